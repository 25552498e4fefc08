"""Read pairs, splice junctions and reference identity of alignments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.functions import cigar as C
from locusframe.functions.sequence import is_canonical, splice_motif
from locusframe.operators.sequences import extract_sequence
from locusframe.operators.stats import ALIGNMENT_CLASSES, counts_over_domain
from locusframe.session import broadcast_if_small, cut_lineage
from locusframe.sources.fasta import CHUNK_BITS

# Bits of the packed facts about one primary mate.
_UNMAPPED, _PROPER, _NH_ONE, _NH_MANY, _CLIP, _INDEL, _FOREIGN, _ALL = 1, 2, 4, 8, 16, 32, 64, 128


# --- pairs -----------------------------------------------------------------

def _mate_facts(nuclear: Column) -> Column:
    def bit(test: Column, value: int) -> Column:
        return F.when(test, value).otherwise(0)

    known = F.col("cigar") != "*"
    return (
        bit(C.flag_set("flag", C.UNMAPPED), _UNMAPPED)
        + bit(C.flag_set("flag", C.PROPER), _PROPER)
        + bit(F.col("nh") == 1, _NH_ONE)
        + bit(F.col("nh") > 1, _NH_MANY)
        + bit(known & C.has_operation("cigar", ("S",), 20), _CLIP)
        + bit(known & C.has_operation("cigar", ("I", "D"), 20), _INDEL)
        + bit((F.col("rname") != "*") & ~nuclear, _FOREIGN)
    )


def _file_keys(alignments: DataFrame) -> list[str]:
    """Line numbers and query names are unique in one file only."""
    return ["file"] if "file" in alignments.columns else []


def pair_facts(
    alignments: DataFrame, nuclear: Sequence[str] | DataFrame, keys: Sequence[str] | None = None
) -> DataFrame:
    """One row per key and query name with the facts its classes depend on.

    ``nuclear`` names the nuclear sequences: a few names, or a written table
    with ``seqid`` of any size.
    Without ``keys`` the file is the key, if there is that column: runs that
    share query names stay apart.
    The first primary mate of each side is the one with the lowest line
    number; line number and facts are packed into one integer, so the choice
    is a plain ``min`` that combines before the shuffle.
    """
    primary = ~C.flag_set("flag", C.SECONDARY | C.SUPPLEMENTARY)
    keys = _file_keys(alignments) if keys is None else list(keys)
    if isinstance(nuclear, DataFrame):
        names = nuclear.select(F.col("seqid").alias("rname")).distinct().withColumn("__nuclear", F.lit(True))
        alignments = alignments.join(broadcast_if_small(names), "rname", "left")
        inside = F.coalesce("__nuclear", F.lit(False))
    else:
        inside = F.col("rname").isin(*nuclear)
    packed = F.col("line_number") * _ALL + _mate_facts(inside)
    grouped = alignments.groupBy(*keys, "qname").agg(
        F.min(F.when(primary & C.flag_set("flag", C.FIRST), packed)).alias("m1"),
        F.min(F.when(primary & C.flag_set("flag", C.SECOND), packed)).alias("m2"),
        F.bool_or(C.flag_set("flag", C.SECONDARY)).alias("has_secondary"),
        F.bool_or(C.flag_set("flag", C.SUPPLEMENTARY)).alias("has_supplementary"),
    )
    both = F.col("m1").isNotNull() & F.col("m2").isNotNull()

    def of(mate: str, bit: int) -> Column:
        return F.col(mate).bitwiseAND(F.lit(bit)) != 0

    def either(bit: int) -> Column:
        return both & (of("m1", bit) | of("m2", bit))

    def every(bit: int) -> Column:
        return both & of("m1", bit) & of("m2", bit)

    unmapped, mixed = every(_UNMAPPED), either(_UNMAPPED) & ~every(_UNMAPPED)
    mapped = both & ~either(_UNMAPPED)
    unique = mapped & every(_NH_ONE) & ~F.col("has_secondary")
    multi = mapped & ~unique & (F.col("has_secondary") | either(_NH_MANY))
    named = {
        "unknown_pair_structure": ~both,
        "pair_unmapped": unmapped,
        "pair_mixed": mixed,
        "pair_both_mapped": mapped,
        "pair_proper": mapped & every(_PROPER),
        "pair_discordant": mapped & ~every(_PROPER),
        "pair_unique": unique,
        "pair_multi": multi,
        "pair_multiplicity_unknown": mapped & ~unique & ~multi,
        "pair_softclip_ge20": either(_CLIP),
        "pair_indel_ge20": either(_INDEL),
        "pair_non_nuclear_reference": either(_FOREIGN),
        "pair_with_supplementary": F.col("has_supplementary"),
    }
    return grouped.select(
        *keys, "qname", *[F.coalesce(test, F.lit(False)).alias(n) for n, test in named.items()])


def pair_summary(pairs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Counts of every pair class, and whether the classes cover all pairs."""
    classes = [name for name, kind in pairs.dtypes if kind == "boolean" and name not in keys]
    counted = pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_query_pairs"),
        *[F.count_if(c).alias(c) for c in classes])
    covered = (F.col("pair_unmapped") + F.col("pair_mixed") + F.col("pair_both_mapped")
               + F.col("unknown_pair_structure"))
    return counted.withColumn("classification_complete", covered == F.col("total_query_pairs"))


def record_counts(alignments: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return alignments.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("alignment_records"),
        F.count_if(C.flag_set("flag", C.SECONDARY)).alias("secondary_alignment_records"),
        F.count_if(C.flag_set("flag", C.SUPPLEMENTARY)).alias("supplementary_alignment_records"),
    )


def both_unmapped(alignments: DataFrame) -> DataFrame:
    """Primary records of pairs with neither mate mapped."""
    wanted = F.col("flag").bitwiseAND(F.lit(12)) == 12
    return alignments.where(wanted & ~C.flag_set("flag", 2304))


# --- junctions -------------------------------------------------------------

def junctions(alignments: DataFrame) -> DataFrame:
    """One row per skipped stretch of every record."""
    skips = F.filter(C.blocks("cigar", F.col("pos")), lambda b: b["op"] == "N")
    return alignments.where(F.contains("cigar", F.lit("N"))).withColumn(
        "j", F.explode(skips)).withColumns({
            "intron_start": F.col("j.ref_start"), "intron_end": F.col("j.ref_end")}).drop("j")


def junction_support(alignments: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per junction: query names with unique and with multi support.

    A query name counts once per class.  The first grouping includes the query
    name, so a hot junction is spread before it is counted.
    """
    keys = list(keys)
    usable = ~C.flag_set("flag", C.UNMAPPED | C.SUPPLEMENTARY)
    rows = alignments.where(usable & (F.col("rname") != "*") & (F.col("cigar") != "*"))
    unique = F.coalesce(F.col("nh") == 1, F.lit(False)) & ~C.flag_set("flag", C.SECONDARY)
    place = [*keys, "rname", "intron_start", "intron_end"]
    per_query = junctions(rows.withColumn("is_unique", unique)).groupBy(*place, "qname").agg(
        F.bool_or("is_unique").alias("u"), F.bool_or(~F.col("is_unique")).alias("m"))
    return per_query.groupBy(*place).agg(
        F.count_if("u").alias("unique_support"), F.count_if("m").alias("multi_support"))


def junction_summary(support: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return support.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("distinct_junctions"),
        F.count_if(F.col("unique_support") > 0).alias("with_unique_fragment_support"),
        F.count_if(F.col("multi_support") > 0).alias("with_multi_fragment_support"),
    )


def with_motifs(
    support: DataFrame, chunks: DataFrame, sequences: DataFrame, chunk_bits: int = CHUNK_BITS
) -> DataFrame:
    """Add the intron motif; ``unavailable`` outside the known sequence.

    An intron with both its ends in one chunk reads them where it meets that
    chunk; only ends in different chunks are extracted and joined back.
    """
    named = support.withColumn("seqid", F.col("rname")).join(
        sequences.select("seqid", "length"), "seqid", "left")
    start, end = F.col("intron_start"), F.col("intron_end")
    inside = (start >= 0) & (start < end) & (end <= F.col("length"))
    known = named.withColumns({
        "inside": F.coalesce(inside, F.lit(False)),
        "donor_end": F.least(start + 2, F.col("length")),
        "acceptor_start": F.greatest(end - 2, F.lit(0)),
    })
    first = F.shiftright(F.least(start, F.col("acceptor_start")), chunk_bits)
    last = F.shiftright(F.greatest(F.col("donor_end"), end) - 1, chunk_bits)
    at_once = F.col("inside") & (first == last)
    base = first * (1 << chunk_bits)

    def piece(low: Column, high: Column) -> Column:
        return F.substring("bases", (low - base + 1).cast("int"), (high - low).cast("int"))

    near = known.where(at_once).withColumn("chunk_no", first).join(
        chunks.select("seqid", "chunk_no", "bases"), ["seqid", "chunk_no"], "left").withColumns({
            "donor": piece(start, F.col("donor_end")), "acceptor": piece(F.col("acceptor_start"), end)})
    rest = known.where(~at_once)
    ends = rest.where("inside").select("seqid", F.explode(F.array(
        F.struct(start.alias("s"), F.col("donor_end").alias("e")),
        F.struct(F.col("acceptor_start").alias("s"), end.alias("e")),
    )).alias("x")).select("seqid", F.col("x.s").alias("start_pos"), F.col("x.e").alias("end_pos"))
    bases = extract_sequence(ends, chunks, chunk_bits=chunk_bits)
    donor = bases.select("seqid", F.col("start_pos").alias("intron_start"),
                         F.col("end_pos").alias("donor_end"), F.col("sequence").alias("donor"))
    acceptor = bases.select("seqid", F.col("start_pos").alias("acceptor_start"),
                            F.col("end_pos").alias("intron_end"), F.col("sequence").alias("acceptor"))
    looked_up = rest.join(donor, ["seqid", "intron_start", "donor_end"], "left").join(
        acceptor, ["seqid", "intron_end", "acceptor_start"], "left")
    both = [*support.columns, "inside", "donor", "acceptor"]
    motif = F.when(F.col("inside"), splice_motif(F.col("donor"), F.col("acceptor"))).otherwise("unavailable")
    return near.select(*both).unionByName(looked_up.select(*both)).withColumn("motif", motif).select(
        *support.columns, "motif", is_canonical(motif).alias("canonical"))


# --- identity against the reference ----------------------------------------

def reference_identity(
    alignments: DataFrame, chunks: DataFrame, sequences: DataFrame,
    row_key: str | Sequence[str] | None = None, chunk_bits: int = CHUNK_BITS,
) -> DataFrame:
    """Aligned and matching bases of every record against its reference.

    ``row_key`` tells records apart: by default file, if there is that
    column, and line number.
    A record inside one chunk is counted there.  Of others each aligned block is
    cut at chunk borders and carries only its own bases, so introns of any
    length need no wide overlap.  A block that runs past
    the read or the sequence makes the record invalid; counts of the blocks
    before it are kept.
    """
    if row_key is None:
        row_key = [*_file_keys(alignments), "line_number"]
    row_key = [row_key] if isinstance(row_key, str) else list(row_key)
    walk = alignments.join(
        sequences.select(F.col("seqid").alias("rname"), "length"), "rname", "left"
    ).withColumns({
        "walk": C.blocks("cigar", F.col("pos")),
        "read_length": F.length("seq"),
        "length": F.coalesce("length", F.lit(0)),
    })

    def runs_over(b: Column) -> Column:
        size = b["ref_end"] - b["ref_start"]
        return b["op"].isin("M", "=", "X") & (
            (b["ref_end"] > F.col("length")) | (b["read_start"] + size > F.col("read_length")))

    numbered = F.transform("walk", lambda b, i: F.struct(
        b["op"].alias("op"), b["ref_start"].alias("ref_start"), b["ref_end"].alias("ref_end"),
        b["read_start"].alias("read_start"), i.alias("i"), runs_over(b).alias("over")))
    stop = F.array_min(F.transform(F.filter(numbered, lambda b: b["over"]), lambda b: b["i"]))
    limited = walk.withColumns({"walk": numbered, "stop": stop}).withColumn(
        "kept", F.when(F.col("stop").isNull(), F.col("walk")).otherwise(
            F.filter("walk", lambda b: b["i"] < F.col("stop"))))
    aligned_blocks = F.filter("kept", lambda b: b["op"].isin("M", "=", "X"))
    zero = F.lit(0).cast("bigint")
    described = limited.withColumns({
        "aligned_bases": F.aggregate(
            aligned_blocks, zero, lambda a, b: a + b["ref_end"] - b["ref_start"]),
        "splice_junctions": F.size(F.filter("kept", lambda b: b["op"] == "N")),
        "target_end": F.coalesce(
            F.get("walk", F.col("stop"))["ref_start"],
            F.get("walk", F.size("walk") - 1)["ref_end"],
            F.col("pos") - 1),
    })
    size = 1 << chunk_bits

    def alike(query: Column, target: Column) -> Column:
        same = F.zip_with(F.split(query, ""), F.split(target, ""), lambda q, r: (q == r).cast("int"))
        return F.aggregate(same, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))

    described = cut_lineage(described.withColumn("aligned", F.filter(aligned_blocks, lambda b: b["ref_end"] > b["ref_start"])).drop(
        "walk", "kept")).withColumns({
            "first_chunk": F.shiftright(F.array_min(F.col("aligned")["ref_start"]), chunk_bits),
            "last_chunk": F.shiftright(F.array_max(F.col("aligned")["ref_end"]) - 1, chunk_bits)})
    # A record whose blocks lie in one chunk is counted where it meets that chunk.
    at_once = F.coalesce(F.col("first_chunk") == F.col("last_chunk"), F.lit(False))

    def block_matches(b: Column) -> Column:
        n = (b["ref_end"] - b["ref_start"]).cast("int")
        return alike(F.substring("seq", (b["read_start"] + 1).cast("int"), n), F.substring(
            "bases", (b["ref_start"] - F.col("first_chunk") * size + 1).cast("int"), n))

    near = described.where(at_once).join(chunks.select(
        F.col("seqid").alias("rname"), F.col("chunk_no").alias("first_chunk"), "bases"), ["rname", "first_chunk"], "left").withColumn(
        "matches", F.when(F.col("bases").isNotNull(), F.aggregate("aligned", zero, lambda a, b: a + block_matches(b)))).drop("bases")
    rest = described.where(~at_once)
    placed = rest.select(
        *row_key, "rname", "seq", F.explode("aligned").alias("b")
    ).withColumn(
        "chunk_no", F.explode(F.sequence(
            F.shiftright("b.ref_start", chunk_bits),
            F.shiftright(F.col("b.ref_end") - 1, chunk_bits))))
    base = F.col("chunk_no") * size
    low = F.greatest(F.col("b.ref_start"), base)
    high = F.least(F.col("b.ref_end"), base + size)
    queries = placed.select(
        *row_key, F.col("rname").alias("seqid"), "chunk_no", (low - base).cast("int").alias("at"),
        F.substring("seq", (F.col("b.read_start") + low - F.col("b.ref_start") + 1).cast("int"),
                    (high - low).cast("int")).alias("query"))
    matched = (
        queries.join(chunks, ["seqid", "chunk_no"])
        .select(*row_key, alike(F.col("query"), F.substring("bases", F.col("at") + 1, F.length("query"))).alias("m"))
        .groupBy(*row_key).agg(F.sum("m").alias("matches"))
    )
    valid = F.col("stop").isNull() & (F.col("aligned_bases") > 0)
    return near.unionByName(rest.join(matched, row_key, "left")).withColumn(
        "matches", F.coalesce("matches", zero)
    ).withColumns({
        "coordinate_valid": valid,
        "reference_identity": F.when(
            valid, F.round(F.col("matches") / F.col("aligned_bases"), 6)),
    }).select(*alignments.columns, "aligned_bases", "matches", "splice_junctions", "target_end",
              "coordinate_valid", "reference_identity")


def classify(alignments: DataFrame, minimum_identity: float) -> DataFrame:
    """Add ``classification``; multi-mapping wins over conflict over endpoint."""
    multi = (F.coalesce("nh", F.lit(1)) > 1) | C.flag_set("flag", C.SECONDARY)
    poor = ~F.col("coordinate_valid") | (F.col("reference_identity") < minimum_identity)
    return alignments.withColumns({
        "classification": F.when(multi, "multi_mapping").when(poor, "conflict").when(
            F.col("endpoint_status").isNotNull(), "endpoint_limited").otherwise("success"),
        "alignment_orientation": F.when(
            C.flag_set("flag", C.REVERSE), "reverse").otherwise("forward"),
    })


def class_counts(classified: DataFrame) -> DataFrame:
    return counts_over_domain(classified, "classification", ALIGNMENT_CLASSES)


def header_compatibility(
    header: DataFrame, sequences: DataFrame, seq_map: DataFrame | None = None
) -> DataFrame:
    """Declared lengths, modulo 2**31, against the reference lengths."""
    named = header.withColumn("seqid", F.col("rname"))
    if seq_map is not None:
        named = header.join(
            seq_map.select(F.col("source_seqid").alias("rname"), F.col("target_seqid").alias("seqid")),
            "rname")
    normal = F.pmod(F.col("declared_length"), F.lit(2147483648))
    return named.join(sequences.select("seqid", "length"), "seqid", "left").select(
        "rname", "seqid", "declared_length", normal.alias("normalized_length"),
        F.col("length").alias("target_length"),
        F.coalesce(normal == F.col("length"), F.lit(False)).alias("length_identity"))
