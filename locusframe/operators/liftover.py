"""Exact-anchor lift-over of feature boundaries between assemblies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.functions.sequence import flip_strand, reverse_complement
from locusframe.operators import seeds
from locusframe.operators.scans import ordered_index
from locusframe.operators.sequences import extract_sequence
from locusframe.operators.stats import MAPPING_STATUSES, counts_over_domain
from locusframe.session import cut_lineage, ship
from locusframe.sources.fasta import CHUNK_BITS

# Reason texts of the mapping results.
REASON_EDGE = "boundary anchor reaches source sequence edge"
REASON_NONE = "neither boundary anchor maps exactly"
REASON_MANY = "one or both boundary anchors are missing or non-unique"
REASON_TARGETS = "boundary anchors map to different target identities"
REASON_ORDER = "boundary anchor order conflicts with mapping orientation"
REASON_GOOD = "both 101-bp boundary anchors map uniquely and coherently"
REASON_ADJACENCY = (
    "exact boundary anchors establish collinear order only; target gene adjacency was not qualified"
)
HIT_CAP = 3


# --- probe selection -------------------------------------------------------

def probe_trios(genes: DataFrame, keys: Sequence[str] = ("seqid",)) -> DataFrame:
    """First, middle and last trio of neighbouring genes per sequence.

    A gene near two centres belongs to the first window that claims it.
    """
    ranked = ordered_index(genes, keys, ["start_pos", "end_pos", "feature_id"])
    n, at = F.col("n_rows"), F.col("rank")
    last = n - 1

    def near(center: Column) -> Column:
        return (
            (at == F.greatest(F.lit(0), center - 1)) | (at == center)
            | (at == F.least(last, center + 1))
        )

    label = (
        F.when(near(F.lit(1)), "first")
        .when(near(F.floor(n / 2)), "middle")
        .when(near(F.greatest(F.lit(1), n - 2)), "last")
    )
    return (
        ranked.withColumn("window_position", label)
        .where(F.col("window_position").isNotNull())
        .withColumn("window_id", F.concat_ws(":", *keys, "window_position"))
        .drop("rank", "n_rows")
    )


def first_middle_last(regions: DataFrame, keys: Sequence[str] = ("seqid",)) -> DataFrame:
    """The first, the middle and the last row of every sequence by start."""
    ranked = ordered_index(regions, keys, ["start_pos", "end_pos"])
    n, at = F.col("n_rows"), F.col("rank")
    return ranked.where((at == 0) | (at == F.floor(n / 2)) | (at == n - 1)).drop("rank", "n_rows")


# --- anchor search ---------------------------------------------------------

def kmer_texts(
    chunks: DataFrame, k: int, keys: Sequence[str] = ("seqid",), chunk_bits: int = CHUNK_BITS
) -> DataFrame:
    """Texts (keys, origin, bases) that hold every run of ``k`` bases of every sequence exactly once.

    A chunk holds its own; those over a chunk border are in the last ``k - 1``
    bases of one chunk and the ``k - 1`` bases after it, of as many chunks as
    hold them; only these ends travel.
    """
    keys = list(keys)
    size = 1 << chunk_bits
    edge = F.lit(k - 1)
    after = max(1, -(-(k - 1) // size))  # chunks that hold the bases after a border
    tails = chunks.select(*keys, (F.col("chunk_no") + 1).alias("border"),
                          F.right("bases", edge).alias("tail"), F.lit(None).cast("string").alias("head"))
    if after == 1:
        heads = chunks.select(*keys, F.col("chunk_no").alias("border"),
                              F.lit(None).cast("string").alias("tail"), F.left("bases", edge).alias("head"))
        head = F.max("head")
    else:
        tails = tails.withColumn("nth", F.lit(None).cast("int"))
        heads = chunks.withColumn("nth", F.explode(F.sequence(F.lit(0), F.lit(after - 1)))).select(
            *keys, (F.col("chunk_no") - F.col("nth")).alias("border"), F.lit(None).cast("string").alias("tail"),
            F.left("bases", edge - F.col("nth") * size).alias("head"), "nth")
        pieces = F.array_sort(F.collect_list(F.when(F.col("head").isNotNull(), F.struct("nth", "head"))))
        head = F.when(F.size(pieces) > 0, F.array_join(pieces["head"], ""))
    # A sequence of one chunk has no border, so most short sequences send nothing.
    borders = tails.where(F.length("tail") > 0).unionByName(heads.where("border > 0")).groupBy(*keys, "border").agg(
        F.max("tail").alias("tail"), head.alias("head")
    ).where("tail IS NOT NULL AND head IS NOT NULL")
    return chunks.select(*keys, (F.col("chunk_no") * size).alias("origin"), "bases").unionByName(
        borders.select(*keys, (F.col("border") * size - F.length("tail")).alias("origin"),
                       F.concat("tail", "head").alias("bases")))


def kmer_starts(
    chunks: DataFrame, k: int, keys: Sequence[str] = ("seqid",), chunk_bits: int = CHUNK_BITS
) -> DataFrame:
    """Every start position of every sequence with its k-mer.

    The bases are read as bytes: a byte slice costs its own length, a
    character slice would cost its distance from the chunk start.
    """
    starts = kmer_texts(chunks, k, keys, chunk_bits).where(F.length("bases") >= k).select(
        *keys, "origin", F.col("bases").cast("binary").alias("raw"),
        F.explode(F.sequence(F.lit(0), F.length("bases") - k)).alias("i"))
    return starts.select(
        *keys, (F.col("origin") + F.col("i")).alias("pos"),
        F.substring("raw", F.col("i") + 1, F.lit(k)).alias("kmer"))


def anchor_hits(
    anchors: DataFrame, chunks: DataFrame, k: int, keys: Sequence[str] = ("seqid",),
    chunk_bits: int = CHUNK_BITS, ns: Sequence[str] = (),
) -> DataFrame:
    """Exact occurrences of each anchor on both strands: count and first hit.

    ``anchors`` has ``anchor`` (length ``k``; others have no hits) and the
    columns of ``ns``, such as a run: an anchor is searched only in target
    sequences with the same values.  The target is scanned once (see
    ``seeds``); what passes the filter of all anchors and their reverse
    complements is counted and minimised per k-mer, so an anchor that matches
    a third of the target combines map-side, and then joins the anchors on
    the whole k-mer.  The first hit follows sequence name, then strand, then
    position.  An anchor that is its own reverse complement is found once per
    strand.
    """
    keys, ns = list(keys), list(ns)
    distinct = anchors.select(*ns, "anchor").where(F.length("anchor") == k).distinct()
    probes = cut_lineage(distinct.select(*ns, "anchor", F.explode(F.array(
        F.struct(F.col("anchor").alias("q"), F.lit("+").alias("o")),
        F.struct(reverse_complement("anchor").alias("q"), F.lit("-").alias("o")),
    )).alias("p")).select(
        *ns, "anchor", F.col("p.o").alias("hit_orientation"), F.col("p.q").cast("binary").alias("kmer")))
    ship(anchors.sparkSession)
    table = seeds.bloom_filter(probes, "kmer", k, probes.count())
    seen = seeds.candidates(kmer_texts(chunks, k, [*ns, *keys], chunk_bits), k, [*ns, *keys], table)
    counted = seen.groupBy(*ns, "kmer").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct(*keys, "pos")).alias("at"))
    order = F.struct(
        *[F.col(f"at.{c}").alias(c) for c in keys],
        F.when(F.col("hit_orientation") == "+", 0).otherwise(1).alias("strand_order"),
        F.col("at.pos").alias("pos"))
    found = probes.join(counted, [*ns, "kmer"]).groupBy(*ns, "anchor").agg(
        F.sum("n").alias("hits"), F.min(order).alias("first"))
    return found.select(
        *ns, "anchor", "hits", F.least("hits", F.lit(HIT_CAP)).alias("capped_hits"),
        *[F.col(f"first.{c}").alias(f"hit_{c}") for c in keys],
        F.when(F.col("first.strand_order") == 0, "+").otherwise("-").alias("hit_orientation"),
        F.col("first.pos").alias("hit_pos"))


# --- boundaries ------------------------------------------------------------

def map_boundaries(
    features: DataFrame, sequences: DataFrame, source_chunks: DataFrame,
    target_chunks: DataFrame, flank: int = 50, chunk_bits: int = CHUNK_BITS,
    ns: Sequence[str] = (),
) -> DataFrame:
    """Place both ends of every feature in the target by exact anchors.

    All tables share the columns of ``ns``, such as a run; several runs in one
    call give the rows that each would give by itself.
    """
    k, ns = 2 * flank + 1, list(ns)
    at = [*ns, "seqid"]
    first, last = F.col("start_pos"), F.col("end_pos") - 1
    at_edge = (first - flank < 0) | (last + flank >= F.col("length"))
    base = features.join(sequences.select(*at, "length"), at).withColumns({
        "at_edge": at_edge,
        "start_from": F.when(~at_edge, first - flank),
        "end_from": F.when(~at_edge, last - flank),
    })
    spans = base.where(~F.col("at_edge")).select(*at, F.explode(F.array(
        "start_from", "end_from")).alias("start_pos")).withColumn("end_pos", F.col("start_pos") + k)
    texts = cut_lineage(extract_sequence(spans, source_chunks, at, chunk_bits=chunk_bits).select(
        *at, F.col("start_pos").alias("from"), F.col("sequence").alias("anchor")))
    hits = anchor_hits(texts, target_chunks, k, chunk_bits=chunk_bits, ns=ns)
    placed = cut_lineage(texts.join(hits, [*ns, "anchor"], "left").select(
        *at, "from", F.coalesce("hits", F.lit(0)).alias("hits"),
        F.coalesce("capped_hits", F.lit(0)).alias("capped"),
        F.col("hit_seqid").alias("t_seqid"), F.col("hit_orientation").alias("t_or"),
        (F.col("hit_pos") + flank).alias("t_center")))

    def side(name: str) -> DataFrame:
        return placed.select(
            *at, F.col("from").alias(f"{name}_from"),
            *[F.col(c).alias(f"{name}_{c}") for c in ("hits", "capped", "t_seqid", "t_or", "t_center")])

    joined = base.join(side("start"), [*at, "start_from"], "left").join(
        side("end"), [*at, "end_from"], "left")
    one_each = (F.col("start_hits") == 1) & (F.col("end_hits") == 1)
    none = (F.col("start_hits") == 0) & (F.col("end_hits") == 0)
    same = (F.col("start_t_seqid") == F.col("end_t_seqid")) & (F.col("start_t_or") == F.col("end_t_or"))
    plus = F.col("start_t_or") == "+"
    ordered = F.when(plus, F.col("start_t_center") <= F.col("end_t_center")).otherwise(
        F.col("end_t_center") <= F.col("start_t_center"))
    status = (
        F.when(F.col("at_edge"), F.struct(F.lit("uncertain").alias("s"), F.lit(REASON_EDGE).alias("r")))
        .when(none, F.struct(F.lit("unmappable").alias("s"), F.lit(REASON_NONE).alias("r")))
        .when(~one_each, F.struct(F.lit("uncertain").alias("s"), F.lit(REASON_MANY).alias("r")))
        .when(~same, F.struct(F.lit("conflict").alias("s"), F.lit(REASON_TARGETS).alias("r")))
        .when(~ordered, F.struct(F.lit("conflict").alias("s"), F.lit(REASON_ORDER).alias("r")))
        .otherwise(F.struct(F.lit("consistent").alias("s"), F.lit(REASON_GOOD).alias("r")))
    )
    good = F.col("mapping_status") == "consistent"
    target_start = F.least("start_t_center", "end_t_center")
    target_end = F.greatest("start_t_center", "end_t_center") + 1
    extra = [c for c in features.columns if c not in ("seqid", "start_pos", "end_pos", "strand", "attributes")]
    inside = ~F.col("at_edge")
    return joined.withColumn("verdict", status).withColumns({
        "mapping_status": F.col("verdict.s"), "mapping_reason": F.col("verdict.r"),
    }).select(
        *extra,
        F.when(inside, F.col("seqid")).alias("source_seqid"),
        F.when(inside, F.col("start_pos")).alias("source_start"),
        F.when(inside, F.col("end_pos")).alias("source_end"),
        F.when(inside, F.col("strand")).alias("source_strand"),
        F.when(inside, F.lit(k)).alias("anchor_length"),
        F.col("start_capped").alias("start_anchor_hit_count"),
        F.col("end_capped").alias("end_anchor_hit_count"),
        "mapping_status", "mapping_reason",
        F.when(good, F.col("start_t_seqid")).alias("target_seqid"),
        F.when(good, target_start).alias("target_start"),
        F.when(good, target_end).alias("target_end"),
        F.when(good, F.col("start_t_or")).alias("assembly_orientation"),
        F.when(good, flip_strand(F.col("strand"), ~plus)).alias("mapped_strand"),
        F.when(good, target_start - F.col("start_pos")).alias("start_boundary_offset"),
        F.when(good, target_end - F.col("end_pos")).alias("end_boundary_offset"),
    )


def order_status(mapped: DataFrame, ns: Sequence[str] = ()) -> DataFrame:
    """One row per probe window (and ``ns``): is the source order kept in the target?

    A window is a trio of genes, so its sorted list holds three rows at most.
    """
    center = F.floor((F.col("target_start") + F.col("target_end")) / 2)
    grouped = mapped.groupBy(*ns, "window_id").agg(
        F.bool_and(F.col("mapping_status") == "consistent").alias("all_good"),
        F.min("target_seqid").alias("t1"), F.max("target_seqid").alias("t2"),
        F.min("assembly_orientation").alias("o1"), F.max("assembly_orientation").alias("o2"),
        F.array_sort(F.collect_list(F.struct(F.col("source_start").alias("s"), center.alias("c")))).alias("rows"),
    )
    centers = F.col("rows")["c"]
    kept = F.when(F.col("o1") == "+", centers == F.sort_array(centers)).otherwise(
        centers == F.sort_array(centers, asc=False))
    status = (
        F.when(~F.col("all_good"), "uncertain")
        .when((F.col("t1") != F.col("t2")) | (F.col("o1") != F.col("o2")), "conflict")
        .when(kept, "preserved").otherwise("conflict")
    )
    return grouped.select(
        *ns, "window_id", status.alias("order_status"), F.lit("unavailable").alias("adjacency_status"),
        F.lit(REASON_ADJACENCY).alias("adjacency_reason"))


def mapping_counts(mapped: DataFrame) -> DataFrame:
    return counts_over_domain(mapped, "mapping_status", MAPPING_STATUSES)


def mapping_summary(mapped: DataFrame, orders: DataFrame) -> DataFrame:
    """Long table ``measure, label, n`` of the lift-over report."""

    def measure(df: DataFrame, name: str, label: str) -> DataFrame:
        return df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(name).alias("measure"), "label", "n")

    status = mapping_counts(mapped).select(
        F.lit("mapping_status").alias("measure"), F.col("mapping_status").alias("label"), "n")
    totals = mapped.agg(
        F.count(F.lit(1)).alias("probe_record_count"),
        F.countDistinct("source_seqid").alias("source_sequence_count"),
        F.countDistinct("window_id").alias("window_count"),
    ).unpivot([], ["probe_record_count", "source_sequence_count", "window_count"], "measure", "n")
    return (
        status.unionByName(measure(orders, "order_status", "order_status"))
        .unionByName(measure(orders, "adjacency_status", "adjacency_status"))
        .unionByName(totals.select("measure", F.lit("*").alias("label"), "n"))
    )
