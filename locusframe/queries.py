"""The registered queries: operators over tables derived from the driver's."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe import adapters as A
from locusframe.functions.sequence import reverse_complement
from locusframe.functions.text import attribute_true, attribute_values, wrapped
from locusframe.operators import (
    alignments as AL, annotation as AN, checks as CH, compare as CO, coverage as CV, gates as GA,
    intervals as IV, liftover as LO, provenance as PR, rules as RU, scans as SC, stats as ST,
)
from locusframe.operators.sequences import extract_sequence
from locusframe.session import apply_settings, cut_lineage, shared_folder
from locusframe.plans import baseline as BL
from locusframe.plans.candidates import run_candidates, with_sequence
from locusframe.sources import gff3, published
from locusframe.sources.fasta import chunked, read_fasta
from locusframe.sources.files import verify_declared
from locusframe.sources.reads import parse_sam
from locusframe.sources.sinks import fasta_text

Query = Callable[[SparkSession, str], DataFrame]
NUCLEAR_NAMES = ("chr1", "chr2", "chr3")
_QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    """Register a query under its function name."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return function(apply_settings(spark), folder)

    _QUERIES[function.__name__] = run
    return run


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


# --- clusters, gaps and sequence ends --------------------------------------

@query
def gap_inventory(spark, d):
    return IV.gaps(A.entities(spark, d))


@query
def cluster_merge(spark, d):
    return IV.cluster_spans(A.entities(spark, d))


@query
def edge_strands(spark, d):
    return IV.merge_clusters(A.entities(spark, d))


@query
def cluster_members(spark, d):
    return IV.cluster_members(A.entities(spark, d))


@query
def gap_neighbours(spark, d):
    entities = A.entities(spark, d)
    return IV.gap_neighbours(cut_lineage(IV.gap_spans(entities).withColumn(
        "region_id", IV.region_id("intergenic"))), entities)


@query
def terminal_regions(spark, d):
    nuclear = A.sequences(spark, d).where(F.col("seq_class") == CH.NUCLEAR)
    return IV.terminals(A.entities(spark, d), nuclear).drop(
        "adjacent_sequence_end", "adjacent_end_declaration")


@query
def conservation(spark, d):
    nuclear = A.sequences(spark, d).where(F.col("seq_class") == CH.NUCLEAR)
    return IV.conservation(A.entities(spark, d), nuclear)


@query
def overlap_pairs(spark, d):
    return IV.overlapping_entities(A.entities(spark, d), bits=6)


@query
def overlap_pair_counts(spark, d):
    return IV.overlap_pair_counts(A.entities(spark, d))


@query
def zone_overlaps(spark, d):
    zones = A.zones(spark, d).select(
        "seqid", F.col("start_pos").alias("z_start"), F.col("end_pos").alias("z_end"), "ordinal")
    hits = IV.overlap_join(IV.gaps(A.entities(spark, d)), zones, ["seqid"],
        right_span=("z_start", "z_end"), bits=8)
    return hits.select(
        "seqid", "region_id", "ordinal", F.greatest("start_pos", "z_start").alias("cut_start"),
        F.least("end_pos", "z_end").alias("cut_end"))


@query
def interval_subtraction(spark, d):
    gaps = cut_lineage(IV.gaps(A.entities(spark, d)))
    return IV.subtract(gaps, A.zones(spark, d), span_keys=["region_id"], bits=8)


@query
def fixed_windows(spark, d):
    return IV.fixed_windows(A.sequences(spark, d), 5000)


@query
def endpoint_proximity(spark, d):
    near = IV.endpoint_proximity(A.entities(spark, d), A.sequences(spark, d), 1000)
    return near.drop("strand", "start_conf", "end_conf")


@query
def point_in_window(spark, d):
    suppliers = A.table(spark, d, "supplier").agg(F.count(F.lit(1))).scalar()
    points = A.table(spark, d, "events").select(
        F.concat(F.lit("chr"), F.col("user_id") % suppliers).alias("seqid"),
        (F.col("event_id") * 97 % 60100).alias("pos"), "value")
    windows = IV.fixed_windows(A.sequences(spark, d), 5000)
    return IV.start_in_interval(windows, points, ["seqid"], "pos").groupBy("seqid", "window").agg(
        F.count(F.lit(1)).alias("points"), F.round(F.sum("value"), 2).alias("total"))


# --- contract checks -------------------------------------------------------

@query
def bounds_violations(spark, d):
    known = A.sequences(spark, d).where(F.col("seq_class") == CH.NUCLEAR).withColumn(
        "length", F.lit(59900).cast("bigint"))
    return CH.bounds_violations(A.entities(spark, d), known).select(
        "seqid", "entity_id", "start_pos", "end_pos", "problem")


@query
def unclassified_sequences(spark, d):
    classes = A.table(spark, d, "part").select(
        F.concat(F.lit("chr"), F.col("p_partkey") * 2).alias("seqid"))
    return CH.unclassified_sequences(A.sequences(spark, d), classes)


@query
def sequence_remap(spark, d):
    number = F.substring("seqid", 4, 20).cast("bigint")
    explicit = A.sequences(spark, d).select("seqid", F.when(
        number % 4 == 1, F.concat(F.lit("chr"), number + 1)
    ).when(number % 4 == 3, F.concat(F.lit("gone"), number)).alias("target")).where("target IS NOT NULL")
    return CH.sequence_map(A.entities(spark, d), A.sequences(spark, d), explicit)


@query
def nuclear_only(spark, d):
    return CH.nuclear_only(A.entities(spark, d), A.sequences(spark, d)).select("seqid", "entity_id")


@query
def endpoint_violations(spark, d):
    ends = A.table(spark, d, "supplier").select(
        F.concat(F.lit("chr"), "s_suppkey").alias("seqid"),
        F.when(F.col("s_acctbal") < 0, "broken").otherwise("complete").alias("five_prime"),
        F.when(F.col("s_nationkey") <= 12, "partial").alias("three_prime"))
    return CH.endpoint_violations(ends)


# --- annotation ------------------------------------------------------------

def _annotation(spark: SparkSession, d: str) -> DataFrame:
    # Text lines stand for a file; without the cut, filters on parsed columns
    # would rebuild each line from its table many times.
    parsed = gff3.parse_features(cut_lineage(A.gff_lines(spark, d)))
    return gff3.with_ids(parsed.where("problem IS NULL").drop("problem", "file"))


@query
def duplicate_ids(spark, d):
    return AN.duplicate_ids(A.loose_features(spark, d))


@query
def duplicate_lines(spark, d):
    return AN.duplicate_lines(A.loose_features(spark, d))


@query
def missing_parents(spark, d):
    return AN.missing_parents(A.loose_features(spark, d))


@query
def ambiguous_parents(spark, d):
    return AN.ambiguous_parents(A.loose_features(spark, d))


@query
def ancestor_closure(spark, d):
    seeds = A.table(spark, d, "nation").where("n_regionkey = 1").select(
        F.concat(F.lit("n"), "n_nationkey").alias("id"))
    return AN.reachable_ids(A.forest_links(spark, d), seeds)


@query
def normalized_entities(spark, d):
    entities = AN.functional_entities(cut_lineage(_annotation(spark, d)))
    return entities.withColumns({
        "start_range": F.array_join("start_range", ","), "end_range": F.array_join("end_range", ",")
    }).drop("source_feature_ids", "five_prime_conf", "three_prime_conf")


@query
def diagnostic_counts(spark, d):
    found = AN.normalize(_annotation(spark, d))
    return AN.diagnostic_totals(found.features, found.entities, summary=found.summary)


@query
def abnormal_order(spark, d):
    placed = A.table(spark, d, "events").select(
        F.concat(F.lit("chr"), "user_id").alias("seqid"), "event_id",
        F.col("value").cast("bigint").alias("start_pos"), F.col("event_id").alias("end_pos"),
        F.lit("").alias("entity_id"))
    return AN.abnormal_order(placed, position="event_id")


@query
def entity_boundary_summary(spark, d):
    return ST.entity_boundary_summary(AN.functional_entities(cut_lineage(_annotation(spark, d))))


@query
def gff_parse(spark, d):
    return _annotation(spark, d).select(
        "line_number", "seqid", "feature_type", "start_pos", "end_pos", "strand", "feature_id",
        F.array_join("parents", ",").alias("parent_ids"))


@query
def attribute_map(spark, d):
    genes = gff3.feature_identity(_annotation(spark, d).where("feature_type = 'gene'"))
    return genes.select(
        "line_number", "feature_id", "name",
        F.array_join(attribute_values("attributes", "Note"), "|").alias("notes"), "gene_id",
        attribute_true("attributes", "partial").alias("partial"))


@query
def type_counts(spark, d):
    return ST.type_counts(_annotation(spark, d))


@query
def source_profile(spark, d):
    features = _annotation(spark, d).withColumn("source_id", F.col("seqid"))
    return CO.source_profile(features).withColumn(
        "missing_feature_types", F.array_join("missing_feature_types", ","))


# --- statistics ------------------------------------------------------------

@query
def describe_lengths(spark, d):
    return ST.length_distributions(IV.gaps(A.entities(spark, d)))


@query
def orientation_counts(spark, d):
    return ST.orientation_counts(IV.gaps(A.entities(spark, d)))


@query
def high_confidence_subset(spark, d):
    return ST.high_confidence_summary(IV.gaps(A.entities(spark, d)))


@query
def sequence_statistics(spark, d):
    entities = A.entities(spark, d)
    return ST.sequence_statistics(
        A.sequences(spark, d), entities, IV.cluster_spans(entities), IV.gap_spans(entities))


# --- candidate windows -----------------------------------------------------

def _candidates(spark: SparkSession, d: str) -> tuple[DataFrame, RU.CandidateResult]:
    regions = cut_lineage(IV.gaps(A.entities(spark, d)))
    return regions, RU.candidate_windows(regions, 5, 10, zones=A.zones(spark, d), bits=8)


@query
def candidate_windows(spark, d):
    windows = _candidates(spark, d)[1].windows
    return RU.window_view(windows).drop("rule_flags", "left_confidence", "right_confidence")


@query
def excluded_regions(spark, d):
    return _candidates(spark, d)[1].excluded


@query
def excluded_by_rule(spark, d):
    return RU.excluded_by_rule(_candidates(spark, d)[1].excluded)


@query
def rule_summary(spark, d):
    regions, result = _candidates(spark, d)
    return RU.rule_summary(
        regions, RU.CandidateResult(cut_lineage(result.windows), cut_lineage(result.excluded)))


@query
def window_split(spark, d):
    return _candidates(spark, d)[1].windows.groupBy("split_count").agg(
        F.countDistinct("region_id").alias("regions"), F.count(F.lit(1)).alias("windows"),
        F.count_if("keeps_left").alias("keep_left"), F.count_if("keeps_right").alias("keep_right"))


@query
def long_interval_threshold(spark, d):
    return RU.long_interval_threshold(IV.gaps(A.entities(spark, d)))


# --- alignments ------------------------------------------------------------

def _alignments(spark: SparkSession, d: str) -> DataFrame:
    return parse_sam(cut_lineage(A.sam_lines(spark, d))).where("well_formed").drop("well_formed", "file")


@query
def sam_parse(spark, d):
    return _alignments(spark, d).select(
        "line_number", "qname", "flag", "rname", "pos", "cigar", "nh")


@query
def pair_classes(spark, d):
    return AL.pair_facts(_alignments(spark, d), NUCLEAR_NAMES)


@query
def pair_summary(spark, d):
    return AL.pair_summary(AL.pair_facts(_alignments(spark, d), NUCLEAR_NAMES))


@query
def record_counts(spark, d):
    return AL.record_counts(_alignments(spark, d))


@query
def both_unmapped(spark, d):
    return AL.both_unmapped(_alignments(spark, d)).select("line_number", "qname", "flag")


@query
def junction_support(spark, d):
    return AL.junction_support(_alignments(spark, d))


@query
def motif_counts(spark, d):
    _, lengths, chunks = A.document_store(spark, d)
    # An intron at every 40 bases of every text; the last may reach beyond its end.
    introns = lengths.where("length IS NOT NULL").select("seqid", F.explode(F.sequence(
        F.lit(5).cast("bigint"), F.greatest(F.col("length") - 1, F.lit(5)), F.lit(40).cast("bigint"))).alias("at")).select(
        F.col("seqid").alias("rname"), F.col("at").alias("intron_start"), (F.col("at") + 25).alias("intron_end"))
    found = AL.with_motifs(introns, chunks, lengths)
    return found.groupBy("motif", "canonical").agg(F.count(F.lit(1)).alias("n"))


@query
def reference_identity(spark, d):
    pieces, lengths, chunks = A.document_store(spark, d)
    # A read at every 200 bases of every text; alignments follow three patterns in turn, the last may reach beyond the end.
    at, bases = F.col("at"), F.col("stretch")

    def piece(first: int, size: int):
        return F.substring(bases, first + 1, size)

    patterns = [
        ("20M10D30M5S", F.concat(piece(0, 20), piece(30, 30), F.lit("AAAAA"))),
        ("3H10M5I20M8N15M", F.concat(piece(0, 10), F.lit("TTTTT"), piece(10, 20), piece(38, 15))),
        ("4S12M3P18M2H", F.concat(F.lit("CCCC"), piece(0, 12), piece(13, 18)))]
    turn = F.col("at") / 200 % len(patterns)
    # A byte slice costs its own length, a character slice its distance from the start of the text.
    reads = pieces.where("bases <> ''").select("seqid", F.col("bases").cast("binary").alias("raw"), F.explode(F.sequence(
        F.lit(0), F.length("bases") - 1, F.lit(200))).alias("at")).withColumn(
        "stretch", F.substring("raw", at + 1, F.lit(60)).cast("string")).select(
        F.col("seqid").alias("rname"), "at", F.concat_ws(":", "seqid", "at").alias("line_number"),
        (at + 1).cast("bigint").alias("pos"),
        F.coalesce(*[F.when(turn == k, F.lit(cigar)) for k, (cigar, _) in enumerate(patterns)]).alias("cigar"),
        F.coalesce(*[F.when(turn == k, seq) for k, (_, seq) in enumerate(patterns)]).alias("seq"))
    # Two files with equal line numbers; the reads of the second hold one base only.
    files = reads.withColumn("file", F.explode(F.array(F.lit("a"), F.lit("b")))).withColumn(
        "seq", F.when(F.col("file") == "a", F.col("seq")).otherwise(F.repeat(F.lit("A"), F.length("seq"))))
    found = AL.reference_identity(files, chunks, lengths)
    return found.select(
        "file",
        "line_number", "aligned_bases", "matches", "splice_junctions", "target_end",
        "coordinate_valid", "reference_identity")


# --- coverage --------------------------------------------------------------

@query
def depth_runs(spark, d):
    return CV.depth_runs(_alignments(spark, d))


@query
def coverage_profile(spark, d):
    found = CV.profile(CV.depth_runs(_alignments(spark, d)), A.sequences(spark, d))
    return found.withColumns({
        "coverage_fraction": F.round("coverage_fraction", 6), "mean_depth": F.round("mean_depth", 6)})


def _bins(spark: SparkSession, d: str) -> DataFrame:
    return CV.bin_means(CV.depth_runs(_alignments(spark, d)), A.sequences(spark, d))


@query
def bin_means(spark, d):
    return _bins(spark, d).withColumn("mean_depth", F.round("mean_depth", 6))


@query
def bin_statistics(spark, d):
    return CV.bin_statistics(cut_lineage(_bins(spark, d))).withColumns({
        c: F.round(c, 6) for c in ("median_nonzero", "mad_nonzero", "threshold")})


@query
def depth_outliers(spark, d):
    return CV.outliers(cut_lineage(_bins(spark, d))).withColumns({
        c: F.round(c, 6) for c in ("mean_depth", "median_nonzero", "mad_nonzero")})


@query
def window_coverage(spark, d):
    windows = IV.fixed_windows(A.sequences(spark, d), 5000).withColumnRenamed("window", "window_id")
    found = CV.window_coverage(CV.depth_runs(_alignments(spark, d)), windows)
    return found.withColumns({
        "coverage_fraction": F.round("coverage_fraction", 6), "mean_depth": F.round("mean_depth", 6)})


# --- comparison ------------------------------------------------------------

@query
def mirror_compare(spark, d):
    start = (F.col("l_orderkey") * 37 + F.col("l_linenumber") * 11) % 60000
    left = A.table(spark, d, "lineitem").select(
        F.concat(F.lit("gene-g"), "l_orderkey").alias("id"),
        F.concat(F.lit("chr"), "l_suppkey").alias("seqid"), F.lit("gene").alias("feature_type"),
        start.alias("start_pos"), (start + F.col("l_quantity").cast("int")).alias("end_pos"),
        F.when(F.col("l_returnflag") == "A", "+").otherwise("-").alias("strand"))
    with_map = left.withColumn("attributes", F.create_map(F.lit("ID"), F.array("id")))
    right = with_map.where(F.col("start_pos") % 5 != 0).withColumn(
        "end_pos", F.when(F.col("start_pos") % 3 == 0, F.col("end_pos") + 1).otherwise(F.col("end_pos")))
    return CO.mirror(CO.canonical_genes(with_map), CO.canonical_genes(right))


@query
def exact_shared(spark, d):
    left = A.table(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("fact"))
    right = A.table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("fact"))
    return CO.exact_shared(left, right, "id", ["fact"])


@query
def two_sided_diff(spark, d):
    orders = A.table(spark, d, "orders")
    published = orders.select("o_custkey", "o_orderstatus")
    recomputed = orders.select("o_custkey", F.when(F.col("o_totalprice") > 300000, "X").otherwise(
        F.col("o_orderstatus")).alias("o_orderstatus"))
    return CO.two_sided_diff(published, recomputed)


@query
def set_difference(spark, d):
    left = A.table(spark, d, "customer").select(F.col("c_custkey").alias("custkey"))
    right = A.table(spark, d, "orders").where("o_orderstatus = 'F'").select(
        F.col("o_custkey").alias("custkey"))
    return CO.set_difference(left, right, ["custkey"])


@query
def table_hash(spark, d):
    return CO.table_hash(A.table(spark, d, "lineitem"))


# --- sequences and lift-over -----------------------------------------------

@query
def reverse_complement_documents(spark, d):
    return A.documents_as_bases(spark, d).select("seqid", reverse_complement("bases").alias("reversed"))


@query
def sequence_chunks(spark, d):
    return chunked(A.documents_as_bases(spark, d), ["seqid"])


def _fasta_files(spark, d):
    """Documents as FASTA files: a header and lines of 70 bases, two texts of one name never in one file."""
    path = f"{shared_folder(spark)}/fasta-{uuid.uuid4().hex}"
    pieces = A.documents_as_bases(spark, d)
    lines = F.concat(F.lit(">"), "seqid", F.lit(" document "), F.length("bases"), F.when(
        F.col("bases") != "", F.concat(F.lit("\n"), F.lower(wrapped("bases")))).otherwise(""))
    pieces.where("bases IS NOT NULL").select(lines.alias("value")).write.text(path)
    return path


@query
def fasta_index(spark, d):
    return read_fasta(spark, _fasta_files(spark, d)).sequences.select("seqid", "length", "description")


@query
def fasta_chunks(spark, d):
    return read_fasta(spark, _fasta_files(spark, d)).chunks.select("seqid", "chunk_no", "bases")


@query
def window_sequence(spark, d):
    _, lengths, chunks = A.document_store(spark, d)
    spans = lengths.select(
        "seqid", F.floor(F.col("length") / 4).alias("start_pos"),
        F.floor(F.col("length") / 2).alias("end_pos"))
    return extract_sequence(spans, chunks)


@query
def anchor_hits(spark, d):
    pieces, _, chunks = A.document_store(spark, d)
    # An anchor at every 500 bases of every text.
    anchors = pieces.where(F.length("bases") >= 21).select(F.col("bases").cast("binary").alias("raw"), F.explode(F.sequence(
        F.lit(0), F.length("bases") - 21, F.lit(500))).alias("at")).select(
        F.substring("raw", F.col("at") + 1, F.lit(21)).cast("string").alias("anchor"))
    return LO.anchor_hits(anchors, chunks, 21)


@query
def boundary_mapping(spark, d):
    _, lengths, chunks = A.document_store(spark, d)
    # A gene in every 1,000 bases; short texts and ends of texts give genes at the sequence edge.
    places = lengths.where("length IS NOT NULL").select("seqid", "length", F.explode(F.sequence(
        F.lit(0).cast("bigint"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(1000).cast("bigint"))).alias("at"))
    size = F.least(F.col("length") - F.col("at"), F.lit(1000))
    genes = places.select(
        F.concat_ws(":", "seqid", "at").alias("feature_id"), "seqid", (F.col("at") + F.floor(size / 4)).alias("start_pos"),
        (F.col("at") + F.floor(size / 2)).alias("end_pos"), F.lit("+").alias("strand"))
    return LO.map_boundaries(genes, lengths, chunks, chunks)


@query
def probe_trios(spark, d):
    genes = A.entities(spark, d).withColumn("feature_id", F.col("entity_id"))
    return LO.probe_trios(genes).select("seqid", "entity_id", "window_position", "window_id")


@query
def first_middle_last(spark, d):
    return LO.first_middle_last(IV.gaps(A.entities(spark, d))).select(
        "seqid", "region_id", "start_pos", "end_pos")


@query
def top_n_per_window(spark, d):
    events = A.table(spark, d, "events").select("user_id", "event_id", "ts")
    return SC.top_per_group(events, ["user_id"], ["ts", "event_id"], 5)


@query
def fasta_export(spark, d):
    _, lengths, chunks = A.document_store(spark, d)
    spans = lengths.where("length > 0").select(
        F.col("seqid").alias("candidate_id"), "seqid", F.lit(0).cast("bigint").alias("start_pos"),
        F.col("length").alias("end_pos"), "length")
    return fasta_text(with_sequence(spans, chunks))


@query
def gene_list_positions(spark, d):
    key, chromosome = F.col("o_orderkey"), F.col("o_custkey") % 7
    position = (
        F.when(key % 3 == 0, F.format_string("%d:%d..%d", chromosome, key, key + 9))
        .when(key % 3 == 1, F.format_string("%d:complement(%d..%d)", chromosome, key, key + 9))
        .otherwise(F.format_string("%d:join(%d..%d,%d..%d)", chromosome, key + 50, key + 60, key, key + 9)))
    rows = A.table(spark, d, "orders").select(
        key.alias("line_number"), F.concat(F.lit("ppa:G"), F.floor(key / 2)).alias("id"),
        position.alias("position"))
    found = CO.gene_list_positions(rows)
    return found.select("gene_id", "place.seqid", "place.first", "place.last", "place.strand")


@query
def header_compatibility(spark, d):
    key = F.col("s_suppkey")
    header = A.table(spark, d, "supplier").select(
        F.concat(F.lit("chr"), key).alias("rname"),
        (60100 + (key % 3) * 2147483648 + F.when(key % 4 == 0, 1).otherwise(0)).alias("declared_length"))
    return AL.header_compatibility(header, A.sequences(spark, d))


# --- gates -----------------------------------------------------------------

@query
def source_status(spark, d):
    key = F.col("c_custkey")
    sources = A.table(spark, d, "customer").select(
        key.alias("source_id"),
        F.when(key % 5 == 0, "unavailable").when(key % 5 == 1, "metadata_only").otherwise("available").alias("availability"),
        F.when(key % 3 == 0, "coordinate mirror").otherwise("original").alias("relationship"),
        F.lit("boundaries").alias("expected_use"), F.col("c_mktsegment").alias("strain"),
        F.when(key % 2 == 0, "A").otherwise("B").alias("coordinate_space"),
        F.when(key % 7 != 0, F.abs("c_acctbal") / 10000).alias("partial_gene_fraction"))
    rated = GA.source_status(sources, "BUILDING", "A")
    return rated.select("source_id", "qualification_status",
                        F.array_join("qualification_reasons", "|").alias("reasons"))


@query
def engineering_screen(spark, d):
    totals = A.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("run_id")).agg(
        F.count(F.lit(1)).alias("total_query_pairs"),
        F.count_if(F.col("o_orderstatus") == "F").alias("pair_unmapped"),
        F.count_if(F.col("o_totalprice") > 450000).alias("vector_pairs_all"),
        F.count_if((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 450000)).alias("vector_pairs_unmapped"),
        F.count_if(F.col("o_orderpriority") < "4").alias("nuclear_bins"),
        F.count_if(F.col("o_orderpriority") < "2").alias("nuclear_outlier_bins"))
    found = GA.engineering_screen(totals, 0.2, 0.3, 0.5)
    return found.withColumns({c: F.round(c, 6) for c in (
        "vector_fraction_all", "vector_fraction_unmapped", "outlier_fraction")})


@query
def phrase_gate(spark, d):
    checked = CH.phrase_gate(A.table(spark, d, "documents"), "text", ["the of", "with"])
    return checked.select("doc_id", "phrases_present")


@query
def gate_eligibility(spark, d):
    facts = A.table(spark, d, "orders").groupBy(
        F.concat(F.lit("study"), "o_custkey").alias("study")
    ).agg(F.max("o_totalprice").alias("top"), F.min("o_orderdate").alias("first"),
          F.countDistinct("o_orderstatus").alias("states"))
    gates = GA.gate_rows(facts, ["study"], {
        "price": GA.passed(F.col("top") > 250000),
        "date": GA.passed(F.col("first") > F.lit("1993-01-01").cast("timestamp")),
        "states": GA.passed(F.col("states") == 3),
    })
    return GA.eligible(gates, ["study"])


@query
def replication_gate(spark, d):
    return GA.replication(A.samples(spark, d), ["study"], at_least=10)


@query
def date_gate(spark, d):
    dated = A.samples(spark, d).withColumn("release", F.lit("1995-06-17"))
    return GA.temporal_independence(dated, "collection_date", "release").select(
        "study", "sample", "status")


# --- runs ------------------------------------------------------------------

@query
def step_log_order(spark, d):
    return PR.step_log(A.steps(spark, d), ["run_id"], 100)


@query
def repeatability(spark, d):
    return PR.repeatability(A.document_files(spark, d), A.document_files(spark, d, changed=True))


@query
def declared_identity(spark, d):
    declared = A.document_files(spark, d).withColumnRenamed("name", "path")
    observed = A.document_files(spark, d, changed=True).withColumnRenamed("name", "path")
    return verify_declared(declared, observed).select("path", "problem", "matches")


@query
def run_catalog(spark, d):
    return _entries(spark, d)


def _entries(spark, d):
    return PR.catalog(
        A.runs(spark, d), A.run_artifacts(spark, d), A.artifact_identities(spark, d), A.acceptance(spark, d))


@query
def displayable_runs(spark, d):
    return PR.displayable(_entries(spark, d), PR.BASELINE).select("run_id", "scientific_acceptance_status")


@query
def parent_status(spark, d):
    return PR.with_parent(cut_lineage(_entries(spark, d))).select(
        "run_id", "parent_run_id", "displayable", "parent_status", "parent_displayable")


@query
def status_banner(spark, d):
    return PR.status_banner(_entries(spark, d), A.runs(spark, d))


@query
def missing_artifacts(spark, d):
    return PR.missing_artifacts(A.runs(spark, d), A.run_artifacts(spark, d))


@query
def evidence_chain(spark, d):
    """Every customer vouches for a run by the digest of its manifest; a sixth of these manifests is unknown."""
    runs = A.table(spark, d, "customer").select("c_custkey", F.sha2(F.col("c_custkey").cast("string"), 256).alias("manifest_sha256"))
    claims = runs.select(F.concat(F.lit("label"), "c_custkey").alias("label"), "manifest_sha256")
    manifests = runs.where("c_custkey % 6 <> 5").select(
        F.col("manifest_sha256").alias("sha256"), F.concat(F.lit("r"), "c_custkey").alias("run_id"))
    return PR.evidence_chain(claims, manifests, A.run_artifacts(spark, d), A.artifact_identities(spark, d))


@query
def published_runs(spark, d):
    """A baseline and a candidate run of the annotation: their catalogue entries, and the rows of their reloaded tables."""
    root = f"{shared_folder(spark)}/runs-{uuid.uuid4().hex}"
    features = cut_lineage(_annotation(spark, d))
    known = {"seq_class": CH.NUCLEAR, "five_prime": "complete", "three_prime": "partial"} | {
        f"{end}_{what}": what for end in ("five_prime", "three_prime") for what in ("evidence", "declaration")}
    sequences = features.groupBy("seqid").agg((F.max("end_pos") + 10).alias("length")).withColumns(
        {name: F.lit(value) for name, value in known.items()})
    run = spark.createDataFrame([("baseline-derived", 2, "derived", "complete", "pending", "blocked")], (
        "run_id STRING, schema_version INT, target_strain STRING, execution_status STRING, verification_status STRING, "
        "scientific_acceptance_status STRING"))
    text = features.agg(F.sum("line_number").alias("size_bytes"), F.sha2(F.max("seqid"), 256).alias("sha256"))
    BL.publish(spark, BL.inventory(features, sequences, written=True), run, text.withColumn("role", F.lit("fasta")), f"{root}/a")
    bases = chunked(sequences.select("seqid", F.lit(0).alias("start_pos"), F.repeat(
        F.lit("ACGT"), F.ceil(F.col("length") / 4).cast("int")).alias("bases")), ["seqid"])
    child = run_candidates(spark, f"{root}/a", bases, None, 10, 20, f"{root}/b").first()["run_id"]
    entries = cut_lineage(published.scan(spark, root))
    sizes = None
    for name, run_id, table in (("entities", "baseline-derived", "entities"), ("regions", "baseline-derived", "regions"),
                                ("terminals", "baseline-derived", "terminals"), ("split regions", child, "windows"),
                                ("split regions", child, "excluded")):
        rows = published.load_table(spark, root, run_id, table, entries=entries).agg(F.count("*").alias("rows")).select(
            F.lit(run_id).alias("run_id"), F.lit(name).alias("table_name"), "rows")
        sizes = rows if sizes is None else sizes.unionByName(rows)
    return entries.join(sizes.groupBy("run_id", "table_name").agg(F.sum("rows").alias("rows")), "run_id").select(
        "run_type", "parent_run_id", "displayable", "reason", "verification_status", "table_name", "rows")


@query
def parent_inputs(spark, d):
    inputs = A.table(spark, d, "customer").select(
        F.concat(F.lit("r"), "c_custkey").alias("run_id"), F.lit("fasta").alias("role"),
        F.sha2(F.floor(F.col("c_nationkey") / 5).cast("string"), 256).alias("sha256"))
    return PR.parent_inputs(A.runs(spark, d), inputs).select("run_id", "parent_run_id", "problem")


@query
def run_id(spark, d):
    facts = A.table(spark, d, "customer").select(
        F.col("c_custkey").alias("run_key"), F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").cast("bigint").cast("string").alias("balance")
    ).unpivot(["run_key"], ["name", "segment", "balance"], "fact", "value").withColumnRenamed("fact", "name")
    return PR.run_id(facts, ["run_key"], "run")


@query
def acceptance_checks(spark, d):
    suppliers = A.table(spark, d, "supplier").agg(F.count(F.lit(1))).scalar()
    customers = A.table(spark, d, "customer")
    run = F.concat(F.lit("r"), "c_custkey").alias("run_id")
    expected = customers.select(run, F.explode(F.create_map(
        F.lit("nation"), F.col("c_nationkey").cast("string"), F.lit("solvent"), F.lit("yes")
    )).alias("check", "expected"))
    nations = customers.join(
        A.table(spark, d, "supplier"), F.col("c_custkey") % suppliers == F.col("s_suppkey"), "left")
    observed = nations.select(run, F.explode(F.create_map(
        F.lit("nation"), F.col("s_nationkey").cast("string"),
        F.lit("solvent"), F.when(F.col("c_acctbal") >= 0, "yes").otherwise("no")
    )).alias("check", "observed"))
    return PR.accepted(PR.acceptance_checks(expected, observed))


# --- checks over derived records -------------------------------------------

@query
def paths_outside(spark, d):
    key = F.col("c_custkey")
    path = (F.when(key % 7 == 0, F.concat(F.lit("../../e/"), key)).when(key % 5 == 0, F.concat(F.lit("a/"), key))
            .when(key % 5 == 1, F.concat(F.lit("../x/"), key)).when(key % 5 == 2, F.concat(F.lit("d/../"), key))
            .when(key % 5 == 3, F.concat(F.lit("/root/x/./"), key)).otherwise(F.concat(F.lit("/root/x/../"), key)))
    return CH.paths_outside(A.table(spark, d, "customer").select("c_custkey", path.alias("path")), "/root/x")


@query
def forbidden_files(spark, d):
    key = F.col("c_custkey")
    name = F.when(key % 3 == 0, "SRR").when(key % 3 == 1, "srr_").otherwise("xsrr")
    files = A.table(spark, d, "customer").select("c_custkey", F.concat(F.lit("d/"), name, key).alias("path"))
    return CH.forbidden_files(files, ["srr"])


@query
def missing_assembly_directive(spark, d):
    directives = A.table(spark, d, "orders").select(
        F.concat(F.lit("f"), "o_custkey").alias("file"),
        F.concat(F.lit("#!genome-build-accession NCBI_Assembly:A"), F.col("o_orderkey") % 3).alias("value"))
    expected = A.table(spark, d, "customer").select(
        F.concat(F.lit("f"), "c_custkey").alias("file"), F.lit("A1").alias("assembly_accession"),
        (F.col("c_custkey") % 4 != 0).alias("required"))
    return CH.missing_assembly_directive(directives, expected).select("file")


@query
def incomplete_fields(spark, d):
    key = F.col("c_custkey")
    sources = A.table(spark, d, "customer").select(
        key.alias("source_id"), F.when(key % 3 != 0, F.col("c_mktsegment")).alias("strain"),
        F.when(key % 4 == 0, "  ").otherwise(F.col("c_name")).alias("terms"))
    found = CH.incomplete_fields(sources, {"strain": "no strain", "terms": "no terms"})
    return found.select("source_id", F.array_join("reasons", "|").alias("reasons"))


@query
def mirror_groups(spark, d):
    mirror = F.when(F.col("c_custkey") % 3 == 0, "coordinate mirror").otherwise("original")
    return GA.mirror_groups(A.table(spark, d, "customer").select(
        F.col("c_nationkey").alias("independence_group"), mirror.alias("relationship")))


@query
def metadata_contract(spark, d):
    key = F.col("c_custkey")
    customers = A.table(spark, d, "customer")
    observed = customers.where(key % 5 != 0).select(
        key.alias("run"), (F.col("c_nationkey") + (key % 3 == 0).cast("int")).alias("nation"),
        F.col("c_mktsegment").alias("segment"))
    expected = GA.observed_checks(
        customers.select(key.alias("run"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")),
        ["run"], ["nation", "segment"]).withColumnRenamed("observed", "expected")
    return GA.metadata_contract(GA.observed_checks(observed, ["run"], ["nation", "segment"]), expected, ["run"])


@query
def accession_links(spark, d):
    key = F.col("c_custkey")
    expected = A.table(spark, d, "customer").select(
        key.alias("run"), F.concat(F.lit("e"), key).alias("experiment"),
        F.concat(F.lit("p"), "c_nationkey").alias("project"), F.concat(F.lit("10.1/"), "c_mktsegment").alias("publication"))
    archive = expected.where("run % 5 <> 0")
    report = expected.withColumn("project", F.when(F.col("run") % 4 == 0, "other").otherwise(F.col("project")))
    return GA.accession_links(archive, report, expected, "run", ["experiment", "project", "publication"])


@query
def declared_bytes(spark, d):
    records = A.table(spark, d, "orders").select(F.concat_ws(";", "o_orderkey", "o_custkey", F.lit("x")).alias("bytes"))
    return GA.declared_bytes(records, "bytes")


def _measured(spark: SparkSession, d: str) -> DataFrame:
    records = A.table(spark, d, "lineitem").select(
        F.nullif(F.col("l_linenumber") % 3, F.lit(0)).alias("nh"),
        F.when(F.col("l_returnflag") == "A", 256).when(F.col("l_returnflag") == "N", 16).otherwise(0).alias("flag"),
        (F.col("l_discount") <= 0.08).alias("coordinate_valid"), (F.col("l_quantity") / 50).alias("reference_identity"),
        F.when(F.col("l_tax") > 0.06, "near an end").alias("endpoint_status"))
    return AL.classify(records, 0.5)


@query
def alignment_classes(spark, d):
    return _measured(spark, d).groupBy("classification", "alignment_orientation").agg(F.count(F.lit(1)).alias("n"))


@query
def endpoint_classes(spark, d):
    found = AL.class_counts(_measured(spark, d))
    return found.toDF("alignment_class", "n")
