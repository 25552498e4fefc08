"""Alignment-evidence job: alignments and depth to summaries and capabilities."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.operators import alignments as AL, checks, coverage as CV, gates, intervals, scans, stats
from locusframe.session import cut_lineage
from locusframe.sources.fasta import CHUNK_BITS


class Evidence(NamedTuple):
    pairs: DataFrame
    junctions: DataFrame
    profile: DataFrame
    outliers: DataFrame
    windows: DataFrame
    screen: DataFrame
    capabilities: DataFrame


def summarise(
    alignments: DataFrame, runs: DataFrame, sequences: DataFrame, chunks: DataFrame,
    windows: DataFrame, vector: DataFrame, limits: Mapping[str, float], run_id: str,
    chunk_bits: int = CHUNK_BITS,
) -> Evidence:
    """All evidence tables of one sequencing run.

    ``runs`` is run-length depth, ``vector`` one row ``vector_pairs_all,
    vector_pairs_unmapped``; ``limits`` has ``all``, ``unmapped``, ``outlier``.
    """
    nuclear = cut_lineage(sequences.where(F.col("seq_class") == checks.NUCLEAR).select("seqid"))
    pairs = cut_lineage(AL.pair_summary(AL.pair_facts(alignments, nuclear)))
    junctions = cut_lineage(AL.with_motifs(
        AL.junction_support(alignments), chunks, sequences, chunk_bits))
    profile = cut_lineage(CV.profile(runs, sequences))
    bins = cut_lineage(CV.bin_means(runs, sequences))
    outliers = cut_lineage(CV.outliers(bins))
    covered = CV.window_coverage(runs, windows)
    totals = pairs.select("total_query_pairs", "pair_unmapped").withColumns({
        "run_id": F.lit(run_id),
        "vector_pairs_all": vector.select("vector_pairs_all").scalar(),
        "vector_pairs_unmapped": vector.select("vector_pairs_unmapped").scalar(),
        "nuclear_bins": checks.nuclear_only(bins, sequences).agg(F.count(F.lit(1))).scalar(),
        "nuclear_outlier_bins": checks.nuclear_only(outliers, sequences).agg(F.count(F.lit(1))).scalar(),
    })
    screen = gates.engineering_screen(totals, limits["all"], limits["unmapped"], limits["outlier"])
    facts = screen.select("run_id", "conclusion").withColumns({
        "nuclear_all_covered": checks.nuclear_only(profile, sequences).agg(
            F.bool_and(F.col("covered_bases") > 0)).scalar(),
        "with_unique_fragment_support": AL.junction_summary(junctions).select(
            "with_unique_fragment_support").scalar(),
        "classification_complete": pairs.select("classification_complete").scalar(),
        "pair_multiplicity_unknown": pairs.select("pair_multiplicity_unknown").scalar(),
    })
    return Evidence(pairs, junctions, profile, outliers, covered, screen, gates.capabilities(facts))


def submitted_probe(
    alignments: DataFrame, sequences: DataFrame, chunks: DataFrame, window_bp: int,
    per_window: int, minimum_identity: float, endpoint_bp: int, chunk_bits: int = CHUNK_BITS,
) -> tuple[DataFrame, DataFrame]:
    """Classified sample of submitted alignments, and the designed windows.

    Records are chosen by their start in the fixed windows of each sequence,
    the first ``per_window`` by position, name and flag (the sampling is the
    operation itself).
    """
    windows = intervals.fixed_windows(sequences, window_bp).drop("length")
    located = alignments.where((F.col("pos") > 0) & (F.col("rname") != "*")).withColumns({
        "seqid": F.col("rname"), "at": F.col("pos") - 1})
    inside = intervals.start_in_interval(windows, located, ["seqid"], "at").drop("start_pos", "end_pos", "at")
    sample = cut_lineage(scans.top_per_group(
        inside, ["seqid", "window"], ["pos", "qname", "flag", "line_number"], per_window
    ).withColumn("row", F.concat_ws(":", "window", "line_number")))
    measured = AL.reference_identity(sample, chunks, sequences, "row", chunk_bits)
    placed = measured.withColumns({
        "start_pos": F.col("pos") - 1, "end_pos": F.col("target_end")})
    near = intervals.endpoint_proximity(placed, sequences, endpoint_bp)
    return AL.classify(near, minimum_identity), windows


def window_statistics(classified: DataFrame, windows: DataFrame) -> DataFrame:
    """Per designed window: records, class counts and exact median identity."""
    key = ["seqid", "window"]
    near = F.col("endpoint_status").isNotNull()
    counted = classified.groupBy(*key).agg(
        F.count(F.lit(1)).alias("sampled_records"),
        *[F.count_if(F.col("classification") == c).alias(c) for c in stats.ALIGNMENT_CLASSES],
        F.count_if(F.col("splice_junctions") > 0).alias("splice_junction_records"),
        F.count_if(near).alias("endpoint_affected_records"),
        F.count_if(near & (F.col("classification") == "multi_mapping")).alias("endpoint_and_multi_mapping"),
    )
    scaled = classified.where("reference_identity IS NOT NULL").select(
        *key, F.round(F.col("reference_identity") * 1000000).cast("bigint").alias("ppm"))
    middle = stats.exact_median(scaled, "ppm", "ppm_median", key).select(
        *key, F.round(F.col("ppm_median") / 1000000, 6).alias("median_reference_identity"))
    joined = windows.select(*key).join(counted, key, "left").join(middle, key, "left")
    return joined.fillna(0, [c for c in counted.columns if c not in key])


def zero_coverage_windows(statistics: DataFrame) -> DataFrame:
    return statistics.where("sampled_records = 0").select("seqid", "window")


def required_positions(mapped: DataFrame, positions: Sequence[str] = ("first", "middle", "last")) -> DataFrame:
    """Source sequences that lack one of the probe positions."""
    seen = mapped.groupBy("source_seqid").agg(*[
        F.bool_or(F.col("window_position") == p).alias(p) for p in positions])
    complete = F.lit(True)
    for p in positions:
        complete = complete & F.col(p)
    return seen.where(~complete)
