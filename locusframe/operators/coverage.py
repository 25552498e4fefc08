"""Depth runs, profiles, bins and robust outliers.

Depth is kept as runs ``keys, start_pos, end_pos, depth``; a per-position
table is the special case of runs of length one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.functions import cigar as C
from locusframe.operators.intervals import BIN_BITS, KEYS, overlap_join
from locusframe.operators.scans import prefix_scan
from locusframe.operators.stats import exact_median

BIN_WIDTH = 1000


def depth_runs(alignments: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Run-length depth of aligned blocks.

    Unmapped, secondary and records marked failed (0x200) or duplicate (0x400)
    do not count; deleted and skipped bases are not covered.  Block edges
    become +1/-1 events, equal positions collapse map-side, and a tiled
    running sum turns them into runs.  Runs of depth zero are left out.
    """
    keys = list(keys)
    usable = ~C.flag_set("flag", C.UNMAPPED | C.SECONDARY | 0x200 | 0x400)
    blocks = F.filter(C.blocks("cigar", F.col("pos")), lambda b: b["op"].isin("M", "=", "X"))
    edges = alignments.where(usable & (F.col("rname") != "*")).withColumn(
        "seqid", F.col("rname")
    ).select(*keys, F.explode(blocks).alias("b")).select(
        *keys, F.explode(F.array(
            F.struct(F.col("b.ref_start").alias("pos"), F.lit(1).cast("bigint").alias("step")),
            F.struct(F.col("b.ref_end").alias("pos"), F.lit(-1).cast("bigint").alias("step")),
        )).alias("e"))
    events = edges.groupBy(*keys, F.col("e.pos").alias("pos")).agg(F.sum("e.step").alias("step"))
    summed = prefix_scan(
        events, keys, "pos", {"before": ("sum", "step"), "next_pos": ("lead", "pos")})
    return summed.select(
        *keys, F.col("pos").alias("start_pos"), F.col("next_pos").alias("end_pos"),
        (F.col("before") + F.col("step")).alias("depth"),
    ).where("depth > 0 AND end_pos IS NOT NULL")


def as_runs(depth: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per-position depth as runs of length one."""
    return depth.select(
        *keys, F.col("pos").alias("start_pos"), (F.col("pos") + 1).alias("end_pos"), "depth")


def incomplete_depth(depth: DataFrame, sequences: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Sequences whose depth table does not hold every position exactly once."""
    keys = list(keys)
    per_position = depth.groupBy(*keys, "pos").agg(F.count(F.lit(1)).alias("n"))
    seen = per_position.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("positions"), F.sum("n").alias("records"))
    return (
        sequences.select(*keys, "length").join(seen, keys, "left")
        .withColumn("positions", F.coalesce("positions", F.lit(0)))
        .where((F.col("positions") != F.col("length"))
               | (F.coalesce("records", F.lit(0)) != F.col("length")))
        .drop("records")
    )


def profile(runs: DataFrame, sequences: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Covered bases, mean, exact median and maximum depth per sequence.

    The median comes from the histogram of depth values; positions that no run
    mentions count as depth zero.
    """
    keys = list(keys)
    width = F.col("end_pos") - F.col("start_pos")

    def weight(depth, n):
        return F.struct(depth.cast("bigint").alias("depth"), n.cast("bigint").alias("n"))

    # Every sequence starts as all zeros; a run moves its width to its depth.
    zero = F.lit(0)
    moved = runs.join(sequences.select(*keys), keys, "left_semi").select(*keys, F.explode(F.array(
        weight(F.col("depth"), width), weight(zero, -width))).alias("w"))
    start = sequences.select(*keys, weight(zero, F.col("length")).alias("w"))
    full = moved.unionByName(start).groupBy(*keys, F.col("w.depth").alias("depth")).agg(
        F.sum("w.n").alias("n")).where("n > 0")
    ranked = prefix_scan(full, keys, "depth", {"n_below": ("sum", "n"), "n_total": ("total", "n")})

    def at(rank):
        held = (F.col("n_below") <= rank) & (rank < F.col("n_below") + F.col("n"))
        return F.max(F.when(held, F.col("depth")))

    low, high = F.floor((F.col("n_total") - 1) / 2), F.floor(F.col("n_total") / 2)
    covered = F.coalesce(F.sum(F.when(F.col("depth") > 0, F.col("n"))), F.lit(0))
    total = F.sum("n")
    return ranked.groupBy(*keys).agg(
        total.alias("length"),
        covered.alias("covered_bases"),
        (covered / total).alias("coverage_fraction"),
        (F.sum(F.col("depth") * F.col("n")) / total).alias("mean_depth"),
        ((at(low) + at(high)) / 2).alias("median_depth"),
        F.max("depth").alias("max_depth"),
    )


def bin_means(
    runs: DataFrame, sequences: DataFrame, width: int = BIN_WIDTH, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Mean depth of every fixed-width bin; the last bin uses its true width."""
    keys = list(keys)
    split = runs.where("depth > 0").withColumn("bin", F.explode(F.sequence(
        F.floor(F.col("start_pos") / width), F.floor((F.col("end_pos") - 1) / width))))
    shared = F.least(F.col("end_pos"), (F.col("bin") + 1) * width) - F.greatest(
        F.col("start_pos"), F.col("bin") * width)
    sums = split.groupBy(*keys, "bin").agg(F.sum(F.col("depth") * shared).alias("depth_sum"))
    all_bins = sequences.where("length > 0").select(
        *keys, "length",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("length") - 1) / width))).alias("bin"))
    start = F.col("bin") * width
    end = F.least(F.col("length"), start + width)
    return all_bins.join(sums, [*keys, "bin"], "left").select(
        *keys, "bin", start.alias("start_pos"), end.alias("end_pos"),
        (F.coalesce("depth_sum", F.lit(0)) / (end - start)).alias("mean_depth"))


def bin_statistics(bins: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per sequence: bin counts, median and MAD of the non-zero bins, threshold.

    Medians are exact and come from histograms tiled by whole depth units.
    """
    keys = list(keys)
    counts = bins.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_bins"),
        F.count_if(F.col("mean_depth") > 0).alias("nonzero_bins"))
    nonzero = bins.where("mean_depth > 0").select(*keys, "mean_depth")
    middle = exact_median(nonzero, "mean_depth", "median_nonzero", keys, tile_bits=0)
    spread = nonzero.join(middle, keys).select(
        *keys, F.abs(F.col("mean_depth") - F.col("median_nonzero")).alias("deviation"))
    mad = exact_median(spread, "deviation", "mad_nonzero", keys, tile_bits=0)
    center, scale = F.coalesce("median_nonzero", F.lit(0.0)), F.coalesce("mad_nonzero", F.lit(0.0))
    return counts.join(middle, keys, "left").join(mad, keys, "left").select(
        *keys, "total_bins", "nonzero_bins",
        center.alias("median_nonzero"), scale.alias("mad_nonzero"),
        (center + F.greatest(10 * scale, 5 * center, F.lit(10.0))).alias("threshold"))


def outliers(bins: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Bins strictly above their sequence's robust threshold."""
    keys = list(keys)
    return bins.join(bin_statistics(bins, keys), keys).where(
        F.col("mean_depth") > F.col("threshold")
    ).select(*keys, "start_pos", "end_pos", "mean_depth", "median_nonzero", "mad_nonzero",
             F.lit("high_depth_outlier").alias("classification"))


def ordered_outliers(found: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Report order: mean depth descending, then sequence and start."""
    return found.orderBy(F.desc("mean_depth"), *keys, "start_pos")


def window_coverage(
    runs: DataFrame, windows: DataFrame, keys: Sequence[str] = KEYS, bits: int = BIN_BITS
) -> DataFrame:
    """Covered bases, mean and maximum depth of named windows.

    ``windows`` has ``keys, window_id, start_pos, end_pos``; windows that no
    run touches are kept with zeros.
    """
    keys = list(keys)
    named = [*keys, "window_id", "start_pos", "end_pos"]
    renamed = runs.where("depth > 0").select(
        *keys, F.col("start_pos").alias("run_start"), F.col("end_pos").alias("run_end"), "depth")
    hits = overlap_join(
        windows.select(*named), renamed, keys, right_span=("run_start", "run_end"),
        bits=bits)
    shared = F.least("end_pos", "run_end") - F.greatest("start_pos", "run_start")
    sums = hits.groupBy(*named).agg(
        F.sum(shared).alias("covered_bases"),
        F.sum(F.col("depth") * shared).alias("depth_sum"),
        F.max("depth").alias("max_depth"))
    width = F.col("end_pos") - F.col("start_pos")
    zero = F.lit(0)
    return windows.select(*named).join(sums, named, "left").select(
        *named,
        F.coalesce("covered_bases", zero).alias("covered_bases"),
        (F.coalesce("covered_bases", zero) / width).alias("coverage_fraction"),
        (F.coalesce("depth_sum", zero) / width).alias("mean_depth"),
        F.coalesce("max_depth", zero).alias("max_depth"))
