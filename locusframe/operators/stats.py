"""Counts, rank statistics and summary tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.operators.scans import TILE_BITS, prefix_scan

# The report domains, in the order reports list them.
ORIENTATIONS = ("convergent", "tandem", "divergent", "unknown")
MAPPING_STATUSES = ("consistent", "conflict", "unmappable", "uncertain")
ALIGNMENT_CLASSES = ("success", "multi_mapping", "conflict", "endpoint_limited", "unmappable")


# --- rank statistics -------------------------------------------------------

def _ranked_histogram(df: DataFrame, value: str, by: Sequence[str], tile_bits: int) -> DataFrame:
    """Distinct values with their counts, the count below and the group size."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(
        F.count(F.lit(1)).alias("n"))
    return prefix_scan(
        counted, by, value, {"n_below": ("sum", "n"), "n_total": ("total", "n")}, tile_bits)


def _at_rank(value: str, rank: Column) -> Column:
    held = (F.col("n_below") <= rank) & (rank < F.col("n_below") + F.col("n"))
    return F.max(F.when(held, F.col(value)))


def _nearest(fraction: float) -> Column:
    """0-based nearest rank, ties to even."""
    return F.bround((F.col("n_total") - 1) * F.lit(float(fraction)))


def nearest_rank(
    df: DataFrame, value: str, fractions: Mapping[str, float],
    by: Sequence[str] = (), tile_bits: int = TILE_BITS,
) -> DataFrame:
    """Exact nearest-rank percentiles of a non-negative number, per group.

    Works on the histogram of distinct values, so equal values collapse
    map-side and no group is ever sorted in one task.
    """
    ranked = _ranked_histogram(df, value, by, tile_bits)
    return ranked.groupBy(*by).agg(
        *[_at_rank(value, _nearest(f)).alias(out) for out, f in fractions.items()])


def exact_median(
    df: DataFrame, value: str, out: str, by: Sequence[str] = (), tile_bits: int = TILE_BITS
) -> DataFrame:
    """Exact median (mean of the two middle values), per group."""
    ranked = _ranked_histogram(df, value, by, tile_bits)
    low = _at_rank(value, F.floor((F.col("n_total") - 1) / 2))
    high = _at_rank(value, F.floor(F.col("n_total") / 2))
    return ranked.groupBy(*by).agg(((low + high) / 2).alias(out))


def describe(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """count, min, p25, median, p75, max and mean of an integer column."""
    ranked = _ranked_histogram(df, value, by, TILE_BITS)
    total = F.coalesce(F.sum("n"), F.lit(0))
    return ranked.groupBy(*by).agg(
        total.alias("count"),
        F.min(value).alias("min"),
        _at_rank(value, _nearest(0.25)).alias("p25"),
        _at_rank(value, _nearest(0.5)).alias("median"),
        _at_rank(value, _nearest(0.75)).alias("p75"),
        F.max(value).alias("max"),
        F.round(F.sum(F.col(value) * F.col("n")) / F.sum("n"), 6).alias("mean"),
    )


# --- zero-filled counts ----------------------------------------------------

def domain_table(df: DataFrame, column: str, domain: Sequence[str]) -> DataFrame:
    """The fixed domain of a category as a one-column table."""
    values = F.array(*[F.lit(v) for v in domain])
    return df.sparkSession.range(1).select(F.explode(values).alias(column))


def counts_over_domain(
    df: DataFrame, column: str, domain: Sequence[str], out: str = "n"
) -> DataFrame:
    """Row count per category, with zeros for categories that do not occur."""
    counted = df.groupBy(column).agg(F.count(F.lit(1)).alias(out))
    return (
        domain_table(df, column, domain)
        .join(counted, column, "left")
        .select(column, F.coalesce(out, F.lit(0)).alias(out))
    )


def fraction(part: Column, whole: Column, empty: float | None = 0.0) -> Column:
    """``part / whole`` to six digits; ``empty`` when the whole is zero."""
    return F.coalesce(F.round(F.try_divide(part.cast("double"), whole), 6),
                      F.lit(empty).cast("double"))


# --- inventory reports -----------------------------------------------------

def orientation_counts(regions: DataFrame) -> DataFrame:
    return counts_over_domain(regions, "orientation", ORIENTATIONS)


def high_confidence(regions: DataFrame) -> DataFrame:
    return regions.where("left_confidence = 'high' AND right_confidence = 'high'")


def length_distributions(regions: DataFrame) -> DataFrame:
    """Length description overall, per orientation and for confident regions."""
    trusted = (F.col("left_confidence") == "high") & (F.col("right_confidence") == "high")
    labels = F.array_compact(F.array(
        F.lit("all"), F.col("orientation"), F.when(trusted, F.lit("high_confidence"))))
    described = describe(
        regions.select(F.explode(labels).alias("subset"), "length"), "length", ["subset"])
    domain = domain_table(regions, "subset", ("all", "high_confidence", *ORIENTATIONS))
    return domain.join(described, "subset", "left").withColumn(
        "count", F.coalesce("count", F.lit(0)))


def high_confidence_summary(regions: DataFrame) -> DataFrame:
    """One row: how many regions are confident on both sides, and their kinds."""
    trusted = (F.col("left_confidence") == "high") & (F.col("right_confidence") == "high")
    hits = F.count_if(trusted)
    return regions.agg(
        F.count(F.lit(1)).alias("region_count"),
        hits.alias("high_confidence_count"),
        fraction(hits, F.count(F.lit(1))).alias("high_confidence_fraction"),
        *[F.count_if(trusted & (F.col("orientation") == o)).alias(f"{o}_count")
          for o in ORIENTATIONS],
    )


def sequence_statistics(
    sequences: DataFrame, entities: DataFrame, clusters: DataFrame, regions: DataFrame,
    keys: Sequence[str] = ("seqid",),
) -> DataFrame:
    """Per sequence: entities, and clusters and gaps of nuclear sequences."""
    keys = list(keys)
    counted = (
        entities.select(*keys, F.lit("functional_entity_count").alias("what"))
        .unionByName(clusters.select(*keys, F.lit("boundary_cluster_count").alias("what")))
        .unionByName(regions.select(*keys, F.lit("intergenic_region_count").alias("what")))
        .groupBy(*keys)
        .agg(*[F.count_if(F.col("what") == w).alias(w) for w in (
            "functional_entity_count", "boundary_cluster_count", "intergenic_region_count")])
    )
    nuclear = F.col("seq_class") == "nuclear_chromosome"
    joined = sequences.select(*keys, "seq_class", "length").join(counted, keys, "left")
    return joined.select(
        *keys, "seq_class", "length",
        F.coalesce("functional_entity_count", F.lit(0)).alias("functional_entity_count"),
        *[F.when(nuclear, F.coalesce(c, F.lit(0))).otherwise(0).alias(c)
          for c in ("boundary_cluster_count", "intergenic_region_count")],
        (~nuclear).alias("excluded_from_nuclear_statistics"),
    )


def entity_boundary_summary(entities: DataFrame) -> DataFrame:
    """Partial and open-range counts per entity type, and over all (`*`)."""
    has_start, has_end = F.size("start_range") > 0, F.size("end_range") > 0
    labels = F.explode(F.array(F.lit("*"), F.col("entity_type"))).alias("entity_type")
    return (
        entities.select(labels, "partial", has_start.alias("s"), has_end.alias("e"))
        .groupBy("entity_type")
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.count_if("partial").alias("partial_count"),
            F.count_if("s").alias("start_range_count"),
            F.count_if("e").alias("end_range_count"),
            fraction(F.count_if("partial"), F.count(F.lit(1))).alias("partial_fraction"),
        )
    )


def type_counts(features: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return features.groupBy(*by, "feature_type").agg(F.count(F.lit(1)).alias("n"))
