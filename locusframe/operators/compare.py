"""Comparison of annotation sources, of tables and of record streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from locusframe.functions.text import after_first, attribute_true, attribute_values, multiset_digest
from locusframe.operators.annotation import TRANSCRIPT_TYPES
from locusframe.operators.stats import fraction

# Feature types that count as non-coding RNA in source profiles.
NCRNA_TYPES = (
    "ncRNA_gene", "ncRNA", "lnc_RNA", "snRNA", "snoRNA", "miRNA", "SRP_RNA", "RNase_P_RNA",
    "RNase_MRP_RNA",
)


# --- source profiles -------------------------------------------------------

def source_profile(
    features: DataFrame, regions: DataFrame | None = None, ns: Sequence[str] = ("source_id",)
) -> DataFrame:
    """Gene, transcript and RNA counts of every annotation source.

    The sequence count is the number of declared regions; a source without
    declared regions counts the names its features use.
    """
    ns = list(ns)
    kind = F.col("feature_type")
    gene = kind == "gene"
    partial = attribute_true("attributes", "partial")
    opened = {
        side: F.size(attribute_values("attributes", side)) > 0 for side in ("start_range", "end_range")}
    counted = features.groupBy(*ns).agg(
        F.count_if(gene).alias("gene_count"),
        F.count_if(kind.isin(*TRANSCRIPT_TYPES)).alias("transcript_count"),
        F.count_if(kind == "CDS").alias("orf_cds_count"),
        F.count_if(kind.isin(*NCRNA_TYPES)).alias("ncrna_count"),
        F.count_if(kind == "tRNA").alias("trna_count"),
        F.count_if(kind == "rRNA").alias("rrna_count"),
        F.count_if(gene & partial).alias("partial_gene_count"),
        F.count_if(gene & opened["start_range"]).alias("start_range_gene_count"),
        F.count_if(gene & opened["end_range"]).alias("end_range_gene_count"),
    )
    used = features.select(*ns, "seqid", F.lit(0).alias("declared"))
    if regions is not None:
        used = used.unionByName(regions.select(*ns, "seqid", F.lit(1).alias("declared")))
    names = used.distinct().groupBy(*ns).agg(
        F.count_if(F.col("declared") == 1).alias("declared"),
        F.count_if(F.col("declared") == 0).alias("observed"))
    missing = F.array_compact(F.array(
        F.when(F.col("ncrna_count") == 0, "ncRNA"),
        F.when(F.col("trna_count") == 0, "tRNA"),
        F.when(F.col("rrna_count") == 0, "rRNA")))
    return counted.join(names, ns).select(
        *counted.columns,
        fraction(F.col("partial_gene_count"), F.col("gene_count"), None).alias("partial_gene_fraction"),
        F.when(F.col("declared") > 0, F.col("declared")).otherwise(F.col("observed")).alias("sequence_count"),
        missing.alias("missing_feature_types"),
    )


def sequence_names(
    features: DataFrame, regions: DataFrame, ns: Sequence[str] = ("source_id",)
) -> DataFrame:
    """Names of each source in long form: declared ones, or else observed."""
    ns = list(ns)
    declared = regions.select(*ns, "seqid").distinct()
    observed = features.select(*ns, "seqid").distinct().join(
        declared.select(*ns).distinct(), ns, "left_anti")
    return declared.unionByName(observed)


def gene_list_profile(genes: DataFrame, ns: Sequence[str] = ("source_id",)) -> DataFrame:
    """Profile of a plain gene list (``chromosome`` per row)."""
    return genes.groupBy(*ns).agg(
        F.count(F.lit(1)).alias("gene_count"),
        F.lit(0).alias("transcript_count"),
        F.count(F.lit(1)).alias("orf_cds_count"),
        F.countDistinct("chromosome").alias("sequence_count"),
        F.array(F.lit("ncRNA"), F.lit("tRNA"), F.lit("rRNA")).alias("missing_feature_types"),
    )


# --- mirrors ---------------------------------------------------------------

def canonical_genes(features: DataFrame, seq_map: DataFrame | None = None) -> DataFrame:
    """Distinct ``gene_id, seqid, start_pos, end_pos, strand`` of the genes."""
    def first(key: str) -> Column:
        return F.get(attribute_values("attributes", key), F.lit(0))

    name = F.coalesce(first("locus_tag"), first("gene_id"), first("ID"), F.lit(""))
    bare = F.regexp_replace(F.regexp_replace(name, "^gene:", ""), "^gene-", "")
    genes = features.where("feature_type = 'gene'").withColumn("gene_id", bare)
    if seq_map is not None:
        genes = genes.join(seq_map.select("seqid", "target"), "seqid", "left").withColumn(
            "seqid", F.coalesce("target", "seqid"))
    return genes.select("gene_id", "seqid", "start_pos", "end_pos", "strand").distinct()


def one_per_gene(genes: DataFrame) -> DataFrame:
    """A duplicate id keeps its largest (seqid, start, end, strand) row."""
    return genes.groupBy("gene_id").agg(
        F.max(F.struct("seqid", "start_pos", "end_pos", "strand")).alias("place"))


def mirror(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: gene counts, shared ids and exact boundary matches.

    Both sides are canonical gene tables; the counts are of distinct rows.
    """
    shared = one_per_gene(left).join(
        one_per_gene(right).withColumnRenamed("place", "other"), "gene_id")
    exact = F.count_if(F.col("place") == F.col("other"))
    counted = shared.agg(
        F.count(F.lit(1)).alias("shared_gene_id_count"),
        exact.alias("exact_boundary_match_count"),
        fraction(exact, F.count(F.lit(1))).alias("exact_boundary_match_fraction"))
    return counted.withColumns({
        "left_gene_count": left.agg(F.count(F.lit(1))).scalar(),
        "right_gene_count": right.agg(F.count(F.lit(1))).scalar(),
    })


def gene_list_positions(rows: DataFrame, seq_map: DataFrame | None = None) -> DataFrame:
    """``gene_id`` and closed 1-based span out of ``id, position`` texts.

    The strand is minus only if the position itself starts with
    ``complement(``; a joined position covers all its segments.
    """
    position = after_first(F.col("position"), ":")
    chromosome = F.replace(F.substring_index("position", ":", 1), F.lit("complement("), F.lit(""))
    starts = F.transform(F.regexp_extract_all(position, F.lit(r"(\d+)\.\.(\d+)"), F.lit(1)),
                         lambda x: x.cast("bigint"))
    ends = F.transform(F.regexp_extract_all(position, F.lit(r"(\d+)\.\.(\d+)"), F.lit(2)),
                       lambda x: x.cast("bigint"))
    parsed = rows.select(
        "line_number", after_first(F.col("id"), ":").alias("gene_id"),
        chromosome.alias("seqid"), F.array_min(starts).alias("first"), F.array_max(ends).alias("last"),
        F.when(position.startswith("complement("), "-").otherwise("+").alias("strand"),
    ).where("first IS NOT NULL")
    if seq_map is not None:
        parsed = parsed.join(seq_map.select("seqid", "target"), "seqid", "left").withColumn(
            "seqid", F.coalesce("target", "seqid"))
    return last_per_gene(parsed)


def last_per_gene(rows: DataFrame) -> DataFrame:
    """The last line of a repeated gene id wins."""
    place = F.struct("seqid", "first", "last", "strand")
    return rows.groupBy("gene_id").agg(F.max_by(place, "line_number").alias("place"))


def annotation_positions(features: DataFrame) -> DataFrame:
    """Genes with a locus tag or name, as closed 1-based spans."""
    name = F.coalesce(F.get(attribute_values("attributes", "locus_tag"), F.lit(0)),
                      F.get(attribute_values("attributes", "Name"), F.lit(0)))
    return last_per_gene(features.where("feature_type = 'gene'").select(
        name.alias("gene_id"), "seqid", (F.col("start_pos") + 1).alias("first"),
        F.col("end_pos").alias("last"), "strand", "line_number").where("gene_id IS NOT NULL"))


def compare_positions(genes: DataFrame, annotated: DataFrame) -> DataFrame:
    """One row: counts of both sides, shared ids and equal coordinates."""
    shared = genes.join(annotated.withColumnRenamed("place", "other"), "gene_id")
    exact = F.count_if(F.col("place") == F.col("other"))
    return shared.agg(
        F.count(F.lit(1)).alias("shared_gene_id_count"),
        exact.alias("exact_coordinate_match_count"),
        fraction(exact, F.count(F.lit(1))).alias("exact_coordinate_match_fraction"),
    ).withColumns({
        "list_record_count": genes.agg(F.count(F.lit(1))).scalar(),
        "annotation_gene_count": annotated.agg(F.count(F.lit(1))).scalar(),
    })


def exact_shared(left: DataFrame, right: DataFrame, key: str, facts: Sequence[str]) -> DataFrame:
    """One row: shared keys and how many of them agree in all ``facts``."""
    l = left.select(key, F.struct(*facts).alias("l"))
    r = right.select(key, F.struct(*facts).alias("r"))
    return l.join(r, key).agg(
        F.count(F.lit(1)).alias("shared"), F.count_if(F.col("l") == F.col("r")).alias("exact"))


# --- tables ----------------------------------------------------------------

def two_sided_diff(published: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Rows whose number of occurrences differs, with both counts.

    One grouping over the union of both sides; copies combine map-side.
    """
    columns = published.columns
    both = published.withColumn("__side", F.lit(0)).unionByName(
        recomputed.select(*columns).withColumn("__side", F.lit(1)))
    return both.groupBy(*columns).agg(
        F.count_if(F.col("__side") == 0).alias("published_rows"),
        F.count_if(F.col("__side") == 1).alias("recomputed_rows"),
    ).where(F.col("published_rows") != F.col("recomputed_rows"))


def set_difference(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """Distinct keys on one side only, labelled by the side that has them."""
    seen = left.select(*key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(*key, F.lit(0).alias("l"), F.lit(1).alias("r")))
    return seen.groupBy(*key).agg(F.max("l").alias("l"), F.max("r").alias("r")).where(
        F.col("l") != F.col("r")).select(
        *key, F.when(F.col("l") == 1, "left_only").otherwise("right_only").alias("side"))


def table_hash(df: DataFrame, scale: int = 6) -> DataFrame:
    """Row count and a content hash that ignores row order but not repetition.

    Values are taken as text in the order of the column names: floating
    numbers as decimals of ``scale`` places, times as microseconds, so that
    another engine can form the same hash.
    """
    def text(field: T.StructField) -> Column:
        if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
            return F.col(field.name).cast(f"decimal(38,{scale})")
        if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            return F.unix_micros(F.col(field.name).cast("timestamp"))
        return F.col(field.name) if not isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)) else F.to_json(field.name)

    fields = sorted(df.schema, key=lambda f: f.name)
    return df.agg(F.count(F.lit(1)).alias("rows"), multiset_digest(*map(text, fields)).alias("content_hash"))
