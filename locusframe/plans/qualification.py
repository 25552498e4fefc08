"""Annotation-source job: profiles, mirrors and lift-over of a source manifest."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.operators import compare, gates, liftover
from locusframe.session import cut_lineage
from locusframe.sources import archive, files
from locusframe.sources.fasta import CHUNK_BITS
from locusframe.sources.gff3 import feature_identity, read_gff3


class Qualification(NamedTuple):
    identities: DataFrame
    summary: DataFrame


def qualify_sources(
    spark: SparkSession, manifest_path: str, root: str, strain: str, coordinate_space: str
) -> Qualification:
    """Verify declared files, profile the annotations and rate every source."""
    sources = cut_lineage(files.read_source_manifest(spark, manifest_path))
    declared = files.declared_files(sources)
    observed = files.under_root(files.file_identities(spark, root), root)
    identities = cut_lineage(files.verify_declared(declared, observed))

    def paths(role: str, kind: str | None = None) -> list[str]:
        wanted = declared.where(F.col("role") == role)
        if kind is not None:
            wanted = wanted.join(sources.where(F.col("annotation_format") == kind), "source_id", "left_semi")
        return [f"{root}/{r['path']}" for r in wanted.select("path").collect()]

    def owner(df: DataFrame, role: str) -> DataFrame:
        """Name the source of each row by the file it came from."""
        own = declared.where(F.col("role") == role).select("source_id", F.col("path").alias("declared"))
        plain = F.regexp_replace("file", "^file:/+", "/")
        return df.withColumn("declared", F.substring(
            plain, F.lit(len(root.rstrip("/")) + 2), F.length(plain))).join(own, "declared").drop("declared")

    annotated = paths("annotation")
    empty = sources.select("source_id").where("false")
    profiles = empty.withColumn("partial_gene_fraction", F.lit(None).cast("double"))
    if annotated:
        gff = read_gff3(spark, annotated)
        profiles = compare.source_profile(
            owner(gff.features, "annotation"), owner(gff.regions, "annotation"))
    lists = paths("metadata", "kegg_list")
    if lists:
        profiles = profiles.unionByName(compare.gene_list_profile(
            owner(archive.read_gene_list(spark, lists), "metadata")), allowMissingColumns=True)
    summary = gates.source_summary(sources, profiles, identities, strain, coordinate_space)
    return Qualification(identities, summary)


def lift_over_probe(
    features: DataFrame, source_sequences: DataFrame, source_chunks: DataFrame,
    target_chunks: DataFrame, flank: int = 50, chunk_bits: int = CHUNK_BITS,
) -> tuple[DataFrame, DataFrame]:
    """Map the gene trios of every source sequence; records and window orders."""
    genes = feature_identity(features.where("feature_type = 'gene'"))
    trios = cut_lineage(liftover.probe_trios(genes))
    mapped = cut_lineage(liftover.map_boundaries(
        trios, source_sequences, source_chunks, target_chunks, flank, chunk_bits))
    return mapped, liftover.order_status(mapped)
