"""Alignment, depth and read readers."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.sources.lines import numbered_lines

SAM_FIELDS = (
    ("qname", "string"), ("flag", "int"), ("rname", "string"), ("pos", "bigint"),
    ("mapq", "int"), ("cigar", "string"), ("rnext", "string"), ("pnext", "bigint"),
    ("tlen", "bigint"), ("seq", "string"),
)


class Sam(NamedTuple):
    alignments: DataFrame
    header: DataFrame
    violations: DataFrame


class FastqPairs(NamedTuple):
    pairs: DataFrame
    violations: DataFrame


def tag_int(fields: Column | str, name: str) -> Column:
    """Integer value of an optional SAM tag, NULL if absent."""
    tags = F.filter(F.slice(fields, 12, F.greatest(F.size(fields), F.lit(1))),
                    lambda t: t.startswith(f"{name}:i:"))
    return F.substring(F.get(tags, F.lit(0)), len(name) + 4, 20).try_cast("int")


def parse_sam(lines: DataFrame, carry: tuple[str, ...] = ("file", "line_number")) -> DataFrame:
    """Alignment columns of record lines; ``well_formed`` marks 11+ fields."""
    fields = lines.where(~F.col("value").startswith("@") & (F.col("value") != "")).withColumn(
        "f", F.split("value", "\t"))
    return fields.select(
        *carry,
        *[F.get("f", F.lit(i)).try_cast(kind).alias(name)
          for i, (name, kind) in enumerate(SAM_FIELDS)],
        tag_int("f", "NH").alias("nh"),
        tag_int("f", "NM").alias("nm"),
        (F.size("f") >= 11).alias("well_formed"),
    )


def parse_sam_header(lines: DataFrame) -> DataFrame:
    return lines.where(F.col("value").startswith("@SQ\t")).select(
        "file",
        F.regexp_extract("value", r"\tSN:([^\t]+)", 1).alias("rname"),
        F.regexp_extract("value", r"\tLN:(\d+)", 1).cast("bigint").alias("declared_length"),
    )


def read_sam(spark: SparkSession, path: str | list[str]) -> Sam:
    lines = numbered_lines(spark, path)
    parsed = parse_sam(lines)
    ok = F.col("well_formed") & F.col("flag").isNotNull() & F.col("pos").isNotNull()
    return Sam(
        parsed.where(ok).drop("well_formed"),
        parse_sam_header(lines),
        parsed.where(~ok).select("file", "line_number", F.lit("malformed SAM record").alias("problem")),
    )


def read_depth(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Per-position depth; the file's positions are 1-based."""
    raw = spark.read.csv(path, sep="\t", schema="seqid STRING, pos1 BIGINT, depth BIGINT")
    return raw.select("seqid", (F.col("pos1") - 1).alias("pos"), "depth")


# --- FASTQ -----------------------------------------------------------------

def _mate_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per four lines, with its ordinal within the file."""
    lines = numbered_lines(spark, path)
    at = F.col("line_number") - 1
    slot = F.pmod(at, F.lit(4))
    return lines.groupBy(F.floor(at / 4).alias("ordinal")).agg(
        F.count(F.lit(1)).alias("n_lines"),
        *[F.max(F.when(slot == i, F.col("value"))).alias(c)
          for i, c in enumerate(("name_line", "bases", "plus_line", "quality"))],
    )


def _name_and_mate(line: Column) -> tuple[Column, Column]:
    tokens = F.split(F.trim(line), r"\s+")
    first, second = F.get(tokens, F.lit(0)), F.get(tokens, F.lit(1))
    suffixed = first.rlike("/[12]$")
    name = F.when(suffixed, F.regexp_replace(first, "/[12]$", "")).otherwise(first)
    mate = F.when(suffixed, F.right(first, F.lit(1))).when(second.isin("1", "2"), second)
    return name, mate.cast("int")


def read_fastq_pairs(spark: SparkSession, read1: str, read2: str) -> FastqPairs:
    """Pair two FASTQ files record by record.

    Records are found by line number modulo four, never by their first
    character, since quality lines may start with ``@``.
    """

    def prepared(path: str, side: str) -> DataFrame:
        records = _mate_records(spark, path)
        name, mate = _name_and_mate(F.col("name_line"))
        broken = (
            F.when(F.col("n_lines") != 4, "truncated record")
            .when(~F.col("name_line").startswith("@") | ~F.col("plus_line").startswith("+"),
                  "invalid record")
            .when(F.length("bases") != F.length("quality"), "sequence/quality length mismatch")
        )
        return records.select(
            "ordinal", name.alias(f"name_{side}"), mate.alias(f"mate_{side}"),
            F.col("bases").alias(f"bases_{side}"), broken.alias(f"problem_{side}"),
            F.lit(True).alias(f"has_{side}"))

    joined = prepared(read1, "1").join(prepared(read2, "2"), "ordinal", "full")
    mates = (F.coalesce(F.col("mate_1"), F.lit(0)) == 1) & (F.coalesce(F.col("mate_2"), F.lit(0)) == 2)
    problem = (
        F.when(F.col("has_1").isNull() | F.col("has_2").isNull(), "paired count mismatch")
        .when(F.col("problem_1").isNotNull(), F.col("problem_1"))
        .when(F.col("problem_2").isNotNull(), F.col("problem_2"))
        .when((F.col("name_1") != F.col("name_2")) | ~mates, "paired name mismatch")
    )
    checked = joined.withColumn("problem", problem)
    return FastqPairs(
        checked.where("problem IS NULL").select(
            "ordinal", F.col("name_1").alias("name"), "bases_1", "bases_2"),
        checked.where("problem IS NOT NULL").select(
            F.lit(read1).alias("file"), (F.col("ordinal") * 4 + 1).alias("line_number"), "problem"),
    )


def fastq_totals(pairs: DataFrame) -> DataFrame:
    return pairs.agg(
        F.count(F.lit(1)).alias("pair_count"),
        F.count(F.lit(1)).alias("read_count_per_file"),
        F.coalesce(F.sum(F.length("bases_1") + F.length("bases_2")), F.lit(0)).alias("total_bases"),
    )
