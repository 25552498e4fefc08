"""Text lines with their line numbers, without a global sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from locusframe.errors import ContractError
from locusframe.session import spread

# One offset row per input split; above this many the offsets are shuffled.
BROADCAST_SPLITS = 1_000_000


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file, line_number, value`` of text files, plain or gzip.

    A first pass counts lines per split.  A line number is then the line's
    place in its split plus the lines of the file's earlier splits.  Splits
    are at most one per scan partition plus one remainder per file, which
    bounds the offsets table before it is broadcast.
    """
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
        "value",
    )
    counted = raw.groupBy("file", "block").agg(
        F.count(F.lit(1)).alias("n"), F.min("row").alias("first_row"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = counted.select(
        "file", "block",
        (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first_row") + 1).alias("offset"),
    )
    scanned = raw.rdd.getNumPartitions()
    splits = scanned + len(raw.inputFiles())
    if splits <= BROADCAST_SPLITS:
        offsets = F.broadcast(offsets)
    return spread(raw.join(offsets, ["file", "block"]).select(
        "file", (F.col("row") + F.col("offset")).alias("line_number"), "value"), scanned)


def assert_empty(violations: DataFrame, columns: tuple[str, ...] = ("file", "line_number")) -> None:
    """Raise ``ContractError`` with the first violation, if there is one."""
    known = [c for c in columns if c in violations.columns]
    first = violations.orderBy(*known).limit(1).collect()
    if first:
        raise ContractError(", ".join(f"{k}={v}" for k, v in first[0].asDict().items()))
