"""Helpers that several operators share: tables, written results, numbering and connected components."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from locusframe.session import broadcast_if_small, shared_folder, ship

__all__ = ["anti_join", "components", "cut_compressed", "cut_lineage", "join_counted", "number_rows", "release", "scratch", "scratch_folder",
           "semi_join", "ship", "small_batches", "table"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def semi_join(df: DataFrame, written: DataFrame, on: str) -> DataFrame:
    """Rows of ``df`` whose key is in a written table; broadcast only if a count proves it small."""
    return df.join(broadcast_if_small(written.select(on)), on, "left_semi")


def anti_join(df: DataFrame, written: DataFrame, on: str) -> DataFrame:
    """Rows of ``df`` whose key is not in a written table; broadcast only if a count proves it small."""
    return df.join(broadcast_if_small(written.select(on)), on, "left_anti")


#: Rows of a key from which on it is broadcast, so that its rows stay where they are.
HOT = 10_000


def join_counted(df: DataFrame, counted: DataFrame, on: str | Sequence[str], count: str, spread: bool = False) -> DataFrame:
    """Inner join with a written table that has one row per key and how many rows of ``df`` it has.

    A table that a count proves small is broadcast, but not with ``spread``,
    for tables that grow with the data.  Of others the hot keys are, if they
    are few enough; the rows of all other keys are shuffled.
    """
    on = [on] if isinstance(on, str) else list(on)
    if not spread and (small := broadcast_if_small(counted)) is not counted:
        return df.join(small, on)
    hot = counted.where(F.col(count) >= HOT)
    few = broadcast_if_small(hot)
    if few is hot:
        return df.join(counted, on)
    return df.join(few, on).unionByName(
        df.join(F.broadcast(hot.select(*on)), on, "left_anti").join(counted.where(F.col(count) < HOT), on))


_scopes: list[list[str]] = []


def scratch_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; a ``scratch`` scope deletes it at its end."""
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


def cut_lineage(df: DataFrame, codec: str | None = None) -> DataFrame:
    """Write ``df`` to the folder of ``spark.checkpoint.dir`` and read it back; a ``scratch`` scope deletes it at its end."""
    path = scratch_folder(df.sparkSession)
    (df.write.option("compression", codec) if codec else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_compressed(df: DataFrame) -> DataFrame:
    """``cut_lineage`` with a denser codec, for tables that hold whole texts or token ids."""
    return cut_lineage(df, "zstd")


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables cut inside are deleted at the end, but for those that the yielded function cuts."""
    _scopes.append([])

    def keep(df: DataFrame) -> DataFrame:
        kept = cut_lineage(df)
        path = _scopes[-1].pop()
        if len(_scopes) > 1:
            _scopes[-2].append(path)
        return kept

    try:
        yield keep
    finally:
        hadoop = spark._jvm.org.apache.hadoop.fs
        for name in _scopes.pop():
            path = hadoop.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1_000) -> Iterator[None]:
    """Jobs run inside hand ``rows`` rows at a time to Python workers; whole texts in batches of the default size need ten times the memory.

    The session's setting is put back at the end.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def release(pa) -> None:
    """Give back what Arrow's pool keeps of freed batches: workers live on between tasks, beside their executor."""
    pa.default_memory_pool().release_unused()


def number_rows(df: DataFrame, key: str, order: Sequence[str], name: str, sizes: DataFrame,
                per_block: int = 2_000) -> DataFrame:
    """Gapless numbers from 0 within each key, with about ``per_block`` rows to a task.

    ``sizes`` has (key, ``rows``) of few keys, a number that the caller bounds
    and not the data, and is broadcast.  The rows of a key are dealt to blocks
    by the hash of ``order``; each block is numbered from the count of the
    blocks before it, so a key with a third of all rows just gets that many
    more blocks.  ``df`` is read twice: pass a written table.
    """
    blocks = sizes.select(F.col(key), F.greatest(F.lit(1), F.ceil(F.col("rows") / per_block)).cast("long").alias("_blocks"))
    placed = df.join(F.broadcast(blocks), key).withColumn("_block", F.pmod(F.xxhash64(*order), "_blocks"))
    before = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy(key, "_block").agg(F.count("*").alias("_n")).select(
        key, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inner = Window.partitionBy(key, "_block").orderBy(*order)
    return (placed.withColumn("_inner", F.row_number().over(inner) - 1)
            .join(offsets, [key, "_block"])
            .withColumn(name, F.col("_before") + F.col("_inner"))
            .drop("_blocks", "_block", "_before", "_inner"))


def components(links: DataFrame, first: str = "a", second: str = "b") -> DataFrame:
    """Smallest reachable id of every node that has a link: columns ``node`` and ``component``.

    Alternating star contraction: each round connects the larger neighbours
    of a node, then the smaller ones, to the smallest it knows, until the
    links are stars.  Rounds grow with the logarithm of the longest path; each
    is written to the shared folder, so lineage stays short and no link or
    label passes through the driver.
    """
    edges = cut_lineage(
        links.where(F.col(first) != F.col(second))
        .select(F.greatest(first, second).alias("u"), F.least(first, second).alias("v")).distinct())
    mark = None
    while True:
        # Large star: every larger neighbour of a node goes to the node's minimum.
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.where("v > u").join(least, "u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # Small star: the smaller neighbours of a node, and it, go to their minimum.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u")
                 .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                                           F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e"))
                 .select("e.u", "e.v").where("u != v").distinct())
        edges = cut_lineage(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
    hubs = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(hubs)
