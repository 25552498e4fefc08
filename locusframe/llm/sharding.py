"""Shards of nearly equal bytes by histogram sort.

Keys order the rows; splitters are found by counting the exact bytes below
candidate boundaries over all partitions, round after round, with new
candidates only inside the intervals that still hold a splitter.  The rows
themselves are exchanged once, when every boundary is known.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.llm.common import cut_lineage, number_rows

#: Key bits that one round of probes resolves, and low key bits that tell equal texts apart.
ROUND_BITS, ID_BITS = 10, 24


def order_key(id_col: Column, text: Column) -> Column:
    """64-bit key: the hash of the text, then of the id, so that equal texts are neighbours."""
    low = (1 << ID_BITS) - 1
    return F.xxhash64(text).bitwiseAND(F.lit(~low)).bitwiseOR(F.xxhash64(id_col).bitwiseAND(F.lit(low)))


def splitters(rows: DataFrame, shards: int, tolerance: float = 0.001) -> list[int]:
    """Smallest keys of shards 1, 2, ...: each has its share of the bytes below it.

    ``rows`` has ``key`` and ``size``.  A boundary is taken once it is within
    ``tolerance`` of a shard's bytes; where one key holds more than that, the
    nearer of its two sides.  A round brings at most 2**ROUND_BITS counts per
    open interval to the driver, whatever the number of rows.
    """
    total = int(rows.agg(F.sum("size").cast("decimal(38,0)")).first()[0] or 0)
    if not total:
        return [2**63 - 1] * (shards - 1)  # an empty table: shard 0 has all of nothing
    allowed = tolerance * total / shards
    # Open splitters: target, and the interval (prefix of the key) with the bytes below it.
    open_at = {k: (None, 0) for k in range(1, shards)}
    found: dict[int, int] = {}
    depth = 0
    while open_at:
        step = min(ROUND_BITS, 64 - depth)
        part = rows if not depth else rows.where(
            F.shiftright("key", 64 - depth).isin(sorted({p for p, _ in open_at.values()})))
        counts = part.groupBy(F.shiftright("key", 64 - depth - step).alias("p")).agg(
            F.sum("size").cast("decimal(38,0)").alias("n")).collect()
        inside: dict[int | None, list[tuple[int, int]]] = {}
        for p, n in sorted((p, int(n)) for p, n in counts):
            inside.setdefault(p >> step if depth else None, []).append((p, n))
        depth += step
        still = {}
        for k, (prefix, below) in open_at.items():
            probes = inside[prefix]
            edges = [below, *(below + n for n in accumulate(n for _, n in probes))]
            target = total * k / shards
            at = min(bisect_right(edges, target) - 1, len(probes) - 1)
            near = at if target - edges[at] <= edges[at + 1] - target else at + 1
            if abs(edges[near] - target) <= allowed or depth == 64:
                found[k] = (probes[near][0] if near < len(probes) else probes[-1][0] + 1) << (64 - depth)
            else:
                still[k] = (probes[at][0], edges[at])
        open_at = still
    return [min(found[k], 2**63 - 1) for k in range(1, shards)]


def shard_of(key: Column, bounds: list[int]) -> Column:
    """Number of splitters at or below the key."""
    return sum(((key >= F.lit(b)).cast("int") for b in bounds), F.lit(0)).cast("int")


def assign_shards(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text",
                  tolerance: float = 0.001) -> DataFrame:
    """Per row: ``id_col``, ``size``, ``text_crc32``, ``key``, ``shard`` and ``slot`` (gapless from 0 in its shard).

    A row's size is its UTF-8 bytes plus 1; a null text has none and counts as
    empty.  Shards differ by the tolerance and at most one key.  Equal texts
    are neighbours in the order and stay in one shard unless a splitter must
    cut their group.  Repeated rows get slots of their own; an empty table
    gives an empty result; other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = cut_lineage(docs.select(
        F.col(id_col), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), order_key(F.col(id_col), text).alias("key")))
    bounds = splitters(rows, shards, tolerance)
    placed = rows.withColumn("shard", shard_of(F.col("key"), bounds))
    sizes = placed.groupBy("shard").agg(F.count("*").alias("rows"))
    return number_rows(placed, "shard", ["key", id_col], "slot", sizes)


def write_shards(docs: DataFrame, path: str, shards: int = 16, id_col: str = "doc_id", text_col: str = "text",
                 files: int = 8) -> None:
    """Whole rows as Parquet, one folder per shard with ``files`` files each; the texts are exchanged once."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = order_key(F.col(id_col), text)
    rows = docs.select(key.alias("key"), (F.octet_length(text) + 1).cast("long").alias("size"))
    out = docs.withColumn("shard", shard_of(key, splitters(cut_lineage(rows), shards)))
    out.withColumn("_file", F.pmod(F.xxhash64(id_col), F.lit(files))).repartition(shards * files, "shard", "_file").drop(
        "_file").write.partitionBy("shard").parquet(path)
