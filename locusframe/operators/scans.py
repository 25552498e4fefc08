"""Ordered scans that do not put a whole key into one task.

A plain ``Window.partitionBy(seqid).orderBy(start)`` sorts one chromosome in
one task.  Positions here are integers, so the ordered axis can be cut into
fixed tiles:

1. one summary row per (keys, tile), built with map-side partial aggregation;
2. a window over the *tiles* of a key, at most ``axis length / tile`` rows;
3. a window inside each (keys, tile), at most ``2**tile_bits`` rows, because callers
   pre-aggregate so that (keys, pos) is unique.

Neither window grows with the number of input rows, whatever their skew.

Keep the scanned table narrow.  When both passes need the same columns of the
pre-aggregated table, their plans are equal up to its exchange and Spark runs
that exchange once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusframe.session import cut_lineage

TILE_BITS = 16

_T = "__tile"


def prefix_scan(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    outputs: Mapping[str, tuple[str, str]],
    tile_bits: int = TILE_BITS,
) -> DataFrame:
    """Add one column per output, computed over the rows of ``keys`` by ``pos``.

    ``outputs`` maps a new column to ``(kind, source column)``:

    ``sum``/``max``
        over all rows before this one (0 / NULL for the first row);
    ``lag``/``lead``
        the value of the neighbouring row;
    ``total``
        the sum over all rows of the key.

    (keys, pos) must be unique and ``pos`` must not be negative.
    """
    keys = list(keys)
    based = df.withColumn(_T, F.shiftright(F.floor(pos), tile_bits))
    for column in (*keys, _T):
        based = based.where(F.col(column).isNotNull())
    summary = []
    for out, (kind, source) in outputs.items():
        col = F.col(source)
        boxed = F.struct(col.alias("v"))
        summary.append(
            {
                "sum": F.sum(col),
                "total": F.sum(col),
                "max": F.max(col),
                "lag": F.max_by(boxed, F.col(pos)),
                "lead": F.min_by(boxed, F.col(pos)),
            }[kind].alias(_carry(out))
        )
    over_tiles = Window.partitionBy(*keys).orderBy(_T)
    before = over_tiles.rowsBetween(Window.unboundedPreceding, -1)
    carried = based.groupBy(*keys, _T).agg(*summary).select(
        *keys,
        _T,
        *[
            {
                "sum": F.sum(_carry(out)).over(before),
                "total": F.sum(_carry(out)).over(Window.partitionBy(*keys)),
                "max": F.max(_carry(out)).over(before),
                "lag": F.lag(_carry(out)).over(over_tiles),
                "lead": F.lead(_carry(out)).over(over_tiles),
            }[kind].alias(_carry(out))
            for out, (kind, _) in outputs.items()
        ],
    )
    joined = based.join(carried, [*keys, _T])
    in_tile = Window.partitionBy(*keys, _T).orderBy(pos)
    earlier = in_tile.rowsBetween(Window.unboundedPreceding, -1)
    results: list[Column] = []
    for out, (kind, source) in outputs.items():
        col, carry = F.col(source), F.col(_carry(out))
        boxed = F.struct(col.alias("v"))
        results.append(
            {
                "sum": F.coalesce(carry, F.lit(0)) + F.coalesce(F.sum(col).over(earlier), F.lit(0)),
                "total": carry,
                "max": F.greatest(carry, F.max(col).over(earlier)),
                "lag": F.coalesce(F.lag(boxed).over(in_tile), carry)["v"],
                "lead": F.coalesce(F.lead(boxed).over(in_tile), carry)["v"],
            }[kind].alias(out)
        )
    return joined.select(*[F.col(c) for c in df.columns], *results)


def _carry(name: str) -> str:
    return f"__carry_{name}"


def ordered_index(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Add ``rank`` (from 0) within each key and ``n_rows`` of the key.

    A global sort range-partitions the rows, so a hot key is spread over many
    tasks; the sorted rows are written once with their running id.  Counts per
    (key, sorted partition) then turn the id into a rank: the window over them
    holds one row per partition at most.
    """
    keys = list(keys)
    placed = cut_lineage(
        df.sort(*keys, *order).withColumn("__row", F.monotonically_increasing_id())
        .withColumn("__part", F.shiftright("__row", 33)))
    parts = placed.groupBy(*keys, "__part").agg(
        F.count(F.lit(1)).alias("n"), F.min("__row").alias("first_row"))
    by_key = Window.partitionBy(*keys)
    earlier = by_key.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        *keys, "__part",
        (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first_row")).alias("__offset"),
        F.sum("n").over(by_key).alias("n_rows"),
    )
    return (
        placed.join(offsets, [*keys, "__part"])
        .withColumn("rank", F.col("__row") + F.col("__offset"))
        .drop("__row", "__part", "__offset")
    )


def top_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int, salts: int = 32
) -> DataFrame:
    """The first ``n`` rows of every group in a total order.

    Two rounds: each group is cut into ``salts`` parts by a row hash, every
    part keeps its own first ``n``, and the final round orders at most
    ``salts * n`` rows of a group.
    """
    keys, order = list(keys), list(order)
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    part = Window.partitionBy(*keys, "__salt").orderBy(*order)
    kept = salted.withColumn("__rn", F.row_number().over(part)).where(F.col("__rn") <= n)
    group = Window.partitionBy(*keys).orderBy(*order)
    return (
        kept.withColumn("__rn", F.row_number().over(group))
        .where(F.col("__rn") <= n)
        .drop("__salt", "__rn")
    )
