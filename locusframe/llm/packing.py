"""Packing of token sequences by non-negative least squares over length combinations.

Documents are cut into full windows and one rest.  The histogram of the rests
is matched by combinations of up to ``depth`` length classes that fill a
window exactly: least squares gives their repeat counts, rounded down to what
the histogram holds.  Rests that no combination took are laid end to end and
cut at window ends.  Only the histogram (less than a window's number of rows)
reaches the driver; every row finds its place by arithmetic on its number
among the rows of its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locusframe.llm.byte_bpe import blocks
from locusframe.llm.common import cut_compressed, number_rows, release, ship, small_batches
from locusframe.llm.word_coder import WordCoder

BLOCK_CHARS = 1_000_000


def windows(docs: DataFrame, path: str, window: int = 2048, end: int = 1, id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """Token ids of every document plus ``end``, cut at multiples of ``window``; ``piece`` numbers the rows uniquely.

    See ``word_coder`` for how texts are encoded; its words are forgotten when
    a task ends.
    """
    def run(batches) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        coder, last, count = WordCoder(path), end.to_bytes(4, "little"), TaskContext.get().partitionId() << 33
        for batch in batches:
            names, at = batch.column(0), 0
            for block in blocks((text.as_py() for text in batch.column(1)), BLOCK_CHARS):
                data = [ids + last for ids in coder.ids(block)]
                cuts = [(k, s) for k, d in enumerate(data) for s in range(0, len(d), 4 * window)]
                part = [data[k][s:s + 4 * window] for k, s in cuts]
                yield pa.RecordBatch.from_arrays([
                    names.slice(at, len(block)).take(pa.array([k for k, _ in cuts], pa.int64())),
                    pa.array(range(count, count + len(cuts)), pa.int64()),
                    pa.array([len(data[k]) // 4 for k, _ in cuts], pa.int64()),
                    pa.array([s // 4 for _, s in cuts], pa.int64()),
                    pa.array([len(p) // 4 for p in part], pa.int64()),
                    pa.array(part, pa.binary())],
                    names=["doc", "piece", "doc_tokens", "start", "length", "ids"])
                at, count = at + len(block), count + len(cuts)
            release(pa)

    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(
        run, f"doc {kind}, piece bigint, doc_tokens bigint, start bigint, length bigint, ids binary")


def combinations(classes: int, depth: int) -> np.ndarray:
    """Columns: how often each class 1..classes occurs in a multiset of up to ``depth`` classes with that sum."""
    found: list[list[int]] = []

    def grow(chosen: list[int], rest: int) -> None:
        if not rest:
            found.append(chosen)
        elif len(chosen) < depth:
            for c in range(min(rest, chosen[-1] if chosen else classes), 0, -1):
                if c * (depth - len(chosen)) < rest:
                    break
                grow([*chosen, c], rest - c)

    grow([], classes)
    out = np.zeros((classes, len(found)))
    for k, chosen in enumerate(found):
        for c in chosen:
            out[c - 1, k] += 1
    return out


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400, at_once: int = 16) -> np.ndarray:
    """Minimises |a x - b| over x >= 0: the active-set method on the normal equations.

    A round frees the ``at_once`` columns of steepest gain, then steps back
    until no free column is negative.
    """
    x, free = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(rounds):
        gain = np.where(free, -np.inf, a.T @ (b - a @ x))
        steep = np.argpartition(-gain, min(at_once, len(gain) - 1))[:at_once]
        steep = steep[gain[steep] > 1e-6 * max(1.0, np.abs(b).max())]
        if not len(steep):
            break
        free[steep] = True
        while True:
            cols = np.flatnonzero(free)
            own = a[:, cols]
            best = np.linalg.solve(own.T @ own + 1e-9 * np.eye(len(cols)), own.T @ b)
            if best.min(initial=1.0) > 0:
                x[:] = 0
                x[cols] = best
                break
            low = best <= 0
            share = np.min(x[cols][low] / (x[cols][low] - best[low] + 1e-300))
            x[cols] += share * (best - x[cols])
            gone = cols[low & (x[cols] <= 1e-9)]
            x[gone] = 0
            free[gone] = False
            if not len(gone) or not free.any():
                break
    return x


def plan(histogram: dict[int, int], window: int, unit: int = 8, depth: int = 3) -> tuple[list, list, int]:
    """Places for rests of each length: rows of (length, ...) and (class, ...), and the number of combined windows.

    Lengths are rounded up to classes of ``unit`` tokens.  Of each class the
    shorter rests go to combinations, in the order of their class numbers.
    """
    classes = -(-window // unit)
    counts = np.zeros(classes, np.int64)
    for length, n in histogram.items():
        counts[-(-length // unit) - 1] += n
    shapes = combinations(classes, depth)
    repeats = np.floor(nnls(shapes, counts.astype(float)) + 1e-6).astype(np.int64)
    rest, used, slots, sequences = counts.copy(), np.zeros(classes, np.int64), [], 0
    for k in np.argsort(-repeats, kind="stable"):
        members = np.flatnonzero(shapes[:, k])
        times = shapes[members, k].astype(np.int64)
        n = int(min(repeats[k], (rest[members] // times).min()))
        if n <= 0:
            continue
        for c, m in zip(members, times):
            slots.append((int(c) + 1, int(used[c]), int(used[c] + n * m), int(m), sequences))
            used[c] += n * m
            rest[c] -= n * m
        sequences += n
    lengths, line, seen = [], 0, np.zeros(classes, np.int64)
    for length in sorted(histogram):
        c, n = -(-length // unit) - 1, histogram[length]
        taken = int(min(max(used[c] - seen[c], 0), n))
        lengths.append((length, c + 1, int(seen[c]), taken, line))
        line += (n - taken) * length
        seen[c] += n
    return lengths, slots, sequences


def pack(pieces: DataFrame, window: int = 2048, unit: int = 8, depth: int = 3) -> DataFrame:
    """Sequences for the written rows of ``windows``: its columns, cut where needed, with ``sequence_id`` and ``offset``.

    Every id is in exactly one row.  Rows of a full window are sequences of
    their own; combined windows lack at most ``depth * (unit - 1)`` tokens; the
    rests laid end to end leave one sequence short.  An empty table gives an
    empty result.
    """
    spark = pieces.sparkSession
    rests = pieces.where(F.col("length") < window)
    sizes = rests.groupBy("length").agg(F.count("*").alias("rows"))
    histogram = {r["length"]: r["rows"] for r in sizes.collect()}  # fewer rows than a window has tokens
    lengths, slots, combined = plan(histogram, window, unit, depth)
    by_length = spark.createDataFrame(lengths, "length long, class long, before long, taken long, line long")
    by_class = spark.createDataFrame(slots, "class long, first long, last long, times long, sequence long")
    rows = spark.createDataFrame(list(histogram.items()), "length long, rows long")
    numbered = number_rows(rests.select("piece", "length"), "length", ["piece"], "n", rows).join(
        F.broadcast(by_length), "length")
    # Tables of a bounded number of rows, less than a window or a few per class: they are broadcast.
    place = F.col("before") + F.col("n")
    joined = (numbered.where("n < taken").withColumn("place", place)
              .join(F.broadcast(by_class.withColumnRenamed("class", "of")),
                    (F.col("class") == F.col("of")) & (F.col("place") >= F.col("first")) & (F.col("place") < F.col("last")))
              .select("piece", F.lit(0).cast("long").alias("skip"), F.col("length").alias("take"),
                      (F.col("sequence") + F.floor((F.col("place") - F.col("first")) / F.col("times"))).alias("sequence_id")))
    inner = Window.partitionBy("sequence_id").orderBy(F.col("take").desc(), "piece").rowsBetween(
        Window.unboundedPreceding, -1)
    joined = joined.withColumn("offset", F.coalesce(F.sum("take").over(inner), F.lit(0)))
    at = F.col("line") + (F.col("n") - F.col("taken")) * F.col("length")
    laid = (numbered.where("n >= taken").withColumn("at", at)
            .withColumn("room", window - F.col("at") % window)
            .withColumn("sequence", F.lit(combined) + F.floor(F.col("at") / window))
            .select("piece", F.explode(F.filter(F.array(
                F.struct(F.lit(0).cast("long").alias("skip"), F.least("length", "room").alias("take"),
                         F.col("sequence").alias("sequence_id"), (F.col("at") % window).alias("offset")),
                F.struct(F.col("room").alias("skip"), (F.col("length") - F.col("room")).alias("take"),
                         (F.col("sequence") + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))),
                lambda x: x["take"] > 0)).alias("x")).select("piece", "x.*"))
    first_full = combined + sum(n * k for k, n in histogram.items()) // window + 1
    cut = (joined.unionByName(laid).join(rests, "piece")
           .select("doc", "doc_tokens", (F.col("start") + F.col("skip")).alias("start"), F.col("take").alias("length"),
                   F.substring("ids", (F.col("skip") * 4 + 1).cast("int"), (F.col("take") * 4).cast("int")).alias("ids"),
                   "sequence_id", "offset"))
    full = pieces.where(F.col("length") == window).select(
        "doc", "doc_tokens", "start", "length", "ids", (F.col("piece") + first_full).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"))
    return cut.unionByName(full)


def pack_documents(docs: DataFrame, path: str, window: int = 2048, end: int = 1, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """Packed pieces of all documents: ``id_col``, doc_tokens, start, length, ids, sequence_id, offset.

    A null or empty text has the end token only.  Repeated rows are packed
    each for itself; other columns are not read.
    """
    with small_batches(docs.sparkSession):
        pieces = cut_compressed(windows(docs, path, window, end, id_col, text_col))
    return pack(pieces, window).withColumnRenamed("doc", id_col)
