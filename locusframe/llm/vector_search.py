"""Approximate nearest neighbours by an inverted multi-index.

Each half of a vector is quantised by its own codebook, so a cell is a pair of
centroids.  A query walks the pairs in the order of their summed distance with
a heap until the cells seen hold the calibrated share of all entries, and the
entries of these cells are reranked by the exact inner product.  Codebooks and
share are fitted on a bounded sample; every row is indexed.  Cells are dealt to
shards of a bounded number of entries and queries to blocks, and one task
reranks one block against one shard.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locusframe.llm.common import cut_lineage, ship

#: Vectors of the fitted sample, queries of its calibration, centroids per half.
SAMPLE, CALIBRATION, CENTROIDS = 16_384, 256, 64
#: Share of true neighbours in the sample that the calibrated walk must reach.
TARGET = 0.95
#: Entries of a shard and queries of a block.
SHARD, QUERIES = 8192, 512


def entries(rows: DataFrame, id_col: str, vector_col: str, dim: int, keep: int) -> DataFrame:
    """Distinct usable vectors as doubles, each with its ``keep`` smallest ids; copies beyond them can't be found first.

    The rows of a vector are ranked in 64 salted parts and then together, so
    one vector with a third of all rows is no single task's work.
    """
    part = Window.partitionBy("v", "salt").orderBy("id")
    whole = Window.partitionBy("v").orderBy("id")
    return (usable(rows, id_col, vector_col, dim).distinct()
            .withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
            .withColumn("n", F.row_number().over(part)).where(F.col("n") <= keep)
            .withColumn("n", F.row_number().over(whole)).where(F.col("n") <= keep)
            .groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
            .select(F.col("ids")[0].alias("entry"), "ids", "v"))


def usable(rows: DataFrame, id_col: str, vector_col: str, dim: int) -> DataFrame:
    """Rows with an id and a finite, non-zero vector of ``dim`` components."""
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (rows.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
            .where(F.col("id").isNotNull() & (F.size("v") == dim))
            .where(good & F.exists("v", lambda x: x != 0)))


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(1) - 2 * x @ centres.T, axis=1)


def _codebook(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    rng = np.random.default_rng(7)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = _nearest(x, centres)
        for c in np.unique(own):
            centres[c] = x[own == c].mean(axis=0)
    return centres


def walk(query: np.ndarray, books: tuple[np.ndarray, np.ndarray], sizes: np.ndarray, wanted: float) -> list[int]:
    """Cells in the order of summed half distances, until they hold ``wanted`` entries."""
    half = len(query) // 2
    near = []
    for part, book in ((query[:half], books[0]), (query[half:], books[1])):
        distance = ((part - book) ** 2).sum(axis=1)
        order = np.argsort(distance, kind="stable")
        near.append((order.tolist(), distance[order].tolist()))
    (first, d1), (second, d2) = near
    heap, cells, held = [(d1[0] + d2[0], 0, 0)], [], 0
    counts, width = sizes, len(second)
    while heap and held < wanted:
        _, i, j = heapq.heappop(heap)
        cell = first[i] * width + second[j]
        cells.append(cell)
        held += counts[cell]
        # Each pair is pushed once: by its left neighbour, or in the first column by the one above.
        if j + 1 < width:
            heapq.heappush(heap, (d1[i] + d2[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(first):
            heapq.heappush(heap, (d1[i + 1] + d2[0], i + 1, 0))
    return cells


def fit(sample: np.ndarray, k: int, centroids: int = CENTROIDS, target: float = TARGET):
    """Codebooks of both halves, and the share of entries a walk must see to reach ``target`` of true neighbours."""
    half = sample.shape[1] // 2
    books = (_codebook(sample[:, :half], centroids), _codebook(sample[:, half:], centroids))
    cells = _nearest(sample[:, :half], books[0]) * len(books[1]) + _nearest(sample[:, half:], books[1])
    sizes = np.bincount(cells, minlength=len(books[0]) * len(books[1]))
    needed = []
    for i in range(min(CALIBRATION, len(sample))):
        score = sample @ sample[i]
        score[i] = -np.inf
        true = np.argsort(-score, kind="stable")[:min(k, len(sample) - 1)]
        order = walk(sample[i], books, sizes, math.inf)
        seen = np.zeros(len(sizes))
        seen[order] = np.cumsum(sizes[order])
        needed.extend(seen[cells[true]] / len(sample))
    return books, float(np.quantile(needed, target)) if needed else 1.0


def search(rows: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id",
           vector_col: str = "embedding") -> DataFrame:
    """The ``k`` nearest rows found for each row whose id ``every`` divides: query_id, rank, vec_id, score.

    The score is the inner product in double precision; ties go to the smaller
    id; the query's own row is left out.  Null vectors, zero vectors, vectors
    with a null or non-finite component or not of the most frequent length,
    and rows without an id take no part; repeated rows count once.  An empty
    table gives an empty result; other columns are not read.
    """
    spark = rows.sparkSession
    ship(spark)
    lengths = rows.groupBy(F.size(vector_col).alias("d")).count().where("d > 0").orderBy(F.desc("count"), "d").first()
    dim = lengths["d"] if lengths else 2
    held = cut_lineage(entries(rows, id_col, vector_col, dim, k + 1))
    # Rows whose hash is below a share of the range: about SAMPLE of any table, chosen before they leave their task.
    chosen = F.pmod(F.xxhash64("entry"), F.lit(1 << 30)) < int(min(1.0, SAMPLE / max(held.count(), 1)) * (1 << 30))
    # In the order of another part of the hash: the first ones, which calibrate the walk, come from everywhere.
    sample = held.where(chosen).select("v", F.xxhash64("entry").alias("order")).toPandas().sort_values("order")["v"]
    empty = "query_id bigint, rank int, vec_id bigint, score double"
    if not len(sample):
        return spark.createDataFrame([], empty)
    books, share = fit(np.stack([np.asarray(v, float) for v in sample]), k)
    half, width, cells = dim // 2, len(books[1]), len(books[0]) * len(books[1])

    def index(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            x = _matrix(batch.column("v"), dim)
            own = _nearest(x[:, :half], books[0]) * width + _nearest(x[:, half:], books[1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32))],
                                             names=[*batch.schema.names, "cell"])

    indexed = cut_lineage(held.mapInArrow(index, "entry bigint, ids array<bigint>, v array<double>, cell int"))
    sizes = np.zeros(cells, np.int64)
    for cell, n in indexed.groupBy("cell").count().collect():  # at most CENTROIDS ** 2 rows
        sizes[cell] = n
    total = int(sizes.sum())
    # Cells fill shards one after another; a cell beyond a shard's size is dealt over several by the hash of the entry.
    pieces = np.maximum(1, -(-sizes // SHARD))
    start = np.zeros(cells, np.int64)
    shard = room = 0
    for c in range(cells):
        if pieces[c] > 1 or sizes[c] > room:
            shard, room = shard + 1, SHARD
        start[c] = shard
        shard, room = (shard + pieces[c] - 1, 0) if pieces[c] > 1 else (shard, room - sizes[c])
    wanted = share * total

    def visits(batches) -> Iterator:
        import pyarrow as pa

        counts = sizes.tolist()
        for batch in batches:
            x = _matrix(batch.column("v"), dim)
            at, shards, bits = [], [], []
            for i, query in enumerate(x):
                seen = np.array(walk(query, books, counts, wanted))
                mark = np.zeros(cells, bool)
                mark[seen] = True
                seen = seen[sizes[seen] > 0]
                goes = set(start[seen[pieces[seen] == 1]].tolist())
                for c in seen[pieces[seen] > 1]:
                    goes.update(range(int(start[c]), int(start[c] + pieces[c])))
                at += [i] * len(goes)
                shards += goes
                bits += [np.packbits(mark).tobytes()] * len(goes)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("entry").take(take), batch.column("v").take(take), batch.column("block").take(take),
                 pa.array(shards, pa.int64()), pa.array(bits, pa.binary())],
                names=["query", "q", "block", "shard", "seen"])

    wanted_ids = cut_lineage(usable(rows, id_col, vector_col, dim).where(F.pmod(F.col("id"), F.lit(every)) == 0)
                             .distinct().withColumnRenamed("id", "query_id"))
    asked = wanted_ids.select("v").distinct().join(indexed.select("entry", "v"), "v")
    blocks = max(1, -(-wanted_ids.count() // QUERIES))
    queries = asked.withColumn("block", F.pmod(F.xxhash64("entry"), F.lit(blocks)).cast("int")).select(
        "entry", "v", "block").mapInArrow(visits, "query bigint, q array<double>, block int, shard bigint, seen binary")
    by_cell = spark.createDataFrame(
        [(int(c), int(start[c]), int(pieces[c])) for c in np.flatnonzero(sizes)], "cell int, start long, pieces int")
    placed = (indexed.join(F.broadcast(by_cell), "cell")
              .withColumn("shard", F.col("start") + F.pmod(F.xxhash64("entry"), "pieces"))
              .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
              .select("shard", "block", "ids", "v", "cell"))

    def rerank(asking, holding):
        import pyarrow as pa

        q, v = _matrix(asking.column("q").combine_chunks(), dim), _matrix(holding.column("v").combine_chunks(), dim)
        own, ids = holding.column("cell").to_numpy(), holding.column("ids").to_pylist()
        names, out = asking.column("query").to_pylist(), ([], [], [])
        for i, seen in enumerate(asking.column("seen").to_pylist()):
            inside = np.flatnonzero(np.unpackbits(np.frombuffer(seen, np.uint8)).astype(bool)[own])
            if not len(inside):
                continue
            score = (v[inside] * q[i]).sum(axis=1)
            if len(score) > k + 1:  # a copy of the query may be its own row
                least = np.partition(score, len(score) - k - 1)[len(score) - k - 1]
                inside, score = inside[score >= least], score[score >= least]
            best = sorted((-s, x) for s, e in zip(score.tolist(), inside) for x in ids[e])[:k + 1]
            out[0].extend([names[i]] * len(best))
            out[1].extend(x for _, x in best)
            out[2].extend(-s for s, _ in best)
        return pa.table({"entry": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()),
                         "score": pa.array(out[2], pa.float64())})

    found = (queries.groupBy("shard", "block").cogroup(placed.groupBy("shard", "block"))
             .applyInArrow(rerank, "entry bigint, vec_id bigint, score double"))
    order = [F.desc("score"), F.asc("vec_id")]
    top = found.withColumn("n", F.row_number().over(Window.partitionBy("entry").orderBy(*order))).where(F.col("n") <= k + 1)
    named = wanted_ids.join(indexed.select("entry", "v"), "v").select("query_id", "entry")
    ranked = Window.partitionBy("query_id").orderBy(*order)
    return (named.join(top.drop("n"), "entry").where("vec_id != query_id")
            .withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def _matrix(column, dim: int) -> np.ndarray:
    column = column.combine_chunks() if hasattr(column, "chunks") else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
