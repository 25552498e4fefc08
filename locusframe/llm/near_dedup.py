"""Near-duplicate documents: MinHash bands, odd sketches, exact confirmation, components.

Documents with one set of shingles form a class; classes that share a band
meet in a bucket.  Inside a bucket pairs are judged by odd sketches: the
MinHash samples of a set (one per hash range) are folded into a parity bitmap,
and the population count of two bitmaps' XOR estimates how many samples
differ, most precisely where few do.  Pairs that may reach the threshold are
confirmed on the full sets.  A bucket first proposes each class's most similar
partner only; once those links are contracted to components, it proposes all
pairs between different components, so that a large group of copies never
emits its pairs, and no link that would join two components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.llm import shingles
from locusframe.llm.common import anti_join, components, cut_compressed, cut_lineage, join_counted, release, scratch, semi_join, ship, small_batches
from locusframe.llm.shingles import band_keys, mix

BANDS, ROWS = 32, 6
#: Bits of the parity bitmap, and hash ranges that give a sample each.
PARITY_BITS, RANGES = 2048, 512
#: Rows of a block: larger buckets are compared block by block, each pair of blocks in a task of its own.
BLOCK = 2000
#: Pairs that are judged at once: their sketches and keys are copied, half a kilobyte a row.
PAIRS = 10_000
#: Buckets up to this size propose all their pairs at once.
SMALL = 8
#: Standard deviations of the sampling error that a pair may lie below the threshold before it is dropped.
MARGIN = 5.0


def odd_sketch(values: np.ndarray) -> bytes:
    """``odd_sketches`` of one set."""
    return odd_sketches(values, np.array([len(values)])).tobytes()


def odd_sketches(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of each set the parity bitmap of its samples, then the bitmap of the hash ranges that hold one, as a row of bytes.

    The sets lie behind each other in ``values``, each sorted.
    """
    row = np.repeat(np.arange(len(sizes)), sizes)
    ranges = (values >> np.uint64(64 - RANGES.bit_length() + 1)).astype(np.int64)
    first = np.ones(len(row), bool)
    first[1:] = (row[1:] != row[:-1]) | (ranges[1:] != ranges[:-1])
    row, ranges, bit = row[first], ranges[first], (mix(values[first]) % np.uint64(PARITY_BITS)).astype(np.int64)
    out = np.empty((len(sizes), (PARITY_BITS + RANGES) // 8), np.uint8)
    for at in range(0, len(sizes), 256):
        a, b = np.searchsorted(row, [at, at + 256])
        n = min(256, len(sizes) - at)
        parity = np.bincount((row[a:b] - at) * PARITY_BITS + bit[a:b], minlength=n * PARITY_BITS) & 1
        held = np.zeros((n, RANGES), bool)
        held[row[a:b] - at, ranges[a:b]] = True
        out[at:at + n, :PARITY_BITS // 8] = np.packbits(parity.astype(bool).reshape(n, -1), axis=1)
        out[at:at + n, PARITY_BITS // 8:] = np.packbits(held, axis=1)
    return out


def features(docs: DataFrame, id_col: str, text_col: str, bands: int, rows: int, width: int) -> DataFrame:
    """Per row: id, size of its shingle set, 128-bit digest of the set, band keys and sketch."""
    def run(batches) -> Iterator:
        import pyarrow as pa
        import xxhash

        for batch in batches:
            at = 0
            for values, sizes in shingles.shingle_blocks(batch.column(1).to_pylist(), width):
                ends, some = np.cumsum(sizes), np.flatnonzero(sizes)
                digests = [xxhash.xxh3_128_intdigest(values[a:b].tobytes()) for a, b in zip((ends - sizes).tolist(), ends.tolist())]
                # An empty set has no bands and no sketch.
                has = np.append(0, np.cumsum(sizes > 0)).astype(np.int32)
                banded = band_keys(shingles.minhashes(values, (ends - sizes)[some], bands * rows), bands, rows)
                empty = pa.array(sizes == 0)
                keys = pa.ListArray.from_arrays(pa.array(has * bands, pa.int32()), pa.array(banded.ravel()), mask=empty)
                sketch = odd_sketches(values, sizes[some])
                bits = pa.Array.from_buffers(pa.binary(sketch.shape[1]), len(some), [None, pa.py_buffer(sketch)]).cast(pa.binary())
                sketch = bits.take(pa.array(np.where(sizes > 0, has[:-1], 0), mask=sizes == 0))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(sizes)), pa.array(sizes.astype(np.int64)), pa.array([(x >> 64) - 2**63 for x in digests], pa.int64()),
                     pa.array([(x & (2**64 - 1)) - 2**63 for x in digests], pa.int64()), keys, sketch],
                    names=["id", "n", "high", "low", "keys", "sketch"])
                at += len(sizes)
            release(pa)

    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(
        run, f"id {kind}, n bigint, high bigint, low bigint, keys array<bigint>, sketch binary")


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """Per row: id and its full set of shingle hashes."""
    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            at = 0
            for values, sizes in shingles.shingle_blocks(batch.column(1).to_pylist(), width):
                sets = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(values.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(sizes)), sets], names=["id", "set"])
                at += len(sizes)
            release(pa)

    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(
        run, f"id {kind}, set array<bigint>")


@lru_cache(maxsize=64)
def _triangle(m: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(m, 1)


class _Bucket:
    """Columns of one Arrow batch of bucket rows, and the judgement of pairs of its rows."""

    def __init__(self, table, percent: int):
        self.id = table.column("id").to_numpy()
        self.n = table.column("n").to_numpy()
        self.part = table.column("part").to_numpy()
        self.label = table.column("label").to_numpy()
        keys = [table.column(c).to_numpy() for c in ("key", "low_part", "high_part")]
        self.key, flat = keys[0], table.column("keys").combine_chunks()
        self.keys = flat.flatten().to_numpy().reshape(len(self.id), -1)
        change = np.zeros(len(self.id), bool)
        change[0] = True
        for k in keys:
            change[1:] |= k[1:] != k[:-1]
        self.starts = np.flatnonzero(change)
        self.crossed = keys[1] != keys[2]
        flat = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint64).reshape(len(self.id), -1)
        self.parity, self.held = flat[:, :PARITY_BITS // 64], flat[:, PARITY_BITS // 64:]
        self.samples = np.bitwise_count(self.held).sum(axis=1).astype(np.int64)
        self.level = percent / 100

    def estimate(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimated similarity, and whether the pair may reach the threshold."""
        odd = np.bitwise_count(self.parity[i] ^ self.parity[j]).sum(axis=1).astype(float)
        ranges = np.bitwise_count(self.held[i] | self.held[j]).sum(axis=1).astype(float)
        both = (self.samples[i] + self.samples[j]).astype(float)
        differ = -PARITY_BITS / 2 * np.log(np.maximum(1 - 2 * odd / PARITY_BITS, 1e-3))
        near = (both - np.minimum(differ, both)) / 2 / ranges
        # XOR never counts more than what differs, so this is the highest similarity of the samples.
        most = (both - odd) / 2 / ranges
        union = (self.n[i] + self.n[j]) / (1 + self.level)
        error = np.sqrt(self.level * (1 - self.level) / ranges * np.clip(1 - ranges / union, 0.0, 1.0))
        small, large = np.minimum(self.n[i], self.n[j]), np.maximum(self.n[i], self.n[j])
        possible = (most >= self.level - MARGIN * error - 1e-9) & (small >= self.level * large - 1e-9)
        return near, possible & (self.id[i] != self.id[j])

    def pairs(self, all_pairs: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        ends = np.append(self.starts[1:], len(self.id))
        sizes = ends - self.starts
        for m in np.unique(sizes[(sizes > 1) & (sizes <= 64)]):
            if m <= SMALL or all_pairs:
                a, b = _triangle(int(m))
                groups = self.starts[sizes == m]
                for at in range(0, len(groups), max(1, PAIRS // len(a))):
                    some = groups[at:at + max(1, PAIRS // len(a)), None]
                    yield self._chosen((some + a).ravel(), (some + b).ravel())
        for s, e in zip(self.starts, ends):
            if e - s > (64 if all_pairs else SMALL):
                yield from self._large(int(s), int(e), all_pairs)

    def _own(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Pairs of different labels and parts whose first common band is this bucket's: no other bucket judges them."""
        wanted = (self.label[i] != self.label[j]) & (~self.crossed[i] | (self.part[i] != self.part[j]))
        some = np.flatnonzero(wanted)
        first = (self.keys[i[some]] == self.keys[j[some]]).argmax(axis=1)
        wanted[some] = self.keys[i[some], first] == self.key[i[some]]
        return wanted

    def _chosen(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        wanted = self._own(i, j)
        i, j = i[wanted], j[wanted]
        keep = self.estimate(i, j)[1]
        return i[keep], j[keep]

    def _large(self, s: int, e: int, all_pairs: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if all_pairs and (self.label[s:e] == self.label[s]).all():
            return
        for i in range(s, e):
            others = np.arange(i + 1, e) if all_pairs else np.delete(np.arange(s, e), i - s)
            others = others[self._own(np.full(len(others), i), others)]
            if not len(others):
                continue
            near, possible = self.estimate(np.full(len(others), i), others)
            chosen = others[possible]
            if not all_pairs and len(chosen):
                chosen = chosen[[int(np.argmax(near[possible]))]]
            yield np.full(len(chosen), i), chosen


def candidate_pairs(rows: DataFrame, percent: int, all_pairs: bool) -> DataFrame:
    """Pairs (a < b) of bucket rows (key, id, n, sketch, keys, label, size) with different labels that may be similar enough."""
    def run(batches) -> Iterator:
        import pyarrow as pa

        carried = None
        for table in _with_end(batches):
            if table is not None:
                table = pa.Table.from_batches([table])
                carried = pa.concat_tables([carried, table]) if carried is not None else table
                if not carried.num_rows:
                    continue
            if carried is None or not carried.num_rows:
                continue
            bucket = _Bucket(carried, percent)
            if table is not None:  # the last bucket may go on in the next batch
                last = int(bucket.starts[-1])
                rest = carried.slice(last)
                if not last:
                    continue
                bucket, carried = _Bucket(carried.slice(0, last), percent), rest
            seen = [np.stack([bucket.id[i], bucket.id[j]], 1) for i, j in bucket.pairs(all_pairs)]
            found = np.concatenate([np.zeros((0, 2), np.int64), *seen])
            found = np.unique(np.sort(found, axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])
        del carried
        release(pa)

    parts = F.ceil(F.col("size") / BLOCK).cast("int")
    placed = (rows.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
              .withColumn("low_part", F.least("part", "other")).withColumn("high_part", F.greatest("part", "other"))
              .select("key", "low_part", "high_part", "id", "n", "sketch", "keys", "part", "label"))
    dealt = placed.repartition("key", "low_part", "high_part").sortWithinPartitions("key", "low_part", "high_part")
    ship(rows.sparkSession)
    return dealt.mapInArrow(run, "a bigint, b bigint").distinct()


def _with_end(batches) -> Iterator:
    yield from batches
    yield None


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets have 100 * intersection >= percent * union."""
    both = (pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a")
            .join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b"))
    shared = F.size(F.array_intersect("set_a", "set_b"))
    return (both.select("a", "b", shared.alias("i"), (F.size("set_a") + F.size("set_b")).alias("sum"))
            .where(F.lit(100) * F.col("i") >= F.lit(percent) * (F.col("sum") - F.col("i"))).select("a", "b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85,
                    width: int = 5, bands: int = BANDS, rows: int = ROWS, spread: bool = False) -> DataFrame:
    """One row per input row: ``id_col``, ``n_shingles``, ``component_id``, ``kept``.

    A link needs 100 * intersection >= percent * union of the shingle sets.
    32 bands of 6 rows miss a pair at 0.85 with probability 3e-7.  A text
    without words, or null, has an empty set and is alone.  Rows that share an
    id are one document; a null id links with nothing, its component is null
    and it is not kept.  An empty table gives an empty result; other columns
    are not read.  ``spread`` shuffles band keys whatever their number.
    """
    with small_batches(docs.sparkSession):
        made = cut_compressed(features(docs, id_col, text_col, bands, rows, width))
    alive = made.where("n > 0 and id is not null")
    classes = cut_lineage(alive.groupBy("high", "low").agg(F.min("id").alias("rep")))
    reps = classes.select(F.col("rep").alias("id"))
    keys = (alive.join(reps, "id", "left_semi") if spread else semi_join(alive, reps, "id")).select("id", F.explode("keys").alias("key"))
    # Counts combine before they leave a task; only keys that are met twice have their rows moved.
    counts = cut_lineage(keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"))
    shared = cut_lineage(join_counted(keys, counts, "key", "size", spread).distinct())
    ids = cut_lineage(shared.select("id").distinct())
    # Of the sketches only those of ids that meet another one are moved.
    buckets = shared.join(semi_join(alive.select("id", "n", "sketch", "keys"), ids, "id"), "id")
    with small_batches(docs.sparkSession):
        sets = cut_lineage(shingle_sets(
            semi_join(docs, ids.withColumnRenamed("id", id_col), id_col), id_col, text_col, width).dropDuplicates(["id"]))
    proposed = candidate_pairs(buckets.withColumn("label", F.col("id")), percent, all_pairs=False)
    links = cut_lineage(confirmed(proposed, sets, percent))
    found = cut_lineage(components(links))
    large = buckets.where(F.col("size") > SMALL)
    if not shared.where(F.col("size") > SMALL).isEmpty():
        labelled = (large.join(found, large["id"] == found["node"], "left")
                    .withColumn("label", F.coalesce("component", "id")).drop("node", "component"))
        more = cut_lineage(confirmed(candidate_pairs(labelled, percent, all_pairs=True), sets, percent))
        if not more.isEmpty():
            found = cut_lineage(components(links.unionByName(more)))
    return (made.join(classes, ["high", "low"], "left")
            .withColumn("node", F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("rep")).otherwise(F.col("id")))
            .join(found, "node", "left")
            .withColumn("component_id", F.coalesce("component", "node"))
            .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id",
                    F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept")))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85,
                         bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``docs`` with one document of each component, all columns kept; rows without an id stay."""
    with scratch(docs.sparkSession) as keep:
        gone = keep(near_duplicates(docs, id_col, text_col, percent, bands=bands, rows=rows)
                    .where(~F.col("kept") & F.col(id_col).isNotNull()).select(id_col).distinct())
    return anti_join(docs, gone, id_col).select(*docs.columns)
