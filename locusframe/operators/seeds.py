"""Exact k-mer search: rolling hashes of a target, thinned by one bounded Bloom filter of all probes.

The target is read once, however many probes there are.  Every position gets a
hash of its k bases from running sums, a few array passes per chunk; only
positions that pass the filter become rows with their full k-mer, and these
are counted per k-mer before they meet the probes in a shuffled join on the
k-mer itself, so a false positive of the filter never becomes a hit.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Filter bits per probe, hashes per probe, and the bounds of the filter: 4 KB and 64 MB.
BITS_PER_PROBE, HASHES = 12, 3
SMALLEST, LARGEST = 1 << 15, 1 << 29
# Bases hashed at once; candidates of one Arrow batch.
PART, ROWS = 1 << 18, 1 << 15
_BASE = 0x9E3779B97F4A7C15  # odd, so that its powers can be divided by


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * seed)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


@lru_cache(maxsize=4)
def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def rolling(data: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every run of ``k`` bytes: equal runs have equal hashes, wherever they stand."""
    if len(data) < k:
        return np.zeros(0, np.uint64)
    room = max(PART, 1 << (len(data) - 1).bit_length())
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(room, _BASE)[:len(data)], out=sums[1:])
    return (sums[k:] - sums[:-k]) * _powers(room, pow(_BASE, -1, 2**64))[:len(data) - k + 1]


def whole(data: np.ndarray, k: int) -> np.ndarray:
    """The hashes of k-mers that stand one behind the other."""
    return ((data.reshape(-1, k).astype(np.uint64) + np.uint64(1)) * _powers(PART, _BASE)[:k]).sum(axis=1, dtype=np.uint64)


def filter_bits(probes: int) -> int:
    """Size of the filter, a power of two: it grows with the probes up to a fixed bound."""
    return min(LARGEST, max(SMALLEST, 1 << (BITS_PER_PROBE * probes - 1).bit_length())) if probes else SMALLEST


def _raw(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a binary column without nulls, and where its values start and end."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return (data[ends[0]:ends[-1]], ends - ends[0]) if len(ends) else (data[:0], np.zeros(1, np.int64))


def bloom_filter(kmers: DataFrame, column: str, k: int, probes: int) -> np.ndarray:
    """The filter's bytes.  Tasks hash their k-mers, bitmaps are merged by key, and at most 64 MB come to the driver."""
    bits = filter_bits(probes)

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            hashes = whole(_raw(batch.column(0))[0], k)
            slots = np.concatenate([_mix(hashes, seed) & np.uint64(bits - 1) for seed in range(HASHES)]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(slots)], names=["slot"])

    bucket, place = F.floor(F.col("slot") / SMALLEST), F.col("slot") % SMALLEST
    parts = kmers.select(column).mapInArrow(run, "slot bigint").groupBy(bucket.alias("bucket")).agg(
        F.bitmap_construct_agg(place).alias("bits"))
    out, size = np.zeros(bits // 8, np.uint8), SMALLEST // 8
    for row in parts.toLocalIterator():  # at most LARGEST / SMALLEST rows of 4 KB
        out[row["bucket"] * size:(row["bucket"] + 1) * size] = np.frombuffer(row["bits"], np.uint8)
    return out


def passing(hashes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Positions whose hash may be that of a probe."""
    found = np.arange(len(hashes))
    for seed in range(HASHES):
        slot = _mix(hashes[found], seed) & np.uint64(8 * len(table) - 1)
        found = found[(table[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1]
    return found


def candidates(texts: DataFrame, k: int, keys: Sequence[str], table: np.ndarray) -> DataFrame:
    """Rows (keys, pos, kmer) of the positions in ``texts`` (keys, origin, bases) that pass the filter.

    The texts of a batch are hashed as one, in parts that overlap by ``k - 1``
    bases; what would reach into the next text is left out.
    """
    keys = list(keys)
    shared = texts.sparkSession.sparkContext.broadcast(table)
    schema = ", ".join(f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in keys)

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            data, ends = _raw(batch.column(len(keys) + 1))
            origin = batch.column(len(keys)).to_numpy()
            for at in range(0, max(0, len(data) - k + 1), PART):
                found = at + passing(rolling(data[at:at + PART + k - 1], k), shared.value)
                row = np.searchsorted(ends, found, "right") - 1
                inside = found + k <= ends[row + 1]
                found, row = found[inside], row[inside]
                for part in range(0, len(found), ROWS):
                    p, r = found[part:part + ROWS], row[part:part + ROWS]
                    places = np.arange(len(p) + 1, dtype=np.int32) * k
                    kmers = pa.Array.from_buffers(pa.binary(), len(p), [
                        None, pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(data[p[:, None] + np.arange(k)]))])
                    yield pa.RecordBatch.from_arrays(
                        [*(batch.column(i).take(pa.array(r)) for i in range(len(keys))), pa.array(origin[r] + p - ends[r]), kmers],
                        names=[*keys, "pos", "kmer"])

    return texts.where("bases IS NOT NULL").select(*keys, F.col("origin").cast("long"), F.col("bases").cast("binary").alias("bases")).mapInArrow(
        run, f"{schema}, pos bigint, kmer binary")
