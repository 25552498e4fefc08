"""Token files with fixed-width ids: every id takes the fewest bits that the vocabulary allows.

A file is a header, the document ids (with a byte each that tells a null),
where each document starts, the byte offset of every block, and the blocks: a
fixed number of ids each, packed without gaps and filled up to whole bytes.  So
numpy unpacks a block in a few passes, and any range of ids is read from the
blocks that hold it.  Spark writes one file per row of a sorted, range
partitioned table with its own commit protocol, on any file system it knows,
and a closing line feed that its text writer adds; a small index table next to
the files says which part of the whole stream each one holds.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from locusframe.llm.byte_bpe import blocks
from locusframe.llm.common import ship
from locusframe.llm.word_coder import WordCoder, vocabulary_size
from locusframe.session import broadcast_if_small

MAGIC = b"FIXEDIDS"
#: magic, bits of an id, ids of a block, documents, ids, number of the file in stream order
HEADER = "<8sIIQQQ"
HEADER_BYTES = struct.calcsize(HEADER)
#: Ids of a block and of a file (a longer document has a file of its own); characters encoded at once.
BLOCK_IDS, FILE_IDS, BLOCK_CHARS = 1 << 16, 1 << 21, 1_000_000
#: Bytes of text that a task encodes.
TASK_BYTES = 16 << 20


def bits_for(size: int) -> int:
    """Fewest bits that hold the ids 0 .. size - 1."""
    return max(1, (size - 1).bit_length())


def pack_block(ids: np.ndarray, bits: int) -> bytes:
    """Ids of ``bits`` bits each, the highest bit first, filled up with zeros to a whole byte."""
    ids = np.ascontiguousarray(ids, np.uint32)
    if ids.size and int(ids.max()) >> bits:
        raise ValueError(f"an id does not fit into {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype(f">u{bits // 8}").tobytes()
    digits = np.unpackbits(ids.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)[:, 32 - bits:]
    return np.packbits(digits.ravel()).tobytes()


def unpack_block(data, count: int, bits: int) -> np.ndarray:
    """The first ``count`` ids of a packed block."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f">u{bits // 8}", count).astype("<u4")
    digits = np.unpackbits(np.frombuffer(data, np.uint8), count=count * bits).reshape(count, bits)
    wide = np.zeros((count, 32), np.uint8)
    wide[:, 32 - bits:] = digits
    return np.packbits(wide, axis=1).view(">u4").ravel().astype("<u4")


def file_image(docs: list[int | None], lengths: list[int], ids: np.ndarray, bits: int, ordinal: int,
               block: int = BLOCK_IDS) -> bytes:
    """The bytes of one file."""
    packed = [pack_block(ids[at:at + block], bits) for at in range(0, len(ids), block)]
    return b"".join([
        struct.pack(HEADER, MAGIC, bits, block, len(docs), len(ids), ordinal),
        np.array([d is None for d in docs], np.uint8).tobytes(),
        np.array([d or 0 for d in docs], "<i8").tobytes(),
        np.cumsum([0, *lengths]).astype("<u8").tobytes(),
        np.cumsum([0, *map(len, packed)]).astype("<u8").tobytes(), *packed])


class TokenFile:
    """Random access to the bytes of a file; nothing is unpacked before it is asked for."""

    def __init__(self, data):
        magic, self.bits, self.block, docs, self.n_ids, self.ordinal = struct.unpack_from(HEADER, data)
        if magic != MAGIC:
            raise ValueError("not a file of fixed-width ids")
        at = HEADER_BYTES
        nulls, at = np.frombuffer(data, np.uint8, docs, at), at + docs
        named, at = np.frombuffer(data, "<i8", docs, at), at + 8 * docs
        self.docs = [None if null else doc for null, doc in zip(nulls.tolist(), named.tolist())]
        self.starts, at = np.frombuffer(data, "<u8", docs + 1, at).astype(np.int64), at + 8 * (docs + 1)
        count = -(-self.n_ids // self.block)
        self.offsets = np.frombuffer(data, "<u8", count + 1, at).astype(np.int64) + at + 8 * (count + 1)
        self.data = memoryview(data)

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the file, from the blocks that hold them."""
        stop = self.n_ids if stop is None else min(stop, self.n_ids)
        if start >= stop:
            return np.zeros(0, "<u4")
        first, last = start // self.block, (stop - 1) // self.block
        found = [unpack_block(self.data[self.offsets[k]:self.offsets[k + 1]],
                              min(self.block, self.n_ids - k * self.block), self.bits) for k in range(first, last + 1)]
        return np.concatenate(found)[start - first * self.block:stop - first * self.block]

    def document(self, k: int) -> np.ndarray:
        """Ids of the k-th document of the file."""
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))


def write_token_files(docs: DataFrame, path: str, target: str, end: int = 1, id_col: str = "doc_id", text_col: str = "text",
                      block_ids: int = BLOCK_IDS, file_ids: int = FILE_IDS, task_bytes: int = TASK_BYTES) -> None:
    """Write the ids of all documents and ``end`` after each to files in ``target``, by ascending ``id_col``, and their index.

    A null text has the end id only; rows that share an id are all written,
    next to each other; null ids come first.  An empty table gives no file and
    an empty index.  Ids must be whole numbers; other columns are not read.
    Texts are exchanged once, by ranges of (id, row), so that neither a long
    document nor a repeated id makes a task large; each task encodes its
    range and packs it.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{id_col} must be a whole number, not {kind}")
    bits = bits_for(max(vocabulary_size(path), end + 1))

    def run(batches) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        coder, last = WordCoder(path), end.to_bytes(4, "little")
        ordinal, held, size = TaskContext.get().partitionId() << 32, [], 0

        def image():
            names, parts = zip(*held)
            whole = file_image(names, [len(x) // 4 for x in parts], np.frombuffer(b"".join(parts), "<u4"), bits, ordinal, block_ids)
            return pa.RecordBatch.from_arrays([pa.array([whole], pa.binary())], names=["image"])

        for batch in batches:
            names, at = batch.column(0).to_pylist(), 0
            for block in blocks((text.as_py() for text in batch.column(1)), BLOCK_CHARS):
                for name, ids in zip(names[at:at + len(block)], coder.ids(block)):
                    if held and size + len(ids) // 4 + 1 > file_ids:
                        yield image()
                        ordinal, held, size = ordinal + 1, [], 0
                    held.append((name, ids + last))
                    size += len(ids) // 4 + 1
                at += len(block)
        if held:
            yield image()

    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    (rows.withColumn("row", F.monotonically_increasing_id())
     .repartitionByRange(max(1, -(-total // task_bytes)), "doc", "row").sortWithinPartitions("doc", "row").select("doc", "text")
     .mapInArrow(run, "image binary").select(F.col("image").cast("string").alias("value"))
     .write.option("maxRecordsPerFile", 1).option("compression", "none").text(f"{target}/files"))
    _index_files(docs.sparkSession, target)


def _files(spark: SparkSession, target: str | list[str]) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(target).where("length > 0")


def _index_files(spark: SparkSession, target: str) -> None:
    """One row per file: path, ordinal, documents, ids, and the position of its first id in the whole stream."""
    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            heads = [struct.unpack(HEADER, x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([h[k] for h in heads], pa.int64()) for k in (5, 3, 4))],
                names=["path", "ordinal", "docs", "ids"])

    heads = _files(spark, f"{target}/files").select("path", F.substring("content", 1, HEADER_BYTES).alias("head"))
    # One row per file, not per document: a running sum over them is small.
    before = Window.orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    (heads.mapInArrow(run, "path string, ordinal bigint, docs bigint, ids bigint")
     .withColumn("position", F.coalesce(F.sum("ids").over(before), F.lit(0))).write.parquet(f"{target}/index"))


def read_index(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.schema("path string, ordinal long, docs long, ids long, position long").parquet(f"{target}/index")


def read_documents(spark: SparkSession, target: str, id_col: str = "doc_id") -> DataFrame:
    """All documents of the files: ``id_col``, ``start`` (ids before it), ``n_tokens``, ``ids`` (little-endian unsigned 32-bit)."""
    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for content in batch.column(0):
                file = TokenFile(content.as_buffer())
                ids, cuts = file.ids().tobytes(), (4 * file.starts).tolist()
                yield pa.RecordBatch.from_arrays([
                    pa.array([file.ordinal] * len(file.docs), pa.int64()), pa.array(file.docs, pa.int64()),
                    pa.array(file.starts[:-1]), pa.array(np.diff(file.starts)),
                    pa.array([ids[a:b] for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())],
                    names=["ordinal", "doc", "at", "n_tokens", "ids"])

    ship(spark)
    found = _files(spark, f"{target}/files").select("content").mapInArrow(
        run, "ordinal bigint, doc bigint, at bigint, n_tokens bigint, ids binary")
    index = broadcast_if_small(read_index(spark, target).select("ordinal", "position"))
    return found.join(index, "ordinal").select(
        F.col("doc").alias(id_col), (F.col("position") + F.col("at")).alias("start"), "n_tokens", "ids")


def read_range(spark: SparkSession, target: str, start: int, stop: int) -> DataFrame:
    """Ids ``start`` to ``stop`` of the whole stream, one row per file that holds some: ``position``, ``ids``.

    Only those files are read, and only the blocks in range are unpacked.
    """
    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for content, position in zip(batch.column(0), batch.column(1).to_pylist()):
                file, first = TokenFile(content.as_buffer()), max(start - position, 0)
                ids = file.ids(first, stop - position)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([position + first], pa.int64()), pa.array([ids.tobytes()], pa.binary())], names=["position", "ids"])

    ship(spark)
    held = read_index(spark, target).where((F.col("position") < stop) & (F.col("position") + F.col("ids") > start))
    paths = [r["path"] for r in held.select("path").collect()]  # the files of one requested range
    if not paths or stop <= start:
        return spark.createDataFrame([], "position long, ids binary")
    return _files(spark, paths).join(F.broadcast(held), "path").select("content", "position").mapInArrow(
        run, "position bigint, ids binary")
