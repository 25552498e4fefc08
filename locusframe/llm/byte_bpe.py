"""Byte-level BPE in DuckDB, one in-process database per Python worker.

Encoding: texts are cut into pieces by the tokenizer's pattern; the distinct
pieces of a block become rows (word, position, token) and a recursive query
joins neighbours with the merge table and contracts each word's leftmost pair
of minimum rank until no pair is left.  Decoding joins ids with the vocabulary
and concatenates by an ordered aggregation.  Spark deals out the documents;
nothing is shuffled, and a lost task only repeats its own input.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.llm.common import ship

#: Text of one block of documents, in characters, and tokens of one decoded slice.
BLOCK_CHARS = 2_000_000
SLICE_TOKENS = 500_000
#: Distinct words of one recursive query.
WORDS = 30_000
#: Entries of a worker's cache of encoded pieces; a full cache only repeats work.
CACHE = 400_000
CHUNKS = 200_000

# Neighbouring token positions join the merge table; each turn contracts the leftmost pair of minimum rank in every
# word that has one.  All turns stay in the result, so it serves words of up to SHORT bytes, whose turns are few.
SHORT = 64
CONTRACT_SHORT = """
WITH RECURSIVE t(w, ids, turn) AS (
  SELECT w, ids, 0 FROM start_words
  UNION ALL
  (WITH position AS (
     SELECT w, generate_subscripts(ids[2:], 1) AS p, unnest(ids[:-2])::BIGINT << 20 | unnest(ids[2:]) AS pair FROM t),
   least AS (SELECT w, min(merged::BIGINT << 32 | p) AS best FROM position JOIN merges USING (pair) GROUP BY w),
   hit AS (SELECT w, best & 4294967295 AS p, (best >> 32)::INTEGER AS merged FROM least)
   SELECT t.w, ids[:p - 1] || [merged] || ids[p + 2:], turn + 1 FROM t JOIN hit USING (w)))
SELECT w, arg_max(ids, turn) AS ids FROM t GROUP BY w ORDER BY w
"""
# Longer words: only the latest state is held, by key, and a turn contracts all occurrences of the pair.
# A contraction of all occurrences of a pair at once equals one at a time, unless the new token can
# form a pair of lower rank; such a token is not "safe" and only its leftmost pair is contracted.
CONTRACT_LONG = """
WITH RECURSIVE t(w, p, id) USING KEY (w, p) AS (
  SELECT w, generate_subscripts(ids, 1), unnest(ids) FROM start_words
  UNION
  (WITH live AS (
     SELECT w, p, id, lead(p) OVER o AS q, lead(id) OVER o AS nxt FROM recurring.t
     WHERE id >= 0 AND w IN (SELECT w FROM t) WINDOW o AS (PARTITION BY w ORDER BY p)),
   pair AS (
     SELECT w, p, q, merged, safe, min(merged) OVER (PARTITION BY w) AS least
     FROM live JOIN merges ON pair = id::BIGINT << 20 | nxt),
   hit AS (
     SELECT w, p, q, merged, safe, row_number() OVER o AS k, coalesce(lag(q) OVER o <> p, true) AS fresh
     FROM pair WHERE merged = least WINDOW o AS (PARTITION BY w ORDER BY p)),
   run AS (
     SELECT *, k - max(CASE WHEN fresh THEN k END) OVER (PARTITION BY w ORDER BY p) AS step FROM hit),
   go AS (SELECT w, p, q, merged FROM run WHERE k = 1 OR safe AND step % 2 = 0)
   SELECT w, p, merged FROM go UNION ALL SELECT w, q, -1 FROM go))
SELECT w, list(id ORDER BY p) AS ids FROM t WHERE id >= 0 GROUP BY w ORDER BY w
"""
DECODE = """
SELECT part, array_to_string(list(bytes ORDER BY p), '') AS bytes
FROM id_rows JOIN vocabulary USING (id) GROUP BY part ORDER BY part
"""


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Coder:
    """Merge table and vocabulary in DuckDB, and what is already encoded."""

    def __init__(self, path: str, pattern: str):
        import duckdb
        import pyarrow as pa
        import regex

        ranks = load_ranks(path)
        splits = [(ranks[token[:k]], ranks[token[k:]], rank) for token, rank in ranks.items()
                  for k in range(1, len(token)) if token[:k] in ranks and token[k:] in ranks]
        unsafe = {part for left, right, rank in splits for part in (left, right) if rank < part}
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "200MB"})
        self._load("merges", pa.table({
            "pair": pa.array([s[0] << 20 | s[1] for s in splits], pa.int64()),
            "merged": pa.array([s[2] for s in splits], pa.int32()),
            "safe": pa.array([s[2] not in unsafe for s in splits], pa.bool_())}))
        # One character per byte, so that strings of the vocabulary may end inside a UTF-8 character.
        self._load("vocabulary", pa.table({
            "id": pa.array(list(ranks.values()), pa.int32()),
            "bytes": pa.array([token.decode("latin-1") for token in ranks], pa.string())}))
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.of_byte = [ranks[bytes([b])] for b in range(256)]
        self.pieces: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    def _load(self, name: str, rows) -> None:
        self.db.register("rows", rows)
        self.db.execute(f"CREATE TABLE {name} AS FROM rows")
        self.db.unregister("rows")

    def contract(self, pieces: list[str]) -> None:
        """Encode distinct pieces into the cache."""
        data = [piece.encode() for piece in pieces]
        whole = [k for k, d in enumerate(data) if d in self.ranks]
        for k in whole:  # a piece that is a token stays whole
            self.pieces[pieces[k]] = self.ranks[data[k]].to_bytes(4, "little")
        rest = [k for k, d in enumerate(data) if d not in self.ranks]
        for query, some in ((CONTRACT_SHORT, [k for k in rest if len(data[k]) <= SHORT]),
                            (CONTRACT_LONG, [k for k in rest if len(data[k]) > SHORT])):
            for at in range(0, len(some), WORDS):
                ks = some[at:at + WORDS]
                for k, ids in zip(ks, self._contracted(query, [data[k] for k in ks])):
                    self.pieces[pieces[k]] = ids

    def _contracted(self, query: str, words: list[bytes]) -> Iterator[bytes]:
        import numpy as np
        import pyarrow as pa

        ends = np.cumsum([0, *map(len, words)]).astype(np.int32)
        tokens = np.array(self.of_byte, np.int32)[np.frombuffer(b"".join(words), np.uint8)]
        self.db.register("start_words", pa.table({
            "w": np.arange(len(words), dtype=np.int32),
            "ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(tokens))}))
        ids = self.db.sql(query).to_arrow_table()["ids"].combine_chunks()
        self.db.unregister("start_words")
        ends, values = ids.offsets.to_numpy(), ids.values.to_numpy().astype("<u4")
        return (values[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:]))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers.

        A single blank after a visible character always starts a piece, so
        texts are cut there first, by a plain split; a chunk that is empty or
        ends in white space depends on what follows, and then the whole text
        goes through the pattern.
        """
        make_room(self.pieces, CACHE)
        make_room(self.chunks, CHUNKS)
        chunks, split = self.chunks, self.split
        parts = [text.split(" ") for text in texts]
        fresh = {p for words in parts for p in words[1:] if p not in chunks}
        odd = {p for p in fresh if not p or p[-1].isspace()}
        fresh -= odd
        cut = {p: split(" " + p) for p in fresh}
        plain = [odd.isdisjoint(words[:-1]) and words[-1] not in odd and bool(words[0]) and not words[0][-1].isspace()
                 if odd or not words[0] or words[0][-1].isspace() else True for words in parts]
        heads = [split(words[0] if ok else text) for words, ok, text in zip(parts, plain, texts)]
        wanted = {x for pieces in cut.values() for x in pieces} | {x for pieces in heads for x in pieces}
        self.contract([x for x in wanted if x not in self.pieces])
        known = self.pieces.__getitem__
        for p, pieces in cut.items():
            chunks[p] = b"".join(map(known, pieces))
        return [b"".join(map(known, head)) + (b"".join(map(chunks.__getitem__, words[1:])) if ok else b"")
                for head, words, ok in zip(heads, parts, plain)]

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """The bytes that each list of ids stands for."""
        import numpy as np
        import pyarrow as pa

        out: list[list[str]] = [[] for _ in ids]
        for block in _slices(ids):
            size = np.array([len(part) // 4 for _, part in block])
            flat = np.frombuffer(b"".join(part for _, part in block), "<u4").astype(np.int32)
            self.db.register("id_rows", pa.table({
                "part": np.repeat(np.arange(len(block), dtype=np.int32), size),
                "p": np.arange(len(flat), dtype=np.int32), "id": flat}))
            found = self.db.sql(DECODE).to_arrow_table()
            self.db.unregister("id_rows")
            for part, text in zip(found["part"].to_pylist(), found["bytes"].to_pylist()):
                out[block[part][0]].append(text)
        return ["".join(parts).encode("latin-1") for parts in out]


def _slices(ids: list[bytes]) -> Iterator[list[tuple[int, bytes]]]:
    """Blocks of (index, ids), of at most SLICE_TOKENS tokens; a long list goes on in the next block."""
    block, room = [], SLICE_TOKENS * 4
    for k, data in enumerate(ids):
        at = 0
        while at < len(data):
            block.append((k, data[at:at + room]))
            at += len(block[-1][1])
            room -= len(block[-1][1])
            if not room:
                yield block
                block, room = [], SLICE_TOKENS * 4
    if block:
        yield block


@lru_cache(maxsize=2)
def coder(path: str, pattern: str) -> Coder:
    return Coder(path, pattern)


def make_room(cache: dict, limit: int) -> None:
    """Drop the newer half of a full cache: what is frequent came in early."""
    if len(cache) > limit:
        for key in list(islice(reversed(cache), len(cache) // 2)):
            del cache[key]


def blocks(values: Iterable, most: int) -> Iterator[list]:
    """Consecutive values in lists of a bounded total length."""
    block, size = [], 0
    for value in values:
        block.append(value)
        size += len(value)
        if size >= most:
            yield block
            block, size = [], 0
    if block:
        yield block


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
           round_trip: bool = False) -> DataFrame:
    """``id_col``, ``ids`` (little-endian unsigned 32-bit) and ``n_tokens`` of every whole text, without special tokens.

    With ``round_trip`` also ``decoded``, made from the ids alone by the same
    worker, which spares a second set of Python workers.  A null or empty text
    has no ids.  Repeated rows are encoded each for itself; an empty table
    gives an empty result; other columns are not read.
    """
    def run(batches):
        import pyarrow as pa

        own = coder(path, pattern)
        for batch in batches:
            at = 0
            for block in blocks(batch.column(1).to_pylist(), BLOCK_CHARS):
                ids = own.encode(block)
                out = [batch.column(0).slice(at, len(block)), pa.array(ids, pa.binary()),
                       pa.array([len(x) // 4 for x in ids], pa.int64())]
                if round_trip:
                    out.append(pa.array(own.decode(ids), pa.binary()))
                yield pa.RecordBatch.from_arrays(out, names=[id_col, "ids", "n_tokens", "decoded"][:len(out)])
                at += len(block)

    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(
        run, f"`{id_col}` {kind}, ids binary, n_tokens bigint" + ", decoded binary" * round_trip)


def decode(encoded: DataFrame, path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """The rows of ``encoded`` with ``decoded``: the bytes its ids stand for; null ids count as none."""
    def run(batches):
        import pyarrow as pa

        own = coder(path, pattern)
        for batch in batches:
            at = 0
            for ids in blocks([x or b"" for x in batch.column(ids_col).to_pylist()], 4 * SLICE_TOKENS):
                rows = batch.slice(at, len(ids))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(own.decode(ids), pa.binary())],
                                                 names=[*rows.schema.names, "decoded"])
                at += len(ids)

    ship(encoded.sparkSession)
    plain = encoded.drop("decoded")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema)
    return plain.mapInArrow(run, f"{kinds}, decoded binary")
