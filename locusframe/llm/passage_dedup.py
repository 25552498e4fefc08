"""Repeated passages: paragraph MinHash banding, and windows for what is inside paragraphs.

The lines of a text are its paragraphs.  Their shingle sets are banded for
high recall, colliding ones are confirmed by exact Jaccard similarity, and
removals are clustered by the components of the links: of a component the
first paragraph in order of document id stays.  A passage that is copied into
the middle of other paragraphs makes no paragraph similar; so every text also
gives overlapping windows of words that begin at local minima of the shingle
hashes, the same places in every copy, and windows with equal words in two
documents are removed likewise.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.llm.common import cut_compressed, cut_lineage, join_counted, release, scratch, ship, small_batches
from locusframe.llm.near_dedup import near_duplicates
from locusframe.llm.shingles import mix, odd_numbers, shingles, words_of
from locusframe.session import broadcast_if_small

#: Words of a window, and shingle positions one of which begins a window: a copied passage of
#: WINDOW + REACH - 1 words or more holds a window entirely.
WINDOW, REACH = 32, 16
#: Words of a shingle.
WIDTH = 5
#: Words of the shortest paragraph that is compared.
SHORTEST = 20
PERCENT, BANDS, ROWS = 80, 12, 4
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def paragraphs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Lines of at least SHORTEST words: id, doc, first (its first word in the document), words, line."""
    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            doc, first, words, lines = [], [], [], []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                at = 0
                for line in text.split("\n"):
                    n = len(line.encode().split())
                    if n >= SHORTEST:
                        doc.append(name)
                        first.append(at)
                        words.append(n)
                        lines.append(line)
                    at += n
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(first, pa.int64()), pa.array(words, pa.int64()), pa.array(lines, pa.string())],
                names=["doc", "first", "words", "line"])
            release(pa)

    return _texts(docs, id_col, text_col).mapInArrow(
        run, "doc bigint, first bigint, words bigint, line string").withColumn("id", F.monotonically_increasing_id())


def windows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Windows of every text: 128 bits of its words' hash (high, low), doc and first word."""
    def run(batches) -> Iterator:
        import pyarrow as pa

        factors = odd_numbers(2 * WINDOW, 51).reshape(2, WINDOW)
        for batch in batches:
            at = 0
            for words, cuts in words_of(batch.column(1).to_pylist()):
                size = np.diff(cuts)
                place = anchors(shingles(words), cuts[:-1], np.maximum(size - WIDTH + 1, 0))
                row = np.searchsorted(cuts, place, "right") - 1
                whole = place + WINDOW <= cuts[row + 1]
                place, row = place[whole], row[whole]
                high, low = np.zeros(len(place), np.uint64), np.zeros(len(place), np.uint64)
                for k in range(WINDOW):
                    some = words[place + k]
                    high += some * factors[0, k]
                    low += some * factors[1, k]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(mix(high).view(np.int64)), pa.array(mix(low).view(np.int64)),
                     batch.column(0).take(pa.array(at + row)), pa.array(place - cuts[row])], names=["high", "low", "doc", "first"])
                at += len(size)
            release(pa)

    return _texts(docs, id_col, text_col).mapInArrow(run, "high bigint, low bigint, doc bigint, first bigint")


def anchors(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, reach: int = REACH) -> np.ndarray:
    """Positions that hold the smallest of some ``reach`` consecutive values of one run, the last of equal ones.

    Runs have ``sizes`` values from ``starts`` on; those of fewer than ``reach`` give none.
    """
    least, where, width = values, np.arange(len(values)), 1
    while width < reach and len(least):  # of ``width`` values from each position on; two such stretches make the next, whatever they share
        step = min(width, reach - width)
        right = least[step:] <= least[:-step]
        least, where = np.where(right, least[step:], least[:-step]), np.where(right, where[step:], where[:-step])
        width += step
    n = np.maximum(sizes - reach + 1, 0)
    first = np.repeat(starts - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
    found = where[first]  # never falls from one position to the next
    return found[np.concatenate([[True], found[1:] != found[:-1]])] if len(found) else found


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    ship(docs.sparkSession)
    return docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))


def _alike(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Written spans (doc, start, end, source) of lines like one of an earlier document; lines and sketches are deleted before windows are made."""
    with scratch(docs.sparkSession) as keep:
        with small_batches(docs.sparkSession):
            lines = cut_compressed(paragraphs(docs, id_col, text_col))
        near = near_duplicates(lines, "id", "line", PERCENT, 5, BANDS, ROWS, spread=True).select("id", "component_id")
        placed = cut_lineage(lines.select("id", "doc", "first", "words").join(near, "id"))
        groups = cut_lineage(placed.groupBy("component_id").agg(
            F.min("doc").alias("source"), F.max("doc").alias("other"), F.count("*").alias("rows")).where("source < other"))
        return keep(join_counted(placed, groups, "component_id", "rows", spread=True).where("doc <> source")
                    .select("doc", F.col("first").alias("start"), (F.col("first") + F.col("words")).alias("end"), "source"))


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Written table of documents that lose words: ``doc`` and ``spans`` of words (start, end, source: who keeps them)."""
    with scratch(docs.sparkSession) as keep:
        alike = _alike(docs, id_col, text_col)
        with small_batches(docs.sparkSession):
            found = cut_lineage(windows(docs, id_col, text_col))
        keys = cut_lineage(found.groupBy("high", "low").agg(
            F.min("doc").alias("source"), F.max("doc").alias("other"), F.count("*").alias("rows")).where("source < other"))
        copied = (join_counted(found, keys, ["high", "low"], "rows", spread=True).where("doc <> source")
                  .select("doc", F.col("first").alias("start"), (F.col("first") + WINDOW).alias("end"), "source"))
        return keep(alike.unionByName(copied).groupBy("doc").agg(
            F.array_sort(F.collect_set(F.struct("start", "end", "source"))).alias("spans")))


def _merged(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s in sorted((x["start"], x["end"]) for x in spans):
        if out and s[0] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], s[1]))
        else:
            out.append(s)
    return out


def _joined(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of many rows, in order of row and start, without those that touch one before: row, start and end."""
    if not len(row):
        return row, start.astype(np.int64), end.astype(np.int64)
    room = row * (int(end.max()) + 1)  # rows lie behind each other, so that none touches the next
    reach = np.maximum.accumulate(end + room)
    opens = np.concatenate([[True], (start + room)[1:] > reach[:-1]])
    last = np.append(np.flatnonzero(opens)[1:], len(row)) - 1
    return row[opens], start[opens], reach[last] - room[last]


def _distinct(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of each row, sorted and once each."""
    order = np.lexsort((value, row))
    row, value = row[order], value[order].astype(np.int64)
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[new], value[new]


def word_totals(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc`` and ``n_words`` of every row, a null text as empty."""
    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            n = [len((text.as_py() or "").encode().split()) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["doc", "n_words"])
            release(pa)

    ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).mapInArrow(run, "doc bigint, n_words bigint")


def without(text: str, spans: list[dict]) -> str:
    """The text without the words of the spans; the white space before what follows a span stays."""
    places = [m.span() for m in WORD.finditer(text)]
    out, at = [], 0
    for start, end in _merged(spans):
        out.append(text[at:places[start][0]])
        at = places[end][0] if end < len(places) else len(text)
    return "".join([*out, text[at:]]).strip(" \n")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, ``n_words``, ``removed_words``, ``spans`` and ``sources``.

    Spans are runs of words [start, end) that an earlier document keeps;
    ``sources`` are the ids of these documents.  A null text or id has nothing
    to remove; rows that share an id are one document; repetitions within one
    document stay.  An empty table gives an empty result; other columns are
    not read.
    """
    found = removals(docs, id_col, text_col)

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            n, lists = batch.num_rows, batch.column("spans")
            size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            start, end, source = (x.to_numpy(zero_copy_only=False) for x in lists.flatten().flatten())
            row, first, last = _joined(np.repeat(np.arange(n), size), start, end)
            whose, who = _distinct(np.repeat(np.arange(n), size), source)
            removed = np.zeros(n, np.int64)
            np.add.at(removed, row, last - first)
            spans = pa.StructArray.from_arrays([pa.array(first), pa.array(last)], names=["start", "end"])
            rows = np.arange(n + 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), batch.column("n_words"), pa.array(removed),
                 pa.ListArray.from_arrays(pa.array(np.searchsorted(row, rows).astype(np.int32)), spans),
                 pa.ListArray.from_arrays(pa.array(np.searchsorted(whose, rows).astype(np.int32)), pa.array(who))],
                names=[id_col, "n_words", "removed_words", "spans", "sources"])

    with small_batches(docs.sparkSession):
        sized = cut_lineage(word_totals(docs, id_col, text_col))
    return sized.join(found, "doc", "left").mapInArrow(
        run, f"`{id_col}` bigint, n_words bigint, removed_words bigint, "
             "spans array<struct<start: bigint, end: bigint>>, sources array<bigint>")


def drop_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the repeated passages, all columns kept; texts that lose nothing are not touched.

    A document of which no word is left goes.
    """
    found = removals(docs, id_col, text_col)
    names = broadcast_if_small(found.select(F.col("doc").alias("__passage_doc")))
    key = F.col(id_col).cast("long")
    whole = docs.withColumn("__passage_doc", key)
    cut = whole.join(names, "__passage_doc", "left_semi").join(found.withColumnsRenamed({"doc": "__passage_doc", "spans": "__passage_spans"}), "__passage_doc")

    @F.pandas_udf("string")
    def clean(texts, spans):
        return texts.combine(spans, lambda text, x: text if text is None else without(text, list(x)))

    changed = cut.withColumn(text_col, clean(F.col(text_col), F.col("__passage_spans"))).where(
        F.col(text_col).rlike(WORD.pattern)).select(*docs.columns)
    return whole.join(names, "__passage_doc", "left_anti").select(*docs.columns).unionByName(changed)
