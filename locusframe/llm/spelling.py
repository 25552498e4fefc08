"""Spelling variants: words one edit apart, compared in dense tiles of prefix and suffix lengths.

Two words of lengths L and L or L - 1 are one inserted, deleted or replaced
code point apart exactly if their common prefix and their common suffix
together reach L - 1.  The edit then lies behind the common prefix, so the
words agree outside any range of positions that holds it.  Words are dealt to
blocks by what is left of them without one of four such ranges; the words of a
block become padded matrices of code points, aligned left and right, and block
pairs are compared whole.  A block that is too large is dealt again by the
halves of its range; a range of one position leaves at most one word per
letter, so blocks are bounded without a cap and no pair is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.llm.common import anti_join, cut_lineage, scratch, semi_join, ship
from locusframe.session import broadcast_if_small

LETTERS = "a-z\\u00C0-\\u00FF"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Code points and occurrences of the words that are grouped; one in SLIPS (word, document) pairs loses a letter.
SHORTEST, FEWEST, SLIPS = 5, 3, 97
#: Ranges that a word is cut into at first, words of a block, code points that are compared at once.
RANGES, MOST, AT_ONCE = 4, 128, 8_000_000


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z only; the built-in function does just that unless there are other capitals or special cases."""
    return F.when(text.rlike(r"[^\x00-\x7F×ß-ÿ]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slips: int | None = SLIPS,
                shortest: int = SHORTEST, fewest: int = FEWEST) -> DataFrame:
    """``word`` and ``n``: runs of letters with at least ``shortest`` code points and ``fewest`` occurrences overall.

    ``slips`` deletes a letter wherever the checksum of document id and run is
    divisible by it; None takes the runs as they are.  A null text has no
    runs; a null id counts as empty; repeated rows count each.
    """
    runs = docs.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("doc"),
        F.explode(F.regexp_extract_all(lower_ascii(F.col(text_col)), F.lit(f"[{LETTERS}]+"), F.lit(0))).alias("run"))
    word = F.col("run")
    if slips:
        runs = runs.withColumn("h", F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary")))
        at = (F.col("h") % F.length("run")).cast("int")
        word = F.when(F.col("h") % slips == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
                      ).otherwise(word)
    return (runs.select(word.alias("word")).where(F.length("word") >= shortest)
            .groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= fewest))


def _dealt(rows: DataFrame, ranges: list[tuple[Column, Column, Column]]) -> DataFrame:
    """A row per word and range (size, first, last): ``key`` is what the word has outside the range."""
    def part(size: Column, first: Column, last: Column) -> Column:
        tail = size - last
        outside = F.concat(F.substring("word", F.lit(1), first), F.lit(" "), F.substring("word", F.length("word") - tail + 1, tail))
        return F.struct(size.alias("size"), first.alias("first"), last.alias("last"),
                        F.xxhash64(size, first, last, outside).alias("key"))

    return (rows.withColumn("_r", F.explode(F.array(*(part(*r) for r in ranges)))).select("word", "n", "_r.*")
            .where("first < last"))


def block_rows(words: DataFrame) -> DataFrame:
    """Words dealt to blocks of at most MOST words, or to ranges of one position: word, n, size, first, last, key."""
    ranges = []
    for more in (0, 1):  # a word meets words of its own length and, as the shorter one, longer words
        size = F.length("word") + more
        cuts = [F.floor(size * k / RANGES).cast("int") for k in range(RANGES + 1)]
        ranges += [(size, a, b) for a, b in zip(cuts[:-1], cuts[1:])]
    rows, done = _dealt(words.select("word", "n"), ranges), []
    while True:
        large = cut_lineage(rows.where("last - first > 1").groupBy("key").agg(F.count("*").alias("rows")).where(F.col("rows") > MOST))
        if large.isEmpty():
            done.append(rows)
            break
        done.append(anti_join(rows, large, "key"))
        middle = F.floor((F.col("first") + F.col("last")) / 2).cast("int")
        rows = cut_lineage(_dealt(semi_join(rows, large, "key").drop("key"), [
            (F.col("size"), F.col("first"), middle), (F.col("size"), middle, F.col("last"))]))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def near_words(words: DataFrame) -> DataFrame:
    """Links of a written table (word, n) of distinct words, in both directions: ``word``, ``near``, ``near_n``.

    Each pair is judged in one block only, that of the range which holds its
    edit.  Words of up to one code point have no links.
    """
    def run(batches) -> Iterator:
        import pyarrow as pa

        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            keys = table["key"].to_numpy()
            stop = int(np.searchsorted(keys, keys[-1], "left")) if len(keys) else 0
            held = table.slice(stop)  # the last block may go on in the next batch
            yield from _compared(table.slice(0, stop))
        if held is not None:
            yield from _compared(held)

    ship(words.sparkSession)
    return block_rows(words).repartition("key").sortWithinPartitions("key", "size", "first", "last").mapInArrow(
        run, "word string, near string, near_n bigint")


def _compared(table) -> Iterator:
    """Links within the blocks of a table that is sorted by block."""
    import pyarrow as pa

    low, high, length = (table[c].to_numpy() for c in ("first", "last", "size"))
    if not len(low):
        return
    changes = [x[1:] != x[:-1] for x in (table["key"].to_numpy(), length, low, high)]
    starts = np.flatnonzero(np.concatenate([[True], np.any(changes, axis=0)]))
    sizes = np.diff(np.append(starts, len(low)))
    starts, sizes = starts[sizes > 1], sizes[sizes > 1]
    if not len(starts):
        return
    words, n = table["word"].combine_chunks(), table["n"].to_numpy()
    shape = np.ceil(np.log2(sizes)).astype(int) * 64 + np.ceil(np.log2(length[starts])).astype(int)
    for kind in np.unique(shape):
        some = np.flatnonzero(shape == kind)
        g, width = int(sizes[some].max()), int(length[starts[some]].max())
        i, j = np.triu_indices(g, 1)
        step = max(1, AT_ONCE // (len(i) * width))
        for at in range(0, len(some), step):
            block = some[at:at + step]
            index = starts[block][:, None] + np.minimum(np.arange(g), sizes[block][:, None] - 1)
            good = np.arange(g) < sizes[block][:, None]
            rows, place = np.unique(index, return_inverse=True)
            left, right, size = _matrices(words.take(pa.array(rows)).to_pylist(), width)
            place = place.reshape(index.shape)
            for top in range(0, len(i), max(1, AT_ONCE // width)):  # one block of very long words goes in parts
                pi, pj = i[top:top + max(1, AT_ONCE // width)], j[top:top + max(1, AT_ONCE // width)]
                yield from _links(words, n, rows, place, good, left, right, size, pi, pj,
                                  low[starts[block]], high[starts[block]], length[starts[block]])


def _links(words, n, rows, place, good, left, right, size, i, j, low, high, length) -> Iterator:
    import pyarrow as pa

    valid = good[:, i] & good[:, j]
    block, pair = np.nonzero(valid)
    a, b = place[block, i[pair]], place[block, j[pair]]
    longer = np.maximum(size[a], size[b]) == length[block]
    block, a, b = block[longer], a[longer], b[longer]
    if not len(a):
        return
    prefix = _agreeing(left[a] == left[b])
    fits = (prefix >= low[block]) & (prefix < high[block])
    block, a, b, prefix = block[fits], a[fits], b[fits], prefix[fits]
    suffix = _agreeing(right[a] == right[b])
    near = prefix + suffix >= length[block] - 1
    a, b = rows[a[near]], rows[b[near]]
    yield pa.RecordBatch.from_arrays([
        words.take(pa.array(np.concatenate([a, b]))), words.take(pa.array(np.concatenate([b, a]))),
        pa.array(n[np.concatenate([b, a])])], names=["word", "near", "near_n"])


def _matrices(words: list[str], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points aligned left, code points of the reversed words aligned left, and lengths."""
    size = np.array(list(map(len, words)))
    left = np.array(words, f"<U{width}").view(np.uint32).reshape(len(words), width)
    if left.max(initial=0) < 256:
        left = left.astype(np.uint8)
    back = size[:, None] - 1 - np.arange(width)
    right = np.where(back >= 0, np.take_along_axis(left, np.maximum(back, 0), axis=1), 0)
    return left, right, size


def _agreeing(equal: np.ndarray) -> np.ndarray:
    """How many columns agree before the first that does not; distinct words of one width have such a column."""
    return np.argmin(equal, axis=1)


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slips: int | None = SLIPS,
                      shortest: int = SHORTEST, fewest: int = FEWEST) -> DataFrame:
    """Every word with its more frequent form: ``word, form, root, n, n_near, form_n``.

    ``form`` is the near word of largest n, of equal ones the first in code
    point order, if it occurs at least twice as often; ``root`` is reached by
    following forms.  ``n_near`` counts all near words.  Nulls and repeated
    rows as in ``word_counts``; an empty table, or one without such words,
    gives an empty result; other columns are not read.
    """
    with scratch(docs.sparkSession) as keep:
        words = cut_lineage(word_counts(docs, id_col, text_col, slips, shortest, fewest))
        # Of equal counts the smaller string: strings compare by bytes, which is code point order.
        best = near_words(words).groupBy("word").agg(
            F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("rank"), F.col("near").alias("form"))).alias("best"))
        good = -F.col("best.rank") >= 2 * F.col("n")
        formed = cut_lineage(words.join(best, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(good, F.col("best.form")).alias("form"), F.when(good, -F.col("best.rank")).alias("form_n")))
        roots = _roots(formed.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
        return keep(formed.join(broadcast_if_small(roots), "word", "left").select(
            "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))


def _roots(links: DataFrame) -> DataFrame:
    """The end of every chain: each round doubles how far a word looks; counts double along a chain, so rounds are few."""
    while True:
        ahead = broadcast_if_small(links.select(F.col("word").alias("root"), F.col("root").alias("further")))
        jumped = cut_lineage(links.join(ahead, "root", "left"))
        if jumped.where("further IS NOT NULL").isEmpty():
            return links
        links = jumped.select("word", F.coalesce("further", "root").alias("root"))
