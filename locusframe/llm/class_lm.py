"""Class-based bigram language model with exchange clustering.

Every word that is seen twice or more is put into a class by the exchange
algorithm: it moves to the class that raises the likelihood of the class
bigrams most.  The most frequent words begin, on the driver; then the words
that every worker holds move in tasks, sweep after sweep, each judged by its
counts beside the classes; then all other words, whose classes are a table.
A word that is seen once belongs to an open class by its last character, as
words do that were never seen: without its only place nothing tells its class.
A word's probability is the smoothed transition between classes times its
emission from its class; in open classes an absolute discount is kept for
words that were never seen.  Counts cover every training text; only those of
a fixed number of words and classes reach the driver, and the counts and
classes of all other words are joined where they are needed.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.llm.byte_bpe import blocks
from locusframe.llm.common import cut_compressed, cut_lineage, release, ship, small_batches

#: Words that the driver clusters to begin with, classes, sweeps over them, and words whose counts every worker holds.
CLUSTERED, CLASSES, SWEEPS, HEAD = 1024, 64, 4, 65_536
#: Words whose classes every worker holds, and sweeps over these in tasks; the classes of all others are joined.
HELD, HELD_SWEEPS = 65_536, 3
#: Open classes, by the last byte: letter, digit, full stop, comma, colon or semicolon, end of question, other.
OPEN = 7
#: Distinct words that a task counts before it hands them on, and entries of a worker's cache.
FLUSH, CACHE = 300_000, 300_000
#: Tokens whose neighbours are counted before the counts are handed on, and words that are judged at once.
PAIR_BLOCK, JUDGED = 2_000_000, 250
#: Characters of texts that are scored before their rows are handed on.
BLOCK_CHARS = 2_000_000
END = ""  # no word is empty


#: Open class of a word by its last byte.
SHAPES = bytes(0 if chr(b).isalpha() or b >= 128 else 1 if chr(b).isdigit() else {46: 2, 44: 3, 58: 4, 59: 4, 33: 5, 63: 5}.get(b, 6) for b in range(256))


def shape(word: bytes) -> int:
    return SHAPES[word[-1]]


def tokens(text: str | None) -> list[bytes]:
    """Words after lower-casing A-Z; the end comes on top."""
    return (text or "").encode().lower().split()


def word_counts(rows: DataFrame, text_col: str) -> DataFrame:
    """``word``, ``open`` (its shape) and ``n``, the end of text as the empty word."""
    def run(batches) -> Iterator:
        import pyarrow as pa

        def out(held):
            words = list(held)
            return pa.RecordBatch.from_arrays(
                [pa.array(words, pa.string()), pa.array([SHAPES[w[-1]] if w else -1 for w in words], pa.int32()),
                 pa.array(held.values(), pa.int64())], names=["word", "open", "n"])

        held: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.update(tokens(text))
                held[b""] += 1
                if len(held) > FLUSH:
                    yield out(held)
                    held.clear()
        yield out(held)

    return rows.select(text_col).mapInArrow(run, "word string, open int, n bigint").groupBy("word", "open").agg(
        F.sum("n").alias("n"))


class _Units(dict):
    """Unit of a word: its place among the clustered words, or its open class after them."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = CLUSTERED + shape(word)
        return value


UNITS = CLUSTERED + OPEN + 1
END_UNIT = UNITS - 1
#: Classes, open classes and the end.
KINDS = CLASSES + OPEN + 1


def _lines(batches, own: dict) -> Iterator[np.ndarray]:
    """Numbers of the tokens of whole texts, about PAIR_BLOCK at once; each text begins and ends with the end."""
    end, parts, size = own[b""], [], 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            words = tokens(text)
            parts += [np.fromiter(map(own.__getitem__, words), np.int64, len(words)), [end]]
            size += len(words) + 1
            if size > PAIR_BLOCK:
                yield np.concatenate([[end], *parts]).astype(np.int64)
                parts, size = [], 0
    if parts:
        yield np.concatenate([[end], *parts]).astype(np.int64)


class _Ranks(dict):
    """Number of a word: its place among the held words, or its open class after them."""

    def __init__(self, held: dict[bytes, int]):
        super().__init__(held)
        self.held = len(held)
        self[b""] = self.held + OPEN

    def __missing__(self, word: bytes) -> int:
        value = self.held + shape(word)
        if len(self) < self.held + CACHE:
            self[word] = value
        return value


def held_bigrams(rows: DataFrame, text_col: str, held: dict[bytes, int]) -> DataFrame:
    """``pair`` (first number * (held words + OPEN + 1) + second) and ``n`` over all texts, written."""
    shared = rows.sparkSession.sparkContext.broadcast(held)  # at most HELD words
    width = len(held) + OPEN + 1

    def run(batches) -> Iterator:
        import pyarrow as pa

        for line in _lines(batches, _Ranks(shared.value)):
            pair, n = np.unique(line[:-1] * width + line[1:], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n.astype(np.int64))], names=["pair", "n"])

    return cut_compressed(rows.select(text_col).mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")))


def folded(pairs: DataFrame, to: np.ndarray, kinds: int) -> np.ndarray:
    """Counts of neighbours after every number became its kind ``to[number]``: kinds * kinds."""
    shared, width = pairs.sparkSession.sparkContext.broadcast(to), len(to)

    def run(batches) -> Iterator:
        import pyarrow as pa

        to, held = shared.value, np.zeros(kinds * kinds, np.int64)
        for batch in batches:
            a, b = np.divmod(batch.column(0).to_numpy(), width)
            np.add.at(held, to[a] * kinds + to[b], batch.column(1).to_numpy())
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some])], names=["cell", "n"])

    return _dense(pairs.mapInArrow(run, "cell bigint, n bigint"), kinds)


def _dense(cells: DataFrame, kinds: int) -> np.ndarray:
    out = np.zeros(kinds * kinds)
    found = cells.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # at most kinds ** 2 rows
    out[found["cell"].to_numpy().astype(np.int64)] = found["n"].to_numpy()
    return out.reshape(kinds, kinds)


def held_profiles(pairs: DataFrame, to: np.ndarray, wanted: np.ndarray) -> DataFrame:
    """Of ``wanted`` held words ``word``, ``at`` and ``n``: how often a kind follows the word (at the kind), the word follows one (KINDS + it) or itself (2 * KINDS)."""
    shared, width, slots = pairs.sparkSession.sparkContext.broadcast((to, wanted)), len(to), 2 * KINDS + 1

    def run(batches) -> Iterator:
        import pyarrow as pa

        to, wanted = shared.value
        held = np.zeros(width * slots, np.int64)  # at most HELD + OPEN + 1 words
        for batch in batches:
            (a, b), n = np.divmod(batch.column(0).to_numpy(), width), batch.column(1).to_numpy()
            same, right, left = (a == b) & wanted[a], (a != b) & wanted[a], (a != b) & wanted[b]
            np.add.at(held, a[right] * slots + to[b[right]], n[right])
            np.add.at(held, b[left] * slots + KINDS + to[a[left]], n[left])
            np.add.at(held, a[same] * slots + 2 * KINDS, n[same])
        for low in range(0, len(held), slots * 4096):
            key = low + np.flatnonzero(held[low:low + slots * 4096])
            word, at = np.divmod(key, slots)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(at.astype(np.int32)), pa.array(held[key])], names=["word", "at", "n"])

    return pairs.mapInArrow(run, "word bigint, at int, n bigint")


def best_classes(m: np.ndarray, profile: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The class to which each word would move, alone, from its class ``own``; ``profile`` as in ``held_profiles``, one row per word.

    What ``exchange`` computes word by word: the gain of a class is that of the
    cells which the word's own counts touch, after it was taken out of its class.
    """
    def h(x):
        return x * np.log(np.maximum(x, 1e-300))

    right, left, alone = profile[:, :KINDS], profile[:, KINDS:2 * KINDS], profile[:, 2 * KINDS]
    weight, rows = right.sum(axis=1) + alone, np.arange(len(profile))
    inside = own < CLASSES
    word, at = np.nonzero(profile[:, :2 * KINDS])
    v, j, after, a = profile[word, at], at % KINDS, at < KINDS, own[word]
    cell = np.where(after[:, None], m[:CLASSES, j].T, m[j, :CLASSES])
    beside = j == a
    cell[beside & after] -= left[word[beside & after], :CLASSES]
    cell[beside & ~after] -= right[word[beside & ~after], :CLASSES]
    mine = np.flatnonzero(inside[word] & ~beside)
    cell[mine, a[mine]] -= v[mine]
    change = h(cell + v[:, None]) - h(cell)
    inner = np.flatnonzero(j < CLASSES)
    change[inner, j[inner]] = 0  # the cell of a class with itself is below
    gain = np.zeros((len(profile), CLASSES))
    starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else word
    if len(word):
        gain[word[starts]] = np.add.reduceat(change, starts)
    added = right[:, :CLASSES] + left[:, :CLASSES] + alone[:, None]
    diagonal, size = np.tile(np.diagonal(m)[:CLASSES], (len(profile), 1)), np.tile(m.sum(axis=1)[:CLASSES], (len(profile), 1))
    some = rows[inside]
    diagonal[some, own[some]] -= added[some, own[some]]
    size[some, own[some]] -= weight[some]
    gain += h(diagonal + added) - h(diagonal) - 2 * (h(size + weight[:, None]) - h(size))
    best = np.argmax(gain, axis=1)
    stays = inside & (gain[rows, best] <= gain[rows, np.where(inside, own, 0)] + 1e-9)
    return np.where(stays, own, best)


def _by_word(batches) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Columns of rows that are sorted by word, always with all rows of a word."""
    held: list = []
    for batch in chain(batches, [None]):
        if batch is not None:
            held.append([c.to_numpy() for c in batch.columns])
            if sum(len(x[0]) for x in held) < 50_000:
                continue
        if not held:
            return
        columns = [np.concatenate(x) for x in zip(*held)]
        last = len(columns[0]) if batch is None else int(np.searchsorted(columns[0], columns[0][-1]))
        held = [[c[last:] for c in columns]]
        if last:
            yield tuple(c[:last] for c in columns)


def moves(profiles: DataFrame, m: np.ndarray, to: np.ndarray | None = None) -> DataFrame:
    """``word``, ``cls``, ``cell`` and ``n``: the class of every word by its counts in ``profiles``.

    Words with ``to`` are numbers of held ones and begin in that class.  Others
    are ids as in ``_Ids`` and begin in their open class, where they stay if
    they were seen once; of these the class bigrams with held neighbours are
    given, too, with a null word.  Neighbours that are not held count as their
    open class, at 2 * KINDS and more for ids.
    """
    shared = profiles.sparkSession.sparkContext.broadcast((m, to))

    def run(batches) -> Iterator:
        import pyarrow as pa

        def out(word, cls, cell, n):
            return pa.RecordBatch.from_arrays([pa.array(word, pa.int64()), pa.array(cls, pa.int32()), pa.array(cell, pa.int64()), pa.array(n, pa.int64())],
                                              names=["word", "cls", "cell", "n"])

        (m, to), cells = shared.value, np.zeros(KINDS * KINDS, np.int64)
        for word, at, n in _by_word(batches):
            new = np.concatenate([[True], word[1:] != word[:-1]])
            names, where = word[new], np.cumsum(new) - 1
            cls = to[names] if to is not None else CLASSES + (names & 7)
            slot = at if to is not None else at % (2 * KINDS)
            follows = (slot < KINDS) | (slot == 2 * KINDS)
            often = np.bincount(where[follows], n[follows], len(names)) > 1
            some, kept = np.flatnonzero(often), often[where]
            place, slot, count = (np.cumsum(often) - 1)[where[kept]], slot[kept], n[kept]
            for low in range(0, len(some), JUDGED):
                a, b = np.searchsorted(place, [low, low + JUDGED])
                who = some[low:low + JUDGED]
                profile = np.bincount((place[a:b] - low) * (2 * KINDS + 1) + slot[a:b], count[a:b], len(who) * (2 * KINDS + 1)).reshape(len(who), -1)
                cls[who] = best_classes(m, profile, cls[who])
            if to is None:
                held, mine = at < 2 * KINDS, cls[where]
                side, kind = np.divmod(at, KINDS)
                cell = np.where(side == 0, mine * KINDS + kind, kind * KINDS + mine)[held]
                cells += np.bincount(cell, n[held], KINDS * KINDS).astype(np.int64)
                names, cls = names[cls < CLASSES], cls[cls < CLASSES]
            yield out(names, cls, np.full(len(names), -1), np.zeros(len(names)).astype(np.int64))
        some = np.flatnonzero(cells)
        yield out([None] * len(some), np.full(len(some), -1), some, cells[some])

    return profiles.repartition("word").sortWithinPartitions("word").mapInArrow(run, "word bigint, cls int, cell bigint, n bigint")


def word_id(word, opened):
    """Id of a word that is not held: its hash, with the open class in the last three bits."""
    return F.xxhash64(word).bitwiseAND(F.lit(-8)).bitwiseOR(opened.cast("long"))


class _Ids(dict):
    """Number of each word that a task has met: below KINDS the class of a held word, from there on others, whose ids are listed."""

    def __init__(self, held: dict[bytes, int]):
        super().__init__(held)
        self.ids: list[int] = []
        self[b""] = KINDS - 1

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = self[word] = KINDS + len(self.ids)
        x = xxhash.xxh64_intdigest(word, seed=42) & ~7 | SHAPES[word[-1]]  # as Spark's xxhash64
        self.ids.append(x - (1 << 64) if x >> 63 else x)
        return value


def other_neighbours(rows: DataFrame, text_col: str, held: dict[bytes, int]) -> DataFrame:
    """Neighbours by the classes of the held words, written: class bigrams, profiles of all other words, and pairs of these.

    ``word`` (an id, null for class bigrams), ``at`` (the cell, the place in a
    profile, or -1 in a pair), ``other`` (second id of a pair) and ``n``.
    """
    shared = rows.sparkSession.sparkContext.broadcast(held)  # at most HELD words

    def run(batches) -> Iterator:
        import pyarrow as pa

        def out(word, at, other, n):
            return pa.RecordBatch.from_arrays([pa.array(word, pa.int64()), pa.array(at, pa.int32()), pa.array(other, pa.int64()), pa.array(n, pa.int64())],
                                              names=["word", "at", "other", "n"])

        own, cells = _Ids(shared.value), np.zeros(KINDS * KINDS, np.int64)
        for line in _lines(batches, own):
            ids = np.array(own.ids, np.int64)
            x, y = line[:-1], line[1:]
            first, second = x >= KINDS, y >= KINDS
            cells += np.bincount((x * KINDS + y)[~first & ~second], minlength=KINDS * KINDS)
            kind = np.concatenate([np.arange(KINDS), 2 * KINDS + CLASSES + (ids & 7)])  # of a neighbour; 2 * KINDS: it is not held
            key, n = np.unique(np.concatenate([(x[first] - KINDS) * 4 * KINDS + kind[y[first]],
                                               (y[second] - KINDS) * 4 * KINDS + KINDS + kind[x[second]]]), return_counts=True)
            word, at = np.divmod(key, 4 * KINDS)
            yield out(ids[word], at, [None] * len(at), n)
            both = first & second
            pair, n = np.unique((x[both] - KINDS) * max(1, len(ids)) + y[both] - KINDS, return_counts=True)
            word, other = np.divmod(pair, max(1, len(ids)))
            yield out(ids[word], np.full(len(n), -1), ids[other], n)
            if len(own) > CACHE + HELD:
                own = _renewed(own, shared.value)
        some = np.flatnonzero(cells)
        yield out([None] * len(some), some, [None] * len(some), cells[some])

    return cut_compressed(rows.select(text_col).mapInArrow(run, "word bigint, at int, other bigint, n bigint"))


def _renewed(own: _Ids, held: dict[bytes, int]) -> _Ids:
    """The same object without the words met so far, as a generator goes on with it."""
    own.clear()
    own.__init__(held)
    return own


def exchange(bigrams: np.ndarray, words: int, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of every unit: the first ``words`` units move between ``classes``, the others keep one each."""
    units = len(bigrams)
    own = np.concatenate([np.arange(words) % classes, classes + np.arange(units - words)]).astype(np.int64)
    k = classes + units - words

    def h(x):
        return x * np.log(np.maximum(x, 1e-300))

    one = np.zeros((units, k))
    one[np.arange(units), own] = 1
    b = bigrams.astype(float)
    m = one.T @ b @ one
    weight = b.sum(axis=1)
    size = one.T @ weight
    for _ in range(sweeps):
        moved = 0
        for w in range(words):
            if not weight[w]:
                continue
            a, alone = own[w], b[w, w]
            right, left = np.bincount(own, b[w], k), np.bincount(own, b[:, w], k)
            m[a] -= right
            m[:, a] -= left
            m[a, a] += alone
            size[a] -= weight[w]
            right[a] -= alone
            left[a] -= alone
            block_r, block_l = m[:classes], m[:, :classes].T
            gain = (h(block_r + right) - h(block_r)).sum(axis=1) + (h(block_l + left) - h(block_l)).sum(axis=1)
            inner, c = np.diagonal(m)[:classes], np.arange(classes)
            gain += (h(inner + right[c] + left[c] + alone) - h(inner)
                     - (h(inner + right[c]) - h(inner)) - (h(inner + left[c]) - h(inner)))
            gain -= 2 * (h(size[:classes] + weight[w]) - h(size[:classes]))
            best = int(np.argmax(gain))
            best = best if gain[best] > gain[a] + 1e-9 else int(a)
            m[best] += right
            m[:, best] += left
            m[best, best] += alone
            size[best] += weight[w]
            moved += best != a
            own[w] = best
        if not moved:
            break
    return own


@dataclass(frozen=True)
class Model:
    """What every worker holds: a fixed number of words, classes and constants."""

    total: int  # training tokens
    distinct: int  # distinct training tokens
    counts: dict[bytes, int]  # of the most frequent words
    units: dict[bytes, int]  # of the words whose classes every worker holds: a place among the first, or UNITS and the class
    classes: np.ndarray  # class of each unit
    transition: np.ndarray  # log10 P(class | class before)
    size: np.ndarray  # training tokens of each class
    seen: np.ndarray  # distinct training words of each open class
    discount: float

    def emission(self, n: int, unit: int) -> float:
        """log10 P(word | class) of a word with that training count."""
        size = self.size[self.classes[unit]]
        if unit < CLUSTERED or unit >= END_UNIT:
            return math.log10(n / size)
        if n:
            return math.log10((n - self.discount) / size)
        return math.log10(self.discount * self.seen[unit - CLUSTERED] / size) if size else -math.log10(self.distinct + 1)

    def base(self, n: int) -> float:
        return math.log10((n + 1) / (self.total + self.distinct + 1))


def frequent_words(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The most frequent words, ``most`` or all, in order of their counts; of equal counts at the border by hash.

    Histograms, of sixteenths of powers of two and then of the hashes within
    the border level, show which words are few enough; only those leave their
    tasks.
    """
    level, order = F.floor(F.log2("n") * 16), F.struct((-F.col("n")).alias("n"), F.xxhash64("word").alias("h"))
    words = counts.where("word != ''")
    border, held = None, 0
    for at, n in sorted(((r["level"], r["count"]) for r in words.groupBy(level.alias("level")).count().collect()), reverse=True):
        if held + n > most:
            border = at
            break
        held += n
    chosen = words.where(F.lit(border is None) | (level > F.lit(border)))
    if border is not None and held < most:
        inside = words.where(level == border)
        sizes = sorted(((r["n"], r["count"]) for r in inside.groupBy("n").count().collect()), reverse=True)
        for count, n in sizes:  # a level spans few counts; of the last one a share of the hashes, then the smallest of them
            part = inside.where(F.col("n") == count)
            if held + n > most:
                share = min(1.0, (1.5 * (most - held) + 50) / n)
                part = part.where(F.xxhash64("word") / float(1 << 64) + 0.5 <= share).orderBy(order).limit(most - held)
                chosen = chosen.unionByName(part)
                break
            chosen, held = chosen.unionByName(part), held + n
    found = [(r["word"].encode(), r["n"]) for r in chosen.select("word", "n").collect()]
    return sorted(found, key=lambda x: (-x[1], x[0]))


def fit(rows: DataFrame, text_col: str = "text") -> tuple[Model, DataFrame]:
    """The model, and the written counts and classes of all words."""
    spark = rows.sparkSession
    ship(spark)
    with small_batches(spark):
        counts = cut_lineage(word_counts(rows, text_col))
    total, distinct = (int(x or 0) for x in counts.agg(F.sum("n"), F.count("*")).first())
    head = frequent_words(counts, max(HEAD, HELD))
    held = {word: k for k, (word, n) in enumerate(head[:HELD]) if k < CLUSTERED or n > 1}
    opened = np.array([shape(word) for word in held] + [*range(OPEN), OPEN], np.int64)
    with small_batches(spark):
        pairs = held_bigrams(rows, text_col, held)
    first = np.where(np.arange(len(opened)) < min(CLUSTERED, len(held)), np.arange(len(opened)), CLUSTERED + opened)
    start = exchange(folded(pairs, first, UNITS), CLUSTERED)
    to = start[first]
    m = folded(pairs, to, KINDS)
    number = np.arange(len(to))
    for sweep in range(HELD_SWEEPS):
        # The first sweep takes all words out of open classes; in later ones a half moves, and the other half sees what moved.
        wanted = (number < len(held)) & ((sweep == 0) | (number % 2 == sweep % 2))
        found = moves(held_profiles(pairs, to, wanted), m, to).where("word is not null").select("word", "cls").toArrow()  # at most HELD rows
        now = to.copy()
        now[found["word"].to_numpy()] = found["cls"].to_numpy()
        then = folded(pairs, now, KINDS)
        if _likelihood(then) <= _likelihood(m):
            break
        to, m = now, then
    classes = {word: int(to[k]) for word, k in held.items()}
    with small_batches(spark):
        around = other_neighbours(rows, text_col, classes)
    moved = cut_lineage(moves(around.where("word is not null and other is null").select("word", "at", "n"), m))
    assigned = moved.where("word is not null").select("word", "cls")
    both = around.where("other is not null").groupBy("word", "other").agg(F.sum("n").alias("n"))
    for name in ("word", "other"):
        one = assigned.withColumnsRenamed({"word": name, "cls": f"{name}_cls"})
        both = both.join(one, name, "left").withColumn(
            f"{name}_cls", F.coalesce(f"{name}_cls", F.lit(CLASSES) + F.col(name).bitwiseAND(F.lit(7))))
    m = (_dense(around.where("word is null").select(F.col("at").cast("long").alias("cell"), "n"), KINDS)
         + _dense(moved.where("word is null").select("cell", "n"), KINDS)
         + _dense(both.select((F.col("word_cls") * KINDS + F.col("other_cls")).alias("cell"), "n"), KINDS))
    known = F.broadcast(spark.createDataFrame([(w.decode(), c) for w, c in classes.items()], "word string, held int"))  # at most HELD words
    counts = cut_lineage(
        counts.withColumn("id", word_id("word", F.greatest("open", F.lit(0)))).join(assigned.withColumnRenamed("word", "id"), "id", "left")
        .join(known, "word", "left")
        .select("word", "open", "n", F.when(F.col("word") == END, KINDS - 1).otherwise(
            F.coalesce("held", "cls", F.lit(CLASSES) + F.col("open"))).cast("int").alias("cls")))
    size, seen, ones, twos = np.zeros(KINDS), np.zeros(OPEN), 0, 0
    for r in counts.groupBy("cls").agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.count_if(F.col("n") == 1).alias("n1"),
                                       F.count_if(F.col("n") == 2).alias("n2")).collect():
        size[r["cls"]] = r["n"]
        if r["cls"] < KINDS - 1:
            ones, twos = ones + r["n1"], twos + r["n2"]
        if CLASSES <= r["cls"] < KINDS - 1:
            seen[r["cls"] - CLASSES] = r["v"]
    ones -= sum(n == 1 for _, n in head[:CLUSTERED])
    twos -= sum(n == 2 for _, n in head[:CLUSTERED])
    prior = (size + 1) / (size.sum() + KINDS)
    transition = np.log10((m + KINDS * prior) / (m.sum(axis=1, keepdims=True) + KINDS))
    discount = ones / (ones + 2 * twos) if ones else 0.5
    units = {word: k if k < CLUSTERED else UNITS + int(to[k]) for word, k in held.items()}
    start[:min(CLUSTERED, len(held))] = to[:min(CLUSTERED, len(held))]
    return Model(total, distinct, dict(head[:HEAD]), units, np.concatenate([start, np.arange(CLASSES)]), transition, size, seen,
                 min(max(discount, 0.05), 0.95)), counts


def _likelihood(m: np.ndarray) -> float:
    """Of the class bigrams, but for what does not depend on the classes."""
    size = m.sum(axis=1)
    return float((m * np.log(np.maximum(m, 1))).sum() - 2 * (size * np.log(np.maximum(size, 1))).sum())


@dataclass(frozen=True)
class Head:
    """Words with a count in the model: their places, the end first, and values by place; the last ones are of all other words."""

    places: dict[bytes, int]
    base: np.ndarray
    emission: np.ndarray
    kind: np.ndarray  # class, -1 of other words

    @classmethod
    def of(cls, model: Model) -> Head:
        end = int(model.size[model.classes[END_UNIT]])
        rows = [(model.base(end), model.emission(end, END_UNIT) if end else model.base(0), model.classes[END_UNIT])]
        for word, n in model.counts.items():
            unit = model.units.get(word, CLUSTERED + shape(word))
            rows.append((model.base(n), model.emission(n, unit), model.classes[unit]))
        base, emission, kind = (np.array(x) for x in zip(*rows, (0.0, 0.0, -1)))
        return cls({END.encode(): 0, **{word: k for k, word in enumerate(model.counts, 1)}}, base, emission, kind.astype(np.int64))


class _Known(dict):
    """Number of each word that a task has met: its place in the head, or from there on others, which are listed."""

    def __init__(self, head: Head):
        super().__init__(head.places)
        self.others: list[bytes] = []
        self.head = len(head.places)

    def __missing__(self, word: bytes) -> int:
        value = self[word] = self.head + len(self.others)
        self.others.append(word)
        return value


def score(docs: DataFrame, model: Model, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id_col``, n_tokens, n_known, train_tokens, base_score and score (log10 probability of the text).

    The words that each worker holds, and transitions between them, are scored
    in place, a block of texts at a time; other words are joined with their
    counts and classes, one row per place in a text.
    """
    spark = docs.sparkSession
    shared, of_head = spark.sparkContext.broadcast(model), spark.sparkContext.broadcast(Head.of(model))  # at most HEAD words

    def run(batches) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        m, values, row = shared.value, of_head.value, TaskContext.get().partitionId() << 33
        own, end_known = _Known(values), int(m.size[m.classes[END_UNIT]] > 0)
        for batch in batches:
            at = 0
            for block in blocks((text.as_py() or "" for text in batch.column(1)), BLOCK_CHARS):
                if len(own.others) > CACHE:
                    own = _Known(values)
                parts = [tokens(text) for text in block]
                size = np.fromiter(map(len, parts), np.int64, len(parts))
                ids = np.fromiter(map(own.__getitem__, chain.from_iterable(parts)), np.int64, int(size.sum()))
                # Each text is its words and the end; what comes before its first word is an end, too.
                line = np.insert(ids, np.cumsum(size), 0)
                first = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
                head = line < own.head
                at_head = np.where(head, line, own.head)
                kind = values.kind[at_head]
                before = np.concatenate([values.kind[:1], kind[:-1]])
                step = np.where((before >= 0) & (kind >= 0), m.transition[before, kind], 0.0)
                place = np.flatnonzero(~head)
                words = [own.others[k] for k in (line[place] - own.head).tolist()]
                text = np.repeat(np.arange(len(block)), size + 1)[place]
                others = pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(text, np.arange(len(block) + 1)).astype(np.int32)),
                    pa.StructArray.from_arrays(
                        [pa.array(words, pa.string()), pa.array((place - first[text]).astype(np.int32)),
                         *(pa.array(x.astype(np.int8)) for x in (before[place], kind[np.minimum(place + 1, len(kind) - 1)])),
                         pa.array([SHAPES[w[-1]] for w in words], pa.int8())],
                        names=["word", "pos", "before", "after", "open"]))
                known = np.add.reduceat(head.astype(np.int64), first) - (1 - end_known)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(block)), pa.array(np.arange(row, row + len(block))), pa.array(size + 1), pa.array(known),
                     pa.array(np.add.reduceat(values.base[at_head], first)), pa.array(np.add.reduceat(values.emission[at_head] + step, first)), others],
                    names=["id", "row", "n_tokens", "n_known", "base", "whole", "other"])
                at, row = at + len(block), row + len(block)
            release(pa)

    kind = docs.schema[id_col].dataType.simpleString()
    with small_batches(spark):
        local = cut_compressed(docs.select(id_col, text_col).mapInArrow(
            run, f"id {kind}, row bigint, n_tokens bigint, n_known bigint, base double, whole double, "
                 "other array<struct<word: string, pos: int, before: tinyint, after: tinyint, open: tinyint>>"))
    words = local.select("row", F.explode("other").alias("x")).select("row", "x.*")
    # A word is one row of its counts, so a task's part of them is small and need not be sorted.
    placed = (words.join(counts.select("word", "n", "cls").hint("shuffle_hash"), "word", "left")
              .select("row", "pos", "before", "after", F.coalesce("n", F.lit(0)).cast("long").alias("n"),
                      F.coalesce("cls", F.lit(CLASSES) + F.col("open")).cast("int").alias("cls")))

    def rest(batches) -> Iterator:
        import pyarrow as pa

        m, last = shared.value, np.zeros(1, np.int32)
        for batch in batches:
            if not batch.num_rows:
                continue
            row, _, before, after, n, cls = (c.to_numpy() for c in batch.columns)
            # A neighbour before that has no class of its own is the row before this one.
            before = np.where(before >= 0, before, np.concatenate([last, cls[:-1]]))
            last = cls[-1:]
            opened, size = cls >= CLASSES, m.size[cls]
            mass = np.where(opened, np.where(n > 0, n - m.discount, m.discount * m.seen[np.clip(cls - CLASSES, 0, OPEN - 1)]), n)
            none = (n == 0) & (size == 0)
            emission = np.where(none, -math.log10(m.distinct + 1), np.log10(np.where(none, 1, mass) / np.where(none, 1, size)))
            step = m.transition[before, cls] + np.where(after >= 0, m.transition[cls, after], 0.0)
            starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            sums = [np.add.reduceat(x, starts) for x in (np.log10((n + 1) / (m.total + m.distinct + 1)), emission + step, (n > 0).astype(np.int64))]
            yield pa.RecordBatch.from_arrays([pa.array(row[starts]), *map(pa.array, sums)], names=["row", "base_more", "whole_more", "known_more"])

    added = (placed.repartition("row").sortWithinPartitions("row", "pos")
             .mapInArrow(rest, "row bigint, base_more double, whole_more double, known_more bigint")
             .groupBy("row").agg(*[F.sum(c).alias(c) for c in ("base_more", "whole_more", "known_more")]))
    zero = F.lit(0.0)
    return local.drop("other").join(added, "row", "left").select(
        F.col("id").alias(id_col), "n_tokens", (F.col("n_known") + F.coalesce("known_more", F.lit(0))).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("base_more", zero)).alias("base_score"),
        (F.col("whole") + F.coalesce("whole_more", zero)).alias("score"))


def held_out(id_col: str = "doc_id"):
    """Rows that are never learnt from: a seventh by the checksum of the id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Learn from the rows that are not held out and score all of them.

    A null or empty text has only its end.  Repeated rows are scored each for
    itself.  Without any training text the model has no words and every token
    is unknown.  An empty table gives an empty result; other columns are not
    read.
    """
    model, counts = fit(docs.where(~held_out(id_col)), text_col)
    return score(docs, model, counts, id_col, text_col).withColumn(
        "held_out", held_out(id_col)).select(
        id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
