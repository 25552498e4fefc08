"""Language identification by sparse multinomial logistic regression.

Features are character n-grams of the words, with a blank at both ends, hashed
to a fixed number of columns and weighted by TF-IDF.  The regression is
trained by follow-the-regularised-leader with an elastic net, which leaves
most weights exactly zero; a temperature is then fitted on rows kept aside.
Document frequencies cover all learning rows; the regression sees a bounded
sample of their distinct texts.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.llm.common import cut_lineage, release, scratch, ship, small_batches
from locusframe.llm.shingles import odd_numbers
from locusframe.session import broadcast_if_small

#: Hashed columns, longest n-gram, rows of the fitted sample (all languages together), passes.
BITS, LONGEST, SAMPLE, PASSES = 16, 4, 3_000, 3
COLUMNS, MIXER = 1 << BITS, np.uint64(0x9E3779B97F4A7C15)
#: Words that are turned into n-grams at once.
PART = 50_000
#: Learning rate, its offset, and the two parts of the elastic net.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.05, 0.01
UNKNOWN = "und"


def grams(text: str) -> Iterator[np.ndarray]:
    """Columns of the n-grams of a text's words, one entry per occurrence, a bounded part at a time."""
    words, factors = text.lower().split(), odd_numbers(LONGEST, 81)
    for at in range(0, len(words), PART):
        codes = np.frombuffer(f" {' '.join(words[at:at + PART])} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
        blank = codes == 32
        hashed, inner = np.zeros(len(codes), np.uint64), np.zeros(len(codes), bool)
        for n in range(1, LONGEST + 1):
            m = len(codes) - n + 1
            if m < 1:
                break
            # A window may hold a blank at its ends only: inner marks a blank after the first character.
            hashed = hashed[:m] + codes[n - 1:] * factors[n - 1]
            last = blank[n - 1:]
            good = ~inner[:m] & ~(last & (n == 1))
            yield ((hashed[good] * factors[0] + np.uint64(n)) * MIXER >> np.uint64(64 - BITS)).astype(np.int64)
            inner = inner[:m] | last if n > 1 else np.zeros(m, bool)


def columns_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct columns of a text and how often each occurs."""
    counts = np.zeros(COLUMNS, np.int64)
    for columns in grams(text):
        counts += np.bincount(columns, minlength=COLUMNS)
    found = np.flatnonzero(counts)
    return found, counts[found].astype(float)


@dataclass(frozen=True)
class Model:
    """Languages, IDF of the columns, weights (column by language), their biases, and the temperature."""

    languages: tuple[str, ...]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float


def frequencies(rows: DataFrame, text_col: str) -> DataFrame:
    """Number of texts per column, over all rows: partial sums of each task, then one row per column."""
    def run(batches) -> Iterator:
        import pyarrow as pa

        held = np.zeros(COLUMNS, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen = np.zeros(COLUMNS, bool)
                for columns in grams(text):
                    seen[columns] = True
                held += seen
            release(pa)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some])], names=["column", "n"])

    return rows.select(text_col).mapInArrow(run, "column bigint, n bigint").groupBy("column").agg(F.sum("n").alias("n"))


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], languages: tuple[str, ...], idf: np.ndarray) -> Model:
    """FTRL-proximal over the rows (columns, counts, language); every tenth row only fits the temperature."""
    k = len(languages)
    z, n = np.zeros((COLUMNS + 1, k)), np.zeros((COLUMNS + 1, k))

    def weights(at):
        own = z[at]
        step = (BETA + np.sqrt(n[at])) / ALPHA + L2
        return np.where(np.abs(own) <= L1, 0.0, (np.sign(own) * L1 - own) / step)

    def vector(columns, counts):
        x = counts / counts.sum() * idf[columns]
        return np.append(columns, COLUMNS), np.append(x, 1.0)

    def softmax(logits):
        e = np.exp(logits - logits.max())
        return e / e.sum()

    learned = [row for i, row in enumerate(rows) if i % 10]
    for _ in range(PASSES):
        for columns, counts, label in learned:
            at, x = vector(columns, counts)
            w = weights(at)
            error = softmax(x @ w)
            error[label] -= 1
            g = x[:, None] * error
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(COLUMNS + 1))
    aside = [(x @ w[at], row[2]) for row in rows[::10] for at, x in [vector(row[0], row[1])]]
    grid = np.exp(np.linspace(math.log(0.1), math.log(10), 41))
    loss = [sum(-math.log(max(softmax(logits / t)[label], 1e-12)) for logits, label in aside) for t in grid]
    best = float(grid[int(np.argmin(loss))]) if aside else 1.0
    return Model(languages, idf, w[:-1], w[-1], best)


def fit(rows: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Learn from rows with a language and a text; None if there are none.

    The sample takes distinct texts, the same number per language or all that
    it has, by the smallest hashes: at most ``SAMPLE`` however often texts
    repeat (one per language if there are more languages than that).  Only
    its columns and counts, and a row per language, come to the driver.
    """
    with small_batches(rows.sparkSession):
        return _fit(rows, text_col, lang_col)


def _fit(rows: DataFrame, text_col: str, lang_col: str) -> Model | None:
    spark = rows.sparkSession
    ship(spark)
    rows = rows.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    pick = F.xxhash64("text", "lang")
    with scratch(spark):
        # One row per text and language: copies combine before they leave their task.
        keys = cut_lineage(rows.select("lang", pick.alias("pick")).groupBy("lang", "pick").agg(F.count("*").alias("n")))
        per = keys.groupBy("lang").agg(F.count("*").alias("texts"), F.sum("n").alias("n")).collect()  # one row per language
        if not per:
            return None
        most = max(1, SAMPLE // len(per))
        # Half more hashes than wanted and some come to the driver; they hold each language's ``most`` smallest.
        shares = spark.createDataFrame(
            [(r["lang"], min(1.0, (1.5 * most + 50) / r["texts"])) for r in per], "lang string, share double")
        near = (keys.join(F.broadcast(shares), "lang")  # one row per language
                .where(F.col("pick") / float(1 << 64) + 0.5 <= F.col("share")).select("lang", "pick").collect())
    hashes = defaultdict(list)
    for r in near:
        hashes[r["lang"]].append(r["pick"])
    last = spark.createDataFrame([(lang, sorted(found)[:most][-1]) for lang, found in hashes.items()], "lang string, last long")
    total = sum(r["n"] for r in per)
    languages = tuple(sorted(r["lang"] for r in per))
    idf = np.full(COLUMNS, math.log(1 + total))
    for column, n in frequencies(rows, "text").collect():  # at most COLUMNS rows
        idf[column] = math.log((1 + total) / (1 + n)) + 0.05

    def run(batches) -> Iterator:
        import pyarrow as pa

        seen = set()  # texts of the sample, so bounded
        for batch in batches:
            keys = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()))
            first = [i for i, key in enumerate(keys) if not (key in seen or seen.add(key))]
            batch = batch.take(pa.array(first, pa.int64()))
            made = [columns_of(text) for text in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(2), pa.array([c for c, _ in made], pa.list_(pa.int32())),
                 pa.array([n for _, n in made], pa.list_(pa.float32()))], names=["lang", "order", "columns", "counts"])

    # Each task hands on one copy of a text; the last copies go after one exchange.
    sample = (rows.join(F.broadcast(last), "lang").where(pick <= F.col("last")).withColumn("order", F.xxhash64("text")).select("text", "lang", "order").mapInArrow(
        run, "lang string, order bigint, columns array<int>, counts array<float>")
        .dropDuplicates(["lang", "order"]).toArrow().combine_chunks())
    place = {name: i for i, name in enumerate(languages)}
    columns, counts = (sample[c].combine_chunks() for c in ("columns", "counts"))
    ends, names = columns.offsets.to_numpy(), sample["lang"].to_pylist()
    columns, counts = columns.values.to_numpy(), counts.values.to_numpy()
    data = [(columns[ends[k]:ends[k + 1]], counts[ends[k]:ends[k + 1]], place[names[k]])
            for k in np.argsort(sample["order"].to_numpy(), kind="stable") if ends[k + 1] > ends[k]]
    return train(data, languages, idf)


def _has_letter(text: str) -> bool:
    return text.isalpha() or any(map(str.isalpha, text))


def _labelled(model: Model | None, tables: list[np.ndarray], text: str | None) -> tuple[str, float]:
    if model is None or text is None or not _has_letter(text):
        return UNKNOWN, 0.0
    total, n = np.zeros(len(tables)), 0
    for columns in grams(text):
        total += [row[columns].sum() for row in tables]
        n += len(columns)
    logits = (total / n + model.bias) / model.temperature
    e = np.exp(logits - logits.max())
    best = int(np.argmax(logits))
    return model.languages[best], float(e[best] / e.sum())


def _tables(model: Model | None) -> list[np.ndarray]:
    return [] if model is None else list((model.idf[:, None] * model.weights).T.copy())


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``lang_pred`` and ``score`` of every whole text.

    A null text, or one without a letter, is ``und`` with score 0, as is every
    text if there was nothing to learn from.  Only the text is used; repeated
    rows get equal predictions; an empty table gives an empty result.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of columns and languages

    def run(batches) -> Iterator:
        import pyarrow as pa

        tables = _tables(shared.value)
        for batch in batches:
            made = [_labelled(shared.value, tables, text) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([name for name, _ in made], pa.string()), pa.array([x for _, x in made], pa.float64())],
                names=[id_col, "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")


def drop_unidentified(docs: DataFrame, model: Model | None, least: float = 0.3, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text is ``und`` or scores below ``least``; all columns kept.

    Only texts go to Python; what comes back are 128-bit hashes of the texts
    that go, and an anti-join removes their rows.  It is a broadcast join if a
    count proves the hashes few.  Without a model only texts without a letter
    go.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    hashes = {"__text_high": F.xxhash64(text_col), "__text_low": F.xxhash64(F.lit(1), F.col(text_col))}

    def run(batches) -> Iterator:
        import pyarrow as pa

        tables = _tables(shared.value)
        for batch in batches:
            gone = []
            for text in batch.column(0):
                text = text.as_py()
                if shared.value is None:
                    gone.append(not _has_letter(text))
                else:
                    name, x = _labelled(shared.value, tables, text)
                    gone.append(name == UNKNOWN or x < least)
            yield batch.select([1, 2]).filter(pa.array(gone, pa.bool_()))
            release(pa)

    known = docs.where(F.col(text_col).isNotNull())
    with small_batches(spark):
        gone = cut_lineage(known.select(text_col, *[c.alias(name) for name, c in hashes.items()]).mapInArrow(
            run, "__text_high bigint, __text_low bigint").distinct())
    return known.withColumns(hashes).join(broadcast_if_small(gone), list(hashes), "left_anti").select(*docs.columns)


def held_out(id_col: str = "doc_id"):
    """Rows that are never learnt from: a quarter by the checksum of the id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Fit on the rows that are not held out and predict all: ``id_col``, ``held_out``, ``lang_pred``, ``score``."""
    model = fit(docs.where(~held_out(id_col)), text_col, lang_col)
    return predict(docs, model, id_col, text_col).withColumn("held_out", held_out(id_col)).select(
        id_col, "held_out", "lang_pred", "score")
