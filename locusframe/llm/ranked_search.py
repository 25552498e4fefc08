"""Ranked lexical search by branch and bound over prefix trees of documents.

Documents are restricted to the terms of the items, as term numbers in
ascending document frequency with counts.  Each task lays its documents into
trees: vectors that begin alike share a path, so documents with the same rare
terms share a subtree.  Every node knows, per term, the largest count below it
and the smallest length norm; that bounds the score of all documents below.
An item walks each tree depth-first, best bound first, and leaves out what
cannot reach its tenth result so far, which all trees of a task share.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locusframe.llm.common import cut_lineage, scratch, ship

#: Items, and characters of their texts, that are answered in one pass over the documents.
ITEMS, ITEM_CHARS = 4_096, 8_000_000
#: Documents and vector entries of a tree; documents below which a node is not divided.
TREE_DOCS, TREE_ENTRIES, LEAF = 16_384, 2_000_000, 32
#: Parts in which the results of one item are ranked first.
PARTS = 64
#: Bytes of UTF-8 that are no part of a term become blanks, A-Z become a-z.
TERM_BYTES = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))
BIG = 1_000_000_000


def terms_of(text: str) -> list[bytes]:
    """Terms of a text in order: runs of ASCII letters and digits and of all other characters, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().translate(TERM_BYTES).split()


def restricted(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents with a term of the vocabulary or, with ``doc`` null and ``n`` below 0, totals of a task's documents.

    ``doc, n, terms, counts``: length in terms, numbers of the terms of the
    vocabulary and how often each occurs.  The row of totals holds minus the
    documents with a term in ``n`` and the number of all terms in ``total``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # the terms of one block of items

    def run(batches) -> Iterator:
        import pyarrow as pa

        known, held, length = shared.value, 0, 0
        names = ["doc", "n", "total", "terms", "counts"]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = terms_of(text) if text else ()
                if not found:
                    continue
                held, length = held + 1, length + len(found)
                own = Counter(filter(None.__ne__, map(known.get, found)))
                if own:
                    rows.append((doc, len(found), 0, list(own), list(own.values())))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 5, kinds)], names=names)
        if held:
            yield pa.RecordBatch.from_arrays(
                [pa.array([x], k) for x, k in zip((None, -held, length, None, None), kinds)], names=names)

    ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc bigint, n bigint, total bigint, terms array<int>, counts array<int>")


def weight(n_docs: int, frequency: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * frequency + 1)))


def gain(counts: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """What a unit of weight earns: grows with the count and falls with the norm, so node bounds are bounds."""
    return BIG * counts // (1000 * counts + 8 * norms)


@dataclass
class Tree:
    """Documents in path order, their entries, and nodes with bounds.

    Entries of document d are ``terms/counts[ends[d]:ends[d + 1]]``.  Node k
    covers documents ``first[k]`` to ``last[k]``; inner nodes have
    ``children``.  ``tops[t]`` lists the nodes that have term t below and the
    largest count there.
    """

    docs: np.ndarray
    norms: np.ndarray
    ends: np.ndarray
    terms: np.ndarray
    counts: np.ndarray
    first: np.ndarray
    last: np.ndarray
    children: list[np.ndarray]
    least_norm: np.ndarray
    least_doc: np.ndarray
    tops: dict[int, tuple[np.ndarray, np.ndarray]]


def grow(docs: np.ndarray, norms: np.ndarray, vectors: list[tuple[np.ndarray, np.ndarray]], leaf: int = LEAF) -> Tree:
    """The tree of documents whose vectors (terms, counts) are in path order."""
    paths = [terms.astype(">u4").tobytes() for terms, _ in vectors]
    order = sorted(range(len(docs)), key=lambda k: (paths[k], norms[k], docs[k]))
    paths = [paths[k] for k in order]
    docs, norms = docs[order], norms[order]
    ends = np.cumsum([0, *(len(vectors[k][0]) for k in order)])
    terms = np.concatenate([vectors[k][0] for k in order])
    counts = np.concatenate([vectors[k][1] for k in order]).astype(np.int64)
    first, last, parent, todo = [0], [len(docs)], [-1], [(0, 0)]
    while todo:
        node, depth = todo.pop()
        lo, hi = first[node], last[node]
        if hi - lo <= leaf:
            continue
        # Nodes with one child are skipped: go down to where the first and the last path part.
        a, b = paths[lo], paths[hi - 1]
        while depth < len(a) and a[depth:depth + 4] == b[depth:depth + 4]:
            depth += 4
        cuts = [lo]
        while cuts[-1] < hi:
            cuts.append(_run_end(paths, cuts[-1], hi, depth))
        at = 0
        while at < len(cuts) - 1:
            to = at + 1
            if cuts[to] - cuts[at] <= leaf:  # small neighbours make one leaf
                while to < len(cuts) - 1 and cuts[to + 1] - cuts[at] <= leaf:
                    to += 1
                spans = [(cuts[at], cuts[to])]
            elif len(paths[cuts[at]]) == depth or paths[cuts[at]] == paths[cuts[to] - 1]:  # equal vectors: by norm
                spans = [(k, min(k + leaf, cuts[to])) for k in range(cuts[at], cuts[to], leaf)]
            else:
                spans = [(cuts[at], cuts[to])]
            for span in spans:
                first.append(span[0])
                last.append(span[1])
                parent.append(node)
                if span[1] - span[0] > leaf:
                    todo.append((len(first) - 1, depth + 4))
            at = to
    first, last, parent = np.array(first), np.array(last), np.array(parent)
    family = np.argsort(parent, kind="stable")
    bounds = np.searchsorted(parent[family], np.arange(len(first) + 1))
    children = [family[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
    least_norm, least_doc = (np.array([x[a:b].min() for a, b in zip(first, last)]) for x in (norms, docs))
    return Tree(docs, norms, ends, terms, counts, first, last, children, least_norm, least_doc,
                _tops(first, last, parent, children, ends, terms, counts))


def _run_end(paths: list[bytes], start: int, stop: int, depth: int) -> int:
    """End of the run of paths that have the same term at ``depth`` as the one at ``start``, by bisection."""
    term = paths[start][depth:depth + 4]
    lo, hi = start, stop
    while hi - lo > 1:
        middle = (lo + hi) // 2
        lo, hi = (middle, hi) if paths[middle][depth:depth + 4] == term else (lo, middle)
    return hi


def _tops(first, last, parent, children, ends, terms, counts) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Largest count per term below each node: of the leaves from their entries, of inner nodes from their children."""
    leaves = np.array([k for k in range(len(first)) if not len(children[k])])
    leaves = leaves[np.argsort(first[leaves])]  # they cover the entries in order
    node, term, count = _largest(np.repeat(leaves, ends[last[leaves]] - ends[first[leaves]]), terms, counts)
    found, depth = [(node, term, count)], np.zeros(len(first), int)
    for k in range(1, len(first)):  # parents are numbered before their children
        depth[k] = depth[parent[k]] + 1
    for d in range(int(depth.max()), 0, -1):
        at = np.concatenate([x[0] for x in found])
        some = depth[at] == d
        up = parent[at[some]]
        found.append(_largest(up, np.concatenate([x[1] for x in found])[some], np.concatenate([x[2] for x in found])[some]))
    node, term, count = (np.concatenate([x[k] for x in found]) for k in range(3))
    node, term, count = _largest(node, term, count)  # a node may have leaves and inner nodes as children
    by_term = np.argsort(term, kind="stable")
    node, term, count = node[by_term], term[by_term], count[by_term]
    cuts = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1], [True]])) if len(term) else np.zeros(1, int)
    return {int(term[a]): (node[a:b], count[a:b]) for a, b in zip(cuts[:-1], cuts[1:])}


def _largest(node: np.ndarray, term: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((-count, term, node))
    node, term, count = node[order], term[order], count[order]
    new = np.concatenate([[True], (node[1:] != node[:-1]) | (term[1:] != term[:-1])]) if len(node) else np.zeros(0, bool)
    return node[new], term[new], count[new]


def walk(tree: Tree, item: list[tuple[int, int]], best: list[tuple[int, int]], most: int, vocabulary: int) -> list[tuple[int, int]]:
    """``best``, pairs (-score, doc) in order, improved by the tree's documents; ``item`` is (term, weight with repeats)."""
    bounds = np.zeros(len(tree.first), np.int64)
    for term, w in item:
        if term in tree.tops:
            nodes, counts = tree.tops[term]
            bounds[nodes] += w * gain(counts, tree.least_norm[nodes])
    weights = np.zeros(vocabulary, np.int64)
    for term, w in item:
        weights[term] = w

    def hopeless(node: int) -> bool:
        if not bounds[node]:
            return True
        return len(best) == most and (-int(bounds[node]), int(tree.least_doc[node])) > best[-1]

    todo = [0]
    while todo:
        node = todo.pop()
        if hopeless(node):
            continue
        children = tree.children[node]
        if len(children):
            todo += children[np.argsort(bounds[children], kind="stable")].tolist()  # the best is taken next
            continue
        lo, hi = tree.first[node], tree.last[node]
        a, b = tree.ends[lo], tree.ends[hi]
        w = weights[tree.terms[a:b]]
        hit = np.flatnonzero(w)
        doc = np.searchsorted(tree.ends[lo:hi + 1], a + hit, "right") - 1
        earned = w[hit] * gain(tree.counts[a:b][hit], tree.norms[lo:hi][doc])
        scores = np.zeros(hi - lo, np.int64)
        np.add.at(scores, doc, earned)
        fresh = [(-int(scores[k]), int(tree.docs[lo + k])) for k in np.flatnonzero(scores)]
        if fresh:
            best = sorted(best + fresh)[:most]
    return best


def search(docs: DataFrame, items: DataFrame, most: int = 10, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The ``most`` best documents of each item: ``item_col``, ``rank`` (from 1), ``id_col``, ``score``.

    Only scores above 0 count; equal scores go by ascending id.  A row of
    ``items`` is an item; a null or term-less text finds nothing.  Null texts
    of documents have no terms; a null id comes after all others of the same
    score; rows that share an id are ranked each for itself.  Ids must be whole
    numbers.  Empty tables give an empty result; other columns are not read.
    Items come to the driver in blocks of bounded size, each answered in one
    pass over the documents.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{id_col} must be a whole number, not {kind}")
    item_kind = items.schema[item_col].dataType.simpleString()
    schema = f"`{item_col}` {item_kind}, rank int, `{id_col}` {kind}, score long"
    found = None
    for block in _item_blocks(items.select(item_col, item_text_col)):
        part = _search_block(docs, block, most, id_col, text_col)
        names = spark.createDataFrame([(k, name) for k, (name, _) in enumerate(block)], f"_item int, `{item_col}` {item_kind}")
        part = part.join(F.broadcast(names), "_item").select(
            item_col, "rank", F.col("doc").cast(kind).alias(id_col), "score")
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], schema) if found is None else found


def _item_blocks(items: DataFrame) -> Iterator[list[tuple[object, list[bytes]]]]:
    block, size = [], 0
    for name, text in items.toLocalIterator():
        terms = terms_of(text) if text else []
        if terms:
            block.append((name, terms))
            size += len(text)
        if len(block) >= ITEMS or size >= ITEM_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


def _search_block(docs: DataFrame, block: list, most: int, id_col: str, text_col: str) -> DataFrame:
    """Written results of one block of items: _item, doc, score, rank."""
    spark = docs.sparkSession
    vocabulary = {term: k for k, term in enumerate(sorted({t for _, terms in block for t in terms}))}
    with scratch(spark) as keep:
        vectors = cut_lineage(restricted(docs, vocabulary, id_col, text_col))
        totals = vectors.where("n < 0").agg(F.sum(-F.col("n")), F.sum("total")).first()
        n_docs, length = int(totals[0] or 0), int(totals[1] or 0)
        # At most one row per term of the block.
        held = vectors.where("n > 0").select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()
        frequency = np.zeros(len(vocabulary), np.int64)
        for r in held:
            frequency[r["term"]] = r["df"]
        place = np.empty(len(vocabulary), np.int32)  # the rarest terms come first on a path
        place[np.argsort(frequency, kind="stable")] = np.arange(len(vocabulary))
        queries = []
        for _, terms in block:
            repeats = Counter(int(vocabulary[t]) for t in terms)
            queries.append([(int(place[t]), k * weight(n_docs, int(frequency[t]))) for t, k in repeats.items()
                            if frequency[t] and weight(n_docs, int(frequency[t]))])
        shared = spark.sparkContext.broadcast((place, queries, n_docs, length))

        def run(batches) -> Iterator:
            import pyarrow as pa

            place, queries, n_docs, length = shared.value
            best: list[list[tuple[int, int]]] = [[] for _ in queries]
            for docs, norms, vectors in _tree_parts(batches, place, n_docs, length):
                tree = grow(docs, norms, vectors)
                for k, query in enumerate(queries):
                    best[k] = walk(tree, query, best[k], most, len(place))
            rows = [(k, None if doc == NO_ID else doc, -score) for k, found in enumerate(best) for score, doc in found]
            columns = zip(*rows) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64()))], names=["_item", "doc", "score"])

        found = vectors.where("n > 0").select("doc", "n", "terms", "counts").mapInArrow(run, "_item int, doc bigint, score bigint")
        order = [F.col("score").desc(), F.col("doc").asc_nulls_last()]
        # Each task has ranked its own; the tasks' results of an item are ranked in parts, then together.
        parts = Window.partitionBy("_item", "_part").orderBy(*order)
        few = (found.withColumn("_part", F.pmod(F.xxhash64("doc", "score"), F.lit(PARTS)))
               .withColumn("rank", F.row_number().over(parts)).where(F.col("rank") <= most))
        return keep(few.withColumn("rank", F.row_number().over(Window.partitionBy("_item").orderBy(*order)))
                    .where(F.col("rank") <= most).select("_item", "doc", "score", "rank"))


NO_ID = (1 << 63) - 1


def _tree_parts(batches, place: np.ndarray, n_docs: int, length: int) -> Iterator:
    """Documents of one tree each: ids, norms and vectors in path order."""
    docs, norms, vectors, entries = [], [], [], 0
    for batch in batches:
        sizes = batch.column(1).to_numpy()
        m = 25 + 75 * sizes * n_docs // length if len(sizes) and 75 * int(sizes.max()) * n_docs < 1 << 62 else np.array(
            [25 + 75 * int(n) * n_docs // length for n in sizes], np.int64)
        ids = batch.column(0).fill_null(NO_ID).to_numpy()
        ends = batch.column(2).offsets.to_numpy()
        terms, counts = place[batch.column(2).values.to_numpy()], batch.column(3).values.to_numpy()
        for k in range(batch.num_rows):
            own = slice(ends[k], ends[k + 1])
            order = np.argsort(terms[own])
            vectors.append((terms[own][order], counts[own][order]))
            docs.append(ids[k])
            norms.append(m[k])
            entries += len(order)
            if len(docs) >= TREE_DOCS or entries >= TREE_ENTRIES:
                yield np.array(docs), np.array(norms, np.int64), vectors
                docs, norms, vectors, entries = [], [], [], 0
    if docs:
        yield np.array(docs), np.array(norms, np.int64), vectors
