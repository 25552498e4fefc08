"""Token files, spelling variants and ranked search against brute force on small tables with every awkward kind of row."""

import math
import random
import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest

from locusframe.llm import ranked_search, spelling, token_files, word_coder
from locusframe.llm.common import scratch_folder

SCHEMA = "doc_id long, text string, doc int, row string, ids string, start long, n double"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(["uno", "two", "Élan", "ñandú", "x-1", "a1b2", "don't"]) + rng.choice(["", ",", ".", "...", "\n"]) for _ in range(n))


TEXTS = [(7, None), (3, ""), (5, prose(40, 1)), (2, " \n\t "), (9, "z" * 5000), (9, "z" * 5000), (9, "other"), (None, "no id"), (11, prose(3000, 2)),
         (-4, "日本語 😀 Don't ÉCOLE <|startoftext|> <|EndOfText|>..., . ,"), (6, prose(40, 1))]


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, "r", "x", 5, 0.5) for i, t in rows], SCHEMA).repartition(3, "text")


@lru_cache
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(TOKENIZER)


def library_ids(text):
    return np.array(library().encode(text or "", add_special_tokens=False).ids + [1], "<u4")


@pytest.mark.parametrize("bits", [1, 7, 8, 13, 16, 17, 32])
def test_blocks_of_any_width(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 777, dtype=np.uint32)
    data = token_files.pack_block(ids, bits)
    assert len(data) == -(-777 * bits // 8)
    assert (token_files.unpack_block(data, 777, bits) == ids).all()
    file = token_files.TokenFile(token_files.file_image([4, None, 6], [700, 0, 77], ids, bits, 9, block=100) + b"\n")
    assert file.docs == [4, None, 6] and file.ordinal == 9 and (file.document(2) == ids[700:]).all()
    for a, b in [(0, 777), (99, 101), (100, 200), (650, 777), (5, 5)]:
        assert (file.ids(a, b) == ids[a:b]).all()
    if bits < 32:
        with pytest.raises(ValueError):
            token_files.pack_block(np.array([1 << bits]), bits)


def test_bits_of_a_vocabulary():
    assert [token_files.bits_for(n) for n in (1, 2, 3, 49408, 65536, 65537)] == [1, 1, 2, 16, 16, 17]


def test_files_hold_all_documents_in_order(spark):
    target = scratch_folder(spark)
    token_files.write_token_files(table(spark, TEXTS), TOKENIZER, target, block_ids=64, file_ids=1000)
    got = sorted(token_files.read_documents(spark, target).collect(), key=lambda r: r["start"])
    order = sorted(TEXTS, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r["doc_id"] for r in got] == [i for i, _ in order]
    wanted = {}
    for i, t in TEXTS:
        wanted.setdefault(i, []).append(library_ids(t).tobytes())
    at, stream = 0, b""
    for r in got:
        assert (r["start"], r["n_tokens"]) == (at, len(r["ids"]) // 4)
        wanted[r["doc_id"]].remove(bytes(r["ids"]))
        at, stream = at + r["n_tokens"], stream + bytes(r["ids"])
    assert not any(wanted.values())
    index = token_files.read_index(spark, target)
    assert index.count() > 3 and index.agg({"ids": "sum"}).first()[0] == at
    for a, b in [(0, at), (990, 2100), (at - 1, at + 5), (7, 7)]:
        parts = sorted(token_files.read_range(spark, target, a, b).collect(), key=lambda r: r["position"])
        assert b"".join(bytes(r["ids"]) for r in parts) == stream[4 * a:4 * b]


def test_no_documents_no_files(spark):
    target = scratch_folder(spark)
    token_files.write_token_files(table(spark, []), TOKENIZER, target)
    assert token_files.read_documents(spark, target).count() == 0
    with pytest.raises(TypeError):
        token_files.write_token_files(spark.createDataFrame([("a", "b")], "doc_id string, text string"), TOKENIZER, target)


def test_words_are_encoded_as_whole_texts():
    rng = random.Random(1)
    some = ["".join(rng.choice(" \n\tabÉéñÑß'1,.µªºΣİ日\x85÷ÿ<|>́\xa0") for _ in range(rng.randrange(60))) for _ in range(1500)]
    some += [t or "" for _, t in TEXTS]
    assert [x + b"\x01\0\0\0" for x in word_coder.WordCoder(TOKENIZER).ids(some)] == [library_ids(x).tobytes() for x in some]


def test_other_tokenizers_get_whole_texts():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    some = ["Two  words\n and more", "", "É  x"]
    want = [np.array(x.ids, "<u4").tobytes() for x in Tokenizer.from_file(path).encode_batch(some, add_special_tokens=False)]
    assert word_coder.WordCoder(path).ids(some) == want


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted([a, b], key=len)
    return any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def plain_variants(rows, slips=97, shortest=5, fewest=3):
    counts = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-z\u00C0-\u00FF]+", t or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if slips and h % slips == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= shortest:
                counts[run] += 1
    counts = {w: n for w, n in counts.items() if n >= fewest}
    near = {w: [x for x in counts if one_edit(w, x)] for w in counts}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted(((w, form[w], root(w), n, len(near[w]), form[w] and counts[form[w]]) for w, n in counts.items()), key=str)


def spelled(spark, rows, **options):
    found = spelling.spelling_variants(table(spark, rows), **options)
    return sorted((tuple(r) for r in found.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)


def test_spelling_variants(spark, monkeypatch):
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdñé") for _ in range(rng.randint(4, 9))) for _ in range(40)] + ["aaaaaa", "aaaaa", "aaaaaaa", "abababab", "É" * 5]
    words = list(base)
    for w in base:
        for _ in range(4):
            k = rng.randrange(len(w))
            words.append(rng.choice([w[:k] + w[k + 1:], w[:k] + rng.choice("abcxÉ") + w[k:], w[:k] + "Z" + w[k + 1:]]))
    rows = [(i, " ".join(rng.choice(words[:80] + words) for _ in range(60)) + "×Straße ÷ ﬁne Kelvin naïve") for i in range(60)]
    rows += [(None, None), (3, ""), (None, "aaaaa " * 9), (3, rows[3][1]), (8, "q" * 900 + " " + "q" * 899 + " " + "q" * 901)] * 3
    want = plain_variants(rows)
    assert spelled(spark, rows) == want and len(want) > 100 and sum(w[1] is not None for w in want) > 20
    monkeypatch.setattr(spelling, "MOST", 2)  # every block is dealt again down to single positions
    assert spelled(spark, rows) == want
    monkeypatch.setattr(spelling, "AT_ONCE", 3000)
    assert spelled(spark, rows, slips=None, shortest=3, fewest=1) == plain_variants(rows, None, 3, 1)


def test_chains_of_forms_end_in_one_root(spark):
    rows = [(1, " ".join(w for k, w in enumerate(["abcde", "abcdx", "abcyx", "abzyx", "aqzyx"]) for _ in range(3 * 2 ** (2 * k))))]
    assert [(r[0], r[1], r[2]) for r in spelled(spark, rows, slips=None)][0] == ("abcde", "abcdx", "aqzyx")
    assert spelled(spark, []) == [] and spelled(spark, [(1, "a b c")]) == []


def test_a_hundred_words_that_differ_at_one_place(spark):
    letters = [chr(c) for c in range(0xE0, 0x100)] + list("abcdefghijklmnopqrstuvwxyz")
    rows = [(k, f"stem{x}stem stem{x}stem stem{x}stem") for k, x in enumerate(letters)]
    got = spelled(spark, rows, slips=None)
    assert {r[4] for r in got} == {len(letters) - 1}


def plain_search(docs, items, most=10):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

    def terms(text):
        return pattern.findall("".join(c.lower() if c.isascii() else c for c in text or ""))

    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    total, df = sum(n for *_, n in held), Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        found = []
        for doc, c, n in held:
            m = 25 + 75 * n * len(held) // total
            score = sum(math.floor(1000 * math.log((2 * len(held) + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                        for t in terms(text) if c[t])
            if score > 0:
                found.append((-score, doc is None, doc or 0))
        out += [(item, k + 1, None if none else doc, -score) for k, (score, none, doc) in enumerate(sorted(found)[:most])]
    return sorted(out, key=str)


ITEM_SCHEMA = "item_id long, text string, doc_id string, score int, rank string"


def searched(spark, docs, items, **options):
    queries = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in items], ITEM_SCHEMA)
    return sorted((tuple(r) for r in ranked_search.search(table(spark, docs), queries, **options).select(
        "item_id", "rank", "doc_id", "score").collect()), key=str)


def test_ranked_search(spark, monkeypatch):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(60)] + ["Élan", "élan", "日本", "A1", "\u00d7", "x\x00y"]
    weights = [1 / (k + 1) for k in range(len(words))]

    def text(n):
        return " ".join(rng.choices(words, weights, k=n)) + rng.choice(["", ".", "-a1"])

    docs = [(k * 3 % 601, text(rng.choice([1, 3, 8, 40]))) for k in range(600)]
    copy = text(30)
    docs += [(1000 + k, copy) for k in range(150)] + [(2000, copy + " w3 " * 5)] + [(5, docs[0][1])] * 12
    docs += [(None, copy), (None, docs[3][1]), (7000, None), (7001, "... \n"), (7002, "w1 " * 9000), (7003, "w59")]
    items = [(k, text(rng.choice([1, 2, 12]))) for k in range(30)] + [(40, copy), (41, None), (42, "--"), (43, "unknown words"), (None, "w59 w58"), (44, "w0")]
    want = plain_search(docs, items)
    assert len(want) > 250
    assert searched(spark, docs, items) == want
    for name, value in [("TREE_DOCS", 40), ("ITEMS", 7), ("PARTS", 2)]:
        monkeypatch.setattr(ranked_search, name, value)
    assert searched(spark, docs, items, most=3) == plain_search(docs, items, 3)


def test_search_in_empty_tables(spark):
    assert searched(spark, [], [(1, "a")]) == [] and searched(spark, [(1, "a")], []) == [] and searched(spark, [(1, None)], [(1, "a")]) == []


def test_trees_bound_every_score():
    rng = np.random.default_rng(2)
    vectors = []
    for _ in range(700):
        terms = np.unique(np.minimum(rng.geometric(0.2, rng.integers(1, 9)), 30)).astype(np.int32)
        vectors.append((terms, rng.integers(1, 5, len(terms)).astype(np.int32)))
    vectors += [vectors[0]] * 200
    norms = rng.integers(25, 400, len(vectors))
    tree = ranked_search.grow(np.arange(len(vectors)), norms, vectors, leaf=8)
    item = [(2, 50), (5, 300), (11, 700), (29, 900)]

    def score(k):
        terms, counts = vectors[k]
        return sum(w * int(ranked_search.gain(counts[terms == t].astype(np.int64), norms[k:k + 1])[0]) for t, w in item if t in terms)

    covered = Counter()
    for node in range(len(tree.first)):
        members = tree.docs[tree.first[node]:tree.last[node]]
        bound = sum(w * int(ranked_search.gain(c, tree.least_norm[n])[0]) for t, w in item if t in tree.tops
                    for n, c in [(tree.tops[t][0][tree.tops[t][0] == node], tree.tops[t][1][tree.tops[t][0] == node])] if len(n))
        assert all(score(d) <= bound for d in members)
        if not len(tree.children[node]):
            assert len(members) <= 8
            covered.update(members.tolist())
    assert set(covered.values()) == {1} and len(covered) == len(vectors)
    best = sorted((-score(k), k) for k in range(len(vectors)) if score(k))[:10]
    assert ranked_search.walk(tree, item, [], 10, 40) == best
