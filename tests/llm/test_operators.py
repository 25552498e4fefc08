"""The pipeline operators against brute force on small tables with every awkward kind of row."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from locusframe.llm import (byte_bpe, class_lm, exact_dedup, language_id, near_dedup, packing, passage_dedup,
                            preferences, sharding, vector_search)
from locusframe.llm.common import components

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "id long, kept string, row long, key string, size string, `run` int, label double")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
RNG = random.Random(5)
VOCABULARY = ["".join(RNG.choice("abcdeorst") for _ in range(RNG.randint(2, 7))) for _ in range(400)]


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(VOCABULARY) + rng.choice(["", "", ".", ","]) for _ in range(n))


def edited(text, every, seed):
    rng = random.Random(seed)
    words = text.split(" ")
    for k in range(seed % every, len(words), every):
        words[k] = rng.choice(VOCABULARY)
    return " ".join(words)


def texts():
    base = prose(120, 1)
    out = [None, "", " \n\t ", "a", "A  a", "aA", "x y", "X\nY", "don't  stop\x1c  now\x85 é日本語 😀", "...!!", "Un deux", "un deux",
           "z" * 3000, prose(3000, 2), base, base, base.upper(), base.replace(" ", "\n")]
    out += [edited(base, 40, s) for s in range(12)] + [edited(base, 15, s) for s in range(12)]
    out += [prose(60, 100 + s) for s in range(20)]
    passage = prose(55, 9)
    out += [prose(30, 200 + s) + " " + passage + " " + prose(25, 300 + s) + "\n" + prose(40, 400 + s) for s in range(4)]
    return out


TEXTS = dict(enumerate(texts()))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "fr", None][i % 3], "s", 1, 7, "k", 3, "y", "z", 1, 2.0) for i, t in TEXTS.items()]
    return spark.createDataFrame(rows, SCHEMA).repartition(4, "doc_id")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def plain(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def test_exact_duplicates(docs, empty):
    groups = defaultdict(list)
    for i, t in TEXTS.items():
        groups[plain(t)].append((-len(t or ""), i))
    got = {r["doc_id"]: r for r in exact_dedup.exact_duplicates(docs, runs=5, fan_in=2).collect()}
    assert len(got) == len(TEXTS)
    for p, members in groups.items():
        for _, i in members:
            keep = min(members)[1]
            assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (keep, len(members), keep == i)
            assert got[i]["text_sha256"] == hashlib.sha256(p.encode()).hexdigest()
    assert exact_dedup.exact_duplicates(empty).count() == 0


def test_exact_filter_leaves_one_of_repeated_rows(spark, docs, empty):
    again = docs.unionByName(docs.where("doc_id in (1, 3, 13)"))
    assert sum(r["kept"] for r in exact_dedup.exact_duplicates(again).collect()) == len({plain(t) for t in TEXTS.values()})
    out = exact_dedup.drop_exact_duplicates(again)
    assert out.columns == docs.columns
    assert Counter(plain(r["text"]) for r in out.collect()) == Counter({plain(t) for t in TEXTS.values()})
    assert exact_dedup.drop_exact_duplicates(empty).count() == 0
    unnamed = spark.createDataFrame([(None, "a"), (4, "a"), (None, None)], "doc_id long, text string")
    assert sorted((r["doc_id"] or -1, r["kept"]) for r in exact_dedup.exact_duplicates(unnamed).collect()) == [
        (-1, False), (-1, True), (4, True)]


def test_byte_bpe_is_tiktoken(docs, empty):
    import tiktoken

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=byte_bpe.load_ranks(path), special_tokens={})
    encoded = byte_bpe.encode(docs, path, pattern)
    for r in byte_bpe.decode(encoded, path, pattern).collect():
        text = TEXTS[r["doc_id"]] or ""
        assert np.frombuffer(r["ids"], "<u4").tolist() == own.encode_ordinary(text)
        assert bytes(r["decoded"]).decode() == text and r["n_tokens"] == len(r["ids"]) // 4
    assert byte_bpe.encode(empty, path, pattern, round_trip=True).count() == 0


def test_byte_bpe_on_random_text():
    import tiktoken

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=byte_bpe.load_ranks(path), special_tokens={})
    rng = random.Random(3)
    some = ["".join(rng.choice(" \n\t aabé日'1,.") for _ in range(rng.randrange(80))) for _ in range(500)]
    coder = byte_bpe.coder(path, pattern)
    ids = coder.encode(some)
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == [own.encode_ordinary(x) for x in some]
    assert [x.decode() for x in coder.decode(ids)] == some


def test_packing_keeps_every_id_and_fills_windows(docs, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, window = Tokenizer.from_file(path), 256
    pieces, sequences = defaultdict(list), defaultdict(list)
    packed = packing.pack_documents(docs, path, window).collect()
    for r in packed:
        pieces[r["doc_id"]].append((r["start"], bytes(r["ids"]), r["length"], r["doc_tokens"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, t in TEXTS.items():
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        assert b"".join(p[1] for p in sorted(pieces[i])) == ids.tobytes()
        assert {p[3] for p in pieces[i]} == {len(ids)}
    for parts in sequences.values():
        ends = [0]
        for offset, length in sorted(parts):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= window
    tokens = sum(r["length"] for r in packed)
    assert len(sequences) * window < 1.1 * tokens
    assert packing.pack_documents(empty, path).count() == 0


def test_least_squares_finds_the_counts_of_a_mixture():
    shapes = packing.combinations(8, 3)
    assert (shapes.T @ np.arange(1, 9) == 8).all() and shapes.sum(axis=0).max() == 3
    truth = np.zeros(shapes.shape[1])
    truth[[0, 3, 5]] = [10, 200, 31]
    found = packing.nnls(shapes, shapes @ truth)
    assert (found >= 0).all() and np.abs(shapes @ (found - truth)).max() < 1e-3


@pytest.mark.parametrize("histogram", [{1500: 10}, {1: 5000}, {2047: 3, 1: 3}, {700: 9, 648: 5}, {}])
def test_plan_places_every_rest_once(histogram):
    lengths, slots, combined = packing.plan(histogram, 2048)
    for length, c, before, taken, line in lengths:
        assert 0 <= taken <= histogram[length] and c == -(-length // 8)
    used = Counter()
    for c, first, last, times, sequence in slots:
        assert first == used[c] and (last - first) % times == 0 and sequence < max(combined, 1)
        used[c] += last - first
    assert sum(used.values()) == sum(x[3] for x in lengths)


def test_shards_are_even_and_slots_gapless(spark, docs, empty, tmp_path):
    got = sharding.assign_shards(docs, 4).collect()
    by = defaultdict(list)
    for r in got:
        t = (TEXTS[r["doc_id"]] or "").encode()
        assert r["size"] == len(t) + 1 and r["text_crc32"] == zlib.crc32(t)
        by[r["shard"]].append(r)
    total, largest = sum(r["size"] for r in got), max(r["size"] for r in got)
    for k in range(4):
        assert sorted(r["slot"] for r in by[k]) == list(range(len(by[k])))
        assert abs(sum(r["size"] for r in by[k]) - total / 4) <= largest
    assert sharding.assign_shards(empty, 4).count() == 0
    one_text = spark.range(4000).selectExpr("id as doc_id", "'same' as text")  # a group is cut only where it must be
    sizes = Counter(r["shard"] for r in sharding.assign_shards(one_text, 4).collect())
    assert max(sizes.values()) - min(sizes.values()) <= 10
    sharding.write_shards(docs, str(tmp_path / "s"), 4, files=2)
    assert spark.read.parquet(str(tmp_path / "s")).count() == len(TEXTS)


def brute_links(percent):
    sets = {}
    for i, t in TEXTS.items():
        w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    label = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                same = len(sets[a] & sets[b])
                if sets[a] and sets[b] and 100 * same >= percent * (len(sets[a]) + len(sets[b]) - same):
                    label[a] = label[b] = min(label[a], label[b])
    return sets, label


@pytest.mark.parametrize("block", [2000, 7])
def test_near_duplicates_are_the_brute_force_components(docs, empty, block, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    sets, label = brute_links(85)
    got = near_dedup.near_duplicates(docs).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == {
        i: (len(sets[i]), label[i], label[i] == i) for i in TEXTS}
    if block == 7:
        assert near_dedup.near_duplicates(empty).count() == 0
        kept = near_dedup.drop_near_duplicates(docs)
        assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i in TEXTS if label[i] == i}


def test_odd_sketches_estimate_high_similarity():
    rng = np.random.default_rng(2)
    for share in (0.8, 0.9, 0.97):
        common = rng.integers(0, 2**64 - 1, int(400 * share), dtype=np.uint64)
        own = [rng.integers(0, 2**64 - 1, int(400 * (1 - share) / 2), dtype=np.uint64) for _ in range(2)]
        a, b = (np.frombuffer(near_dedup.odd_sketch(np.unique(np.concatenate([common, x]))), np.uint64) for x in own)
        words = near_dedup.PARITY_BITS // 64
        odd = np.bitwise_count(a[:words] ^ b[:words]).sum()
        held = [np.bitwise_count(x[words:]).sum() for x in (a, b)]
        ranges = np.bitwise_count(a[words:] | b[words:]).sum()
        differ = -near_dedup.PARITY_BITS / 2 * np.log(1 - 2 * odd / near_dedup.PARITY_BITS)
        assert abs((sum(held) - differ) / 2 / ranges - share) < 0.12


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(k, k + 1) for k in range(100, 160)] + [(5, k) for k in range(10, 60)] + [(7, 7)]
    RNG.shuffle(links)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 100 for k in range(100, 161)}, **{k: 5 for k in [5, *range(10, 60)]}}


def test_repeated_passages_go_and_clean_texts_stay(docs, empty):
    got = {r["doc_id"]: r for r in passage_dedup.repeated_passages(docs).collect()}
    words = {i: (t or "").encode().lower().split() for i, t in TEXTS.items()}
    covered = {i: {k for s in got[i]["spans"] for k in range(s["start"], s["end"])} for i in TEXTS}
    held = defaultdict(set)
    for i, w in words.items():
        assert got[i]["n_words"] == len(w) and got[i]["removed_words"] == len(covered[i])
        for k in range(len(w) - 50):
            if covered[i].isdisjoint(range(k, k + 51)):
                held[tuple(w[k:k + 51])].add(i)
    assert max(map(len, held.values())) == 1
    last = max(TEXTS)
    assert last - 3 in got[last]["sources"] and 32 <= got[last]["removed_words"] <= 55
    assert all(got[i]["removed_words"] == 0 for i in range(42, 62))  # prose of their own
    assert passage_dedup.repeated_passages(empty).count() == 0


def test_passage_filter_rewrites_only_what_it_must(docs):
    out = {r["doc_id"]: r for r in passage_dedup.drop_repeated_passages(docs).collect()}
    assert all(out[i]["text"] == TEXTS[i] for i in [*range(14), *range(42, 62), max(TEXTS) - 3])
    assert 15 not in out  # an exact copy loses every word
    assert len(out[max(TEXTS)]["text"].split()) < len(TEXTS[max(TEXTS)].split())
    assert passage_dedup.without("a b  c\nd e", [{"start": 1, "end": 3}]) == "a d e"


def test_tables_of_lines_are_gone_before_windows_are_made(docs, monkeypatch):
    """Lines, sketches and sets of the paragraph step don't lie on disk beside the windows; the spans of lines do."""
    from pathlib import Path

    from locusframe.session import shared_folder

    folder, seen = Path(shared_folder(docs.sparkSession)), []
    before = {p.name for p in folder.glob("cut-*")}
    plain = passage_dedup.windows
    monkeypatch.setattr(passage_dedup, "windows", lambda *a: seen.append({p.name for p in folder.glob("cut-*")} - before) or plain(*a))
    assert any(r["spans"] for r in passage_dedup.removals(docs).collect())
    assert [len(x) for x in seen] == [1]


def test_spans_of_many_rows_are_joined_at_once():
    rows = [[(0, 32, 5), (3, 35, 5), (3, 35, 2), (36, 68, 9)], [], [(0, 40, 1), (2, 10, 7), (40, 50, 1)], [(0, 1, 3)]]
    row = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    start, end, source = (np.array([x[k] for r in rows for x in r], np.int64) for k in range(3))
    got = list(zip(*(x.tolist() for x in passage_dedup._joined(row, start, end))))
    assert got == [(k, *s) for k, r in enumerate(rows) for s in passage_dedup._merged([{"start": a, "end": b} for a, b, _ in r])]
    whose, who = passage_dedup._distinct(row, source)
    assert list(zip(whose.tolist(), who.tolist())) == [(k, x) for k, r in enumerate(rows) for x in sorted({y[2] for y in r})]
    none = np.zeros(0, np.int64)
    assert [len(x) for x in passage_dedup._joined(none, none, none)] == [0, 0, 0]


def test_sketches_that_meet_no_other_stay_where_they_are(spark, monkeypatch):
    """Of the written features, only ids that share a band have their sketches joined, with ``spread`` too."""
    seen = []
    plain = near_dedup.semi_join
    monkeypatch.setattr(near_dedup, "semi_join", lambda df, ids, on: seen.append((df.columns, ids.count())) or plain(df, ids, on))
    texts = [(k, prose(40, 500 + k)) for k in range(12)] + [(20, prose(40, 500) + " tail")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs, spread=True).collect()}
    assert got == {k: 0 if k == 20 else k for k, _ in texts}
    assert [n for columns, n in seen if "sketch" in columns] == [2]


def test_preferences_share_their_prompt_once(spark):
    rows = [(1, 0, "user", "hi", 0), (1, 1, "assistant", "x", 0), (1, 2, "user", "more", 0), (1, 3, "assistant", "p", 0),
            (2, 0, "user", "hi", 0), (2, 1, "assistant", "x", 0), (2, 2, "user", "more", 0), (2, 3, "assistant", "q", 0),
            (2, 3, "assistant", "q", 0), (3, None, None, None, 0), (4, 0, "user", "other", 0), (5, 1, "user", "", 0),
            (None, 1, "user", "lost", 0), (6, 0, "user", "hi", 0), (7, 0, "user", "hi", 0)]
    turns = preferences.clean_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part int"))
    pairs = preferences.pair_by_opening(turns)
    assert {tuple(r) for r in pairs.collect()} == {(1, 2), (6, 7), (3, 4), (5, None)}
    got = {(r["chosen_id"], r["rejected_id"]): r for r in preferences.assemble(preferences.preference_rows(turns, pairs)).collect()}
    first = got[(1, 2)]
    assert first["prompt"] == "<|user|>\nhi<|end|>\n<|assistant|>\nx<|end|>\n<|user|>\nmore<|end|>\n"
    assert (first["chosen"], first["rejected"]) == ("<|assistant|>\np<|end|>\n", "<|assistant|>\nq<|end|>\n")
    assert [tuple(x) for x in first["chosen_trained"]] == [(0, len(first["chosen"]))]
    assert got[(6, 7)]["chosen"] == "" == got[(6, 7)]["rejected"] and got[(6, 7)]["prompt"]
    assert got[(5, None)]["prompt"] == "" and got[(5, None)]["chosen"]
    none = preferences.clean_turns(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert preferences.preference_rows(none, preferences.pair_by_opening(none)).count() == 0


def test_class_model_counts_and_sums_to_one(docs, empty):
    tokens = {i: (t or "").encode().lower().split() + [b""] for i, t in TEXTS.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in TEXTS}
    counts = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(counts.values()), len(counts)
    for r in class_lm.score_documents(docs).collect():
        ws = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (held[r["doc_id"]], len(ws), n)
        assert r["n_known"] == sum(counts[w] > 0 for w in ws)
        assert r["base_score"] == pytest.approx(sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in ws))
    model, _ = class_lm.fit(docs.where(~class_lm.held_out()))
    total = np.zeros(len(model.size))
    own = class_lm._Units(model.units)
    for word, k in counts.items():
        unit = own[word] if word else class_lm.END_UNIT
        total[model.classes[unit]] += 10 ** model.emission(k, unit)
    for s in range(class_lm.OPEN):
        unit = class_lm.CLUSTERED + s
        total[model.classes[unit]] += 10 ** model.emission(0, unit)
    used = model.size > 0
    assert total[used] == pytest.approx(1) and (10 ** model.transition).sum(axis=1) == pytest.approx(1)
    assert class_lm.score_documents(empty).count() == 0


def test_scores_are_those_of_the_model_word_by_word(docs, monkeypatch):
    import math

    monkeypatch.setattr(class_lm, "HEAD", 100)
    monkeypatch.setattr(class_lm, "BLOCK_CHARS", 3000)
    monkeypatch.setattr(class_lm, "CACHE", 50)
    model, counts = class_lm.fit(docs.where(~class_lm.held_out()))
    n_of = {r["word"].encode(): r["n"] for r in counts.collect()}
    assert len(model.counts) == 100 and min(model.counts.values()) >= sorted(
        (n for w, n in n_of.items() if w), reverse=True)[99]
    for r in class_lm.score(docs, model, counts).collect():
        words, before, total, base, known = [*class_lm.tokens(TEXTS[r["doc_id"]]), b""], class_lm.END_UNIT, 0.0, 0.0, 0
        for word in words:
            unit = model.units.get(word, class_lm.CLUSTERED + class_lm.shape(word)) if word else class_lm.END_UNIT
            n = n_of.get(word, 0)
            total += model.transition[model.classes[before], model.classes[unit]] + model.emission(n, unit)
            base += math.log10((n + 1) / (sum(n_of.values()) + len(n_of) + 1))
            before, known = unit, known + (n > 0)
        assert (r["n_tokens"], r["n_known"]) == (len(words), known)
        assert r["score"] == pytest.approx(total, rel=1e-9) and r["base_score"] == pytest.approx(base, rel=1e-9)


def test_many_languages_have_no_deep_plan(spark, monkeypatch):
    learned = []
    monkeypatch.setattr(language_id, "train", lambda rows, languages, idf: learned.append((len(rows), len(languages))))
    docs = spark.createDataFrame([(k, f"wort{k % 1000} {chr(97 + k % 26)}", f"l{k % 1000}") for k in range(2000)], "doc_id long, text string, lang string")
    language_id.fit(docs)
    assert learned == [(2000, 1000)]


@pytest.mark.parametrize("bound, hot", [(1000, 10), (3, 4), (0, 4)])
def test_joins_with_counted_keys(spark, monkeypatch, bound, hot):
    from locusframe.llm import common

    monkeypatch.setattr(common, "HOT", hot)
    monkeypatch.setattr(common, "broadcast_if_small", lambda df: df if df.count() > bound else df.hint("broadcast"))
    rows = [(k, i) for k in range(6) for i in range(1 + 3 * (k == 2) + 2 * (k == 4))]
    df = spark.createDataFrame(rows, "key long, i long")
    counted = df.groupBy("key").count().where("count > 1 OR key < 2")
    got = sorted(tuple(r) for r in common.join_counted(df, counted, "key", "count").select("key", "i", "count").collect())
    size = Counter(k for k, _ in rows)
    assert got == sorted((k, i, size[k]) for k, i in rows if size[k] > 1 or k < 2)


def test_frequent_words_fill_their_number(spark):
    rows = [(f"hot{k}", 5000 + k) for k in range(20)] + [(f"same{k}", 7) for k in range(900)]
    counts = spark.createDataFrame(rows, "word string, n long").repartition(3)
    for most in (5, 20, 300, 920, 2000):
        found = class_lm.frequent_words(counts, most)
        assert len(found) == min(most, 920) and [n for _, n in found] == sorted((n for _, n in rows), reverse=True)[:most]
    assert class_lm.frequent_words(counts, 300) == class_lm.frequent_words(counts.repartition(2), 300)


def test_unseen_open_class_is_not_certain(spark):
    rows = [(k, "alpha beta gamma") for k in range(20)]
    docs = spark.createDataFrame([*rows, (100, "§12")], "doc_id long, text string")
    model, counts = class_lm.fit(docs.where("doc_id < 100"))
    score = class_lm.score(docs, model, counts).where("doc_id = 100").first()["score"]
    assert score < 2 * model.base(0) / 3


def test_every_word_seen_twice_is_exchanged(spark, monkeypatch):
    """Words of one class follow words of the other; few are held by the workers, the classes of all others are joined."""
    monkeypatch.setattr(class_lm, "HEAD", 1100)
    monkeypatch.setattr(class_lm, "HELD", 1100)
    monkeypatch.setattr(class_lm, "PAIR_BLOCK", 5000)
    rng = random.Random(8)
    sides = [[f"{x}{k:04d}a" for k in range(1500)] for x in "xy"]
    texts = [" ".join(sides[k % 2][min(int(rng.expovariate(1 / 400)), 1499)] for k in range(200)) + f" once{i}a" for i in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    model, counts = class_lm.fit(docs)
    rows = counts.collect()
    assert len(model.units) == 1100 < sum(r["n"] > 1 for r in rows) and all(r["cls"] < class_lm.CLASSES for r in rows if r["n"] > 1 and r["word"])
    assert all(r["cls"] == class_lm.CLASSES + r["open"] for r in rows if r["n"] == 1 and r["word"].encode() not in model.units)
    cls = {r["word"]: r["cls"] for r in rows}
    votes = defaultdict(Counter)
    for r in rows:
        if r["n"] > 1 and r["word"]:
            votes[r["cls"]][r["word"][0]] += r["n"]
    assert sum(max(v.values()) for v in votes.values()) > 0.95 * sum(sum(v.values()) for v in votes.values())
    pairs, size = Counter(), Counter()
    for text in texts:
        line = [class_lm.KINDS - 1, *(cls[w] for w in text.split()), class_lm.KINDS - 1]
        pairs.update(zip(line, line[1:]))
        size.update(line[1:])
    k = class_lm.KINDS
    assert model.size.tolist() == [size[c] for c in range(k)]
    m = np.array([[pairs[a, b] for b in range(k)] for a in range(k)], float)
    prior = (model.size + 1) / (model.size.sum() + k)
    assert model.transition == pytest.approx(np.log10((m + k * prior) / (m.sum(axis=1, keepdims=True) + k)))
    n_of = {r["word"]: r["n"] for r in rows}
    for r in class_lm.score(docs, model, counts).collect():
        line = [*texts[r["doc_id"]].split(), ""]
        steps = zip([class_lm.KINDS - 1, *(cls[w] for w in line)], line)
        units = [(c, w, class_lm.UNITS + cls[w] if cls[w] < class_lm.CLASSES else class_lm.CLUSTERED + cls[w] - class_lm.CLASSES) for c, w in steps]
        assert r["score"] == pytest.approx(sum(model.transition[c, cls[w]] + model.emission(n_of[w], u) for c, w, u in units))


def test_moves_of_many_words_are_those_of_the_exchange():
    rng, k = np.random.default_rng(3), class_lm.KINDS
    words = 150
    b = rng.poisson(0.8, (words + class_lm.OPEN + 1,) * 2).astype(float)
    own = np.concatenate([rng.integers(0, class_lm.KINDS - 1, words), class_lm.CLASSES + np.arange(class_lm.OPEN + 1)])
    one = np.eye(k)[own]
    m = one.T @ b @ one
    profile = np.zeros((words, 2 * k + 1))
    for w in range(words):
        row, column = b[w].copy(), b[:, w].copy()
        row[w] = column[w] = 0
        profile[w] = [*(row @ one), *(column @ one), b[w, w]]

    def likelihood(own):
        one = np.eye(k)[own]
        m = one.T @ b @ one
        size = b.sum(axis=1) @ one
        return sum((x * np.log(np.maximum(x, 1e-300))).sum() * f for x, f in ((m, 1), (size, -2)))

    # Row sums stand for the sizes, as in a corpus, where they equal the column sums.
    got = class_lm.best_classes(m, profile, own[:words])
    for w in range(0, words, 7):
        gains = []
        for c in range(class_lm.CLASSES):
            other = own.copy()
            other[w] = c
            gains.append(likelihood(other))
        assert gains[got[w]] == pytest.approx(max(gains), abs=1e-6)


def test_exchange_finds_planted_classes():
    rng = np.random.default_rng(1)
    truth, line = np.arange(12) % 2, [0]
    for _ in range(6000):  # words of one class follow words of the other
        line.append(int(rng.choice(np.flatnonzero(truth != truth[line[-1]]))))
    b = np.zeros((12, 12))
    np.add.at(b, (line[:-1], line[1:]), 1)
    start = rng.permutation(12)
    own = class_lm.exchange(b[np.ix_(start, start)], 12, classes=2, sweeps=5)
    assert len({(o, t) for o, t in zip(own, truth[start])}) == 2


def test_language_id_on_held_out_texts(spark, empty):
    letters = {"aa": "abcde ", "bb": "defgh ", "cc": "äöüßab "}
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice(letters[lang]) for _ in range(120)), lang, 1.0)
            for i in range(400) for lang in [sorted(letters)[i % 3]]]
    rows += [(1000, None, "aa", 1.0), (1001, "12 34 !", "bb", 1.0), (1002, "", "bb", 1.0), (1003, "abc abc", None, 1.0)]
    found = {r["doc_id"]: r for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")).collect()}
    aside = [r for r in rows[:400] if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert sum(found[r[0]]["lang_pred"] == r[2] for r in aside) > 0.95 * len(aside) > 0
    assert all(found[r[0]]["held_out"] for r in aside)
    assert [found[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3
    assert all(0 <= r["score"] <= 1 for r in found.values())
    assert language_id.identify(empty).count() == 0
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string, score double"))
    assert (model.weights == 0).mean() > 0.5
    kept = language_id.drop_unidentified(spark.createDataFrame(rows, "doc_id long, text string, lang string, score double"), model)
    assert {r["doc_id"] for r in kept.collect()} == {r[0] for r in rows} - {1000, 1001, 1002}


def test_language_sample_counts_texts_and_not_copies(spark, monkeypatch):
    learned = []
    monkeypatch.setattr(language_id, "SAMPLE", 40)
    monkeypatch.setattr(language_id, "train", lambda rows, languages, idf: learned.extend(rows))
    rows = [(t, lang) for lang in ("aa", "bb") for t in (prose(8, 1), prose(8, 2)) for _ in range(300)]  # two texts each
    rows += [(prose(8, 100), "cc")] * 300 + [(prose(8, 100 + s), "cc") for s in range(200)]  # a hot text among many
    language_id.fit(spark.createDataFrame(rows, "text string, lang string").repartition(8))
    assert Counter(label for _, _, label in learned) == {0: 2, 1: 2, 2: 13}


def test_vector_search_finds_neighbours_and_skips_unusable_vectors(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1500, 16))
    x[100:160] = x[20]  # copies, also of a query
    rows = [(i, [float(v) for v in row], 1) for i, row in enumerate(x)]
    rows += [(2000, None, 1), (2020, [0.0] * 16, 1), (2040, [float("nan")] * 16, 1), (2060, [1.0, None] * 8, 1),
             (None, [1.0] * 16, 1), (2080, [1.0], 1), (3, rows[3][1], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got = defaultdict(list)
    for r in vector_search.search(table).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 1500, 20))
    right = 0
    for q, found in got.items():
        scores = x @ x[q]
        order = [i for i in np.lexsort((np.arange(1500), -scores)) if i != q][:20]
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and q not in {f[1] for f in found}
        assert all(s == pytest.approx(scores[i]) for _, i, s in found)
        right += len({f[1] for f in found} & set(order))
    assert right >= 0.9 * 20 * len(got)
    assert [f[1] for f in got[20]] == list(range(100, 120))
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vector_search.search(none).count() == 0


def test_vector_recall_where_ids_follow_clusters(spark):
    rng = np.random.default_rng(8)
    tight = rng.normal(size=(40, 16)).repeat(50, axis=0) * 4 + rng.normal(size=(2000, 16)) * 0.05
    x = np.concatenate([tight, rng.normal(size=(2000, 16))])  # the first ids are easy, the others are scattered
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    table = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    found = defaultdict(set)
    for r in vector_search.search(table).collect():
        found[r["query_id"]].add(r["vec_id"])
    recall = []
    for q in range(0, len(x), 20):
        score = x @ x[q]
        score[q] = -np.inf
        recall.append(len(found[q] & set(np.argsort(-score)[:20].tolist())) / 20)
    print("recall", np.mean(recall[:100]), np.mean(recall[100:]))
    assert np.mean(recall) > 0.9


def test_pipeline_stages_follow_each_other(spark, docs, empty, tmp_path):
    import corpus_pipeline

    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language ID", "exact dedup", "MinHash near-dedup", "substring dedup", "packing"]
    held, rows = docs, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, held, "").write.parquet(str(tmp_path / str(k)))
        held = spark.read.parquet(str(tmp_path / str(k)))
        assert k == 4 or held.columns == docs.columns
        rows.append(held.collect())
    left = [{r["doc_id"] for r in some} for some in rows]
    assert left[0] == {i for i, t in TEXTS.items() if t and any(map(str.isalpha, t))}
    assert len(left[1]) == len({plain(TEXTS[i]) for i in left[0]})
    assert left[3] <= left[2] <= left[1] and set(range(42, 62)) <= left[3] == left[4]
    assert corpus_pipeline.STAGES[-1][1](spark, empty, "").count() == 0


def test_pairs_of_many_buckets_are_judged_a_bounded_number_at_a_time():
    import tracemalloc

    import pyarrow as pa

    groups, m, bands, rng = 150, 60, 40, np.random.default_rng(5)
    n = groups * m
    keys = rng.integers(0, 2**62, (n, bands))
    keys[:, 0] = np.repeat(np.arange(groups), m)
    sketch = near_dedup.odd_sketch(np.unique(rng.integers(0, 2**64 - 1, 300, np.uint64)))
    zero = pa.array(np.zeros(n, np.int32))
    table = pa.table({"key": keys[:, 0], "low_part": zero, "high_part": zero, "id": np.arange(n), "n": np.full(n, 300), "sketch": [sketch] * n,
                      "keys": pa.array(list(keys)), "part": zero, "label": np.arange(n)})
    bucket = near_dedup._Bucket(table, 80)
    tracemalloc.start()
    found = sum(len(i) for i, _ in bucket.pairs(True))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == groups * m * (m - 1) // 2
    assert peak < 30e6  # before 200,000 pairs were judged at once, with copies of their sketches and keys


def test_short_lines_are_hashed_and_sketched_together(monkeypatch):
    from locusframe.llm import shingles

    rng = np.random.default_rng(6)
    texts = ["", " ", "one", "a b c d", "a b c d e", "same " * 60, *(" ".join(f"w{k}" for k in rng.integers(0, 50, size)) for size in rng.integers(0, 90, 300)),
             " ".join(map(str, range(5000)))]
    single = [shingles.distinct(shingles.shingles(shingles.word_hashes(text))) for text in texts]
    values, sizes = (np.concatenate(x) for x in zip(*shingles.shingle_blocks(texts)))
    assert sizes.tolist() == [len(x) for x in single] and (values == np.concatenate(single)).all()
    one_by_one = [shingles.minhash(x, 48) for x in single if len(x)]
    calls = []
    monkeypatch.setattr(shingles, "minhash", lambda x, n, f=shingles.minhash: calls.append(1) or f(x, n))
    starts, full = np.cumsum(sizes) - sizes, sizes > 0
    assert (shingles.minhashes(values, starts[full], 48) == one_by_one).all()
    assert len(calls) == 1  # of the one long text
    sketches = near_dedup.odd_sketches(values, sizes[full])
    assert [x.tobytes() for x in sketches] == [near_dedup.odd_sketch(x) for x in single if len(x)]


def test_windows_of_many_texts_begin_where_those_of_one_do():
    rng = np.random.default_rng(7)
    sizes = np.array([0, 1, 15, 16, 17, 40, 0, 300])
    values = rng.integers(0, 9, sizes.sum()).astype(np.uint64)  # many are equal
    starts, expected = np.cumsum(sizes) - sizes, []
    for start, size in zip(starts, sizes):
        for at in range(start, start + size - passage_dedup.REACH + 1):
            some = values[at:at + passage_dedup.REACH]
            expected.append(int(at + max(np.flatnonzero(some == some.min()))))
    assert passage_dedup.anchors(values, starts, sizes).tolist() == sorted(set(expected))


def test_values_of_the_head_are_made_once_and_other_words_are_only_listed():
    size = np.full(class_lm.KINDS, 50.0)
    classes = np.concatenate([np.zeros(class_lm.CLUSTERED, np.int64), class_lm.CLASSES + np.arange(class_lm.OPEN + 1), np.arange(class_lm.CLASSES)])
    model = class_lm.Model(1000, 9, {b"often": 30, b"held": 4, b"5": 1}, {b"often": 0, b"held": class_lm.UNITS + 3}, classes,
                           np.zeros((class_lm.KINDS, class_lm.KINDS)), size, np.full(class_lm.OPEN, 2.0), 0.5)
    head = class_lm.Head.of(model)
    own = class_lm._Known(head)
    assert [own[w] for w in (b"", b"often", b"held", b"5", b"new", b"new.", b"new")] == [0, 1, 2, 3, 4, 5, 4]
    assert own.others == [b"new", b"new."]
    assert head.kind.tolist() == [class_lm.KINDS - 1, 0, 3, class_lm.CLASSES + 1, -1]
    units = [class_lm.END_UNIT, 0, class_lm.UNITS + 3, class_lm.CLUSTERED + 1]
    for k, (n, unit) in enumerate(zip((50, 30, 4, 1), units)):
        assert head.base[k] == model.base(n) and head.emission[k] == model.emission(n, unit)
    assert head.base[4] == head.emission[4] == 0
    assert all(class_lm.shape(w) == k for w, k in ((b"a", 0), ("é".encode(), 0), (b"a7", 1), (b"a.", 2), (b"a,", 3), (b"a;", 4), (b"a?", 5), (b"a)", 6)))
