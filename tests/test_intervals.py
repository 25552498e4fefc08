"""Zone splits and brute-force checks on random intervals."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from locusframe.operators import annotation as AN, intervals as IV, rules as RU, scans as SC, stats as ST

REGION = ("seqid STRING, region_id STRING, start_pos BIGINT, end_pos BIGINT, length BIGINT, "
          "orientation STRING, left_confidence STRING, right_confidence STRING")
ZONE = "seqid STRING, start_pos BIGINT, end_pos BIGINT, rule_id STRING, reason STRING, ordinal BIGINT"


@pytest.mark.parametrize("cuts, minimum, windows, excluded", [
    ([], 5, [(0, 100, 1, 1, True, True)], []),
    ([(40, 60)], 5, [(0, 40, 1, 2, True, False), (60, 100, 2, 2, False, True)], ["repeat"]),
    ([(20, 30), (70, 80)], 5,
     [(0, 20, 1, 3, True, False), (30, 70, 2, 3, False, False), (80, 100, 3, 3, False, True)],
     ["repeat"] * 2),
    ([(5, 95)], 10, [], ["below_minimum_window_length"] * 2 + ["repeat"]),
    ([(0, 100)], 5, [], ["repeat"]),
    ([(200, 210)], 5, [(0, 100, 1, 1, True, True)], []),
])
def test_zone_splits(spark, cuts, minimum, windows, excluded):
    region = spark.createDataFrame(
        [("chr1", "chr1:intergenic:000001", 0, 100, 100, "convergent", "high", "high")], REGION)
    zones = spark.createDataFrame(
        [("chr1", a, b, "repeat", "r", i) for i, (a, b) in enumerate(cuts)], ZONE)
    found = RU.candidate_windows(region, 0, minimum, zones=zones)
    assert rows(found.windows, "start_pos", "end_pos", "split_index", "split_count",
                "keeps_left", "keeps_right") == windows
    assert sorted(r["rule_id"] for r in found.excluded.collect()) == excluded


def test_long_flag_uses_the_window_length(spark):
    lengths = [10] * 19 + [1000]
    at = 0
    data = []
    for i, n in enumerate(lengths):
        data.append(("c", f"c:intergenic:{i:06d}", at, at + n, n, "convergent", "high", "high"))
        at += n + 5
    region = spark.createDataFrame(data, REGION)
    assert RU.long_interval_threshold(region).first()[0] == 10
    flagged = RU.candidate_windows(region, 0, 1).windows.where("structural_tier = 'flagged'")
    assert [f["rule_id"] for f in flagged.first()["rule_flags"]] == ["unusually_long_interval"]
    assert flagged.count() == 1
    assert RU.candidate_windows(region, 497, 1).windows.where("structural_tier = 'flagged'").isEmpty()


def _random(spark, seed, n=400, span=3000, widest=60):
    rng = random.Random(seed)
    data = []
    for i in range(n):
        start = rng.randrange(span)
        # A third of all rows sits on one position.
        start = 700 if i % 3 == 0 else start
        data.append((rng.choice("ab") if i % 3 else "a", start, start + rng.randint(1, widest),
                     f"e{i:04d}", rng.choice("+-."), rng.choice(["high", "high", "uncertain"])))
    df = spark.createDataFrame(
        data, "seqid STRING, start_pos BIGINT, end_pos BIGINT, entity_id STRING, strand STRING, start_conf STRING"
    ).withColumn("end_conf", F.col("start_conf"))
    return data, df


def _merge(data):
    out = []
    for seqid in sorted({r[0] for r in data}):
        members = sorted(r for r in data if r[0] == seqid)
        number, start, end = 1, members[0][1], members[0][2]
        for r in members[1:]:
            if r[1] < end:
                end = max(end, r[2])
            else:
                out.append((seqid, number, start, end))
                number, start, end = number + 1, r[1], r[2]
        out.append((seqid, number, start, end))
    return sorted(out)


@pytest.mark.parametrize("bits", [3, 16])
def test_clusters_and_gaps_against_brute_force(spark, monkeypatch, bits):
    data, df = _random(spark, bits)
    original = SC.prefix_scan
    monkeypatch.setattr(IV, "prefix_scan", lambda *a, **k: original(*a, **{**k, "tile_bits": bits}))
    clusters = _merge(data)
    assert rows(IV.cluster_spans(df), "seqid", "cluster_no", "start_pos", "end_pos") == clusters
    gaps = [(a[0], a[1], a[3], b[2]) for a, b in zip(clusters, clusters[1:])
            if a[0] == b[0] and b[2] > a[3]]
    assert rows(IV.gaps(df), "seqid", "region_no", "start_pos", "end_pos") == gaps


def test_overlap_pairs_against_brute_force(spark):
    data, df = _random(spark, 7, n=200)
    want = []
    for l in data:
        for r in data:
            lk, rk = (l[1], l[2], l[3]), (r[1], r[2], r[3])
            if l[0] == r[0] and lk < rk and r[1] < l[2]:
                want.append((l[3], r[3], "nested" if r[2] <= l[2] else "overlaps", r[1], min(l[2], r[2])))
    for bits in (3, 14):
        found = IV.overlapping_entities(df, bits=bits)
        assert rows(found, "left_id", "right_id", "kind", "intersection_start",
                    "intersection_end") == sorted(want)


@pytest.mark.parametrize("span, longest, digit_bits", [(40, 12, 3), (3000, 700, 2), (200000, 150000, 4)])
def test_pair_counts_are_those_of_the_pairs(spark, span, longest, digit_bits):
    rng = random.Random(span)
    data = [("a" if rng.random() < 0.8 else "b", s, s + rng.choice([0, 1, rng.randint(0, longest)]), f"e{i % 110}")
            for i, s in enumerate(rng.randrange(span) for _ in range(140))]
    data += [("a", 7, 30, f"copy{i}") for i in range(9)] + [("a", 7, 7, "point"), ("a", 30, 30, "end"), ("b", None, 3, "none"), (None, 1, 2, "x")]
    data += data[:3]
    df = spark.createDataFrame(data, "seqid STRING, start_pos BIGINT, end_pos BIGINT, entity_id STRING")
    want = IV.overlapping_entities(df).groupBy("seqid", "kind").count()
    assert rows(IV.overlap_pair_counts(df, digit_bits=digit_bits), "seqid", "kind", "n") == rows(want, "seqid", "kind", "count")
    assert IV.overlap_pair_counts(df.limit(0)).isEmpty()


@pytest.mark.parametrize("span, longest", [(40, 12), (200000, 150000)])
def test_pairs_of_spans_stand_for_all_pairs(spark, span, longest):
    """copies of a locus add to the weight of its rows, not rows by the square."""
    rng = random.Random(span)
    data = [("a" if rng.random() < 0.8 else "b", s, s + rng.choice([0, 1, rng.randint(0, longest)]), f"e{i}")
            for i, s in enumerate(rng.randrange(span) for _ in range(120))]
    data += [("a", 7, 30, f"copy{i:02}") for i in range(40)] + [("b", 7, 7, "point"), ("b", None, 3, "none"), (None, 1, 2, "x")]
    df = spark.createDataFrame(data, "seqid STRING, start_pos BIGINT, end_pos BIGINT, entity_id STRING")
    want = IV.overlapping_entities(df)
    spans = IV.overlapping_spans(df).cache()
    assert rows(spans.groupBy("seqid", "kind").agg(F.sum("n").alias("n")), "seqid", "kind", "n") == rows(
        want.groupBy("seqid", "kind").agg(F.count("*").alias("n")), "seqid", "kind", "n")
    assert spans.count() < want.count() - 700  # of the 40 copies alone there are 780 pairs
    reports = spans.withColumnsRenamed({"left_id": "subject", "right_id": "object", "intersection_start": "start_pos",
                                        "intersection_end": "end_pos"}).withColumn("line_number", F.lit(None).cast("bigint"))
    assert rows(AN.listed_pairs(reports, df), "kind", "subject", "object", "start_pos", "end_pos") == rows(
        want, "kind", "left_id", "right_id", "intersection_start", "intersection_end")
    # An id that occurs twice on one span is no pair with itself.
    again = df.unionByName(df)
    assert rows(IV.overlapping_spans(again).groupBy("kind").agg(F.sum("n").alias("n")), "kind", "n") == rows(
        IV.overlapping_entities(again).groupBy("kind").agg(F.count("*").alias("n")), "kind", "n")
    assert IV.overlapping_spans(df.limit(0)).isEmpty()


def test_long_chains_close_in_few_rounds(spark, monkeypatch):
    writes = []
    cut = AN.cut_lineage
    monkeypatch.setattr(AN, "cut_lineage", lambda df: writes.append(1) or cut(df))
    pairs = [(f"n{k}", f"n{k - 1}") for k in range(1, 201)]
    pairs += [("n150", "n3"), ("x", "n149"), ("x", "lost"), ("loop1", "loop2"), ("loop2", "loop1"), ("under", "loop1"), ("n5", "n200"), ("n7", "n6")]
    links = spark.createDataFrame([("a", *p) for p in pairs] + [("b", "n9", "n1"), ("b", "n1", "n0")], "run STRING, child_id STRING, parent_id STRING")
    seeds = spark.createDataFrame([("a", "n0"), ("a", "n0"), ("b", "n1"), ("a", "alone")], "run STRING, id STRING")
    steps = {("a", "n0"): 0, ("a", "alone"): 0, ("b", "n1"): 0, ("b", "n9"): 1}
    steps |= {("a", f"n{k}"): k for k in range(1, 150)} | {("a", f"n{k}"): k - 146 for k in range(150, 201)} | {("a", "x"): 150}
    assert {(r["run"], r["id"]): r["steps"] for r in AN.reachable_ids(links, seeds, ["run"]).collect()} == steps
    assert len(writes) <= 2 * 10


def test_many_copies_of_a_locus_make_no_pairs(spark):
    copies = spark.range(100_000).selectExpr("'c' AS seqid", "5000 AS start_pos", "5100 AS end_pos", "concat('e', id) AS entity_id")
    around = spark.range(1000).selectExpr("'c' AS seqid", "4000 + id AS start_pos", "6000L AS end_pos", "concat('w', id) AS entity_id")
    found = rows(IV.overlap_pair_counts(copies.unionByName(around)), "kind", "n")
    assert found == [("nested", 100_000 * 99_999 // 2 + 1000 * 100_000 + 1000 * 999 // 2)]


def test_subtraction_against_brute_force(spark):
    rng = random.Random(3)
    spans = [("a", i * 120, i * 120 + rng.randint(1, 100)) for i in range(20)]
    cuts = [("a", s, s + rng.randint(0, 30)) for s in (rng.randrange(2400) for _ in range(120))]
    want = []
    for seqid, start, end in spans:
        free = [p for p in range(start, end) if not any(a <= p < b for _, a, b in cuts)]
        run = []
        for p in free:
            if run and p != run[-1] + 1:
                want.append((seqid, run[0], run[-1] + 1))
                run = []
            run.append(p)
        if run:
            want.append((seqid, run[0], run[-1] + 1))
    schema = "seqid STRING, start_pos BIGINT, end_pos BIGINT"
    found = IV.subtract(spark.createDataFrame(spans, schema), spark.createDataFrame(cuts, schema), bits=5)
    # Touching pieces around a zero-length cut stay apart; join them for the check.
    assert _joined(rows(found, "seqid", "start_pos", "end_pos")) == _joined(sorted(want))


def _joined(spans):
    out = []
    for seqid, start, end in spans:
        if out and out[-1][0] == seqid and out[-1][2] == start:
            out[-1] = (seqid, out[-1][1], end)
        else:
            out.append((seqid, start, end))
    return out


@pytest.mark.parametrize("n", [1, 2, 7, 400])
def test_nearest_rank_against_sorting(spark, n):
    rng = random.Random(n)
    values = [rng.choice([5, rng.randrange(100000)]) for _ in range(n)]
    df = spark.createDataFrame([(v,) for v in values], "v BIGINT")
    found = ST.nearest_rank(df, "v", {"a": 0.25, "b": 0.5, "c": 0.95}, tile_bits=8).first()
    ordered = sorted(values)
    assert list(found) == [ordered[round((n - 1) * f)] for f in (0.25, 0.5, 0.95)]


def test_ranks_and_top_rows_with_a_hot_key(spark):
    rng = random.Random(5)
    data = [("hot" if i % 3 else "k%d" % (i % 9), rng.randrange(50), i) for i in range(600)]
    df = spark.createDataFrame(data, "k STRING, v INT, id INT")
    want = {}
    for k in {r[0] for r in data}:
        group = sorted((v, i) for kk, v, i in data if kk == k)
        want.update({(k, i): (rank, len(group)) for rank, (_, i) in enumerate(group)})
    found = SC.ordered_index(df, ["k"], ["v", "id"]).collect()
    assert {(r["k"], r["id"]): (r["rank"], r["n_rows"]) for r in found} == want
    top = SC.top_per_group(df, ["k"], ["v", "id"], 4).collect()
    assert {(r["k"], r["id"]) for r in top} == {key for key, (rank, _) in want.items() if rank < 4}


@pytest.mark.parametrize("bits", [2, 16])
def test_prefix_scan_kinds(spark, bits):
    rng = random.Random(bits)
    data = [(k, p, rng.randint(-5, 9)) for k in "xy" for p in rng.sample(range(300), 80)]
    df = spark.createDataFrame(data, "k STRING, p BIGINT, v BIGINT")
    found = SC.prefix_scan(df, ["k"], "p", {
        "s": ("sum", "v"), "m": ("max", "v"), "prev": ("lag", "v"), "next": ("lead", "v"),
        "t": ("total", "v")}, bits)
    want = []
    for k in "xy":
        vs = [(p, v) for kk, p, v in sorted(data) if kk == k]
        for i, (p, v) in enumerate(vs):
            seen = [x for _, x in vs[:i]]
            want.append((k, p, sum(seen), max(seen) if seen else None, seen[-1] if seen else None,
                         vs[i + 1][1] if i + 1 < len(vs) else None, sum(x for _, x in vs)))
    assert sorted(map(tuple, found.select("k", "p", "s", "m", "prev", "next", "t").collect()),
                  key=lambda r: r[:2]) == want


def test_packed_neighbours_hold_every_id(spark):
    data = [("g", "left", f"e{k:04d}") for k in range(50)] + [("g", "right", "r"), ("h", "right", "x")]
    packed = IV.pack_neighbours(spark.createDataFrame(data, "region_id STRING, side STRING, entity_id STRING"), limit=20)
    found = {(r["region_id"], r["part"]): (r["left_ids"], r["right_ids"]) for r in packed.collect()}
    assert sorted(x for (region, _), (left, _) in found.items() if region == "g" for x in left) == [f"e{k:04d}" for k in range(50)]
    assert [len(found[("g", k)][0]) for k in range(3)] == [20, 20, 10] and found[("h", 0)] == ([], ["x"])


def test_depth_with_a_doubled_and_a_missing_position(spark):
    from locusframe.operators import coverage as CO

    depth = spark.createDataFrame([("a", 0), ("a", 0), ("b", 0), ("b", 1), ("c", 0), ("c", 1), ("c", 1)], "seqid STRING, pos INT")
    known = spark.createDataFrame([("a", 2), ("b", 2), ("c", 2), ("d", 1)], "seqid STRING, length INT")
    assert rows(CO.incomplete_depth(depth, known), "seqid") == [("a",), ("c",), ("d",)]


def test_parent_chains_of_any_length(spark):
    from locusframe.operators import annotation as AN

    links = spark.createDataFrame([(f"n{k + 1}", f"n{k}") for k in range(40)], "child_id STRING, parent_id STRING")
    seeds = spark.createDataFrame([("n0",)], "id STRING")
    assert {r["id"]: r["steps"] for r in AN.reachable_ids(links, seeds).collect()} == {f"n{k}": k for k in range(41)}


def test_pair_counts_move_only_rows_of_nested_pairs(spark):
    """F8: what lies in no other interval and holds none has no part in the digits of the starts."""
    spans = spark.createDataFrame(
        [("a", 1, 1, 9), ("a", 1, 3, 5), ("a", 1, 7, 12), ("a", 1, 9000, 9001), ("a", 1, 10, 70000), ("b", 1, 2, 5), ("b", 1, 2, 4)],
        "seqid STRING, w LONG, start_pos LONG, reach LONG")
    found = IV._nested(spans, ["seqid"])
    assert rows(found, "start_pos", "reach", "inner", "outer") == [
        (1, 9, False, True), (3, 5, True, False), (10, 70000, False, True), (9000, 9001, True, False)]
    chain = spark.range(3000).selectExpr("'a' AS seqid", "concat('e', id) AS entity_id", "id * 30 AS start_pos", "id * 30 + 40 AS end_pos")
    assert IV._nested(chain.selectExpr("seqid", "1L AS w", "start_pos", "end_pos AS reach"), ["seqid"]).isEmpty()
    assert rows(IV.overlap_pair_counts(chain), "kind", "n") == [("overlaps", 2999)]


def test_gaps_share_one_exchange_and_keep_facts(spark, monkeypatch):
    """F16, F20: both passes of the scan read one exchange of the starts."""
    df = spark.createDataFrame(
        [("a", 1, 5, "+", "high", "high"), ("a", 8, None, "-", "high", "high"), ("a", 9, 12, "-", "uncertain", "high"), ("a", 20, 25, "+", "high", "high")],
        "seqid STRING, start_pos LONG, end_pos LONG, strand STRING, start_conf STRING, end_conf STRING")
    written = []
    monkeypatch.setattr(IV, "cut_lineage", lambda cut: written.append(cut) or cut)
    found = rows(IV.gaps(df), "start_pos", "end_pos", "left_strand", "right_strand", "right_confidence")
    assert found == [(5, 8, "+", "-", "high"), (5, 9, "+", "-", "uncertain"), (12, 20, "-", "+", "high")]
    written[0].collect()
    assert "Reused" in written[0]._jdf.queryExecution().executedPlan().toString()
