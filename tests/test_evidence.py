"""Alignments, depth, reads and lift-over on small inputs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from locusframe.operators import alignments as AL, coverage as CV, gates as GA, liftover as LO, seeds
from locusframe.operators.sequences import extract_sequence
from locusframe.functions.sequence import reverse_complement
from locusframe.plans.evidence import submitted_probe, summarise, window_statistics
from locusframe.queries import queries
from locusframe.sources.fasta import chunked
from locusframe.sources.reads import fastq_totals, read_depth, read_fastq_pairs, read_sam

SET_A = [
    ("q1", 99, "CP014715.1", 1, "5M10N5M", 1), ("q1", 147, "CP014715.1", 21, "10M", 1),
    ("q2", 99, "CP014715.1", 2, "10M", 2), ("q2", 147, "CP014715.1", 22, "10M", 2),
    ("q2", 355, "CP014716.1", 3, "10M", 2), ("q3", 77, "*", 0, "*", None), ("q3", 141, "*", 0, "*", None)]
SET_B = [
    ("q1", 99, "CP014715.1", 1, "5M10N5M", 1), ("q1", 147, "CP014715.1", 30, "10M", 1),
    ("q1", 355, "CP014716.1", 2, "5M8N5M", 2), ("q1", 2147, "CP014716.1", 3, "5M7N5M", 1)]
NUCLEAR = ["CP014715.1", "CP014716.1", "CP014717.1", "CP014718.1"]


def sam(spark, path, records):
    head = "@HD\tVN:1.6\n@SQ\tSN:CP014715.1\tLN:40\n@SQ\tSN:big\tLN:4294967336\n"
    body = "".join(
        "\t".join([q, str(f), r, str(p), "60", c, "*", "0", "0", "*", "*"] + ([f"NH:i:{n}"] if n else [])) + "\n"
        for q, f, r, p, c, n in records)
    path.write_text(head + body)
    return read_sam(spark, str(path))


def store(spark, texts, bits=4):
    pieces = spark.createDataFrame(
        [(k, 0, v) for k, v in texts.items()], "seqid STRING, start_pos BIGINT, bases STRING")
    lengths = pieces.select("seqid", F.length("bases").cast("bigint").alias("length"))
    return chunked(pieces, ["seqid"], bits), lengths


def test_pair_classes_and_motif(spark, tmp_path):
    found = sam(spark, tmp_path / "a.sam", SET_A)
    assert found.violations.isEmpty() and found.header.count() == 2
    summary = AL.pair_summary(AL.pair_facts(found.alignments, NUCLEAR)).first()
    assert [summary[c] for c in ("total_query_pairs", "pair_unique", "pair_multi", "pair_unmapped",
                                 "classification_complete")] == [3, 1, 1, 1, True]
    bases = list("A" * 40)
    bases[5:7], bases[13:15] = "GT", "AG"
    chunks, lengths = store(spark, {"CP014715.1": "".join(bases)})
    motifs = AL.with_motifs(AL.junction_support(found.alignments), chunks, lengths, 4)
    assert rows(motifs, "intron_start", "intron_end", "unique_support", "multi_support", "motif",
                "canonical") == [(5, 15, 1, 0, "GT-AG", True)]
    assert AL.both_unmapped(found.alignments).count() == 2
    shorter = store(spark, {"CP014715.1": "A" * 12})
    outside = AL.with_motifs(AL.junction_support(found.alignments), *shorter, 4).first()
    assert (outside["motif"], outside["canonical"]) == ("unavailable", False)


def test_secondary_counts_as_multi_and_supplementary_is_dropped(spark, tmp_path):
    found = sam(spark, tmp_path / "b.sam", SET_B).alignments
    assert tuple(AL.junction_summary(AL.junction_support(found)).first()) == (2, 1, 1)
    pair = AL.pair_facts(found, NUCLEAR).first()
    assert pair["pair_multi"] and pair["pair_with_supplementary"] and not pair["pair_unique"]
    # Records of one query need not be neighbours, and their order is kept by line.
    assert AL.pair_facts(found.orderBy(F.rand(3)), NUCLEAR).first() == pair
    names = spark.createDataFrame([(n,) for n in [*NUCLEAR, NUCLEAR[0]]], "seqid STRING")
    assert AL.pair_facts(found, names).first() == pair


def test_header_lengths_are_taken_modulo_two_to_31(spark, tmp_path):
    header = sam(spark, tmp_path / "c.sam", SET_A).header
    known = spark.createDataFrame([("CP014715.1", 40), ("big", 40)], "seqid STRING, length BIGINT")
    assert rows(AL.header_compatibility(header, known), "rname", "length_identity") == [
        ("CP014715.1", True), ("big", True)]


def test_malformed_record(spark, tmp_path):
    (tmp_path / "x.sam").write_text("q1\t99\tc\n")
    found = read_sam(spark, str(tmp_path / "x.sam"))
    assert found.alignments.isEmpty() and found.violations.count() == 1


def test_files_with_equal_lines_and_names_stay_apart(spark):
    chunks, lengths = store(spark, {"r": "ACGTACGTAC"})
    data = [("x", 1, "q", 99, "r", "4M", "ACGT"), ("x", 2, "q", 147, "r", "4M", "ACGT"),
            ("y", 1, "q", 77, "*", "*", "ACGT"), ("y", 2, "q", 141, "*", "*", "ACGT"), ("z", 1, "s", 99, "r", "4M", "ACCC")]
    df = spark.createDataFrame(data, "file STRING, line_number BIGINT, qname STRING, flag INT, rname STRING, cigar STRING, "
                               "seq STRING").withColumns({"pos": F.lit(1).cast("bigint"), "nh": F.lit(1)})
    aligned = df.where("cigar <> '*'")
    assert rows(AL.reference_identity(aligned, chunks, lengths), "file", "line_number", "matches", "reference_identity") == [
        ("x", 1, 4, 1.0), ("x", 2, 4, 1.0), ("z", 1, 2, 0.5)]
    pairs = AL.pair_facts(df, ["r"])
    assert rows(pairs, "file", "pair_unmapped", "pair_both_mapped") == [
        ("x", False, True), ("y", True, False), ("z", False, False)]
    total = AL.pair_summary(pairs).first()
    assert (total["total_query_pairs"], total["pair_unmapped"], total["classification_complete"]) == (3, 1, True)


def test_reference_identity(spark):
    chunks, lengths = store(spark, {"r": "ACGTNNGTAC", "short": "ACGTAC", "long": "ACGT" * 20})
    data = [
        ("a", "r", 1, "4M2N4M", "ACGTGTAC"), ("b", "short", 5, "8M", "ACGTGTAC"),
        ("c", "long", 14, "2S30M3I5D10M2H", "GG" + ("CGTA" * 20)[:30] + "TTT" + "A" * 10),
        ("d", "r", 1, "4M2N6M", "ACGTGTAC"), ("e", "r", 1, "8S", "ACGTGTAC")]
    df = spark.createDataFrame(data, "line_number STRING, rname STRING, pos BIGINT, cigar STRING, seq STRING")
    found = {r["line_number"]: r for r in AL.reference_identity(df, chunks, lengths, chunk_bits=4).collect()}

    def facts(key):
        r = found[key]
        return tuple(r[c] for c in ("coordinate_valid", "aligned_bases", "matches", "reference_identity",
                                    "splice_junctions", "target_end"))

    assert facts("a") == (True, 8, 8, 1.0, 1, 10)
    assert facts("b") == (False, 0, 0, None, 0, 4)
    text, read = "ACGT" * 20, data[2][4]
    want = sum(a == b for a, b in zip(read[2:32], text[13:43])) + sum(
        a == b for a, b in zip(read[35:45], text[48:58]))
    assert facts("c") == (True, 40, want, round(want / 40, 6), 0, 58)
    assert facts("d") == (False, 4, 4, None, 1, 6)
    assert facts("e")[:4] == (False, 0, 0, None)


def test_classification_precedence(spark):
    df = spark.createDataFrame([
        ("m", 0, 2, True, 0.1, "partial"), ("s", 256, 1, True, 1.0, None), ("c", 0, 1, False, None, "partial"),
        ("l", 16, None, True, 0.5, None), ("e", 0, 1, True, 0.99, "unknown"), ("g", 16, 1, True, 0.99, None)],
        "q STRING, flag INT, nh INT, coordinate_valid BOOLEAN, reference_identity DOUBLE, endpoint_status STRING")
    found = dict(rows(AL.classify(df, 0.9), "q", "classification"))
    assert found == {"m": "multi_mapping", "s": "multi_mapping", "c": "conflict", "l": "conflict",
                     "e": "endpoint_limited", "g": "success"}
    counts = dict(rows(AL.class_counts(AL.classify(df, 0.9)), "classification", "n"))
    assert counts["unmappable"] == 0 and counts["multi_mapping"] == 2


def test_depth_runs_against_brute_force(spark):
    rng = random.Random(2)
    data, depth = [], {}
    for i in range(300):
        pos = 500 if i % 3 == 0 else rng.randint(1, 900)
        cigar = rng.choice(["10M", "4M6N4M", "3S5M2D5M", "6M3I6M"])
        flag = rng.choice([0, 16, 4, 256, 1024])
        data.append((f"q{i}", flag, "c", pos, cigar))
        if flag in (0, 16):
            at = pos - 1
            for n, op in {"10M": [(10, "M")], "4M6N4M": [(4, "M"), (6, "N"), (4, "M")],
                          "3S5M2D5M": [(5, "M"), (2, "D"), (5, "M")], "6M3I6M": [(12, "M")]}[cigar]:
                for p in range(at, at + n):
                    if op == "M":
                        depth[p] = depth.get(p, 0) + 1
                at += n
    df = spark.createDataFrame(data, "qname STRING, flag INT, rname STRING, pos BIGINT, cigar STRING")
    runs = CV.depth_runs(df)
    got = {p: r["depth"] for r in runs.collect() for p in range(r["start_pos"], r["end_pos"])}
    assert got == depth
    seqs = spark.createDataFrame([("c", 1000)], "seqid STRING, length BIGINT")
    row = CV.profile(runs, seqs).first()
    ordered = sorted(depth.get(p, 0) for p in range(1000))
    assert (row["covered_bases"], row["median_depth"], row["max_depth"]) == (
        len(depth), (ordered[499] + ordered[500]) / 2, ordered[-1])


def test_depth_table_profile_windows_and_outliers(spark, tmp_path):
    lines = [f"c{k}\t{p}\t{int(p == 1)}" for k in range(4) for p in range(1, 11)]
    (tmp_path / "d.tsv").write_text("\n".join(lines) + "\n")
    depth = read_depth(spark, str(tmp_path / "d.tsv"))
    seqs = spark.createDataFrame([(f"c{k}", 10) for k in range(4)], "seqid STRING, length BIGINT")
    assert CV.incomplete_depth(depth, seqs).isEmpty()
    assert CV.incomplete_depth(depth.where("pos > 0"), seqs).count() == 4
    windows = seqs.selectExpr("seqid", "seqid AS window_id", "0L AS start_pos", "length AS end_pos")
    found = CV.window_coverage(CV.as_runs(depth), windows)
    assert [r["covered_bases"] for r in found.collect()] == [1] * 4
    runs = spark.createDataFrame(
        [("x", i * 1000, i * 1000 + 1000, 2) for i in range(20)] + [("x", 20000, 20500, 100)],
        "seqid STRING, start_pos BIGINT, end_pos BIGINT, depth BIGINT")
    long = spark.createDataFrame([("x", 20500), ("none", 1500)], "seqid STRING, length BIGINT")
    bins = CV.bin_means(runs, long)
    assert bins.count() == 23
    assert rows(CV.outliers(bins), "start_pos", "end_pos", "mean_depth", "median_nonzero", "mad_nonzero") == [
        (20000, 20500, 100.0, 2.0, 0.0)]
    stat = {r["seqid"]: r for r in CV.bin_statistics(bins).collect()}
    assert stat["x"]["threshold"] == 12.0 and stat["none"]["threshold"] == 10.0


@pytest.mark.parametrize("first, second, problem", [
    ("@spot 1 length=2\nAC\n+\nII\n", "@spot 2 length=2\nGT\n+\nII\n", None),
    ("@spot/1\nAC\n+\n@I\n", "@spot/2\nGT\n+\nII\n", None),
    ("@spot 1\nAC\n+\nII\n@s2 1\nAC\n+\nII\n", "@spot 2\nGT\n+\nII\n", "paired count mismatch"),
    ("@spot\nAC\n+\nII\n", "@spot\nGT\n+\nII\n", "paired name mismatch"),
    ("@spot 1\nACG\n+\nII\n", "@spot 2\nGT\n+\nII\n", "sequence/quality length mismatch"),
    ("@spot 1\nAC\n+\n", "@spot 2\nGT\n+\nII\n", "truncated record")])
def test_fastq_pairs(spark, tmp_path, first, second, problem):
    (tmp_path / "1.fq").write_text(first)
    (tmp_path / "2.fq").write_text(second)
    found = read_fastq_pairs(spark, str(tmp_path / "1.fq"), str(tmp_path / "2.fq"))
    assert [r["problem"] for r in found.violations.collect()] == ([problem] if problem else [])
    if problem is None:
        assert tuple(fastq_totals(found.pairs).first()) == (1, 1, 4)


# --- lift-over -------------------------------------------------------------

def _dna(seed, n):
    return "".join(random.Random(seed).choices("ACGT", k=n))


def _reverse(text):
    return text.translate(str.maketrans("ACGTN", "TGCAN"))[::-1]


SOURCE, PAD_A, PAD_B = _dna(1, 500), _dna(2, 80), _dna(3, 80)
FORWARD = PAD_A + SOURCE + PAD_B


@pytest.mark.parametrize("targets, status, strand, offset", [
    ({"t": FORWARD}, "consistent", "+", 80),
    ({"t": _reverse(FORWARD)}, "consistent", "-", None),
    ({"t": _dna(9, 700)}, "unmappable", None, None),
    ({"t": SOURCE + _dna(5, 30) + SOURCE}, "uncertain", None, None),
    ({"t": _dna(6, 40) + SOURCE[:220] + _dna(7, 40), "u": _dna(8, 40) + SOURCE[200:] + _dna(4, 40)},
     "conflict", None, None)])
def test_boundary_mapping(spark, targets, status, strand, offset):
    source, lengths = store(spark, {"s": SOURCE}, 7)
    target, _ = store(spark, targets, 7)
    gene = spark.createDataFrame(
        [("g", "s", 150, 260, "+")], "feature_id STRING, seqid STRING, start_pos BIGINT, end_pos BIGINT, strand STRING")
    row = LO.map_boundaries(gene, lengths, source, target, chunk_bits=7).first()
    assert (row["mapping_status"], row["mapped_strand"], ) == (status, strand)
    if offset is not None:
        assert (row["start_boundary_offset"], row["end_boundary_offset"]) == (offset, offset)
        assert (row["target_start"], row["target_end"]) == (230, 340)


def test_edge_gene_and_capped_hits(spark):
    source, lengths = store(spark, {"s": SOURCE}, 7)
    target, _ = store(spark, {"t": SOURCE * 5}, 7)
    genes = spark.createDataFrame(
        [("edge", "s", 10, 260, "+"), ("many", "s", 150, 260, "-")],
        "feature_id STRING, seqid STRING, start_pos BIGINT, end_pos BIGINT, strand STRING")
    found = {r["feature_id"]: r for r in LO.map_boundaries(genes, lengths, source, target, chunk_bits=7).collect()}
    assert (found["edge"]["mapping_reason"], found["edge"]["source_start"]) == (LO.REASON_EDGE, None)
    assert (found["many"]["start_anchor_hit_count"], found["many"]["mapping_status"]) == (3, "uncertain")


def test_boundary_mapping_takes_every_text_and_all_of_it(spark, tmp_path):
    texts = [(1, ""), (2, _dna(11, 150)), (3, _dna(12, 2500)), (4, None)]
    spark.createDataFrame(texts, "doc_id BIGINT, text STRING").write.parquet(str(tmp_path / "documents.parquet"))
    found = {r["feature_id"]: r for r in queries()["boundary_mapping"](spark, str(tmp_path)).collect()}
    assert {k: (r["mapping_status"], r["source_start"], r["source_end"]) for k, r in found.items()} == {
        "doc1:0": ("uncertain", None, None), "doc2:0": ("uncertain", None, None),
        "doc3:0": ("consistent", 250, 500), "doc3:1000": ("consistent", 1250, 1500), "doc3:2000": ("consistent", 2125, 2250)}
    assert {found[k]["mapping_reason"] for k in ("doc1:0", "doc2:0")} == {LO.REASON_EDGE}


@pytest.mark.parametrize("bits", [8, 1 << 15])
def test_overlapping_hits_count(spark, monkeypatch, bits):
    monkeypatch.setattr(seeds, "filter_bits", lambda probes: max(bits, 1 << 15))
    chunks, _ = store(spark, {"t": "A" * 20}, 3)
    anchors = spark.createDataFrame([("AAAAA",), ("TTTTT",), ("CCCCC",)], "anchor STRING")
    found = {r["anchor"]: r for r in LO.anchor_hits(anchors, chunks, 5, chunk_bits=3).collect()}
    assert (found["AAAAA"]["hits"], found["TTTTT"]["hits"], "CCCCC" in found) == (16, 16, False)
    assert (found["AAAAA"]["hit_orientation"], found["TTTTT"]["hit_orientation"]) == ("+", "-")


def test_hashes_depend_on_the_run_only():
    data = np.frombuffer((_dna(31, 5000) * 2).encode(), np.uint8)
    hashes = seeds.rolling(data, 21)
    assert (hashes[:4980] == hashes[5000:]).all() and len(np.unique(hashes[:5000])) == 5000
    assert (seeds.whole(data[:9996], 21) == hashes[::21][:476]).all()


@pytest.mark.parametrize("k, bits, part", [(5, 3, 1 << 18), (9, 4, 64), (21, 3, 100), (33, 8, 1 << 18)])
def test_anchor_hits_are_those_of_a_plain_search(spark, monkeypatch, k, bits, part):
    monkeypatch.setattr(seeds, "PART", part)
    texts = {f"s{i}": _dna(50 + i, n) for i, n in enumerate([0, 3, k - 1, k, 200, 731])}
    texts["rep"], texts["back"], texts["n"] = "ACGT" * 40, _reverse(texts["s5"]), "N" * 60
    chunks, _ = store(spark, texts, bits)
    wanted = {t[i:i + k] for t in texts.values() for i in range(0, len(t) - k + 1, 7)} | {_dna(77, k), "A" * (k + 1), "ACG"}
    found = {r["anchor"]: r.asDict() for r in LO.anchor_hits(
        spark.createDataFrame([(a,) for a in wanted] + [(None,)], "anchor STRING"), chunks, k, chunk_bits=bits).collect()}
    for a in wanted:
        hits = [(n, o, i) for n, t in texts.items() for o, q in (("+", a), ("-", _reverse(a)))
                for i in range(len(t) - k + 1) if len(a) == k and t[i:i + k] == q]
        assert (a in found) == bool(hits)
        if hits:
            r = found[a]
            assert (r["hits"], r["capped_hits"], r["hit_seqid"], r["hit_orientation"], r["hit_pos"]) == (len(hits), min(3, len(hits)), *min(hits))


def test_two_runs_at_once_are_two_runs(spark):
    a, la = store(spark, {"s": SOURCE, "x": _dna(61, 400)}, 7)
    b, lb = store(spark, {"s": _dna(62, 500), "x": SOURCE}, 7)
    t, _ = store(spark, {"t": FORWARD, "u": _dna(61, 400)}, 7)
    u, _ = store(spark, {"t": _reverse(FORWARD) + _dna(62, 500)}, 7)
    genes = spark.createDataFrame([(f"{s}{i}", s, i, i + 90, "+", f"w{s}") for s in "sx" for i in (60, 150, 220)],
                                  "feature_id STRING, seqid STRING, start_pos BIGINT, end_pos BIGINT, strand STRING, window_id STRING")

    def run(df, name):
        return df.withColumn("run", F.lit(name))

    def both(x, y):
        return run(x, "a").unionByName(run(y, "b"))

    together = LO.map_boundaries(both(genes, genes), both(la, lb), both(a, b), both(t, u), chunk_bits=7, ns=["run"])
    apart = both(LO.map_boundaries(genes, la, a, t, chunk_bits=7), LO.map_boundaries(genes, lb, b, u, chunk_bits=7))
    assert rows(together, *apart.columns) == rows(apart, *apart.columns)
    assert rows(LO.order_status(together, ["run"]), "run", "window_id", "order_status") == sorted(
        [("a", *r) for r in rows(LO.order_status(apart.where("run = 'a'")), "window_id", "order_status")]
        + [("b", *r) for r in rows(LO.order_status(apart.where("run = 'b'")), "window_id", "order_status")])


@pytest.mark.parametrize("k", [8, 9, 10, 21, 33])
def test_kmers_longer_than_chunks(spark, k):
    texts = {"s": _dna(21, 70), "short": _dna(22, 9)}
    chunks, _ = store(spark, texts, 3)
    found = [(r["seqid"], r["pos"], bytes(r["kmer"]).decode()) for r in LO.kmer_starts(chunks, k, chunk_bits=3).collect()]
    assert sorted(found) == [(n, i, t[i:i + k]) for n, t in texts.items() for i in range(len(t) - k + 1)]


def test_long_flanks_map_across_chunks(spark):
    source, lengths = store(spark, {"s": SOURCE}, 4)
    target, _ = store(spark, {"t": FORWARD}, 4)
    gene = spark.createDataFrame(
        [("g", "s", 150, 260, "+")], "feature_id STRING, seqid STRING, start_pos BIGINT, end_pos BIGINT, strand STRING")
    row = LO.map_boundaries(gene, lengths, source, target, chunk_bits=4).first()  # 101 bases over chunks of 16
    assert (row["mapping_status"], row["target_start"], row["target_end"]) == ("consistent", 230, 340)


def test_nine_genes_give_three_windows_in_order(spark):
    from locusframe.plans.qualification import lift_over_probe

    text = _dna(11, 2400)
    source, lengths = store(spark, {"s": text}, 8)
    target, _ = store(spark, {"t": PAD_A + text}, 8)
    genes = spark.createDataFrame(
        [(f"g{i}", "s", "gene", 100 + i * 240, 220 + i * 240, "+", {"ID": [f"g{i}"]}) for i in range(9)],
        "feature_id STRING, seqid STRING, feature_type STRING, start_pos BIGINT, end_pos BIGINT, strand STRING, "
        "attributes MAP<STRING, ARRAY<STRING>>")
    mapped, orders = lift_over_probe(genes, lengths, source, target, chunk_bits=8)
    assert rows(orders, "window_id", "order_status") == [
        ("s:first", "preserved"), ("s:last", "preserved"), ("s:middle", "preserved")]
    summary = {(r["measure"], r["label"]): r["n"] for r in LO.mapping_summary(mapped, orders).collect()}
    assert summary[("mapping_status", "consistent")] == 9 and summary[("mapping_status", "conflict")] == 0
    assert GA.probe_coverage(mapped, lengths).first()["complete"]


def test_sequence_store(spark):
    texts = {"a": _dna(21, 203), "b": "ACGTN"}
    chunks, _ = store(spark, texts, 4)
    spans = [("a", 0, 203), ("a", 15, 17), ("a", 190, 300), ("b", 1, 4)]
    df = spark.createDataFrame(spans, "seqid STRING, start_pos BIGINT, end_pos BIGINT")
    found = {(r[0], r[1], r[2]): r[3] for r in extract_sequence(df, chunks, chunk_bits=4).collect()}
    assert found == {s: texts[s[0]][s[1]:s[2]] for s in spans}
    flipped = spark.createDataFrame([("ACGTNRY",)], "s STRING").select(reverse_complement("s")).first()[0]
    assert flipped == "YRNACGT"


# --- whole evidence job ----------------------------------------------------

def test_evidence_job(spark, tmp_path):
    found = sam(spark, tmp_path / "a.sam", SET_A)
    chunks, lengths = store(spark, {"CP014715.1": "A" * 40, "CP014716.1": "A" * 40})
    seqs = lengths.withColumn("seq_class", F.lit("nuclear_chromosome"))
    runs = CV.depth_runs(found.alignments)
    windows = seqs.selectExpr("seqid", "seqid AS window_id", "0L AS start_pos", "length AS end_pos")
    vector = spark.createDataFrame([(0, 0)], "vector_pairs_all BIGINT, vector_pairs_unmapped BIGINT")
    limits = {"all": 0.01, "unmapped": 0.05, "outlier": 0.05}
    result = summarise(found.alignments, runs, seqs, chunks, windows, vector, limits, "r1", 4)
    assert result.screen.first()["conclusion"] == "no global signal"
    found = dict(rows(result.capabilities, "gate", "status"))
    assert (found["coordinate_coverage"], found["splice_support"], found["strand_support"]) == (
        "failed", "passed", "unavailable")


def test_submitted_probe(spark):
    chunks, lengths = store(spark, {"c": "ACGT" * 50}, 4)
    seqs = lengths.selectExpr("*", "'partial' AS five_prime", "'complete' AS three_prime")
    data = [(f"q{i}", 0, "c", p, "4M", "ACGT", 1, i) for i, p in enumerate([1, 5, 9, 101, 102, 189])]
    df = spark.createDataFrame(data, "qname STRING, flag INT, rname STRING, pos BIGINT, cigar STRING, seq STRING, nh INT, line_number BIGINT")
    classified, windows = submitted_probe(df, seqs, chunks, 20, 2, 0.9, 6, 4)
    assert rows(classified, "qname", "window", "classification") == [
        ("q0", "start", "endpoint_limited"), ("q1", "start", "endpoint_limited"),
        ("q3", "middle", "success"), ("q4", "middle", "conflict"), ("q5", "end", "success")]
    stats = {r["window"]: r for r in window_statistics(classified, windows).collect()}
    assert stats["start"]["sampled_records"] == 2 and stats["middle"]["median_reference_identity"] == 0.5
    status = GA.chromosome_compatibility(classified, windows, 0.9).first()
    assert status["coordinate_compatibility"] == "passed"


def test_introns_inside_one_chunk_extract_nothing(spark, monkeypatch):
    """only introns with ends in two chunks go through the extraction; all motifs stay those of the plain text."""
    text = "".join("ACGTN"[(k * k + k // 3) % 5] for k in range(100))
    sequences = spark.createDataFrame([("s", 100)], "seqid string, length long")
    chunks = spark.createDataFrame([("s", k, text[16 * k:16 * k + 16]) for k in range(7)], "seqid string, chunk_no long, bases string")
    places = [(a, b) for a in range(0, 100, 3) for b in (a + 1, a + 2, a + 5, a + 17, 104)]
    asked = []
    plain = AL.extract_sequence
    monkeypatch.setattr(AL, "extract_sequence", lambda spans, *a, **k: asked.append(spans.count()) or plain(spans, *a, **k))
    introns = spark.createDataFrame([("s", a, b) for a, b in places], "rname string, intron_start long, intron_end long")
    got = {(r["intron_start"], r["intron_end"]): r["motif"] for r in AL.with_motifs(introns, chunks, sequences, chunk_bits=4).collect()}
    ends = spark.createDataFrame([(text[a:a + 2], text[max(b - 2, 0):b]) for a, b in places if b <= 100], "d string, a string").select(
        AL.splice_motif(F.col("d"), F.col("a")).alias("m")).collect()
    inside = [x for x in places if x[1] <= 100]
    assert got == {**dict.fromkeys(places, "unavailable"), **{x: r["m"] for x, r in zip(inside, ends)}}
    two = [x for x in inside if min(x[0], x[1] - 2) // 16 != (max(x[0] + 2, x[1]) - 1) // 16]
    assert len(asked) == 1 and 2 * len(two) - 20 <= asked[0] <= 2 * len(two) < 2 * len(inside)


def test_records_inside_one_chunk_are_counted_in_place(spark):
    """equal counts whatever the chunks, and a record without its reference."""
    text = "ACGTTGCAACGGTCAT" * 6
    reads = [(k, "s" if k % 5 else "none", k % 80 + 1, c, text[(k % 80):][:30] + "A" * 12) for k in range(60) for c in [("10M5D10M2S", "20M", "3S4M20N9M", "*")[k % 4]]]
    df = spark.createDataFrame(reads, "line_number long, rname string, pos long, cigar string, seq string")
    lengths = spark.createDataFrame([("s", len(text))], "seqid string, length long")
    found = []
    for bits in (3, 5, 12):
        n = 1 << bits
        chunks = spark.createDataFrame([("s", k, text[n * k:n * k + n]) for k in range(-(-len(text) // n))], "seqid string, chunk_no long, bases string")
        found.append({r["line_number"]: (r["matches"], r["aligned_bases"], r["target_end"], r["coordinate_valid"], r["reference_identity"])
                      for r in AL.reference_identity(df, chunks, lengths, chunk_bits=bits).collect()})
    assert found[0] == found[1] == found[2] and len(found[0]) == 60 and any(x[0] for x in found[0].values())


def test_tasks_read_bounded_parts(spark):
    """a registered query reads files and exchanges in parts of fixed size, not in the defaults of 128 and 64 MB."""
    queries()["record_counts"](spark, "/root/testdata/sf0.001")
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == "32m"
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "16m"
