"""Sources, sinks, gates, comparison, run tables and whole jobs."""

import hashlib
import json
import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from conftest import GENES, LENGTHS, fasta_text, gff_text, rows
from locusframe.errors import ContractError
from locusframe.operators import annotation as AN, checks as CH, compare as CO, gates as GA, provenance as PR
from locusframe.sources import published as PB
from locusframe.plans.baseline import report, run_baseline
from locusframe.plans.candidates import run_candidates
from locusframe.plans.qualification import qualify_sources
from locusframe.session import cut_lineage
from locusframe.sources import archive, files, sinks
from locusframe.sources.fasta import read_fasta
from locusframe.sources.gff3 import read_gff3


def read_text(folder):
    return "".join(p.read_text() for p in sorted(Path(folder).glob("part-*")))


def identity(path):
    data = Path(path).read_bytes()
    return {"size_bytes": len(data), "sha256": hashlib.sha256(data).hexdigest()}


# --- archive ---------------------------------------------------------------

PACKAGE = """<EXPERIMENT_PACKAGE_SET><EXPERIMENT_PACKAGE>
<EXPERIMENT accession="SRX1"><STUDY_REF accession="SRP1"/><DESIGN><DESIGN_DESCRIPTION>wild type</DESIGN_DESCRIPTION>
<LIBRARY_DESCRIPTOR><LIBRARY_STRATEGY>RNA-Seq</LIBRARY_STRATEGY><LIBRARY_SOURCE>TRANSCRIPTOMIC</LIBRARY_SOURCE>
<LIBRARY_SELECTION>cDNA</LIBRARY_SELECTION><LIBRARY_LAYOUT><PAIRED/></LIBRARY_LAYOUT></LIBRARY_DESCRIPTOR></DESIGN>
<PLATFORM><ILLUMINA><INSTRUMENT_MODEL>X</INSTRUMENT_MODEL></ILLUMINA></PLATFORM></EXPERIMENT>
<SAMPLE accession="SRS1"><IDENTIFIERS><EXTERNAL_ID namespace="BioSample">SAMN1</EXTERNAL_ID></IDENTIFIERS>
<SAMPLE_NAME><SCIENTIFIC_NAME>K p</SCIENTIFIC_NAME></SAMPLE_NAME><DESCRIPTION>WT</DESCRIPTION>
<SAMPLE_ATTRIBUTES><SAMPLE_ATTRIBUTE><TAG>strain</TAG><VALUE>S1</VALUE></SAMPLE_ATTRIBUTE>
<SAMPLE_ATTRIBUTE><TAG>replicate</TAG><VALUE>1</VALUE></SAMPLE_ATTRIBUTE></SAMPLE_ATTRIBUTES></SAMPLE>
<RUN_SET><RUN accession="SRR1" total_spots="10" total_bases="300"><SRAFiles>
<SRAFile semantic_name="SRA Normalized" url="u" size="5" md5="m"/><SRAFile semantic_name="other" url="v" size="6" md5="n"/>
</SRAFiles></RUN></RUN_SET></EXPERIMENT_PACKAGE></EXPERIMENT_PACKAGE_SET>"""


def test_archive_metadata(spark, tmp_path):
    (tmp_path / "e.xml").write_text(PACKAGE)
    found = archive.read_experiments(spark, str(tmp_path / "e.xml"))
    row = found.first()
    assert (row["run"], row["experiment"], row["sample"], row["study"], row["layout"], row["total_spots"]) == (
        "SRR1", "SRX1", "SAMN1", "SRP1", "PAIRED", 10)
    assert row["attributes"] == {"strain": "S1", "replicate": "1"}
    one = archive.normalized_file(found).first()
    assert (one["url"], one["size_bytes"], one["problem"]) == ("u", 5, None)
    assert archive.normalized_file(found, "absent").first()["problem"] is not None
    (tmp_path / "r.json").write_text(json.dumps([{
        "run_accession": "SRR1", "experiment_accession": "SRX1", "sample_accession": "SAMN1",
        "study_accession": "P1", "secondary_study_accession": "SRP1", "fastq_bytes": "10;20"}]))
    ena = archive.read_run_report(spark, str(tmp_path / "r.json"))
    expected = spark.createDataFrame(
        [("SRR1", "SRX1", "SAMN1", "SRP1"), ("SRR2", "SRX2", "SAMN2", "SRP1")],
        "run STRING, experiment STRING, sample STRING, study STRING")
    assert rows(GA.accession_links(found, ena, expected), "run", "consistent") == [("SRR1", True), ("SRR2", False)]
    assert GA.declared_bytes(ena, "fastq_bytes").first()[0] == 30
    with pytest.raises(ContractError, match="SRR9"):
        archive.require_runs(found, ["SRR1", "SRR9"])


def test_archive_tables_and_tool_summary(spark, tmp_path):
    (tmp_path / "t.xml").write_text(
        '<Database><Table name="PRIMARY_ALIGNMENT"><Statistics><Rows count="70"/></Statistics></Table>'
        '<Table name="SECONDARY_ALIGNMENT"><Statistics><Rows count="5"/></Statistics></Table></Database>')
    total = GA.archive_totals(archive.read_archive_tables(spark, str(tmp_path / "t.xml")), 100).first()
    assert (total["primary_alignment_rows"], total["unmappable_or_not_primary_rows_estimate"]) == (70, 30)
    (tmp_path / "s.txt").write_text(
        "HISAT2 summary stats:\n\tTotal pairs: 100\n\t\tAligned concordantly >1 times: 7 (7.00%)\n\tOverall alignment rate: 90.5%\n")
    assert dict(rows(archive.read_tool_summary(spark, str(tmp_path / "s.txt")), "metric", "value")) == {
        "total_pairs": 100.0, "aligned_concordantly_gt1_times": 7.0, "overall_alignment_rate": 90.5}


# --- annotation sources ----------------------------------------------------

def test_source_profile_mirror_and_gene_list(spark, tmp_path):
    (tmp_path / "l.gff3").write_text(
        "1\ts\tgene\t5\t10\t.\t+\t.\tID=gene:X;partial=true;start_range=.,5;end_range=10,.\n"
        "1\ts\tmRNA\t5\t10\t.\t+\t.\tID=t;Parent=gene:X\n1\ts\tCDS\t5\t10\t.\t+\t.\tID=c;Parent=t\n"
        "1\ts\ttRNA\t20\t30\t.\t+\t.\tID=r\n")
    (tmp_path / "r.gff3").write_text("chr\ts\tgene\t5\t10\t.\t+\t.\tID=gene-X\n")
    left = read_gff3(spark, str(tmp_path / "l.gff3")).features
    right = read_gff3(spark, str(tmp_path / "r.gff3")).features
    row = CO.source_profile(left.withColumn("source_id", F.lit("s"))).first()
    assert [row[c] for c in ("gene_count", "partial_gene_count", "start_range_gene_count", "trna_count",
                             "transcript_count", "partial_gene_fraction")] == [1, 1, 1, 1, 2, 1.0]
    assert row["missing_feature_types"] == ["ncRNA", "rRNA"]
    names = spark.createDataFrame([("chr", "1")], "seqid STRING, target STRING")
    plain = CO.mirror(CO.canonical_genes(left), CO.canonical_genes(right)).first()
    mapped = CO.mirror(CO.canonical_genes(left), CO.canonical_genes(right, names)).first()
    assert (plain["shared_gene_id_count"], plain["exact_boundary_match_count"]) == (1, 0)
    assert mapped["exact_boundary_match_count"] == 1
    (tmp_path / "k.tsv").write_text(
        "ppa:X\tCDS\t1:5..10\tprotein\nppa:Y\tCDS\t1:complement(12..15)\tp\nppa:Z\tCDS\t2:join(3..5,9..11)\tp\n")
    genes = archive.read_gene_list(spark, str(tmp_path / "k.tsv"))
    placed = {r["gene_id"]: tuple(r["place"]) for r in CO.gene_list_positions(genes).collect()}
    assert placed == {"X": ("1", 5, 10, "+"), "Y": ("1", 12, 15, "-"), "Z": ("2", 3, 11, "+")}
    named = left.withColumn("attributes", F.create_map(F.lit("Name"), F.array(F.lit("X"))))
    found = CO.compare_positions(CO.gene_list_positions(genes), CO.annotation_positions(named)).first()
    assert (found["shared_gene_id_count"], found["exact_coordinate_match_count"], found["list_record_count"]) == (1, 1, 3)
    assert CO.gene_list_profile(genes.withColumn("source_id", F.lit("k"))).first()["sequence_count"] == 2


def test_source_status_reasons(spark):
    df = spark.createDataFrame([
        ("a", "available", "original", "boundaries", "S", "A", 0.1), ("b", "unavailable", "original", "x", "S", "A", None),
        ("c", "available", "mirror of x", "x", "T", "B", 0.9), ("d", "metadata_only", "o", "mirror_detection_only", "S", "A", None)],
        "source_id STRING, availability STRING, relationship STRING, expected_use STRING, strain STRING, coordinate_space STRING, partial_gene_fraction DOUBLE")
    found = {r["source_id"]: (r["qualification_status"], len(r["qualification_reasons"]))
             for r in GA.source_status(df, "S", "A").collect()}
    assert found == {"a": ("qualified", 1), "b": ("unavailable", 1), "c": ("unqualified", 4), "d": ("unqualified", 2)}


def test_qualification_job(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.gff3").write_text(gff_text())
    (tmp_path / "src" / "k.tsv").write_text("ppa:X\tCDS\t1:5..10\tprotein\n")

    def source(name, role, path, form, **more):
        return {"source_id": name, "availability": "available", "strain": "S", "coordinate_space": "A",
                "annotation_format": form, "expected_use": "u",
                "upstream": {"relationship": "original", "independence_group": "g"},
                "files": {role: {"path": path, **identity(tmp_path / path)}}, **more}

    bad = source("gone", "metadata", "src/k.tsv", "other")
    bad["files"]["metadata"]["sha256"] = "0"
    manifest = {"schema_version": 1, "sources": [
        source("s1", "annotation", "src/a.gff3", "gff3"), source("s2", "metadata", "src/k.tsv", "kegg_list"), bad]}
    (tmp_path / "m.json").write_text(json.dumps(manifest))
    found = qualify_sources(spark, str(tmp_path / "m.json"), str(tmp_path), "S", "A")
    summary = {r["source_id"]: r for r in found.summary.collect()}
    assert (summary["s1"]["gene_count"], summary["s1"]["sequence_count"], summary["s1"]["verified_files"]) == (10, 5, 1)
    assert summary["s2"]["orf_cds_count"] == 1 and summary["gone"]["verified_files"] == 0
    (tmp_path / "bad.json").write_text('{"schema_version": 2, "sources": []}')
    with pytest.raises(ContractError):
        files.read_source_manifest(spark, str(tmp_path / "bad.json"))


# --- gates -----------------------------------------------------------------

def test_gates(spark):
    samples = spark.createDataFrame(
        [("p", "a", "1"), ("p", "a", "2"), ("p", "b", ""), ("q", "a", "1"), ("q", "b", "2"), ("q", "c", "3")],
        "study STRING, sample STRING, replicate STRING")
    assert rows(GA.replication(samples, ["study"]), "study", "sample_count", "status") == [
        ("p", 1, "not-passed"), ("q", 3, "passed")]
    assert rows(GA.replication(samples, ["study"], exactly=3), "status") == [("not-passed",), ("passed",)]
    dates = spark.createDataFrame([("2019-01-02", "2016-05-01"), ("2016-05-01", "2016-05-01"), ("May", "2016-05-01")],
                                  "a STRING, b STRING")
    assert [r["status"] for r in GA.temporal_independence(dates, "a", "b").collect()] == [
        "passed", "unavailable", "unavailable"]
    docs = spark.createDataFrame([("Some  Long\nText here",), ("text long",)], "t STRING")
    assert [r["phrases_present"] for r in CH.phrase_gate(docs, "t", ["long text", "here"]).collect()] == [True, False]
    fields = spark.createDataFrame([("s", "", "x"), ("t", "a", "b")], "source_id STRING, strain STRING, terms STRING")
    assert rows(CH.incomplete_fields(fields, {"strain": "no strain", "terms": "no terms"}), "source_id", "reasons") == [
        ("s", ["no strain"])]
    paths = spark.createDataFrame([("a/SRR9_1.fq",), ("a/../b",), ("/etc/x",), ("a/..b",), ("../y/z",),
                                   ("/root/x/../z",), ("/root/y/../x/a",), ("../x/b",)], "path STRING")
    assert CH.forbidden_files(paths, ["srr9"]).count() == 1
    assert rows(CH.paths_outside(paths, "/root/x"), "path") == [("../y/z",), ("/etc/x",), ("/root/x/../z",)]
    screen = spark.createDataFrame([("r", 0, 0, 0, 0, 0, 0), ("s", 100, 10, 2, 0, 100, 6)],
        "run_id STRING, total_query_pairs INT, pair_unmapped INT, vector_pairs_all INT, vector_pairs_unmapped INT, "
        "nuclear_bins INT, nuclear_outlier_bins INT")
    found = rows(GA.engineering_screen(screen, 0.01, 0.5, 0.05), "run_id", "global_vector_signal", "widespread_high_depth")
    assert found == [("r", False, False), ("s", True, True)]


def test_metadata_contract(spark):
    expected = spark.createDataFrame([("s", "strain", "A"), ("s", "layout", "PAIRED")], "source_id STRING, `check` STRING, expected STRING")
    record = spark.createDataFrame([("s", "A", "SINGLE")], "source_id STRING, strain STRING, layout STRING")
    found = GA.metadata_contract(GA.observed_checks(record, ["source_id"], ["strain", "layout"]), expected, ["source_id"])
    assert rows(found, "check", "ok") == [("layout", False), ("strain", True)]


# --- comparison and runs ---------------------------------------------------

def test_two_sided_difference_and_hash(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None)], "k INT, v STRING")
    b = spark.createDataFrame([(2, None), (1, "x"), (3, "z")], "k INT, v STRING")
    assert rows(CO.two_sided_diff(a, b), "k", "published_rows", "recomputed_rows") == [(1, 2, 1), (3, 0, 1)]
    assert CO.two_sided_diff(a, a.orderBy(F.desc("k"))).isEmpty()
    assert CO.table_hash(a).first() == CO.table_hash(a.repartition(3)).first()
    assert CO.table_hash(a).first() != CO.table_hash(b).first()


def _write_run(root, name, manifest, contents, tamper=None):
    folder = root / name
    folder.mkdir(parents=True)
    for artifact, text in contents.items():
        (folder / artifact).write_text(text)
    manifest = {**manifest, "artifacts": {a: identity(folder / a) for a in contents}}
    if tamper:
        (folder / tamper).write_text("changed")
    (folder / "run_manifest.json").write_text(json.dumps(manifest))


def test_run_catalogue(spark, tmp_path):
    base = {n: n for n in PR.REQUIRED_ARTIFACTS[PR.BASELINE]}
    cand = {n: n for n in PR.REQUIRED_ARTIFACTS[PR.CANDIDATES]}
    baseline = {"schema_version": 2, "target_strain": "T", "execution_status": "complete",
                "verification_status": "pending", "scientific_acceptance_status": "blocked"}
    child = {"parent_run_id": "good", "rule_version": "v", "schema_version": 1, "execution_status": "complete"}
    _write_run(tmp_path, "a", {**baseline, "run_id": "good"}, base)
    _write_run(tmp_path, "b", {**child, "run_id": "cand"}, cand)
    _write_run(tmp_path, "c", {**baseline, "run_id": "altered"}, base, tamper="statistics.json")
    _write_run(tmp_path, "d", {**baseline, "run_id": "open", "execution_status": "running"}, base)
    _write_run(tmp_path, "e", {"run_id": "odd", "schema_version": 1}, {})
    _write_run(tmp_path, "f", {**baseline, "run_id": "short"}, {"statistics.json": "x"})
    (tmp_path / "nothing").mkdir()
    (tmp_path / "a" / "acceptance_manifest.json").write_text(json.dumps(
        {"run_id": "good", "verification_status": "passed", "scientific_acceptance_status": "accepted"}))
    runs = files.read_runs(spark, str(tmp_path))
    entries = PR.catalog(runs, files.run_artifacts(runs), files.artifact_identities(spark, str(tmp_path), runs),
                         files.read_acceptance(spark, str(tmp_path)))
    found = {r["run_id"]: r for r in entries.collect()}
    assert {k: r["displayable"] for k, r in found.items()} == {
        "good": True, "cand": True, "altered": False, "open": False, "odd": False, "short": False}
    assert (found["good"]["verification_status"], found["good"]["scientific_acceptance_status"]) == ("passed", "accepted")
    assert found["altered"]["reason"] == PR.REASON_HASH and found["odd"]["reason"] == PR.REASON_SCHEMA
    assert PR.displayable(entries, PR.CANDIDATES).count() == 1
    assert PR.with_parent(entries).first()["parent_displayable"] is True
    assert PR.status_banner(entries, runs).count() == 6
    assert PR.missing_artifacts(runs, files.run_artifacts(runs)).where("run_id = 'short'").count() == 8
    chain = PR.evidence_chain(
        spark.createDataFrame([("base", "m1"), ("lost", "m9")], "label STRING, manifest_sha256 STRING"),
        spark.createDataFrame([("m1", "good")], "sha256 STRING, run_id STRING"),
        files.run_artifacts(runs), files.artifact_identities(spark, str(tmp_path), runs))
    assert rows(chain, "label", "intact") == [("base", True), ("lost", False)]


def test_file_identities_list_empty_files(spark, tmp_path):
    """an artifact without rows is a file of no bytes, which is listed like any other."""
    (tmp_path / "some rows.json").write_text("{}")
    (tmp_path / "no rows.json").write_text("")
    found = {r["path"].rpartition("/")[2]: (r["size_bytes"], r["sha256"], r["md5"])
             for r in files.file_identities(spark, str(tmp_path)).collect()}
    assert found == {name: (len(data), hashlib.sha256(data).hexdigest(), hashlib.md5(data).hexdigest())
                     for name, data in (("some rows.json", b"{}"), ("no rows.json", b""))}


def test_file_identities_away_from_the_package(tmp_path):
    """the workers of a cluster have no copy of this package beside them."""
    (tmp_path / "a.txt").write_text("abc")
    script = f"""
import sys
sys.path.insert(0, {str(Path(files.__file__).resolve().parents[2])!r})
from pyspark.sql import SparkSession
from locusframe.sources import files
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
print("size", files.file_identities(spark, {str(tmp_path)!r}, whole_file_bytes=0).first()["size_bytes"])
"""
    bare = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=bare, capture_output=True, text=True, timeout=300)
    assert "size 3" in done.stdout, done.stderr[-2000:]


def test_tables_of_artifacts_are_never_broadcast(spark):
    """F1 to F4, F6: a row per file is many more than the estimate from a listing of runs."""
    from locusframe import queries as registered

    folder = "/root/testdata/sf0.001"
    names = ("run_catalog", "displayable_runs", "parent_status", "missing_artifacts", "evidence_chain", "status_banner", "parent_inputs")
    for name in names:
        plan = registered.queries()[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan, name


def test_file_identities_in_blocks(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"abc" * 1000)
    whole = files.file_identities(spark, str(tmp_path)).first()
    blocks = files.file_identities(spark, str(tmp_path), whole_file_bytes=0).first()
    assert whole == blocks and whole["sha256"] == identity(tmp_path / "x.bin")["sha256"]
    assert whole["md5"] == hashlib.md5(b"abc" * 1000).hexdigest()


def test_step_log(spark):
    import datetime as dt

    def at(s):
        return dt.datetime(2024, 1, 1, 0, 0, s)

    data = [("ok", 1, at(0), at(5), 0), ("ok", 2, at(5), at(6), 0), ("ok", 3, at(7), at(9), 0),
            ("late", 1, at(0), at(5), 0), ("late", 2, at(4), at(6), 0), ("late", 3, at(7), at(9), 0),
            ("short", 1, at(0), at(5), 0), ("back", 1, at(5), at(1), 1)]
    df = spark.createDataFrame(data, "run STRING, step INT, started TIMESTAMP, completed TIMESTAMP, exit_code INT")
    assert rows(PR.step_log(df, ["run"]), "run", "valid") == [
        ("back", False), ("late", False), ("ok", True), ("short", False)]


# --- sinks -----------------------------------------------------------------

def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("c1", "s", 0, 75, 75, "A" * 70 + "CCCCC", ["x", "y"], [("r", "why")])],
        "candidate_id STRING, seqid STRING, start_pos BIGINT, end_pos BIGINT, length BIGINT, sequence STRING, "
        "ids ARRAY<STRING>, rule_flags ARRAY<STRUCT<rule_id: STRING, reason: STRING>>")
    sinks.write_fasta(df, str(tmp_path / "f"))
    assert read_text(tmp_path / "f") == f">c1 seqid=s start=0 end=75 length=75\n{'A' * 70}\nCCCCC\n"
    sinks.write_tsv_joined(df.drop("rule_flags"), str(tmp_path / "j"))
    assert read_text(tmp_path / "j").splitlines()[-1].endswith("\tx,y")
    sinks.write_tsv_json(df, str(tmp_path / "t"), ["candidate_id", "rule_flags", "absent"])
    assert read_text(tmp_path / "t").splitlines()[0] == "candidate_id\trule_flags"
    sinks.write_json(df, str(tmp_path / "o"))
    row = json.loads(read_text(tmp_path / "o").strip())
    assert list(row) == sorted(row) and row["ids"] == ["x", "y"]
    sinks.export_csv(df, str(tmp_path / "c"))
    assert read_text(tmp_path / "c").startswith("candidate_id,seqid")
    assert sinks.one_candidate_fasta(df, "c1").count() == 1
    assert sinks.output_manifest(spark, str(tmp_path / "f"), "r").where("name LIKE 'part-%'").count() == 1


def test_manifest_leaves_out_empty_parts_beside_others_only(spark, tmp_path):
    """An empty FASTA is an output, and so are empty files of other names."""
    for name, text in {"f/part-0": "", "f/part-1": ">x", "f/empty": "", "g/part-0": "", "part-0": "", "h/part-0": "y"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    assert rows(sinks.output_manifest(spark, str(tmp_path), "r"), "run_id", "name", "size_bytes") == [
        ("r", "f/empty", 0), ("r", "f/part-1", 2), ("r", "g/part-0", 0), ("r", "h/part-0", 1), ("r", "part-0", 0)]


# --- whole jobs ------------------------------------------------------------

@pytest.fixture(scope="module")
def published(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("jobs")
    (root / "a.fna").write_text(fasta_text())
    (root / "a.gff3").write_text(gff_text())
    classes = {"chr1": "nuclear_chromosome", "chr2": "nuclear_chromosome", "chr_empty": "nuclear_chromosome",
               "mito": "mitochondrial", "scaffold": "unlocalized_scaffold"}
    end = {"status": "complete", "evidence_source": "e", "original_declaration": "d"}
    manifest = {"manifest_version": 1, "references": {"asm": {
        "assembly_accession": "FIXTURE_001.1", "annotation_accession": "x 2016-01-01",
        "sequence_classes": classes,
        "sequence_endpoints": {k: {"five_prime": end, "three_prime": end} for k in LENGTHS},
        "files": {"fasta": {"local_name": "a.fna", **identity(root / "a.fna")},
                  "gff": {"local_name": "a.gff3", **identity(root / "a.gff3")}}}}}
    (root / "m.json").write_text(json.dumps(manifest))
    arguments = [str(root / n) for n in ("a.fna", "a.gff3", "m.json")]
    run = run_baseline(spark, *arguments, "asm", str(root / "out"))
    return root, arguments, run.first()


def test_baseline_job(spark, published):
    root, arguments, run = published
    assert run["run_id"].startswith("baseline-") and run["execution_status"] == "complete"
    assert spark.read.parquet(str(root / "out/regions")).count() == 6
    assert spark.read.parquet(str(root / "out/entities")).count() == 11
    table = spark.read.parquet(str(root / "out/statistics"))
    facts = {(r["measure"], r["label"]): r["value"] for r in report(
        table, spark.read.parquet(str(root / "out/diagnostics"))).collect()}
    assert facts[("orientation.n", "convergent")] == 2 and facts[("length.p25", "all")] == 9
    assert facts[("diagnostics", "missing_parent")] == 1
    again = run_baseline(spark, *arguments, "asm", str(root / "again")).first()
    assert again["run_id"] == run["run_id"]
    same = CO.two_sided_diff(spark.read.parquet(str(root / "out/regions")),
                             spark.read.parquet(str(root / "again/regions")))
    assert same.isEmpty()


def test_candidate_job(spark, published):
    root, arguments, run = published
    fasta = read_fasta(spark, arguments[0], chunk_bits=4)
    digest = identity(arguments[0])["sha256"]
    child = run_candidates(spark, str(root / "out"), fasta.chunks, digest, 0, 1, str(root / "cand"))
    assert child.first()["parent_run_id"] == run["run_id"]
    # The job reads the chunks of the default size; these chunks are smaller.
    assert spark.read.parquet(str(root / "cand/windows")).count() == 4
    assert read_text(root / "cand/fasta").count(">") == 4
    with pytest.raises(ContractError):
        run_candidates(spark, str(root / "out"), fasta.chunks, "other", 0, 1, str(root / "no"))
    assert not (root / "no").exists()


def _published_pair(spark, published, root):
    source, arguments, _ = published
    run_baseline(spark, *arguments, "asm", str(root / "base"))
    chunks = read_fasta(spark, arguments[0], chunk_bits=4).chunks
    run_candidates(spark, str(root / "base"), chunks, None, 0, 1, str(root / "cand"))


def test_published_runs_are_displayable_until_a_byte_changes(spark, published, tmp_path):
    _published_pair(spark, published, tmp_path)
    _write_run(tmp_path, "told", {"run_id": "told", "schema_version": 2, "target_strain": "T", "execution_status": "complete"},
               {n: n for n in PR.REQUIRED_ARTIFACTS[PR.BASELINE]})
    entries = {r["run_type"] if r["run_id"] != "told" else "told": r for r in PB.scan(spark, str(tmp_path)).collect()}
    assert {k: (r["displayable"], r["reason"]) for k, r in entries.items()} == {
        k: (True, "ok") for k in (PR.BASELINE, PR.CANDIDATES, "told")}
    assert entries[PR.CANDIDATES]["parent_run_id"] == entries[PR.BASELINE]["run_id"] and entries["told"]["folder"] == "told"
    assert PR.with_parent(PB.scan(spark, str(tmp_path))).first()["parent_displayable"] is True
    base, child = entries[PR.BASELINE]["run_id"], entries[PR.CANDIDATES]["run_id"]
    assert PB.load_table(spark, str(tmp_path), base, "regions", PR.BASELINE).count() == 6
    assert PB.load_table(spark, str(tmp_path), child, "windows").count() == 4
    runs = PB.read_runs(spark, str(tmp_path))
    assert PR.missing_artifacts(runs, PB.read_artifacts(spark, str(tmp_path), runs)).isEmpty()
    assert PR.parent_inputs(runs, PB.read_inputs(spark, str(tmp_path), runs)).where("problem IS NOT NULL").isEmpty()
    with pytest.raises(ContractError, match="not a baseline"):
        PB.load_table(spark, str(tmp_path), child, "windows", PR.BASELINE)
    with pytest.raises(ContractError, match="no run"):
        PB.load_table(spark, str(tmp_path), "nothing", "windows")
    part = next((tmp_path / "base/intergenic_regions.tsv").glob("part-*"))
    data = bytearray(part.read_bytes())
    data[-3] ^= 1
    part.write_bytes(bytes(data))
    for crc in part.parent.glob(".part-*.crc"):
        crc.write_bytes(b"")  # the checksum file of the local file system would refuse the read
        crc.unlink()
    rows_left = spark.read.parquet(str(tmp_path / "cand/artifacts")).where("name NOT LIKE 'fasta/%'").toPandas()
    spark.createDataFrame(rows_left).write.mode("overwrite").parquet(str(tmp_path / "cand/artifacts"))
    found = {r["run_id"]: r for r in PB.scan(spark, str(tmp_path)).collect()}
    assert (found[base]["displayable"], found[base]["reason"]) == (False, PR.REASON_HASH) and not found[child]["displayable"]  # files or listing altered
    with pytest.raises(ContractError, match="not displayable"):
        PB.load_table(spark, str(tmp_path), base, "regions")


def test_reports_of_a_baseline_grow_with_its_copies(spark, published, tmp_path):
    """a published locus of 60 copies has rows for its spans; their pairs are counted, and can be listed."""
    _, arguments, _ = published
    copies = "".join(f"chr1 gene 91 97 + ID=copy{k:02}\n" for k in range(60)) + "chr1 gene 93 99 + ID=last\n"
    (tmp_path / "a.gff3").write_text(gff_text(GENES + copies))
    manifest = json.loads(Path(arguments[2]).read_text())
    manifest["references"]["asm"]["files"]["gff"].update(identity(tmp_path / "a.gff3"))
    (tmp_path / "m.json").write_text(json.dumps(manifest))
    run_baseline(spark, arguments[0], str(tmp_path / "a.gff3"), str(tmp_path / "m.json"), "asm", str(tmp_path / "out"))
    reports, entities = (spark.read.parquet(str(tmp_path / "out" / name)) for name in ("diagnostics", "entities"))
    assert rows(reports.where("kind IN ('nested', 'overlaps')"), "kind", "subject", "object", "n") == [
        ("nested", "copy00", "copy00", 60 * 59 // 2), ("nested", "g6", "g_nested", 1), ("overlaps", "copy00", "last", 60)]
    assert rows(AN.diagnostic_counts(reports), "kind", "n") == [
        ("missing_parent", 1), ("nested", 1 + 60 * 59 // 2), ("overlaps", 60)]
    assert read_text(tmp_path / "out/diagnostics.json").count("\n") == 4
    found = AN.listed_pairs(reports, entities)
    assert found.count() == 1 + 60 * 59 // 2 + 60
    assert ("overlaps", "copy59", "last", 92, 97) in rows(found, "kind", "subject", "object", "start_pos", "end_pos")


def test_tables_of_a_catalogue_are_loaded_without_digesting_again(spark, published, tmp_path, monkeypatch):
    """one scan of the root vouches for all tables that are loaded from it."""
    _published_pair(spark, published, tmp_path)
    entries = cut_lineage(PB.scan(spark, str(tmp_path)))
    monkeypatch.setattr(files, "file_identities", lambda *a: pytest.fail("digested again"))
    ids = {r["run_type"]: r["run_id"] for r in entries.collect()}
    load = {"entries": entries, "wanted": PR.BASELINE}
    assert PB.load_table(spark, str(tmp_path), ids[PR.BASELINE], "regions", **load).count() == 6
    with pytest.raises(ContractError, match="not a baseline"):
        PB.load_table(spark, str(tmp_path), ids[PR.CANDIDATES], "windows", **load)
    refused = entries.withColumns({"displayable": F.lit(False), "reason": F.lit("altered")})
    with pytest.raises(ContractError, match="not displayable: altered"):
        PB.load_table(spark, str(tmp_path), ids[PR.BASELINE], "regions", entries=refused)


@pytest.mark.parametrize("stop_at", ["tables", "listing", "marker"])
def test_a_job_that_stops_half_way_leaves_no_run(spark, tmp_path, monkeypatch, stop_at):
    class Stopped(Exception):
        pass

    def stop(*args, **options):
        raise Stopped

    root, out = str(tmp_path / "runs"), str(tmp_path / "runs/base")
    run = spark.createDataFrame([("r", 2, "T", "complete")], "run_id STRING, schema_version INT, target_strain STRING, execution_status STRING")
    inputs = spark.createDataFrame([("fasta", 3, "x")], "role STRING, size_bytes LONG, sha256 STRING")

    def publish():
        with PB.staged(spark, out) as folder:
            for name in PR.REQUIRED_ARTIFACTS[PR.BASELINE]:
                (tmp_path / "runs" / Path(folder).name / name).mkdir(parents=True)
                (tmp_path / "runs" / Path(folder).name / name / "part-0").write_text(name)
            if stop_at == "tables" and not done:
                stop()
            return PB.commit(spark, folder, out, run, inputs)

    done = False
    (tmp_path / "runs").mkdir()
    with monkeypatch.context() as m:
        if stop_at == "listing":
            m.setattr(files, "file_identities", stop)
        elif stop_at == "marker":
            m.setattr(PB, "_listing_digest", stop)
        with pytest.raises(Stopped):
            publish()
    assert PB.scan(spark, root).isEmpty()
    with pytest.raises(ContractError, match="not a published run"):
        PB.read_run(spark, out)
    done = True
    assert publish().first()["files"] == 9  # the next attempt replaces what is left
    assert [r["displayable"] for r in PB.scan(spark, root).collect()] == [True]
    with pytest.raises(ContractError, match="is a published run"):
        publish()


def test_table_hash_ignores_order_but_not_repetition(spark):
    df = spark.range(50).selectExpr("id", "CASE WHEN id % 7 > 0 THEN concat('x', id) END AS name", "id / 3.0D AS value", "array(id) AS list")
    one = CO.table_hash(df).first()
    assert CO.table_hash(df.orderBy(F.rand()).repartition(5)).first() == one and one["rows"] == 50
    others = [df.unionByName(df.limit(1)), df.withColumn("name", F.coalesce("name", F.lit("-"))), df.limit(49),
              df.withColumn("value", F.col("value") + 0.001)]
    assert len({one["content_hash"], *(CO.table_hash(o).first()["content_hash"] for o in others)}) == 5
    assert CO.table_hash(df.limit(0)).first()["content_hash"] == "0-0-0-0"


@pytest.mark.parametrize("change, message", [
    (("chr1 gene 81 90 . ID=g5", "chr1 gene 99 101 . ID=g5"), "out of bounds"),
    (("##sequence-region chr1 1 100", "##sequence-region chr1 1 99"), "chr1"),
    (("FIXTURE_001.1", "OTHER"), "FIXTURE_001.1")])
def test_failed_contract_publishes_nothing(spark, published, tmp_path, change, message):
    root, arguments, _ = published
    old, new = change
    if " " in old and old.startswith("chr1"):
        old, new = ("\t".join(x.split(" ")[:1] + ["src"] + x.split(" ")[1:4]) for x in (old, new))
    (tmp_path / "a.gff3").write_text(gff_text().replace(old, new))
    manifest = json.loads(Path(arguments[2]).read_text())
    manifest["references"]["asm"]["files"]["gff"].update(identity(tmp_path / "a.gff3"))
    (tmp_path / "m.json").write_text(json.dumps(manifest))
    with pytest.raises(ContractError, match=message):
        run_baseline(spark, arguments[0], str(tmp_path / "a.gff3"), str(tmp_path / "m.json"), "asm", str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()


def test_altered_input_is_refused(spark, published, tmp_path):
    root, arguments, _ = published
    (tmp_path / "a.gff3").write_text(gff_text() + "#\n")
    with pytest.raises(ContractError, match="mismatch"):
        run_baseline(spark, arguments[0], str(tmp_path / "a.gff3"), arguments[2], "asm", str(tmp_path / "out"))
