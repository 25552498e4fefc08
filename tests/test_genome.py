"""The small genome: sources, entities, gaps, terminals, statistics, windows."""

import pytest
from pyspark.sql import functions as F

from conftest import GENES, LENGTHS, gff_text, rows
from locusframe.errors import ContractError
from locusframe.operators import annotation as AN, checks as CH, intervals as IV, rules as RU, stats as ST
from locusframe.sources.fasta import read_fasta
from locusframe.sources.gff3 import feature_identity, parse_features, read_gff3, with_ids
from locusframe.sources.lines import assert_empty, numbered_lines

SPAN = ("seqid", "start_pos", "end_pos")


@pytest.fixture(scope="module")
def nuclear(genome):
    return CH.nuclear_only(genome["entities"], genome["sequences"])


@pytest.fixture(scope="module")
def regions(nuclear):
    from locusframe.session import cut_lineage

    return cut_lineage(IV.gaps(nuclear))


def test_line_numbers_follow_the_file_over_many_splits(spark, tmp_path):
    (tmp_path / "x.txt").write_text("".join(f"line {i}\n" for i in range(1, 5001)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        lines = numbered_lines(spark, str(tmp_path / "x.txt"))
        wrong = lines.where(F.concat(F.lit("line "), "line_number") != F.col("value"))
        assert lines.count() == 5000 and wrong.isEmpty()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_sequences_and_chunks(genome):
    fasta = genome["fasta"]
    assert dict(rows(fasta.sequences, "seqid", "length")) == LENGTHS
    assert fasta.violations.isEmpty()
    chunks = fasta.chunks.where("seqid = 'chr2'").orderBy("chunk_no").collect()
    assert [len(c["bases"]) for c in chunks] == [16] * 5


@pytest.mark.parametrize("text, problem", [
    (">a\nACGTXQ\n", "invalid symbol"), (">a\nAC\n>a\nGT\n", "duplicate sequence name"),
    ("ACGT\n>a\nAC\n", "sequence before header")])
def test_bad_sequence_files(spark, tmp_path, text, problem):
    (tmp_path / "x.fna").write_text(text)
    found = read_fasta(spark, str(tmp_path / "x.fna")).violations
    assert [r["problem"] for r in found.collect()] == [problem]
    with pytest.raises(ContractError):
        assert_empty(found)


def test_empty_fasta_is_a_violation(spark, tmp_path):
    texts = {"nothing": "", "blank": " \n\n", "good": ">a\nAC\n"}
    for name, text in texts.items():
        (tmp_path / f"{name}.fna").write_text(text)
    found = {n: [r["problem"] for r in read_fasta(spark, str(tmp_path / f"{n}.fna")).violations.collect()] for n in texts}
    assert found == {"nothing": ["no sequence"], "blank": ["no sequence"], "good": []}
    both = read_fasta(spark, [str(tmp_path / "blank.fna"), str(tmp_path / "good.fna"), str(tmp_path / "nothing.fna")]).violations.collect()
    assert [r["file"].rsplit("/", 1)[1] for r in both] == ["blank.fna"]


def test_annotation_scan(genome):
    gff = genome["gff"]
    assert gff.features.count() == 17 and gff.violations.isEmpty()
    assert rows(gff.directives, "key", "value") == [
        ("genome-build-accession", "NCBI_Assembly:FIXTURE_001.1")]
    assert len(rows(gff.regions, "seqid", "first", "last")) == 5
    first = gff.features.where("feature_id = 'g1'").first()
    assert (first["start_pos"], first["end_pos"], first["line_number"]) == (0, 10, 8)


@pytest.mark.parametrize("start, end", [("0", "1"), ("-1", "1"), ("3", "2"), ("x", "2")])
def test_bad_coordinates(spark, tmp_path, start, end):
    (tmp_path / "x.gff3").write_text(f"c\ts\tgene\t{start}\t{end}\t.\t+\t.\tID=a\n")
    assert read_gff3(spark, str(tmp_path / "x.gff3")).violations.count() == 1


def test_attribute_grammar(spark, tmp_path):
    cell = 'ID=a%2Cb;Note=x+y,%41%zz, ;gene_name "q r";flag;Note=last;Dbxref=Foo:1,GeneID:77;Name=n'
    (tmp_path / "x.gff3").write_text(f"c\ts\tgene\t1\t2\t.\t+\t.\t{cell}\n")
    row = feature_identity(read_gff3(spark, str(tmp_path / "x.gff3")).features).first()
    assert row["attributes"] == {
        "ID": ["a,b"], "Note": ["x+y", "A%zz", "last"], "gene_name": ["q r"], "flag": [""],
        "Dbxref": ["Foo:1", "GeneID:77"], "Name": ["n"]}
    assert (row["feature_id"], row["gene_id"], row["name"]) == ("a,b", "77", "n")


def test_entities(genome):
    names = {r["entity_id"] for r in genome["entities"].collect()}
    assert names == {"g1", "g2", "g3", "g4", "g5", "g6", "g_nested", "g7", "orphan_cds",
                     "mt_gene", "scaffold_gene"}
    g2 = genome["entities"].where("entity_id = 'g2'").first()
    assert g2["partial"] and g2["start_range"] == [".", "21"] and g2["end_range"] == ["30", "."]
    assert (g2["start_conf"], g2["end_conf"]) == ("uncertain", "uncertain")


def test_diagnostics(genome):
    found = rows(genome["diagnostics"], "kind", "subject", "object", "start_pos", "end_pos")
    assert ("missing_parent", "orphan_cds", "missing_transcript", None, None) in found
    assert ("nested", "g6", "g_nested", 14, 20) in found
    assert {kind for kind, *_ in found} == {"missing_parent", "nested"}


def test_gaps(regions):
    assert rows(regions, *SPAN, "orientation", "left_confidence", "right_confidence") == [
        ("chr1", 10, 20, "convergent", "high", "uncertain"),
        ("chr1", 30, 40, "divergent", "uncertain", "high"),
        ("chr1", 50, 60, "tandem", "high", "high"),
        ("chr1", 70, 80, "unknown", "high", "high"),
        ("chr2", 30, 34, "convergent", "high", "high"),
        ("chr2", 40, 49, "divergent", "high", "high")]


def test_neighbours_are_the_members_on_the_edge(nuclear, regions):
    found = IV.gap_neighbours(regions, nuclear)
    packed = {r["region_id"]: (r["left_ids"], r["right_ids"]) for r in IV.pack_neighbours(found).collect()}
    assert packed["chr2:intergenic:000001"] == (["g6"], ["g7"])
    tight = IV.pack_neighbours(found, limit=1).where("region_id = 'chr2:intergenic:000001'").first()
    assert (tight["part"], tight["left_ids"], tight["right_ids"]) == (0, ["g6"], ["g7"])


def test_terminals(genome, nuclear):
    seqs = genome["sequences"].where(F.col("seq_class") == CH.NUCLEAR)
    found = IV.terminals(nuclear, seqs)
    assert rows(found, *SPAN, "side", "true_telomere_distance") == [
        ("chr1", 90, 100, "3p", False), ("chr2", 0, 10, "5p", False), ("chr2", 55, 80, "3p", True),
        ("chr_empty", 0, 50, "whole_sequence_no_features", True)]
    assert rows(IV.terminal_neighbours(found, nuclear), "region_id", "entity_id") == [
        ("chr1:3p-terminal", "g5"), ("chr2:3p-terminal", "orphan_cds"), ("chr2:5p-terminal", "g6")]
    sums = rows(IV.conservation(nuclear, seqs), "seqid", "covered_bp", "gap_bp", "terminal_bp", "conserved")
    assert sums == [("chr1", 50, 40, 10, True), ("chr2", 32, 13, 35, True), ("chr_empty", 0, 0, 50, True)]


def test_statistics(genome, nuclear, regions):
    all_row = ST.describe(regions, "length").first().asDict()
    assert all_row == {"count": 6, "min": 4, "p25": 9, "median": 10, "p75": 10, "max": 10, "mean": 8.833333}
    assert dict(rows(ST.orientation_counts(regions), "orientation", "n")) == {
        "convergent": 2, "tandem": 1, "divergent": 2, "unknown": 1}
    stats = ST.sequence_statistics(
        genome["sequences"], genome["entities"], IV.cluster_spans(nuclear), regions)
    assert rows(stats, "seqid", "functional_entity_count", "boundary_cluster_count",
                "intergenic_region_count", "excluded_from_nuclear_statistics") == [
        ("chr1", 5, 5, 4, False), ("chr2", 4, 3, 2, False), ("chr_empty", 0, 0, 0, False),
        ("mito", 1, 0, 0, True), ("scaffold", 1, 0, 0, True)]
    empty = ST.counts_over_domain(regions.where("false"), "orientation", ST.ORIENTATIONS)
    assert [r["n"] for r in empty.collect()] == [0, 0, 0, 0]


def test_windows_without_zones(regions):
    plain = RU.candidate_windows(regions, 0, 1)
    assert rows(plain.windows, *SPAN, "orientation", "structural_tier") == [
        ("chr1", 50, 60, "tandem", "flagged"), ("chr1", 70, 80, "unknown", "flagged"),
        ("chr2", 30, 34, "convergent", "convergent_clean"), ("chr2", 40, 49, "divergent", "flagged")]
    assert plain.windows.count() + plain.excluded.count() == regions.count()
    assert ("chr1", 53, 57) in rows(RU.candidate_windows(regions, 3, 1).windows, *SPAN)
    short = RU.candidate_windows(regions, 0, 11).excluded
    assert ("chr1", 50, 60, "below_minimum_window_length") in rows(short, *SPAN, "rule_id")
    for bad in ((-1, 1), (0, 0)):
        with pytest.raises(ValueError):
            RU.candidate_windows(regions, *bad)


def test_browse_and_view(regions):
    windows = RU.candidate_windows(regions, 0, 1).windows
    assert RU.browse_windows(windows, seqid="chr1").count() == 2
    assert RU.browse_windows(windows, tier="convergent_clean", orientation="convergent").count() == 1
    view = RU.window_view(windows).where("start_pos = 50").first()
    assert (view["collinearity_status"], view["rule_flag_ids"]) == (
        "unavailable", "neighbor_orientation_tandem")


def test_contract_checks(spark, genome):
    extra = spark.createDataFrame(
        [("chr1", "late", 98, 101), ("nowhere", "lost", 0, 1)],
        "seqid STRING, entity_id STRING, start_pos BIGINT, end_pos BIGINT")
    bad = CH.bounds_violations(extra, genome["sequences"])
    assert rows(bad, "entity_id", "problem") == [
        ("late", "coordinate out of bounds"), ("lost", "sequence is absent")]
    assert CH.region_length_violations(genome["gff"].regions, genome["sequences"]).isEmpty()
    expected = genome["gff"].directives.select(
        "file", F.lit("FIXTURE_001.1").alias("assembly_accession"), F.lit(True).alias("required"))
    assert CH.missing_assembly_directive(genome["gff"].directives, expected).isEmpty()
    other = expected.withColumn("assembly_accession", F.lit("OTHER"))
    assert CH.missing_assembly_directive(genome["gff"].directives, other).count() == 1
    named = CH.sequence_map(extra, genome["sequences"])
    assert rows(named.where("problem IS NOT NULL"), "seqid") == [("nowhere",)]


def _features(spark, tmp_path, extra):
    (tmp_path / "x.gff3").write_text(gff_text(GENES + extra))
    return read_gff3(spark, str(tmp_path / "x.gff3")).features


def test_conflicting_duplicate_id_is_fatal(spark, tmp_path):
    with pytest.raises(ContractError, match="g1"):
        AN.normalize(_features(spark, tmp_path, "chr1 gene 91 95 + ID=g1\n"))


def test_segmented_child_is_legal(spark, tmp_path):
    extra = "chr2 CDS 57 58 + ID=seg;Parent=none\nchr2 CDS 60 62 + ID=seg;Parent=none\n"
    found = AN.normalize(_features(spark, tmp_path, extra))
    assert rows(found.entities.where("entity_id = 'seg'"), "start_pos", "end_pos") == [(56, 62)]
    assert ("duplicate_id", "seg") in rows(found.diagnostics, "kind", "subject")


def test_ids_missing_and_parent_cycles(spark, tmp_path):
    extra = ("chr1 gene 91 92 + Name=x\nchr1 mRNA 93 94 + Note=y\nchr1 exon 95 96 + Note=z\n"
             "chr2 mRNA 60 61 + ID=ca;Parent=cb\nchr2 mRNA 62 63 + ID=cb;Parent=ca\n")
    found = AN.normalize(_features(spark, tmp_path, extra)).entities
    names = {r["entity_id"] for r in found.collect()}
    assert {"missing-id-line-25", "orphan-transcript-line-26", "orphan-exon-line-27", "ca", "cb"} <= names


def test_one_sided_range_keeps_the_other_side_high(spark, tmp_path):
    extra = "chr1 gene 91 95 - ID=half;partial=true;start_range=.,91\nchr1 gene 96 99 + ID=bare;partial=true\n"
    found = AN.normalize(_features(spark, tmp_path, extra)).entities
    assert rows(found.where("entity_id IN ('half', 'bare')"), "entity_id", "start_conf", "end_conf",
                "five_prime_conf", "three_prime_conf") == [
        ("bare", "uncertain", "uncertain", "uncertain", "uncertain"),
        ("half", "uncertain", "high", "high", "uncertain")]


def test_entities_summarise_the_ids_once(spark, monkeypatch):
    """one written summary of the ids serves links and entities, one pass gives both ranges."""

    calls, plain = [], AN.id_summary
    monkeypatch.setattr(AN, "id_summary", lambda *a: calls.append(1) or plain(*a))
    text = ["ID=g1;start_range=.,5;end_range= 9 ,%2C.", "ID=g1;start_range=7, 5;note=a b;flag;empty= ", "ID=g2;Parent=g1;x \"q, r\";start_range=,"]
    lines = spark.createDataFrame(
        [("f", k, f"c\ts\tgene\t{5}\t{9}\t.\t+\t.\t{t}") for k, t in enumerate(text)], "file string, line_number long, value string")
    features = with_ids(parse_features(lines, ("line_number",)).where("problem IS NULL"))
    maps = {r["line_number"]: r["attributes"] for r in features.collect()}
    assert maps[1] == {"ID": ["g1"], "start_range": ["7", "5"], "note": ["a b"], "flag": [""], "empty": [""]}
    assert maps[0]["end_range"] == ["9", ",."] and maps[2]["x"] == ["q", "r"] and maps[2]["start_range"] == [""]
    got = {r["entity_id"]: (r["start_range"], r["end_range"]) for r in AN.functional_entities(features).collect()}
    assert got == {"g1": ([".", "5", "7"], ["9", ",."]), "g2": ([""], [])} and len(calls) == 1
