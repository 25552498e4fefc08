import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tools"))

GENES = """\
chr1 gene 1 10 + ID=g1
chr1 mRNA 1 10 + ID=t1;Parent=g1
chr1 exon 1 4 + ID=e1;Parent=t1
chr1 exon 8 10 + ID=e2;Parent=t1
chr1 gene 21 30 - ID=g2;partial=true;start_range=.,21;end_range=30,.
chr1 gene 41 50 + ID=g3
chr1 gene 61 70 + ID=g4
chr1 gene 81 90 . ID=g5
chr2 mRNA 11 30 + ID=t2;Parent=g6
chr2 exon 11 15 + ID=e3;Parent=t2
chr2 gene 11 30 + ID=g6
chr2 mRNA 12 29 + ID=t3;Parent=g6
chr2 gene 15 20 - ID=g_nested
chr2 gene 35 40 - ID=g7
chr2 CDS 50 55 + ID=orphan_cds;Parent=missing_transcript
mito gene 5 12 + ID=mt_gene
scaffold gene 5 12 - ID=scaffold_gene
"""
LENGTHS = {"chr1": 100, "chr2": 80, "chr_empty": 50, "mito": 40, "scaffold": 60}


def gff_text(rows: str = GENES) -> str:
    head = ["##gff-version 3", "#!genome-build-accession NCBI_Assembly:FIXTURE_001.1"]
    head += [f"##sequence-region {name} 1 {n}" for name, n in LENGTHS.items()]
    body = []
    for row in rows.splitlines():
        seqid, kind, start, end, strand, attributes = row.split(" ")
        body.append("\t".join([seqid, "src", kind, start, end, ".", strand, ".", attributes]))
    return "\n".join(head + body) + "\n"


def fasta_text() -> str:
    out = []
    for name, n in LENGTHS.items():
        out.append(f">{name} test sequence")
        bases = "A" * n
        out += [bases[i:i + 30] for i in range(0, n, 30)]
    return "\n".join(out) + "\n"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.sql.shuffle.partitions", "2")
        .config("spark.sql.codegen.wholeStage", "false")  # tiny data: compiling costs more
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    from locusframe.session import apply_settings

    yield apply_settings(session)
    session.stop()


@pytest.fixture(scope="session")
def genome(spark, tmp_path_factory):
    """The small genome, read from files and normalised."""
    from locusframe.operators.annotation import normalize
    from locusframe.session import cut_lineage
    from locusframe.sources.fasta import read_fasta
    from locusframe.sources.gff3 import read_gff3

    folder = tmp_path_factory.mktemp("genome")
    (folder / "a.gff3").write_text(gff_text())
    (folder / "a.fna").write_text(fasta_text())
    gff = read_gff3(spark, str(folder / "a.gff3"))
    fasta = read_fasta(spark, str(folder / "a.fna"), chunk_bits=4)
    annotation = normalize(gff.features)
    sequences = spark.createDataFrame(
        [("chr1", 100, "nuclear_chromosome", "complete", "partial"),
         ("chr2", 80, "nuclear_chromosome", "unknown", "complete"),
         ("chr_empty", 50, "nuclear_chromosome", "complete", "complete"),
         ("mito", 40, "mitochondrial", "complete", "complete"),
         ("scaffold", 60, "unlocalized_scaffold", "unknown", "unknown")],
        "seqid STRING, length BIGINT, seq_class STRING, five_prime STRING, three_prime STRING",
    ).selectExpr(
        "*", "'e5' five_prime_evidence", "'d5' five_prime_declaration",
        "'e3' three_prime_evidence", "'d3' three_prime_declaration")
    return {
        "folder": folder, "gff": gff, "fasta": fasta, "sequences": cut_lineage(sequences),
        "entities": annotation.entities, "diagnostics": annotation.diagnostics,
    }


def rows(df, *columns):
    """Sorted tuples of the given columns."""
    return sorted(tuple(r) for r in df.select(*columns).collect())
