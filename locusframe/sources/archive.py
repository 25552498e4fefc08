"""Archive metadata: experiment XML, run reports, gene lists, tool summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.errors import ContractError

_TEXT_REF = "STRUCT<_namespace: STRING, _VALUE: STRING>"
EXPERIMENT = f"""
    EXPERIMENT STRUCT<
      _accession: STRING,
      STUDY_REF: STRUCT<_accession: STRING>,
      DESIGN: STRUCT<
        DESIGN_DESCRIPTION: STRING,
        LIBRARY_DESCRIPTOR: STRUCT<
          LIBRARY_STRATEGY: STRING, LIBRARY_SOURCE: STRING, LIBRARY_SELECTION: STRING,
          LIBRARY_LAYOUT: STRUCT<PAIRED: STRING, SINGLE: STRING>,
          LIBRARY_CONSTRUCTION_PROTOCOL: STRING>>,
      PLATFORM: STRUCT<ILLUMINA: STRUCT<INSTRUMENT_MODEL: STRING>>>,
    STUDY STRUCT<_accession: STRING, IDENTIFIERS: STRUCT<EXTERNAL_ID: ARRAY<{_TEXT_REF}>>>,
    SAMPLE STRUCT<
      _accession: STRING, DESCRIPTION: STRING,
      SAMPLE_NAME: STRUCT<SCIENTIFIC_NAME: STRING>,
      IDENTIFIERS: STRUCT<EXTERNAL_ID: ARRAY<{_TEXT_REF}>>,
      SAMPLE_ATTRIBUTES: STRUCT<SAMPLE_ATTRIBUTE: ARRAY<STRUCT<TAG: STRING, VALUE: STRING>>>>,
    RUN_SET STRUCT<RUN: ARRAY<STRUCT<
      _accession: STRING, _total_spots: BIGINT, _total_bases: BIGINT,
      SRAFiles: STRUCT<SRAFile: ARRAY<STRUCT<
        _semantic_name: STRING, _url: STRING, _size: BIGINT, _md5: STRING>>>>>>
"""


def read_experiments(spark: SparkSession, path: str) -> DataFrame:
    """One row per run of every experiment package."""
    raw = spark.read.format("xml").schema(EXPERIMENT).option("rowTag", "EXPERIMENT_PACKAGE").load(path)
    library = "e.DESIGN.LIBRARY_DESCRIPTOR"
    biosample = F.filter("s.IDENTIFIERS.EXTERNAL_ID", lambda x: x["_namespace"] == "BioSample")
    tags = F.coalesce(F.col("s.SAMPLE_ATTRIBUTES.SAMPLE_ATTRIBUTE"), F.expr(
        "CAST(array() AS ARRAY<STRUCT<TAG: STRING, VALUE: STRING>>)"))
    layout = (
        F.when(F.col(f"{library}.LIBRARY_LAYOUT.PAIRED").isNotNull(), "PAIRED")
        .when(F.col(f"{library}.LIBRARY_LAYOUT").isNotNull(), "SINGLE"))
    named = raw.select(
        F.col("EXPERIMENT").alias("e"), F.col("STUDY").alias("st"), F.col("SAMPLE").alias("s"),
        F.explode("RUN_SET.RUN").alias("r"))
    return named.select(
        F.col("r._accession").alias("run"),
        F.col("e._accession").alias("experiment"),
        F.get(biosample, F.lit(0))["_VALUE"].alias("sample"),
        F.col("s._accession").alias("archive_sample"),
        F.coalesce("e.STUDY_REF._accession", "st._accession").alias("study"),
        F.col("s.DESCRIPTION").alias("sample_description"),
        F.col("s.SAMPLE_NAME.SCIENTIFIC_NAME").alias("organism"),
        F.col("e.DESIGN.DESIGN_DESCRIPTION").alias("design"),
        F.col(f"{library}.LIBRARY_STRATEGY").alias("strategy"),
        F.col(f"{library}.LIBRARY_SOURCE").alias("library_source"),
        F.col(f"{library}.LIBRARY_SELECTION").alias("selection"),
        layout.alias("layout"),
        F.array_compact(F.array(
            f"{library}.LIBRARY_STRATEGY", f"{library}.LIBRARY_SELECTION",
            f"{library}.LIBRARY_CONSTRUCTION_PROTOCOL")).alias("library_texts"),
        F.col("e.PLATFORM.ILLUMINA.INSTRUMENT_MODEL").alias("instrument"),
        F.map_from_arrays(
            F.array_distinct(F.transform(tags, lambda t: t["TAG"])),
            F.transform(F.array_distinct(F.transform(tags, lambda t: t["TAG"])), lambda k: F.element_at(
                F.filter(tags, lambda t: t["TAG"] == k), -1)["VALUE"])).alias("attributes"),
        F.col("r._total_spots").alias("total_spots"),
        F.col("r._total_bases").alias("total_bases"),
        F.col("r.SRAFiles.SRAFile").alias("files"),
    )


def normalized_file(experiments: DataFrame, name: str = "SRA Normalized") -> DataFrame:
    """The one archive file of that name per run; ``problem`` if not exactly one."""
    wanted = F.filter("files", lambda f: f["_semantic_name"] == name)
    one = F.get(wanted, F.lit(0))
    return experiments.select(
        "run", one["_url"].alias("url"), one["_size"].alias("size_bytes"), one["_md5"].alias("md5"),
        F.when(F.coalesce(F.size(wanted), F.lit(0)) != 1, "file entry is not unique").alias("problem"))


def read_archive_tables(spark: SparkSession, path: str) -> DataFrame:
    """``name, rows`` of every archive table."""
    schema = "_name STRING, Statistics STRUCT<Rows: STRUCT<_count: BIGINT>>"
    return spark.read.format("xml").schema(schema).option("rowTag", "Table").load(path).where(
        "Statistics.Rows IS NOT NULL").select(
        F.col("_name").alias("name"), F.col("Statistics.Rows._count").alias("rows"))


RUN_REPORT = """
    run_accession STRING, experiment_accession STRING, sample_accession STRING,
    study_accession STRING, secondary_study_accession STRING, instrument_model STRING,
    fastq_bytes STRING, fastq_md5 STRING, fastq_ftp STRING
"""


def read_run_report(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(RUN_REPORT).option("multiLine", "true").json(path)
    return raw.withColumnsRenamed({
        "run_accession": "run", "experiment_accession": "experiment",
        "sample_accession": "sample", "secondary_study_accession": "study",
        "study_accession": "project"})


def read_gene_list(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Tab-separated gene lists in one scan: ``file, line_number, id, kind, position, description``."""
    from locusframe.sources.lines import numbered_lines

    lines = numbered_lines(spark, path).where(F.trim("value") != "")
    c = F.split("value", "\t")
    chromosome = F.replace(F.regexp_extract(F.get(c, F.lit(2)), "^([^:]+):", 1),
                           F.lit("complement("), F.lit(""))
    return lines.select(
        "file", "line_number", F.get(c, F.lit(0)).alias("id"), F.get(c, F.lit(1)).alias("kind"),
        F.get(c, F.lit(2)).alias("position"), F.get(c, F.lit(3)).alias("description"),
        F.when(chromosome != "", chromosome).alias("chromosome"))


def read_tool_summary(spark: SparkSession, path: str) -> DataFrame:
    """``metric, value`` out of ``Name: number`` lines of an aligner summary."""
    pattern = r"^\s*([A-Za-z][A-Za-z >0-9_-]*):\s*([0-9.]+)%?"
    name = F.lower(F.trim(F.regexp_extract("value", pattern, 1)))
    return spark.read.text(path).where(F.col("value").rlike(pattern)).select(
        F.replace(F.replace(name, F.lit(" "), F.lit("_")), F.lit(">"), F.lit("gt")).alias("metric"),
        F.regexp_extract("value", pattern, 2).cast("double").alias("value"))


def require_runs(experiments: DataFrame, runs: list[str]) -> None:
    """Fail if a wanted run is not in the archive metadata."""
    found = {r["run"] for r in experiments.where(F.col("run").isin(*runs)).select("run").distinct().collect()}
    if missing := sorted(set(runs) - found):
        raise ContractError(f"runs are missing from the archive metadata: {', '.join(missing)}")
