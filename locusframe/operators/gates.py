"""Qualification gates over source metadata and evidence summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.functions.text import iso_date

# Reason texts of the source qualification.
REASON_UNAVAILABLE = "source file could not be obtained or verified"
REASON_MIRROR = "same upstream annotation or coordinate mirror; not independent evidence"
REASON_STRAIN = "different strain; cannot directly define %s primary-coordinate boundaries"
REASON_PARTIAL = "systematic partial gene boundaries exceed 50 percent"
REASON_SPACE = "requires explicit mapping to the locked primary assembly"
REASON_METADATA = "metadata does not provide an independently qualified boundary file"
REASON_GOOD = "same primary coordinate space with sufficiently explicit boundaries"


def source_status(sources: DataFrame, strain: str, coordinate_space: str) -> DataFrame:
    """Status and ordered reasons of annotation sources.

    ``sources`` has ``source_id, availability, relationship, expected_use,
    strain, coordinate_space, partial_gene_fraction``.
    """
    reasons = F.array_compact(F.array(
        F.when(F.contains("relationship", F.lit("mirror"))
               | (F.col("expected_use") == "mirror_detection_only"), REASON_MIRROR),
        F.when(F.col("strain") != strain, REASON_STRAIN % strain),
        F.when(F.col("partial_gene_fraction") > 0.5, REASON_PARTIAL),
        F.when(F.col("coordinate_space") != coordinate_space, REASON_SPACE),
        F.when(F.col("availability") == "metadata_only", REASON_METADATA),
    ))
    gone = F.col("availability") == "unavailable"
    return sources.withColumn("reasons", reasons).withColumns({
        "qualification_status": F.when(gone, "unavailable")
        .when(F.size("reasons") > 0, "unqualified").otherwise("qualified"),
        "qualification_reasons": F.when(gone, F.array(F.lit(REASON_UNAVAILABLE)))
        .when(F.size("reasons") > 0, F.col("reasons")).otherwise(F.array(F.lit(REASON_GOOD))),
    }).drop("reasons")


def source_summary(
    sources: DataFrame, profiles: DataFrame, identities: DataFrame,
    strain: str, coordinate_space: str,
) -> DataFrame:
    """Sources with file verdicts, profile and qualification status."""
    files = identities.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("declared_files"), F.count_if("matches").alias("verified_files"))
    joined = sources.join(files, "source_id", "left").join(profiles, "source_id", "left")
    return source_status(joined, strain, coordinate_space)


def mirror_groups(sources: DataFrame) -> DataFrame:
    """Sources that share an independence group with a non-mirror source."""
    is_mirror = F.contains("relationship", F.lit("mirror"))
    return sources.groupBy("independence_group").agg(
        F.count(F.lit(1)).alias("source_count"),
        F.count_if(is_mirror).alias("mirror_count"),
    ).withColumn("explicit", F.col("source_count") - F.col("mirror_count") == 1)


# --- long gate tables ------------------------------------------------------

def gate_rows(records: DataFrame, key: Sequence[str], tests: Mapping[str, Column]) -> DataFrame:
    """Turn status columns into long rows ``key, gate, status``."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(name).alias("gate"), status.alias("status")) for name, status in tests.items()]))
    return records.select(*key, pairs.alias("g")).select(*key, "g.gate", "g.status")


def passed(test: Column, otherwise: str = "not-passed") -> Column:
    return F.when(F.coalesce(test, F.lit(False)), "passed").otherwise(otherwise)


def eligible(gates: DataFrame, key: Sequence[str]) -> DataFrame:
    """A source is eligible only if every one of its gates passed."""
    return gates.groupBy(*key).agg(
        F.count(F.lit(1)).alias("gate_count"),
        F.count_if(F.col("status") == "passed").alias("passed_count"),
        F.bool_and(F.col("status") == "passed").alias("eligible"),
    ).withColumn("scientific_acceptance_status", F.when(F.col("eligible"), "accepted").otherwise("blocked"))


def metadata_contract(observed: DataFrame, expected: DataFrame, key: Sequence[str]) -> DataFrame:
    """``key, check, expected, observed, ok`` for long observed and expected tables."""
    return expected.select(*key, "check", "expected").join(
        observed.select(*key, "check", "observed"), [*key, "check"], "left"
    ).withColumn("ok", F.coalesce(F.col("expected") == F.col("observed"), F.lit(False)))


def observed_checks(records: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Unpivot record columns into ``key, check, observed``."""
    return records.select(*key, *[F.col(c).cast("string").alias(c) for c in columns]).unpivot(
        list(key), list(columns), "check", "observed")


def replication(
    samples: DataFrame, key: Sequence[str], at_least: int = 2, exactly: int | None = None
) -> DataFrame:
    """Replicate gate: distinct samples that carry a replicate label.

    ``samples`` has ``key, sample, replicate``; distinct pairs are formed
    first, so one large study is counted in parallel.
    """
    labelled = samples.where(
        F.col("sample").isNotNull() & (F.coalesce("replicate", F.lit("")) != ""))
    distinct = labelled.select(*key, "sample").distinct().groupBy(*key).agg(
        F.count(F.lit(1)).alias("sample_count"))
    counted = samples.select(*key).distinct().join(distinct, list(key), "left").withColumn(
        "sample_count", F.coalesce("sample_count", F.lit(0)))
    wanted = F.col("sample_count") >= at_least if exactly is None else F.col("sample_count") == exactly
    return counted.withColumn("status", passed(wanted))


def temporal_independence(records: DataFrame, sample_date: str, release_date: str) -> DataFrame:
    """Passed if the sample is later than the annotation release."""
    later = iso_date(sample_date) > iso_date(release_date)
    return records.withColumn("status", passed(later, "unavailable"))


def accession_links(
    archive: DataFrame, report: DataFrame, expected: DataFrame, key: str = "run",
    facts: Sequence[str] = ("experiment", "sample", "study"),
) -> DataFrame:
    """Cross-file accession consistency of every expected run.

    The three tables share ``run`` and the ``facts``, to which project and
    publication can be added; a run fails if any file lacks it or names
    another accession.
    """
    named = expected
    for name, table in (("archive", archive), ("report", report)):
        named = named.join(
            table.select(key, F.struct(*facts).alias(name)), key, "left")
    own = F.struct(*facts)
    return named.select(
        key, *facts,
        F.coalesce(F.col("archive") == own, F.lit(False)).alias("archive_ok"),
        F.coalesce(F.col("report") == own, F.lit(False)).alias("report_ok"),
    ).withColumn("consistent", F.col("archive_ok") & F.col("report_ok"))


def declared_bytes(records: DataFrame, column: str) -> DataFrame:
    """Sum of semicolon-separated byte lists."""
    parts = F.transform(F.split(column, ";"), lambda x: F.coalesce(x.try_cast("bigint"), F.lit(0)))
    total = F.aggregate(parts, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return records.agg(F.coalesce(F.sum(total), F.lit(0)).alias("declared_total_bytes"))


# --- evidence --------------------------------------------------------------

def engineering_screen(
    totals: DataFrame, max_all: float, max_unmapped: float, max_outlier: float,
    key: Sequence[str] = ("run_id",),
) -> DataFrame:
    """Three fractions against three limits, one row per run.

    ``totals`` has ``total_query_pairs, pair_unmapped, vector_pairs_all,
    vector_pairs_unmapped, nuclear_bins, nuclear_outlier_bins``.
    """
    def share(part: str, whole: str) -> Column:
        return F.coalesce(F.try_divide(F.col(part).cast("double"), F.col(whole)), F.lit(0.0))

    return totals.select(
        *key,
        share("vector_pairs_all", "total_query_pairs").alias("vector_fraction_all"),
        share("vector_pairs_unmapped", "pair_unmapped").alias("vector_fraction_unmapped"),
        share("nuclear_outlier_bins", "nuclear_bins").alias("outlier_fraction"),
    ).withColumns({
        "global_vector_signal": (F.col("vector_fraction_all") >= max_all)
        | (F.col("vector_fraction_unmapped") >= max_unmapped),
        "widespread_high_depth": F.col("outlier_fraction") >= max_outlier,
    }).withColumn(
        "conclusion",
        F.when(F.col("global_vector_signal") | F.col("widespread_high_depth"),
               "global or widespread signal detected").otherwise("no global signal"))


def capabilities(evidence: DataFrame, key: Sequence[str] = ("run_id",)) -> DataFrame:
    """The eight evidence capabilities of a run as long rows.

    ``evidence`` has ``nuclear_all_covered, with_unique_fragment_support,
    classification_complete, pair_multiplicity_unknown, conclusion``.
    """
    clear = F.col("conclusion") == "no global signal"
    sorted_out = F.col("classification_complete") & (F.col("pair_multiplicity_unknown") == 0)
    return gate_rows(evidence, key, {
        "coordinate_coverage": passed(F.col("nuclear_all_covered"), "failed"),
        "splice_support": passed(F.col("with_unique_fragment_support") > 0, "failed"),
        "strand_support": F.lit("unavailable"),
        "boundary_support": F.lit("not-authorized"),
        "strain_specific_support": F.lit("unavailable"),
        "biological_replication": F.lit("single-replicate-only"),
        "unique_multi_unmapped_classification": passed(sorted_out, "partial"),
        "engineering_screen": F.when(clear, "passed-with-explicit-local-exclusions").otherwise("failed"),
    })


def chromosome_compatibility(
    classified: DataFrame, windows: DataFrame, minimum_identity: float
) -> DataFrame:
    """One row: compatible chromosomes, covered windows and the joint status.

    ``windows`` lists every designed ``seqid, window``.
    """
    good = F.col("coordinate_valid") & (F.col("reference_identity") >= minimum_identity)
    seen = classified.groupBy("seqid", "window").agg(
        F.count(F.lit(1)).alias("records"), F.bool_or(F.coalesce(good, F.lit(False))).alias("good"))
    designed = windows.select("seqid", "window").join(seen, ["seqid", "window"], "left")
    per_sequence = designed.groupBy("seqid").agg(
        F.bool_or(F.coalesce("good", F.lit(False))).alias("compatible"),
        F.count(F.lit(1)).alias("windows"),
        F.count_if(F.col("records") > 0).alias("windows_with_records"))
    totals = per_sequence.agg(
        F.count_if("compatible").alias("compatible_sequences"),
        F.count(F.lit(1)).alias("sequences"),
        F.sum("windows").alias("windows"),
        F.sum("windows_with_records").alias("windows_with_records"))
    chromosome = F.when(F.col("compatible_sequences") == F.col("sequences"), "passed").otherwise("failed")
    coverage = (
        F.when(F.col("windows_with_records") == F.col("windows"), "passed")
        .when(F.col("windows_with_records") > 0, "partial").otherwise("failed"))
    return totals.withColumns({
        "chromosome_coordinate_probe": chromosome, "window_coverage": coverage,
    }).withColumn(
        "coordinate_compatibility",
        F.when(F.col("chromosome_coordinate_probe") == "passed", F.col("window_coverage"))
        .otherwise("failed"))


def applicability(sources: DataFrame, compatibility: DataFrame) -> DataFrame:
    """Applicability row of each source with the probe's compatibility."""
    return sources.select("source_id", "strain", "license_assignment").withColumns({
        "exact_target_strain_coordinates": F.lit(False),
        "independence_from_current_annotation": F.lit("not-passed"),
        "strand_orientation": F.lit("unavailable"),
        "true_unmappable": F.lit("unavailable"),
        "contamination": F.lit("unavailable"),
        "coordinate_compatibility": compatibility.select("coordinate_compatibility").scalar(),
        "eligible_as_independent_transcript_source": F.lit(False),
    })


def probe_coverage(
    mapped: DataFrame, sequences: DataFrame, per_sequence: int = 9
) -> DataFrame:
    """Per source sequence: probe records and whether all three windows occur."""
    seen = mapped.groupBy(F.col("source_seqid").alias("seqid")).agg(
        F.count(F.lit(1)).alias("records"),
        F.countDistinct("window_position").alias("positions"))
    return sequences.select("seqid").join(seen, "seqid", "left").select(
        "seqid", F.coalesce("records", F.lit(0)).alias("records"),
        F.coalesce("positions", F.lit(0)).alias("positions"),
    ).withColumn("complete", (F.col("records") == per_sequence) & (F.col("positions") == 3))


def archive_totals(tables: DataFrame, total_reads: int) -> DataFrame:
    """Primary and secondary rows of an archive and what no row accounts for."""
    def rows(name: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("name") == name, F.col("rows"))), F.lit(0))

    return tables.agg(
        rows("PRIMARY_ALIGNMENT").alias("primary_alignment_rows"),
        rows("SECONDARY_ALIGNMENT").alias("secondary_alignment_rows"),
    ).withColumns({
        "total_reads": F.lit(total_reads).cast("bigint"),
        "unmappable_or_not_primary_rows_estimate":
            F.greatest(F.lit(0), F.lit(total_reads) - F.col("primary_alignment_rows")),
    })
