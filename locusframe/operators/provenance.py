"""Run tables: identity, catalogue, acceptance and repeatability."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Run types and the artifacts each type must list.
BASELINE, CANDIDATES, UNSUPPORTED = "baseline", "candidate_windows", "unsupported"
REQUIRED_ARTIFACTS = {
    BASELINE: (
        "functional_entities.json", "functional_entities.tsv", "intergenic_regions.json",
        "intergenic_regions.tsv", "terminal_regions.json", "terminal_regions.tsv",
        "statistics.json", "diagnostics.json", "baseline_report.md"),
    CANDIDATES: (
        "candidate_windows.json", "candidate_windows.tsv", "excluded_regions.json",
        "excluded_regions.tsv", "statistics.json", "candidate_windows_report.md"),
}
REASON_SCHEMA = "unrecognized or unsupported run_manifest schema"
REASON_HASH = "one or more artifacts do not match the hashes recorded in run_manifest.json"


def run_id(material: DataFrame, key: Sequence[str], prefix: str) -> DataFrame:
    """Content-addressed id from ``key, name, value`` facts.

    Facts are hashed in the order of their names, so the same content always
    gives the same id.  A run has a handful of facts (inputs, parameters).
    """
    facts = F.array_sort(F.collect_list(F.struct("name", "value")))
    digest = F.sha2(F.to_json(facts), 256)
    return material.groupBy(*key).agg(
        F.concat(F.lit(f"{prefix}-"), F.substring(digest, 1, 16)).alias("run_id"))


def run_type(runs: DataFrame) -> Column:
    """Type from the fields a manifest has."""
    child = F.col("parent_run_id").isNotNull()
    return (
        F.when(child & F.col("rule_version").isNotNull(), CANDIDATES)
        .when((F.col("schema_version") == 2) & F.col("target_strain").isNotNull() & ~child, BASELINE)
        .otherwise(UNSUPPORTED)
    )


def artifact_verdicts(artifacts: DataFrame, identities: DataFrame) -> DataFrame:
    """Declared artifacts against observed size and digest.

    Both tables have ``run_id, name, size_bytes, sha256``.  They hold a row per
    file, which no estimate made from a listing of runs shows: they meet in a
    sort-merge join and are never broadcast.
    """
    seen = identities.select(
        "run_id", "name", F.col("size_bytes").alias("actual_size"), F.col("sha256").alias("actual_sha256"))
    matches = (F.col("size_bytes") == F.col("actual_size")) & (F.col("sha256") == F.col("actual_sha256"))
    return artifacts.join(seen.hint("merge"), ["run_id", "name"], "left").withColumn(
        "matches", F.coalesce(matches, F.lit(False)))


def _artifact_names(artifacts: DataFrame) -> DataFrame:
    """Artifacts are files, or folders of part files: the first part of the path names them."""
    return artifacts.select("run_id", F.substring_index("name", "/", 1).alias("name")).distinct()


def catalog(
    runs: DataFrame, artifacts: DataFrame, identities: DataFrame, acceptance: DataFrame
) -> DataFrame:
    """Every run with its type, statuses, and whether it may be shown.

    The first failing reason is reported: required artifact missing, run not
    complete, digest mismatch.  An acceptance row with the run's id overrides
    the statuses of the manifest.
    """
    typed = runs.withColumn("run_type", run_type(runs))
    listed = artifact_verdicts(artifacts, identities)
    required = F.array(*[
        F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("name"))
        for kind, names in REQUIRED_ARTIFACTS.items() for name in names])
    wanted = typed.select("run_id", "run_type", F.explode(required).alias("r")).where(
        F.col("r.kind") == F.col("run_type")).select("run_id", F.col("r.name").alias("name"))
    missing = wanted.join(_artifact_names(artifacts).hint("merge"), ["run_id", "name"], "left_anti").groupBy(
        "run_id").agg(F.count(F.lit(1)).alias("missing"))
    verified = listed.groupBy("run_id").agg(F.bool_and("matches").alias("verified"))
    ruled = acceptance.select(
        "run_id", F.col("verification_status").alias("a_verification"),
        F.col("scientific_acceptance_status").alias("a_scientific"))
    joined = (
        typed.join(missing.hint("merge"), "run_id", "left").join(verified.hint("merge"), "run_id", "left")
        .join(ruled.hint("merge"), "run_id", "left"))
    lacking = F.coalesce("missing", F.lit(0)) > 0
    done = F.coalesce("execution_status", F.lit("unknown")) == "complete"
    good = F.coalesce("verified", F.lit(True))
    reason = (
        F.when(F.col("run_type") == UNSUPPORTED, REASON_SCHEMA)
        .when(lacking, F.format_string("run_manifest is missing %d required artifact entries", "missing"))
        .when(~done, F.format_string(
            "execution_status=%s, not complete", F.coalesce("execution_status", F.lit("unknown"))))
        .when(~good, REASON_HASH)
        .otherwise("ok")
    )
    return joined.select(
        "run_id", "run_type", "parent_run_id",
        F.coalesce("execution_status", F.lit("unknown")).alias("execution_status"),
        F.coalesce("a_verification", "verification_status", F.lit("unknown")).alias("verification_status"),
        F.coalesce("a_scientific", "scientific_acceptance_status", F.lit("unknown"))
        .alias("scientific_acceptance_status"),
        (reason == "ok").alias("displayable"), reason.alias("reason"))


def missing_artifacts(runs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Names of required artifacts that a run's manifest does not list."""
    typed = runs.select("run_id", run_type(runs).alias("run_type"))
    required = F.array(*[
        F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("name"))
        for kind, names in REQUIRED_ARTIFACTS.items() for name in names])
    wanted = typed.select("run_id", "run_type", F.explode(required).alias("r")).where(
        F.col("r.kind") == F.col("run_type")).select("run_id", F.col("r.name").alias("name"))
    return wanted.join(_artifact_names(artifacts).hint("merge"), ["run_id", "name"], "left_anti")


def displayable(entries: DataFrame, kind: str | None = None) -> DataFrame:
    shown = entries.where("displayable")
    return shown if kind is None else shown.where(F.col("run_type") == kind)


def status_banner(entries: DataFrame, runs: DataFrame) -> DataFrame:
    """The status facts to show with any result of a run."""
    facts = [c for c in ("target_strain", "run_purpose") if c in runs.columns]
    return entries.select(
        "run_id", "run_type", "execution_status", "verification_status",
        "scientific_acceptance_status",
    ).join(runs.select("run_id", *facts).hint("merge"), "run_id")


def with_parent(entries: DataFrame) -> DataFrame:
    """Candidate runs next to the baseline run they were made from."""
    parent = entries.where(F.col("run_type") == BASELINE).select(
        F.col("run_id").alias("parent_run_id"),
        F.col("execution_status").alias("parent_status"),
        F.col("displayable").alias("parent_displayable"))
    return entries.where(F.col("run_type") == CANDIDATES).join(parent.hint("merge"), "parent_run_id", "left")


def parent_inputs(runs: DataFrame, inputs: DataFrame) -> DataFrame:
    """Candidate runs whose parent is incomplete or used another sequence file.

    ``inputs`` has ``run_id, role, sha256``.
    """
    fasta = inputs.where("role = 'fasta'").select("run_id", "sha256")
    own = runs.where("parent_run_id IS NOT NULL").select("run_id", "parent_run_id").join(
        fasta.hint("merge"), "run_id", "left")
    parent = runs.select(
        F.col("run_id").alias("parent_run_id"), F.col("execution_status").alias("parent_status")
    ).join(fasta.select(F.col("run_id").alias("parent_run_id"), F.col("sha256").alias("parent_sha256")).hint("merge"),
           "parent_run_id", "left")
    problem = (
        F.when(F.col("parent_status").isNull(), "parent run is missing")
        .when(F.col("parent_status") != "complete", "parent run is not complete")
        .when(F.col("parent_sha256").isNotNull()
              & ~F.col("sha256").eqNullSafe(F.col("parent_sha256")), "sequence file differs"))
    return own.join(parent.hint("merge"), "parent_run_id", "left").withColumn("problem", problem)


def acceptance_checks(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """``run_id, check, expected, observed, ok`` of two long fact tables."""
    facts = expected.join(observed, ["run_id", "check"], "full")
    return facts.withColumn("ok", F.coalesce(F.col("expected") == F.col("observed"), F.lit(False)))


def accepted(checks: DataFrame) -> DataFrame:
    return checks.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("checks"), F.count_if(~F.col("ok")).alias("failed"),
        F.bool_and("ok").alias("accepted"))


def repeatability(left: DataFrame, right: DataFrame) -> DataFrame:
    """Per file of two runs: same digest, other digest, or on one side only."""
    l = left.select("name", F.col("sha256").alias("left_sha256"))
    r = right.select("name", F.col("sha256").alias("right_sha256"))
    status = (
        F.when(F.col("right_sha256").isNull(), "left_only")
        .when(F.col("left_sha256").isNull(), "right_only")
        .when(F.col("left_sha256") == F.col("right_sha256"), "identical")
        .otherwise("different"))
    return l.join(r, "name", "full").withColumn("status", status)


def evidence_chain(
    acceptance: DataFrame, manifests: DataFrame, artifacts: DataFrame, identities: DataFrame
) -> DataFrame:
    """Walk from acceptance to run manifest to artifacts by digest.

    ``acceptance``: ``label, manifest_sha256``; ``manifests``: ``sha256,
    run_id``; the other two as in :func:`artifact_verdicts`.
    """
    linked = acceptance.join(
        manifests.select(F.col("sha256").alias("manifest_sha256"), "run_id").hint("merge"), "manifest_sha256", "left")
    verdicts = artifact_verdicts(artifacts, identities).groupBy("run_id").agg(
        F.count(F.lit(1)).alias("artifacts"), F.count_if("matches").alias("verified"))
    return linked.join(verdicts.hint("merge"), "run_id", "left").select(
        "label", "run_id",
        F.coalesce("artifacts", F.lit(0)).alias("artifacts"),
        F.coalesce("verified", F.lit(0)).alias("verified"),
        (F.col("run_id").isNotNull() & F.coalesce(
            F.col("artifacts") == F.col("verified"), F.lit(False))).alias("intact"))


def step_log(steps: DataFrame, key: Sequence[str], expected: int | None = 3) -> DataFrame:
    """Per run: do the steps exit with 0, run forward, and not overlap?

    ``steps`` has ``key, step, started, completed, exit_code``; ``step`` counts
    from 1, so a step meets its successor through an equality join on its
    number instead of a window over the whole log.
    """
    key = list(key)
    following = steps.select(
        *key, (F.col("step") - 1).alias("step"), F.col("started").alias("next_started"))
    chained = steps.join(following, [*key, "step"], "left")
    overlaps = F.coalesce(F.col("completed") > F.col("next_started"), F.lit(False))
    backwards = ~F.coalesce(F.col("started") <= F.col("completed"), F.lit(False))
    counted = chained.groupBy(*key).agg(
        F.count(F.lit(1)).alias("steps"),
        F.count_if(F.col("exit_code") != 0).alias("failed_steps"),
        F.count_if(backwards).alias("backward_steps"),
        F.count_if(overlaps).alias("overlapping_steps"))
    bad = F.col("failed_steps") + F.col("backward_steps") + F.col("overlapping_steps")
    right_size = F.lit(True) if expected is None else F.col("steps") == expected
    return counted.withColumn("valid", (bad == 0) & right_size)
