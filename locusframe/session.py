"""Session settings and reliable lineage cuts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Runtime settings every job relies on.  Adaptive execution sizes the reduce
# side from measured map output and splits skewed join partitions; the forced
# form also splits them below a window or an aggregate.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # What one task sorts or groups does not grow with the input: a task reads this much of a file or an exchange.
    "spark.sql.files.maxPartitionBytes": "32m",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    "spark.sql.session.timeZone": "UTC",
}


def apply_settings(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session and return it."""
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    return spark


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp()  # the driver's own: executors fetch the archive from the driver
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = Path(folder, f"{package.name}-{context.applicationId}.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The reliable folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session that names none gets a temporary folder; a cluster
    must name a shared one, because an executor's disk is lost with it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder once and read it back.

    For tables that several branches of a job read: the branches then scan
    columnar files instead of repeating the work, and a lost executor costs a
    re-read only.
    """
    path = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, max_rows: int = 1_000_000) -> DataFrame:
    """Broadcast a *written* table of narrow rows, if a count proves it small.

    Without the hint both sides of a join are shuffled before their sizes are
    known; a table above the bound is joined that way.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def spread(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Repartition input that has fewer partitions than the cluster has slots.

    A gzip file or a file with one row group is read by one task, and narrow
    work after it would stay there.  Input with enough splits is left alone.
    ``partitions`` are those of the scan; without them ``df`` must be a scan,
    as counting the partitions of anything wider would run its shuffles.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    known = df.rdd.getNumPartitions() if partitions is None else partitions
    return df.repartition(slots) if known < slots else df
