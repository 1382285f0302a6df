"""Session defaults and the durable scratch area shared by every job."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Settings a panel job wants on a cluster.  AQE sizes the post-shuffle
#: partitions, so the initial count may be generous.  Every per-well group is
#: bounded by the number of calendar months, hence partitioning by well alone is
#: safe and lets a join on (well, month) reuse a shuffle on well.
#: A scan task types its rows and sorts them for the newest load, at about 280
#: bytes a row against 12 in a compressed file, so its share of a file is small.
#: Shuffled rows are wide text and hashed keys, which zstd stores in fewer bytes.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.files.maxPartitionBytes": "32m",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.io.compression.codec": "zstd",
}

def build_session(app: str = "wellpanel", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the defaults above; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and staged tables.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local session with
    nothing configured gets a temporary folder; a cluster without the setting is
    an error, because a machine-local path would not outlive its executor.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not _is_local(spark):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point the context at :func:`scratch_root` unless it already has a directory."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(scratch_root(spark))


#: Folders that staged tables go to while a job of :func:`job_scratch` runs; the innermost job is the last.
_JOBS: list[str] = []


def staging_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    ensure_checkpoint_dir(spark)
    root = _JOBS[-1] if _JOBS else spark.sparkContext.getCheckpointDir()
    return f"{root}/{name}-{uuid.uuid4().hex}"


@contextmanager
def job_scratch(spark: SparkSession, name: str = "job") -> Iterator[str]:
    """A folder for the staged tables of one job, removed when the job ends, well or not.

    What the job returns must not read from it any more.
    """
    folder = staging_path(spark, name)
    _JOBS.append(folder)
    try:
        yield folder
    finally:
        _JOBS.pop()
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: How layers are written: half of their bytes are digits of hashed keys, which only an entropy coder makes shorter.
STORED = {"compression": "zstd"}


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet below the shared folder and continue from there, with its columns prunable."""
    spark = df.sparkSession
    path = staging_path(spark, "durable")
    df.write.options(**STORED).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
