"""Tables published by manifest: write beside, audit, then switch.

A table is a set of partition folders, and a manifest that says which of them count:

``<path>/batches/batch=<version>/<period>=<value>/part-*.parquet``
    rows of one period as one batch wrote them; never changed afterwards
``<path>/manifests/version=<version>/part-*.parquet``
    one row a period: its value and the batch that holds it; and what the table was made from

A batch first writes the periods it touches into a folder of its own, which no reader sees.  The candidate can be read
and checked as the table it would become.  Publishing writes one small manifest file, which a rename makes visible as a
whole; a job that fails before that leaves the table as it was.  Readers resolve the newest manifest once and keep
reading its files while later ones are published.  :func:`expire` removes what no kept manifest names.

Periods are months or cutoffs, so a manifest has at most a calendar's rows.  A table has one writer at a time; a second
one that starts from the same version fails when it publishes, because that version then exists.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wellpanel.session import STORED, durable
from wellpanel.sources.tables import merge_by_key, read_table

NO_PERIOD = "__HIVE_DEFAULT_PARTITION__"


@dataclass(frozen=True)
class Snapshot:
    """Which batch holds each period; ``version`` 0 is the table before its first batch."""

    path: str
    period: str
    version: int
    batches: tuple[tuple[str, int], ...]  # (period value, batch), in order
    made_from: str | None = None  # the state of its inputs, in words of the job that publishes

    def folders(self, wanted: set[str] | None = None) -> list[str]:
        return [f"{self.path}/batches/batch={b:06d}/{self.period}={v}" for v, b in self.batches if wanted is None or v in wanted]


def _manifests(spark: SparkSession, path: str) -> DataFrame | None:
    return read_table(spark, f"{path}/manifests")


def at_version(spark: SparkSession, path: str, version: int, period: str = "production_month") -> Snapshot | None:
    """A published state, unless it is not kept any more."""
    manifests = _manifests(spark, path)
    if manifests is None:
        return None
    # one row a period of the calendar
    rows = manifests.filter(F.col("version") == version).collect()
    if not rows:
        return None
    return Snapshot(path, period, version, tuple(sorted((r.value, r.batch) for r in rows if r.value is not None)), getattr(rows[0], "made_from", None))


def current(spark: SparkSession, path: str, period: str = "production_month") -> Snapshot:
    """The newest published state."""
    manifests = _manifests(spark, path)
    newest = None if manifests is None else manifests.agg(F.max("version")).first()[0]
    return Snapshot(path, period, 0, ()) if newest is None else at_version(spark, path, int(newest), period)


def rewritten(before: Snapshot, after: Snapshot) -> set[str]:
    """Periods that any batch between two states wrote or dropped; the files of all others are the same."""
    return {value for value, _ in set(before.batches) ^ set(after.batches)}


def read(spark: SparkSession, snapshot: Snapshot, wanted: set[str] | None = None) -> DataFrame | None:
    """The rows of a snapshot, or of some of its periods; ``None`` while there are none.  Files of others stay closed."""
    folders = snapshot.folders(wanted)
    if not folders:
        return None
    rows = spark.read.option("mergeSchema", True).option("basePath", f"{snapshot.path}/batches").parquet(*folders)
    return rows.drop("batch")


def read_current(spark: SparkSession, path: str, period: str = "production_month") -> DataFrame | None:
    return read(spark, current(spark, path, period))


def stage(spark: SparkSession, batch: DataFrame, path: str, period: str = "production_month", keys: list[str] | None = None,
          removed: DataFrame | None = None, *, stored: bool = False, by_period: bool = False) -> Snapshot:
    """Write what ``batch`` changes beside the table and return the table it would make; nothing is published.

    Without ``keys`` every period in the batch is replaced whole; with them, rows of the same key are replaced within
    the periods the batch touches (the period must be a function of the key) and the other rows stay, but for
    those whose key and period ``removed`` lists.  Periods that neither names keep their files and are not opened.

    A batch is read several times.  ``stored`` says that it is a stored table, or columns computed from one, and need not
    be written for that; ``by_period``, that its files are those of single periods, so that a batch without rows to merge
    with is written as it is read, without a shuffle.
    """
    before = current(spark, path, period)
    version = before.version + 1
    folder = f"{path}/batches/batch={version:06d}"
    rows, touched = batch, set()
    if keys is not None:
        batch = batch if stored else durable(batch)
        periods = batch.select(period) if removed is None else batch.select(period).union(removed.select(period))
        touched = {r[0] or NO_PERIOD for r in periods.select(F.col(period).cast("string")).distinct().collect()}  # calendar periods
        kept = read(spark, before, touched)
        if kept is not None and removed is not None:
            kept = kept.join(removed.select(*keys, period), [*keys, period], "left_anti")
        rows = batch if kept is None else merge_by_key(kept, batch, [*keys, period])
    # a leftover of an attempt that was never published is overwritten; the rebalance splits a period that is most of it
    dealt = rows if by_period and rows is batch else rows.hint("rebalance", period)
    dealt.write.options(**STORED).mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(period).parquet(folder)
    written = read_table(spark, folder)
    values = set() if written is None else {r[0] or NO_PERIOD for r in written.select(F.col(period).cast("string")).distinct().collect()}
    kept = [(v, b) for v, b in before.batches if v not in values | touched]
    return Snapshot(path, period, version, tuple(sorted([*kept, *[(v, version) for v in values]])))


def publish(spark: SparkSession, snapshot: Snapshot) -> None:
    """Make a staged snapshot the table, by one file."""
    named = [(value, batch, snapshot.made_from) for value, batch in snapshot.batches or ((None, None),)]
    rows = spark.createDataFrame(named, "value string, batch long, made_from string")
    rows.coalesce(1).write.mode("errorifexists").parquet(f"{snapshot.path}/manifests/version={snapshot.version:06d}")


def replace_periods(spark: SparkSession, batch: DataFrame, path: str, period: str = "production_month") -> None:
    """Every period of the batch is replaced whole, all of them at one moment."""
    publish(spark, stage(spark, batch, path, period))


def upsert_periods(spark: SparkSession, batch: DataFrame, path: str, keys: list[str], period: str = "production_month", *,
                   stored: bool = False, by_period: bool = False) -> None:
    """Upsert by key, visible at one moment; ``stored`` and ``by_period`` as in :func:`stage`."""
    publish(spark, stage(spark, batch, path, period, keys, stored=stored, by_period=by_period))


def _children(spark: SparkSession, folder: str) -> list[str]:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in files.listStatus(path) if s.isDirectory()] if files.exists(path) else []


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder on whatever store its path names."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def expire(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Remove all but the ``keep`` newest manifests, and every period folder that none of those names.

    Folders of batches that were staged and never published go as well.  Readers of an older snapshot must be done.
    """
    manifests = _manifests(spark, path)
    known = [] if manifests is None else sorted(r[0] for r in manifests.select("version").distinct().collect())
    kept = known[-keep:]
    removed = [f"{path}/manifests/version={v:06d}" for v in known[:-keep]]
    named = set() if not kept else {(r.batch, r.value) for r in manifests.filter(F.col("version").isin(kept)).select("batch", "value").distinct().collect()}
    used = {b for b, _ in named}
    for name in _children(spark, f"{path}/batches"):
        batch = int(name.partition("=")[2])
        if batch not in used:
            removed.append(f"{path}/batches/{name}")
        else:
            periods = _children(spark, f"{path}/batches/{name}")
            removed += [f"{path}/batches/{name}/{p}" for p in periods if "=" in p and (batch, p.partition("=")[2]) not in named]
    for folder in removed:
        remove(spark, folder)
    return removed
