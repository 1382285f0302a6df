from __future__ import annotations

import random
from pathlib import Path

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from wellpanel.session import durable, job_scratch
from wellpanel.sources import published as PB

ROWS = "key string, production_month date, v int"


def rows_of(df):
    return set() if df is None else {(r["key"], str(r["production_month"]), r["v"]) for r in df.collect()}


def frame(spark, rows):
    return spark.createDataFrame([(k, m, v) for k, m, v in rows], "key string, production_month string, v int").withColumn("production_month", F.col("production_month").cast("date"))


def test_replace_and_upsert_equal_a_plain_dictionary(spark, tmp_path):
    """Random batches against plain Python; snapshots taken on the way stay readable until they expire."""
    rng, path, months = random.Random(3), str(tmp_path / "t"), [f"2020-0{k}-01" for k in range(1, 7)]
    model: dict[tuple, int] = {}
    snapshots = []
    for turn in range(7):
        batch = {(f"k{rng.randint(0, 9)}", m): rng.randint(0, 99) for m in rng.sample(months, rng.randint(1, 3)) for _ in range(3)}
        df = frame(spark, [(k, m, v) for (k, m), v in batch.items()])
        if turn % 2:
            PB.upsert_periods(spark, df, path, ["key"])
        else:
            PB.replace_periods(spark, df, path)
            model = {k: v for k, v in model.items() if k[1] not in {m for _, m in batch}}
        model |= batch
        want = {(k, m, v) for (k, m), v in model.items()}
        assert rows_of(PB.read_current(spark, path)) == want
        snapshots.append((PB.current(spark, path), want))
    for snapshot, want in snapshots:
        assert rows_of(PB.read(spark, snapshot)) == want
    assert PB.expire(spark, path, keep=2)
    for snapshot, want in snapshots[-2:]:
        assert rows_of(PB.read(spark, snapshot)) == want
    assert PB.expire(spark, path, keep=2) == []
    held = {(p.parent.name, p.name) for p in Path(path, "batches").glob("*/*=*")}
    assert held == {(f"batch={b:06d}", f"production_month={m}") for s, _ in snapshots[-2:] for m, b in s.batches}


def test_a_write_that_fails_midway_leaves_the_table(spark, tmp_path):
    path = str(tmp_path / "t")
    before = [("a", "2020-01-01", 1), ("b", "2020-02-01", 2)]
    PB.replace_periods(spark, frame(spark, before), path)
    bad = frame(spark, [(f"k{k}", "2020-01-01", k) for k in range(200)]).repartition(8)
    bad = bad.withColumn("v", F.when(F.col("v") == 137, F.raise_error(F.lit("broken row"))).otherwise(F.col("v")).cast("int"))
    for keys in (None, ["key"]):
        with pytest.raises(Exception, match="broken row"):
            PB.publish(spark, PB.stage(spark, bad, path, keys=keys))
        assert rows_of(PB.read_current(spark, path)) == set(before)
    # staged and checked, but never published
    PB.stage(spark, frame(spark, [("z", "2020-03-01", 9)]), path)
    assert rows_of(PB.read_current(spark, path)) == set(before)
    assert PB.expire(spark, path) == [f"{path}/batches/batch=000002"]
    assert rows_of(PB.read_current(spark, path)) == set(before)
    PB.replace_periods(spark, frame(spark, [("z", "2020-03-01", 9)]), path)
    assert rows_of(PB.read_current(spark, path)) == {*before, ("z", "2020-03-01", 9)}


def test_a_candidate_is_read_before_it_counts(spark, tmp_path):
    path = str(tmp_path / "t")
    assert PB.read_current(spark, path) is None and PB.expire(spark, path) == []
    PB.replace_periods(spark, frame(spark, [("a", "2020-01-01", 1), ("a", None, 7)]), path)
    candidate = PB.stage(spark, frame(spark, [("a", "2020-02-01", 2), ("b", None, 8)]), path)
    assert rows_of(PB.read(spark, candidate)) == {("a", "2020-01-01", 1), ("a", "2020-02-01", 2), ("b", "None", 8)}
    assert rows_of(PB.read_current(spark, path)) == {("a", "2020-01-01", 1), ("a", "None", 7)}
    PB.publish(spark, candidate)
    assert rows_of(PB.read_current(spark, path)) == rows_of(PB.read(spark, candidate))
    with pytest.raises(AnalysisException):  # a second writer that started from the same version
        PB.publish(spark, candidate)


def test_untouched_periods_stay_closed_and_columns_may_appear(spark, tmp_path):
    path = str(tmp_path / "t")
    PB.replace_periods(spark, frame(spark, [("a", "2020-01-01", 1), ("b", "2020-02-01", 2)]), path)
    wider = frame(spark, [("b", "2020-02-01", 3)]).withColumn("w", F.lit("new"))
    PB.upsert_periods(spark, wider, path, ["key"])
    assert {(r["key"], r.v, r.w) for r in PB.read_current(spark, path).collect()} == {("a", 1, None), ("b", 3, "new")}
    january = PB.read(spark, PB.current(spark, path), {"2020-01-01"})
    assert all("production_month=2020-01-01" in f for f in january.inputFiles())
    PB.replace_periods(spark, frame(spark, []), path)  # nothing changes, and nothing is lost
    assert PB.read_current(spark, path).count() == 2


def test_removed_keys_go_and_emptied_periods_with_them(spark, tmp_path):
    path = str(tmp_path / "t")
    PB.replace_periods(spark, frame(spark, [("a", "2020-01-01", 1), ("b", "2020-01-01", 2), ("c", "2020-02-01", 3)]), path)
    before = PB.current(spark, path)
    gone = frame(spark, [("b", "2020-01-01", 0), ("c", "2020-02-01", 0)])
    PB.publish(spark, PB.stage(spark, frame(spark, [("d", "2020-03-01", 4)]), path, keys=["key"], removed=gone))
    after = PB.current(spark, path)
    assert rows_of(PB.read(spark, after)) == {("a", "2020-01-01", 1), ("d", "2020-03-01", 4)}
    assert PB.rewritten(before, after) == {"2020-01-01", "2020-02-01", "2020-03-01"}
    assert PB.at_version(spark, path, before.version) == before and PB.at_version(spark, path, 9) is None


def test_staged_tables_of_a_job_are_gone_after_it(spark):
    with job_scratch(spark, "one") as folder:
        assert durable(spark.range(5)).count() == 5
        local = Path(folder.removeprefix("file:"))
        assert list(local.glob("durable-*"))
    assert not local.exists()
    with pytest.raises(ValueError), job_scratch(spark, "two") as folder:
        durable(spark.range(5))
        raise ValueError
    assert not Path(folder.removeprefix("file:")).exists()


def test_a_batch_of_a_stored_table_is_written_once_and_as_it_is_read(spark, tmp_path, monkeypatch):
    """F8, F9: the fact was written three times and shuffled as a whole to get into its months, where it had come from."""
    source, path = str(tmp_path / "source"), str(tmp_path / "t")
    rows = [(f"k{k}", f"2020-0{1 + k % 3}-01", k) for k in range(30)]
    PB.replace_periods(spark, frame(spark, rows), source)
    batch = PB.read_current(spark, source).withColumn("v", F.col("v") * 2)
    monkeypatch.setattr(PB, "durable", lambda df: pytest.fail("written again"))
    moved, real = [], type(batch).hint
    monkeypatch.setattr(type(batch), "hint", lambda df, name, *by: (moved.append(name), real(df, name, *by))[1])
    PB.upsert_periods(spark, batch, path, ["key"], stored=True, by_period=True)
    assert rows_of(PB.read_current(spark, path)) == {(k, m, 2 * v) for k, m, v in rows} and "rebalance" not in moved
    # with rows to merge, months are dealt again
    later = PB.read_current(spark, source).filter("v < 5").withColumn("v", F.lit(-1))
    PB.upsert_periods(spark, later, path, ["key"], stored=True, by_period=True)
    assert rows_of(PB.read_current(spark, path)) == {(k, m, -1 if v < 5 else 2 * v) for k, m, v in rows} and "rebalance" in moved
