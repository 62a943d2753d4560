"""The bucketed store: only touched buckets are written, half-written versions ignored, one of two writers repeats."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from noticewing.sources import store

SCHEMA = "notice_id string, criticality string, score int"


@pytest.fixture
def filled(spark, tmp_path):
    labels = store.label_store(spark, str(tmp_path / "store"), buckets=32)
    assert labels.read() is None and labels.manifest() is None
    labels.overwrite(spark.range(2000).select(F.format_string("n%d", "id").alias("notice_id"), F.lit("LOW").alias("criticality"), F.col("id").cast("int").alias("score")))
    return labels


def files(labels):
    return {str(p): p.stat().st_mtime_ns for p in Path(labels.root).rglob("*.parquet")}


def rows(df):
    return {r["notice_id"]: (r["criticality"], r["score"]) for r in df.collect()}


def test_upsert_writes_touched_buckets_only(spark, filled):
    before, first = files(filled), filled.manifest()
    assert len(first.folders) == 32
    new = spark.createDataFrame([("n7", "HIGH", 1), ("n8", "HIGH", 2), ("new", "INFO", 3)], SCHEMA)
    after = filled.upsert(new)
    touched = {b for b in after.folders if after.folders[b] != first.folders.get(b)}
    assert 1 <= len(touched) <= 3 and after.version == 1
    now = files(filled)
    assert all(now[p] == t for p, t in before.items()) and len({Path(p).parent for p in now}) - len({Path(p).parent for p in before}) == len(touched)
    got = rows(filled.read())
    assert len(got) == 2001 and got["n7"] == ("HIGH", 1) and got["new"] == ("INFO", 3) and got["n9"] == ("LOW", 9)
    assert rows(filled.read(version=0))["n7"] == ("LOW", 7)


def test_reading_keys_opens_their_buckets(filled):
    part = filled.read(keys=["n5", "nobody"])
    assert rows(part) == {"n5": ("LOW", 5)}
    assert 1 <= len({Path(f).parent for f in part.inputFiles()}) <= 2
    assert filled.read(keys=[]).count() == 0


def test_half_written_versions_are_passed_over(spark, filled):
    path = Path(filled.root) / "manifest" / f"{1:012d}.json"
    path.write_text('{"buckets": 32, "folders": {"0": "data/no')
    assert filled.manifest().version == 0 and filled.read().count() == 2000
    assert filled.upsert(spark.createDataFrame([("x", "LOW", 0)], SCHEMA)).version == 2
    assert filled.read().count() == 2001


def test_failed_writes_leave_nothing_visible(spark, filled):
    broken = spark.range(50).select(
        F.format_string("n%d", "id").alias("notice_id"), F.when(F.col("id") == 40, F.raise_error(F.lit("broken"))).otherwise(F.lit("HIGH")).alias("criticality"),
        F.lit(1).alias("score"))
    with pytest.raises(Exception, match="broken"):
        filled.upsert(broken)
    assert filled.manifest().version == 0 and set(rows(filled.read()).values()) == {("LOW", k) for k in range(2000)}
    filled.vacuum()
    assert len(list((Path(filled.root) / "data").iterdir())) == 1 and filled.read().count() == 2000


def test_one_of_two_writers_repeats(spark, filled, monkeypatch):
    other = store.label_store(spark, filled.root)
    written = filled._written

    def slow(*args):
        folders = written(*args)
        monkeypatch.undo()
        other.upsert(spark.createDataFrame([("n1", "HIGH", 11)], SCHEMA))
        return folders

    monkeypatch.setattr(filled, "_written", slow)
    with pytest.raises(store.ConcurrentWrite):
        filled.upsert(spark.createDataFrame([("n2", "HIGH", 22)], SCHEMA))
    filled.upsert(spark.createDataFrame([("n2", "HIGH", 22)], SCHEMA))
    got = rows(filled.read())
    assert got["n1"] == ("HIGH", 11) and got["n2"] == ("HIGH", 22)


def test_repeats_new_columns_nulls_and_vacuum(spark, filled):
    new = spark.createDataFrame([("n1", "B", 1, "r"), ("n1", "A", 2, "s"), (None, "C", 3, "t")], SCHEMA + ", reason string")
    filled.upsert(new)
    again = store.label_store(spark, filled.root).read()
    assert again.columns == ["notice_id", "criticality", "score", "reason"] and again.count() == 2001
    assert again.where("notice_id = 'n1'").first()["reason"] in ("r", "s") and again.where("notice_id = 'n2'").first()["reason"] is None
    assert again.where("notice_id IS NULL").first()["score"] == 3
    filled.upsert(spark.createDataFrame([("n1", "Z", 9)], SCHEMA))
    filled.vacuum(keep=1)
    assert filled.read(version=0) is None and filled.read().count() == 2001
    empty = store.BucketStore(spark, f"{filled.root}-empty", "notice_id")
    empty.upsert(new.limit(0))
    assert empty.read().count() == 0
