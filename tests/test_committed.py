"""Data sources with commits: planned pruning, one commit per job, nothing left by failing jobs."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from noticewing.sources import briefs, committed, landing, pages


def landed(spark, n_requests=20, n_pages=5, extra=""):
    df = spark.range(n_requests * n_pages).select(
        F.format_string("r%03d", F.floor(F.col("id") / n_pages)).alias("request_id"), (F.col("id") % n_pages + 1).cast("int").alias("page_num"),
        F.lit(200).alias("status"), F.concat(F.lit(f'{{"x":"é\\n{extra}'), F.col("id").cast("string"), F.lit('"}')).alias("body"))
    return df


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def many_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(committed, "TASK_BYTES", 1)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield str(tmp_path / "landing")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_pages_round_trip_and_filters(spark, many_parts):
    df = landed(spark)
    landing.write_landing(df, many_parts)
    back = landing.read_landing(spark, many_parts)
    assert rows(back) == rows(df)
    for condition in (
        "request_id IN ('r001', 'r019', 'none')", "request_id = 'r003' AND page_num > 2", "page_num <= 1 AND request_id <> 'r004'",
        "request_id > 'r015' AND page_num >= 5", "request_id <= 'r002' AND status = 200 AND body LIKE '%1%'", "request_id IS NULL",
    ):
        assert rows(back.where(condition)) == rows(df.where(condition)), condition
    lines = spark.read.schema(landing.SCHEMA).json(f"{many_parts}/data/*/*.jsonl")  # the parts are plain JSON lines too
    assert rows(lines) == rows(df)


def test_filters_leave_out_parts_blocks_and_rows(spark, many_parts, monkeypatch):
    landing.write_landing(landed(spark), many_parts)
    files, root = committed.filesystem(many_parts)
    parts = committed.listed(files, root)
    assert len(parts) == 4 and sum(p.rows for p in parts) == 100
    reader = landing.PageReader(many_parts)
    whole = len(reader.partitions())
    assert list(reader.pushFilters([landing.EqualTo(("request_id",), "r000"), landing.EqualTo(("status",), 200)])) == [landing.EqualTo(("status",), 200)]
    few = reader.partitions()
    assert whole == 4 and len(few) == 1
    assert sum(b.num_rows for b in reader.read(few[0])) == 5
    full = landing.read_landing(spark, many_parts)
    plan = full.where("request_id = 'r000'")._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan and "Filter isnotnull" not in plan
    none = landing.PageReader(many_parts)
    assert not list(none.pushFilters([landing.GreaterThan(("page_num",), 9)])) and none.partitions() == []
    assert full.where("page_num > 9").count() == 0


def test_long_pages_roll_parts(spark, many_parts, monkeypatch):
    writer = landing.PageWriter(many_parts, False)
    monkeypatch.setattr(landing, "BLOCK_BYTES", 100)
    monkeypatch.setattr(landing, "PART_BYTES", 300)
    table = landed(spark, 3, 4, "long " * 30).toArrow()
    message = writer.write(iter(table.to_batches()))
    assert len(message.parts) > 1 and sum(p.rows for p in message.parts) == 12
    writer.commit([message, None])
    assert rows(landing.read_landing(spark, many_parts)) == rows(landed(spark, 3, 4, "long " * 30))
    files, root = committed.filesystem(many_parts)
    blocks = [b for p in message.parts for b in json.loads(committed.read_bytes(files, f"{root}/{p.path}.blocks"))]
    assert len(blocks) == 12 and sum(landing._may_match(b["about"], [("page_num", landing.LessThan, 2)]) for b in blocks) == 3


def test_nulls_empty_and_missing_landing(spark, tmp_path):
    path = str(tmp_path / "landing")
    assert landing.read_landing(spark, path).count() == 0
    df = spark.createDataFrame([(None, None, None, None), ("", 1, 429, ""), ("r", None, 200, "{}")], landing.SCHEMA)
    landing.write_landing(df, path)
    landing.write_landing(df.limit(0), path)
    back = landing.read_landing(spark, path)
    assert set(rows(back.where("status IS NOT NULL"))) == {("", 1, 429, ""), ("r", None, 200, "{}")} and back.count() == 3
    assert back.where("page_num = 1").count() == 1 and back.where("request_id IN ('', 'r')").count() == 2
    with pytest.raises(Exception, match="columns"):
        df.select("request_id").write.format(landing.NAME).mode("append").save(path)


def test_appends_overwrites_and_pages_source(spark, tmp_path):
    path = str(tmp_path / "landing")
    landing.write_landing(landed(spark, 2, 2), path)
    landing.write_landing(landed(spark, 3, 1), path)
    assert landing.read_landing(spark, path).count() == 7
    landing.write_landing(landed(spark, 4, 1), path, mode="overwrite")
    assert landing.read_landing(spark, path).count() == 4 and committed.vacuum(path) == 2 and committed.vacuum(path) == 0
    assert pages.classify_responses(landing.read_landing(spark, path)).where("kind = 'invalid'").count() == 4


def test_failing_job_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "landing")
    landing.write_landing(landed(spark, 2, 2), path)
    broken = landed(spark).withColumn("body", F.when(F.col("request_id") == "r015", F.raise_error(F.lit("torn"))).otherwise(F.col("body")))
    with pytest.raises(Exception, match="torn"):
        landing.write_landing(broken, path)
    assert landing.read_landing(spark, path).count() == 4 and len(list((Path(path) / "data").iterdir())) == 1
    # A job that ends before its commit: finished parts and a torn commit file, none of it seen.
    writer = landing.PageWriter(path, True)
    writer.write(iter(landed(spark, 1, 1).toArrow().to_batches()))
    (Path(path) / "commits" / "000000000009-x.tmp").write_text('{"overwrite": tr')
    assert landing.read_landing(spark, path).count() == 4 and committed.vacuum(path) == 1
    # A task that ran twice is listed once.
    again = landing.PageWriter(path, False)
    table = landed(spark, 1, 3).toArrow().to_batches()
    again.write(iter(table))
    again.commit([again.write(iter(table))])
    assert landing.read_landing(spark, path).count() == 7


def lines(spark, n=300):
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, "A / B").when(F.col("id") % 3 == 1, "").alias("route"), (F.col("id") % 5).cast("int").alias("section"),
        F.col("id").alias("pos"), (F.col("id") % 2).cast("int").alias("line_no"),
        F.when(F.col("id") == 7, None).when(F.col("id") % 50 == 0, F.concat(F.lit("two\nlines "), "id")).otherwise(F.concat(F.lit("ü "), "id")).alias("line"))


def expected(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["section"], r["pos"], r["line_no"])):
        out.setdefault(r["route"], []).extend((r["line"] or "").split("\n"))
    return out


def test_brief_files_order_and_routes(spark, tmp_path, many_parts):
    path, df = str(tmp_path / "briefs"), lines(spark)
    briefs.save_briefs(df, path)
    back = briefs.read_briefs(spark, path)
    got = {}
    for r in sorted(back.collect(), key=lambda r: r["line_no"]):
        got.setdefault(r["route"], []).append((r["line_no"], r["line"]))
    assert {k: [x[1] for x in v] for k, v in got.items()} == expected(df)
    assert all([x[0] for x in v] == list(range(len(v))) for v in got.values())
    assert back.where("route = 'A / B'").count() == len(got["A / B"]) and back.where("route IS NULL").count() == len(got[None])
    assert back.where("route IN ('', 'x') AND line_no < 2").count() == 2
    reader = briefs.BriefReader(path)
    everything = len(reader.partitions())
    assert not list(reader.pushFilters([briefs.EqualTo(("route",), "A / B")])) and 0 < len(reader.partitions()) < everything


def test_failing_briefing_keeps_the_old_one(spark, tmp_path):
    path = str(tmp_path / "briefs")
    briefs.save_briefs(lines(spark, 30), path)
    broken = lines(spark).withColumn("line", F.when(F.col("pos") == 200, F.raise_error(F.lit("torn"))).otherwise(F.col("line")))
    with pytest.raises(Exception, match="torn"):
        briefs.save_briefs(broken, path)
    back = briefs.read_briefs(spark, path)
    want = expected(lines(spark, 30))
    assert back.count() == sum(map(len, want.values()))
    assert len(list((Path(path) / "data").iterdir())) == 1
    commit = json.loads(sorted((Path(path) / "commits").iterdir())[-1].read_text())
    assert commit["overwrite"] and sum(p["rows"] for p in commit["parts"]) == back.count()
    briefs.save_briefs(lines(spark, 3), path)
    assert briefs.read_briefs(spark, path).where("line_no > 0").count() == 1 and committed.vacuum(path) == 1
    assert rows(briefs.read_briefs(spark, path).where("route IS NOT NULL")) == [("", 0, "ü 1"), ("A / B", 0, "two"), ("A / B", 1, "lines 0")]
