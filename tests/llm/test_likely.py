"""Rows that a join would drop stay where they are: what passes the bitmap of its keys."""

from noticewing.llm import common
from noticewing.llm.common import likely


def test_wanted_rows_pass_and_few_others(spark, monkeypatch):
    rows = spark.range(20000).selectExpr("id as node", "id % 7 as other", "cast(id as string) as text")
    wanted = rows.where("node % 100 = 3").select("other", "node")
    for bits, most in ((common.MARKS, 210), (1 << 10, 20000)):
        monkeypatch.setattr(common, "MARKS", bits)
        found = {r.node for r in likely(rows, wanted, "node", "other").select("node").collect()}
        assert {k for k in range(20000) if k % 100 == 3} <= found and len(found) <= most
    assert likely(rows, wanted.where("false"), "node").count() == 0
    assert likely(rows, wanted, "node").columns == rows.columns


def test_a_narrow_bitmap_still_leaves_rows_out(spark, monkeypatch):
    monkeypatch.setattr(common, "MARKS", 1 << 15)
    rows = spark.range(20000).selectExpr("id as node")
    assert 200 <= likely(rows, rows.where("node % 100 = 3"), "node").count() < 1000
