import json

import pytest
from pyspark.sql import functions as F

from noticewing.functions import rules
from noticewing.functions import text as tx
from noticewing.operators import dedupe, filters, ranking

NOTICES = [
    # pos, id, type, purpose, classification, series, scope
    (0, "001", "N", "N", "FDC", None, None),
    (1, "002", "N", "B", "FDC", None, None),
    (2, "003", "N", "O", "FDC", None, None),
    (3, "004", "R", "M", "MIL", "R", "AW"),
    (4, "005", "C", "O", "LMIL", "C", "E"),
]
SCHEMA = "input_pos long, id string, type string, purpose string, classification string, series string, scope string"


@pytest.fixture()
def notices(spark):
    return spark.createDataFrame(NOTICES, SCHEMA)


def test_totals_and_order(notices):
    totals = {r["id"]: r["rule_score"] for r in ranking.rule_score(notices).collect()}
    assert totals == {"001": 70, "002": 45, "003": 30, "004": 110, "005": 40}
    assert [r["id"] for r in ranking.rank_notices(notices).collect()] == ["004", "001", "002", "005", "003"]


def test_rank_per_route_matches_plain_sort_and_keeps_ties(spark):
    rows = [(p, f"n{p}", "NRC"[p % 3], "NBOMK"[p % 5], "DOM", None, None, "AB"[p % 7 == 0]) for p in range(300)]
    df = spark.createDataFrame(rows, SCHEMA + ", route string")
    got = ranking.rank_notices(df, "route").select("route", "rank", "id", "rule_score").collect()
    for route in "AB":
        mine = sorted((r for r in got if r["route"] == route), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, len(mine) + 1))
        assert [r["id"] for r in mine] == [r["id"] for r in sorted(mine, key=lambda r: (-r["rule_score"], int(r["id"][1:])))]


def test_weights_and_extra_scores(notices):
    heavy = rules.Weights(type={"N": 1000})
    plus = notices.withColumn("bonus", F.lit(7))
    got = {r["id"]: r["rule_score"] for r in ranking.rule_score(plus, heavy, extra=["bonus"]).collect()}
    assert got["001"] == 50 + 1000 + 7


def test_text_head(spark):
    six = "\n".join("abcdef")
    df = spark.createDataFrame([(six,), (None,)], "t string")

    def head(n):
        return [r[0] for r in df.select(tx.text_head(F.col("t"), n)).collect()]

    assert head(3) == ["a\nb\nc\n...", None]
    assert head(6) == [six, None] and head(999) == [six, None] and head(None) == [six, None]
    for bad in (0, -1):
        with pytest.raises(ValueError):
            tx.text_head(F.col("t"), bad)


def test_tokens_use_unicode_word_borders(spark):
    df = spark.createDataFrame([("éab RWY 13L/31R clsd the a_b TWY-A the",)], "t string")
    assert df.select(tx.tokens(F.col("t"))).first()[0] == ["RWY", "CLSD", "TWY"]


@pytest.mark.parametrize(
    "reply, want",
    [
        ('{"criticality":"high","score":91,"reason":"x"}', ("HIGH", 91, "x", True)),
        ('```json\n{"criticality":"Low","score":" 85 "}\n```', ("LOW", 85, "", True)),
        ('{"criticality":"SEVERE","score":140}', ("INFO", 100, "", True)),
        ('{"score":-3.9,"reason":"' + "r" * 300 + '"}', ("INFO", 0, "r" * 200, True)),
        ("{}", ("INFO", 0, "", True)),
        ('{"criticality":3}', (None, None, None, False)),
        ('{"score":"85.7"}', (None, None, None, False)),
        ('{"score":null}', (None, None, None, False)),
        ('{"reason":null}', (None, None, None, False)),
        ("[1]", (None, None, None, False)),
        ("not json", (None, None, None, False)),
    ],
)
def test_parse_reply(spark, reply, want):
    got = spark.createDataFrame([(reply,)], "r string").select(tx.parse_reply(F.col("r")).alias("x")).select("x.*").first()
    assert tuple(got) == want


def test_first_success_and_failure_reasons(spark):
    good = json.dumps({"criticality": "HIGH", "score": 80, "reason": "ok"})
    rows = [
        ("a", 1, 429, None), ("a", 2, 200, good), ("a", 3, 200, json.dumps({"criticality": "LOW"})),
        ("b", 1, 200, "junk"), ("b", 2, 429, None),
        ("c", 1, 429, None), ("c", 2, 500, None), ("c", 3, 529, None),
        ("d", 1, 400, None), ("d", 6, 200, good),
    ]
    got = {r["notice_id"]: r for r in dedupe.first_success(spark.createDataFrame(rows, "notice_id string, attempt int, status int, reply string")).collect()}
    assert (got["a"]["criticality"], got["a"]["attempt"]) == ("HIGH", 2)
    assert got["b"]["reason"] == "LABELING_FAILED: invalid reply"
    assert got["c"]["reason"] == "LABELING_FAILED: None" and got["c"]["criticality"] == "INFO"
    assert got["d"]["reason"] == "LABELING_FAILED: HTTP 400"


def test_waypoint_dedupe_modes(spark):
    # three points with five notices each, the first two equal
    rows = [(w, i, f"{'x' if w < 2 else 'y'}{i}") for w in range(3) for i in range(5)] + [(0, 9, "x0")]
    df = spark.createDataFrame(rows, "wp_idx int, item int, id string")
    once = dedupe.keep_first(df, "id", ["wp_idx", "item"])
    assert once.count() == 10 and {r["wp_idx"] for r in once.where("id like 'x%'").collect()} == {0}
    assert dedupe.keep_first(once, "id", ["wp_idx", "item"]).count() == 10
    assert dedupe.keep_first(df, "id", ["wp_idx", "item"], scope="across_waypoints").count() == 11
    plan = once._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_filters(spark):
    places = spark.createDataFrame(
        [("JFK", "United States", "America/New_York"), ("ANC", "United States", "America/Anchorage"), ("HNL", "United States", "Pacific/Honolulu"),
         ("BQN", "United States", "America/Puerto_Rico"), ("XXX", "United States", None), ("YYZ", "Canada", None), ("LOC", "US", None)],
        "iata string, country string, tz_name string",
    )
    assert [r["iata"] for r in filters.conus(places).collect()] == ["JFK", "XXX"]
    assert filters.conus(places, ("United States", "US")).count() == 3
    texts = spark.createDataFrame([("a", "rwy Canceled", "x"), ("b", "ok", "LABELING_FAILED: e"), ("c", " \n", None), ("d", None, None), ("e", "ok", None)],
                                  "id string, text string, reason string")
    assert [r["id"] for r in filters.active_only(texts).collect()] == ["b", "c", "d", "e"]
    assert [r["id"] for r in filters.trainable(texts).collect()] == ["a", "e"]
