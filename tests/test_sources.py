import copy
import json

import pytest
from pyspark.sql import functions as F

from noticewing import domain
from noticewing.functions import text as tx
from noticewing.sources import airports, blocks, briefs, labels, pages

ITEM = {
    "type": "Feature",
    "properties": {domain.CORE_KEY: {
        domain.EVENT_KEY: {"scenario": "6000"},
        domain.NOTICE_KEY: {
            "id": "ENTRY_1_4711", "series": "A", "number": "A0042/25", "type": "N", "issued": "2025-03-04T05:06:00.000Z",
            "affectedFIR": "EDGG", "selectionCode": "QMRLC", "minimumFL": "010", "maximumFL": "120", "location": "EDDF",
            "effectiveStart": "2025-03-05T06:00:00.000Z", "effectiveEnd": "2025-03-09T18:30:00.000Z", "text": "RWY 07L CLOSED FOR WORKS",
            "classification": "INTL", "accountId": "EDDF", "lastUpdated": "2025-03-04T05:06:00.000Z", "icaoLocation": "EDDF",
            "purpose": "NBO", "lowerLimit": "GND", "upperLimit": "FL120",
        },
        domain.TRANSLATION_KEY: [{"type": "ICAO", "formattedText": "A0042/25"}],
    }},
    "geometry": {"type": "GeometryCollection"},
}


def _page(*items, **extra):
    return {"pageSize": 50, "pageNum": 1, "totalCount": len(items), "totalPages": 1, "items": list(items), **extra}


def _changed(path, value):
    item = copy.deepcopy(ITEM)
    at = item
    for key in path[:-1]:
        at = at[key]
    if value is None:
        del at[path[-1]]
    else:
        at[path[-1]] = value
    return item


def _landed(spark, *bodies):
    rows = [(f"q{i}", s, b if isinstance(b, str) else json.dumps(b)) for i, (s, b) in enumerate(bodies)]
    return spark.createDataFrame(rows, pages.LANDED)


CORE = ("properties", domain.CORE_KEY)


def test_triage(spark):
    df = _landed(
        spark, (200, _page(ITEM)), (200, _page(unknown="ignored")), (200, {"error": "Response returned an error"}),
        (200, {"message": "Response returned a message"}), (200, {"error": "Invalid client id or secret"}), (200, {"Invalid": "x"}),
        (200, _page(ITEM, {"type": "Point"})), (429, {"error": "Rate limit exceeded"}), (200, "<html>"), (200, "[1]"),
    )
    kinds = [r["kind"] for r in pages.classify_responses(df).orderBy("request_id").collect()]
    assert kinds == ["success", "success", "error", "message", "unauthenticated", "invalid", "invalid", "rate_limited", "not_json", "invalid"]
    with pytest.raises(Exception, match="error response: Response returned an error"):
        pages.classify_responses(df.where("request_id = 'q2'"), on_error="raise").collect()


@pytest.mark.parametrize(
    "path, value, reason",
    [
        ((*CORE, domain.NOTICE_KEY, "bogus"), "x", "extra:notice.bogus"),
        ((*CORE, domain.NOTICE_KEY, "text"), None, "missing:text"),
        ((*CORE, domain.NOTICE_KEY, "id"), 7, "type:id"),
        ((*CORE, domain.NOTICE_KEY, "type"), "X", "value:type"),
        ((*CORE, domain.NOTICE_KEY, "series"), "Y", "value:series"),
        ((*CORE, domain.NOTICE_KEY, "scope"), "AZ", "value:scope"),
        ((*CORE, domain.NOTICE_KEY, "effectiveEnd"), "whenever", "value:effectiveEnd"),
        ((*CORE, domain.NOTICE_KEY, "issued"), "2024-13-45T00:00:00Z", "value:issued"),
        ((*CORE, domain.EVENT_KEY, "scenario"), "six", "value:event.scenario"),
        ((*CORE, domain.TRANSLATION_KEY), [{"type": "ICAO", "simpleText": "x"}], "value:translation"),
        ((*CORE, "extra"), 1, "extra:core.extra"),
        (("geometry",), None, "missing:item.geometry"),
        (("type",), "Point", "value:item.type"),
    ],
)
def test_item_rules(spark, path, value, reason):
    items = pages.page_items(_landed(spark, (200, _page(ITEM, _changed(path, value)))))
    got = {r["item_pos"]: r["problems"] for r in items.collect()}
    assert got[0] == [] and got[1] == [reason]
    valid, quarantine = pages.validate_items(items)
    assert valid.count() == 1 and quarantine.count() == 1
    assert pages.validate_items(items, page_atomic=True)[0].count() == 0


def test_flatten(spark):
    permanent = _changed((*CORE, domain.NOTICE_KEY, "effectiveEnd"), "PERM")
    rows = pages.flatten_notices(pages.page_items(_landed(spark, (200, _page(ITEM, permanent)))), keep=["item_pos"]).orderBy("item_pos").collect()
    assert rows[0]["id"] == "ENTRY_1_4711" and rows[0]["scenario"] == 6000 and sorted(rows[0]["purpose"]) == ["B", "N", "O"]
    assert str(rows[0]["issued"]) == "2025-03-04 05:06:00" and rows[0]["schedule"] is None and not rows[0]["is_permanent"]
    assert rows[1]["is_permanent"] and rows[1]["effective_end"] is None
    assert rows[0]["translations"][0]["formatted_text"] == "A0042/25" and json.loads(rows[0]["geometry"]) == {"type": "GeometryCollection"}


def test_files_layout_and_empty_page(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(_page(ITEM, ITEM), indent=1))
    (tmp_path / "b.json").write_text(json.dumps(_page()))
    df = pages.read_pages(spark, str(tmp_path), layout="files")
    assert {r["kind"] for r in pages.classify_responses(df).collect()} == {"success"}
    assert pages.page_items(df).count() == 2


def test_request_parameters_and_bounds(spark):
    point = spark.createDataFrame([(35.0, -105.0)], "lat double, lon double")
    assert pages.plan_requests(point, 100.0, 500).first()["params"] == {
        "locationLongitude": "-105.0", "locationLatitude": "35.0", "locationRadius": "100.0", "pageNum": "1", "pageSize": "500",
    }
    code = spark.createDataFrame([("DEN",)], "code string")
    assert pages.plan_requests(code).first()["params"] == {"icaoLocation": "DEN", "pageNum": "1", "pageSize": "1000"}
    for size in (0, -1, 1001, 10001):
        with pytest.raises(ValueError):
            pages.plan_requests(code, page_size=size)
    for radius in (0, 100.5):
        with pytest.raises(ValueError):
            pages.plan_requests(point, radius_nm=radius)
    with pytest.raises(ValueError):
        pages.plan_requests(code, page_num=0)


SEP = domain.BLOCK_SEPARATOR


def test_blocks(spark, tmp_path):
    text = (
        f"ID: n1\nNumber: A1\nNumber: A2\nType: NotamType.N\nno field here\nSelection Code: None\nText: first line\n  second: line \n{SEP}\n"
        f"Number: lost\nText: no id\n{SEP}\n\n{SEP}\nID: n2\r\nClassification: Classification.DOM\r\nText:\r\nonly later\n{SEP}\n"
    )
    (tmp_path / "OKC.txt").write_text(text, newline="")
    for whole in (False, True):
        rows = blocks.parse_blocks(blocks.read_blocks(spark, str(tmp_path), whole_files=whole)).orderBy("block_start", "seq").collect()
        assert [r["id"] for r in rows] == ["n1", "n2"]
        assert rows[0]["number"] == "A2" and rows[0]["text"] == "first line   second: line" and rows[0]["issued"] == ""
        assert rows[1]["text"] == "only later" and rows[1]["classification"] == "Classification.DOM"


def test_block_files_split_in_many_parts(spark, tmp_path):
    cols = [*domain.BLOCK_FIELDS.values(), "text"]
    df = spark.range(400).select("id", *[F.concat(F.lit(f"{c} "), F.col("id").cast("string")).alias(c) for c in cols if c != "id"], F.lit("R1").alias("route"))
    df = df.withColumn("id", F.format_string("n%05d", "id"))
    path = str(tmp_path / "out")
    blocks.write_blocks(df, path, ["id"])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        back = blocks.read_blocks(spark, path)
        rows = blocks.parse_blocks(back).orderBy("file", "block_start", "seq").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["id"] for r in rows] == [f"n{i:05d}" for i in range(400)]
    assert rows[7]["text"] == "text 7"


def test_airport_lines(spark):
    lines = [
        '3797,"John F Kennedy International Airport","New York","United States","JFK","KJFK",40.63980103,-73.77890015,13,-5,"A","America/New_York","airport","OurAirports"',
        '1,"A, B","C","D",\\N,"KAAA",x,2,3,-5,"A",\\N,"airport","OurAirports"', "",
    ]
    df = spark.createDataFrame([(ln,) for ln in lines], "value string")
    valid, bad = airports.ingest_airports(df)
    row = valid.first()
    assert valid.count() == 1 and bad.count() == 2 and row["name"] == "John F Kennedy International Airport" and row["altitude"] == 13.0
    loose, rest = airports.ingest_airports(df, strict_split=False)
    assert {r["name"]: r["latitude"] for r in loose.collect()} == {"John F Kennedy International Airport": 40.63980103, "A, B": None}
    assert rest.count() == 1
    assert tuple(airports.ingest_counts(df).first()) == (3, 1, 2)


def test_airport_and_facility_files(spark, tmp_path):
    (tmp_path / "airports.dat").write_text('4,"Leeward Point Field","Guantanamo","Cuba","NBW","MUGM",19.9065,-75.2071,56,-5,"U",\\N,"airport","OurAirports"\n')
    row = airports.airports_as_places(airports.read_airports(spark, str(tmp_path / "airports.dat"))).first()
    assert row["tz_name"] is None and row["elevation"] == 56 and row["icao"] == "MUGM"
    values = dict.fromkeys(domain.FACILITY_COLUMNS, "")
    values |= {"ARPT_ID": "JKA", "ICAO_ID": "KJKA", "ARPT_NAME": "JACK EDWARDS", "STATE_NAME": "ALABAMA", "LAT_DECIMAL": "30.28963888", "ELEV": "17"}
    (tmp_path / "APT.csv").write_text(",".join(f'"{c}"' for c in values) + "\n" + ",".join(f'"{v}"' for v in values.values()) + "\n")
    got = airports.read_facilities(spark, str(tmp_path / "APT.csv"))
    assert len(got.columns) == 91 and got.first()["STATE_NAME"] == "ALABAMA" and got.first()["CITY"] is None


def test_labelled_csv_roundtrip(spark, tmp_path):
    rows = [("a", "R", "D", "E", None, "DOM", "None", 'two "quoted"\nlines, and commas', "HIGH", 90, "why"), ("b", "R", "D", "E", "KJFK", "DOM", "QABC", "t", "LOW", 1, "")]
    df = spark.createDataFrame(rows, labels.LABELED)
    labels.write_labeled(df, str(tmp_path / "csv"), format="csv")
    back = {r["id"]: r for r in labels.read_labeled(spark, str(tmp_path / "csv"), format="csv").collect()}
    assert back["a"]["text"] == rows[0][7] and back["a"]["selection_code"] is None and back["a"]["score"] == 90
    assert back["b"]["icao_location"] == "KJFK" and back["b"]["reason"] is None


def test_label_store(spark, tmp_path):
    root = str(tmp_path / "store")
    assert labels.load_store(spark, root).count() == 0
    schema = "notice_id string, criticality string, score int, reason string"
    labels.save_store(spark.createDataFrame([("a", "LOW", 1, "x"), ("b", "LOW", 1, "x")], schema), root)
    new = spark.createDataFrame([("a", "HIGH", 9, "y"), ("c", "INFO", 0, "LABELING_FAILED: e")], schema)
    labels.save_store(labels.upsert_labels(labels.load_store(spark, root), new), root)
    assert {(r["notice_id"], r["criticality"]) for r in labels.load_store(spark, root).collect()} == {("a", "HIGH"), ("b", "LOW")}


def test_brief_files(spark, tmp_path):
    rows = [("R", "KOKC", "KJFK", 1, "n1", " RWY CLSD\n", 0.875, True, "HIGH"), ("R", "KOKC", "KJFK", 2, "n2", "b", 0.125, False, "LOW"),
            ("R", "KOKC", "KJFK", 0, "n0", "c", 1.0, False, "HIGH")]
    df = spark.createDataFrame(rows, "route string, departure string, destination string, pos long, notice_id string, text string, rf_confidence double, is_anomaly boolean, final_criticality string")
    briefs.write_briefs(briefs.brief_lines(df, "2025-01-01 00:00Z"), str(tmp_path / "out"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "out" / "route=R").glob("part-*")))
    lines = text.split("\n")
    assert lines[1] == "  Briefing KOKC -> KJFK, made 2025-01-01 00:00Z UTC" and lines[2] == "  Notices rated: 3"
    assert lines[4] == "  HIGH        2  (66.7%)" and lines[8] == "  Unusual     1  (33.3%)"
    assert text.index("  HIGH  n0  (confidence 100 %)") < text.index("  HIGH, unusual  n1  (confidence 88 %)") < text.index("  Nothing here.") < text.index("  LOW  n2  (confidence 12 %)")


def test_null_spellings(spark):
    df = spark.createDataFrame([(v,) for v in ("None", "", "\\N", "KJFK", None)], "v string")
    assert [r[0] for r in df.select(tx.null_if_blank(F.col("v"))).collect()] == [None, None, None, "KJFK", None]
