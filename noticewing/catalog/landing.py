"""Registered queries: landed pages, request plans, text blocks, airport files, label store, briefs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticewing import domain
from noticewing.catalog.core import FIRST_SQL
from noticewing.catalog.registry import query
from noticewing.catalog.views import Views
from noticewing.functions import text as tx
from noticewing.operators import spatial
from noticewing.plans import storage, workflows
from noticewing.sources import airports, blocks, briefs, labels, landing, pages, store

PAGE = 4
STAMP = "yyyy-MM-dd'T'HH:mm:ss'.000Z'"

# ---------------------------------------------------------------- response pages built from the notices

#: defect planted in an item -> (SQL test on pos, reason the validator must give)
DEFECTS = {
    "extra": ("pos % 17 = 3", "extra:notice.bogus"),
    "enum": ("pos % 19 = 4", "value:type"),
    "time": ("pos % 23 = 5", "value:issued"),
    "text": ("pos % 29 = 6", "missing:text"),
    "purpose": ("pos % 31 = 7", "value:purpose"),
    "geometry": ("pos % 37 = 8", "missing:item.geometry"),
    "scenario": ("pos % 41 = 9", "value:event.scenario"),
}
REASONS_SQL = "[x FOR x IN [" + ", ".join(f"CASE WHEN {t} THEN '{r}' END" for t, r in DEFECTS.values()) + "] IF x IS NOT NULL]"
PAGED_SQL = f"""(SELECT *, 'r' || CAST(pos % 3 AS VARCHAR) AS request_id, CAST(pos // 3 // {PAGE} + 1 AS INT) AS page_num, CAST(pos // 3 % {PAGE} AS INT) AS item_pos,
 list_sort({REASONS_SQL}) AS problems FROM v_notices)"""


def _item(defects: bool = True) -> Column:
    """An item as the service sends it, with planted defects; null fields are absent keys."""

    def bad(name: str) -> Column:
        return F.expr(DEFECTS[name][0]) if defects else F.lit(False)

    issued = F.date_format("issued", STAMP)
    notice = F.struct(
        F.col("id"), F.concat(F.lit("A"), F.col("pos").cast("string"), F.lit("/24")).alias("number"),
        F.when(bad("enum"), "X").otherwise(F.col("type")).alias("type"),
        F.when(bad("time"), "soon").otherwise(issued).alias("issued"),
        F.col("selection_code").alias("selectionCode"),
        F.when(bad("purpose"), "NZ").otherwise(F.col("purpose")).alias("purpose"), F.col("scope"), F.col("series"),
        F.coalesce("icao_location", F.lit("ZZZ")).alias("location"), issued.alias("effectiveStart"),
        F.when(F.col("pos") % 6 == 0, "PERM").otherwise(issued).alias("effectiveEnd"),
        F.when(~bad("text"), F.col("text")).alias("text"), F.col("classification"), F.lit("KZJX").alias("accountId"),
        issued.alias("lastUpdated"), F.col("icao_location").alias("icaoLocation"),
        F.when(bad("extra"), "x").alias("bogus"),
    )
    translation = F.array(F.struct(F.lit("ICAO").alias("type"), F.concat(F.lit("A) "), F.col("id")).alias("formattedText")))
    core = F.struct(
        F.struct(F.when(bad("scenario"), "abc").otherwise("6000").alias("scenario")).alias(domain.EVENT_KEY), notice.alias(domain.NOTICE_KEY),
        translation.alias(domain.TRANSLATION_KEY),
    )
    geometry = F.when(~bad("geometry"), F.struct(F.lit("GeometryCollection").alias("type")))
    return F.struct(
        F.lit("Feature").alias("type"), F.struct(core.alias(domain.CORE_KEY)).alias("properties"), geometry.alias("geometry")
    )


def _pages(v: Views, defects: bool = True) -> DataFrame:
    """Three requests with pages of PAGE items each, as (request_id, status, body)."""
    n = v.table("documents").agg(F.count(F.lit(1)).alias("n")).scalar()
    idx = F.floor(F.col("pos") / 3)
    rows = v.notices().select(
        (F.col("pos") % 3).alias("r"), (F.floor(idx / PAGE) + 1).cast("int").alias("page"), F.struct("pos", _item(defects).alias("item")).alias("x")
    )
    grouped = rows.groupBy("r", "page").agg(F.array_sort(F.collect_list("x")).alias("xs"))  # PAGE items at most
    total = F.floor((n - F.col("r") + 2) / 3)
    body = F.struct(
        F.lit(PAGE).alias("pageSize"), F.col("page").alias("pageNum"), total.alias("totalCount"),
        F.ceil(total / PAGE).alias("totalPages"), F.transform("xs", lambda x: x["item"]).alias("items"),
    )
    return grouped.select(F.concat(F.lit("r"), F.col("r").cast("string")).alias("request_id"), F.lit(200).alias("status"), F.to_json(body).alias("body"))


def _id() -> Column:
    return F.try_variant_get("item", f"{pages.NOTICE}.id", "string").alias("id")


@query("page_items", f"""
SELECT request_id, page_num, item_pos, id, CAST(ceil(count(*) OVER (PARTITION BY request_id) / {PAGE}.0) AS INT) AS total_pages,
 bool_and(len(problems) = 0) OVER (PARTITION BY request_id, page_num) AS page_ok FROM {PAGED_SQL} p""")
def _(v: Views):
    path = storage.scratch(v.spark)
    _pages(v).write.json(path)  # landed responses, read back by the source
    return pages.page_items(pages.read_pages(v.spark, path)).select("request_id", "page_num", "item_pos", _id(), "total_pages", "page_ok")


@query("landed_pages", f"""
SELECT request_id, page_num, item_pos, id FROM {PAGED_SQL} p WHERE request_id IN ('r0', 'r2') AND page_num >= 2""")
def _(v: Views):
    path = storage.scratch(v.spark)
    landing.write_landing(_pages(v).withColumn("page_num", F.get_json_object("body", "$.pageNum").cast("int")), path)
    few = landing.read_landing(v.spark, path).where("request_id IN ('r0', 'r2') AND page_num >= 2")
    return pages.page_items(few.drop("page_num")).select("request_id", "page_num", "item_pos", _id())


TRIAGE = "CASE pos % 9 WHEN 0 THEN 'unauthenticated' WHEN 1 THEN 'error' WHEN 2 THEN 'message' WHEN 3 THEN 'invalid' WHEN 4 THEN 'not_json' WHEN 5 THEN 'rate_limited' WHEN 6 THEN 'invalid' WHEN 7 THEN 'success'"


@query("response_triage", f"""
SELECT id AS request_id, {TRIAGE} ELSE CASE WHEN len(problems) = 0 THEN 'success' ELSE 'invalid' END END AS kind,
 CASE pos % 9 WHEN 0 THEN 'Invalid client id or secret' WHEN 1 THEN 'e' || id WHEN 2 THEN 'm' || id END AS detail FROM {PAGED_SQL} p""")
def _(v: Views):
    p = F.col("pos")

    def envelope(items: Column) -> Column:
        return F.to_json(F.struct(F.lit("10").alias("pageSize"), F.lit(1).alias("pageNum"), F.lit(1).alias("totalCount"), F.lit(1).alias("totalPages"), items.alias("items")))

    one = F.array(_item())
    body = (
        F.when(p % 9 == 0, f'{{"error":"{domain.BAD_CREDENTIALS}"}}')
        .when(p % 9 == 1, F.to_json(F.struct(F.concat(F.lit("e"), "id").alias("error"))))
        .when(p % 9 == 2, F.to_json(F.struct(F.concat(F.lit("m"), "id").alias("message"))))
        .when(p % 9 == 3, '{"Invalid":"no known shape"}')
        .when(p % 9 == 4, F.concat(F.lit("<html>"), "id"))
        .when(p % 9 == 5, '{"error":"Rate limit exceeded"}')
        .when(p % 9 == 6, envelope(F.array(F.struct(F.lit("Point").alias("type")))))
        .when(p % 9 == 7, envelope(F.slice(one, 1, 0)))
        .otherwise(envelope(one))
    )
    landed = v.notices().select(F.col("id").alias("request_id"), F.when(p % 9 == 5, 429).otherwise(200).alias("status"), body.alias("body"))
    return pages.classify_responses(landed).select("request_id", "kind", "detail")


@query("validate_items", f"SELECT id, array_to_string(problems, '|') AS problems FROM {PAGED_SQL} p WHERE len(problems) > 0")
def _(v: Views):
    _valid, quarantine = pages.validate_items(pages.page_items(_pages(v)))
    return quarantine.select(_id(), F.concat_ws("|", F.array_sort("problems")).alias("problems"))


@query("validate_pages", f"SELECT id FROM {PAGED_SQL} p QUALIFY bool_and(len(problems) = 0) OVER (PARTITION BY request_id, page_num)")
def _(v: Views):
    valid, _quarantine = pages.validate_items(pages.page_items(_pages(v)), page_atomic=True)
    return valid.select(_id())


@query("flatten_notices", """
SELECT id, 'A' || CAST(pos AS VARCHAR) || '/24' AS number, type, strftime(issued, '%Y-%m-%d %H:%M:%S') AS issued, selection_code,
 array_to_string(list_sort(list_distinct(string_split(purpose, ''))), '') AS purpose, series, classification,
 CASE WHEN pos % 6 <> 0 THEN strftime(issued, '%Y-%m-%d %H:%M:%S') END AS effective_end, pos % 6 = 0 AS is_permanent,
 icao_location, text, 6000 AS scenario, 'A) ' || id AS formatted_text FROM v_notices""")
def _(v: Views):
    valid, _quarantine = pages.validate_items(pages.page_items(_pages(v, defects=False)))
    flat = pages.flatten_notices(valid)
    chars = F.when(F.col("purpose").isNotNull(), F.concat_ws("", F.array_sort("purpose")))
    times = {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("issued", "effective_end")}
    return flat.withColumns(times).select(
        "id", "number", "type", "issued", "selection_code", chars.alias("purpose"), "series", "classification", "effective_end",
        "is_permanent", "icao_location", "text", "scenario", F.col("translations")[0]["formatted_text"].alias("formatted_text"),
    )


@query("request_plan", """
SELECT icao, CAST(lon AS VARCHAR) AS lon_param, CAST(lat AS VARCHAR) AS lat_param, '30.0' AS radius_param, '1' AS page_param, '500' AS size_param FROM v_airports""")
def _(v: Views):
    plan = pages.plan_requests(v.airports().select("icao", "lat", "lon"), radius_nm=30.0, page_size=500)
    keys = {"lon_param": "locationLongitude", "lat_param": "locationLatitude", "radius_param": "locationRadius", "page_param": "pageNum", "size_param": "pageSize"}
    return plan.select("icao", *[F.col("params")[k].alias(n) for n, k in keys.items()])


@query("request_plan_codes", "SELECT icao AS code, icao AS code_param, '1' AS page_param, '1000' AS size_param, 3 AS n_params FROM v_airports")
def _(v: Views):
    plan = pages.plan_requests(v.airports().select(F.col("icao").alias("code")))
    keys = {"code_param": "icaoLocation", "page_param": "pageNum", "size_param": "pageSize"}
    return plan.select("code", *[F.col("params")[k].alias(n) for n, k in keys.items()], F.size("params").alias("n_params"))


@query("page_fanout", """
SELECT c_custkey AS request_id, CAST(c_custkey % 7 AS INT) AS total_pages, CAST(unnest(range(2, CAST(c_custkey % 7 AS INT) + 1)) AS INT) AS page_num FROM customer""")
def _(v: Views):
    first = v.table("customer").select(F.col("c_custkey").alias("request_id"), (F.col("c_custkey") % 7).cast("int").alias("total_pages"))
    return pages.fan_out_pages(first)


@query("sampling_grid", """
SELECT source, i, j, round(lat1 + (lat2 - lat1) / 4.0::DOUBLE * i, 9) AS lat, round(lon1 + (lon2 - lon1) / 4.0::DOUBLE * j, 9) AS lon
FROM (SELECT coalesce(icao_location, 'none') AS source, max(lat) AS lat1, min(lat) AS lat2, min(lon) AS lon1, max(lon) AS lon2 FROM v_notices GROUP BY 1) b
CROSS JOIN (SELECT CAST(unnest(range(5)) AS INT) AS i) x CROSS JOIN (SELECT CAST(unnest(range(5)) AS INT) AS j) y""")
def _(v: Views):
    boxes = v.notices().groupBy(F.coalesce("icao_location", F.lit("none")).alias("source")).agg(
        F.max("lat").alias("lat0"), F.min("lat").alias("lat1"), F.min("lon").alias("lon0"), F.max("lon").alias("lon1")
    )
    grid = spatial.sampling_grid(boxes, 5)
    return grid.select("source", "i", "j", F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"))


@query("collect_union", f"SELECT request_id, id FROM {PAGED_SQL} p")
def _(v: Views):
    items = pages.page_items(_pages(v))
    parts = [items.where(F.col("request_id") == f"r{i}").select("request_id", _id()) for i in range(3)]
    return pages.collect_union(*parts)


@query("schema_drift", """
SELECT * FROM (
 SELECT 'notice.bogus' AS path, 'extra' AS issue, 'STRING' AS detail, count(*) FILTER (WHERE pos % 17 = 3) AS n FROM v_notices
 UNION ALL SELECT 'notice.type', 'new_value', 'X', count(*) FILTER (WHERE pos % 19 = 4) FROM v_notices
 UNION ALL SELECT 'event.scenario', 'type', 'STRING', count(*) FROM v_notices
 UNION ALL SELECT 'notice.' || k, 'missing', NULL, 0 FROM (SELECT unnest(['affectedFIR', 'traffic', 'minimumFL', 'maximumFL', 'schedule', 'coordinates', 'radius', 'lowerLimit', 'upperLimit']) AS k) u) d""")
def _(v: Views):
    return pages.schema_drift(pages.page_items(_pages(v)))


@query("schema_inferred", """
SELECT count(*) > 0 AS has_items, bool_or(pos % 17 = 3) AS has_bogus, bool_or(scope IS NOT NULL) AS has_scope, FALSE AS has_schedule FROM v_notices""")
def _(v: Views):
    inferred = pages.infer_schema(pages.page_items(_pages(v)))
    seen = {"has_items": domain.CORE_KEY, "has_bogus": "bogus: STRING", "has_scope": "scope: STRING", "has_schedule": "schedule"}
    return inferred.select(*[F.col("schema").contains(text).alias(name) for name, text in seen.items()])


#: a nested document per notice: lists in lists, objects down to depth 12, nulls, keys that not all have
NESTED_SQL = """'{"id":' || CAST(pos AS STRING) || ',"geometry":{"type":"GC","geometries":[{"coordinates":[[' || CAST(lon AS STRING) || ',' || CAST(lat AS STRING) ||
 '],[]]}]},"deep":' || repeat('{"a":', CAST(pos % 12 AS INT)) || '1' || repeat('}', CAST(pos % 12 AS INT)) || ',"list":' || repeat('[', CAST(pos % 11 AS INT)) ||
 'null' || repeat(']', CAST(pos % 11 AS INT)) || CASE WHEN pos % 5 = 0 THEN ',"flag":true,"id2":"x"' WHEN pos % 5 = 1 THEN ',"flag":"yes"' ELSE '' END || '}'"""


@query("schema_paths", f"""
WITH tree AS (SELECT regexp_replace(regexp_replace(t.fullkey, '\\[[0-9]+\\]', '[]', 'g'), '^\\$\\.?', '') AS path, t.type AS kind
 FROM (SELECT {NESTED_SQL} AS doc FROM v_notices) d, json_tree(d.doc) t)
SELECT path, CASE kind WHEN 'VARCHAR' THEN 'STRING' WHEN 'UBIGINT' THEN 'BIGINT' WHEN 'DOUBLE' THEN 'DECIMAL' WHEN 'NULL' THEN 'VOID' ELSE kind END AS kind, count(*) AS n
FROM tree GROUP BY 1, 2""")
def _(v: Views):
    return pages.schema_paths(v.notices().select(F.parse_json(F.expr(NESTED_SQL)).alias("item")))


NOTICE_AT = f"properties.{domain.CORE_KEY}.{domain.NOTICE_KEY}"


@query("path_drift", f"""
SELECT * FROM (
 SELECT '{NOTICE_AT}.bogus' AS path, 'extra' AS issue, 'STRING' AS detail, count(*) FILTER (WHERE pos % 17 = 3) AS n FROM v_notices
 UNION ALL SELECT 'properties.{domain.CORE_KEY}.{domain.EVENT_KEY}.scenario', 'type', 'STRING', count(*) FROM v_notices
 UNION ALL SELECT 'properties.{domain.CORE_KEY}.{domain.TRANSLATION_KEY}[].simpleText', 'missing', NULL, 0
 UNION ALL SELECT '{NOTICE_AT}.' || k, 'missing', NULL, 0 FROM (SELECT unnest(['affectedFIR', 'traffic', 'minimumFL', 'maximumFL', 'schedule', 'coordinates', 'radius', 'lowerLimit', 'upperLimit']) AS k) u) d""")
def _(v: Views):
    return pages.path_drift(pages.schema_paths(pages.page_items(_pages(v))))


# ---------------------------------------------------------------- airport files

LINE_SQL = """CAST(pos AS VARCHAR) || ',"' || name || CASE WHEN pos % 13 = 0 THEN ', Intl' ELSE '' END || '","City","' || country || '",' ||
 coalesce('"' || iata || '"', '\\N') || ',"' || icao || '",' || CAST(lat AS VARCHAR) || ',' || CAST(lon AS VARCHAR) || ',' ||
 CASE WHEN pos % 7 = 0 THEN 'high' ELSE CAST(elevation AS VARCHAR) END || ',-5,"A","' || coalesce(tz_name, '\\N') || '","airport","OurAirports"'"""


def _lines(v: Views) -> DataFrame:
    """The airports as lines of the raw airports file."""

    def quoted(c) -> Column:
        return F.concat(F.lit('"'), c, F.lit('"'))

    p = F.col("pos")
    null = F.lit("\\N")
    fields = [
        p.cast("string"), quoted(F.concat("name", F.when(p % 13 == 0, ", Intl").otherwise(""))), quoted(F.lit("City")), quoted(F.col("country")),
        F.coalesce(quoted(F.col("iata")), null), quoted(F.col("icao")), F.col("lat").cast("string"), F.col("lon").cast("string"),
        F.when(p % 7 == 0, "high").otherwise(F.col("elevation").cast("string")), F.lit("-5"), quoted(F.lit("A")),
        quoted(F.coalesce("tz_name", null)), quoted(F.lit("airport")), quoted(F.lit("OurAirports")),
    ]
    return v.airports().select(F.concat_ws(",", *fields).alias("value"))


@query("airports_ingest", """
SELECT CAST(pos AS DOUBLE) AS airport_id, name, country, coalesce(iata, '\\N') AS iata, icao, lat AS latitude, lon AS longitude,
 CASE WHEN pos % 7 <> 0 THEN CAST(elevation AS DOUBLE) END AS altitude, coalesce(tz_name, '\\N') AS tz_name FROM v_airports WHERE pos % 13 <> 0""".replace("\\\\", "\\"))
def _(v: Views):
    valid, _bad = airports.ingest_airports(_lines(v))
    return valid.select("airport_id", "name", "country", "iata", "icao", "latitude", "longitude", "altitude", "tz_name")


@query("airports_ingest_quoted", """
SELECT CAST(pos AS DOUBLE) AS airport_id, name || CASE WHEN pos % 13 = 0 THEN ', Intl' ELSE '' END AS name, icao FROM v_airports""")
def _(v: Views):
    valid, _bad = airports.ingest_airports(_lines(v), strict_split=False)
    return valid.select("airport_id", "name", "icao")


@query("airports_bad_rows", f"SELECT {LINE_SQL} AS bad_row FROM v_airports WHERE pos % 13 = 0".replace("\\\\", "\\"))
def _(v: Views):
    _valid, bad = airports.ingest_airports(_lines(v))
    return bad


@query("airports_counts", "SELECT count(*) AS total, count(*) FILTER (WHERE pos % 13 <> 0) AS valid, count(*) FILTER (WHERE pos % 13 = 0) AS bad FROM v_airports")
def _(v: Views):
    return airports.ingest_counts(_lines(v))


@query("airports_read", """
SELECT CAST(pos AS VARCHAR) AS airport_id, name || CASE WHEN pos % 13 = 0 THEN ', Intl' ELSE '' END AS name, iata, icao, lat AS latitude, lon AS longitude,
 CASE WHEN pos % 7 <> 0 THEN elevation END AS altitude, tz_name FROM v_airports""")
def _(v: Views):
    path = storage.scratch(v.spark)
    _lines(v).write.text(path)
    return airports.read_airports(v.spark, path).select("airport_id", "name", "iata", "icao", "latitude", "longitude", "altitude", "tz_name")


@query("facility_read", """
SELECT name AS "ARPT_NAME", iata AS "ARPT_ID", icao AS "ICAO_ID", CAST(lat AS VARCHAR) AS "LAT_DECIMAL", 90 AS n_columns FROM v_airports""")
def _(v: Views):
    known = {"ARPT_NAME": F.col("name"), "ARPT_ID": F.col("iata"), "ICAO_ID": F.col("icao"), "LAT_DECIMAL": F.col("lat").cast("string")}
    path = storage.scratch(v.spark)
    v.airports().select(*[known.get(c, F.lit(None).cast("string")).alias(c) for c in domain.FACILITY_COLUMNS]).write.csv(path, header=True, emptyValue="")
    back = airports.read_facilities(v.spark, path)
    return back.select("ARPT_NAME", "ARPT_ID", "ICAO_ID", "LAT_DECIMAL", F.lit(len(back.columns) - 1).alias("n_columns"))


# ---------------------------------------------------------------- text blocks

ONE_LINE = "trim(replace(text, chr(10), ' '))"


def _printable(v: Views) -> DataFrame:
    n = v.route_notices()
    return n.select(
        "route_no", "route", "departure", "destination", "pos", "id", F.concat(F.lit("A"), F.col("pos").cast("string"), F.lit("/24")).alias("number"),
        F.concat(F.lit(domain.TYPE_PREFIX), "type").alias("type"), F.date_format("issued", "yyyy-MM-dd HH:mm:ss").alias("issued"), "selection_code",
        F.coalesce("icao_location", F.lit("ZZZ")).alias("location"), F.lit("2024-10-02").alias("effective_start"), F.lit("PERM").alias("effective_end"),
        F.concat(F.lit("Classification."), "classification").alias("classification"), F.lit("KZJX").alias("account_id"),
        F.lit("2024-10-02").alias("last_updated"), "icao_location", "text",
    )


BLOCK_SQL = f"""'ID: ' || id || chr(10) || 'Number: A' || CAST(pos AS VARCHAR) || '/24' || chr(10) || 'Type: {domain.TYPE_PREFIX}' || type || chr(10)
 || 'Issued: ' || strftime(issued, '%Y-%m-%d %H:%M:%S') || chr(10) || 'Selection Code: ' || coalesce(selection_code, 'None') || chr(10)
 || 'Location: ' || coalesce(icao_location, 'ZZZ') || chr(10) || 'Effective Start: 2024-10-02' || chr(10) || 'Effective End: PERM' || chr(10)
 || 'Classification: Classification.' || classification || chr(10) || 'Account ID: KZJX' || chr(10) || 'Last Updated: 2024-10-02' || chr(10)
 || 'ICAO Location: ' || coalesce(icao_location, 'None') || chr(10){{route}} || 'Text: ' || text"""
ROUTE_LINES = " || 'Route: ' || route || chr(10) || 'Departure: ' || departure || chr(10) || 'Destination: ' || destination || chr(10)"


@query("block_format", f"SELECT route, id, {BLOCK_SQL.format(route='')} AS block FROM v_route_notices")
def _(v: Views):
    return blocks.format_blocks(_printable(v)).select("route", "id", "block")


@query("block_format_merged", f"SELECT id, {BLOCK_SQL.format(route=ROUTE_LINES)} AS block FROM v_route_notices")
def _(v: Views):
    return blocks.format_blocks(_printable(v), with_route=True).select("id", "block")


@query("block_parse", f"""
SELECT route, id, 'A' || CAST(pos AS VARCHAR) || '/24' AS number, type, coalesce(selection_code, 'None') AS selection_code, classification,
 strftime(issued, '%Y-%m-%d %H:%M:%S') AS issued, {ONE_LINE} AS text FROM v_route_notices""")
def _(v: Views):
    path = storage.scratch(v.spark)
    blocks.write_blocks(_printable(v), path, ["pos"], with_route=True)
    parsed = blocks.parse_blocks(blocks.read_blocks(v.spark, path), with_route=True)
    return parsed.select(
        "route", "id", "number", tx.strip_enum(F.col("type")).alias("type"), "selection_code",
        tx.strip_enum(F.col("classification")).alias("classification"), "issued", "text",
    )


# ---------------------------------------------------------------- labels

LABELED_SQL = f"SELECT {', '.join(c for c in domain.LABELED_COLUMNS)} FROM v_labeled"


@query("labeled_roundtrip", LABELED_SQL)
def _(v: Views):
    path = storage.scratch(v.spark)
    labels.write_labeled(v.labeled(), path, format="csv")
    return labels.read_labeled(v.spark, path, format="csv")


@query("labeled_store", LABELED_SQL)
def _(v: Views):
    path = storage.scratch(v.spark)
    labels.write_labeled(v.labeled(), path)
    return labels.read_labeled(v.spark, path)


@query("label_upsert", """
SELECT notice_id, CASE WHEN CAST(substr(notice_id, 9) AS BIGINT) % 3 = 0 AND reason NOT LIKE 'LABELING_FAILED%' THEN 'INFO' ELSE criticality END AS criticality, score, reason
FROM v_labels""")
def _(v: Views):
    root = storage.scratch(v.spark)
    labels.save_store(v.labels(), root)
    new = v.labels().where(F.substring("notice_id", 9, 20).cast("long") % 3 == 0).withColumn("criticality", F.lit("INFO"))
    labels.save_store(labels.upsert_labels(labels.load_store(v.spark, root), new), root)
    return labels.load_store(v.spark, root)


@query("label_store_buckets", """
SELECT notice_id, CASE WHEN CAST(substr(notice_id, 9) AS BIGINT) % 50 = 0 AND reason NOT LIKE 'LABELING_FAILED%' THEN 'INFO' ELSE criticality END AS criticality, score, reason
FROM v_labels WHERE reason NOT LIKE 'LABELING_FAILED%'""")
def _(v: Views):
    kept = v.labels().where(~F.col("reason").startswith(domain.FAILED_PREFIX))
    labels_by_bucket = store.label_store(v.spark, storage.scratch(v.spark), buckets=64)
    labels_by_bucket.upsert(kept)
    labels_by_bucket.upsert(kept.where(F.substring("notice_id", 9, 20).cast("long") % 50 == 0).withColumn("criticality", F.lit("INFO")))
    return labels_by_bucket.read()


@query("labelled_set", f"""
WITH merged AS (SELECT * FROM v_route_notices QUALIFY row_number() OVER (PARTITION BY id ORDER BY route_no, pos) = 1),
 held AS (SELECT notice_id, criticality, score, reason FROM v_labels WHERE reason NOT LIKE 'LABELING_FAILED%' AND CAST(substr(notice_id, 9) AS BIGINT) % 3 <> 0),
 fresh AS ({FIRST_SQL}),
 known AS (SELECT * FROM held UNION ALL SELECT notice_id, criticality, score, reason FROM fresh WHERE notice_id NOT IN (SELECT notice_id FROM held))
SELECT m.id, m.route, m.departure, m.destination, m.icao_location, m.classification, m.selection_code, m.text, k.criticality, CAST(k.score AS INT) AS score, k.reason
FROM merged m JOIN known k ON k.notice_id = m.id""")
def _(v: Views):
    # the whole job: three routes, a store that holds two thirds of the labels, a service that answers for the rest
    rows = v.route_notices()
    routes = [rows.where(F.col("route") == name).drop("route_no") for _, name, _, _ in domain.ROUTES]
    held = v.labels().where(~F.col("reason").startswith(domain.FAILED_PREFIX) & (F.substring("notice_id", 9, 20).cast("long") % 3 != 0))
    replies = v.replies()

    def ask(todo: DataFrame) -> DataFrame:
        return replies.join(todo.select(F.col("id").alias("notice_id")), "notice_id", "left_semi")

    labeled, _store = workflows.build_labeled(routes, held, ask, ["pos"])
    return labeled.withColumn("score", F.col("score").cast("int"))


# ---------------------------------------------------------------- briefs

PCT1 = "printf('%4.1f', round_even({n} * 100.0::DOUBLE / total, 1))"
HEAD = " UNION ALL ".join(
    f"SELECT route, 0, CAST(-1 AS BIGINT), {4 + i}, '  ' || printf('%-8s', '{lv}') || ' ' || printf('%4d', {lv.lower()}) || '  (' || {PCT1.format(n=lv.lower())} || '%)' FROM c"
    for i, lv in enumerate(domain.LEVELS)
)
HEADS = " UNION ALL ".join(
    f"""SELECT route, {i}, CAST(-1 AS BIGINT), u.k, CASE u.k WHEN 1 THEN '  {domain.SECTION_TITLES[lv]}: ' || CAST({lv.lower()} AS VARCHAR) WHEN 3 THEN '  Nothing here.' WHEN 4 THEN '' ELSE repeat('=', 72) END
 FROM c CROSS JOIN (SELECT unnest(range(5)) AS k) u WHERE u.k < 3 OR {lv.lower()} = 0"""
    for i, lv in enumerate(domain.LEVELS, start=1)
)


BRIEF_SQL = f"""
WITH c AS (SELECT route, departure, destination, count(*) AS total, count(*) FILTER (WHERE is_anomaly) AS anomalies,
  {", ".join(f"count(*) FILTER (WHERE final_criticality = '{lv}') AS {lv.lower()}" for lv in domain.LEVELS)} FROM v_scored GROUP BY 1, 2, 3)
SELECT route, CAST(section AS INT) AS section, pos, CAST(line_no AS INT) AS line_no, line FROM (
 SELECT route, 0 AS section, CAST(-1 AS BIGINT) AS pos, u.k AS line_no, CASE u.k WHEN 1 THEN '  Briefing ' || departure || ' -> ' || destination || ', made 2025-01-01 00:00Z UTC'
   WHEN 2 THEN '  Notices rated: ' || CAST(total AS VARCHAR) WHEN 3 THEN repeat('-', 72) WHEN 10 THEN '' ELSE repeat('=', 72) END AS line
 FROM c CROSS JOIN (SELECT unnest([0, 1, 2, 3, 9, 10]) AS k) u
 UNION ALL {HEAD}
 UNION ALL SELECT route, 0, CAST(-1 AS BIGINT), 8, rpad('  Unusual', 10, ' ') || ' ' || printf('%4d', anomalies) || '  (' || {PCT1.format(n='anomalies')} || '%)' FROM c
 UNION ALL {HEADS}
 UNION ALL SELECT route, CASE final_criticality WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 ELSE 4 END, pos, u.k,
   CASE u.k WHEN 1 THEN '  ' || final_criticality || CASE WHEN is_anomaly THEN ', unusual' ELSE '' END || '  ' || notice_id || '  (confidence ' || CAST(CAST(round_even(rf_confidence * 100, 0) AS INT) AS VARCHAR) || ' %)'
    WHEN 3 THEN trim(text, ' ' || chr(10) || chr(9) || chr(13)) WHEN 4 THEN '' ELSE repeat('-', 72) END
 FROM v_scored CROSS JOIN (SELECT unnest(range(5)) AS k) u) z"""


@query("brief_lines", BRIEF_SQL)
def _(v: Views):
    return briefs.brief_lines(v.scored(), generated_at="2025-01-01 00:00Z")


@query("brief_files", f"""
SELECT route, row_number() OVER (PARTITION BY route ORDER BY section, pos, line_no, k) - 1 AS line_no, line FROM (
 SELECT route, section, pos, line_no, unnest(string_split(coalesce(line, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(line, ''), chr(10))))) AS k
 FROM ({BRIEF_SQL}) b) f""")
def _(v: Views):
    path = storage.scratch(v.spark)
    briefs.save_briefs(briefs.brief_lines(v.scored(), generated_at="2025-01-01 00:00Z"), path)
    return briefs.read_briefs(v.spark, path)
