"""Notice-shaped views derived from the supplied tables, for Spark and as SQL for the oracle."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticewing import domain

SQL = {
    "v_notices": """
SELECT d.doc_id AS pos, 'ENTRY_1_' || CAST(d.doc_id AS VARCHAR) AS id,
 CASE d.doc_id % 10 WHEN 0 THEN 'R' WHEN 1 THEN 'C' ELSE 'N' END AS type, e.ts AS issued,
 CASE WHEN d.doc_id % 5 < 3 THEN NULL ELSE 'Q' || upper(substr(e.event_type,1,4)) END AS selection_code,
 CASE d.doc_id % 7 WHEN 0 THEN 'NBO' WHEN 1 THEN 'BO' WHEN 2 THEN 'O' WHEN 3 THEN 'M' WHEN 4 THEN 'K' WHEN 5 THEN NULL ELSE 'NB' END AS purpose,
 CASE d.doc_id % 6 WHEN 0 THEN 'A' WHEN 1 THEN 'E' WHEN 2 THEN 'W' WHEN 3 THEN 'AE' WHEN 4 THEN 'K' ELSE NULL END AS scope,
 CASE d.doc_id % 8 WHEN 0 THEN 'R' WHEN 1 THEN 'A' WHEN 2 THEN 'C' WHEN 3 THEN 'H' ELSE NULL END AS series,
 CASE d.doc_id % 9 WHEN 0 THEN 'FDC' WHEN 1 THEN 'INTL' WHEN 2 THEN 'MIL' WHEN 3 THEN 'LMIL' ELSE 'DOM' END AS classification,
 CASE WHEN d.doc_id % 11 = 0 THEN NULL ELSE 'K' || upper(d.source) END AS icao_location,
 25.0::DOUBLE + CAST((d.doc_id * 37) % 2400 AS DOUBLE) / 100.0::DOUBLE AS lat,
 -124.0::DOUBLE + CAST((d.doc_id * 91) % 5700 AS DOUBLE) / 100.0::DOUBLE AS lon,
 d.text AS text, d.lang AS lang
FROM documents d JOIN events e ON e.event_id = d.doc_id""",
    "v_routes": """
SELECT 0 AS route_no,'OKC_JFK' AS route,'KOKC' AS departure,'KJFK' AS destination
UNION ALL SELECT 1,'OKC_ORD','KOKC','KORD' UNION ALL SELECT 2,'OKC_DEN','KOKC','KDEN'""",
    "v_route_notices": """
SELECT r.route_no, r.route, r.departure, r.destination, n.* FROM v_notices n JOIN v_routes r ON n.pos % (r.route_no + 2) = 0""",
    "v_labels": """
SELECT id AS notice_id, CASE WHEN pos % 100 < 8 THEN 'HIGH' WHEN pos % 100 < 29 THEN 'MEDIUM' WHEN pos % 100 < 83 THEN 'LOW' ELSE 'INFO' END AS criticality,
 CASE WHEN pos % 100 < 8 THEN 75 + pos % 26 WHEN pos % 100 < 29 THEN 40 + pos % 35 WHEN pos % 100 < 83 THEN 15 + pos % 25 ELSE pos % 15 END AS score,
 CASE WHEN pos % 97 = 5 THEN 'LABELING_FAILED: timeout' ELSE 'auto' END AS reason FROM v_notices WHERE pos % 13 <> 12""",
    "v_labeled": """
SELECT n.id, n.route, n.departure, n.destination, n.icao_location, n.classification, n.selection_code, n.text,
 l.criticality, l.score, l.reason, n.pos
FROM (SELECT * FROM v_route_notices QUALIFY row_number() OVER (PARTITION BY id ORDER BY route_no, pos) = 1) n
JOIN v_labels l ON l.notice_id = n.id""",
    "v_replies": """
SELECT id AS notice_id, a.attempt, CASE WHEN (pos + a.attempt) % 4 = 0 OR pos % 29 = 3 THEN 429 WHEN pos % 31 = 4 THEN 400 ELSE 200 END AS status,
 CASE WHEN pos % 3 = 0 THEN '```json' || chr(10) ELSE '' END || '{"criticality":"' ||
 CASE WHEN pos % 100 < 8 THEN 'high' WHEN pos % 17 = 0 THEN 'SEVERE' ELSE 'low' END || '","score":' ||
 CASE WHEN pos % 19 = 0 THEN '140' WHEN pos % 23 = 0 THEN '"85.7"' ELSE CAST(pos % 100 AS VARCHAR) END ||
 ',"reason":"r' || CAST(a.attempt AS VARCHAR) || '"}' ||
 CASE WHEN pos % 3 = 0 THEN chr(10) || '```' ELSE '' END AS reply, pos
FROM v_notices CROSS JOIN (SELECT unnest([1,2,3,4,5]) AS attempt) a""",
    "v_airports": """
SELECT c_custkey AS pos, c_name AS name, n_name AS country,
 CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE 'A' || CAST(c_custkey % 400 AS VARCHAR) END AS iata, 'KA' || CAST(c_custkey AS VARCHAR) AS icao,
 25.0::DOUBLE + CAST((c_custkey * 53) % 2400 AS DOUBLE) / 100.0::DOUBLE AS lat,
 -124.0::DOUBLE + CAST((c_custkey * 77) % 5700 AS DOUBLE) / 100.0::DOUBLE AS lon,
 CAST(c_custkey % 3000 AS INT) AS elevation,
 CASE c_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'Pacific/Honolulu' WHEN 2 THEN 'America/Anchorage' WHEN 3 THEN 'America/Chicago' ELSE 'America/New_York' END AS tz_name
FROM customer JOIN nation ON n_nationkey = c_nationkey""",
    # one flight per order: from the customer's airport to one derived from the date
    "v_flights": """
SELECT f.route_id, a.lat AS dep_lat, a.lon AS dep_lon, b.lat AS dst_lat, b.lon AS dst_lon
FROM (SELECT o_orderkey AS route_id, 'KA' || CAST(o_custkey AS VARCHAR) AS dep,
             'KA' || CAST((o_custkey * 7 + datediff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE))) % 150 AS VARCHAR) AS dst FROM orders) f
JOIN v_airports a ON a.icao = f.dep JOIN v_airports b ON b.icao = f.dst""",
    "v_pred": """
SELECT l.notice_id, n.pos, l.criticality AS y_true, CASE WHEN n.pos % 5 = 0 THEN 'LOW' WHEN n.pos % 23 = 0 THEN 'HIGH' ELSE l.criticality END AS y_pred,
 CASE WHEN n.pos % 7 = 0 THEN 'MEDIUM' ELSE l.criticality END AS y_pred2,
 CAST((n.pos * 7919) % 10007 AS DOUBLE) / 10007.0::DOUBLE AS anomaly_score,
 n.icao_location, n.classification, n.text, l.reason
FROM v_labels l JOIN v_notices n ON n.id = l.notice_id""",
    "v_scored": """
SELECT r.route_no, r.route, r.departure, r.destination, r.pos, p.notice_id, r.text, p.y_pred2 AS lr_criticality,
 CAST(250 + p.pos % 751 AS DOUBLE) / 1000.0::DOUBLE AS lr_confidence, p.y_pred AS rf_criticality,
 CAST(250 + (p.pos * 3) % 751 AS DOUBLE) / 1000.0::DOUBLE AS rf_confidence,
 p.anomaly_score, p.anomaly_score >= 0.95::DOUBLE AS is_anomaly, p.y_pred2 = p.y_pred AS models_agree, p.y_pred AS final_criticality
FROM v_route_notices r JOIN v_pred p ON p.notice_id = r.id""",
}


def with_views(sql: str) -> str:
    """Put the views a statement reads in front of it as common table expressions."""
    needed: list[str] = []

    def add(text: str) -> None:
        for name in re.findall(r"\bv_[a-z_]+\b", text):
            if name in SQL and name not in needed:
                add(SQL[name])
                needed.append(name)

    add(sql)
    ctes = ",\n".join(f"{n} AS ({SQL[n]})" for n in needed)
    body = sql.strip()
    if not ctes:
        return body
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def _case(c, table: dict, default=None):
    out = F.lit(default)
    for key, value in table.items():
        out = F.when(c == key, value).otherwise(out)
    return out


class Views:
    """The same views as DataFrames over one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def notices(self) -> DataFrame:
        d = F.col("doc_id")
        # The join needs this partitioning on large tables anyway; on one small file it spreads the texts.
        docs = self.table("documents").select("doc_id", "text", "lang", "source").repartition("doc_id")
        events = self.table("events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
        return docs.join(events, F.col("event_id") == d).select(
            d.alias("pos"),
            F.concat(F.lit("ENTRY_1_"), d.cast("string")).alias("id"),
            _case(d % 10, {0: "R", 1: "C"}, "N").alias("type"),
            F.col("ts").alias("issued"),
            F.when(d % 5 >= 3, F.concat(F.lit("Q"), F.upper(F.substring("event_type", 1, 4)))).alias("selection_code"),
            _case(d % 7, {0: "NBO", 1: "BO", 2: "O", 3: "M", 4: "K", 6: "NB"}).alias("purpose"),
            _case(d % 6, {0: "A", 1: "E", 2: "W", 3: "AE", 4: "K"}).alias("scope"),
            _case(d % 8, {0: "R", 1: "A", 2: "C", 3: "H"}).alias("series"),
            _case(d % 9, {0: "FDC", 1: "INTL", 2: "MIL", 3: "LMIL"}, "DOM").alias("classification"),
            F.when(d % 11 != 0, F.concat(F.lit("K"), F.upper("source"))).alias("icao_location"),
            (F.lit(25.0) + (d * 37 % 2400).cast("double") / 100.0).alias("lat"),
            (F.lit(-124.0) + (d * 91 % 5700).cast("double") / 100.0).alias("lon"),
            "text", "lang",
        )

    def routes(self) -> DataFrame:
        return self.spark.createDataFrame(list(domain.ROUTES), "route_no int, route string, departure string, destination string")

    def route_notices(self) -> DataFrame:
        """Notices on the routes they belong to; the route list is a literal, so no join is needed."""
        routes = F.array(*[
            F.struct(F.lit(n).alias("route_no"), F.lit(r).alias("route"), F.lit(a).alias("departure"), F.lit(b).alias("destination"))
            for n, r, a, b in domain.ROUTES
        ])
        spread = self.notices().withColumn("_r", F.explode(routes))
        return spread.where(F.col("pos") % (F.col("_r.route_no") + 2) == 0).select("_r.*", *[c for c in spread.columns if c != "_r"])

    def labels(self) -> DataFrame:
        p = F.col("pos")
        m = p % 100
        return self.notices().where(p % 13 != 12).select(
            F.col("id").alias("notice_id"),
            F.when(m < 8, "HIGH").when(m < 29, "MEDIUM").when(m < 83, "LOW").otherwise("INFO").alias("criticality"),
            F.when(m < 8, 75 + p % 26).when(m < 29, 40 + p % 35).when(m < 83, 15 + p % 25).otherwise(p % 15).alias("score"),
            F.when(p % 97 == 5, "LABELING_FAILED: timeout").otherwise("auto").alias("reason"),
        )

    def labeled(self) -> DataFrame:
        from noticewing.operators import dedupe, lookup

        return lookup.attach_labels(dedupe.keep_first(self.route_notices(), "id", ["route_no", "pos"]), self.labels())

    def replies(self) -> DataFrame:
        p, a = F.col("pos"), F.col("attempt")
        fenced = p % 3 == 0
        return self.notices().select("id", "pos", F.explode(F.array(*[F.lit(i) for i in range(1, 6)])).alias("attempt")).select(
            F.col("id").alias("notice_id"), "attempt",
            F.when(((p + a) % 4 == 0) | (p % 29 == 3), 429).when(p % 31 == 4, 400).otherwise(200).alias("status"),
            F.concat(
                F.when(fenced, "```json\n").otherwise(""), F.lit('{"criticality":"'),
                F.when(p % 100 < 8, "high").when(p % 17 == 0, "SEVERE").otherwise("low"), F.lit('","score":'),
                F.when(p % 19 == 0, "140").when(p % 23 == 0, '"85.7"').otherwise((p % 100).cast("string")),
                F.lit(',"reason":"r'), a.cast("string"), F.lit('"}'), F.when(fenced, "\n```").otherwise(""),
            ).alias("reply"),
            "pos",
        )

    def airports(self) -> DataFrame:
        k = F.col("c_custkey")
        nation = self.table("nation").select("n_nationkey", "n_name")
        return self.table("customer").join(nation, F.col("n_nationkey") == F.col("c_nationkey")).select(
            k.alias("pos"), F.col("c_name").alias("name"), F.col("n_name").alias("country"),
            F.when(k % 9 != 0, F.concat(F.lit("A"), (k % 400).cast("string"))).alias("iata"),
            F.concat(F.lit("KA"), k.cast("string")).alias("icao"),
            (F.lit(25.0) + (k * 53 % 2400).cast("double") / 100.0).alias("lat"),
            (F.lit(-124.0) + (k * 77 % 5700).cast("double") / 100.0).alias("lon"),
            (k % 3000).cast("int").alias("elevation"),
            _case(k % 6, {1: "Pacific/Honolulu", 2: "America/Anchorage", 3: "America/Chicago", 4: "America/New_York", 5: "America/New_York"}).alias("tz_name"),
        )

    def flights(self) -> DataFrame:
        days = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date"))
        legs = self.table("orders").select(
            F.col("o_orderkey").alias("route_id"),
            F.concat(F.lit("KA"), F.col("o_custkey").cast("string")).alias("dep"),
            F.concat(F.lit("KA"), ((F.col("o_custkey") * 7 + days) % 150).cast("string")).alias("dst"),
        )
        at = self.airports().select("icao", "lat", "lon")
        dep = at.select(F.col("icao").alias("dep"), F.col("lat").alias("dep_lat"), F.col("lon").alias("dep_lon"))
        dst = at.select(F.col("icao").alias("dst"), F.col("lat").alias("dst_lat"), F.col("lon").alias("dst_lon"))
        return legs.join(dep, "dep").join(dst, "dst").select("route_id", "dep_lat", "dep_lon", "dst_lat", "dst_lon")

    def pred(self) -> DataFrame:
        p = F.col("pos")
        notices = self.notices().select("id", "pos", "icao_location", "classification", "text")
        return self.labels().join(notices, F.col("id") == F.col("notice_id")).select(
            "notice_id", "pos", F.col("criticality").alias("y_true"),
            F.when(p % 5 == 0, "LOW").when(p % 23 == 0, "HIGH").otherwise(F.col("criticality")).alias("y_pred"),
            F.when(p % 7 == 0, "MEDIUM").otherwise(F.col("criticality")).alias("y_pred2"),
            ((p * 7919 % 10007).cast("double") / 10007.0).alias("anomaly_score"),
            "icao_location", "classification", "text", "reason",
        )

    def scored(self) -> DataFrame:
        pred = self.pred().select("notice_id", F.col("pos").alias("ppos"), "y_pred", "y_pred2", "anomaly_score")
        rows = self.route_notices().select("route_no", "route", "departure", "destination", "pos", "id", "text")
        p = F.col("ppos")
        return rows.join(pred, F.col("notice_id") == F.col("id")).select(
            "route_no", "route", "departure", "destination", "pos", "notice_id", "text",
            F.col("y_pred2").alias("lr_criticality"), ((250 + p % 751).cast("double") / 1000.0).alias("lr_confidence"),
            F.col("y_pred").alias("rf_criticality"), ((250 + p * 3 % 751).cast("double") / 1000.0).alias("rf_confidence"),
            "anomaly_score", (F.col("anomaly_score") >= 0.95).alias("is_anomaly"),
            (F.col("y_pred2") == F.col("y_pred")).alias("models_agree"), F.col("y_pred").alias("final_criticality"),
        )
