"""Registered queries: text functions, rule score, filters, lookups, duplicates, profiles, metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from noticewing import domain
from noticewing.catalog.registry import query
from noticewing.catalog.views import Views
from noticewing.functions import text as tx
from noticewing.operators import dedupe, filters, lookup, metrics, profile, ranking, spatial
from noticewing.plans import order as od

LEVEL_VALUES = ", ".join(f"('{lv}')" for lv in domain.LEVELS)
STOP_SQL = ", ".join(f"'{w.upper()}'" for w in domain.STOPWORDS)
FIVE_SUM = "count(*) FILTER (WHERE criticality = '{0}') AS \"{0}\""
LEVEL_COUNTS = ", ".join(f"count(*) FILTER (WHERE criticality = '{lv}') AS \"{lv}\"" for lv in domain.LEVELS)
LEVEL_SHARES = ", ".join(
    f"round(count(*) FILTER (WHERE criticality = '{lv}') * 100.0::DOUBLE / count(*), 6) AS \"{lv}\"" for lv in domain.LEVELS
)
WORD_COUNT = r"len(regexp_extract_all(text, '\S+'))"
QFLAG = "CASE WHEN selection_code IS NOT NULL AND selection_code NOT IN ('', 'None') THEN 'Has Q-Code' ELSE 'No Q-Code' END"

PURPOSE_SQL = """CASE WHEN purpose LIKE '%N%' THEN 50 WHEN purpose LIKE '%B%' THEN 25
 WHEN purpose LIKE '%O%' THEN 10 WHEN purpose LIKE '%M%' THEN 5 ELSE 0 END"""
TYPE_SQL = "CASE type WHEN 'R' THEN 50 WHEN 'N' THEN 20 ELSE 10 END"
CLASS_SQL = "CASE WHEN classification IN ('MIL', 'LMIL') THEN 10 ELSE 0 END"
SCOPE_SQL = """CASE WHEN series = 'R' THEN 20 ELSE 0 END + CASE WHEN scope LIKE '%A%' THEN 20 ELSE 0 END
 + CASE WHEN scope LIKE '%E%' THEN 10 ELSE 0 END + CASE WHEN scope LIKE '%W%' THEN 5 ELSE 0 END"""
TOTAL_SQL = f"({PURPOSE_SQL}) + ({TYPE_SQL}) + ({CLASS_SQL}) + ({SCOPE_SQL})"

# ---------------------------------------------------------------- text and codes


@query("char_sets", """
SELECT id, array_to_string(list_sort(list_distinct(string_split(purpose, ''))), ',') AS purpose_set,
       array_to_string(list_sort(list_distinct(string_split(scope, ''))), ',') AS scope_set FROM v_notices""")
def _(v: Views):
    sets = {f"{c}_set": F.array_join(F.array_sort(tx.char_set(F.col(c))), ",") for c in ("purpose", "scope")}
    return v.notices().select("id", *[e.alias(n) for n, e in sets.items()])


@query("effective_end", """
SELECT id, CASE WHEN pos % 6 = 0 THEN NULL WHEN pos % 6 = 1 THEN NULL ELSE strftime(issued, '%Y-%m-%d %H:%M:%S') END AS effective_end,
       pos % 6 = 0 AS is_permanent FROM v_notices""")
def _(v: Views):
    iso = F.date_format("issued", "yyyy-MM-dd'T'HH:mm:ss'.000Z'")
    given = F.when(F.col("pos") % 6 == 0, "PERM").when(F.col("pos") % 6 == 1, "soon").otherwise(iso)
    end = v.notices().select("id", tx.effective_end(given).alias("e")).select("id", "e.*")
    return end.withColumn("effective_end", F.date_format("effective_end", "yyyy-MM-dd HH:mm:ss"))


@query("strip_prefix", "SELECT id, classification, type FROM v_notices")
def _(v: Views):
    printed = v.notices().select(
        "id", F.concat(F.lit("Classification."), "classification").alias("c"), F.concat(F.lit(domain.TYPE_PREFIX), "type").alias("t")
    )
    return printed.select("id", tx.strip_enum(F.col("c")).alias("classification"), tx.strip_enum(F.col("t")).alias("type"))


@query("qcode_flag", f"SELECT id, {QFLAG} AS has_qcode FROM v_notices")
def _(v: Views):
    return v.notices().select("id", tx.qcode_flag(F.col("selection_code")).alias("has_qcode"))


@query("text_head", """
SELECT id, array_to_string(list_slice(string_split(text, chr(10)), 1, 3), chr(10))
 || CASE WHEN len(string_split(text, chr(10))) > 3 THEN chr(10) || '...' ELSE '' END AS head FROM v_notices""")
def _(v: Views):
    return v.notices().select("id", tx.text_head(F.col("text"), 3).alias("head"))


@query("text_lengths", f"SELECT id, {WORD_COUNT} AS word_count, length(text) AS char_count FROM v_notices")
def _(v: Views):
    return profile.text_lengths(v.notices()).select("id", "word_count", "char_count")


# The oracle folds the one letter whose upper case DuckDB keeps and Spark expands.
WORDS_SQL = r"""
SELECT {key}, unnest(regexp_extract_all(upper(replace(text, 'ß', 'ss')), '[\p{{L}}\p{{N}}_]+')) AS w FROM {src}"""


@query("tokens", f"""
SELECT id, count(*) AS n_tokens, count(DISTINCT w) AS n_distinct, min(w) AS first_word, max(w) AS last_word
FROM ({WORDS_SQL.format(key='id', src='v_notices')}) t
WHERE regexp_full_match(w, '[A-Z]{{2,}}') AND w NOT IN ({STOP_SQL}) GROUP BY id""")
def _(v: Views):
    toks = v.notices().select("id", tx.tokens(F.col("text")).alias("t")).where(F.size("t") > 0)
    return toks.select(
        "id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"),
        F.array_min("t").alias("first_word"), F.array_max("t").alias("last_word"),
    )


@query("prompt_text", """
SELECT id, route, 'How much does this notice matter to a flight from ' || departure || ' to ' || destination || '?' || chr(10) || chr(10)
 || id || ', type ' || type || ', class ' || classification || chr(10) || 'At ' || coalesce(icao_location, 'None') || ', ICAO code '
 || coalesce(icao_location, 'None') || ', selection code ' || coalesce(selection_code, 'None') || chr(10)
 || 'In force from ' || strftime(issued, '%Y-%m-%d %H:%M:%S') || ' until PERM' || chr(10) || chr(10) || text || chr(10) || chr(10)
 || 'Answer with one JSON object.' AS prompt FROM v_route_notices""")
def _(v: Views):
    df = v.route_notices()
    cols = {c: F.col(c) for c in ("departure", "destination", "id", "selection_code", "text")}
    cols |= {
        "type": F.concat(F.lit(domain.TYPE_PREFIX), "type"), "classification": F.concat(F.lit("Classification."), "classification"),
        "location": F.col("icao_location"), "icao_location": F.col("icao_location"),
        "effective_start": F.date_format("issued", "yyyy-MM-dd HH:mm:ss"), "effective_end": F.lit("PERM"),
    }
    return df.select("id", "route", tx.prompt_text(cols).alias("prompt"))


@query("label_parse", """
SELECT notice_id, attempt, NOT bad AS ok,
 CASE WHEN bad THEN NULL WHEN pos % 100 < 8 THEN 'HIGH' WHEN pos % 17 = 0 THEN 'INFO' ELSE 'LOW' END AS criticality,
 CASE WHEN bad THEN NULL WHEN pos % 19 = 0 THEN 100 ELSE pos % 100 END AS score,
 CASE WHEN bad THEN NULL ELSE 'r' || CAST(attempt AS VARCHAR) END AS reason
FROM (SELECT *, pos % 23 = 0 AND pos % 19 <> 0 AS bad FROM v_replies) r""")
def _(v: Views):
    return v.replies().select("notice_id", "attempt", tx.parse_reply(F.col("reply")).alias("l")).select("notice_id", "attempt", "l.*")


@query("route_tag", "SELECT route, id, departure, destination FROM v_route_notices")
def _(v: Views):
    return lookup.tag_route(v.route_notices().select("route", "id"), v.routes())


@query("consensus", """
SELECT notice_id, y_pred2 AS lr_criticality, y_pred AS rf_criticality, y_pred = y_pred2 AS models_agree, y_pred AS final_criticality FROM v_pred""")
def _(v: Views):
    df = v.pred().select("notice_id", F.col("y_pred2").alias("lr_criticality"), F.col("y_pred").alias("rf_criticality"))
    return profile.consensus(df)


# ---------------------------------------------------------------- rule score


@query("score_purpose", f"SELECT id, {PURPOSE_SQL} AS purpose_score FROM v_notices")
def _(v: Views):
    return ranking.score_purpose(v.notices()).select("id", "purpose_score")


@query("score_type", f"SELECT id, {TYPE_SQL} AS type_score FROM v_notices")
def _(v: Views):
    return ranking.score_type(v.notices()).select("id", "type_score")


@query("score_classification", f"SELECT id, {CLASS_SQL} AS classification_score FROM v_notices")
def _(v: Views):
    return ranking.score_classification(v.notices()).select("id", "classification_score")


@query("score_scope", f"SELECT id, {SCOPE_SQL} AS scope_score FROM v_notices")
def _(v: Views):
    return ranking.score_scope(v.notices()).select("id", "scope_score")


@query("score_total", f"SELECT id, {TOTAL_SQL} AS rule_score FROM v_notices")
def _(v: Views):
    return ranking.rule_score(v.notices()).select("id", "rule_score")


@query("ranked", f"""
SELECT route, id, rule_score, row_number() OVER (PARTITION BY route ORDER BY rule_score DESC, pos) AS "rank", text
FROM (SELECT *, {TOTAL_SQL} AS rule_score FROM v_route_notices) s""")
def _(v: Views):
    return ranking.rank_notices(v.route_notices(), "route", "pos").select("route", "id", "rule_score", "rank", "text")


# ---------------------------------------------------------------- filters


@query("conus_filter", """
SELECT icao, name FROM v_airports WHERE country = 'NATION_2' AND coalesce(tz_name NOT IN ('Pacific/Honolulu', 'America/Anchorage'), TRUE)""")
def _(v: Views):
    return filters.conus(v.airports(), ("NATION_2",)).select("icao", "name")


@query("active_notices", "SELECT id FROM v_notices WHERE pos % 4 <> 1")
def _(v: Views):
    p = F.col("pos")
    marked = F.when(p % 4 == 1, F.concat(F.lit("Rwy 13 Canceled "), "text")).otherwise(F.col("text"))
    return filters.active_only(v.notices().select("id", marked.alias("text"))).select("id")


@query("trainable", "SELECT id FROM v_labeled WHERE reason NOT LIKE 'LABELING_FAILED%' AND regexp_matches(text, '[^\\s]')".replace("\\\\", "\\"))
def _(v: Views):
    return filters.trainable(v.labeled()).select("id")


# ---------------------------------------------------------------- lookups and joins

CODES_SQL = "SELECT 'A' || CAST(o_custkey % 450 AS VARCHAR) AS code, o_orderkey FROM orders"


def _codes(v: Views):
    return v.table("orders").select(F.concat(F.lit("A"), (F.col("o_custkey") % 450).cast("string")).alias("code"), "o_orderkey")


@query("airport_lookup", f"""
SELECT c.code, c.o_orderkey, a.name, a.country, a.iata, a.icao, a.lat, a.lon, a.elevation, a.tz_name FROM ({CODES_SQL}) c JOIN (
 SELECT * FROM (SELECT x.*, unnest([iata, icao]) AS k FROM v_airports x) y WHERE k IS NOT NULL
 QUALIFY row_number() OVER (PARTITION BY k ORDER BY pos) = 1) a ON a.k = c.code""")
def _(v: Views):
    found, _rejects = lookup.lookup_airports(_codes(v), v.airports())
    return found


@query("airport_rejects", f"""
SELECT c.code, c.o_orderkey FROM ({CODES_SQL}) c
WHERE c.code NOT IN (SELECT iata FROM v_airports WHERE iata IS NOT NULL UNION ALL SELECT icao FROM v_airports)""")
def _(v: Views):
    _found, rejects = lookup.lookup_airports(_codes(v), v.airports())
    return rejects


@query("facility_lookup", f"""
SELECT c.code, c.o_orderkey, a.name, a.country, a.iata, a.icao, a.lat, a.lon, a.elevation, a.state_name FROM ({CODES_SQL}) c JOIN (
 SELECT * FROM (SELECT pos, name, country, iata, icao, lat, lon, elevation,
   CASE WHEN pos % 3 = 0 THEN NULL ELSE 'STATE' || CAST(pos % 50 AS VARCHAR) END AS state_name, unnest([iata, icao]) AS k FROM v_airports) y WHERE k IS NOT NULL
 QUALIFY row_number() OVER (PARTITION BY k ORDER BY pos) = 1) a ON a.k = c.code""")
def _(v: Views):
    a = v.airports()
    raw = a.select(
        "pos", F.col("name").alias("ARPT_NAME"), F.col("country").alias("COUNTRY_CODE"), F.coalesce("iata", F.lit("")).alias("ARPT_ID"),
        F.col("icao").alias("ICAO_ID"), F.col("lat").cast("string").alias("LAT_DECIMAL"), F.col("lon").cast("string").alias("LONG_DECIMAL"),
        F.col("elevation").cast("string").alias("ELEV"),
        F.when(F.col("pos") % 3 == 0, "").otherwise(F.concat(F.lit("STATE"), (F.col("pos") % 50).cast("string"))).alias("STATE_NAME"),
    )
    found, _rejects = lookup.lookup_airports(_codes(v), lookup.facilities_as_places(raw), info=lookup.FACILITY_INFO)
    return found


@query("radius_join", """
SELECT icao, id, round(d, 6) AS distance_nm FROM (
 SELECT a.icao, n.id, 2.0::DOUBLE * 3440.065 * asin(sqrt(least(1.0::DOUBLE, pow(sin(radians(a.lat - n.lat) / 2), 2)
   + cos(radians(n.lat)) * cos(radians(a.lat)) * pow(sin(radians(a.lon - n.lon) / 2), 2)))) AS d
 FROM v_notices n CROSS JOIN v_airports a) x WHERE d <= 30""")
def _(v: Views):
    points = v.airports().select("icao", F.col("lat").alias("point_lat"), F.col("lon").alias("point_lon"))
    notices = v.notices().select("id", "pos", "lat", "lon")
    return spatial.radius_join(notices, points, 30.0).select("icao", "id", F.round("distance_nm", 6).alias("distance_nm"))


STORE_SQL = "(SELECT notice_id FROM v_labels WHERE reason NOT LIKE 'LABELING_FAILED%')"


def _store(v: Views):
    return v.labels().where(~F.col("reason").startswith(domain.FAILED_PREFIX))


@query("cache_hits", f"SELECT route, id FROM v_route_notices WHERE id IN {STORE_SQL}")
def _(v: Views):
    hits, _todo = lookup.split_cached(v.route_notices().select("route", "id"), _store(v))
    return hits


@query("to_label", f"SELECT route, id FROM v_route_notices WHERE id NOT IN {STORE_SQL}")
def _(v: Views):
    _hits, todo = lookup.split_cached(v.route_notices().select("route", "id"), _store(v))
    return todo


@query("labeled", """
SELECT n.id, n.route, n.departure, n.destination, n.icao_location, n.classification, n.selection_code, n.text,
 l.criticality, l.score, l.reason FROM v_route_notices n JOIN v_labels l ON l.notice_id = n.id""")
def _(v: Views):
    return lookup.attach_labels(v.route_notices(), v.labels())


TOP20_SQL = "(SELECT * FROM v_pred ORDER BY anomaly_score DESC, pos LIMIT 20)"


@query("rare_airport", f"""
SELECT t.notice_id, t.icao_location, coalesce(c.n, 0) AS airport_total, coalesce(c.n, 0) < 46 AS likely_rare
FROM {TOP20_SQL} t LEFT JOIN (SELECT icao_location, count(*) AS n FROM v_pred WHERE icao_location IS NOT NULL GROUP BY 1) c
ON c.icao_location = t.icao_location""")
def _(v: Views):
    pred = v.pred()
    top = profile.nlargest(pred, "anomaly_score", 20, "pos")
    return lookup.rare_airports(top, pred, threshold=46).select("notice_id", "icao_location", "airport_total", "likely_rare")


@query("rare_share", f"""
SELECT CAST(count(*) - sum(r) AS BIGINT) AS content_driven, CAST(sum(r) AS BIGINT) AS rare_driven, round((count(*) - sum(r)) * 100.0::DOUBLE / count(*), 6) AS content_pct,
 round(sum(r) * 100.0::DOUBLE / count(*), 6) AS rare_pct
FROM (SELECT CASE WHEN coalesce(c.n, 0) < 46 THEN 1 ELSE 0 END AS r
 FROM {TOP20_SQL} t LEFT JOIN (SELECT icao_location, count(*) AS n FROM v_pred WHERE icao_location IS NOT NULL GROUP BY 1) c
 ON c.icao_location = t.icao_location) x""")
def _(v: Views):
    pred = v.pred()
    return lookup.rare_share(lookup.rare_airports(profile.nlargest(pred, "anomaly_score", 20, "pos"), pred, threshold=46))


@query("feature_align", """
SELECT l.notice_id AS id, l.criticality, e.label AS vector_label, len(e.embedding) AS dims
FROM v_labels l JOIN embeddings e ON l.notice_id = 'ENTRY_1_' || CAST(e.vec_id AS VARCHAR)""")
def _(v: Views):
    labels = v.labels().select(F.col("notice_id").alias("id"), "criticality")
    vectors = v.table("embeddings").select(
        F.concat(F.lit("ENTRY_1_"), F.col("vec_id").cast("string")).alias("id"), F.col("label").alias("vector_label"),
        F.size("embedding").alias("dims"),
    )
    return lookup.align_features(labels, vectors)


# ---------------------------------------------------------------- duplicates


@query("dedupe_waypoints", """
SELECT route_no, route, pos, id, text FROM v_route_notices
QUALIFY row_number() OVER (PARTITION BY id ORDER BY route_no, pos) = 1""")
def _(v: Views):
    rows = v.route_notices().select("route_no", "route", "pos", "id", "text")
    return dedupe.keep_first(rows, "id", ["route_no", "pos"])


REPEATED_SQL = "(SELECT route_no, id, pos, r FROM v_route_notices CROSS JOIN (SELECT unnest([0, 1]) AS r) x)"


@query("dedupe_across_waypoints", f"""
SELECT route_no, id, pos, r FROM {REPEATED_SQL} d QUALIFY route_no = min(route_no) OVER (PARTITION BY id)""")
def _(v: Views):
    rows = v.route_notices().select("route_no", "id", "pos", F.explode(F.array(F.lit(0), F.lit(1))).alias("r"))
    return dedupe.keep_first(rows, "id", ["route_no", "pos"], scope="across_waypoints")


@query("dedupe_ids", """
SELECT id, route, departure, destination, pos FROM v_route_notices QUALIFY row_number() OVER (PARTITION BY id ORDER BY route_no, pos) = 1""")
def _(v: Views):
    rows = v.route_notices().select("route_no", "id", "route", "departure", "destination", "pos")
    return dedupe.keep_first(rows, "id", ["route_no", "pos"]).drop("route_no")


@query("dedupe_stats", """
SELECT count(*) AS total, count(DISTINCT id) AS kept, count(*) - count(DISTINCT id) AS removed FROM v_route_notices""")
def _(v: Views):
    return dedupe.dedupe_stats(v.route_notices(), "id")


@query("route_union", "SELECT route_no, route, id, pos FROM v_route_notices")
def _(v: Views):
    rows = v.route_notices().select("route", "id", "pos")
    parts = [rows.where(F.col("route") == name) for _, name, _, _ in domain.ROUTES]
    return dedupe.union_routes(parts)


FIRST_SQL = """
SELECT notice_id, coalesce(max(criticality), 'INFO') AS criticality, coalesce(max(score), 0) AS score,
 coalesce(max(reason), 'LABELING_FAILED: ' || CASE WHEN bool_or(status = 400) THEN 'HTTP 400' WHEN bool_or(status = 200) THEN 'invalid reply' ELSE 'None' END) AS reason,
 max(won) AS attempt
FROM (SELECT *, good AND attempt = min(CASE WHEN good THEN attempt END) OVER (PARTITION BY notice_id) AS first FROM
  (SELECT *, status = 200 AND NOT (pos % 23 = 0 AND pos % 19 <> 0) AS good FROM v_replies) g) h,
 LATERAL (SELECT CASE WHEN first THEN CASE WHEN pos % 100 < 8 THEN 'HIGH' WHEN pos % 17 = 0 THEN 'INFO' ELSE 'LOW' END END AS criticality,
  CASE WHEN first THEN CASE WHEN pos % 19 = 0 THEN 100 ELSE pos % 100 END END AS score,
  CASE WHEN first THEN 'r' || CAST(attempt AS VARCHAR) END AS reason, CASE WHEN first THEN attempt END AS won) z
GROUP BY notice_id"""


@query("first_success", FIRST_SQL)
def _(v: Views):
    return dedupe.first_success(v.replies())


# ---------------------------------------------------------------- profiles


@query("merged_summary", """
SELECT 'total' AS section, '' AS value, count(*) AS n FROM v_route_notices
UNION ALL SELECT 'empty_text', '', count(*) FILTER (WHERE pos % 41 = 0) FROM v_route_notices
UNION ALL SELECT 'route', route, count(*) FROM v_route_notices GROUP BY route
UNION ALL SELECT 'classification', classification, count(*) FROM v_route_notices GROUP BY classification""")
def _(v: Views):
    rows = v.route_notices().withColumn("text", F.when(F.col("pos") % 41 == 0, " \n ").otherwise(F.col("text")))
    return profile.merged_summary(rows)


@query("top_codes", """
SELECT coalesce(selection_code, '(none)') AS selection_code, count(*) AS n FROM v_notices GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10""")
def _(v: Views):
    return profile.top_codes(v.notices())


@query("label_summary", f"""
SELECT l.lv AS criticality, count(x.notice_id) AS n, round(count(x.notice_id) * 100.0::DOUBLE / t.total, 6) AS pct,
 repeat('█', CAST(floor(count(x.notice_id) * 100.0::DOUBLE / t.total / 2) AS INT)) AS bar, t.failed, count(x.notice_id) < 50 AS warning
FROM (VALUES {LEVEL_VALUES}) l(lv) CROSS JOIN (SELECT count(*) AS total, count(*) FILTER (WHERE reason LIKE 'LABELING_FAILED%') AS failed FROM v_labels) t
LEFT JOIN v_labels x ON x.criticality = l.lv GROUP BY l.lv, t.total, t.failed""")
def _(v: Views):
    return profile.label_summary(v.labels()).drop("total")


@query("class_distribution", """
SELECT criticality, count(*) AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM v_labeled), 6) AS pct,
 (SELECT round(count(*) FILTER (WHERE criticality = 'LOW')::DOUBLE / count(*) FILTER (WHERE criticality = 'HIGH'), 6) FROM v_labeled) AS low_high_ratio
FROM v_labeled GROUP BY criticality""")
def _(v: Views):
    return profile.class_distribution(v.labeled())


WC_SQL = f"(SELECT criticality, {WORD_COUNT} AS wc FROM v_labeled)"


@query("length_median", f"SELECT criticality, median(wc)::DOUBLE AS median_words FROM {WC_SQL} t GROUP BY criticality")
def _(v: Views):
    return profile.length_median(v.labeled())


@query("length_box", f"""
WITH w AS {WC_SQL}, q AS (SELECT criticality, quantile_cont(wc, 0.25)::DOUBLE AS q1, quantile_cont(wc, 0.5)::DOUBLE AS median, quantile_cont(wc, 0.75)::DOUBLE AS q3 FROM w GROUP BY 1)
SELECT q.criticality, q1, median, q3, min(wc) FILTER (WHERE wc >= q1 - 1.5 * (q3 - q1)) AS whisker_low,
 max(wc) FILTER (WHERE wc <= q3 + 1.5 * (q3 - q1)) AS whisker_high,
 count(*) FILTER (WHERE wc < q1 - 1.5 * (q3 - q1) OR wc > q3 + 1.5 * (q3 - q1)) AS outliers
FROM w JOIN q ON q.criticality = w.criticality GROUP BY q.criticality, q1, median, q3""")
def _(v: Views):
    return profile.length_box(v.labeled())


@query("length_hist", f"""
WITH w AS {WC_SQL}, e AS (SELECT criticality, min(wc)::DOUBLE AS lo, max(wc)::DOUBLE AS hi FROM w GROUP BY 1)
SELECT w.criticality, CAST(least(floor((wc - lo) / ((hi - lo) / 40.0::DOUBLE)), 39) AS INT) AS bin, count(*) AS n
FROM w JOIN e ON e.criticality = w.criticality GROUP BY 1, 2""")
def _(v: Views):
    return profile.length_hist(v.labeled())


@query("top_words", f"""
SELECT criticality, word, n FROM (SELECT criticality, w AS word, count(*) AS n FROM ({WORDS_SQL.format(key='criticality', src='v_labeled')}) t
 WHERE regexp_full_match(w, '[A-Z]{{2,}}') AND w NOT IN ({STOP_SQL}) GROUP BY 1, 2) c
QUALIFY row_number() OVER (PARTITION BY criticality ORDER BY n DESC, word) <= 15""")
def _(v: Views):
    return profile.top_words(v.labeled())


@query("top_airports", """
SELECT criticality, icao_location, count(*) AS n FROM v_labeled WHERE criticality IN ('HIGH', 'LOW') AND icao_location IS NOT NULL
GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY criticality ORDER BY count(*) DESC, icao_location) <= 15""")
def _(v: Views):
    return profile.top_airports(v.labeled())


@query("top_high_codes", """
SELECT selection_code, count(*) AS n FROM v_labeled WHERE criticality = 'HIGH' AND selection_code IS NOT NULL
GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10""")
def _(v: Views):
    return profile.top_high_codes(v.labeled())


@query("xtab_classification", f"SELECT classification, {LEVEL_COUNTS} FROM v_labeled GROUP BY classification")
def _(v: Views):
    return profile.crosstab(v.labeled(), "classification")


@query("xtab_classification_pct", f"SELECT classification, {LEVEL_SHARES} FROM v_labeled GROUP BY classification")
def _(v: Views):
    return profile.crosstab(v.labeled(), "classification", normalize="index")


@query("xtab_route", f"SELECT route, {LEVEL_COUNTS} FROM v_labeled GROUP BY route")
def _(v: Views):
    return profile.crosstab(v.labeled(), "route")


@query("xtab_route_pct", f"SELECT route, {LEVEL_SHARES} FROM v_labeled GROUP BY route")
def _(v: Views):
    return profile.crosstab(v.labeled(), "route", normalize="index")


@query("xtab_qcode", f"SELECT {QFLAG} AS has_qcode, {LEVEL_SHARES} FROM v_labeled GROUP BY 1")
def _(v: Views):
    df = v.labeled().withColumn("has_qcode", tx.qcode_flag(F.col("selection_code")))
    return profile.crosstab(df, "has_qcode", normalize="index")


@query("qcode_counts", f"SELECT {QFLAG} AS has_qcode, count(*) AS n FROM v_labeled GROUP BY 1")
def _(v: Views):
    return od.value_counts(v.labeled().select(tx.qcode_flag(F.col("selection_code")).alias("has_qcode")), "has_qcode")


@query("score_means", "SELECT criticality, round(avg(score), 1) AS mean_score FROM v_labeled GROUP BY criticality")
def _(v: Views):
    return profile.score_means(v.labeled())


@query("score_kde", """
WITH s AS (SELECT criticality, count(*)::DOUBLE AS n, stddev_samp(score) * pow(count(*), -0.2) AS h FROM v_labeled GROUP BY 1),
 g AS (SELECT unnest(range(0, 100)) AS g)
SELECT criticality, CAST(g AS INT) AS g, round(density, 6) AS density FROM (
 SELECT s.criticality, g.g, sum(exp(-0.5 * pow((g.g * (100.0::DOUBLE / 99) - l.score) / s.h, 2))) / (s.n * s.h * sqrt(2 * pi())) AS density
 FROM v_labeled l JOIN s ON s.criticality = l.criticality CROSS JOIN g GROUP BY s.criticality, g.g, s.n, s.h) d""")
def _(v: Views):
    return profile.kde(v.labeled(), "score", "criticality").select("criticality", "g", F.round("density", 6).alias("density"))


@query("eda_findings", f"""
SELECT count(*) AS total, round(count(*) FILTER (WHERE criticality = 'HIGH') * 100.0::DOUBLE / count(*), 6) AS high_pct,
 round(count(*) FILTER (WHERE criticality = 'LOW') * 100.0::DOUBLE / count(*), 6) AS low_pct,
 round(count(*) FILTER (WHERE q = 'No Q-Code') * 100.0::DOUBLE / count(*), 6) AS no_qcode_pct,
 (median(wc) FILTER (WHERE criticality = 'HIGH'))::DOUBLE AS high_median_words, (median(wc) FILTER (WHERE criticality = 'LOW'))::DOUBLE AS low_median_words,
 (median(wc) FILTER (WHERE criticality = 'INFO'))::DOUBLE AS info_median_words,
 round(count(*) FILTER (WHERE criticality = 'LOW')::DOUBLE / count(*) FILTER (WHERE criticality = 'HIGH'), 6) AS imbalance
FROM (SELECT criticality, {WORD_COUNT} AS wc, {QFLAG} AS q FROM v_labeled) t""")
def _(v: Views):
    return profile.eda_findings(v.labeled())


# ---------------------------------------------------------------- anomaly profiles on a given score

FLAGGED_SQL = "(SELECT *, y_true AS criticality, anomaly_score >= (SELECT quantile_cont(anomaly_score, 0.95) FROM v_pred) AS is_anomaly FROM v_pred)"


def _flagged(v: Views):
    from noticewing.models import iforest

    return iforest.flag(v.pred().withColumnRenamed("y_true", "criticality"), "anomaly_score", mode="batch_percentile")


@query("percentile_flag", f"SELECT notice_id, is_anomaly FROM {FLAGGED_SQL} t")
def _(v: Views):
    return _flagged(v).select("notice_id", "is_anomaly")


@query("percentile_flag_by_route", """
SELECT route, notice_id, anomaly_score >= quantile_cont(anomaly_score, 0.95) OVER (PARTITION BY route) AS is_anomaly FROM v_scored""")
def _(v: Views):
    from noticewing.models import iforest

    return iforest.flag(v.scored(), mode="batch_percentile", by="route").select("route", "notice_id", "is_anomaly")


@query("score_quantiles", """
SELECT p.prob, round((SELECT quantile_cont(anomaly_score, [0.05, 0.25, 0.5, 0.75, 0.95])[p.i] FROM v_pred), 9) AS quantile
FROM (VALUES (1, 0.05::DOUBLE), (2, 0.25), (3, 0.5), (4, 0.75), (5, 0.95)) p(i, prob)""")
def _(v: Views):
    q = od.exact_quantiles(v.pred(), "anomaly_score", [0.05, 0.25, 0.5, 0.75, 0.95])
    return q.select("prob", F.round("quantile", 9).alias("quantile"))


@query("anomaly_by_class", f"""
SELECT criticality, count(*) FILTER (WHERE is_anomaly) AS flagged, count(*) AS total,
 round(count(*) FILTER (WHERE is_anomaly) * 100.0::DOUBLE / count(*), 6) AS pct FROM {FLAGGED_SQL} t GROUP BY criticality""")
def _(v: Views):
    return profile.flag_rate(_flagged(v))


@query("anomaly_hist", """
WITH e AS (SELECT min(anomaly_score) AS lo, max(anomaly_score) AS hi FROM v_pred)
SELECT CAST(least(floor((anomaly_score - lo) / ((hi - lo) / 60.0::DOUBLE)), 59) AS INT) AS bin, count(*) AS n FROM v_pred CROSS JOIN e GROUP BY 1""")
def _(v: Views):
    return profile.histogram(v.pred(), "anomaly_score", 60)


@query("anomaly_threshold", f"SELECT round(min(anomaly_score), 9) AS threshold FROM {FLAGGED_SQL} t WHERE is_anomaly")
def _(v: Views):
    return _flagged(v).where("is_anomaly").agg(F.round(F.min("anomaly_score"), 9).alias("threshold"))


@query("anomaly_quartiles", """
SELECT y_true AS criticality, p.prob, round(quantile_cont(anomaly_score, 0.25) FILTER (WHERE p.prob = 0.25), 9) AS q25,
 round(quantile_cont(anomaly_score, 0.5) FILTER (WHERE p.prob = 0.5), 9) AS q50, round(quantile_cont(anomaly_score, 0.75) FILTER (WHERE p.prob = 0.75), 9) AS q75
FROM v_pred CROSS JOIN (VALUES (0.25::DOUBLE), (0.5), (0.75)) p(prob) GROUP BY 1, 2""")
def _(v: Views):
    long = od.exact_quantiles_by(v.pred(), "anomaly_score", [0.25, 0.5, 0.75], "y_true")
    cols = [F.round(F.when(F.col("prob") == p, F.col("quantile")), 9).alias(n) for p, n in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))]
    return long.select(F.col("y_true").alias("criticality"), "prob", *cols)


@query("top_anomalies", f"""
SELECT notice_id, icao_location, classification, y_true AS criticality, anomaly_score, substr(text, 1, 120) AS text_preview, substr(reason, 1, 100) AS reason_preview
FROM {TOP20_SQL} t""")
def _(v: Views):
    top = profile.nlargest(v.pred(), "anomaly_score", 20, "pos")
    return top.select(
        "notice_id", "icao_location", "classification", F.col("y_true").alias("criticality"), "anomaly_score",
        tx.preview(F.col("text"), 120).alias("text_preview"), tx.preview(F.col("reason"), 100).alias("reason_preview"),
    )


@query("top_anomaly_breakdown", f"""
SELECT dimension, value, n FROM (
 SELECT 'criticality' AS dimension, y_true AS value, count(*) AS n FROM {TOP20_SQL} t GROUP BY 2
 UNION ALL SELECT 'classification', classification, count(*) FROM {TOP20_SQL} t GROUP BY 2
 UNION ALL SELECT 'icao_location', icao_location, count(*) FROM {TOP20_SQL} t WHERE icao_location IS NOT NULL GROUP BY 2) u
QUALIFY row_number() OVER (PARTITION BY dimension ORDER BY n DESC, value) <= 10""")
def _(v: Views):
    top = profile.nlargest(v.pred(), "anomaly_score", 20, "pos").withColumnRenamed("y_true", "criticality")
    return profile.top_breakdown(top, ["criticality", "classification", "icao_location"])


@query("run_summary", """
SELECT count(*) AS scored, count(*) FILTER (WHERE NOT models_agree) AS disagreements, count(*) FILTER (WHERE is_anomaly) AS anomalies FROM v_scored""")
def _(v: Views):
    return profile.run_summary(v.scored())


# ---------------------------------------------------------------- metrics

CELLS = ", ".join(f"count(*) FILTER (WHERE y_pred = '{lv}') AS \"{lv}\"" for lv in domain.LEVELS)
REPORT_SQL = """(SELECT criticality, support, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS precision,
 CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall, CASE WHEN predicted + support > 0 THEN 2 * tp / (predicted + support) ELSE 0 END AS f1
 FROM (SELECT l.lv AS criticality, count(*) FILTER (WHERE y_true = lv AND {p} = lv)::DOUBLE AS tp, count(*) FILTER (WHERE {p} = lv)::DOUBLE AS predicted,
  count(*) FILTER (WHERE y_true = lv)::DOUBLE AS support FROM v_pred CROSS JOIN (VALUES {lv}) l(lv) GROUP BY l.lv) c)"""
METRIC_SQL = """SELECT '{m}' AS model, (SELECT round(avg(CASE WHEN y_true = {p} THEN 100.0::DOUBLE ELSE 0 END), 1) FROM v_pred) AS accuracy,
 round(avg(f1) * 100, 1) AS macro_f1, round(sum(f1 * support) / sum(support) * 100, 1) AS weighted_f1,
 round(max(f1) FILTER (WHERE criticality = 'HIGH') * 100, 1) AS high_f1 FROM {r} t"""


def _metric_sql(name: str, pred: str) -> str:
    return METRIC_SQL.format(m=name, p=pred, r=REPORT_SQL.format(p=pred, lv=LEVEL_VALUES))


@query("confusion", f"SELECT y_true, {CELLS} FROM v_pred GROUP BY y_true")
def _(v: Views):
    return metrics.confusion(v.pred())


@query("class_report", f"""
SELECT criticality, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support
FROM {REPORT_SQL.format(p='y_pred', lv=LEVEL_VALUES)} t""")
def _(v: Views):
    return metrics.class_report(v.pred())


@query("model_metrics", _metric_sql("forest", "y_pred"))
def _(v: Views):
    return metrics.model_metrics(v.pred(), "forest")


@query("model_compare", f"""
WITH m AS ({_metric_sql('forest', 'y_pred')} UNION ALL {_metric_sql('linear', 'y_pred2')}),
 l AS (SELECT model, metric, value FROM m UNPIVOT (value FOR metric IN (accuracy, macro_f1, weighted_f1, high_f1)))
SELECT metric, arg_max(model, value) AS winner, round(max(value) - min(value), 1) AS spread FROM l GROUP BY metric""")
def _(v: Views):
    pred = v.pred()
    return metrics.compare_models([metrics.model_metrics(pred, "forest"), metrics.model_metrics(pred, "linear", y_pred="y_pred2")])
