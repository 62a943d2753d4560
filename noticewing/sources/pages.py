"""Landed responses of the notice service: reading, triage, strict validation, flattening.

A response body is parsed once into a variant; every check is a column expression on it, so pages
are validated where they are read, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticewing import domain
from noticewing.functions import text as tx
from noticewing.plans import storage

CORE = f"$.properties.{domain.CORE_KEY}"
NOTICE = f"{CORE}.{domain.NOTICE_KEY}"
EVENT = f"{CORE}.{domain.EVENT_KEY}"
TRANSLATION = f"{CORE}.{domain.TRANSLATION_KEY}"
ENVELOPE = {"pageSize": "page_size", "pageNum": "page_num", "totalCount": "total_count", "totalPages": "total_pages"}
LANDED = "request_id string, status int, body string"


def read_pages(spark: SparkSession, path: str | Sequence[str], layout: str = "lines") -> DataFrame:
    """Landed responses as (request_id, status, body).

    layout="lines": one JSON object per response and line, the splittable form for large landings;
    layout="files": one raw body per file, the file path as request_id, status 200.
    """
    if layout == "lines":
        return spark.read.schema(LANDED).json(path)
    if layout != "files":
        raise ValueError(f"unknown layout: {layout}")
    raw = spark.read.text(path, wholetext=True)
    return raw.select(
        F.col("_metadata.file_path").alias("request_id"), F.lit(200).alias("status"), F.col("value").alias("body")
    )


def _type(v: Column, path: str) -> Column:
    """Variant type name at a path; null when the key is absent, 'VOID' for a JSON null."""
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def _text(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def _is_int(v: Column, path: str) -> Column:
    """A JSON integer, or a string that spells one."""
    kind = _type(v, path)
    return F.coalesce(
        (kind == "BIGINT") | ((kind == "STRING") & _text(v, path).try_cast("bigint").isNotNull()), F.lit(False)
    )


def _extra_keys(v: Column, path: str, allowed: Iterable[str], tag: str) -> Column:
    keys = F.map_keys(F.try_variant_get(v, path, "map<string,variant>"))
    extra = F.array_except(F.coalesce(keys, F.array().cast("array<string>")), F.array(*[F.lit(a) for a in allowed]))
    return F.transform(extra, lambda k: F.concat(F.lit(f"extra:{tag}."), k))


def _field_problem(v: Column, key: str, required: bool) -> Column:
    """Reason text when a notice field breaks its rule, else null."""
    path = f"{NOTICE}.{key}"
    kind, value = _type(v, path), _text(v, path)
    absent = kind.isNull() | (kind == "VOID") if not required else F.lit(False)
    if key in domain.CHAR_SET_FIELDS:
        wrong = F.size(F.array_except(tx.char_set(value), F.array(*[F.lit(c) for c in domain.CHAR_SET_FIELDS[key]]))) > 0
    elif key in domain.ENUM_FIELDS:
        wrong = ~value.isin(*domain.ENUM_FIELDS[key])
    elif key in domain.TIME_FIELDS:
        wrong = tx.iso_ts(value).isNull()
    elif key == "effectiveEnd":
        wrong = tx.iso_ts(value).isNull() & (value != domain.PERMANENT)
    else:
        wrong = F.lit(False)
    return (
        F.when(absent, None)
        .when(kind.isNull(), f"missing:{key}")
        .when(kind != "STRING", f"type:{key}")
        .when(wrong, f"value:{key}")
    )


def item_problems(v: Column) -> Column:
    """Reasons an item (variant) breaks the closed schema; an empty array for a valid item."""
    translations = F.try_variant_get(v, TRANSLATION, "array<variant>")

    def bad_translation(t: Column) -> Column:
        kind = _text(t, "$.type")
        fits = reduce(
            lambda a, b: a | b,
            [(kind == tag) & (_type(t, f"$.{field}") == "STRING") for tag, field in domain.TRANSLATIONS.items()],
        )
        return ~F.coalesce(fits, F.lit(False))

    single = [
        F.when(F.coalesce(_text(v, "$.type") != "Feature", F.lit(True)), "value:item.type"),
        F.when(_type(v, "$.geometry").isNull(), "missing:item.geometry"),
        F.when(~F.coalesce(_type(v, NOTICE).startswith("OBJECT"), F.lit(False)), "missing:notice"),
        F.when(~_is_int(v, f"{EVENT}.scenario"), "value:event.scenario"),
        F.when(translations.isNull(), "missing:translation").when(F.exists(translations, bad_translation), "value:translation"),
        *[_field_problem(v, k, True) for k in domain.REQUIRED_FIELDS],
        *[_field_problem(v, k, False) for k in domain.OPTIONAL_FIELDS],
    ]
    return F.concat(
        F.array_compact(F.array(*single)),
        _extra_keys(v, "$", ("type", "properties", "geometry"), "item"),
        _extra_keys(v, "$.properties", (domain.CORE_KEY,), "properties"),
        _extra_keys(v, CORE, (domain.EVENT_KEY, domain.NOTICE_KEY, domain.TRANSLATION_KEY), "core"),
        _extra_keys(v, EVENT, ("scenario",), "event"),
        _extra_keys(v, NOTICE, domain.NOTICE_FIELDS, "notice"),
    )


def _opened(pages: DataFrame) -> DataFrame:
    """Add the parsed body and its items with their problems."""
    doc = pages.withColumn("_doc", F.try_parse_json("body"))
    items = F.try_variant_get("_doc", "$.items", "array<variant>")
    return doc.withColumn("_items", F.transform(items, lambda x: F.struct(x.alias("item"), item_problems(x).alias("problems"))))


def _whole(doc: Column) -> Column:
    """Whether all numbers of the envelope are there."""
    return F.coalesce(reduce(lambda a, b: a & b, [_is_int(doc, f"$.{k}") for k in ENVELOPE]), F.lit(False))


def classify_responses(pages: DataFrame, on_error: str = "column") -> DataFrame:
    """Add `kind`: success, rate_limited, not_json, unauthenticated, error, message or invalid, and `detail`.

    One bad item makes its page invalid. on_error="raise" fails the query on the first page that is
    not a success.
    """
    opened = _opened(pages)
    doc = F.col("_doc")
    whole = _whole(doc)
    clean = F.coalesce(~F.exists("_items", lambda i: F.size(i["problems"]) > 0), F.lit(False))
    error = F.when(_type(doc, "$.error") == "STRING", _text(doc, "$.error"))
    message = F.when(_type(doc, "$.message") == "STRING", _text(doc, "$.message"))
    kind = (
        F.when(F.col("status") == 429, "rate_limited")
        .when(doc.isNull(), "not_json")
        .when(whole & clean, "success")
        .when(error == domain.BAD_CREDENTIALS, "unauthenticated")
        .when(error.isNotNull(), "error")
        .when(message.isNotNull(), "message")
        .otherwise("invalid")
    )
    detail = F.when(F.col("kind").isin("unauthenticated", "error"), error).when(F.col("kind") == "message", message)
    out = opened.withColumn("kind", kind).withColumn("detail", detail)
    if on_error == "raise":
        failure = F.concat(F.col("kind"), F.lit(" response: "), F.coalesce("detail", F.left("body", F.lit(500)), F.lit("")))
        out = out.withColumn("kind", F.when(F.col("kind") == "success", F.col("kind")).otherwise(F.raise_error(failure)))
    elif on_error != "column":
        raise ValueError(f"unknown on_error: {on_error}")
    return out.drop("_doc", "_items")


def page_items(pages: DataFrame) -> DataFrame:
    """One row per item in page order: envelope numbers, item_pos (0-based), item, problems, page_ok.

    page_ok is true where the whole page is a success: status, envelope and every item.
    """
    opened = _opened(pages)
    limited = F.coalesce(F.col("status") == 429, F.lit(False))
    ok = ~limited & _whole(F.col("_doc")) & ~F.exists("_items", lambda i: F.size(i["problems"]) > 0)
    envelope = [F.try_variant_get("_doc", f"$.{k}", "int").alias(n) for k, n in ENVELOPE.items()]
    keys = [c for c in pages.columns if c != "body"]
    # *_outer: a plain explode adds a filter on the array's size, which parses and checks every page twice
    return opened.select(*keys, *envelope, ok.alias("page_ok"), F.posexplode_outer("_items").alias("item_pos", "_i")).where(
        "item_pos IS NOT NULL"
    ).select(
        *keys, *ENVELOPE.values(), "page_ok", "item_pos", "_i.item", "_i.problems"
    )


def validate_items(items: DataFrame, page_atomic: bool = False) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantine). With page_atomic one bad item sends its whole page to quarantine."""
    good = F.col("page_ok") if page_atomic else F.size("problems") == 0
    return items.where(good), items.where(~good)


def flatten_notices(items: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Valid items as notice rows in snake_case, translations and raw geometry included."""
    v = F.col("item")

    def field(key: str, name: str) -> Column:
        value = _text(v, f"{NOTICE}.{key}")
        if key in domain.TIME_FIELDS:
            value = tx.iso_ts(value)
        elif key in domain.CHAR_SET_FIELDS:
            value = tx.char_set(value)
        return value.alias(name)

    end = tx.effective_end(_text(v, f"{NOTICE}.effectiveEnd"))
    plain = [field(k, n) for k, n in domain.NOTICE_FIELDS.items() if k != "effectiveEnd"]
    translations = F.transform(
        F.try_variant_get(v, TRANSLATION, "array<variant>"),
        lambda t: F.struct(
            _text(t, "$.type").alias("type"), _text(t, "$.formattedText").alias("formatted_text"),
            _text(t, "$.simpleText").alias("simple_text"),
        ),
    )
    return items.select(
        *keep, *plain, end["effective_end"].alias("effective_end"), end["is_permanent"].alias("is_permanent"),
        _text(v, f"{EVENT}.scenario").try_cast("int").alias("scenario"),
        translations.alias("translations"), F.to_json(F.try_variant_get(v, "$.geometry", "variant")).alias("geometry"),
    )


def parse_geometry(c: Column) -> Column:
    """Typed view of the raw geometry JSON, for those who need it."""
    return F.from_json(
        c,
        "type string, geometries array<struct<type: string, subType: string, "
        "heightInformation: struct<upperLevel: string, uomUpperLevel: string, lowerLevel: string, uomLowerLevel: string>, "
        "coordinates: string>>",
    )


def plan_requests(targets: DataFrame, radius_nm: float = 100.0, page_size: int = 1000, page_num: int = 1) -> DataFrame:
    """Request parameter map per waypoint (columns lat, lon) or airport code (column code)."""
    if not 0 < radius_nm <= domain.MAX_RADIUS_NM:
        raise ValueError("radius must be greater than 0 and at most 100")
    if not 0 < page_size <= domain.MAX_PAGE_SIZE:
        raise ValueError("page_size must be between 1 and 1000")
    if page_num < 1:
        raise ValueError("page_num must be greater than 0")
    paging = [F.lit("pageNum"), F.lit(str(page_num)), F.lit("pageSize"), F.lit(str(page_size))]
    if "code" in targets.columns:
        params = F.create_map(F.lit("icaoLocation"), F.col("code"), *paging)
    else:
        params = F.create_map(
            F.lit("locationLongitude"), F.col("lon").cast("string"), F.lit("locationLatitude"), F.col("lat").cast("string"),
            F.lit("locationRadius"), F.lit(str(float(radius_nm))), *paging,
        )
    return targets.withColumn("params", params)


def fan_out_pages(first_pages: DataFrame) -> DataFrame:
    """Requests for pages 2..total_pages of every first page."""
    more = first_pages.where(F.col("total_pages") >= 2)
    return more.withColumn("page_num", F.explode(F.sequence(F.lit(2), F.col("total_pages"))))


def collect_union(*dfs: DataFrame) -> DataFrame:
    """Items of several landings under one another; absent columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def infer_schema(items: DataFrame) -> DataFrame:
    """One row with the merged schema of all items seen, as text."""
    return items.agg(F.schema_of_variant_agg("item").alias("schema"))


#: levels of nesting a pass over the items goes down; deeper values are taken as items of the next pass
LEVELS = 8
_NODE = "array<struct<path:string,value:variant>>"


def _children(node: Column) -> Column:
    """Members of an object or elements of an array with their paths; none for a plain value."""
    path, value = node["path"], node["value"]
    members = F.map_entries(F.try_variant_get(value, "$", "map<string,variant>"))
    elements = F.try_variant_get(value, "$", "array<variant>")
    dot = F.when(path == "", "").otherwise(F.concat(path, F.lit(".")))
    return F.coalesce(
        F.transform(members, lambda m: F.struct(F.concat(dot, m["key"]).alias("path"), m["value"].alias("value"))),
        F.transform(elements, lambda e: F.struct(F.concat(path, F.lit("[]")).alias("path"), e.alias("value"))),
        F.array().cast(_NODE),
    )


def _kind(value: Column) -> Column:
    # Only plain values are described by schema_of_variant, which would write out all that lies below a container.
    return (
        F.when(F.try_variant_get(value, "$", "map<string,variant>").isNotNull(), "OBJECT")
        .when(F.try_variant_get(value, "$", "array<variant>").isNotNull(), "ARRAY")
        .otherwise(F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0))
    )


def schema_paths(items: DataFrame, item: str = "item") -> DataFrame:
    """The schema that the items have, to any depth: (path, kind, n), one row per path and kind of value.

    `item` is a variant. Members are `a.b`, elements of an array `a[]`; the item itself has the empty path.
    kind is OBJECT, ARRAY, VOID (a JSON null) or Spark's name of the plain type without its digits; n counts
    values. One pass goes LEVELS down inside the rows and only counts leave the tasks; a further pass is made
    for what lies deeper, if there is any. Null items count as nothing; keys with a dot are not told apart
    from nesting.
    """
    nodes = items.select(F.struct(F.lit("").alias("path"), F.col(f"`{item}`").alias("value")).alias("node")).where("node.value IS NOT NULL")
    found: DataFrame | None = None
    while True:
        levels = nodes.select(F.array("node").cast(_NODE).alias("l0"))
        for k in range(LEVELS):
            levels = levels.withColumn(f"l{k + 1}", F.flatten(F.transform(f"l{k}", _children)))
        # The deepest level is counted as the items of the next pass.
        every = F.concat(*[F.transform(f"l{k}", lambda x, k=k: F.struct(x["path"].alias("path"), _kind(x["value"]).alias("kind"))) for k in range(LEVELS)])
        below = F.size(f"l{LEVELS}").cast("long")
        counts = storage.written(
            levels.select(F.explode(every).alias("e"), F.when(F.size("l0") > 0, below).alias("below"))
            .groupBy("e.path", "e.kind").agg(F.count(F.lit(1)).alias("n"), F.max("below").alias("below"))
        )
        part = counts.select("path", "kind", "n")
        found = part if found is None else found.unionByName(part)
        if not counts.agg(F.max("below") > 0).first()[0]:
            return found.groupBy("path", "kind").agg(F.sum("n").alias("n"))
        nodes = levels.select(F.explode(f"l{LEVELS}").alias("node"))


#: declared kinds by path; a path that ends in `.*` allows anything below it
DECLARED = {
    "": "OBJECT", "type": "STRING", "geometry": "OBJECT", "geometry.*": "", "properties": "OBJECT",
    f"properties.{domain.CORE_KEY}": "OBJECT",
    f"properties.{domain.CORE_KEY}.{domain.EVENT_KEY}": "OBJECT",
    f"properties.{domain.CORE_KEY}.{domain.EVENT_KEY}.scenario": "BIGINT",
    f"properties.{domain.CORE_KEY}.{domain.NOTICE_KEY}": "OBJECT",
    **{f"properties.{domain.CORE_KEY}.{domain.NOTICE_KEY}.{k}": "STRING" for k in domain.NOTICE_FIELDS},
    f"properties.{domain.CORE_KEY}.{domain.TRANSLATION_KEY}": "ARRAY",
    f"properties.{domain.CORE_KEY}.{domain.TRANSLATION_KEY}[]": "OBJECT",
    **{f"properties.{domain.CORE_KEY}.{domain.TRANSLATION_KEY}[].{k}": "STRING" for k in ("type", *domain.TRANSLATIONS.values())},
}


def path_drift(paths: DataFrame, declared: dict[str, str] = DECLARED) -> DataFrame:
    """`schema_paths` held against declared kinds: (path, issue, detail, n).

    issue is extra (an undeclared path, detail its kind; paths below it are not listed again), type (another
    kind than declared; JSON nulls are of any kind) or missing (a declared path with no value, n = 0).
    """
    spark = paths.sparkSession
    exact = {p: k for p, k in declared.items() if not p.endswith(".*")}
    open_ = [p.removesuffix(".*") for p in declared if p.endswith(".*")]
    known = spark.createDataFrame(list(exact.items()), "path string, want string")
    free = F.lit(False)
    for p in open_:
        free |= F.startswith("path", F.lit(f"{p}.")) | F.startswith("path", F.lit(f"{p}[]"))
    held = paths.join(known, "path", "left").where(~(F.col("want").isNull() & free))
    # What holds a path: it without its last member or element.
    parent = F.when(F.endswith("path", F.lit("[]")), F.regexp_replace("path", r"\[\]$", "")).otherwise(F.regexp_replace("path", r"(^|\.)[^.]*$", ""))
    above = known.select(F.col("path").alias("parent"))
    extra = held.where("want IS NULL").withColumn("parent", parent).join(above, "parent", "left_semi").select(
        "path", F.lit("extra").alias("issue"), F.col("kind").alias("detail"), "n")
    kinds = held.where((F.col("kind") != F.col("want")) & (F.col("kind") != "VOID")).select("path", F.lit("type").alias("issue"), F.col("kind").alias("detail"), "n")
    missing = known.join(paths, "path", "left_anti").select(
        "path", F.lit("missing").alias("issue"), F.lit(None).cast("string").alias("detail"), F.lit(0).cast("long").alias("n"))
    return extra.unionByName(kinds).unionByName(missing)


def schema_drift(items: DataFrame) -> DataFrame:
    """Differences between the items seen and the declared schema: (path, issue, detail, n).

    issue is extra (unknown key), type (not the declared type), new_value (outside an enumeration) or
    missing (a declared key no item carries). Only counts per path leave the map side.
    """
    v = F.col("item")

    def entries(path: str, tag: str) -> Column:
        pairs = F.map_entries(F.try_variant_get(v, path, "map<string,variant>"))
        return F.transform(
            F.coalesce(pairs, F.array().cast("array<struct<key:string,value:variant>>")),
            lambda e: F.struct(
                F.concat(F.lit(f"{tag}."), e["key"]).alias("path"), F.schema_of_variant(e["value"]).alias("kind"),
                F.when(F.schema_of_variant(e["value"]) == "STRING", F.try_variant_get(e["value"], "$", "string")).alias("value"),
            ),
        )

    declared = {f"notice.{k}": "STRING" for k in domain.NOTICE_FIELDS}
    declared |= {f"core.{domain.EVENT_KEY}": "OBJECT", f"core.{domain.NOTICE_KEY}": "OBJECT", f"core.{domain.TRANSLATION_KEY}": "ARRAY", "event.scenario": "BIGINT"}
    found = F.concat(entries(NOTICE, "notice"), entries(CORE, "core"), entries(EVENT, "event"))
    seen = items.select(F.explode_outer(found).alias("e")).where("e IS NOT NULL")
    path, kind, value = F.col("e.path"), F.col("e.kind"), F.col("e.value")
    want = F.lit(None).cast("string")
    for name, expected in declared.items():
        want = F.when(path == name, expected).otherwise(want)
    listed = F.lit(True)
    for key, allowed in domain.ENUM_FIELDS.items():
        listed = F.when(path == f"notice.{key}", value.isin(*allowed)).otherwise(listed)
    base = F.regexp_extract(kind, r"^[A-Z]+", 0)
    issue = (
        F.when(want.isNull(), "extra")
        .when((kind != "VOID") & (base != want), "type")
        .when(~F.coalesce(listed, F.lit(True)), "new_value")
    )
    detail = F.when(issue == "new_value", value).otherwise(base)
    counts = (
        seen.select(path.alias("path"), issue.alias("issue"), F.when(issue.isNotNull(), detail).alias("detail"))
        .groupBy("path", "issue", "detail").agg(F.count(F.lit(1)).alias("n"))
    )
    # The declared keys not met are read off a flag per key: one row, whatever the data.
    met = counts.agg(*[F.coalesce(F.bool_or(F.col("path") == k), F.lit(False)).alias(k.replace(".", "_")) for k in declared])
    gone = met.select(F.explode(F.array_compact(F.array(*[F.when(~F.col(k.replace(".", "_")), F.lit(k)) for k in declared]))).alias("path"))
    missing = gone.select("path", F.lit("missing").alias("issue"), F.lit(None).cast("string").alias("detail"), F.lit(0).cast("long").alias("n"))
    return counts.where(F.col("issue").isNotNull()).unionByName(missing)
