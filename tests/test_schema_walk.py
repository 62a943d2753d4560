import json

from pyspark.sql import functions as F

from noticewing.sources import pages

KINDS = {dict: "OBJECT", list: "ARRAY", str: "STRING", bool: "BOOLEAN", int: "BIGINT", float: "DECIMAL", type(None): "VOID"}


def walked(values):
    """The same walk in plain Python."""
    out: dict = {}

    def visit(path, value):
        key = (path, KINDS[type(value)])
        out[key] = out.get(key, 0) + 1
        if isinstance(value, dict):
            for k, x in value.items():
                visit(f"{path}.{k}" if path else k, x)
        if isinstance(value, list):
            for x in value:
                visit(f"{path}[]", x)

    for value in values:
        visit("", value)
    return out


def _items(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "t string").select(F.parse_json("t").alias("item"))


def _got(frame):
    rows = frame.collect()
    assert len({(r["path"], r["kind"]) for r in rows}) == len(rows)
    return {(r["path"], r["kind"]): r["n"] for r in rows}


def test_paths_at_any_depth_equal_a_plain_walk(spark):
    deep: object = 1
    for k in range(2 * pages.LEVELS + 3):
        deep = {"a": deep} if k % 3 else [deep, "x", []]
    values = [{"a": 1, "b": [1, "x", None, [2.5, {"c": True}]], "e": {}, "l": []}, {"a": "one", "b": {"c": 1}}, deep, [1, 2], "plain", 7, None]
    got = _got(pages.schema_paths(_items(spark, [*map(json.dumps, values), None])))
    assert got == walked(values)


def test_paths_of_nothing(spark):
    assert pages.schema_paths(_items(spark, ["1"]).where("false")).count() == 0
    assert pages.schema_paths(_items(spark, [None])).count() == 0


def test_drift_of_nested_paths(spark):
    declared = {"": "OBJECT", "geo": "OBJECT", "geo.*": "", "tr": "ARRAY", "tr[]": "OBJECT", "tr[].type": "STRING", "tr[].more": "STRING", "n": "BIGINT"}
    values = [
        {"geo": {"x": [1, {"y": 2}]}, "tr": [{"type": "A", "odd": {"deep": 1}}, {"type": 5}], "n": 3},
        {"geo": None, "tr": [[1]], "n": "three", "new": {"k": [1]}}, {"geo": {"x": "s"}, "n": None},
    ]
    paths = pages.schema_paths(_items(spark, map(json.dumps, values)))
    got = {(r["path"], r["issue"], r["detail"], r["n"]) for r in pages.path_drift(paths, declared).collect()}
    assert got == {
        ("tr[].odd", "extra", "OBJECT", 1), ("new", "extra", "OBJECT", 1), ("tr[][]", "extra", "BIGINT", 1),
        ("tr[].type", "type", "BIGINT", 1), ("tr[]", "type", "ARRAY", 1), ("n", "type", "STRING", 1), ("tr[].more", "missing", None, 0),
    }
