"""Text files of notice records separated by a line of 80 '='."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticewing import domain
from noticewing.functions import text as tx

#: columns that give the order of the records read
ORDER = ("file", "block_start", "seq")


def read_blocks(spark: SparkSession, path, whole_files: bool = False) -> DataFrame:
    """Records of block files as rows (file, block_start, seq, block).

    Files are split inside, so a single huge file is read by many tasks; (file, block_start, seq) is
    the order in the file. whole_files=True reads each file in one task, for small files of other
    writers in which separators may be longer than 80 characters.
    """
    where = [F.col("_metadata.file_path").alias("file")]
    if whole_files:
        raw = spark.read.text(path, wholetext=True)
        parts = F.split("value", domain.BLOCK_SEPARATOR, -1)
        return raw.select(*where, F.lit(0).cast("long").alias("block_start"), F.posexplode_outer(parts).alias("seq", "block")).withColumn(
            "seq", F.col("seq").cast("long")
        )
    raw = spark.read.text(path, lineSep=domain.BLOCK_SEPARATOR)
    return raw.select(
        *where, F.col("_metadata.file_block_start").alias("block_start"), F.monotonically_increasing_id().alias("seq"),
        F.col("value").alias("block"),
    )


def parse_blocks(df: DataFrame, block: str = "block", with_route: bool = False) -> DataFrame:
    """Fields of each record as strings; absent fields are '', records without an ID are dropped.

    'Text:' takes the rest of the record, its lines joined by one space. Of a repeated key the last counts.
    """
    fields = {**domain.BLOCK_FIELDS, **(domain.BLOCK_ROUTE_FIELDS if with_route else {})}
    lines = F.split(tx.strip(F.regexp_replace(block, "\r\n?", "\n")), "\n", -1)
    cut = df.withColumn("_lines", lines)
    at = F.array_position(F.transform("_lines", lambda ln: ln.startswith("Text:")), True)
    cut = cut.withColumn("_at", at)
    head = F.when(F.col("_at") == 0, F.col("_lines")).otherwise(F.slice("_lines", F.lit(1), F.greatest(F.col("_at") - 1, F.lit(0))))
    pairs = F.transform(
        F.filter(head, lambda ln: ln.contains(": ")),
        lambda ln: F.struct(
            tx.strip(F.substring_index(ln, ": ", 1)).alias("k"),
            tx.strip(F.substring(ln, F.instr(ln, ": ") + 2, F.length(ln))).alias("v"),
        ),
    )
    first = tx.strip(F.substring(F.try_element_at("_lines", F.col("_at").cast("int")), 6, 1 << 30))
    rest = F.slice("_lines", F.col("_at").cast("int") + 1, F.size("_lines"))
    text = tx.strip(F.concat_ws(" ", F.when(first != "", F.array(first)), rest))
    cut = cut.withColumn("_pairs", pairs).withColumn("_text", F.when(F.col("_at") > 0, text).otherwise(""))

    def value(label: str) -> Column:
        hits = F.filter("_pairs", lambda p: p["k"] == label)
        return F.coalesce(F.try_element_at(hits, F.lit(-1))["v"], F.lit(""))

    kept = [c for c in df.columns if c != block and c not in fields.values()]
    parsed = cut.select(*kept, *[value(label).alias(name) for label, name in fields.items()], F.col("_text").alias("text"))
    return parsed.where(F.col("id") != "")


def format_block(df: DataFrame, with_route: bool = False) -> Column:
    """One record as text, 'None' for null; 13 fields, or 16 with the route."""
    fields = {**domain.BLOCK_FIELDS, **(domain.BLOCK_ROUTE_FIELDS if with_route else {}), "Text": "text"}
    known = set(df.columns)
    lines = [
        F.concat(F.lit(f"{label}: "), F.coalesce(F.col(name).cast("string") if name in known else F.lit(None).cast("string"), F.lit("None")))
        for label, name in fields.items()
    ]
    return F.concat_ws("\n", *lines)


def format_blocks(df: DataFrame, with_route: bool = False, out: str = "block") -> DataFrame:
    return df.withColumn(out, format_block(df, with_route))


def write_blocks(df: DataFrame, path: str, order: list[str], with_route: bool = False, by: str | None = "route") -> None:
    """Write records in order, one folder per route.

    Rows are range-partitioned by (route, order), so a route that holds most rows becomes several
    files whose names sort in order.
    """
    keys = [*([by] if by else []), *order]
    record = F.concat(format_block(df, with_route), F.lit("\n" + domain.BLOCK_SEPARATOR))
    rows = df.withColumn("_record", record).repartitionByRange(*keys).sortWithinPartitions(*keys)
    if by:
        rows.select(by, F.col("_record").alias("value")).write.partitionBy(by).text(path)
    else:
        rows.select(F.col("_record").alias("value")).write.text(path)
