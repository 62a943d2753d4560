"""Airport and facility files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticewing import domain

_KINDS = {"latitude": "double", "longitude": "double", "altitude": "integer"}
AIRPORTS = T.StructType()
for _name in domain.AIRPORT_COLUMNS:
    AIRPORTS = AIRPORTS.add(_name, _KINDS.get(_name, "string"))
FACILITIES = T.StructType()
for _name in domain.FACILITY_COLUMNS:
    FACILITIES = FACILITIES.add(_name, "string")


_MARK = "\u0002"


def _file_order():
    """Orderable position of a row in its file, right for split files too."""
    return F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("seq"),
    ).alias("pos")


def ingest_airports(lines: DataFrame, strict_split: bool = True, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(valid, bad) of raw comma-separated lines.

    strict_split cuts at every comma, so a quoted name with a comma makes a bad row; False honours
    quotes. Valid rows lose surrounding quotes, and four columns become numbers or null.
    """
    n = len(domain.AIRPORT_COLUMNS)
    if strict_split:
        cut = lines.withColumn("_f", F.split(value, ",", -1))
    else:
        # A mark as one more column stands right behind the wanted ones, empty or not, if their number fits.
        wide = ", ".join(f"c{i} string" for i in range(n + 2))
        got = F.from_csv(F.concat(F.col(value), F.lit(f",{_MARK}")), F.lit(wide), {"nullValue": "\u0000"})
        fields = F.array(*[F.coalesce(F.col(f"_r.c{i}"), F.lit("")) for i in range(n)])
        cut = lines.withColumn("_r", got).withColumn("_f", F.when((F.col(f"_r.c{n}") == _MARK) & F.col(f"_r.c{n + 1}").isNull(), fields)).drop("_r")
    fits = F.coalesce(F.size("_f") == n, F.lit(False))

    def field(i: int, name: str):
        bare = F.regexp_replace(F.get("_f", F.lit(i)), '^"+|"+$', "")
        return (bare.try_cast("double") if name in domain.AIRPORT_NUMERIC else bare).alias(name)

    rest = [c for c in lines.columns if c != value]
    valid = cut.where(fits).select(*rest, *[field(i, c) for i, c in enumerate(domain.AIRPORT_COLUMNS)])
    return valid, cut.where(~fits).select(*rest, F.col(value).alias("bad_row"))


def ingest_counts(lines: DataFrame, value: str = "value") -> DataFrame:
    """One row: lines read, valid rows, bad rows (bare comma split)."""
    ok = F.size(F.split(value, ",", -1)) == len(domain.AIRPORT_COLUMNS)
    return lines.agg(F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("valid"), F.count_if(~ok).alias("bad"))


def read_airports(spark: SparkSession, path, header: bool = False) -> DataFrame:
    """The 14-column airports file, `\\N` as null, with a file-order column `pos`."""
    raw = spark.read.schema(AIRPORTS).csv(path, header=header, nullValue="\\N", quote='"', escape="\\")
    return raw.select(_file_order(), *domain.AIRPORT_COLUMNS)


def airports_as_places(airports: DataFrame) -> DataFrame:
    """Airport columns under the place names used by lookups."""
    return airports.select(
        "pos", "name", "country", "iata", "icao", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"),
        F.col("altitude").cast("int").alias("elevation"), "tz_name",
    )


def read_facilities(spark: SparkSession, path) -> DataFrame:
    """The 90-column facility file with its header row; blanks are null."""
    raw = spark.read.schema(FACILITIES).csv(path, header=True, enforceSchema=True, nullValue="", quote='"', escape='"')
    return raw.select(_file_order(), *domain.FACILITY_COLUMNS)
