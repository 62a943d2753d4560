"""The prioritised briefing of scored notices, as ordered lines and as text files."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition, IsNotNull

from noticewing import domain
from noticewing.functions import text as tx
from noticewing.sources import committed
from noticewing.sources.committed import CommittedWriter, Part

#: sort order of the lines within a route
ORDER = ("section", "pos", "line_no")
_W = domain.BRIEF_WIDTH


def _share(n, total):
    """Percentage with one decimal in four places; 0.0 of nothing."""
    value = F.when(total > 0, n * 100.0 / total).otherwise(0.0)
    return F.format_string("%4.1f", F.bround(value, 1))


def brief_lines(scored: DataFrame, generated_at: str | None = None, pos: str = "pos") -> DataFrame:
    """Lines (route, section, pos, line_no, line): header, then HIGH to INFO, input order inside.

    `scored` needs route, departure, destination, notice_id, text, rf_confidence, is_anomaly,
    final_criticality and the position column. Header and section heads come from counts per route,
    so no route is gathered anywhere.
    """
    now = generated_at or datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%MZ")
    level = F.col("final_criticality")
    per_route = scored.groupBy("route", "departure", "destination").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("is_anomaly").alias("anomalies"),
        *[F.count_if(level == lv).alias(lv) for lv in domain.LEVELS],
    )

    def lines(*cols):
        return F.array(*[c if not isinstance(c, str) else F.lit(c) for c in cols])

    both = (F.coalesce("departure", F.lit("")) != "") & (F.coalesce("destination", F.lit("")) != "")
    title = F.when(both, F.concat("departure", F.lit(" -> "), "destination")).otherwise(domain.BRIEF_NO_ROUTE)
    head = lines(
        "=" * _W, tx.fill(domain.BRIEF_TITLE, route=title, now=now), tx.fill(domain.BRIEF_TOTAL, total=F.col("total")), "-" * _W,
        *[F.concat(F.format_string(f"  {lv:<8} %4d  (", F.col(lv)), _share(F.col(lv), F.col("total")), F.lit("%)")) for lv in domain.LEVELS],
        F.concat(F.format_string(f"{domain.BRIEF_UNUSUAL:<10} %4d  (", F.col("anomalies")), _share(F.col("anomalies"), F.col("total")), F.lit("%)")),
        "=" * _W, "",
    )
    sections = [F.struct(F.lit(0).alias("section"), head.alias("lines"))]
    for i, lv in enumerate(domain.LEVELS, start=1):
        top = [
            F.lit("=" * _W), tx.fill(domain.BRIEF_SECTION, title=domain.SECTION_TITLES[lv], count=F.col(lv)), F.lit("=" * _W),
        ]
        none = F.array(*top, F.lit(domain.BRIEF_NONE), F.lit(""))
        sections.append(F.struct(F.lit(i).alias("section"), F.when(F.col(lv) == 0, none).otherwise(F.array(*top)).alias("lines")))
    fixed = (
        per_route.select("route", F.explode_outer(F.array(*sections)).alias("s"))
        .select("route", F.col("s.section").alias("section"), F.lit(-1).cast("long").alias("pos"), F.posexplode_outer("s.lines").alias("line_no", "line"))
    )
    entry = lines(
        "-" * _W,
        tx.fill(
            domain.BRIEF_ENTRY, id=F.col("notice_id"), level=level, flag=F.when(F.col("is_anomaly"), domain.BRIEF_ANOMALY).otherwise(""),
            conf=F.bround(F.col("rf_confidence") * 100, 0).cast("int"),
        ),
        "-" * _W, tx.strip(F.col("text")), "",
    )
    body = scored.where(level.isin(*domain.LEVELS)).select(
        "route", (tx.level_order(level) + 1).alias("section"), F.col(pos).cast("long").alias("pos"), F.posexplode_outer(entry).alias("line_no", "line")
    )
    return fixed.unionByName(body)


def write_briefs(lines: DataFrame, path: str) -> None:
    """One folder per route; its part files, read in name order, are the briefing.

    Range partitions keep a route with very many notices from becoming one task.
    """
    keys = ["route", *ORDER]
    rows = lines.repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows.select("route", F.col("line").alias("value")).write.partitionBy("route").text(path)


# ---------------------------------------------------------------- text files with commit and abort

FILES = "brief_files"
FILE_SCHEMA = "route string, line_no long, line string"
_LINES = pa.schema([("route", pa.string()), ("line_no", pa.int64()), ("line", pa.string())])


class BriefWriter(CommittedWriter):
    """One text file per route a task meets; the commit puts a route's files in reading order."""

    def finished(self, files, folder, batches):
        parts, out, route, key, rows, size = [], None, None, None, 0, 0

        def end():
            nonlocal out, rows, size
            if out is not None:
                out.close()
                parts.append(Part(path, rows, size, {"route": route, "first": key}))
            out, rows, size = None, 0, 0

        for batch in batches:
            names = batch.column("route").to_pylist()
            values = batch.column("line").to_pylist()
            keys = [batch.column(c).to_pylist() for c in ORDER]
            for i, name in enumerate(names):
                if out is None or name != route:
                    end()
                    route, key = name, [k[i] for k in keys]
                    path = f"{folder}/{uuid.uuid4().hex}.txt"
                    out = files.open_output_stream(path)
                text = (values[i] or "") + "\n"
                data = text.encode()
                out.write(data)
                rows, size = rows + text.count("\n"), size + len(data)
        end()
        return parts

    def order(self, parts):
        return sorted(parts, key=lambda p: (p.about["route"] is not None, p.about["route"] or "", p.about["first"]))


@dataclass
class Pieces(InputPartition):
    """Files of one reading task: route, number of the first line, path."""

    pieces: list[tuple] = field(default_factory=list)

    def __post_init__(self):
        super().__init__(None)


class BriefReader(DataSourceReader):
    def __init__(self, root: str):
        self.root, self.routes, self.named = root.rstrip("/"), None, False

    def pushFilters(self, filters):
        for f in filters:
            if type(f) in (EqualTo, In) and f.attribute == ("route",):
                wanted = set(f.value if type(f) is In else [f.value]) - {None}
                self.routes = wanted if self.routes is None else self.routes & wanted
            elif type(f) is IsNotNull and f.attribute == ("route",):
                self.named = True
            else:
                yield f

    def partitions(self):
        files, root = committed.filesystem(self.root)
        pieces, sizes, starts = [], [], {}
        for part in committed.listed(files, root):
            route = part.about["route"]
            start = starts.get(route, 0)
            starts[route] = start + part.rows
            if (self.routes is None or route in self.routes) and not (self.named and route is None):
                pieces.append((route, start, part.path))
                sizes.append(part.size)
        return [Pieces(pieces[i:j]) for i, j in committed.bundles(sizes)]

    def read(self, partition):
        files, root = committed.filesystem(self.root)
        for route, start, path in getattr(partition, "pieces", ()):
            rest = b""
            with files.open_input_stream(f"{root}/{path}") as f:
                while chunk := f.read(4 << 20):
                    *lines, rest = (rest + chunk).split(b"\n")
                    if lines:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([route] * len(lines), pa.string()), pa.array(range(start, start + len(lines)), pa.int64()), pa.array([b.decode() for b in lines], pa.string())],
                            schema=_LINES,
                        )
                        start += len(lines)


class BriefFiles(DataSource):
    """Option: path, a folder that driver and executors share.

    Written: route, section, pos, line_no, line, in this order within a task. Read: route, line_no, line,
    where line_no counts a route's lines in the text files; a value with line breaks was several lines.
    A second appended briefing of a route follows the first.
    """

    @classmethod
    def name(cls):
        return FILES

    def schema(self):
        return FILE_SCHEMA

    def reader(self, schema):
        return BriefReader(self.options["path"])

    def writer(self, schema, overwrite):
        return BriefWriter(self.options["path"], overwrite)


def save_briefs(lines: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write briefing lines as text files in one commit: readers see the old briefings or all the new ones.

    Range partitions cut a route with very many notices into several files.
    """
    keys = ["route", *ORDER]
    lines.sparkSession.dataSource.register(BriefFiles)
    rows = lines.select(*keys, "line").repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows.write.format(FILES).mode(mode).save(path)


def read_briefs(spark: SparkSession, path: str) -> DataFrame:
    """Committed briefings below `path`: route, line_no, line; a filter on the route opens its files only."""
    spark.dataSource.register(BriefFiles)
    committed.enable_pushdown(spark)
    return spark.read.format(FILES).load(path)
