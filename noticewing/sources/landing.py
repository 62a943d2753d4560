"""Landed responses as a data source: `spark.read.format("landed_pages")`.

Part files hold JSON lines in the order of (request_id, page_num), cut into blocks of a few MB. The
commit list keeps the range of requests and pages of every part, the file beside a part that of every
block. Filters on request and page leave out parts while the read is planned, blocks when a task
opens its parts, and rows at last, so Spark need not check them again.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.json as pj
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan,
    LessThanOrEqual,
)

from noticewing.sources import committed
from noticewing.sources.committed import CommittedWriter, Part

NAME = "landed_pages"
SCHEMA = "request_id string, page_num int, status int, body string"
_ARROW = pa.schema([("request_id", pa.string()), ("page_num", pa.int32()), ("status", pa.int32()), ("body", pa.string())])
#: bytes of a block and of a part file, about; a longer response is a block of its own
BLOCK_BYTES, PART_BYTES = 4 << 20, 128 << 20
KEYS = ("request_id", "page_num")
_COMPARE = {GreaterThan: pc.greater, GreaterThanOrEqual: pc.greater_equal, LessThan: pc.less, LessThanOrEqual: pc.less_equal}


def _ranges(rows: list[tuple]) -> dict:
    """Smallest and largest of each key; null keys count as none."""
    out = {}
    for i, key in enumerate(KEYS):
        values = [r[i] for r in rows if r[i] is not None]
        out[key] = [min(values), max(values)] if values else None
    return out


def _joined(parts: list[dict]) -> dict:
    out = {}
    for key in KEYS:
        spans = [p[key] for p in parts if p[key] is not None]
        out[key] = [min(s[0] for s in spans), max(s[1] for s in spans)] if spans else None
    return out


def _possible(span: list | None, kind: type, value) -> bool:
    """Whether a value of the range may pass the filter. Nulls never do."""
    if span is None:
        return False
    low, high = span
    if kind is IsNotNull:
        return True
    if kind is In:
        return any(low <= x <= high for x in value if x is not None)
    if value is None:
        return False
    if kind is EqualTo:
        return low <= value <= high
    return (high > value) if kind is GreaterThan else (high >= value) if kind is GreaterThanOrEqual else (low < value) if kind is LessThan else low <= value


def _may_match(about: dict, filters: list[tuple]) -> bool:
    return all(_possible(about[key], kind, value) for key, kind, value in filters)


def _rows(batch: pa.RecordBatch, filters: list[tuple]) -> pa.RecordBatch:
    for key, kind, value in filters:
        column = batch.column(key)
        if kind is IsNotNull:
            mask = pc.is_valid(column)
        elif kind is In:
            mask = pc.is_in(column, value_set=pa.array([x for x in value if x is not None], column.type))
        elif kind is EqualTo:
            mask = pc.equal(column, pa.scalar(value, column.type))
        else:
            mask = _COMPARE[kind](column, pa.scalar(value, pa.int64() if key == "page_num" else column.type))
        batch = batch.filter(mask)  # null is dropped
    return batch


@dataclass
class Files(InputPartition):
    """Parts of one reading task."""

    paths: list[str] = field(default_factory=list)

    def __post_init__(self):
        super().__init__(None)


class PageReader(DataSourceReader):
    def __init__(self, root: str):
        self.root, self.filters = root.rstrip("/"), []

    def pushFilters(self, filters):
        for f in filters:
            if type(f) in (EqualTo, In, IsNotNull, *_COMPARE) and len(f.attribute) == 1 and f.attribute[0] in KEYS:
                self.filters.append((f.attribute[0], type(f), getattr(f, "value", None)))
            else:
                yield f

    def partitions(self):
        files, root = committed.filesystem(self.root)
        parts = [p for p in committed.listed(files, root) if _may_match(p.about, self.filters)]
        return [Files([p.path for p in parts[i:j]]) for i, j in committed.bundles([p.size for p in parts])]

    def read(self, partition):
        files, root = committed.filesystem(self.root)
        for path in getattr(partition, "paths", ()):  # a read without partitions calls with None
            blocks = [b for b in json.loads(committed.read_bytes(files, f"{root}/{path}.blocks")) if _may_match(b["about"], self.filters)]
            with files.open_input_file(f"{root}/{path}") as f:
                for block in blocks:
                    data = f.read_at(block["size"], block["start"])
                    table = pj.read_json(
                        pa.BufferReader(data), pj.ReadOptions(use_threads=False, block_size=len(data) + 1),
                        pj.ParseOptions(explicit_schema=_ARROW, unexpected_field_behavior="ignore"),
                    )
                    for batch in table.select(_ARROW.names).to_batches():
                        batch = _rows(batch, self.filters)
                        if batch.num_rows:
                            yield batch


class PageWriter(CommittedWriter):
    def finished(self, files, folder, batches):
        parts, out, path, blocks = [], None, None, []
        lines, keys, held, start = [], [], 0, 0

        def end_block():
            nonlocal lines, keys, held, start, out, path
            if not lines:
                return
            if out is None:
                path = f"{folder}/{uuid.uuid4().hex}.jsonl"
                out = files.open_output_stream(path)
            out.write(b"".join(lines))
            blocks.append({"start": start, "size": held, "rows": len(lines), "about": _ranges(keys)})
            start, lines, keys, held = start + held, [], [], 0

        def end_part():
            nonlocal out, blocks, start
            if out is None:
                return
            out.close()
            committed.write_bytes(files, f"{path}.blocks", json.dumps(blocks).encode())
            parts.append(Part(path, sum(b["rows"] for b in blocks), start, _joined([b["about"] for b in blocks])))
            out, blocks, start = None, [], 0

        for batch in batches:
            columns = [batch.column(name) for name in _ARROW.names]
            for i in range(batch.num_rows):  # responses of up to 1,000 notices: a row is large
                row = [c[i].as_py() for c in columns]
                line = json.dumps(dict(zip(_ARROW.names, row)), ensure_ascii=False).encode() + b"\n"
                if lines and held + len(line) > BLOCK_BYTES:
                    end_block()
                    if start >= PART_BYTES:
                        end_part()
                lines.append(line)
                keys.append((row[0], row[1]))
                held += len(line)
        end_block()
        end_part()
        return parts


class LandedPages(DataSource):
    """Options: path, a folder that driver and executors share. Schema: request_id, page_num, status, body."""

    @classmethod
    def name(cls):
        return NAME

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return PageReader(self.options["path"])

    def writer(self, schema, overwrite):
        if set(schema.fieldNames()) != set(_ARROW.names):
            raise ValueError(f"landed pages have the columns {', '.join(_ARROW.names)}")
        return PageWriter(self.options["path"], overwrite)


def read_landing(spark: SparkSession, path: str) -> DataFrame:
    """Committed responses below `path`: request_id, page_num, status, body; none yet gives no rows."""
    spark.dataSource.register(LandedPages)
    committed.enable_pushdown(spark)
    return spark.read.format(NAME).load(path)


def write_landing(pages: DataFrame, path: str, mode: str = "append") -> None:
    """Land responses (request_id, page_num, status, body) in one commit.

    Range partitions over both keys: a request that holds a third of all pages becomes many parts.
    """
    spark = pages.sparkSession
    spark.dataSource.register(LandedPages)
    rows = pages.select(*[F.col(name).cast(kind) for name, kind in (c.split() for c in SCHEMA.split(", "))])
    rows.repartitionByRange(*KEYS).sortWithinPartitions(*KEYS).write.format(NAME).mode(mode).save(path)
