"""Suffix-array dedup: byte strings that an earlier document has are found by suffix sorting and removed."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticewing.llm.common import batches_of, mixed, ranges, text_bytes
from noticewing.llm.lines import doc_keys
from noticewing.llm.suffixes import suffix_order

#: bytes of a repeated string, and of the anchor that decides where it is looked up (a power of two)
WINDOW, ANCHOR = 50, 16
#: bytes of text in one bucket of documents
BUCKET_BYTES = 4 << 20
#: places with one anchor from which on its windows are looked up one by one
HOT = 20_000
#: places whose hashes are computed at once; low bits that hold such a place
CHUNK, PLACE_BITS = 1 << 17, 18
_M = 0x9E3779B97F4A7C15
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9))


def _squeezed(raw: bytes) -> bytes:
    return pa.compress(raw, codec="zstd", asbytes=True)


def _whole(raw: bytes, size: int) -> bytes:
    return pa.decompress(raw, size, codec="zstd", asbytes=True)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_M, n, 1 << 64))


def _anchor_hashes(data: np.ndarray) -> np.ndarray:
    """The hash of the ANCHOR bytes at every place where so many are left."""
    with np.errstate(over="ignore"):
        out, step = _BYTES[data], 1
        while step < ANCHOR:
            out = out[:-step] * _power(step) + out[step:]
            step *= 2
    return out


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` neighbouring values."""
    done = 1
    while 2 * done <= width:
        values = np.minimum(values[:-done], values[done:])
        done *= 2
    return np.minimum(values[: len(values) - (width - done)], values[width - done :]) if width > done else values


@dataclass
class Segments:
    """Runs of windows with one anchor, over the documents of a bucket."""

    data: np.ndarray
    rows: np.ndarray  # first byte of each row, and one more
    row: np.ndarray
    first: np.ndarray  # byte
    size: np.ndarray  # bytes
    place: np.ndarray  # first byte of the anchor
    anchor: np.ndarray  # hash


def _signatures(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hash of the strings at `first`, in ascending order; a block of places at a time, so that sums beside it stay small."""
    out = np.zeros(len(first), dtype=np.uint64)
    i = 0
    with np.errstate(over="ignore"):
        up = np.cumprod(np.full(CHUNK + 2 * WINDOW, np.uint64(_M)))
        down = np.cumprod(np.full(CHUNK + 2 * WINDOW, _power(-1)))
        while i < len(first):
            j = int(np.searchsorted(first, first[i] + CHUNK))
            base = int(first[i])
            part = _BYTES[data[base : int((first[i:j] + size[i:j]).max())]]
            sums = np.zeros(len(part) + 1, dtype=np.uint64)
            np.cumsum(part * up[: len(part)], out=sums[1:])
            a = first[i:j] - base
            out[i:j] = mixed((sums[a + size[i:j]] - sums[a]) * down[a] + size[i:j].astype(np.uint64))
            i = j
    return out


def segments(text: pa.Array | pa.ChunkedArray) -> Segments:
    """Every window of every row lies in exactly one segment.

    The anchor of a window is its leftmost ANCHOR bytes of least hash, so equal windows have equal
    anchors at equal places in them wherever they occur, and their segments meet in the anchor's shard.
    """
    data, rows = text_bytes(text)
    kept = [[np.zeros(0, np.int64)] for _ in range(4)] + [[np.zeros(0, np.uint64)]]
    low = np.uint64((1 << PLACE_BITS) - 1)
    # Short rows are hashed together, long ones alone in chunks from their own start, so that a row's segments do not depend on others.
    for i, j in batches_of(rows, CHUNK):
        for at in range(int(rows[i]), max(int(rows[j]) - WINDOW + 1, 0), CHUNK):
            part = data[at : min(at + CHUNK + WINDOW - 1, int(rows[j]))]
            if len(part) < WINDOW:
                continue
            hashes = _anchor_hashes(part)
            place = (_least(hashes & ~low | np.arange(len(hashes), dtype=np.uint64), WINDOW - ANCHOR + 1) & low).astype(np.int64)
            n = len(place)
            # Windows that cross from a row into the next are none.
            inside = rows[i + 1 : j] - at
            cross, until = np.minimum(np.maximum(inside - WINDOW + 1, 0), n), np.minimum(inside, n)
            whole = np.ones(n, dtype=bool)
            whole[ranges(cross, until - cross)] = False
            new = np.ones(n, dtype=bool)
            new[1:] = (place[1:] != place[:-1]) | (whole[1:] != whole[:-1])
            new[inside[inside < n]] = True
            edge = np.flatnonzero(new)
            size = np.diff(np.append(edge, n))
            pick = whole[edge]
            edge, size = edge[pick], size[pick]
            of = i + np.searchsorted(rows[i + 1 : j + 1], edge + at, side="right")
            for k, values in enumerate((of, edge + at, size + WINDOW - 1, place[edge] + at, mixed(hashes[place[edge]]))):
                kept[k].append(values)
    return Segments(data, rows, *map(np.concatenate, kept))


def _shard(key: np.ndarray, n_shards: int) -> np.ndarray:
    return ((key >> np.uint64(32)) % np.uint64(n_shards)).astype(np.int64)


def _runs(keys: np.ndarray) -> np.ndarray:
    """First places of equal neighbours."""
    return np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)


def _by_shard(shard: np.ndarray) -> list[tuple[int, int, int]]:
    edge = _runs(shard)
    return list(zip(shard[edge].tolist(), edge.tolist(), [*edge[1:].tolist(), len(shard)]))


def _packed(values: np.ndarray) -> bytes:
    """Integers as their least and the rest in as few bytes as hold them, compressed."""
    if not len(values):
        return b""
    low = int(values.min())
    rest = (values.astype(np.uint64) - np.array(low, dtype=np.int64).astype(np.uint64))
    wide = 1 if rest.max() < 1 << 8 else 2 if rest.max() < 1 << 16 else 4 if rest.max() < 1 << 32 else 8
    body = rest.astype(f"<u{wide}").tobytes()
    return bytes([wide]) + low.to_bytes(8, "little", signed=True) + len(body).to_bytes(8, "little") + _squeezed(body)


def _unpacked(raw: bytes) -> np.ndarray:
    if not raw:
        return np.zeros(0, dtype=np.int64)
    low, size = int.from_bytes(raw[1:9], "little", signed=True), int.from_bytes(raw[9:17], "little")
    rest = np.frombuffer(_whole(raw[17:], size), dtype=f"<u{raw[0]}").astype(np.uint64)
    return (rest + np.array(low, dtype=np.int64).astype(np.uint64)).view(np.int64)


@dataclass
class Lookups:
    """What a bucket asks its shards for: distinct strings by shard, and all places where the bucket has them."""

    shard: np.ndarray
    first: np.ndarray
    size: np.ndarray
    anchor: np.ndarray  # place of the anchor in the string
    low: np.ndarray  # documents
    high: np.ndarray
    place_first: np.ndarray  # every occurrence
    place_row: np.ndarray
    place_of: np.ndarray  # the distinct string it is


def _anchors(s: Segments, ids: np.ndarray, n_shards: int) -> tuple[np.ndarray, ...]:
    """Distinct anchors of a bucket by shard: hash, lowest document, whether others have it, number of places, shard."""
    by = np.argsort(s.anchor, kind="stable")
    anchor, doc = s.anchor[by], ids[s.row[by]]
    edge = _runs(anchor)
    if not len(edge):
        none = np.zeros(0, np.int64)
        return anchor, none, none, none, none
    low, high, n = np.minimum.reduceat(doc, edge), np.maximum.reduceat(doc, edge), np.diff(np.append(edge, len(by)))
    shard = _shard(anchor[edge], n_shards)
    by = np.argsort(shard, kind="stable")
    return anchor[edge][by], low[by], (high > low)[by].astype(np.int64), n[by], shard[by]


class Removal:
    """The steps for one number of shards, as functions of Arrow tables."""

    def __init__(self, n_shards: int, hot: int = HOT):
        self.n_shards, self.hot = n_shards, hot

    ASKED = pa.schema([("bucket", pa.int32()), ("shard", pa.int32()), ("keys", pa.binary()), ("low", pa.binary()), ("several", pa.binary()), ("n", pa.binary())])
    ANSWER = pa.schema([("bucket", pa.int32()), ("shard", pa.int32()), ("found", pa.binary())])
    SENT = pa.schema([("bucket", pa.int32()), ("shard", pa.int32()), ("bytes", pa.binary()), ("size", pa.binary()), ("anchor", pa.binary()), ("low", pa.binary()), ("high", pa.binary())])
    FIRSTS = pa.schema([("bucket", pa.int32()), ("shard", pa.int32()), ("which", pa.binary()), ("firsts", pa.binary())])

    @staticmethod
    def table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
        return pa.Table.from_arrays([pa.array([r[k] for r in rows], type=f.type) for k, f in enumerate(schema)], schema=schema)

    def ask(self, docs: pa.Table) -> pa.Table:
        s, ids = segments(docs.column("text")), docs.column("_id").to_numpy()
        keys, low, several, n, shard = _anchors(s, ids, self.n_shards)
        bucket, short = docs.column("bucket")[0].as_py(), (keys & np.uint64(0xFFFFFFFF)).astype("<u4")
        return self.table([
            (bucket, p, short[a:b].tobytes(), _packed(low[a:b]), _packed(several[a:b]), _packed(n[a:b])) for p, a, b in _by_shard(shard)], self.ASKED)

    def answer(self, rows: list[dict]) -> pa.Table:
        """For all buckets that asked a shard: 1 for anchors that several documents have, 2 for those in very many places."""
        keys = np.concatenate([np.frombuffer(r["keys"], "<u4") for r in rows])
        low, several, n = (np.concatenate([_unpacked(r[c]) for r in rows]) for c in ("low", "several", "n"))
        by = np.argsort(keys, kind="stable")
        edge = _runs(keys[by])
        many = (np.minimum.reduceat(low[by], edge) < np.maximum.reduceat(low[by], edge)) | (np.maximum.reduceat(several[by], edge) > 0)
        kind = np.where(many, np.where(np.add.reduceat(n[by], edge) > self.hot, 2, 1), 0).astype(np.uint8)
        out = np.empty(len(keys), dtype=np.uint8)
        out[by] = np.repeat(kind, np.diff(np.append(edge, len(keys))))
        at = np.cumsum([0, *[len(r["keys"]) // 4 for r in rows]])
        return self.table([(r["bucket"], r["shard"], _squeezed(out[a:b].tobytes())) for r, a, b in zip(rows, at, at[1:]) if out[a:b].any()], self.ANSWER)

    def _lookups(self, s: Segments, ids: np.ndarray, answers: pa.Table) -> Lookups:
        keys, _, _, _, shard = _anchors(s, ids, self.n_shards)
        kind = np.zeros(len(keys), dtype=np.uint8)
        edges = {p: (a, b) for p, a, b in _by_shard(shard)}
        for p, found in zip(answers.column("shard").to_pylist(), answers.column("found").to_pylist()):
            a, b = edges[p]
            kind[a:b] = np.frombuffer(_whole(found, b - a), np.uint8)
        by = np.argsort(keys)
        own = kind[by][np.searchsorted(keys[by], s.anchor)] if len(keys) else np.zeros(0, np.uint8)
        some, hot = np.flatnonzero(own == 1), np.flatnonzero(own == 2)
        # Windows of hot anchors are strings of their own, in the shard of their own hash.
        n = s.size[hot] - WINDOW + 1
        single = ranges(s.first[hot], n)
        alone = _signatures(s.data, single, np.full(len(single), WINDOW))
        first = np.concatenate((s.first[some], single))
        size = np.concatenate((s.size[some], np.full(len(single), WINDOW, np.int64)))
        row = np.concatenate((s.row[some], np.repeat(s.row[hot], n)))
        place = np.concatenate((s.place[some], np.repeat(s.place[hot], n))) - first
        sig = np.concatenate((_signatures(s.data, s.first[some], s.size[some]), alone))
        where = np.concatenate((_shard(s.anchor[some], self.n_shards), _shard(alone, self.n_shards)))
        by = np.argsort(sig, kind="stable")
        edge = _runs(sig[by])
        if not len(edge):
            return Lookups(*[np.zeros(0, np.int64)] * 9)
        doc, one = ids[row[by]], by[edge]
        low, high = np.minimum.reduceat(doc, edge), np.maximum.reduceat(doc, edge)
        order = np.argsort(where[one], kind="stable")
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        of = np.empty(len(by), dtype=np.int64)
        of[by] = np.repeat(rank, np.diff(np.append(edge, len(by))))
        one = one[order]
        return Lookups(where[one], first[one], size[one], place[one], low[order], high[order], first, row, of)

    def send(self, docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows or not answers.num_rows:
            return self.SENT.empty_table()
        s, ids = segments(docs.column("text")), docs.column("_id").to_numpy()
        k = self._lookups(s, ids, answers)
        bucket, out = docs.column("bucket")[0].as_py(), []
        for p, a, b in _by_shard(k.shard):
            body = s.data[ranges(k.first[a:b], k.size[a:b])].tobytes()
            out.append((bucket, p, _squeezed(body), _packed(k.size[a:b]), _packed(k.anchor[a:b]), _packed(k.low[a:b]), _packed(k.high[a:b] - k.low[a:b])))
        return self.table(out, self.SENT)

    def index(self, rows: list[dict]) -> pa.Table:
        """For every string sent to a shard the lowest document of each of its windows, where that is not its own."""
        size = [_unpacked(r["size"]) for r in rows]
        body = np.concatenate([np.frombuffer(_whole(r["bytes"], int(n.sum())), np.uint8) for r, n in zip(rows, size)])
        low, anchor = (np.concatenate([_unpacked(r[c]) for r in rows]) for c in ("low", "anchor"))
        high = low + np.concatenate([_unpacked(r["high"]) for r in rows])
        at, size = np.cumsum([0, *map(len, size)]), np.concatenate(size)
        first = np.cumsum(size) - size
        # Equal strings of several buckets are one, with their lowest document.
        _, one, of = np.unique(_signatures(body, first, size), return_index=True, return_inverse=True)
        least = np.full(len(one), np.iinfo(np.int64).max)
        np.minimum.at(least, of, low)
        found, start = first_documents(body[ranges(first[one], size[one])], size[one], anchor[one], least)
        windows = size[one] - WINDOW + 1
        lowest = np.minimum.reduceat(found, start)
        out = []
        for r, a, b in zip(rows, at, at[1:]):
            pick = np.flatnonzero(lowest[of[a:b]] < high[a:b])
            if len(pick):
                mine = of[a + pick]
                out.append((r["bucket"], r["shard"], _packed(pick), _packed(found[ranges(start[mine], windows[mine])])))
        return self.table(out, self.FIRSTS)

    def covered(self, docs: pa.Table, answers: pa.Table, firsts: pa.Table) -> tuple[Segments, np.ndarray]:
        """The bucket's bytes, and for each whether it goes."""
        s, ids = segments(docs.column("text")), docs.column("_id").to_numpy()
        if not answers.num_rows or not firsts.num_rows:
            return s, np.zeros(len(s.data), dtype=bool)
        k = self._lookups(s, ids, answers)
        edges = {p: a for p, a, _ in _by_shard(k.shard)}
        which = np.concatenate([edges[p] + _unpacked(w) for p, w in zip(firsts.column("shard").to_pylist(), firsts.column("which").to_pylist())])
        values = np.concatenate([_unpacked(f) for f in firsts.column("firsts").to_pylist()])
        windows = k.size[which] - WINDOW + 1
        start = np.full(len(k.first), -1)
        start[which] = np.cumsum(windows) - windows
        mine = np.flatnonzero(start[k.place_of] >= 0)
        one = k.place_of[mine]
        n = k.size[one] - WINDOW + 1
        earlier = values[ranges(start[one], n)] < np.repeat(ids[k.place_row[mine]], n)
        place = ranges(k.place_first[mine], n)[earlier]
        starts = np.zeros(len(s.data), dtype=np.int32)
        starts[place] = 1
        gone = np.cumsum(starts)
        gone[WINDOW:] -= gone[:-WINDOW].copy()  # windows that start within the last WINDOW bytes
        return s, gone > 0


def _resembling(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Strings with a window whose hash another window has. Equal windows have equal hashes, so the windows of all others are in one string only."""
    with np.errstate(over="ignore"):
        hashes, step = _BYTES[data], 1
        while 2 * step <= WINDOW:
            hashes = hashes[:-step] * _power(step) + hashes[step:]
            step *= 2
        hashes = hashes[: len(data) - WINDOW + 1] * _power(WINDOW) + hashes[WINDOW - step :]  # two parts that overlap
    windows = size - WINDOW + 1
    hashes = hashes[ranges(begin, windows)]
    by = np.argsort(hashes)
    edge = _runs(hashes[by])
    several = np.empty(len(by), dtype=bool)
    several[by] = np.repeat(np.diff(np.append(edge, len(by))) > 1, np.diff(np.append(edge, len(by))))
    return np.logical_or.reduceat(several, np.cumsum(windows) - windows)


def first_documents(data: np.ndarray, size: np.ndarray, anchor: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lowest document of every window of the strings that lie end to end in `data`, and each string's first window.

    A string that has no window in common with any other is its windows' only one. Those that may have
    one are sorted, and that decides.
    """
    begin, windows = np.cumsum(size) - size, size - WINDOW + 1
    start = np.cumsum(windows) - windows
    out, some = np.repeat(low, windows), np.flatnonzero(_resembling(data, begin, size))
    if len(some):
        out[ranges(start[some], windows[some])] = _sorted_firsts(data[ranges(begin[some], size[some])], size[some], anchor[some], low[some])
    return out, start


def _sorted_firsts(data: np.ndarray, size: np.ndarray, anchor: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The lowest document of every window of strings that lie end to end.

    All suffixes are sorted; those that begin with equal windows are neighbours then. All windows of a
    string hold its anchor, so that is one symbol of the text whose suffixes are sorted.
    """
    begin = np.cumsum(size) - size
    text = size - ANCHOR + 1
    first = np.cumsum(text + 1) - text
    _, name = np.unique(_signatures(data, begin + anchor, np.full(len(size), ANCHOR)), return_inverse=True)
    n = int(text.sum()) + len(size) + 1
    symbols, inside, of = np.zeros(n, dtype=np.int32), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int32)
    at = ranges(first, text)
    rest = ranges(np.zeros(len(size), np.int64), text)  # place in the string's symbols
    of[at] = np.repeat(np.arange(len(size)), text)
    inside[at] = rest
    symbols[at] = data[np.repeat(begin, text) + rest + (ANCHOR - 1) * (rest > np.repeat(anchor, text))].astype(np.int32) + 1
    symbols[first + anchor] = 257 + name
    order = suffix_order(symbols)[len(size) + 1 :]
    rest, of = inside[order], of[order]
    whole = rest + WINDOW <= size[of]
    rest, of = rest[whole], of[whole]
    at = begin[of] + rest
    words = np.zeros(len(data) + 8, dtype=np.uint64)
    padded = np.concatenate((data, np.zeros(15, np.uint8)))
    for k in range(8):
        words |= padded[k : k + len(words)].astype(np.uint64) << np.uint64(8 * k)
    same = np.ones(max(len(at) - 1, 0), dtype=bool)
    for k in [*range(0, WINDOW - 7, 8), WINDOW - 8]:
        w = words[at + k]
        same &= w[1:] == w[:-1]
    edge = np.flatnonzero(np.append(True, ~same))
    lowest = np.minimum.reduceat(low[of], edge)
    windows = size - WINDOW + 1
    start = np.cumsum(windows) - windows
    out = np.empty(int(windows.sum()), dtype=np.int64)
    out[start[of] + rest] = np.repeat(lowest, np.diff(np.append(edge, len(at))))
    return out


def _each_shard(work):
    """`work` on the rows of one shard after the other, of batches that come in the order of shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and held[0]["shard"] != row["shard"]:
                    yield from work(held).to_batches()
                    held = []
                held.append(row)
        if held:
            yield from work(held).to_batches()

    return run


def _sql(schema: pa.Schema) -> str:
    names = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary", pa.string(): "string"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def repeat_report(docs: DataFrame, key: str = "doc_id", text: str = "text", with_bytes: bool = False, hot: int = HOT) -> DataFrame:
    """Repeated strings removed from every text: `_id`, `_h` (as `doc_keys` gives them), n_bytes, n_removed, n_spans, kept_sha256.

    Texts are their UTF-8 bytes, null is empty. A byte goes if one of the WINDOW-byte strings over it
    also starts in a document with a smaller id (null is smallest); strings are judged on the input and
    never cross documents. n_spans counts maximal removed runs, kept_sha256 is of the bytes that stay;
    `with_bytes` adds these as `kept` (a cut may divide a character, so they are binary) and the runs
    as `spans` (start, end). Texts shorter than WINDOW lose nothing; rows that share an id take nothing
    from each other.

    Windows go to shards by their anchor, the ANCHOR bytes of least hash. Buckets of documents first ask
    which anchors several documents have; the segments around those are sent, each different one once
    per bucket, and every shard sorts all suffixes of its different segments (`suffixes`). An
    anchor in more than `hot` places has its windows sent to shards by their own hash instead, so
    one very common string cannot fill a shard. Segments are told apart by 64-bit hashes, windows by
    their bytes. A bucket and a shard hold some megabytes of text; Spark decides how many of them a task
    works off, one after the other.
    """
    spark = docs.sparkSession
    slim = docs.select(*[c.alias(n) for n, c in doc_keys(docs, key, text).items()], F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    total = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(total) // BUCKET_BYTES))
    bucketed = slim.withColumn("bucket", F.pmod(F.hash("_id", "_h"), F.lit(n)).cast("int"))
    steps = Removal(n, hot)
    asked = bucketed.groupBy("bucket").applyInArrow(lambda part: steps.ask(part), _sql(steps.ASKED))
    answers = asked.repartition("shard").sortWithinPartitions("shard").mapInArrow(_each_shard(steps.answer), _sql(steps.ANSWER))
    sent = bucketed.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(lambda part, found: steps.send(part, found), _sql(steps.SENT))
    firsts = sent.repartition("shard").sortWithinPartitions("shard").mapInArrow(_each_shard(steps.index), _sql(steps.FIRSTS))
    # Both kinds of replies in one frame: a cogroup takes two sides.
    none = F.lit(None).cast("binary")
    replies = answers.select("bucket", "shard", "found", none.alias("which"), none.alias("firsts")).unionByName(
        firsts.select("bucket", "shard", none.alias("found"), "which", "firsts"))
    fields = [("_id", pa.int64()), ("_h", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema(fields + [("kept", pa.binary()), ("spans", span)] * with_bytes)

    def finish(docs: pa.Table, replies: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return schema.empty_table()
        s, gone = steps.covered(docs, replies.filter(replies.column("found").is_valid()), replies.filter(replies.column("which").is_valid()))
        rows = s.rows
        edge = np.zeros(len(gone) + 1, dtype=bool)
        edge[rows] = True
        before = np.append(False, gone[:-1])
        starts = np.flatnonzero(gone & (~before | edge[:-1]))
        after = np.append(gone[1:], False)
        ends = np.flatnonzero(gone & (~after | edge[1:])) + 1
        which = np.searchsorted(starts, rows)
        upto = np.concatenate(([0], np.cumsum(gone)))
        kept, at = s.data[~gone].tobytes(), rows - upto[rows]
        parts = [kept[a:b] for a, b in zip(at.tolist(), at[1:].tolist())]
        columns = [
            docs.column("_id"), docs.column("_h"), pa.array(np.diff(rows)), pa.array(np.diff(upto[rows])), pa.array(np.diff(which)),
            pa.array([hashlib.sha256(p).hexdigest() for p in parts], type=pa.string())]
        if with_bytes:
            shift = np.repeat(rows[:-1], np.diff(which))
            runs = [{"start": a, "end": b} for a, b in zip((starts - shift).tolist(), (ends - shift).tolist())]
            columns += [pa.array(parts, type=pa.binary()), pa.array([runs[a:b] for a, b in zip(which.tolist(), which[1:].tolist())], type=span)]
        return pa.Table.from_arrays(columns, schema=schema)

    kind = _sql(pa.schema(fields)) + ", kept binary, spans array<struct<start:long,end:long>>" * with_bytes
    return bucketed.groupBy("bucket").cogroup(replies.groupBy("bucket")).applyInArrow(finish, kind)
