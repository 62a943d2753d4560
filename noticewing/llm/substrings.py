"""Substring dedup: repeated word windows found by a compressed FM-index per shard."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticewing.llm.common import mixed, ranges, text_bytes, word_hashes, word_spans
from noticewing.llm.fmindex import FmIndex, matched
from noticewing.llm.lines import doc_keys

#: words of a window, and of the anchor that decides its shard
WINDOW, ANCHOR = 13, 3
#: bytes of text in one bucket of documents and, about, in one shard
BUCKET_BYTES = 4 << 20
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: longest segment, in words: as many windows as can share an anchor, and the rest of the last one
LONGEST = 2 * WINDOW - ANCHOR


@dataclass
class Segments:
    """Runs of windows with one anchor, over the documents of a bucket."""

    data: np.ndarray
    starts: np.ndarray  # of words, in bytes
    ends: np.ndarray
    words: np.ndarray  # each row's first word, and one more
    row: np.ndarray
    first: np.ndarray  # word
    size: np.ndarray  # words
    anchor: np.ndarray  # hash
    sig: np.ndarray  # hash of all words


def segments(text: pa.Array | pa.ChunkedArray) -> Segments:
    """Every window of every row lies in exactly one segment.

    The anchor of a window is its leftmost ANCHOR words of least hash, so equal windows have equal
    anchors wherever they occur, and their segments meet in the anchor's shard.
    """
    data, rows = text_bytes(text)
    starts, ends, first_word = word_spans(data, rows)
    h = word_hashes(data, starts, ends)
    n = len(h)
    row = np.repeat(np.arange(len(rows) - 1), np.diff(first_word))
    none = np.zeros(0, dtype=np.int64)
    if n < WINDOW:
        return Segments(data, starts, ends, first_word, none, none, none, none.astype(np.uint64), none.astype(np.uint64))
    with np.errstate(over="ignore"):
        g = np.zeros(n - ANCHOR + 1, dtype=np.uint64)
        for k in range(ANCHOR):
            g = g * _MULTIPLIER + h[k : k + len(g)]
        g = mixed(g)
        windows = n - WINDOW + 1
        best, at = g[:windows].copy(), np.zeros(windows, dtype=np.int8)
        for k in range(1, WINDOW - ANCHOR + 1):
            lower = g[k : k + windows] < best
            best[lower] = g[k : k + windows][lower]
            at[lower] = k
        whole = np.flatnonzero(row[:windows] == row[WINDOW - 1 :])
        place = whole + at[whole]
        new = np.ones(len(whole), dtype=bool)
        new[1:] = (whole[1:] != whole[:-1] + 1) | (place[1:] != place[:-1])
        edge = np.flatnonzero(new)
        first = whole[edge]
        size = np.diff(np.append(edge, len(whole))) + WINDOW - 1
        sig = _signatures(h, first, size)
    return Segments(data, starts, ends, first_word, row[first], first, size, best[first], sig)


def _shard(anchor: np.ndarray, n_shards: int) -> np.ndarray:
    return ((anchor >> np.uint64(32)) % np.uint64(n_shards)).astype(np.int64)


def _lowest(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, a place of each, and the lowest and highest id with it."""
    by = np.lexsort((ids, keys))
    edge = np.flatnonzero(np.append(True, keys[by][1:] != keys[by][:-1])) if len(by) else by
    last = np.append(edge[1:], len(by)) - 1
    return keys[by[edge]], by[edge], ids[by[edge]], ids[by[last]]


_ASKED = pa.schema([("bucket", pa.int32()), ("shard", pa.int32()), ("keys", pa.binary()), ("low", pa.binary()), ("high", pa.binary())])
_ANSWER = pa.schema([("bucket", pa.int32()), ("shard", pa.int32()), ("found", pa.binary())])
_SENT = pa.schema([("bucket", pa.int32()), ("shard", pa.int32()), ("words", pa.binary()), ("low", pa.binary()), ("high", pa.binary())])
_FIRSTS = pa.schema([("bucket", pa.int32()), ("shard", pa.int32()), ("segment", pa.binary()), ("firsts", pa.binary())])


def _by_shard(shard: np.ndarray) -> list[tuple[int, int, int]]:
    some, edge = np.unique(shard, return_index=True)
    return list(zip(some.tolist(), edge.tolist(), [*edge[1:].tolist(), len(shard)]))


def _anchors(s: Segments, ids: np.ndarray, n_shards: int):
    """Distinct anchors of a bucket with their lowest and highest document, by shard."""
    keys, at, low, high = _lowest(s.anchor, ids[s.row])
    by = np.argsort(_shard(keys, n_shards), kind="stable")
    return keys[by], low[by], high[by], _shard(keys, n_shards)[by]


def _repeated(s: Segments, ids: np.ndarray, answers: pa.Table, n_shards: int):
    """Distinct segments with an anchor that several documents have, by shard: (signature, place, low, high, shard)."""
    keys, _, _, shard = _anchors(s, ids, n_shards)
    found = np.zeros(len(keys), dtype=bool)
    edges = {p: (a, b) for p, a, b in _by_shard(shard)}
    for p, bits in zip(answers.column("shard").to_pylist(), answers.column("found").to_pylist()):
        a, b = edges[p]
        found[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)
    wanted = np.sort(keys[found])
    if not len(wanted):
        empty = np.zeros(0, np.int64)
        return empty.astype(np.uint64), empty, empty, empty, empty
    at = np.minimum(np.searchsorted(wanted, s.anchor), len(wanted) - 1)
    pick = np.flatnonzero(wanted[at] == s.anchor)
    sig, place, low, high = _lowest(s.sig[pick], ids[s.row[pick]])
    place = pick[place]
    shard = _shard(s.anchor[place], n_shards)
    by = np.argsort(shard, kind="stable")
    return sig[by], place[by], low[by], high[by], shard[by]


def _text_of(s: Segments, place: np.ndarray) -> bytes:
    """The words of segments, one segment a line."""
    word = ranges(s.first[place], s.size[place])
    length = s.ends[word] - s.starts[word] + 1
    ends = np.cumsum(length)
    out = np.full(int(ends[-1]), 0x20, dtype=np.uint8)
    out[ends[np.cumsum(s.size[place]) - 1] - 1] = 0x0A
    out[ranges(ends - length, length - 1)] = s.data[ranges(s.starts[word], length - 1)]
    return out.tobytes()


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[k] for r in rows], type=f.type) for k, f in enumerate(schema)], schema=schema)


def _signatures(h: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hash of runs of words with hashes `h`."""
    with np.errstate(over="ignore"):
        up, down = np.cumprod(np.full(len(h), _MULTIPLIER)), np.cumprod(np.full(len(h), _INVERSE))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * up)))
        return mixed((total[first + size] - total[first]) * down[first] + size.astype(np.uint64))


def _resembling(h: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Segments with a window whose hash another window has. Equal windows have equal hashes, so the windows of all others are in one segment only."""
    windows = size - WINDOW + 1
    at = ranges(first, windows)
    hashes = _signatures(h, at, np.full(len(at), WINDOW))
    by = np.argsort(hashes)
    edge = np.flatnonzero(np.append(True, hashes[by][1:] != hashes[by][:-1]))
    n = np.diff(np.append(edge, len(by)))
    several = np.empty(len(by), dtype=bool)
    several[by] = np.repeat(n > 1, n)
    return np.logical_or.reduceat(several, np.cumsum(windows) - windows)


def _first_documents(text: bytes, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of windows of every segment (a line of `text`), and the lowest document each window occurs in.

    Equal segments of several buckets are one, with their lowest document. One that has no window in
    common with any other is its windows' only one; those that may have one are indexed and searched.
    """
    data = np.frombuffer(text, dtype=np.uint8)
    rows = np.concatenate(([0], np.flatnonzero(data == 0x0A) + 1))
    starts, ends, edge = word_spans(data, rows)
    h, size = word_hashes(data, starts, ends), np.diff(edge)
    _, one, of = np.unique(_signatures(h, edge[:-1], size), return_index=True, return_inverse=True)
    least = np.full(len(one), np.iinfo(np.int64).max)
    np.minimum.at(least, of, low)
    first, own = edge[one], size[one] - WINDOW + 1
    found, start = np.repeat(least, own), np.cumsum(own) - own
    some = np.flatnonzero(_resembling(h, first, size[one]))
    if len(some):
        n = size[one[some]]
        found[ranges(start[some], own[some])] = _searched(h[ranges(first[some], n)], n, least[some])
    windows = size - WINDOW + 1
    return windows, found[ranges(start[of], windows)]


def _searched(words: np.ndarray, size: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The lowest document of every window of segments whose words lie end to end.

    The segments are indexed; then all are searched backwards, and wherever WINDOW words or more match,
    the interval's suffixes agree in the window that begins there.
    """
    _, symbol = np.unique(words, return_inverse=True)
    edge = np.cumsum(size) - size
    n_symbols = int(symbol.max()) + 1
    body = np.zeros(len(symbol) + len(size), dtype=np.int64)
    first = edge + np.arange(len(size))  # a 0 follows each segment
    body[ranges(first, size)] = symbol + 1
    index = FmIndex(body, n_symbols, LONGEST + 1)
    owner = np.repeat(np.arange(len(size)), size + 1)
    whole = np.arange(len(body)) - first[owner] + WINDOW <= size[owner]
    least = np.where(whole, low[owner], np.iinfo(np.int64).max)[index.order]
    group = index.groups(WINDOW)
    lowest = np.minimum.reduceat(least, np.flatnonzero(np.append(True, group[1:] != group[:-1])))
    windows = size - WINDOW + 1
    start = np.cumsum(windows) - windows
    out = np.full(int(windows.sum()), np.iinfo(np.int64).max, dtype=np.int64)
    for live, place, depth, at, _ in matched(index, body, first, size):
        if depth >= WINDOW:
            out[start[live] + place] = lowest[group[at]]
    return out


class Removal:
    """The steps for one number of shards, as functions of Arrow tables."""

    def __init__(self, n_shards: int):
        self.n_shards = n_shards

    def ask(self, docs: pa.Table) -> pa.Table:
        s, ids = segments(docs.column("text")), docs.column("_id").to_numpy()
        keys, low, high, shard = _anchors(s, ids, self.n_shards)
        bucket = docs.column("bucket")[0].as_py()
        short = (keys & np.uint64(0xFFFFFFFF)).astype("<u4")
        return _table([(bucket, p, short[a:b].tobytes(), low[a:b].tobytes(), (high - low)[a:b].tobytes()) for p, a, b in _by_shard(shard)], _ASKED)

    def answer(self, batches):
        """Which anchors several documents have, for all buckets that asked this task's shards."""
        asked: dict[int, list[tuple]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                asked.setdefault(row["shard"], []).append((row["bucket"], np.frombuffer(row["keys"], "<u4"), np.frombuffer(row["low"], np.int64), np.frombuffer(row["high"], np.int64)))
        for shard in sorted(asked):
            rows = asked.pop(shard)
            keys, low = np.concatenate([r[1] for r in rows]), np.concatenate([r[2] for r in rows])
            high = low + np.concatenate([r[3] for r in rows])
            _, inverse = np.unique(keys, return_inverse=True)
            least, most = np.full(inverse.max() + 1, np.iinfo(np.int64).max), np.full(inverse.max() + 1, np.iinfo(np.int64).min)
            np.minimum.at(least, inverse, low)
            np.maximum.at(most, inverse, high)
            several = (least < most)[inverse]
            edge = np.cumsum([0, *[len(r[1]) for r in rows]])
            yield from _table([(r[0], shard, np.packbits(several[a:b]).tobytes()) for r, a, b in zip(rows, edge[:-1], edge[1:]) if several[a:b].any()], _ANSWER).to_batches()

    def send(self, docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows or not answers.num_rows:
            return _table([], _SENT)
        s, ids = segments(docs.column("text")), docs.column("_id").to_numpy()
        _, place, low, high, shard = _repeated(s, ids, answers, self.n_shards)
        bucket = docs.column("bucket")[0].as_py()
        return _table([(bucket, p, _text_of(s, place[a:b]), low[a:b].tobytes(), high[a:b].tobytes()) for p, a, b in _by_shard(shard)], _SENT)

    def index(self, batches):
        """First documents of the windows of all segments sent to this task's shards, where they matter."""
        sent: dict[int, list[dict]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                sent.setdefault(row["shard"], []).append(row)
        for shard in sorted(sent):
            rows = sent.pop(shard)
            low = [np.frombuffer(r["low"], np.int64) for r in rows]
            high = [np.frombuffer(r["high"], np.int64) for r in rows]
            windows, firsts = _first_documents(b"".join([r["words"] for r in rows]), np.concatenate(low))
            start = np.concatenate(([0], np.cumsum(windows)))
            matters = np.minimum.reduceat(firsts, start[:-1]) < np.concatenate(high)
            edge = np.cumsum([0, *map(len, low)])
            out = []
            for r, a, b in zip(rows, edge[:-1], edge[1:]):
                pick = np.flatnonzero(matters[a:b])
                if len(pick):
                    out.append((r["bucket"], shard, pick.astype("<i4").tobytes(), firsts[ranges(start[a + pick], windows[a + pick])].tobytes()))
            yield from _table(out, _FIRSTS).to_batches()

    def spans(self, docs: pa.Table, answers: pa.Table, firsts: pa.Table) -> tuple[Segments, np.ndarray]:
        """The bucket's segments, and for every word whether it goes."""
        s, ids = segments(docs.column("text")), docs.column("_id").to_numpy()
        gone = np.zeros(len(s.starts) + 1, dtype=np.int64)
        if answers.num_rows and firsts.num_rows:
            sig, place, _, _, shard = _repeated(s, ids, answers, self.n_shards)
            edges = {p: a for p, a, _ in _by_shard(shard)}
            which, values = [], []
            for row in firsts.to_pylist():
                which.append(edges[row["shard"]] + np.frombuffer(row["segment"], "<i4").astype(np.int64))
                values.append(np.frombuffer(row["firsts"], np.int64))
            which, values = np.concatenate(which), np.concatenate(values)
            windows = s.size[place[which]] - WINDOW + 1
            start = np.cumsum(windows) - windows
            by = np.argsort(sig[which])
            ordered = sig[which][by]
            at = np.minimum(np.searchsorted(ordered, s.sig), len(ordered) - 1)
            mine = np.flatnonzero(ordered[at] == s.sig)
            own = by[at[mine]]
            n = windows[own]
            word = ranges(s.first[mine], n)
            earlier = values[ranges(start[own], n)] < np.repeat(ids[s.row[mine]], n)
            np.add.at(gone, word[earlier], 1)
        # A window covers WINDOW words from its first.
        covered = np.cumsum(gone[:-1])
        covered[WINDOW:] -= covered[:-WINDOW].copy() if len(covered) > WINDOW else 0
        return s, covered > 0



def _planned(docs: DataFrame, key: str, text: str):
    """Documents in buckets, the answers and first documents for each, and the steps."""
    spark = docs.sparkSession
    slim = docs.select(*[c.alias(n) for n, c in doc_keys(docs, key, text).items()], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    size = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(size) // BUCKET_BYTES))
    bucketed = slim.withColumn("bucket", F.pmod(F.hash("_id", "_h"), F.lit(n)).cast("int"))
    steps = Removal(n)
    by = bucketed.groupBy("bucket")
    asked = by.applyInArrow(lambda part: steps.ask(part), "bucket int, shard int, keys binary, low binary, high binary")
    answers = asked.repartition(n, "shard").mapInArrow(lambda batches: steps.answer(batches), "bucket int, shard int, found binary")
    sent = by.cogroup(answers.groupBy("bucket")).applyInArrow(lambda part, found: steps.send(part, found), "bucket int, shard int, words binary, low binary, high binary")
    firsts = sent.repartition(n, "shard").mapInArrow(lambda batches: steps.index(batches), "bucket int, shard int, segment binary, firsts binary")
    # Both kinds of replies in one frame: a cogroup takes two sides.
    replies = answers.select("bucket", "shard", F.col("found"), F.lit(None).cast("binary").alias("segment"), F.lit(None).cast("binary").alias("firsts")).unionByName(
        firsts.select("bucket", "shard", F.lit(None).cast("binary").alias("found"), "segment", "firsts"))
    return bucketed, replies, steps


def _split(replies: pa.Table) -> tuple[pa.Table, pa.Table]:
    return replies.filter(pa.compute.field("found").is_valid()), replies.filter(pa.compute.field("segment").is_valid())


def window_report(docs: DataFrame, key: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """Repeated windows removed from every text: `_id`, `_h` (as `doc_keys` gives them), n_words, n_removed, kept_sha256.

    Words are longest runs without ASCII white space, whole and unchanged. A word goes if one of the
    WINDOW-word windows over it also starts in a document with a smaller id (null is smallest);
    windows are judged on the input. kept_sha256 is of the kept words joined by one space;
    `with_text` adds `kept_text`, the text without the words that go and the white space after them.
    Null texts have no words; texts shorter than a window lose none; rows that share an id do not
    take words from each other.

    Windows go to shards by their anchor. Buckets of documents first ask which anchors several
    documents have; segments with such anchors are sent, each different one once per bucket, and
    every shard indexes its segments and searches them. Anchors, signatures and words are compared by
    64-bit hashes. A bucket and a shard hold BUCKET_BYTES of text or so at any size of the input, and
    a passage that many documents share reaches its shard once per bucket.
    """
    bucketed, replies, steps = _planned(docs, key, text)
    fields = [("_id", pa.int64()), ("_h", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]
    schema = pa.schema(fields + [("kept_text", pa.string())] * with_text)

    def finish(docs: pa.Table, replies: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return schema.empty_table()
        s, gone = steps.spans(docs, *_split(replies))
        n_words = np.diff(s.words)
        upto = np.concatenate(([0], np.cumsum(gone)))
        raw, rows, digests, texts = s.data.tobytes(), text_bytes(docs.column("text"))[1], [], []
        starts, ends, lost = s.starts.tolist(), s.ends.tolist(), gone.tolist()
        for r, (a, b) in enumerate(zip(s.words[:-1].tolist(), s.words[1:].tolist())):
            digests.append(hashlib.sha256(b" ".join([raw[starts[k] : ends[k]] for k in range(a, b) if not lost[k]])).hexdigest())
            if with_text:
                part, at, k = [], int(rows[r]), a
                while k < b:
                    if lost[k]:
                        part.append(raw[at : starts[k]])
                        while k < b and lost[k]:
                            k += 1
                        at = starts[k] if k < b else int(rows[r + 1])
                    else:
                        k += 1
                texts.append((b"".join(part) + raw[at : int(rows[r + 1])]).decode())
        columns = [docs.column("_id"), docs.column("_h"), pa.array(n_words), pa.array(upto[s.words[1:]] - upto[s.words[:-1]]), pa.array(digests)]
        return pa.Table.from_arrays([*columns, *([pa.array(texts, type=pa.string())] * with_text)], schema=schema)

    kind = "_id long, _h long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return bucketed.groupBy("bucket").cogroup(replies.groupBy("bucket")).applyInArrow(finish, kind)


def deduped(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` without the words `window_report` removes; n_chars, if there, is the new length. Every row stays, null texts too."""
    found = window_report(docs, key, text, with_text=True).where("n_removed > 0").select("_id", "_h", "kept_text").dropDuplicates(["_id", "_h"])
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    both = docs.select(row.alias("_row"), *[c.alias(n) for n, c in doc_keys(docs, key, text).items()]).join(found, ["_id", "_h"], "left")
    new = F.coalesce("kept_text", F.col(f"_row.`{text}`"))
    return both.select(*[
        new.alias(c) if c == text
        else F.when(F.col("kept_text").isNull(), F.col("_row.n_chars")).otherwise(F.length("kept_text").cast(docs.schema[c].dataType)).alias(c) if c == "n_chars"
        else F.col(f"_row.`{c}`")
        for c in docs.columns
    ])
