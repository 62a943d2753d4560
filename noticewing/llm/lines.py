"""Line dedup: exact set-similarity join of lines with prefix, positional and length filters."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticewing.llm.common import (
    batches_of, bucketed, hash64, likely, lists, mixed, ranges, release, text_bytes, word_hashes, word_spans, written,
)

#: share of all lines from which on a token's frequency is counted; rarer tokens rank as equally rare
FREQUENT = 5e-5
#: bytes of text whose lines are read together
CHUNK = 3 << 20
#: bytes of text whose keys meet in one partition
TEXT_PER_PARTITION = 16 << 20
#: groups up to this size list their pairs at once; larger ones first compare with their earliest line
SMALL = 4
_LF = 0x0A


def doc_keys(docs: DataFrame, key: str = "doc_id", text: str = "text") -> dict[str, Column]:
    """Columns that name a document: its id (null first) and a hash of its text.

    Rows that agree in both are one document, however often they occur, and share one result.
    """
    return {
        "_id": F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(-(1 << 63))),
        "_h": hash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))),
    }


def _token_sets(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row and number of every line, and the distinct tokens of each with their line, lines in order."""
    feeds = np.flatnonzero(data == _LF)
    # A row begins a line and so does every feed in it, even its last byte: that line is empty.
    line_row = np.concatenate((np.arange(len(rows) - 1), np.searchsorted(rows[1:], feeds, side="right")))
    order = np.argsort(line_row, kind="stable")
    line_row, cuts = line_row[order], np.concatenate((rows[:-1], feeds + 1))[order]
    line_no = np.arange(len(cuts)) - np.searchsorted(line_row, line_row)
    starts, ends, _ = word_spans(data, rows)
    tokens = word_hashes(data, starts, ends)
    line = np.repeat(np.arange(len(cuts)), np.diff(np.append(np.searchsorted(starts, cuts), len(starts))))
    with np.errstate(over="ignore"):
        both = mixed(tokens ^ (line.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    by = np.argsort(both)
    new = np.ones(len(by), dtype=bool)
    new[1:] = both[by[1:]] != both[by[:-1]]
    one = np.zeros(len(by), dtype=bool)
    one[by[new]] = True  # one place of every (line, token), in the order of lines
    return line_row, line_no, line[one], tokens[one]


def _signatures(n_lines: int, line: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of each line's token set, and its size."""
    size = np.bincount(line, minlength=n_lines)
    some = size > 0
    first = (np.cumsum(size) - size)[some]
    with np.errstate(over="ignore"):
        total = np.zeros(n_lines, dtype=np.uint64)
        other = np.zeros(n_lines, dtype=np.uint64)
        if len(tokens):
            total[some] = np.add.reduceat(mixed(tokens + np.uint64(1)), first)
            other[some] = np.add.reduceat(mixed(tokens ^ np.uint64(0x5851F42D4C957F2D)), first)
        return mixed(total ^ mixed(other + size.astype(np.uint64))), size


def _bitmaps(n_lines: int, line: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """128 bits of each line, the parity of its tokens on each: sets differ in at least as many tokens as bits."""
    out = np.zeros((n_lines, 2), dtype=np.uint64)
    bit = ((tokens >> np.uint64(20)) & np.uint64(127)).astype(np.int64)
    for i in range(0, n_lines, 1 << 14):  # some lines at a time: a count per line and bit
        n = min(1 << 14, n_lines - i)
        a, b = np.searchsorted(line, (i, i + n))
        odd = np.bincount((line[a:b] - i) * 128 + bit[a:b], minlength=n * 128).astype(np.uint8) & 1
        out[i : i + n] = np.packbits(odd.reshape(n, 128), axis=1, bitorder="little").view(np.uint64)
    return out


def _chunks(batches: Iterator[pa.RecordBatch], most: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray, pa.RecordBatch]]:
    """Blocks of a batch whose column `text` has about `most` bytes: bytes, row starts, the block's rows."""
    for batch in batches:
        data, rows = text_bytes(batch.column("text"))
        for i, j in batches_of(rows, most):
            yield data[rows[i] : rows[j]], rows[i : j + 1] - rows[i], batch.slice(i, j - i)


class FrequentCounts:
    """Counts of tokens, of which those that are surely in less than `share` of all lines are let go (lossy counting)."""

    def __init__(self, share: float):
        self.share, self.lines = share, 0
        self.token, self.n, self.missed = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.float64)

    def add(self, tokens: np.ndarray, lines: int) -> None:
        new, n = np.unique(tokens, return_counts=True)
        at = np.searchsorted(self.token, new)
        held = np.append(self.token, np.uint64(0))[at] == new
        held &= at < len(self.token)
        self.n[at[held]] += n[held]
        at, new, n = at[~held], new[~held], n[~held]
        token, total, missed = np.insert(self.token, at, new), np.insert(self.n, at, n), np.insert(self.missed, at, self.share * self.lines)
        self.lines += lines
        stay = total + missed >= self.share * self.lines
        self.token, self.n, self.missed = token[stay], total[stay], missed[stay]


def _read(docs: DataFrame) -> DataFrame:
    """Lines with tokens (kind 0: document, number in it, signature, distinct tokens, bitmap) and token counts.

    Every task reports tokens in at least half of FREQUENT of its lines (kind 1: token as `_sig`, lines
    as `_n`, at most that half too few) and how many lines it has (kind 2, with the least and the
    greatest document and the bytes of text as `_id`, `_h` and `_b0`).
    """
    names = ["_kind", "_id", "_h", "_line", "_sig", "_n", "_b0", "_b1"]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]

    def batch(*columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=t) for c, t in zip(columns, kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = FrequentCounts(FREQUENT / 2)
        low, high, n_bytes = (1 << 63) - 1, -(1 << 63), 0
        for data, rows, part in _chunks(batches):
            ids = part.column("_id").to_numpy()
            low, high, n_bytes = min(low, int(ids.min())), max(high, int(ids.max())), n_bytes + len(data)
            line_row, line_no, line, tokens = _token_sets(data, rows)
            counts.add(tokens, len(line_row))
            sig, size = _signatures(len(line_row), line, tokens)
            some = size > 0
            bitmap = _bitmaps(len(line_row), line, tokens)[some].view(np.int64)
            at = pa.array(line_row[some])
            yield batch(
                np.zeros(len(at), np.int32), part.column("_id").take(at), part.column("_h").take(at), line_no[some], sig[some].view(np.int64), size[some],
                bitmap[:, 0], bitmap[:, 1])
        often = counts.n >= max(1.0, FREQUENT / 2 * counts.lines)
        none = np.zeros(int(often.sum()) + 1, dtype=np.int64)
        yield batch(
            np.append(np.ones(len(none) - 1), 2), np.append(none[1:], low), np.append(none[1:], high), none, np.append(counts.token[often].view(np.int64), 0),
            np.append(counts.n[often], counts.lines), np.append(none[1:], n_bytes), none)

    return docs.select("_id", "_h", "text").mapInArrow(run, "_kind int, _id long, _h long, _line int, _sig long, _n int, _b0 long, _b1 long")


def frequent_tokens(read: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of tokens that many lines have, and how rare each is (0 rarest; others are rarer).

    Sums over all tasks are within FREQUENT of all lines of the truth. At most 2 / FREQUENT times
    the tokens of a mean line reach the driver, however many documents there are.
    """
    total = read.where("_kind = 2").agg(F.sum("_n")).first()[0] or 0
    sums = read.where("_kind = 1").groupBy("_sig").agg(F.sum("_n").alias("n"))
    rows = sums.where(F.col("n") >= F.lit(FREQUENT / 2 * total)).toArrow()
    token, n = rows["_sig"].to_numpy().view(np.uint64), rows["n"].to_numpy()
    order = np.argsort(token)
    return token[order], np.minimum(16 * np.log2(1 + n[order]), 511).astype(np.uint64)


def pair_prefix(n: np.ndarray, threshold: Fraction) -> np.ndarray:
    """How many of its rarest tokens a set of n tokens shows as neighbouring pairs.

    Take two sets of sizes n and m with Jaccard t or more, in one order, and walk from the rarest
    token until two common tokens stand side by side in both. With a tokens of the first alone and b
    of the second passed, a + b + 2 common ones are enough, so 2a + b + 2 of the first are read. With
    overlap t / (1 + t) of n + m at least this is most for the smallest m, t * n:
    2n + m - 3 t / (1 + t) (n + m) + 2 = n (2 - 2t) + 2.
    """
    t = threshold
    slope = 2 + t - 3 * t
    return np.minimum((n * slope.numerator) // slope.denominator + 2, n)


def _places(often: np.ndarray, edge: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Where tokens are in `often`, if they are; `edge` is where each value of their highest 18 bits begins."""
    last = len(often) - 1
    at = np.minimum(edge[tokens >> np.uint64(46)], last)
    left = np.flatnonzero((often[at] < tokens) & (at < last))
    while len(left):
        at[left] += 1
        now = at[left]
        left = left[(often[now] < tokens[left]) & (now < last)]
    return at


def _keys(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray], threshold: Fraction, n_parts: int, low: int, span: int) -> DataFrame:
    """Blobs of (key, signature, size, position, order) by partition, lines of a chunk collapsed first.

    A key is the hash of two neighbouring tokens, rarest first, of the pair prefix. Sets of one to
    three tokens match only equal sets and show no keys; nothing is lost by it when t > 3/4.
    """
    shared = docs.sparkSession.sparkContext.broadcast(frequent)
    least = 4 if threshold > Fraction(3, 4) else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, count = shared.value
        edge = np.searchsorted(often, np.arange(1 << 18, dtype=np.uint64) << np.uint64(46))
        for data, rows, part in _chunks(batches, 1 << 22):  # fewer lines than 2^22
            line_row, _, line, tokens = _token_sets(data, rows)
            sig, size = _signatures(len(line_row), line, tokens)
            order = ((part.column("_id").to_numpy().astype(float) - low) / span * (2**16 - 1)).clip(0, 2**16 - 1).astype(np.uint16)[line_row]
            by = np.lexsort((order, sig))
            first = np.ones(len(by), dtype=bool)
            first[1:] = sig[by][1:] != sig[by][:-1]
            chosen = np.zeros(len(sig), dtype=bool)
            chosen[by[first]] = True
            chosen &= size >= least
            keep = chosen[line]
            line, tokens = line[keep], tokens[keep]
            rank = np.zeros(len(tokens), dtype=np.uint64)
            if len(often):
                at = _places(often, edge, tokens)
                rank = np.where(often[at] == tokens, count[at] + np.uint64(1), np.uint64(0))
            # Lines in order, in each the rarest first, equal ranks by hash: 22, 10 and 32 bits.
            by = np.argsort(line.astype(np.uint64) << np.uint64(42) | rank << np.uint64(32) | tokens >> np.uint64(32))
            line, tokens = line[by], tokens[by]
            many = np.bincount(line, minlength=len(sig))
            place = np.arange(len(line)) - (np.cumsum(many) - many)[line]
            with np.errstate(over="ignore"):
                pair = mixed(tokens[:-1] * np.uint64(0x9E3779B97F4A7C15) + tokens[1:]) if len(tokens) else tokens
            show = (line[:-1] == line[1:]) & (place[1:] < pair_prefix(size[line[:-1]], threshold)) if len(tokens) else np.zeros(0, bool)
            at = np.flatnonzero(show)
            pair, line, place = pair[at], line[at], place[at]
            part_no = (pair >> np.uint64(32)) % np.uint64(n_parts)
            by = np.argsort(part_no << np.uint64(32) | pair & np.uint64(0xFFFFFFFF))
            pair, line, place, part_no = pair[by], line[by], place[by], part_no[by]
            entry = np.zeros(len(by), dtype=ENTRY)
            entry["key"], entry["sig"], entry["order"] = pair & np.uint64(0xFFFFFFFF), sig[line], order[line]
            entry["n"], entry["i"] = np.minimum(size[line], 65535), np.minimum(place, 255)
            some, cuts = np.unique(part_no, return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), _blobs(entry, np.append(cuts, len(entry)))], names=["part", "blob"])

    return docs.select("_id", "text").mapInArrow(run, "part int, blob binary")


#: one key of one line; sizes beyond 65534 are written as 65535 and pass every filter, positions
#: beyond 255 as 255; order is the document's rough place among all
ENTRY = np.dtype([("key", "<u4"), ("sig", "<u8"), ("order", "<u2"), ("n", "<u2"), ("i", "u1")])
_SHARED = "kind int, key long, sig long, other long, n int, i int, m int, j int"


def _blobs(entry: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Entries between cuts, by key, as binary values: keys as differences, first bytes of all, second bytes of all and so on.

    Bytes that say little stand together so and cost little, however few entries of a line are in one part.
    """
    entry = entry.copy()
    step = np.diff(entry["key"], prepend=np.uint32(0))
    step[cuts[:-1]] = entry["key"][cuts[:-1]]
    entry["key"] = step
    n, width = np.repeat(np.diff(cuts), np.diff(cuts)), ENTRY.itemsize
    start = np.repeat(cuts[:-1], np.diff(cuts))
    at, flat, out = start * (width - 1) + np.arange(len(entry)), entry.view(np.uint8).reshape(-1, width), np.empty(len(entry) * width, np.uint8)
    for k in range(width):
        out[at + k * n] = flat[:, k]
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * width).astype(np.int32)), pa.py_buffer(out)])


def _entries(blob: pa.Buffer) -> np.ndarray:
    """What `_blobs` made a value of."""
    flat = np.frombuffer(blob, dtype=np.uint8).reshape(ENTRY.itemsize, -1)
    entry = flat.T.copy("C").view(ENTRY)[:, 0]
    entry["key"] = np.cumsum(entry["key"], dtype=np.uint32)
    return entry


def filtered(n: np.ndarray, i: np.ndarray, m: np.ndarray, j: np.ndarray, t: Fraction) -> np.ndarray:
    """Length and positional filter for sets of n and m tokens whose i-th and j-th are a common pair.

    Of the tokens before the pair no more than the smaller place are common, of those from it on no
    more than the fewer that are left.
    """
    n, m = n.astype(np.int64), m.astype(np.int64)
    known = (n < 65535) & (m < 65535)
    length = np.minimum(n, m) * t.denominator >= np.maximum(n, m) * t.numerator
    most = np.minimum(n - i, m - j) + np.minimum(i, j)
    known &= (i < 255) & (j < 255)
    enough = most * (t.denominator + t.numerator) >= t.numerator * (n + m)
    return length & (~known | enough) | (n == 65535) | (m == 65535)


def _meet(blobs: DataFrame, t: Fraction, n_parts: int) -> DataFrame:
    """Candidates: kind 0 rows are pairs (sig, other); kind 1 rows list the members of larger groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_part: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for p, blob in zip(batch.column("part").to_pylist(), batch.column("blob")):
                by_part.setdefault(p, []).append(_entries(blob.as_buffer()))
        for p in sorted(by_part):
            e = np.concatenate(by_part.pop(p))
            by = np.argsort(e["key"])
            again = np.append(False, np.diff(e["key"][by]) == 0)
            e = e[by[again | np.append(again[1:], False)]]  # keys shown once, most of them, are done
            e = e[np.lexsort((e["order"], e["sig"], e["key"]))]
            first = np.ones(len(e), dtype=bool)  # a line whose chunks all sent it: the earliest counts
            first[1:] = (e["key"][1:] != e["key"][:-1]) | (e["sig"][1:] != e["sig"][:-1])
            e = e[first]
            e = e[np.lexsort((e["sig"], e["order"], e["key"]))]
            start = np.flatnonzero(np.append(len(e) > 0, e["key"][1:] != e["key"][:-1]))
            size = np.diff(np.append(start, len(e)))
            for pick, steps in (((size >= 2) & (size <= SMALL), range(1, SMALL)), (size > SMALL, None)):
                at, g = start[pick], size[pick]
                if steps is None:
                    later = ranges(at + 1, g - 1)
                    yield from _pairs(e, np.repeat(at, g - 1), later, t)
                    member = ranges(at, g)
                    pivot = np.repeat(at, g)
                    yield _rows(1, e["key"][member].astype(np.int64) | np.int64(p) << np.int64(32), e, member, pivot)
                else:
                    for gap in steps:
                        many = np.maximum(g - gap, 0)
                        a = ranges(at, many)
                        yield from _pairs(e, a, a + gap, t)

    return blobs.repartition(n_parts, "part").mapInArrow(run, _SHARED)


def _pairs(e: np.ndarray, a: np.ndarray, b: np.ndarray, t: Fraction) -> Iterator[pa.RecordBatch]:
    fine = filtered(e["n"][a], e["i"][a].astype(np.int64), e["n"][b], e["i"][b].astype(np.int64), t)
    a, b = a[fine], b[fine]
    yield _rows(0, np.zeros(len(a), np.int64), e, b, a)


def _rows(kind: int, key: np.ndarray, e: np.ndarray, own: np.ndarray, other: np.ndarray) -> pa.RecordBatch:
    int32 = lambda name, at: pa.array(e[name][at].astype(np.int32))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(own), kind, np.int32)), pa.array(key), pa.array(e["sig"][own].view(np.int64)), pa.array(e["sig"][other].view(np.int64)),
         int32("n", own), int32("i", own), int32("n", other), int32("i", other)],
        names=["kind", "key", "sig", "other", "n", "i", "m", "j"])


@F.arrow_udf(T.ArrayType(T.StructType().add("sig", "long").add("tokens", T.ArrayType(T.LongType()))))
def _tokens_of(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for text, wanted in columns:
        data, rows = text_bytes(text)
        asked, edge = wanted.flatten().to_numpy(), wanted.offsets.to_numpy() - wanted.offsets.to_numpy()[0]
        sigs, sizes, values = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, j in batches_of(rows):
            line_row, _, line, tokens = _token_sets(data[rows[i] : rows[j]], rows[i : j + 1] - rows[i])
            sig, size = _signatures(len(line_row), line, tokens)
            first = np.searchsorted(line_row, np.arange(j - i))
            pick = np.repeat(first, np.diff(edge[i : j + 1])) + asked[edge[i] : edge[j]]
            start = np.concatenate(([0], np.cumsum(size)))
            sigs.append(sig[pick].view(np.int64))
            sizes.append(size[pick])
            values.append(tokens[ranges(start[pick], size[pick])].view(np.int64))
        found = pa.StructArray.from_arrays(
            [pa.array(np.concatenate(sigs)), lists(np.concatenate(values), np.concatenate(sizes), pa.int64())], names=["sig", "tokens"])
        yield pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), found)


def _verified(pairs: DataFrame, sets: DataFrame, t: Fraction) -> DataFrame:
    """Pairs (later, earlier) of signatures with the Jaccard similarity of their sets at least t."""
    own = sets.select(F.col("_sig").alias("later"), F.col("_tokens").alias("_a"))
    other = sets.select(F.col("_sig").alias("earlier"), F.col("_tokens").alias("_b"))
    both = F.size(F.array_intersect("_a", "_b")).cast("long")
    return (
        pairs.join(own, "later").join(other, "earlier")
        .where(both * (t.denominator + t.numerator) >= t.numerator * (F.size("_a") + F.size("_b")).cast("long"))
        .select("later", "earlier")
    )


class _Groups:
    """Members of large groups, compared with every earlier member of theirs.

    A line goes for one such member however many there are, so members are semi-joined and no pair of
    a group becomes a row: lines whom no earlier member fits by lengths, positions and bitmaps are
    let go first, then members that fit none of the others. Only what is left has its set made.
    """

    def __init__(self, members: DataFrame, firsts: DataFrame, t: Fraction):
        self.tn, self.td = F.lit(t.numerator), F.lit(t.denominator)
        known = firsts.select(F.col("_sig").alias("sig"), F.col("_first").alias("first"), F.col("_n").alias("size"), F.col("_b0").alias("b0"), F.col("_b1").alias("b1"))
        placed = written(members.join(known.hint("shuffle_hash"), "sig"))
        release(members.sparkSession)
        every = self._side(placed, "y")
        self.some = written(self._fitting(self._side(placed, "x"), every))
        self.fits = written(self._fitting(every, self.some))

    @staticmethod
    def _side(frame: DataFrame, which: str) -> DataFrame:
        return frame.select("key", *[F.col(c).alias(f"{c}_{which}") for c in frame.columns if c != "key"])

    def _fitting(self, left: DataFrame, right: DataFrame, also: Column | None = None) -> DataFrame:
        """Rows of `left` for which a row of `right`, one of them later (x) and one earlier (y), may be similar enough."""
        n, m, i, j, size, other = (F.col(c).cast("long") for c in ("n_x", "n_y", "i_x", "i_y", "size_x", "size_y"))
        lengths = F.least(n, m) * self.td >= F.greatest(n, m) * self.tn
        places = (F.greatest("i_x", "i_y") >= 255) | ((F.least(n - i, m - j) + F.least(i, j)) * (self.tn + self.td) >= self.tn * (n + m))
        apart = sum(F.bit_count(F.col(f"{c}_x").bitwiseXOR(F.col(f"{c}_y"))) for c in ("b0", "b1")).cast("long")
        fair = (F.col("first_y") < F.col("first_x")) & ((F.greatest("n_x", "n_y") >= 65535) | (lengths & places)) & (
            apart * (self.tn + self.td) <= (self.td - self.tn) * (size + other))
        return left.join(right, (left["key"] == right["key"]) & (fair if also is None else fair & also), "left_semi")

    def sigs(self) -> DataFrame:
        """Signatures whose sets `gone` may ask for; a line may be in several groups."""
        return self.some.select(F.col("sig_x").alias("sig")).unionByName(self.fits.select(F.col("sig_y").alias("sig")))

    def gone(self, gone: DataFrame, sets: DataFrame) -> DataFrame:
        """Signatures, not gone yet, whose set has Jaccard similarity t or more with an earlier member's of a group."""
        some = written(self.some.join(gone.select(F.col("_sig").alias("sig_x")), "sig_x", "left_anti"))
        fits = self._fitting(self.fits, some)
        later = written(some.join(sets.select(F.col("_sig").alias("sig_x"), F.col("_tokens").alias("tokens_x")), "sig_x"))
        earlier = written(fits.join(sets.select(F.col("_sig").alias("sig_y"), F.col("_tokens").alias("tokens_y")), "sig_y"))
        release(gone.sparkSession)
        both = F.size(F.array_intersect("tokens_x", "tokens_y")).cast("long")
        alike = both * (self.tn + self.td) >= self.tn * (F.size("tokens_x") + F.size("tokens_y")).cast("long")
        return self._fitting(later, earlier, alike).select(F.col("sig_x").alias("_sig"))


def removed_lines(docs: DataFrame, threshold: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Lines to remove: `_id`, `_h` (as `doc_keys` gives them) and `_line`, numbered from 0; repeated rows repeat theirs.

    Lines end at line feeds; tokens are their distinct words between ASCII white space. A line goes if
    an earlier line of the corpus, by (doc_id, text hash, line number), has Jaccard similarity
    `threshold` or more, whether or not that line goes too. Lines without tokens stay. Tokens,
    signatures and keys are 64-bit hashes, the last only to find candidates.

    Equal sets are found by signature. Of different ones each shows neighbouring pairs of its rarest
    tokens; lines that share one meet, all pairs in groups up to SMALL, else first with the earliest
    line of the group. Lines of larger groups that no pair removes are then compared with every
    earlier member. Every candidate passes the length and positional filters and is verified.
    """
    t = Fraction(threshold).limit_denominator(1000)
    spark = docs.sparkSession
    slim = docs.select(*[c.alias(n) for n, c in doc_keys(docs, key, text).items()], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    read = written(_read(slim))
    low, high, size = read.where("_kind = 2").agg(F.min("_id"), F.max("_h"), F.sum("_b0")).first()
    lines = read.where("_kind = 0").drop("_kind")
    place = F.struct("_id", "_h", "_line")
    firsts = bucketed(lines.groupBy("_sig").agg(F.min(place).alias("_first"), F.max("_n").alias("_n"), F.max("_b0").alias("_b0"), F.max("_b1").alias("_b1")), "_sig")
    if size is None or low > high:
        return lines.select("_id", "_h", "_line").where("false")
    release(spark)
    n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(size) // TEXT_PER_PARTITION))
    met = written(_meet(_keys(slim, frequent_tokens(read), t, n_parts, int(low), max(1, int(high) - int(low))), t, n_parts))

    def ordered(pairs: DataFrame) -> DataFrame:
        """Distinct pairs with the later line first, but for those whose bitmaps differ in too many places."""
        a = firsts.select(F.col("_sig").alias("sig"), F.col("_first").alias("_p"), *[F.col(c).alias(f"{c}_p") for c in ("_n", "_b0", "_b1")])
        b = firsts.select(F.col("_sig").alias("other"), F.col("_first").alias("_q"), *[F.col(c).alias(f"{c}_q") for c in ("_n", "_b0", "_b1")])
        apart = sum(F.bit_count(F.col(f"{c}_p").bitwiseXOR(F.col(f"{c}_q"))) for c in ("_b0", "_b1"))
        fair = apart.cast("long") * (t.denominator + t.numerator) <= (t.denominator - t.numerator) * (F.col("_n_p") + F.col("_n_q")).cast("long")
        placed = pairs.distinct().join(a.hint("shuffle_hash"), "sig").join(b.hint("shuffle_hash"), "other").where(fair)
        swap = F.col("_p") < F.col("_q")
        return placed.select(F.when(swap, F.col("other")).otherwise(F.col("sig")).alias("later"), F.when(swap, F.col("sig")).otherwise(F.col("other")).alias("earlier"))

    release(spark)
    first_pairs = written(ordered(met.where("kind = 0").select("sig", "other")))
    release(spark)
    groups = _Groups(met.where("kind = 1").select("key", "sig", "n", "i"), firsts, t)
    release(spark)
    named = first_pairs.select(F.col("later").alias("sig")).unionByName(first_pairs.select(F.col("earlier").alias("sig"))).unionByName(
        groups.sigs()).distinct()
    homes = firsts.join(named.withColumnRenamed("sig", "_sig").hint("shuffle_hash"), "_sig", "left_semi").select("_first.*")
    wanted = written(homes.groupBy("_id", "_h").agg(F.collect_list("_line").alias("_wanted")))
    texts = likely(slim, wanted, "_id", "_h").join(wanted.hint("shuffle_hash"), ["_id", "_h"])
    # Repeated rows give their lines again; texts would have to be sorted to find them earlier.
    sets = texts.select(F.explode(_tokens_of("text", "_wanted")).alias("_t")).select(F.col("_t.sig").alias("_sig"), F.col("_t.tokens").alias("_tokens"))
    sets = bucketed(sets.dropDuplicates(["_sig"]), "_sig")
    release(spark)
    gone = written(_verified(first_pairs, sets, t).select(F.col("later").alias("_sig")).distinct())

    release(spark)
    gone_too = groups.gone(gone, sets)
    removed = written(gone.unionByName(gone_too).distinct())
    release(spark)
    # By places, of which there is one a line: by signature, a line that many documents have would be one task's.
    stay = firsts.join(removed.hint("shuffle_hash"), "_sig", "left_anti").select("_first.*")
    return lines.select("_id", "_h", "_line").join(stay.hint("shuffle_hash"), ["_id", "_h", "_line"], "left_anti")


@F.arrow_udf(T.StringType())
def _kept(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for text, gone in columns:
        out = []
        for line, numbers in zip(text.to_pylist(), gone.to_pylist()):
            if numbers:
                drop = set(numbers)
                line = "\n".join([x for k, x in enumerate(line.split("\n")) if k not in drop])
            out.append(line)
        yield pa.array(out, type=pa.string())


def deduped(docs: DataFrame, threshold: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with `removed_lines` taken out of `text` and, if there is a column n_chars, its new length.

    Every row stays: a document whose lines all go keeps an empty text. Null texts stay null.
    """
    gone = removed_lines(docs, threshold, key, text).groupBy("_id", "_h").agg(F.collect_set("_line").alias("_gone"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    both = docs.select(row.alias("_row"), *[c.alias(n) for n, c in doc_keys(docs, key, text).items()]).join(gone, ["_id", "_h"], "left")
    new = F.when(F.col("_gone").isNull(), F.col(f"_row.`{text}`")).otherwise(_kept(F.col(f"_row.`{text}`"), F.coalesce("_gone", F.array().cast("array<int>"))))
    out = both.withColumn("_new", new)
    return out.select(*[
        F.col("_new").alias(c) if c == text
        else F.when(F.col("_gone").isNull(), F.col("_row.n_chars")).otherwise(F.length("_new").cast(docs.schema[c].dataType)).alias(c) if c == "n_chars"
        else F.col(f"_row.`{c}`")
        for c in docs.columns
    ])


def line_report(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Per document row: doc_id, n_lines (line feeds and one more), n_removed, removed_lines in order."""
    gone = removed_lines(docs, threshold).groupBy("_id", "_h").agg(F.sort_array(F.collect_set("_line")).alias("removed_lines"))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"), *[c.alias(n) for n, c in doc_keys(docs).items()])
    out = rows.join(gone, ["_id", "_h"], "left")
    removed = F.coalesce("removed_lines", F.array().cast("array<int>"))
    return out.select("doc_id", "n_lines", F.size(removed).cast("long").alias("n_removed"), removed.alias("removed_lines"))
