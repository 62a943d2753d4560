"""Alignment of two tokenizers' ids: texts cut into windows at shared ends, window alignments remembered by their ids."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticewing.llm.bpe import _FAR, ByteBpe
from noticewing.llm.common import batches_of, free_name, lists, mixed, ranges, text_groups, without, written

#: tokens of the windows a worker remembers at most
REMEMBERED = 500_000
#: id pairs that are broadcast at once (13 bytes each); more are gone through in several passes
PAIRS = 2_000_000
#: links scored or counted at once
LINKS = 1 << 20
#: distinct pairs a task counts before it reports them
COUNTED = 500_000


class Tokens:
    """Ids of one tokenizer with the bytes each id stands for."""

    def __init__(self, token: list[bytes]):
        self.bytes = np.frombuffer(b"".join(token), dtype=np.uint8)
        self.length = np.array([len(t) for t in token], dtype=np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.spaced = np.array([t[:1] == b" " for t in token])

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.bytes[ranges(self.start[ids], self.length[ids])]


class ByteLevel(Tokens):
    """A byte-level BPE file; special tokens' strings are plain text.

    Ids in merge order let tiktoken encode with the file's tokens as ranks. Letters whose class depends
    on the Unicode version are divided by the tokenizers library.
    """

    def __init__(self, text: str):
        import tiktoken

        bpe = ByteBpe(text)
        super().__init__([bpe.token.get(i, b"") for i in range(max(bpe.token) + 1)])
        self.text, self.library, self.fast = text, None, None
        if (np.diff(bpe.made) > 0).all():
            special = set(bpe.added.values())
            plain = {t: i for i, t in bpe.token.items() if i not in special}
            pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
            self.fast = tiktoken.Encoding("byte_level", pat_str=pattern, mergeable_ranks=plain, special_tokens={})

    def _slow(self, text: str) -> list[int]:
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.text)
            self.library.encode_special_tokens = True
        return self.library.encode(" " + text, add_special_tokens=False).ids

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [
            np.array(self._slow(t), dtype=np.int32) if self.fast is None or _FAR.search(t)
            else self.fast.encode_to_numpy(" " + t, disallowed_special=()).astype(np.int32)
            for t in texts
        ]


class Pieces(Tokens):
    """A sentencepiece model; it adds the space before the text itself."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = self.model.get_piece_size()
        names = [self.model.id_to_piece(i) for i in range(n)]
        super().__init__([bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, dtype=np.int32) for ids in self.model.encode(texts, num_threads=1)]


class Written:
    """Decimal numbers with a sign after each, as bytes."""

    def __init__(self, most: int):
        names = [str(i).encode() for i in range(most)]
        self.length = np.array([len(n) for n in names], dtype=np.int64)
        self.digits = np.frombuffer(b"".join(n.ljust(8) for n in names), dtype=np.uint8).reshape(most, 8)

    def text(self, numbers: np.ndarray, signs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All numbers with their signs end to end, and how many bytes each takes."""
        size = self.length[numbers]
        cells = self.digits[numbers]
        cells[np.arange(len(numbers)), size] = signs
        return cells[np.arange(8) <= size[:, None]], size + 1


def overlaps(size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Two cuts of the same bytes into pieces of these sizes: linked pieces of a and b, and the group of every a and b.

    Pieces are linked if they share bytes; groups end where pieces of both end.
    """
    end_a, end_b = np.cumsum(size_a), np.cumsum(size_b)
    start_a, start_b = end_a - size_a, end_b - size_b
    low, high = np.searchsorted(end_b, start_a, side="right"), np.searchsorted(start_b, end_a, side="left")
    shared_a = end_b[np.minimum(np.searchsorted(end_b, end_a), max(len(end_b) - 1, 0))] == end_a if len(end_b) else np.zeros(0, bool)
    group_a = np.cumsum(shared_a) - shared_a
    shared = end_a[shared_a]
    group_b = np.searchsorted(shared, end_b)
    return np.repeat(np.arange(len(end_a)), high - low), ranges(low, high - low), group_a, group_b


def run_hashes(ids: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """64-bit hash of the ids between every two cuts."""
    with np.errstate(over="ignore"):
        up, down = (np.cumprod(np.full(len(ids) + 1, np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64)))) for k in (1, -1))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(ids.astype(np.uint64) + np.uint64(1)) * up[:-1])))
        return mixed((total[cut[1:]] - total[cut[:-1]]) * down[cut[:-1]] + np.diff(cut).astype(np.uint64))


class Pool:
    """Arrays end to end that grow, with the place of each part."""

    def __init__(self, kind: type):
        self.values, self.start, self.size = np.zeros(0, kind), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, values: np.ndarray, size: np.ndarray) -> None:
        self.start = np.concatenate((self.start, len(self.values) + np.cumsum(size) - size))
        self.size = np.concatenate((self.size, size))
        self.values = np.concatenate((self.values, values))

    def of(self, parts: np.ndarray) -> np.ndarray:
        return self.values[ranges(self.start[parts], self.size[parts])]


class Aligner:
    """Aligns batches of texts, remembering a bounded number of windows."""

    def __init__(self, a: Tokens, b: Tokens):
        self.a, self.b = a, b
        self.n_b = len(b.length)
        self.written = Written(max(len(a.length), self.n_b))
        self._forget()

    def _forget(self) -> None:
        self.known: dict[tuple[bytes, bytes], int] = {}
        self.groups, self.pairs = Pool(np.uint8), Pool(np.int64)
        self.n_groups = np.zeros(0, dtype=np.int64)
        self.weight = 0

    def _learn(self, x: np.ndarray, n_x: np.ndarray, y: np.ndarray, n_y: np.ndarray) -> None:
        """Align windows with these ids, `n_x` and `n_y` of them in each, all at once."""
        link_x, link_y, group_x, group_y = overlaps(self.a.length[x], self.b.length[y])
        ends_x, ends_y = np.append(group_x[1:] != group_x[:-1], True), np.append(group_y[1:] != group_y[:-1], True)
        # A group's ids are written a first: each id goes behind the ids of the other side that come before it.
        at_x = np.arange(len(x)) + np.searchsorted(group_y, group_x, side="left")
        at_y = np.arange(len(y)) + np.searchsorted(group_x, group_y, side="right")
        number, sign = np.empty(len(x) + len(y), dtype=np.int64), np.empty(len(x) + len(y), dtype=np.uint8)
        number[at_x], number[at_y] = x, y
        sign[at_x], sign[at_y] = np.where(ends_x, ord("|"), ord(",")), np.where(ends_y, ord(";"), ord(","))
        text, size = self.written.text(number, sign)
        both = np.cumsum(n_x + n_y) - (n_x + n_y)
        self.groups.add(text, np.add.reduceat(size, both))
        first_x = np.cumsum(n_x) - n_x
        self.n_groups = np.concatenate((self.n_groups, np.add.reduceat(ends_x.astype(np.int64), first_x)))
        window = np.repeat(np.arange(len(n_x)), n_x)
        self.pairs.add(x[link_x].astype(np.int64) * self.n_b + y[link_y], np.bincount(window[link_x], minlength=len(n_x)))
        self.weight += len(x) + len(y)

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts by both, and how many each text has; none where the bytes are not space+text."""
        ids = [self.a.encode(texts), self.b.encode(texts)]
        raw = [b" " + t.encode() if t else b"" for t in texts]
        size = np.array([len(r) for r in raw], dtype=np.int64)
        good = size > 0
        for one, side in zip(ids, (self.a, self.b)):
            good &= np.array([int(side.length[i].sum()) for i in one], dtype=np.int64) == size
        want = np.frombuffer(b"".join([r for r, g in zip(raw, good) if g]), dtype=np.uint8)
        wrong = np.zeros(len(want) + 1, dtype=np.int64)
        for one, side in zip(ids, (self.a, self.b)):
            if len(want):
                wrong[1:] |= side.joined(np.concatenate([i for i, g in zip(one, good) if g])) != want
        wrong = np.cumsum(wrong)
        end = np.cumsum(np.where(good, size, 0))
        good &= wrong[end] == wrong[end - np.where(good, size, 0)]
        out = []
        for one in ids:
            picked = [i for i, g in zip(one, good) if g]
            out += [np.concatenate(picked) if picked else np.zeros(0, np.int32), np.array([len(i) if g else 0 for i, g in zip(one, good)], dtype=np.int64)]
        return tuple(out)

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes], np.ndarray, np.ndarray]:
        """Per text: numbers of a ids, b ids and groups, the groups as text, and the number of links; then all links."""
        if self.weight > REMEMBERED:
            self._forget()
        x, n_x, y, n_y = self._ids(texts)
        # All texts end to end: both cuts have the same bytes there.
        start_x, start_y = np.cumsum(self.a.length[x]) - self.a.length[x], np.cumsum(self.b.length[y]) - self.b.length[y]
        first_x = np.concatenate(([0], np.cumsum(n_x)))
        # Every text begins with a space, so it begins a window.
        at_x, at_y = np.flatnonzero(self.a.spaced[x]), np.flatnonzero(self.b.spaced[y])
        _, pick_x, pick_y = np.intersect1d(start_x[at_x], start_y[at_y], assume_unique=True, return_indices=True)
        cut_x, cut_y = np.append(at_x[pick_x], len(x)), np.append(at_y[pick_y], len(y))
        # Windows of this batch with the same ids are looked up once.
        _, one, which = np.unique(run_hashes(x, cut_x) ^ mixed(run_hashes(y, cut_y)), return_index=True, return_inverse=True)
        raw_x, raw_y = x.tobytes(), y.tobytes()
        p, q = 4 * cut_x, 4 * cut_y
        known, fresh, places = self.known, [], []
        for k, a, b, c, d in zip(one.tolist(), p[one].tolist(), p[one + 1].tolist(), q[one].tolist(), q[one + 1].tolist()):
            key = raw_x[a:b], raw_y[c:d]
            at = known.get(key)
            if at is None:
                at = known[key] = len(known)
                fresh.append(k)
            places.append(at)
        if fresh:
            new = np.array(fresh)
            size_x, size_y = np.diff(cut_x)[new], np.diff(cut_y)[new]
            self._learn(x[ranges(cut_x[new], size_x)], size_x, y[ranges(cut_y[new], size_y)], size_y)
        window = np.array(places, dtype=np.int64)[which]
        edge = np.searchsorted(cut_x[:-1], first_x)

        def per_text(values: np.ndarray) -> np.ndarray:
            upto = np.concatenate(([0], np.cumsum(values)))[edge]
            return np.diff(upto)

        text, size = self.groups.of(window).tobytes(), per_text(self.groups.size[window])
        end = np.cumsum(size).tolist()
        groups = [text[e - n : e - 1] if n else b"" for e, n in zip(end, size.tolist())]  # without the last sign
        return n_x, n_y, per_text(self.n_groups[window]), groups, per_text(self.pairs.size[window]), self.pairs.of(window)


@lru_cache(maxsize=2)
def aligner(a_text: str, b_model: bytes) -> Aligner:
    """One aligner for a worker process, whatever the number of its tasks."""
    return Aligner(ByteLevel(a_text), Pieces(b_model))


_NEW = ["n_a", "n_b", "n_groups", "groups", "links"]


def _added(docs: DataFrame, byte_level_file: str, pieces_file: str, text: str, digest: bool) -> DataFrame:
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((Path(byte_level_file).read_text(encoding="utf-8"), Path(pieces_file).read_bytes()))
    size_a = len(json.loads(shared.value[0])["model"]["vocab"])
    wide = size_a * len(Pieces(shared.value[1]).length) >= 1 << 31
    kind = pa.int64() if wide else pa.int32()

    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        align = aligner(*shared.value).texts
        for column in parts:
            # A group of texts at a time: what comes out is longer than the texts.
            for texts in text_groups(column):
                n_a, n_b, n_groups, groups, size, pairs = align(texts)
                if digest:
                    groups = [hashlib.sha256(g).hexdigest() if n else "" for g, n in zip(groups, n_a)]
                names = pa.array(groups, type=pa.string() if digest else pa.binary()).cast(pa.string())
                yield pa.StructArray.from_arrays([pa.array(n_a), pa.array(n_b), pa.array(n_groups), names, lists(pairs, size, kind)], names=_NEW)

    kept = without(docs, *_NEW)
    new = free_name(kept, "_t")
    fields = f"struct<n_a:bigint,n_b:bigint,n_groups:bigint,groups:string,links:array<{'bigint' if wide else 'int'}>>"
    added = kept.withColumn(new, F.arrow_udf(run, fields)(F.col(f"`{text}`")))
    return added.select(*[F.col(f"`{c}`") for c in kept.columns], f"{new}.*")


def aligned(docs: DataFrame, byte_level_file: str, pieces_file: str, text: str = "text") -> DataFrame:
    """`docs` with the alignment of each whole text under two tokenizers: n_a, n_b, n_groups, groups, links.

    a are the ids of space+text by a byte-level BPE file, b those of the text by a sentencepiece model,
    which adds that space. Byte offsets where tokens of both end cut a text into groups; `groups` lists
    them as `a1,a2|b1;a3|b2,b3`. `links` has a * (size of b) + b for every two tokens that share bytes.
    Null and empty texts, and those whose joined token bytes are not space+text (the model replaced
    something), have no tokens: zeros, '' and no links. Columns with these names are replaced.

    Tokens that begin with a space at the same byte in both cuts divide a text into windows; equal
    windows (the same ids) are aligned once per worker as long as it remembers them.
    """
    return _added(docs, byte_level_file, pieces_file, text, digest=False)


def pair_counts(links: DataFrame, size_b: int) -> DataFrame:
    """(`pair`, `n`, `best`): how many links have each id pair, and whether no pair with the same b id has more.

    Tasks count their links first and report distinct pairs.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            values = batch.column(0).flatten().to_numpy()
            for at in range(0, len(values), LINKS):
                one, n = np.unique(values[at : at + LINKS], return_counts=True)
                keys, where = np.unique(np.concatenate((keys, one)), return_inverse=True)
                sums = np.bincount(where, weights=np.concatenate((sums, n)), minlength=len(keys)).astype(np.int64)
                if len(keys) > COUNTED:
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sums)], names=["pair", "n"])
                    keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sums)], names=["pair", "n"])

    total = links.select("links").mapInArrow(counted, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    total = written(total.withColumn("b", F.col("pair") % size_b))
    most = total.groupBy("b").agg(F.max("n").alias("most"))
    # One row for each id of the second tokenizer at most.
    return total.join(F.broadcast(most), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def linked(docs: DataFrame, byte_level_file: str, pieces_file: str, text: str = "text", pairs_at_once: int = PAIRS) -> DataFrame:
    """`aligned` with the SHA-256 of groups as `groups_sha256` ('' without tokens), without `links`; with n_links, n_best and count_sum.

    A pair's count is the number of links in all documents that have it; n_best counts a document's
    links whose count is the highest of their b id, count_sum adds the counts of its links. Counts are
    broadcast `pairs_at_once` at a time; a vocabulary with more pairs is gone through in several
    passes over the links, whose sums are added per document.
    """
    size_b = len(Pieces(Path(pieces_file).read_bytes()).length)
    found = _added(docs, byte_level_file, pieces_file, text, digest=True).withColumnRenamed("groups", "groups_sha256")
    slim = without(found, text, "groups_sha256")
    row = free_name(slim, "_r")
    table = written(found.withColumn(row, F.monotonically_increasing_id()).select(*[F.col(f"`{c}`") for c in slim.columns], "groups_sha256", row))
    counts = written(pair_counts(table, size_b))
    total = counts.count()
    passes = max(1, -(-total // pairs_at_once))
    slices = [counts] if passes == 1 else [counts.where(F.pmod(F.xxhash64("pair"), F.lit(passes)) == k) for k in range(passes)]
    spark = docs.sparkSession

    def scored(part: DataFrame):
        rows = part.toArrow()
        by = np.argsort(rows["pair"].to_numpy())
        shared = spark.sparkContext.broadcast((rows["pair"].to_numpy()[by], rows["n"].to_numpy()[by], rows["best"].to_numpy()[by]))

        def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            pair, n, best = shared.value
            for column in parts:
                edges = column.offsets.to_numpy().astype(np.int64)
                for i, j in batches_of(edges, LINKS):
                    value, edge = column.slice(i, j - i).flatten().to_numpy(), edges[i : j + 1] - edges[i]
                    at = np.minimum(np.searchsorted(pair, value), max(len(pair) - 1, 0))
                    hit = pair[at] == value if len(pair) else np.zeros(len(value), bool)
                    yield pa.StructArray.from_arrays([
                        pa.array(np.diff(np.concatenate(([0], np.cumsum(v)))[edge]))
                        for v in (np.where(hit, best[at], False) if len(pair) else hit, np.where(hit, n[at], 0) if len(pair) else hit)
                    ], names=["n_best", "count_sum"])

        return F.arrow_udf(run, "struct<n_best:bigint,count_sum:bigint>")("links")

    kept = [F.col(f"`{c}`") for c in slim.columns if c != "links"]
    n_links = F.size("links").cast("long").alias("n_links")
    if passes == 1:
        return table.withColumn(row, scored(counts)).select(*kept, n_links, f"{row}.*", "groups_sha256")
    sums = None
    for part in slices:
        one = table.select(row, scored(part).alias("_s")).select(row, "_s.*")
        sums = one if sums is None else sums.unionByName(one)
    sums = sums.groupBy(row).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return table.join(sums, row).select(*kept, n_links, "n_best", "count_sum", "groups_sha256")
