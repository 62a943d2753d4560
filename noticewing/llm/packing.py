"""Packing token sequences by shortest-pack-first over the length histogram."""

from __future__ import annotations

import heapq
import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticewing.llm.common import batches_of, free_name, hash64, lists, ranges, text_bytes, without, written
from noticewing.plans.order import grouped_position

#: words a worker remembers in each of two generations; the older goes when the newer is full
REMEMBERED = 200_000
#: bytes of text encoded together
GROUP = 4 << 20
#: words whose ids are gathered at once
GATHERED = 1 << 18
#: hash buckets a length's pieces are ranked in
RANK_BUCKETS = 1 << 10
_PIECE = ["start", "length", "doc_tokens", "ids"]


#: texts with other signs are left to the library, for normal forms and lower case; with its special tokens too
_FAR = "[^\\x00-\\x{12f}\\x{131}-\\x{24f}]|<\\|"
#: how the tokenizer divides a lower-case text of other signs: letters, single digits, contractions, the rest;
#: the lower case of some letters lies beyond them
_LETTERS, _DIGITS, _WHITE = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u02af\u2c65\u2c66", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r\x20\x85\xa0"
_PARTS = re.compile(f"[{_LETTERS}]+|[{_DIGITS}]|'(?:s|t|re|ve|m|ll|d)|[^{_LETTERS}{_DIGITS}{_WHITE}]+")


class WordIds:
    """Token ids of whole texts by the tokenizers library, as little-endian 32-bit numbers.

    For a tokenizer that lower-cases, drops white space, never merges across letters, digits and other
    signs, and ends words with a suffix in its tokens: the library encodes every part that is not
    known yet, and texts of far scripts or with special tokens whole.
    """

    def __init__(self, text: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.library = Tokenizer.from_str(text)
        self.library.no_truncation()
        self.library.no_padding()
        spec = json.loads(text)
        suffix = spec["model"].get("end_of_word_suffix")
        if not suffix or "Lowercase" not in json.dumps(spec["normalizer"]):
            raise ValueError("a lower-casing vocabulary with word ends is needed")
        self.last = np.zeros(1 + max(spec["model"]["vocab"].values()), dtype=bool)
        self.last[[i for t, i in spec["model"]["vocab"].items() if t.endswith(suffix)]] = True
        self.known: dict[str, bytes] = {}  # ids of words and parts, in two generations
        self.older: dict[str, bytes] = {}

    def _each(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.library.encode_batch_fast(words, add_special_tokens=False)]

    def _simple(self, words: list[str]) -> list[bytes]:
        """Ids of parts that the tokenizer does not divide, encoded many in a text and told apart by their last tokens."""
        out: list[bytes] = []
        for i in range(0, len(words), 6400):
            texts = [words[k : k + 64] for k in range(i, min(i + 6400, len(words)), 64)]
            for some, e in zip(texts, self.library.encode_batch_fast([" ".join(t) for t in texts], add_special_tokens=False)):
                ids = np.array(e.ids, dtype="<u4")
                ends = np.flatnonzero(self.last[ids]) + 1
                if len(ends) == len(some):
                    raw, at = ids.tobytes(), (ends * 4).tolist()
                    out += [raw[a:b] for a, b in zip([0, *at], at)]
                else:
                    out += self._each(some)
        return out

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words: new ones are divided (letters alone are one part); of their parts the library encodes the new ones."""
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        out = list(map(known.get, words))
        new = []
        for k in [k for k, ids in enumerate(out) if ids is None]:
            ids = older.get(words[k])
            if ids is None:
                new.append(k)
            else:
                out[k] = known[words[k]] = ids
        plain = [words[k] for k in new if words[k].isalpha()]
        mixed = [(k, _PARTS.findall(words[k])) for k in new if not words[k].isalpha()]
        parts = [p for p in set(chain(plain, *[ps for _, ps in mixed])) if p not in known and p not in older]
        known.update(zip(parts, self._simple(parts)))
        for k, ps in mixed:
            known[words[k]] = b"".join([known[p] if p in known else older[p] for p in ps])
        for k in new:
            out[k] = known[words[k]]
        return out

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end and each text's first one (one more at the end); null is empty.

        Every different word is looked up once; what stands between ASCII white space is a word.
        """
        texts = texts.fill_null("")
        far = pc.match_substring_regex(texts, _FAR).to_numpy(zero_copy_only=False)
        words = pc.ascii_split_whitespace(pc.utf8_lower(pc.if_else(pa.array(~far), texts, "")))
        each = words.flatten().dictionary_encode()
        known = self._words(each.dictionary.to_pylist())
        length = np.fromiter(map(len, known), dtype=np.int64, count=len(known)) // 4
        first, at = np.cumsum(length) - length, each.indices.to_numpy()
        length, first, table = length[at], first[at], np.frombuffer(b"".join(known), dtype="<i4")
        some = [slice(k, k + GATHERED) for k in range(0, len(at), GATHERED)]
        ids = np.concatenate([np.zeros(0, "<i4"), *[table[ranges(first[s], length[s])] for s in some]])
        offsets = words.offsets.to_numpy()
        rows = np.concatenate(([0], np.cumsum(length)))[offsets - offsets[0]]
        if far.any():
            parts = np.split(ids, rows[1:-1])
            where = np.flatnonzero(far)
            for k, raw in zip(where.tolist(), self._each(texts.take(pa.array(where)).to_pylist())):
                parts[k] = np.frombuffer(raw, dtype="<i4")
            ids, rows = np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        return ids, rows


@lru_cache(maxsize=2)
def word_ids(text: str) -> WordIds:
    """One encoder for a worker process, whatever the number of its tasks."""
    return WordIds(text)


def pieces(docs: DataFrame, tokenizer_file: str, *, capacity: int, end_id: int, text: str = "text") -> DataFrame:
    """Documents cut into pieces of at most `capacity` tokens, every text followed by `end_id`.

    Each row becomes one row per piece with `start`, `length`, `doc_tokens` and `ids`, the piece's token
    ids; the text is dropped. Null texts count as empty and give one piece, the end id. The tokenizer's
    words must not cross a space or line end.
    """
    model = docs.sparkSession.sparkContext.broadcast(Path(tokenizer_file).read_text(encoding="utf-8"))

    def cut(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = word_ids(model.value)
        for column in parts:
            tokens, totals = [np.zeros(0, "<i4")], [np.zeros(0, np.int64)]
            for i, j in batches_of(text_bytes(column)[1], GROUP):
                ids, rows = encode(column.slice(i, j - i))
                tokens.append(np.insert(ids, rows[1:], end_id))
                totals.append(np.diff(rows) + 1)
            total = np.concatenate(totals)
            sizes = -(-total // capacity)
            start = ranges(np.zeros(len(sizes), np.int64), sizes) * capacity
            whole = np.repeat(total, sizes)
            length = np.minimum(capacity, whole - start)
            each = lists(np.concatenate(tokens), length, pa.int32())
            flat = pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(whole), each], names=_PIECE)
            yield pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), flat)

    add = F.arrow_udf(cut, "array<struct<start:long,length:long,doc_tokens:long,ids:array<int>>>")
    rest = without(docs, text, *_PIECE)
    names, part = [F.col(f"`{c}`") for c in rest.columns], free_name(docs, "_p")
    return docs.select(*names, F.explode(add(F.col(f"`{text}`"))).alias(part)).select(*names, f"{part}.*")


@F.arrow_udf(T.LongType())
def ids_crc32(ids: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """CRC-32 of a column of ids as unsigned little-endian 32-bit numbers."""
    for column in ids:
        raw = memoryview(column.flatten().to_numpy().astype("<i4", copy=False)).cast("B")
        ends = 4 * np.concatenate(([0], np.cumsum(column.value_lengths().to_numpy())))
        yield pa.array([zlib.crc32(raw[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())], type=pa.int64())


def spfhp(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns as (how many sequences, [(length, how many of it)]), covering the histogram exactly.

    Lengths are placed longest first, each into the emptiest packs it fits (a new pack where none
    does). Packs with the same content are one pattern with a count, so the work depends on the
    number of different lengths, not on the number of pieces.
    """
    open_packs: list[tuple[int, int, int, list[tuple[int, int]]]] = []  # (fill, age, count, content)
    age = 0

    def push(fill: int, count: int, content: list[tuple[int, int]]) -> None:
        nonlocal age
        heapq.heappush(open_packs, (fill, age, count, content))
        age += 1

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} does not fit {capacity}")
        while left:
            if open_packs and open_packs[0][0] + length <= capacity:
                fill, _, count, content = heapq.heappop(open_packs)
                if left < count:
                    push(fill, count - left, content)
                    count = left
            else:
                fill, count, content = 0, -(-left // (capacity // length)), []
            # As many of this length as the packs take before they are fuller than the next emptiest.
            deep = min(left // count, (capacity - fill) // length, max(1, -(-((open_packs[0][0] if open_packs else capacity) - fill) // length)))
            deep = max(1, deep)
            if left < count:
                count = left
            same = content and content[-1][0] == length
            longer = [*content[: -1 if same else None], (length, deep + (content[-1][1] if same else 0))]
            push(fill + deep * length, count, longer)
            left -= deep * count
    return [(count, content) for _, _, count, content in open_packs]


def pack(parts: DataFrame, capacity: int, key: str = "doc_id", tie: str = "ids") -> DataFrame:
    """`parts` (as `pieces` gives them) with `sequence_id` and `offset`, gapless from 0 in every sequence.

    The histogram of lengths (at most `capacity` rows) goes to the driver, which packs lengths, not
    pieces. Pieces get their rank among those of the same length from hash buckets and a count table,
    so no length is ordered in one task; rank and patterns then give the place. Repeated rows and tied
    lengths have different ranks, by `tie` at last; an empty table gives no rows. Columns sequence_id and
    offset are replaced.
    """
    parts = without(parts, "sequence_id", "offset")
    histogram = {int(r[0]): int(r[1]) for r in parts.groupBy("length").count().collect()}
    firsts: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = dict.fromkeys(histogram, 0)
    sequence = 0
    for count, content in spfhp(histogram, capacity):
        at = 0
        for length, times in content:
            firsts.setdefault(length, []).append((used[length], times, sequence, at))
            used[length] += count * times
            at += length * times
        sequence += count
    table = {n: tuple(np.array(c, dtype=np.int64) for c in zip(*rows)) for n, rows in firsts.items()}
    shared = parts.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        n, r = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        seq, at = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
        for one in np.unique(n):
            rows = np.flatnonzero(n == one)
            first, times, sequences, offset = shared.value[int(one)]
            k = np.searchsorted(first, r[rows], "right") - 1
            nth = r[rows] - first[k]
            seq[rows] = sequences[k] + nth // times[k]
            at[rows] = offset[k] + nth % times[k] * one
        return pd.DataFrame({"sequence_id": seq, "offset": at})

    bucket = F.pmod(hash64(key, "start"), F.lit(RANK_BUCKETS))
    order = [F.col(key), F.col("start"), F.col("doc_tokens"), F.col(tie)]
    ranked = grouped_position(parts, ["length"], [bucket], order, out="_rank")
    names = [F.col(f"`{c}`") for c in parts.columns]
    return ranked.withColumn("_at", place("length", F.col("_rank") - 1)).select(*names, "_at.*")


def packed(docs: DataFrame, tokenizer_file: str, *, capacity: int = 2048, end_id: int = 1, key: str = "doc_id") -> DataFrame:
    """Every token of every document in one piece of one sequence: `pieces` written once, then `pack`.

    A sequence is the `ids` of its pieces by `offset`. `ids_crc32` is taken from them. Pieces are ranked
    without their ids, by a number fixed when they are written, and joined to them once.
    """
    cut = without(pieces(docs, tokenizer_file, capacity=capacity, end_id=end_id), "sequence_id", "offset")
    row = free_name(cut, "_row")
    rows = written(cut.withColumn(row, F.monotonically_increasing_id()))
    slim = rows.select(F.col(f"`{key}`"), "start", "length", "doc_tokens", row)
    places = pack(slim, capacity, key, row).select(row, "sequence_id", "offset")
    return rows.join(places, row).drop(row).withColumn("ids_crc32", ids_crc32("ids"))
