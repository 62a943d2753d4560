"""Helpers the operators of this subpackage share: written tables, words of Arrow text columns, hashes."""

from __future__ import annotations

import gc
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticewing.plans.storage import bucketed, written

__all__ = ["bucketed", "free_name", "hash64", "likely", "read_table", "release", "uniform", "without", "written"]

#: bytes of text hashed at once, so that the arrays beside it stay small
BLOCK = 1 << 18
#: bits of the bitmap by which `likely` tells rows apart: 8 MB
MARKS = 1 << 26
_ODD = np.uint64(0x9E3779B97F4A7C15)
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps that are over: it does so when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def without(df: DataFrame, *names: str) -> DataFrame:
    """`df` without columns that have one of these names, whatever their case."""
    low = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in low])


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores before it until no column of `df` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def hash64(*cols: str | Column) -> Column:
    return F.xxhash64(*cols)


def uniform(*cols: str | Column) -> Column:
    """A number in [0, 1) that depends on the columns alone, so a task that runs again draws the same."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / F.lit(float(1 << 53))


def likely(rows: DataFrame, wanted: DataFrame, *keys: str) -> DataFrame:
    """Rows of `rows` whose keys a row of `wanted` has, and some others, so that a join behind it is sent fewer.

    Hashes of the wanted keys are marked in a bitmap that is broadcast, of MARKS bits however many there
    are: a share of the other rows passes, about as large as that of the bits that are marked.
    """
    place = F.pmod(hash64(*keys), F.lit(MARKS))
    number, bit = F.bitmap_bucket_number(place), F.bitmap_bit_position(place)
    marks = wanted.select(number.alias("_number"), bit.alias("_bit")).groupBy("_number").agg(F.bitmap_construct_agg("_bit").alias("_marks"))
    byte = F.conv(F.hex(F.substring(F.col("_marks"), (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << k) for k in range(8)]), (bit % 8).cast("int") + 1)) != 0
    return rows.join(F.broadcast(marks), (number == F.col("_number")) & marked, "left_semi")


# ---- words of Arrow text columns -------------------------------------------------------------


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column end to end and each row's first byte; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_spans(data: np.ndarray, rows: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and end byte of every word, and the index of each row's first word (one more at the end).

    A word is a longest run of bytes that are not ASCII white space; it never crosses rows.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(rows), np.int64)
    inside = ~space[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[rows] = True
    before = np.empty(len(data), dtype=bool)
    before[0], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(len(data), dtype=bool)
    after[-1], after[:-1] = False, inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, rows)


def mixed(x: np.ndarray) -> np.ndarray:
    """Scatter the bits of 64-bit integers (the finisher of SplitMix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _A
    x = x ^ (x >> np.uint64(27))
    x = x * _B
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
    with np.errstate(over="ignore"):
        up = np.cumprod(np.full(BLOCK, _ODD))
        down = np.cumprod(np.full(BLOCK, inverse))
        table = mixed(np.arange(1, 257, dtype=np.uint64) * _A)
    return up, down, table


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every word's bytes, the same on every machine and in every batch."""
    up, down, table = _powers()
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(starts):
            base = starts[i]
            j = int(np.searchsorted(ends, base + BLOCK - 1, side="right"))
            if j <= i:  # a word longer than a block
                value = np.uint64(0)
                for at in range(int(base), int(ends[i]), BLOCK):
                    part = table[data[at : min(at + BLOCK, int(ends[i]))]]
                    value = value * _B + (part * up[: len(part)]).sum(dtype=np.uint64)
                out[i] = value + np.uint64(ends[i] - base)
                i += 1
                continue
            part = table[data[base : ends[j - 1]]]
            sums = np.zeros(len(part) + 1, dtype=np.uint64)
            np.cumsum(part * up[: len(part)], out=sums[1:])
            first, last = starts[i:j] - base, ends[i:j] - base
            out[i:j] = (sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64)
            i = j
        return mixed(out)


def batches_of(rows: np.ndarray, most: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about `most` bytes each; a longer row stands alone."""
    i, n = 0, len(rows) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(rows, rows[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = j


def text_groups(column: pa.Array, most: int = 1 << 20) -> Iterator[list[str]]:
    """A text column's rows in groups of about `most` bytes, null as empty."""
    _, rows = text_bytes(column)
    for i, j in batches_of(rows, most):
        yield column.slice(i, j - i).fill_null("").to_pylist()


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start+1, ... of every range, end to end."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    skip = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    return np.arange(total, dtype=np.int64) + skip


def lists(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column from end-to-end values."""
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))
