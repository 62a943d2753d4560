"""TF-IDF with sublinear term frequency, smooth IDF and unit length; unigrams and bigrams."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from noticewing.functions import text as tx
from noticewing.plans import storage

MAX_TERMS = 5000
MIN_DF = 2
_VOCABULARY = "term string, idx int, df long, total long, idf double"


#: a row's words joined by spaces, as the counting functions read them
WORDS = "_words"
#: bytes of words counted together in a task
CHUNK = 8 << 20
#: words of a second place that are sent to the tasks, as a multiple of the terms wanted
TIES = 10


def words_of(text: Column) -> Column:
    """The unigrams of a text joined by spaces; no unigram holds one."""
    return F.array_join(tx.unigrams(text), " ")


class Words:
    """Words of some rows as numbers: `known` lists the different ones, `code` and `row` go over all in order."""

    def __init__(self, column: pa.Array):
        column = column.fill_null("") if column.null_count else column
        cut = pc.split_pattern(column, " ")
        # cutting an empty text leaves one empty word
        size = np.where(pc.binary_length(column).to_numpy() > 0, np.diff(cut.offsets.to_numpy()), 0)
        flat = cut.flatten()
        coded = flat.filter(pc.greater(pc.binary_length(flat), 0)).dictionary_encode()
        self.n, self.known = len(column), coded.dictionary
        self.code = coded.indices.to_numpy().astype(np.int64)
        self.row = np.repeat(np.arange(self.n), size)
        self.pair = np.flatnonzero(self.row[1:] == self.row[:-1])  # where a bigram starts


def _chunks(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold CHUNK bytes, or one row if it holds more."""
    ends = np.cumsum(pc.binary_length(column).fill_null(0).to_numpy().astype(np.int64))
    i = 0
    while i < len(ends):
        j = max(int(np.searchsorted(ends, (ends[i - 1] if i else 0) + CHUNK, "right")), i + 1)
        yield i, j
        i = j


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, lengths) of equal neighbours."""
    new = np.ones(len(keys), dtype=bool)
    new[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(new)
    return at, np.diff(np.append(at, len(keys)))


def _per_row(row: np.ndarray, code: np.ndarray, codes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, code, count) of every different code of a row, by row and code."""
    bits = codes.bit_length()
    keys = np.sort(row << bits | code)
    at, count = _runs(keys)
    return keys[at] >> bits, keys[at] & ((1 << bits) - 1), count


def _per_group(group: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, rows it is in, its count) of every different group."""
    bits = rows.bit_length()
    keys = np.sort(group << bits | row)
    at, total = _runs(keys >> bits)
    new = np.ones(len(keys), dtype=np.int64)
    new[1:] = keys[1:] != keys[:-1]
    return keys[at] >> bits, np.add.reduceat(new, at) if len(at) else at, total


def _counted(rows: DataFrame, by: str | None, firsts: list[str] | None = None, seconds: list[str] | None = None) -> DataFrame:
    """(term, part, df, total) of unigrams, or of the bigrams whose words are in the lists (no second list: any); several rows a term.

    `part` is the column `by`, else 0. Terms are counted chunk by chunk and become text once in each.
    """
    shared = rows.sparkSession.sparkContext.broadcast((firsts, seconds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts, seconds = (x if x is None else pa.array(x, pa.string()) for x in shared.value)
        for batch in batches:
            column = batch.column(WORDS)
            part = batch.column(by).to_numpy().astype(np.int64) if by else np.zeros(batch.num_rows, np.int64)
            for i, j in _chunks(column):
                words = Words(column.slice(i, j - i))
                row, code, n = words.row, words.code, len(words.known)
                bits = max(n, 1).bit_length()
                if firsts is not None:
                    here = pc.is_in(words.known, value_set=firsts).to_numpy(zero_copy_only=False)[code[words.pair]]
                    if seconds is not None:
                        here &= pc.is_in(words.known, value_set=seconds).to_numpy(zero_copy_only=False)[code[words.pair + 1]]
                    at = words.pair[here]
                    row, code, bits = row[at], code[at] << bits | code[at + 1], 2 * bits
                keys, df, total = _per_group(part[i:j][row] << bits | code, row, words.n)
                if not len(keys):
                    continue
                code = keys & ((1 << bits) - 1)
                half = bits // 2
                term = words.known.take(pa.array(code)) if firsts is None else pc.binary_join_element_wise(
                    words.known.take(pa.array(code >> half)), words.known.take(pa.array(code & ((1 << half) - 1))), " ")
                yield pa.RecordBatch.from_arrays([term, pa.array(keys >> bits), pa.array(df.astype(np.int64)), pa.array(total.astype(np.int64))], names=["term", "part", "df", "total"])

    return rows.mapInArrow(run, "term string, part long, df long, total long")


def counted_terms(rows: DataFrame, max_terms: int, min_df: int, parts: dict[str, Column] | None = None, by: str | None = None) -> DataFrame:
    """(term, df, total) of all unigrams and of every bigram that can be among the `max_terms` most frequent terms.

    `parts` (name -> condition on the column `part`) asks for columns df<name> and total<name> of rows in each part.
    A bigram is no more frequent than either of its words. If `max_terms` words are as frequent as T, a bigram
    that comes in has two words as frequent as T, and the first is one of those `max_terms`: where
    both have T, "a b" comes after "a" and before the last one. With fewer words, all of them are asked for.
    """
    parts = parts or {"": F.lit(True)}
    sums = [F.sum(F.when(c, F.col(x)).otherwise(0)).alias(f"{x}{name}") for name, c in parts.items() for x in ("df", "total")]
    words = storage.written(_counted(rows, by).groupBy("term").agg(*sums))
    firsts: set[str] = set()
    often = F.lit(False)
    for name in parts:
        enough = F.col(f"df{name}") >= min_df
        top = words.where(enough).orderBy(F.desc(f"total{name}"), "term").limit(max_terms).select("term", F.col(f"total{name}").alias("n")).collect()
        firsts.update(r["term"] for r in top)
        often |= enough & (F.col(f"total{name}") >= (top[-1]["n"] if top and len(top) == max_terms else 0))
    most = TIES * max_terms * len(parts)
    seconds = words.where(often).select("term").limit(most + 1).toArrow()["term"].to_pylist()
    pairs = _counted(rows, by, sorted(firsts), seconds if len(seconds) <= most else None)
    return words.unionByName(pairs.groupBy("term").agg(*sums))


def vocabulary(df: DataFrame, text: str = "text", max_terms: int = MAX_TERMS, min_df: int = MIN_DF) -> DataFrame:
    """(term, idx, df, total, idf): the most frequent terms, ties by term, numbered alphabetically.

    Rows of `df` are documents. They are read once and their words written; only distinct terms travel.
    """
    return vocabulary_of(storage.written(df.select(words_of(F.col(text)).alias(WORDS))), max_terms, min_df)


def vocabulary_of(rows: DataFrame, max_terms: int = MAX_TERMS, min_df: int = MIN_DF) -> DataFrame:
    """`vocabulary` of written rows with a column WORDS."""
    n = rows.count()
    counts = counted_terms(rows, max_terms, min_df)
    kept = counts.where(F.col("df") >= min_df).orderBy(F.desc("total"), F.asc("term")).limit(max_terms)
    # max_terms rows at most: numbering them in one task is bounded
    idx = (F.row_number().over(W.partitionBy().orderBy("term")) - 1).cast("int")
    idf = F.ln((n + 1) / (F.col("df") + 1)) + 1
    return kept.select("term", idx.alias("idx"), "df", "total", idf.alias("idf"))


class Places:
    """Places of terms in a list, looked up by the numbers of their words."""

    def __init__(self, terms: list[str]):
        cut = [t.split(" ") for t in terms]
        words = sorted({w for c in cut for w in c})
        number = {w: i for i, w in enumerate(words)}
        self.words, self.n = pa.array(words, pa.string()), len(terms)
        self.single = np.full(len(words) + 1, -1, dtype=np.int64)  # the last one stands for unknown words
        for place, c in enumerate(cut):
            if len(c) == 1:
                self.single[number[c[0]]] = place
        pairs = sorted((number[c[0]] * len(words) + number[c[1]], place) for place, c in enumerate(cut) if len(c) == 2)
        self.pair = np.array([k for k, _ in pairs], dtype=np.int64)
        self.pair_place = np.array([p for _, p in pairs], dtype=np.int64)

    def __call__(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, place, count) of the known terms of every row, by row and place."""
        number = pc.index_in(words.known, value_set=self.words).fill_null(-1).to_numpy().astype(np.int64)[words.code]
        row, place = words.row, self.single[number]
        row, place = row[place >= 0], place[place >= 0]
        if len(self.pair):
            a, b = number[words.pair], number[words.pair + 1]
            both = (a >= 0) & (b >= 0)
            keys = a[both] * len(self.words) + b[both]
            at = np.minimum(np.searchsorted(self.pair, keys), len(self.pair) - 1)
            hit = self.pair[at] == keys
            row, place = np.concatenate((row, words.row[words.pair[both][hit]])), np.concatenate((place, self.pair_place[at[hit]]))
        return _per_row(row, place, max(self.n, 1))


def weights(df: DataFrame, vocab: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(key, term, weight) with unit length per row of `df`; `vocab` has max_terms rows at most, and `key` is unique."""
    rows = vocab.select("term", "idf").orderBy("term").collect()
    shared = df.sparkSession.sparkContext.broadcast(([r["term"] for r in rows], np.array([r["idf"] for r in rows], dtype=float)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, idf = shared.value
        places, names = Places(terms), pa.array(terms, pa.string())
        for batch in batches:
            for i, j in _chunks(batch.column(1)):
                row, place, tf = places(Words(batch.column(1).slice(i, j - i)))
                w = (1.0 + np.log(tf)) * idf[place]
                w /= np.sqrt(np.bincount(row, weights=w * w, minlength=j - i))[row]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row + i)), names.take(pa.array(place)), pa.array(w)], names=[key, "term", "weight"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, words_of(F.col(text)).alias(WORDS)).mapInArrow(run, f"`{key}` {kind}, term string, weight double")


def placed(words: str, terms: list[str], spark: SparkSession) -> Column:
    """struct<terms, tf>: places in the list and counts of the known terms of a column of joined words."""
    shared = spark.sparkContext.broadcast(terms)

    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        places = Places(shared.value)
        for column in parts:
            found = [(i, j, *places(Words(column.slice(i, j - i)))) for i, j in _chunks(column)]
            size = np.concatenate([np.zeros(0, np.int64), *(np.bincount(row, minlength=j - i) for i, j, row, _, _ in found)])
            offsets = pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32))
            flat = [np.concatenate([np.zeros(0, np.int32), *(f[k].astype(np.int32) for f in found)]) for k in (3, 4)]
            yield pa.StructArray.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in flat], names=["terms", "tf"])

    return F.arrow_udf(run, "struct<terms:array<int>,tf:array<int>>")(F.col(words))


@dataclass
class TfidfModel:
    """A fitted vocabulary: at most MAX_TERMS rows (term, idx, df, total, idf)."""

    rows: list[tuple]

    @classmethod
    def fit(cls, df: DataFrame, text: str = "text", max_terms: int = MAX_TERMS, min_df: int = MIN_DF) -> TfidfModel:
        return cls.of(vocabulary(df, text, max_terms, min_df))

    @classmethod
    def of(cls, vocab: DataFrame) -> TfidfModel:
        return cls([tuple(r) for r in vocab.orderBy("idx").collect()])

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, _VOCABULARY)

    def transform(self, df: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
        """(key, features) with a sparse unit vector per document, for training."""
        size, at, idf = len(self.rows), [r[1] for r in self.rows], [float(r[4]) for r in self.rows]

        @F.udf(VectorUDT())
        def sparse(terms, tf):
            entries = sorted((at[t], (1 + math.log(n)) * idf[t]) for t, n in zip(terms, tf))
            norm = sum(w * w for _, w in entries) ** 0.5
            return SparseVector(size, [i for i, _ in entries], [w / norm for _, w in entries])

        words = df.select(key, words_of(F.col(text)).alias(WORDS))
        known = words.withColumn("_e", placed(WORDS, [r[0] for r in self.rows], df.sparkSession))
        return known.select(key, sparse("_e.terms", "_e.tf").alias("features"))

    def save(self, spark: SparkSession, path: str) -> None:
        self.frame(spark).coalesce(1).write.parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TfidfModel:
        return cls([tuple(r) for r in spark.read.parquet(path).select("term", "idx", "df", "total", "idf").orderBy("idx").collect()])
