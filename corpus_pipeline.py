"""A training corpus from `documents`: toxicity, line dedup, near-dedup, substring dedup, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from noticewing.llm import lines, minhash, packing, severity, substrings
from noticewing.llm.common import read_table, written
from noticewing.llm.registered import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents likelier clean than toxic, by a model of the labelled ones among those given."""
    return severity.clean(docs, read_table(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without lines that resemble an earlier one."""
    return lines.deduped(docs, 0.8)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return minhash.deduped(docs, 0.8)


def drop_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without windows of words that an earlier one has."""
    return substrings.deduped(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, with their token ids, in sequences of 2048 tokens; a document left without text gives one token."""
    return packing.packed(docs.select("doc_id", "text"), tokenizer_path("word_bpe_49k.json"), capacity=2048, end_id=1)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_substrings),
    ("packing", pack),
]

#: SQL can express neither the fitted model nor the tokenizer; tests compare with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on `documents`, each written as Parquet and read again for the next."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
