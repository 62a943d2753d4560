"""The queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticewing.llm import align, bpe, hyperplanes, lines, minhash, packing, postings, quality, repeats, severity, sharding, substrings, trie
from noticewing.llm.common import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@query("op1_packing")
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = packing.packed(docs, tokenizer_path("word_bpe_49k.json"), capacity=2048, end_id=1)
    length = F.size("ids").cast("long").alias("length")
    return out.select("doc_id", "start", length, "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query("op2_nearest")
def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings.nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


@query("op3_minhash")
def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.duplicate_report(read_table(spark, sf_dir, "documents").select("doc_id", "text"), 0.8)


@query("op4_bpe")
def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.token_digests(docs, tokenizer_path("byte_bpe_50k.json")).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query("op5_vectors", """
WITH v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), n AS (SELECT *, sqrt(list_inner_product(e, e)) AS norm FROM v),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id
    AND len(a.e) = len(b.e) AND list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.98
), r AS (
  WITH RECURSIVE c(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT c.a, l.b FROM c JOIN l ON c.b = l.a)
  SELECT a, min(b) AS component FROM c GROUP BY a
), k AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(k.n, 0) AS n_links, r.component AS component_id, vec_id = r.component AS kept
FROM embeddings JOIN r ON r.a = vec_id LEFT JOIN k ON k.a = vec_id
""")
def op5_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperplanes.near_vectors(read_table(spark, sf_dir, "embeddings"), 0.98)


@query("op6_quality")
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = quality.fit(docs, read_table(spark, sf_dir, "labels"), ~held_out)
    out = quality.score(docs, model)
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query("op7_lines")
def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(read_table(spark, sf_dir, "documents").select("doc_id", "text"), 0.8)


@query("op8_substrings")
def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.window_report(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    key = F.when(F.col("_id") != -(1 << 63), F.col("_id"))  # that stands for null
    return out.select(key.alias("doc_id"), "n_words", "n_removed", "kept_sha256")


@query("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = severity.fit(docs, read_table(spark, sf_dir, "labels"))
    out = severity.severity(docs, model)
    return out.select("doc_id", "severity", "toxic_probability", model.rejects(F.col("toxic_probability")).alias("rejected"))


@query("op10_sharding")
def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = read_table(spark, sf_dir, "documents").select(
        "doc_id", (F.length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    out = sharding.range_shards(docs, "doc_id", "size", 40)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op11_trie")
def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, convs = trie.rebuilt(trie.numbered(read_table(spark, sf_dir, "conversations")))
    return trie.trie(turns, convs)


@query("op12_alignment")
def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = align.linked(docs, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@query("op13_suffixes")
def op13_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.repeat_report(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    key = F.when(F.col("_id") != -(1 << 63), F.col("_id"))  # that stands for null
    return out.select(key.alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
