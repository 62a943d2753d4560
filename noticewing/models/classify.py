"""The two level classifiers: linear on TF-IDF, forest on embeddings."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticewing import domain
from noticewing.functions import text as tx
from noticewing.models import forest, linear, split, tfidf
from noticewing.models.forest import ForestModel
from noticewing.operators import metrics
from noticewing.plans import order as od
from noticewing.plans import storage

LEVELS = domain.LEVELS


def balanced(df: DataFrame, label: str = "criticality") -> tuple[DataFrame, int]:
    """(rows with numeric label y and class weight n / (k * n_c), n). Reads the counts of the levels."""
    counts = {r[0]: r[1] for r in df.where(F.col(label).isin(*LEVELS)).groupBy(label).count().collect()}
    n = sum(counts.values())
    weight = F.lit(None).cast("double")
    for level, c in counts.items():
        weight = F.when(F.col(label) == level, n / (len(counts) * c)).otherwise(weight)
    rows = df.withColumn("y", tx.level_order(F.col(label)).cast("double")).withColumn("weight", weight)
    return rows.where(F.col("y").isNotNull()), n


@dataclass
class LinearModel:
    """Multinomial coefficients next to the vocabulary; scoring needs no vectors."""

    vocab: tfidf.TfidfModel
    coefficients: list[list[float]]  # level x term
    intercepts: list[float]

    def frame(self, spark: SparkSession) -> DataFrame:
        """(term, idf, b0..b3): at most MAX_TERMS rows."""
        rows = [(r[0], float(r[4]), *[float(c[r[1]]) for c in self.coefficients]) for r in self.vocab.rows]
        names = ", ".join(f"b{i} double" for i in range(len(LEVELS)))
        return spark.createDataFrame(rows, f"term string, idf double, {names}")

    def transform(self, df: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
        """(key, criticality, confidence): margins of each row's own terms, then softmax. No shuffle."""
        terms, idf = [r[0] for r in self.vocab.rows], np.array([float(r[4]) for r in self.vocab.rows])
        # The vocabulary has MAX_TERMS terms at most.
        place = np.array([r[1] for r in self.vocab.rows], dtype=np.int64)
        coefficients = np.array(self.coefficients, dtype=float).reshape(len(LEVELS), -1)[:, place]
        shared = df.sparkSession.sparkContext.broadcast((idf, coefficients, np.array(self.intercepts)))

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            idf, coefficients, intercepts = shared.value
            for batch in batches:
                block = linear.Block(batch)
                margins = block.margins(block.weights(idf), coefficients, intercepts)
                top = margins.argmax(axis=1)
                with np.errstate(under="ignore"):
                    odds = np.exp(margins - margins.max(axis=1, keepdims=True)).sum(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(top.astype(np.int32)), pa.array(1.0 / odds)], names=[key, "_level", "confidence"])

        rows = linear.encoded(df.select(key, text), terms, text)
        kind = rows.schema[key].dataType.simpleString()
        scored = rows.mapInArrow(score, f"`{key}` {kind}, _level int, confidence double")
        return scored.select(key, F.get(F.array(*[F.lit(lv) for lv in LEVELS]), "_level").alias("criticality"), "confidence")

    def save(self, spark: SparkSession, path: str) -> None:
        self.vocab.save(spark, f"{path}/vocabulary")
        rows = [(i, [float(x) for x in c], float(b)) for i, (c, b) in enumerate(zip(self.coefficients, self.intercepts))]
        spark.createDataFrame(rows, "level int, coefficients array<double>, intercept double").coalesce(1).write.parquet(f"{path}/coefficients")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LinearModel:
        rows = spark.read.parquet(f"{path}/coefficients").orderBy("level").collect()
        return cls(tfidf.TfidfModel.load(spark, f"{path}/vocabulary"), [r["coefficients"] for r in rows], [r["intercept"] for r in rows])


def fit_lr(
    df: DataFrame, vocab: tfidf.TfidfModel | None = None, key: str = "id", text: str = "text", label: str = "criticality",
    c: float = 1.0, max_iter: int = 1000, tol: float = 1e-4,
) -> LinearModel:
    """Balanced multinomial logistic regression with L2 penalty 1/(C n) on TF-IDF vectors (`linear.solve`)."""
    words = df.select(label, tfidf.words_of(F.col(text)).alias(tfidf.WORDS))
    if vocab is None:
        words = storage.written(words)
        vocab = tfidf.TfidfModel.of(tfidf.vocabulary_of(words))
    rows = linear.numbered(words, label).select("y", F.lit(0).alias("fold"), tfidf.WORDS)
    table = storage.written(linear.encoded(rows, [r[0] for r in vocab.rows], tfidf.WORDS))
    counts = {r["y"]: r["count"] for r in table.groupBy("y").count().collect()}
    weight, n = linear.class_weights(counts)
    problem = linear.Problem(np.arange(len(vocab.rows)), np.array([float(r[4]) for r in vocab.rows]), weight, n)
    coefficients, bias = linear.solve(table, [problem], len(vocab.rows), c, max_iter, tol)[0]
    # a level absent from the training rows can never be predicted
    order = np.argsort([r[1] for r in vocab.rows])
    return LinearModel(vocab, coefficients[:, order].tolist(), [float(b) if w else float("-inf") for b, w in zip(bias, weight)])


def top_terms(model: LinearModel, spark: SparkSession, k: int = 15) -> DataFrame:
    """Strongest terms per level: (criticality, term, weight)."""
    pairs = F.array(*[F.struct(F.lit(lv).alias("criticality"), F.col(f"b{i}").alias("weight")) for i, lv in enumerate(LEVELS)])
    long = model.frame(spark).select("term", F.explode(pairs).alias("p")).select("p.criticality", "term", "p.weight")
    return od.top_k(long, k, [F.desc("weight"), F.asc("term")], ["criticality"])


def fit_rf(
    df: DataFrame, embedding: str = "embedding", label: str = "criticality", trees: int = 200, min_leaf: int = 2,
    max_samples: int = forest.MAX_SAMPLES, seed: int = 42, key: str = "id",
) -> ForestModel:
    """Balanced random forest without a depth limit.

    Every tree is grown on a bootstrap sample of its own, drawn from all rows, of `max_samples` rows in
    the mean at most. Rows without an embedding or with an unknown level are left out.
    """
    rows, n = balanced(df.where(F.col(embedding).isNotNull()).select(key, label, embedding), label)
    return ForestModel(forest.grow_forest(rows, n, embedding, key, trees, min_leaf, max_samples, seed))


Predict = Callable[[DataFrame], DataFrame]


def cv_scores(
    df: DataFrame, fit: Callable[[DataFrame], Predict], name: str = "model", folds: int = 5, seed: int = 42,
    label: str = "criticality", key: str = "id",
) -> DataFrame:
    """One row: mean and population deviation of macro F1 (percent) over stratified folds.

    `fit(train)` returns a function that adds y_pred to test rows; features fitted inside it see the
    training fold only. To fit them once on everything, close over them.
    """
    parts = split.stratified_folds(df, label, key, folds, seed).persist()
    try:
        scores = []
        for fold in range(folds):
            predict = fit(parts.where(F.col("fold") != fold).drop("fold"))
            done = predict(parts.where(F.col("fold") == fold).drop("fold"))
            scores.append(metrics.model_metrics(done, f"{fold}", y_true=label, dp=10).first()["macro_f1"])
    finally:
        parts.unpersist()
    rows = df.sparkSession.createDataFrame([(s,) for s in scores], "f double")
    return rows.agg(F.lit(name).alias("model"), F.avg("f").alias("macro_f1_mean"), F.stddev_pop("f").alias("macro_f1_std"))


def cv_scores_lr(
    df: DataFrame, name: str = "TF-IDF + Logistic Regression", folds: int = 5, seed: int = 42, label: str = "criticality", key: str = "id", text: str = "text", **fit
) -> DataFrame:
    """`cv_scores` of the linear model, all folds fitted side by side (`linear.cross_predict`)."""
    parts = storage.written(split.stratified_folds(df.select(key, label, text), label, key, folds, seed))
    done = storage.written(linear.cross_predict(parts, folds, key, text, label, **fit))
    scores = [metrics.model_metrics(done.where(F.col("fold") == f), f"{f}", y_true=label, dp=10).first()["macro_f1"] for f in range(folds)]
    rows = df.sparkSession.createDataFrame([(s,) for s in scores], "f double")
    return rows.agg(F.lit(name).alias("model"), F.avg("f").alias("macro_f1_mean"), F.stddev_pop("f").alias("macro_f1_std"))


def predict_with(model: LinearModel | ForestModel, key: str = "id") -> Predict:
    """Function that adds y_pred to labelled rows, for cv_scores and evaluation."""
    if isinstance(model, LinearModel):
        return lambda df: df.join(model.transform(df, key).select(key, F.col("criticality").alias("y_pred")), key)

    def by_forest(df: DataFrame) -> DataFrame:
        scored = model.transform(df.withColumnRenamed("criticality", "_true"))
        return scored.drop("confidence").withColumnsRenamed({"criticality": "y_pred", "_true": "criticality"})

    return by_forest
