"""Embedding columns: a pluggable encoder and a store of vectors already made."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml.feature import PCA, HashingTF, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticewing.functions import text as tx

#: turns rows with a text column into the same rows with an `embedding` array<float>
Encoder = Callable[[DataFrame], DataFrame]


def hashing_encoder(dim: int = 384, text: str = "text") -> Encoder:
    """Default encoder: hashed term counts folded to `dim` and scaled to unit length; no training, no Python."""

    def encode(df: DataFrame) -> DataFrame:
        words = df.withColumn("_w", F.coalesce(tx.unigrams(F.col(text)), F.array().cast("array<string>")))
        counted = HashingTF(inputCol="_w", outputCol="_tf", numFeatures=dim).transform(words)
        unit = Normalizer(inputCol="_tf", outputCol="_v", p=2.0).transform(counted)
        return unit.withColumn("embedding", vector_to_array("_v", "float32")).drop("_w", "_tf", "_v")

    return encode


def batch_encoder(load: Callable[[], Callable[[list[str]], list]], text: str = "text", batch_size: int = 128) -> Encoder:
    """Encoder around a pretrained network: `load()` runs once per task and returns texts -> vectors."""

    def encode(df: DataFrame) -> DataFrame:
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for texts in batches:
                given = texts.fillna("").tolist()
                out: list = []
                for i in range(0, len(given), batch_size):
                    out.extend([[float(x) for x in v] for v in model(given[i:i + batch_size])])
                yield pd.Series(out)

        run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
        return df.withColumn("embedding", F.pandas_udf(run, "array<float>")(F.col(text)))

    return encode


def embed(df: DataFrame, encoder: Encoder, store: DataFrame | None = None, key: str = "id", text: str = "text") -> DataFrame:
    """(key, embedding): from the store where it has the key, else encoded."""
    rows = df.select(key, text)
    if store is None:
        return encoder(rows).select(key, "embedding")
    known = store.select(key, "embedding")
    fresh = encoder(rows.join(known.select(key), key, "left_anti")).select(key, "embedding")
    return known.join(rows.select(key), key, "left_semi").unionByName(fresh)


def project_2d(df: DataFrame, embedding: str = "embedding", key: str = "id", sample: int = 2000, seed: int = 42) -> DataFrame:
    """Two principal components (fitted on all rows) of a seeded sample of rows, for inspection.

    The sample is the rows with the smallest hashes; every task keeps that many at most before they meet.
    """
    vectors = df.withColumn("_f", array_to_vector(F.col(embedding).cast("array<double>")))
    model = PCA(k=2, inputCol="_f", outputCol="_p").fit(vectors)
    picked = vectors.orderBy(F.xxhash64(F.col(key), F.lit(seed)), F.col(key)).limit(sample)
    point = vector_to_array("_p")
    return model.transform(picked).withColumn("x", point[0]).withColumn("y", point[1]).drop("_f", "_p")
