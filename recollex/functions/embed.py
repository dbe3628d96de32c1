"""Hooks for models, and stand-ins that need none: hash embedding, a learned pair classifier, tolerant JSON."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hash_vector(text: str, dim: int = 64) -> list[float]:
    """A unit vector from the bytes of SHA-256 over the text and a counter, each byte scaled to -1..1."""
    raw = b"".join(hashlib.sha256(f"{text}{i}".encode()).digest() for i in range(-(-dim // 32)))[:dim]
    v = np.frombuffer(raw, np.uint8) / 127.5 - 1
    n = np.linalg.norm(v)
    return (v / n if n else v).tolist()


def hash_embedding(dim: int = 64):
    """The hash embedder as an Arrow-batched function of a text column."""

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: hash_vector(t or "", dim))

    return embed


def model_embedding(load: Callable[[], Callable[[list[str]], np.ndarray]]):
    """An embedder that is loaded once a worker; load() gives a function of a list of texts."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            yield pd.Series(list(model(texts.fillna("").tolist())))

    return embed


def model_scores(load: Callable[[], Callable[[list[tuple[str, str]]], list[float]]]):
    """A reranker or pair judge that is loaded once a worker; rows are filtered before it, as a UDF inside CASE always runs."""

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for a, b in batches:
            yield pd.Series(model(list(zip(a.fillna(""), b.fillna(""), strict=True))))

    return score


# ---- a learned relation of pairs ----

def pair_features(a: str = "x", b: str = "y") -> Column:
    """Both vectors, their difference and its size, as one vector."""
    x, y = F.col(a).cast("array<double>"), F.col(b).cast("array<double>")
    minus = F.zip_with(x, y, lambda p, q: p - q)
    return array_to_vector(F.concat(x, y, minus, F.transform(minus, lambda d: F.abs(d))))


def fit_pairs(pairs: DataFrame, label: str = "label") -> LogisticRegressionModel:
    return LogisticRegression(featuresCol="features", labelCol=label, regParam=0.01, maxIter=50).fit(pairs.withColumn("features", pair_features()))


def predict_pairs(model: LogisticRegressionModel, pairs: DataFrame, threshold: float = 0.5) -> DataFrame:
    out = model.transform(pairs.withColumn("features", pair_features()))
    p = F.element_at(vector_to_array("probability"), 2)
    return out.withColumn("p", p).withColumn("related", F.col("p") >= threshold).drop("features", "rawPrediction", "probability", "prediction")


def adjacent_pairs(props: DataFrame) -> DataFrame:
    """Each proposition with the next of its session: the positives of a mined training set."""
    from pyspark.sql import Window as W

    w = W.partitionBy("session_id").orderBy("turn_idx", "prop_idx")
    return props.select("session_id", F.col("text").alias("a"), F.lead("text").over(w).alias("b")).where("b is not null")


# ---- JSON that models write ----

def salvaged(answer: Column, element: str) -> Column:
    """The array of records in a model's answer: fences off, from the first [ to the last ]; null if there is none."""
    plain = F.regexp_replace(answer, r"```(?:json)?", "")
    body = F.regexp_extract(plain, r"(?s)\[.*\]", 0)
    return F.when(body != "", F.from_json(body, f"array<{element}>"))
