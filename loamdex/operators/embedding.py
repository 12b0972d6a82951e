"""Embedding behind an interface: models are loaded once a worker, texts are embedded once each."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamdex.functions.vectors import MODELS, role_text, toy_embed

BATCH = 16


class Embedder(Protocol):
    """embed(text column) gives an array<double> column."""

    name: str

    def embed(self, text: Column) -> Column: ...


class ToyEmbedder:
    name = "toy"

    def embed(self, text: Column) -> Column:
        return model_embedding(lambda: lambda texts: [toy_embed(t) for t in texts])(text)


_MODELS: dict[str, object] = {}


def loaded(name: str, load: Callable[[], object]):
    """One model a worker process: the first call loads it, another name takes its place."""
    if name not in _MODELS:
        _MODELS.clear()
        _MODELS[name] = load()
    return _MODELS[name]


def pooled(tokens: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Mean of the token vectors (texts, tokens, numbers) that the mask keeps, to unit length; a text without tokens stays zero."""
    kept = mask[..., None].astype(np.float64)
    mean = (tokens * kept).sum(axis=1) / np.maximum(kept.sum(axis=1), 1e-9)
    n = np.linalg.norm(mean, axis=1, keepdims=True)
    return mean / np.where(n == 0, 1, n)


def model_embedding(load: Callable[[], Callable[[list[str]], list]], batch: int = BATCH, name: str | None = None):
    """Arrow. load() gives a function from texts to vectors, or to (token vectors, mask) that are pooled; it is called on batches. With a name it runs once a worker, else once a task."""

    def run(text: Column) -> Column:
        @F.pandas_udf("array<double>")
        def embed(series: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            model = loaded(name, load) if name else load()
            for s, _ in series:
                own, vectors = [t or "" for t in s], []
                for i in range(0, len(own), batch):
                    made = model(own[i : i + batch])
                    vectors += list(pooled(*map(np.asarray, made))) if isinstance(made, tuple) else list(made)
                yield pd.Series([None if t is None else list(map(float, v)) for t, v in zip(s, vectors)])

        # the second use keeps the optimizer from inlining a text that is an expression with lambdas
        return embed(text, F.char_length(text))

    return run


def embed_once(texts: DataFrame, embedder: Embedder, role: str = "passage", text: str = "text", known: DataFrame | None = None) -> DataFrame:
    """texts with embedding. Each distinct text is embedded once; known (model, role, text, embedding) are not embedded again."""
    asked = texts.select(F.col(text).alias("_t")).filter("_t is not null").distinct()
    if known is not None:
        stored = known.filter((F.col("model") == embedder.name) & (F.col("role") == role)).select(F.col("text").alias("_t"), "embedding")
        fresh = asked.join(stored, "_t", "left_anti")
    else:
        stored, fresh = None, asked
    wanted = role_text("_t", embedder.name, role) if embedder.name in MODELS else F.col("_t")
    made = fresh.select("_t", embedder.embed(wanted).alias("embedding"))
    every = made if stored is None else made.unionByName(stored)
    return texts.join(every, texts[text] == every["_t"], "left").drop("_t")


def off_diagonal_scale(pairs: DataFrame) -> DataFrame:
    """pairs (i, j, sim) with scaled: sim from 0 to 1 over all pairs of different rows, 1 where they are equal."""
    ends = pairs.agg(F.min("sim").alias("_lo"), F.max("sim").alias("_hi"))
    scaled = F.when(F.col("_hi") == F.col("_lo"), 1.0).otherwise(F.try_divide(F.col("sim") - F.col("_lo"), F.col("_hi") - F.col("_lo")))
    return pairs.join(F.broadcast(ends)).withColumn("scaled", scaled).drop("_lo", "_hi")
