"""Vector math on array columns, in double precision."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamdex.functions.text import _c


def _d(v: Column | str) -> Column:
    return F.transform(_c(v), lambda x: x.cast("double"))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column | str, b: Column | str) -> Column:
    """Null for vectors of different lengths."""
    a, b = _c(a), _c(b)
    return F.when(F.size(a) == F.size(b), total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))))


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def normalize(a: Column | str) -> Column:
    """To unit length; a zero vector stays."""
    n = norm(a)
    return F.transform(_d(a), lambda x: x / F.when(n == 0, 1.0).otherwise(n))


def cosine(a: Column | str, b: Column | str) -> Column:
    """0 if either is a zero vector."""
    d = norm(a) * norm(b)
    return F.when(d == 0, 0.0).otherwise(dot(a, b) / d)


def euclid(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(total(F.zip_with(_c(a), _c(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def softmax(value: Column | str, temperature: float, group: list[str]) -> Column:
    """Over the rows of a group; the maximum is taken off first."""
    w = Window.partitionBy(*group)
    z = _c(value) / temperature
    e = F.exp(z - F.max(z).over(w))
    return e / F.sum(e).over(w)


def toy_embed(text: str, dim: int = 256) -> list[float]:
    return _counts(text, dim).tolist()


def _counts(text: str, dim: int) -> np.ndarray:
    codes = np.frombuffer(re.sub(r"\s+", " ", text).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return np.bincount(((codes[:-1] * 31 + codes[1:]) % dim).astype(np.int64), minlength=dim).astype(float)


def toy_embedding(dim: int = 256):
    """Arrow. Deterministic stand-in for a model: counts of character bigrams, hashed as code point 1 * 31 + code point 2; not normalised."""

    @F.pandas_udf("array<double>")
    def run(text: pd.Series, size: pd.Series) -> pd.Series:
        return text.map(lambda t: _counts(t, dim), na_action="ignore")

    # the second use keeps the optimizer from inlining a text that is an expression: lambdas can't stand inside of a Python function's arguments
    return lambda text: run(_c(text), F.char_length(_c(text)))


#: Prefixes of texts by model family and role, and sizes.
MODELS = {
    "multilingual-e5-small": {"dim": 384, "query": "query: ", "passage": "passage: "},
    "paraphrase-multilingual-MiniLM-L12-v2": {"dim": 384, "query": "", "passage": ""},
    "all-MiniLM-L6-v2": {"dim": 384, "query": "", "passage": ""},
    "toy": {"dim": 256, "query": "", "passage": ""},
}


def role_text(text: Column | str, model: str, role: str) -> Column:
    return F.concat(F.lit(MODELS[model][role]), _c(text))


def similarity_pairs(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The upper triangle of the similarity matrix: (i, j, sim) with i < j. Quadratic by definition: for sets that are meant to be looked at."""
    a = vectors.select(F.col(id).alias("i"), F.col(vector).alias("_a"))
    b = vectors.select(F.col(id).alias("j"), F.col(vector).alias("_b"))
    return a.join(b, F.col("i") < F.col("j")).select("i", "j", cosine("_a", "_b").alias("sim"))


def ranked_neighbours(found: DataFrame) -> DataFrame:
    """(i, j, sim, rank) of searched lists (qid, id, score): ties share a rank."""
    return found.select(F.col("qid").alias("i"), F.col("id").alias("j"), F.col("score").alias("sim"), F.rank().over(Window.partitionBy("qid").orderBy(F.col("score").desc())).alias("rank"))


def both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), "sim"))


def neighbour_ranks(pairs: DataFrame) -> DataFrame:
    """(i, j, sim, rank): rank of j among i's neighbours, ties share it."""
    return both_ways(pairs).withColumn("rank", F.rank().over(Window.partitionBy("i").orderBy(F.col("sim").desc())))


def topic_metrics(vectors: DataFrame, ignore: tuple = (), id: str = "vec_id", vector: str = "embedding", topic: str = "label") -> DataFrame:
    """One row: nn_hits, nn_total, nn_agree, same, diff.

    Mean similarities within and across topics need no pairs: the similarities of all pairs of a set add
    up to half of (the squared length of the sum of its unit vectors, less its size). Nearest neighbours
    are exact; pairs of blocks that can't hold any are skipped. Topics of one member and those in ignore have no say in their
    agreement; of equal neighbours the one of smaller id counts.
    """
    from loamdex.operators.neighbours import nearest_of_all

    unit = vectors.select(F.col(id).alias("id"), F.col(topic).alias("topic"), normalize(vector).alias("v"))
    parts = unit.select("topic", "id", F.posexplode("v").alias("i", "x")).groupBy("topic", "i").agg(F.sum("x").alias("x"))
    size = unit.groupBy("topic").agg(F.count(F.lit(1)).alias("n"), F.sum(dot("v", "v")).alias("own"))
    within = parts.groupBy("topic").agg(F.sum(F.col("x") * F.col("x")).alias("q")).join(size, "topic").agg(F.sum((F.col("q") - F.col("own")) / 2).alias("s"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("sn"), F.sum("n").alias("n"), F.sum("own").alias("own"))
    total = parts.groupBy("i").agg(F.sum("x").alias("x")).agg(F.sum(F.col("x") * F.col("x")).alias("q"))
    means = within.join(F.broadcast(total)).select(F.try_divide("s", "sn").alias("same"), F.try_divide((F.col("q") - F.col("own")) / 2 - F.col("s"), F.col("n") * (F.col("n") - 1) / 2 - F.col("sn")).alias("diff"))
    nearest = nearest_of_all(vectors, 1, id, vector)
    asked = unit.select(F.col("id").alias("qid"), F.col("topic").alias("ti")).join(size.select(F.col("topic").alias("ti"), "n"), "ti").filter(F.col("n") >= 2)
    asked = asked.filter(~F.col("ti").isin(*ignore)) if ignore else asked
    met = asked.join(nearest.select("qid", "id"), "qid", "left").join(unit.select("id", "topic"), "id", "left")
    hits = met.agg(F.count_if(F.col("topic").eqNullSafe(F.col("ti"))).alias("nn_hits"), F.count(F.lit(1)).alias("nn_total"))
    return hits.join(F.broadcast(means)).select("nn_hits", "nn_total", F.try_divide("nn_hits", "nn_total").alias("nn_agree"), "same", "diff")


def pca2(vectors: DataFrame, vector: str = "embedding") -> tuple[list[list[float]], list[float], list[float]]:
    """(two components, mean, explained shares); a component's largest coordinate is positive. Project with project2()."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    v = vectors.select(array_to_vector(_d(vector)).alias("v"))
    model = PCA(k=2, inputCol="v", outputCol="p").fit(v)
    mean = v.select(Summarizer.mean(F.col("v"))).first()[0].toArray().tolist()
    columns = model.pc.toArray().T.tolist()
    signed = [[x if max(c, key=abs) > 0 else -x for x in c] for c in columns]
    return signed, mean, model.explainedVariance.toArray().tolist()


def project2(vector: Column | str, components: list[list[float]], mean: list[float]) -> Column:
    """Coordinates of centred vectors."""
    centred = F.zip_with(_d(vector), F.array(*map(F.lit, mean)), lambda x, m: x - m)
    return F.array(*[dot(centred, F.array(*map(F.lit, c))) for c in components])
