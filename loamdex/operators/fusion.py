"""Fusing and reranking ranked lists: rows (qid, id, score, rank), lists told apart by name or position."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamdex.functions.text import coverage, tokenize
from loamdex.operators.retrieval import DIGITS


def _ranked(df: DataFrame, k: int, *ties: Column | str) -> DataFrame:
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), *ties, "id")
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def reciprocal_rank_fusion(lists: list[DataFrame], k: float = 60, top: int = 10) -> DataFrame:
    """(qid, id, score, ranks, rank): sum of 1 / (k + rank). ranks maps a list's position to the rank there.

    Of equal scores the one first seen comes first: by the first list that has it, then its rank there.
    """
    tagged = [x.select("qid", "id", F.col("rank").cast("int").alias("r"), F.lit(i).alias("list")) for i, x in enumerate(lists)]
    rows = reduce(DataFrame.unionByName, tagged)
    fused = rows.groupBy("qid", "id").agg(
        F.round(F.sum(1 / (F.lit(float(k)) + F.col("r"))), 12).alias("score"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("list", "r")))).alias("ranks"), F.min(F.struct("list", "r")).alias("_seen"))
    return _ranked(fused, top, "_seen").drop("_seen")


def min_max(ranked: DataFrame) -> DataFrame:
    """Scores of each query's list from 0 to 1; all 1 where they are equal."""
    w = Window.partitionBy("qid")
    low, high = F.min("score").over(w), F.max("score").over(w)
    return ranked.withColumn("score", F.when(high == low, 1.0).otherwise(F.try_divide(F.col("score") - low, high - low)))


def weighted_fusion(vector: DataFrame, keyword: DataFrame, alpha: float = 0.5, top: int = 10) -> DataFrame:
    """(qid, id, score, rank): alpha of the vector score and the rest of the keyword score, each min-max scaled; what a list lacks counts 0."""
    v = min_max(vector).select("qid", "id", (F.col("score") * alpha).alias("_v"), F.col("rank").alias("_vr"))
    k = min_max(keyword).select("qid", "id", (F.col("score") * (1 - alpha)).alias("_k"), F.col("rank").alias("_kr"))
    both = v.join(k, ["qid", "id"], "full").withColumn("score", F.round(F.coalesce("_v", F.lit(0.0)) + F.coalesce("_k", F.lit(0.0)), 12))
    first = F.struct(F.col("_vr").isNull().alias("a"), F.coalesce("_vr", "_kr").alias("b"))
    return _ranked(both.withColumn("_seen", first), top, "_seen").select("qid", "id", "score", "rank")


def rerank(candidates: DataFrame, score: Callable[[DataFrame], DataFrame] | Column, top: int = 5) -> DataFrame:
    """The candidates of each query by another score (a column, or a function that adds rerank_score); of equal ones the better ranked."""
    scored = score(candidates) if callable(score) else candidates.withColumn("rerank_score", score)
    w = Window.partitionBy("qid").orderBy(F.col("rerank_score").desc(), "rank", "id")
    return scored.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= top).drop("rank").withColumnRenamed("_r", "rank")


def coverage_and_cosine(candidates: DataFrame, question: str = "question", text: str = "text", similarity: str = "cosine") -> DataFrame:
    """rerank_score: half the query's coverage by the text, half the min-max scaled similarity among the query's candidates."""
    w = Window.partitionBy("qid")
    low, high = F.min(similarity).over(w), F.max(similarity).over(w)
    scaled = F.when(high == low, 1.0).otherwise(F.try_divide(F.col(similarity) - low, high - low))
    return candidates.withColumn("rerank_score", F.round(0.5 * coverage(tokenize(question), tokenize(text)) + 0.5 * scaled, DIGITS))


def coverage_and_prior(candidates: DataFrame, question: str = "question", text: str = "text") -> DataFrame:
    """rerank_score: coverage plus a prior that falls by a tenth a rank."""
    return candidates.withColumn("rerank_score", F.round(coverage(tokenize(question), tokenize(text)) + (1 - (F.col("rank") - 1) / 10), DIGITS))


def movement(ranked: DataFrame, reference: DataFrame) -> DataFrame:
    """ranked with before (rank in the reference list), moved (up is positive) and mark: new, up, down or same."""
    before = reference.select("qid", "id", F.col("rank").alias("before"))
    moved = F.col("before") - F.col("rank")
    mark = F.when(F.col("before").isNull(), "new").when(moved > 0, "up").when(moved < 0, "down").otherwise("same")
    return ranked.join(before, ["qid", "id"], "left").select("qid", "id", "rank", "before", moved.alias("moved"), mark.alias("mark"))


def score_range(ranked: DataFrame) -> DataFrame:
    return ranked.groupBy("qid").agg(F.min("score").alias("low"), F.max("score").alias("high"), F.count(F.lit(1)).alias("n"))


def hybrid_or_keyword(keyword: DataFrame, vector: DataFrame | None, top: int = 10) -> DataFrame:
    """Fused lists, or the keyword list alone where vectors aren't to be had."""
    return keyword if vector is None else reciprocal_rank_fusion([keyword, vector], top=top).drop("ranks")
