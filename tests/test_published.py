"""Published figures of the baseline, on literals that are re-typed here."""

import pytest
from pyspark.sql import functions as F

from loamdex.functions import text as T
from loamdex.functions import vectors as V
from loamdex.operators import fusion, metrics
from loamdex.operators.chunking import ChunkConfig, chunk, overlap_cost, overlap_formula
from loamdex.operators.metrics import cost, per_query
from loamdex.operators.retrieval import Bm25Index, break_even, verdict


def test_overlap_cost(spark):
    docs = spark.createDataFrame([(1, "x" * 30_000)], "doc_id int, text string")
    plain = overlap_cost(chunk(docs, ChunkConfig("fixed", 300, 0)), docs).first()
    lapped = overlap_cost(chunk(docs, ChunkConfig("fixed", 300, 60)), docs).first()
    assert (plain.chunks, lapped.chunks, lapped.chunk_chars) == (100, 125, 37_440) and round(lapped.extra, 3) == 0.248
    assert round(overlap_formula(100, 40), 2) == 0.67


def test_idf_and_saturation(spark):
    """N = 37, one text with the term, once, of 41 tokens at a mean of 74.6: 3.232 * 1.254 = 4.05."""
    texts = [(0, "rare " + "a " * 40)] + [(i, "b " * (75 if i < 27 else 77)) for i in range(1, 37)]
    index = Bm25Index.build(spark.createDataFrame(texts, "doc_id int, text string"))
    rows = {r.term: r for r in index.idf().collect()}
    assert round(rows["rare"].idf, 3) == 3.232 and abs(rows["rare"].avg - 74.6) < 0.1
    score = index.search(spark.createDataFrame([(1, "rare")], "qid int, question string"), 1).first().score
    assert round(score, 2) == 4.05


def test_reciprocal_ranks(spark):
    lists = [spark.createDataFrame([(1, x, 0.0, i + 1) for i, x in enumerate(ids)], "qid int, id string, score double, rank int") for ids in (["p", "x1", "x2", "x3", "x4", "x5", "q"], ["q", "y1", "y2", "y3", "y4", "y5", "p"])]
    top = fusion.reciprocal_rank_fusion(lists).filter("id in ('p', 'q')").collect()
    assert [round(r.score, 4) for r in top] == [0.0313, 0.0313]


def test_softmax_table(spark):
    logits = spark.createDataFrame([(1, 2.0), (1, 1.0), (1, 0.5)], "g int, x double")
    table = {0.2: [99.3, 0.7, 0.1], 1.0: [62.9, 23.1, 14.0], 2.0: [48.1, 29.2, 22.7]}
    for t, expected in table.items():
        assert [round(100 * r.p, 1) for r in logits.select("x", V.softmax("x", t, ["g"]).alias("p")).orderBy(F.desc("x")).collect()] == expected


@pytest.mark.parametrize("rank, gain", [(1, 1.0), (2, 0.63), (3, 0.5)])
def test_ndcg_weights(spark, rank, gain):
    runs = spark.createDataFrame([(1, rank, "d")], "qid int, rank int, id string")
    rel = spark.createDataFrame([(1, "d")], "qid int, id string")
    assert round(per_query(runs, rel, rel, 5).first().ndcg, 2) == gain


def test_context_share(spark):
    row = spark.range(1).select(T.window_share(F.lit(8848), 8192).alias("s"), cost(F.lit(8848), 8192, 1.0).alias("c")).first()
    assert round(row.s, 2) == 1.08 and round(row.c.share, 2) == 1.08


def test_hit_rates(spark):
    """11 of 12 and 9 of 12 questions, and what changed between the two runs."""
    questions = spark.createDataFrame([(f"q{i:02d}",) for i in range(1, 13)], "qid string")
    rel = questions.select("qid", F.concat(F.lit("d"), "qid").alias("id"))
    found = lambda missed: rel.filter(~F.col("qid").isin(*missed)).withColumn("rank", F.lit(2))
    first, second = found(["q10"]), found(["q07", "q09", "q10"])
    assert metrics.evaluate(first, rel, questions, 3).first().hit == 0.916667 and metrics.evaluate(second, rel, questions, 3).first().hit == 0.75
    changed = metrics.regression(per_query(second, rel, questions, 3), per_query(first, rel, questions, 3))
    assert sorted(r.qid for r in changed.collect()) == ["q07", "q09"]


def test_dot_and_cosine(spark):
    """2 - 2 cos is the squared distance of unit vectors."""
    row = spark.createDataFrame([([0.6, 0.8], [0.8, 0.6])], "a array<double>, b array<double>").select(V.cosine("a", "b").alias("c"), V.euclid("a", "b").alias("e")).first()
    assert abs(row.e**2 - (2 - 2 * row.c)) < 1e-12 and round(row.c, 2) == 0.96


def test_index_verdicts():
    assert verdict(0.89, 9) == "inaccurate" and verdict(0.9, 1.49) == "not faster" and verdict(0.9, 1.5) == "good"
    assert break_even(10.0, 0.5, 0.1) == 25 and break_even(10.0, 0.1, 0.5) is None
