"""Retrieval metrics over runs (qid, rank, id) and judgements (qid, id[, gain]), all queries at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamdex.functions.text import document_of
from loamdex.operators.retrieval import small


def ideal_gain(relevant: DataFrame, k: int) -> DataFrame:
    """(qid, ideal, n_rel): the gains in their best order, cut at k."""
    w = Window.partitionBy("qid").orderBy(F.col("gain").desc(), "id")
    order = relevant.withColumn("_i", F.row_number().over(w))
    return order.groupBy("qid").agg(F.sum(F.when(F.col("_i") <= k, F.col("gain") / F.log2(F.col("_i") + 1)).otherwise(0.0)).alias("ideal"), F.count(F.lit(1)).alias("n_rel"))


def per_query(runs: DataFrame, relevant: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(qid, recall, precision, hit, rr, rr_at_k, ndcg, n_rel), a row for each of queries.

    Precision divides by k however short the list is, and is 0 for an empty one; without relevant
    ids, recall and nDCG are 0. rr looks at the whole list, rr_at_k at the first k.
    """
    rel = (relevant if "gain" in relevant.columns else relevant.withColumn("gain", F.lit(1.0))).select("qid", "id", "gain")
    met = runs.select("qid", "id", "rank").join(rel, ["qid", "id"])
    top = F.col("rank") <= k
    found = met.groupBy("qid").agg(
        F.count_if(top).alias("hits"), F.min("rank").alias("first"), F.sum(F.when(top, F.col("gain") / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"))
    out = queries.select("qid").join(found, "qid", "left").join(ideal_gain(rel, k), "qid", "left")
    hits = F.coalesce("hits", F.lit(0))
    rr = F.coalesce(1 / F.col("first"), F.lit(0.0))
    return out.select(
        "qid", F.coalesce(hits / F.col("n_rel"), F.lit(0.0)).alias("recall"), (hits / F.lit(float(k))).alias("precision"), (hits > 0).cast("int").alias("hit"), rr.alias("rr"),
        F.when(F.col("first") <= k, rr).otherwise(0.0).alias("rr_at_k"), F.coalesce(F.try_divide("dcg", "ideal"), F.lit(0.0)).alias("ndcg"), F.coalesce("n_rel", F.lit(0)).alias("n_rel"))


def evaluate(runs: DataFrame, relevant: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """One row of means: recall, precision, hit, mrr, mrr_at_k, ndcg, and n; zeros without queries."""
    mean = lambda c, n: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(n)
    return per_query(runs, relevant, queries, k).agg(mean("recall", "recall"), mean("precision", "precision"), mean("hit", "hit"), mean("rr", "mrr"), mean("rr_at_k", "mrr_at_k"), mean("ndcg", "ndcg"), F.count(F.lit(1)).alias("n"))


def wilson(hits: Column, n: Column, z: float = 1.96) -> Column:
    """(low, high) of the 95 % interval of a share; zeros for no trials."""
    m = F.when(n == 0, 1).otherwise(n)
    p, d = hits / m, 1 + z * z / m
    centre, half = (p + z * z / (2 * m)) / d, z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m)) / d
    none = n == 0
    return F.struct(F.when(none, 0.0).otherwise(F.greatest(F.lit(0.0), centre - half)).alias("low"), F.when(none, 0.0).otherwise(F.least(F.lit(1.0), centre + half)).alias("high"))


def first_of_documents(runs: DataFrame) -> DataFrame:
    """Chunk lists as document lists: the first chunk of a document stands for it, later ones keep their rank but no id."""
    w = Window.partitionBy("qid", F.col("_doc")).orderBy("rank")
    r = runs.withColumn("_doc", document_of(F.col("id").cast("string")))
    return r.withColumn("id", F.when(F.row_number().over(w) == 1, F.col("_doc"))).drop("_doc")


def label_run(runs: DataFrame, chunks: DataFrame, evidence: DataFrame, mode: str = "chunk") -> tuple[DataFrame, DataFrame]:
    """(runs, relevant) in evidence units, each credited once, at its first chunk.

    runs (qid, id, rank); chunks (id, doc, text); evidence (qid, ev, doc, quote), ev counting from 0.
    In chunk mode a unit is a quote, met by a chunk of its document that holds it; in doc mode a document.
    """
    unit = F.concat(F.lit("doc:"), "doc") if mode == "doc" else F.concat(F.lit("ev:"), F.col("ev").cast("string"))
    runs = small(runs)
    hit = chunks.select("id", F.col("doc").cast("string").alias("doc"), "text").join(runs, "id").join(evidence.withColumn("doc", F.col("doc").cast("string")), ["qid", "doc"])
    if mode != "doc":
        hit = hit.filter(F.contains("text", "quote"))
    first = hit.groupBy("qid", "id", "rank").agg(F.min_by(unit, "ev").alias("unit"))
    once = first.withColumn("_n", F.row_number().over(Window.partitionBy("qid", "unit").orderBy("rank"))).filter("_n = 1").select("qid", "rank", "unit")
    labelled = runs.join(once, ["qid", "rank"], "left").select("qid", "rank", F.coalesce("unit", F.col("id").cast("string")).alias("id"))
    return labelled, evidence.withColumn("doc", F.col("doc").cast("string")).select("qid", unit.alias("id")).distinct()


def never_whole(chunks: DataFrame, evidence: DataFrame) -> DataFrame:
    """qids none of whose quotes any chunk holds: cut apart before retrieval could find them."""
    held = evidence.join(chunks.select("doc", "text"), "doc").filter(F.contains("text", "quote")).select("qid").distinct()
    return evidence.select("qid").distinct().join(held, "qid", "left_anti")


def set_score(retrieved: Column, gold: Column) -> Column:
    """(hits, precision, recall) of arrays as sets. For an empty gold set, precision is 1 only for an empty answer, recall null."""
    hits = F.size(F.filter(retrieved, lambda x: F.array_contains(gold, x)))
    empty, none = F.size(gold) == 0, F.size(retrieved) == 0
    precision = F.when(none, F.when(empty, 1.0).otherwise(0.0)).otherwise(hits / F.when(none, 1).otherwise(F.size(retrieved)))
    return F.struct(hits.alias("hits"), precision.alias("precision"), F.when(~empty, hits / F.when(empty, 1).otherwise(F.size(gold))).alias("recall"))


def regression(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """(qid, before, now) of queries whose hit changed or that only one side has."""
    return baseline.select("qid", F.col("hit").alias("before")).join(current.select("qid", F.col("hit").alias("now")), "qid", "full").filter(~F.col("before").eqNullSafe(F.col("now")))


def before_after(before: DataFrame, after: DataFrame, k: int) -> DataFrame:
    """(qid, before, after, change) of ranks; a missing rank counts as k + 1."""
    b = before.select("qid", F.col("rank").alias("before")).join(after.select("qid", F.col("rank").alias("after")), "qid", "full")
    x, y = F.coalesce("before", F.lit(k + 1)), F.coalesce("after", F.lit(k + 1))
    return b.withColumn("change", F.when(y < x, "improved").when(y > x, "worse").otherwise("same"))


def team_scores(submissions: DataFrame, golden: DataFrame, k: int) -> DataFrame:
    """Per team: recall, mrr, ndcg, hit over documents at k, cite (any citation) and cite_ok (one of a relevant document).

    submissions (team, qid, retrieved, citations arrays of ids); golden (qid, docs array). Missing questions score 0.
    """
    # each question once for each team; documents of a question may be many, so they only meet what a team gave
    teams = submissions.agg(F.collect_set("team").alias("_teams"))
    full = golden.select("qid", "docs").join(F.broadcast(teams)).select(F.explode("_teams").alias("team"), "qid", "docs").join(submissions, ["team", "qid"], "left")
    rows = full.select(F.struct("team", "qid").alias("qid"), "docs", "retrieved", "citations")
    runs = first_of_documents(rows.select("qid", F.posexplode("retrieved").alias("rank", "id")).withColumn("rank", F.col("rank") + 1)).filter(F.col("rank") <= k).filter("id is not null")
    scored = per_query(runs, rows.select("qid", F.explode(F.array_distinct("docs")).alias("id")), rows, k)
    cites = rows.select("qid", (F.coalesce(F.size("citations"), F.lit(0)) > 0).cast("int").alias("cite"), F.coalesce(F.exists("citations", lambda c: F.array_contains("docs", document_of(c))), F.lit(False)).cast("int").alias("cite_ok"))
    mean = lambda c, n=None: F.round(F.avg(c), 6).alias(n or c)
    return scored.join(cites, "qid").groupBy(F.col("qid.team").alias("team")).agg(mean("recall"), mean("rr_at_k", "mrr"), mean("ndcg"), mean("hit"), mean("cite"), mean("cite_ok"))


def failed_by_all(hits: DataFrame) -> DataFrame:
    """qids without a hit by any team. hits (team, qid, hit)."""
    return hits.groupBy("qid").agg(F.max("hit").alias("_best")).filter("_best = 0").select("qid")


def board(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows with best_<column>: whether the row has the column's highest value."""
    top = rows.agg(*[F.max(c).alias(f"_{c}") for c in columns])
    return rows.join(F.broadcast(top)).select(*rows.columns, *[(F.col(c) == F.col(f"_{c}")).alias(f"best_{c}") for c in columns])


def board_notes(rows: DataFrame, score: str, questions: int) -> DataFrame:
    """One row: mixed_k, mixed_mode, close (the two best are within one question). rows (k, mode, score)."""
    best = F.sort_array(F.collect_list(score), asc=False)
    return rows.agg((F.count_distinct("k") > 1).alias("mixed_k"), (F.count_distinct("mode") > 1).alias("mixed_mode"), (F.get(best, F.lit(0)) - F.get(best, F.lit(1)) <= 1 / questions + 1e-9).alias("close"))


def cost(tokens: Column, window: int, price: float, per: int = 1_000_000) -> Column:
    """(share of the window, price) of a prompt."""
    return F.struct((tokens / window).alias("share"), (tokens * price / per).alias("price"))


def mean_of(metrics: list[DataFrame], names: list[str]) -> DataFrame:
    """One row a configuration, named."""
    return reduce(DataFrame.unionByName, [m.withColumn("config", F.lit(n)) for m, n in zip(metrics, names)])


def sorted_board(rows: DataFrame, by: str, name: str, descending: bool = True, locale: str = "ko") -> DataFrame:
    """rows by a column, equal ones by name in the order of a language."""
    first = F.col(by).desc() if descending else F.col(by).asc()
    return rows.orderBy(first, F.collate(F.col(name), locale))


def broken_first(docs: DataFrame, kind: str = "type", ord: str = "ord") -> DataFrame:
    """Damaged documents before the others, each in data order."""
    return docs.orderBy((F.col(kind) == "broken").desc_nulls_last(), ord)
