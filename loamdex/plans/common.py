"""Inputs that several plans share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamdex.functions.text import sentences
from loamdex.operators.matching import containing
from loamdex.operators.retrieval import Bm25Index
from loamdex.session import dealt
from loamdex.sources.readers import table


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return dealt(table(spark, folder, "documents"))


def questions(spark: SparkSession, folder: str) -> DataFrame:
    """(qid, question): the first sentence of each benchmark passage, so that evidence and question differ."""
    return table(spark, folder, "benchmark").select(F.col("item_id").alias("qid"), F.get(sentences("text"), F.lit(0)).alias("question"))


def evidence(spark: SparkSession, folder: str) -> DataFrame:
    """(qid, id): documents that hold a passage whole."""
    return containing(documents(spark, folder), table(spark, folder, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("quote")))


def keyword_index(spark: SparkSession, folder: str, k1: float = 1.5, b: float = 0.75) -> Bm25Index:
    return Bm25Index.build(documents(spark, folder), k1=k1, b=b)


def runs(spark: SparkSession, folder: str, k: int = 10, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    return several_runs(spark, folder, [(k1, b)], k)[0]


def several_runs(spark: SparkSession, folder: str, settings: list[tuple[float, float]], k: int = 10) -> list[DataFrame]:
    """One ranked list for each (k1, b): texts are cut into words once, the settings only enter into scores."""
    asked = questions(spark, folder)
    index = Bm25Index.build(documents(spark, folder), only=Bm25Index.terms(asked))
    return [index.with_(k1, b).search(asked, k) for k1, b in settings]


def registry():
    """(QUERIES, SQL, plan) of a module; plan(sql) registers a query beside its SQL."""
    queries, sql_of = {}, {}

    def plan(sql: str | None = None):
        def register(f):
            queries[f.__name__] = f
            if sql:
                sql_of[f.__name__] = sql
            return f

        return register

    return queries, sql_of, plan


#: The same in SQL.
SENTENCE_SQL = r"regexp_replace({0}, '[.!?。]+[\"'')\]]?(?:\s+|$)|\n+', '\0' || chr(1), 'g')"
QUESTIONS_SQL = r"""questions AS (SELECT item_id AS qid, string_split(regexp_replace(text, '[.!?。]+["'')\]]?(?:\s+|$)|\n+', '\0' || chr(1), 'g'), chr(1))[1] AS question FROM benchmark)"""


def runs_sql(name: str = "run", k: int = 10, k1: float = 1.5, b: float = 0.75) -> str:
    """CTEs up to ranked lists (qid, id, score, rank); needs questions."""
    p = name
    return rf"""
{p}_t AS MATERIALIZED (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS t FROM documents),
{p}_q AS (SELECT DISTINCT qid, term FROM (SELECT qid, unnest(regexp_extract_all(lower(question), '[\p{{L}}\p{{N}}]+')) AS term FROM questions)),
{p}_p AS MATERIALIZED (SELECT doc_id, term, len, count(*) AS tf FROM (SELECT doc_id, len(t) AS len, unnest(t) AS term FROM {p}_t) GROUP BY ALL),
{p}_s AS (SELECT count(*) AS n, sum(len(t)) / count(*) AS avg FROM {p}_t),
{p}_f AS (SELECT term, count(*) AS df FROM {p}_p GROUP BY term),
{p}_c AS (
  SELECT qid, doc_id AS id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * {k1 + 1} / (tf + {k1} * (1 - {b} + {b} * len / avg))), 9) AS score
  FROM {p}_q JOIN {p}_p USING (term) JOIN {p}_f USING (term), {p}_s GROUP BY qid, doc_id),
{name} AS MATERIALIZED (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM {p}_c WHERE score > 0 QUALIFY rank <= {k})"""


EVIDENCE_SQL = "evidence AS MATERIALIZED (SELECT item_id AS qid, doc_id AS id FROM benchmark JOIN documents ON contains(documents.text, benchmark.text))"
