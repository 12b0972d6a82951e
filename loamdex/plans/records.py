"""Plans over structured records: filters, relaxation, search timing, set scores, JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamdex.functions.text import tokenize
from loamdex.operators import selfquery
from loamdex.operators.metrics import set_score
from loamdex.operators.retrieval import Bm25Index
from loamdex.operators.validators import json_error, parsed
from loamdex.sources.readers import latest, table

QUERIES, SQL = {}, {}


def plan(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _parts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part")


@plan("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def self_query_eq(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").filter(selfquery.predicate({"status": "F"}, {"status": "o_orderstatus"})).select("o_orderkey", "o_orderstatus")


@plan("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey IN (1, 3) AND n_nationkey >= 5")
def self_query_in(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "nation").filter(selfquery.predicate({"n_regionkey": {"in": [1, 3]}, "n_nationkey": {"gte": 5}})).select("n_nationkey", "n_name")


@plan("SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 20")
def self_query_range(spark: SparkSession, folder: str) -> DataFrame:
    return _parts(spark, folder).filter(selfquery.predicate({"p_size": {"gte": 10, "lte": 20}})).select("p_partkey", "p_size")


WANTED = {"type": "F", "professor": "nobody", "credits": {"gte": 100_000}}
AS = {"type": "o_orderstatus", "professor": "o_orderpriority", "credits": "o_totalprice"}


@plan("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 100000")
def self_query_relax(spark: SparkSession, folder: str) -> DataFrame:
    """No order has the priority that is asked for, so that condition goes first."""
    orders = table(spark, folder, "orders")
    kept, _ = selfquery.relax(orders, WANTED, columns=AS)
    return orders.filter(selfquery.predicate(kept, AS)).select("o_orderkey")


@plan("SELECT p_partkey, list_filter([CASE WHEN NOT p_size >= 25 THEN 'p_size' END, CASE WHEN NOT p_partkey <= 100 THEN 'p_partkey' END], lambda x: x IS NOT NULL) AS failed FROM part")
def violated_conditions(spark: SparkSession, folder: str) -> DataFrame:
    return _parts(spark, folder).select("p_partkey", selfquery.violations({"p_size": {"gte": 25}, "p_partkey": {"lte": 100}}).alias("failed"))


_RANKED = r"""
d AS (SELECT doc_id, lang, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS t FROM documents),
p AS MATERIALIZED (SELECT doc_id, len(t) AS len, term, count(*) AS tf FROM (SELECT doc_id, t, unnest(t) AS term FROM d) GROUP BY ALL),
s AS (SELECT count(*) AS n, sum(len(t)) / count(*) AS avg FROM d), f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
r AS MATERIALIZED (SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg))), 9) AS score FROM p JOIN f USING (term), s WHERE term IN ('license', 'released') GROUP BY doc_id)"""


@plan(f"""WITH {_RANKED}, pre AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC NULLS LAST, doc_id) AS rank FROM documents LEFT JOIN r USING (doc_id) WHERE lang = 'en' QUALIFY rank <= 10),
top AS (SELECT doc_id, score FROM r ORDER BY score DESC, doc_id LIMIT 10), post AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM top JOIN documents USING (doc_id) WHERE lang = 'en')
SELECT 'pre' AS timing, doc_id AS id, rank FROM pre UNION ALL SELECT 'post', doc_id, rank FROM post""")
def prefilter_vs_postfilter(spark: SparkSession, folder: str) -> DataFrame:
    """The same question, filtered before and after the ten best are taken."""
    docs = table(spark, folder, "documents").withColumn("ord", F.col("doc_id"))
    asked = spark.createDataFrame([(0, "license released")], "qid int, question string")
    ranking = Bm25Index.build(docs, only=Bm25Index.terms(asked)).scores(asked).select("id", "score")
    question = {"query": "license released", "intent": "search", "filter": {"lang": "en"}}
    found = [selfquery.search(docs, ranking, question, 10, t, id="doc_id").select(F.lit(t).alias("timing"), "id", "rank") for t in ("pre", "post")]
    return found[0].unionByName(found[1])


@plan("""WITH g AS (SELECT o_custkey, list(o_orderkey) FILTER (o_orderstatus = 'F') AS gold, list(o_orderkey) FILTER (o_totalprice >= 200000) AS got FROM orders GROUP BY o_custkey), h AS (SELECT o_custkey, coalesce(gold, []) AS gold, coalesce(got, []) AS got FROM g)
SELECT o_custkey, len(list_intersect(got, gold)) AS hits, CASE WHEN len(got) = 0 THEN CASE WHEN len(gold) = 0 THEN 1.0 ELSE 0.0 END ELSE round(len(list_intersect(got, gold)) / CAST(len(got) AS DOUBLE), 9) END AS precision,
CASE WHEN len(gold) > 0 THEN round(len(list_intersect(got, gold)) / CAST(len(gold) AS DOUBLE), 9) END AS recall FROM h""")
def set_precision_recall(spark: SparkSession, folder: str) -> DataFrame:
    """Dear orders as an answer to which orders of a customer are finished."""
    pick = lambda c: F.collect_list(F.when(c, F.col("o_orderkey")))
    rows = table(spark, folder, "orders").groupBy("o_custkey").agg(pick(F.col("o_orderstatus") == "F").alias("gold"), pick(F.col("o_totalprice") >= 200_000).alias("got"))
    return rows.select("o_custkey", set_score(F.col("got"), F.col("gold")).alias("s")).select("o_custkey", "s.hits", F.round("s.precision", 9).alias("precision"), F.round("s.recall", 9).alias("recall"))


@plan("SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events")
def json_props(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select("event_id", F.try_variant_get(parsed("props"), "$.k", "int").alias("k"))


@plan("SELECT event_id, event_id % 7 <> 0 AS ok, CASE WHEN event_id % 7 = 0 THEN 1 END AS line FROM events")
def json_errors(spark: SparkSession, folder: str) -> DataFrame:
    """Every seventh object loses its last brace."""
    broken = F.when(F.col("event_id") % 7 == 0, F.expr("left(props, length(props) - 1)")).otherwise(F.col("props"))
    return table(spark, folder, "events").select("event_id", json_error(broken).alias("e")).select("event_id", "e.ok", "e.line")


@plan("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) = 1")
def latest_per_key(spark: SparkSession, folder: str) -> DataFrame:
    return latest(table(spark, folder, "events"), "user_id", "ts").select("user_id", "event_id")


@plan(r"""SELECT p_partkey, len(regexp_extract_all(lower(p_name), '[\p{L}\p{N}]+')) AS n FROM part""")
def record_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return _parts(spark, folder).select("p_partkey", F.size(tokenize("p_name")).alias("n"))
