"""Plans over keyword and vector search, fusion, reranking and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamdex.functions.text import coverage, tokenize
from loamdex.functions.vectors import pca2, project2, ranked_neighbours, similarity_pairs, topic_metrics, toy_embedding
from loamdex.operators import answers, fusion, metrics
from loamdex.operators.embedding import off_diagonal_scale
from loamdex.operators.impacts import ImpactIndex
from loamdex.operators.quantised import QuantisedIndex
from loamdex.operators.retrieval import Bm25Index, GraphIndex, IvfIndex, list_recall, sweep, vector_search
from loamdex.plans.common import EVIDENCE_SQL, QUESTIONS_SQL, documents, evidence, keyword_index, questions, runs, runs_sql, several_runs
from loamdex.session import stored
from loamdex.sources.readers import table

QUERIES, SQL = {}, {}


def plan(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _round(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if c in columns else c for c in df.columns])


EVALUATED = """
met AS (SELECT run.qid, run.rank FROM run JOIN evidence USING (qid, id)),
n_rel AS (SELECT qid, count(*) AS n_rel FROM evidence GROUP BY qid),
per AS (
  SELECT questions.qid, coalesce(count(met.rank) / CAST(any_value(n_rel) AS DOUBLE), 0) AS recall, count(met.rank) / 10.0 AS precision, CASE WHEN count(met.rank) > 0 THEN 1 ELSE 0 END AS hit,
    coalesce(1.0 / min(met.rank), 0) AS rr, coalesce(sum(1 / log2(met.rank + 1)) / (SELECT sum(1 / log2(i + 1)) FROM unnest(generate_series(1, least(10, any_value(n_rel)))) AS u(i)), 0) AS ndcg
  FROM questions LEFT JOIN met USING (qid) LEFT JOIN n_rel USING (qid) GROUP BY questions.qid)"""


@plan(f"WITH {QUESTIONS_SQL}, {EVIDENCE_SQL}, {runs_sql()}, {EVALUATED} SELECT round(avg(recall), 6) AS recall, round(avg(precision), 6) AS precision, round(avg(hit), 6) AS hit, round(avg(rr), 6) AS mrr, round(avg(rr), 6) AS mrr_at_k, round(avg(ndcg), 6) AS ndcg, count(*) AS n FROM per")
def bm25_evaluation(spark: SparkSession, folder: str) -> DataFrame:
    """Keyword search for each benchmark question, scored at 10; questions without evidence score 0."""
    return metrics.evaluate(runs(spark, folder), evidence(spark, folder), questions(spark, folder), 10)


@plan("WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS t FROM documents) SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct FROM t")
def tokenize_counts(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).select("doc_id", tokenize("text").alias("t")).select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"))


@plan("SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM documents) GROUP BY term")
def bm25_df(spark: SparkSession, folder: str) -> DataFrame:
    return keyword_index(spark, folder).frequencies


@plan(f"WITH {QUESTIONS_SQL}, {runs_sql()} SELECT qid, id, round(score, 6) AS score, rank FROM run")
def bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
    return _round(runs(spark, folder), "score").select("qid", "id", "score", "rank")


def _impacts(spark: SparkSession, folder: str) -> ImpactIndex:
    """Blocks of eight consecutive ids."""
    index = Bm25Index.build(documents(spark, folder), only=Bm25Index.terms(questions(spark, folder)))
    return ImpactIndex.build(index, F.floor(F.col("id") / 8))


@plan(f"WITH {QUESTIONS_SQL}, {runs_sql()} SELECT qid, id, round(score, 6) AS score, rank FROM run")
def bm25_pruned(spark: SparkSession, folder: str) -> DataFrame:
    """The same lists from the blocks that can reach them."""
    return _round(_impacts(spark, folder).search(questions(spark, folder), 10), "score").select("qid", "id", "score", "rank")


@plan(rf"""WITH {QUESTIONS_SQL}, {runs_sql()},
posting AS MATERIALIZED (SELECT qid, doc_id AS id, doc_id // 8 AS block, term, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf, tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg)) AS impact
  FROM run_q JOIN run_p USING (term) JOIN run_f USING (term), run_s),
bounded AS (SELECT qid, block, round(sum(idf * most), 9) AS bound FROM (SELECT qid, block, term, any_value(idf) AS idf, max(impact) AS most FROM posting GROUP BY ALL) GROUP BY qid, block),
rare AS (SELECT qid, term FROM (SELECT DISTINCT qid, term, df FROM run_q JOIN run_f USING (term)) WINDOW w AS (PARTITION BY qid ORDER BY df, term) QUALIFY sum(df) OVER w <= 640 OR row_number() OVER w = 1),
partly AS (SELECT qid, block, id, round(sum(idf * impact), 9) AS s FROM posting JOIN rare USING (qid, term) GROUP BY ALL),
first AS (SELECT DISTINCT qid, block FROM (SELECT * FROM partly WHERE s > 0 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) <= 40)),
best AS (SELECT qid, round(sum(idf * impact), 9) AS score FROM posting JOIN first USING (qid, block) GROUP BY qid, id),
least AS (SELECT qid, score FROM best WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC) = 10)
SELECT qid, count(*) AS blocks, count(*) FILTER (first.block IS NOT NULL OR least.score IS NULL OR bound + 2e-9 >= least.score) AS scored FROM bounded LEFT JOIN first USING (qid, block) LEFT JOIN least USING (qid) GROUP BY qid""")
def bm25_blocks_read(spark: SparkSession, folder: str) -> DataFrame:
    return _impacts(spark, folder).counted(questions(spark, folder), 10)


@plan(f"WITH {QUESTIONS_SQL}, {runs_sql()} SELECT qid, round(min(score), 6) AS low, round(max(score), 6) AS high, count(*) AS n FROM run GROUP BY qid")
def score_range(spark: SparkSession, folder: str) -> DataFrame:
    return _round(fusion.score_range(runs(spark, folder)), "low", "high")


TWO = f"{QUESTIONS_SQL}, {runs_sql('run')}, {runs_sql('flat', 10, 1.2, 0.0)}"
FUSED = """
listed AS (SELECT qid, id, rank AS r, 0 AS list FROM run UNION ALL SELECT qid, id, rank, 1 FROM flat),
fused AS (SELECT qid, id, round(sum(1 / (60.0 + r)), 12) AS score, min(list * 1000 + r) AS seen FROM listed GROUP BY qid, id),
rrf AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, seen, id) AS rank FROM fused QUALIFY rank <= 10)"""


def _two(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Ranked lists with and without length normalisation."""
    a, b = several_runs(spark, folder, [(1.5, 0.75), (1.2, 0.0)])
    return a, b


@plan(f"WITH {TWO}, {FUSED} SELECT qid, id, round(score, 9) AS score, rank FROM rrf")
def rrf_fusion(spark: SparkSession, folder: str) -> DataFrame:
    return _round(fusion.reciprocal_rank_fusion([*_two(spark, folder)]).drop("ranks"), "score", digits=9).select("qid", "id", "score", "rank")


@plan(f"""WITH {TWO},
a AS (SELECT qid, id, rank, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1 ELSE (score - min(score) OVER w) / nullif(max(score) OVER w - min(score) OVER w, 0) END * 0.3 AS s FROM run WINDOW w AS (PARTITION BY qid)),
b AS (SELECT qid, id, rank, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1 ELSE (score - min(score) OVER w) / nullif(max(score) OVER w - min(score) OVER w, 0) END * 0.7 AS s FROM flat WINDOW w AS (PARTITION BY qid)),
m AS (SELECT coalesce(a.qid, b.qid) AS qid, coalesce(a.id, b.id) AS id, round(coalesce(a.s, 0) + coalesce(b.s, 0), 12) AS score, a.rank IS NULL AS late, coalesce(a.rank, b.rank) AS r FROM a FULL JOIN b ON a.qid = b.qid AND a.id = b.id)
SELECT qid, id, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY m.score DESC, late, r, id) AS rank FROM m QUALIFY rank <= 10""")
def weighted_fusion(spark: SparkSession, folder: str) -> DataFrame:
    return _round(fusion.weighted_fusion(*_two(spark, folder), alpha=0.3), "score")


@plan(f"""WITH {TWO} SELECT flat.qid, flat.id, flat.rank, run.rank AS before, run.rank - flat.rank AS moved,
CASE WHEN run.rank IS NULL THEN 'new' WHEN run.rank > flat.rank THEN 'up' WHEN run.rank < flat.rank THEN 'down' ELSE 'same' END AS mark FROM flat LEFT JOIN run USING (qid, id)""")
def rank_movement(spark: SparkSession, folder: str) -> DataFrame:
    a, b = _two(spark, folder)
    return fusion.movement(b, a)


COVER = r"""
t AS (SELECT qid, list_distinct(regexp_extract_all(lower(question), '[\p{L}\p{N}]+')) AS q FROM questions),
c AS (SELECT run.qid, run.id, run.rank, len(list_intersect(q, regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))) / CAST(len(q) AS DOUBLE) AS coverage FROM run JOIN t USING (qid) JOIN documents ON doc_id = id)"""


@plan(f"WITH {QUESTIONS_SQL}, {runs_sql()}, {COVER}, s AS (SELECT qid, id, rank AS r, round(coverage + (1 - (rank - 1) / 10.0), 9) AS s FROM c) SELECT qid, id, round(s, 6) AS rerank_score, row_number() OVER (PARTITION BY qid ORDER BY s DESC, r, id) AS rank FROM s QUALIFY rank <= 5")
def coverage_rerank(spark: SparkSession, folder: str) -> DataFrame:
    rows = runs(spark, folder).join(questions(spark, folder), "qid").join(documents(spark, folder).select(F.col("doc_id").alias("id"), "text"), "id")
    return _round(fusion.rerank(rows, fusion.coverage_and_prior).select("qid", "id", "rerank_score", "rank"), "rerank_score")


@plan(f"WITH {QUESTIONS_SQL}, {runs_sql()}, {COVER} SELECT qid, id, round(coverage, 6) AS coverage FROM c")
def query_coverage(spark: SparkSession, folder: str) -> DataFrame:
    rows = runs(spark, folder).join(questions(spark, folder), "qid").join(documents(spark, folder).select(F.col("doc_id").alias("id"), "text"), "id")
    return rows.select("qid", "id", F.round(coverage(tokenize("question"), tokenize("text")), 6).alias("coverage"))


@plan(f"WITH {QUESTIONS_SQL}, {EVIDENCE_SQL}, {runs_sql()}, {EVALUATED} SELECT qid, round(recall, 6) AS recall, round(precision, 6) AS precision, hit, round(rr, 6) AS rr, round(ndcg, 6) AS ndcg FROM per")
def metrics_per_question(spark: SparkSession, folder: str) -> DataFrame:
    out = metrics.per_query(runs(spark, folder), evidence(spark, folder), questions(spark, folder), 10)
    return _round(out.select("qid", "recall", "precision", "hit", "rr", "ndcg"), "recall", "precision", "rr", "ndcg")


@plan(f"""WITH {QUESTIONS_SQL}, {EVIDENCE_SQL}, {runs_sql()},
g AS (SELECT evidence.qid, id, 1 + coalesce(quality, 0) AS gain FROM evidence LEFT JOIN labels ON doc_id = id),
d AS (SELECT qid, sum(gain / log2(rank + 1)) AS dcg FROM run JOIN g USING (qid, id) WHERE rank <= 5 GROUP BY qid),
i AS (SELECT qid, sum(gain / log2(r + 1)) AS ideal FROM (SELECT qid, gain, row_number() OVER (PARTITION BY qid ORDER BY gain DESC, id) AS r FROM g) WHERE r <= 5 GROUP BY qid)
SELECT questions.qid, round(coalesce(dcg / ideal, 0), 6) AS ndcg FROM questions LEFT JOIN d USING (qid) LEFT JOIN i USING (qid)""")
def graded_ndcg(spark: SparkSession, folder: str) -> DataFrame:
    """Gains of 1, and 1 more for documents that are labelled good."""
    rel = evidence(spark, folder).join(table(spark, folder, "labels").select(F.col("doc_id").alias("id"), "quality"), "id", "left").select("qid", "id", (1 + F.coalesce("quality", F.lit(0))).cast("double").alias("gain"))
    return _round(metrics.per_query(runs(spark, folder), rel, questions(spark, folder), 5).select("qid", "ndcg"), "ndcg")


@plan(f"""WITH {QUESTIONS_SQL}, {EVIDENCE_SQL}, {runs_sql()}, {EVALUATED}, s AS (SELECT CAST(sum(hit) AS BIGINT) AS hits, count(*) AS n FROM per), p AS (SELECT *, hits / CAST(n AS DOUBLE) AS p, 1 + 1.96 * 1.96 / n AS d FROM s)
SELECT hits, n, round(greatest(0, (p + 1.96 * 1.96 / (2 * n)) / d - 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n * n)) / d), 6) AS low, round(least(1, (p + 1.96 * 1.96 / (2 * n)) / d + 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n * n)) / d), 6) AS high FROM p""")
def wilson_interval(spark: SparkSession, folder: str) -> DataFrame:
    out = metrics.per_query(runs(spark, folder), evidence(spark, folder), questions(spark, folder), 10).agg(F.sum("hit").alias("hits"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("w", metrics.wilson(F.col("hits"), F.col("n"))).select("hits", "n", F.round("w.low", 6).alias("low"), F.round("w.high", 6).alias("high"))


HITS = """
h1 AS (SELECT questions.qid, CASE WHEN count(e.id) > 0 THEN 1 ELSE 0 END AS hit, min(run.rank) FILTER (e.id IS NOT NULL) AS rank FROM questions LEFT JOIN run ON run.qid = questions.qid AND run.rank <= 3 LEFT JOIN evidence e ON e.qid = run.qid AND e.id = run.id GROUP BY questions.qid),
h2 AS (SELECT questions.qid, CASE WHEN count(e.id) > 0 THEN 1 ELSE 0 END AS hit, min(flat.rank) FILTER (e.id IS NOT NULL) AS rank FROM questions LEFT JOIN flat ON flat.qid = questions.qid AND flat.rank <= 3 LEFT JOIN evidence e ON e.qid = flat.qid AND e.id = flat.id GROUP BY questions.qid)"""


def _hits(spark: SparkSession, folder: str) -> list[DataFrame]:
    q, rel = questions(spark, folder), evidence(spark, folder)
    return [metrics.per_query(r.filter("rank <= 3"), rel, q, 3) for r in _two(spark, folder)]


@plan(f"WITH {TWO}, {EVIDENCE_SQL}, {HITS} SELECT qid, h1.hit AS before, h2.hit AS now FROM h1 JOIN h2 USING (qid) WHERE h1.hit <> h2.hit")
def regression_compare(spark: SparkSession, folder: str) -> DataFrame:
    a, b = _hits(spark, folder)
    return metrics.regression(b, a)


@plan(f"WITH {TWO}, {EVIDENCE_SQL}, {HITS} SELECT qid, h1.rank AS before, h2.rank AS after, CASE WHEN coalesce(h2.rank, 4) < coalesce(h1.rank, 4) THEN 'improved' WHEN coalesce(h2.rank, 4) > coalesce(h1.rank, 4) THEN 'worse' ELSE 'same' END AS change FROM h1 JOIN h2 USING (qid)")
def before_after(spark: SparkSession, folder: str) -> DataFrame:
    a, b = (h.select("qid", F.when(F.col("rr_at_k") > 0, F.round(1 / F.col("rr_at_k")).cast("int")).alias("rank")) for h in _hits(spark, folder))
    return metrics.before_after(a, b, 3)


@plan(f"WITH {TWO}, {EVIDENCE_SQL}, {HITS} SELECT qid FROM h1 JOIN h2 USING (qid) WHERE h1.hit = 0 AND h2.hit = 0")
def all_fail(spark: SparkSession, folder: str) -> DataFrame:
    a, b = _hits(spark, folder)
    return metrics.failed_by_all(a.select(F.lit("a").alias("team"), "qid", "hit").unionByName(b.select(F.lit("b").alias("team"), "qid", "hit")))


@plan(f"""WITH {TWO}, {EVIDENCE_SQL}, sub AS (SELECT 'a' AS team, * FROM run UNION ALL SELECT 'b', * FROM flat),
n_rel AS (SELECT qid, count(*) AS n_rel FROM evidence GROUP BY qid),
all_q AS (SELECT team, n_rel.qid, n_rel FROM n_rel, (VALUES ('a'), ('b')) AS t(team)),
m AS (SELECT sub.team, sub.qid, sub.rank FROM sub JOIN evidence USING (qid, id) WHERE rank <= 5),
per AS (SELECT all_q.team, all_q.qid, count(m.rank) / CAST(any_value(n_rel) AS DOUBLE) AS recall, coalesce(1.0 / min(m.rank), 0) AS rr, CASE WHEN count(m.rank) > 0 THEN 1 ELSE 0 END AS hit,
  coalesce(sum(1 / log2(m.rank + 1)) / (SELECT sum(1 / log2(i + 1)) FROM unnest(generate_series(1, least(5, any_value(n_rel)))) AS u(i)), 0) AS ndcg FROM all_q LEFT JOIN m USING (team, qid) GROUP BY all_q.team, all_q.qid),
c AS (SELECT all_q.team, all_q.qid, count(s.id) > 0 AS cite, count(e.id) > 0 AS ok FROM all_q LEFT JOIN sub s ON s.team = all_q.team AND s.qid = all_q.qid AND s.rank = 1 LEFT JOIN evidence e ON e.qid = s.qid AND e.id = s.id GROUP BY all_q.team, all_q.qid)
SELECT team, round(avg(recall), 6) AS recall, round(avg(rr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg, round(avg(hit), 6) AS hit, round(avg(CAST(cite AS INT)), 6) AS cite, round(avg(CAST(ok AS INT)), 6) AS cite_ok FROM per JOIN c USING (team, qid) GROUP BY team""")
def team_board(spark: SparkSession, folder: str) -> DataFrame:
    """Two systems as teams, over the questions that have evidence; each cites its first document."""
    a, b = _two(spark, folder)
    rows = a.withColumn("team", F.lit("a")).unionByName(b.withColumn("team", F.lit("b")))
    ids = F.sort_array(F.collect_list(F.struct("rank", F.col("id").cast("string").alias("id"))))["id"]
    sub = rows.groupBy("team", "qid").agg(ids.alias("retrieved")).withColumn("citations", F.slice("retrieved", 1, 1))
    golden = evidence(spark, folder).groupBy("qid").agg(F.collect_set(F.col("id").cast("string")).alias("docs"))
    return metrics.team_scores(sub, golden, 5)


# ---- vectors


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings")


def _asked(spark: SparkSession, folder: str) -> DataFrame:
    """Stated query set: ids divisible by 50."""
    return _vectors(spark, folder).filter("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), "embedding")


VECTORS_SQL = "v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), u AS MATERIALIZED (SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v)"


@plan(f"WITH {VECTORS_SQL}, s AS (SELECT q.vec_id AS qid, d.vec_id AS id, round(list_dot_product(q.e, d.e), 9) AS s FROM u q, u d WHERE q.vec_id % 50 = 0) SELECT qid, id, round(s, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) AS rank FROM s QUALIFY rank <= 10")
def vector_topk(spark: SparkSession, folder: str) -> DataFrame:
    return _round(vector_search(_vectors(spark, folder), _asked(spark, folder), 10), "score")


@plan(f"""WITH {VECTORS_SQL}, p AS (SELECT a.vec_id AS i, b.vec_id AS j, a.label AS ti, b.label AS tj, round(list_dot_product(a.e, b.e), 9) AS sim FROM u a, u b WHERE a.vec_id <> b.vec_id),
n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label), nn AS (SELECT i, ti, tj FROM p QUALIFY row_number() OVER (PARTITION BY i ORDER BY sim DESC, j) = 1),
a AS (SELECT count(*) FILTER (ti = tj) AS nn_hits, count(*) AS nn_total FROM nn JOIN n ON label = ti WHERE n >= 2), m AS (SELECT avg(sim) FILTER (ti = tj) AS same, avg(sim) FILTER (ti <> tj) AS diff FROM p)
SELECT nn_hits, nn_total, round(nn_hits / CAST(nn_total AS DOUBLE), 6) AS nn_agree, round(same, 6) AS same, round(diff, 6) AS diff FROM a, m""")
def topic_separation(spark: SparkSession, folder: str) -> DataFrame:
    return _round(topic_metrics(_vectors(spark, folder)), "nn_agree", "same", "diff")


@plan(f"WITH {VECTORS_SQL}, p AS (SELECT a.vec_id AS i, b.vec_id AS j, round(list_dot_product(a.e, b.e), 9) AS sim FROM u a, u b WHERE a.vec_id <> b.vec_id AND a.vec_id % 50 = 0), t AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY i ORDER BY sim DESC, j) <= 20) SELECT i, j, round(sim, 6) AS sim, rank() OVER (PARTITION BY i ORDER BY t.sim DESC) AS rank FROM t")
def neighbour_rank(spark: SparkSession, folder: str) -> DataFrame:
    """The twenty nearest of all vectors to each of the stated query set, ranked with ties."""
    found = vector_search(_vectors(spark, folder), _asked(spark, folder), 20, skip_self=True)
    return _round(ranked_neighbours(found), "sim")


@plan(f"WITH {VECTORS_SQL}, q AS (SELECT * FROM u WHERE vec_id % 50 = 0), p AS (SELECT a.vec_id AS i, b.vec_id AS j, round(list_dot_product(a.e, b.e), 9) AS sim FROM q a JOIN q b ON a.vec_id < b.vec_id), e AS (SELECT min(sim) AS lo, max(sim) AS hi FROM p) SELECT i, j, round(sim, 6) AS sim, round(CASE WHEN hi = lo THEN 1 ELSE (sim - lo) / (hi - lo) END, 6) AS scaled FROM p, e")
def similarity_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """The upper triangle over the stated query set, and its values scaled to 0 to 1."""
    pairs = similarity_pairs(_asked(spark, folder), "qid").withColumn("sim", F.round("sim", 9))
    return _round(off_diagonal_scale(pairs), "sim", "scaled")


@plan()
def ann_recall(spark: SparkSession, folder: str) -> DataFrame:
    """(share, recall): inverted lists against exact search, by the share of lists that are looked into."""
    v, q = _vectors(spark, folder), _asked(spark, folder)
    exact, index = stored(vector_search(v, q, 10)), IvfIndex(v)
    n = len(index.centres)
    rows = [list_recall(index.search(q, 10, max(1, n * p // 100)), exact, 10).agg(F.avg("recall").alias("recall")).select(F.lit(p).alias("share"), "recall") for p in (10, 30, IvfIndex.PROBE)]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@plan()
def quantised_recall(spark: SparkSession, folder: str) -> DataFrame:
    """(share, recall, looked): compressed lists against exact search, by the per cent of lists looked into; looked: share of all vectors whose codes were scored."""
    v, q = _vectors(spark, folder), _asked(spark, folder)
    exact, index, out = stored(vector_search(v, q, 10)), QuantisedIndex(v), None
    for share in (5, 10, QuantisedIndex.PROBE):
        looked = index.search(q, 10, share, counted=True).agg(F.round(F.avg("looked") / index.rows, 6).alias("looked"))
        row = list_recall(index.search(q, 10, share), exact, 10).agg(F.round(F.avg("recall"), 6).alias("recall")).select(F.lit(share).alias("share"), "recall").join(looked)
        out = row if out is None else out.unionByName(row)
    return out


@plan(f"WITH {VECTORS_SQL}, s AS (SELECT q.vec_id AS qid, d.vec_id AS id, round(list_dot_product(q.e, d.e), 9) AS s FROM u q, u d WHERE q.vec_id % 50 = 0) SELECT qid, id, round(s, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) AS rank FROM s QUALIFY rank <= 10")
def quantised_of_all_lists(spark: SparkSession, folder: str) -> DataFrame:
    """All lists are looked into and all that is found is scored by its vectors: the exact ranks."""
    index = QuantisedIndex(_vectors(spark, folder))
    return _round(index.search(_asked(spark, folder), 10, probe=100, rerank=index.rows), "score")


@plan()
def graph_recall(spark: SparkSession, folder: str) -> DataFrame:
    """(beam, recall): sharded small-world graphs against exact search; a beam under k is filled up."""
    v, q = _vectors(spark, folder), _asked(spark, folder)
    exact, index = stored(vector_search(v, q, 10)), GraphIndex(v)
    rows = [list_recall(index.search(q, 10, b), exact, 10).agg(F.avg("recall").alias("recall")).select(F.lit(b).alias("beam"), "recall") for b in (4, 10, 32)]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@plan()
def graph_sweep(spark: SparkSession, folder: str) -> DataFrame:
    """(beam, recall, looked, seconds, flat_seconds, speedup, break_even, verdict) for beams of powers of two."""
    return sweep(_vectors(spark, folder), _asked(spark, folder), 10, [2**i for i in range(9)])


def _pca_sql(rounds: int = 16) -> str:
    """Covariances, squared over and over until only the first component is left of them; the same again without it."""

    def component(n: int, matrix: str) -> str:
        powers = [f"p{n}_0 AS (SELECT * FROM {matrix})"]
        for r in range(rounds):
            powers.append(f"s{n}_{r} AS MATERIALIZED (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM p{n}_{r} a JOIN p{n}_{r} b ON a.j = b.i GROUP BY a.i, b.j), p{n}_{r + 1} AS MATERIALIZED (SELECT i, j, v / (SELECT sqrt(sum(v * v)) FROM s{n}_{r}) AS v FROM s{n}_{r})")
        column = f"k{n} AS MATERIALIZED (SELECT i, v FROM p{n}_{rounds} WHERE j = (SELECT i FROM p{n}_{rounds} WHERE i = j ORDER BY v DESC, i LIMIT 1))"
        unit = f"e{n} AS MATERIALIZED (SELECT i, v / (SELECT sqrt(sum(v * v)) FROM k{n}) * (SELECT sign(arg_max(v, abs(v))) FROM k{n}) AS v FROM k{n})"
        return ", ".join([*powers, column, unit])

    return f"""WITH x AS (SELECT vec_id, i, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, unnest(generate_series(1, len(embedding))) AS u(i)),
c AS MATERIALIZED (SELECT vec_id, i, x - avg(x) OVER (PARTITION BY i) AS x FROM x),
cov AS MATERIALIZED (SELECT a.i, b.i AS j, sum(a.x * b.x) / (SELECT count(*) - 1 FROM embeddings) AS v FROM c a JOIN c b USING (vec_id) GROUP BY a.i, b.i),
{component(1, "cov")}, l AS (SELECT sum(a.v * cov.v * b.v) AS l FROM cov JOIN e1 a ON a.i = cov.i JOIN e1 b ON b.i = cov.j),
rest AS MATERIALIZED (SELECT cov.i, cov.j, cov.v - l.l * a.v * b.v AS v FROM cov JOIN e1 a ON a.i = cov.i JOIN e1 b ON b.i = cov.j, l), {component(2, "rest")}
SELECT vec_id, round(sum(x * e1.v), 6) AS x, round(sum(x * e2.v), 6) AS y FROM c JOIN e1 USING (i) JOIN e2 USING (i) GROUP BY vec_id"""


@plan(_pca_sql())
def pca_projection(spark: SparkSession, folder: str) -> DataFrame:
    """(vec_id, x, y) of the two first components."""
    v = _vectors(spark, folder)
    components, mean, _ = pca2(v)
    return v.select("vec_id", project2("embedding", components, mean).alias("p")).select("vec_id", F.round(F.get("p", F.lit(0)), 6).alias("x"), F.round(F.get("p", F.lit(1)), 6).alias("y"))


@plan(r"""WITH c AS (SELECT item_id, list_transform(string_split(regexp_replace(text, '\s+', ' ', 'g'), ''), lambda x: unicode(x)) AS c FROM benchmark),
b AS (SELECT item_id, (c[i] * 31 + c[i + 1]) % 256 AS bucket FROM c, unnest(generate_series(1, len(c) - 1)) AS u(i)) SELECT item_id, bucket, count(*) AS n FROM b GROUP BY item_id, bucket""")
def toy_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "benchmark").select("item_id", F.posexplode(toy_embedding()("text")).alias("bucket", "n"))
    return rows.filter("n > 0").select("item_id", "bucket", F.col("n").cast("long").alias("n"))


_BUCKETS = r"""{0} AS MATERIALIZED (SELECT id, bucket, count(*) AS n FROM (SELECT id, (c[i] * 31 + c[i + 1]) % 256 AS bucket FROM (SELECT {1} AS id, list_transform(string_split(regexp_replace({2}, '{3}+', ' ', 'g'), ''), lambda x: unicode(x)) AS c FROM {4}), unnest(generate_series(1, len(c) - 1)) AS u(i)) GROUP BY ALL)"""
# white space as Python's \\s sees it
_BLANK = r"[\t-\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


@plan(f"""WITH {QUESTIONS_SQL}, {runs_sql()}, {_BUCKETS.format("db", "doc_id", "text", _BLANK, "documents")}, {_BUCKETS.format("qb", "qid", "question", _BLANK, "questions")},
dn AS (SELECT id, sqrt(sum(n * n)) AS l FROM db GROUP BY id), qn AS (SELECT id, sqrt(sum(n * n)) AS l FROM qb GROUP BY id),
dots AS (SELECT qb.id AS qid, db.id AS id, sum(qb.n * db.n) AS s FROM qb JOIN db USING (bucket) GROUP BY ALL),
cosines AS (SELECT qn.id AS qid, documents.doc_id AS id, round(coalesce(s / (qn.l * dn.l), 0), 9) AS s FROM qn CROSS JOIN documents LEFT JOIN dn ON dn.id = documents.doc_id LEFT JOIN dots ON dots.qid = qn.id AND dots.id = documents.doc_id),
vec AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) AS rank FROM cosines QUALIFY rank <= 10),
listed AS (SELECT qid, id, rank AS r, 0 AS list FROM run UNION ALL SELECT qid, id, rank, 1 FROM vec),
fused AS (SELECT qid, id, round(sum(1 / (60.0 + r)), 12) AS score, min(list * 1000 + r) AS seen FROM listed GROUP BY qid, id)
SELECT qid, id, round(score, 9) AS score, row_number() OVER (PARTITION BY qid ORDER BY fused.score DESC, seen, id) AS rank FROM fused QUALIFY rank <= 10""")
def hybrid_search(spark: SparkSession, folder: str) -> DataFrame:
    """Keyword and vector lists over documents, fused. Texts are embedded once each, the vector lists come from the same plan as for real models."""
    embed = toy_embedding()
    texts = documents(spark, folder).select(F.col("doc_id").alias("vec_id"), embed("text").alias("embedding"))
    asked = questions(spark, folder).select("qid", embed("question").alias("embedding"))
    return _round(fusion.reciprocal_rank_fusion([runs(spark, folder), vector_search(texts, asked, 10)]).drop("ranks"), "score", digits=9)


@plan()
def rag_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Question to checked answer: search, prompt, the deterministic generator, citation check."""
    texts = documents(spark, folder).select(F.col("doc_id").alias("id"), "text")
    q = questions(spark, folder)
    found = answers.contexts(runs(spark, folder, 3), texts, 3).join(q, "qid")
    made = answers.OverlapGenerator().generate(found.select("qid", "question", "texts"))
    sources = found.select("qid", F.posexplode("texts").alias("n", "text")).withColumn("n", F.col("n") + 1)
    checked = answers.validate_answers(made.select("qid", "answer"), sources)
    return answers.citation_stats(checked)


@plan("SELECT event_id, round(exp(value / 50.0 - max(value / 50.0) OVER w) / sum(exp(value / 50.0 - m)) OVER w, 9) AS p FROM (SELECT *, max(value / 50.0) OVER (PARTITION BY user_id, event_type) AS m FROM events) WINDOW w AS (PARTITION BY user_id, event_type)")
def softmax_values(spark: SparkSession, folder: str) -> DataFrame:
    from loamdex.functions.vectors import softmax

    return table(spark, folder, "events").select("event_id", F.round(softmax("value", 50.0, ["user_id", "event_type"]), 9).alias("p"))
