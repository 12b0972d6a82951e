"""Plans over single functions and small operators: facts, prompts, checks, conversations, vectors, scores."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamdex.functions import cleaning, text
from loamdex.functions.vectors import euclid, role_text
from loamdex.operators import answers, conversation, fusion, metrics, quiz, selfquery, validators
from loamdex.operators.chunking import ChunkConfig, chunk, documents_of
from loamdex.operators.embedding import ToyEmbedder, embed_once, model_embedding
from loamdex.operators.matching import containing
from loamdex.operators.retrieval import Bm25Index, GraphIndex, IvfIndex, VectorStore, evidence_rank, relevant_ids, small, vector_search, with_scores
from loamdex.plans.common import EVIDENCE_SQL, QUESTIONS_SQL, documents, questions, registry, runs, runs_sql
from loamdex.session import stored
from loamdex.sources.readers import table

QUERIES, SQL, plan = registry()
SPACE = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _turns(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "conversations")


def _round(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if c in columns else c for c in df.columns])


# ---- cleaning


@plan("SELECT doc_id, sha256(translate(text, 'OIl', '011')) AS sha256, length(text) - length(regexp_replace(text, '[OIl]', '', 'g')) AS count FROM documents")
def ocr_everywhere(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).select("doc_id", cleaning.ocr_everywhere("text").alias("r")).select("doc_id", F.sha2("r.text", 256).alias("sha256"), "r.count")


# ---- facts, terms, texts


@plan(rf"SELECT item_id, regexp_replace(replace(lower(text), '퍼센트', '%'), '{SPACE}+', '', 'g') AS fact, list_distinct(list_transform(regexp_extract_all(text, '\d+(?:\.\d+)?\s*(?:%|퍼센트|시간|교시|학점|호|명|주|회)?'), lambda n: regexp_replace(n, '\s', '', 'g'))) IS NOT NULL AS known FROM benchmark")
def normal_facts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "benchmark").select("item_id", text.normal_fact("text", False).alias("fact"), text.golden_facts("text", False).isNotNull().alias("known"))


@plan("SELECT conv_id, turn, 'Q: ' || text || ' {unknown} by ' || role AS filled FROM conversations")
def filled_templates(spark: SparkSession, folder: str) -> DataFrame:
    return _turns(spark, folder).select("conv_id", "turn", text.fill_template("Q: {question} {unknown} by {role}", {"question": F.col("text"), "role": F.col("role")}).alias("filled"))


_PAIRS = "p AS (SELECT conv_id, list(text ORDER BY turn) AS texts, list(role ORDER BY turn) AS roles, any_value(conv_id) AS c FROM conversations GROUP BY conv_id)"


def _conversations(spark: SparkSession, folder: str) -> DataFrame:
    rows = _turns(spark, folder).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text", "role"))).alias("x"))
    return rows.select("conv_id", F.col("x.text").alias("texts"), F.col("x.role").alias("roles"))


@plan(f"""WITH {_PAIRS} SELECT conv_id, array_to_string(list_transform(texts, lambda t, i: '[' || i || '] (' || roles[i] || ') ' || t), chr(10) || chr(10)) AS context,
'근거 문서:' || chr(10) || array_to_string(list_transform(texts, lambda t, i: '[' || i || '] ' || t), chr(10) || chr(10)) || chr(10) || chr(10) || '질문: ' || texts[1] AS prompt FROM p""")
def numbered_prompts(spark: SparkSession, folder: str) -> DataFrame:
    rows = _conversations(spark, folder)
    return rows.select("conv_id", text.numbered_context(F.col("roles"), F.col("texts")).alias("context"), answers.rag_prompt(F.col("texts")[0], F.col("texts"))["user"].alias("prompt"))


@plan(f"""WITH {_PAIRS} SELECT conv_id, 'Do it.' || chr(10) || chr(10) || '### 예시 1' || chr(10) || '<문서>c</문서>' || chr(10) || '질문: q' || chr(10) || '답: a' || chr(10) || chr(10) || '### 실제 질문' || chr(10) || '<문서>' || texts[1] || '</문서>' || chr(10) || '질문: ' || roles[1] || chr(10) || '답:' AS few,
'Sources:' || chr(10) || array_to_string(list_transform(texts, lambda t, i: '[' || i || '] ' || t), chr(10) || chr(10)) || chr(10) || chr(10) || 'Answer:' || chr(10) || texts[1] AS judge FROM p""")
def other_prompts(spark: SparkSession, folder: str) -> DataFrame:
    rows = _conversations(spark, folder)
    few = answers.few_shot("Do it.", [{"context": "c", "q": "q", "a": "a"}], F.col("roles")[0], F.col("texts")[0])
    judge = F.substring_index(answers.judge_prompt(F.col("texts"), F.col("texts")[0]), "\n\nSplit the answer", 1)
    return rows.select("conv_id", few.alias("few"), judge.alias("judge"))


@plan("SELECT item_id, len(regexp_extract_all(lower(text), '(?:de)+')) AS hits FROM benchmark")
def marked_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Stretches that a token covers; neighbours make one."""
    return table(spark, folder, "benchmark").select("item_id", F.size(F.filter(text.marked("text", F.array(F.lit("de"), F.lit(""))), lambda m: m["hit"])).alias("hits"))


@plan("SELECT item_id AS qid, doc_id AS doc, instr(documents.text, benchmark.text) - 1 AS start, instr(documents.text, benchmark.text) - 1 + length(benchmark.text) AS \"end\" FROM benchmark JOIN documents ON contains(documents.text, benchmark.text)")
def respaced_quotes(spark: SparkSession, folder: str) -> DataFrame:
    """Quotes whose blanks are doubled are found where they stand."""
    quotes = table(spark, folder, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("quote"))
    rows = containing(documents(spark, folder), quotes).join(quotes, "qid").join(documents(spark, folder).select(F.col("doc_id").alias("id"), "text"), "id")
    none = F.lit(None).cast("int")
    found = text.find_quote(F.col("text"), F.replace("quote", F.lit(" "), F.lit("  ")), none, none)
    return rows.select("qid", F.col("id").alias("doc"), found.alias("f")).select("qid", "doc", "f.start", "f.end")


@plan(rf"""WITH s AS (SELECT doc_id, unnest(list_filter(string_split(regexp_replace(text, '[.!?。]+["'')\]]?(?:\s+|$)|\n+', '\0' || chr(1), 'g'), chr(1)), lambda x: length(x) > 0)) AS s FROM documents),
t AS (SELECT doc_id, regexp_replace(s, '^{SPACE}+|{SPACE}+$', '', 'g') AS s FROM s)
SELECT doc_id, count(*) AS n, CAST(sum(length(s)) AS BIGINT) AS n_chars FROM t WHERE length(s) >= 8 GROUP BY doc_id""")
def long_sentences(spark: SparkSession, folder: str) -> DataFrame:
    rows = documents(spark, folder).select("doc_id", F.explode(text.long_sentences("text")).alias("s"))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("s.end") - F.col("s.start")).alias("n_chars"))


@plan(rf"""WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(text, '{SPACE}+', ' ', 'g'), '^ +| +$', '', 'g') AS t FROM documents) SELECT doc_id, CASE WHEN length(t) > 60 THEN left(t, 60) || '…' ELSE t END AS preview FROM t""")
def previews(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).select("doc_id", text.preview("text").alias("preview"))


@plan("SELECT conv_id, turn, contains(lower(text), lower('De')) AS found, contains(lower(text), '') AS any FROM conversations")
def title_filter(spark: SparkSession, folder: str) -> DataFrame:
    return _turns(spark, folder).select("conv_id", "turn", text.title_has("text", F.lit(" De ")).alias("found"), text.title_has("text", F.lit(" ")).alias("any"))


@plan(r"""WITH a AS (SELECT conv_id, turn, text || ' [' || (turn % 3 + 1) || ', 2] x [7]' AS a, length(text) AS n FROM conversations WHERE role = 'assistant' AND NOT regexp_matches(text, '\[\d')),
e AS (SELECT conv_id, turn, unnest([turn % 3 + 1, 2, 7]) AS n_, unnest([n + 1, n + 1, n + 10]) AS s, unnest([n + 7, n + 7, n + 13]) AS e_, unnest([0, 1, 2]) AS i FROM a) SELECT conv_id, turn, i AS index, CAST(n_ AS INT) AS n, s AS start, e_ AS "end" FROM e""")
def citation_offsets(spark: SparkSession, folder: str) -> DataFrame:
    rows = _turns(spark, folder).filter("role = 'assistant'").filter(~F.col("text").rlike(r"\[\d"))
    answer = F.concat("text", F.lit(" ["), (F.col("turn") % 3 + 1).cast("string"), F.lit(", 2] x [7]"))
    return rows.select("conv_id", "turn", F.posexplode(text.citation_places(answer)).alias("index", "c")).select("conv_id", "turn", "index", "c.*")


# ---- vectors


@plan(r"""SELECT conv_id, turn, CAST(greatest(length(regexp_replace(text, '\s+', ' ', 'g')) - 1, 0) AS DOUBLE) AS total, 'query: ' || left(text, 10) AS asked, 'passage: ' || left(text, 10) AS kept FROM conversations""")
def embedded_turns(spark: SparkSession, folder: str) -> DataFrame:
    """Each distinct text is embedded once; half of them were known before."""
    turns = _turns(spark, folder)
    known = embed_once(turns.filter("role = 'user'").select("text").distinct(), ToyEmbedder()).select(F.lit("toy").alias("model"), F.lit("passage").alias("role"), "text", "embedding")
    rows = embed_once(turns, ToyEmbedder(), known=known)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    model = "multilingual-e5-small"
    return rows.select("conv_id", "turn", total.alias("total"), role_text(F.left("text", F.lit(10)), model, "query").alias("asked"), role_text(F.left("text", F.lit(10)), model, "passage").alias("kept"))


def _word_vectors():
    """A stand-in model: each word's vector is (its length, 1)."""

    def model(texts: list[str]):
        rows = [[w for w in t.split(" ") if w] for t in texts]
        tokens, mask = np.zeros((len(rows), max([1, *map(len, rows)]), 2)), np.zeros((len(rows), max([1, *map(len, rows)])))
        for i, words in enumerate(rows):
            for j, w in enumerate(words):
                tokens[i, j], mask[i, j] = (len(w), 1), 1
        return tokens, mask

    return model


@plan("""WITH w AS (SELECT item_id, list_filter(string_split(text, ' '), lambda w: w <> '') AS w FROM benchmark), m AS (SELECT item_id, list_avg(list_transform(w, lambda x: length(x))) AS m FROM w)
SELECT item_id, round(m / sqrt(m * m + 1), 6) AS x, round(1 / sqrt(m * m + 1), 6) AS y FROM m""")
def pooled_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    """Token vectors are averaged under their mask and scaled to unit length; the model is loaded once a worker."""
    rows = table(spark, folder, "benchmark").select("item_id", model_embedding(_word_vectors, name="word lengths")(F.col("text")).alias("v"))
    return rows.select("item_id", F.round(F.get("v", F.lit(0)), 6).alias("x"), F.round(F.get("v", F.lit(1)), 6).alias("y"))


@plan("SELECT a.vec_id AS i, round(sqrt(list_sum(list_transform(generate_series(1, len(a.embedding)), lambda k: (CAST(a.embedding[k] AS DOUBLE) - b.embedding[k]) * (CAST(a.embedding[k] AS DOUBLE) - b.embedding[k])))), 6) AS distance FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def vector_distances(spark: SparkSession, folder: str) -> DataFrame:
    v = table(spark, folder, "embeddings").select(F.col("vec_id").alias("i"), F.col("embedding").alias("a"))
    return v.join(v.select((F.col("i") - 1).alias("i"), F.col("a").alias("b")), "i").select("i", F.round(euclid("a", "b"), 6).alias("distance"))


_EXACT = "WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), u AS MATERIALIZED (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v), s AS (SELECT q.vec_id AS qid, d.vec_id AS id, round(list_dot_product(q.e, d.e), 9) AS s FROM u q, u d WHERE q.vec_id % 50 = 0) SELECT qid, id, round(s, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) AS rank FROM s QUALIFY rank <= {0}"


def _asked(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    v = table(spark, folder, "embeddings")
    return v, v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), "embedding")


@plan(_EXACT.format(5))
def graph_of_full_beam(spark: SparkSession, folder: str) -> DataFrame:
    """A beam as wide as a shard walks all of its graph, so the lists are the exact ones."""
    v, q = _asked(spark, folder)
    return _round(GraphIndex(v).search(q, 5, 2 * GraphIndex.SHARD_ROWS), "score")


@plan(_EXACT.format(5))
def lists_all_probed(spark: SparkSession, folder: str) -> DataFrame:
    """Inverted lists that are all looked into give the exact lists."""
    v, q = _asked(spark, folder)
    index = IvfIndex(v)
    return _round(index.search(q, 5, len(index.centres)), "score")


@plan(_EXACT.format(5))
def stored_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors that are added in two batches after a store was cleared."""
    v, q = _asked(spark, folder)
    store = VectorStore(spark, 64).add(v).clear().add(v.filter("vec_id % 2 = 0")).add(v.filter("vec_id % 2 = 1"))
    return _round(store.search(q, 5), "score")


@plan(_EXACT.format(3))
def search_of_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """More queries than are sent at once: products of blocks."""
    v, q = _asked(spark, folder)
    return _round(vector_search(v, q, 3, block=4), "score")


# ---- retrieval, fusion, scores

_CHUNKS = r"""chunk AS MATERIALIZED (SELECT doc_id AS doc, doc_id || '#' || (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1) AS id, substr(text, i * 240 + 1, 300) AS text
  FROM documents, unnest(generate_series(0, greatest(CAST(ceil((length(text) - 300) / 240.0) AS BIGINT), 0))) AS u(i) WHERE length(text) > 0 AND regexp_matches(substr(text, i * 240 + 1, 300), '[^\t-\r ]')),
quote AS MATERIALIZED (SELECT item_id AS qid, 0 AS ev, doc_id AS doc, benchmark.text AS quote FROM benchmark JOIN documents ON contains(documents.text, benchmark.text))"""


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    return _cut(documents(spark, folder))


def _cut(docs: DataFrame) -> DataFrame:
    return chunk(docs, ChunkConfig("fixed", 300, 60)).select(F.col("chunk_id").alias("id"), "doc", "text")


def _quotes(spark: SparkSession, folder: str) -> DataFrame:
    quotes = table(spark, folder, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("quote"))
    return containing(documents(spark, folder), quotes).join(quotes, "qid").select("qid", F.lit(0).alias("ev"), F.col("id").alias("doc"), "quote")


@plan(f"WITH {_CHUNKS} SELECT DISTINCT qid, id FROM quote JOIN chunk USING (doc) WHERE contains(text, quote)")
def relevant_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return relevant_ids(_chunks(spark, folder), _quotes(spark, folder).select("qid", "doc", "quote"))


@plan(f"WITH {_CHUNKS} SELECT qid FROM quote GROUP BY qid EXCEPT SELECT qid FROM quote JOIN chunk USING (doc) WHERE contains(text, quote)")
def quotes_cut_apart(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.never_whole(_chunks(spark, folder), _quotes(spark, folder))


_CHUNK_RUN = runs_sql("run", 5).replace("SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS t FROM documents", "SELECT id AS doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS t FROM chunk")


def _chunk_run(spark: SparkSession, folder: str) -> DataFrame:
    asked = questions(spark, folder)
    return Bm25Index.build(_chunks(spark, folder), "id", "text", only=Bm25Index.terms(asked)).search(asked, 5)


@plan(f"WITH {QUESTIONS_SQL}, {_CHUNKS}, {_CHUNK_RUN}, hit AS (SELECT run.qid, min(rank) AS rank FROM run JOIN chunk USING (id) JOIN quote ON quote.qid = run.qid AND quote.doc = chunk.doc WHERE contains(chunk.text, quote) GROUP BY run.qid) SELECT DISTINCT quote.qid, coalesce(rank, 0) AS rank FROM quote LEFT JOIN hit USING (qid)")
def chunk_evidence_ranks(spark: SparkSession, folder: str) -> DataFrame:
    found = small(_chunk_run(spark, folder))
    return evidence_rank(found, _cut(documents_of(documents(spark, folder), found)), stored(_quotes(spark, folder).select("qid", "doc", "quote")))


@plan(f"""WITH {QUESTIONS_SQL}, {_CHUNKS}, {_CHUNK_RUN},
hit AS (SELECT DISTINCT run.qid, rank, 'doc:' || chunk.doc AS unit FROM run JOIN chunk USING (id) JOIN quote ON quote.qid = run.qid AND quote.doc = chunk.doc),
once AS (SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY qid, unit ORDER BY rank) = 1) SELECT run.qid, run.rank, coalesce(unit, run.id) AS id FROM run LEFT JOIN once ON once.qid = run.qid AND once.rank = run.rank""")
def labelled_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Chunk lists in units of evidence documents, each credited once."""
    return metrics.label_run(_chunk_run(spark, folder), _chunks(spark, folder), _quotes(spark, folder), "doc")[0]


@plan(f"WITH {QUESTIONS_SQL}, {EVIDENCE_SQL}, {runs_sql()} SELECT evidence.qid, evidence.id, round(coalesce(score, 0), 6) AS score FROM evidence LEFT JOIN run USING (qid, id)")
def evidence_scores(spark: SparkSession, folder: str) -> DataFrame:
    wanted = _quotes(spark, folder).select("qid", F.col("doc").alias("id")).distinct()
    return _round(with_scores(wanted, runs(spark, folder)).select("qid", "id", "score"), "score")


@plan(rf"""WITH {QUESTIONS_SQL}, {runs_sql()}, t AS (SELECT qid, list_distinct(regexp_extract_all(lower(question), '[\p{{L}}\p{{N}}]+')) AS q FROM questions),
c AS (SELECT run.qid, run.id, rank AS r, len(list_intersect(q, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+'))) / CAST(len(q) AS DOUBLE) AS cover, score / 100 AS cosine FROM run JOIN t USING (qid) JOIN documents ON doc_id = id),
s AS (SELECT qid, id, r, round(0.5 * cover + 0.5 * CASE WHEN max(cosine) OVER w = min(cosine) OVER w THEN 1 ELSE (cosine - min(cosine) OVER w) / nullif(max(cosine) OVER w - min(cosine) OVER w, 0) END, 9) AS s FROM c WINDOW w AS (PARTITION BY qid))
SELECT qid, id, round(s, 6) AS rerank_score, row_number() OVER (PARTITION BY qid ORDER BY s DESC, r, id) AS rank FROM s QUALIFY rank <= 5""")
def cosine_rerank(spark: SparkSession, folder: str) -> DataFrame:
    """Half coverage, half a similarity scaled among the candidates; keyword scores stand in for cosines."""
    rows = fusion.hybrid_or_keyword(runs(spark, folder), None).join(questions(spark, folder), "qid").join(documents(spark, folder).select(F.col("doc_id").alias("id"), "text"), "id").withColumn("cosine", F.col("score") / 100)
    return _round(fusion.rerank(rows, fusion.coverage_and_cosine).select("qid", "id", "rerank_score", "rank"), "rerank_score")


@plan("WITH s AS (SELECT p_brand AS name, avg(p_size) AS size, avg(p_retailprice) AS price FROM part GROUP BY p_brand) SELECT name, size = max(size) OVER () AS best_size, price = max(price) OVER () AS best_price, row_number() OVER (ORDER BY round(size, 6) DESC, name) AS place FROM s")
def best_of_board(spark: SparkSession, folder: str) -> DataFrame:
    """Rows with the best of each column marked, in order."""
    rows = table(spark, folder, "part").groupBy(F.col("p_brand").alias("name")).agg(F.avg("p_size").alias("size"), F.avg("p_retailprice").alias("price"))
    marked = metrics.board(rows, ["size", "price"]).withColumn("size", F.round("size", 6))
    ordered = metrics.sorted_board(marked, "size", "name", locale="UTF8_BINARY")
    place = ordered.agg(F.collect_list(F.struct("name", "best_size", "best_price")).alias("x"))  # one row a brand
    return place.select(F.posexplode("x").alias("i", "r")).select("r.*", (F.col("i") + 1).alias("place"))


@plan("SELECT row_number() OVER (ORDER BY (p_brand LIKE '%1') DESC, p_partkey) AS place, p_partkey FROM part")
def damaged_first(spark: SparkSession, folder: str) -> DataFrame:
    """A damaged kind before the others, else in data order."""
    rows = table(spark, folder, "part").select(F.col("p_partkey").alias("ord"), F.when(F.col("p_brand").endswith("1"), "broken").otherwise("whole").alias("type"))
    return selfquery.ranked_rows(metrics.broken_first(rows).select("ord", F.when(F.col("type") == "broken", 1.0).otherwise(0.0).alias("score"), F.col("ord").alias("_ord"))).select(F.col("rank").alias("place"), F.col("ord").alias("p_partkey"))


@plan("SELECT conv_id, turn, list_filter(['d' || turn || '#9', 'd1#1', 'd2#0'], lambda c: NOT list_contains(['d1', 'd2'], split_part(c, '#', 1))) AS outside FROM conversations")
def citations_outside(spark: SparkSession, folder: str) -> DataFrame:
    cited = F.array(F.concat(F.lit("d"), "turn", F.lit("#9")), F.lit("d1#1"), F.lit("d2#0"))
    return _turns(spark, folder).select("conv_id", "turn", validators.cited_outside(F.array(F.lit("d1#0"), F.lit("d2#3")), cited).alias("outside"))


# ---- structured questions


@plan("""WITH p AS (SELECT p_partkey, p_size FROM part), best AS (SELECT p_partkey, row_number() OVER (ORDER BY p_size DESC, p_partkey) AS rank FROM p QUALIFY rank <= 7),
good AS (SELECT p_partkey, row_number() OVER (ORDER BY p_size DESC, p_partkey) AS rank FROM p WHERE p_size >= 45)
SELECT 'invalid' AS kind, p_partkey AS id, rank FROM best UNION ALL SELECT 'list', p_partkey, rank FROM good""")
def searched_records(spark: SparkSession, folder: str) -> DataFrame:
    """A question that isn't valid becomes a plain search; a list has no limit, and ranks."""
    parts = table(spark, folder, "part").withColumn("ord", F.col("p_partkey"))
    ranking = parts.select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("score"))
    schema = {"p_size": {"kind": "int", "min": 1, "max": 50}}
    out = []
    for name, question in (("invalid", {"filter": {"colour": "red"}}), ("list", {"intent": "list", "filter": {"p_size": {"gte": 45}}})):
        rows, errors = selfquery.safe_search(parts, ranking, question, schema, 7, id="p_partkey")
        out.append(rows.select(F.lit(name).alias("kind"), "id", "rank"))
        if bool(errors) != (name == "invalid"):
            raise ValueError(errors)
    return out[0].unionByName(out[1])


# ---- generation and its checks


@plan("SELECT conv_id, turn, variant, answer FROM (SELECT conv_id, turn, unnest(['a', 'b']) AS variant, '문서에서 찾을 수 없다.' AS answer FROM conversations)")
def prompt_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Two prompts for each turn, answered side by side; without sources there is nothing to say."""
    rows = _turns(spark, folder).select(F.struct("conv_id", "turn").alias("qid"), "text", F.array().cast("array<string>").alias("texts"))
    out = answers.run_variants(rows, {"a": ("s", "{question}"), "b": ("s", "Please: {question}")}, {"question": F.col("text")}, answers.OverlapGenerator())
    return out.select("qid.*", "variant", "answer")


@plan(f"""WITH {_PAIRS}, s AS (SELECT conv_id, texts[1] AS q, unnest(list_transform(texts, lambda t, i: {{'n': i, 't': t}})) AS x FROM p WHERE len(texts) > 1),
w AS (SELECT conv_id, list_distinct(regexp_extract_all(lower(q), '[\\p{{L}}\\p{{N}}]+')) AS q FROM s GROUP BY ALL) SELECT conv_id, len(q) >= 3 AS answered FROM w""")
def overlap_answers(spark: SparkSession, folder: str) -> DataFrame:
    """A question that stands among its own sources is answered from them if it has words enough."""
    rows = _conversations(spark, folder).filter(F.size("texts") > 1).select(F.col("conv_id").alias("qid"), F.col("texts")[0].alias("question"), F.transform("texts", lambda t: F.regexp_replace(t, r"[.!?\n]+", " ")).alias("texts"))
    return answers.OverlapGenerator().generate(rows).select(F.col("qid").alias("conv_id"), (F.col("answer") != answers.REFUSED).alias("answered"))


@plan(r"SELECT a.item_id, len(list_filter(regexp_extract_all(a.text, '\d+(?:\.\d+)?'), lambda n: NOT contains(b.text, n))) = 0 AS grounded FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1 WHERE NOT regexp_matches(a.text, '\[\d')")
def grounded_numbers(spark: SparkSession, folder: str) -> DataFrame:
    b = table(spark, folder, "benchmark")
    rows = b.filter(~F.col("text").rlike(r"\[\d")).join(b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("source")), "item_id")
    return rows.select("item_id", answers.grounded("text", "source").alias("grounded"))


# ---- conversations


@plan("SELECT conv_id, turn, regexp_replace(text, '\\n.*', '', 's') AS query, role = 'user' AS clarify FROM conversations WHERE regexp_matches(text, '^[A-Za-z][^\"\\n]*[A-Za-z.?!](\\n|$)')")
def parsed_rewrites(spark: SparkSession, folder: str) -> DataFrame:
    """Replies with labels and quotes, of which the first line counts; a user turn stands for a question back."""
    rows = _turns(spark, folder).filter(F.col("text").rlike(r'^[A-Za-z][^"\n]*[A-Za-z.?!](\n|\z)'))
    reply = F.when(F.col("role") == "user", F.concat(F.lit("되묻기: "), "text")).otherwise(F.concat(F.lit('질문: "'), F.substring_index("text", "\n", 1), F.lit('"\nmore')))
    return rows.select("conv_id", "turn", conversation.parse_rewrite(reply).alias("r")).select("conv_id", "turn", "r.*")


@plan("""SELECT conv_id, turn, CASE WHEN turn % 5 = 0 THEN 'llm' WHEN turn % 3 = 0 THEN 'clarify' WHEN turn % 4 = 1 THEN 'example' WHEN turn % 4 = 2 THEN 'extract' ELSE 'clarify' END AS kind,
CASE WHEN turn % 5 = 0 THEN text WHEN turn % 3 = 0 THEN '무엇에 대한 질문인지 확실하지 않다. 다음 중 어느 것을 묻는가? ‘a’, ‘b’' WHEN turn % 4 = 1 THEN 'see [2]' WHEN turn % 4 = 2 THEN text || ' [1]' ELSE '무엇에 대한 질문인지 확실하지 않다. 다음 중 어느 것을 묻는가? ‘a’, ‘b’' END AS text FROM conversations""")
def chosen_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Every branch of the policy, by the number of the turn."""
    t = F.col("turn")
    row = _turns(spark, folder)
    titles = F.array(F.lit("a"), F.lit("b"), F.lit("a"))
    a = conversation.choose_answer(F.lit(False), F.when(t % 3 == 0, 0.5).otherwise(5.0), 1.0, F.when(t % 5 == 0, F.col("text")), F.when(t % 4 == 1, "see [*]"), F.lit(2), F.col("text"), F.when(t % 4 == 2, 1.0).otherwise(0.0), titles)
    return row.select("conv_id", "turn", a.alias("a")).select("conv_id", "turn", "a.*")


# ---- quizzes


@plan(rf"SELECT conv_id, turn, lower(regexp_replace(text, '{SPACE}+', '', 'g')) <> '' AS same, lower(regexp_replace(text, '{SPACE}+', '', 'g')) = lower(regexp_replace(role, '{SPACE}+', '', 'g')) AS role FROM conversations WHERE text <> ''")
def graded_answers(spark: SparkSession, folder: str) -> DataFrame:
    rows = _turns(spark, folder).filter("text != ''")
    return rows.select("conv_id", "turn", quiz.grade("text", F.replace("text", F.lit(" "), F.lit("  "))).alias("same"), quiz.grade("text", "role").alias("role"))


@plan(f"WITH {_PAIRS} SELECT conv_id, array_to_string(list_transform(texts, lambda t, i: '(id: ' || roles[i] || ')' || chr(10) || trim(t)), chr(10) || chr(10)) AS blocks, 'Items: 3' AS items FROM p")
def quiz_prompts(spark: SparkSession, folder: str) -> DataFrame:
    body = F.element_at(F.split(quiz.prompt(F.col("texts"), F.col("roles"), 3), "hold the answer\\.\n\n"), 2)
    return _conversations(spark, folder).select("conv_id", F.substring_index(body, "\n\nItems: ", 1).alias("blocks"), F.concat(F.lit("Items: "), F.substring_index(F.substring_index(body, "\n\nItems: ", -1), "\n", 1)).alias("items"))


# ---- chunks with typed-out spans


