"""Plans over sources and sinks: what is written is read back and compared with the tables.

Files go to the shared folder of the session, each run to one of its own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamdex.functions.text import document_of, escape_html
from loamdex.operators.answers import cut_at_spans, highlight
from loamdex.operators.chunking import ChunkConfig, chunk
from loamdex.operators.validators import validate_results
from loamdex.plans.common import documents, registry
from loamdex.session import shared_folder
from loamdex.sources import readers, writers
from loamdex.sources.readers import table

QUERIES, SQL, plan = registry()


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


def _corpus(spark: SparkSession, folder: str, path: str) -> None:
    """Conversations as corpus objects, one a file: a conversation's turns are its documents."""
    turn = F.struct(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("role").alias("title"), F.lit("conversations").alias("source"), F.col("role").alias("type"), "text", F.lit(None).cast("string").alias("broken"))
    groups = table(spark, folder, "conversations").groupBy((F.col("conv_id") % 4).alias("g")).agg(F.sort_array(F.collect_list(F.struct("conv_id", "turn", turn.alias("d")))).alias("x"))
    rows = groups.select(F.lit(1).alias("version"), F.lit("test").alias("description"), F.col("x.d").alias("documents"))
    writers.write_json(rows.repartition(4, "documents"), path, options={"maxRecordsPerFile": 1})


@plan("""SELECT conv_id || '-' || turn AS id, role AS title, role AS type, text, row_number() OVER (PARTITION BY conv_id % 4 ORDER BY conv_id, turn) - 1 AS ord FROM conversations""")
def corpus_objects(spark: SparkSession, folder: str) -> DataFrame:
    """JSON objects of documents, written and read."""
    path = _folder(spark)
    _corpus(spark, folder, path)
    return readers.corpus(spark, path).select("id", "title", "type", "text", "ord")


@plan("SELECT 'a' AS name, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM conversations UNION ALL SELECT 'b', count(*), CAST(sum(length(text)) AS BIGINT) FROM conversations")
def several_sources(spark: SparkSession, folder: str) -> DataFrame:
    path = _folder(spark)
    _corpus(spark, folder, path)
    found = readers.sources(spark, {"a": path, "b": path})
    parts = [d.agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("text")).alias("n_chars")).select(F.lit(k).alias("name"), "n", "n_chars") for k, d in found.items()]
    return parts[0].unionByName(parts[1])


@plan("SELECT CAST(doc_id AS VARCHAR) AS id, length(text) AS n FROM documents WHERE doc_id IN (SELECT n_nationkey FROM nation) UNION ALL SELECT 'b' || item_id, length(text) FROM benchmark")
def composite_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose ids another table shares, and extra ones."""
    own = documents(spark, folder).select(F.col("doc_id").cast("string").alias("id"), "text")
    shared = table(spark, folder, "nation").select(F.col("n_nationkey").cast("string").alias("id"))
    extra = table(spark, folder, "benchmark").select(F.concat(F.lit("b"), "item_id").alias("id"), "text")
    return readers.composite(own, shared, extra).select("id", F.char_length("text").alias("n"))


@plan("SELECT CAST(sum(length(text) + 1) AS BIGINT) AS n_chars, 0 AS errors FROM conversations")
def text_files(spark: SparkSession, folder: str) -> DataFrame:
    """Turns written in files that a reader takes; a turn over that size is let in by it."""
    path = _folder(spark)
    turns = table(spark, folder, "conversations").filter("text is not null")
    longest = turns.agg(F.max(F.octet_length("text"))).first()[0] or 0
    writers.write_text(turns, path, "text", most=readers.MOST_BYTES)
    files = readers.local_files(spark, path, max(readers.MOST_BYTES, longest + 1))
    return files.agg(F.sum(F.char_length("text")).alias("n_chars"), F.count("error").cast("int").alias("errors"))


@plan("""WITH f AS (SELECT n_nationkey AS n, repeat(n_name || ' ', n_nationkey) AS t FROM nation)
SELECT n, CASE WHEN length(t) + 1 > 100 THEN 'too large' WHEN n % 4 = 1 THEN 'not UTF-8' END AS error, CASE WHEN length(t) + 1 <= 100 AND n % 4 <> 1 THEN t || chr(10) END AS text FROM f""")
def refused_files(spark: SparkSession, folder: str) -> DataFrame:
    """A file for each nation: large ones are refused unopened, one in four is no UTF-8."""
    n = F.col("n_nationkey")
    said = F.expr("repeat(n_name || ' ', cast(n_nationkey as int))")
    broken = F.concat(F.substring(said, 2, 1_000).cast("binary"), F.unhex(F.lit("FF"))).cast("string")
    rows = table(spark, folder, "nation").select(n.alias("n"), F.when((n % 4 == 1), broken).otherwise(said).alias("text"))
    path = _folder(spark)
    rows.repartition("n").write.partitionBy("n").text(path)
    return readers.local_files(spark, path, 100).select(F.regexp_extract("path", r"/n=(\d+)/", 1).cast("long").alias("n"), "error", "text")


@plan("SELECT n_name AS team, n_nationkey % 2 = 0 AS ok, CASE WHEN n_nationkey % 2 = 0 THEN 0 ELSE 1 END AS errors FROM nation")
def result_file_checks(spark: SparkSession, folder: str) -> DataFrame:
    """A file for each nation as a team, in every second of which k is no number; the newest of each team is checked."""
    item = F.struct(F.lit("q1").alias("id"), F.array(F.lit("d#1")).alias("retrieved"), F.lit("x").alias("answer"), F.array(F.lit("d#1")).alias("citations"))
    system = lambda k: F.struct(*[F.lit("s").alias(n) for n in ("chunking", "embedding", "retriever")], k.alias("k"))
    rows = table(spark, folder, "nation").select(F.col("n_name").alias("team"), F.array(*map(F.lit, "abc")).alias("members"), "n_nationkey", F.array(item).alias("golden"))
    path = _folder(spark)
    for odd, k in ((0, F.lit(5)), (1, F.lit("five"))):
        writers.write_json(rows.filter(F.col("n_nationkey") % 2 == odd).withColumn("system", system(k)).drop("n_nationkey").repartition(8, "team"), path, "append", {"maxRecordsPerFile": 1})
    newest = readers.latest_entries(readers.result_files(spark, path))
    checked = validate_results(newest, {"q1": "a"})
    return checked.select("team", "ok", F.size("issues.errors").alias("errors"))


@plan(r"""WITH l AS (SELECT conv_id, turn, list_filter(list_transform(string_split('[' || role || '] ' || text, chr(10)), lambda s: trim(s)), lambda s: s <> '')[1:16] AS l FROM conversations)
SELECT conv_id, turn, i - 1 AS index, CASE WHEN regexp_matches(l[i], '^\[([^\]]{1,20})\]\s*(.+)$') THEN trim(regexp_extract(l[i], '^\[([^\]]{1,20})\]\s*(.+)$', 1)) ELSE '기타' END AS topic,
CASE WHEN regexp_matches(l[i], '^\[([^\]]{1,20})\]\s*(.+)$') THEN trim(regexp_extract(l[i], '^\[([^\]]{1,20})\]\s*(.+)$', 2)) ELSE l[i] END AS text FROM l, unnest(generate_series(1, len(l))) AS u(i)""")
def labelled_texts(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", F.posexplode(readers.labelled_lines(F.concat(F.lit("["), "role", F.lit("] "), "text"))).alias("index", "x"))
    return rows.select("conv_id", "turn", "index", "x.topic", "x.text")


@plan("""SELECT conv_id || '-' || turn || '#' || i AS chunk_id, i AS index, substr(text, i * 40 + 1, 40) AS text FROM conversations, unnest(generate_series(0, greatest(CAST(ceil((length(text) - 40) / 40.0) AS BIGINT), 0))) AS u(i)
WHERE conv_id = 0 AND turn = 0 AND length(text) > 0 AND regexp_matches(substr(text, i * 40 + 1, 40), '[^ ]')""")
def chunks_of_document(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "conversations").withColumn("id", F.concat_ws("-", "conv_id", "turn"))
    return readers.chunks_of(chunk(docs, ChunkConfig("fixed", 300).with_(size=40), "id"), "0-0").select("chunk_id", "index", "text")


@plan("""SELECT doc_id AS doc, i AS index, sha256('[' || lang || '] ' || substr(text, i * 500 + 1, 500)) AS embed_text FROM documents, unnest(generate_series(0, greatest(CAST(ceil((length(text) - 500) / 500.0) AS BIGINT), 0))) AS u(i)
WHERE length(text) > 0 AND regexp_matches(substr(text, i * 500 + 1, 500), '[^\\t-\\r ]')""")
def titled_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks with the language as their title; the offsets stay those of the text."""
    return chunk(documents(spark, folder), ChunkConfig("fixed", 500), title="lang").select("doc", "index", F.sha2("embed_text", 256).alias("embed_text"))


@plan("SELECT count(*) AS n, count(*) AS orders, 0 AS changed, true AS moved FROM documents")
def seeded_shuffle(spark: SparkSession, folder: str) -> DataFrame:
    """An order for each row, the same for the same seed and another for another."""
    docs = documents(spark, folder).select("doc_id")
    a, b, c = (readers.shuffled(docs, s, "doc_id").withColumnRenamed("order", n) for s, n in (("x", "a"), ("x", "b"), ("y", "c")))
    rows = a.join(b, "doc_id").join(c, "doc_id")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("a").alias("orders"), F.count_if(F.col("a") != F.col("b")).cast("int").alias("changed"), F.bool_or(F.col("a") != F.col("c")).alias("moved"))


@plan("SELECT 'r' || n_regionkey AS qid, n_name AS id, CAST(25 - n_nationkey AS DOUBLE) AS score, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS rank FROM nation")
def stored_lists(spark: SparkSession, folder: str) -> DataFrame:
    """Ranked lists that were computed before, from one JSON object."""
    one = F.struct(F.col("n_name").alias("id"), (25 - F.col("n_nationkey")).cast("double").alias("score"))
    lists = table(spark, folder, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", one.alias("o")))).alias("x"))
    whole = lists.agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("r"), "n_regionkey"), F.col("x.o")))).alias("vector"))
    path = _folder(spark)
    writers.write_json(whole.coalesce(1), path)
    return readers.ranked_lists(spark, path).select("qid", "id", "score", "rank")


@plan("SELECT count(*) AS questions, '' AS team, 5 AS k, CAST(sum(item_id) AS BIGINT) AS ids, 0 AS filled FROM benchmark")
def submission_form(spark: SparkSession, folder: str) -> DataFrame:
    """The form to fill in holds all questions, in one document."""
    form = writers.submission_template(table(spark, folder, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question")))
    j = F.from_json("document", "team string, system struct<k int>, golden array<struct<id:long,retrieved:array<string>>>").alias("j")
    rows = form.select(j).select(F.size("j.golden").cast("long").alias("questions"), "j.team", "j.system.k", F.aggregate("j.golden", F.lit(0).cast("long"), lambda a, g: a + g["id"]).alias("ids"), F.aggregate("j.golden", F.lit(0), lambda a, g: a + F.size(g["retrieved"])).alias("filled"))
    return rows.select("questions", "team", "k", "ids", "filled")


@plan("SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_nationkey >= 13")
def saved_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Rows are appended twice; the newest twelve are read."""
    rows = table(spark, folder, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    store = writers.RowStore(spark, _folder(spark), ", ".join(f"{n} {k}" for n, k in rows.dtypes))
    if store.read().count():
        raise ValueError("a new store has rows")
    store.append(rows.filter("id < 13"))
    store.append(rows.filter("id >= 13"))
    return store.read()


_ESCAPED = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"


@plan(f"""SELECT item_id, '<mark data-k="a">' || {_ESCAPED.format("substr(text, 1, 5)")} || '</mark><mark data-k="a b">' || {_ESCAPED.format("substr(text, 6, 5)")} || '</mark><mark data-k="b">' || {_ESCAPED.format("substr(text, 11, 10)")} || '</mark>' || {_ESCAPED.format("substr(text, 21)")} AS html FROM benchmark WHERE length(text) > 20""")
def highlighted_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Two marks that overlap."""
    marks = F.array(F.struct(F.lit(0).alias("start"), F.lit(10).alias("end"), F.lit("a").alias("key")), F.struct(F.lit(5).alias("start"), F.lit(20).alias("end"), F.lit("b").alias("key")))
    rows = table(spark, folder, "benchmark").filter(F.char_length("text") > 20)
    return rows.select("item_id", highlight(cut_at_spans("text", marks)).alias("html"))


@plan("SELECT doc_id, split_part(doc_id || '#' || length(text), '#', 1) AS doc FROM documents")
def documents_of_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).select("doc_id", document_of(F.concat(F.col("doc_id").cast("string"), F.lit("#"), F.char_length("text"))).alias("doc"))


@plan(f"SELECT page_id, {_ESCAPED.format('url')} AS url FROM pages")
def escaped_urls(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select("page_id", escape_html("url").alias("url"))


