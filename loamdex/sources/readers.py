"""Sources as lazy DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamdex.functions.html import html_to_text
from loamdex.functions.text import _c, trim_blank

MOST_BYTES, MOST_RESULT_BYTES, MOST_LINES = 1_000_000, 2_000_000, 16
TEXT_TYPES = ("txt", "md", "html", "htm")
OTHER_TOPIC = "기타"
CORPUS = "version int, description string, documents array<struct<id:string,title:string,source:string,type:string,text:string,broken:string>>"
GOLDEN = "items array<struct<id:string,question:string,answer:string,evidence:array<struct<doc:string,quote:string>>,note:string>>"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a corpus object (one JSON object a file), in order."""
    return spark.read.schema(CORPUS).option("multiLine", True).json(path).select(F.posexplode("documents").alias("ord", "d")).select("ord", "d.*")


def golden(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(questions (qid, question, answer), evidence (qid, ev, doc, quote)) of a golden set."""
    items = spark.read.schema(GOLDEN).option("multiLine", True).json(path).select(F.explode("items").alias("i")).select("i.*")
    return items.select(F.col("id").alias("qid"), "question", "answer"), items.select(F.col("id").alias("qid"), F.posexplode("evidence").alias("ev", "e")).select("qid", "ev", "e.doc", "e.quote")


def sources(spark: SparkSession, paths: dict[str, str]) -> dict[str, DataFrame]:
    """Several corpora at once; a path that doesn't exist fails all of them."""
    return {name: corpus(spark, path) for name, path in paths.items()}


def _small_files(spark: SparkSession, path: str, types: tuple[str, ...], most: int, deep: bool) -> DataFrame:
    """(path, name, modificationTime, bytes, error) of files with these endings, in any case.

    Names are told apart when folders are listed. The bound on the length goes down to the source, so that files over it
    are never opened: they come from a second scan that asks for no contents. Bytes that are no UTF-8 are an error too.
    """
    glob = "*.{" + ",".join("".join(f"[{c}{c.upper()}]" for c in t) for t in types) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", deep).option("pathGlobFilter", glob).load(path)
    name = F.element_at(F.split("path", "/"), -1).alias("name")
    own = files.filter(F.col("length") <= most).select("path", name, "modificationTime", F.col("content").cast("string").alias("_t"))
    valid = F.is_valid_utf8("_t")
    own = own.select("path", "name", "modificationTime", F.when(valid, F.col("_t")).alias("text"), F.when(~valid, "not UTF-8").alias("error"))
    large = files.filter(F.col("length") > most).select("path", name, "modificationTime", F.lit(None).cast("string").alias("text"), F.lit("too large").alias("error"))
    return own.unionByName(large)


def local_files(spark: SparkSession, path: str, most: int = MOST_BYTES) -> DataFrame:
    """(path, name, text, error) of text, markdown and HTML files; those that are too large or no UTF-8 keep a row with an error instead of a text, empty ones have none."""
    files = _small_files(spark, path, TEXT_TYPES, most, True)
    return files.select("path", "name", F.when(F.lower("name").rlike(r"\.html?$"), html_to_text("text")).otherwise(F.col("text")).alias("text"), "error")


def result_files(spark: SparkSession, path: str, most: int = MOST_RESULT_BYTES) -> DataFrame:
    """(path, name, text, team, modified) of submitted .json files; bad ones stay as rows, their team is null."""
    team = F.try_variant_get(F.try_parse_json("text"), "$.team", "string")
    return _small_files(spark, path, ("json",), most, False).select("path", "name", "text", team.alias("team"), F.col("modificationTime").alias("modified"))


def latest(rows: DataFrame, key: Column | str, order: str) -> DataFrame:
    """The newest row of each key."""
    w = Window.partitionBy(_c(key)).orderBy(F.col(order).desc())
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def latest_entries(files: DataFrame) -> DataFrame:
    """The newest submission of each team; files without a team are told apart by name."""
    return latest(files.withColumn("entry", F.coalesce(F.concat(F.lit("team:"), trim_blank("team")), F.concat(F.lit("file:"), "name"))), "entry", "modified")


def paragraph(text: Column | str, p: int, more: str | None = None) -> Column:
    """The p-th paragraph (from 0), empty if there is none, with a text appended."""
    own = F.coalesce(F.get(F.split(_c(text), r"(?U)\n\s*\n"), F.lit(p)), F.lit(""))
    return F.concat(own, F.lit(f" {more}")) if more else own


def labelled_lines(text: Column | str, most: int = MOST_LINES) -> Column:
    """Array of (topic, text) of '[topic] text' lines; lines without a topic get the default one. The first most of them, as the panel shows."""
    lines = F.slice(F.filter(F.transform(F.split(_c(text), "\n"), trim_blank), lambda s: s != ""), 1, most)
    pattern = r"^\[([^\]]{1,20})\]\s*(.+)$"
    return F.transform(lines, lambda s: F.struct(F.when(s.rlike(pattern), trim_blank(F.regexp_extract(s, pattern, 1))).otherwise(OTHER_TOPIC).alias("topic"), F.when(s.rlike(pattern), trim_blank(F.regexp_extract(s, pattern, 2))).otherwise(s).alias("text")))


def composite(corpus_docs: DataFrame, shared: DataFrame, extra: DataFrame, id: str = "id") -> DataFrame:
    """Documents of the corpus whose ids are shared, and extra ones."""
    return corpus_docs.join(shared, id, "left_semi").unionByName(extra, allowMissingColumns=True)


def pages_of(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, page, text): a line that ends in '- n -' starts page n and isn't part of it."""
    pattern = r"-\s*(\d+)\s*-\s*$"
    lines = docs.select(F.col(id).alias("doc"), F.posexplode(F.split(text, "\n")).alias("_i", "_l"))
    w = Window.partitionBy("doc").orderBy("_i")
    mark = F.when(F.col("_l").rlike(pattern), F.regexp_extract("_l", pattern, 1).cast("int"))
    lines = lines.withColumn("_m", mark).withColumn("_s", F.count("_m").over(w)).withColumn("page", F.coalesce(F.last("_m", ignorenulls=True).over(w), F.lit(1)))
    own = lines.filter("_m is null").groupBy("doc", "_s", "page").agg(F.sort_array(F.collect_list(F.struct("_i", "_l"))).alias("_x"))
    return own.select("doc", "page", F.array_join("_x._l", "\n").alias("text"))


def shuffled(rows: DataFrame, seed: str | int, key: str) -> DataFrame:
    """rows with a seeded random order number; the same for the same seed."""
    return rows.withColumn("order", F.xxhash64(F.lit(str(seed)), key))


def ranked_lists(spark: SparkSession, path: str) -> DataFrame:
    """(qid, id, score, rank) of lists that were computed before: one JSON object with vector: {question: [{id, score}]}."""
    schema = "vector map<string,array<struct<id:string,score:double>>>"
    lists = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("vector").alias("qid", "list"))
    return lists.select("qid", F.posexplode("list").alias("rank", "r")).select("qid", "r.id", "r.score", (F.col("rank") + 1).alias("rank"))


def chunks_of(chunks: DataFrame, doc) -> DataFrame:
    """All chunks of a document in order, without a search."""
    return chunks.filter(F.col("doc") == doc).orderBy("index")
