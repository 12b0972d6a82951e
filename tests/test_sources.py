"""Readers, writers, streams, and the driver's contract."""

import json

from pyspark.sql import functions as F

from loamdex.sources import readers as R
from loamdex.sources import writers as W
from loamdex.streaming.postings import append_postings, stored_index, windowed_counts


def test_corpus_and_golden(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"version": 1, "documents": [{"id": "a", "title": "T", "source": "s", "type": "guide", "text": "x"}, {"id": "b", "text": "y", "type": "broken", "broken": "ocr"}]}))
    docs = R.corpus(spark, str(tmp_path / "c.json"))
    assert [(r.ord, r.id, r.broken) for r in docs.orderBy("ord").collect()] == [(0, "a", None), (1, "b", "ocr")]
    (tmp_path / "g.json").write_text(json.dumps({"items": [{"id": "q1", "question": "?", "answer": "!", "evidence": [{"doc": "a", "quote": "x"}, {"doc": "b", "quote": "y"}]}]}))
    q, ev = R.golden(spark, str(tmp_path / "g.json"))
    assert q.count() == 1 and [r.ev for r in ev.orderBy("ev").collect()] == [0, 1]
    assert R.composite(docs, spark.createDataFrame([("a",)], "id string"), spark.createDataFrame([("z", "new")], "id string, text string")).count() == 2


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hello")
    (tmp_path / "b.html").write_text("<p>x</p><p>y</p>")
    (tmp_path / "big.md").write_text("z" * 2000)
    (tmp_path / "c.bin").write_text("no")
    got = {r.name: (r.text, r.error) for r in R.local_files(spark, str(tmp_path), 1000).collect()}
    assert got == {"a.txt": ("hello", None), "b.html": ("x\n\ny", None), "big.md": (None, "too large")}
    (tmp_path / "t1.json").write_text('{"team": "T"}')
    (tmp_path / "t2.json").write_text('{"team": "T", "notes": "later"}')
    (tmp_path / "t3.json").write_text("{")
    files = R.result_files(spark, str(tmp_path)).withColumn("modified", F.col("name"))
    assert sorted(r.name for r in R.latest_entries(files).collect()) == ["t2.json", "t3.json"]


def test_text_sources(spark):
    df = spark.createDataFrame([("a\n\n b\n\nc",)], "t string")
    assert df.select(R.paragraph("t", 1), R.paragraph("t", 9, "x")).first()[:] == (" b", " x")
    rows = spark.createDataFrame([("[가] 나\n\n다 \n[x]",)], "t string").select(R.labelled_lines("t").alias("r")).first().r
    assert [tuple(r) for r in rows] == [("가", "나"), (R.OTHER_TOPIC, "다"), (R.OTHER_TOPIC, "[x]")]
    pages = R.pages_of(spark.createDataFrame([(1, "a\nHead - 2 -\nb\nc"), (2, "x")], "doc_id int, text string")).orderBy("doc", "page").collect()
    assert [(p.doc, p.page, p.text) for p in pages] == [(1, 1, "a"), (1, 2, "b\nc"), (2, 1, "x")]


def test_sinks(spark, tmp_path):
    t = W.submission_template(spark.createDataFrame([("q1", "?"), ("q2", "!")], "qid string, question string"))
    made = json.loads(t.first().document)
    assert [g["id"] for g in made["golden"]] == ["q1", "q2"] and made["system"]["k"] == 5 and made["system"]["llm"] is None
    W.write_text(t, str(tmp_path / "t"))
    W.write_json(t, str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "t")).count() == 1 and spark.read.json(str(tmp_path / "j")).count() == 1
    store = W.RowStore(spark, str(tmp_path / "rows"), "name string, hit double")
    assert store.read().count() == 0
    for i in range(3):
        store.append(spark.createDataFrame([(f"r{i}", i / 3)], "name string, hit double"))
    assert [r.name for r in store.read(2).collect()] == ["r2", "r1"]
    assert W.text_table(store.read(1)) == "name  hit\nr2    0.6667"


def test_streams(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "index")
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "beta gamma")], "doc_id long, text string")
    for i in (1, 2):
        docs.filter(F.col("doc_id") == i).write.mode("append").parquet(source)
        append_postings(spark.readStream.schema(docs.schema).parquet(source), folder, str(tmp_path / "cp")).awaitTermination()
    index = stored_index(spark, folder)
    assert index.size.first().n == 2
    asked = spark.createDataFrame([(1, "gamma")], "qid int, question string")
    assert [r.id for r in index.search(asked, 5).collect()] == [2]
    events = spark.createDataFrame([("2024-01-01 00:00:01", "a", 1.0), ("2024-01-01 00:06:00", "a", 2.0)], "ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    assert windowed_counts(events).count() == 2


def test_contract(spark):
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 50
    df = entry.entry(spark)
    assert df.columns == ["recall", "precision", "hit", "mrr", "mrr_at_k", "ndcg", "n"] and df.count() == 1


def test_texts_in_files_that_are_read(spark, tmp_path):
    """Files over the bound were refused, and with them their texts."""
    texts = ["a" * 40, "", "é" * 20, "b" * 120, "c" * 59, "d" * 30]
    W.write_text(spark.createDataFrame([(t,) for t in texts], "document string").coalesce(1), f"{tmp_path}/t", most=100)
    files = R.local_files(spark, f"{tmp_path}/t", 121).collect()
    assert all(f.error is None for f in files) and sorted(len(f.text.encode()) for f in files) == [83, 91, 121]
    assert sorted("".join(f.text for f in files).split("\n")[:-1]) == sorted(texts)


def test_turns_of_more_than_a_file(spark, tmp_path):
    from loamdex.plans.files import QUERIES

    rows = [(1, i, "user", "x" * 40_000) for i in range(60)] + [(2, 0, "user", "y" * 1_200_000), (2, 1, "user", None)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    assert [tuple(r) for r in QUERIES["text_files"](spark, str(tmp_path)).collect()] == [(60 * 40_001 + 1_200_001, 0)]
