"""Table functions, files that are refused, and conversations from a stream."""

import pytest
from pyspark.sql import functions as F

from loamdex.functions.tables import register
from loamdex.functions.text import sentences
from loamdex.operators.chunking import ChunkConfig, chunk
from loamdex.operators.conversation import with_history
from loamdex.sources.readers import local_files, result_files
from loamdex.streaming.conversations import STORE, streamed_history

TEXTS = [(1, "One. Two is it!  Three\nfour"), (2, ""), (3, None), (4, "가나. 다라? \"마.\" 끝"), (5, "no end"), (6, "  \n\n ")]


def test_sentences_by_sql(spark):
    df = spark.createDataFrame(TEXTS, "id int, text string")
    got = register(spark).sql("SELECT id, s.index, s.text FROM {df}, LATERAL text_sentences(text) s", df=df)
    expected = df.select("id", F.posexplode(sentences("text")).alias("index", "text"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))


@pytest.mark.parametrize("strategy", ["fixed", "sentence", "recursive"])
def test_chunks_by_sql(spark, strategy):
    df = spark.createDataFrame(TEXTS, "id int, text string")
    got = register(spark).sql("SELECT id, c.index, c.start, c.end, c.text FROM {df}, LATERAL text_chunks(text, '" + strategy + "', 8, 2) c", df=df)
    expected = chunk(df, ChunkConfig(strategy, 8, 2), "id").select("doc", "index", "start", "end", "text")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))


def test_words_by_sql(spark):
    rows = register(spark).sql("SELECT * FROM text_words('b a B c a_d', 3)").collect()
    assert [tuple(r) for r in rows] == [(0, "a", 2), (1, "b", 2), (2, "c", 1)]


def test_files_are_refused_by_name_and_size(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, body in (("a.txt", b"hello"), ("B.MD", b"# hi"), ("sub/c.html", b"<p>x<p>y"), ("d.pdf", b"%PDF"), ("e.txt", b"\xff\xfe"), ("f.htm", b"<b>" + b"z" * 200), ("g.txt", b""), ("txt", b"no ending")):
        (tmp_path / name).write_bytes(body)
    got = {r.name: (r.text, r.error) for r in local_files(spark, str(tmp_path), 100).collect()}
    assert got == {"a.txt": ("hello", None), "B.MD": ("# hi", None), "c.html": ("x\ny", None), "e.txt": (None, "not UTF-8"), "f.htm": (None, "too large")}  # an empty file has no row
    plan = local_files(spark, str(tmp_path), 100)._jdf.queryExecution().toString()
    assert "LessThanOrEqual(length,100)" in plan and "GreaterThan(length,100)" in plan
    (tmp_path / "r.json").write_text('{"team": "t"}')
    (tmp_path / "s.JSON").write_text("broken")
    assert {(r.name, r.team) for r in result_files(spark, str(tmp_path)).collect()} == {("r.json", "t"), ("s.JSON", None)}


def test_history_from_a_stream(spark, tmp_path):
    schema = "conv_id long, turn long, role string, text string"
    first = [(1, 0, "user", "a"), (1, 1, "assistant", "x"), (1, 2, "user", "b"), (2, 0, "user", "z"), (1, 4, "user", None)]
    second = [(1, 8, "user", "e"), (1, 6, "user", "d"), (2, 2, "user", "y"), (3, 0, "assistant", "q")]
    spark.conf.set(*STORE)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    try:
        for batch in (first, second):
            spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
            stream = streamed_history(spark.readStream.schema(schema).json(str(tmp_path / "in")), 2)
            stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(STORE[0])
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    got = spark.read.schema(stream.schema).parquet(str(tmp_path / "out"))
    every = with_history(spark.createDataFrame(first + second, schema), 2).select("conv_id", "turn", "history", "previous_turn")
    assert {(r.conv_id, r.turn, r.previous_turn) for r in got.collect()} == {(r.conv_id, r.turn, r.previous_turn) for r in every.collect()}
    histories = {(r.conv_id, r.turn): r.history for r in got.collect()}
    # a null text is a turn of its own in the state; a window of collected texts leaves it out
    assert histories[1, 6] == ["b", None] and histories[1, 8] == [None, "d"] and histories[2, 2] == ["z"] and histories[1, 0] == []
