"""Diffs, pages, embedding once, retriever interfaces, stand-ins."""

import random

from pyspark.sql import functions as F

from loamdex.functions import cleaning as C
from loamdex.functions import diffs as D
from loamdex.functions import text as T
from loamdex.operators import answers as A
from loamdex.operators import embedding as E
from loamdex.operators import metrics as M
from loamdex.operators import retrieval as R
from loamdex.operators import selfquery as S
from loamdex.operators.chunking import ChunkConfig
from loamdex.sources import readers


def common(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_diffs(monkeypatch):
    rng = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randint(0, 12))) for _ in range(2))
        runs = D.text_diff(a, b)
        assert "".join(r["text"] for r in runs if r["type"] != "ins") == a and "".join(r["text"] for r in runs if r["type"] != "del") == b
        assert sum(len(r["text"]) for r in runs if r["type"] == "eq") == common(a, b)
        assert all(x["type"] != y["type"] for x, y in zip(runs, runs[1:]))
    assert D.text_diff("5O%", "50%") == [{"type": "eq", "text": "5"}, {"type": "del", "text": "O"}, {"type": "ins", "text": "0"}, {"type": "eq", "text": "%"}]
    monkeypatch.setattr(D, "MOST_CELLS_CHARS", 4)
    assert [r["type"] for r in D.text_diff("x abc def y", "x abd def y")] == ["eq", "del", "ins", "eq"]
    monkeypatch.setattr(D, "MOST_CELLS_WORDS", 0)
    assert D.text_diff("xay", "xby") == [{"type": "eq", "text": "x"}, {"type": "del", "text": "a"}, {"type": "ins", "text": "b"}, {"type": "eq", "text": "y"}]


def test_repeated_lines(spark):
    pages = spark.createDataFrame([(1, 1, "Head 1\nfirst"), (1, 2, "Head 2\nsecond"), (1, 3, "third"), (2, 1, "Head 9")], "doc int, page int, text string")
    got = {(r.doc, r.page): r.text for r in C.remove_repeated(pages).collect()}
    assert got == {(1, 1): "first", (1, 2): "second", (1, 3): "third", (2, 1): "Head 9"}


def test_facts(spark):
    docs = spark.createDataFrame([("a", "x y z")], "doc_id string, text string")
    checks = spark.createDataFrame([("a", "1", "x y"), ("a", "2", "xy"), ("a", "3", "q"), ("b", "4", "x")], "doc string, label string, needle string")
    assert {r.label: r.state for r in C.check_facts(docs, checks).collect()} == {"1": "present", "2": "spaced", "3": "absent", "4": "absent"}


def test_embedding_once(spark):
    texts = spark.createDataFrame([(1, "ab"), (2, "ab"), (3, None), (4, "cd")], "id int, text string")
    seen = spark.sparkContext.accumulator(0)

    class Counting:
        name = "counting"

        def embed(self, text):
            def load():
                def model(batch):
                    seen.add(len(batch))
                    return [[float(len(t))] for t in batch]

                return model

            return E.model_embedding(load)(text)

    got = {r.id: r.embedding for r in E.embed_once(texts, Counting()).collect()}
    assert got == {1: [2.0], 2: [2.0], 3: None, 4: [2.0]} and seen.value == 2
    known = spark.createDataFrame([("counting", "passage", "ab", [9.0])], "model string, role string, text string, embedding array<double>")
    assert {r.id: r.embedding for r in E.embed_once(texts, Counting(), known=known).collect()}[1] == [9.0]


def test_retrievers(spark):
    texts = spark.createDataFrame([(1, "alpha beta"), (2, "gamma delta"), (3, "beta beta")], "id long, text string")
    asked = spark.createDataFrame([(7, "gamma")], "qid long, question string")
    keyword = R.Bm25Index.build(texts, "id")
    both = R.HybridRetriever([keyword, R.VectorRetriever(texts, E.ToyEmbedder())])
    for r in (keyword, both):
        assert r.search(asked, 2).filter("rank = 1").first().id == 2
    ev = spark.createDataFrame([(7, 2, "delta"), (8, 1, "zeta")], "qid long, doc long, quote string")
    chunks = texts.withColumn("doc", F.col("id"))
    assert {r.qid: r["rank"] for r in R.evidence_rank(keyword.search(asked, 2), chunks, ev).collect()} == {7: 1, 8: 0}
    assert [tuple(r) for r in R.relevant_ids(chunks, ev).collect()] == [(7, 2)]
    scored = R.with_scores(spark.createDataFrame([(7, 1), (7, 2)], "qid long, id long"), keyword.search(asked, 2)).collect()
    assert {r.id: r.score > 0 for r in scored} == {1: False, 2: True}
    row = R.simulate(texts, asked, ev.filter("qid = 7"), ChunkConfig("fixed", 50, 0, k=1), "id").first()
    assert (row.chunks, row.hit, row.mrr, row.context) == (3, 1.0, 1.0, 11) and abs(row.density - 5 / 11) < 1e-12


def test_safe_search(spark):
    rows = spark.createDataFrame([(0, "a", 3), (1, "b", 1)], "ord int, id string, credits int")
    ranking = spark.createDataFrame([("b", 2.0), ("a", 1.0)], "id string, score double")
    schema = {"credits": {"kind": "int", "min": 1, "max": 5}}
    got, errors = S.safe_search(rows, ranking, {"query": "x", "filter": {"credits": 3}}, schema, 2)
    assert not errors and [r.id for r in got.collect()] == ["a"]
    got, errors = S.safe_search(rows, ranking, {"query": "x", "filter": {"price": 3}}, schema, 2)
    assert errors and [r.id for r in got.orderBy("rank").collect()] == ["b", "a"]


def test_stand_ins(spark):
    prompts = spark.createDataFrame([(1, "how many hours", ["Nothing. It takes 12 hours at most."]), (2, "how many hours", None)], "qid long, question string, texts array<string>")
    got = {r.qid: r for r in A.GuessingGenerator(["4 hours", "6 hours"]).generate(prompts).collect()}
    assert got[1].answer == got[1].cite == "It takes 12 hours at most." and got[2].cite is None and got[2].answer in ("4 hours", "6 hours")
    v = spark.createDataFrame([("12 hours", "it takes 12 hours", "12hours"), (None, "x", "x")], "c string, s string, f string").select(A.verifiable(F.col("c"), F.col("s"), F.col("f")).alias("v")).collect()
    assert [r.v for r in v] == [True, False]
    made = A.variants(prompts.select("qid", "question"), {"A": ("s", "{question}?"), "B": ("t", "! {other}")}, {"question": F.col("question")})
    assert {(r.variant, r.user) for r in made.collect()} == {("A", "how many hours?"), ("B", "! {other}")}
    assert T.group_pieces(["한".encode()[:1], "한".encode()[1:], b"a"]) == [("한", 2), ("a", 1)] and T.group_pieces([b"\xff"] * 9)[0] == ("�" * 8, 8)


def test_small_tables(spark, tmp_path):
    (tmp_path / "h.json").write_text('{"vector": {"q1": [{"id": "d#1", "score": 0.9}, {"id": "d#0", "score": 0.8}]}}')
    assert [(r.qid, r.id, r["rank"]) for r in readers.ranked_lists(spark, str(tmp_path / "h.json")).collect()] == [("q1", "d#1", 1), ("q1", "d#0", 2)]
    pairs = spark.createDataFrame([(0, 1, 0.5), (0, 2, 1.0)], "i int, j int, sim double")
    assert [r.scaled for r in E.off_diagonal_scale(pairs).orderBy("sim").collect()] == [0.0, 1.0]
    rows = spark.createDataFrame([("나", 1.0), ("가", 1.0), ("다", 2.0)], "team string, hit double")
    assert [r.team for r in M.sorted_board(rows, "hit", "team").collect()] == ["다", "가", "나"]
