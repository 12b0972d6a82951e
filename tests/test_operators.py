"""Chunks, search, fusion, metrics, self-queries, answers, conversations, quizzes, validators on small cases."""

import json
import math

import pytest
from pyspark.sql import functions as F

from loamdex.functions import vectors as V2
from loamdex.operators import answers as A
from loamdex.operators import chunking as K
from loamdex.operators import conversation as V
from loamdex.operators import fusion as U
from loamdex.operators import metrics as M
from loamdex.operators import quiz as Z
from loamdex.operators import selfquery as S
from loamdex.operators import validators as D
from loamdex.operators import matching
from loamdex.operators.matching import containing
from loamdex.operators.retrieval import Bm25Index, GraphIndex, IvfIndex, generated_vectors, list_recall, vector_search


# ---- chunks


def by_row(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def test_fixed_chunks(spark):
    docs = spark.createDataFrame([(1, "abcdefghij"), (2, ""), (3, None), (4, "ab   cd")], "doc_id long, text string")
    got = K.chunk(docs, K.ChunkConfig("fixed", 4, 1)).orderBy("doc", "index").collect()
    assert [(r.start, r.text) for r in got if r.doc == 1] == [(0, "abcd"), (3, "defg"), (6, "ghij")]
    assert [r.chunk_id for r in got if r.doc == 4] == ["4#0", "4#1"] and {r.doc for r in got} == {1, 4}


def test_recursive_and_packed_chunks():
    t = "가나다. 라마바.\n\n사아자 차카타 파하. 끝이다. 정말 길고 긴 문장이 하나 더 있다"
    for strategy in K.STRATEGIES:
        for size, overlap in ((5, 0), (8, 3), (12, 5), (100, 0)):
            found = K.cut(t, strategy, size, overlap)
            assert all(0 < e - s <= size for s, e in found)
            covered = set().union(*(range(s, e) for s, e in found))
            assert all(i in covered or t[i].isspace() for i in range(len(t)))
    assert K.cut(t, "recursive", 100) == [(0, len(t))]
    assert ["aa bb cc"[s:e] for s, e in K.cut("aa bb cc", "recursive", 3)] == ["aa ", "bb ", "cc"]
    with pytest.raises(ValueError):
        K.cut(t, "other")


def test_configs():
    assert K.clamp(0, 9) == (1, 0) and K.clamp(4, 9) == (4, 3)
    for bad in ({"overlap": 300}, {"k": 0}, {"strategy": "x"}):
        with pytest.raises(ValueError):
            K.ChunkConfig(**bad)
    with pytest.raises(TypeError):
        K.ChunkConfig(sizes=3)
    assert K.from_character_splitter().overlap == 200 and abs(K.overlap_formula(100, 40) - 2 / 3) < 1e-12


def test_overlap_costs(spark):
    docs = spark.createDataFrame([(1, "x" * 30_000)], "doc_id long, text string")
    row = K.overlap_cost(K.chunk(docs, K.ChunkConfig("fixed", 300, 60)), docs).first()
    assert row.chunks == 125 and row.chunk_chars == 37_440 and abs(row.extra - 0.248) < 1e-9
    s = K.chunk_stats(K.chunk(docs, K.ChunkConfig("fixed", 300, 0)), docs).first()
    assert (s["count"], s.avg, s.min, s.max, s.duplicated) == (100, 300, 300, 300, 0.0)


def test_evidence(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (2, "nothing here")], "doc_id long, text string")
    quotes = spark.createDataFrame([(0, "three four five six seven"), (1, "ten"), (2, ""), (3, "wo three four five six sev")], "qid long, quote string")
    assert sorted(map(tuple, containing(docs, quotes).collect())) == [(0, 1), (1, 1), (3, 1)]
    monkeypatch.setattr(matching, "SET_QUOTES", 0)
    assert sorted(map(tuple, containing(docs, quotes).collect())) == [(0, 1), (1, 1), (3, 1)]
    q = quotes.filter("qid = 0").select(F.lit(1).cast("long").alias("doc"), "qid", "quote")
    rates = {(r.strategy, r["size"]): r.rate for r in K.survival(docs, q, [K.ChunkConfig("fixed", 10), K.ChunkConfig("fixed", 60)]).collect()}
    assert rates == {("fixed", 10): 0.0, ("fixed", 60): 1.0}
    cover = K.cover(K.chunk(docs.filter("doc_id = 2"), K.ChunkConfig("fixed", 8, 4))).orderBy("start").collect()
    assert [(r.start, r.end, r.n) for r in cover] == [(0, 4, 1), (4, 8, 2), (8, 12, 1)]


# ---- search


def test_bm25_formula(spark):
    docs = spark.createDataFrame([(i, "rare " + "x " * 40 if i == 0 else "x " * 75) for i in range(37)], "doc_id long, text string")
    index = Bm25Index.build(docs)
    idf = index.idf().filter("term = 'rare'").first().idf
    assert round(idf, 3) == 3.232
    asked = spark.createDataFrame([(1, "rare rare nowhere"), (2, "nowhere")], "qid long, question string")
    got = index.search(asked, 3).collect()
    avg = (41 + 36 * 75) / 37
    assert [(r.qid, r.id) for r in got] == [(1, 0)] and abs(got[0].score - idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 41 / avg))) < 1e-6
    more = index.add(spark.createDataFrame([(99, "rare")], "doc_id long, text string"))
    assert more.search(asked, 3).count() == 2 and more.size.first().n == 38


def test_vector_search(spark):
    v = generated_vectors(spark, 600, 16, clusters=8).cache()
    q = v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    exact = vector_search(v, q, 5).cache()
    assert exact.count() == 60 and all(r.id == r.qid and r.score == 1.0 for r in exact.filter("rank = 1").collect())
    others = vector_search(v, q, 4, skip_self=True)
    assert sorted((r.qid, r.id) for r in others.collect()) == sorted((r.qid, r.id) for r in exact.filter("rank > 1").collect())
    topics = v.withColumn("label", F.col("vec_id") % 3).filter("vec_id < 90")
    pairs = V2.similarity_pairs(topics).collect()
    same = [p.sim for p in pairs if p.i % 3 == p.j % 3]
    near = {}
    for p in pairs:
        for i, j in ((p.i, p.j), (p.j, p.i)):
            near[i] = max(near.get(i, (-2, 0)), (round(p.sim, 9), -j))
    m = V2.topic_metrics(topics).first()
    assert abs(m.same - sum(same) / len(same)) < 1e-9 and m.nn_total == 90 and m.nn_hits == sum(-j % 3 == i % 3 for i, (_, j) in near.items())
    assert abs(m["diff"] - sum(p.sim for p in pairs if p.i % 3 != p.j % 3) / (len(pairs) - len(same))) < 1e-9
    assert list_recall(IvfIndex(v, 16).search(q, 5, 8), exact, 5).agg(F.avg("recall")).first()[0] >= 0.9
    assert list_recall(GraphIndex(v, shard_rows=200).search(q, 5, 32), exact, 5).agg(F.avg("recall")).first()[0] >= 0.9
    # more queries than a block: products of blocks give the same rows, whatever the ids are
    assert by_row(vector_search(v, q, 5, block=5)) == by_row(exact)
    assert by_row(vector_search(v, q, 4, skip_self=True, block=1)) == by_row(others)
    named = lambda df, c: df.withColumn(c, F.concat(F.lit("v"), F.lpad(F.col(c).cast("string"), 5, "0")))
    for block in (5, 1024):
        got = vector_search(named(v, "vec_id"), named(q, "qid"), 5, block=block)
        assert by_row(got) == by_row(named(named(exact, "qid"), "id"))
    # a beam of one still gives k rows, from what the walk looked at
    narrow = GraphIndex(v, shard_rows=200).search(q, 5, 1)
    assert narrow.count() == 60 and narrow.groupBy("qid").count().filter("count < 5").count() == 0
    bad = v.unionByName(spark.createDataFrame([(9999, [1.0])], "vec_id long, embedding array<float>"))
    with pytest.raises(Exception, match="vectors of|same shape"):
        vector_search(bad.coalesce(1), q, 5).collect()
    zero = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [r.score for r in vector_search(zero, zero.select(F.col("vec_id").alias("qid"), "embedding"), 2).filter("qid = 1").collect()] == [0.0, 0.0]


def test_graphs_are_asked_in_blocks(spark, tmp_path, monkeypatch):
    from loamdex.operators import retrieval as R
    from loamdex.plans import retrieval as P

    v = generated_vectors(spark, 600, 8, clusters=4).cache()
    q = v.filter("vec_id % 10 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    whole = sorted(map(tuple, GraphIndex(v, shard_rows=200).search(q, 5, 32).collect()))
    monkeypatch.setattr(R, "BLOCK", 7)
    monkeypatch.setattr(P, "BLOCK", 7, raising=False)
    assert sorted(map(tuple, GraphIndex(v, shard_rows=200).search(q, 5, 32).collect())) == whole and len({r[0] for r in whole}) == 60
    v.write.parquet(f"{tmp_path}/embeddings.parquet")
    asked = []
    monkeypatch.setattr(P, "list_recall", lambda a, e, k: asked.append((a.select("qid").distinct().count(), e.select("qid").distinct().count())) or list_recall(a, e, k))
    assert P.graph_recall(spark, str(tmp_path)).count() == 3 and asked == [(12, 12)] * 3


def test_quiz_items_look_into_all_documents(spark, tmp_path):
    from loamdex.plans import texts as T

    rows = [(i, "45%" if i < 30 else f"The share of answers in group {i} was {i}% of all.") for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [r.chunk for r in T.quiz_items(spark, str(tmp_path)).orderBy("chunk").collect()] == [str(i) for i in range(30, 40)]


def _list(spark, ids, scores=None):
    return spark.createDataFrame([(1, x, float(s), i + 1) for i, (x, s) in enumerate(zip(ids, scores or range(len(ids), 0, -1)))], "qid int, id string, score double, rank int")


def test_fusion(spark):
    a, b = _list(spark, "ABCD"), _list(spark, "CEFD")
    got = U.reciprocal_rank_fusion([a, b]).orderBy("rank").collect()
    assert [r.id for r in got] == ["C", "D", "A", "B", "E", "F"] and abs(got[0].score - (1 / 63 + 1 / 61)) < 1e-9 and got[0].ranks == {0: 3, 1: 1}
    kw, vec = _list(spark, "ABC", [12.4, 7.9, 2.1]), _list(spark, "BAC", [0.871, 0.866, 0.812])
    assert [r.id for r in U.weighted_fusion(vec, kw, 1.0).orderBy("rank").collect()] == ["B", "A", "C"]
    assert [r.id for r in U.weighted_fusion(vec, kw, 0.0).orderBy("rank").collect()] == ["A", "B", "C"]
    assert {r.score for r in U.min_max(_list(spark, "AB", [3, 3])).collect()} == {1.0}
    assert [(r.id, r.mark) for r in U.movement(b, a).orderBy("rank").collect()] == [("C", "up"), ("E", "new"), ("F", "new"), ("D", "same")]


def test_metrics(spark):
    runs = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3), (2, "x", 1)], "qid int, id string, rank int")
    rel = spark.createDataFrame([(1, "b"), (1, "z"), (2, "y")], "qid int, id string")
    asked = spark.createDataFrame([(1,), (2,), (3,)], "qid int")
    got = {r.qid: r for r in M.per_query(runs, rel, asked, 2).collect()}
    assert (got[1].recall, got[1].precision, got[1].hit, got[1].rr) == (0.5, 0.5, 1, 0.5) and abs(got[1].ndcg - (1 / math.log2(3)) / (1 + 1 / math.log2(3))) < 1e-12
    assert (got[2].recall, got[2].rr, got[3].recall, got[3].ndcg) == (0, 0, 0, 0)
    m = M.evaluate(runs, rel, asked, 2).first()
    assert m.n == 3 and m.hit == round(1 / 3, 6)
    w = spark.range(1).select(M.wilson(F.lit(0), F.lit(0)).alias("a"), M.wilson(F.lit(11), F.lit(12)).alias("b")).first()
    assert tuple(w.a) == (0.0, 0.0) and 0.64 < w.b.low < 0.65 and 0.98 < w.b.high < 0.99
    s = spark.createDataFrame([(["a"], []), ([], []), (["a", "b"], ["b"])], "x array<string>, y array<string>").select(M.set_score(F.col("x"), F.col("y")).alias("s")).collect()
    assert [tuple(r.s) for r in s] == [(0, 0.0, None), (0, 1.0, None), (1, 0.5, 1.0)]


def test_labels_once(spark):
    runs = spark.createDataFrame([(1, "d#0", 1), (1, "d#1", 2), (1, "e#0", 3)], "qid int, id string, rank int")
    chunks = spark.createDataFrame([("d#0", "d", "the quote"), ("d#1", "d", "the quote too"), ("e#0", "e", "z")], "id string, doc string, text string")
    ev = spark.createDataFrame([(1, 0, "d", "quote"), (1, 1, "e", "nope")], "qid int, ev int, doc string, quote string")
    labelled, rel = M.label_run(runs, chunks, ev)
    assert [r.id for r in labelled.orderBy("rank").collect()] == ["ev:0", "d#1", "e#0"] and rel.count() == 2
    docs, _ = M.label_run(runs, chunks, ev, "doc")
    assert [r.id for r in docs.orderBy("rank").collect()] == ["doc:d", "d#1", "doc:e"]
    assert M.never_whole(chunks, ev.withColumn("quote", F.lit("absent"))).count() == 1


def test_team_scores(spark):
    golden = spark.createDataFrame([("q1", ["d"]), ("q2", ["e"])], "qid string, docs array<string>")
    sub = spark.createDataFrame([("T", "q1", ["x#1", "d#2", "d#3"], ["d#9"])], "team string, qid string, retrieved array<string>, citations array<string>")
    r = M.team_scores(sub, golden, 3).first()
    assert (r.recall, r.mrr, r.hit, r.cite, r.cite_ok) == (0.5, 0.25, 0.5, 0.5, 0.5)
    board = M.board(spark.createDataFrame([("a", 0.5), ("b", 0.7)], "t string, s double"), ["s"]).collect()
    assert {r.t: r.best_s for r in board} == {"a": False, "b": True}


# ---- self-queries


SCHEMA = {"type": {"kind": "enum", "values": ["course", "timetable", "scholarship"]}, "day": {"kind": "enum", "values": list("월화수목금")}, "room": {"kind": "enum", "values": ["305", "306"]},
          "periodStart": {"kind": "int", "min": 1, "max": 6}, "periodEnd": {"kind": "int", "min": 1, "max": 6}, "credits": {"kind": "int", "min": 1, "max": 5}, "professor": {"kind": "enum", "values": ["조 교수", "공동"]}, "semester": {"kind": "int", "min": 1, "max": 2}}


def test_rule_parser():
    q = S.parse("화요일 오전 305호 수업은 뭐야?", SCHEMA)
    assert q["filter"] == {"day": "화", "room": "305", "periodEnd": {"lte": 3}, "type": "timetable"} and q["intent"] == "list" and q["query"] == ""
    assert S.parse("3학점 이상 과목은 몇 개야?", SCHEMA)["filter"] == {"credits": {"gte": 3}, "type": "course"} and S.parse("3학점 이상 과목은 몇 개야?", SCHEMA)["intent"] == "count"
    assert S.parse("월요일이나 수요일에 조 교수님 강의", SCHEMA)["filter"]["day"] == {"in": ["월", "수"]}
    assert not S.validate({k: v for k, v in q.items() if k != "trace"}, SCHEMA)


def test_validation():
    bad = [3, {"filter": []}, {"x": 1}, {"intent": "drop"}, {"filter": {"price": 1}}, {"filter": {"day": "일"}}, {"filter": {"day": {"gte": 1}}}, {"filter": {"credits": {}}}, {"filter": {"credits": {"near": 2}}}, {"filter": {"credits": {"in": []}}}, {"filter": {"credits": 2.5}}, {"filter": {"credits": True}}, {"filter": {"credits": ["1"]}}]
    assert all(S.validate(b, SCHEMA) for b in bad) and not S.validate({}, SCHEMA)
    assert S.extract_json('Sure:\n```json\n{"query": "a"}\n``` ok') == {"query": "a"}
    with pytest.raises(ValueError):
        S.extract_json("none")


def test_filters(spark):
    rows = spark.createDataFrame([(0, "a", 3, "월"), (1, "b", None, "화"), (2, "c", 2, None)], "ord int, id string, credits int, day string")
    ids = lambda f: [r.id for r in rows.filter(S.predicate(f)).orderBy("ord").collect()]
    assert ids({}) == ["a", "b", "c"] and ids({"credits": {"gte": 2, "lte": 3}}) == ["a", "c"] and ids({"day": {"in": ["월", "화"]}}) == ["a", "b"] and ids({"credits": 9}) == []
    assert S.relax(rows, {"credits": 3, "day": "화"}) == ({"credits": 3}, ["day"])
    ranking = spark.createDataFrame([("c", 2.0), ("b", 1.0), ("a", 0.0)], "id string, score double")
    q = {"query": "x", "intent": "search", "filter": {"credits": {"gte": 1}}}
    assert [r.id for r in S.search(rows, ranking, q, 2, "pre").orderBy("rank").collect()] == ["c", "a"]
    assert [r.id for r in S.search(rows, ranking, q, 2, "post").orderBy("rank").collect()] == ["c"]
    assert [r.id for r in S.search(rows, None, q | {"query": "", "intent": "list"}, 1).orderBy("rank").collect()] == ["a", "c"]
    assert [r.v for r in rows.select("ord", S.violations({"credits": 3, "day": "화"}).alias("v")).orderBy("ord").collect()] == [["day"], ["credits"], ["credits", "day"]]


# ---- answers


def test_answer_checks(spark):
    sources = spark.createDataFrame([(1, 1, "수료 요건은 출석률 80% 이상이다."), (1, 2, "스터디룸은 12시간 전에 예약한다.")], "qid int, n int, text string")
    a = "출석률은 80% 이상이다 [1]. 예약은 24시간 전이다 [2]. 점심은 무료다. 없는 근거다 [7]. 나머지는 문서에서 찾을 수 없다."
    got = {r["index"]: r for r in A.validate_answers(spark.createDataFrame([(1, a)], "qid int, answer string"), sources).collect()}
    assert [got[i].status for i in range(5)] == ["ok", "fail", "fail", "fail", "refusal"]
    assert got[1].unsupported and got[1].missing[0] == "24" and got[2].uncited and got[3].invalid == 1
    s = A.citation_stats(A.validate_answers(spark.createDataFrame([(1, a)], "qid int, answer string"), sources)).first()
    assert (s.sentences, s.claims, s.cited, s.coverage, s.ok) == (5, 4, 2, 0.5, False)


def test_alignment_and_support(spark):
    t = "첫 문장이다. 예약은 12시간 전에 한다. 끝."
    r = A.align(spark.createDataFrame([(1, "12시간 전에 예약", t)], "k int, claim string, text string"), ["k"]).first().best
    assert t[r.start : r.end] == "예약은 12시간 전에 한다."
    s = spark.createDataFrame([("2시간", "12시간")], "a string, b string").select(A.support("a", "b").alias("s")).first().s
    assert s.missing_numbers == ["2"]


def test_generation(spark):
    prompts = spark.createDataFrame([(1, "study room booking hours", ["Nothing. The study room has booking hours.", "other"]), (2, "x y z", ["a"])], "qid int, question string, texts array<string>")
    got = {r.qid: r.answer for r in A.OverlapGenerator().generate(prompts).collect()}
    assert got == {1: "The study room has booking hours. [1]", 2: A.REFUSED}
    p = prompts.select(A.rag_prompt("question", "texts").alias("p")).first().p
    assert p.user.endswith("\n\n질문: study room booking hours") and "[2] other" in p.user
    m = A.Provider("x")
    with pytest.raises(A.GenerationError):
        m.request("m", "s", "u")
    m.set_key(" secret ")
    assert m.has_key() and "secret" not in repr(m) and "secret" not in json.dumps(m.request("m", "s", "u"))
    shot = prompts.select(A.few_shot("do", [{"q": "q", "context": "c", "a": "a"}], F.col("question"), F.lit("ctx")).alias("x")).first().x
    assert shot.count("### 예시") == 1 and shot.endswith("답:")


def test_faithfulness_and_judges(spark):
    df = spark.createDataFrame([("GPU는 8대다. 점심은 무료다.", "실습실에 GPU 8대가 있다")], "a string, c string")
    assert tuple(df.select(A.faithfulness("a", "c").alias("f")).first().f) == (1, 2, 0.5)
    reply = 'ok ```{"claims":[{"claim":"x","supported":true},{"claim":"y","supported":"true"}],"faithfulness":1.0}```'
    j = spark.createDataFrame([(reply,), ("no",), ('{"claims": 3}',)], "r string").select(A.parse_judgement("r").alias("j")).collect()
    assert j[1].j is None and j[2].j is None and len(j[0].j.claims) == 2
    rub = spark.createDataFrame([("답: 12시간 [1]",)], "o string").select(A.rubric("o", 2, "answer", ("12시간",), "hack").alias("r")).first().r
    assert [(r.key, r["pass"]) for r in rub] == [("cite", True), ("refuse", True), ("format", True), ("inject", True)]


# ---- conversations


def test_rewriting(spark):
    def rewrite(history, question, window=3):
        df = spark.createDataFrame([(history, question)], "h array<string>, q string")
        return df.select(V.rewriter(window)("h", "q").alias("r")).first().r

    assert rewrite([], "스터디룸 예약은 어떻게 해?")["rule"] == "standalone"
    assert rewrite(["스터디룸은 어디에 있어?"], "거기서 음료 마셔도 돼?")["query"].startswith("스터디룸")
    switched = rewrite(["RAG 과목은 몇 학점이야?"], "그럼 딥러닝은?")
    assert switched["query"].startswith("딥러닝") and "학점" in switched["query"]
    assert rewrite([], "거기는 언제 열어?")["clarify"]
    far = ["도서관은 언제 열어?", "x", "y", "z"]
    assert rewrite(far, "거기는?", 1)["clarify"] and not rewrite(far, "거기는?", 4)["clarify"]
    assert rewrite(None, None)["query"] == "" and rewrite([], "  ", 0)["rule"] == "nothing to carry"
    found = spark.createDataFrame([("성적 우수장학금과 RAG",), ("",), (None,)], "t string").select(V.entities("t").alias("e")).collect()
    assert [tuple(e) for e in found[0].e] == [("성적 우수 장학금", "성적 우수장학금", 0), ("RAG", "RAG", 10)] and found[1].e == [] and not found[2].e


def test_conversation_columns(spark):
    r = spark.createDataFrame([('질문: "도서관은 언제 열어?"',), ("되묻기: 무엇?",)], "t string").select(V.parse_rewrite("t").alias("r")).collect()
    assert [tuple(x.r) for x in r] == [("도서관은 언제 열어?", False), ("무엇?", True)]
    hits = spark.createDataFrame([(1, "rate of scholarship", "scholarship", "First. The rate is 50%. Last.")], "qid int, query string, title string, text string")
    idf = spark.createDataFrame([("rate", 2.0), ("of", 0.1)], "term string, idf double")
    assert V.extract_answers(hits, idf).first().sentence == "The rate is 50%."
    row = spark.createDataFrame([(False, 5.0, None, None, 0, "s", 1.0, ["t"])], "c boolean, top double, llm string, ex string, rank int, s string, sc double, ti array<string>")
    kind = lambda th: row.select(V.choose_answer(F.col("c"), F.col("top"), th, F.col("llm"), F.col("ex"), F.col("rank"), F.col("s"), F.col("sc"), F.col("ti")).alias("a")).first().a
    assert tuple(kind(1.0)) == ("extract", "s [1]") and kind(9.0).kind == "clarify"


# ---- quizzes and validators


def test_candidates(spark):
    found = spark.createDataFrame([("수업료의 50%를 12시간 안에 RRF로 60개",)], "t string").select(Z.candidates("t").alias("c")).first().c
    assert [(c["text"], c["type"]) for c in found] == [("50%", "percent"), ("12시간", "hours"), ("60개", "unit:개"), ("RRF", "term:search")]
    assert Z._shift("10~20%", lambda v: v + 10) == "20~30%" and Z._shift("5", lambda v: v - 10) is None


def test_quiz(spark):
    docs = spark.createDataFrame([("d", "장학금은 수업료의 50%를 준다. 예약은 12시간 전에 해야 한다."), ("e", "출석률은 80% 이상이어야 한다. 과제는 30%다.")], "id string, text string")
    pools = Z.pools(docs)
    assert sorted(r.text for r in pools.collect() if r.type == "percent") == ["30%", "50%", "80%"]
    items = Z.generate(docs.withColumn("rank", F.when(F.col("id") == "d", 1).otherwise(2)), pools, 3, "normal", 1).withColumn("n", F.substring("id", 2, 3).cast("int"))
    rows = items.orderBy("n").collect()
    assert [r.answer for r in rows] == ["50%", "80%", "12시간"] and all(len(r.choices) == 4 and r.answer in r.choices and "____" in r.question for r in rows)
    chunks = docs.select(F.col("id").alias("chunk_id"), F.col("id").alias("doc"), "text")
    assert {r.status for r in Z.verify(items, chunks).collect()} == {"ok"}
    moved = items.withColumn("chunk", F.lit("e"))
    codes = {r.id: {c.code for c in r.checks if c.level == "fail"} for r in Z.verify(moved, chunks).collect()}
    assert codes["Q1"] == {"span"} and codes["Q2"] == set()
    assert {r.id: r.held_by for r in Z.verify(moved, chunks).collect()} == {"Q1": "d", "Q2": None, "Q3": "d"}
    twice = items.unionByName(items.withColumn("n", F.col("n") + 10))
    assert Z.verify(twice, chunks).filter("dup_of is not null").count() == 3
    assert Z.markdown(Z.verify(items, chunks), "t").first().document.count("## ") == 4
    assert Z.counts(Z.verify(items, chunks)).first().ok == 3


def test_team_files(spark):
    bad = {"team": "", "members": "a, b", "system": {"chunking": "x", "embedding": "e", "retriever": "r", "k": "5"}, "golden": [{"id": "q1", "answer": "", "citations": []}, {"id": "q99", "retrieved": [], "answer": "", "citations": []}, {"id": "q1", "retrieved": "x", "answer": "", "citations": "d"}]}
    paths = [e["path"] for e in D.result_issues(bad, {"q1": "a"})["errors"]]
    assert paths == ["team", "members", "system.k", "golden[0] (q1).retrieved", "golden[1].id", "golden[2].id", "golden[2] (q1).retrieved", "golden[2] (q1).citations"]
    good = {"team": "t", "members": list("abc"), "system": {"chunking": "x", "embedding": "e", "retriever": "r", "k": 5, "reranker": None, "llm": None}, "golden": [{"id": "q1", "retrieved": ["d#1"], "answer": "", "citations": ["z#1"]}]}
    out = D.result_issues(good, {"q1": "a", "q2": "b"})
    assert not out["errors"] and [w["path"] for w in out["warnings"]] == ["golden[0] (q1).citations", "golden"]
    files = spark.createDataFrame([(json.dumps(good),), ("{",), (None,)], "text string")
    assert [r.ok for r in D.validate_results(files, {"q1": "a"}).collect()] == [True, False, False]
    e = spark.createDataFrame([('{"a": 1,\n}',)], "t string").select(D.json_error("t").alias("e")).first().e
    assert not e.ok and e.line is not None
    o = spark.createDataFrame([('x ```json\n{"a":1}\n``` y',)], "t string").select(D.object_in("t").alias("o")).first().o
    assert o.body == '{"a":1}' and o.fenced
