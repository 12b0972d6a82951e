"""Steps whose time or memory grew faster than the input: plans, and the same rows either way."""

from pyspark.sql import functions as F

from loamdex.functions import cleaning
from loamdex.operators import answers, quiz
from loamdex.plans import derived


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _part(spark, folder, n=40):
    spark.range(n).select(F.col("id").alias("p_partkey"), (F.col("id") % 50 + 1).cast("int").alias("p_size"), F.lit("Brand#12").alias("p_brand")).coalesce(1).write.parquet(f"{folder}/part.parquet")


def test_parts_are_dealt_over_all_cores(spark, tmp_path):
    _part(spark, tmp_path)
    assert derived._parts(spark, str(tmp_path)).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_a_timetable_row_is_matched_a_few_times(spark):
    df = spark.createDataFrame([("요일 교시 과목 강의실 담당\n월 1-3 수학 306 이 교수",)], "t string").select(cleaning.rebuild_timetable("t").alias("r"))
    assert _plan(df).count("regexp_extract(") <= 8
    assert df.first().r.text.split("\n")[1] == "월 | 1-3 | 수학 | 306 | 이 교수"


def test_overlap_answers_shuffle_nothing(spark):
    rows = spark.createDataFrame([
        (1, "the rate of it", ["No. The rate of it is 5.", "The rate of it."]), (2, "rate of it", [None, "rate of it now. rate of it"]), (3, "no such words", ["a b c"]), (4, None, ["a"]), (5, "a b c", None), (6, "a b c", []), (None, "a b c", ["x\na b c "]),
    ], "qid int, question string, texts array<string>")
    made = answers.OverlapGenerator().generate(rows)
    assert "Exchange" not in _plan(made)
    no = answers.REFUSED
    assert [r.answer for r in made.orderBy(F.col("qid").asc_nulls_last()).collect()] == ["The rate of it is 5. [1]", "rate of it now. [2]", no, no, no, no, "a b c [1]"]


def test_sentences_are_picked_without_one_task(spark, monkeypatch):
    rows = spark.range(30).select(F.col("id").alias("rank"), F.col("id").cast("string").alias("id"), F.concat(F.lit("수업료의 "), F.col("id") + 1, F.lit("%를 준다. 예약은 "), F.col("id") + 2, F.lit("개까지 받는다.")).alias("text"))
    few = quiz.pick_sentences(rows, 37).orderBy("n").collect()
    monkeypatch.setattr(quiz, "FEW", 5)
    many = quiz.pick_sentences(rows, 37)
    assert "Window" not in _plan(many)
    assert many.orderBy("n").collect() == few and [r.n for r in few] == list(range(1, 38))
    assert quiz.pick_sentences(rows.limit(0), 37).count() == 0


def test_candidates_look_at_a_sentence_once(spark):
    """A sentence that is an expression was put together again for each pattern."""
    df = spark.createDataFrame([("5", "a")], "s string, t string").select(quiz.candidates(F.concat("t", F.lit(" "), "s", F.lit("%"))).alias("c"))
    assert _plan(df).count("concat(t#") == 1
    assert [(c.text, c.start, c.type) for c in df.first().c] == [("5%", 2, "percent")]


def test_texts_are_cut_in_small_batches(spark, monkeypatch):
    """Chunks of some thousand texts were held by a task at once."""
    from loamdex.operators import chunking

    sizes = []
    docs = spark.createDataFrame([(i, None if i == 7 else "ab cd. " * i, "t") for i in range(150)], "doc_id long, text string, title string")
    for strategy in chunking.STRATEGIES[1:]:
        config = chunking.ChunkConfig(strategy, 20, 5)
        own = chunking.chunk(docs, config, title="title")
        want = [(i, f"{i}#{n}", n, s, e, t[s:e], f"[t] {t[s:e]}") for i, t in ((r.doc_id, r.text) for r in docs.collect()) if t is not None for n, (s, e) in enumerate(chunking.cut(t, strategy, 20, 5))]
        assert sorted(tuple(r) for r in own.collect()) == sorted(want)
        monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, *a: sizes.append(f) or self)
        chunking._cut_rows(docs.select("doc_id", "text"), config)
        monkeypatch.undo()
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(150)), "text": ["ab cd. "] * 150})
    assert [b.num_rows for b in sizes[0](iter([batch]))] == [64, 64, 22]


def test_walks_that_leave_nothing_out_are_one_product(spark, monkeypatch):
    """They were made step by step, for each query."""
    import numpy as np

    from loamdex.operators.retrieval import GraphIndex, SmallWorld, places, _unit

    import pyarrow as pa

    rng = np.random.default_rng(3)
    x, q = _unit(rng.standard_normal((300, 8))), _unit(rng.standard_normal((40, 8)))
    g = SmallWorld(x, links=3, width=6)
    slow = []
    for n, one in enumerate(q):
        g.looked = 0
        slow += [(n, i, round(float(s), 9), g.looked) for s, i in g.search(one, 5, 600)]
        slow[-5:] = [(*r[:3], g.looked) for r in slow[-5:]]
    steps, beam = [], SmallWorld._beam
    monkeypatch.setattr(SmallWorld, "_beam", lambda self, *a, **k: steps.append(a[2]) or beam(self, *a, **k))
    assert sorted(g.search_wide(q, 5, places(pa.array(range(300))))) == sorted(slow)
    assert set(steps) <= {1}
    monkeypatch.undo()
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    asked = rows.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "qid")
    index = GraphIndex(rows, shard_rows=100)
    near = {(int(r), int(c)) for r in range(0, 300, 50) for c in np.argsort(-(x[r] @ x.T), kind="stable")[:5]}
    assert {(r.qid, r.id) for r in index.search(asked, 5, 300).collect()} == near
    walks = index.walks(asked, 5, 20)
    assert index.counted(walks).orderBy("qid").collect() == index.search(asked, 5, 20, counted=True).orderBy("qid").collect()


def test_few_quotes_shuffle_neither_texts_nor_grams(spark, monkeypatch):
    """Grams of all texts were stored, and texts joined once for each quote that they may hold."""
    import random

    from loamdex.operators import matching

    rng = random.Random(4)
    words = ["a", "b", "ab", "가", "나다", "é", "the ", " ", "\n", "ab ab ab ab ab ab ", "😀"]
    texts = ["".join(rng.choices(words, k=rng.choice([0, 1, 3, 40, 200]))) for _ in range(80)] + [None, "", "a"]
    quotes = ["".join(rng.choices(words, k=rng.choice([1, 1, 2, 3, 8, 20]))) for _ in range(150)] + [t[5:60] for t in texts[:30]] + [None, "", "a", "a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    q = spark.createDataFrame([(f"q{i // 2}", x) for i, x in enumerate(quotes)], "qid string, quote string")
    bare = lambda t: "".join((t or "").split())
    for held, plain in ((matching.containing, lambda t: t or ""), (matching.containing_respaced, bare)):
        brute = sorted({(f"q{i // 2}", j) for i, a in enumerate(quotes) for j, t in enumerate(texts) if plain(a) and plain(a) in plain(t)})
        found = held(docs, q)
        assert not any(step in _plan(found) for step in ("Exchange", "Join", "Generate"))
        assert sorted(map(tuple, found.collect())) == brute
        monkeypatch.setattr(matching, "SET_BYTES", 0)
        joined = held(docs, spark.createDataFrame(list(enumerate(quotes))[:40], "qid long, quote string"))
        assert {tuple(r) for r in joined.collect()} == {(i, j) for i, a in enumerate(quotes[:40]) for j, t in enumerate(texts) if plain(a) and plain(a) in plain(t)}
        monkeypatch.undo()
    import numpy as np

    monkeypatch.setattr(matching, "STRETCH", 7)
    sizes, asked = [len((t or "").encode()) for t in texts], sorted({a.encode() for a in quotes if a})
    data = np.frombuffer("".join(t or "" for t in texts).encode(), np.uint8)
    text, quote = matching.QuoteSet(asked).held(data, np.cumsum(sizes))
    assert sorted(zip(text.tolist(), quote.tolist())) == [(j, i) for j, t in enumerate(texts) for i, a in enumerate(asked) if a in (t or "").encode()]


def test_sentences_without_digit_or_term_meet_no_pattern(spark, monkeypatch):
    """All patterns were tried on each sentence of the corpus."""
    texts = ["No such thing here. Nor is it there.", "It rose by 5% then. No such thing here.", "BM25 ranks the texts. 가나다라마바사.", "오전 9시에 조교가 온다.", "0 is a number too.", "l% and O명 aren't any.", "고정 길이 청킹을 쓴다. 재귀 분할을 쓴다.", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = F.filter(F.transform(quiz.long_sentences("text"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), quiz.candidates(s["text"]).alias("found"))), lambda s: F.size(s["found"]) > 0)
    got, want = (docs.select(F.coalesce(c, F.array().cast("array<struct<start:int,end:int,text:string,found:array<struct<text:string,start:int,end:int,type:string,priority:int>>>>")).alias("s")).collect() for c in (quiz.quiz_sentences("text"), whole))
    assert got == want and [len(r.s) for r in got] == [0, 1, 1, 1, 1, 0, 2, 0, 0]
    monkeypatch.setattr(quiz, "candidates", lambda s: F.raise_error(s).cast("array<struct<text:string,start:int,end:int,type:string,priority:int>>"))
    assert docs.limit(1).select(quiz.quiz_sentences("text").alias("s")).first().s == []
    for own in quiz.TERMS.values():
        assert all(any(stem in t for stem in quiz.STEMS) for t in own)


def test_made_items_are_never_similar_and_cite_the_next_part(spark, tmp_path):
    """Hashed questions of keys far apart were similar by chance, and a part behind a gap had no next one."""
    import duckdb

    keys = [46175, 240635, 92772, 230323, 10, 28, 29, 37]  # the first are two such pairs; 10, 28 and 37 cite the next
    spark.createDataFrame([(k, k % 50 + 1, "Brand#1") for k in keys], "p_partkey long, p_size int, p_brand string").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    for name in ("items_verified", "items_counted"):
        made = derived.QUERIES[name](spark, str(tmp_path))
        assert sorted(map(str, map(tuple, made.collect()))) == sorted(map(str, con.execute(derived.SQL[name]).fetchall()))
    questions = derived._items(spark, str(tmp_path))[0].select("question").collect()
    assert all(len({*map(ord, r.question)}) == 6 and all(0xAC00 <= ord(c) < 0xD7A4 for c in r.question) for r in questions)


def test_few_queries_meet_texts_by_products(spark, monkeypatch):
    """A common word made a row for each query and text."""
    from loamdex.operators import retrieval
    from loamdex.operators.retrieval import Bm25Index

    words = ["the", "a", "rate", "of", "room", "five"]
    texts = spark.range(300).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 50 == 7, None).otherwise(F.concat_ws(" ", F.lit("the"), *[F.when(F.pmod(F.xxhash64("id"), F.lit(i + 2)) == 0, w) for i, w in enumerate(words)])).alias("text")).repartition(3)
    asked = spark.createDataFrame([(1, "the rate"), (2, "rate the the"), (3, "a room of five"), (4, "nowhere"), (5, None), (6, "")], "qid int, question string")
    both = []
    for most in (retrieval.WEIGHTS, 40, 0):
        monkeypatch.setattr(retrieval, "WEIGHTS", most)
        both.append([])
        for k1, b in ((1.5, 0.75), (0.0, 1.0)):
            found = Bm25Index.build(texts, k1=k1, b=b, only=Bm25Index.terms(asked)).search(asked, 7)
            both[-1] += found.orderBy("qid", "rank").collect()
            assert ("MapInArrow" in _plan(found)) == (most > 0)
    assert both[0] == both[1] == both[2] and len(both[0]) == 2 * 3 * 7


def test_fixed_chunks_are_cut_once(spark):
    """The length of a text was counted for each window, its steps copied for each, and a filter cut it again."""
    from loamdex.operators.chunking import ChunkConfig, chunk

    df = spark.createDataFrame([(1, "a" * 10 + " " * 9 + "한글" * 4), (2, ""), (3, None), (4, " ")], "doc_id int, text string").repartition(1)
    plan = _plan(chunk(df, ChunkConfig("fixed", 7, 3)))
    assert plan.count("char_length(") == 1 and plan.count("regexp_extract_all(") == 1 and "slice(" not in plan
    rows = chunk(df, ChunkConfig("fixed", 7, 3)).orderBy("doc", "index").collect()
    text = df.first().text
    assert [r.text for r in rows] == [text[s : s + 7] for s in range(0, 24, 4) if text[s : s + 7].strip()] and [r["index"] for r in rows] == list(range(len(rows)))


def test_the_simulation_cuts_all_texts_once(spark, monkeypatch):
    """Chunks of all texts were made again for evidence, sizes and their number."""
    from loamdex.operators import chunking
    from loamdex.operators.chunking import ChunkConfig
    from loamdex.operators.retrieval import simulate

    docs = spark.createDataFrame([(f"d#{i}", f"rate {'word ' * i}of it {i}") for i in range(20)], "doc_id string, text string")
    cut, seen = chunking.chunk, []
    monkeypatch.setattr(chunking, "chunk", lambda d, *a: seen.append(sorted(r.doc_id for r in d.select("doc_id").collect())) or cut(d, *a))
    asked, quotes = spark.createDataFrame([(1, "it 3"), (2, "it 19")], "qid int, question string"), spark.createDataFrame([(1, "d#3", "it 3"), (2, "d#5", "it 5")], "qid int, doc string, quote string")
    row = simulate(docs, asked, quotes, ChunkConfig("fixed", 400, 0, k=1)).first()
    assert (row.chunks, row.hit, row.mrr, row.context) == (20, 0.5, 0.5, 68)
    assert [len(s) for s in seen] == [20, 2] and seen[1] == ["d#19", "d#3"]
