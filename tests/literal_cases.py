"""Cases of single functions with typed-out rows: rules over Hangul, forms of replies, defaults, and other things that the tables have no rows for.

Each is a plan beside the SQL of its expected rows, as queries are; test_literal_cases.py runs them.
"""

from __future__ import annotations

import json
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamdex.functions import cleaning, text
from loamdex.functions.diffs import diff
from loamdex.functions.vectors import pca2
from loamdex.operators import answers, conversation, metrics, quiz, selfquery
from loamdex.operators.chunking import ChunkConfig, chunk, from_character_splitter, from_token_splitter
from loamdex.operators.quiz import markdown
from loamdex.operators.retrieval import Bm25Index, SmallWorld, generated_vectors
from loamdex.plans.common import registry
from loamdex.sources import writers

QUERIES, SQL, plan = registry()


def literal(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Small cases that the test tables have no texts for."""
    return spark.createDataFrame(rows, schema)


def values_sql(rows: list[tuple], names: list[str]) -> str:
    """The expected rows, typed out."""

    def text(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        if isinstance(v, (list, tuple)):
            return "[" + ", ".join(map(text, v)) + "]" + ("::VARCHAR[]" if not v else "")
        return repr(v)

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) AS t({', '.join(names)})"


@plan("SELECT * FROM (VALUES ('recursive', 4000, 200, 4), ('sentence', 4096, 80, 6)) AS t(strategy, size, overlap, separators)")
def foreign_splitters(spark: SparkSession, folder: str) -> DataFrame:
    """Defaults of other frameworks' splitters as settings of this one."""
    return spark.createDataFrame([(c.strategy, c.size, c.overlap, len(c.separators)) for c in (from_character_splitter(), from_token_splitter())], "strategy string, size int, overlap int, separators int")


@plan("SELECT 200 AS n, 16 AS dim, 1.0 AS least, 1.0 AS most, 1 AS versions")
def synthetic_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Unit vectors around centres: the same rows for the same seed, however many partitions make them."""
    a, b = generated_vectors(spark, 200, 16, clusters=5), generated_vectors(spark, 200, 16, clusters=5)
    norm = F.round(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))), 5)
    both = a.unionByName(b.repartition(3)).groupBy("vec_id").agg(F.count_distinct("embedding").alias("v"), F.max(norm).alias("norm"), F.max(F.size("embedding")).alias("dim"))
    return both.agg(F.count(F.lit(1)).cast("int").alias("n"), F.max("dim").alias("dim"), F.min("norm").alias("least"), F.max("norm").alias("most"), F.max("v").cast("int").alias("versions"))


SHOWN = [("alpha", 0.12345, 3), ("b", 2.0, 10)]


@plan("SELECT 'name' || '   ' || 'value' || '   ' || 'n' || chr(10) || 'alpha' || '  ' || '0.1235' || '  ' || '3' || chr(10) || 'b' || '      ' || '2' || '       ' || '10' AS text")
def aligned_text(spark: SparkSession, folder: str) -> DataFrame:
    return spark.createDataFrame([(writers.text_table(spark.createDataFrame(SHOWN, "name string, value double, n int")),)], "text string")


QUIZ = [(1, "Which?", "a", ["b", "a"], "d#0", "ok", "It is a."), (2, "How many?", "3", None, "e#1", "warn", "There are 3.")]


@plan("""SELECT '# quiz' || chr(10) || chr(10) || '## 1. Which?' || chr(10) || chr(10) || 'A) b' || chr(10) || 'B) a' || chr(10) || chr(10) || '## 2. How many?' || chr(10) || chr(10) || '(단답형)' || chr(10)
|| chr(10) || '---' || chr(10) || chr(10) || '## 정답과 근거' || chr(10) || chr(10) || '1. **a** — d#0 · ok' || chr(10) || chr(10) || '   > It is a.' || chr(10) || chr(10) || '2. **3** — e#1 · warn' || chr(10) || chr(10) || '   > There are 3.' || chr(10) AS document""")
def quiz_document(spark: SparkSession, folder: str) -> DataFrame:
    items = spark.createDataFrame(QUIZ, "n int, question string, answer string, choices array<string>, chunk string, status string, quote string")
    return markdown(items, "quiz")


HTML = [(1, "<html><body><h1>Title</h1><p>one &amp; two</p></body></html>"), (2, "plain"), (3, "<p>a</p><script>x()</script><p>b</p>")]


@plan(values_sql([(1, "Title", True), (2, "plain", False), (3, "a", True)], ["id", "first", "marked"]))
def html_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The first line of small pages' texts; scripts are no text."""
    from loamdex.functions.html import html_to_text

    rows = literal(spark, HTML, "id int, html string").withColumn("t", html_to_text("html"))
    rows = rows.filter(~F.contains("t", F.lit("x()")))
    return rows.select("id", F.get(F.split("t", "\n"), F.lit(0)).alias("first"), F.contains("html", F.lit("<")).alias("marked"))


#: (case, step, text, expected text, changes)
STEPS = [
    (1, "table", "안내\n요일 교시 과목 강의실 담당\n월 1-3 딥러닝 306 이 교수 화 4-6 현장 실습 외부 산업체\n끝", "안내\n요일 | 교시 | 과목 | 강의실 | 담당\n월 | 1-3 | 딥러닝 | 306 | 이 교수\n화 | 4-6 | 현장 실습 | 외부 산업체 | —\n끝", 2),
    (2, "table", "요일 교시 과목 강의실 담당\n수 2-3 팀 프로젝트 305호 공동", "요일 | 교시 | 과목 | 강의실 | 담당\n수 | 2-3 | 팀 프로젝트 | 305호 | 공동", 1),
    (3, "table", "요일 교시 과목 강의실 담당\n다른 줄", "요일 교시 과목 강의실 담당\n다른 줄", 0),
    (4, "ocr", "출석률 5O% 이상, 2O24년 MLOps COVID19 l2시간", "출석률 50% 이상, 2024년 MLOps COVID19 12시간", 3),
    (5, "space", "장 학 금 안 내\n평 점이 지급한 다.", "장학금안내\n평점이 지급한다.", 3),
    (6, "space", "그 과목 매 학기", "그 과목 매 학기", 0),
    (7, "spaceAll", "장학 금은 A 학점 이상", "장학금은 A 학점이상", 2),
    (8, "pagenum", "본문\n- 3 -\n끝 - 4 -", "본문\n끝", 2),
]


@plan(values_sql([(c, s, after, n) for c, s, _, after, n in STEPS], ["id", "step", "text", "count"]))
def hangul_cleaning(spark: SparkSession, folder: str) -> DataFrame:
    parts = []
    for step in sorted({s[1] for s in STEPS}):
        rows = literal(spark, [(c, s, t) for c, s, t, *_ in STEPS if s == step], "id int, step string, t string")
        parts.append(rows.select("id", "step", cleaning.STEPS[step]("t").alias("r")).select("id", "step", "r.text", "r.count"))
    return reduce(DataFrame.unionByName, parts)


@plan(values_sql([(1, "50% 이상", 1, 0, 1), (2, "a\nb", 0, 1, 1)], ["id", "text", "ocr", "header", "pagenum"]))
def cleaned_literals(spark: SparkSession, folder: str) -> DataFrame:
    """All recommended steps together: page numbers, repeated lines, damaged digits."""
    rows = literal(spark, [(1, "5O% 이상\n- 1 -"), (2, "a\n사이트맵\nb\n2/3")], "id int, text string")
    out = cleaning.clean(rows, cleaning.recommended("broken-mixed"))
    return out.select("id", "text", *[F.col("counts")[s].alias(s) for s in ("ocr", "header", "pagenum")])


@plan(values_sql([(1, "eq:5|del:O|ins:0|eq:%"), (2, "eq:same"), (3, "ins:new")], ["id", "runs"]))
def small_diffs(spark: SparkSession, folder: str) -> DataFrame:
    rows = literal(spark, [(1, "5O%", "50%"), (2, "same", "same"), (3, "", "new")], "id int, a string, b string")
    return rows.select("id", F.array_join(F.transform(diff("a", "b"), lambda r: F.concat_ws(":", r["type"], r["text"])), "|").alias("runs"))


FACTS = [(1, "최대 12 시간까지", "12시간이다.", ["12시간"], True), (2, "112시간", "12시간", ["12시간"], False), (3, "40 퍼센트", "40%", ["40%"], True), (4, "재수강은 불가능하다", "재수강은 불가능하다.", ["재수강은불가능하"], True), (5, "모른다", "8시간", ["8시간"], False), (6, "ＡＢ 3호", "3호", ["3호"], True)]


@plan(values_sql([(i, f, h) for i, _, _, f, h in FACTS], ["id", "facts", "holds"]))
def fact_matches(spark: SparkSession, folder: str) -> DataFrame:
    rows = literal(spark, [r[:3] for r in FACTS], "id int, t string, a string")
    return rows.select("id", text.golden_facts("a").alias("facts"), text.contains_facts("t", "a").alias("holds"))


@plan(values_sql([(1, [], []), (2, ["context"], ["name"]), (3, ["question", "context"], [])], ["id", "missing", "unknown"]))
def template_placeholders(spark: SparkSession, folder: str) -> DataFrame:
    rows = literal(spark, [(1, ["{question}", "{context}"]), (2, ["{question} {name}"]), (3, ["plain"])], "id int, t array<string>")
    return rows.select("id", text.placeholders(F.col("t")).alias("p")).select("id", "p.missing", "p.unknown")


@plan(values_sql([("도서관에서는", "도서관"), ("학교는", "학교"), ("나는", "나는"), ("books", "books"), ("장학금으로", "장학금")], ["word", "stem"]))
def word_endings(spark: SparkSession, folder: str) -> DataFrame:
    rows = literal(spark, [(w,) for w in ("도서관에서는", "학교는", "나는", "books", "장학금으로")], "word string")
    return rows.select("word", text.strip_ending(F.col("word"), text.ENDINGS_TALK, 2).alias("stem"))


@plan(values_sql([("a", 1), ("é", 2), ("�", 1), ("日", 3)], ["piece", "tokens"]))
def grouped_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Byte tokens are grouped until they decode; a lone byte that never does is replaced."""
    rows = text.group_pieces([b"a", *(bytes([x]) for x in "é".encode())]) + text.group_pieces([b"\xff"]) + text.group_pieces([bytes([x]) for x in "日".encode()])
    return spark.createDataFrame(rows, "piece string, tokens int")


PLANE = [(i, [float(x), float(y), 0.0]) for i, (x, y) in enumerate([(3, 1), (-3, 1), (3, -1), (-3, -1)])]


@plan("SELECT 0.9 AS first, 0.1 AS second, 1.0 AS x, 1.0 AS y")
def principal_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Corners of a rectangle: nine tenths of the variance lie along its length."""
    components, _, shares = pca2(literal(spark, PLANE, "vec_id int, embedding array<double>"))
    return spark.createDataFrame([(round(shares[0], 6), round(shares[1], 6), round(abs(components[0][0]), 6), round(abs(components[1][1]), 6))], "first double, second double, x double, y double")


@plan(values_sql([("sum", True), ("base", True), ("falls", True)], ["name", "ok"]))
def graph_layers(spark: SparkSession, folder: str) -> DataFrame:
    """The lowest layer of a graph holds all rows, higher ones ever fewer."""
    rows = np.random.default_rng(1).standard_normal((300, 8))
    sizes = SmallWorld(rows / np.linalg.norm(rows, axis=1, keepdims=True)).layer_sizes()
    return spark.createDataFrame([("sum", sum(sizes) >= 300), ("base", sizes[0] == 300), ("falls", sizes == sorted(sizes, reverse=True))], "name string, ok boolean")


@plan(values_sql([(1, True, False, True), (2, False, True, False)], ["id", "mixed_k", "mixed_mode", "close"]))
def notes_of_boards(spark: SparkSession, folder: str) -> DataFrame:
    boards = {1: [(5, "doc", 0.75), (3, "doc", 0.70)], 2: [(5, "doc", 0.9), (5, "chunk", 0.5)]}
    parts = [metrics.board_notes(literal(spark, rows, "k int, mode string, score double"), "score", 12).select(F.lit(i).alias("id"), "mixed_k", "mixed_mode", "close") for i, rows in boards.items()]
    return parts[0].unionByName(parts[1])


SCHEMA = {"semester": {"kind": "int", "min": 1, "max": 2}, "day": {"kind": "enum", "values": list("월화수목금")}, "room": {"kind": "enum", "values": ["305", "306"]}, "credits": {"kind": "int", "min": 1, "max": 4}, "professor": {"kind": "enum", "values": ["이 교수", "조 교수", "공동"]}, "type": {"kind": "enum", "values": ["course", "timetable", "scholarship"]}, "periodStart": {"kind": "int", "min": 1, "max": 9}, "periodEnd": {"kind": "int", "min": 1, "max": 9}}


ASKED = [
    (1, "화요일 오전 305호 수업은 뭐야?", "", "list", {"day": "화", "room": "305", "periodEnd": {"lte": 3}, "type": "timetable"}, ["day", "room", "morning", "type"]),
    (2, "3학점 이상 과목은 몇 개야?", "", "count", {"credits": {"gte": 3}, "type": "course"}, ["credits", "type"]),
    (3, "월요일이나 수요일에 조 교수님 강의", "", "list", {"day": {"in": ["월", "수"]}, "professor": "조 교수", "type": "timetable"}, ["day", "professor", "type"]),
    (4, "장학금 신청 기간", "장학금 신청 기간", "search", {"type": "scholarship"}, ["type"]),
    (5, "2학기 3-4교시 모두 보여줘", "", "list", {"semester": 2, "periodStart": {"gte": 3}, "periodEnd": {"lte": 4}, "type": "timetable"}, ["semester", "periods", "type"]),
]


@plan(values_sql([(i, q, n, json.dumps(f, ensure_ascii=False), t) for i, _, q, n, f, t in ASKED], ["id", "query", "intent", "filter", "trace"]))
def parsed_questions(spark: SparkSession, folder: str) -> DataFrame:
    rows = selfquery.parsed_questions(literal(spark, [r[:2] for r in ASKED], "id int, question string"), SCHEMA)
    return rows.select("id", "parsed.*")


CHECKED = [({"query": "x", "intent": "search", "filter": {"day": "월"}}, 0), ({"intent": "sing"}, 1), ({"filter": {"day": "일", "colour": 1}}, 2), ({"filter": {"credits": {"gte": 9, "near": 1}, "day": {"gte": "월"}}}, 3), ({"filter": {"room": ["305"], "day": {"in": []}}, "more": 1}, 3), ("text", 1), ({"filter": {"credits": True}}, 1)]


@plan(values_sql([(i, n) for i, (_, n) in enumerate(CHECKED)], ["id", "errors"]))
def question_errors(spark: SparkSession, folder: str) -> DataFrame:
    """How many errors the validator finds in a question object; one with any is never run."""
    return spark.createDataFrame([(i, len(selfquery.validate(o, SCHEMA))) for i, (o, _) in enumerate(CHECKED)], "id int, errors int")


REPLIES = [(1, '{"items": [{"type": "short", "question": "q", "answer": "a"}]}', True, 1, []), (2, 'Sure:\n```json\n{"items": []}\n```', True, 0, ["fence"]), (3, 'x {"items": []} y', True, 0, ["chatter"]), (4, "none", False, -1, ["no object"]), (5, "{broken}", False, -1, ["not JSON"])]


@plan(values_sql([(i, ok, n, notes) for i, _, ok, n, notes in REPLIES], ["id", "ok", "items", "notes"]))
def quiz_replies(spark: SparkSession, folder: str) -> DataFrame:
    rows = literal(spark, [r[:2] for r in REPLIES], "id int, reply string").select("id", quiz.quiz_reply("reply").alias("r"))
    return rows.select("id", "r.ok", F.coalesce(F.size("r.items"), F.lit(-1)).alias("items"), "r.notes")


JUDGED = [(1, 'ok {"claims": [{"claim": "a", "supported": true}, {"claim": "b", "supported": "yes"}], "faithfulness": 0.5}', 1, 2, 0.5, 1), (2, '{"claims": [{"claim": "a", "supported": false, "reason": "r"}], "faithfulness": 1.0}', 0, 1, 0.0, 0), (3, "no reply", -1, -1, -1.0, -1)]


@plan(values_sql([(i, *r) for i, _, *r in JUDGED], ["id", "supported", "total", "score", "agrees"]))
def judged_replies(spark: SparkSession, folder: str) -> DataFrame:
    rows = literal(spark, [r[:2] for r in JUDGED], "id int, reply string").select("id", answers.parse_judgement("reply").alias("j"))
    s = rows.select("id", F.when(F.col("j").isNotNull(), answers.judged(F.col("j"))).alias("s"))
    known = lambda c, kind: F.coalesce(F.col(f"s.{c}").cast(kind), F.lit(-1).cast(kind)).alias(c)
    return s.select("id", known("supported", "int"), known("total", "int"), known("score", "double"), known("agrees", "int"))


OUTPUTS = [(1, "답: 12시간이다. [1]", "answer", 1, True, True), (2, "문서에서 찾을 수 없다.", "refuse", -1, True, False), (3, "모른다 [4]", "answer", 0, False, False), (4, "답: 문장", "refuse", 0, False, True)]


@plan(values_sql([(i, c, j, f) for i, _, _, c, j, f in OUTPUTS], ["id", "cite", "judged", "format"]))
def rubric_scores(spark: SparkSession, folder: str) -> DataFrame:
    parts = []
    for i, output, expect, *_ in OUTPUTS:
        r = answers.rubric(F.col("t"), 3, expect, ("12시간",) if expect == "answer" else ())
        parts.append(literal(spark, [(i, output)], "id int, t string").select("id", F.map_from_entries(r).alias("r")).select("id", F.coalesce(F.col("r")["cite"].cast("int"), F.lit(-1)).alias("cite"), F.col("r")["refuse"].alias("judged"), F.col("r")["format"].alias("format")))
    return reduce(DataFrame.unionByName, parts)


GUESSED = [(1, "연장 신청은 언제까지 하나", ["도서관은 9시에 연다. 연장 신청은 반납일 전날까지 한다. 끝."], "연장 신청은 반납일 전날까지 한다."), (2, "몇 시", None, None)]


@plan(values_sql([(i, c, c is None) for i, _, _, c in GUESSED], ["qid", "cite", "guessed"]))
def guessed_answers(spark: SparkSession, folder: str) -> DataFrame:
    rows = answers.GuessingGenerator(["4시간", "6시간"]).generate(literal(spark, [r[:3] for r in GUESSED], "qid int, question string, texts array<string>"))
    return rows.select("qid", "cite", F.col("answer").isin("4시간", "6시간").alias("guessed"))


SAVED = [(1, 2, "[2]에 있다.", "correct"), (2, 0, "없다", "refused"), (3, 0, "모름", "refused")]


@plan(values_sql([(q, a, v) for q, _, a, v in SAVED], ["qid", "answer", "verdict"]))
def recorded_answers(spark: SparkSession, folder: str) -> DataFrame:
    said = "struct<text:string,verdict:string>"
    saved = literal(spark, [(1, ("{ev}에 있다.", "correct"), ("없다", "refused")), (2, ("x", "correct"), ("없다", "refused"))], f"qid int, hit {said}, miss {said}")
    return answers.saved_answers(literal(spark, [(q, r) for q, r, *_ in SAVED], "qid int, rank int"), saved, "모름")


@plan(values_sql([("read", "docs", True), ("search", "", True)], ["step", "note", "timed"]))
def step_log(spark: SparkSession, folder: str) -> DataFrame:
    log = answers.StepLog()
    with log.step("read", "docs"):
        pass
    with log.step("search"):
        pass
    return log.frame(spark).select("step", "note", (F.col("seconds") >= 0).alias("timed"))


CALLS = [("messages", 200, "hi", None), ("chat", 200, "hi", None), ("contents", 200, "hi", None), ("chat", 401, None, "http"), ("chat", 0, None, "network"), ("other", 200, None, "bad-provider"), ("messages", -1, None, "no-key")]


@plan(values_sql([(i, t, c, False) for i, (_, _, t, c) in enumerate(CALLS)], ["id", "text", "code", "leaked"]))
def provider_calls(spark: SparkSession, folder: str) -> DataFrame:
    """Replies and errors of the request forms, over a transport that stands in for the network. No message holds the key."""
    replies = {"messages": {"content": [{"type": "text", "text": "hi"}]}, "chat": {"choices": [{"message": {"content": "hi"}}]}, "contents": {"candidates": [{"content": {"parts": [{"text": "hi"}]}}]}}

    def transport(form: str, status: int):
        def send(headers: dict, body: dict):
            if status == 0:
                raise OSError("down")
            return (status, replies[form]) if status == 200 else (status, {"error": {"message": "bad key sk-12345678"}})

        return send

    rows = []
    for i, (form, status, _, _) in enumerate(CALLS):
        p = answers.Provider("p", form=form, transport=transport(form, status))
        if status != -1:
            p.set_key(" sk-12345678 ")
        try:
            rows.append((i, p.call("m", "s", "u"), None, "sk-" in repr(p)))
        except answers.GenerationError as e:
            rows.append((i, None, e.code, "sk-" in f"{e!r}{p!r}"))
    return spark.createDataFrame(rows, "id int, text string, code string, leaked boolean")


CLAIMS = [
    (1, "수업료의 50%를 준다 [1]. 신청은 12시간 전이다 [2].", [("ok", 0, False, False), ("fail", 0, False, True)]),
    (2, "아무 근거 없는 주장이다. 찾을 수 없다.", [("fail", 0, True, False), ("refusal", 0, False, False)]),
    (3, "50%를 준다 [7].", [("fail", 1, False, False)]),
]


@plan(values_sql([(q, i, *r) for q, _, rows in CLAIMS for i, r in enumerate(rows)], ["qid", "index", "status", "invalid", "uncited", "unsupported"]))
def checked_claims(spark: SparkSession, folder: str) -> DataFrame:
    sources = literal(spark, [(q, n, t) for q in (1, 2, 3) for n, t in ((1, "장학금은 수업료의 50%를 준다."), (2, "예약은 24시간 전에 한다."))], "qid int, n int, text string")
    checked = answers.validate_answers(literal(spark, [r[:2] for r in CLAIMS], "qid int, answer string"), sources)
    return checked.select("qid", "index", "status", "invalid", "uncited", "unsupported")


@plan(values_sql([(1, 2, 2, 2, 1.0, 0, 0, 1), (2, 2, 1, 0, 0.0, 0, 1, 0), (3, 1, 1, 0, 0.0, 1, 0, 0)], ["qid", "sentences", "claims", "cited", "coverage", "invalid", "uncited", "unsupported"]))
def claim_statistics(spark: SparkSession, folder: str) -> DataFrame:
    sources = literal(spark, [(q, n, t) for q in (1, 2, 3) for n, t in ((1, "장학금은 수업료의 50%를 준다."), (2, "예약은 24시간 전에 한다."))], "qid int, n int, text string")
    return answers.citation_stats(answers.validate_answers(literal(spark, [r[:2] for r in CLAIMS], "qid int, answer string"), sources)).select("qid", "sentences", "claims", "cited", "coverage", "invalid", "uncited", "unsupported")


FAITHFUL = [(1, "장학금은 수업료의 50%를 준다. 기숙사는 무료다.", "장학금은 수업료의 50%를 준다", 1, 2, 0.5), (2, "", "x", 0, 0, 0.0)]


@plan(values_sql([(i, *r) for i, _, _, *r in FAITHFUL], ["id", "supported", "sentences", "score"]))
def faithful_sentences(spark: SparkSession, folder: str) -> DataFrame:
    return literal(spark, [r[:3] for r in FAITHFUL], "id int, a string, c string").select("id", answers.faithfulness("a", "c").alias("f")).select("id", "f.*")


ALIGNED = [(1, "12시간 전에 예약한다", "도서관은 9시에 연다. 예약은 12시간 전에 한다.", 13, 28), (2, "ABC 999", "다른 글이다.", None, None)]


@plan(values_sql([(i, s, e) for i, _, _, s, e in ALIGNED], ["id", "start", "end"]).replace(", end)", ', "end")'))
def aligned_claims(spark: SparkSession, folder: str) -> DataFrame:
    rows = answers.align(literal(spark, [r[:3] for r in ALIGNED], "id int, claim string, text string"), ["id"], answers.ALIGNED)
    return rows.select("id", "best.start", "best.end")


REWRITES = [
    (1, [], "스터디룸 예약은 어떻게 해?", "스터디룸 예약은 어떻게 해?", "standalone", False),
    (2, ["스터디룸은 어디에 있어?"], "거기서 음료 마셔도 돼?", "스터디룸 음료 마셔도 돼?", "pronoun", False),
    (3, ["RAG 과목은 몇 학점이야?"], "그럼 딥러닝은?", "딥러닝 은 몇 학점이야?", "topic switch", False),
    (4, [], "거기는 언제 열어?", "거기는 언제 열어?", "pronoun without topic", True),
    (5, ["도서관은 언제 열어?"], "주말은?", "도서관 주말은?", "carried", False),
    (6, [], "그럼 주말은?", "주말은?", "marker without topic", True),
]


@plan(values_sql([(i, q, r, c) for i, _, _, q, r, c in REWRITES], ["id", "query", "rule", "clarify"]))
def rewritten_questions(spark: SparkSession, folder: str) -> DataFrame:
    rows = literal(spark, [r[:3] for r in REWRITES], "id int, h array<string>, q string").select("id", conversation.rewriter(3)("h", "q").alias("r"))
    return rows.select("id", "r.query", "r.rule", "r.clarify")


@plan(values_sql([(1, ["성적 우수 장학금", "RAG"], "0,10", None, None), (2, ["도서관"], "3", "거기", "그럼"), (3, [], "", None, None)], ["id", "names", "starts", "pronoun", "marker"]))
def named_entities(spark: SparkSession, folder: str) -> DataFrame:
    rows = literal(spark, [(1, "성적 우수장학금과 RAG"), (2, "그럼 도서관 거기"), (3, "plain words")], "id int, t string").withColumn("e", conversation.entities("t"))
    return rows.select("id", F.col("e.name").alias("names"), F.array_join("e.start", ",").alias("starts"), conversation.pronoun(F.col("t")).alias("pronoun"), conversation.marker(F.col("t")).alias("marker"))


EXTRACTED = [(1, "rate of scholarship 몇", "scholarship", "First. The rate is 50%. The rate of it.", "The rate is 50%."), (2, "nothing here", "title", "Other words.", "Other words.")]


@plan(values_sql([(i, s) for i, *_, s in EXTRACTED], ["qid", "sentence"]))
def extracted_answers(spark: SparkSession, folder: str) -> DataFrame:
    idf = literal(spark, [("rate", 2.0), ("of", 0.1)], "term string, idf double")
    return conversation.extract_answers(literal(spark, [r[:4] for r in EXTRACTED], "qid int, query string, title string, text string"), idf).select("qid", "sentence")


@plan(values_sql([(1, 3, 10, None, 1), (1, 1, 10, 1, 1)], ["conv_id", "turn", "id", "raw", "rewritten"]))
def rewriting_compared(spark: SparkSession, folder: str) -> DataFrame:
    """What a follow-up finds as it is and rewritten."""
    docs = literal(spark, [(10, "도서관 운영 시간 주말 휴관"), (11, "기숙사 신청")], "doc_id int, text string")
    turns = literal(spark, [(1, 1, "user", "도서관은 언제 열어?"), (1, 2, "assistant", "9시"), (1, 3, "user", "거기는?")], "conv_id int, turn int, role string, text string")
    return conversation.compare_rewriting(turns, lambda q: Bm25Index.build(docs).search(q, 1))


SENTENCES = [(1, "수업료의 50%를 12시간 안에 RRF로 60개", ["50%:percent", "12시간:hours", "60개:unit:개", "RRF:term:search"]), (2, "고정 길이 청킹은 300자다", ["고정 길이 청킹:term:chunk", "300:number"]), (3, "값은 3.5 또는 7", ["3.5:number", "7:number"]), (4, "", [])]


@plan(values_sql([(i, c) for i, _, c in SENTENCES], ["id", "found"]))
def answer_candidates(spark: SparkSession, folder: str) -> DataFrame:
    rows = literal(spark, [r[:2] for r in SENTENCES], "id int, t string")
    return rows.select("id", F.transform(quiz.candidates("t"), lambda c: F.concat_ws(":", c["text"], c["type"])).alias("found"))


LESSONS = [("d", 1, "장학금은 수업료의 50%를 준다. 예약은 12시간 전에 해야 한다."), ("e", 2, "출석률은 80% 이상이어야 한다. 과제는 30%다.")]


def _quiz(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    docs = literal(spark, LESSONS, "id string, rank int, text string")
    items = quiz.generate(docs, quiz.pools(docs), 3, "normal", 1).withColumn("n", F.substring("id", 2, 3).cast("int"))
    return items, docs.select(F.col("id").alias("chunk_id"), F.col("id").alias("doc"), "text")


@plan(values_sql([("Q1", "빈칸에 알맞은 말은? 장학금은 수업료의 ____를 준다.", "50%", 4, "d", "ok"), ("Q2", "빈칸에 알맞은 말은? 출석률은 ____ 이상이어야 한다.", "80%", 4, "e", "ok"), ("Q3", "빈칸에 알맞은 말은? 예약은 ____ 전에 해야 한다.", "12시간", 4, "d", "ok")], ["id", "question", "answer", "choices", "chunk", "status"]))
def small_quiz(spark: SparkSession, folder: str) -> DataFrame:
    """Rounds over the sources, best candidates first; all items hold up against their sources."""
    items, chunks = _quiz(spark)
    return quiz.verify(items, chunks).select("id", "question", "answer", F.size("choices").alias("choices"), "chunk", "status")


@plan(values_sql([("Q1", "fail", "d", ["span"]), ("Q2", "ok", None, []), ("Q3", "fail", "d", ["span"])], ["id", "status", "held_by", "failed"]))
def moved_quotes(spark: SparkSession, folder: str) -> DataFrame:
    """Quotes that are cited from the wrong chunk, and the chunk that holds them."""
    items, chunks = _quiz(spark)
    checked = quiz.verify(items.withColumn("chunk", F.lit("e")), chunks)
    return checked.select("id", "status", "held_by", F.transform(F.filter("checks", lambda c: c["level"] == "fail"), lambda c: c["code"]).alias("failed"))


@plan(values_sql([(3, 0, 0, 1)], ["ok", "warn", "fail", "approved"]))
def quiz_counts(spark: SparkSession, folder: str) -> DataFrame:
    items, chunks = _quiz(spark)
    checked = quiz.verify(items, chunks)
    return quiz.counts(checked, checked.filter("id = 'Q2'").select(quiz.signature().alias("signature")))


CUTS = [
    ("recursive", 12, 0, "aaaa bbbb cccc dddd", ["0-10", "10-19"]), ("recursive", 10, 5, "one two three four", ["0-8", "4-14", "14-18"]), ("recursive", 4, 1, "abcdefghij", ["0-4", "3-7", "6-10"]),
    ("sentence", 20, 0, "One. Two is it. Three.", ["0-16", "16-22"]), ("sentence", 12, 6, "Aa. Bb. Cc. Dd.", ["0-12", "8-15"]), ("fixed", 4, 1, "abcdefghij", ["0-4", "3-7", "6-10"]),
]


@plan(values_sql([(i, c[4]) for i, c in enumerate(CUTS)], ["id", "spans"]))
def small_cuts(spark: SparkSession, folder: str) -> DataFrame:
    parts = []
    for i, (strategy, size, overlap, t, _) in enumerate(CUTS):
        own = chunk(literal(spark, [(i, t)], "doc_id int, text string"), ChunkConfig(strategy, size, overlap))
        parts.append(own.groupBy(F.col("doc").alias("id")).agg(F.sort_array(F.collect_list(F.struct("index", F.concat_ws("-", "start", "end").alias("s"))))["s"].alias("spans")))
    return reduce(DataFrame.unionByName, parts)
