"""Small cases of functions, re-typed from the expectations that the exercises state."""

import pytest
from pyspark.sql import functions as F

from loamdex.functions import cleaning as C
from loamdex.functions import html as H
from loamdex.functions import text as T
from loamdex.functions import vectors as V


@pytest.fixture(scope="module")
def one(spark):
    def run(column, **values):
        df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<double>' if isinstance(v, list) and v and isinstance(v[0], float) else 'array<string>' if isinstance(v, list) else 'int' if isinstance(v, int) else 'string'}" for k, v in values.items())) if values else spark.range(1)
        return df.select(column.alias("x")).first()[0]

    return run


def test_tokens(one):
    assert one(T.tokenize("t"), t="305호") == ["305호", "30", "05", "5호"]
    assert len(one(T.tokenize("t"), t="305호와 306호를")) == 10
    assert one(T.tokenize("t"), t="") == [] and one(T.tokenize("t"), t=None) is None


def test_sentences(one):
    t = "GPA 4.0 is needed. Really!\nYes? End"
    assert one(T.sentences("t"), t=t) == ["GPA 4.0 is needed. ", "Really!\n", "Yes? ", "End"]
    spans = one(T.spans(T.sentences("t")), t=t)
    assert "".join(t[s.start : s.end] for s in spans) == t
    assert one(T.sentences("t"), t="\n\na") == ["\n\n", "a"] and one(T.sentences("t"), t="") == []


def test_facts(one):
    def holds(text, answer):
        return one(T.contains_facts("a", "b"), a=text, b=answer)

    assert holds("최대 12 시간까지", "12시간이다.") and not holds("112시간", "12시간") and holds("40 퍼센트", "40%")
    assert holds("재수강은 불가능하다", "재수강은 불가능하다.") and not holds("모른다", "8시간")


def test_templates(one):
    q = one(T.fill_template("질문: {question} {other}", {"question": F.col("q")}), q="{context}는 뭐지?")
    assert q == "질문: {context}는 뭐지? {other}"
    r = one(T.placeholders(F.array(F.lit("{question} {topic}"))))
    assert r.missing == ["context"] and r.unknown == ["topic"]


def test_citations(one):
    assert one(T.citations("t"), t="a [1]. b [1][2]. c [3, 4]") == [1, 1, 2, 3, 4]
    assert one(T.strip_citations("t"), t="그렇다 [1] . 끝 [2, 3]") == "그렇다. 끝"
    rows = one(T.cited_sentences("t"), t="점수는 4.0이다. [1]\n끝이다 [2]")
    assert [r.text for r in rows] == ["점수는 4.0이다. [1]", "끝이다 [2]"]


def test_quotes_and_terms(one):
    found = one(T.find_quote("t", "q", F.lit(None).cast("int"), F.lit(None).cast("int")), t="가 나 다라 마", q="나다 라")
    assert (found.start, found.end) == (2, 6)
    assert one(T.find_quote("t", "q", F.lit(3), F.lit(None).cast("int")), t="가 나 다라 마", q="나다 라").start is None
    assert not one(T.contains_term("t", "q"), t="12시간", q="2") and one(T.contains_term("t", "q"), t="GPU  Server", q="gpu server")
    assert one(T.cloze("t", "a"), t="k는 60이고 160은 아니다", a="60") == "k는 ____이고 160은 아니다"


def test_overlap(one):
    assert one(T.char_bigram_jaccard("a", "b"), a="", b="") == 1.0 and one(T.char_bigram_jaccard("a", "b"), a="abc", b="a b c!") == 1.0
    assert one(T.coverage(T.tokenize("a"), T.tokenize("b")), a="x y", b="y z") == 0.5 and one(T.coverage(T.tokenize("a"), T.tokenize("b")), a="", b="y") == 0.0


def test_small_ones(one):
    assert one(T.document_of("t"), t="rag-hybrid#2") == "rag-hybrid"
    assert one(T.escape_html("t"), t="<a&\"'>") == "&lt;a&amp;&quot;&#39;&gt;"
    assert one(T.code_lines("t"), t="# c\n\nx = 1\n") == 1
    assert one(T.estimate_tokens("t"), t="가나abcd") == 3
    assert [(r.text, r.hit) for r in one(T.marked("t", "k"), t="abcab", k=["ab"])] == [("ab", True), ("c", False), ("ab", True)]
    assert one(T.key_terms("t"), t="수강은 12.5학점이 the 가능").numbers == ["12.5"]


def test_ocr_digits(one):
    cases = {"5O%": "50%", "2l4": "214", "1O시간": "10시간", "MLOps": "MLOps", "COVID19": "COVID19", "4.O": "4.O", "l0O": "100", "OIl": "OIl", "B1O": "B1O"}
    for given, expected in cases.items():
        assert one(C.fix_ocr_digits("t"), t=given).text == expected, given


def test_cleaning_steps(one):
    r = one(C.remove_page_numbers("t"), t="a\n- 2 -\nb - 3 -\n3 / 10\nPage 4\nc")
    assert r.text == "a\nb\nc" and r["count"] == 4
    assert one(C.dedupe_paragraphs("t"), t="x  y\n\nz\n\nx y\n\n") .text == "x  y\n\nz\n\n"
    r = one(C.remove_boilerplate("t"), t="머리글 1쪽\n본문\n머리글 2쪽\nCopyright x\nab\nab")
    assert r.text == "본문\nab\nab" and r["count"] == 3
    r = one(C.rebuild_timetable("t"), t="요일 교시 과목 강의실 담당\n월 1-3 딥러닝 306 이 교수 화 1-3 현장 실습 외부 산업체")
    assert r.text.split("\n") == ["요일 | 교시 | 과목 | 강의실 | 담당", "월 | 1-3 | 딥러닝 | 306 | 이 교수", "화 | 1-3 | 현장 실습 | 외부 산업체 | —"]
    assert one(C.merge_syllables("t"), t="장 학 금 안 내\n평 점이 지급한 다.").text == "장학금안내\n평점이 지급한다."
    assert one(C.tidy("t"), t="\n\na  \n\n\n\nb\n") == "a\n\nb"
    assert one(C.remove_hangul_spaces("t"), t="가 나 a").text == "가나 a"


def test_clean_order(spark):
    t = "Q. 노트북?\nA. 된다\n\nQ. 노트북?\nA. 된다\n\n- 1 -\n끝"
    out = C.clean(spark.createDataFrame([(t,)], "text string"), ["header", "dedupe", "pagenum"]).first()
    assert out.text.count("노트북") == 1 and out.counts["dedupe"] == 1 and out.counts["header"] == 0


def test_masks(one):
    r = one(C.mask_pii("t"), t="010-1234-5678, a.b@c.kr, 2023123456")
    assert r.text == "[전화번호], [이메일], [학번]" and r.found == ["전화번호", "이메일", "학번"]
    assert one(C.scrub_secrets("t", "KEY"), t="KEY sk-abcdefgh1 x") == "[redacted] [redacted] x"
    assert one(C.kept_fact("t", F.lit("가 나")), t="가나") == "spaced"
    assert one(C.ocr_suspects("t"), t="5O% 장 학 금 안 내") == ["5O%", "장 학 금 안 내"]


def test_html():
    html = "<head><title>t</title></head><body><h1>A</h1><p>x<br>y &amp; z</p><script>no</script><table><tr><th>a</th><td> b  c</td></tr></table></body>"
    assert H.text_of(html) == "A\n\nx\ny & z\n\na | b c"
    assert H.text_of("") == "" and H.text_of("<p>open") == "open"


def test_references_without_semicolon_stay():
    assert H.text_of("<h1>a&amp;&amp; b&amp</h1><p>c&lt &copy;&#39;&#39 AT&T & d</p>") == "a&& b&amp\n\nc&lt ©'&#39 AT&T & d"


def test_vectors(one):
    a, b = [1.0, 2.0, 2.0], [0.0, 0.0, 0.0]
    assert one(V.cosine("a", "b"), a=a, b=b) == 0.0 and one(V.norm("a"), a=a) == 3.0
    assert one(V.dot("a", "b"), a=a, b=[1.0]) is None
    u, w = [0.6, 0.8], [0.8, 0.6]
    assert abs(one(V.euclid("a", "b"), a=u, b=w) ** 2 - (2 - 2 * one(V.cosine("a", "b"), a=u, b=w))) < 1e-12
    e = one(V.toy_embedding()("t"), t="abc")
    assert sum(e) == 2 and e[(97 * 31 + 98) % 256] == 1


def test_softmax(spark):
    rows = spark.createDataFrame([(1, 2.0), (1, 1.0), (1, 0.5)], "g int, z double").select(F.round(100 * V.softmax("z", 1.0, ["g"]), 1).alias("p")).collect()
    assert sorted((r.p for r in rows), reverse=True) == [62.9, 23.1, 14.0]
