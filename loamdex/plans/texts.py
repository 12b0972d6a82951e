"""Plans over texts: chunks, cleaning, masks, overlap, citations, conversations, quizzes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamdex.functions import cleaning
from loamdex.functions.diffs import diff
from loamdex.functions.html import html_to_text
from loamdex.functions.text import char_bigram_jaccard, citations, code_lines, contains_term, count_visible, escape_html, estimate_tokens, key_tokens, question_jaccard, sentences, strip_citations, window_share
from loamdex.operators import answers, conversation, quiz
from loamdex.operators.chunking import ChunkConfig, chunk, chunk_stats, cover, holders, overlap_cost, quote_spans, survival
from loamdex.operators.matching import containing
from loamdex.operators.metrics import cost
from loamdex.operators.retrieval import simulate
from loamdex.plans.common import documents, questions
from loamdex.session import stored
from loamdex.sources.readers import pages_of, paragraph, table

QUERIES, SQL = {}, {}
#: White space as (?U)\s sees it, in the pattern language of the SQL engine.
SPACE = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def plan(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


FIXED = ChunkConfig("fixed", 300, 60)


def fixed_sql(size: int, overlap: int, name: str = "chunk", source: str = "documents") -> str:
    step = size - overlap
    return rf"""{name} AS (
  SELECT doc_id AS doc, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS index, i * {step} AS start, least(i * {step} + {size}, length(text)) AS "end", substr(text, i * {step} + 1, {size}) AS text
  FROM {source}, unnest(generate_series(0, greatest(CAST(ceil((length(text) - {size}) / {step}.0) AS BIGINT), 0))) AS u(i)
  WHERE length(text) > 0 AND regexp_matches(substr(text, i * {step} + 1, {size}), '[^\t-\r ]'))"""


@plan(f'WITH {fixed_sql(300, 60)} SELECT doc, index, start, "end" FROM chunk')
def chunk_fixed(spark: SparkSession, folder: str) -> DataFrame:
    return chunk(documents(spark, folder), FIXED).select("doc", "index", "start", "end")


@plan(f"""WITH {fixed_sql(300, 60)}, n AS (SELECT doc, "end" - start AS n FROM chunk)
SELECT doc_id AS doc, count(n) AS count, CAST(coalesce(floor(avg(n) + 0.5), 0) AS BIGINT) AS avg, coalesce(min(n), 0) AS min, coalesce(max(n), 0) AS max, round(coalesce(greatest(sum(n) - any_value(length(text)), 0) / CAST(any_value(length(text)) AS DOUBLE), 0), 9) AS duplicated FROM documents LEFT JOIN n ON doc = doc_id GROUP BY doc_id""")
def chunk_statistics(spark: SparkSession, folder: str) -> DataFrame:
    out = chunk_stats(chunk(documents(spark, folder), FIXED), documents(spark, folder))
    return out.withColumn("duplicated", F.round("duplicated", 9))


@plan(f"""WITH {fixed_sql(300, 60)} SELECT (SELECT count(*) FROM chunk) AS chunks, (SELECT CAST(sum(length(text)) AS BIGINT) FROM documents) AS doc_chars, (SELECT CAST(sum("end" - start) AS BIGINT) FROM chunk) AS chunk_chars,
round((SELECT sum("end" - start) FROM chunk) / CAST((SELECT sum(length(text)) FROM documents) AS DOUBLE) - 1, 9) AS extra""")
def overlap_costs(spark: SparkSession, folder: str) -> DataFrame:
    return overlap_cost(chunk(documents(spark, folder), FIXED), documents(spark, folder)).withColumn("extra", F.round("extra", 9))


@plan(r"""WITH s AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '[.!?。]+["'')\]]?(?:\s+|$)|\n+', '\0' || chr(1), 'g'), chr(1)), lambda x: length(x) > 0) AS s FROM documents)
SELECT doc_id, i - 1 AS index, length(s[i]) AS n_chars FROM s, unnest(generate_series(1, len(s))) AS u(i)""")
def chunk_sentence(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).select("doc_id", F.posexplode(sentences("text")).alias("index", "s")).select("doc_id", "index", F.char_length("s").alias("n_chars"))


@plan()
def chunk_recursive(spark: SparkSession, folder: str) -> DataFrame:
    return chunk(documents(spark, folder), ChunkConfig("recursive", 200, 20)).select("doc", "index", "start", "end")


def _packed_sql(size: int, overlap: int) -> str:
    """Sentences, those over size cut into windows; then one chunk of each document a step: as many atoms as fit, and the next begins with the last ones that overlap allows."""
    return rf"""WITH RECURSIVE s AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '[.!?。]+["'')\]]?(?:\s+|$)|\n+', '\0' || chr(1), 'g'), chr(1)), lambda x: length(x) > 0) AS s FROM documents),
sentence AS (SELECT doc_id, i, length(s[i]) AS n, sum(length(s[i])) OVER (PARTITION BY doc_id ORDER BY i) - length(s[i]) AS o FROM s, unnest(generate_series(1, len(s))) AS u(i)),
atom AS (SELECT doc_id, o + w * {size} AS a, o + least(n, (w + 1) * {size}) AS b FROM sentence, unnest(generate_series(0, (n - 1) // {size})) AS u(w)),
own AS MATERIALIZED (SELECT doc_id, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b FROM atom GROUP BY doc_id),
step(doc_id, f, l) AS (
  SELECT doc_id, 1::BIGINT, len(list_filter(b, lambda x: x - a[1] <= {size})) FROM own UNION ALL
  SELECT doc_id, f, len(list_filter(b, lambda x: x - a[f] <= {size})) FROM (
    SELECT own.*, list_min(list_filter(generate_series(f + 1, l + 1), lambda j: j = l + 1 OR (b[l] - a[j] <= {overlap} AND b[l + 1] - a[j] <= {size}))) AS f FROM step JOIN own USING (doc_id) WHERE l < len(own.a))),
span AS (SELECT doc_id, CAST(a[f] AS BIGINT) AS start, CAST(b[l] AS BIGINT) AS "end" FROM step JOIN own USING (doc_id))
SELECT doc_id AS doc, row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS index, start, "end" FROM span JOIN documents USING (doc_id) WHERE regexp_matches(substr(text, start + 1, "end" - start), '[^\s]')"""


@plan(_packed_sql(200, 40))
def chunk_sentence_packed(spark: SparkSession, folder: str) -> DataFrame:
    return chunk(documents(spark, folder), ChunkConfig("sentence", 200, 40)).select("doc", "index", "start", "end")


@plan(f"""WITH {fixed_sql(300, 60)}, e AS (SELECT doc, start AS pos, 1 AS d FROM chunk UNION ALL SELECT doc, "end", -1 FROM chunk), s AS (SELECT doc, pos AS start, sum(d) AS d FROM e GROUP BY doc, pos),
w AS (SELECT doc, start, lead(start) OVER (PARTITION BY doc ORDER BY start) AS "end", CAST(sum(d) OVER (PARTITION BY doc ORDER BY start) AS BIGINT) AS n FROM s) SELECT * FROM w WHERE "end" IS NOT NULL""")
def chunk_cover(spark: SparkSession, folder: str) -> DataFrame:
    return cover(chunk(documents(spark, folder), FIXED))


def _quotes(spark: SparkSession, folder: str) -> DataFrame:
    """(doc, qid, quote): each benchmark passage with the documents that hold it."""
    quotes = table(spark, folder, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("quote"))
    return containing(documents(spark, folder), quotes).join(quotes, "qid").select(F.col("id").alias("doc"), "qid", "quote")


@plan("SELECT item_id AS qid, doc_id AS doc, instr(documents.text, benchmark.text) - 1 AS start FROM benchmark JOIN documents ON contains(documents.text, benchmark.text)")
def evidence_spans(spark: SparkSession, folder: str) -> DataFrame:
    return quote_spans(documents(spark, folder), _quotes(spark, folder)).select("qid", "doc", "start")


@plan(f"""WITH {fixed_sql(300, 60)}, q AS (SELECT item_id AS qid, doc_id AS doc, instr(documents.text, benchmark.text) - 1 AS s, instr(documents.text, benchmark.text) - 1 + length(benchmark.text) AS e FROM benchmark JOIN documents ON contains(documents.text, benchmark.text))
SELECT qid, doc, index, start <= s AND "end" >= e AS holds FROM q JOIN chunk USING (doc) WHERE start < e AND s < "end" """)
def evidence_holders(spark: SparkSession, folder: str) -> DataFrame:
    quotes = _quotes(spark, folder)
    cited = documents(spark, folder).join(quotes.select(F.col("doc").alias("doc_id")).distinct(), "doc_id", "left_semi")
    chunks = chunk(cited, FIXED)
    return holders(chunks, quote_spans(cited, quotes)).select("qid", "doc", F.substring_index("chunk_id", "#", -1).cast("int").alias("index"), "holds")


GRID = [(100, 0), (100, 20), (300, 60)]


@plan("WITH q AS MATERIALIZED (SELECT item_id AS qid, doc_id AS doc, instr(documents.text, benchmark.text) - 1 AS s, instr(documents.text, benchmark.text) - 1 + length(benchmark.text) AS e, benchmark.text AS quote FROM benchmark JOIN documents ON contains(documents.text, benchmark.text)), cited AS (SELECT * FROM documents WHERE doc_id IN (SELECT doc FROM q)), "
      + ", ".join(fixed_sql(s, o, f"c{i}", "cited") for i, (s, o) in enumerate(GRID)) + " "
      + " UNION ALL ".join(f"""SELECT 'fixed' AS strategy, {s} AS size, {o} AS overlap, count(*) FILTER (h) AS kept, count(*) AS quotes, count(*) FILTER (h) / CAST(count(*) AS DOUBLE) AS rate FROM (SELECT doc, quote, bool_or(coalesce(start <= s AND "end" >= e, false)) AS h FROM q LEFT JOIN c{i} USING (doc) GROUP BY doc, quote)""" for i, (s, o) in enumerate(GRID)))
def survival_rate(spark: SparkSession, folder: str) -> DataFrame:
    return survival(documents(spark, folder), _quotes(spark, folder), [ChunkConfig("fixed", s, o) for s, o in GRID])


# ---- cleaning


@plan(r"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), k AS (SELECT doc_id, i, trim(regexp_replace(regexp_replace(l[i], '[0-9]+', '#', 'g'), '\s+', ' ', 'g')) AS k FROM l, unnest(generate_series(1, len(l))) AS u(i)),
n AS (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS n FROM k)
SELECT doc_id, count(*) FILTER ((length(k) >= 4 AND n >= 2) OR (length(k) BETWEEN 1 AND 160 AND regexp_matches(k, '(?i)(로그인|회원가입|사이트맵|copyright|©|all rights reserved|개인정보처리방침|이용약관|무단수집거부)'))) AS dropped FROM n GROUP BY doc_id""")
def boilerplate_lines(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).select("doc_id", cleaning.remove_boilerplate("text").alias("r")).select("doc_id", F.col("r.count").alias("dropped"))


@plan(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents)
SELECT doc_id, count(*) FILTER (trim(l) <> '' AND regexp_matches(l, '(?i)^\s*(?:[-–—]\s*\d{1,4}\s*[-–—]|\d{1,4}\s*/\s*\d{1,4}|(?:page|p\.)\s*\d{1,4}(?:\s*of\s*\d{1,4})?|\d{1,3})\s*$')) + count(*) FILTER (regexp_matches(l, '\s+[-–—]\s*\d{1,4}\s*[-–—]\s*$') AND NOT regexp_matches(l, '(?i)^\s*(?:[-–—]\s*\d{1,4}\s*[-–—]|\d{1,4}\s*/\s*\d{1,4}|(?:page|p\.)\s*\d{1,4}(?:\s*of\s*\d{1,4})?|\d{1,3})\s*$')) AS removed FROM l GROUP BY doc_id""")
def page_number_lines(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).select("doc_id", cleaning.remove_page_numbers("text").alias("r")).select("doc_id", F.col("r.count").alias("removed"))


@plan(r"""WITH p AS (SELECT doc_id, string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10)) AS p FROM documents), k AS (SELECT doc_id, i, trim(regexp_replace(p[i], '\s+', ' ', 'g')) AS k FROM p, unnest(generate_series(1, len(p))) AS u(i))
SELECT doc_id, count(*) FILTER (k <> '' AND i > f) AS dropped FROM (SELECT *, min(i) OVER (PARTITION BY doc_id, k) AS f FROM k) GROUP BY doc_id""")
def dedupe_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    """Lines as paragraphs: the texts have no blank lines."""
    spaced = F.replace("text", F.lit("\n"), F.lit("\n\n"))
    return documents(spark, folder).select("doc_id", cleaning.dedupe_paragraphs(spaced).alias("r")).select("doc_id", F.col("r.count").alias("dropped"))


@plan()
def clean_documents(spark: SparkSession, folder: str) -> DataFrame:
    out = cleaning.clean(documents(spark, folder).select("doc_id", "text"), cleaning.RECOMMENDED_ELSE)
    return out.select("doc_id", F.char_length("text").alias("n_chars"), F.sha2("text", 256).alias("sha256"), "counts")


@plan(r"""SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[ \t]+(\n|$)', '\1', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\n+', ''), '\n+$', '')) AS sha256 FROM documents""")
def tidy_documents(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).select("doc_id", F.sha2(cleaning.tidy("text"), 256).alias("sha256"))


_R = [("전화번호", r"01[016789][-\s]?\d{3,4}[-\s]?\d{4}"), ("주민등록번호", r"\d{6}[-\s]?[1-4]\d{6}"), ("이메일", r"[\w.+-]+@[\w-]+\.[\w.-]+")]


def _masked(t: str) -> str:
    for name, pattern in _R:
        t = f"regexp_replace({t}, '{pattern}', '[{name}]', 'g')"
    return rf"regexp_replace({t}, '(^|[^0-9])20[0-9]{{8}}($|[^0-9])', '\1[학번]\2', 'g')"


@plan(f"SELECT doc_id, sha256({_masked('text')}) AS sha256, len(string_split({_masked('text')}, '[이메일]')) - len(string_split(text, '[이메일]')) AS n_email FROM documents")
def pii_mask(spark: SparkSession, folder: str) -> DataFrame:
    out = documents(spark, folder).select("doc_id", cleaning.mask_pii("text").alias("m"))
    return out.select("doc_id", F.sha2("m.text", 256).alias("sha256"), F.size(F.filter("m.found", lambda x: x == "이메일")).alias("n_email"))


@plan(r"SELECT conv_id, turn, left(regexp_replace(replace(text, 'de', '[redacted]'), 'sk-[\w-]{8,}|AIza[\w-]{20,}', '[redacted]', 'g'), 400) AS text FROM conversations")
def secret_scrub(spark: SparkSession, folder: str) -> DataFrame:
    """With a stand-in key that occurs in the texts."""
    return table(spark, folder, "conversations").select("conv_id", "turn", cleaning.scrub_secrets("text", "de").alias("text"))


@plan("""WITH s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s FROM documents)
SELECT doc_id, CAST(sum(CASE WHEN regexp_matches(s, '(?i)(이전|앞의|위의|모든)\\s*(지시|명령|규칙).{0,6}무시|ignore\\s+(all\\s+)?(previous|prior|above)') THEN 3 ELSE 0 END + CASE WHEN regexp_matches(s, '(?i)\\b(AI|LLM|assistant|model)\\b|너는|당신은|조교는|모델은') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(s, '(?i)지금부터|from now on') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(s, '(?i)라고만|답하라|출력하라|reveal|system prompt|시스템 프롬프트') THEN 1 ELSE 0 END) AS BIGINT) AS score FROM s GROUP BY doc_id""")
def injection_scores(spark: SparkSession, folder: str) -> DataFrame:
    rows = documents(spark, folder).select("doc_id", F.explode(F.split("text", "\n")).alias("s"))
    return rows.groupBy("doc_id").agg(F.sum(cleaning.injection_score("s")).alias("score"))


_ENTITIES = (("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&"))
_UNESCAPED = "s"
for _entity, _character in _ENTITIES:
    _UNESCAPED = f"replace({_UNESCAPED}, '{_entity}', '{_character}')"


@plan(rf"""WITH b AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(html, '(?s)<head>.*?</head>|<!--.*?-->|<script.*?</script>|<style.*?</style>', '', 'g'),
'</?(?:p|div|li|h[1-6]|section|article|header|footer|nav|aside|main|ul|ol|blockquote)(?: [^>]*)?>|<br>', chr(10), 'g'), '<[^>]*>', '', 'g') AS s FROM pages),
l AS (SELECT page_id, url, array_to_string(list_transform(string_split({_UNESCAPED}, chr(10)), lambda x: regexp_replace(regexp_replace(x, '[ 	]+', ' ', 'g'), '^\s+|\s+$', '', 'g')), chr(10)) AS t FROM b),
t AS (SELECT page_id, url, regexp_replace(regexp_replace(t, '
{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS text FROM l) SELECT page_id, url, text, length(text) AS n_chars FROM t""")
def html_texts(spark: SparkSession, folder: str) -> DataFrame:
    out = table(spark, folder, "pages").withColumn("text", html_to_text("html"))
    return out.select("page_id", "url", "text", F.char_length("text").alias("n_chars"))


@plan(r"""WITH c AS (SELECT doc_id, text, coalesce(string_split(text, chr(10) || chr(10))[1], '') || ' +' AS p FROM documents) SELECT doc_id, length(p) AS n_chars FROM c""")
def first_paragraph(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).select("doc_id", F.char_length(paragraph("text", 0, "+")).alias("n_chars"))


@plan("SELECT doc_id AS doc, 1 AS page, length(text) AS n_chars FROM documents")
def pages(spark: SparkSession, folder: str) -> DataFrame:
    return pages_of(documents(spark, folder)).select("doc", "page", F.char_length("text").alias("n_chars"))


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    """Five lines of a document are a page."""
    lines = documents(spark, folder).select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("i", "l"))
    pages = lines.groupBy("doc", F.floor(F.col("i") / 5).alias("page")).agg(F.sort_array(F.collect_list(F.struct("i", "l"))).alias("x"))
    return pages.select("doc", "page", F.array_join("x.l", "\n").alias("text"))


@plan(r"""WITH l AS (SELECT doc_id AS doc, string_split(text, chr(10)) AS l FROM documents), p AS (SELECT doc, (i - 1) // 5 AS page, trim(regexp_replace(regexp_replace(l[i], '[0-9]+', '#', 'g'), '\s+', ' ', 'g')) AS key FROM l, unnest(generate_series(1, len(l))) AS u(i)),
n AS (SELECT doc, key, count(DISTINCT page) AS n FROM p WHERE key <> '' GROUP BY doc, key), s AS (SELECT doc, count(DISTINCT page) AS pages FROM p GROUP BY doc) SELECT doc, key FROM n JOIN s USING (doc) WHERE n >= greatest(2, ceil(pages * 0.5))""")
def lines_across_pages(spark: SparkSession, folder: str) -> DataFrame:
    return cleaning.repeated_across_pages(_pages(spark, folder))


@plan("""SELECT item_id, doc_id AS doc, CASE WHEN contains(documents.text, benchmark.text) THEN 'present' WHEN contains(regexp_replace(documents.text, '\\s+', '', 'g'), regexp_replace(benchmark.text, '\\s+', '', 'g')) THEN 'spaced' ELSE 'absent' END AS state FROM benchmark JOIN documents ON doc_id = item_id""")
def fact_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each passage is in the document of the same number."""
    checks = table(spark, folder, "benchmark").select(F.col("item_id").alias("doc"), "item_id", F.col("text").alias("needle"))
    return cleaning.check_facts(documents(spark, folder), checks).select("item_id", "doc", "state")


@plan()
def cleaning_diffs(spark: SparkSession, folder: str) -> DataFrame:
    """What the cleaning steps changed in each document. Comparing is quadratic in the changed part, so documents are dealt out anew first."""
    docs = documents(spark, folder).select("doc_id", "text", F.col("text").alias("raw"))
    cleaned = cleaning.clean(docs, cleaning.RECOMMENDED_ELSE).repartition("doc_id")
    return cleaned.select("doc_id", "counts", diff("raw", "text").alias("runs"))


@plan()
def retrieval_simulation(spark: SparkSession, folder: str) -> DataFrame:
    """Chunk settings compared by hit, rank, context and density."""
    quotes = stored(_quotes(spark, folder).select("qid", "doc", "quote"))
    configs = [ChunkConfig("recursive", 150, 20, k=3), ChunkConfig("fixed", 300, 60, k=3)]
    rows = [simulate(documents(spark, folder), questions(spark, folder), quotes, c).withColumn("strategy", F.lit(c.strategy)) for c in configs]
    return rows[0].unionByName(rows[1])


# ---- scalars


@plan(r"""SELECT doc_id, CAST(ceil((length(text) - length(regexp_replace(text, '[가-힣ㄱ-ㆎ]', '', 'g'))) * 0.8 + length(regexp_replace(text, '[가-힣ㄱ-ㆎ]', '', 'g')) / 4.0) AS BIGINT) AS estimate, length(regexp_replace(text, '\s+', '', 'g')) AS visible,
round(ceil(length(regexp_replace(text, '[가-힣ㄱ-ㆎ]', '', 'g')) / 4.0) / 8192, 9) AS share, round(ceil(length(text) / 4.0) * 0.15 / 1000000, 12) AS price FROM documents""")
def token_estimates(spark: SparkSession, folder: str) -> DataFrame:
    e = estimate_tokens("text")
    return documents(spark, folder).select("doc_id", e.alias("estimate"), count_visible("text").alias("visible"), F.round(window_share(e, 8192), 9).alias("share"), F.round(cost(e, 8192, 0.15)["price"], 12).alias("price"))


_GRAMS = "list_distinct(list_transform(generate_series(1, length({0}) - 1), lambda i: substr({0}, i, 2)))"


@plan(rf"""WITH t AS (SELECT item_id, regexp_replace(text, '[\s.,!?·"''()]', '', 'g') AS t, lower(regexp_replace(text, '[\s\p{{P}}\p{{S}}_]+', '', 'g')) AS u FROM benchmark),
g AS (SELECT item_id, {_GRAMS.format('t')} AS g, {_GRAMS.format('u')} AS h FROM t)
SELECT a.item_id AS i, b.item_id AS j, round(len(list_intersect(a.g, b.g)) / CAST(len(list_distinct(a.g || b.g)) AS DOUBLE), 9) AS chars, round(len(list_intersect(a.h, b.h)) / CAST(len(list_distinct(a.h || b.h)) AS DOUBLE), 9) AS questions FROM g a JOIN g b ON b.item_id = a.item_id + 1""")
def bigram_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """Of each passage and the next."""
    b = table(spark, folder, "benchmark")
    pairs = b.select(F.col("item_id").alias("i"), F.col("text").alias("a")).join(b.select((F.col("item_id") - 1).alias("i"), F.col("item_id").alias("j"), F.col("text").alias("b")), "i")
    return pairs.select("i", "j", F.round(char_bigram_jaccard("a", "b"), 9).alias("chars"), F.round(question_jaccard("a", "b"), 9).alias("questions"))


@plan(r"""SELECT doc_id, length(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')) AS escaped, len(list_filter(string_split(text, chr(10)), lambda s: trim(s) <> '' AND NOT starts_with(trim(s), '#'))) AS lines FROM documents""")
def markup_scalars(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).select("doc_id", F.char_length(escape_html("text")).alias("escaped"), code_lines("text").alias("lines"))


def _answers(spark: SparkSession, folder: str) -> DataFrame:
    """Assistant turns with citations put after them: [turn % 3 + 1, 2]."""
    return table(spark, folder, "conversations").filter("role = 'assistant'").select("conv_id", "turn", F.concat("text", F.lit(" ["), (F.col("turn") % 3 + 1).cast("string"), F.lit(", 2]")).alias("answer"))


@plan(r"""WITH a AS (SELECT conv_id, turn, text || ' [' || (turn % 3 + 1) || ', 2]' AS answer FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn, list_transform(flatten(list_transform(regexp_extract_all(answer, '\[(\d+(?:\s*,\s*\d+)*)\]', 1), lambda g: string_split(g, ','))), lambda n: CAST(trim(n) AS INT)) AS cites,
trim(regexp_replace(regexp_replace(regexp_replace(answer, '\[(\d+(?:\s*,\s*\d+)*)\]', '', 'g'), '\s+([.!?。])', '\1', 'g'), '\s{2,}', ' ', 'g')) AS plain FROM a""")
def citation_parse(spark: SparkSession, folder: str) -> DataFrame:
    return _answers(spark, folder).select("conv_id", "turn", citations("answer").alias("cites"), strip_citations("answer").alias("plain"))


@plan()
def support_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Assistant turns as answers, their user turns as sources 1 and 2."""
    rows = _answers(spark, folder).select(F.struct("conv_id", "turn").alias("qid"), "answer")
    users = table(spark, folder, "conversations").filter("role = 'user'")
    sources = users.select(F.struct("conv_id", (F.col("turn") + 1).alias("turn")).alias("qid"), F.explode(F.array(F.lit(1), F.lit(2))).alias("n"), "text")
    return answers.citation_stats(answers.validate_answers(rows, sources)).select("qid.*", "sentences", "claims", "cited", "coverage", "invalid", "uncited", "unsupported", "weak", "ok")


@plan()
def faithfulness(spark: SparkSession, folder: str) -> DataFrame:
    """Each assistant turn against the user turn before it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, folder, "conversations").withColumn("context", F.lag("text").over(w)).filter("role = 'assistant' and context is not null")
    return rows.select("conv_id", "turn", answers.faithfulness("text", "context").alias("f")).select("conv_id", "turn", "f.*")


@plan(r"""SELECT item_id, len(list_distinct(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}%]+'), lambda w: length(w) >= 2))) AS n FROM benchmark""")
def key_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The texts have no Hangul, so no endings or stop words take part."""
    return table(spark, folder, "benchmark").select("item_id", F.size(key_tokens("text")).alias("n"))


@plan("SELECT a.item_id, contains(lower(a.text), lower(split_part(b.text, ' ', 1))) AS found FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1")
def term_containment(spark: SparkSession, folder: str) -> DataFrame:
    b = table(spark, folder, "benchmark")
    return b.join(b.select((F.col("item_id") - 1).alias("item_id"), F.split("text", " ").getItem(0).alias("term")), "item_id").select("item_id", contains_term("text", "term").alias("found"))


# ---- conversations


@plan("""SELECT conv_id, turn, coalesce(list(text) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), []) AS history, lag(turn) OVER w AS previous_turn FROM conversations WHERE role = 'user' WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def conv_history_window(spark: SparkSession, folder: str) -> DataFrame:
    return conversation.with_history(table(spark, folder, "conversations"), 3).select("conv_id", "turn", "history", "previous_turn")


@plan(r"""WITH u AS (SELECT conv_id, turn, nullif(regexp_extract(lower(text), '[\p{L}]{9,}'), '') AS topic FROM conversations WHERE role = 'user')
SELECT conv_id, turn, topic, last_value(topic IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS carried FROM u""")
def conv_prev_topic(spark: SparkSession, folder: str) -> DataFrame:
    """The first long word stands for a turn's topic."""
    user = table(spark, folder, "conversations").filter("role = 'user'")
    word = F.regexp_extract(F.lower("text"), r"[\p{L}]{9,}", 0)
    return conversation.carried_topic(user, F.when(word != "", word), 3).select("conv_id", "turn", "topic", "carried")


@plan(r"""WITH t AS (SELECT *, CASE WHEN lead(role) OVER w = 'assistant' THEN trim(regexp_replace(regexp_replace(lead(text) OVER w, '\s*\[(\d+(?:\s*,\s*\d+)*)\]', '', 'g'), '\s{2,}', ' ', 'g')) END AS bot FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
x AS (SELECT conv_id, turn, text, '사용자: ' || text || coalesce(chr(10) || '챗봇: ' || CASE WHEN length(bot) > 160 THEN left(bot, 160) || '…' ELSE bot END, '') AS x FROM t WHERE role = 'user'),
h AS (SELECT conv_id, turn, text, coalesce(list(x) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), []) AS l, row_number() OVER w - 1 AS n FROM x WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, CASE WHEN len(l) > 0 THEN '대화 기록 (최근 ' || len(l) || '턴):' || chr(10) || array_to_string(l, chr(10)) ELSE '대화 기록: (없음)' END || chr(10) || chr(10) || '마지막 질문: ' || text || chr(10) || chr(10) || '독립 질문:' AS prompt, len(l) AS included, n - len(l) AS dropped FROM h""")
def conv_prompt(spark: SparkSession, folder: str) -> DataFrame:
    out = conversation.condense_prompts(table(spark, folder, "conversations"), 3)
    return out


@plan()
def conv_rewrite(spark: SparkSession, folder: str) -> DataFrame:
    rows = conversation.with_history(table(spark, folder, "conversations"), 3)
    return rows.select("conv_id", "turn", conversation.rewriter(3)("history", "text").alias("r")).select("conv_id", "turn", "r.*")


# ---- quizzes


@plan()
def quiz_items(spark: SparkSession, folder: str) -> DataFrame:
    """Items from the documents with numbers, in order of their ids, verified against them."""
    docs = documents(spark, folder)
    sources = docs.filter(F.col("text").rlike(r"\d{2,}%|version \d")).select(F.col("doc_id").alias("rank"), F.col("doc_id").cast("string").alias("id"), "text")
    items = quiz.generate(sources, quiz.pools(docs), 10, "normal", 7).withColumn("n", F.substring("id", 2, 9).cast("int"))
    items = stored(items)  # ten rows, read three times below
    chunks = sources.select(F.col("id").alias("chunk_id"), F.col("id").alias("doc"), "text")
    return quiz.verify(items, chunks).select("id", "question", "answer", "choices", "chunk", "checks", "status")
