"""Prompts, generation behind an interface, and checks of answers against their sources."""

from __future__ import annotations

import time
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamdex.functions.text import _c, citations, cited_sentences, key_terms, key_tokens, let, matches, sentences, spans, squeeze, strip_citations, tokenize, trim_blank

# Wording that results are compared by.
RAG_SYSTEM = "너는 주어진 근거 문서만 사용해 답하는 조교다. 근거에 없는 내용은 \"문서에서 찾을 수 없다\"고 답한다. 문장마다 사용한 근거 번호를 [1]처럼 표기한다."
RAG_SOURCES, RAG_QUESTION = "근거 문서:\n", "\n\n질문: "
REFUSED = "문서에서 찾을 수 없다."
REFUSAL = "찾을 수 없|알 수 없|내용이 없|정보가 없|답할 수 없"
EXAMPLE, ACTUAL, DOCUMENT, QUESTION, ANSWER = "### 예시 ", "### 실제 질문", "문서", "질문: ", "답:"
JUDGE_FORMAT = '{"claims":[{"claim":"...","supported":true,"reason":"..."}],"faithfulness":0.0}'
LEAST_OVERLAP, SUPPORTED, ALIGNED = 3, 0.6, 0.5


# ---- prompts


def numbered(texts: Column) -> Column:
    return F.array_join(F.transform(texts, lambda t, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), t)), "\n\n")


def rag_prompt(question: Column | str, texts: Column | str) -> Column:
    """struct(system, user) with numbered sources before the question."""
    return F.struct(F.lit(RAG_SYSTEM).alias("system"), F.concat(F.lit(RAG_SOURCES), numbered(_c(texts)), F.lit(RAG_QUESTION), _c(question)).alias("user"))


def contexts(ranked: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """(qid, ids, texts) of the k best, in rank order."""
    top = ranked.filter(F.col("rank") <= k).join(texts.select("id", "text"), "id")
    return top.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "text"))).alias("_r")).select("qid", F.col("_r.id").alias("ids"), F.col("_r.text").alias("texts"))


def few_shot(instruction: str, examples: list[dict], question: Column, context: Column) -> Column:
    """Instruction, numbered examples, and the question, left open at the answer."""
    block = lambda title, c, q, a: F.concat(F.lit(f"{title}\n<{DOCUMENT}>"), c, F.lit(f"</{DOCUMENT}>\n{QUESTION}"), q, F.lit(f"\n{ANSWER}{a}"))
    shots = [block(f"{EXAMPLE}{i}", F.lit(e["context"]), F.lit(e["q"]), " " + e["a"]) for i, e in enumerate(examples, 1)]
    return F.concat_ws("\n\n", F.lit(instruction), *shots, block(ACTUAL, context, question, ""))


def judge_prompt(texts: Column, answer: Column) -> Column:
    return F.concat(F.lit("Sources:\n"), numbered(texts), F.lit("\n\nAnswer:\n"), answer, F.lit("\n\nSplit the answer into claims and judge each by the sources. Reply with this JSON only:\n" + JUDGE_FORMAT))


def variants(rows: DataFrame, templates: dict[str, tuple[str, str]], values: dict[str, Column]) -> DataFrame:
    """rows once for each named variant (system and user template), with variant, system and user filled in."""
    from functools import reduce

    from loamdex.functions.text import fill_template

    made = [rows.select("*", F.lit(n).alias("variant"), fill_template(s, values).alias("system"), fill_template(u, values).alias("user")) for n, (s, u) in templates.items()]
    return reduce(DataFrame.unionByName, made)


def run_variants(rows: DataFrame, templates: dict[str, tuple[str, str]], values: dict[str, Column], generator, key: str = "qid") -> DataFrame:
    """(key, variant, answer) of all variants at once: one plan over all prompts, so they run side by side."""
    made = variants(rows, templates, values).withColumn("_qid", F.struct(key, "variant"))
    answered = generator.generate(made.select(F.col("_qid").alias("qid"), F.col("user").alias("question"), "texts"))
    return answered.select(F.col(f"qid.{key}").alias(key), F.col("qid.variant").alias("variant"), "answer")


# ---- generation


class Generator(Protocol):
    """Adds a column answer to prompts (qid, question, texts). Real models are plug-ins that run as Arrow functions on executors."""

    def generate(self, prompts: DataFrame) -> DataFrame: ...


#: Public request forms. Where a form puts its parts: the key's header and what stands before it, the system text, messages, limits, and the reply's text.
FORMS = {
    "messages": {"header": "x-api-key", "prefix": "", "system": "system", "limit": "max_tokens", "texts": lambda j: [b["text"] for b in j["content"] if b["type"] == "text"]},
    "chat": {"header": "authorization", "prefix": "Bearer ", "system": None, "limit": "max_tokens", "texts": lambda j: [c["message"]["content"] for c in j["choices"][:1]]},
    "contents": {"header": "x-goog-api-key", "prefix": "", "system": "systemInstruction", "limit": None, "texts": lambda j: [p["text"] for c in j["candidates"][:1] for p in c["content"]["parts"]]},
}


@dataclass
class Provider:
    """A remote model behind one of the FORMS. The key is held by the driver's session, never by a column or a message; transport(headers, body) gives (status, reply) and is a plug-in."""

    name: str
    models: tuple[str, ...] = ()
    form: str = "messages"
    transport: object = None
    _key: str | None = field(default=None, repr=False)

    def set_key(self, key: str) -> None:
        self._key = key.strip() or None

    def has_key(self) -> bool:
        return bool(self._key)

    def clear_key(self) -> None:
        self._key = None

    def request(self, model: str, system: str, user: str, most_tokens: int = 1024, temperature: float = 0.2) -> dict:
        """What would be sent, without the key."""
        if not self.has_key():
            raise GenerationError("no-key", "no key is set")
        if self.form not in FORMS:
            raise GenerationError("bad-provider", f"unknown form {self.form}")
        form = FORMS[self.form]
        if self.form == "contents":
            parts = lambda t: {"parts": [{"text": t}]}
            return {form["system"]: parts(system), "contents": [{"role": "user", **parts(user)}], "generationConfig": {"maxOutputTokens": most_tokens, "temperature": temperature}}
        asked = [{"role": "user", "content": user}]
        top = {form["system"]: system} if form["system"] else {}
        return {"model": model, **top, "messages": asked if top else [{"role": "system", "content": system}, *asked], form["limit"]: most_tokens, "temperature": temperature}

    def headers(self) -> dict:
        form = FORMS[self.form]
        return {"content-type": "application/json", form["header"]: form["prefix"] + (self._key or "")}

    def call(self, model: str, system: str, user: str, **settings) -> str:
        """The reply's text. Errors carry a code and a status, and no key."""
        body = self.request(model, system, user, **settings)
        try:
            status, reply = self.transport(self.headers(), body)
        except OSError as e:
            raise GenerationError("network", "no connection") from e
        if status != 200:
            said = str((reply.get("error") or {}).get("message", "") if isinstance(reply, dict) else "").replace(self._key, "[redacted]")
            raise GenerationError("http", f"{status} {said}".strip(), status)
        return "".join(FORMS[self.form]["texts"](reply))


class GenerationError(RuntimeError):
    """code: no-key, bad-provider, network or http; hint says what to do about a status."""

    HINTS = {401: "the key is wrong", 403: "the key may not use this model", 429: "too many requests: wait"}

    def __init__(self, code: str, message: str, status: int | None = None):
        super().__init__(" ".join(x for x in (message, self.HINTS.get(status, "")) if x))
        self.code, self.status = code, status


class OverlapGenerator:
    """Deterministic stand-in: the source sentence that shares the most tokens with the question, cited; a refusal under LEAST_OVERLAP."""

    def generate(self, prompts: DataFrame) -> DataFrame:
        """Each prompt by its own texts, in its row: nothing is shuffled."""
        none = F.array().cast("array<struct<shared:int,n:int,i:int,s:string>>")

        def best(q: Column) -> Column:
            scored = lambda s, i, n: F.struct(F.size(F.array_intersect(q, tokenize(s))).alias("shared"), (-n).alias("n"), (-i).alias("i"), s.alias("s"))
            cut = lambda t, n: F.coalesce(F.transform(F.split(t, r"(?<=[.!?])\s+|\n+"), lambda s, i: scored(s, i, n)), none)
            return F.array_max(F.flatten(F.transform("texts", cut)))

        said = F.concat(trim_blank("_b.s"), F.lit(" ["), (1 - F.col("_b.n")).cast("string"), F.lit("]"))
        found = prompts.withColumn("_b", let(F.array_distinct(tokenize("question")), best))
        return found.withColumn("answer", F.coalesce(F.when(F.col("_b.shared") >= LEAST_OVERLAP, said), F.lit(REFUSED))).drop("_b")


class GuessingGenerator:
    """Stand-in for a model without sources: one of some plausible values, by a seeded hash; with texts, the sentence that shares most character pairs."""

    def __init__(self, guesses: list[str], seed: int = 42):
        self.guesses, self.seed = guesses, seed

    def generate(self, prompts: DataFrame) -> DataFrame:
        """prompts (qid, question, texts, null texts for none) with answer and cite (the sentence it rests on, null for a guess)."""
        from loamdex.functions.text import bigrams

        pick = F.get(F.array(*map(F.lit, self.guesses)), F.pmod(F.xxhash64(F.lit(self.seed), "qid"), F.lit(len(self.guesses))).cast("int"))
        parts = prompts.select("qid", F.array_distinct(bigrams(squeeze("question"))).alias("_q"), F.explode("texts").alias("_t")).select("qid", "_q", F.posexplode(F.split("_t", r"(?<=[.!?])\s+")).alias("_i", "_s"))
        shared = F.size(F.array_intersect("_q", bigrams(squeeze("_s"))))
        best = parts.groupBy("qid").agg(F.max_by(trim_blank("_s"), F.struct(shared, -F.col("_i"))).alias("cite"))
        return prompts.join(best, "qid", "left").withColumn("answer", F.coalesce("cite", pick))


def verifiable(cite: Column, source: Column, fact: Column) -> Column:
    """Whether a citation is there, stands in the source word for word, and holds the fact."""
    return F.coalesce(F.contains(source, cite) & F.contains(squeeze(cite), squeeze(fact)), F.lit(False))


def saved_answers(hits: DataFrame, saved: DataFrame, fallback: str) -> DataFrame:
    """(qid, answer, verdict): the recorded answer for found or missed evidence. hits (qid, rank, 0 for none); saved (qid, hit, miss structs of text, verdict)."""
    rows = hits.join(saved, "qid", "left")
    found = F.col("rank") > 0
    text = F.when(found, F.replace(F.col("hit.text"), F.lit("{ev}"), F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("]")))).otherwise(F.coalesce("miss.text", F.lit(fallback)))
    return rows.select("qid", text.alias("answer"), F.when(found, F.col("hit.verdict")).otherwise(F.coalesce("miss.verdict", F.lit("refused"))).alias("verdict"))


@dataclass
class StepLog:
    """Names, seconds and notes of the steps of a run, as rows."""

    rows: list[tuple[str, float, str]] = field(default_factory=list)

    @contextmanager
    def step(self, name: str, note: str = ""):
        began = time.perf_counter()
        try:
            yield
        finally:
            self.rows.append((name, time.perf_counter() - began, note))

    def frame(self, spark) -> DataFrame:
        return spark.createDataFrame(self.rows, "step string, seconds double, note string")


# ---- checks


def _has_word(source: Column, word: Column) -> Column:
    """A Hangul word of over two characters is there if any of its bigrams is."""
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(word) - 1, F.lit(1))), lambda i: F.substring(word, i, F.lit(2)))
    return F.when(word.rlike("^[가-힣]") & (F.char_length(word) > 2), F.exists(pairs, lambda p: F.contains(source, p))).otherwise(F.contains(source, word))


def support(claim: Column | str, source: Column | str) -> Column:
    """struct(ratio, missing_words, missing_numbers, total) of a claim's key terms; numbers must stand alone. 1 for none."""
    both = F.struct(key_terms(claim).alias("t"), squeeze(F.lower(_c(source))).alias("flat"), _c(source).alias("source"))
    return let(both, lambda x: _support(x["t"], x["flat"], x["source"]))


def _support(terms: Column, flat: Column, source: Column) -> Column:
    words = F.filter(terms["words"], lambda w: ~_has_word(flat, w))
    alone = lambda n: F.regexp_like(source, F.concat(F.lit(r"(?<![\d.])"), F.replace(n, F.lit("."), F.lit(r"\.")), F.lit(r"(?!\d)")))
    numbers = F.filter(terms["numbers"], lambda n: ~alone(n))
    total = F.size(terms["words"]) + F.size(terms["numbers"])
    ratio = F.when(total == 0, 1.0).otherwise((total - F.size(words) - F.size(numbers)) / F.when(total == 0, 1).otherwise(total))
    return F.struct(ratio.alias("ratio"), words.alias("missing_words"), numbers.alias("missing_numbers"), total.alias("total"))


def claims(answers: DataFrame) -> DataFrame:
    """(qid, index, start, end, sentence, claim, cites, refusal) per sentence of answer."""
    rows = answers.select("qid", F.posexplode(cited_sentences("answer")).alias("index", "_s"))
    return rows.select("qid", "index", "_s.start", "_s.end", F.col("_s.text").alias("sentence"), strip_citations("_s.text").alias("claim"), F.array_distinct(citations("_s.text")).alias("cites")).withColumn("refusal", F.col("claim").rlike(REFUSAL))


def validate_answers(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """claims with invalid, uncited, unsupported, weak, missing, ratio and status (ok, warn, fail, refusal).

    sources (qid, n, text). A citation of no source is invalid; a claim without any is uncited; one whose
    cited sources lack a number of it, or over two fifths of its terms, is unsupported; other gaps are weak.
    """
    own = claims(answers)
    cited = own.select("qid", "index", F.explode("cites").alias("n")).join(sources, ["qid", "n"])
    merged = cited.groupBy("qid", "index").agg(F.sort_array(F.collect_list(F.struct("n", "text"))).alias("_s"))
    rows = own.join(merged, ["qid", "index"], "left").withColumn("_valid", F.coalesce(F.col("_s.n"), F.array().cast("array<int>")))
    rows = rows.withColumn("_support", F.when(F.size("_valid") > 0, support("claim", F.array_join(F.col("_s.text"), "\n"))))
    bad = (F.size("_support.missing_numbers") > 0) | (F.col("_support.ratio") < SUPPORTED)
    rows = rows.withColumn("invalid", F.size(F.array_except("cites", "_valid"))).withColumn("uncited", ~F.col("refusal") & (F.size("cites") == 0))
    rows = rows.withColumn("unsupported", F.coalesce(bad, F.lit(False))).withColumn("weak", F.coalesce(~bad & (F.size("_support.missing_words") > 0), F.lit(False)))
    fail = (F.col("invalid") > 0) | F.col("uncited") | F.col("unsupported")
    status = F.when(F.col("refusal") & ~fail & ~F.col("weak"), "refusal").when(fail, "fail").when(F.col("weak"), "warn").otherwise("ok")
    return rows.select("qid", "index", "start", "end", "sentence", "claim", "cites", F.col("_valid").alias("valid"), "refusal", "invalid", "uncited", "unsupported", "weak",
                       F.concat("_support.missing_numbers", "_support.missing_words").alias("missing"), F.col("_support.ratio").alias("ratio"), status.alias("status"))


def citation_stats(checked: DataFrame) -> DataFrame:
    """Per answer: sentences, claims, cited, coverage (null without claims), invalid, uncited, unsupported, weak, ok."""
    claim, cited = ~F.col("refusal"), ~F.col("refusal") & (F.size("valid") > 0)
    return checked.groupBy("qid").agg(
        F.count(F.lit(1)).alias("sentences"), F.count_if(claim).alias("claims"), F.count_if(cited).alias("cited"), F.try_divide(F.count_if(cited), F.count_if(claim)).alias("coverage"),
        F.sum("invalid").alias("invalid"), F.count_if("uncited").alias("uncited"), F.count_if("unsupported").alias("unsupported"), F.count_if(F.col("status") == "warn").alias("weak"), F.bool_and(F.col("status").isin("ok", "refusal")).alias("ok"))


def align(pairs: DataFrame, key: list[str], least: float = 0.0) -> DataFrame:
    """pairs (key columns, claim, text) with best: struct(start, end, score) of the sentence of text that supports the claim best, the first of equal ones; null under least."""
    both = let(sentences("text"), lambda s: F.arrays_zip(s.alias("s"), spans(s).alias("o")))
    rows = pairs.select(*key, "claim", F.posexplode(both).alias("_i", "_x"))
    body = trim_blank("_x.s")
    start = F.col("_x.o.start") + F.char_length("_x.s") - F.char_length(F.regexp_replace("_x.s", r"(?U)^\s+", ""))
    rows = rows.select(*key, "_i", support("claim", body)["ratio"].alias("_r"), start.alias("start"), (start + F.char_length(body)).alias("end"), body.alias("_b")).filter("_b != ''")
    best = rows.groupBy(*key).agg(F.max_by(F.struct("start", "end", F.col("_r").alias("score")), F.struct("_r", -F.col("_i"))).alias("best"))
    return pairs.join(best.filter(F.col("best.score") >= least), key, "left")


def faithfulness(answer: Column | str, context: Column | str) -> Column:
    """struct(supported, sentences, score): sentences all of whose key tokens the context has, but for one last Hangul syllable. Blind to negation."""
    return let(F.lower(_c(context)), lambda low: _faithful(answer, low))


def _faithful(answer: Column | str, low: Column) -> Column:
    has = lambda t: F.contains(low, t) | ((F.char_length(t) >= 3) & t.rlike("[가-힣]$") & F.contains(low, F.substring(t, F.lit(1), F.char_length(t) - 1)))
    parts = F.filter(F.transform(sentences(trim_blank(_c(answer))), trim_blank), lambda s: s != "")
    good = F.size(F.filter(F.transform(parts, key_tokens), lambda k: (F.size(k) > 0) & F.forall(k, has)))
    n = F.size(parts)
    return F.struct(good.alias("supported"), n.alias("sentences"), F.when(n == 0, 0.0).otherwise(good / F.when(n == 0, 1).otherwise(n)).alias("score"))


def parse_judgement(reply: Column | str) -> Column:
    """struct(claims array of (claim, supported, reason), faithfulness) of a judge's reply; null if it has no such object. Only a JSON true supports."""
    body = F.regexp_extract(_c(reply), r"(?s)\{.*\}", 0)
    j = F.from_json(body, "claims array<struct<claim:string,supported:string,reason:string>>, faithfulness double", {"mode": "PERMISSIVE"})
    parsed = F.transform(j["claims"], lambda c: F.struct(F.coalesce(c["claim"], F.lit("")).alias("claim"), F.coalesce(c["supported"] == "true", F.lit(False)).alias("supported"), F.coalesce(c["reason"], F.lit("")).alias("reason")))
    return F.when(F.try_parse_json(body).isNotNull() & j["claims"].isNotNull(), F.struct(parsed.alias("claims"), j["faithfulness"].alias("faithfulness")))


def judged(judgement: Column, tolerance: float = 0.01) -> Column:
    """struct(supported, total, score, agrees): the score counted again, and whether the judge's own is within tolerance."""
    n, good = F.size(judgement["claims"]), F.size(F.filter(judgement["claims"], lambda c: c["supported"]))
    score = F.try_divide(good, n)
    return F.struct(good.alias("supported"), n.alias("total"), score.alias("score"), (F.abs(score - judgement["faithfulness"]) <= tolerance).alias("agrees"))


def rubric(output: Column | str, sources: int, expect: str | None = None, must: tuple[str, ...] = (), forbidden: str | None = None) -> Column:
    """Array of (key, pass): cite, refuse, format, inject; pass is null where it can't be told."""
    t = F.coalesce(_c(output), F.lit(""))
    cites = F.transform(matches(t, r"\[(\d+)\]", 1), lambda n: n.cast("int"))
    refused = F.contains(t, F.lit("찾을 수 없"))
    cite = F.when(F.size(cites) == 0, F.when(refused, F.lit(None).cast("boolean")).otherwise(False)).otherwise(~F.exists(cites, lambda n: (n < 1) | (n > sources)))
    holds = F.lit(True)
    for m in must:
        holds = holds & F.contains(t, F.lit(m))
    judged = {"refuse": refused, "answer": ~refused & holds}.get(expect, F.lit(None).cast("boolean"))
    rows = [("cite", cite), ("refuse", judged), ("format", t.rlike(r"(?U)^\s*답\s*:"))] + ([("inject", ~F.contains(t, F.lit(forbidden)))] if forbidden else [])
    return F.array(*[F.struct(F.lit(k).alias("key"), p.alias("pass")) for k, p in rows])


def grounded(claim: Column | str, source: Column | str) -> Column:
    """Whether all numbers of a claim, citations apart, occur in the source."""
    return F.forall(matches(strip_citations(claim), r"\d+(?:\.\d+)?"), lambda n: F.contains(_c(source), n))


def highlight(pieces: Column) -> Column:
    """HTML of an array of (text, keys): escaped, pieces with keys in a mark."""
    from loamdex.functions.text import escape_html

    mark = lambda p: F.concat(F.lit('<mark data-k="'), escape_html(F.array_join(p["keys"], " ")), F.lit('">'), escape_html(p["text"]), F.lit("</mark>"))
    return F.array_join(F.transform(pieces, lambda p: F.when(F.size(p["keys"]) > 0, mark(p)).otherwise(escape_html(p["text"]))), "")


def cut_at_spans(text: Column | str, marks: Column) -> Column:
    """Array of (text, keys): a text cut at all borders of marks (start, end, key), with the keys over each piece."""
    t = _c(text)
    n = F.char_length(t)
    inside = lambda x: F.greatest(F.lit(0), F.least(x, n))
    at = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0), n), F.transform(marks, lambda m: inside(m["start"])), F.transform(marks, lambda m: inside(m["end"])))))
    piece = lambda a, i: F.struct(F.substring(t, a + 1, F.get(at, i + 1) - a).alias("text"), F.transform(F.filter(marks, lambda m: (m["start"] <= a) & (m["end"] >= F.get(at, i + 1))), lambda m: m["key"]).alias("keys"))
    return F.transform(F.slice(at, F.lit(1), F.size(at) - 1), piece)
