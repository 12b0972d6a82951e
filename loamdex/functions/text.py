"""Text functions as Column builders: tokens, sentences, facts, citations, overlap measures.

All offsets and lengths are code points. White space is Unicode white space, as \\s with (?U).
Functions marked Arrow run as pandas UDFs since their logic is sequential; all others stay in the JVM.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import reduce, wraps

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and word lists that results depend on.
TOKEN = r"[\p{L}\p{N}]+"
HANGUL = "[가-힣]"
SENTENCE_END = r"(?U)[.!?。]+[\"')\]]?(?=\s|\z)\s*|\n+"
CITATION = r"\[(\d+(?:\s*,\s*\d+)*)\]"
CLAIM_NUMBER = r"\d+(?:\.\d+)?\s*(?:%|퍼센트|시간|교시|학점|호|명|주|회)?"
TERM = r"(?i)[a-z][a-z0-9]*|\d+(?:\.\d+)?|[가-힣]+"
# Particles of the faithfulness words, of claim terms, and of conversation words, each longest match first.
ENDINGS_FAITHFUL = ["하려면", "으로는", "에서는", "이라면", "에게", "에서", "으로", "하면", "려면", "까지", "부터", "이며", "이고", "이다", "은", "는", "이", "가", "을", "를", "에", "의", "로", "와", "과", "도", "만", "다", "며", "고"]
STOP_FAITHFUL = ["그리고", "또한", "하지만", "그러나", "따라서", "것이", "것을", "경우", "한다", "된다", "있다", "없다", "않다", "하는", "되는", "있는", "없는", "않는", "않을", "있을", "없을"]
ENDINGS_CLAIM = ["이라는", "으로", "에서", "에게", "까지", "부터", "이다", "한다", "된다", "하는", "하고", "라는", "이며", "이고", "에는", "에도", "와", "과", "는", "은", "이", "가", "을", "를", "에", "의", "로", "도", "만", "다"]
STOP_CLAIM = ["그래서", "따라서", "하지만", "그러나", "또한", "그리고", "이는", "경우", "때문", "있다", "없다", "한다", "된다", "이다", "같다", "있는", "없는", "하는", "되는", "대한", "위해", "통해", "모두", "만큼", "나머지", "다만", "먼저", "않는", "않다", "않고", "않으며", "있으면", "하면", "되면", "두면", "the", "and", "of", "to", "is", "in"]
ENDINGS_TALK = ["에서는", "에서도", "까지는", "으로는", "에서", "에는", "에도", "까지", "부터", "으로", "이야", "이랑", "한테", "에게", "은", "는", "이", "가", "을", "를", "에", "의", "도", "만", "로", "와", "과", "야"]
QUIZ_STEM = "빈칸에 알맞은 말은?"


def arrow(returns: str):
    """A pandas function as a function of columns; the UDF is made when called, since its type needs a session."""

    def wrap(f: Callable) -> Callable[..., Column]:
        @wraps(f)
        def column(*columns: Column | str) -> Column:
            return F.pandas_udf(f, returns)(*columns)

        return column

    return wrap


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once a row; inside of lambdas, outer expressions would be evaluated for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def matches(text: Column | str, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(_c(text), F.lit(pattern), F.lit(group))


def trim_blank(text: Column | str) -> Column:
    """Trim of Unicode white space; trim() itself only drops U+0020."""
    return F.regexp_replace(_c(text), r"(?U)^\s+|\s+\z", "")


def squeeze(text: Column | str, by: str = "") -> Column:
    return F.regexp_replace(_c(text), r"(?U)\s+", by)


def bigrams(word: Column) -> Column:
    """Adjacent character pairs of a word; none for fewer than two characters."""
    n = F.char_length(word)
    return F.when(n > 1, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(word, i, F.lit(2)))).otherwise(strings([]))


def tokenize(text: Column | str, hangul_bigrams: bool = True) -> Column:
    """Lower-cased runs of letters and digits; Hangul words of over two characters are followed by their bigrams."""
    words = matches(F.lower(_c(text)), TOKEN)
    if not hangul_bigrams:
        return words
    more = F.flatten(F.transform(words, lambda w: F.when(w.rlike(HANGUL) & (F.char_length(w) > 2), F.concat(F.array(w), bigrams(w))).otherwise(F.array(w))))
    return F.when(_c(text).rlike(HANGUL), more).otherwise(words)


def estimate_tokens(text: Column | str) -> Column:
    """Ceiling of 0.8 per Hangul character and a quarter of each other."""
    hangul = F.regexp_count(_c(text), F.lit("[가-힣ㄱ-ㆎ]"))
    return F.ceil(hangul * 0.8 + (F.char_length(_c(text)) - hangul) / 4)


def count_visible(text: Column | str) -> Column:
    """Characters but white space: the coarse token estimate of conversations."""
    return F.char_length(squeeze(text))


def window_share(tokens: Column, window: int) -> Column:
    return tokens / F.lit(float(window))


# ---- sentences


def sentences(text: Column | str) -> Column:
    """The contiguous pieces of a text that end at sentence punctuation before white space, or at line breaks; a decimal point ends none."""
    t = _c(text)
    both = F.struct(F.split(t, SENTENCE_END, -1).alias("p"), matches(t, SENTENCE_END).alias("e"))
    whole = let(both, lambda x: F.transform(x["p"], lambda p, i: F.concat(p, F.coalesce(F.get(x["e"], i), F.lit("")))))
    return F.filter(whole, lambda s: F.char_length(s) > 0)


def spans(pieces: Column) -> Column:
    """(start, end) of contiguous pieces of a text."""
    none = F.array().cast("array<struct<start:int,end:int>>")
    step = lambda a, p: F.struct((a["to"] + F.char_length(p)).alias("to"), F.concat(a["out"], F.array(F.struct(a["to"].alias("start"), (a["to"] + F.char_length(p)).alias("end")))).alias("out"))
    return F.aggregate(pieces, F.struct(F.lit(0).alias("to"), none.alias("out")), step, lambda a: a["out"])


def _cited_sentences(text: str) -> list[dict]:
    """Sentences with offsets; citations after a full stop, or alone on a line, belong to the sentence before."""
    out: list[list[int]] = []
    end_of = re.compile(r"[.!?。]+(?:\s*\[\d+(?:\s*,\s*\d+)*\])*(?=\s|$)|\n+")
    cuts = [m.end() for m in end_of.finditer(text)]
    for s, e in zip([0, *cuts], [*cuts, len(text)]):
        piece = text[s:e]
        if not piece.strip():
            continue
        s, e = s + len(piece) - len(piece.lstrip()), e - len(piece) + len(piece.rstrip())
        if out and not re.sub(r"\s+", "", re.sub(CITATION, "", text[s:e])):
            out[-1][1] = e
        else:
            out.append([s, e])
    return [{"start": s, "end": e, "text": text[s:e]} for s, e in out]


@arrow("array<struct<start:int,end:int,text:string>>")
def cited_sentences(text: pd.Series) -> pd.Series:
    """Arrow. Sentences of an answer, each with its trailing citations."""
    return text.map(_cited_sentences, na_action="ignore")


def long_sentences(text: Column | str, least: int = 8) -> Column:
    """Trimmed sentences of least or more characters with offsets."""
    return F.filter(trimmed(text), lambda x: x["end"] - x["start"] >= least)


def located(text: Column | str, pattern: str) -> Column:
    """Array of (start, end, match) of a pattern's matches. Pieces between them and matches alternate, so lengths give the places."""
    t = _c(text)
    both = F.struct(F.split(t, pattern, -1).alias("p"), matches(t, pattern).alias("m"))

    def places(x: Column) -> Column:
        cut = F.flatten(F.transform(x["p"], lambda p, i: F.array(p, F.coalesce(F.get(x["m"], i), F.lit("")))))
        return let(spans(cut), lambda o: F.transform(x["m"], lambda m, i: F.struct(F.get(o, 2 * i + 1).alias("o"), m.alias("m"))))

    found = F.transform(let(both, places), lambda f: F.struct(f["o"]["start"].alias("start"), f["o"]["end"].alias("end"), f["m"].alias("match")))
    return F.when(F.regexp_like(t, F.lit(pattern)), found).otherwise(F.array().cast("array<struct<start:int,end:int,match:string>>"))


def replaced(text: Column | str, pattern: str, by: Callable[[Column], Column]) -> Column:
    """struct(text, count): each match of a pattern as by() makes it, and how many that changed."""
    t = _c(text)
    both = F.struct(F.split(t, pattern, -1).alias("p"), matches(t, pattern).alias("m"))
    made = let(both, lambda x: F.struct(x["p"].alias("p"), x["m"].alias("m"), F.transform(x["m"], by).alias("n")))
    return let(made, lambda x: F.struct(
        F.array_join(F.transform(x["p"], lambda p, i: F.concat(p, F.coalesce(F.get(x["n"], i), F.lit("")))), "").alias("text"),
        F.size(F.filter(F.zip_with(x["m"], x["n"], lambda a, b: a != b), lambda c: c)).alias("count")))


def trimmed(text: Column | str) -> Column:
    """Array of (start, end, text): sentences without the white space around them, blank ones left out."""
    left = lambda s: F.char_length(s) - F.char_length(F.regexp_replace(s, r"(?U)^\s+", ""))
    pieces = let(sentences(text), lambda s: F.arrays_zip(s.alias("s"), spans(s).alias("o")))
    body = F.transform(pieces, lambda x: F.struct((x["o"]["start"] + left(x["s"])).alias("start"), trim_blank(x["s"]).alias("text")))
    return F.transform(F.filter(body, lambda b: b["text"] != ""), lambda b: F.struct(b["start"].alias("start"), (b["start"] + F.char_length(b["text"])).alias("end"), b["text"].alias("text")))


# ---- facts


@arrow("string")
def nfkc(text: pd.Series) -> pd.Series:
    """Arrow. Unicode compatibility composition."""
    return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def normal_fact(text: Column | str, compose: bool = True) -> Column:
    """Lower-cased, the word for percent as its sign, without white space; compose adds NFKC (Arrow)."""
    t = nfkc(_c(text)) if compose else _c(text)
    return squeeze(F.replace(F.lower(t), F.lit("퍼센트"), F.lit("%")))


def golden_facts(answer: Column | str, compose: bool = True) -> Column:
    """Numbers with their units; without any, the whole answer's stem."""
    a = normal_fact(answer, compose)
    numbers = F.transform(matches(_c(answer), CLAIM_NUMBER), lambda n: squeeze(F.replace(F.lower(n), F.lit("퍼센트"), F.lit("%"))))
    stem = F.regexp_replace(F.regexp_replace(a, r"[.。!]+\z", ""), r"다\z", "")
    return F.when(F.size(numbers) > 0, F.array_distinct(numbers)).otherwise(F.array(stem))


def quoted(text: Column) -> Column:
    """Text as a literal inside of a pattern."""
    return F.regexp_replace(text, r"([.*+?^$(){}|\[\]\\])", r"\\$1")


def has_fact(text: Column, fact: Column) -> Column:
    """Whether the fact occurs without a digit before it, nor one after if it ends in one."""
    pattern = F.concat(F.lit(r"(?<!\d)"), quoted(fact), F.when(fact.rlike(r"\d\z"), r"(?!\d)").otherwise(""))
    return F.regexp_like(text, pattern)


def contains_facts(text: Column | str, answer: Column | str, compose: bool = True) -> Column:
    both = F.struct(normal_fact(text, compose).alias("t"), golden_facts(answer, compose).alias("f"))
    return let(both, lambda x: F.forall(x["f"], lambda f: has_fact(x["t"], f)))


# ---- templates


def fill_template(template: str, values: dict[str, Column]) -> Column:
    """{name} by its value; unknown names stay; values aren't expanded again since the template is cut up first."""
    parts = re.split(r"(\{\w+\})", template)
    return F.concat(*[values[p[1:-1]].cast("string") if p.startswith("{") and p[1:-1] in values else F.lit(p) for p in parts if p] or [F.lit("")])


def placeholders(texts: Column, known: tuple[str, ...] = ("question", "context")) -> Column:
    """(missing, unknown) names of an array of templates."""
    found = F.array_distinct(F.flatten(F.transform(texts, lambda t: matches(t, r"\{(\w+)\}", 1))))
    return F.struct(F.array_except(strings([*known]), found).alias("missing"), F.array_except(found, strings([*known])).alias("unknown"))


def numbered_context(titles: Column, texts: Column) -> Column:
    """'[1] (title) text' blocks of two parallel arrays."""
    return F.array_join(F.transform(texts, lambda t, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] ("), F.get(titles, i), F.lit(") "), t)), "\n\n")


# ---- overlap


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; two empty ones are equal."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def char_bigram_jaccard(a: Column | str, b: Column | str) -> Column:
    strip = lambda x: F.regexp_replace(_c(x), r"(?U)[\s.,!?·\"'()]", "")
    return jaccard(bigrams(strip(a)), bigrams(strip(b)))


def question_bigrams(question: Column | str) -> Column:
    """Bigrams of a quiz question without the stem, white space, punctuation and symbols, lower-cased."""
    plain = F.lower(F.regexp_replace(F.regexp_replace(_c(question), re.escape(QUIZ_STEM).replace("\\ ", " "), ""), r"(?U)[\s\p{P}\p{S}_]+", ""))
    return let(plain, bigrams)  # worked out once, not for each pair


def question_jaccard(a: Column | str, b: Column | str) -> Column:
    """Bigram overlap of quiz questions."""
    return jaccard(question_bigrams(a), question_bigrams(b))


def coverage(query_tokens: Column, text_tokens: Column) -> Column:
    """Share of the query's distinct tokens that the text has; 0 for no tokens."""
    q = F.array_distinct(query_tokens)
    return F.when(F.size(q) == 0, 0.0).otherwise(F.size(F.array_intersect(q, text_tokens)) / F.size(q))


# ---- words


def strip_ending(word: Column, endings: list[str], rest: int) -> Column:
    """Without the first listed ending that leaves rest characters or more."""
    done = [F.when(word.endswith(e) & (F.char_length(word) - len(e) >= rest), F.substring(word, F.lit(1), F.char_length(word) - len(e))) for e in endings]
    return F.coalesce(*done, word)


def key_tokens(sentence: Column | str) -> Column:
    """Distinct content words of two or more characters, endings stripped."""
    words = matches(F.lower(_c(sentence)), r"[\p{L}\p{N}%]+")
    stems = F.transform(words, lambda w: F.when(w.rlike("[가-힣]$"), strip_ending(w, ENDINGS_FAITHFUL, 2)).otherwise(w))
    return F.array_distinct(F.filter(stems, lambda w: (F.char_length(w) >= 2) & ~F.array_contains(strings(STOP_FAITHFUL), w)))


def key_terms(claim: Column | str) -> Column:
    """(words, numbers): distinct content words with endings stripped, and distinct numbers as written."""
    found, stop = matches(claim, TERM), strings(STOP_CLAIM)
    words = F.filter(F.transform(F.filter(found, lambda w: ~w.rlike(r"^\d")), lambda w: F.lower(w)), lambda w: ~F.array_contains(stop, w))
    stems = F.transform(words, lambda w: F.when(w.rlike("^[가-힣]"), strip_ending(w, ENDINGS_CLAIM, 1)).otherwise(w))
    kept = F.array_distinct(F.filter(stems, lambda w: (F.char_length(w) >= 2) & ~F.array_contains(stop, w)))
    return F.struct(kept.alias("words"), F.array_distinct(F.filter(found, lambda w: w.rlike(r"^\d"))).alias("numbers"))


# ---- citations


def citations(text: Column | str) -> Column:
    """Cited numbers in order; '[3, 4]' is two."""
    return F.transform(F.flatten(F.transform(matches(text, CITATION, 1), lambda g: F.split(g, ","))), lambda n: F.regexp_replace(n, r"\s", "").cast("int"))


def citation_places(text: Column | str) -> Column:
    """Array of (n, start, end): cited numbers in order, with the place of their brackets."""
    each = F.transform(located(text, CITATION), lambda c: F.transform(citations(c["match"]), lambda n: F.struct(n.alias("n"), c["start"].alias("start"), c["end"].alias("end"))))
    return F.flatten(each)


def strip_citations(text: Column | str) -> Column:
    """Without citations, and without the blanks that they leave before punctuation."""
    return trim_blank(F.regexp_replace(F.regexp_replace(F.regexp_replace(_c(text), CITATION, ""), r"(?U)\s+([.!?。])", "$1"), r"(?U)\s{2,}", " "))


def strip_citations_spoken(text: Column | str) -> Column:
    """Without citations and the blanks before them."""
    return trim_blank(F.regexp_replace(F.regexp_replace(_c(text), r"(?U)\s*" + CITATION, ""), r"(?U)\s{2,}", " "))


def _find_quote(text: str, quote: str, start: int | None, end: int | None) -> dict | None:
    parts = [re.escape(c) for c in quote if not c.isspace()]
    if not parts:
        return None
    m = re.compile(r"\s*".join(parts)).search(text, start or 0, len(text) if end is None else end)
    return {"start": m.start(), "end": m.end()} if m else None


@arrow("struct<start:int,end:int>")
def find_quote(text: pd.Series, quote: pd.Series, start: pd.Series, end: pd.Series) -> pd.DataFrame:
    """Arrow. Where a quote stands in a text, however either is spaced; nulls if nowhere. start and end bound the search, null for none."""
    found = [None if t is None or q is None else _find_quote(t, q, None if pd.isna(s) else int(s), None if pd.isna(e) else int(e)) for t, q, s, e in zip(text, quote, start, end)]
    return pd.DataFrame({k: pd.array([f[k] if f else None for f in found], "Int32") for k in ("start", "end")})


# ---- terms


def term_pattern(term: Column) -> Column:
    """A term as a pattern: any blanks between its words, no digit glued to a digit at its ends, any case."""
    t = F.lower(trim_blank(squeeze(term, " ")))
    body = F.array_join(F.transform(F.split(t, " "), quoted), r"\\s+".replace("\\\\", "\\"))
    return F.concat(F.lit("(?iu)"), F.when(t.rlike(r"^\d"), r"(?<![0-9.])").otherwise(""), body, F.when(t.rlike(r"\d$"), r"(?![0-9])").otherwise(""))


def contains_term(text: Column | str, term: Column | str) -> Column:
    blank = trim_blank(_c(term)) == ""
    return F.when(blank, False).otherwise(F.regexp_like(_c(text), term_pattern(_c(term))))


def title_has(title: Column | str, needle: Column | str) -> Column:
    """Whether a title contains a typed text, however either is cased; an empty one is in all."""
    return F.contains(F.lower(_c(title)), F.lower(trim_blank(_c(needle))))


def cloze(sentence: Column | str, answer: Column | str, blank: str = "____") -> Column:
    return F.regexp_replace(_c(sentence), term_pattern(_c(answer)), F.lit(blank))


# ---- small ones


def document_of(chunk_id: Column | str) -> Column:
    return F.substring_index(_c(chunk_id), "#", 1)


def preview(value: Column | str, longest: int = 60) -> Column:
    """One line of at most longest characters, an ellipsis for the rest."""
    line = trim_blank(squeeze(_c(value).cast("string"), " "))
    return F.when(F.char_length(line) > longest, F.concat(F.left(line, F.lit(longest)), F.lit("…"))).otherwise(line)


def code_lines(code: Column | str, comment: str = "#") -> Column:
    """Lines that are neither blank nor only a comment."""
    return F.size(F.filter(F.split(_c(code), "\n"), lambda s: (trim_blank(s) != "") & ~trim_blank(s).startswith(comment)))


def escape_html(text: Column | str) -> Column:
    swaps = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")]
    return reduce(lambda t, s: F.replace(t, F.lit(s[0]), F.lit(s[1])), swaps, _c(text))


def _mark(text: str, tokens: list[str]) -> list[dict]:
    """Maximal stretches of a text that tokens do or don't cover."""
    low, covered = text.lower(), bytearray(len(text))
    for token in {t for t in tokens if t}:
        for m in re.finditer(f"(?={re.escape(token)})", low):
            covered[m.start() : m.start() + len(token)] = b"\1" * len(token)
    cuts = [i for i in range(1, len(text)) if covered[i] != covered[i - 1]]
    return [{"text": text[a:b], "hit": bool(covered[a])} for a, b in zip([0, *cuts], [*cuts, len(text)]) if b > a]


@arrow("array<struct<text:string,hit:boolean>>")
def marked(text: pd.Series, tokens: pd.Series) -> pd.Series:
    """Arrow. A text in stretches, told apart by whether some token covers them."""
    return pd.Series([_mark(t, list(k)) if t is not None and k is not None else None for t, k in zip(text, tokens)])


def group_pieces(tokens: list[bytes], most: int = 8) -> list[tuple[str, int]]:
    """(text, tokens) of byte-level tokens, grouped until they decode; most tokens at once, then as they are, with replacement characters."""
    out, held = [], []
    for i, token in enumerate(tokens):
        held.append(token)
        try:
            out.append((b"".join(held).decode("utf-8"), len(held)))
            held = []
        except UnicodeDecodeError:
            if len(held) == most or i == len(tokens) - 1:
                out.append((b"".join(held).decode("utf-8", "replace"), len(held)))
                held = []
    return out
