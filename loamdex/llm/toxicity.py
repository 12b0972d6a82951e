"""Toxicity by a weighted lexicon, matched with Aho-Corasick over folded text.

The lexicon holds beginnings of words. It is learned from labelled documents: log-odds weights
of beginnings that many toxic and hardly any clean documents have, after copies are dropped.
Texts are matched as they are and with homoglyphs and digit substitutions folded; hits inside
of exception phrases don't count. The summed weight, and the same per length, go through a
logistic function that is fitted on the same labelled documents.
"""

from __future__ import annotations

import json
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamdex.llm.textops import checkpointed, whole
from loamdex.llm.workers import map_texts, releasing, small_batches

#: Labelled rows that the lexicon and the logistic function are fitted on, at most.
SAMPLE = 10_000
#: Beginnings have this many characters; of longer words, the whole word is one more.
SHORTEST, LONGEST = 3, 24
#: A beginning is taken if this share of toxic documents has it, and MIN_POSITIVE of them, at this log-odds.
MIN_SHARE, MIN_POSITIVE, MIN_WEIGHT = 0.01, 4, 3.0
#: A longer beginning stands for a shorter one that has hardly more documents.
SAME = 0.95
#: Harmless phrases around words that may be in a lexicon.
EXCEPTIONS = ("clown fish", "clown fishes", "idiot proof", "trash bag", "trash bags", "trash bin", "trash bins", "trash can", "trash cans")
#: Look-alikes of Latin letters, and digits and signs written for letters.
HOMOGLYPHS = {"а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x"}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
_FOLD = str.maketrans(HOMOGLYPHS | DIGITS)
_FOLDABLE = re.compile("[" + "".join(HOMOGLYPHS | DIGITS) + "]")
_WORD = re.compile(r"\w+")


def forms(text: str) -> list[list[str]]:
    """Word lists of the text as it is and, where that differs, folded."""
    low = (text if text.isascii() else unicodedata.normalize("NFKC", text)).lower()
    return [_WORD.findall(low)] + ([_WORD.findall(low.translate(_FOLD))] if _FOLDABLE.search(low) else [])


@cache
def automaton(lexicon: str) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for beginning, weight in json.loads(lexicon).items():
        a.add_word(" " + beginning, (weight, len(beginning)))
    for phrase in EXCEPTIONS:
        a.add_word(f" {phrase} ", (None, len(phrase)))
    a.make_automaton()
    return a


def weight_of(words: list[str], matcher: ahocorasick.Automaton) -> float:
    total, waiting = 0.0, []
    for end, (weight, n) in matcher.iter(f" {' '.join(words)} "):
        if weight is None:  # an exception ends after the hits that it covers
            begin = end - 1 - n
            total -= sum(w for at, w in waiting if at > begin)
            waiting = []
        else:
            total += weight
            waiting = [*waiting[-3:], (end - n + 1, weight)]
    return max(total, 0.0)


def features(text: str, matcher: ahocorasick.Automaton) -> tuple[float, float]:
    """Log of the summed weight, and of the weight per 100 words."""
    both = forms(text)
    total = max(weight_of(w, matcher) for w in both)
    return math.log1p(total), math.log1p(100 * total / (len(both[0]) + 20))


def beginnings(text: str) -> set[str]:
    every = {w for words in forms(text) for w in words}
    return {w[:k] for w in every for k in (*range(SHORTEST, min(len(w), LONGEST) + 1), len(w)) if k >= SHORTEST}


def choose(counts: dict[str, tuple[int, int]], positive: int, negative: int) -> dict[str, float]:
    """Weights of the beginnings that are taken. counts: toxic and clean documents of each."""
    least = max(MIN_POSITIVE, MIN_SHARE * positive)
    weight = {b: math.log((p + 0.5) / (positive + 1)) - math.log((n + 0.5) / (negative + 1)) for b, (p, n) in counts.items() if p >= least}
    good = {b for b, w in weight.items() if w >= MIN_WEIGHT}
    longer = Counter()
    for b in good:
        shorter = b[: min(len(b) - 1, LONGEST)]
        longer[shorter] = max(longer[shorter], counts[b][0])
    taken: dict[str, float] = {}
    for b in sorted(good, key=lambda b: (len(b), b)):
        if longer[b] < SAME * counts[b][0] and not any(b[:k] in taken for k in range(SHORTEST, len(b))):
            taken[b] = round(weight[b], 6)
    return taken


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.05) -> np.ndarray:
    """Newton's method on (n, k) features; a small ridge keeps separable data finite."""
    x = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -35, 35)))
        ridge = np.diag([0.0] + [penalty] * (x.shape[1] - 1))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + ridge, x.T @ (y - p) - ridge @ beta)
        step *= min(1.0, 4 / (np.abs(step).max() + 1e-12))
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def held_out(doc_id: str = "doc_id"):
    """Whether crc32 of the id as text is divisible by 5; such labels are never learned from. A null id is the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[dict[str, float], list[float]]:
    """(lexicon, coefficients) from at most sample labelled rows that aren't held out; the rows of smallest id hash."""
    own = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [forms(t.as_py())[0] for t in b.column(0)]
            sign = [min((xxhash.xxh64_intdigest(" ".join(w[i : i + 3])) >> 1 for i in range(max(1, len(w) - 2))), default=0) for w in words]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sign, pa.int64())], ["text", "toxic", "sign"])

    rows = docs.select("doc_id", whole().alias("text")).join(F.broadcast(own), "doc_id").select("text", "toxic")
    rows = map_texts(rows, signed, "text string, toxic int, sign long")
    # copies share their smallest shingle and would make any word of theirs look toxic
    order = Window.partitionBy("sign", "toxic").orderBy(F.xxhash64("text"))
    rows = checkpointed(rows.withColumn("_n", F.row_number().over(order)).filter("_n = 1").select("text", "toxic"))
    size = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    positive, negative = size.get(1, 0), size.get(0, 0)
    if not positive or not negative:
        return {}, [-35.0 if not positive else 35.0, 0.0, 0.0]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            names = [*seen]
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([seen[n][k] for n in names], pa.int64()) for k in (1, 0))], ["b", "p", "n"])

        seen: dict[str, list[int]] = {}
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1)):
                toxic = toxic.as_py()
                for b in beginnings(text.as_py()):
                    seen.setdefault(b, [0, 0])[toxic] += 1
                if len(seen) > 400_000:
                    yield out()
                    seen.clear()
        yield out()

    kept = map_texts(rows, counted, "b string, p long, n long").groupBy("b").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    kept = kept.filter((F.col("p") >= max(MIN_POSITIVE, MIN_SHARE * positive)) & (F.col("p") * negative > F.col("n") * positive * 4))
    lexicon = choose({r["b"]: (r["p"], r["n"]) for r in kept.collect()}, positive, negative)
    x = scored(rows, lexicon, ["toxic"]).collect()  # sample rows at most
    beta = fit_logistic(np.array([[r["x1"], r["x2"]] for r in x]), np.array([r["toxic"] for r in x], float))
    return lexicon, beta.tolist()


def scored(docs: DataFrame, lexicon: dict[str, float], keep: list[str]) -> DataFrame:
    """Columns keep, and the features x1 and x2 of text."""
    compiled = json.dumps(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = automaton(compiled)
        for b in batches:
            x = [features(t.as_py(), matcher) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *(pa.array([v[k] for v in x], pa.float64()) for k in (0, 1))], [*keep, "x1", "x2"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return map_texts(docs.select(whole().alias("text"), *keep), run, f"{kinds}, x1 double, x2 double")


def logit(x1: Column, x2: Column, beta: list[float]) -> Column:
    return F.lit(beta[0]) + F.lit(beta[1]) * x1 + F.lit(beta[2]) * x2


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Return doc_id, held_out, score (0 to 1), predicted (1 from score 0.5 on).

    A null text is the empty one, which has no hits and the lowest score. Labels without an id
    or a value are left out, repeated ones count as toxic if any is; without both classes to
    learn from, all get the score of the class there is (0 without any). Repeated rows get equal
    scores; an empty table gives no rows. Neither labels nor other columns go into a score.
    """
    lexicon, beta = learn(docs, labels, sample)
    z = logit(F.col("x1"), F.col("x2"), beta)
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.least(F.greatest(z, F.lit(-35.0)), F.lit(35.0))))
    out = scored(docs.select("doc_id", "text"), lexicon, ["doc_id"]).withColumn("score", score)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows that score under 0.5, all columns kept."""
    lexicon, beta = learn(docs, labels, sample)
    compiled = json.dumps(lexicon)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        matcher = automaton(compiled)
        for texts in batches:
            yield pd.DataFrame([features(t or "", matcher) for t in texts], columns=["x1", "x2"])

    @F.pandas_udf("struct<x1:double,x2:double>")
    def measured(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from releasing(run)(batches)

    small_batches(docs)
    x = measured(docs["text"])
    return docs.filter(logit(x["x1"], x["x2"], beta) < 0)
