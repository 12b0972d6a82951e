"""Personal data: fixed patterns, and identifiers found by bootstrapped contexts.

Fixed patterns give the seeds. The two words before an identifier-like token, of any length, are
its lexical pattern; patterns and instances form a bipartite graph over the whole corpus. A pattern's score
is the mean confidence of its instances (damped for few instances), an unseen instance's
confidence the chance that one of its good patterns is right. A few rounds of both settle the
scores; unseen instances of high-confidence patterns become spans of kind context.

Offsets come from the text between the matches: split() and regexp_extract_all() see the same
matches, so running sums of lengths give starts and ends in code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamdex.llm.textops import checkpointed, left_by_row, let, sha256_of, text_key, whole

KINDS = ("email", "ip", "card", "phone", "context")
#: The base patterns, with possessive loops and anchored starts that match the same
#: but never scan a run of characters twice.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: What a text with a valid match must hold; others are not searched.
HINTS = {EMAIL: "@[A-Za-z0-9-]+\\.", IP: r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", CARD: r"[0-9](?:[\x20-]?[0-9]){13}", PHONE: r"\+[0-9]"}
#: Tokens of LEAST_CHARS or more characters with four digits or an @: what an unseen identifier may look like.
TOKEN = r"(?<![A-Za-z0-9@._+-])(?=(?:[A-Za-z@._+-]*+[0-9]){4}|[A-Za-z0-9._+-]++@)[A-Za-z0-9@._+-]{6,}+"
TOKEN_HINT = r"[0-9@]"

LEAST_CHARS = 6
BLOCK, SPANS = 256, "array<struct<start:int,end:int,match:string,before:string>>"
#: Patterns and instances of more characters are told apart by digest.
KEY_CHARS = 200
ROUNDS, DAMPING, GOOD_PATTERN, GOOD_INSTANCE, LEAST_SEEDS = 3, 2.0, 0.8, 0.8, 3


def _spans(text: str, pattern: str, hint: str, before: int = 0) -> Column:
    """Array of (start, end, match, before), start and end in code points; before: the text since the before-th match before, none for 0."""
    t = F.col(text)
    none = F.array().cast(SPANS)
    pieces, matches = F.split(t, pattern, -1), F.regexp_extract_all(t, F.lit(pattern), F.lit(0))

    def located(x: Column) -> Column:
        start = lambda a, i: a["to"] + F.char_length(F.get(x["p"], i))
        passed = lambda i: F.concat(*[F.coalesce(F.get(x[k], i - back), F.lit("")) for back in range(before - 1, -1, -1) for k in "pm"][:-1]) if before else F.lit("")

        def one(a: Column, i: Column) -> Column:
            match = F.get(x["m"], i)
            return let(start(a, i), lambda s: F.struct(s.alias("start"), (s + F.char_length(match)).alias("end"), match.alias("match"), passed(i).alias("before")))

        def block(a: Column, j: Column) -> Column:
            """BLOCK matches at a time, as each step copies what it appends to."""
            last = F.least(j * BLOCK + BLOCK, F.size(x["m"])) - 1
            step = lambda b, i: let(one(b, i), lambda o: F.struct(o["end"].alias("to"), F.concat(b["found"], F.array(o)).alias("found")))
            own = F.aggregate(F.sequence(j * BLOCK, last), F.struct(a["to"].alias("to"), none.alias("found")), step)
            return let(own, lambda o: F.struct(o["to"].alias("to"), F.concat(a["found"], F.array(o["found"])).alias("found")))

        out = F.aggregate(F.sequence(F.lit(0), ((F.size(x["m"]) - 1) / BLOCK).cast("int")), F.struct(F.lit(0).alias("to"), F.array().cast(f"array<{SPANS}>").alias("found")), block)
        return F.when(F.size(x["m"]) > 0, F.flatten(out["found"])).otherwise(none)

    return F.when(t.rlike(hint), let(F.struct(pieces.alias("p"), matches.alias("m")), located)).otherwise(none)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.char_length(digits)

    def worth(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        doubled = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when((n - i) % 2 == 1, doubled).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + worth(i)) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda part: part.rlike("^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"))
    if kind == "card":
        return let(_digits(match), lambda d: F.when(F.char_length(d).between(14, 19), _luhn(d)).otherwise(False))
    if kind == "phone":
        return F.char_length(_digits(match)).between(10, 15)
    return F.lit(True)


def base_spans(text: str) -> Column:
    """Array of (start, kind, end) of the fixed patterns, by start and kind."""
    every = []
    for k, (kind, pattern) in enumerate(zip(KINDS, (EMAIL, IP, CARD, PHONE))):
        every.append(F.transform(_filtered(text, pattern, kind), _tagged(k)))
    return F.sort_array(F.concat(*every))


def _filtered(text: str, pattern: str, kind: str) -> Column:
    return F.filter(_spans(text, pattern, HINTS[pattern]), lambda s: _valid(kind, s["match"]))


def _tagged(k: int):
    return lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("kind"), s["end"].alias("end"))


def _key(text: Column) -> Column:
    return F.when(F.char_length(text) <= KEY_CHARS, text).otherwise(F.sha2(text, 256))


def occurrences(text: str, base: str) -> Column:
    """Array of identifier-like tokens: (start, end, instance, pattern, seed). seed: a base span meets it.

    The two words before a token stand between it and the third token before it, so no window cuts them short.
    """

    def one(s: Column) -> Column:
        word = F.regexp_replace(s["match"], r"[._+-]+$", "")
        end = s["start"] + F.char_length(word)
        context = F.substring_index(F.trim(F.regexp_replace(s["before"], r"\s+", " ")), " ", -2)
        seed = F.exists(F.col(base), lambda b: (b["start"] < end) & (s["start"] < b["end"]))
        return F.struct(s["start"].alias("start"), end.alias("end"), _key(word).alias("instance"), _key(F.regexp_replace(F.lower(context), "[0-9]+", "#")).alias("pattern"), seed.alias("seed"))

    return F.filter(F.transform(_spans(text, TOKEN, TOKEN_HINT, 3), one), lambda o: o["end"] - o["start"] >= LEAST_CHARS)


def confident(found: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, instance) pairs that are accepted. found: pattern, instance, seed of each occurrence. One round at least."""
    if rounds < 1:
        raise ValueError("bootstrapping takes one round or more")
    edges = checkpointed(found.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")))
    seeds = edges.groupBy("instance").agg(F.max("seed").alias("known"))
    confidence = seeds.select("instance", "known", F.col("known").cast("double").alias("c"))
    for _ in range(rounds):
        scored = edges.join(confidence, "instance").groupBy("pattern").agg((F.sum("c") / (F.count(F.lit(1)) + DAMPING)).alias("score"), F.count_if(F.col("known")).alias("seeds"))
        patterns = checkpointed(scored.filter((F.col("seeds") >= LEAST_SEEDS) & (F.col("score") > 0.5)))
        wrong = edges.join(patterns, "pattern").groupBy("instance").agg(F.exp(F.sum(F.log1p(-F.least("score", F.lit(0.999))))).alias("wrong"))
        confidence = checkpointed(seeds.join(wrong, "instance", "left").select("instance", "known", F.when(F.col("known"), 1.0).otherwise(1 - F.coalesce("wrong", F.lit(1.0))).alias("c")))
    good = patterns.filter(F.col("score") >= GOOD_PATTERN).select("pattern")
    unseen = confidence.filter(~F.col("known") & (F.col("c") >= GOOD_INSTANCE)).select("instance")
    return edges.join(good, "pattern").join(unseen, "instance").select("pattern", "instance")


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_spans(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Per document: doc_id, _key, base and spans (arrays of start, kind, end; spans also has context ones)."""
    rows = docs.select("doc_id", text_key().alias("_key"), whole().alias("_text")).withColumn("base", base_spans("_text"))
    rows = checkpointed(rows.select("doc_id", "_key", "base", occurrences("_text", "base").alias("_found")))  # spans only, no texts
    found = rows.select("doc_id", "_key", F.explode("_found").alias("o")).select("doc_id", "_key", "o.*")
    accepted = confident(found, rounds)
    new = found.filter(~F.col("seed")).join(accepted, ["pattern", "instance"])
    span = F.struct("start", F.lit(KINDS.index("context")).alias("kind"), "end")
    new = new.groupBy("doc_id", "_key").agg(F.collect_set(span).alias("_new"))
    key = rows.withColumn("_row", F.col("_key"))
    out = left_by_row(key, new)
    return out.select("doc_id", F.col("_row").alias("_key"), "base", F.sort_array(F.concat("base", F.coalesce("_new", F.array().cast("array<struct<start:int,kind:int,end:int>>")))).alias("spans"))


def scan_personal_data(docs: DataFrame) -> DataFrame:
    """Return doc_id, n_email, n_ip, n_card, n_phone, n_context, base_sha256, spans.

    spans has kind:start:end of base and context spans in code points. A null or empty text has
    none (the digest of no bytes); repeated rows get equal results; an empty table gives no rows.
    """
    found = personal_spans(docs)
    count = lambda k, kind: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k, kind) for k, kind in enumerate(KINDS)], sha256_of(_joined(F.col("base"))).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def mask_personal_data(docs: DataFrame) -> DataFrame:
    """docs with each span of text replaced by its kind in brackets; n_chars, if there, follows. Overlapping spans become the first one's kind."""
    masks = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    found = personal_spans(docs).filter(F.size("spans") > 0).dropDuplicates(["doc_id", "_key"]).select(F.col("doc_id").alias("_m_id"), F.col("_key").alias("_m_key"), F.col("spans").alias("_m_spans"))
    both = docs.join(found, docs["doc_id"].eqNullSafe(found["_m_id"]) & (text_key(docs["text"]) == found["_m_key"]), "left")
    text = docs["text"]

    def put(a: Column, s: Column) -> Column:
        fresh = s["start"] >= a["to"]
        out = F.when(fresh, F.concat(a["out"], F.substring(text, a["to"] + 1, s["start"] - a["to"]), F.get(masks, s["kind"]))).otherwise(a["out"])
        return F.struct(out.alias("out"), F.greatest(a["to"], s["end"]).alias("to"))

    done = F.aggregate(found["_m_spans"], F.struct(F.lit("").alias("out"), F.lit(0).alias("to")), put, lambda a: F.concat(a["out"], F.substring(text, a["to"] + 1, F.char_length(text))))
    masked = F.when(found["_m_spans"].isNull(), text).otherwise(done)
    out = both.select(*[masked.alias("text") if c == "text" else docs[c] for c in docs.columns])
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
