"""Document fingerprints as threshold-scaled sketches.

The sketch of a text keeps the hash of every five-word shingle below a fixed fraction of the
hash range, and the LEAST smallest hashes where fewer are below, so that short texts are kept
whole. What is kept doesn't depend on the other text, so sketches of very unequal texts still
estimate how much of the one the other contains, and the sketch of a union is the union of
sketches, cut the same way. A sketch is complete up to some hash (all there are, if it has
fewer than LEAST); two are compared up to the lower of these.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamdex.llm.textops import ascii_lower, checkpointed, let, sha256_of, text_key, whole, words

SHINGLE = 5
#: A hash of 63 bits is kept if its first FRACTION_BITS bits are 0: one in eight. fingerprints() keeps one in two.
FRACTION_BITS, DENSE_BITS = 3, 1
#: Hashes that a sketch has at least, as far as the text has them.
LEAST = 64
#: Consecutive ids that a task puts in order at once, and ids of such groups, as powers of 2.
GROUP_BITS, LEVEL_BITS = 5, 16
#: Groups of rows without an id are numbered around this, under those of all ids.
UNNAMED = -(2**60)


def shingle_hashes(w: str) -> Column:
    """Hashes (63 bits) of the shingles of a word array; fewer than five words are one shingle, none are none."""
    a = F.col(w)
    at = lambda i: F.get(a, i)
    many = F.transform(F.slice(a, 1, F.size(a) - (SHINGLE - 1)), lambda x, i: F.shiftrightunsigned(F.xxhash64(x, *[at(i + k) for k in range(1, SHINGLE)]), 1))
    hashes = F.when(F.size(a) >= SHINGLE, many).when(F.size(a) > 0, F.array(F.shiftrightunsigned(F.xxhash64(a), 1))).otherwise(F.array().cast("array<bigint>"))
    return hashes


def kept(hashes: str | Column, bits: int = FRACTION_BITS) -> Column:
    """The sketch: sorted distinct hashes below the fraction, or the LEAST smallest where these are more."""
    h = F.col(hashes) if isinstance(hashes, str) else hashes
    low = F.array_distinct(F.filter(h, lambda x: x < 1 << (63 - bits)))
    return let(low, lambda x: F.when(F.size(x) >= LEAST, F.sort_array(x)).otherwise(F.slice(F.sort_array(F.array_distinct(h)), 1, LEAST)))


def text_form(sketched: Column) -> Column:
    return F.array_join(F.transform(sketched, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def complete_to(sketched: Column, bits: int) -> Column:
    """All hashes of the text up to this one are in its sketch."""
    return F.when(F.size(sketched) < LEAST, 2**63 - 1).otherwise(F.greatest(F.lit((1 << (63 - bits)) - 1), F.element_at(sketched, -1)))


def _compared(a: str, b: str, bits: int) -> Column:
    """(both, a, b): how many hashes are in both sketches and in each, up to where both are complete."""
    end = F.least(complete_to(F.col(a), bits), complete_to(F.col(b), bits))
    upto = lambda c, e: F.when(F.element_at(c, -1) <= e, F.size(c)).otherwise(F.size(F.filter(c, lambda x: x <= e)))
    size = lambda c, e: F.when(F.size(c) == 0, 0).otherwise(upto(c, e))
    # what is in both is in the one up to where the other is complete, if it is up to the end
    shared = F.array_intersect(a, b)
    return let(end, lambda e: F.struct(size(shared, e).alias("both"), size(F.col(a), e).alias("a"), size(F.col(b), e).alias("b")))


def likeness(a: str, b: str, bits: int = FRACTION_BITS) -> Column:
    """Jaccard estimate; two blank sketches are alike."""
    union = lambda n: n["a"] + n["b"] - n["both"]
    return let(_compared(a, b, bits), lambda n: F.when(union(n) == 0, 1.0).otherwise(n["both"] / union(n)))


def containment(a: str, b: str, bits: int = FRACTION_BITS) -> Column:
    """Estimate of the share of a that b holds; a blank sketch is held by any."""
    return let(_compared(a, b, bits), lambda n: F.when(n["a"] == 0, F.when(F.size(a) == 0, 1.0).otherwise(0.0)).otherwise(n["both"] / n["a"]))


def with_sketch(df: DataFrame, text: Column, name: str, bits: int = FRACTION_BITS) -> DataFrame:
    """Adds the sketch of a text column, step by step so that none is evaluated twice."""
    columns = [c for c in df.columns if c != name]
    df = df.withColumn("_w", words(ascii_lower(text)))
    return df.withColumn("_hashes", shingle_hashes("_w")).withColumn(name, kept("_hashes", bits)).select(*columns, name)


def upper_neighbours(groups: DataFrame) -> DataFrame:
    """(_group, _up): the next higher group number that is there; the lowest for the highest.

    Works level by level on higher and higher bits, so no task orders more than 2**LEVEL_BITS numbers.
    """
    groups = checkpointed(groups)
    low, high = groups.agg(F.min("_group"), F.max("_group")).first()
    if low is None:
        return groups.withColumn("_up", F.col("_group"))
    out, top = groups.withColumn("_up", F.lit(None).cast("long")), 63 // LEVEL_BITS
    for level in range(top + 1):
        own = groups.select(F.shiftright("_group", LEVEL_BITS * level).alias("_g"), "_group").groupBy("_g").agg(F.min("_group").alias("_least"))
        parent = F.shiftright("_g", LEVEL_BITS) if level < top else F.lit(0)  # the sign bit stays through all shifts
        own = own.withColumn("_to", F.lead("_least").over(Window.partitionBy(parent).orderBy("_g"))).select("_g", "_to")
        out = out.withColumn("_g", F.shiftright("_group", LEVEL_BITS * level)).join(own, "_g", "left").select("_group", F.coalesce("_up", "_to").alias("_up"))
        if low >> (LEVEL_BITS * (level + 1)) == high >> (LEVEL_BITS * (level + 1)):
            break
    return out.withColumn("_up", F.coalesce("_up", F.lit(low)))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text, and of the text whose last third gives way to the next document.

    The next document is the one with the next lower doc_id (repeated ids: by text hash; null ids
    come last), after the last the first; a lone document is its own next. Return doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, within_edited,
    within_next (shares of the document's own sketch), next_doc_id. A null text is empty. Texts
    without words have blank fingerprints, alike to each other (1) and unlike others (0). An
    empty table gives no rows.
    """
    base = docs.select("doc_id", whole().alias("_text"), text_key().alias("_key"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("_sort"))
    # rows without an id come last, in groups by text hash below all others, so that many of them are many groups
    unnamed = F.lit(UNNAMED) + F.shiftright("_key", 34)
    base = base.withColumn("_group", F.when(F.col("_sort") == -(2**63), unnamed).otherwise(F.shiftright("_sort", GROUP_BITS)))
    up = upper_neighbours(base.select("_group").distinct())

    # texts are shuffled bare, and their sketches, nearly as large, made where they arrive
    base = base.repartition("_group")
    order = Window.partitionBy("_group").orderBy(F.col("_sort").desc(), F.col("_key").desc())
    nexts = {"_next_id": "doc_id", "_next_text": "_text", "_next_fp": "_fp", "_next_sort": "_sort"}
    row = with_sketch(base, F.col("_text"), "_fp", DENSE_BITS).select("*", *[F.lead(c).over(order).alias(n) for n, c in nexts.items()])
    heads = base.withColumn("_first", F.lag("_sort").over(order).isNull()).filter("_first")
    heads = with_sketch(heads, F.col("_text"), "_fp", DENSE_BITS).select("_group", F.col("doc_id").alias("_head_id"), F.col("_text").alias("_head_text"), F.col("_fp").alias("_head_fp"))
    heads = heads.join(up, "_group").select(F.col("_up").alias("_group"), "_head_id", "_head_text", "_head_fp")
    row = row.join(heads, "_group", "left")
    inside = F.col("_next_sort").isNotNull()
    row = row.select(
        "doc_id", "_text", "_fp", F.char_length("_text").cast("long").alias("n_chars"),
        *[F.when(inside, F.col(f"_next_{c}")).otherwise(F.col(f"_head_{c}")).alias(f"_{c}2") for c in ("id", "text", "fp")])
    third = F.expr("cast(n_chars div 3 as int)")
    row = row.withColumn("_edited", F.concat(F.left("_text", F.col("n_chars").cast("int") - third), F.left("_text2", third)))
    row = with_sketch(row, F.col("_edited"), "_efp", DENSE_BITS)
    return row.select(
        "doc_id", "n_chars", sha256_of(F.col("_edited")).alias("edited_sha256"), text_form(F.col("_fp")).alias("fingerprint"), text_form(F.col("_efp")).alias("edited_fingerprint"),
        likeness("_fp", "_efp", DENSE_BITS).alias("near_edited"), likeness("_fp", "_fp2", DENSE_BITS).alias("near_next"),
        containment("_fp", "_efp", DENSE_BITS).alias("within_edited"), containment("_fp", "_fp2", DENSE_BITS).alias("within_next"), F.col("_id2").alias("next_doc_id"))


def merged(sketches: list[Column], bits: int = FRACTION_BITS) -> Column:
    """The sketch of the union of the sketched texts."""
    return kept(reduce(F.array_union, sketches), bits)
