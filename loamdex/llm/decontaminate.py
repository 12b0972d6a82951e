"""Benchmark decontamination by a hash set of normalised test n-grams.

Every training-token window is hashed and probed against the set of the benchmark's
windows; hits are verified word by word. Only matched windows leave the scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamdex.llm.textops import ascii_lower, checkpointed, sha256_of, text_key, whole, words

N = 13
#: Distinct benchmark windows up to which the hash set is sent to all tasks.
SET_WINDOWS = 20_000


def benchmark_windows(benchmark: DataFrame, n: int = N) -> DataFrame:
    """One row for each distinct window: _hash, _len, _words, _items. Items without words have none."""
    w = benchmark.select(F.col("item_id"), words(ascii_lower(whole())).alias("_w")).filter(F.size("_w") > 0)
    w = w.withColumn("_len", F.least(F.size("_w"), F.lit(n)))
    w = w.select("item_id", "_len", "_w", F.explode(F.sequence(F.lit(1), F.size("_w") - F.col("_len") + 1)).alias("_i"))
    w = w.select("item_id", "_len", F.slice("_w", F.col("_i"), F.col("_len")).alias("_words"))
    return w.groupBy("_len", "_words").agg(F.collect_set(F.col("item_id").cast("string")).alias("_items")).withColumn("_hash", F.xxhash64(word_hashes("_words")))


def word_hashes(tokens: str) -> Column:
    return F.transform(tokens, lambda x: F.xxhash64(x))


def window_hashes(tokens: str, k: int) -> Column:
    """The hash of each k-word window, in order, from the hashes of the words."""
    return F.transform(F.sequence(F.lit(1), F.size(tokens) - (k - 1)), lambda i: F.xxhash64(F.slice(tokens, i, k)))


def _bigint(h: int) -> str:
    return f"{h}L" if h != -(2**63) else "bigint('-9223372036854775808')"


def _spread(hits: DataFrame, windows: DataFrame) -> DataFrame:
    """Occurrences whose words agree, too: _row, _start, _len, _items. hits: _row, _len, _start, _hash, _found."""
    met = hits.join(windows.withColumnRenamed("_len", "_k"), "_hash").filter((F.col("_len") == F.col("_k")) & (F.col("_found") == F.col("_words")))
    return met.select("_row", "_start", "_len", "_items")


def window_hits(docs: DataFrame, benchmark: DataFrame, n: int = N, set_windows: int = SET_WINDOWS) -> tuple[DataFrame, DataFrame]:
    """(rows, hits): each document's doc_id, _key, _row, n_words; verified occurrences _row, _start (word index from 0), _len, _items.

    Texts are cut into words once. Up to set_windows distinct windows, the hash set goes to all tasks
    as part of the plan and only positions in the set leave the scan. The set of a larger benchmark is
    too much to send: there all positions' hashes are joined with it, and words follow for those that meet.
    """
    windows = checkpointed(benchmark_windows(benchmark, n))
    lengths = [r["_len"] for r in windows.select("_len").distinct().collect()]  # n rows at most
    known = [r["_hash"] for r in windows.select("_hash").distinct().limit(set_windows + 1).collect()]
    tokens = docs.select("doc_id", text_key().alias("_key"), words(ascii_lower(whole())).alias("_w"), F.monotonically_increasing_id().alias("_row"))
    hashed = tokens.withColumn("_wh", word_hashes("_w")).withColumn("n_words", F.size("_w").cast("long"))
    if len(known) <= set_windows:
        listed = ", ".join(map(_bigint, known)) or "null"
        place = lambda k: f"transform(filter(sequence(1, size(_wh) - {k - 1}), i -> xxhash64(slice(_wh, i, {k})) IN ({listed})), i -> struct({k} AS _len, i - 1 AS _start, xxhash64(slice(_wh, i, {k})) AS _hash, slice(_w, i, {k}) AS _found))"
        none = "CAST(array() AS array<struct<_len:int,_start:int,_hash:bigint,_found:array<string>>>)"
        places = [F.expr(f"CASE WHEN size(_wh) >= {k} THEN {place(k)} ELSE {none} END") for k in sorted(lengths)]
        rows = checkpointed(hashed.select("doc_id", "_key", "_row", "n_words", (F.concat(*places) if places else F.expr(none)).alias("_places")))  # counts and what was met, no texts
        hits = rows.select("_row", F.explode("_places").alias("_p")).select("_row", "_p.*")
        return rows.drop("_places"), _spread(hits, windows)
    rows = checkpointed(hashed.select("doc_id", "_key", "_row", "n_words", "_w"))
    every = [rows.withColumn("_wh", word_hashes("_w")).select("_row", F.posexplode_outer(F.when(F.size("_wh") >= k, window_hashes("_wh", k))).alias("_start", "_hash"), F.lit(k).alias("_len")) for k in sorted(lengths)]
    met = reduce(DataFrame.unionByName, every).join(windows.select("_hash").distinct().hint("merge"), "_hash", "left_semi")
    hits = met.join(rows.select("_row", "_w").hint("merge"), "_row").withColumn("_found", F.slice("_w", F.col("_start") + 1, F.col("_len"))).drop("_w")
    return rows.drop("_w"), _spread(hits, windows)


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = N, keep_key: bool = False, set_windows: int = SET_WINDOWS) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, run_starts.

    run_starts are the first words of the runs of hit words, counted from 0. A null or empty text has no words
    and is clean; repeated rows get equal results; an empty benchmark leaves all clean; an
    empty table gives no rows. Null item ids are no items.
    """
    rows, hits = window_hits(docs, benchmark, n, set_windows)
    span = F.struct(F.col("_start").cast("int").alias("s"), (F.col("_start") + F.col("_len")).cast("int").alias("e"))
    per = hits.groupBy("_row").agg(F.sort_array(F.collect_set(span)).alias("_spans"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("_items")))).alias("_ids"))
    covered = F.aggregate(
        "_spans", F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
        lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(a["to"], x["s"]))).alias("n"), F.greatest(a["to"], x["e"]).alias("to")))
    merged = F.filter(F.col("_spans"), lambda x, i: (i == 0) | (x["s"] > F.get(F.col("_spans"), i - 1)["e"]))["s"]
    per = per.select("_row", covered["n"].cast("long").alias("_n_hit"), F.size("_ids").cast("long").alias("_n_items"), F.array_join("_ids", ",").alias("_joined"), merged.alias("_starts"))
    out = rows.join(per, "_row", "left")
    hit = F.coalesce("_n_hit", F.lit(0).cast("long"))
    return out.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.coalesce("_n_items", F.lit(0).cast("long")).alias("n_items"),
        sha256_of(F.coalesce("_joined", F.lit(""))).alias("items_sha256"),
        ((hit > 0) & (hit * 20 >= F.col("n_words"))).alias("contaminated"), F.coalesce("_starts", F.array().cast("array<int>")).alias("run_starts"), *["_key"] * keep_key)


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """The documents that aren't contaminated, all columns kept; empty and null texts stay."""
    bad = contamination(docs, benchmark, n, keep_key=True).filter("contaminated").select(F.col("doc_id").alias("_bad_id"), F.col("_key").alias("_bad_key")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_bad_id"]) & (text_key(docs["text"]) == bad["_bad_key"]), "left_anti")
