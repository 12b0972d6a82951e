"""Proportional stratified interleaving: shards that all carry the mixture of the sources.

Rows of a source are put into a seeded random order and get the fractional rank
(rank + u) / n, where n is the source's row count and u a fixed offset of the source
in (0, 1). Sorting all rows by the fractional rank interleaves the sources in proportion;
equal cuts of that order are the shards. Counts of shards differ by one at most.

Both ranks are built in two levels (bucket counts, prefix sums of the count table, row numbers
inside of a bucket), so no task ever holds a whole source or all rows. The number of buckets follows
the number of rows, about BUCKET_ROWS each; prefix sums of bucket counts have two levels themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamdex.llm.textops import checkpointed, whole

#: Rows of a bucket, about; buckets at least and at most, as powers of 2; buckets whose counts are added up at once.
BUCKET_ROWS, LEAST_BITS, MOST_BITS, GROUP_BITS = 4096, 6, 40, 12


def bucket_bits(n: int) -> int:
    """Buckets for n rows, as a power of 2."""
    return min(MOST_BITS, max(LEAST_BITS, (n // BUCKET_ROWS).bit_length()))


def rows_before(counts: DataFrame, group: list[str], bucket: str) -> DataFrame:
    """counts (group columns, bucket, _n) with _before, the rows of all lower buckets of the group, and _all, those of the group."""
    high = F.shiftright(bucket, GROUP_BITS)
    counts = counts.withColumn("_high", high)
    inside = Window.partitionBy(*group, "_high").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    whole_group = Window.partitionBy(*group)
    tops = counts.groupBy(*group, "_high").agg(F.sum("_n").alias("_t"))
    tops = tops.select(*group, "_high", F.coalesce(F.sum("_t").over(whole_group.orderBy("_high").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"), F.sum("_t").over(whole_group).alias("_all"))
    own = counts.withColumn("_in", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    return own.join(tops, [*group, "_high"]).select(*group, bucket, (F.col("_base") + F.col("_in")).alias("_before"), "_all")


def interleaved_shards(docs: DataFrame, shards: int = 8, seed: int = 42) -> DataFrame:
    """Return doc_id, source, size, text_crc32, shard, slot (position in the shard, from 0).

    A null source is a source of its own; a null text has size 1 and checksum 0; repeated
    rows each take a slot; an empty table gives no rows. Other columns of docs are ignored.
    """
    row = docs.select(
        "doc_id", F.col("source").cast("string").alias("source"),
        (F.octet_length(whole()).cast("long") + 1).alias("size"),
        F.crc32(whole().cast("binary")).alias("text_crc32"),
    )
    row = row.withColumn("_h", F.xxhash64(F.lit(seed), "doc_id", "text_crc32", "size"))
    row = row.withColumn("_s", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")))
    row = checkpointed(row)  # narrow; texts are read once
    bits = bucket_bits(row.count())
    row = row.withColumn("_b", F.shiftrightunsigned("_h", 64 - bits))

    starts = rows_before(row.groupBy("_s", "_b").agg(F.count(F.lit(1)).alias("_n")), ["_s"], "_b")
    # the sign bit comes first in the unsigned order of _h, as in _b
    unsigned = F.col("_h").bitwiseXOR(F.lit(-(2**63)))
    inner = Window.partitionBy("_s", "_b").orderBy(unsigned, "doc_id", "text_crc32")
    offset = (F.pmod(F.xxhash64(F.lit(seed), "_s"), F.lit(1 << 30)) + 1) / F.lit(float((1 << 30) + 1))
    # the counts grow with the rows, so they are never broadcast; buckets are what both sides are dealt by anyway
    ranked = row.join(starts.hint("merge"), ["_s", "_b"]).withColumn("_f", (F.col("_before") + F.row_number().over(inner) - 1 + offset) / F.col("_all"))
    ranked = ranked.withColumn("_fb", F.least(F.floor(F.col("_f") * (1 << bits)), F.lit((1 << bits) - 1))).drop("_before", "_all")

    cuts = rows_before(ranked.groupBy("_fb").agg(F.count(F.lit(1)).alias("_n")), [], "_fb").select("_fb", F.col("_before").alias("_first"), F.col("_all").alias("_total"))
    place = Window.partitionBy("_fb").orderBy("_f", "_s", unsigned, "doc_id", "text_crc32")
    rank = ranked.withColumn("_p", F.row_number().over(place) - 1).join(cuts.hint("merge"), "_fb")
    rank = rank.withColumn("_g", F.col("_first") + F.col("_p")).withColumn("shard", F.expr(f"(_g * {shards}) div _total").cast("int"))
    return rank.select("doc_id", "source", "size", "text_crc32", "shard", (F.col("_g") - F.expr(f"(shard * _total + {shards - 1}) div {shards}")).cast("long").alias("slot"))
