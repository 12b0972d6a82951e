"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within RADIUS = 3 bits have a variant in common that lies within half the radius
of both: within one flipped bit of the one and two of the other. Every fingerprint emits itself
and its 64 variants of one flip. Fingerprints three bits apart differ in parity, so only those with
an odd number of bits emit variants of two flips as well, and of three differing bits two are
always in one half, so the two flips are of the same half: about 560 variants on average.

Variants are shuffled once, each with the number of its flips, from which its fingerprint follows. On a
variant, a fingerprint within one flip of it is the hub, that of the least number; all others that
emit it are within 3 bits of the hub, are verified against it and linked to it. Equal fingerprints are one node, so at most 2,081 meet on a variant, however many copies there
are, and no pairs within a group are needed.

Components come from alternating large-star and small-star steps over the links, with a checkpoint
after each round.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamdex.llm.textops import checkpointed, text_key, whole
from loamdex.llm.workers import map_texts

RADIUS, SHINGLE, SEED, STEP = 3, 3, 42, 1 << 16


def fingerprint(text: str) -> int:
    """64-bit SimHash of the three-word shingles (repeats count), as a signed integer."""
    w = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z, and ASCII white space
    if not w:
        return 0
    shingles = map(b" ".join, zip(*(w[k:] for k in range(SHINGLE)))) if len(w) >= SHINGLE else [b" ".join(w)]
    n, ones, digest = max(1, len(w) - SHINGLE + 1), np.zeros(64, np.int64), xxhash.xxh64_digest
    digests = b"".join([digest(s, SEED) for s in shingles])
    for i in range(0, len(digests), 8 * STEP):
        bits = np.unpackbits(np.frombuffer(digests[i : i + 8 * STEP], np.uint8)).view(np.uint64).reshape(-1, 8)
        # sums of 255 bits fit a byte, eight bytes are added at once
        ones += np.add.reduceat(bits, range(0, len(bits), 255), axis=0).view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > n).astype(np.uint8)).view(">i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, _key, fp) for each row; a null text is empty, texts without words have fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = [fingerprint(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp, pa.int64())], ["doc_id", "_key", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_texts(docs.select("doc_id", text_key().alias("_key"), whole().alias("text")), run, f"doc_id {kind}, _key long, fp long")


def _odd(x: Column) -> Column:
    return F.bit_count(x) % 2 == 1


def _flips() -> list[int]:
    """The masks of variants by number: none, one flip, two flips of one half."""
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    single = [signed(1 << k) for k in range(64)]
    return [0, *single, *[signed(1 << a | 1 << b) for low in (0, 32) for a, b in combinations(range(low, low + 32), 2)]]


#: Flips up to this number are of one bit at most.
NEAR = 64


def ball_variants(nodes: DataFrame) -> DataFrame:
    """(variant, flip) of the distinct fingerprints fp; flip is the number of the mask, from which the fingerprint follows again."""
    masks = _flips()
    every = F.when(_odd(F.col("fp")), F.lit(masks)).otherwise(F.lit(masks[: NEAR + 1]))
    return nodes.select("fp", F.posexplode_outer(every).alias("flip", "_m")).select(F.col("fp").bitwiseXOR(F.col("_m")).alias("variant"), F.col("flip").cast("short").alias("flip"))


def links(nodes: DataFrame) -> DataFrame:
    """Distinct links (u, v), u > v, that connect what lies within RADIUS bits. nodes: distinct fp."""
    # only variant and flip are shuffled: fingerprints follow from them behind the window
    met = ball_variants(nodes).withColumn("_least", F.min("flip").over(Window.partitionBy("variant")))
    met = met.filter((F.col("_least") <= NEAR) & (F.col("flip") != F.col("_least")))
    of = lambda flip: F.col("variant").bitwiseXOR(F.get(F.lit(_flips()), F.col(flip)))
    met = met.select(of("flip").alias("fp"), of("_least").alias("hub"))
    found = met.filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("hub"))) <= RADIUS)
    return found.select(F.greatest("fp", "hub").alias("u"), F.least("fp", "hub").alias("v")).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(u, v) for each node u of the links but the smallest v of its component."""

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    # tables of nodes and links grow with the input: their joins are never broadcasts
    edges = checkpointed(edges)
    known = state(edges)
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.hint("merge"), "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = checkpointed(small.distinct())
        now = state(edges)
        if now == known:
            return edges
        known = now
    raise RuntimeError(f"components didn't settle in {rounds} rounds")


def labelled(docs: DataFrame) -> DataFrame:
    """(doc_id, _key, fp, root, component_id, stays) of each row.

    root is the smallest fingerprint of the component; stays marks the row of the smallest doc_id, null
    ids last, then of the smallest text hash. Rows meet their component by fingerprint, both sides being
    plain shuffles, so that a fingerprint of very many copies is split at run time.
    """
    rows = checkpointed(fingerprints(docs))
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_key")
    nodes = checkpointed(rows.groupBy("fp").agg(F.min(first).alias("first")))
    root = components(links(nodes.select("fp"))).withColumnRenamed("u", "fp")
    rooted = nodes.join(root.hint("merge"), "fp", "left").withColumn("root", F.coalesce("v", "fp"))
    least = rooted.groupBy("root").agg(F.min("first").alias("least"))
    ids = checkpointed(rooted.select("fp", "root").join(least.hint("merge"), "root").select("fp", "root", F.col("least.doc_id").alias("component_id"), F.col("least._key").alias("_least_key")))
    stays = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("_key") == F.col("_least_key"))
    return rows.join(ids.hint("merge"), "fp").select("doc_id", "_key", "fp", "root", "component_id", stays.alias("stays"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Return doc_id, fingerprint (16 hexadecimal digits), component_id.

    component_id is the smallest doc_id that can be reached over links of RADIUS bits or fewer,
    the row's own included; null only where no doc_id of the component is known. Repeated rows
    and null or empty texts (fingerprint 0) are linked like any other; an empty table gives no rows.
    """
    return labelled(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each component stays, all columns kept: that of the smallest doc_id, null ids last, then of the smallest text hash."""
    rows = checkpointed(labelled(docs).select("doc_id", "_key", "stays"))
    out = rows.filter("not stays").select(F.col("doc_id").alias("_out_id"), F.col("_key").alias("_out_key")).distinct()
    kept = docs.join(out, docs["doc_id"].eqNullSafe(out["_out_id"]) & (text_key(docs["text"]) == out["_out_key"]), "left_anti")
    repeated = rows.groupBy("doc_id", "_key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return kept if repeated.isEmpty() else kept.dropDuplicates(["doc_id", "text"])
