"""The nearest neighbour of every vector, exactly, without comparing all with all.

Vectors are sorted by their nearest pivot into blocks, each with a centre and a radius. Compared with its own
block, a vector has a first neighbour. By the triangle inequality, no vector of another block is nearer than
the distance to its centre less its radius: pairs of blocks where that is too far for every vector are never
made, and within a pair the vectors for which it is too far are left out. Blocks that are consecutive make a
slab; what is left of the pairs of two slabs is made in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from loamdex.operators.quantised import clustered
from loamdex.operators.retrieval import DIGITS, SLABS, _matrix, _unit, best_rows, first_rows, places, top_k, whole_vectors
from loamdex.session import stored

#: Rows that pivots are fitted on, pivots that are sent to all tasks, rows of a block, rows of a slab.
SAMPLE, PIVOTS, ROWS, SLAB = 20_000, 1_024, 2_048, 65_536
#: Distances are trusted to this much: scores are rounded before they are ranked.
_SLACK = 1e-6


def _blocks(own: DataFrame, k: int, seed: int) -> DataFrame:
    """(block, slab, ids, v: unit rows as bytes, centre, radius, reach, most). reach: the distance in which each vector has k neighbours of its block; most: the largest. Zero vectors have no direction: a block with one has no bound."""
    n, kind = own.count(), own.schema["id"].dataType
    sample = [r[0] for r in own.select("v").orderBy(F.xxhash64("id"), "v").limit(SAMPLE).collect()]
    pivots = clustered(_unit(np.array(sample, np.float64)), min(PIVOTS, round(n**0.5)), np.random.default_rng(seed), on_sphere=True) if sample else np.zeros((1, 1))
    rows = int(min(ROWS, max(32, round(2 * n**0.5))))
    sent = own.sparkSession.sparkContext.broadcast(pivots)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                m = _unit(_matrix(batch.column(1), sent.value.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(np.argmax(m @ sent.value.T, axis=1).astype(np.int32)), batch.column(0), pa.array([r.tobytes() for r in m], pa.binary())], ["pivot", "id", "v"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vs, at = [], [], None

        def full() -> pa.RecordBatch:
            m = np.frombuffer(b"".join(vs)).reshape(len(ids), -1)
            centre = m.mean(axis=0)
            radius = float(np.linalg.norm(m - centre, axis=1).max()) if m.any(axis=1).all() else float("inf")
            scores = np.round(m @ m.T, DIGITS)
            np.fill_diagonal(scores, -np.inf)
            kth = np.partition(scores, -k, axis=1)[:, -k] if len(ids) > k else np.full(len(ids), -np.inf)
            reach = np.where(np.isfinite(kth) & m.any(axis=1), np.sqrt(np.maximum(0, 2 - 2 * np.maximum(kth, -1))), np.inf)
            row = [pa.array([ids], pa.list_(to_arrow_type(kind))), pa.array([b"".join(vs)]), pa.array([centre.tolist()]), pa.array([radius]), pa.array([reach.tolist()]), pa.array([float(reach.max())])]
            return pa.RecordBatch.from_arrays(row, ["ids", "v", "centre", "radius", "reach", "most"])

        for batch in batches:
            for pivot, i, v in zip(*(c.to_pylist() for c in batch.columns)):
                if len(ids) == rows or pivot != at and 4 * len(ids) >= rows:  # not too small, and of one pivot where it can be
                    yield full()
                    ids, vs = [], []
                at = pivot
                ids.append(i)
                vs.append(v)
        if ids:
            yield full()

    by_pivot = own.mapInArrow(placed, f"pivot int, id {kind.simpleString()}, v binary")
    parts = max(1, -(-n // (16 * rows)))
    per_slab = max(1, min(-(-parts // SLABS), SLAB // (16 * rows)))
    ordered = by_pivot.repartitionByRange(parts, "pivot", F.xxhash64("id")).sortWithinPartitions("pivot", F.xxhash64("id"))
    made = ordered.mapInArrow(packed, f"ids array<{kind.simpleString()}>, v binary, centre array<double>, radius double, reach array<double>, most double")
    return made.withColumns({"block": F.monotonically_increasing_id(), "slab": F.floor(F.spark_partition_id() / per_slab).cast("int")})


def _rows(block: dict) -> tuple[list, np.ndarray]:
    return block["ids"], np.frombuffer(block["v"]).reshape(len(block["ids"]), -1)


def nearest_of_all(vectors: DataFrame, k: int = 1, id: str = "vec_id", vector: str = "embedding", seed: int = 42, counted: bool = False) -> DataFrame:
    """(qid, id, score, rank): the k nearest others of every vector by cosine, equal ones by id; the rows of an exact search.

    counted: one row instead, compared and possible: pairs of a vector with another that were worked out, and all of them.
    A vector that is null, or lacks a number, has no neighbours and is none.
    """
    own = whole_vectors(vectors.select(F.col(id).alias("id"), F.col(vector).alias("v")), "v")
    blocks = stored(_blocks(own, k, seed))
    kind = own.schema["id"].dataType
    schema = pa.schema([("qid", to_arrow_type(kind)), ("id", to_arrow_type(kind)), ("score", pa.float64())])
    # one row for ROWS vectors: what meets here is small
    short = blocks.select("slab", "centre", "radius", "most")
    a, b = (short.select(*(F.col(c).alias(f"{c}_{s}") for c in short.columns)) for s in "ab")
    apart = F.sqrt(F.aggregate(F.zip_with("centre_a", "centre_b", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda t, x: t + x))
    # a block's own radius bounds how much nearer one of its vectors can be
    pairs = stored(a.crossJoin(b).filter(apart - F.col("radius_a") - F.col("radius_b") <= F.col("most_a") + _SLACK).select(F.col("slab_a").alias("slab"), F.col("slab_b").alias("other")).distinct())
    left = pairs.join(blocks.select("slab", "block", "ids", "v", "centre", "radius", "reach", "most"), "slab")
    right = pairs.join(blocks.select(F.col("slab").alias("other"), "block", "ids", "v", "centre", "radius"), "other")
    right = right.select(*(F.col(c).alias(f"o_{c}") for c in right.columns))

    def across(x: pa.Table, y: pa.Table) -> pa.Table:
        asked, compared, out = y.rename_columns([c.removeprefix("o_") for c in y.column_names]).to_pylist(), 0, [schema.empty_table()]
        ids = pa.array([i for o in asked for i in o["ids"]], schema.field("id").type)
        place, starts = places(ids), np.cumsum([0, *(len(o["ids"]) for o in asked)]).tolist()
        others = [_rows(o)[1] for o in asked]
        for row in x.to_pylist():
            names, m = _rows(row)
            reach, centre, found = np.array(row["reach"]), np.array(row["centre"]), []
            # by what its own block has, a vector knows what a score must be to matter
            floor = np.where(np.isfinite(reach), 1 - reach**2 / 2 - _SLACK, -np.inf)
            for o, at, om in zip(asked, starts, others):
                own = row["block"] == o["block"]
                if np.sqrt(((centre - np.array(o["centre"])) ** 2).sum()) - row["radius"] - o["radius"] > row["most"] + _SLACK:
                    continue
                far = np.linalg.norm(m - np.array(o["centre"]), axis=1) - o["radius"]
                near = np.arange(len(names)) if own else np.flatnonzero(far <= reach + _SLACK)
                compared += len(near) * len(om)
                if len(near) and not counted:
                    q = m[near]
                    r, c, s = best_rows(lambda i, j: q[i:j] @ om.T, len(near), place[at : at + len(om)], k + own, floor[near])
                    kept = near[r] != c if own else np.ones(len(r), bool)  # not itself
                    found.append((near[r][kept], c[kept] + at, s[kept]))
            if found:
                r, c, s = first_rows(*(np.concatenate(z) for z in zip(*found)), place, k)
                out.append(pa.table([pa.array(names, schema.field("qid").type).take(pa.array(r)), ids.take(pa.array(c)), pa.array(s)], schema=schema))
        return pa.table({"compared": pa.array([compared], pa.int64())}) if counted else pa.concat_tables(out)

    met = left.groupBy("slab", "other").cogroup(right.groupBy("o_slab", "o_other"))
    each = met.applyInArrow(across, "compared long" if counted else f"qid {kind.simpleString()}, id {kind.simpleString()}, score double")
    if counted:
        return each.agg(F.sum("compared").alias("compared")).join(own.agg((F.count("*") * F.count("*")).alias("possible")))
    return top_k(each, k)
