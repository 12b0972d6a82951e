"""Merkle manifest of a table: a tree of hashes for each group, and one tree over the groups' roots.

Leaves are range-sorted by group and key, so that each partition holds an unbroken stretch of every
tree it touches. The first and last group of each partition are counted; from these counts the driver
knows where each stretch begins in its tree. A partition builds every aligned subtree that lies whole
in it. What is left, fewer than ARITY nodes at either end of each level, is shuffled by its coordinate
in the tree, BAND levels at a time, until each group has one root. The roots, sorted by group, are the
leaves of the upper tree, which is built by the same steps. Paths then go back down to the partitions.

Driver: two counts and two places for each partition of at most about ROWS leaves. No task holds more
than a partition, or the ARITY ** BAND nodes of one coordinate.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import groupby
from typing import Any

from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamdex.llm.textops import checkpointed

#: Nodes under one parent, and levels that one shuffle finishes.
ARITY, BAND = 8, 4
#: Leaves in a partition; partitions grow in number with the table, not in size.
ROWS = 100_000
PROOF = "array<struct<left:string,right:string>>"

Path = list[tuple[str, str]]


def leaf_of(*fields: str | Column) -> Column:
    """SHA-256 (lowercase hex) over all fields: `-` for null, else the UTF-8 byte count, `:` and the value; numbers are decimal."""

    def packed(field: str | Column) -> Column:
        value = (F.col(field) if isinstance(field, str) else field).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*map(packed, fields)), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that leaf and its siblings lead to."""
    return F.aggregate(proof, leaf, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]), 256))


def proof_digest(proof: Column) -> Column:
    """SHA-256 of all siblings, level by level upwards, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda step: F.concat(step["left"], step["right"])), ""), 256)


def parent(nodes: Iterable[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def _width(total: int, level: int) -> int:
    """Nodes of a tree of total leaves at a level."""
    for _ in range(level):
        total = -(-total // ARITY)
    return total


def _height(total: int) -> int:
    level = 0
    while total > 1:
        total, level = -(-total // ARITY), level + 1
    return level


def stretch(nodes: list[str], begin: int, total: int) -> list[tuple[int, list[str], range]]:
    """What the leaves begin, begin + 1, ... of a tree of total ones finish on their own: (begin, nodes, runs that are whole here) by level."""
    levels = []
    while nodes:
        end = begin + len(nodes)
        whole = range(0) if total == 1 else range(-(-begin // ARITY), -(-end // ARITY) if end == total else end // ARITY)
        levels.append((begin, nodes, whole))
        nodes = [parent(nodes[r * ARITY - begin : (r + 1) * ARITY - begin]) for r in whole]
        begin, total = whole.start, -(-total // ARITY)
    return levels


def _beside(nodes: list[str], at: int) -> tuple[str, str]:
    return "".join(nodes[:at]), "".join(nodes[at + 1 :])


class _Places:
    """Where the groups of each partition begin, and how many leaves those have that lie in several."""

    def __init__(self, counted: list[tuple[int, list[tuple[Any, int]]]]):
        #: part -> [leaves of its first group before it, all leaves of its first group, all leaves of its last group]
        self.of: dict[int, list[int]] = {}
        open_group: Any = None
        members: list[tuple[int, int]] = []  # (part, which entry) of the open group
        size = 0

        def close() -> None:
            for part, entry in members:
                self.of[part][entry] = size
                if len(members) > 1:
                    self.largest = max(self.largest, size)

        self.largest = 0  # of the groups in several partitions
        for part, ends in sorted(counted):
            self.of[part] = [0, 0, 0]
            group, n = ends[0]
            if members and group == open_group:
                self.of[part][0] = size
            else:
                close()
                members, size, open_group = [], 0, group
            members.append((part, 1))
            size += n
            if len(ends) > 1:
                close()
                open_group, size = ends[1]
                members = [(part, 2)]
        close()


def _ends(index: int, groups: Iterator[Any]) -> Iterator[tuple[int, list[tuple[Any, int]]]]:
    first = last = None
    for group, rows in groupby(groups):
        last = (group, sum(1 for _ in rows))
        first = first or last
        several = first is not last
    if first:
        yield index, [first, last] if several else [first]


def _groups(index: int, rows: list, places: dict[int, list[int]]) -> Iterator[tuple[Any, list, int, int]]:
    """(group, its rows here, leaves before them, all leaves of it) of a partition; rows begin with group and node."""
    here = [(group, list(of)) for group, of in groupby(rows, key=lambda row: row[0])]
    for i, (group, of) in enumerate(here):
        before, of_first, of_last = places[index]
        yield group, of, before if i == 0 else 0, of_first if i == 0 else of_last if i == len(here) - 1 else len(of)


def _ragged(index: int, rows: Iterator, places: dict[int, list[int]]) -> Iterator[tuple]:
    """Roots of the groups that lie whole in a partition: (group, None, ...); and nodes of the others that need nodes of other partitions."""
    for group, of, begin, total in _groups(index, list(rows), places):
        levels = stretch([row[1] for row in of], begin, total)
        if len(of) == total:
            yield group, None, levels[-1][1][0], None
            continue
        for level, (start, nodes, whole) in enumerate(levels):
            for pos, node in enumerate(nodes, start):
                if pos // ARITY not in whole:
                    yield group, (total, level, pos), node, index


def _finished(key: tuple, found: Iterable[tuple], low: int) -> Iterator[tuple]:
    """The levels low to low + BAND of one coordinate: the node or root on top, and the way of each node to it."""
    group, given = key[0], list(found)
    levels: dict[int, dict[int, str]] = defaultdict(dict)
    for (_, level, pos), node, _part in given:
        levels[level][pos] = node
    total, top = given[0][0][0], low + BAND
    for level in range(low, low + BAND):
        width = _width(total, level)
        if width == 1:
            top = level
            break
        for run in {pos // ARITY for pos in levels[level]}:
            levels[level + 1][run] = parent(levels[level][pos] for pos in range(run * ARITY, min((run + 1) * ARITY, width)))
    ((at, node),) = levels[top].items()
    done = _width(total, top) == 1
    yield "root" if done else "node", (group, None if done else (total, top, at), node, None)
    for place, _node, part in given:
        _, level, pos = place
        way: Path = []
        for up in range(level, top):
            first = pos // ARITY * ARITY
            run = [levels[up][p] for p in range(first, min(first + ARITY, _width(total, up)))]
            way.append(_beside(run, pos - first))
            pos //= ARITY
        yield "way", (None if done else (group, top, at), (part, (group, level, place[2], way)))


def _climb(rows: RDD) -> tuple[RDD, RDD, dict[int, list[int]]]:
    """Of sorted (group, node, ...) rows: (group, root), (partition, (group, level, position, way to the root)) for nodes at the ends of partitions, places."""
    places = _Places(rows.map(lambda row: row[0]).mapPartitionsWithIndex(_ends).collect())
    of, largest = places.of, places.largest
    left = rows.mapPartitionsWithIndex(lambda i, it: _ragged(i, it, of))
    roots = left.filter(lambda x: x[1] is None).map(lambda x: (x[0], x[2]))
    ragged = left.filter(lambda x: x[1] is not None)
    ways: list[RDD] = []
    parts = max(1, min(rows.getNumPartitions(), 2 * rows.ctx.defaultParallelism))
    for low in range(0, max(_height(largest), 1) if largest else 0, BAND):

        def coordinate(x: tuple, low: int = low) -> tuple:
            group, place, node, part = x
            return (group, place[2] // ARITY ** (low + BAND - place[1])), (place, node, part)

        in_band = ragged.filter(lambda x, low=low: low <= x[1][1] < low + BAND)
        given = (in_band if not low else in_band.union(risen)).map(coordinate)
        done = given.groupByKey(parts).flatMap(lambda kv, low=low: _finished(kv[0], kv[1], low))
        risen = done.filter(lambda x: x[0] == "node").map(lambda x: x[1])
        roots = roots.union(done.filter(lambda x: x[0] == "root").map(lambda x: (x[1][0], x[1][2])))
        ways.append(done.filter(lambda x: x[0] == "way").map(lambda x: x[1]))
    above, out = None, rows.ctx.emptyRDD()
    for band in reversed(ways):
        complete = band.filter(lambda x: x[0] is None).map(lambda x: x[1])
        if above is not None:
            longer = band.filter(lambda x: x[0] is not None).join(above, parts)
            complete = complete.union(longer.map(lambda x: (x[1][0][0], (*x[1][0][1][:3], x[1][0][1][3] + x[1][1]))))
        above = complete.filter(lambda x: x[0] is None).map(lambda x: (x[1][:3], x[1][3]))
        out = out.union(complete.filter(lambda x: x[0] is not None))
    return roots, out, of


def _proofs(records: Iterator[tuple[int, tuple]], places: dict[int, list[int]]) -> Iterator[tuple]:
    """(row, subroot, root or None, steps) of each row of the partitions whose rows and ways are records."""
    rows: dict[int, list] = defaultdict(list)
    ways: dict[int, dict] = defaultdict(dict)
    over: dict[int, dict] = defaultdict(dict)
    for part, (kind, *x) in records:
        if kind == "row":
            rows[part].append(x)
        elif kind == "way":
            ways[part][tuple(x[:3])] = x[3]
        else:
            over[part][x[0]] = x[1:]
    for part, found in rows.items():
        found.sort(key=lambda x: x[0])
        for group, of, begin, total in _groups(part, [row for _, row in found], places):
            levels = stretch([row[1] for row in of], begin, total)
            beyond, root = over[part].get(group, ([], None))
            subroot: str | None = None
            for pos, row in enumerate(of, begin):
                steps: Path = []
                for level, (start, nodes, whole) in enumerate(levels):
                    first = pos // ARITY * ARITY
                    if pos // ARITY not in whole:
                        steps += ways[part][(group, level, pos)] if len(of) < total else []
                        break
                    steps.append(_beside(nodes[first - start : first - start + ARITY], pos - first))
                    pos //= ARITY
                if subroot is None:
                    subroot = row[1]
                    for left, right in steps:
                        subroot = parent((left, subroot, right))
                yield row, subroot, root, steps + beyond


def _sorted(rows: DataFrame, keys: list[Column], count: int) -> RDD:
    parts = -(-count // ROWS) or 1
    return checkpointed(rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)).rdd.map(tuple)


def _keyed(rows: RDD) -> RDD:
    return rows.mapPartitionsWithIndex(lambda i, it: ((i, ("row", n, row)) for n, row in enumerate(it)))


def _to_partitions(records: RDD, parts: int) -> RDD:
    return records.partitionBy(max(parts, 1), lambda part: part)


def proofs(leaves: DataFrame, group: str, order: list[str], node: str = "leaf") -> DataFrame:
    """leaves with subroot, root and proof, an array of (left, right): the siblings of each level from the leaf up, concatenated.

    leaves: one row for each leaf, whose hash (lowercase hex, never null) is node; in each group leaves
    ascend by order, then by node; null groups and keys come first. A run of one node has no siblings and
    still is hashed. Equal rows are leaves of their own, wherever they end up among each other. No leaves:
    no rows. Other columns go along whatever their names are, but subroot, root and proof are replaced.
    """
    spark = leaves.sparkSession
    kept = leaves.drop("subroot", "root", "proof")
    names = kept.columns
    plain = kept.select(F.col(group).alias("_group"), F.col(node).alias("_node"), *(F.col(c).alias(f"_{i}") for i, c in enumerate(names)), F.monotonically_increasing_id().alias("_row"))
    rows_table = checkpointed(plain)
    keys = [F.col("_group").asc_nulls_first(), *(F.col(f"_{names.index(c)}").asc_nulls_first() for c in order), F.col("_node"), F.col("_row")]
    rows = _sorted(rows_table, keys, rows_table.count())
    roots, ways, places = _climb(rows)

    kind = leaves.schema[group].dataType
    over_table = checkpointed(spark.createDataFrame(roots, T.StructType([T.StructField("_group", kind), T.StructField("_node", T.StringType())]), verifySchema=False))
    over_rows = _sorted(over_table, [F.col("_group").asc_nulls_first()], over_table.count()).map(lambda x: (0, x[1], x[0]))
    top, over_ways, over_places = _climb(over_rows)
    over_records = _to_partitions(_keyed(over_rows).union(ways_of(over_ways)), over_rows.getNumPartitions())
    of_groups = over_records.mapPartitions(lambda it: _proofs(it, over_places)).map(lambda x: (x[0][2], (x[3], x[1])))

    wanted = rows.map(lambda row: row[0]).mapPartitionsWithIndex(lambda i, it: ((g, i) for g, _ in groupby(it)))
    asked = wanted.join(of_groups, max(1, min(rows.getNumPartitions(), 64))).map(lambda x: (x[1][0], ("group", x[0], *x[1][1])))
    records = _to_partitions(_keyed(rows).union(ways_of(ways)).union(asked), rows.getNumPartitions())
    out = records.mapPartitions(lambda it: _proofs(it, places)).map(lambda x: (*x[0][2:-1], x[1], x[2], x[3]))
    schema = T.StructType([*kept.schema.fields, *T._parse_datatype_string(f"subroot string, root string, proof {PROOF}").fields])
    return spark.createDataFrame(out, schema, verifySchema=False)


def ways_of(ways: RDD) -> RDD:
    return ways.map(lambda x: (x[0], ("way", *x[1])))


def manifest(leaves: DataFrame, group: str, order: list[str], node: str = "leaf") -> DataFrame:
    """One row for each group: its value, n_leaves, subroot and the table's root."""
    out = proofs(leaves.select(group, node, *(c for c in order if c not in (group, node))), group, order, node)
    return out.groupBy(group).agg(F.count("*").alias("n_leaves"), F.first("subroot").alias("subroot"), F.first("root").alias("root"))


def document_leaves(docs: DataFrame) -> DataFrame:
    """(lang, doc_id, leaf, tampered): the leaf of each row of documents, and that of the row as a third of ids are tampered with, A-Z of their text lower-cased."""
    from loamdex.llm.textops import UPPER

    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    lowered = F.translate(F.col("text"), UPPER, UPPER.lower())
    head = ("doc_id", "source", "lang", "n_chars")
    return docs.select("lang", "doc_id", leaf_of(*head, "text").alias("leaf"), F.when(hit, leaf_of(*head, lowered)).alias("tampered"))


def document_proofs(docs: DataFrame) -> DataFrame:
    """Proofs of all documents and what they say of tampered rows: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Rows are leaves of their lang's tree, ascending by doc_id. Nulls of any column enter into the leaf; a row
    without an id comes first and isn't tampered with. Empty and very long texts are hashed whole. Repeated
    rows are leaves each; of rows that share an id, the smaller leaf comes first. Other columns are ignored;
    no documents give no rows.
    """
    found = proofs(document_leaves(docs), "lang", ["doc_id"])
    back = folded(F.coalesce("tampered", "leaf"), F.col("proof"))
    out = found.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), back.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
