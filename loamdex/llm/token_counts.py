"""Token counts by a compiled finite-state transducer.

What later bytes of a piece can still see of its bytes so far is finite: the suffixes that some
token begins with, and for each the last token before it and how many tokens came since. That is
a state. A transition on a byte is deterministic, and annotated with the tokens that it emits:
the change of the count, which is negative where a longer token takes the place of several.
The driver compiles the states and transitions of all tokens and sends the tables, their size
checked; a worker adds those that its texts need beyond (STATES at most, then it starts again
from the tables). A piece's path from the start state back to it is one macro-transition.

Texts are read in chunks of CHUNK characters, and each chunk gives its state map as a row: what it
makes of the text that its left neighbour left open, the tokens between, and what it leaves open
itself. Maps compose by an associative operation; a tree of groups of FAN combines them by text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamdex.llm import pretokens
from loamdex.llm.merges import Merges, ranks_of_json
from loamdex.llm.textops import checkpointed, whole
from loamdex.llm.workers import map_texts

CHUNK, FAN, PIECES = 1 << 14, 16, 600_000
#: States that a worker may add to the tables, and bytes of tables that are sent at most.
STATES, TABLE_BYTES = 400_000, 64 << 20
START = -1


class Tables(NamedTuple):
    """Transitions (state * 256 + byte to next state and emission), and for each state how it is reached: from, byte."""

    keys: np.ndarray
    to: np.ndarray
    emitted: np.ndarray
    parent: np.ndarray

    @property
    def size(self) -> int:
        return sum(x.nbytes for x in self)


class Transducer:
    """States are numbers; contents[state] is ((suffix, last token before it, tokens since), ...), the longest suffix first."""

    def __init__(self, merges: Merges, tables: Tables | None = None):
        self.rank, self.fits = merges.rank, merges.fits
        self.prefixes = {t[:k] for t in merges.tokens for k in range(1, len(t))}
        self.tables = tables
        self.reset()

    def reset(self) -> None:
        self.contents: list[tuple | None] = [((b"", START, 0),)]
        self.ids: dict[tuple, int] = {self.contents[0]: 0}
        self.step: dict[int, tuple[int, int]] = {}
        self.known = 1
        if self.tables is not None:
            self.step = dict(zip(self.tables.keys.tolist(), zip(self.tables.to.tolist(), self.tables.emitted.tolist())))
            self.known = len(self.tables.parent)
            self.contents += [None] * (self.known - 1)

    def content(self, state: int) -> tuple:
        """Contents of compiled states come from the transition that reaches them, when first asked for."""
        path = []
        while self.contents[state] is None:
            path.append(state)
            state = int(self.tables.parent[state]) >> 8
        for s in reversed(path):
            self.contents[s] = self._successor(self.contents[state], int(self.tables.parent[s]) & 255)[0]
            self.ids.setdefault(self.contents[s], s)
            state = s
        return self.contents[state]

    def _successor(self, content: tuple, byte: int) -> tuple[tuple, int]:
        b = bytes([byte])
        for suffix, last, since in content:
            token = self.rank.get(suffix + b)
            # exactly one token fits behind what it leaves, so the first is the one
            if token is not None and (last == START or self.fits(last, token)):
                emitted = 1 - since
                break
        else:
            raise ValueError("a byte without a token")
        kept = [(s + b, t, n + emitted) for s, t, n in content if s + b in self.prefixes]
        return (*kept, (b"", token, 0)), emitted

    def _compile(self, state: int, byte: int) -> tuple[int, int]:
        content, emitted = self._successor(self.content(state), byte)
        to = self.ids.setdefault(content, len(self.contents))
        if to == len(self.contents):
            self.contents.append(content)
        found = self.step[state << 8 | byte] = to, emitted
        return found

    def count(self, piece: bytes) -> int:
        """Emissions of the path over a piece."""
        if len(self.contents) > self.known + STATES:
            self.reset()
        state, n, step = 0, 0, self.step
        for b in piece:
            found = step.get(state << 8 | b)
            if found is None:
                found = self._compile(state, b)
            state = found[0]
            n += found[1]
        return n

    def compiled(self, tokens: list[bytes]) -> Tables:
        """The tables of all paths of tokens from the start."""
        for token in tokens:
            self.count(token)
        parent = np.zeros(len(self.contents), np.int64)
        for key, (to, _) in self.step.items():  # a state's first transition was there before its own
            if to and not parent[to] and to > key >> 8:
                parent[to] = key
        pairs = list(self.step.values())
        return Tables(np.array(list(self.step), np.int64), np.array([p[0] for p in pairs], np.int32), np.array([p[1] for p in pairs], np.int8), parent)


#: The state map of a chunk: (head, tokens between, tail), cut where blank follows non-blank, or the chunk itself if it has no such place.
ChunkMap = tuple[str, int, str] | str


class Counter(dict):
    """Macro-transitions: the count of each piece seen."""

    def __init__(self, merges: Merges, special: tuple[str, ...], tables: Tables | None = None):
        super().__init__()
        self.machine, self.special = Transducer(merges, tables), special

    def __missing__(self, piece: str) -> int:
        n = self[piece] = self.machine.count(piece.encode("utf-8"))
        return n

    def count(self, text: str) -> int:
        """Strings of special tokens inside of a text are one token each, as the library has it by default."""
        if len(self) > PIECES:
            self.clear()
        parts = reduce(lambda parts, s: [y for x in parts for y in x.split(s)], self.special, [text])
        return sum(sum(map(self.__getitem__, pretokens.pieces(p))) for p in parts) + len(parts) - 1

    def chunk_map(self, chunk: str) -> ChunkMap:
        """Pieces and special strings never reach over a blank that follows a non-blank, so such a place is always a cut."""
        blank = pretokens.class_table()[np.frombuffer(chunk.encode("utf-32-le", "surrogatepass"), np.uint32)] >= pretokens.BLANK
        at = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1
        return (chunk[: at[0]], self.count(chunk[at[0] : at[-1]]), chunk[at[-1] :]) if len(at) else chunk

    def compose(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        if isinstance(a, str):
            return a + b if isinstance(b, str) else (a + b[0], b[1], b[2])
        if isinstance(b, str):
            return a[0], a[1], a[2] + b
        return a[0], a[1] + self.count(a[2] + b[0]) + b[1], b[2]

    def total(self, whole_text: ChunkMap) -> int:
        """Tokens of a text by its map: nothing comes before and nothing after."""
        return self.count(whole_text) if isinstance(whole_text, str) else self.count(whole_text[0]) + whole_text[1] + self.count(whole_text[2])

    def maps(self, text: str, chunk: int = CHUNK) -> list[ChunkMap]:
        return [self.chunk_map(text[i : i + chunk]) for i in range(0, len(text), chunk)]


def vocabulary_parts(data: bytes) -> tuple[Merges, tuple[str, ...]]:
    import json

    return Merges(ranks_of_json(data)), tuple(t["content"] for t in json.loads(data)["added_tokens"])


@cache
def compiled(data: bytes) -> Counter:
    """With tables compiled here, for use on the driver."""
    merges, special = vocabulary_parts(data)
    return Counter(merges, special, Transducer(merges).compiled(merges.tokens))


_COUNTERS: dict[bytes, Counter] = {}


def counter(data: bytes, tables: Tables | None) -> Counter:
    """One counter a worker process and vocabulary."""
    if data not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[data] = Counter(*vocabulary_parts(data), tables)
    return _COUNTERS[data]


def _columns(maps: list[ChunkMap]) -> list[pa.Array]:
    """head, between (null for a chunk without a cut, which stands in head) and tail."""
    flat = [(m, None, "") if isinstance(m, str) else m for m in maps]
    return [pa.array([f[0] for f in flat], pa.string()), pa.array([f[1] for f in flat], pa.int64()), pa.array([f[2] for f in flat], pa.string())]


def _map_of(head: str, between: int | None, tail: str) -> ChunkMap:
    return head if between is None else (head, between, tail)


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 512, chunk: int = CHUNK) -> DataFrame:
    """Return doc_id, n_bytes, n_tokens, over_limit.

    vocabulary: path of a byte-level BPE .json of the tokenizers library, read on the driver
    (about 1.5 MB) and sent to the executors with the compiled tables. A null text is empty and
    has 0 tokens; repeated rows are counted each; an empty table gives no rows.
    """
    with open(vocabulary, "rb") as f:
        data = f.read()
    tables = compiled(data).machine.tables
    sent = docs.sparkSession.sparkContext.broadcast((data, tables if tables.size <= TABLE_BYTES else None))
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_bytes", "_row", "_chunk", "_last", "head", "between", "tail"]

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = counter(*sent.value)
        for batch in batches:
            taken, place, last, maps = [], [], [], []
            for i, t in enumerate(batch.column(3)):
                t = t.as_py()
                # a text of one chunk is counted right away
                own = machine.maps(t, chunk) if len(t) > chunk else [("", machine.count(t), "")]
                taken += [i] * len(own)
                place += range(len(own))
                last += [len(own) - 1] * len(own)
                maps += own
            row = batch.take(pa.array(taken, pa.int32()))
            yield pa.RecordBatch.from_arrays([*row.columns[:3], pa.array(place, pa.int64()), pa.array(last, pa.int64()), *_columns(maps)], names)

    def composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = counter(*sent.value)
        for batch in batches:
            maps = [reduce(machine.compose, [_map_of(m["head"], m["between"], m["tail"]) for m in own.as_py()]) for own in batch.column(5)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *_columns(maps)], names)

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = counter(*sent.value)
        for batch in batches:
            n = [machine.total(_map_of(h.as_py(), b.as_py(), t.as_py())) for h, b, t in zip(*batch.columns[2:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    schema = f"doc_id {kind}, n_bytes long, _row long, _chunk long, _last long, head string, between long, tail string"
    text = docs.select("doc_id", F.octet_length(whole()).cast("long").alias("n_bytes"), F.monotonically_increasing_id().alias("_row"), whole().alias("text"))
    maps = checkpointed(map_texts(text, mapped, schema))  # counts, and the open ends of chunks
    done = maps.filter("_last = 0").select("doc_id", "n_bytes", F.col("between").alias("n_tokens"))
    top = maps.agg(F.max("_last")).first()[0] or 0
    if top:
        more = maps.filter("_last > 0")
        while top:
            top //= FAN
            parts = more.groupBy("doc_id", "n_bytes", "_row", F.expr(f"_chunk div {FAN}").alias("_chunk"), F.expr(f"_last div {FAN}").alias("_last"))
            more = map_texts(parts.agg(F.sort_array(F.collect_list(F.struct("_chunk", "head", "between", "tail"))).alias("_maps")), composed, schema)  # FAN maps at most
        done = done.unionByName(map_texts(more.select("doc_id", "n_bytes", "head", "between", "tail"), finished, f"doc_id {kind}, n_bytes long, n_tokens long"))
    return done.withColumn("over_limit", F.col("n_tokens") > limit)
