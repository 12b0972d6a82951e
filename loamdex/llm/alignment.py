"""Which tokens of two tokenizers cover the same bytes of a text, and how often over the corpus.

Each tokenizer's token ends are a bitset over the bytes of the text, packed into 64-bit words. Their
AND holds the cuts that both share; set bits counted up to a cut (rank) give the token that ends there in
either one. Two neighbouring cuts bound a group: one range of tokens on each side, and every pair over a
group is a link.

Texts are encoded once; what a document needs later (its distinct linked id pairs and how often it has
each) is stored packed. Pairs are counted inside tasks before they are shuffled. Counts come back to the
documents in two ways that always run both: the HOT most frequent pairs, whose size is fixed, are sent
to all tasks; pairs beyond them are joined by pair and summed by document. Frequent pairs so never meet
in one task, and nothing that is sent grows with the corpus.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from loamdex.llm.textops import checkpointed
from loamdex.llm.workers import map_texts, releasing

#: Pairs that are sent to all tasks: 17 bytes each.
HOT = 1_000_000
#: Groups that are spelled out at a time.
GROUPS = 100_000
#: Links of a group that are spelled out one by one; larger groups multiply the counts of their distinct ids.
SPELLED = 4_096
#: Distinct pairs that a task keeps before it passes their counts on.
KEPT = 2_000_000
#: Stretches of text whose ids a task keeps.
STRETCHES = 400_000
_SHIFT = 32


class Vocabulary:
    """Encodes texts that begin with a space, given as lists of stretches to encode on their own; knows the bytes of each id.

    between: where stretches may be cut (nowhere: None). Ids of stretches met before are kept, up to STRETCHES of them.
    """

    def __init__(self, tokens: list[bytes], encode, between: re.Pattern | None = None):
        self.tokens, self._encode, self._between = tokens, encode, between
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self._kept: dict[str, bytes] = {}

    def encode(self, text: str) -> np.ndarray:
        if self._between is None:
            return np.asarray(self._encode([text])[0], np.int64)
        stretches, kept = self._between.split(text), self._kept
        if len(kept) > STRETCHES:
            kept.clear()
        new = list(set(stretches).difference(kept))
        for stretch, ids in zip(new, self._encode(new) if new else ()):
            kept[stretch] = array("i", ids).tobytes()
        return np.frombuffer(b"".join(map(kept.__getitem__, stretches)), np.intc).astype(np.int64)

    def joined(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


def _byte_of_character() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 stands for itself, the other bytes for what follows U+0100, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


#: Fixed value: the pattern that byte-level pre-tokenizers cut texts by.
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@cache
def byte_level(data: str) -> Vocabulary:
    """A tokenizers file of a byte-level vocabulary. Its special strings are plain text.

    Where the file has nothing but merges, and ids in their order, they are ranks, and tiktoken encodes by them to
    the same ids in a seventh of the time; any other file is encoded by tokenizers.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer, byte = Tokenizer.from_str(data), _byte_of_character()
    tokenizer.no_truncation()
    tokenizer.no_padding()
    tokenizer.encode_special_tokens = True
    tokens = [b""] * tokenizer.get_vocab_size()
    for token, i in tokenizer.get_vocab().items():
        tokens[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
    ranks = _ranks(json.loads(data), tokens)
    if ranks is None:
        return Vocabulary(tokens, lambda texts: [tokenizer.encode(t, add_special_tokens=False).ids for t in texts])
    import tiktoken

    encoding = tiktoken.Encoding("ranks", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
    return Vocabulary(tokens, lambda texts: list(map(encoding.encode_ordinary, texts)))


def _ranks(file: dict, tokens: list[bytes]) -> dict[bytes, int] | None:
    model, cut = file["model"], file.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not file.get("normalizer") and not any(model.get(k) for k in ("dropout", "unk_token", "byte_fallback", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix"))
    if not plain or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
        return None
    pairs, ids = (x if isinstance(x, list) else x.split(" ") for x in model["merges"]), model["vocab"]
    special = {x["id"] for x in file.get("added_tokens") or ()}
    in_order = all(ids.get(a + b) == 256 + i for i, (a, b) in enumerate(pairs)) and len(model["merges"]) + 256 == len(set(ids.values()) - special)
    return {t: i for i, t in enumerate(tokens) if i not in special} if in_order else None


@cache
def pieces(data: bytes) -> Vocabulary:
    """A sentencepiece model with byte fallback; it puts a space before each text. If no piece has a space behind another character, texts are cut there; spaces at the end stay with what is before them."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_proto=data)
    tokens = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i in range(model.get_piece_size()) for p in (model.id_to_piece(i),)]
    across = any(re.search(r"[^ ] ", t.decode("utf-8", "replace")) for t in tokens)
    return Vocabulary(tokens, lambda texts: model.encode([t[1:] for t in texts], num_threads=1), None if across else re.compile(r"(?<=\S)(?= +[^ ])"))


def bitset(ends: np.ndarray, n: int) -> np.ndarray:
    """Bits ends of n, in 64-bit words."""
    bits = np.zeros((n // 64 + 1) * 64, np.uint8)
    bits[ends] = 1
    return np.packbits(bits, bitorder="little").view("<u8")


def selected(words: np.ndarray) -> np.ndarray:
    """Places of the set bits."""
    return np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little"))


def rank(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Set bits up to and with each place."""
    before = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))
    word, bit = at >> 6, (at & 63).astype(np.uint64)
    return before[word] + np.bitwise_count(words[word] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(63) - bit)))


@cache
def _spelling(n_a: int, n_b: int) -> np.ndarray:
    """`id,` and `id|` of the ids of a, `id,` and `id;` of those of b."""
    return np.array([f"{i}{end}" for n, ends in ((n_a, ",|"), (n_b, ",;")) for end in ends for i in range(n)], object)


class Alignment:
    """Two encodings of the same bytes, cut where tokens of both end: group i has the tokens of a from a_cuts[i] to a_cuts[i + 1], and those of b alike."""

    def __init__(self, a: np.ndarray, b: np.ndarray, a_lengths: np.ndarray, b_lengths: np.ndarray):
        self.a, self.b, self.sizes = a, b, (len(a_lengths), len(b_lengths))
        a_ends, b_ends = np.cumsum(a_lengths[a]), np.cumsum(b_lengths[b])
        n = int(a_ends[-1]) if len(a) else 0
        a_set, b_set = bitset(a_ends, n), bitset(b_ends, n)
        cuts = selected(a_set & b_set)
        self.a_cuts = np.concatenate(([0], rank(a_set, cuts)))
        self.b_cuts = np.concatenate(([0], rank(b_set, cuts)))

    @property
    def groups(self) -> int:
        return len(self.a_cuts) - 1

    @property
    def links(self) -> int:
        return int(np.dot(np.diff(self.a_cuts), np.diff(self.b_cuts)))

    def spelled(self) -> Iterator[str]:
        """`a1,a2|b1;a3|b2,b3`: ids of each group, in parts of so many groups that memory stays small."""
        for first in range(0, self.groups, GROUPS):
            yield ";" * (first > 0) + self._spelled(self.a_cuts[first : first + GROUPS + 1], self.b_cuts[first : first + GROUPS + 1])

    def _spelled(self, a_cuts: np.ndarray, b_cuts: np.ndarray) -> str:
        a, b = self.a[a_cuts[0] : a_cuts[-1]], self.b[b_cuts[0] : b_cuts[-1]]
        a_cuts, b_cuts = a_cuts - a_cuts[0], b_cuts - b_cuts[0]
        # a token of a comes after all tokens of b in earlier groups, one of b after all of a up to its own group
        a_at = np.arange(len(a)) + np.repeat(b_cuts[:-1], np.diff(a_cuts))
        b_at = np.arange(len(b)) + np.repeat(a_cuts[1:], np.diff(b_cuts))
        n_a, n_b = self.sizes
        a_ends, b_ends, out = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64), np.empty(len(a) + len(b), np.int64)
        a_ends[a_cuts[1:] - 1] = b_ends[b_cuts[1:] - 1] = 1
        out[a_at], out[b_at] = a + n_a * a_ends, 2 * n_a + b + n_b * b_ends
        return "".join(_spelling(n_a, n_b)[out].tolist())[:-1]

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct linked id pairs as a << 32 | b, ascending, and the links of each."""
        a_n, b_n = np.diff(self.a_cuts), np.diff(self.b_cuts)
        large = a_n * b_n > SPELLED
        per_a = np.repeat(np.where(large, 0, b_n), a_n)  # links of each token of a
        total = int(per_a.sum())
        within = np.arange(total) - np.repeat(np.cumsum(per_a) - per_a, per_a)
        b_at = np.repeat(np.repeat(self.b_cuts[:-1], a_n), per_a) + within
        keys, n = np.unique(np.repeat(self.a, per_a) << _SHIFT | self.b[b_at], return_counts=True)
        if not large.any():
            return keys, n
        found, counts = [keys], [n]
        for i in np.flatnonzero(large):
            x, x_n = np.unique(self.a[self.a_cuts[i] : self.a_cuts[i + 1]], return_counts=True)
            y, y_n = np.unique(self.b[self.b_cuts[i] : self.b_cuts[i + 1]], return_counts=True)
            found.append((x[:, None] << _SHIFT | y[None, :]).ravel())
            counts.append(np.outer(x_n, y_n).ravel())
        return summed(np.concatenate(found), np.concatenate(counts))


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sum of the counts of each."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def align(text: str | None, a: Vocabulary, b: Vocabulary) -> Alignment | None:
    """The alignment of a (over a space and the text) with b (which adds that space); None for null and empty texts and where the tokens' bytes differ from the text's."""
    if not text:
        return None
    wanted = (" " + text).encode()
    a_ids, b_ids = a.encode(" " + text), b.encode(" " + text)
    return Alignment(a_ids, b_ids, a.lengths, b.lengths) if a.joined(a_ids) == wanted == b.joined(b_ids) else None


def _packed(x: np.ndarray, narrow: str, wide: str) -> bytes:
    return x.astype(narrow if not len(x) or int(x.max()) <= np.iinfo(narrow).max else wide).tobytes()


def _unpacked(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{len(data) // n}").astype(np.int64) if n else np.zeros(0, np.int64)


def _described(found: Alignment | None, spelled: bool) -> tuple:
    """Numbers of tokens, groups and links, digest of the groups, and the distinct pairs, packed: ids of a, ids of b, links."""
    if found is None:
        return (0, 0, 0, 0, "", 0, b"", b"", b"", "")
    keys, times = found.pairs()
    digest, parts = hashlib.sha256(), []
    for part in found.spelled():
        digest.update(part.encode())
        if spelled:
            parts.append(part)
    packed = (_packed(keys >> _SHIFT, "<u2", "<u4"), _packed(keys & 0xFFFFFFFF, "<u2", "<u4"), _packed(times, "<u2", "<u8"))
    return (len(found.a), len(found.b), found.groups, found.links, digest.hexdigest(), len(keys), *packed, "".join(parts))


_SCHEMA = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, _n long, _a binary, _b binary, _times binary"


def alignments(docs: DataFrame, byte_level_file: str, piece_file: str, spelled: bool = False) -> DataFrame:
    """Each text's alignment: doc_id, n_a, n_b, n_groups, n_links, groups_sha256; packed distinct pairs (_n, _a, _b, _times); with spelled, groups too.

    The vocabulary files are read on the driver (a few MB) and sent to the executors. Null and empty texts,
    and those that a tokenizer doesn't give back byte by byte, have zeros, and '' as groups and digest. Long
    texts are encoded whole. Repeated rows are aligned each; other columns are ignored; an empty table gives no rows.
    """
    with open(byte_level_file, encoding="utf-8") as f, open(piece_file, "rb") as g:
        sent = docs.sparkSession.sparkContext.broadcast((f.read(), g.read()))
    types = T._parse_datatype_string(_SCHEMA + ", groups string" * spelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = byte_level(sent.value[0]), pieces(sent.value[1])
        schema = to_arrow_schema(types)
        for batch in batches:
            rows = [_described(align(t.as_py(), a, b), spelled) for t in batch.column(1)]
            columns = [pa.array([row[i] for row in rows], f.type) for i, f in enumerate(schema)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *schema.names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_texts(docs.select("doc_id", "text"), run, f"doc_id {kind}, {_SCHEMA}" + ", groups string" * spelled)


def _pairs_of(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, pairs, links of each) of the rows of a batch that have any."""
    n, a, b, times = (batch.column(batch.schema.get_field_index(c)) for c in ("_n", "_a", "_b", "_times"))
    for i in range(batch.num_rows):
        k = n[i].as_py()
        if k:
            yield i, _unpacked(a[i].as_py(), k) << _SHIFT | _unpacked(b[i].as_py(), k), _unpacked(times[i].as_py(), k)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair (a << 32 | b), n_docs: in how many rows of aligned the pair is linked; best: no pair of the same a has more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, waiting, size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0
        for batch in batches:
            found = [pairs for _, pairs, _ in _pairs_of(batch)]
            waiting += found
            size += sum(map(len, found))
            if size > KEPT:
                keys, counts = _added(keys, counts, waiting)
                waiting, size = [], 0
                if len(keys) > KEPT:
                    yield from _in_batches(keys, counts)
                    keys, counts = keys[:0], counts[:0]
        yield from _in_batches(*_added(keys, counts, waiting))

    counted = aligned.select("_n", "_a", "_b", "_times").mapInArrow(releasing(run), "pair long, n long")
    summed_up = counted.groupBy("pair").agg(F.sum("n").alias("n_docs"))
    of_a = Window.partitionBy(F.shiftright("pair", _SHIFT))
    return summed_up.withColumn("best", F.col("n_docs") == F.max("n_docs").over(of_a))


def _added(keys: np.ndarray, counts: np.ndarray, more: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    new = np.concatenate([np.zeros(0, np.int64), *more])
    return summed(np.concatenate((keys, new)), np.concatenate((counts, np.ones(len(new), np.int64))))


def _in_batches(keys: np.ndarray, counts: np.ndarray, rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(keys), rows):
        yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + rows]), pa.array(counts[i : i + rows])], ["pair", "n"])


class _Frequent:
    """Counts of the pairs that were sent."""

    def __init__(self, keys: np.ndarray, docs: np.ndarray, best: np.ndarray):
        self.keys, self.docs, self.best = keys, docs, best

    def split(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the pairs are frequent, and their places here."""
        if not len(self.keys):
            return np.zeros(len(pairs), bool), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.keys, pairs), len(self.keys) - 1)
        known = self.keys[at] == pairs
        return known, at[known]


def aligned_documents(docs: DataFrame, byte_level_file: str, piece_file: str, hot: int | None = None) -> DataFrame:
    """The columns of alignments, and n_best, count_sum: links whose pair is in as many documents as any pair of its a, and the sum of the links' counts.

    hot: pairs that are sent to all tasks (HOT). Rows without tokens have zeros. The rest as in alignments.
    """
    spark, hot = docs.sparkSession, HOT if hot is None else hot
    aligned = checkpointed(alignments(docs, byte_level_file, piece_file).withColumn("_row", F.monotonically_increasing_id()))
    counts = checkpointed(pair_counts(aligned))
    most = counts.orderBy(F.desc("n_docs"), "pair").limit(hot).toArrow()
    keys, n_docs, best = (most.column(c).to_numpy(zero_copy_only=False) for c in ("pair", "n_docs", "best"))
    order = np.argsort(keys)
    sent = spark.sparkContext.broadcast((keys[order], n_docs[order], best[order]))
    if len(keys):
        beyond = (F.col("n_docs") < int(n_docs[-1])) | ((F.col("n_docs") == int(n_docs[-1])) & (F.col("pair") > int(keys[-1])))
        rare = counts.where(beyond)
    else:
        rare = counts

    def with_frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = _Frequent(*sent.value)
        for batch in batches:
            n_best, count_sum = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for i, pairs, times in _pairs_of(batch):
                known, at = frequent.split(pairs)
                n_best[i] = times[known][frequent.best[at]].sum()
                count_sum[i] = np.dot(times[known], frequent.docs[at])
            names = [*_KEPT_COLUMNS, "_row"]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(n_best), pa.array(count_sum)], [*names, "n_best", "count_sum"])

    def rare_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = _Frequent(*sent.value)
        for batch in batches:
            rows, found, often = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            row_ids = batch.column(batch.schema.get_field_index("_row")).to_numpy()
            for i, pairs, times in _pairs_of(batch):
                known, _ = frequent.split(pairs)
                if not known.all():
                    found.append(pairs[~known])
                    often.append(times[~known])
                    rows.append(np.full(len(found[-1]), row_ids[i]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (rows, found, often)], ["_row", "pair", "times"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    numbers = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, _row long, n_best long, count_sum long"
    near = aligned.mapInArrow(releasing(with_frequent), f"doc_id {kind}, {numbers}")
    far = aligned.select("_row", "_n", "_a", "_b", "_times").mapInArrow(releasing(rare_pairs), "_row long, pair long, times long").join(rare, "pair")
    far = far.groupBy("_row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_best"), F.sum(F.col("times") * F.col("n_docs")).alias("_sum"))
    out = near.join(far, "_row", "left")
    more = {c: F.col(c) + F.coalesce(d, F.lit(0)) for c, d in (("n_best", "_best"), ("count_sum", "_sum"))}
    return out.withColumns(more).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


_KEPT_COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
