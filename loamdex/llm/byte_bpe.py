"""Byte-level BPE encoding and decoding through Aho-Corasick matches.

Bytes are mapped to Latin-1 characters, so one automaton over strings finds every token of
a piece. Starting from the longest match, the encoder goes on wherever the next token is
compatible with the one before (a memoised test) and backtracks otherwise; positions that
turned out dead are never tried again, so each is settled once. The compatible path is the
exact result of the merges.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamdex.llm import pretokens
from loamdex.llm.merges import Merges, ranks_of_tiktoken
from loamdex.llm.textops import whole
from loamdex.llm.workers import map_texts

PIECES, STEP = 400_000, 1 << 20


class Codec(dict):
    """Maps a piece to its ids as little-endian 32-bit integers; keeps those of pieces seen."""

    def __init__(self, merges: Merges):
        super().__init__()
        self.m = merges
        self.automaton = ahocorasick.Automaton()
        for i, token in enumerate(merges.tokens):
            self.automaton.add_word(token.decode("latin-1"), (i, len(token)))
        self.automaton.make_automaton()

    def __missing__(self, piece: str) -> bytes:
        ids = self.encode_piece(piece.encode("utf-8"))
        packed = self[piece] = struct.pack(f"<{len(ids)}I", *ids)
        return packed

    def encode_piece(self, data: bytes) -> list[int]:
        if data in self.m.rank:
            return [self.m.rank[data]]
        n = len(data)
        untried: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, (i, k) in self.automaton.iter(data.decode("latin-1")):
            untried[end - k + 1].append((i, k))  # shorter ones come first
        out: list[int] = []
        dead, at, fits = bytearray(n + 1), 0, self.m.fits
        while at < n:
            options = untried[at]
            while options:
                i, k = options.pop()
                if not dead[at + k] and (not out or fits(out[-1], i)):
                    out.append(i)
                    at += k
                    break
            else:
                if not out:
                    raise ValueError("a byte without a token")
                dead[at] = 1
                at -= len(self.m.tokens[out.pop()])
        return out

    def packed(self, text: str) -> bytes:
        """The ids of a text, little-endian 32-bit integers."""
        if len(self) > PIECES:
            self.clear()
        if len(text) <= STEP:
            return b"".join(map(self.__getitem__, pretokens.pieces(text)))
        return b"".join(b"".join(map(self.__getitem__, pretokens.pieces(part))) for part in pieces_in_steps(text, STEP))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), "<u4").tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.m.tokens.__getitem__, ids))


def pieces_in_steps(text: str, step: int) -> Iterator[str]:
    """Parts of about step characters that end where every pattern piece ends: before a blank after a non-blank."""
    begin = 0
    while begin < len(text):
        end = begin + step
        while end < len(text) and not (text[end] == " " and not text[end - 1].isspace()):
            end += 1
        yield text[begin:end]
        begin = end


@cache
def compiled(data: bytes) -> Codec:
    return Codec(Merges(ranks_of_tiktoken(data)))


def _send(docs: DataFrame, vocabulary: str):
    with open(vocabulary, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def encode_documents(docs: DataFrame, vocabulary: str, keep_ids: bool = False) -> DataFrame:
    """Encode each whole text and decode it again.

    Return doc_id, n_tokens, ids_sha256 (ids as little-endian 32-bit), decoded_sha256 and,
    with keep_ids, ids. vocabulary: path of a rank file, read on the driver (about 1 MB) and
    sent to the executors. A null text is empty: no ids, the digests of no bytes. Repeated
    rows are encoded each; an empty table gives no rows.
    """
    sent = _send(docs, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = compiled(sent.value)
        for batch in batches:
            n, digests, decoded, kept = [], [], [], []
            for t in batch.column(1):
                packed = codec.packed(t.as_py())
                ids = np.frombuffer(packed, "<u4").tolist()
                decoded.append(hashlib.sha256(codec.decode(ids)).hexdigest())
                digests.append(hashlib.sha256(packed).hexdigest())
                n.append(len(ids))
                if keep_ids:
                    kept.append(ids)
            out = [batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            yield pa.RecordBatch.from_arrays([*out, pa.array(kept, pa.list_(pa.int32()))] if keep_ids else out, [*names, "ids"] if keep_ids else names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return map_texts(docs.select("doc_id", whole().alias("text")), run, schema)


def decode_ids(encoded: DataFrame, vocabulary: str, ids: str = "ids") -> DataFrame:
    """Add decoded (binary): the bytes of each row's ids; null for null ids."""
    sent = _send(encoded, vocabulary)

    @F.pandas_udf("binary")
    def decoded(batch):
        codec = compiled(sent.value)
        return batch.map(lambda x: None if x is None else codec.decode(x))

    return encoded.withColumn("decoded", decoded(F.col(ids)))
