"""Which tokens may stand side by side under byte-pair merges, from ranks alone.

Two adjacent tokens are compatible if no merge across their border would have come before
the merges that made them. An encoding is the exact one if and only if all its adjacent
tokens are compatible, so encoders need no merge loop.
"""

from __future__ import annotations

import base64
import json

MEMO = 1_000_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of bytes in vocabularies that are JSON text."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def ranks_of_json(data: bytes) -> list[bytes]:
    """Tokens in the order of their merges: single bytes first."""
    model, to_byte = json.loads(data)["model"], byte_alphabet()
    merged = [bytes(to_byte[c] for c in ("".join(m) if isinstance(m, list) else m.replace(" ", "", 1))) for m in model["merges"]]
    return [bytes([b]) for b in to_byte.values()] + merged


def ranks_of_tiktoken(data: bytes) -> list[bytes]:
    """Tokens by rank; the rank is the id."""
    rows = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, data.splitlines()))
    if [r for r, _ in rows] != list(range(len(rows))):
        raise ValueError("ranks have gaps")
    return [token for _, token in rows]


class Merges:
    """tokens[i] is the token of rank i; left[i] and right[i] are the tokens that it was merged from (itself for a byte)."""

    def __init__(self, tokens: list[bytes], splits: tuple[list[int], list[int]] | None = None):
        self.tokens = tokens
        self.rank = {t: i for i, t in enumerate(tokens)}
        self.longest = max(map(len, tokens))
        self.pair: dict[tuple[int, int], int] = {}
        self.memo: dict[int, bool] = {}
        self.left, self.right = splits or ([*range(len(tokens))], [*range(len(tokens))])
        if splits:
            self.pair = {(a, b): i for i, (a, b) in enumerate(zip(*splits)) if a != i}
        else:
            self._find_splits()

    def _find_splits(self) -> None:
        for i, token in enumerate(self.tokens):
            for k in range(1, len(token)):
                a, b = self.rank.get(token[:k], i), self.rank.get(token[k:], i)
                if a < i and b < i and self._fits(a, b):
                    self.left[i], self.right[i], self.pair[a, b] = a, b, i
                    break
            else:
                if len(token) > 1:
                    raise ValueError(f"token {i} can't be reached by merges")

    def _fits(self, a: int, b: int) -> bool:
        """Undo the later of the two border tokens' merges until bytes meet; a merge across the border must never come before."""
        before = len(self.tokens)
        while True:
            across = self.pair.get((a, b))
            if across is not None and across < before:
                return False
            split_a = a > b
            for _ in range(2):
                part = self.right[a] if split_a else self.left[b]
                if part != (a if split_a else b):
                    break
                split_a = not split_a
            else:
                return True
            # equal ranks: the one further left is merged first
            if split_a:
                before, a = a, part
            else:
                before, b = b + 1, part

    def fits(self, a: int, b: int) -> bool:
        key = a << 20 | b
        known = self.memo.get(key)
        if known is None:
            if len(self.memo) > MEMO:
                self.memo.clear()
            known = self.memo[key] = self._fits(a, b)
        return known
