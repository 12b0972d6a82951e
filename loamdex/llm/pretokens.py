"""Cuts a text where the byte-level BPE pattern does, by classes of characters.

The pattern is 's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+ .
A cut depends on the classes of the two characters beside it and of one more, so the
finite-state scan becomes a few array comparisons.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import tiktoken

OTHER, LETTER, NUMBER, BLANK, SPACE = 0, 1, 2, 3, 4
#: What the pattern splits off after an apostrophe.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


@cache
def class_table() -> np.ndarray:
    """Classes of all code points, asked of the tokenizer library's own pattern engine (Unicode versions differ)."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    table = np.zeros(0x110000, np.uint8)
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
        matched = tiktoken.Encoding(f"class {kind}", pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        found = matched.decode_bytes(matched.encode_ordinary(every)).decode("utf-8")
        table[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
    table[ord(" ")] = BLANK
    return table


def starts(text: str) -> list[int]:
    """Where the pieces of a non-empty text start; the first is 0."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = class_table()[codes]
    n, blank = len(kind), kind >= BLANK
    cut = np.ones(n, bool)
    p, q, p_blank, q_blank = kind[:-1], kind[1:], blank[:-1], blank[1:]
    ends_run = np.zeros(n - 1, bool)
    ends_run[:-1] = ~blank[2:]
    cut[1:] = np.where(q_blank, ~p_blank | ends_run, np.where(p_blank, p != BLANK, p != q))
    for i in np.flatnonzero(codes == 39).tolist():
        if i and kind[i - 1] in (OTHER, BLANK):
            continue
        after = text[i + 1 : i + 3]
        end = next((e for e in ENDINGS if after.startswith(e)), None)
        if end:
            cut[i + 1 : i + 1 + len(end)] = False
            cut[i + 1 + len(end) : i + 2 + len(end)] = True
    return np.flatnonzero(cut).tolist()


def pieces(text: str) -> list[str]:
    if not text:
        return []
    at = starts(text)
    return [text[a:b] for a, b in zip(at, [*at[1:], len(text)])]
