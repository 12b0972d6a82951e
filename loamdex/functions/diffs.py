"""Differences of two texts as runs of kept, removed and added text."""

from __future__ import annotations

import re
from itertools import groupby

import numpy as np
import pandas as pd

from loamdex.functions.text import arrow

#: Table cells up to which characters are compared, and up to which words are; beyond, the middle is replaced as a whole.
MOST_CELLS_CHARS, MOST_CELLS_WORDS = 2_500_000, 6_000_000


def _lengths(a: list[str], b: list[str]) -> np.ndarray:
    """Longest common subsequences of all suffixes, row by row from the end."""
    table = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    codes = {u: i for i, u in enumerate(dict.fromkeys(a + b))}
    row_b = np.array([codes[u] for u in b], np.int64)
    for i in range(len(a) - 1, -1, -1):
        below = table[i + 1]
        best = np.where(row_b == codes[a[i]], below[1:] + 1, below[:-1])
        # a cell is at least its right neighbour: running maximum from the right
        table[i, :-1] = np.maximum.accumulate(best[::-1])[::-1]
    return table


def _aligned(a: list[str], b: list[str]) -> list[tuple[str, str]]:
    table, i, j, out = _lengths(a, b), 0, 0, []
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i] == b[j]:
            out.append(("eq", a[i]))
            i, j = i + 1, j + 1
        elif j == len(b) or (i < len(a) and table[i + 1, j] >= table[i, j + 1]):
            out.append(("del", a[i]))
            i += 1
        else:
            out.append(("ins", b[j]))
            j += 1
    return out


def text_diff(a: str, b: str) -> list[dict]:
    """Runs (type eq, del or ins; text); removals come before additions."""
    head = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    tail = next((i for i, (x, y) in enumerate(zip(a[head:][::-1], b[head:][::-1])) if x != y), min(len(a), len(b)) - head)
    mid_a, mid_b = a[head : len(a) - tail], b[head : len(b) - tail]
    units_a, units_b = list(mid_a), list(mid_b)
    if len(units_a) * len(units_b) > MOST_CELLS_CHARS:
        units_a, units_b = re.findall(r"\s+|\S+", mid_a), re.findall(r"\s+|\S+", mid_b)
    middle = [("del", mid_a), ("ins", mid_b)] if len(units_a) * len(units_b) > MOST_CELLS_WORDS else _aligned(units_a, units_b)
    every = [("eq", a[:head]), *middle, ("eq", a[len(a) - tail :] if tail else "")]
    runs = groupby((x for x in every if x[1]), key=lambda x: x[0])
    return [{"type": kind, "text": "".join(t for _, t in own)} for kind, own in runs]


@arrow("array<struct<type:string,text:string>>")
def diff(a: pd.Series, b: pd.Series) -> pd.Series:
    """Arrow. text_diff of two columns; null if either is."""
    return pd.Series([text_diff(x, y) if x is not None and y is not None else None for x, y in zip(a, b)])
