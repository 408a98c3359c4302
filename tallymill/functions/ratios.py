"""Similarity of short strings, 0 to 100, as Arrow functions over columns."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel dynamic programming over the shorter string."""
    if len(a) > len(b):
        a, b = b, a
    places: dict[str, int] = {}
    for i, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    free = full
    for ch in b:
        hit = free & places.get(ch, 0)
        free = (free + hit | free - hit) & full
    return len(a) - free.bit_count()


def ratio(a: str, b: str) -> float:
    """Share of characters in common order; two empty strings are alike."""
    total = len(a) + len(b)
    return 100.0 if not total else 100.0 * 2 * common_length(a, b) / total


def token_sort(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set(a: str, b: str) -> float:
    """Best ratio of the common tokens and each side's own; 0 if a side has no tokens, 100 if one side's tokens are all in the other."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = sorted(x & y), sorted(x - y), sorted(y - x)
    if both and (not left or not right):
        return 100.0
    common, one, other = " ".join(both), " ".join(both + left), " ".join(both + right)
    return max(ratio(one, other), *([ratio(common, one), ratio(common, other)] if both else [0.0]))


def sequence(a: str, b: str) -> float:
    """Share of characters in matching blocks: the longest common stretch, the first of equals in a, then in b; then the same to the left and to the right of it.

    In a b of 200 characters or more one that is over a hundredth of it begins no stretch, but may lengthen one. The sides are not alike.
    """
    places: dict[str, list[int]] = {}
    for j, ch in enumerate(b):
        places.setdefault(ch, []).append(j)
    if len(b) >= 200:
        places = {ch: at for ch, at in places.items() if len(at) <= len(b) // 100 + 1}
    matched, todo = 0, [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        size, i0, j0 = 0, a0, b0
        runs: dict[int, int] = {}  # by its end in b, how long the stretch is that ends at this character of a
        for i in range(a0, a1):
            ends = {}
            for j in places.get(a[i], ()):
                if b0 <= j < b1:
                    n = ends[j] = runs.get(j - 1, 0) + 1
                    if n > size:
                        size, i0, j0 = n, i - n + 1, j - n + 1
            runs = ends
        while i0 > a0 and j0 > b0 and a[i0 - 1] == b[j0 - 1]:
            size, i0, j0 = size + 1, i0 - 1, j0 - 1
        while i0 + size < a1 and j0 + size < b1 and a[i0 + size] == b[j0 + size]:
            size += 1
        if size:
            matched += size
            todo += [(a0, i0, b0, j0), (i0 + size, a1, j0 + size, b1)]
    total = len(a) + len(b)
    return 100.0 * (2.0 * matched / total) if total else 100.0


def _column(score: Callable[[str, str], float]):
    def apply(a: pd.Series, b: pd.Series) -> pd.Series:
        seen: dict[tuple[str, str], float] = {}
        out = []
        for pair in zip(a, b, strict=True):
            if pair[0] is None or pair[1] is None:
                out.append(None)
                continue
            if pair not in seen:
                seen[pair] = score(*pair)
            out.append(seen[pair])
        return pd.Series(out, dtype="float64")

    return F.pandas_udf(apply, DoubleType())


#: Columns of scores; null if a side is null.
token_sort_ratio, token_set_ratio, sequence_ratio = _column(token_sort), _column(token_set), _column(sequence)
