"""String and set similarity.

Sets are native.  A ratio is 100 * 2 * LCS / (length + length); the longest common subsequence runs
bit-parallel (Hyyro 2004) on whole-string masks.  Ratios, Jaro-Winkler and the best partial window are
Arrow functions: those of one projection share one pass through Python.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of different tokens; 0 if both are empty."""
    n = F.size(F.array_union(a, b))
    return F.when(n > 0, F.size(F.array_intersect(a, b)) / n).otherwise(0.0)


def shared(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def coverage(a: Column, b: Column, of: Column) -> Column:
    return shared(a, b) / F.greatest(F.lit(1), F.size(of))


def _sorted(tokens: Column) -> Column:
    return F.array_join(F.array_sort(tokens), " ")


def token_sort_ratio(a: Column, b: Column) -> Column:
    """Of token arrays."""
    return ratio(_sorted(a), _sorted(b))


def _lcs(a: str, b: str) -> int:
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for ch in b:
        u = v & where.get(ch, 0)
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def indel(a: str, b: str) -> float:
    n = len(a) + len(b)
    return 100.0 if a == b else 200.0 * _lcs(a, b) / n


def token_set(a: str, b: str) -> float:
    """Best ratio of the shared tokens, and of those with either side's others; 0 if a side has none."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, only_a, only_b = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if both and (not only_a or not only_b):
        return 100.0
    more_a, more_b = f"{both} {only_a}".strip(), f"{both} {only_b}".strip()
    return max(indel(more_a, more_b), *((indel(both, more_a), indel(both, more_b)) if both else (0.0,)))


def partial(a: str, b: str) -> float:
    """Best ratio of the shorter string with a window of its length in the longer (shorter at the ends); 0 if one is empty."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0.0
    m = len(a)
    best = 0.0
    have = set(a)
    for i in range(1 - m, len(b)):
        w = b[max(0, i) : i + m]
        if w and (w[-1] in have or w[0] in have):
            best = max(best, 200.0 * _lcs(a, w) / (m + len(w)))
    return best


def jaro_winkler_pair(a: str, b: str, weight: float = 0.1) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used = [False] * len(b)
    first = []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == ch:
                used[j] = True
                first.append(ch)
                break
    if not first:
        return 0.0
    second = [ch for ch, u in zip(b, used, strict=True) if u]
    swaps = sum(x != y for x, y in zip(first, second, strict=True)) // 2
    m = len(first)
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + prefix * weight * (1 - jaro) if jaro > 0.7 else jaro


@lru_cache(maxsize=1 << 16)
def _known(f: Callable[[str, str], float], a: str, b: str) -> float:
    return f(a, b)


def of_pairs(f: Callable[[str, str], float], x: pa.Array, y: pa.Array) -> pa.Array:
    """``f`` of each pair; a worker keeps its last results for short texts, as records often share theirs."""
    sides = zip(x.to_pylist(), y.to_pylist(), strict=True)
    return pa.array([_known(f, p, q) if len(p) + len(q) <= 256 else f(p, q) for p, q in ((p or "", q or "") for p, q in sides)], pa.float64())


def _arrow(f: Callable[[str, str], float], a: Column, b: Column) -> Column:
    def each(x: pa.Array, y: pa.Array) -> pa.Array:
        return of_pairs(f, x, y)

    return F.arrow_udf(each, "double")(a, b)


def token_set_ratio(a: Column, b: Column) -> Column:
    """Of space-joined tokens."""
    return _arrow(token_set, a, b)


def ratio(a: Column, b: Column) -> Column:
    """Normalised Indel similarity, 0 to 100; two empty strings are equal."""
    return _arrow(indel, a, b)


def partial_ratio(a: Column, b: Column) -> Column:
    return _arrow(partial, a, b)


def jaro_winkler(a: Column, b: Column) -> Column:
    return _arrow(jaro_winkler_pair, a, b)
