"""String similarity and greedy matching as Arrow UDFs.

These have no built-in expression. Each is called on distinct pairs or rows after an
equi-join, never on all pairs of a table.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def indel_ratio(a: str, b: str) -> float:
    """200 * (longest common subsequence) / (both lengths), by bit-parallel rows."""
    if not a and not b:
        return 100.0
    if len(a) > len(b):
        a, b = b, a
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for ch in b:
        u = v & where.get(ch, 0)
        v = (v + u | v - u) & full
    return 200.0 * (len(a) - v.bit_count()) / (len(a) + len(b))


def token_set(a: str, b: str) -> float:
    """The best ratio of the common words with each side's words, whatever their order and repeats."""
    x, y = set(a.split()), set(b.split())
    both, da, db = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not da or not db):
        return 100.0
    join = lambda s, t: f"{s} {t}".strip()
    return max(indel_ratio(both, join(both, da)) if both else 0.0, indel_ratio(both, join(both, db)) if both else 0.0, indel_ratio(join(both, da), join(both, db)))


def token_sort(a: str, b: str) -> float:
    """The ratio of both sides' words in order."""
    return indel_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def partial(a: str, b: str) -> float:
    """The best ratio of the shorter text with a stretch of the longer, of its length or cut off by an end."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0.0 if b else 100.0
    m = len(a)
    if a in b:
        return 100.0
    letters, best = set(a), 0.0
    for start in range(1 - m, len(b)):
        part = b[max(0, start) : start + m]
        if part[-1] in letters or part[0] in letters:  # a stretch whose ends are not in a is no better than a shorter one
            best = max(best, indel_ratio(a, part))
    return best


def weighted(a: str, b: str) -> float:
    """The best of several ratios, each worth less the more it overlooks.

    Texts of like length (one less than half as long again as the other): the ratio, and
    0.95 times that of their words sorted or as sets. Else the ratio, 0.9 times the best
    stretch (0.6 times if one is eight times as long), and that factor and 0.95 times the
    best stretch of words sorted or as sets.
    """
    if not a or not b:
        return 0.0
    times, base = max(len(a), len(b)) / min(len(a), len(b)), indel_ratio(a, b)
    if times < 1.5:
        return max(base, 0.95 * token_sort(a, b), 0.95 * token_set(a, b))
    scale = 0.9 if times < 8 else 0.6
    x, y = set(a.split()), set(b.split())
    words = 100.0 if x & y else partial(" ".join(sorted(a.split())), " ".join(sorted(b.split())))
    return max(base, scale * partial(a, b), 0.95 * scale * words)


def _pairs(f):
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else f(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return run


def ratio(a: Column | str, b: Column | str) -> Column:
    return _pairs(indel_ratio)(a, b)


def token_set_ratio(a: Column | str, b: Column | str) -> Column:
    return _pairs(token_set)(a, b)


def matcher_ratio(a: Column | str, b: Column | str) -> Column:
    """The standard library's ratio, from 0 to 100."""
    return _pairs(lambda x, y: 100.0 * SequenceMatcher(None, x, y).ratio())(a, b)


def weighted_ratio(a: Column | str, b: Column | str) -> Column:
    return _pairs(weighted)(a, b)


def deduped(items: list[str], threshold: float = 90.0) -> list[str]:
    """Items that are neither equal nor similar, in any case, to one kept before."""
    kept: list[str] = []
    for raw in items:
        s = " ".join(raw.split()).strip("\"'")
        if s and not any(s.lower() == k.lower() or indel_ratio(k.lower(), s.lower()) >= threshold for k in kept):
            kept.append(s)
    return kept


def fuzzy_dedupe(c: Column | str, threshold: float = 90.0) -> Column:
    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: [] if x is None else deduped([i for i in x if i is not None], threshold))

    return run(c)


#: Rows whose pairs are held at once.
ROWS = 1 << 10
#: Pairs whose ratios are worked out at once, and the longest texts for which that is done.
AT_ONCE, LETTERS = 1 << 15, 63


def _ratios(x: np.ndarray, y: np.ndarray, na: np.ndarray, nb: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Ratios of rows of code points of lengths na and nb, of which the first `same` are equal."""
    ra, rb = na - same, nb - same
    width = -(-max(int(ra.max()), 1) // 8) * 8
    i = np.arange(width)
    ahead = np.take_along_axis(x, np.minimum(same[:, None] + i, x.shape[1] - 1), axis=1)
    inside = i < ra[:, None]
    full = (np.uint64(1) << ra.astype(np.uint64)) - np.uint64(1)
    v, where = full.copy(), np.zeros((len(x), 8), np.uint8)
    for j in range(int(rb.max())):
        letter = np.take_along_axis(y, np.minimum(same + j, y.shape[1] - 1)[:, None], axis=1)
        where[:, : width // 8] = np.packbits((ahead == letter) & inside, axis=1, bitorder="little")
        u = v & where.view("<u8")[:, 0]
        v = np.where(j < rb, (v + u | v - u) & full, v)
    lcs, both = na - np.bitwise_count(v), na + nb
    return np.where(both > 0, 200.0 * lcs / np.maximum(both, 1), 100.0)


def indel_ratios(a: list[str], b: list[str]) -> np.ndarray:
    """indel_ratio() of each pair: the same rows of bits, for many pairs at once where both texts are short."""
    la, lb = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
    out = np.empty(len(a))
    short = (la <= LETTERS) & (lb <= LETTERS)
    for i in np.flatnonzero(~short):
        out[i] = indel_ratio(a[i], b[i])
    at = np.flatnonzero(short)
    for chosen in (at[i : i + AT_ONCE] for i in range(0, len(at), AT_ONCE)):
        na, nb = la[chosen], lb[chosen]
        width = max(int(na.max()), int(nb.max()), 1)
        x, y = (np.array([t[i] for i in chosen.tolist()], f"U{width}").view(np.uint32).reshape(-1, width) for t in (a, b))
        # what both begin with is in the longest subsequence, and is not looked at again
        less = np.minimum(na, nb)
        same = np.minimum(np.where((x == y).all(axis=1), width, (x != y).argmax(axis=1)), less)
        order = np.argsort(np.maximum(na, nb) - same, kind="stable")
        for some in np.array_split(order, 8):
            out[chosen[some]] = _ratios(x[some], y[some], na[some], nb[some], same[some]) if len(some) else 0
    return out


def greedy_rows(rows: list[tuple[list[str], list[str]]], thresholds: tuple[float, ...]) -> list[list[int]]:
    """tp, fp, fn at each threshold for each row of true and found names: pairs are matched one to one, the most similar first.

    A lower threshold only goes on with the same matches, so they are made once.
    """
    out, start = [], 0
    low = [([t.lower() for t in truth], [f.lower() for f in found]) for truth, found in rows]
    scores = (-indel_ratios([t for x, y in low for t in x for _ in y], [f for x, y in low for _ in x for f in y])).tolist()
    for truth, found in rows:
        n = len(found)
        end = start + len(truth) * n
        mine = scores[start:end]
        used_t, used_f, matched = set(), set(), []
        for p in sorted(range(end - start), key=mine.__getitem__):  # of equal scores the first pair
            i, j = divmod(p, n)
            if i not in used_t and j not in used_f:
                used_t.add(i)
                used_f.add(j)
                matched.append(-mine[p])
        start = end
        counts = []
        for limit in thresholds:
            tp = sum(s >= limit for s in matched)
            counts += [tp, n - tp, len(truth) - tp]
        out.append(counts)
    return out


def greedy_counts(truth: list[str], found: list[str], thresholds: tuple[float, ...]) -> list[int]:
    """greedy_rows() of one row."""
    return greedy_rows([(truth, found)], thresholds)[0]


def greedy_match(truth: Column | str, found: Column | str, thresholds: tuple[float, ...] = (60.0, 70.0, 80.0, 90.0, 100.0)) -> Column:
    """array<int>: tp, fp, fn of each threshold in turn, for two arrays of names."""

    @F.pandas_udf("array<int>")
    def run(t: pd.Series, f: pd.Series) -> pd.Series:
        names = lambda x: [] if x is None else [i for i in x if i is not None]
        rows = [(names(a), names(b)) for a, b in zip(t, f, strict=True)]
        return pd.Series([c for i in range(0, len(rows), ROWS) for c in greedy_rows(rows[i : i + ROWS], thresholds)])

    return run(truth, found)
