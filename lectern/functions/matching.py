"""Matching of whole texts in time that does not grow with their product: many spans at once, matching blocks, edit distance.

Plain functions over Python strings, and Arrow UDFs that call them for a page's row.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

#: Spans of a page that are searched one by one; more are searched in one pass of the text.
FEW = 8
#: Ranges of both texts up to which a suffix automaton finds the longest match; beyond, hashes of windows do.
SMALL = 2_000


def spans_within(text: str | None, spans) -> list[bool]:
    """Which spans a text contains: one pass of the text with an automaton of all spans. Empty spans are in every text."""
    if text is None or spans is None:
        return [False] * (0 if spans is None else len(spans))
    automaton = ahocorasick.Automaton()
    for s in spans:
        if s:
            automaton.add_word(s, s)
    found: set[str] = {""}
    if len(automaton):
        automaton.make_automaton()
        wanted = len(automaton) + 1
        for _, s in automaton.iter(text):
            found.add(s)
            if len(found) == wanted:
                break
    return [s in found if s is not None else False for s in spans]


@F.pandas_udf(T.ArrayType(T.BooleanType()))
def _spans_within(texts: pd.Series, spans: pd.Series) -> pd.Series:
    return pd.Series([spans_within(t, s) if s is not None else None for t, s in zip(texts, spans)])


def found_in(text: Column, spans: Column) -> Column:
    """An array of booleans beside an array of spans. Few spans are searched one by one, which is the same."""
    many = F.size(spans) > FEW
    return F.when(many, _spans_within(F.when(many, text), F.when(many, spans))).otherwise(F.transform(spans, lambda s: F.coalesce(F.contains(text, s), F.lit(False))))


class _Windows:
    """Hashes of windows of any length over the code points of a text."""

    _base = np.uint64(0x9E3779B97F4A7C15)
    _codes = np.random.Generator(np.random.PCG64(5)).integers(1, 1 << 63, 4096, dtype=np.uint64)

    def __init__(self, points: np.ndarray, powers: np.ndarray):
        code = self._codes[points & 4095] * (points.astype(np.uint64) * np.uint64(2) + np.uint64(1))
        self.sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(code * powers[: len(points)], out=self.sums[1:])
        self.powers = powers

    def of(self, lo: int, hi: int, n: int) -> np.ndarray:
        """Of all windows of ``n`` that begin at ``lo`` or after it and end at ``hi`` or before; all scaled to one power."""
        at = np.arange(lo, hi - n + 1)
        return (self.sums[lo + n : hi + 1] - self.sums[lo : hi - n + 1]) * self.powers[len(self.powers) - 1 - at]


def _powers(n: int) -> np.ndarray:
    factors = np.full(n, _Windows._base, np.uint64)
    factors[0] = 1
    return np.multiply.accumulate(factors)


def _automaton(b: str):
    """A suffix automaton of ``b``: transitions, links, lengths, and where each state's first occurrence ends."""
    nxt: list[dict[str, int]] = [{}]
    link, size, ends, last = [-1], [0], [-1], 0
    for i, c in enumerate(b):
        cur = len(nxt)
        nxt.append({})
        size.append(size[last] + 1)
        link.append(0)
        ends.append(i)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if size[p] + 1 == size[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                size.append(size[p] + 1)
                link.append(link[q])
                ends.append(ends[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt, link, size, ends


def _longest_small(a: str, b: str) -> tuple[int, int, int]:
    """(i, j, n) of the longest common substring, the first in ``a``, then in ``b``."""
    nxt, link, size, ends = _automaton(b)
    best = (0, 0, 0)
    state = here = 0
    for i, c in enumerate(a):
        while state and c not in nxt[state]:
            state = link[state]
            here = size[state]
        if c in nxt[state]:
            state = nxt[state][c]
            here += 1
            if here > best[2]:
                best = (i - here + 1, ends[state] - here + 1, here)
    return best


def longest_common(a: str, b: str) -> int:
    """Length of the longest common substring, by a suffix automaton of the shorter text: linear in both."""
    return _longest_small(*((b, a) if len(a) <= len(b) else (a, b)))[2]


def _common(wa: _Windows, wb: _Windows, alo: int, ahi: int, blo: int, bhi: int, n: int) -> np.ndarray:
    """Which windows of ``n`` in a's range are in b's range, too."""
    x, y = wa.of(alo, ahi, n), np.sort(wb.of(blo, bhi, n))
    at = np.searchsorted(y, x)
    return y[np.minimum(at, len(y) - 1)] == x


def matching_blocks(a: str, b: str) -> list[tuple[int, int, int]]:
    """(i, j, n): the longest common substring (the first in ``a``, then in ``b``), then those left and right of it, and so on.

    Large ranges are searched by hashes of windows: a common substring of n contains one of n - 1, so lengths are halved down; what is found is
    compared character by character. Small ranges have a suffix automaton.
    """
    out, stack = [], [(0, len(a), 0, len(b), min(len(a), len(b)))]
    wa = wb = None
    while stack:
        alo, ahi, blo, bhi, most = stack.pop()
        most = min(most, ahi - alo, bhi - blo)
        if not most:
            continue
        if (ahi - alo) + (bhi - blo) <= SMALL:
            i, j, n = _longest_small(a[alo:ahi], b[blo:bhi])
            i, j = i + alo, j + blo
        else:
            if wa is None:
                powers = _powers(max(len(a), len(b)) + 1)
                wa, wb = (_Windows(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32), powers) for t in (a, b))
            low, high = 0, most  # the answer is in [low, high]
            step = 64
            while low < high and low + step <= high and _common(wa, wb, alo, ahi, blo, bhi, low + step).any():
                low += step
                step *= 2
            high = min(high, low + step - 1) if low + step <= high else high
            while low < high:
                n = (low + high + 1) // 2
                low, high = (n, high) if _common(wa, wb, alo, ahi, blo, bhi, n).any() else (low, n - 1)
            n = low
            if n:
                i = alo + int(np.argmax(_common(wa, wb, alo, ahi, blo, bhi, n)))
                j = b.find(a[i : i + n], blo, bhi)
                if j < 0:  # two substrings of one hash
                    i, j, n = _longest_small(a[alo:ahi], b[blo:bhi])
                    i, j = i + alo, j + blo
        if n:
            out.append((i, j, n))
            stack += [(alo, i, blo, j, n), (i + n, ahi, j + n, bhi, n)]
    return sorted(out)


def matching_ratio(a: str | None, b: str | None) -> float | None:
    """Twice the characters in matching blocks by the characters of both; 1 for two empty texts."""
    if a is None or b is None:
        return None
    return 2.0 * sum(n for *_, n in matching_blocks(a, b)) / (len(a) + len(b)) if a or b else 1.0


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity; null for null."""
    return pd.Series([matching_ratio(x, y) for x, y in zip(a, b)], dtype="float64")


#: Edits that are looked for along diagonals before the table is filled by bits.
NEAR = 512


def _near_distance(a: str, b: str, most: int) -> int | None:
    """The distance if it is ``most`` or less: how far each diagonal gets with each number of edits. ``a`` is not longer than ``b``."""
    m, n = len(a), len(b)
    if n - m > most:
        return None
    far: dict[int, int] = {}
    for e in range(most + 1):
        new = {}
        for k in range(max(-e, -m), min(e, n) + 1):  # j - i
            i = 0 if e == 0 else max(far.get(k, -2) + 1, far.get(k - 1, -2), far.get(k + 1, -2) + 1)
            i = min(i, m, n - k)
            if i < 0:
                continue
            step = 32
            while i < m and i + k < n:
                if a[i : i + step] == b[i + k : i + k + step]:
                    i = min(i + step, m, n - k)
                    step *= 2
                elif step > 1:
                    step //= 2
                else:
                    break
            new[k] = i
        if new.get(n - m, -1) >= m:
            return e
        far = new
    return None


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance: along diagonals while edits are few, else by bits: a column of the table is two integers of a bit for each
    character of the shorter text. What both texts begin and end with is left out first, which changes nothing."""
    if len(a) > len(b):
        a, b = b, a
    n = len(a)
    lead = 0
    while lead < n and a[lead] == b[lead]:
        lead += 1
    tail = 0
    while tail < n - lead and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[lead : n - tail], b[lead : len(b) - tail]
    if not a:
        return len(b)
    if (near := _near_distance(a, b, min(NEAR, len(a) // 8))) is not None:
        return near
    places: dict[str, list[int]] = {}
    for i, c in enumerate(a):
        places.setdefault(c, []).append(i)
    masks = {}
    for c, at in places.items():
        bits = np.zeros(len(a) // 8 + 1, np.uint8)
        np.bitwise_or.at(bits, np.array(at) >> 3, np.left_shift(1, np.array(at) & 7).astype(np.uint8))
        masks[c] = int.from_bytes(bits.tobytes(), "little")
    m = len(a)
    full, top = (1 << m) - 1, m - 1
    up, down, distance = full, 0, m
    for c in b:
        eq = masks.get(c, 0)
        x = ((((eq & up) + up) ^ up) | eq | down) & full
        plus, minus = down | (full ^ (x | up)), up & x
        distance += (plus >> top) - (minus >> top)
        plus = (plus << 1 | 1) & full
        up, down = (minus << 1 & full) | (full ^ (x | plus)), plus & x
    return distance


#: Cells of the table up to which Spark's own function takes it.
CELLS = 4_000_000


@F.pandas_udf(T.IntegerType())
def _edit_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else edit_distance(x, y) for x, y in zip(a, b)], dtype="Int32")


def levenshtein(a: Column, b: Column) -> Column:
    """Edit distance in characters: Spark's function for short texts, by bits for long ones, which is the same."""
    long_ = F.length(a).cast("long") * F.length(b) > CELLS
    return F.when(long_, _edit_distance(F.when(long_, a), F.when(long_, b))).otherwise(F.levenshtein(F.when(~long_, a), F.when(~long_, b)))
