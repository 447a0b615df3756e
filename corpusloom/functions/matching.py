"""The matcher ratio of two strings (2M/T over matching blocks), on suffix automata, with bounds that Spark computes.

Blocks are found as the matcher of the standard library finds them: the longest common block of two ranges, of those the
first in a and then in b, then both sides of it. Characters that are popular in b (over 1 % of at least 200) start no block,
but blocks grow over them.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stemming import common_subsequence

#: Characters that the bound tells apart; all others count as one.
LETTERS = " etaoinshrdlucmfwygpbvk"


class Automaton:
    """The substrings of b[lo:hi]; popular characters are places of their own, which nothing matches."""

    def __init__(self, b: str, lo: int, hi: int, popular: frozenset):
        self.go, self.link, self.size, self.end = [{}], [-1], [0], [-1]
        last = 0
        for j in range(lo, hi):
            c = j if b[j] in popular else b[j]
            last = self._extend(last, c, j)

    def _state(self, go: dict, size: int, end: int, link: int) -> int:
        self.go.append(go)
        self.size.append(size)
        self.end.append(end)
        self.link.append(link)
        return len(self.go) - 1

    def _extend(self, last: int, c, j: int) -> int:
        new = self._state({}, self.size[last] + 1, j, 0)
        p = last
        while p >= 0 and c not in self.go[p]:
            self.go[p][c] = new
            p = self.link[p]
        if p < 0:
            return new
        q = self.go[p][c]
        if self.size[q] != self.size[p] + 1:
            twin = self._state(dict(self.go[q]), self.size[p] + 1, self.end[q], self.link[q])
            while p >= 0 and self.go[p].get(c) == q:
                self.go[p][c] = twin
                p = self.link[p]
            self.link[q] = q = twin
        self.link[new] = q
        return new

    def longest(self, a: str, lo: int, hi: int) -> tuple[int, int, int]:
        """Size and starts of the longest block of a[lo:hi], the first in a, then in b; size 0 without one."""
        best, at, to = 0, lo, -1
        state = size = 0
        for i in range(lo, hi):
            c = a[i]
            while state and c not in self.go[state]:
                state = self.link[state]
                size = self.size[state]
            if c in self.go[state]:
                state, size = self.go[state][c], size + 1
            else:
                size = 0
            if size > best:
                best, at, to = size, i - size + 1, self.end[state] - size + 1
        return best, at, to


def matched(a: str, b: str, enough: int | None = None) -> int:
    """Characters in matching blocks; with `enough` it stops as soon as it is known whether there are as many."""
    popular = frozenset(c for c, n in Counter(b).items() if n > len(b) // 100 + 1) if len(b) >= 200 else frozenset()
    total, ranges = 0, [(0, len(a), 0, len(b))]
    most = min(len(a), len(b))  # what ranges can still match
    while ranges:
        if enough is not None and (total >= enough or total + most < enough):
            break
        alo, ahi, blo, bhi = ranges.pop()
        if alo >= ahi or blo >= bhi:
            continue
        most -= min(ahi - alo, bhi - blo)
        size, i, j = Automaton(b, blo, bhi, popular).longest(a, alo, ahi)
        if not size:
            i, j = alo, blo
        end_i, end_j = i + size, j + size
        while i > alo and j > blo and a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
        while end_i < ahi and end_j < bhi and a[end_i] == b[end_j]:
            end_i, end_j = end_i + 1, end_j + 1
        if end_i > i:
            total += end_i - i
            ranges += [(alo, i, blo, j), (end_i, ahi, end_j, bhi)]
            most += min(i - alo, j - blo) + min(ahi - end_i, bhi - end_j)
    return total


def ratio(a: str | None, b: str | None) -> float:
    """2M/T; null counts as empty, and two empty strings are alike."""
    a, b = a or "", b or ""
    if a == b:
        return 1.0
    return 2.0 * matched(a, b) / (len(a) + len(b))


def above(a: str, b: str, least: float) -> bool:
    """Whether the ratio is above least. Matching blocks stand in the same order in both, so they are no longer than the longest
    common subsequence, which is found by bits; blocks are looked for only where that is long enough."""
    if a == b:
        return least < 1.0
    size = len(a) + len(b)
    enough = int(least * size / 2)
    while 2.0 * enough / size <= least:
        enough += 1
    return common_subsequence(a, b) >= enough and matched(a, b, enough) >= enough


def above_column(a, b, c, d, least: float) -> Column:
    """Whether the ratios of a to b and of c to d are above least; those of a to b come first. Null counts as empty."""

    def run(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([above(x or "", y or "", least) and above(z or "", w or "", least) for x, y, z, w in zip(a, b, c, d, strict=True)], dtype="bool")

    return F.pandas_udf(run, T.BooleanType())(a, b, c, d)


def _ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def ratio_column(a, b) -> Column:
    return F.pandas_udf(_ratios, T.DoubleType())(a, b)


def profile(text: Column) -> Column:
    """Length, and how often each of LETTERS stands in it."""
    size = F.octet_length(text)  # letters are of one byte
    return F.array(F.length(text), *[size - F.octet_length(F.replace(text, F.lit(c), F.lit(""))) for c in LETTERS])


def bound(a: Column, b: Column) -> Column:
    """No ratio of texts with these profiles is above it: what both have of each letter, and of the rest, is matched at most."""
    both, left, right = F.lit(0), a[0], b[0]
    for i in range(1, len(LETTERS) + 1):
        both, left, right = both + F.least(a[i], b[i]), left - a[i], right - b[i]
    total = a[0] + b[0]
    return F.when(total == 0, F.lit(1.0)).otherwise(F.lit(2.0) * (both + F.least(left, right)) / total)


def band(text: Column, least: float) -> Column:
    """Texts whose ratio is above least are in the same or in neighbouring bands of length; empty ones have their own."""
    step = (2.0 - least) / least
    return F.when(F.length(text) == 0, F.lit(-9)).otherwise(F.floor(F.log(F.length(text).cast("double")) / F.log(F.lit(step))).cast("int"))
