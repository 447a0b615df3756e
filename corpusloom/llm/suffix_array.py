"""Suffix arrays by induced sorting, and permuted longest common prefixes.

Suffixes are classified as larger (L) or smaller (S) than their successor; the leftmost smaller (LMS) substrings are
sorted by induction and named; where names repeat, the shorter text of names is sorted recursively; all suffixes are then
induced from the sorted LMS suffixes. With few symbols, induction works on whole waves of a bucket in numpy: what a
wave puts into its own bucket is the next wave, in the order a scan would have put it.
"""

from __future__ import annotations

import numpy as np


def _types(t: np.ndarray) -> np.ndarray:
    """True for S suffixes; the last symbol is the unique smallest."""
    n = len(t)
    d = np.sign(t[1:].astype(np.int64) - t[:-1])
    at = np.where(d != 0, np.arange(n - 1), n - 1)
    at = np.minimum.accumulate(at[::-1])[::-1]  # the next place where neighbours differ
    return np.append(np.append(d, 1)[at] > 0, True)


def _deal(p: np.ndarray, c: np.ndarray, into: dict) -> None:
    """Appends the places p to the lists of their buckets c, in order."""
    if len(p) == 1:
        into.setdefault(int(c[0]), []).append(p)
        return
    order = np.argsort(c, kind="stable")
    p, c = p[order], c[order]
    ends = [0, *(np.flatnonzero(c[1:] != c[:-1]) + 1).tolist(), len(p)]
    for b, x, y in zip(c[ends[:-1]].tolist(), ends, ends[1:]):  # noqa: B905
        into.setdefault(b, []).append(p[x:y])


def _induce(t: np.ndarray, is_s: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """All suffixes, induced from the LMS suffixes in the given order."""
    symbols = np.unique(t).tolist()
    if symbols[-1] < 1 << 16:
        t = t.astype(np.uint16)  # sorted by digits
    larger_at, smaller_at = ~is_s, is_s.copy()
    smaller_at[-1] = False  # of the place before the first, -1, both are false
    seeds: dict[int, list] = {}
    _deal(lms, t[lms], seeds)
    larger: dict[int, list] = {}
    done_l: dict[int, list] = {}

    def spread(wave: np.ndarray, b: int, into: dict, s: bool) -> np.ndarray:
        p = wave - 1
        p = p[(smaller_at if s else larger_at)[p]]
        if not len(p):
            return p
        c = t[p]
        same = c == b
        n = np.count_nonzero(same)
        if not n:
            _deal(p, c, into)
            return p[:0]
        if n == len(p):
            return p
        other = ~same
        _deal(p[other], c[other], into)
        return p[same]

    for b in symbols:
        out = done_l[b] = []
        wave = np.concatenate(larger.pop(b)) if b in larger else None
        while wave is not None and len(wave):
            out.append(wave)
            wave = spread(wave, b, larger, False)
        if b in seeds:
            spread(np.concatenate(seeds[b]), b, larger, False)
    smaller: dict[int, list] = {}
    parts = []
    for b in reversed(symbols):
        out = []
        wave = np.concatenate(smaller.pop(b)) if b in smaller else None
        while wave is not None and len(wave):
            out.append(wave)
            wave = spread(wave, b, smaller, True)
        ls = np.concatenate(done_l[b]) if done_l[b] else np.zeros(0, np.int64)
        if len(ls):
            spread(ls[::-1], b, smaller, True)
        ss = np.concatenate(out)[::-1] if out else np.zeros(0, np.int64)
        if b == symbols[0]:
            ss = np.array([len(t) - 1])  # the end, that no other suffix induces
            spread(ss, b, smaller, True)
        parts += [ss, ls]
    return np.concatenate(parts[::-1])


def _induce_list(t: list[int], is_s: list[bool], lms: list[int], size: int) -> list[int]:
    """As _induce, one suffix at a time: for texts of many symbols."""
    counts = [0] * size
    for c in t:
        counts[c] += 1
    heads, tails, at = [], [], 0
    for x in counts:
        heads.append(at)
        at += x
        tails.append(at - 1)
    sa, ends = [-1] * len(t), tails[:]
    for i in reversed(lms):
        c = t[i]
        sa[ends[c]] = i
        ends[c] -= 1
    for k in range(len(sa)):
        i = sa[k] - 1
        if i >= 0 and not is_s[i]:
            c = t[i]
            sa[heads[c]] = i
            heads[c] += 1
    for k in range(len(sa) - 1, -1, -1):
        i = sa[k] - 1
        if i >= 0 and is_s[i]:
            c = t[i]
            sa[tails[c]] = i
            tails[c] -= 1
    return sa


def _names(t: np.ndarray, lms: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The rank of each LMS substring in the sorted order; equal ones share it. lms is in text order, order is sorted."""
    ends = np.empty(len(t), np.int64)
    ends[lms] = np.append(lms[1:], len(t) - 1)
    a, b = order[:-1], order[1:]
    length = ends[a] - a
    same = length == ends[b] - b
    live, d = np.flatnonzero(same), 0
    while len(live):
        hit = t[a[live] + d] == t[b[live] + d]
        same[live[~hit]] = False
        live = live[hit]
        d += 1
        live = live[length[live] >= d]
    rank = np.empty(len(t), np.int64)
    rank[order] = np.concatenate([[0], np.cumsum(~same)])
    return rank[lms]


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Suffix array of integers whose last symbol is the unique smallest."""
    t = np.asarray(t, np.int64)
    if len(t) < 3:
        return np.argsort(t, kind="stable")
    is_s = _types(t)
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    _, dense = np.unique(t, return_inverse=True)
    size = int(dense.max()) + 1
    if size * 8 < len(t):
        induce = lambda x: _induce(t, is_s, x)
    else:
        tl, sl = dense.tolist(), is_s.tolist()

        def induce(x):
            x = np.asarray(x)
            return np.array(_induce_list(tl, sl, x[np.argsort(dense[x], kind="stable")].tolist(), size), np.int64)

    leftmost = np.zeros(len(t), bool)
    leftmost[lms] = True
    if len(lms) > 1:
        rough = induce(lms)
        order = rough[leftmost[rough]]
        names = _names(t, lms, order)
        order = lms[suffix_array(names)] if names.max() + 1 < len(lms) else lms[np.argsort(names, kind="stable")]
    else:
        order = lms
    return induce(order)


def permuted_lcp(t: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(phi, plcp): each suffix's predecessor in the order (-1: none), and the length of their common prefix.

    Where the symbols before two neighbours agree, the value is its left neighbour's less one; only the other
    (irreducible) places are compared, eight bytes at a time. t holds bytes."""
    n = len(t)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    i = np.arange(n)
    inner = (phi > 0) & (i > 0)
    reducible = np.zeros(n, bool)
    reducible[inner] = t[i[inner] - 1] == t[phi[inner] - 1]
    reducible[1:] &= phi[:-1] >= 0
    places = np.flatnonzero(~reducible)
    plcp = np.zeros(n, np.int64)
    padded = np.concatenate([np.asarray(t, np.uint8), np.zeros(16, np.uint8)])
    words = np.ndarray((n + 8,), "<u8", padded.tobytes(), strides=(1,))
    live = places[phi[places] >= 0]
    length = np.zeros(len(live), np.int64)
    act = np.arange(len(live))
    while len(act):
        a, b = live[act] + length[act], phi[live[act]] + length[act]
        room = n - np.maximum(a, b)
        x = words[np.minimum(a, n)] ^ words[np.minimum(b, n)]
        low = (x & (~x + np.uint64(1))).astype(np.float64)  # the lowest set bit, a power of two
        step = np.where(x == 0, 8, np.log2(np.maximum(low, 1)).astype(np.int64) // 8)
        step = np.minimum(step, np.maximum(room, 0))
        length[act] += step
        act = act[(step == 8) & (room > 8)]
    plcp[live] = length
    at = np.maximum.accumulate(np.where(reducible, -1, i))
    return phi, np.where(reducible, plcp[at] - (i - at), plcp)


def repeated_windows(texts: list[bytes], weights: list[int], width: int) -> list[np.ndarray]:
    """For each distinct text, True at the starts of strings of `width` bytes that stand elsewhere too, in these texts or
    in an equal copy of the text (weight over 1)."""
    starts = np.cumsum([0, *(len(x) + 1 for x in texts)])
    # symbols: the end 0, the separator 1, bytes from 2 on; they need more than 8 bits, common prefixes only the bytes
    wide = np.empty(starts[-1] + 1, np.int64)
    narrow = np.frombuffer(b"\xff".join(texts) + b"\xff\xff", np.uint8).copy()  # 0xff is in no UTF-8 text
    wide[:] = narrow.astype(np.int64) + 2
    wide[starts[1:] - 1] = 1
    wide[-1] = 0
    sa = suffix_array(wide)
    phi, plcp = permuted_lcp(narrow, sa)
    hit = np.flatnonzero((plcp >= width) & (phi >= 0))
    marked = np.zeros(len(wide), bool)
    marked[hit] = marked[phi[hit]] = True
    out = []
    for k, x in enumerate(texts):
        m = marked[starts[k] : starts[k] + max(0, len(x) - width + 1)].copy()
        if weights[k] > 1:
            m[:] = True
        out.append(m)
    return out
