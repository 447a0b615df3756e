"""Language-model scores: a causal self-attention model over subword ids, trained and run in numpy.

The model reads windows of WINDOW ids; windows overlap by CONTEXT ids and score only what follows those, so each id is
scored once, in batches with a causal mask. The frequent ids are classes of their own; the others share one class and are
told apart by their corpus frequencies after the id before, so a score is a probability over all ids and the end. The
logits start from the smoothed frequency of a class after the id before it; attention learns what the wider context adds.
Classes lie in groups of alike ones: a class has the probability of its group times its own within it.

Corpus statistics cover all training documents: counts of words (hashed to 64 bits) for the base score, of ids and of
pairs of ids. Texts are split into ids once; the ids are written. The model's weights are fitted on all training
documents: copies of the model are fitted where the written ids lie, a task for each part of the scan, and averaged after
each round; each document is read in one of the rounds, whose number grows with the ids. Words are split at ASCII white
space, A-Z lower-cased. Very long texts are taken whole; extra columns are left out.

Null and empty texts are a single end. Repeated rows are scored one by one; null ids count as the empty text for the
held-out split. Without training documents the model is uniform over ids.
"""

from __future__ import annotations

import contextlib
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import subword
from .common import give_back, materialize, settle, table
from .quality_classifier import held_out

WINDOW, CONTEXT = 32, 8
WIDTH, CLASSES, INPUTS = 16, 256, 4096
GROUPS = 16  # of alike classes
#: Rounds of averaging at least, and training ids for each, so that copies are averaged as often for each id at any size.
ROUNDS, PER_ROUND = 2, 1 << 26
#: Models that the driver adds up at most; more are added up in tasks first.
MODELS = 24
STEP = 128  # windows of a training step
#: Pairs of ids within the last class whose counts are sent to every task (the others' are joined), and what each pair's
#: count is discounted by.
PAIRS, DISCOUNT = 1 << 18, 0.75
START = 1 << 19  # stands before the first id of a text
#: Frequent words whose counts are sent to every task; the others' counts are joined.
FREQUENT = 1 << 16
BATCH = 256
BLOCK = 1 << 21  # bytes of text or ids held as arrays at once, or one text
SCORED = 1 << 19  # bytes of ids that are scored at once, or one document
ROWS = 1000  # documents that Spark sends to a task at once (10,000 by default, which are 50 MB of ids in the JVM and again here)
HELD = 1 << 20  # counts of words or pairs that a task holds before it adds them up
SENT = 1 << 16  # counts that a task gives out at once
END_WORD = 0  # stands for the end among word hashes


def _times(x: np.ndarray, m: np.ndarray) -> np.ndarray:
    """x @ m as one product of two matrices."""
    return (x.reshape(-1, x.shape[-1]) @ m).reshape(*x.shape[:-1], m.shape[1])


class Attention:
    """One head of causal self-attention over summed id and place vectors; predicts the next class."""

    NAMES = ("emb", "pos", "q", "k", "v", "out", "bias")

    def __init__(self, inputs: int = INPUTS + 2, width: int = WIDTH, classes: int = CLASSES, window: int = WINDOW, seed: int = 5, prior: np.ndarray | None = None):
        self.prior = np.zeros((inputs, classes), np.float32) if prior is None else prior
        self._across = None
        rng = np.random.default_rng(seed)
        normal = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0] if len(s) > 1 else 1)).astype(np.float32)
        self.p = {"emb": rng.standard_normal((inputs, width)).astype(np.float32) * 0.3, "pos": rng.standard_normal((window, width)).astype(np.float32) * 0.1, "q": normal(width, width), "k": normal(width, width), "v": normal(width, width), "out": normal(width, classes) * np.float32(0.1), "bias": np.zeros(classes, np.float32)}
        self.mask = np.triu(np.full((window, window), -1e9, np.float32), 1)
        self.scale = np.float32(1 / np.sqrt(width))

    def forward(self, ids: np.ndarray, keep: int = 0):
        """Log probabilities of the class after each place from keep on; and what the gradient needs."""
        p, n = self.p, ids.shape[1]
        x = p["emb"][ids] + p["pos"][:n]
        q, k, v = _times(x, p["q"]), _times(x, p["k"]), _times(x, p["v"])
        a = (q @ k.transpose(0, 2, 1)) * self.scale + self.mask[:n, :n]
        a -= a.max(-1, keepdims=True)
        np.exp(a, out=a)
        a /= a.sum(-1, keepdims=True)
        h = (x + a @ v)[:, keep:]
        return self.logs(h, ids[:, keep:]), (x, q, k, v, a, h)

    def logs(self, h: np.ndarray, inp: np.ndarray) -> np.ndarray:
        """Log probabilities of all classes."""
        z = _times(h, self.p["out"])
        z += np.take(self.prior, inp, axis=0)
        z += self.p["bias"]
        return _log_shares(z)

    def target_logs(self, ids: np.ndarray, target: np.ndarray, keep: int = 0) -> np.ndarray:
        """As forward, of the target classes alone; sums are shifted only where exp overflows or vanishes."""
        p, (b, n), width = self.p, ids.shape, self.p["q"].shape[0]
        x = np.take(p["emb"], ids, axis=0)
        x += p["pos"][:n]
        seen = x if not keep else np.ascontiguousarray(x[:, keep:])
        q = (seen.reshape(-1, width) @ (p["q"] @ p["k"].T * self.scale)).reshape(seen.shape)
        a = q @ np.ascontiguousarray(x.transpose(0, 2, 1))
        a += self.mask[keep:n, :n]
        if a.max() > 60:
            a -= a.max(-1, keepdims=True)
        np.exp(a, out=a)
        h = (a @ x).reshape(-1, width)
        h /= (a.reshape(-1, n) @ np.ones(n, np.float32))[:, None]
        h = h @ p["v"]
        h += seen.reshape(-1, width)
        return self.logs_of(h, ids[:, keep:].ravel(), target.ravel()).reshape(b, n - keep)

    def logs_of(self, h: np.ndarray, inp: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Log probability of each target class; after ready()."""
        return _target_logs(self.start, h, self.p["out"], inp, target)

    def ready(self) -> Attention:
        """Adds up what target_logs() takes for each input; after the weights have changed."""
        self.start = self.prior + self.p["bias"]
        return self

    def gradient(self, ids: np.ndarray, target: np.ndarray, weight: np.ndarray, drawn: np.ndarray | None = None, share: np.ndarray | None = None) -> dict[str, np.ndarray]:
        """Of the mean negative log probability of target (places of weight 0 are left out).

        drawn: the classes that the softmax covers beside the target (by default all), each standing for `share` classes."""
        p, (b, n) = self.p, ids.shape
        width = p["emb"].shape[1]
        flat = lambda m: m.reshape(-1, m.shape[-1])
        mixed = p["q"] @ p["k"].T * self.scale
        x = np.take(p["emb"], ids, axis=0)
        x += p["pos"][:n]
        x_t = np.ascontiguousarray(x.transpose(0, 2, 1))
        y = _times(x, mixed)
        a = y @ x_t
        a += self.mask[:n, :n]
        if a.max() > 60 or np.einsum("bii->bi", a).min() < -60:  # a row holds its own place, so no sum vanishes
            a -= a.max(-1, keepdims=True)
        np.exp(a, out=a)
        a /= (flat(a) @ np.ones(n, a.dtype)).reshape(b, n, 1)
        c = a @ x
        h = flat(x) + flat(c) @ p["v"]
        inp = ids.ravel()
        dh, g = self.head(h, inp, target.ravel(), (weight.ravel() / max(weight.sum(), 1)).astype(h.dtype), drawn, share)
        dc = (dh @ p["v"].T).reshape(b, n, width)
        ds = dc @ x_t
        ds -= np.einsum("bij,bij->bi", ds, a)[..., None]
        ds *= a
        dy = flat(ds @ x)
        g["v"] = flat(c).T @ dh
        m = flat(x).T @ dy * self.scale
        g["q"], g["k"] = m @ p["k"], m.T @ p["q"]
        dx = (dh + dy @ mixed.T).reshape(b, n, width)
        dx += ds.transpose(0, 2, 1) @ y
        dx += a.transpose(0, 2, 1) @ dc
        g["pos"] = np.zeros_like(p["pos"])
        g["pos"][:n] = dx.sum(0)
        g["emb"] = _summed(inp, flat(dx), len(p["emb"]))
        return g

    def head(self, h: np.ndarray, inp: np.ndarray, t: np.ndarray, w: np.ndarray, drawn: np.ndarray | None, share: np.ndarray | None) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """The softmax's part of the gradient: of h, and of its own weights. w: weights of places, summing to one."""
        p, across = self.p, self.across()
        cols = np.arange(len(p["bias"])) if drawn is None else drawn
        out = np.ascontiguousarray(p["out"].T)
        out_t, out = np.take(out, t, axis=0), out[cols]
        z_t = np.einsum("ij,ij->i", h, out_t) + self.prior[inp, t] + p["bias"][t]
        z = out @ h.T  # a row for each class
        z += np.take(across[cols], inp, axis=1)
        z += (p["bias"][cols] if share is None else p["bias"][cols] + np.log(share).astype(z.dtype))[:, None]
        place = np.full(len(p["bias"]), -1)
        place[cols] = np.arange(len(cols))
        own = np.flatnonzero(place[t] >= 0)
        z[place[t[own]], own] = -1e9  # the target counts once
        if z.max() > 60 or z_t.max() > 60 or z_t.min() < -60:
            top = np.maximum(z.max(0), z_t)
            z -= top
            z_t = z_t - top
        np.exp(z, out=z)
        e_t = np.exp(z_t)
        scale = w / (z.sum(0) + e_t)
        z *= scale
        dz_t = e_t * scale - w
        g = {"out": _summed(t, h * dz_t[:, None], len(p["bias"])).T, "bias": np.bincount(t, dz_t, len(p["bias"])).astype(z.dtype)}
        g["out"][:, cols] += (z @ h).T
        g["bias"][cols] += z.sum(1)
        dh = z.T @ out
        dh += dz_t[:, None] * out_t
        return dh, g

    def across(self) -> np.ndarray:
        """The prior with a row for each class."""
        if self._across is None or self._across[0] is not self.prior:
            self._across = self.prior, np.ascontiguousarray(self.prior.T)
        return self._across[1]


def groups_of(prior: np.ndarray, groups: int) -> np.ndarray:
    """Groups of near sizes of classes that follow alike inputs: halves along the main direction of the prior, again and again."""
    x = prior.T.astype(np.float64)
    x = x - x.mean(1, keepdims=True)
    parts = [np.arange(len(x))]
    while len(parts) < groups:
        halves = []
        for part in parts:
            y = x[part] - x[part].mean(0)
            _, axes = np.linalg.eigh(y @ y.T)
            order = part[np.argsort(axes[:, -1], kind="stable")]
            halves += [order[: len(order) // 2], order[len(order) // 2 :]]
        parts = [np.sort(h) for h in halves if len(h)]
        if len(parts) == len(x):
            break
    of = np.zeros(len(x), np.int64)
    for i, part in enumerate(parts):
        of[part] = i
    return of


class Grouped(Attention):
    """As Attention, with a softmax over groups of alike classes and one over the classes of a group: a place needs the
    groups and the classes of one group, and probabilities still cover all classes. Both start from the prior."""

    NAMES = (*Attention.NAMES, "top", "top_bias")

    def __init__(self, *args, groups: int = GROUPS, of: np.ndarray | None = None, **options):
        super().__init__(*args, **options)
        self.of = groups_of(self.prior, groups) if of is None else of
        order = np.argsort(self.of, kind="stable")
        self.members = np.split(order, np.flatnonzero(np.diff(self.of[order])) + 1)
        n, most, kind = len(self.members), max(map(len, self.members)), self.prior.dtype
        self.place = np.zeros(len(self.of), np.int64)
        self.within = np.full((n, len(self.prior), most), -1e9, kind)  # groups are filled up with classes that never follow
        for i, m in enumerate(self.members):
            self.place[m] = np.arange(len(m))
            self.within[i, :, : len(m)] = self.prior[:, m]
        peak = self.within.max(2)
        self.above = np.ascontiguousarray((np.log(np.exp(self.within - peak[..., None]).sum(2)) + peak).T)
        self.p |= {"top": np.zeros((len(self.p["q"]), n), np.float32), "top_bias": np.zeros(n, np.float32)}

    def _filled(self, m: np.ndarray) -> np.ndarray:
        """Columns by class as groups * rows * places."""
        out = np.zeros((len(self.members), len(m), self.within.shape[2]), m.dtype)
        out[self.of, :, self.place] = m.T
        return out

    def logs(self, h, inp):
        p = self.p
        top = _log_shares(_times(h, p["top"]) + self.above[inp] + p["top_bias"])
        out = np.empty((*top.shape[:-1], len(self.of)), top.dtype)
        for i, m in enumerate(self.members):
            out[..., m] = _log_shares(_times(h, p["out"][:, m]) + self.within[i, inp, : len(m)] + p["bias"][m]) + top[..., i, None]
        return out

    def ready(self):
        self.start_top = self.above + self.p["top_bias"]
        self.start = self.within + self._filled(self.p["bias"][None])
        self.outs = self._filled(self.p["out"])
        return self

    def _sorted(self, t: np.ndarray):
        """Group of each target, places by it, and where groups start among them."""
        of = self.of[t]
        order = np.argsort(of.astype(np.uint16), kind="stable")
        return of, order, np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(self.members)))]).tolist()

    def logs_of(self, h, inp, target):
        of, order, at = self._sorted(target)
        out = _target_logs(self.start_top, h, self.p["top"], inp, of)
        hs, start = np.take(h, order, axis=0), self.start.reshape(-1, self.start.shape[2])
        more = [hs[a:b] @ m for m, (a, b) in zip(self.outs, pairwise(at), strict=True)]
        out[order] += _target_logs(start, np.concatenate(more), None, (of * len(self.prior) + inp)[order], self.place[target[order]])
        return out

    def head(self, h, inp, t, w, drawn=None, share=None):
        p = self.p
        of, order, at = self._sorted(t)
        z = _less_target(np.take(self.above, inp, axis=0) + h @ p["top"] + p["top_bias"], of, w)
        g = {"top": h.T @ z, "top_bias": z.sum(0)}
        dh = z @ p["top"].T
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        hs, outs = np.ones((len(h), h.shape[1] + 1), h.dtype), self._filled(np.vstack([p["out"], p["bias"]]))
        np.take(h, order, axis=0, out=hs[:, :-1], mode="clip")
        z = np.take(self.within.reshape(-1, outs.shape[2]), (of * len(self.prior) + inp)[order], axis=0)
        for out, (a, b) in zip(outs, pairwise(at), strict=True):
            z[a:b] += hs[a:b] @ out
        z = _less_target(z, self.place[t[order]], w[order])
        more, d = np.empty_like(hs), np.zeros_like(outs)
        for i, (a, b) in enumerate(pairwise(at)):
            np.matmul(hs[a:b].T, z[a:b], out=d[i])
            np.matmul(z[a:b], outs[i].T, out=more[a:b])
        d = d[self.of, :, self.place].T
        g["out"], g["bias"] = d[:-1], d[-1]
        dh += np.take(more, back, axis=0)[:, :-1]
        return dh, g


def _log_shares(z: np.ndarray) -> np.ndarray:
    z -= z.max(-1, keepdims=True)
    z -= np.log(np.exp(z).sum(-1, keepdims=True))
    return z


def _target_logs(start: np.ndarray, h: np.ndarray, out: np.ndarray | None, inp: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log shares of the targets among start[inp] + h @ out (without out, h itself); sums are shifted only where exp overflows
    or vanishes."""
    z = np.take(start, inp, axis=0)
    z += h if out is None else h @ out
    got = z[np.arange(len(z)), target]
    with np.errstate(over="ignore"):
        np.exp(z, out=z)
    total = z @ np.ones(z.shape[1], z.dtype)
    odd = np.flatnonzero(~((total > 1e-30) & (total < 1e30)))
    total[odd] = 1
    logs = got - np.log(total)
    if len(odd):
        z = start[inp[odd]] + (h[odd] if out is None else h[odd] @ out)
        top = z.max(-1)
        logs[odd] = got[odd] - top - np.log(np.exp(z - top[:, None]).sum(-1))
    return logs


def _less_target(z: np.ndarray, target: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Shares less one at the target, times w: the gradient of z."""
    if z.max() > 60 or z[np.arange(len(z)), target].min(initial=0) < -60:  # a row holds its target, so no sum vanishes
        z -= z.max(1, keepdims=True)
    np.exp(z, out=z)
    z *= (w / (z @ np.ones(z.shape[1], z.dtype)))[:, None]
    z[np.arange(len(z)), target] -= w
    return z


def _summed(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by their place among n."""
    order = np.argsort(at.astype(np.uint16) if n <= 1 << 16 else at, kind="stable")
    at, out = at[order], np.zeros((n, rows.shape[1]), rows.dtype)
    start = np.flatnonzero(np.concatenate([at[:1] >= 0, at[1:] != at[:-1]]))
    out[at[start]] = np.add.reduceat(rows[order], start, axis=0)
    return out


def windows(at: np.ndarray, window: int = WINDOW, context: int = CONTEXT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows over texts at[i]..at[i+1]: first place, first scored place and end, all in the flat array."""
    n, step = np.diff(at), window - context
    count = np.where(n <= window, n > 0, 1 + -(-(n - window) // step))
    of = np.repeat(np.arange(len(n)), count)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    first = at[of] + nth * step
    return first, np.where(nth > 0, first + context, first), np.minimum(first + window, at[of + 1])


def scored(model: Attention, inputs: np.ndarray, target: np.ndarray, at: np.ndarray, batch: int = BATCH) -> np.ndarray:
    """Natural log probability of each place's target class. inputs: what is read at each place, targets: what follows."""
    out = np.zeros(len(target), np.float32)
    first, start, end = windows(at)
    model.ready()
    for part in (np.flatnonzero(start == first), np.flatnonzero(start > first)):
        keep = CONTEXT if len(part) and start[part[0]] > first[part[0]] else 0
        part = part[np.argsort((end - first)[part], kind="stable")]
        for i in range(0, len(part), batch):
            w = part[i : i + batch]
            n = int((end[w] - first[w]).max())
            place = np.minimum(first[w][:, None] + np.arange(n), len(target) - 1)
            got = model.target_logs(inputs[place], target[place[:, keep:]], keep)
            real = first[w][:, None] + np.arange(keep, n) < end[w][:, None]
            out[place[:, keep:][real]] = got[real]
    return out


class Vocabulary:
    """Classes, inputs and probabilities within the last class of all ids (the last id is the end), from corpus counts.

    Within the last class, discounted counts of pairs are used; what the discount leaves of an id's total goes to the
    ids' own frequencies, so the probabilities after each id sum to one. Pairs that aren't held here are joined later."""

    def __init__(self, counts: np.ndarray):
        order = np.lexsort((np.arange(len(counts)), -counts))
        self.cls = np.full(len(counts), CLASSES - 1, np.int32)
        self.cls[order[: CLASSES - 1]] = np.arange(min(CLASSES - 1, len(order)))
        self.inp = np.full(len(counts), INPUTS, np.int32)
        self.inp[order[:INPUTS]] = np.arange(min(INPUTS, len(order)))
        rest = self.cls == CLASSES - 1
        self.rest = rest
        self.share = np.where(rest, (counts + 1) / (counts + 1)[rest].sum(), 0.0)
        self.keep_pairs(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0))

    def keep_pairs(self, keys: np.ndarray, n: np.ndarray, ids: np.ndarray, totals: np.ndarray, given: np.ndarray | None = None, more: bool = False) -> None:
        """keys, n: pairs held (id before << 20 | id) and their counts; ids, totals: counts of all pairs after an id, and
        given: their discounted sums, where other pairs than those held count (more) too."""
        self.more = more
        order = np.argsort(keys)
        self.keys, self.kept = keys[order], np.maximum(n[order] - DISCOUNT, 0)
        size = len(self.share) + 1
        self.total, taken = np.zeros(size), np.bincount(self._slot(self.keys >> 20), self.kept, size)
        self.total[self._slot(ids)] = totals
        if given is not None:
            taken[self._slot(ids)] = given
        self.left = np.where(self.total > 0, self.total - taken, 1.0)
        self.total = np.where(self.total > 0, self.total, 1.0)

    def _slot(self, ids: np.ndarray) -> np.ndarray:
        return np.where(ids == START, len(self.share), ids)

    def within(self, ids: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Log10 probability of each id within its class after the id before (START before the first); without what
        counts of pairs that aren't held add."""
        return self.looked_up(ids, before)[0]

    def looked_up(self, ids: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As within; and places and keys of pairs within the last class whose counts, if any, aren't held here."""
        out, at = np.zeros(len(ids)), np.flatnonzero(self.rest[ids])
        b, i = before[at].astype(np.int64), ids[at]
        key, slot = b << 20 | i, self._slot(b)
        if len(self.keys):
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            held = self.keys[place] == key
            n = np.where(held, self.kept[place], 0)
        else:
            held, n = np.zeros(len(at), bool), np.zeros(len(at))
        out[at] = np.log10((n + self.left[slot] * self.share[i]) / self.total[slot])
        far = ~held if self.more else np.zeros(len(at), bool)
        return out, at[far], key[far]


def prior_logits(pairs: np.ndarray, smooth: float = 20.0) -> np.ndarray:
    """Log frequency of each class (column) after each input (row), smoothed by that of the class."""
    whole = pairs.sum(0) + 0.5
    share = whole / whole.sum()
    return np.log((pairs + smooth * share) / (pairs.sum(1, keepdims=True) + smooth)).astype(np.float32)


def pair_counts(found: DataFrame, vocabulary: Vocabulary) -> tuple[np.ndarray, DataFrame | None]:
    """How often a class follows an input; and key and gain (log10, what its count adds to a place's score) of the pairs
    of the last class that the vocabulary isn't given, if there are any.

    found: pairs of ids, key = id before << 20 | id. The vocabulary gets the pairs from the highest counts down to a
    limit that at most PAIRS reach; the totals and what is given to pairs cover all."""
    spark = found.sparkSession
    ids = spark.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(zip(vocabulary.inp, vocabulary.cls, strict=True))] + [(START, INPUTS + 1, 0)], "id int, inp int, cls int")
    split = found.where("kind = 'pair'").selectExpr("key", "cast(key >> 20 as int) as a", "cast(key & 1048575 as int) as b", "n")
    of = F.broadcast(ids)  # the tokenizer's ids, whatever the corpus
    both = split.join(of.select(F.col("id").alias("a"), "inp"), "a").join(of.select(F.col("id").alias("b"), "cls"), "b")
    got = both.groupBy("inp", "cls").agg(F.sum("n").alias("n")).toArrow()  # at most inputs * classes rows
    out = np.zeros((INPUTS + 2, CLASSES))
    out[got["inp"].to_numpy(), got["cls"].to_numpy()] = got["n"].to_numpy()
    rest = both.where(F.col("cls") == CLASSES - 1)
    level = F.floor(F.log2("n") * 8)
    limit, seen, more = None, 0, False
    for r in sorted(rest.groupBy(level.alias("level")).count().collect(), reverse=True):  # at most 8 * 63 rows
        seen += r["count"]
        if more := seen > PAIRS:
            break
        limit = r.level
    if not seen:
        return out, None
    kept = rest.where(F.lit(False) if limit is None else level >= limit).select("key", "n").toArrow()  # at most PAIRS rows
    totals = rest.groupBy("a").agg(F.sum("n").alias("n"), F.sum(F.col("n") - DISCOUNT).alias("given")).toArrow()  # at most the tokenizer's ids
    vocabulary.keep_pairs(*(c.to_numpy().astype(t) for c, t in ((kept["key"], np.int64), (kept["n"], float), (totals["a"], np.int64), (totals["n"], float), (totals["given"], float))), more)
    if not more:
        return out, None
    after = totals["a"].to_numpy().astype(np.int64)
    left = spark.createDataFrame(list(zip(after.tolist(), vocabulary.left[vocabulary._slot(after)].tolist(), strict=True)), "a int, l double")
    share = spark.createDataFrame([(i, float(vocabulary.share[i])) for i in np.flatnonzero(vocabulary.rest).tolist()], "b int, s double")
    rare = rest if limit is None else rest.where(level < limit)
    return out, rare.join(F.broadcast(left), "a").join(F.broadcast(share), "b").select("key", F.log10(1 + (F.col("n") - DISCOUNT) / (F.col("l") * F.col("s"))).alias("gain"))


def _with_ends(ids: np.ndarray, at: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    return np.insert(ids, at[1:], end), at + np.arange(len(at))


def _shifted(inp: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The input at each place: that of the id before, or a start mark."""
    out = np.empty(len(inp), np.int64)
    out[1:] = inp[:-1]
    out[at[:-1]] = INPUTS + 1
    return out


def _before(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The id before each place, or START."""
    out = np.append(START, ids[:-1]).astype(np.int64)
    out[at[:-1]] = START
    return out


def _hashes(words: pa.Array) -> np.ndarray:
    got = np.fromiter(map(xxhash.xxh3_64_intdigest, words.cast(pa.binary()).to_numpy(zero_copy_only=False)), np.uint64, len(words))
    return np.where(got == END_WORD, np.uint64(1), got).view(np.int64)


def _lower(texts: pa.Array):
    """Runs of about BLOCK bytes of texts, or one text, lower-cased; only one run is copied at a time."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // BLOCK
    for a, b in pairwise([0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(texts)] if len(texts) else []):
        yield pc.ascii_lower(pc.fill_null(pa.concat_arrays([texts.slice(a, b - a)]).cast(pa.large_string()), ""))  # casts read slices from their start


def _words(texts: pa.Array):
    """Of runs of texts: distinct hashes, index of each word in them, and where texts start among words."""
    for part in _lower(texts):
        lists = pc.ascii_split_whitespace(part)
        coded = lists.flatten().dictionary_encode()
        at = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
        yield _real(coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), at)


def _real(distinct: pa.Array, index: np.ndarray, at: np.ndarray):
    """Without the empty strings that stand for white space at the ends of texts."""
    real = pc.not_equal(distinct, "").to_numpy(zero_copy_only=False)
    real = real[index] if len(index) else np.zeros(0, bool)
    return _hashes(distinct), index[real], np.concatenate([[0], np.cumsum(real)])[at]


def _both(texts: pa.Array, model: subword.Subwords):
    """As _words, and ids and where texts start among them."""
    for part in _lower(texts):
        for distinct, index, at, ids, ids_at in model.with_words(part, 2 * BLOCK + int(pc.max(pc.binary_length(part)).as_py())):
            yield (*_real(distinct, index, at), ids, ids_at)


def encoded(docs: DataFrame, tokenizer: str) -> DataFrame:
    """kind doc: k, c, train and ids (with the end) of each document; kind word, id or pair (of ids): key and n, counted
    over parts of the training documents. docs: k, c, train, text."""
    names = ["kind", "key", "n", "k", "c", "train", "ids"]

    def run(batches):
        model = subword.load(tokenizer)
        held: list = []
        pairs: list = []
        ids_total = np.zeros(model.size + 1, np.int64)

        def summed(some):
            key, at = np.unique(np.concatenate([k for k, _ in some]), return_inverse=True)
            return key, np.bincount(at, np.concatenate([n for _, n in some])).astype(np.int64)

        def out(kind, keys, counts):
            for i in range(0, len(keys), SENT):
                yield sent(kind, keys[i : i + SENT], counts[i : i + SENT])

        def sent(kind, key, n):
            none = lambda t: pa.nulls(len(key), t)
            return pa.RecordBatch.from_arrays([pa.array([kind] * len(key), pa.string()), pa.array(key, pa.int64()), pa.array(n, pa.int64()), none(pa.int64()), none(pa.int32()), none(pa.bool_()), none(pa.binary())], names=names)

        for b in batches:
            row = 0
            trains = b.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for hashes, index, word_at, ids, at in _both(b.column(3), model):
                n_texts = len(at) - 1
                train = trains[row : row + n_texts]
                ids, at = _with_ends(ids, at, model.size)
                raw = ids.astype("<i4")
                none = lambda: pa.nulls(n_texts, pa.int64())  # noqa: B023, E731
                body = pa.array([raw[x:y].tobytes() for x, y in pairwise(at.tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(["doc"] * n_texts, pa.string()), none(), none(), b.column(0).slice(row, n_texts), b.column(1).slice(row, n_texts), pa.array(train), body], names=names)
                row += n_texts
                of_id, of_word = np.repeat(train, np.diff(at)), np.repeat(train, np.diff(word_at))
                ids_total += np.bincount(ids[of_id], minlength=model.size + 1)
                pairs.append(np.unique((_before(ids, at) << 20 | ids)[of_id], return_counts=True))
                if sum(len(k) for k, _ in pairs) > HELD:
                    pairs = [summed(pairs)]
                    if len(pairs[0][0]) > HELD // 2:
                        yield from out("pair", *pairs.pop())
                n = np.bincount(index[of_word], minlength=len(hashes))
                held += [(hashes[n > 0], n[n > 0]), (np.array([END_WORD]), np.array([int(train.sum())]))]
                if sum(len(k) for k, _ in held) > HELD:
                    yield from out("word", *summed(held))
                    held = []
        if held:
            yield from out("word", *summed(held))
        if pairs:
            yield from out("pair", *summed(pairs))
        at = np.flatnonzero(ids_total)
        yield from out("id", at, ids_total[at])
        held = pairs = []
        give_back()

    return docs.select("k", "c", "train", "text").mapInArrow(run, "kind string, key long, n long, k long, c int, train boolean, ids binary")


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int | None = None):
    """Jobs that start inside send `rows` rows (ROWS) to a Python worker at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows or ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _blocks(ids: pa.Array, block: int = BLOCK) -> list[tuple[int, int]]:
    """Runs of written documents of about `block` bytes, or one document."""
    sizes = np.cumsum(pc.binary_length(ids).to_numpy(zero_copy_only=False).astype(np.int64)) // block
    return list(pairwise([0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(ids)])) if len(ids) else []


def _arrays(batch: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the written documents one after another, and where each starts."""
    sizes = pc.binary_length(batch).to_numpy(zero_copy_only=False).astype(np.int64) // 4
    return np.frombuffer(b"".join(batch.to_pylist()), "<i4"), np.concatenate([[0], np.cumsum(sizes)])


def train(docs: DataFrame, vocabulary: Vocabulary, prior: np.ndarray, rounds: int = ROUNDS, rate: float = 0.02) -> Attention:
    """Fits a copy in each task and averages them, each round; docs: ids, part (the number of the round that reads it)."""
    model = Grouped(prior=prior)
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, prior, model.of))  # bounded by the model's size
    kind = "step long, " + ", ".join(f"{k} array<double>" for k in model.NAMES)

    def record(step, p):
        return pa.RecordBatch.from_arrays([pa.array([step], pa.int64()), *(pa.array([p[k].ravel().astype(np.float64)]) for k in model.NAMES)], names=["step", *model.NAMES])

    def total(rows):
        """Steps and sums of weights times steps."""
        step, p = 0, {}
        for b in rows:
            for i in range(b.num_rows):
                step += b["step"][i].as_py()
                for k in model.NAMES:
                    p[k] = p.get(k, 0) + b[k][i].values.to_numpy()
        return step, p

    def add(batches):
        step, p = total(batches)
        if step:
            yield record(step, p)

    for part in range(rounds):
        start = model.p

        def run(batches, start=start, part=part):
            vocabulary, prior, of = shared.value
            net = Grouped(prior=prior, of=of)
            net.p = {k: v.copy() for k, v in start.items()}
            m = {k: np.zeros_like(v) for k, v in net.p.items()}
            s = {k: np.zeros_like(v) for k, v in net.p.items()}
            step, rng = 0, np.random.default_rng(part)

            def learn(ids, at):
                nonlocal step
                inputs, target = _shifted(vocabulary.inp[ids], at), vocabulary.cls[ids].astype(np.int64)
                first, _, end = windows(at, WINDOW, 0)
                order = rng.permutation(len(first))
                for i in range(0, len(order), STEP):
                    w = order[i : i + STEP]
                    place = first[w][:, None] + np.arange(WINDOW)
                    real = place < end[w][:, None]
                    place = np.minimum(place, len(target) - 1)
                    g = net.gradient(inputs[place], target[place], real)
                    step += 1
                    pace = rate * (0.5 if part else 1.0) / (1 + step / 400)
                    for k, d in g.items():
                        m[k] *= np.float32(0.9)
                        s[k] *= np.float32(0.99)
                        m[k] += np.float32(0.1) * d
                        d *= d
                        d *= np.float32(0.01)
                        s[k] += d
                        d = np.sqrt(s[k])
                        d += np.float32(1e-6 * np.sqrt(1 - 0.99**step))
                        np.divide(m[k], d, out=d)
                        d *= np.float32(pace * np.sqrt(1 - 0.99**step) / (1 - 0.9**step))
                        net.p[k] -= d

            for b in batches:
                for x, y in _blocks(b.column(0)):
                    learn(*_arrays(b.column(0).slice(x, y - x)))
            if step:
                yield record(step, {k: v.astype(np.float64) * step for k, v in net.p.items()})
            give_back()

        fitted = settle(docs.sparkSession, lambda run=run, part=part: docs.where(F.col("part") == part).select("ids").mapInArrow(run, kind))
        if fitted.count() > MODELS:
            fitted = fitted.repartition(MODELS).mapInArrow(add, kind)
        steps, sums = total(fitted.toArrow().to_batches())  # MODELS models at most
        if steps:
            model.p = {k: (sums[k] / steps).astype(np.float32).reshape(v.shape) for k, v in start.items()}
    return model


def base_scores(docs: DataFrame, words: DataFrame) -> tuple[DataFrame, int]:
    """k, c, key, n_tokens, n_known and base_score of each document, and the number of training tokens.

    docs: k, c, key, text; words: h, c (counts of training tokens)."""
    spark = docs.sparkSession
    n_tokens, n_distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    end_count = next((r.c for r in words.where(F.col("h") == END_WORD).collect()), 0)
    top = words.orderBy(F.desc("c"), "h").limit(FREQUENT).collect()
    cut = (top[-1].c, top[-1].h) if len(top) == FREQUENT else None
    shared = spark.sparkContext.broadcast(np.array(sorted((r.h, r.c) for r in top), np.int64).reshape(-1, 2))  # FREQUENT rows at most
    base = float(np.log10(n_tokens + n_distinct + 1))
    names = ["k", "c", "key", "n_tokens", "n_known", "base", "rest_h", "rest_n"]

    def run(batches):
        hot = shared.value
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        for b in batches:
            row = 0
            for hashes, index, at in _words(b.column(3)):
                rows: list[tuple] = []
                place = np.minimum(np.searchsorted(hot[:, 0], hashes), max(len(hot) - 1, 0))
                is_hot = hot[place, 0] == hashes if len(hot) else np.zeros(len(hashes), bool)
                count = np.where(is_hot, hot[place, 1], 0) if len(hot) else np.zeros(len(hashes), np.int64)
                log, known, cold = np.log10(count + 1.0), count > 0, ~is_hot
                for x, y in pairwise(at.tolist()):
                    i = index[x:y]
                    far, n = np.unique(i[cold[i]], return_counts=True) if cut is not None else (i[:0], i[:0])
                    rows.append((len(i) + 1, int(known[i].sum()) + (end_count > 0), float(log[i].sum()) + float(np.log10(end_count + 1.0)), hashes[far], n.astype(np.int64)))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([*(c.slice(row, len(rows)) for c in b.columns[:3]), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=names)
                row += len(rows)
        give_back()

    kind = docs.schema["key"].dataType.simpleString()
    rows = docs.select("k", "c", "key", "text").mapInArrow(run, f"k long, c int, key {kind}, n_tokens long, n_known long, base double, rest_h array<long>, rest_n array<long>")
    if cut is not None:
        rows = materialize(rows)
        rare = words.where((F.col("c") < cut[0]) | (F.col("c") == cut[0]) & (F.col("h") > cut[1])).select("h", F.col("c").alias("n_word"))
        one = rows.dropDuplicates(["k", "c"])  # repeated rows have the same words
        far = one.select("k", "c", F.explode(F.arrays_zip("rest_h", "rest_n")).alias("r")).select("k", "c", F.col("r.rest_h").alias("h"), F.col("r.rest_n").alias("n")).join(rare, "h")
        more = far.groupBy("k", "c").agg(F.sum("n").alias("known"), F.sum(F.col("n") * F.log10(F.col("n_word") + 1.0)).alias("more"))
        rows = rows.drop("rest_h", "rest_n").join(more, ["k", "c"], "left").withColumns({"n_known": F.col("n_known") + F.coalesce("known", F.lit(0)), "base": F.col("base") + F.coalesce("more", F.lit(0.0))})
    return rows.select("k", "c", "key", "n_tokens", "n_known", (F.col("base") - F.col("n_tokens") * base).alias("base_score")), n_tokens


def model_scores(ids: DataFrame, vocabulary: Vocabulary, model: Attention, rare_pairs: DataFrame | None) -> DataFrame:
    """k, c and score of each distinct document; ids: k, c, ids."""
    shared = ids.sparkSession.sparkContext.broadcast((vocabulary, model))  # bounded by PAIRS and the model's size

    def run(batches):
        vocabulary, model = shared.value
        for b in batches:
            for x, y in _blocks(b.column(2), SCORED):
                ids, at = _arrays(b.column(2).slice(x, y - x))
                before = _before(ids, at)
                within, place, keys = vocabulary.looked_up(ids, before)
                p = scored(model, _shifted(vocabulary.inp[ids], at), vocabulary.cls[ids].astype(np.int64), at) / np.log(10) + within
                pairs = zip(*(np.unique(k, return_counts=True) for k in np.split(keys, np.searchsorted(place, at[1:-1]))), strict=True)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(x, y - x), b.column(1).slice(x, y - x), pa.array(np.add.reduceat(p, at[:-1]).astype(np.float64)), *(pa.array(c, pa.list_(pa.int64())) for c in pairs)], names=["k", "c", "score", "pair", "pair_n"])
        give_back()

    rows = ids.select("k", "c", "ids").mapInArrow(run, "k long, c int, score double, pair array<long>, pair_n array<long>")
    if rare_pairs is None:
        return rows.groupBy("k", "c").agg(F.min("score").alias("score"))
    rows = materialize(rows).dropDuplicates(["k", "c"])
    far = rows.select("k", "c", F.explode(F.arrays_zip("pair", "pair_n")).alias("r")).select("k", "c", F.col("r.pair").alias("key"), F.col("r.pair_n").alias("n")).join(rare_pairs, "key")
    more = far.groupBy("k", "c").agg(F.sum(F.col("n") * F.col("gain")).alias("more"))
    return rows.join(more, ["k", "c"], "left").select("k", "c", (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"))


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", train_when=None, tokenizer: str | None = None) -> DataFrame:
    """key, n_tokens, n_known, train_tokens, base_score and score of each document; train_when: condition of training rows."""
    spark = docs.sparkSession
    tokenizer = tokenizer or subword.tokenizer_path()
    trains = F.lit(True) if train_when is None else F.coalesce(train_when(F.col(key)), F.lit(False))
    docs = docs.select(F.xxhash64(F.col(key), F.col(text)).alias("k"), F.hash(F.col(text), F.col(key)).alias("c"), F.col(key).alias("key"), trains.alias("train"), F.col(text).alias("text"))

    def scored_rows() -> DataFrame:
        coded = materialize(encoded(docs, tokenizer))
        ids = coded.where("kind = 'doc'")
        found = materialize(coded.where("kind <> 'doc'").groupBy("kind", "key").agg(F.sum("n").alias("n")))
        id_counts = np.zeros(subword.load(tokenizer).size + 1)
        for r in found.where("kind = 'id'").collect():  # at most the tokenizer's ids
            id_counts[r.key] = r.n
        vocabulary = Vocabulary(id_counts)
        pairs, rare_pairs = pair_counts(found, vocabulary)
        rounds = max(ROUNDS, -(-int(id_counts.sum()) // PER_ROUND))
        model = train(ids.where("train").select("k", "ids", F.pmod("k", F.lit(rounds)).alias("part")), vocabulary, prior_logits(pairs), rounds)
        scores = model_scores(ids, vocabulary, model, rare_pairs)
        rows, n_tokens = base_scores(docs, found.where("kind = 'word'").select(F.col("key").alias("h"), F.col("n").alias("c")))
        return rows.join(scores, ["k", "c"], "left").select(F.col("key").alias(key), "n_tokens", "n_known", F.lit(n_tokens).cast("long").alias("train_tokens"), "base_score", "score")

    with small_batches(spark):
        return settle(spark, scored_rows)


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score(table(spark, sf_dir, "documents"), train_when=lambda k: ~held_out(k, 7, 2))
    return out.select("doc_id", held_out(F.col("doc_id"), 7, 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
