"""Quality classifier: a sparse ensemble of rules (RuleFit).

Boosted regression trees over text statistics give paths; each path is a rule, a conjunction of comparisons. Lasso logistic
regression weighs the rules (proximal gradient), and the few that keep a weight are compiled into one Spark column.
Trees and weights are fitted on the driver on a bounded sample of labelled rows (SAMPLE); scoring is a projection.

Null and blank texts have statistics of zero and are scored like any other; null ids count as the empty text for the
held-out split; rows of labels with nulls are left out; without any labels all scores are 0.5. Repeated rows are scored
one by one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .quality_rules import with_statistics

#: Labelled rows that are fitted on at most, chosen by a hash of their id.
SAMPLE = 10_000
TREES, DEPTH, BINS = 30, 3, 32
PENALTY = 0.002
CUT = 0.7

_per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
FEATURES = {
    "f_words": lambda: F.log1p(F.col("n_words")),
    "f_word_length": lambda: _per("word_chars", "n_words"),
    "f_symbols": lambda: _per("n_symbols", "n_words"),
    "f_repeated": lambda: _per("n_repeat_words", "n_words"),
    "f_exclaimed": lambda: _per("n_exclaimed", "n_words"),
    "f_upper": lambda: _per("n_upper", "n_words"),
    "f_stop": lambda: _per("n_stop", "n_words"),
    "f_dup_lines": lambda: _per("n_dup_lines", "n_lines"),
    "f_line_words": lambda: F.log1p(_per("n_words", "n_lines")),
}

Rule = tuple[tuple[int, bool, float], ...]


def with_features(docs: DataFrame, text: str) -> DataFrame:
    return with_statistics(docs, text).withColumns({k: f().cast("double") for k, f in FEATURES.items()})


def held_out(key: Column, mod: int, rest: int) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % mod == rest


def grow(x: np.ndarray, edges: list[np.ndarray], residual: np.ndarray, rng: np.random.Generator, depth: int) -> tuple[list[Rule], np.ndarray]:
    """The paths of a regression tree on half of the rows and features, and its fitted values for all rows."""
    rules: list[Rule] = []
    fit = np.zeros(len(x))
    used = rng.permutation(x.shape[1])[: max(2, 2 * x.shape[1] // 3)]
    in_bag = rng.random(len(x)) < 0.5

    def node(rows: np.ndarray, path: Rule) -> None:
        if path:
            rules.append(path)
        bag = rows[in_bag[rows]]
        best = (1e-9, -1, 0.0)
        if len(path) < depth and len(bag) >= 20:
            r = residual[bag]
            for f in used:
                b = np.searchsorted(edges[f], x[bag, f], "left")
                n = np.cumsum(np.bincount(b, minlength=len(edges[f]) + 1))[:-1]
                s = np.cumsum(np.bincount(b, r, minlength=len(edges[f]) + 1))[:-1]
                ok = (n >= 5) & (len(bag) - n >= 5)
                gain = np.where(ok, s**2 / np.maximum(n, 1) + (r.sum() - s) ** 2 / np.maximum(len(bag) - n, 1) - r.sum() ** 2 / len(bag), 0)
                if len(gain) and gain.max() > best[0]:
                    best = (gain.max(), f, float(edges[f][gain.argmax()]))
        _, f, cut = best
        if f < 0:
            fit[rows] = residual[bag].mean() if len(bag) else 0
            return
        low = x[rows, f] <= cut
        node(rows[low], (*path, (int(f), True, cut)))
        node(rows[~low], (*path, (int(f), False, cut)))

    node(np.arange(len(x)), ())
    return rules, fit


def holds(x: np.ndarray, rule: Rule) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, low, cut in rule:
        out &= (x[:, f] <= cut) == low
    return out


def fit_rules(x: np.ndarray, y: np.ndarray, seed: int = 7, trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY) -> tuple[float, list[tuple[Rule, float]]]:
    """Intercept, and the rules with a weight."""
    if not len(y):
        return 0.0, []
    rng = np.random.default_rng(seed)
    base = np.clip(y.mean(), 0.01, 0.99)
    score = np.full(len(y), np.log(base / (1 - base)))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for c in x.T]
    rules: dict[Rule, None] = {}
    for _ in range(trees):
        found, fit = grow(x, edges, y - 1 / (1 + np.exp(-score)), rng, depth)
        rules |= dict.fromkeys(tuple(sorted(set(r))) for r in found)
        score = score + 1.0 * fit
    names = list(rules)
    if not names:
        return float(score[0]), []
    m = np.stack([holds(x, r) for r in names], 1).astype(float)
    # accelerated proximal gradient for the lasso logistic loss; the intercept bears no penalty
    w, b = np.zeros(m.shape[1]), np.log(base / (1 - base))
    v, c, t = w.copy(), b, 1.0
    step = 4.0 * len(y) / (np.linalg.norm(m, 2) ** 2 + len(y))
    for _ in range(600):
        g = 1 / (1 + np.exp(-(m @ v + c))) - y
        nw = v - step * (m.T @ g) / len(y)
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * penalty, 0)
        nb = c - step * g.mean()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return float(b), [(r, float(x)) for r, x in zip(names, w, strict=True) if x]


def rule_column(rule: Rule, names: list[str]) -> Column:
    out = F.lit(True)
    for f, low, cut in rule:
        out = out & ((F.col(names[f]) <= cut) if low else (F.col(names[f]) > cut))
    return out


def score_column(model: tuple[float, list[tuple[Rule, float]]], names: list[str]) -> Column:
    total = F.lit(model[0])
    for rule, weight in model[1]:
        total = total + F.when(rule_column(rule, names), weight).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def train(docs: DataFrame, labels: DataFrame, text: str, sample: int = SAMPLE) -> tuple[float, list[tuple[Rule, float]]]:
    """labels: doc_id and y (0 or 1). Documents of at most `sample` labels are read for it; of rows that share an id, the one
    with the least statistics is fitted on."""
    chosen = labels.where("doc_id is not null and y is not null").groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    found = with_features(docs.select("doc_id", text).join(F.broadcast(chosen), "doc_id"), text)
    one = found.groupBy("doc_id").agg(F.min(F.struct("y", *FEATURES)).alias("r"))
    rows = sorted(map(tuple, one.select("doc_id", "r.*").collect()))  # at most `sample` rows of numbers
    data = np.array([r[1:] for r in rows], float).reshape(-1, len(FEATURES) + 1)
    return fit_rules(data[:, 1:], data[:, 0])


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"), 4, 2)).select("doc_id", F.col("quality").cast("int").alias("y"))
    model = train(docs, labels, "text")
    scored = with_features(docs, "text").select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), score_column(model, list(FEATURES)).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= CUT, 1).otherwise(0))
