"""Text measures without a built-in expression, as Arrow-batched functions: BLEU-4, ROUGE-L and the matcher ratio."""

from __future__ import annotations

import math
from collections import Counter

import pandas as pd
from pyspark.sql import functions as F

from .matching import ratio, ratio_column  # noqa: F401


def bleu4(pred: str, gold: str) -> float:
    """Sentence BLEU with uniform weights up to 4-grams; orders without a match count 0.1 matches (smoothing method 1)."""
    p, g = (pred or "").lower().split(), (gold or "").lower().split()
    grams = lambda w, n: Counter(zip(*(w[i:] for i in range(n)), strict=False))
    if not p or not grams(p, 1) & grams(g, 1):
        return 0.0
    total = 0.0
    for n in range(1, 5):
        a = grams(p, n)
        hits, size = sum((a & grams(g, n)).values()), max(1, sum(a.values()))
        total += math.log((hits or 0.1) / size) / 4
    return math.exp(min(0.0, 1 - len(g) / len(p)) + total)


def rouge_l(pred: str, gold: str) -> float:
    """F1 of the longest common subsequence of lower-case alphanumeric tokens; no stemming."""
    import re

    p, g = (re.findall("[a-z0-9]+", (x or "").lower()) for x in (pred, gold))
    if not p or not g:
        return 0.0
    row = [0] * (len(g) + 1)
    for a in p:
        last = 0
        for j, b in enumerate(g, 1):
            last, row[j] = row[j], last + 1 if a == b else max(row[j], row[j - 1])
    return 2 * row[-1] / (len(p) + len(g))


def _paired(f):
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([f(x, y) for x, y in zip(a, b, strict=True)])

    return run


def bleu4_column(a, b):
    return _paired(bleu4)(a, b)


def rouge_l_column(a, b):
    return _paired(rouge_l)(a, b)
