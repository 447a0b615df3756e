"""Scores of generated texts: BLEU-4 from n-gram multisets of each row, ROUGE-L over stems."""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.stemming import common_subsequence, stem
from .dialog import query, table

#: Matches that an order without any counts for.
EPSILON = 0.1


def tokens(text: Column) -> Column:
    """Lower-case words between white space; null for none."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)^\s+|\s+$", ""), r"(?U)\s+")
    return F.filter(words, lambda w: w != "")


def clipped(order: int):
    """How many n-grams of the first words stand in the second too, each as often as it does in both, for n from 1 to order."""

    def hits(p, g) -> list[int]:
        grams = lambda w, n: Counter(zip(*(w[i:] for i in range(n)), strict=False))
        return [(grams(p, n) & grams(g, n)).total() for n in range(1, order + 1)]

    def run(p: pd.Series, g: pd.Series) -> pd.Series:
        return pd.Series([hits(x.tolist(), y.tolist()) for x, y in zip(p, g, strict=True)], dtype=object)

    return F.pandas_udf(run, T.ArrayType(T.LongType()))


def bleu4(pairs: DataFrame, key: str, pred: str, gold: str, order: int = 4) -> DataFrame:
    """key and bleu4 of each row: uniform weights, clipped counts, EPSILON matches for orders without any, brevity penalty.

    n-grams are counted where the row is, so nothing is shuffled. Nulls count as empty and give 0."""
    words = pairs.select(F.col(key).alias("key"), tokens(F.col(pred)).alias("pw"), tokens(F.col(gold)).alias("gw"))
    x = words.select("key", F.size("pw").alias("p"), F.size("gw").alias("g"), clipped(order)("pw", "gw").alias("h"))
    logs = F.lit(0.0)
    for n in range(1, order + 1):
        share = F.when(F.col("h")[n - 1] > 0, F.col("h")[n - 1].cast("double")).otherwise(EPSILON) / F.greatest(F.lit(1), F.col("p") - (n - 1))
        logs = logs + F.log(share) / order
    short = F.least(F.lit(0.0), 1 - F.col("g") / F.greatest(F.lit(1), F.col("p")))
    return x.select(F.col("key").alias(key), F.when(F.col("h")[0] > 0, F.exp(short + logs)).otherwise(0.0).alias("bleu4"))


def stems(text: str | None) -> list[str]:
    return [stem(w) if len(w) > 3 else w for w in re.findall("[a-z0-9]+", (text or "").lower())]


def _rouge(pred: pd.Series, gold: pd.Series) -> pd.Series:
    out = []
    for p, g in zip(pred, gold, strict=True):
        a, b = stems(p), stems(g)
        out.append(2.0 * common_subsequence(a, b) / (len(a) + len(b)) if a and b else 0.0)
    return pd.Series(out, dtype="float64")


def rouge_l(pred, gold) -> Column:
    """F1 of the longest common subsequence of stems; nulls count as empty, and an empty side gives 0."""
    return F.pandas_udf(_rouge, T.DoubleType())(pred, gold)


def generated(spark, sf_dir: str) -> DataFrame:
    """Stand-in of generated answers: each answer whole, without its end, with other endings, or the turn before it."""
    talk = table(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    t, kind = F.col("text"), F.pmod(F.col("conv_id") + F.col("turn"), F.lit(4))
    pred = F.when(kind == 0, t).when(kind == 1, F.substring(t, F.lit(1), F.floor(F.length(t) * 0.8).cast("int"))).when(kind == 2, F.replace(t, F.lit("ing "), F.lit("ed "))).otherwise(F.lag("text").over(w))
    return talk.select(F.concat_ws("-", "conv_id", "turn").alias("row"), pred.alias("pred"), t.alias("gold"))


_SIDES = "SELECT conv_id || '-' || turn AS row, text AS gold, CASE (conv_id + turn) % 4 WHEN 0 THEN text WHEN 1 THEN substr(text, 1, floor(length(text) * 0.8)::INT) WHEN 2 THEN replace(text, 'ing ', 'ed ') ELSE lag(text) OVER (PARTITION BY conv_id ORDER BY turn) END AS pred FROM conversations"
_GRAMS = " UNION ALL ".join(f"SELECT row, {s} AS side, {n} AS n, unnest(list_transform(range(1, len({w}) - {n - 1} + 1), lambda i: {w}[i:i + {n - 1}])) AS gram FROM w" for n in range(1, 5) for s, w in ((1, "p"), (0, "g")))
_LOGS = " + ".join(f"ln(CASE WHEN h{n} > 0 THEN h{n}::DOUBLE ELSE 0.1::DOUBLE END / greatest(1, len(p) - {n - 1})) / 4" for n in range(1, 5))


@query("bleu4_scores", f"""WITH s AS ({_SIDES}), w AS (SELECT row, regexp_extract_all(lower(coalesce(pred, '')), '\\S+') AS p, regexp_extract_all(lower(coalesce(gold, '')), '\\S+') AS g FROM s),
 c AS (SELECT row, n, gram, least(count(*) FILTER (side = 1), count(*) FILTER (side = 0)) AS hit FROM ({_GRAMS}) GROUP BY ALL),
 h AS (SELECT row, {", ".join(f"coalesce(sum(hit) FILTER (n = {n}), 0) AS h{n}" for n in range(1, 5))} FROM c GROUP BY row)
 SELECT w.row, round(CASE WHEN coalesce(h1, 0) > 0 THEN exp(least(0, 1 - len(g)::DOUBLE / len(p)) + {_LOGS}) ELSE 0 END, 9) AS bleu4 FROM w LEFT JOIN h USING (row)""")
def bleu4_scores(spark, sf_dir):
    return bleu4(generated(spark, sf_dir), "row", "pred", "gold").select("row", F.round("bleu4", 9).alias("bleu4"))


@query("rouge_l_scores")
def rouge_l_scores(spark, sf_dir):
    """Subsequences and stems have no form in SQL: tests hold them against plain loops and published examples."""
    return generated(spark, sf_dir).select("row", F.round(rouge_l("pred", "gold"), 9).alias("rouge_l"))
