"""Quality rules: a threshold table compiled into one Spark projection without user functions.

Null and blank texts have no words, so they fail min_words; extra columns pass through; a column of the input that has
the name of a computed one is replaced. Repeated rows are judged one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, let, table, words

#: Frequent function words of English, French, Spanish and German (fixed values).
STOP_WORDS = (
    "the of and to in a is was for on with as by at from that it an be are "
    "le la les de des du et en un une que qui dans pour sur est pas au avec "
    "el los las y no se por con su para una del lo al "
    "der die das und zu den von ist mit sich auf für nicht ein eine im dem"
).split()

SYMBOLS = "#*$%&|<>"

#: name, numerator, denominator, comparison, threshold: a document is rejected when the comparison holds.
THRESHOLDS = (
    ("min_words", "n_words", None, "<", 50),
    ("repeat_words", "n_repeat_words", "n_words", ">", 0.5),
    ("symbols_per_word", "n_symbols", "n_words", ">", 0.1),
    ("mean_word_length_high", "word_chars", "n_words", ">", 15),
    ("mean_word_length_low", "word_chars", "n_words", "<", 2),
    ("exclaimed_words", "n_exclaimed", "n_words", ">", 0.15),
    ("upper_words", "n_upper", "n_words", ">", 0.4),
    ("stop_words", "n_stop", "n_words", "<", 0.01),
    ("dup_lines", "n_dup_lines", "n_lines", ">", 0.8),
    ("ellipsis_lines", "n_ellipsis", "n_lines", ">", 0.5),
)
#: The rules of the base filter.
BASE = ("min_words", "repeat_words")


def repeated_words(w: Column, size: int = 3) -> Column:
    """Number of words that lie in windows of size words found twice or more, the first included."""

    def marked(hits: Column) -> Column:
        def pick(x: Column, k: Column) -> Column:
            same = lambda at: F.coalesce(F.get(hits, at)["h"] == x["h"], F.lit(False))
            return F.when(same(k - 1) | same(k + 1), x["i"])

        return F.sort_array(F.filter(F.transform(hits, pick), lambda i: i.isNotNull()))

    def covered(at: Column) -> Column:
        gaps = F.transform(at, lambda x, k: F.coalesce(F.least(F.lit(size), F.get(at, k + 1) - x), F.lit(size)))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda s, x: s + x)

    windows = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.struct(F.xxhash64(*[F.get(w, i + j) for j in range(size)]).alias("h"), i.alias("i"))))
    return F.when(F.size(w) < size, F.lit(0).cast("long")).otherwise(let(let(windows, marked), covered))


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the columns that THRESHOLDS name."""
    t = F.coalesce(F.col(text), F.lit(""))
    stats = let(words(F.col(text)), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        repeated_words(w).alias("n_repeat_words"),
        F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))).cast("long").alias("n_stop"),
        F.size(F.filter(w, lambda x: x.endswith("!"))).cast("long").alias("n_exclaimed"),
    ))
    by_line = let(F.filter(F.split(t, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")), lambda x: F.struct(
        F.size(x).cast("long").alias("n_lines"),
        (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        F.size(F.filter(x, lambda v: F.rtrim(v).endswith("...") | F.rtrim(v).endswith("…"))).cast("long").alias("n_ellipsis"),
    ))
    count = lambda p: F.regexp_count(t, F.lit(p)).cast("long")
    w, by = fresh(docs, "by_word"), fresh(docs, "by_line")
    df = docs.withColumns({w: stats, by: by_line, "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"), "n_upper": count("(?<![^\\x20\\x09-\\x0D])\\p{Lu}{2}[^\\p{Ll}\\x20\\x09-\\x0D]*(?![^\\x20\\x09-\\x0D])")})
    flat = {c: F.col(w)[c] for c in ("n_words", "word_chars", "n_repeat_words", "n_stop", "n_exclaimed")} | {c: F.col(by)[c] for c in ("n_lines", "n_dup_lines", "n_ellipsis")}
    return df.withColumns(flat).drop(w, by)


def rule_column(rule: tuple) -> Column:
    """True where the document breaks the rule; multiplied out, so that no division by zero arises."""
    _, num, den, op, limit = rule
    left, right = (F.col(num), F.lit(limit)) if den is None else (F.col(num).cast("double"), F.lit(float(limit)) * F.col(den))
    return left < right if op == "<" else left > right


def quality_rules(docs: DataFrame, text: str = "text", thresholds: tuple = THRESHOLDS) -> DataFrame:
    """docs with statistics, base_failed, kept and failed_rules (names of the broken rules)."""
    rules = {r[0]: rule_column(r) for r in thresholds}
    base = F.lit(False)
    for name in BASE:
        base = base | rules[name] if name in rules else base
    failed = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())
    return with_statistics(docs, text).withColumns({"base_failed": base, "failed_rules": failed}).withColumn("kept", F.size("failed_rules") == 0)


def passing(judged: DataFrame) -> DataFrame:
    """The kept rows. A filter moves below projections and would compute the statistics once for each rule that reads them;
    it doesn't move below a column that isn't deterministic."""
    once = fresh(judged, "once")
    return judged.withColumn(once, F.rand()).where(F.col("kept") & (F.col(once) >= 0)).drop(once)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_WORD = "[^\\x20\\x09-\\x0D]+"
_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
#: The query in DuckDB: windows of three words are compared as strings.
SQL = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
 g AS (SELECT r, unnest(range(len(w) - 2)) AS i, unnest(list_transform(range(len(w) - 2), lambda i: w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) AS gram FROM d WHERE len(w) > 2),
 h AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, gram) > 1),
 c AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM h) GROUP BY r),
 l AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines FROM d),
 s AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
  len(lines) AS n_lines, len(list_filter(w, lambda x: ends_with(x, '!'))) AS n_exclaimed, len(list_filter(w, lambda x: regexp_matches(x, '^\\p{{Lu}}{{2}}[^\\p{{Ll}}]*$'))) AS n_upper, len(list_filter(w, lambda x: lower(x) IN ({_STOP}))) AS n_stop, len(list_filter(lines, lambda x: ends_with(rtrim(x, ' '), '...') OR ends_with(rtrim(x, ' '), '…'))) AS n_ellipsis
  FROM d JOIN l USING (r) LEFT JOIN c USING (r))
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR n_repeat_words > 0.5::DOUBLE * n_words OR n_symbols > 0.1::DOUBLE * n_words OR word_chars > 15 * n_words OR word_chars < 2 * n_words OR n_exclaimed > 0.15::DOUBLE * n_words OR n_upper > 0.4::DOUBLE * n_words OR n_stop < 0.01::DOUBLE * n_words OR n_dup_lines > 0.8::DOUBLE * n_lines OR n_ellipsis > 0.5::DOUBLE * n_lines) AS kept FROM s"""
