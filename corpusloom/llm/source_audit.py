"""Source divergence audit: how far the sources of a language differ in their terms, by mergeable radix tries.

1. Each partition counts terms in one byte trie a language, with a counter for each source and the number of documents at a
   leaf. Words are counted by hash first; at every ENTRIES counters, and at the end, they become tries, are handed on and
   begun anew, so memory is bounded.
2. Tries are cut at prefixes, quantiles of a small sample of terms, and the pieces of a range meet in one task, which merges
   them into one trie and walks it in the order of UTF-8. Terms in enough documents are kept, in blocks.
3. Divergence is a sum over all kept terms for each ordered pair of sources. A term that neither has adds a constant, one
   that only one has depends on its count alone, so blocks give histograms of counts, and sums over the terms that two
   sources share; no block needs the sources that it doesn't hold, and no row is made for a pair and a term.
4. Each task keeps the best terms of each source, ties in the order of UTF-8, of which the best few are ranked.

p of a count c is 1 + floor(SCALE * (c + 1) / (N + V)), with N the count of all kept terms and V their number; f(p, q) is
floor((p - q)^2 / q). All of it is in whole numbers.

Null texts, languages and sources count as empty strings. Groups without a term, and languages without a kept term, have
pairs (of value 0 if V is 0) and no terms. Ties go by the item. Repeated rows are documents of their own; very long texts
and terms are taken whole; an empty table gives no rows; extra columns are left out of the result.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter, defaultdict
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, parts, settle, table
from .radix_trie import Flat, Trie, merge, terms

SCALE = 1_000_000_000
#: Counters that a task holds at once; terms in a block; sampled terms for each range; bytes of a prefix that bounds a range.
ENTRIES, BLOCK, OVER, PREFIX = 1_000_000, 4096, 16, 64
#: Candidates and pair sums that a task holds before it hands them on; kept terms of a task that looks at blocks.
HELD, SPAN = 200_000, 1 << 15

_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_LETTERS).split() if text else []


def share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / total), by long division in thousands, so that nothing overflows below a total of 2^53."""
    out, rest = np.ones_like(total), count + 1
    whole = np.zeros_like(total)
    for _ in range(3):
        whole, rest = whole * 1000 + rest * 1000 // total, rest * 1000 % total
    return out + whole


def spread(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _texts(batch) -> tuple:
    return (batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()))


def boundaries(docs: DataFrame, ranges: int) -> list[tuple[str, bytes]]:
    """Language and prefix where each range but the first begins: quantiles of OVER sampled terms a range."""
    rows = docs.count()
    want = OVER * ranges

    def some(batches):
        for b in batches:
            rows = {(lang or "", w[:PREFIX]) for lang, _, t in zip(*_texts(b), strict=True) for w in sorted(set(words(t.as_py())), key=hash_of)[:OVER]}
            cols = list(zip(*rows, strict=True)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.binary())], names=["lang", "prefix"])

    sample = docs.sample(min(1.0, 2.0 * want / OVER / max(1, rows)), 7).mapInArrow(some, "lang string, prefix binary").distinct()
    found = sorted((r.lang, bytes(r.prefix)) for r in sample.orderBy(F.xxhash64("prefix")).limit(4 * want).collect())
    return sorted({found[i * len(found) // ranges] for i in range(1, ranges)}) if found else []


def hash_of(term: bytes) -> int:
    return int.from_bytes(term[-8:], "little") * 0x9E3779B97F4A7C15 & (1 << 64) - 1


def counted(docs: DataFrame, cuts: list[tuple[str, bytes]]) -> DataFrame:
    """Pieces of the partitions' tries: range, lang and a flat run. docs: lang, source, text."""

    def pieces(tries):
        for lang, trie in tries.items():
            at = flat = None
            for term, node in trie.walk():
                now = bisect_right(cuts, (lang, term[:PREFIX]))
                if now != at and flat:
                    yield at, lang, *flat.columns()
                at, flat = now, Flat() if now != at else flat
                flat.add(term, node)
            if flat:
                yield at, lang, *flat.columns()

    def out(rows):
        cols = list(zip(*rows, strict=True)) or [()] * 9
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.string(), *Flat.KINDS), strict=True)], names=["range", "lang", "shared", "tails", "docs", "ends", "sources", "counts", "names"])

    def handed(tries):
        rows, size = [], 0
        for row in pieces(tries):
            rows.append(row)
            size += len(row[2])
            if size > 1 << 14:
                yield out(rows)
                rows, size = [], 0
        yield out(rows)

    def built(counts, docs):
        """Tries of a task's counters, which are emptied."""
        tries: dict[str, Trie] = {lang: Trie() for lang in docs}
        known: dict[str, dict] = {lang: {} for lang in docs}
        for (lang, source), by_term in counts.items():
            leaves, trie = known[lang], tries[lang]
            for term, n in by_term.items():
                leaf = leaves.get(term)
                if leaf is None:
                    leaf = leaves[term] = trie.leaf(term)
                leaf.counts[source] = n
            by_term.clear()
        for lang, by_term in docs.items():
            for term, n in by_term.items():
                known[lang][term].docs = n
        return tries

    def work(batches):
        counts, docs = defaultdict(Counter), defaultdict(Counter)
        for b in batches:
            for i, (lang, source, t) in enumerate(zip(*_texts(b), strict=True), 1):
                if found := words(t.as_py()):
                    counts[lang or "", source or ""].update(found)
                    docs[lang or ""].update(set(found))
                if i % 64 == 0 and sum(map(len, counts.values())) > ENTRIES:
                    yield from handed(built(counts, docs))
                    counts, docs = defaultdict(Counter), defaultdict(Counter)
        yield from handed(built(counts, docs))

    return docs.mapInArrow(work, f"range int, lang string, {Flat.SCHEMA}")


def merged(pieces: DataFrame, least_docs: int) -> DataFrame:
    """Blocks of kept terms: id, lang, terms in order, and the counts by source of each; needs a range's pieces in one task."""

    def work(batches):
        rows = ((r, *x) for b in batches for r, *x in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for (at, lang), group in groupby(rows, lambda r: r[:2]):
            trie, known = Trie(), {}
            for r in group:
                merge(trie, known, *r[2:])
            flat, n = Flat(), 0
            for term, node in trie.walk():
                if node.docs < least_docs:
                    continue
                flat.add(term, node)
                if len(flat.docs) == BLOCK:
                    yield out(at, n, lang, flat)
                    flat, n = Flat(), n + 1
            if flat.docs:
                yield out(at, n, lang, flat)

    def out(at, n, lang, flat):
        shared, tails, _, ends, sources, counts, names = flat.columns()
        every = terms(shared, tails)
        next(every)
        totals = np.bincount(sources, minlength=len(names)) * 0
        np.add.at(totals, sources, counts)
        cols = ([f"{at} {n}"], [lang], [[t.decode("utf-8", "surrogatepass") for t in every]], [ends], [sources], [counts], [names], [totals.tolist()])
        kinds = (pa.string(), pa.string(), pa.list_(pa.string()), *(Flat.KINDS[i] for i in (3, 4, 5, 6)), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["block", "lang", "terms", "ends", "sources", "counts", "names", "totals"])

    kinds = "block string, lang string, terms array<string>, ends array<int>, sources array<int>, counts array<long>, names array<string>, totals array<long>"
    return pieces.repartition("range").sortWithinPartitions("range", "lang").mapInArrow(work, kinds)


def found(blocks: DataFrame, top: int) -> DataFrame:
    """Of blocks with ns (N of each name), n (N of the language) and v: rows of kind `pair` (source, item: what the terms add
    that both have), `count` (source, at: the number of terms of that count) and `term` (candidates)."""

    def sums(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, at = np.unique(key, return_inverse=True)
        out = np.zeros(len(keys), np.int64)
        np.add.at(out, at, value)
        return keys, out

    def block(lang, words_, ends, sources, counts, names, ns, n, v, pairs, hist, best):
        src, c = np.asarray(sources, np.int64), np.asarray(counts, np.int64)
        sizes = np.diff(np.asarray(ends, np.int64), prepend=0)
        term = np.repeat(np.arange(len(sizes)), sizes)
        total = np.asarray(ns, np.int64) + v
        p, p0 = share(c, total[src]), share(np.zeros_like(total), total)
        for (i, x), h in Counter(zip(sources, counts, strict=True)).items():
            hist[lang, names[i], x] += h
        # pairs of entries of a term, the terms in chunks of bounded expansion
        first, cum = np.cumsum(sizes) - sizes, np.cumsum(sizes * sizes)
        a = 0
        while a < len(sizes):
            z = max(a + 1, int(np.searchsorted(cum, (cum[a - 1] if a else 0) + (1 << 20), "right")))
            k = sizes[a:z]
            left = np.repeat(np.arange(first[a], first[z - 1] + k[-1]), np.repeat(k, k))
            right = np.arange(len(left)) - np.repeat(np.cumsum(k * k) - k * k, k * k)
            right = right % np.repeat(k, k * k) + np.repeat(first[a:z], k * k)
            i, j = src[left], src[right]
            value = spread(p[left], p[right]) - spread(p[left], p0[j]) - spread(p0[i], p[right]) + spread(p0[i], p0[j])
            keys, out = sums(i * len(names) + j, value)
            for key, x in zip(keys.tolist(), out.tolist(), strict=True):
                i_, j_ = divmod(key, len(names))
                if i_ != j_:
                    pairs[lang, names[i_], names[j_]] += x
            a = z
        whole = np.zeros(len(sizes), np.int64)
        np.add.at(whole, term, c)
        q = share(whole, np.full_like(whole, n + v))[term]
        f = spread(p, q)
        order = np.lexsort((term, -f, src))
        order = order[(p > q)[order]]
        groups = src[order]
        rank = np.arange(len(order)) - np.searchsorted(groups, groups)
        for o in order[rank < top].tolist():
            best.setdefault((lang, names[src[o]]), []).append((-int(f[o]), words_[term[o]].encode("utf-8", "surrogatepass")))

    def rows(pairs, hist, best):
        for (lang, s, t), x in pairs.items():
            yield lang, "pair", s, t, 0, x
        for (lang, s, c), x in hist.items():
            yield lang, "count", s, None, c, x
        for (lang, s), x in best.items():
            for f, t in sorted(x)[:top]:
                yield lang, "term", s, t.decode("utf-8", "surrogatepass"), 0, -f

    def out(*held):
        cols = list(zip(*rows(*held), strict=True)) or [()] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["lang", "kind", "source", "item", "at", "value"])

    def work(batches):
        pairs, hist, best = Counter(), Counter(), {}
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                block(*row, pairs, hist, best)
                for group, x in best.items():
                    if len(x) > 2 * top:
                        best[group] = sorted(x)[:top]
                if len(pairs) + len(hist) + sum(map(len, best.values())) > HELD:
                    yield out(pairs, hist, best)
                    pairs, hist, best = Counter(), Counter(), {}
        yield out(pairs, hist, best)

    kept = blocks.select("lang", "terms", "ends", "sources", "counts", "names", "ns", "n", "v")
    return kept.mapInArrow(work, "lang string, kind string, source string, item string, at long, value long")


def lone_terms(groups: DataFrame, hist: DataFrame) -> DataFrame:
    """lang, source, item and value of each pair, as if no term were shared: groups (lang, source, n, v) against groups."""

    def work(batches):
        for b in batches:
            for lang, source, n, v, at, h, items, ns in zip(*(c.to_pylist() for c in b.columns), strict=True):
                x, own = np.asarray(at or [], np.int64), np.asarray(h or [], np.int64)
                others = np.asarray(ns, np.int64)
                if not v:
                    mine = theirs = both = np.zeros(len(ns), np.int64)
                else:
                    p, p0 = share(x, np.full_like(x, n + v)), share(np.zeros(1, np.int64), np.full(1, n + v, np.int64))
                    q0 = share(np.zeros_like(others), others + v)
                    both = spread(p0, q0) * v
                    mine = np.array([int((own * (spread(p, q) - spread(p0, q))).sum()) for q in q0], np.int64)
                    theirs = np.array([int((own * (spread(q, p) - spread(q, p0))).sum()) for q in q0], np.int64)
                m = len(items)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * 2 * m), pa.array([source] * m + items), pa.array(items + [source] * m), pa.array(np.concatenate([mine + both, theirs]))], names=["lang", "source", "item", "value"])

    held = hist.groupBy("lang", "source").agg(F.collect_list("at").alias("at"), F.collect_list("value").alias("h"))
    mine = groups.join(held, ["lang", "source"], "left").select("lang", "source", "n", "v", "at", "h")
    # all ordered pairs of a language's sources are the result itself; the other side comes in 16 lists
    others = groups.groupBy("lang", F.pmod(F.xxhash64("source"), F.lit(16)).alias("b")).agg(F.collect_list("source").alias("items"), F.collect_list("n").alias("ns"))
    return mine.join(others.drop("b"), "lang").mapInArrow(work, "lang string, source string, item string, value long").where("source <> item")


def source_audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = 3, top: int = 200, ranges: int | None = None) -> DataFrame:
    """lang, source, part (pair or term), item, value and rank.

    pair: every other source of the language with its divergence; term: the top terms that the source has more of than its
    language. least_docs: a language's terms in fewer documents are left out."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(lang, F.lit("")).alias("lang"), F.coalesce(source, F.lit("")).alias("source"), F.col(text).alias("text"))
    blocks = settle(spark, lambda: merged(counted(rows, boundaries(rows, ranges or 4 * parts(spark))), least_docs))
    sums = blocks.select("lang", F.explode(F.arrays_zip("names", "totals")).alias("x")).groupBy("lang", F.col("x.names").alias("source")).agg(F.sum("x.totals").alias("n"))
    sizes = blocks.groupBy("lang").agg(F.sum(F.size("terms")).alias("v"))
    named = rows.groupBy("lang", "source").agg(F.lit(1).alias("one")).drop("one").join(sums, ["lang", "source"], "left").join(sizes, "lang", "left")
    groups = materialize(named.select("lang", "source", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("v", F.lit(0)).cast("long").alias("v")))
    whole = groups.groupBy("lang").agg(F.sum("n").alias("n"), F.max("v").alias("v"))
    own = blocks.select("block", "lang", F.posexplode("names").alias("i", "source")).join(groups.select("lang", "source", F.col("n").alias("m")), ["lang", "source"])
    held = own.groupBy("block", "lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("ns"))
    # each task hands on up to top terms of each group, so there are as many tasks as the kept terms ask for
    tasks = max(spark.sparkContext.defaultParallelism, whole.agg(F.coalesce(F.sum("v"), F.lit(0))).first()[0] // SPAN)
    seen = materialize(found(blocks.join(held, ["block", "lang"]).join(whole, "lang").coalesce(tasks), top))
    shared = seen.where("kind = 'pair'").select("lang", "source", "item", "value")
    hist = seen.where("kind = 'count'").groupBy("lang", "source", "at").agg(F.sum("value").alias("value"))
    every = lone_terms(groups, hist).unionByName(shared).groupBy("lang", "source", "item").agg(F.sum(F.col("value").cast("decimal(38,0)")).cast("long").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = every.withColumn("rank", rank).withColumn("part", F.lit("pair"))
    best = seen.where("kind = 'term'").select("lang", "source", "item", "value").withColumn("rank", rank).where(F.col("rank") <= top).withColumn("part", F.lit("term"))
    return pairs.unionByName(best).select("lang", "source", "part", "item", "value", "rank")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit(table(spark, sf_dir, "documents"))


#: The query in DuckDB, with a row for each pair of groups and kept term.
SQL = f"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
 w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
 k AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
 g AS (SELECT DISTINCT lang, source FROM d),
 v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
 c AS (SELECT w.lang, w.source, w.term, count(*) AS c FROM w JOIN k ON w.lang = k.lang AND w.term = k.term GROUP BY ALL),
 n AS (SELECT lang, source, sum(c) AS n FROM c GROUP BY ALL),
 p AS (SELECT k.lang, g.source, k.term, coalesce(c.c, 0) AS c, 1 + ({SCALE}::HUGEINT * (coalesce(c.c, 0) + 1)) // (coalesce(n.n, 0) + v.v) AS p FROM k JOIN g ON g.lang = k.lang JOIN v ON v.lang = k.lang LEFT JOIN n ON n.lang = k.lang AND n.source = g.source LEFT JOIN c ON c.lang = k.lang AND c.source = g.source AND c.term = k.term),
 q AS (SELECT k.lang, k.term, 1 + ({SCALE}::HUGEINT * (b.c + 1)) // (m.n + v.v) AS q FROM k JOIN v ON v.lang = k.lang JOIN (SELECT lang, sum(n) AS n FROM n GROUP BY lang) m ON m.lang = k.lang JOIN (SELECT lang, term, sum(c) AS c FROM c GROUP BY ALL) b ON b.lang = k.lang AND b.term = k.term),
 s AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
 pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
 best AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, (((p.p - q.q) * (p.p - q.q)) // q.q)::BIGINT AS value FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.c > 0 AND p.p > q.q)
 SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM best)) WHERE part = 'pair' OR rank <= 200"""
