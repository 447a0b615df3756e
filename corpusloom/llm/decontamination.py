"""Benchmark decontamination with SimHash fingerprints of item-sized windows, on DataFrame functions alone.

A window of a document with as many words as a benchmark item is a leak of it if their weighted similarity (of counts of
shingles: sum of minima over sum of maxima) is `threshold` or more; shingles have `size` words, or all of a shorter
item's.
1. An exact filter that drops no window: similarity is at most shared shingles over the item's, so only documents that share
   at least threshold of an item's shingles can hold such a window. A shared shingle at place p
   of the document and q of the item is in line with a start at p - q. These are parted where they lie so far apart that
   no window holds shingles of both sides; a window that starts before the least or after the greatest of such a cluster
   loses no shared shingle when it moves there, so all starts from the least to the greatest are tried.
2. Windows and items get SimHash fingerprints. These are cut into radius + 1 blocks, so that any two fingerprints within the
   radius agree in a block (multi-index); pairs that meet in a block and lie within the radius are candidates.
3. The exact similarity of the candidates decides.

Words are lower-cased. Null and blank texts and items match nothing; documents shorter than an item are one window.
Repeated rows and null ids are judged by id and text, once for each distinct pair of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, let, materialize, settle, table, words

SIZE = 5
THRESHOLD = 0.8
#: A similarity of 0.8 means about 10 differing bits of 64, with a deviation of 3; this leaves four deviations.
RADIUS = 22
#: Rows up to which a counted table may be broadcast; beyond, joins shuffle.
BROADCAST_ROWS = 200_000


def shingle_hashes(w: Column, m: int) -> Column:
    """Hash of each run of m words; empty if there are fewer."""
    return F.when(F.size(w) >= m, F.transform(F.sequence(F.lit(0), F.size(w) - m), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(m)]))).otherwise(F.array().cast("array<long>"))


def simhash(hs: Column) -> Column:
    """64-bit fingerprint: bits set in more than half of the hashes."""
    bit = lambda b: F.when(2 * F.size(F.filter(hs, lambda h: F.getbit(h, b) == 1)) > F.size(hs), F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))
    return F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.call_function("shiftleft", bit(b), b)), F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))


def blocks(fp: Column, radius: int) -> Column:
    """(block, value) of radius + 1 blocks of nearly equal width."""
    n = radius + 1
    cuts = [64 * i // n for i in range(n + 1)]
    return F.array(*[F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1).cast("long")).alias("value")) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))])


def counted(hs: Column) -> Column:
    """Sorted array of (hash, which occurrence of it): intersections of such arrays intersect the counts."""

    def number(s: Column) -> Column:
        # the occurrence is the distance from the first equal one in the sorted array
        return F.transform(s, lambda x, i: F.struct(x.alias("h"), (i - F.array_position(s, x) + 1).alias("c")))

    return let(F.sort_array(hs), number)


def similarity(a: Column, b: Column) -> Column:
    """Sum of minima over sum of maxima of the counts in two arrays of hashes."""
    common = F.size(F.array_intersect(counted(a), counted(b))).cast("double")
    return common / (F.size(a) + F.size(b) - common)


def _sized(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", size: int = SIZE, threshold: float = THRESHOLD, radius: int = RADIUS) -> DataFrame:
    """k (hash of id and text), key, item_id, start (word), n_words, distance and similarity of the best window of each document and item."""
    spark = docs.sparkSession
    keyed = docs.select(F.xxhash64(F.col(key), F.col(text)).alias("k"), F.col(key).alias("key"), F.lower(F.col(text)).alias("t"))
    listed = items.select(F.col(item_key).cast("long").alias("item_id"), words(F.lower(F.col(item_text))).alias("w")).withColumn("n", F.size("w")).where("n > 0").distinct()
    out = None
    for m in sorted(r.m for r in listed.select(F.least(F.lit(size), "n").alias("m")).distinct().collect()):  # size values at most
        mine = listed.where(F.least(F.lit(size), "n") == m).withColumn("hs", shingle_hashes(F.col("w"), m)).select("item_id", "n", "hs", simhash(F.col("hs")).alias("item_fp"))
        mine = materialize(mine)
        places = mine.select("item_id", "n", F.size("hs").alias("total"), F.posexplode("hs").alias("q", "h"))
        n_places, n_items = places.count(), mine.count()
        shingles = keyed.select("k", F.posexplode(let(words(F.col("t")), lambda w: shingle_hashes(w, m))).alias("p", "h"))
        hits = materialize(shingles.join(_sized(places, n_places), "h").select("k", "item_id", "n", "total", (F.col("p") - F.col("q")).alias("at")).groupBy("k", "item_id", "n", "total", "at").agg(F.count(F.lit(1)).alias("c")))
        enough = hits.groupBy("k", "item_id").agg(F.sum("c").alias("c"), F.max("total").alias("total")).where(F.col("c") >= threshold * F.col("total")).select("k", "item_id")
        by_start = Window.partitionBy("k", "item_id", "n").orderBy("at")
        apart = hits.join(enough, ["k", "item_id"], "left_semi").withColumn("cut", (F.col("at") - F.lag("at").over(by_start) > 2 * (F.col("total") - 1)).cast("int"))
        clusters = apart.withColumn("cluster", F.sum(F.coalesce("cut", F.lit(0))).over(by_start)).groupBy("k", "item_id", "n", "cluster").agg(F.min("at").alias("lo"), F.max("at").alias("hi"), F.sum("c").alias("c"), F.max("total").alias("total")).where(F.col("c") >= threshold * F.col("total"))
        starts = materialize(clusters.groupBy("k").agg(F.collect_set(F.struct("n", "lo", "hi")).alias("at")))
        n_starts = starts.agg(F.coalesce(F.sum(F.size("at")), F.lit(0))).first()[0]
        held = keyed.join(_sized(starts, n_starts), "k").select("k", "key", "at", words(F.col("t")).alias("w")).dropDuplicates(["k"])
        hashed = held.select("k", "key", F.size("w").alias("len"), shingle_hashes(F.col("w"), m).alias("hs"), "at")
        clamp = lambda at, n: F.greatest(F.lit(0), F.least(at, F.col("len") - n))
        tried = F.flatten(F.transform("at", lambda x: F.transform(F.sequence(clamp(x["lo"], x["n"]), clamp(x["hi"], x["n"])), lambda s: F.struct(x["n"].alias("n"), s.alias("start")))))
        window = hashed.select("k", "key", "hs", F.explode(F.array_distinct(tried)).alias("x"))
        window = window.select("k", "key", "x.n", "x.start", F.slice("hs", F.col("x.start") + 1, F.col("x.n") - m + 1).alias("hs"))
        window = materialize(window.withColumn("fp", simhash(F.col("hs"))))
        cut = window.select("k", "n", "start", "fp", F.explode(blocks(F.col("fp"), radius)).alias("b")).select("k", "n", "start", "fp", "b.*")
        indexed = mine.select("item_id", "n", "item_fp", F.explode(blocks(F.col("item_fp"), radius)).alias("b")).select("item_id", "n", "item_fp", "b.*")
        near = cut.join(_sized(indexed, n_items * (radius + 1)), ["n", "block", "value"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius).select("k", "n", "start", "item_id", F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))).alias("distance")).distinct()
        judged = near.join(window.select("k", "key", "n", "start", "hs"), ["k", "n", "start"]).join(_sized(mine.select("item_id", "n", F.col("hs").alias("item_hs")), n_places), ["item_id", "n"])
        found = judged.withColumn("similarity", similarity(F.col("hs"), F.col("item_hs"))).where(F.col("similarity") >= threshold)
        best = found.groupBy("k", "key", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("s"), (-F.col("distance")).alias("d"), "n")).alias("b"))
        best = best.select("k", "key", "item_id", (-F.col("b.s")).alias("start"), F.col("b.n").alias("n_words"), (-F.col("b.d")).alias("distance"), "b.similarity")
        out = best if out is None else out.unionByName(best)
    if out is None:
        kind = docs.schema[key].dataType.simpleString()
        return spark.createDataFrame([], f"k long, `{key}` {kind}, item_id long, start int, n_words int, distance int, similarity double")
    return out.withColumnRenamed("key", key)


def decontaminate(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without those that hold a leak."""
    bad = settle(docs.sparkSession, lambda: leaks(docs, items, key, text).select("k").distinct())
    k = fresh(docs, "k")
    return docs.withColumn(k, F.xxhash64(F.col(key), F.col(text))).join(_sized(bad.withColumnRenamed("k", k), bad.count()), k, "left_anti").select(*docs.columns)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = settle(spark, lambda: leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
    return found.select("doc_id", "item_id", "start", "n_words", "distance", F.round("similarity", 6).alias("similarity"))
