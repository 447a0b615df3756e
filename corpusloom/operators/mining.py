"""Vector search and negative mining. Stand-in: embeddings (goal and cluster = label; text vector = a permuted partner's).

Exact top-k runs pack against pack (nearest): vectors and what is compared with them travel in packs, and the k best of each
query are sent once for each stripe of packs. No pair of rows is ever emitted beyond those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import cosine
from ..streaming.limiter import greedy
from . import kmeans, nearest
from .dialog import query, table

BLOCK = 4096


def knn(vectors: DataFrame, k: int, key: str = "vec_id", value: str = "embedding", other_goal: str | None = None, floor: float | None = None, block: int = BLOCK) -> DataFrame:
    """key, other, similarity and rank (from 1) of the k most similar other rows; self is left out by key, ties go to the smaller key."""
    return nearest.search(vectors, k, F.col(key), F.col(value), F.col(other_goal) if other_goal else None, floor, block).withColumnRenamed("id", key)


E2 = "(SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)"
SIM = f"(SELECT a.vec_id, b.vec_id AS other, a.label AS l1, b.label AS l2, list_cosine_similarity(a.e, b.e) AS s FROM {E2} a JOIN {E2} b ON a.vec_id <> b.vec_id)"
RANKED = f"(SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(s, 12) DESC, other) AS r FROM {SIM} {{}})"


@query("knn_cosine", f"SELECT vec_id, other, r AS rank, round(s, 6) AS similarity FROM {RANKED.format('')} WHERE r <= 5")
def knn_cosine(spark, sf_dir):
    return knn(table(spark, sf_dir, "embeddings"), 5).select("vec_id", "other", F.col("rank").cast("long").alias("rank"), F.round("similarity", 6).alias("similarity"))


@query("knn_pruned", f"SELECT vec_id, other, r AS rank, round(s, 6) AS similarity FROM {RANKED.format('')} WHERE r <= 5")
def knn_pruned(spark, sf_dir):
    """As knn_cosine, over an inverted file of blocks of 64 rows."""
    found = nearest.search(table(spark, sf_dir, "embeddings"), 5, F.col("vec_id"), F.col("embedding"), block=64)
    return found.select(F.col("id").alias("vec_id"), "other", F.col("rank").cast("long").alias("rank"), F.round("similarity", 6).alias("similarity"))


@query("blacklist_anti", f"SELECT vec_id FROM {E2} a WHERE NOT EXISTS (SELECT 1 FROM {E2} b WHERE b.vec_id < 30 AND list_cosine_similarity(a.e, b.e) > 0.75)")
def blacklist_anti(spark, sf_dir):
    """30 fixed phrases are a bounded side: they travel to every task as one array of vectors."""
    e = table(spark, sf_dir, "embeddings")
    black = F.broadcast(e.where("vec_id < 30").agg(F.collect_list("embedding").alias("bad")))
    return e.crossJoin(black).where(~F.exists("bad", lambda b: cosine(F.col("embedding"), b) > 0.75)).select("vec_id")


def partner(vectors: DataFrame) -> DataFrame:
    """vec_id and text: the vector of the partner (7 * id + 3) mod n."""
    n = F.broadcast(vectors.agg(F.count(F.lit(1)).alias("n")))
    text = vectors.select(F.col("vec_id").alias("j"), F.col("embedding").alias("text"))
    return vectors.crossJoin(n).select("vec_id", ((F.col("vec_id") * 7 + 3) % F.col("n")).alias("j")).join(text, "j").drop("j")


def candidates(vectors: DataFrame, texts: DataFrame, k: int = 100, low: float = 0.15, tiers: tuple = (0.2, 0.3, 0.4), good: DataFrame | None = None) -> DataFrame:
    """vec_id, other, rank and tier: those of the k visually nearest rows that have another goal, pass the answer test (good:
    keys that do) and a text threshold, the first of which is the tier. The k nearest are taken before any is left out; texts
    are compared where the rows meet, so no vector is joined to a pair."""
    passed = vectors.select("vec_id", F.lit(True).alias("passed")) if good is None else good.select("vec_id", F.lit(True).alias("passed")).distinct()
    x = vectors.join(texts, "vec_id", "left").join(passed, "vec_id", "left").withColumn("whole", F.col("label").isNotNull() & F.col("text").isNotNull())
    text = F.coalesce("text", F.transform("embedding", lambda v: v * 0))  # such rows have no pairs
    near = nearest.with_texts(x, k, F.col("vec_id"), F.col("embedding"), text, F.col("whole") & F.col("passed"), F.col("label"), low).withColumnRenamed("id", "vec_id")
    tier = F.lit(None).cast("int")
    for i in reversed(range(len(tiers))):
        tier = F.when(F.col("text") < tiers[i], i + 1).otherwise(tier)
    return near.withColumn("tier", tier).where("tier is not null").select("vec_id", "other", "rank", "tier").join(x.where(~F.col("whole")).select("vec_id"), "vec_id", "left_anti")


def hard_negatives(vectors: DataFrame, texts: DataFrame, **options) -> DataFrame:
    """The visually nearest candidate of the first tier that has any."""
    found = candidates(vectors, texts, **options)
    return found.groupBy("vec_id").agg(F.min(F.struct("tier", "rank", "other")).alias("m")).select("vec_id", F.col("m.other").alias("negative"), F.col("m.tier").cast("long").alias("tier"))


TXT = f"(SELECT a.vec_id, b.e AS t FROM {E2} a JOIN {E2} b ON b.vec_id = (a.vec_id * 7 + 3) % (SELECT count(*) FROM embeddings))"


def _hard_sql(good: str = "true") -> str:
    return f"(WITH n AS (SELECT * FROM {RANKED.format('')} WHERE r <= 100 AND l1 <> l2 AND s >= 0.15 AND {good}), c AS (SELECT n.*, round(list_cosine_similarity(x.t, y.t), 9) AS ts FROM n JOIN {TXT} x ON x.vec_id = n.vec_id JOIN {TXT} y ON y.vec_id = n.other), t AS (SELECT *, CASE WHEN ts < 0.2 THEN 1 WHEN ts < 0.3 THEN 2 WHEN ts < 0.4 THEN 3 END AS tier FROM c) SELECT vec_id, other AS negative, tier::BIGINT AS tier FROM t WHERE tier IS NOT NULL QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY tier, r) = 1)"


@query("hard_negative_independent", f"SELECT * FROM {_hard_sql()}")
def hard_negative_independent(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return hard_negatives(e, partner(e))


@query("diverse_negative", f"SELECT vec_id, other AS negative FROM {SIM} WHERE l1 <> l2 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(s, 12), other) = 1")
def diverse_negative(spark, sf_dir):
    """The least similar row of another cluster: the nearest to the negated vector."""
    e = table(spark, sf_dir, "embeddings")
    flipped = e.select(F.col("vec_id"), "label", F.transform("embedding", lambda x: -x.cast("double")).alias("embedding"))
    return nearest.nearest_of(flipped, e).select("vec_id", F.col("other").alias("negative"))


@query("similarity_stats", f"SELECT round(min(s), 6) AS lo, round(max(s), 6) AS hi, round(avg(s), 6) AS mean, round(stddev_pop(s), 6) AS std FROM {RANKED.format('')} WHERE r <= 5")
def similarity_stats(spark, sf_dir):
    s = F.col("similarity")
    return knn(table(spark, sf_dir, "embeddings"), 5).agg(F.round(F.min(s), 6).alias("lo"), F.round(F.max(s), 6).alias("hi"), F.round(F.avg(s), 6).alias("mean"), F.round(F.stddev_pop(s), 6).alias("std"))


@query("cluster_transition", f"SELECT round(avg((l1 <> l2)::INT), 6) AS ratio FROM {RANKED.format('')} WHERE r <= 5")
def cluster_transition(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    labels = e.select("vec_id", "label")
    x = knn(e, 5).join(labels, "vec_id").join(labels.select(F.col("vec_id").alias("other"), F.col("label").alias("l2")), "other")
    return x.agg(F.round(F.avg((F.col("label") != F.col("l2")).cast("int")), 6).alias("ratio"))


def plain_phrase(answer: Column) -> Column:
    return F.lower(F.btrim(F.coalesce(answer, F.lit("")), F.lit(" \t\n\x0b\x0c\r")))


def good_answer(answer: Column, text: Column, blacklist: list[list[float]], least: int = 20, alike: float = 0.75) -> Column:
    """Long enough, and unlike every vector of the blacklist (a fixed list of phrases)."""
    bad = F.lit(False)
    if blacklist:
        vectors = F.array(*[F.array(*[F.lit(float(x)) for x in v]) for v in blacklist])
        bad = F.exists(vectors, lambda b: cosine(text, b) > alike)
    return (F.length(plain_phrase(answer)) >= least) & ~F.coalesce(bad, F.lit(False))


def blacklist_of(vectors: DataFrame, n: int = 30) -> list[list[float]]:
    """Stand-in of a fixed list of phrases: the vectors of the first rows."""
    return [list(r.embedding) for r in vectors.where(F.col("vec_id") < n).select("embedding").collect()]


ANSWERS = "(SELECT e.vec_id, CASE WHEN e.vec_id % 5 = 0 THEN 'to the ' || p.p_name ELSE 'Fly over to the ' || p.p_name || ' and the ' || lower(p.p_type) || ' roof ' END AS answer FROM embeddings e JOIN part p ON p.p_partkey = e.vec_id % (SELECT count(*) FROM part))"


def said(spark, sf_dir: str) -> DataFrame:
    """vec_id and answer: texts made of the parts' names, one in five too short."""
    e, part = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "part")
    n = F.broadcast(part.agg(F.count(F.lit(1)).alias("parts")))
    answer = F.when(F.col("vec_id") % 5 == 0, F.concat(F.lit("to the "), "p_name")).otherwise(F.concat(F.lit("Fly over to the "), "p_name", F.lit(" and the "), F.lower("p_type"), F.lit(" roof ")))
    return e.crossJoin(n).withColumn("p_partkey", F.col("vec_id") % F.col("parts")).join(part, "p_partkey").select("vec_id", answer.alias("answer"))


GOOD = f"(SELECT a.vec_id FROM {ANSWERS} a JOIN {TXT} t ON t.vec_id = a.vec_id WHERE length(trim(a.answer)) >= 20 AND NOT EXISTS (SELECT 1 FROM {E2} b WHERE b.vec_id < 30 AND list_cosine_similarity(t.t, b.e) > 0.75))"
_GOOD = f"other IN {GOOD}"
_DIVERSE = f"(SELECT vec_id, other AS negative FROM {SIM} WHERE l1 <> l2 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(s, 12), other) = 1)"
_DRIVER = f"(SELECT e.vec_id, coalesce(h.negative, d.negative) AS negative, CASE WHEN h.negative IS NOT NULL THEN 'hard' WHEN d.negative IS NOT NULL THEN 'diverse' END AS kind, h.tier FROM embeddings e LEFT JOIN {_hard_sql(_GOOD)} h USING (vec_id) LEFT JOIN {_DIVERSE} d USING (vec_id))"


def mined(spark, sf_dir) -> DataFrame:
    """Hard negatives first; anchors without one get a diverse one. Only rows with a good answer are hard negatives."""
    e = table(spark, sf_dir, "embeddings")
    texts = partner(e)
    good = texts.join(said(spark, sf_dir), "vec_id").where(good_answer(F.col("answer"), F.col("text"), blacklist_of(e))).select("vec_id")
    hard = hard_negatives(e, texts, good=good)
    diverse = diverse_negative(spark, sf_dir).withColumnRenamed("negative", "other")
    x = e.select("vec_id").join(hard, "vec_id", "left").join(diverse, "vec_id", "left")
    return x.select("vec_id", F.coalesce("negative", "other").alias("negative"), F.when(F.col("negative").isNotNull(), "hard").when(F.col("other").isNotNull(), "diverse").alias("kind"), "tier")


@query("mining_driver", f"SELECT * FROM {_DRIVER}")
def mining_driver(spark, sf_dir):
    return mined(spark, sf_dir)


@query("mining_counters", f"SELECT count(*) AS attempts, count(negative) AS mined, count(*) FILTER (kind = 'hard') AS hard, count(*) FILTER (kind = 'hard' AND tier > 2) AS relaxed, count(*) FILTER (kind = 'diverse') AS fallbacks, round(count(negative) / count(*)::DOUBLE, 6) AS rate FROM {_DRIVER}")
def mining_counters(spark, sf_dir):
    x = mined(spark, sf_dir)
    every = F.count(F.lit(1))
    return x.agg(every.alias("attempts"), F.count("negative").alias("mined"), F.count_if(F.col("kind") == "hard").alias("hard"), F.count_if((F.col("kind") == "hard") & (F.col("tier") > 2)).alias("relaxed"), F.count_if(F.col("kind") == "diverse").alias("fallbacks"), F.round(F.count("negative") / every, 6).alias("rate"))


@query("mining_lengths", f"SELECT kind, round(avg(length('go to ' || negative * 37)), 6) AS mean, round(stddev_pop(length('go to ' || negative * 37)), 6) AS std FROM {_DRIVER} WHERE negative IS NOT NULL GROUP BY 1")
def mining_lengths(spark, sf_dir):
    """Mean and deviation of the lengths of mined answers."""
    x = mined(spark, sf_dir).where("negative is not null").withColumn("n", F.length(F.concat(F.lit("go to "), (F.col("negative") * 37).cast("string"))))
    return x.groupBy("kind").agg(F.round(F.avg("n"), 6).alias("mean"), F.round(F.stddev_pop("n"), 6).alias("std"))


def limited(found: DataFrame, phrases: DataFrame, window: int = 1000) -> DataFrame:
    """anchor and other: candidates through the phrase limiter, strictly over the first two tiers, then relaxed over all.
    phrases: vec_id, phrase."""
    x = found.join(phrases.select(F.col("vec_id").alias("other"), "phrase"), "other")
    ts = F.element_at(F.array(F.lit(0.1), F.lit(0.25), F.lit(0.35)), F.col("tier"))  # any similarity of the tier
    return greedy(x.select(F.col("vec_id").alias("anchor"), "rank", "other", "phrase", ts.alias("ts")), window)


@query("mining_limited")
def mining_limited(spark, sf_dir):
    """Greedy in the order of anchors: SQL has no form of it; tests hold it against a loop."""
    e = table(spark, sf_dir, "embeddings")
    phrases = e.select("vec_id", F.concat(F.lit("phrase "), (F.col("vec_id") % 40).cast("string")).alias("phrase"))
    return limited(candidates(e, partner(e)), phrases)


def clusters(vectors: DataFrame, k: int = 30, seed: int = 42, key: str = "vec_id", value: str = "embedding", starts: int = 10) -> DataFrame:
    """key and cluster by the cheapest of several seeded starts of k-means; with fewer rows than clusters, one of two by a hash of the key."""
    if vectors.limit(k).count() < k:
        return vectors.select(key, F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(2)).cast("int").alias("cluster"))
    x = vectors.select(key, F.transform(value, lambda v: v.cast("double")).alias("v"))
    return kmeans.assign(x, kmeans.fit(x.select("v"), k, starts, seed)[0], key)


@query("kmeans_clusters")
def kmeans_clusters(spark, sf_dir):
    """Labels of clusters depend on the library: rows only, tests check the partition."""
    return clusters(table(spark, sf_dir, "embeddings"))
