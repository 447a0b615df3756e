"""Sharding by sampled splitters (law `bytes`: sizes near equal).

Every record gets a key of 64 bits: 40 bits of its text's hash, then 24 of its id's, so equal texts stand together and a
large group of them can still be cut. Size-weighted samples of keys give quantile boundaries of fine ranges; ranges that
turn out overfull are subdivided by further samples from them. Exact byte offsets of the ranges and running sums inside
them then cut the key order into shards of equal bytes.

Null texts count as empty (size 1); null ids and repeated rows are records like any other, rows that are equal in id and
text in any order among themselves; very long texts count by their bytes; an empty table gives no rows. Extra columns are
left out of the result; if the key has the name of a computed column, that column's name gets an underscore.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

WIDTH = 32


def _search(key: Column, bounds: list[int]) -> Column:
    """Number of boundaries up to key, by a search over every WIDTH-th one and then the stretch after it."""
    longs = lambda x: F.array(*[F.lit(b).cast("long") for b in x]).cast("array<long>")
    if not bounds:
        return F.lit(0)
    count = lambda a: F.aggregate(a, F.lit(0), lambda s, b: s + F.when(b <= key, 1).otherwise(0))
    coarse = bounds[WIDTH - 1 :: WIDTH]
    stretches = F.array(*[longs(bounds[i * WIDTH : i * WIDTH + WIDTH - 1]) for i in range(len(coarse) + 1)])
    at = count(longs(coarse))
    return F.transform(F.array(at), lambda c: c * WIDTH + count(F.get(stretches, c)))[0]


def splitters(rows: DataFrame, total: int, ranges: int, over: int = 24, bounds: list[int] | None = None, rounds: int = 3) -> list[int]:
    """Sorted boundaries of about so many ranges of near equal bytes; about `over` samples stand for each range."""
    want = float(total) / ranges / over  # bytes for each sample
    chance = F.xxhash64("key", "size", F.lit(rounds)).bitwiseAND(F.lit((1 << 53) - 1)).cast("double") / float(1 << 53)

    def sample(df: DataFrame, step: int) -> list[int]:
        """Every step-th of the drawn keys; copies come as one row with a weight."""
        drawn = df.where(chance * want < F.col("size")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).orderBy("key").collect()  # about ranges * over keys at most
        out, seen = [], 0
        for r in drawn:
            if (seen + r.n) // step > seen // step:
                out.append(r.key)
            seen += r.n
        return out

    if bounds is None:
        bounds = sample(rows, over)
    sizes = rows.groupBy(_search(F.col("key"), bounds).alias("r")).agg(F.sum("size").alias("b"), F.min("key").alias("lo"), F.max("key").alias("hi"))
    full = [r.r for r in sizes.where((F.col("b") > 2.0 * total / ranges) & (F.col("lo") < F.col("hi"))).collect()]
    if not full or not rounds:
        return bounds
    more = sample(rows.where(_search(F.col("key"), bounds).isin(full)), over // 2)
    return splitters(rows, total, ranges, over, sorted({*bounds, *more}), rounds - 1)


def shard(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text", ranges: int | None = None) -> DataFrame:
    """key, size, text_crc32, shard and slot of every record."""
    body = F.coalesce(F.col(text), F.lit(""))
    split_key = F.xxhash64(body).bitwiseAND(F.lit(-(1 << 24)).cast("long")).bitwiseOR(F.xxhash64(F.col(key)).bitwiseAND(F.lit((1 << 24) - 1).cast("long")))
    rows = materialize(docs.select(F.col(key).alias("id"), (F.octet_length(body).cast("long") + 1).alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), split_key.alias("key")))
    named = lambda c: f"{c}_" if c == key.lower() else c
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    if not n:
        return rows.select(F.col("id").alias(key), F.col("size").alias(named("size")), F.col("text_crc32").alias(named("text_crc32")), F.lit(0).alias(named("shard")), F.lit(0).cast("long").alias(named("slot")))
    bounds = splitters(rows, total, ranges or max(shards, min(4096, n // 256)))
    placed = rows.withColumn("r", _search(F.col("key"), bounds))
    before = {}
    bytes_, count = 0, 0
    for r in placed.groupBy("r").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).orderBy("r").collect():  # a row for each range
        before[r.r] = (bytes_, count)
        bytes_, count = bytes_ + r.b, count + r.n
    offsets = F.array(*[F.struct(F.lit(before.get(i, (0, 0))[0]).cast("long").alias("b"), F.lit(before.get(i, (0, 0))[1]).cast("long").alias("n")) for i in range(max(before) + 1)])
    w = Window.partitionBy("r").orderBy("key", "id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = F.get(offsets, F.col("r"))
    ranked = materialize(placed.select("*", (F.sum("size").over(w) - F.col("size") + at["b"]).alias("start"), (F.count(F.lit(1)).over(w) - 1 + at["n"]).alias("rank")).withColumn("shard", F.expr(f"cast(least(start div {-(-total // shards)}, {shards - 1}) as int)")))
    first = {r.shard: r.m for r in ranked.groupBy("shard").agg(F.min("rank").alias("m")).collect()}
    starts = F.array(*[F.lit(first.get(s, 0)).cast("long") for s in range(shards)])
    slot = F.col("rank") - F.get(starts, F.col("shard"))
    return ranked.select(F.col("id").alias(key), *[F.col(c).alias(named(c)) for c in ("size", "text_crc32", "shard")], slot.alias(named("slot")))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
