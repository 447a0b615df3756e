"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints of 64 bits are split into partitions of correlated bits; a dynamic programme allots each partition a
threshold (unequal, -1 leaves it out) so that thresholds sum to radius - partitions + 1, at the least estimated cost
of probes and candidates. Any two fingerprints within the radius then meet in a bucket of some partition, where they are
verified; a bucket gives one link for each fingerprint, to the smallest one that it reaches there. Buckets of over BUCKET
entries aren't compared: their fingerprints go through the star of their one-bit
neighbours, which is exact for a radius of 2 (two fingerprints differ in at most two bits if and only if some word
differs from each in at most one) and linear in their number.

Null and blank texts have the fingerprint zero and link like any other; equal fingerprints are collapsed before any
join, so copies cost nothing; repeated rows stay, each with its component; the smallest doc_id ignores nulls.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, materialize, release, scratch, settle, table

RADIUS = 2
BUCKET = 4096
#: Cost of comparing two fingerprints against that of a row that is shuffled; and the rows of a star.
COMPARE, STAR = 0.005, 65
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None, size: int = 3) -> int:
    """Unsigned 64-bit SimHash over word shingles, repeats included."""
    w = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not w:
        return 0
    joined, h = b" ".join(w), xxhash.xxh64_intdigest
    if len(w) <= size:
        hashes = [h(joined, 42)]
    else:
        ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
        starts = np.concatenate([[0], ends[:-size] + 1])
        hashes = [h(joined[a:b], 42) for a, b in zip(starts.tolist(), ends[size - 1 :].tolist(), strict=True)]
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        block = np.array(hashes[i : i + (1 << 14)], "<u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(block, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, text: str = "text", size: int = 3) -> DataFrame:
    """Without the text, and with fp, the fingerprint as a signed long."""
    rest = [c for c in docs.columns if c != text]

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), size) for t in b.column(b.num_columns - 1)], np.uint64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fps.view(np.int64))], names=[*rest, "fp"])

    kinds = docs.select(*rest).schema
    return docs.select(*rest, text).mapInArrow(run, T.StructType([*kinds.fields, T.StructField("fp", T.LongType())]))


def bit_counts(fps: DataFrame) -> np.ndarray:
    """64 x 64: in how many fingerprints both bits are set, over all of them."""

    def run(batches):
        total = np.zeros((64, 64))
        for b in batches:
            bits = np.unpackbits(b.column(0).to_numpy(zero_copy_only=False).astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            for i in range(0, len(bits), 1 << 16):
                total += bits[i : i + (1 << 16)].T @ bits[i : i + (1 << 16)]
        i, j = np.triu_indices(64)
        yield pa.RecordBatch.from_arrays([pa.array((i * 64 + j).astype(np.int32)), pa.array(total[i, j].astype(np.int64))], names=["ij", "n"])

    out = np.zeros((64, 64))
    for r in fps.select("fp").mapInArrow(run, "ij int, n long").groupBy("ij").agg(F.sum("n").alias("n")).collect():  # 2080 rows at any size
        out[r.ij // 64, r.ij % 64] = out[r.ij % 64, r.ij // 64] = r.n
    return out


def correlated_groups(both: np.ndarray, n: int, m: int) -> list[list[int]]:
    """Bits dealt to m partitions of nearly equal width, the most correlated together."""
    p = both.diagonal() / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    left, out = list(range(64)), []
    for i in range(m):
        width = len(left) // (m - i)
        group = [max(left, key=lambda b: (corr[b, left].sum(), -b))]
        left.remove(group[0])
        while len(group) < width:
            group.append(max(left, key=lambda b: (corr[b, group].mean(), -b)))
            left.remove(group[-1])
        out.append(sorted(group))
    return out


def _mask(bits: list[int]) -> int:
    return int(np.array(sum(1 << b for b in bits), np.uint64).view(np.int64))


def allot(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Dynamic programme: thresholds e >= -1 with sum(e + 1) = total at the least sum of costs[i][e + 1]."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for c in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for k, x in enumerate(c):
                if used + k <= total and (used + k not in step or cost + x < step[used + k][0]):
                    step[used + k] = (cost + x, [*chosen, k - 1])
        best = step
    return best[total]


def plan(fps: DataFrame, radius: int = RADIUS, partitions: tuple = (2, 3, 4)) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition that is probed, from counts over all distinct fingerprints."""
    n = fps.count()
    both = bit_counts(fps)
    groups = {m: correlated_groups(both, n, m) for m in partitions}
    keys = [(m, i) for m in partitions for i in range(m)]
    entries = fps.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(_mask(groups[m][i])).cast("long")).alias("v")) for k, (m, i) in enumerate(keys)])).alias("e")).select("e.*")
    pairs = {keys[r.k]: float(r.p) for r in entries.groupBy("k", "v").count().groupBy("k").agg(F.sum(F.when(F.col("count") <= BUCKET, COMPARE * F.col("count") * (F.col("count") - 1) / 2).otherwise(1.0 * STAR * F.col("count"))).alias("p")).collect()}
    p = both.diagonal() / max(n, 1)
    odds = (d := 2 * p * (1 - p)) / np.maximum(1 - d, 1e-9)

    def cost(m: int, i: int) -> list[float]:
        out, bits = [0.0], groups[m][i]
        probes = near = 1.0
        for e in range(radius + 1):
            if e:
                probes *= (len(bits) - e + 1) / e
                near *= odds[bits].sum() / e
            out.append(out[-1] + n * probes + pairs.get((m, i), 0.0) * near)
        return out

    options = [(*allot([cost(m, i) for i in range(m)], radius + 1), m) for m in partitions]
    _, chosen, m = min(options, key=lambda x: x[0])
    return [(bits, e) for bits, e in zip(groups[m], chosen, strict=True) if e >= 0]


def _flips(value: Column, bits: list[int], e: int) -> Column:
    """Array of all words that differ from value in exactly e of bits."""
    masks = [0] if e == 0 else [1 << b for b in bits] if e == 1 else [1 << a | 1 << b for k, a in enumerate(bits) for b in bits[:k]]
    signed = np.array(masks, np.uint64).view(np.int64).tolist()
    return F.transform(F.array(*[F.lit(x).cast("long") for x in signed]), lambda x: value.bitwiseXOR(x))


def _bucket_links(radius: int):
    """For each bucket, (smallest that is reached, fingerprint) where they differ; an index entry links with any entry."""

    def run(batches):
        for batch in batches:
            low: list[np.ndarray] = [np.zeros(0, np.int64)]
            high: list[np.ndarray] = [np.zeros(0, np.int64)]
            for fps, own in zip(batch.column(0), batch.column(1), strict=True):
                fps, own = np.array(fps.values), np.array(own.values.to_numpy(zero_copy_only=False))
                raw, label = fps.view(np.uint64), fps.copy()
                near: list[np.ndarray] = []
                for i in range(0, len(fps), 256):  # 256 rows of the matrix at a time
                    a, b = np.nonzero((np.bitwise_count(raw[i : i + 256, None] ^ raw[None, :]) <= radius) & (own[i : i + 256, None] | own[None, :]))
                    keep = a + i < b
                    near.append(np.stack([a[keep] + i, b[keep]]))
                a, b = np.concatenate(near, axis=1)
                while len(a):
                    least = np.minimum(label[a], label[b])
                    if (label[a] == least).all() and (label[b] == least).all():
                        break
                    np.minimum.at(label, a, least)
                    np.minimum.at(label, b, least)
                moved = label < fps
                low.append(label[moved])
                high.append(fps[moved])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(low)), pa.array(np.concatenate(high))], names=["a", "b"])

    return run


def links(fps: DataFrame, radius: int = RADIUS, bucket: int = BUCKET, partitions: tuple = (2, 3, 4)) -> DataFrame:
    """Edges (u > v) that connect exactly the distinct fingerprints that differ in radius bits or fewer."""
    if radius != 2:
        raise ValueError("the star of large buckets is exact for a radius of 2")
    chosen = plan(fps, radius, partitions)
    sides = []
    for k, (bits, most) in enumerate(chosen):
        value = F.col("fp").bitwiseAND(F.lit(_mask(bits)).cast("long"))
        for e in range(most + 1):
            sides.append(fps.select(F.lit(k).alias("part"), F.explode(_flips(value, bits, e)).alias("key"), "fp", F.lit(e == 0).alias("own")))
    entries = reduce(DataFrame.unionByName, sides)
    sizes = entries.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n"), F.count_if("own").alias("n_own")).where("n > 1 and n_own > 0")
    full = materialize(entries.join(sizes.select("part", "key", "n"), ["part", "key"]))
    small = full.where(F.col("n") <= bucket).groupBy("part", "key").agg(F.collect_list("fp").alias("fps"), F.collect_list("own").alias("own"))
    pairs = small.select("fps", "own").mapInArrow(_bucket_links(radius), "a long, b long")
    hot = full.where(F.col("n") > bucket).select("fp").distinct()
    star = hot.select("fp", F.explode(F.concat(F.array("fp"), _flips(F.col("fp"), list(range(64)), 1))).alias("key"))
    groups = star.groupBy("key").agg(F.collect_set("fp").alias("x")).where(F.size("x") > 1)  # 65 at most
    near = groups.select(F.array_min("x").alias("a"), F.explode("x").alias("b")).where("a < b")
    both = pairs.unionByName(near)
    return both.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v): v is the smallest node that u reaches; nodes without a smaller one are left out. Alternating large and small stars."""
    spark = edges.sparkSession
    edges, mark = materialize(edges), None

    def stars() -> DataFrame:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        return large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u != v").distinct()

    while True:
        last = scratch()[-1:]
        edges = materialize(stars())
        release(spark, last)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges
        mark = now


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without its text, with fp, root (a fingerprint that names the component) and component_id (its smallest key).

    A column of the input that has the name of a computed one is replaced."""
    rest = [c for c in docs.columns if c != text and c.lower() not in ("fp", "root", "component_id")]

    def found() -> DataFrame:
        rows = materialize(with_fingerprints(docs.select(F.struct(*rest).alias("row"), F.col(key).alias("key"), F.col(text).alias("text"))))
        classes = materialize(rows.groupBy("fp").agg(F.min("key").alias("least")))
        roots = components(links(classes.select("fp"))).select(F.col("u").alias("fp"), F.col("v").alias("root"))
        named = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        least = named.groupBy("root").agg(F.min("least").alias("component_id"))
        return rows.join(named.select("fp", "root").join(least, "root"), "fp").select("row.*", "fp", "root", "component_id")

    return settle(docs.sparkSession, found)


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component: that of the smallest key."""
    row_hash = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    found = near_duplicates(docs.select(F.col(key).alias("d"), row_hash.alias("h"), F.col(text).alias("text")), "d")
    kept = found.where(F.col("d").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min("d").alias("d"), F.min_by("h", F.xxhash64("d", "h")).alias("h")).select("d", "h")
    h, d = fresh(docs, "h"), fresh(docs, "d")
    # one row per (d, h): repeated rows of docs collapse here, after the join has put them together
    held, kept = docs.withColumn(h, row_hash), kept.distinct().toDF(d, h + "_")
    return held.join(kept, F.col(key).eqNullSafe(F.col(d)) & (F.col(h) == F.col(h + "_")), "left_semi").dropDuplicates([key, h]).select(*docs.columns)


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
