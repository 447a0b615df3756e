"""Phrase collocation mining: counted n-grams of frequent words, scored by their weakest cut.

1. Texts are split into pieces and words, and written as blocks of one language: numbers of words, and the block's own list
   of words with counts. Counts over the corpus give the frequent words, each with a dense id.
2. Each block's list meets the ids by a join, so no task needs the whole dictionary, and the block is written again as ids;
   a rare word breaks its piece, as no frequent phrase holds it.
3. Each place gives one key, the ids of `longest` words from there on, of fixed width and padded by zeros where the piece
   ends. A block's keys are radix sorted and counted by runs, cut at splitters (quantiles of keys sampled in each block anew), and
   the runs of a range meet in one task, which sorts and counts them again. Shorter phrases are prefixes, so they are runs of
   the same order; one that may go on in the next range is handed on whatever its count, and added up.
4. Each phrase is cut in every way, its parts' counts are joined, and the least score counts.

Null texts count as empty, a null language as `und`; languages have nothing in common. Ties in score and count go by the
phrase. Repeated rows count each; very long texts and words are taken whole; an empty table gives no rows; extra columns are
left out of the result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import give_back, materialize, parts, release, scratch, settings, settle, table

#: Bytes of text in a block; places for each range of keys; sampled keys for each range; buckets of the dense ids; salts.
BLOCK, RANGE, OVER, BUCKETS, SALT = 1 << 22, 1 << 20, 8, 512, 16
#: Bytes that the JVM and a worker send each other at once, or one row: batches lie in both outside the JVM's heap, and there twice while they grow.
SENT = 1 << 22
#: Blocks of a row group of what is written (a reader holds a whole one), and blocks whose maps a task collects side by side.
GROUP, SIDE = 2, 16

_PLAIN = bytes(c + 32 if 65 <= c <= 90 else 46 if 10 <= c <= 13 or c in b".,;:!?" else 32 if c == 9 else c for c in range(256))


class _Numbers(dict):
    """Numbers words as they come; 0 is the end of a piece."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def encoded(docs: DataFrame) -> DataFrame:
    """Blocks: block, lang, words with counts, and codes (a number is a place in words, from 1; 0 ends a piece). docs: lang, text."""

    def work(batches):
        task, made = TaskContext.get().partitionId(), 0
        held: dict[str, tuple[_Numbers, list, list]] = {}

        def out(lang):
            nonlocal made
            numbers, codes, _ = held.pop(lang)
            every = np.concatenate(codes)
            made += 1
            counts = np.bincount(every, minlength=len(numbers))[1:]
            words = [w.decode("utf-8", "surrogatepass") for w in list(numbers)[1:]]
            cols = ([f"{task} {made}"], [lang], [words], [counts], [every])
            kinds = (pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int32()))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["block", "lang", "words", "counts", "codes"])

        for b in batches:
            for lang, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), strict=True):
                text = t.as_py()
                if not text:
                    continue
                if lang not in held:
                    held[lang] = (_Numbers({b".": 0}), [], [0])
                numbers, codes, size = held[lang]
                codes.append(np.array([*map(numbers.__getitem__, text.translate(_PLAIN).replace(b".", b" . ").split()), 0], np.int32))
                size[0] += len(text)
                if size[0] > BLOCK:
                    yield out(lang)
        for lang in list(held):
            yield out(lang)
        give_back()

    return docs.mapInArrow(work, "block string, lang string, words array<string>, counts array<long>, codes array<int>")


def dictionary(counts: DataFrame) -> DataFrame:
    """lang, word and f with a dense id from 1; counts: lang, word, f."""
    placed = materialize(counts.withColumn("bucket", F.pmod(F.xxhash64("lang", "word"), F.lit(BUCKETS))))
    sizes, before, total = {r.bucket: r.n for r in placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()}, [], 1  # a row for each bucket
    for i in range(BUCKETS):
        before.append(total)
        total += sizes.get(i, 0)
    w = Window.partitionBy("bucket").orderBy("lang", "word")
    offset = F.get(F.array(*[F.lit(x).cast("long") for x in before]), F.col("bucket").cast("int"))
    return placed.select("lang", "word", "f", (offset + F.row_number().over(w) - 1).alias("id"))


def width_of(ids: int) -> int:
    """Bytes of an id, an even number."""
    return max(2, 2 * -(-int(ids).bit_length() // 16))


def pack(ids: np.ndarray, width: int) -> np.ndarray:
    """Rows of ids as rows of bytes, the highest first."""
    return np.ascontiguousarray(ids.astype(">u8").view(np.uint8).reshape(*ids.shape, 8)[..., 8 - width :]).reshape(len(ids), ids.shape[1] * width)


def keys_of(ids: np.ndarray, longest: int, width: int) -> np.ndarray:
    """The keys of the places where at least two words follow each other."""
    cols = np.zeros((len(ids), longest), np.int64)
    alive = np.ones(len(ids), bool)
    for j in range(longest):
        cols[: len(ids) - j, j] = ids[j:]
        alive &= cols[:, j] > 0
        cols[~alive, j] = 0
    return pack(cols[cols[:, 1] > 0], width)


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The order of rows of bytes: stable passes over digits of two bytes, the last one first; one that is equal in all rows is passed over."""
    digits, order = keys.view(">u2"), np.arange(len(keys))
    for d in reversed(range(digits.shape[1])):
        digit = digits[:, d].astype(np.uint16)
        if len(digit) and digit.min() != digit.max():
            order = order[np.argsort(digit[order], kind="stable")]
    return order


def run_starts(keys: np.ndarray) -> np.ndarray:
    """Where the runs of equal rows begin."""
    digits = keys.view(">u2")
    return np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), (digits[1:] != digits[:-1]).any(axis=1)]))


def sort_and_count(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = radix_order(keys)
    keys, counts = keys[order], counts[order]
    at = run_starts(keys)
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts


def _sampled(keys: np.ndarray, rate: float, block: str = "") -> np.ndarray:
    """The keys whose hash with the block is below the rate. Each block draws its own: a range holds a key once for each block
    that has it, and keys of very many blocks would else be in the sample always or never."""
    digits = keys.view(">u2").astype(np.uint64)
    h = np.full(len(keys), zlib.crc32(block.encode()), np.uint64)
    for d in range(digits.shape[1]):
        h = (h ^ digits[:, d]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return keys[(h >> np.uint64(11)).astype(np.float64) < rate * 2.0**53]


def as_ids(blocks: DataFrame, maps: DataFrame, longest: int, width: int, most: int, rate: float) -> DataFrame:
    """ids of each block, without repeated breaks, and sampled keys of it. maps: block, and pairs of number and id; most: the largest id."""
    kind, name = (pa.int32(), "int") if most < 1 << 31 else (pa.int64(), "long")

    def work(batches):
        for b in batches:
            for block, codes, pairs in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                codes = codes.values.to_numpy()
                to = np.zeros(int(codes.max()) + 1, kind.to_pandas_dtype())
                to[pairs.values.field("i").to_numpy()] = pairs.values.field("id").to_numpy()
                ids = to[codes]
                ids = ids[(ids > 0) | np.concatenate([[False], ids[:-1] > 0])]
                some = np.unique(_sampled(keys_of(ids, longest, width), rate, block), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(kind)), pa.array([[x.tobytes() for x in some]], pa.list_(pa.binary()))], names=["ids", "sample"])
        give_back()

    return blocks.join(maps, "block").select("block", "codes", "pairs").mapInArrow(work, f"ids array<{name}>, sample array<binary>")


def runs(blocks: DataFrame, cuts: list[bytes], longest: int, width: int) -> DataFrame:
    """Sorted and counted keys of each block, cut into ranges: range, keys, counts."""
    size = longest * width

    def work(batches):
        bounds = np.frombuffer(b"".join(cuts), f"S{size}")
        for b in batches:
            for ids in b.column(0):
                keys = keys_of(ids.values.to_numpy(), longest, width)
                keys, counts = sort_and_count(keys, np.ones(len(keys), np.int64))
                at = np.concatenate([[0], np.searchsorted(keys.view(f"S{size}").ravel(), bounds), [len(keys)]]) if len(keys) else np.zeros(1, np.int64)
                every = np.flatnonzero(np.diff(at))
                for some in np.split(every, np.flatnonzero(np.diff(at[every] * (size + 8) // SENT)) + 1):
                    cols = (some, [keys[at[i] : at[i + 1]].tobytes() for i in some], [counts[at[i] : at[i + 1]] for i in some])
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.binary(), pa.list_(pa.int64())), strict=True)], names=["range", "keys", "counts"])
        give_back()

    return blocks.select("ids").mapInArrow(work, "range int, keys binary, counts array<long>")


def counted(found: DataFrame, longest: int, width: int, least: int) -> DataFrame:
    """key and f of the phrases of each range; those at its ends whatever their count."""
    size = longest * width

    def work(batches):
        at, held = None, []
        for b in batches:
            for r, keys, counts in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                if at is not None and r != at:
                    yield out(held)
                    held = []
                at = r
                held.append((np.frombuffer(keys.as_py(), np.uint8).reshape(-1, size), counts.values.to_numpy().copy()))  # a view would keep the batch
        if held:
            yield out(held)
        held = []
        give_back()

    def out(held):
        keys, counts = (np.concatenate(x) for x in zip(*held, strict=True))
        keys, counts = sort_and_count(keys, counts)
        found: tuple[list, list] = ([], [])
        for m in range(2, longest + 1):
            head = np.ascontiguousarray(keys[:, : m * width])
            start = run_starts(head)
            f = np.add.reduceat(counts, start)
            keep = f >= least
            if m < longest:
                keep[[0, -1]] = True
            keep &= (head[start][:, -width:] > 0).any(axis=1)
            found[0].extend(x.tobytes() for x in head[start[keep]])
            found[1].append(f[keep])
        return pa.RecordBatch.from_arrays([pa.array(found[0], pa.binary()), pa.array(np.concatenate(found[1]), pa.int64())], names=["key", "f"])

    return found.repartition("range").sortWithinPartitions("range").mapInArrow(work, "key binary, f long")


def splitters(blocks: DataFrame, ranges: int) -> list[bytes]:
    """Keys where each range but the first begins: quantiles of the sample, which has about OVER keys for each range."""
    found = sorted(bytes(r.k) for r in blocks.select(F.explode("sample").alias("k")).collect())
    return sorted({found[i * len(found) // ranges] for i in range(1, ranges)}) if found else []


def scored(phrases: DataFrame, words: DataFrame, width: int) -> DataFrame:
    """lang, key, a, l, r and score of phrases (key, f) by their weakest cut; words: lang, word, f, key."""
    one = F.length("key") == width
    salted = lambda key, by: F.when(F.length(key) == width, F.pmod(F.xxhash64(by), F.lit(SALT))).otherwise(F.lit(0))
    # a frequent word is a part of very many phrases, so words are sent in SALT copies
    counts = words.select("key", "f", "lang").unionByName(phrases.select("key", "f", F.lit(None).cast("string").alias("lang"))).select("*", F.explode(F.when(one, F.sequence(F.lit(0), F.lit(SALT - 1))).otherwise(F.array(F.lit(0)))).alias("salt"))
    cut = phrases.select(F.col("key").alias("whole"), F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), (F.length("key") / width).cast("int") - 1)).alias("k"))
    cut = cut.withColumns({"left": F.substring("whole", F.lit(1), F.col("k") * width), "right": F.substring("whole", F.col("k") * width + 1, F.length("whole"))})
    side = lambda name, f: counts.select(F.col("key").alias(name), F.col("f").alias(f), F.col("salt").cast("long").alias(f"{name}_salt"), *([F.col("lang")] if f == "l" else []))
    parts_ = cut.withColumns({"left_salt": salted("left", "whole").cast("long"), "right_salt": salted("right", "whole").cast("long")})
    both = parts_.join(side("left", "l"), ["left", "left_salt"]).join(side("right", "r"), ["right", "right_salt"])
    exact = lambda c: F.col(c).cast("decimal(15,0)")
    score = both.withColumns({"top": F.lit(1_000_000).cast("decimal(7,0)") * exact("a") * exact("a"), "under": exact("l") * exact("r")}).withColumn("score", F.expr("top div under"))
    least = score.groupBy(F.col("whole").alias("key"), "a").agg(F.max("lang").alias("lang"), F.min(F.struct("score", "k", "l", "r")).alias("m"))
    return least.select("lang", "key", "a", "m.l", "m.r", "m.score")


def spelled(found: DataFrame, words: DataFrame, width: int) -> DataFrame:
    """found with phrase, its words with spaces."""
    at = found.select("key", F.explode(F.sequence(F.lit(0), (F.length("key") / width).cast("int") - 1)).alias("i"))
    at = at.select("key", "i", F.substring("key", F.col("i") * width + 1, F.lit(width)).alias("w"), F.pmod(F.xxhash64("key"), F.lit(SALT)).alias("salt"))
    names = words.select(F.col("key").alias("w"), "word", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))).alias("salt"))
    text = at.join(names, ["w", "salt"]).groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    return found.join(text, "key")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = 3, least: int = 10, inside: int = 50, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the top phrases of 2 to longest words that occur least times or more.

    inside: a phrase is dropped if this share (in hundredths) of its places or more lies in one longer phrase."""
    with settings(docs.sparkSession, {"spark.sql.execution.arrow.maxBytesPerBatch": SENT, "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": SIDE}):
        return _collocations(docs, text, lang, longest, least, inside, top)


def _collocations(docs: DataFrame, text: str, lang: str, longest: int, least: int, inside: int, top: int) -> DataFrame:
    spark, groups = docs.sparkSession, {"parquet.block.row.count.limit": GROUP}
    rows = docs.select(F.coalesce(lang, F.lit("und")).alias("lang"), F.col(text).alias("text"))
    blocks, written = materialize(encoded(rows), **groups), scratch()[-1]
    each = blocks.select("block", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("i", "x")).select("block", "lang", (F.col("i") + 1).alias("i"), F.col("x.words").alias("word"), F.col("x.counts").alias("n"))
    totals = materialize(each.groupBy("lang").agg(F.sum("n").alias("n")))
    frequent = settle(spark, lambda: dictionary(each.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least)))
    most, places = frequent.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0], totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    width, ranges = width_of(most), max(parts(spark), places // RANGE)
    words = frequent.withColumn("key", F.unhex(F.lpad(F.hex("id"), 2 * width, "0")))
    maps = each.join(frequent.select("lang", "word", "id"), ["lang", "word"]).groupBy("block").agg(F.collect_list(F.struct("i", "id")).alias("pairs"))
    coded = materialize(as_ids(blocks, maps, longest, width, most, OVER * ranges / max(1, places)), **groups)
    release(spark, [written])
    written = scratch()[-1]
    cuts = splitters(coded, ranges)
    phrases = materialize(counted(runs(coded, cuts, longest, width), longest, width, least).groupBy("key").agg(F.sum("f").alias("f")).where(F.col("f") >= least))
    release(spark, [written])
    inner = phrases.where(F.length("key") > 2 * width).select("f", F.explode(_inside(width, longest)).alias("key")).groupBy("key").agg(F.max("f").alias("longer"))
    kept = scored(phrases, words, width).join(inner, "key", "left").where(F.col("longer").isNull() | (100 * F.col("longer") < inside * F.col("a"))).drop("longer")
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    best = spelled(kept, words, width).withColumn("part", F.pmod(F.xxhash64("key"), F.lit(64)))
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top).drop("part")
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _inside(width: int, longest: int):
    """The phrases of two words or more that a longer key holds."""
    spans = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(m).alias("m")) for m in range(2, longest) for i in range(longest - m + 1)]) if longest > 2 else F.array().cast("array<struct<i int, m int>>")
    fits = F.filter(spans, lambda s: ((s["i"] + s["m"]) * width <= F.length("key")) & (s["m"] * width < F.length("key")))
    return F.array_distinct(F.transform(fits, lambda s: F.substring(F.col("key"), s["i"] * width + 1, s["m"] * width)))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


#: The query in DuckDB, with phrases as strings.
SQL = """WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
 p AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM d),
 u AS (SELECT lang, unnest(w) AS phrase FROM p),
 g AS (SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS phrase, 2 AS m FROM p UNION ALL SELECT lang, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])), 3 FROM p),
 n AS (SELECT lang, count(*) AS n FROM u GROUP BY lang),
 f AS (SELECT lang, phrase, 1 AS m, count(*) AS f FROM u GROUP BY ALL UNION ALL SELECT lang, phrase, m, count(*) FROM g GROUP BY ALL HAVING count(*) >= 10),
 c AS (SELECT lang, phrase, f AS a, m, unnest(range(1, m)) AS k, string_split(phrase, ' ') AS w FROM f WHERE m > 1),
 s AS (SELECT c.lang, c.phrase, c.a, c.k, l.f AS l, r.f AS r, ((1000000::HUGEINT * c.a * c.a) // (l.f::HUGEINT * r.f))::BIGINT AS score FROM c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[:c.k], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.k + 1:], ' ') QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, c.k) = 1),
 t AS (SELECT lang, f, unnest([array_to_string(w[:2], ' '), array_to_string(w[2:], ' ')]) AS phrase FROM (SELECT lang, f, string_split(phrase, ' ') AS w FROM f WHERE m = 3)),
 o AS (SELECT lang, phrase, max(f) AS longer FROM t GROUP BY ALL),
 q AS (SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY s.score DESC, s.a DESC, s.phrase) AS rank, s.phrase, s.a, s.l, s.r, n.n, s.score FROM s JOIN n ON n.lang = s.lang LEFT JOIN o ON o.lang = s.lang AND o.phrase = s.phrase WHERE o.longer IS NULL OR 100 * o.longer < 50 * s.a)
 SELECT * FROM q WHERE rank <= 2000"""
