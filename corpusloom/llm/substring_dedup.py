"""Exact removal of repeated byte strings with suffix arrays over shards.

1. Each text's least k-gram hash in every run of W k-grams (a minimiser) is counted over the corpus. A string of
   min_len bytes can stand elsewhere only if all minimisers inside it were counted twice, so the rest of a text is out.
2. What is left is cut where the least k-gram hash of the min_len-byte window changes: equal windows have the same hash,
   hence meet in the same shard. Equal segments are collapsed into one with a weight before they are shuffled.
3. Each shard's segments are suffix-sorted by induced sorting; permuted common prefixes of min_len or more mark the
   windows that stand elsewhere too. Hashes only choose candidates; the suffix array decides.
4. Marks go back to all copies of a segment, and the covered bytes of a text are removed.

Segments of one hash that are more than HOT (a passage that very many texts share, each in other surroundings) would be
one task's, at any number of machines. These are cut further, into single windows, so that equal windows meet by their
own 128-bit digests, in as many groups as there are windows; a group of one window needs no sort, and its weight decides.

Null texts count as empty. Matches never cross documents. Repeated rows are documents of their own, so the longer ones
remove each other. Texts are matched by two hashes of id and text (k of 64 and c of 32 bits) when marks go back. Extra
columns pass through; a column removed_spans is replaced.
"""

from __future__ import annotations

import hashlib
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, materialize, settle, table
from .suffix_array import repeated_windows

MIN_LEN = 400
GRAM = 100
RUN = 101
#: Bytes of segments that are suffix-sorted at once; groups of one hash stay together.
SHARD = 1 << 21
#: Distinct segments of one hash that are sorted together at most.
HOT = 512
#: Parts that the copies of one window of a hot group are dealt to.
SALT = 16

_MUL = 0x9E3779B97F4A7C15 | 1
_INV = pow(_MUL, -1, 1 << 64)
_TABLE = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        _powers[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, x, np.uint64)])) for x in (_MUL, _INV)]
    return _powers[0][:n], _powers[1][:n]


def gram_hashes(buf: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of each k-gram of buf."""
    n = len(buf)
    up, down = _power(n)
    total = np.concatenate([[np.uint64(0)], np.cumsum(_TABLE[buf] * up)])
    h = (total[gram:] - total[:-gram]) * down[: n - gram + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def sliding_least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of `width` values."""
    n = len(h)
    if n < width:
        return h[:0]
    pad = np.concatenate([h, np.full(-n % width, np.uint64(2**64 - 1))]).reshape(-1, width)
    left = np.minimum.accumulate(pad, axis=1).ravel()
    right = np.minimum.accumulate(pad[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def _changes(m: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.flatnonzero(m[1:] != m[:-1]) + 1])


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(*_names(key, text), F.col(text).alias("text"))


def _names(key: str, text: str, k: str = "k", c: str = "c") -> list:
    return [F.xxhash64(F.col(key), F.col(text)).alias(k), F.hash(F.col(text), F.col(key)).alias(c)]


def minimiser_runs(keyed: DataFrame, min_len: int, gram: int, run: int) -> DataFrame:
    """k, c, hash, lo, hi: the run of places lo..hi whose least hash it is; weight 2 where it must stand at two places."""

    def work(batches):
        for b in batches:
            cols: list[list] = [[], [], [], [], []]
            for k, c, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                buf = np.frombuffer(t.as_buffer(), np.uint8) if t.is_valid else np.zeros(0, np.uint8)
                if len(buf) < min_len:
                    continue
                m = sliding_least(gram_hashes(buf, gram), run)
                lo = _changes(m)
                for col, x in zip(cols, (np.full(len(lo), k, np.int64), np.full(len(lo), c, np.int64), m[lo].view(np.int64), lo, np.append(lo[1:], len(m)) - 1), strict=True):
                    col.append(x)
                if sum(map(len, cols[0])) > 200_000:
                    yield out(cols)
                    cols = [[], [], [], [], []]
            yield out(cols)

    def out(cols):
        k, c, h, lo, hi = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in cols)
        return pa.RecordBatch.from_arrays([pa.array(k), pa.array(c.astype(np.int32)), pa.array(h), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), pa.array(np.where(hi - lo >= run, 2, 1).astype(np.int32))], names=["k", "c", "hash", "lo", "hi", "weight"])

    return keyed.mapInArrow(work, "k long, c int, hash long, lo int, hi int, weight int")


def candidate_segments(found: DataFrame, min_len: int, gram: int, run: int) -> DataFrame:
    """shard hash, digest, segment, k, c and start of what may stand elsewhere; found: k, c, text and runs (lo, hi) that were counted twice."""
    span = run + gram - 1

    def work(batches):
        for b in batches:
            rows: list[tuple] = []
            held = 0
            for k, c, t, runs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                at = runs.values
                lo, hi = (np.sort(at.field(i).to_numpy(zero_copy_only=False)).astype(np.int64) for i in (0, 1))
                keep = np.flatnonzero(lo[1:] > hi[:-1] + 1)  # repeated rows bring their runs twice
                buf = t.as_py().encode("utf-8", "surrogatepass")
                for a, z in zip(lo[np.concatenate([[0], keep + 1])].tolist(), hi[np.append(keep, len(hi) - 1)].tolist(), strict=True):
                    if z - a < min_len - span:
                        continue
                    piece = buf[a : z + span]
                    least = sliding_least(gram_hashes(np.frombuffer(piece, np.uint8), gram), min_len - gram + 1)
                    cut = _changes(least)
                    for s, e in pairwise([*cut.tolist(), len(least)]):
                        seg = piece[s : e - 1 + min_len]
                        rows.append((int(least[s : s + 1].view(np.int64)[0]), xxhash.xxh3_128_digest(seg), seg, k, c, a + s))
                        held += len(seg)
                        if held > 1 << 23:
                            yield out(rows)
                            rows, held = [], 0
            yield out(rows)

    def out(rows):
        cols = list(zip(*rows, strict=True)) or [()] * 6
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["shard", "digest", "segment", "k", "c", "start"])

    return found.mapInArrow(work, "shard long, digest binary, segment binary, k long, c int, start int")


def covered(starts: np.ndarray, min_len: int) -> list[tuple[int, int]]:
    """Maximal stretches [a, b) under the windows that start at the given places."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > min_len)
    return list(zip(starts[np.concatenate([[0], cut + 1])].tolist(), (starts[np.append(cut, len(starts) - 1)] + min_len).tolist(), strict=True))


def shard_marks(distinct: DataFrame, min_len: int, shard_bytes: int) -> DataFrame:
    """shard, digest and covered stretches of each distinct segment; needs the rows of a shard hash together and in order."""

    def work(batches):
        group: list[tuple] = []
        chunk: list[tuple] = []
        held = 0

        def solve(rows):
            sort = [r for r in rows if r[4]]
            marks = repeated_windows([r[2] for r in sort], [r[3] for r in sort], min_len) if sort else []
            got = [(r[0], r[1], covered(np.flatnonzero(m), min_len)) for r, m in zip(sort, marks, strict=True)]
            got += [(r[0], r[1], [(0, len(r[2]))]) for r in rows if not r[4]]  # all its windows stand in its equal copies
            got = [g for g in got if g[2]]
            cols = list(zip(*got, strict=True)) or [()] * 3
            kinds = (pa.int64(), pa.binary(), pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))
            cols[2] = [[{"a": a, "b": b} for a, b in x] for x in cols[2]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["shard", "digest", "spans"])

        def close():
            """Copies of a segment that stands alone in its group were compared when they were collapsed; a single text needs a
            sort only if it is long enough to repeat itself."""
            nonlocal held
            lone = len(group) == 1
            if lone and group[0][3] < 2 and len(group[0][2]) < min_len + 1:  # a single window
                return
            sort = not (lone and group[0][3] > 1)
            chunk.extend((*g, sort) for g in group)
            held += sum(len(g[2]) for g in group) if sort else 1 << 8

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if group and row[0] != group[0][0]:
                    close()
                    group = []
                    if held > shard_bytes:
                        yield solve(chunk)
                        chunk, held = [], 0
                group.append(row)
        if group:
            close()
        yield solve(chunk)

    return distinct.mapInArrow(work, "shard long, digest binary, spans array<struct<a int, b int>>")


_SPANS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def hot_marks(distinct: DataFrame, min_len: int) -> DataFrame:
    """As shard_marks, of groups that are too large for one task: each window is a segment of its own."""

    def cut(batches):
        for b in batches:
            cols: list[list] = [[], [], [], [], []]
            for shard, digest, seg, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                every = [xxhash.xxh3_128_digest(seg[i : i + min_len]) for i in range(len(seg) - min_len + 1)]
                for col, x in zip(cols, ([shard] * len(every), [digest] * len(every), every, range(len(every)), [n] * len(every)), strict=True):
                    col.extend(x)
                if len(cols[0]) > 100_000:
                    yield out(cols)
                    cols = [[], [], [], [], []]
            yield out(cols)

    def out(cols):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int64()), strict=True)], names=["shard", "digest", "window", "at", "n"])

    def join_up(batches):
        for b in batches:
            spans = [[{"a": x, "b": y} for x, y in covered(np.sort(at.values.to_numpy()), min_len)] for at in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(spans, _SPANS)], names=["shard", "digest", "spans"])

    windows = materialize(distinct.mapInArrow(cut, "shard long, digest binary, window binary, at int, n long").withColumn("salt", F.pmod(F.hash("digest"), F.lit(SALT))))
    twice = windows.groupBy("window").agg(F.sum("n").alias("n")).where("n > 1").select("window", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    hit = windows.join(twice, ["window", "salt"], "left_semi").groupBy("shard", "digest").agg(F.collect_list("at").alias("at"))  # a segment's own windows
    return hit.mapInArrow(join_up, "shard long, digest binary, spans array<struct<a int, b int>>")


def repeated_spans(docs: DataFrame, key: str, text: str, min_len: int = MIN_LEN, gram: int = GRAM, run: int = RUN, shard_bytes: int = SHARD, hot: int = HOT) -> DataFrame:
    """k, c and spans (not yet merged) of each text with bytes to remove."""
    spark, keyed = docs.sparkSession, _keyed(docs, key, text)

    def counted_twice() -> DataFrame:
        runs = materialize(minimiser_runs(keyed, min_len, gram, run))
        twice = runs.groupBy("hash").agg(F.sum("weight").alias("n")).where("n > 1").select("hash")
        kept = runs.join(twice, "hash", "left_semi").groupBy("k", "c").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))
        # a stretch of min_len bytes needs more places in a row than these; cheap test before the texts move
        return kept.where(F.aggregate("runs", F.lit(0), lambda s, x: s + x["hi"] - x["lo"] + 1) > min_len - run - gram + 1)

    def cut() -> DataFrame:
        found = keyed.join(settle(spark, counted_twice).hint("shuffle_hash"), ["k", "c"]).select("k", "c", "text", "runs")
        return candidate_segments(found, min_len, gram, run)

    def marked(segments: DataFrame) -> DataFrame:
        large = materialize(segments.groupBy("shard", "digest").agg(F.lit(1).alias("n")).groupBy("shard").agg(F.sum("n").alias("n")).where(F.col("n") > hot).select("shard"))
        every = segments.groupBy("shard", "digest", "segment").agg(F.count(F.lit(1)).alias("n")).select("shard", "digest", "segment", "n")
        small = every.join(large, "shard", "left_anti").repartition("shard").sortWithinPartitions("shard")
        marks = shard_marks(small, min_len, shard_bytes)
        return marks if large.isEmpty() else marks.unionByName(hot_marks(every.join(large, "shard", "left_semi"), min_len))

    def moved() -> DataFrame:
        segments = settle(spark, cut)
        at = segments.select("shard", "digest", "k", "c", "start").join(settle(spark, lambda: marked(segments)), ["shard", "digest"])
        spans = at.select("k", "c", F.explode(F.transform("spans", lambda x: F.struct((x["a"] + F.col("start")).alias("a"), (x["b"] + F.col("start")).alias("b")))).alias("s"))
        return spans.groupBy("k", "c").agg(F.collect_set("s").alias("spans"))

    return settle(spark, moved)


def merge_spans(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((x["a"], x["b"]) for x in spans or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def without(buf: bytes, spans: list[tuple[int, int]]) -> bytes:
    ends = [0, *(b for _, b in spans)]
    return b"".join(buf[e:a] for e, (a, _) in zip(ends, [*spans, (len(buf), 0)], strict=True))


def whole_characters(buf: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans without characters that are only partly covered."""
    out = []
    for a, b in spans:
        while a < b and buf[a] & 0xC0 == 0x80:
            a += 1
        while a < b < len(buf) and buf[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def long_spans(buf: bytes, spans: list[tuple[int, int]], min_words: int, min_bytes: int) -> list[tuple[int, int]]:
    """The spans of so many words or bytes."""
    return [(a, b) for a, b in spans if b - a >= min_bytes or len(buf[a:b].split()) >= min_words]


def dedup_substrings(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = 0, min_bytes: int = 0, **options) -> DataFrame:
    """docs with its text cut (characters stay whole), and the spans of bytes that were found.

    min_words, min_bytes: shorter spans (in words and in bytes) stay; by default none do."""
    spans = repeated_spans(docs, key, text, **options)
    k, c, at_spans = (fresh(docs, x) for x in ("k", "c", "spans"))
    joined = docs.withColumns(dict(zip((k, c), _names(key, text), strict=True))).join(spans.select(F.col("k").alias(k), F.col("c").alias(c), F.col("spans").alias(at_spans)).hint("shuffle_hash"), [k, c], "left")
    names = [x for x in docs.columns if x.lower() != "removed_spans"]
    at = names.index(text)

    def work(batches):
        for b in batches:
            cols = list(b.columns)
            out, found = [], []
            for t, s in zip(b.column(at).to_pylist(), b.column(len(names)).to_pylist(), strict=True):
                s = merge_spans(s)
                if s:
                    buf = t.encode("utf-8", "surrogatepass")
                    s = long_spans(buf, s, min_words, min_bytes)
                    t = without(buf, whole_characters(buf, s)).decode("utf-8", "surrogatepass")
                out.append(t)
                found.append([{"a": x, "b": y} for x, y in s])
            cols[at] = pa.array(out, pa.string())
            cols[-1] = pa.array(found, _SPANS)
            yield pa.RecordBatch.from_arrays(cols, names=[*names, "removed_spans"])

    span = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType())])
    return joined.select(*names, at_spans).mapInArrow(work, T.StructType([*(docs.schema[x] for x in names), T.StructField("removed_spans", T.ArrayType(span))]))


def digests(docs: DataFrame, spans: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    def work(batches):
        for b in batches:
            rows = []
            for t, s in zip(b.column(1), b.column(2).to_pylist(), strict=True):
                buf, s = t.as_buffer().to_pybytes() if t.is_valid else b"", merge_spans(s)
                rows.append((len(buf), sum(y - x for x, y in s), len(s), hashlib.sha256(without(buf, s)).hexdigest()))
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))], names=[key, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    held = docs.select(*_names(key, text), F.col(key).alias("key"), F.col(text).alias("text"))
    joined = held.join(spans.hint("shuffle_hash"), ["k", "c"], "left").select("key", "text", "spans")
    return joined.mapInArrow(work, f"`{key}` {docs.schema[key].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(docs, repeated_spans(docs, "doc_id", "text"))
