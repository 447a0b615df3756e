"""JSON arrays of any size as rows, read by many tasks from any store that Spark reads.

Spark splits a file by bytes and cuts it at commas. A comma parts two elements where it stands outside a string at depth 1,
which only what comes before it tells. So a first pass sums up each split for both cases (it begins outside or inside a
string): how it leaves strings and depth, and how many commas it has at each depth. Running sums over the splits of a file
then give what each split begins with, and a second pass cuts the elements. Only the first and the last piece of a split can
be parts of an element, and only these are shuffled, to be put together.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ESCAPE = re.compile(rb"\\.", re.S)
_SPLIT = ["path", "block"]


def shape(piece: bytes) -> tuple[int, int, int]:
    """Whether the piece changes from outside to inside of strings, and its change of depth from either side."""
    if b"\\" in piece:
        piece = _ESCAPE.sub(b"", piece)
    parts = piece.split(b'"')
    depth = lambda x: x.count(b"{") + x.count(b"[") - x.count(b"}") - x.count(b"]")
    return (len(parts) - 1) & 1, depth(b"".join(parts[::2])), depth(b"".join(parts[1::2]))


def pieces(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, block (where the split begins) and value: what stands between commas, in order."""
    text = spark.read.text(path, lineSep=",")
    return text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def _by_split(batches, *more: str):
    """Runs of rows of one split: its key (with the columns of more) and its pieces, lazily."""

    def rows():
        for b in batches:
            cols = [b.column(b.schema.get_field_index(c)).to_pylist() for c in (*_SPLIT, *more)]
            yield from zip(zip(*cols, strict=True), b.column(b.schema.get_field_index("value")).to_pylist(), strict=True)

    for key, run in groupby(rows(), lambda r: r[0]):
        yield key, (v for _, v in run)


def summed(found: DataFrame) -> DataFrame:
    """By split: flips (0 or 1), and for both beginnings the change of depth and the commas outside of strings by relative depth."""

    def work(batches):
        for (path, block), run in _by_split(batches):
            depth, commas, flip = [0, 0], [Counter(), Counter()], 0
            for piece in run:
                turn, *change = shape(piece)
                for start in (0, 1):
                    depth[start] += change[start ^ flip]
                flip ^= turn
                commas[flip][depth[flip]] += 1  # a start of 0 is outside after an even number of flips, one of 1 after an odd one
            lists = [[{"depth": d, "n": n} for d, n in c.items()] for c in commas]
            kind = pa.list_(pa.struct([("depth", pa.int32()), ("n", pa.int64())]))
            cols = [pa.array([path]), pa.array([block]), pa.array([flip], pa.int32()), *(pa.array([d], pa.int32()) for d in depth), *(pa.array([x], kind) for x in lists)]
            yield pa.RecordBatch.from_arrays(cols, names=[*_SPLIT, "flip", "depth0", "depth1", "commas0", "commas1"])

    commas = "array<struct<depth: int, n: bigint>>"
    return found.mapInArrow(work, f"path string, block long, flip int, depth0 int, depth1 int, commas0 {commas}, commas1 {commas}")


def entries(sums: DataFrame) -> DataFrame:
    """By split: inside (a string, at its beginning), depth (there), first (elements that end before it), and those of the file's end."""
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("path")
    none = lambda c: F.coalesce(c, F.lit(0))
    x = sums.withColumn("inside", none(F.sum("flip").over(before)) % 2)
    x = x.withColumn("change", F.when(F.col("inside") == 0, F.col("depth0")).otherwise(F.col("depth1"))).withColumn("depth", none(F.sum("change").over(before)))
    here = F.when(F.col("inside") == 0, F.col("commas0")).otherwise(F.col("commas1"))
    x = x.withColumn("ends", F.aggregate(here, F.lit(0).cast("long"), lambda s, c: s + F.when(c["depth"] + F.col("depth") == 1, c["n"]).otherwise(0)))
    last = F.max("block").over(whole) == F.col("block")
    flips, change, ends = (F.sum(c).over(whole) for c in ("flip", "change", "ends"))
    outside = flips % 2 == 0
    # a file that breaks off between two elements ends one more of them, without a comma
    end = {"closed": outside & (change == 0), "end": ends - F.when(outside & (change == 1), 1).otherwise(0)}
    return x.select(*_SPLIT, F.col("inside").cast("int").alias("inside"), F.col("depth").cast("int").alias("depth"), none(F.sum("ends").over(before)).alias("first"), last.alias("last"), *[c.alias(n) for n, c in end.items()])


def cut(found: DataFrame, states: DataFrame) -> DataFrame:
    """path, block, position, whole (else a piece of an element that other splits may have parts of), value, and last."""

    def work(batches):
        for (path, block, inside, depth, at, last), run in _by_split(batches, "inside", "depth", "first", "last"):
            held, first, rows = [], True, []
            for piece in run:
                turn, *change = shape(piece)
                depth += change[inside]
                inside ^= turn
                held.append(piece)
                if not inside and depth == 1:
                    rows.append((at, not first, b",".join(held), False))
                    held, first, at = [], False, at + 1
                    if len(rows) >= 1000:
                        yield out(path, block, rows)
                        rows = []
            if held:
                rows.append((at, False, b",".join(held), last))
            yield out(path, block, rows)

    def out(path, block, rows):
        cols = list(zip(*rows, strict=True)) or [()] * 4
        kinds = (pa.int64(), pa.bool_(), pa.binary(), pa.bool_())
        n = len(rows)
        return pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), pa.array([block] * n, pa.int64()), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=[*_SPLIT, "position", "whole", "value", "last"])

    # a row of some tens of bytes for each split of the input (128 MB by default), so it is small beside any of them
    joined = found.join(F.broadcast(states.select(*_SPLIT, "inside", "depth", "first", "last")), _SPLIT)
    return joined.select(*_SPLIT, "value", "inside", "depth", "first", "last").mapInArrow(work, "path string, block long, position long, whole boolean, value binary, last boolean")


def elements(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, position (from 0, in the order of the file), value (an element's text), closed (whether the file's array ends) and
    end (the last position)."""
    found = pieces(spark, path)
    states = entries(summed(found))
    parts = cut(found, states)
    open_ = parts.where(~F.col("whole")).groupBy("path", "position").agg(F.array_sort(F.collect_list(F.struct("block", "value"))).alias("x"), F.max("last").alias("last"))
    text = lambda c: c.cast("string")
    rows = parts.where("whole").select("path", "position", text(F.col("value")).alias("value"), F.lit(False).alias("last"))
    rows = rows.unionByName(open_.select("path", "position", F.array_join(F.transform("x", lambda p: text(p["value"])), ",").alias("value"), "last"))
    value = F.when(F.col("position") == 0, F.regexp_replace("value", r"^[\s\x{FEFF}]*\[", "")).otherwise(F.col("value"))
    rows = rows.withColumn("value", F.when(F.col("last"), F.regexp_replace(value, r"\]\s*$", "")).otherwise(value))
    empty = F.col("last") & (F.col("position") == 0) & (F.trim(F.regexp_replace("value", r"\s", "")) == "")
    closed = F.broadcast(states.groupBy("path").agg(F.first("closed").alias("closed"), F.first("end").alias("end")))  # a row for each file
    return rows.where(~empty).join(closed, "path")


def read_json_array(spark: SparkSession, path: str | list[str], schema: str | T.StructType) -> DataFrame:
    """Rows of files that hold one JSON array each, with path, position and bad (why an element couldn't be read, else null).

    A bad element is a row without values; an array that doesn't end gives its elements, the last one marked. Empty arrays
    and empty files give no rows; nulls inside an array are rows without values."""
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    corrupt = "_corrupt"
    while corrupt in kind.names:
        corrupt += "_"
    parsed = F.from_json("value", T.StructType([*kind, T.StructField(corrupt, T.StringType())]), {"columnNameOfCorruptRecord": corrupt})
    rows = elements(spark, path).withColumn("_r", parsed)
    null = F.trim(F.regexp_replace("value", r"\s", "")) == "null"
    unended = ~F.col("closed") & (F.col("position") == F.col("end"))
    bad = F.when(~null & F.col(f"_r.{corrupt}").isNotNull(), F.concat(F.lit("not an element: "), F.substring("value", 1, 200))).when(unended, F.lit("the array does not end"))
    return rows.select("path", "position", bad.alias("bad"), *[F.col("_r")[c].alias(c) for c in kind.names])
