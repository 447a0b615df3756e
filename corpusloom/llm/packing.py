"""Best-fit packing planned over a histogram of lengths.

Documents become pieces of at most `capacity` ids. Best-fit decreasing runs over the counts of lengths, not over
documents: groups of equally filled sequences are split or filled as wholes, so the plan has at most a few entries for
each of the `capacity` lengths, at any number of documents. Pieces take planned slots by their rank within their length;
ranks are counted in salted groups, so that no length lands in one task.

Null and empty texts are one id (the end). Repeated rows and null ids are packed like any other; the order of equal ones
is arbitrary. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import subword
from .common import fresh, materialize, parts, table

CAPACITY = 4096
END = 1


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """key, piece, start, length, ids_crc32 and, if asked for, the ids of each piece."""
    tokenizer = tokenizer or subword.tokenizer_path()
    names = [key, "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def run(batches):
        model = subword.load(tokenizer)
        for b in batches:
            row = 0
            for ids, at in model.texts(b.column(1)):
                cols: list[list] = [[] for _ in names[1:]]
                owner = []
                for i in range(len(at) - 1):
                    whole = np.append(ids[at[i] : at[i + 1]], END).astype("<u4")
                    for p, start in enumerate(range(0, len(whole), capacity)):
                        part = whole[start : start + capacity]
                        owner.append(row)
                        for col, x in zip(cols, (p, start, len(part), zlib.crc32(part.tobytes()), part), strict=False):
                            col.append(x)
                    row += 1
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(owner, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=False))], names=names)

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, number, first sequence, offset): best-fit decreasing over counts."""
    out = []
    free: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left: (first sequence, number)
    rooms: list[int] = []  # sorted, of those in free
    used = 0

    def put(room: int, first: int, number: int) -> None:
        if room and number:
            if not free[room]:
                insort(rooms, room)
            free[room].append((first, number))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            k = bisect_left(rooms, length)
            if k < len(rooms):
                room = rooms[k]
                first, number = free[room].pop()
                if not free[room]:
                    rooms.pop(k)
            else:
                room, first, number = capacity, used, -(-left // (capacity // length))
                used += number
            each = room // length
            full = min(number, left // each)
            for t in range(each if full else 0):
                out.append((length, rank, full, first, capacity - room + t * length))
                rank += full
            left -= full * each
            put(room - each * length, first, full)
            if full < number:
                rest = min(left, each)
                for t in range(rest):
                    out.append((length, rank, 1, first + full, capacity - room + t * length))
                    rank += 1
                left -= rest
                put(room - rest * length, first + full, 1 if rest else 0)
                put(room, first + full + bool(rest), number - full - bool(rest))
    return out


def pack(found: DataFrame, key: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """found with sequence_id and offset (which replace columns of these names); needs the columns of pieces(). Rows that
    agree in key, piece and ids_crc32 share a salt."""
    spark, found = found.sparkSession, found.drop("sequence_id", "offset")
    salt, at_rank, before = (fresh(found, x) for x in ("salt", "rank", "before"))
    salted = found.withColumn(salt, F.pmod(F.xxhash64(key, "piece", "ids_crc32"), F.lit(max(16, parts(spark)))))
    by = materialize(salted.groupBy("length", salt).agg(F.count(F.lit(1)).alias("n")))  # at most capacity * salts rows
    counts = {r.length: r.n for r in by.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    slots = np.array(plan(counts, capacity), np.int64).reshape(-1, 5)
    order = np.lexsort((slots[:, 1], slots[:, 0]))
    shared = spark.sparkContext.broadcast(slots[order])  # bounded by the number of lengths, not of documents
    w = Window.partitionBy("length").orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)
    offsets = by.select("length", salt, F.coalesce(F.sum("n").over(w), F.lit(0)).alias(before))
    rank = F.row_number().over(Window.partitionBy("length", salt).orderBy(key, "piece", "ids_crc32")) - 1
    ranked = salted.withColumn(at_rank, rank).join(offsets, ["length", salt]).withColumn(at_rank, F.col(at_rank) + F.col(before))
    names = found.columns
    out = T.StructType([*found.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches):
        s = shared.value
        keys = s[:, 0] << 44 | s[:, 1]
        for b in batches:
            length, at = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", at_rank))
            hit = s[np.searchsorted(keys, length << 44 | at, "right") - 1] if len(at) else s[:0]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(hit[:, 3] + at - hit[:, 1]), pa.array(hit[:, 4])], names=[*names, "sequence_id", "offset"])

    return ranked.select(*names, at_rank).mapInArrow(run, out)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(materialize(pieces(table(spark, sf_dir, "documents"))))
