"""Batched reading in epochs: a seeded permutation of the rows without a sort of them.

The place of a row in an epoch is a keyed bijection of its index (swap-or-not: in each round a row and its partner at the sum
of a round number either trade places or not, by a hash of the greater index), so any row's place is known from the row
alone. Nothing is padded and nothing repeated: the last batch is as long as what is left.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.dialog import ranks

ROUNDS = 64

_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _hashed(value: np.ndarray, seed: np.ndarray, size: int) -> np.ndarray:
    """xxhash64 as Spark has it, of integers of 4 or 8 bytes (as unsigned numbers), seeded by the hash of what comes before."""
    turn = lambda h, by: (h << np.uint64(by)) | (h >> np.uint64(64 - by))
    h = seed + _P5 + np.uint64(size)
    h = turn(h ^ (value * _P1), 23) * _P2 + _P3 if size == 4 else turn(h ^ (turn(value * _P2, 31) * _P1), 27) * _P1 + _P4
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def _number(value: int, seed: np.ndarray) -> np.ndarray:
    size = 4 if -(1 << 31) <= value < 1 << 31 else 8
    return _hashed(np.array([value % (1 << 8 * size)], np.uint64), seed, size)


def place_of(index: Column, n: Column, seed: int, epoch: int, rounds: int = ROUNDS) -> Column:
    """The place of index (0 to n - 1) in the epoch's order: a bijection for every n."""

    def places(index: pd.Series, n: pd.Series) -> pd.Series:
        x, n = index.to_numpy(np.int64), n.to_numpy(np.int64)
        for r in range(1, rounds + 1):
            key = _number(r, _number(epoch, _number(seed, np.array([42], np.uint64))))
            partner = (_number(0, key).view(np.int64) % n - x) % n
            x = np.where(_hashed(np.maximum(x, partner).view(np.uint64), key, 8).view(np.int64) < 0, partner, x)
        return pd.Series(x)

    return F.pandas_udf(places, "long")(index, n)


def epoch(rows: DataFrame, key: str, size: int, seed: int = 42, number: int = 0, workers: int = 1, start: int = 0, shuffle: bool = True) -> DataFrame:
    """rows with batch, slot (place in the batch) and worker, from batch start on, batches whole in one partition and in order.

    key: an integer column of unique values, which gives the rows their index; the order depends on seed, number and the set
    of keys alone, whatever the partitions. Batches are dealt to workers in turn. An empty table has no batch."""
    index = F.col("rank").cast("long")
    place = place_of(index, F.lit(rows.count()), seed, number) if shuffle else index  # a joined count is lost to Spark where it plans lambdas anew
    placed = ranks(rows, key).withColumn("_place", place).withColumns({"batch": F.floor(F.col("_place") / size).cast("long"), "slot": (F.col("_place") % size).cast("int")})
    some = placed.withColumn("worker", (F.col("batch") % workers).cast("int")).where(F.col("batch") >= start).drop("_place", "rank")
    return some.repartitionByRange("batch").sortWithinPartitions("batch", "slot")
