"""Sinks that publish data and metadata together: pretty JSON arrays in versions, with counts and metrics of the same pass.

A version is a folder with data (part files, each a JSON array, in order) and metadata.json. It is written beside the others
under a name that nothing reads, its metrics are observed while the rows are written, and only when all of it is there does
one rename make it a version and another make it the current one. A job that fails leaves the current version as it was, and
the versions before stay as backups.
"""

from __future__ import annotations

import json
import re
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .json_array import read_json_array


def _files(spark: SparkSession, root: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path, path(root).getFileSystem(spark._jsc.hadoopConfiguration())


def _write(spark: SparkSession, path: str, text: str) -> None:
    make, fs = _files(spark, path)
    out = fs.create(make(path), True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def _read(spark: SparkSession, path: str) -> str | None:
    make, fs = _files(spark, path)
    if not fs.exists(make(path)):
        return None
    data = spark._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(fs.open(make(path)))
    return bytes(data).decode()


def pretty(df: DataFrame) -> DataFrame:
    """The lines of one JSON array for each partition that has rows; fields that are null are written, decimals as doubles."""
    rows = df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias("value"))

    def work(batches):
        last = None
        for b in batches:
            out = []
            for text in b.column(0).to_pylist():
                if last is not None:
                    out.append(last + ",")
                now = "\n".join("  " + line for line in json.dumps(json.loads(text), indent=2).split("\n"))
                last = now if last is not None else "[\n" + now
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last + "\n]"])], names=["value"])

    return rows.mapInArrow(work, "value string")


def split_metrics(splits: tuple[str, ...], split: Column, **sizes: Column) -> dict[str, Column]:
    """Rows of each split as dataset_counts, and for every other name the sum of its column over the rows of each split."""
    out = {f"dataset_counts.{s}": F.count_if(split == s) for s in splits}
    return out | {f"{name}.{s}": F.coalesce(F.sum(F.when(split == s, c)), F.lit(0)) for name, c in sizes.items() for s in splits}


def score_metrics(scored: Column, *scores: str) -> dict[str, Column]:
    """Summary and averages over the rows that were scored, as they are saved after a run of generation."""
    got = F.count_if(scored)
    out = {"summary.total_samples": F.count(F.lit(1)), "summary.successful_generations": got, "summary.success_rate": F.coalesce(F.try_divide(got, F.count(F.lit(1))), F.lit(0.0))}
    return out | {f"average_scores.{s}": F.coalesce(F.avg(F.when(scored, F.col(s))), F.lit(0.0)) for s in scores}


def nested(flat: dict) -> dict:
    out: dict = {}
    for name, value in flat.items():
        *path, last = name.split(".")
        at = out
        for p in path:
            at = at.setdefault(p, {})
        at[last] = value
    return out


def versions(spark: SparkSession, root: str) -> list[int]:
    make, fs = _files(spark, root)
    if not fs.exists(make(root)):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(make(root))]
    return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"v(\d+)", n)))


def current(spark: SparkSession, root: str) -> int | None:
    text = _read(spark, f"{root}/current")
    return int(text) if text else None


def publish(spark: SparkSession, root: str, version: int) -> None:
    """Makes a version the current one, in one rename; an earlier one too."""
    if version not in versions(spark, root):
        raise ValueError(f"no version {version} in {root}")
    staged = f"{root}/.current-{uuid.uuid4().hex}"
    _write(spark, staged, str(version))
    jvm = spark._jvm
    make = jvm.org.apache.hadoop.fs.Path
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(make(root).toUri(), spark._jsc.hadoopConfiguration()).rename(make(staged), make(f"{root}/current"), options)


def write_version(df: DataFrame, root: str, order: str, metrics: dict[str, Column] | None = None, parts: int | None = None) -> int:
    """Writes df as the next version below root, sorted by order, with its metrics, and makes it the current one.

    metrics: aggregates by name; a name with dots is nested in metadata.json. They are taken from the rows as they are
    written, so counts and data can't differ. A table without rows makes a version without part files."""
    spark = df.sparkSession
    staged = f"{root}/.staged-{uuid.uuid4().hex}"
    make, fs = _files(spark, root)
    metrics = {"rows": F.count(F.lit(1))} | (metrics or {})
    seen = Observation()
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(n, order).sortWithinPartitions(order).observe(seen, *[c.alias(name) for name, c in metrics.items()])
    try:
        pretty(ordered).write.text(f"{staged}/data")
        _write(spark, f"{staged}/metadata.json", json.dumps(nested({name: seen.get[name] for name in metrics}), indent=2, default=str))
        version = max([0, *versions(spark, root)]) + 1
        while not fs.rename(make(staged), make(f"{root}/v{version}")):  # taken meanwhile
            version += 1
    except BaseException:
        fs.delete(make(staged), True)
        raise
    publish(spark, root, version)
    return version


def read_version(spark: SparkSession, root: str, schema: str | T.StructType, version: int | None = None) -> DataFrame:
    """Rows of a version (the current one) in the order of path and position."""
    version = current(spark, root) if version is None else version
    if version is None:
        raise FileNotFoundError(f"{root} has no current version")
    return read_json_array(spark, f"{root}/v{version}/data", schema)


def metadata(spark: SparkSession, root: str, version: int | None = None) -> dict:
    version = current(spark, root) if version is None else version
    return json.loads(_read(spark, f"{root}/v{version}/metadata.json") or "{}")
