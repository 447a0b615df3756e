"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of all word contracts: space and the code points 9 to 13.
WS = "[\\x20\\x09-\\x0D]+"
WS_CHARS = " \t\n\x0b\x0c\r"

_made = threading.local()
_local: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """Evaluates value once and hands it to body as a bound variable."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Array of words; empty for null or blank texts."""
    stripped = F.btrim(F.coalesce(text, F.lit("")), F.lit(WS_CHARS))
    return F.when(stripped == "", F.array().cast("array<string>")).otherwise(F.split(stripped, WS))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster (spark.checkpoint.dir); a local one only where none is set and the master is local."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="corpusloom-"))
        atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
    return f"file://{_local[0]}"


def materialize(df: DataFrame, **options) -> DataFrame:
    """Writes df to the shared folder and rereads it: cuts the lineage and survives lost executors. options: of the writer."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/corpusloom-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    _scratch().append(path)
    return spark.read.schema(df.schema).parquet(path)


def settle(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """materialize(make()), after which the tables that make() wrote on the way are deleted."""
    before = len(_scratch())
    out = materialize(make())
    release(spark, _scratch()[before:-1])
    return out


def _scratch() -> list[str]:
    """Tables that this thread has written and not deleted, in order."""
    if not hasattr(_made, "paths"):
        _made.paths = []
    return _made.paths


def scratch() -> list[str]:
    return list(_scratch())


def release(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables that materialize() wrote; only when no result that reads them is still needed."""
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        if p in _scratch():
            _scratch().remove(p)


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, object]):
    """Jobs that start inside run with these settings."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, str(v))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def give_back() -> None:
    """Memory that a task has freed goes back to the system: its worker goes on to other stages, beside the JVM's heap."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
