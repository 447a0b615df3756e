"""Tables on the way, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []


def scratch_path(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir; below a local folder only where none is set and the master is local."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="corpusloom-"))
            atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
        shared = f"file://{_local[0]}"
    return f"{shared.rstrip('/')}/corpusloom-{uuid.uuid4().hex}"


def written(df: DataFrame, *by: str) -> DataFrame:
    """df written and reread, partitioned by the given columns: cuts the lineage and survives lost executors."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession)
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
