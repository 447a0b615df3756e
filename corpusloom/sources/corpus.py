"""Sources and sinks of dialog corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SPLITS = ("train", "val_seen", "val_unseen")


def split_path(root: str, split: str, augmented: bool = False) -> str:
    if split not in SPLITS:
        raise ValueError(f"unknown split: {split}")
    return f"{root}/{'augmented' if augmented else 'processed'}/{split}"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def first_existing(spark: SparkSession, *paths: str) -> str:
    for p in paths:
        if exists(spark, p):
            return p
    raise FileNotFoundError(", ".join(paths))


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of files that hold one JSON array each, with their position; for files of bounded size."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.from_json("value", f"array<struct<{schema}>>")).alias("position", "r")).select("position", "r.*")


def read_episodes(spark: SparkSession, path: str, schema: str, most: int | None = None, order: str = "episode_id") -> DataFrame:
    rows = spark.read.schema(schema).json(path, multiLine=True)
    return rows.orderBy(order).limit(most) if most else rows


def read_splits(spark: SparkSession, root: str, *splits: str) -> DataFrame:
    """One table partitioned by split; only the asked splits are read."""
    if unknown := set(splits) - set(SPLITS):
        raise ValueError(f"unknown splits: {sorted(unknown)}")
    return spark.read.parquet(root).where(F.col("split").isin(*splits))


def last_wins(chunks: DataFrame, key: str, order: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return chunks.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def write_chunks(df: DataFrame, path: str, rows: int = 1000, keep: bool = False) -> None:
    """Files of so many rows at most; chunks that are there already are replaced, or stay beside the new ones (keep)."""
    df.write.mode("append" if keep else "overwrite").option("maxRecordsPerFile", rows).parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_version(df: DataFrame, root: str) -> str:
    """Writes to the next free version below root; what is being read is never overwritten."""
    spark, n = df.sparkSession, 1
    while exists(spark, f"{root}/v{n}"):
        n += 1
    df.write.parquet(f"{root}/v{n}")
    return f"{root}/v{n}"
