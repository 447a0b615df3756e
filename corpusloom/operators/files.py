"""Tables through the JSON sources and sinks: what is written is read again, in order, with its metadata."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.scratch import scratch_path
from ..sources import epochs, sinks
from ..sources.corpus import SPLITS
from ..sources.json_array import read_json_array
from .dialog import SPLIT, query, split_of, table


@query("json_array_rows", "SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS position, conv_id, turn, role, text FROM conversations")
def json_array_rows(spark, sf_dir):
    """Conversations as one JSON array, read back by byte ranges."""
    root = scratch_path(spark)
    ordered = table(spark, sf_dir, "conversations").withColumn("key", F.struct("conv_id", "turn"))
    sinks.write_version(ordered, root, "key", parts=1)
    return sinks.read_version(spark, root, "conv_id long, turn long, role string, text string").select("position", "conv_id", "turn", "role", "text")


_EPISODES = f"(SELECT conv_id, {SPLIT.format('conv_id')} AS split, count(*) AS turns FROM conversations GROUP BY ALL)"


@query("split_metadata", f"SELECT s.split, count(e.conv_id) AS dataset_counts, coalesce(sum(e.turns), 0)::BIGINT AS dialog_turn_counts FROM (SELECT unnest(['train', 'val_seen', 'val_unseen']) AS split) s LEFT JOIN {_EPISODES} e USING (split) GROUP BY ALL")
def split_metadata(spark, sf_dir):
    """Episodes are published with counts by split; the counts are those of metadata.json."""
    root, split = scratch_path(spark), split_of(F.col("conv_id"))
    turn = F.struct("turn", "role", "text")
    episodes = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("dialogs"))
    sinks.write_version(episodes, root, "conv_id", sinks.split_metrics(SPLITS, split, dialog_turn_counts=F.size("dialogs").cast("long")))
    found = sinks.metadata(spark, root)
    rows = [(s, found["dataset_counts"][s], found["dialog_turn_counts"][s]) for s in SPLITS]
    return spark.createDataFrame(rows, "split string, dataset_counts long, dialog_turn_counts long")


@query("json_array_limit", "SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS position, p_partkey, p_name FROM part QUALIFY row_number() OVER (ORDER BY p_partkey) <= 100")
def json_array_limit(spark, sf_dir):
    """The first hundred elements of an array: the limit of the episode reader is the feature."""
    root = scratch_path(spark)
    sinks.write_version(table(spark, sf_dir, "part").select("p_partkey", "p_name"), root, "p_partkey", parts=1)
    rows = read_json_array(spark, f"{root}/v{sinks.current(spark, root)}/data", "p_partkey long, p_name string")
    return rows.where("position < 100").select("position", "p_partkey", "p_name")


@query("epoch_batches", "SELECT count(*) AS rows, ceil(count(*) / 6.0)::BIGINT AS batches, count(*) // 6 * 6 AS full_rows, sum(o_orderkey)::BIGINT AS keys FROM orders")
def epoch_batches(spark, sf_dir):
    """A seeded epoch over all orders, in batches of six: every row once, all batches but the last full."""
    batches = epochs.epoch(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 6, workers=8)
    sizes = batches.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("slot").alias("slots"), F.sum("o_orderkey").alias("keys"))
    return sizes.agg(F.sum("slots").alias("rows"), F.count(F.lit(1)).alias("batches"), F.sum(F.when(F.col("n") == 6, 6).otherwise(0)).cast("long").alias("full_rows"), F.sum("keys").alias("keys"))
