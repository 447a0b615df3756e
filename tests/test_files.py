"""JSON arrays read by splits of any size, and versions that are published with their metadata."""

import json
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.sources import sinks
from corpusloom.sources.json_array import elements, read_json_array, shape


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "600b")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield spark
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def values():
    rng = random.Random(3)
    texts = ["", "a, b", 'say "hi", ok', "\\", '\\"', "[{,}]", "tab\t,\n", "é東,\U0001f600", "," * 70, '",', "x" * 250, "}{][", '\\\\",[']
    return [{"id": i, "t": rng.choice(texts), "n": [rng.randint(0, 9) for _ in range(rng.randint(0, 4))], "s": {"a": rng.choice(texts), "b": None}} for i in range(100)]


SCHEMA = "id long, t string, n array<int>, s struct<a: string, b: string>"


@pytest.mark.parametrize("dump", [{}, {"indent": 2}, {"separators": (",", ":")}, {"ensure_ascii": False, "indent": 1}])
def test_array_of_many_splits(small_splits, tmp_path, dump):
    spark, rows = small_splits, values()
    (tmp_path / "a.json").write_text(" \n" + json.dumps(rows, **dump) + "\n", encoding="utf-8")
    got = read_json_array(spark, str(tmp_path / "a.json"), SCHEMA)
    assert elements(spark, str(tmp_path / "a.json")).rdd.getNumPartitions() > 3
    out = sorted((r.asDict(True) for r in got.collect()), key=lambda r: r["position"])
    assert [{k: r[k] for k in ("id", "t", "n", "s")} for r in out] == rows and [r["position"] for r in out] == list(range(100)) and not any(r["bad"] for r in out)


def test_bad_and_odd_files(small_splits, tmp_path):
    spark = small_splits
    files = {"empty": "", "none": " [ \n] ", "one": '[{"id": 7}]', "null": '[null,{"id":1} , null]', "bad": '[{"id": 1}, {"id": x}, 5, {"id": 4}]', "torn": '[{"id": 1}, {"id": 2}, {"id": 3, "t": "ab', "cut": '[{"id": 1}, {"id": 2}', "commas": '[{"t": "' + "," * 300 + '"},{"id": 2}]'}
    for name, text in files.items():
        (tmp_path / f"{name}.json").write_text(text)
    got = {}
    for r in read_json_array(spark, str(tmp_path), "id long, t string").collect():
        got.setdefault(r.path.split("/")[-1][:-5], []).append((r.position, r.id, r.bad))
    got = {k: sorted(v, key=lambda x: x[0]) for k, v in got.items()}
    assert set(got) == {"one", "null", "bad", "torn", "cut", "commas"}
    assert got["one"] == [(0, 7, None)] and got["null"] == [(0, None, None), (1, 1, None), (2, None, None)] and [x[1] for x in got["commas"]] == [None, 2]
    assert [x[2] is None for x in got["bad"]] == [True, False, False, True] and [x[0] for x in got["bad"]] == [0, 1, 2, 3]
    assert [x[2] is None for x in got["torn"]] == [True, True, False] and [x[2] for x in got["cut"]] == [None, "the array does not end"]


def test_shape():
    assert shape(b'{"a": "b') == (1, 1, 0) and shape(b'x\\"y') == (0, 0, 0) and shape(b'[{') == (0, 2, 0) and shape(b'}"]') == (1, -1, -1)


def test_versions_and_their_metadata(spark, tmp_path):
    root = str(tmp_path / "out")
    df = spark.range(50).select("id", F.when(F.col("id") < 30, "train").when(F.col("id") < 45, "val_seen").otherwise("odd").alias("split"), (F.col("id") % 3).alias("turns"))
    metrics = sinks.split_metrics(("train", "val_seen", "val_unseen"), F.col("split"), turns=F.col("turns"))
    assert sinks.current(spark, root) is None and sinks.versions(spark, root) == []
    assert sinks.write_version(df, root, "id", metrics, parts=3) == 1
    want = {"rows": 50, "dataset_counts": {"train": 30, "val_seen": 15, "val_unseen": 0}, "turns": {"train": 30, "val_seen": 15, "val_unseen": 0}}
    assert sinks.metadata(spark, root) == want
    rows = [json.loads(f.read_text()) for f in sorted((tmp_path / "out/v1/data").glob("part-*.txt"))]
    assert [r["id"] for part in rows for r in part] == list(range(50)) and len(rows) == 3
    text = sorted((tmp_path / "out/v1/data").glob("part-*.txt"))[0].read_text()
    assert text == json.dumps(rows[0], indent=2) + "\n"

    broken = df.withColumn("id", F.when(F.col("id") == 40, F.raise_error(F.lit("no"))).otherwise(F.col("id")))
    with pytest.raises(Exception, match="no"):
        sinks.write_version(broken.withColumn("k", F.lit(1)), root, "k", metrics)
    assert sinks.current(spark, root) == 1 and sinks.versions(spark, root) == [1] and not list((tmp_path / "out").glob(".staged*"))

    assert sinks.write_version(df.where("id < 5"), root, "id") == 2 and sinks.current(spark, root) == 2
    assert sorted(r.id for r in sinks.read_version(spark, root, "id long").collect()) == list(range(5))
    assert sinks.read_version(spark, root, "id long", version=1).count() == 50
    sinks.publish(spark, root, 1)
    assert sinks.read_version(spark, root, "id long").count() == 50
    with pytest.raises(ValueError):
        sinks.publish(spark, root, 9)
    assert sinks.write_version(df.limit(0), root, "id", metrics) == 3 and sinks.metadata(spark, root)["rows"] == 0
    with pytest.raises(FileNotFoundError):
        sinks.read_version(spark, str(tmp_path / "none"), "id long")


def test_score_metrics(spark, tmp_path):
    df = spark.createDataFrame([(1, True, 0.5), (2, False, 9.0), (3, True, 1.0)], "id long, ok boolean, bleu4 double")
    sinks.write_version(df, str(tmp_path / "m"), "id", sinks.score_metrics(F.col("ok"), "bleu4"))
    assert sinks.metadata(spark, str(tmp_path / "m")) == {"rows": 3, "summary": {"total_samples": 3, "successful_generations": 2, "success_rate": 2 / 3}, "average_scores": {"bleu4": 0.75}}
