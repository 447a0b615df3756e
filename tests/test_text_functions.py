import pytest
from pyspark.sql import functions as F

from corpusloom.functions import nlp, schedules
from corpusloom.functions import text as T
from corpusloom.operators import dialog, texts
from corpusloom.sources import corpus
from corpusloom.streaming.limiter import PhraseLimiter, greedy, tumbling_counts


def each(spark, f, values):
    df = spark.createDataFrame(list(enumerate(values)), "i int, x string")
    return [r[0] for r in df.select(f(F.col("x")).alias("y"), "i").orderBy("i").collect()]


def test_normalize(spark):
    cases = {"Turn to your 6'o clock": "Turn to your 6 o'clock", "11o'clock": "11 o'clock", "1 o clock": "1 o'clock", "6 o'clock' now": "6 o'clock now", "30 o'clock": "30 o'clock", "30o'clock": "30 o'clock", "Grey  appartment": "gray apartment", "6 o' clock": "6 o' clock"}
    assert each(spark, T.normalize, cases) == list(cases.values())


def test_clock_hours(spark):
    values = ["5 o'clock", "5 oclock", "five o'clock", "05 o'clock", "30 o'clock", "13 o'clock", None]
    assert each(spark, T.clock_hour, values) == ["5", "5", "5", "5", None, None, None]
    assert each(spark, T.clock_hour_raw, values) == ["5", "5", "5", "05", "30", "13", None]


def test_yes_no(spark):
    assert each(spark, T.yes_no, ["yes", "it is not visible", "go north", "out of sight", "turn left", None]) == [True, True, False, False, None, None]


@pytest.mark.parametrize("pred, gold, name, want", [
    ("go forward", "move ahead", "direction", 1.0), ("go forward", "move ahead", "movement", 1.0), ("northeast", "east", "direction", 1.0), ("east", "northeast", "direction", 0.0),
    ("five o'clock", "5 o'clock", "direction", 1.0), ("go left at 3 o'clock", "go left at 5 o'clock", "direction", 0.5), ("red square", "red round building", "attribute", 0.5),
    ("the lot", "parking lot", "landmark", 0.8), ("parking and building", "parking and road", "landmark", 0.0), ("street building", "road", "landmark", 0.8),
    ("turn left", "turn left", "total", 1.0), ("go right", "turn left", "total", 0.2 / 1.8), ("go south", "go north", "total", 0.8 / 2.2),
])
def test_scores(spark, pred, gold, name, want):
    df = spark.createDataFrame([(1, pred, gold)], "p_partkey int, pred string, gold string")
    assert texts.scored_pairs(df).first()[name] == pytest.approx(want, abs=1e-6)


def test_response_parser_and_rules(spark):
    lines = "1. Head to the red building.\nShort\nNote: ignore this line please\n(3) Go past the road"
    assert each(spark, T.parse_response, [lines, None]) == [["Head to the red building.", "Go past the road"], []]
    assert each(spark, T.rule_positives, ["Go NORTH", "3 o'clock", "southeast", "ok"]) == [["head north", "go northward"], ["head towards 3 o'clock", "move to 3 o'clock"], ["head south", "go southward"], ["move ok", "move ok"]]
    assert each(spark, T.rule_negative, ["Go NORTH", "3 o'clock", "southeast", "ok"]) == ["go south", "go in the opposite direction", "go north", "go the other way"]
    assert each(spark, T.question_of, ["[QUE] a? [INS] b", "none"]) == ["a?", None]


def test_schedules(spark):
    w = {r.id: r for r in spark.range(600).select("id", *[c.alias(k) for k, c in schedules.weights(F.col("id")).items()]).collect()}
    assert [round(w[e].curriculum, 6) for e in (0, 112, 262, 375)] == [1.0, 0.7, 0.3, 0.0]
    assert (w[375].contrastive, w[450].contrastive, w[375].ce, w[550].ce) == (7.0, 3.0, 0.6, 0.8)
    assert (round(w[375].kd, 6), w[525].kd) == (0.7, 1.4)


def test_patterns_and_blocks(spark):
    df = spark.createDataFrame([(1, t, f"t{t}") for t in range(4)] + [(2, t, "x") for t in range(5)], "conv_id long, turn long, text string")
    got = {(r.conv_id, r.pattern_no): r.pattern for r in dialog.sub_trajectories(df).collect()}
    assert got[1, 1] == [0, 2, 3] and got[1, 2] == [0, 3] and got[2, 2] == [0, 2, 4] and len(got) == 6
    sizes = dialog.blocks(spark.range(10), "id", 3).groupBy("block").count().orderBy("block").collect()
    assert [r["count"] for r in sizes] == [4, 3, 3]


def test_nlp(spark):
    assert nlp.bleu4("a b c d e", "a b c d e") == pytest.approx(1.0) and nlp.bleu4("x", "a") == 0.0
    assert nlp.rouge_l("the cat sat", "the cat ran") == pytest.approx(2 / 3)
    df = spark.createDataFrame([("turn left now", "turn left")], "a string, b string")
    assert df.select(nlp.ratio_column("a", "b")).first()[0] == pytest.approx(nlp.ratio("turn left now", "turn left"))


def test_limiter(spark):
    x = PhraseLimiter()
    assert x.allows("a" * 30)
    for _ in range(4):
        x.use("a" * 30)
    assert not x.allows("a" * 30) and x.allows("a" * 30, relaxed=True)
    x.use("a" * 30)
    assert not x.allows("a" * 30, relaxed=True)
    y = PhraseLimiter(window=2)
    for p in "abac":
        y.use(p)
    assert list(y.uses) == ["b", "c"]
    rows = [(1, 1, 10, "p"), (1, 2, 11, "q"), (2, 1, 12, "p"), (2, 2, 13, "q"), (3, 1, 14, "p")]
    got = {r.anchor: r.other for r in greedy(spark.createDataFrame(rows, "anchor long, rank int, other long, phrase string")).collect()}
    assert got == {1: 10, 2: 13, 3: 14}


def test_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"a": 1}, {"a": 2}, {"b": 3}]')
    assert [(r.position, r.a) for r in corpus.read_json_array(spark, str(tmp_path / "a.json"), "a int").collect()] == [(0, 1), (1, 2), (2, None)]
    assert corpus.first_existing(spark, str(tmp_path / "no"), str(tmp_path / "a.json")).endswith("a.json")
    with pytest.raises(ValueError):
        corpus.split_path("x", "test")
    df = spark.range(25).selectExpr("id", "id % 5 as k")
    corpus.write_chunks(df.coalesce(1), str(tmp_path / "c"), 10)
    assert len(list((tmp_path / "c").glob("*.parquet"))) == 3
    assert sorted(r.id for r in corpus.last_wins(spark.read.parquet(str(tmp_path / "c")), "k", "id").collect()) == [20, 21, 22, 23, 24]
    assert [corpus.write_version(df, str(tmp_path / "v"))[-2:] for _ in range(2)] == ["v1", "v2"]


def test_stream_counts(spark, tmp_path):
    df = spark.sql("select timestamp '2024-01-01 10:00:00' + make_interval(0, 0, 0, 0, cast(id as int)) as ts, 'a' as event_type, 1.0d as value from range(48)")
    df.coalesce(1).write.parquet(str(tmp_path / "e"))
    q = tumbling_counts(spark.readStream.schema(df.schema).parquet(str(tmp_path / "e"))).writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r.n for r in spark.table("counts").collect()) == [10, 14, 24]
