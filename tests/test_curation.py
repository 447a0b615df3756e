"""Parsers, views and the greedy miner against golden cases and plain loops."""

import numpy as np
from pyspark.sql import functions as F

from corpusloom.operators import curation, geometry, mining, training
from corpusloom.streaming.limiter import PhraseLimiter


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_short_answers(spark):
    parse = lambda t: tuple(one(spark, curation.parse_short_answer(F.lit(t))))
    assert parse("POSITIVE 1: go north\nPOSITIVE 2: head north\nNEGATIVE 1: go south") == (["go north", "head north"], ["go south"])
    assert parse("Positive 1:\ngo on\nPositive 2: a\nmore\nNegative 1:\n\nturn: back\nand more") == (["go on", "a"], ["turn: back"])
    assert parse("nothing here\nat all") == ([], []) and parse("") == ([], [])
    assert tuple(one(spark, curation.short_answer(F.lit("Go NORTH"), F.lit("")))) == (["head north", "go northward"], ["go south"])


def test_sections(spark):
    text = "# c\n[net]\nchannels=3\n\n[convolutional]\nfilters=32\n[convolutional]\nbatch_normalize=1\nfilters = 8\nfilters=9"
    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate(text.split("\n"))], "key long, line int, text string")
    got = [(r.type, r.fields) for r in curation.section_records(lines, "key").orderBy("section").collect()]
    assert got == [("net", {"channels": "3"}), ("convolutional", {"batch_normalize": "0", "filters": "32"}), ("convolutional", {"batch_normalize": "1", "filters": "9"})]


def test_instruction_update(spark):
    f = lambda t: one(spark, curation.updated_instruction(F.lit(t), F.lit("fly on")))
    assert (f("[QUE] where? [INS] there"), f("[INS] there"), f("there")) == ("[QUE] where? [INS] fly on", "[INS] fly on", "fly on")


def test_history(spark):
    f = lambda c: one(spark, curation.parse_history(F.lit(c), F.lit("go")))
    assert f("First Instruction: go Question: a? Answer: b Answer: c Question: open") == ["Question: a?", "Answer: b Answer: c"]
    assert f("First Instruction: go") == [] and f("") == []


def test_pixels_round_half_to_even(spark):
    a = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    assert tuple(one(spark, geometry.pixel(a(0.5, 2.5), a(0, 0), a(3, 3), F.lit(1.0), F.lit(1.0)))) == (2.0, 2.0)


def test_warp_against_a_loop():
    rng = np.random.default_rng(3)
    image, corners = rng.random((9, 11)), np.array([(1.5, 2.0), (8.0, 1.0), (9.5, 7.0), (0.5, 6.0)])
    got = geometry.warp(image, corners, 5, 6)
    m = geometry.perspective(corners, 5, 6)
    for (u, v), want in zip([(0, 0), (5, 0), (5, 4), (0, 4)], corners):
        x = m @ [u, v, 1]
        assert np.allclose(x[:2] / x[2], want)
    for v in range(5):
        for u in range(6):
            x, y, z = m @ [u, v, 1]
            x, y = min(max(x / z, 0), 10), min(max(y / z, 0), 8)
            total = 0.0
            for i in range(9):
                for j in range(11):
                    total += image[i, j] * max(0, 1 - abs(x - j)) * max(0, 1 - abs(y - i))
            assert abs(total - got[v, u]) < 1e-9
    assert np.allclose(geometry.warp(image, np.array([(0, 0), (10, 0), (10, 8), (0, 8)]), 9, 11), image)


def test_views_of_a_hot_map(spark):
    """All rows of one map, and a map without rows or rows without a map."""
    corners = [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0]]
    rows = spark.createDataFrame([(i, "a" if i < 50 else "none", corners) for i in range(55)], "key long, map_name string, corners array<array<double>>")
    maps = spark.createDataFrame([("a", 2, 2, [1.0, 2.0, 3.0, 4.0]), ("b", 1, 1, [0.0])], "map_name string, h int, w int, pixels array<double>")
    got = {r.key: r.view for r in geometry.extract_views(rows, maps, 2, 2).collect()}
    assert sorted(got) == list(range(50)) and all(v == [1.0, 2.0, 3.0, 4.0] for v in got.values())


def test_views_of_many_maps(spark):
    """Maps stream through tasks: no call for each map and part."""
    corners = [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0]]
    rows = spark.range(3000).selectExpr("id AS key", "id % 700 AS map_name").withColumn("corners", F.array(*[F.array(*[F.lit(x) for x in c]) for c in corners]))
    maps = spark.range(600).selectExpr("id AS map_name", "2 AS h", "2 AS w", "array(cast(id AS double), id + 0.5D, 0D, 0D) AS pixels")
    views = geometry.extract_views(rows, maps, 2, 2)
    got = {r.key: r.view for r in views.collect()}
    assert sorted(got) == [i for i in range(3000) if i % 700 < 600] and all(v[0] == i % 700 for i, v in got.items())
    assert "CoGroup" not in views._jdf.queryExecution().executedPlan().toString()


def test_limited_mining_against_a_loop(spark):
    """Strictly over two thresholds, each in the order of rank, then relaxed over three."""
    rng = np.random.default_rng(1)
    found = [(a, int(o), r, int(rng.integers(1, 4))) for a in range(60) for r, o in enumerate(rng.permutation(12)[:4])]
    phrases = [(o, f"phrase {o % 3}") for o in range(12)]
    got = {r.anchor: r.other for r in mining.limited(spark.createDataFrame(found, "vec_id long, other long, rank int, tier int"), spark.createDataFrame(phrases, "vec_id long, phrase string")).collect()}
    limiter, want, text = PhraseLimiter(), {}, dict(phrases)
    for a in range(60):
        mine = sorted((r, t, o) for x, o, r, t in found if x == a)
        passes = [(tiers, False) for tiers in (1, 2)] + [(tiers, True) for tiers in (1, 2, 3)]
        pick = next((o for tiers, relaxed in passes for _, t, o in mine if t <= tiers and limiter.allows(text[o], relaxed)), None)
        if pick is not None:
            limiter.use(text[pick])
            want[a] = pick
    assert got == want and 3 < len(want) < 30


def test_a_used_up_phrase_goes_to_the_relaxed_pass(spark):
    """A fresh row of the last tier doesn't come before a row of the first tier whose phrase has been used."""
    found = [(1, 10, 1, 1), (2, 10, 1, 1), (2, 11, 2, 3)]
    df = spark.createDataFrame(found, "vec_id long, other long, rank int, tier int")
    assert sorted(map(tuple, mining.limited(df, spark.createDataFrame([(10, "p"), (11, "q")], "vec_id long, phrase string")).collect())) == [(1, 10), (2, 10)]


def test_goal_filter_comes_after_the_nearest(spark):
    """An anchor whose nearest rows all share its goal has no hard negative."""
    v = lambda x, y: [float(x), float(y)]
    e = spark.createDataFrame([(0, 1, v(1, 0)), (1, 1, v(1, 0.01)), (2, 1, v(1, 0.02)), (3, 2, v(1, 0.5))], "vec_id long, label int, embedding array<double>")
    texts = spark.createDataFrame([(i, v(np.cos(2.0 * i), np.sin(2.0 * i))) for i in range(4)], "vec_id long, text array<double>")
    near = {r.vec_id for r in mining.hard_negatives(e, texts, k=2).collect()}
    assert 0 not in near and 1 not in near and 0 in {r.vec_id for r in mining.hard_negatives(e, texts, k=3, tiers=(1.1,)).collect()}


def test_clusters(spark):
    e = spark.createDataFrame([(i, [float(i // 20 * 10), float(i % 20) / 100]) for i in range(60)], "vec_id long, embedding array<double>")
    by = {}
    for r in mining.clusters(e, k=3).collect():
        by.setdefault(r.vec_id // 20, set()).add(r.cluster)
    assert sorted(map(len, by.values())) == [1, 1, 1] and len(set.union(*by.values())) == 3
    assert mining.clusters(e.limit(2), k=3).count() == 2


def test_unknown_loss():
    try:
        training.loss_of("none", None, None, None)
    except ValueError as e:
        assert "triplet" in str(e)
    else:
        raise AssertionError
