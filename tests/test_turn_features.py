"""Views from tiles against the warp of whole maps; turns with everything missing."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import geometry, turn_features as tf


@pytest.fixture(scope="module")
def maps():
    rng = np.random.default_rng(4)
    return {"a": rng.random((13, 9, 3)), "b": rng.random((1, 1, 3)), "c": rng.random((20, 31, 3))}


def tiled(spark, maps, size):
    rows = [(k, *m.shape, m.ravel().tolist()) for k, m in maps.items()]
    return tf.tiles(spark.createDataFrame(rows, "map_name string, h int, w int, channels int, pixels array<double>"), size)


@pytest.mark.parametrize("size", [1, 4, 64])
def test_views_against_whole_maps(spark, maps, size):
    rng = np.random.default_rng(size)
    views, want = [], {}
    for i in range(60):
        name = "c" if i < 40 else rng.choice(list(maps))  # a hot map
        h, w, _ = maps[name].shape
        x, y, dx, dy = rng.uniform(-3, w), rng.uniform(-3, h), rng.uniform(3, w + 4), rng.uniform(3, h + 4)
        box = np.array([(x, y), (x + dx, y), (x + dx, y + dy), (x, y + dy)]) + rng.uniform(-0.4, 0.4, (4, 2))
        if i % 3 == 0:
            box = np.round(box)
        views.append((i, str(name), box.tolist()))
        want[i] = geometry.warp(maps[name], box, 5, 7).ravel()
    views += [(90, "none", [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0]]), (91, "a", [[1.0, 1.0]] * 4)]
    df = spark.createDataFrame(views, "view long, map_name string, corners array<array<double>>").repartition(3)
    got = {r.view: r.pixels for r in tf.cut_views(df, tiled(spark, maps, size), 5, 7, size, per_tile=3).collect()}
    assert set(got) == set(want) and all(np.allclose(got[i], want[i], atol=1e-9) for i in want)


def test_tiles_overlap_by_one(spark, maps):
    got = {(r.map_name, r.ty, r.tx): np.array(r.pixels).reshape(r.th, r.tw, 3) for r in tiled(spark, maps, 4).collect()}
    assert len(got) == 4 * 3 + 1 + 5 * 8 and got["a", 0, 0].shape == (5, 5, 3) and got["a", 3, 2].shape == (1, 1, 3) and (got["c", 2, 3] == maps["c"][8:13, 12:17]).all()


def test_turns_with_and_without_everything(spark, maps):
    frame = ([0.0, 0.0], [12.0, 8.0], 1.0, 1.0)
    box = [[8.0, 1.0], [8.0, 6.0], [3.0, 6.0], [3.0, 1.0]]
    episodes = spark.createDataFrame([("e1", "a", *frame, "go on", box), ("e2", "a", *frame, None, None)], "episode_id string, map_name string, gps_botm_left array<double>, gps_top_right array<double>, lat_ratio double, lng_ratio double, first_instruction string, destination array<array<double>>")
    p = (["p one", "p two", "p three"], ["n one"])
    turns = spark.createDataFrame([("e1", 1, "where?", "left", ["h1", "h2", "h3", "h4"], box, [box, [[1.0, 1.0]] * 4, box, box], p), ("e2", 0, None, None, None, None, None, None), ("e9", 0, "x", "y", [], None, [], None)], "episode_id string, turn_id int, question string, answer string, dialog_history array<string>, observation array<array<double>>, previous_observations array<array<array<double>>>, paraphrases struct<positives: array<string>, negatives: array<string>>")
    rows = {r.episode_id: r for r in tf.turn_features(episodes, turns, tiled(spark, maps, 4), 4, 6, 4, answer_length=3, input_length=6, embedding=4, embedder=lambda c: F.array(F.length(c).cast("double"))).collect()}
    assert set(rows) == {"e1", "e2"}
    a, b = rows["e1"], rows["e2"]
    assert a.dialog_context == "h2 h3 h4 Question: where?" and a.input_tokens == ["h2", "h3", "h4", "Question:", "where?", "<pad>"] and a.answer_tokens == ["left", "<pad>", "<pad>"] and a.teacher_embed == [25.0]
    corners = np.array([(c[1], 12.0 - c[0]) for c in box])
    planes = (geometry.warp(maps["a"], corners, 4, 6) - np.array(geometry.RGB_MEAN)) / np.array(geometry.RGB_STD)
    want = planes.transpose(2, 0, 1).ravel()
    assert np.allclose(a.current_view, want) and np.allclose(a.destination_view, want) and len(a.previous_views) == 3
    assert set(a.previous_views[0]) == {0.0} and np.allclose(a.previous_views[1], want) and np.allclose(a.previous_views[2], want)
    assert (a.positive_text, a.positive_text_2, a.negative_text) == ("p one", "p two", "n one")
    assert b.current_view == [0.0] * 72 and b.previous_views == [] and b.destination_view is None and (b.question, b.answer, b.first_instruction, b.dialog_context) == ("", "", "", "") and b.positive_text is None


def test_tiles_stream_without_a_call_for_each(spark):
    """Each tile and part was a pandas call of its own; a tile is followed by its views in one stream now."""
    maps = spark.createDataFrame([(1, 4, 4, 1, [float(i) for i in range(16)])], "map_name long, h int, w int, channels int, pixels array<double>")
    views = spark.createDataFrame([(i, 1, [[0.0, 0.0], [3.0, 0.0], [3.0, 3.0], [0.0, 3.0]]) for i in range(5)], "view long, map_name long, corners array<array<double>>")
    cut = tf.cut_views(views, tf.tiles(maps, 3), 4, 4, 3, per_tile=2)
    assert "CoGroup" not in cut._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.view, [round(v, 6) for v in r.pixels]) for r in cut.collect()) == [(i, [float(v) for v in range(16)]) for i in range(5)]
