"""Drivers around a generator: all rows accounted for, failures one by one, work resumed."""

import os

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import regenerate
from corpusloom.plans import generate


class Flaky:
    """Fails on prompts with `bad`, and writes down what it was asked."""

    def __init__(self, path, fails_first=False):
        self.path, self.fails_first = str(path), fails_first

    def __call__(self, prompts):
        with open(self.path, "a") as f:
            f.write("".join(p + "\n" for p in prompts) + "--\n")
        if any("bad" in p for p in prompts):
            raise RuntimeError("bad prompt")
        return [p.upper() if p != "none" else None for p in prompts]


def asked(path):
    return [x for x in open(path).read().split("\n") if x and x != "--"] if os.path.exists(path) else []


def test_a_failing_prompt_stands_alone(tmp_path):
    model = Flaky(tmp_path / "log")
    got = generate.ask(model, ["a", "b", "bad", "c", "none"], 2)
    assert [x[:2] for x in got] == [("A", None), ("B", None), (None, "RuntimeError: bad prompt"), ("C", None), (None, "no response")]
    assert got[2][2] == 6 and got[0][2] == 3  # two calls a level
    assert generate.ask(lambda p: p[:-1], ["x", "y"], 1) == [(None, "ValueError: 0 responses to 1 prompts", 2)] * 2 and generate.ask(model, [], 1) == []


def test_all_rows_once_and_equal_prompts_asked_once(spark, tmp_path):
    rows = [(i, p) for i, p in enumerate(["a", "b", "a", None, "bad 1", "a", "", "none", "bad 1"])]
    df = spark.createDataFrame(rows, "id long, q string").repartition(3)
    got = {r.id: (r.response, r.error) for r in generate.generated(df, "q", Flaky(tmp_path / "log"), batch=2, attempts=1).collect()}
    bad = (None, "RuntimeError: bad prompt")
    assert got == {0: ("A", None), 1: ("B", None), 2: ("A", None), 3: (None, None), 4: bad, 5: ("A", None), 6: ("", None), 7: (None, "no response"), 8: bad}
    assert generate.generated(df.limit(0), "q", Flaky(tmp_path / "log2")).count() == 0


def test_work_is_resumed_from_what_is_written(spark, tmp_path):
    df = spark.createDataFrame([(i, f"{'bad' if i % 10 == 3 else 'p'} {i}") for i in range(40)], "id long, q string")
    root, log = str(tmp_path / "root"), tmp_path / "log"
    done = generate.generated(df, "q", Flaky(log), attempts=1, chunks=4, root=root)
    first = sorted(map(tuple, done.collect()))
    os.remove(f"{root}/chunk=2/_SUCCESS")  # as if the run had ended there
    before = len(asked(log))
    assert sorted(map(tuple, generate.generated(df, "q", Flaky(log), attempts=1, chunks=4, root=root).collect())) == first
    again = asked(log)[before:]
    assert 0 < len(set(again)) < 20 and before > 39

    class Mended(Flaky):
        def __call__(self, prompts):
            return super().__call__([p.replace("bad", "was") for p in prompts])

    before = len(asked(log))
    mended = {r.id: (r.response, r.error) for r in generate.generated(df, "q", Mended(log), chunks=4, root=root, again=True).collect()}
    assert len(mended) == 40 and mended[3] == ("WAS 3", None) and mended[4] == ("P 4", None)
    assert sorted(asked(log)[before:]) == ["was 13", "was 23", "was 3", "was 33"]
    assert {r.id: r.response for r in generate.generated(df, "q", Flaky(log), chunks=4, root=root).collect()}[3] == "WAS 3"


def test_prompts(spark):
    df = spark.createDataFrame([("go (north) [now] left Note: not this",), (None,)], "t string")
    got = [r[0] for r in df.select(generate.prompt(F.col("t"), "positive", [("a", "b")] * 5)).collect()]
    assert got[1] is None and '"go   left"' in got[0] and got[0].count("Example") == 3 and got[0].startswith("Example 1:\nInput: a\nOutput: b\n\n")
    with pytest.raises(KeyError):
        generate.prompt(F.col("t"), "other")


def reply(prompts):
    answers = {"turn left at the red building": "1. turn left by the red building\n2. at the red building turn left\n3. turn right at the white tower now", "fly north over the road": "just one long line here"}
    return [next((v for k, v in answers.items() if k in p), "short") for p in prompts]


def test_augmented_turns(spark):
    rows = [(0, "e1", None), (1, "e1", "turn left at the red building"), (2, "e1", "ok"), (3, "e2", "fly north over the road"), (4, "e2", "some other answer"), (5, "e2", "turn left at the red building")]
    df = spark.createDataFrame(rows, "id long, episode string, answer string")
    got = {r.id: r for r in generate.augmented(df, "id", "answer", reply).collect()}
    assert [got[i].outcome for i in range(6)] == ["short", "success", "short", "success", "failed", "success"]
    p = got[1].paraphrases
    assert p.positives == ["turn left by the red building", "at the red building turn left"] and p.negatives == ["turn right at the white tower now"] and p.method == "model"
    assert p.valid_positives == p.positives and got[5].paraphrases == p and got[4].paraphrases is None
    assert got[3].paraphrases.positives == [] and got[3].paraphrases.negatives == ["just one long line here"] and got[3].paraphrases.valid_negatives == []
    ruled = {r.id: r.paraphrases for r in generate.augmented(df, "id", "answer", reply, rules=True).collect()}
    assert ruled[4].method == "fallback_patterns" and len(ruled[4].positives) == 2 and ruled[4].valid_positives == ruled[4].positives and len(ruled[4].negatives) == 1 and ruled[0] is None
    counts = {r.split: tuple(r)[1:] for r in generate.augmentation_counts(spark.createDataFrame([(*x, got[x[0]].outcome) for x in rows], "id long, episode string, answer string, outcome string"), F.col("episode"), "episode").collect()}
    assert counts == {"e1": (1, 1, 1, 0), "e2": (1, 3, 2, 1)}


def test_regenerated_rows_keep_what_fails(spark):
    raw = spark.createDataFrame([("r_2", "m", "[QUE] where? [INS] go left", ["[INS] start"]), ("r_3", "m", "[QUE] what? [INS] zu spät", ["[INS] start"]), ("r_4", "m", "[QUE] what? [INS] nobody", ["[INS] start"]), ("r_5", "m", "[INS] only", ["[INS] start"])], "route_index string, map_name string, instructions string, pre_dialogs array<string>")
    turns = spark.createDataFrame([(1, "e", "m", 1, "where?", "go left", "start"), (2, "e", "m", 2, "what?", "zu spät", "start"), (3, "e", "m", 3, "other question", "nobody", "start")], "place long, episode_id string, map_name string, turn_id int, question string, answer string, first_instruction string")
    done = generate.regenerated(raw, turns, "route_index", "place", "answer", lambda p: regenerate.echo(p), attempts=1)
    got = {r.route_index: (r.status, r.instructions) for r in done.collect()}
    assert got["r_3"] == ("failed", "[QUE] what? [INS] zu spät") and got["r_4"] == ("unmatched", "[QUE] what? [INS] nobody") and got["r_5"] == ("unmatched", "[INS] only")
    assert got["r_2"][0] == "new" and got["r_2"][1].startswith("[QUE] where? [INS] 1. please go left")
    scores = generate.regeneration_scores(done, "route_index").collect()
    assert [s.route_index for s in scores] == ["r_2"] and 0 < scores[0].bleu4 < 1 and 0 < scores[0].rouge_l < 1 and 0 <= scores[0].total <= 1


def test_regenerated_rows_link_once(spark):
    """The links were made for the prompts and once more for the result: the plan of the result held the ratios."""
    raw = spark.createDataFrame([("r_2", "m", "[QUE] where? [INS] go left", ["[INS] start"])], "route_index string, map_name string, instructions string, pre_dialogs array<string>")
    turns = spark.createDataFrame([(1, "e", "m", 1, "where? ", "go left", "start")], "place long, episode_id string, map_name string, turn_id int, question string, answer string, first_instruction string")
    done = generate.regenerated(raw, turns, "route_index", "place", "answer", lambda p: [x.upper() for x in p])
    assert "EvalPython" not in done._jdf.queryExecution().optimizedPlan().toString() and done.first().status == "new"
