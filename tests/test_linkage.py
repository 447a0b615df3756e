"""Record linkage: the ratio against the standard library, the join against a loop over all pairs."""

import random
from difflib import SequenceMatcher

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import matching
from corpusloom.operators import linkage

TEXT = st.text("abc ", max_size=40)


@settings(max_examples=400, deadline=None)
@given(TEXT, TEXT)
def test_ratio_of_short_texts(a, b):
    assert matching.ratio(a, b) == SequenceMatcher(None, a, b).ratio()


@settings(max_examples=400, deadline=None)
@given(TEXT, TEXT, st.sampled_from([0.0, 0.3, 0.5, 0.9, 1.0]))
def test_above_is_the_ratio_held_against_a_least(a, b, least):
    assert matching.above(a, b, least) == (SequenceMatcher(None, a, b).ratio() > least)


def test_reversed_texts_are_told_apart_without_matching(monkeypatch):
    """Letter counts of a reversed text are equal, so its blocks were all matched before; subsequences tell it apart."""
    rng, calls, real = random.Random(7), [], matching.Automaton
    monkeypatch.setattr(matching, "Automaton", lambda *x: calls.append(x) or real(*x))
    for n in (60, 250, 900):
        text = "".join(rng.choice("etaoin shrdlu") for _ in range(n))
        assert not matching.above(text, text[::-1], 0.9) and not calls
        near = mangled(rng, text, 3)
        assert matching.above(text, near, 0.9) == (SequenceMatcher(None, text, near).ratio() > 0.9)
        calls.clear()


def mangled(rng, text, edits):
    text = list(text)
    for _ in range(edits):
        i = rng.randrange(len(text) + 1)
        text[i : i + rng.choice([0, 0, 1, 5])] = rng.choice(["", "x", "the ", " "])
    return "".join(text)


def test_ratio_of_long_texts_with_popular_characters():
    rng = random.Random(2)
    for n in (150, 199, 200, 201, 350, 900):
        for alphabet in ("ab", "etaoin shrdlu", "".join(map(chr, range(97, 123))) + " " * 5 + "éü東"):
            a = "".join(rng.choice(alphabet) for _ in range(n))
            for b in (mangled(rng, a, 4), mangled(rng, a, 60), "".join(rng.choice(alphabet) for _ in range(n + 7)), a[n // 2 :] + a[: n // 2]):
                assert matching.ratio(a, b) == SequenceMatcher(None, a, b).ratio(), (a, b)
                assert matching.ratio(b, a) == SequenceMatcher(None, b, a).ratio(), (b, a)


def test_bounds_never_lose_a_pair(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("etaoin shé東x") for _ in range(rng.choice([0, 1, 5, 12, 60, 300]))) for _ in range(40)]
    pairs = [(a, mangled(rng, a, rng.randint(0, 6))) for a in base for _ in range(6)] + [(a, rng.choice(base)) for a in base]
    df = spark.createDataFrame(pairs, "a string, b string")
    bound = matching.bound(matching.profile(F.col("a")), matching.profile(F.col("b")))
    for r in df.select("a", "b", bound.alias("bound"), matching.band(F.col("a"), 0.9).alias("x"), matching.band(F.col("b"), 0.9).alias("y")).collect():
        want = SequenceMatcher(None, r.a, r.b).ratio()
        assert r.bound >= want and (want <= 0.9 or abs(r.x - r.y) <= 1), (r, want)


def loop(raw, turns):
    """Every raw row against every turn, in the order of turns."""
    found = {}
    for key, instruction, dialogs, map_name, route in raw:
        if instruction is None or "[QUE]" not in instruction or "[INS]" not in instruction:
            continue
        ins, que = instruction.find("[INS]"), instruction.find("[QUE]")
        answer, question = instruction[ins + 5 :].strip().lower(), instruction[que + 5 : ins].strip().lower()
        first = dialogs[0][dialogs[0].find("[INS]") + 5 :].strip().lower()
        for order, episode, map2, turn, q, a, f in sorted(turns):
            if "aug_pattern" in episode or map2 != map_name or turn + 1 != int(route[route.find("_") + 1 :]) or (a or "").strip().lower() != answer:
                continue
            if SequenceMatcher(None, (q or "").strip().lower(), question).ratio() > 0.9 and SequenceMatcher(None, (f or "").strip().lower(), first).ratio() > 0.9:
                found[key] = order
                break
    return found


def test_linkage_against_a_loop(spark):
    rng = random.Random(5)
    words = ["go", "north", "past", "the", "tall", "building", "then", "turn", "left", "At", "Parking", "é"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    questions, firsts, answers = [say(n) for n in (9, 30, 60)], [say(12), say(50)], [say(4), ""]
    turns = [(i, f"{i}_aug_pattern_1" if rng.random() < 0.1 else str(i), rng.choice("AAB"), rng.randint(0, 1), mangled(rng, rng.choice(questions), 1), rng.choice(answers), mangled(rng, rng.choice(firsts), 1)) for i in range(150)]
    turns += [(150, "150", None, 1, "q", "a", "f"), (151, "151", "A", 1, None, answers[0], None)]
    raw = []
    for i in range(240):
        q, f = mangled(rng, rng.choice(questions), rng.choice([0, 1, 8])), mangled(rng, rng.choice(firsts), rng.choice([0, 1, 9]))
        text = rng.choice([f"[QUE] {q.upper()} [INS] {rng.choice(answers)} ", f"[QUE] {q}[INS]{rng.choice(answers)}", f"[INS] {q} [QUE]", q, f"\xa0[QUE] {q} [INS] {rng.choice(answers)}\n"])
        raw.append((i, text, [rng.choice(["[INS] ", "xxxx", "[INS]"]) + f, "later"], rng.choice("AAB"), f"r{i}_{rng.randint(1, 2)}"))
    raw += [(900, f"[QUE][INS]{answers[0]}", ["[INS]"], "A", "r_2"), (901, None, ["x"], "A", "r_1"), (902, raw[0][1], raw[0][2], None, "r_1")]
    got = linkage.linked(
        spark.createDataFrame(raw, "key long, instructions string, pre_dialogs array<string>, map_name string, route_index string"),
        spark.createDataFrame(turns, "place long, episode_id string, map_name string, turn_id int, question string, answer string, first_instruction string"), "key", "place",
    )
    want = loop(raw, turns)
    assert {r.key: r.turn_key for r in got.collect()} == want and 30 < len(want) < 200 and want[900] == 151


def test_query_links_each_turn_to_itself(spark):
    """Of two turns with its answer, a row is linked to the one with its question: reversed ones stand first at even turns."""
    got = {r.route_index: (r.conv_id, r.turn, r.copy) for r in linkage.linkage_ratio(spark, "/root/testdata/sf0.001").collect()}
    for k, (c, t, copy) in got.items():
        assert f"{c}_{t + 1}" == k and copy == (c % 4 != 3 and t % 2 == 0)
    assert {copy for _, _, copy in got.values()} == {0, 1} and any(c % 4 == 3 for c, _, _ in got.values())


def test_empty_tables(spark):
    raw = spark.createDataFrame([], "key long, instructions string, pre_dialogs array<string>, map_name string, route_index string")
    turns = spark.createDataFrame([], "place long, episode_id string, map_name string, turn_id int, question string, answer string, first_instruction string")
    assert linkage.linked(raw, turns, "key", "place").count() == 0
