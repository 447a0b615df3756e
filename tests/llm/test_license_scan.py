import itertools
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import license_scan
from corpusloom.llm.license_scan import BASE, NOTICES, Automaton, license_scan as scan, parse

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def brute_places(t, phrases):
    w = WORD.findall(lower(t))
    return len(w), sorted((i, p) for p in phrases for i in range(len(w)) if w[i : i + len(p.split())] == p.split())


def texts():
    rng = random.Random(7)
    parts = [*BASE, *NOTICES, "CC-BY 4.0", "cc by cc by-nc", "GNU", "general public License", "Apache  License,\nVersion 2.0", "mit\tlicense", "the", "élan", "42", "İ", "ccby"]
    out = [" ".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(80)]
    out += [None, "", "  \n", "cc by", "CC BY" * 3, "x" * 50000 + " mit license", "cc by " * 5000, "SPDX-License-Identifier: MIT", "// SPDX-License-Identifier: (GPL-2.0-only WITH Classpath-exception-2.0) OR Apache-2.0 */",
            "a\nSPDX-License-Identifier: MIT OR\nspdx-license-identifier: CC-BY-NC-4.0 and MIT", "spdx license identifier of nothing", "cc by", "cc\x00by ퟿"]
    return out


def test_query_against_brute_force(spark, tmp_path, rows):
    docs = [(i, t, "x") for i, t in enumerate(texts() + [r[1] for r in rows])] + [(None, "mit license", None), (0, texts()[0], "x")]
    spark.createDataFrame(docs, "doc_id long, text string, score string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = license_scan.op11_license_scan(spark, str(tmp_path)).collect()
    want = []
    for doc_id, t, _ in docs:
        n, base = brute_places(t, BASE)
        at = [i for i, _ in base]
        _, every = brute_places(t, NOTICES)
        own = {NOTICES[p][0] for _, p in every} | {BASE[p] for _, p in base}
        tags = {"mit"} if t and t.startswith("SPDX") else {"gpl-2.0-only", "apache-2.0"} if t and t.startswith("//") else {"cc-by-nc-4.0", "mit"} if t and t.startswith("a\nSPDX") else set()
        want.append((doc_id, n, len(base), min(at, default=None), max(at, default=None), ",".join(sorted({BASE[p] for _, p in base})), ",".join(sorted(own | tags))))
    assert sorted((tuple(r)[:7] for r in got), key=repr) == sorted(want, key=repr)
    assert all(0 <= r.score <= 1 and (r.score > 0) == bool(r.labels) for r in got)
    assert all(r.grants is None or 0 <= r.grants <= 1 for r in got)


def test_empty_table(spark, empty_dir):
    df = license_scan.op11_license_scan(spark, empty_dir)
    assert df.count() == 0 and df.columns[:8] == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def test_extra_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "MIT License", 7, "a", "b", [1]), (1, None, 8, None, None, None)], "doc_id long, text string, n_words int, Labels string, other string, places array<int>")
    r = scan(df).orderBy("n_words").collect()
    assert [x.other for x in r] == [None, "b"] and [x.n_words for x in r] == [0, 2] and r[1].labels == ["mit"] and [c.lower() for c in scan(df).columns].count("labels") == 1
    named = scan(df.select("text", F_as(df, "score")))
    assert sorted(x.score > 0 for x in named.collect()) == [False, True]


def F_as(df, name):
    return df["n_words"].alias(name)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=40), st.lists(st.lists(st.sampled_from("abc"), min_size=1, max_size=4).map(" ".join), min_size=1, max_size=6, unique=True))
def test_automaton_finds_all_overlaps(text, phrases):
    assert Automaton(phrases).places([x.encode() for x in text]) == brute_places(" ".join(text), phrases)[1]


def test_expressions():
    p = lambda x: (lambda e: (e.text, e.ids, e.grants))(parse(x.encode()))
    assert p("MIT") == ("mit", ["mit"], 1.0)
    assert p("GPL-2.0-only OR MIT AND CC-BY-NC-4.0") == ("gpl-2.0-only or mit and cc-by-nc-4.0", ["cc-by-nc-4.0", "gpl-2.0-only", "mit"], 0.4)
    assert p("(GPL-2.0-only OR MIT) AND CC-BY-NC-4.0 */")[::2] == ("(gpl-2.0-only or mit) and cc-by-nc-4.0", 0.2)
    assert p("GPL-2.0-or-later WITH GCC-exception-3.1")[1:] == (["gpl-2.0-or-later"], 0.4 + license_scan.EXCEPTION)
    assert p("GPL-2.0+ or MIT, see the file")[0] == "gpl-2.0+ or mit"
    for broken in ("", "OR MIT", "MIT OR", "(MIT", "MIT AND (", "(MIT OR) BSD-2-Clause", "MIT WITH (x)", "(MIT OR ISC) WITH x", "()", "((MIT) ISC)"):
        assert p(broken) == (broken.strip(), [], None), broken


OPS = {"or": max, "and": min}


def random_expression(rng, depth):
    """Text with only the brackets that are needed, its value, and the weakest operator."""
    if depth == 0 or rng.random() < 0.3:
        i = rng.choice(["mit", "gpl-3.0-only", "cc-by-nc-4.0", "lgpl-2.1", "foo-1"])
        return i, license_scan.grant(i), 3
    op = rng.choice(["or", "and"])
    (a, av, ap), (b, bv, bp) = random_expression(rng, depth - 1), random_expression(rng, depth - 1)
    p = {"or": 1, "and": 2}[op]
    a, b = (f"({x})" if xp < p or rng.random() < 0.2 else x for x, xp in ((a, ap), (b, bp)))
    return f"{a} {op.upper() if rng.random() < 0.5 else op} {b}", OPS[op](av, bv), p


def test_random_expressions_against_their_trees():
    rng = random.Random(5)
    for depth in itertools.islice(itertools.cycle(range(6)), 300):
        text, value, _ = random_expression(rng, depth)
        assert parse(text.encode()).grants == value, text
        assert parse(parse(text.encode()).text.encode()).grants == value
