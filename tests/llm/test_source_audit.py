import os
import random
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import source_audit
from corpusloom.llm.radix_trie import Flat, Trie, merge, terms

BYTES = st.text("abé", max_size=6).map(lambda x: x.encode())


def filled(items):
    trie = Trie()
    for term, source, n in items:
        leaf = trie.leaf(term)
        leaf.docs += 1
        leaf.counts[source] = leaf.counts.get(source, 0) + n
    return trie


def content(trie):
    return [(t, n.docs, dict(sorted(n.counts.items()))) for t, n in trie.walk()]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(BYTES, st.sampled_from("xyz"), st.integers(1, 5)), max_size=40), st.integers(0, 40))
def test_tries_count_in_order_and_merge(items, cut):
    whole = filled(items)
    docs, counts = Counter(t for t, _, _ in items), defaultdict(Counter)
    for t, s, n in items:
        counts[t][s] += n
    want = [(t, docs[t], dict(sorted(counts[t].items()))) for t in sorted(docs)]
    assert content(whole) == want and whole.leaves == len(want)
    out, known = Trie(), {}
    for part in (items[:cut], items[cut:]):
        flat = Flat()
        for t, node in filled(part).walk():
            flat.add(t, node)
        assert list(terms(flat.shared, flat.tails))[1:] == sorted({t for t, _, _ in part})
        merge(out, known, *flat.columns())
    assert content(out) == want


def test_shares_are_exact():
    rng = random.Random(2)
    c = [0, 1, 10**9, 2**40] + [rng.getrandbits(44) for _ in range(500)]
    n = [x + rng.getrandbits(rng.randint(1, 49)) + 1 for x in c]
    assert source_audit.share(np.array(c), np.array(n)).tolist() == [1 + 10**9 * (x + 1) // y for x, y in zip(c, n)]


def brute(rows, least_docs=3, top=200):
    import re

    word = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        w = word.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        docs[lang or ""].update(set(w))
        counts[lang or "", source or ""].update(w)
        groups[lang or ""].add(source or "")
    out = []
    for lang, sources in groups.items():
        kept = sorted((t for t, n in docs[lang].items() if n >= least_docs), key=lambda t: t.encode())
        whole = Counter()
        for s in sources:
            whole.update(counts[lang, s])
        p = lambda c, n: 1 + 10**9 * (c + 1) // (n + len(kept))  # noqa: B023, E731
        n = {s: sum(counts[lang, s][t] for t in kept) for s in sources}
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            mine = {t: p(counts[lang, s][t], n[s]) for t in kept}
            pairs = [(-sum(f(mine[t], p(counts[lang, o][t], n[o])) for t in kept), o.encode()) for o in sources - {s}]
            best = [(-f(mine[t], q), t.encode()) for t in kept if counts[lang, s][t] and mine[t] > (q := p(whole[t], sum(n.values())))]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(best)[:top])):
                out += [(lang, s, part, item.decode(), -v, r) for r, (v, item) in enumerate(found, 1)]
    return sorted(out)


def texts():
    rng = random.Random(4)
    vocabulary = [f"w{c}{d}" for c in "abcdefghij" for d in "klmné東"] + ["The", "the", "x" * 3000]
    rows = [(" ".join(rng.choice(vocabulary[rng.randrange(40) :]) + rng.choice([" ", ", ", "9"]) for _ in range(rng.randint(0, 60))), rng.choice(["en", "de"]), f"s{min(int(rng.expovariate(0.3)), 9)}") for _ in range(150)]
    return rows + [(None, None, None), ("", "xx", "s1"), ("the wak", None, "s1"), ("one", "xx", "s2"), ("two", "xx", None), rows[0], rows[0], ("wak " * 20000, "en", "s1"), ("é" * 5, "en", "ß"), ("퟿\U0001f600", "en", "s2")]


def test_audit_against_brute_force_with_small_tries_and_blocks(spark, monkeypatch):
    rows = texts()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "text string, lang string, source string, value int, terms string").repartition(5)
    want = brute(rows)
    assert sorted(tuple(r) for r in source_audit.source_audit(df).collect()) == want
    for name, x in (("ENTRIES", 40), ("BLOCK", 7), ("HELD", 50), ("PREFIX", 2)):
        monkeypatch.setattr(source_audit, name, x)
    assert sorted(tuple(r) for r in source_audit.source_audit(df, ranges=40).collect()) == want
    assert sorted(tuple(r) for r in source_audit.source_audit(df, top=3, least_docs=1).collect()) == brute(rows, 1, 3)


def test_empty_table(spark, empty_dir):
    df = source_audit.op12_source_divergence(spark, empty_dir)
    assert df.count() == 0 and dict(df.dtypes)["value"] == "bigint" and dict(df.dtypes)["rank"] == "int"
