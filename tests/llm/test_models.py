import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T

from corpusloom.llm import decontamination, lm_scoring, quality_classifier, url_filter

from .conftest import prose
from .test_rows_ops import WORD, as_rows


@pytest.fixture(scope="module")
def labelled(spark, sf_dir, rows):
    rng = random.Random(4)
    items = [(i, prose(rng, n)) for i, n in enumerate((13, 20, 40, 3, 1))] + [(5, rows[3][1][:200]), (6, None), (7, " "), (8, rows[3][1][:200])]
    spark.createDataFrame(items, "item_id long, text string").write.mode("overwrite").parquet(f"{sf_dir}/benchmark.parquet")
    marks = [(r[0], int(not (r[1] or "").startswith(("###", "To"))), 0) for r in rows] + [(None, 1, 0), (5, None, 1), (10**6, 1, 0)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{sf_dir}/labels.parquet")
    urls = ["https://a.example.com/en/1", "http://A.Example.com/en/70?x#y", "https://b.example.net/de/8", "https://b.example.net/de/9", "http://x.org/es/", "http://x.org/fr", "x://y.z", None, "no", "://", "http://example.com", "http://notexample.com/en/7", "http://m.b.example.net?q=://k/"]
    pages = [(i, u, '<a href="http://x.org/1">' if i % 2 else None) for i, u in enumerate(urls)] + [(0, urls[0], None)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.mode("overwrite").parquet(f"{sf_dir}/pages.parquet")
    return items


def jaccard(a, b):
    a, b = Counter(a), Counter(b)
    return sum((a & b).values()) / sum((a | b).values())


def brute_leaks(docs, items):
    out = {}
    for doc_id, t in docs:
        w = (t or "").lower().split()
        for item_id, it in items:
            v = (it or "").lower().split()
            m = min(5, len(v))
            if not v:
                continue
            want = [tuple(v[i : i + m]) for i in range(len(v) - m + 1)]
            for s in range(max(1, len(w) - len(v) + 1)):
                x = w[s : s + len(v)]
                got = [tuple(x[i : i + m]) for i in range(len(x) - m + 1)]
                if got and (j := jaccard(got, want)) >= 0.8:
                    out[doc_id, item_id] = max(out.get((doc_id, item_id), 0), round(j, 6))
    return out


def test_leaks(spark, labelled):
    rng = random.Random(8)
    docs = []
    for i in range(60):
        v = labelled[rng.choice((0, 1, 2, 5))][1].split()
        for _ in range(rng.choice((0, 0, 1, 2, 3))):
            v[rng.randrange(len(v))] = "changed"
        if i % 7 == 0:
            v.insert(rng.randrange(len(v)), "more")
        docs.append((i, f"{prose(rng, rng.randint(0, 50))} {' '.join(v)} {prose(rng, rng.randint(0, 50))}"))
    docs += [(60, prose(rng, 300)), (61, None), (62, ""), (63, labelled[3][1].upper()), (0, docs[0][1]), (None, docs[1][1]), (65, labelled[4][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("k", decontamination.F.lit(1))
    items = spark.createDataFrame(labelled, "item_id long, text string")
    got = {(r.doc_id, r.item_id): round(r.similarity, 6) for r in decontamination.leaks(df, items).collect()}
    want = brute_leaks(docs, labelled)
    assert len(want) > 25 and got == want
    bad = {d for d, _ in want}
    kept = decontamination.decontaminate(df, items)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(d for d, _ in docs if d not in bad)


def test_leaks_between_aligned_starts(spark):
    """The two aligned starts have a similarity of 0.774, the one between them 0.803."""
    item = [f"i{i}" for i in range(59)]
    copy = ["x", *item[1:29], "new", "words", *item[29:58], "y"]
    rng = random.Random(6)
    docs = [(0, " ".join(f"{prose(rng, 20)} {' '.join(copy)} {prose(rng, 20)}".split())), (1, " ".join([*copy, "far"] + ["f"] * 200 + item)), (2, " ".join(copy))]
    items = [(0, " ".join(item))]
    want = brute_leaks(docs, items)
    got = decontamination.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert want[0, 0] > 0.8 and {(r.doc_id, r.item_id): round(r.similarity, 6) for r in got} == want


def test_all_fingerprints_within_the_radius_meet(spark):
    rng = random.Random(2)
    pairs = []
    for _ in range(50):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(0, 22)):
            b ^= 1 << bit
        pairs.append(tuple(x - (1 << 64) if x >> 63 else x for x in (a, b)))
    df = spark.createDataFrame(pairs, "a long, b long")
    met = df.select(decontamination.F.arrays_overlap(decontamination.blocks(decontamination.F.col("a"), 22), decontamination.blocks(decontamination.F.col("b"), 22)).alias("m"))
    assert all(r.m for r in met.collect())


def test_url_rules(spark, sf_dir, labelled):
    want = []
    for p in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", p.url or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = [(len(r), r, v) for v, r in url_filter.RULES if ("." + host).endswith("." + r.partition("/")[0]) and host and path.startswith("/" + r.partition("/")[2])]
        want.append((p.page_id, host, path, max(fits)[1] if fits else None))
    got = url_filter.op4_url_filter(spark, sf_dir)
    assert as_rows(got.drop("verdict")) == sorted(want, key=repr)
    rules = {r: v for v, r in url_filter.RULES}
    assert all(r.verdict == rules[r.rule] for r in got.collect() if r.rule)


def test_propagation(spark):
    """Against dense personalised PageRank in numpy."""
    edges = [("a", "b", 2.0), ("b", "c", 1.0), ("c", "a", 1.0), ("d", "c", 3.0), ("b", "a", 1.0)]
    seeds = [("a", 3, 0), ("c", 1, 2), ("d", 0, 2), ("e", 0, 0)]
    got = {r.host: (r.trust, r.distrust) for r in url_filter.propagate(spark.createDataFrame(edges, "src string, dst string, w double"), spark.createDataFrame(seeds, "host string, trust long, distrust long")).collect()}
    names = "abcde"
    assert sorted(got) == list(names)
    for k, flip in ((0, False), (1, True)):
        m = np.zeros((5, 5))
        for s, d, w in edges:
            s, d = (d, s) if flip else (s, d)
            m[names.index(d), names.index(s)] = w
        m /= np.maximum(m.sum(0), 1e-12)
        seed = np.array([s[1 + k] for s in seeds for _ in [0]], float)
        start = np.zeros(5)
        for s in seeds:
            start[names.index(s[0])] = s[1 + k]
        start /= start.sum()
        x = start
        for _ in range(url_filter.ROUNDS):
            x = url_filter.DAMPING * m @ x + (1 - url_filter.DAMPING) * start
        assert seed.sum() and all(abs(got.get(n, (0, 0))[k] - x[i]) < 1e-12 for i, n in enumerate(names))


def test_propagation_settles(spark):
    """Against the solved linear system, on a chain of hosts that is longer than any fixed number of rounds reaches."""
    n = 30
    edges = [(f"h{i}", f"h{i + 1}", 1.0) for i in range(n - 1)] + [(f"h{n - 1}", "h0", 1.0), ("h4", "h2", 2.0)]
    seeds = [("h0", 3, 0), ("h5", 0, 1)]
    got = {r.host: (r.trust, r.distrust) for r in url_filter.propagate(spark.createDataFrame(edges, "src string, dst string, w double"), spark.createDataFrame(seeds, "host string, trust long, distrust long"), rounds=None).collect()}
    for k in (0, 1):
        m, start = np.zeros((n, n)), np.zeros(n)
        for edge in edges:
            s, d = (int(x[1:]) for x in (edge[:2] if k == 0 else edge[1::-1]))
            m[d, s] = edge[2]
        m /= m.sum(0)
        start[0 if k == 0 else 5] = 1
        want = np.linalg.solve(np.eye(n) - url_filter.DAMPING * m, (1 - url_filter.DAMPING) * start)
        assert all(abs(got[f"h{i}"][k] - want[i]) < 1e-8 for i in range(n))


def test_rule_ensemble_on_held_out_rows():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.6) & (x[:, 1] < 0.7) | (x[:, 2] > 0.9)).astype(float)
    intercept, rules = quality_classifier.fit_rules(x[:2000], y[:2000])
    p = intercept + sum(w * quality_classifier.holds(x[2000:], r) for r, w in rules)
    assert ((p > 0) == (y[2000:] > 0)).mean() > 0.93 and len(rules) < 150
    assert quality_classifier.fit_rules(x[:0], y[:0]) == (0.0, [])


def test_quality_classifier(spark, sf_dir, labelled, rows):
    got = quality_classifier.op3_quality_classifier(spark, sf_dir).collect()
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 4 == 2
    assert sorted(((r.doc_id, r.held_out) for r in got), key=repr) == sorted(((r[0], held(r[0])) for r in rows), key=repr)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)


def test_compiled_scores_equal_the_model(spark, sf_dir, labelled):
    """The score column against the rules evaluated in numpy, row by row."""
    rng = np.random.default_rng(5)
    x = rng.random((800, len(quality_classifier.FEATURES)))
    model = quality_classifier.fit_rules(x, ((x[:, 0] > 0.5) & (x[:, 2] < 0.6)).astype(float))
    assert len(model[1]) > 3
    names = list(quality_classifier.FEATURES)
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], names)
    got = [r.score for r in df.select(quality_classifier.score_column(model, names).alias("score")).collect()]
    want = 1 / (1 + np.exp(-(model[0] + sum(w * quality_classifier.holds(x, r) for r, w in model[1]))))
    assert np.allclose(got, want, atol=1e-12)


def test_classifier_fits_one_row_of_each_id(spark):
    docs = spark.createDataFrame([(i % 40, f"word {i} " * (1 + i % 7)) for i in range(4000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] * 3, "doc_id long, y int")
    seen = []
    fit = quality_classifier.fit_rules
    try:
        quality_classifier.fit_rules = lambda x, y, **k: seen.append((x.shape, y.tolist())) or fit(x, y, **k)
        quality_classifier.train(docs, labels, "text", sample=30)
    finally:
        quality_classifier.fit_rules = fit
    assert seen[0][0] == (30, len(quality_classifier.FEATURES)) and len(seen[0][1]) == 30


def test_held_out_accuracy_on_documents(spark, tmp_path):
    rng = random.Random(2)
    good = lambda: " ".join(rng.choice(["the", "of", "and"]) if rng.random() < 0.3 else f"word{rng.randrange(500)}" for _ in range(rng.randint(60, 150)))
    bad = lambda: " ".join(rng.choice(["BUY", "now!", "###", "win$", f"x{rng.randrange(9)}"]) for _ in range(rng.randint(20, 150)))
    spark.createDataFrame([(i, good() if i % 2 else bad()) for i in range(400)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(400)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = quality_classifier.op3_quality_classifier(spark, str(tmp_path)).where("held_out").collect()
    assert len(got) > 50 and sum(r.predicted == r.doc_id % 2 for r in got) >= 0.95 * len(got)


def test_lm_base_scores(spark, sf_dir, rows, monkeypatch):
    monkeypatch.setattr(lm_scoring, "FREQUENT", 50)
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    tokens = [[*WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in r[1] or "")), None] for r in rows]
    c = Counter(t for r, x in zip(rows, tokens) if not held(r[0]) for t in x)
    n, v = sum(c.values()), len(c)
    want = sorted(((r[0], held(r[0]), len(x), sum(c[t] > 0 for t in x), n, round(sum(math.log10((c[t] + 1) / (n + v + 1)) for t in x), 6)) for r, x in zip(rows, tokens)), key=repr)
    got = lm_scoring.op6_lm_scoring(spark, sf_dir).collect()
    assert sorted(((*tuple(r)[:5], round(r.base_score, 6)) for r in got), key=repr) == want
    assert all(-9 * r.n_tokens * 30 < r.score < 0 for r in got)


def test_model_is_fitted_on_all_training_documents(spark, monkeypatch):
    """Each document is read in one of the rounds."""
    texts = [f"text {i} of {i * i}" for i in range(50)]
    fitted, train = [], lm_scoring.train

    def spy(docs, *args, **options):
        fitted.extend((np.frombuffer(r.ids, "<i4").tolist(), r.part) for r in docs.collect())
        return train(docs, *args, **options)

    monkeypatch.setattr(lm_scoring, "train", spy)
    lm_scoring.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    model = lm_scoring.subword.load(lm_scoring.subword.tokenizer_path())
    assert sorted(i for i, _ in fitted) == sorted([*model.library.encode(t, add_special_tokens=False).ids, model.size] for t in texts)
    assert {p for _, p in fitted} == set(range(lm_scoring.ROUNDS))


def test_scores_against_a_direct_forward_pass(spark, sf_dir, monkeypatch):
    """The score of each document from plain window-by-window forward passes of the same model over its ids."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 75")
    kept, rows = [], lm_scoring.model_scores
    monkeypatch.setattr(lm_scoring, "model_scores", lambda ids, vocabulary, model, rare: kept.extend((vocabulary, model)) or rows(ids, vocabulary, model, rare))
    got = {r.doc_id: r.score for r in lm_scoring.score(docs).collect()}
    vocabulary, model = kept
    assert not vocabulary.more
    library = lm_scoring.subword.load(lm_scoring.subword.tokenizer_path())
    for r in docs.collect():
        if len(r.text or "") > 3000:
            continue
        ids = np.array([*library.library.encode("".join(c.lower() if c.isascii() else c for c in r.text or ""), add_special_tokens=False).ids, library.size])
        before = np.append(lm_scoring.START, ids[:-1])
        seen = np.append(lm_scoring.INPUTS + 1, vocabulary.inp[ids[:-1]])
        total, done = float(vocabulary.within(ids, before).sum()), 0
        for first in range(0, len(ids), 24):
            if done >= len(ids):
                break
            end = min(first + 32, len(ids))
            z, _ = model.forward(seen[None, first:end])
            total += sum(float(z[0, i - first, vocabulary.cls[ids[i]]]) for i in range(done, end)) / math.log(10)
            done = end
        assert abs(total - got[r.doc_id]) < 1e-3 * max(1, abs(total)), r.doc_id


@pytest.mark.parametrize("pairs", [0, 40])
def test_all_pair_counts_reach_the_scores(spark, sf_dir, monkeypatch, pairs):
    """How many pairs are broadcast changes nothing; with PAIRS = 0 not even the top level is."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 60")
    monkeypatch.setattr(lm_scoring, "train", lambda docs, vocabulary, prior, *a, **k: lm_scoring.Attention(prior=prior))
    want = {r.doc_id: r.score for r in lm_scoring.score(docs).dropDuplicates(["doc_id"]).collect()}
    monkeypatch.setattr(lm_scoring, "PAIRS", pairs)
    got = {r.doc_id: r.score for r in lm_scoring.score(docs).dropDuplicates(["doc_id"]).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-6 * abs(want[k]) for k in want)


def test_model_scores_each_id_once_and_sums_to_one():
    rng = np.random.default_rng(0)
    net = lm_scoring.Attention(inputs=12, width=4, classes=6, prior=lm_scoring.prior_logits(rng.integers(0, 9, (12, 6)).astype(float)))
    at = np.array([0, 5, 5, 105, 138, 170])
    inputs, target = rng.integers(0, 12, at[-1]), rng.integers(0, 6, at[-1])
    got = lm_scoring.scored(net, inputs, target, at, 3)
    every = np.stack([lm_scoring.scored(net, inputs, np.full(at[-1], c), at) for c in range(6)])
    assert np.allclose(np.exp(every).sum(0), 1, atol=1e-4)
    for a, b in zip(at[:-1], at[1:]):
        done = 0
        for first in range(0, max(1, b - a), 24):
            if done >= b - a:
                break
            end = min(first + 32, b - a)
            z, _ = net.forward(inputs[None, a + first : a + end])
            for i in range(done, end):
                assert abs(z[0, i - first, target[a + i]] - got[a + i]) < 1e-4
            done = end


def test_large_logits_are_shifted():
    rng = np.random.default_rng(6)
    net = lm_scoring.Attention(inputs=9, width=4, classes=5, window=8, prior=(rng.standard_normal((9, 5)) * 150).astype(np.float32))
    net.p["out"] *= 200
    ids, target = rng.integers(0, 9, (3, 8)), rng.integers(0, 5, (3, 5))
    want = np.take_along_axis(net.forward(ids, 3)[0], target[..., None], 2)[..., 0]
    assert np.abs(want).max() > 100 and np.allclose(net.ready().target_logs(ids, target, 3), want, rtol=1e-3, atol=1e-3)


def test_probabilities_within_the_last_class_sum_to_one(monkeypatch):
    monkeypatch.setattr(lm_scoring, "CLASSES", 3)
    rng = np.random.default_rng(4)
    vocabulary = lm_scoring.Vocabulary(np.array([50, 3, 40, 0, 7, 2, 9]))
    rest = np.flatnonzero(vocabulary.rest)
    n = {(a, int(b)): int(rng.integers(1, 9)) for a in (0, 4, 6, lm_scoring.START) for b in rest[:3]}
    totals = Counter()
    for (a, _), c in n.items():
        totals[a] += c
    kept = {k: c for k, c in n.items() if c > 3}
    vocabulary.keep_pairs(np.array([a << 20 | b for a, b in kept]), np.array(list(kept.values()), float), np.array(list(totals)), np.array(list(totals.values()), float))
    for a in (0, 1, 4, 5, 6, lm_scoring.START):
        p = 10 ** vocabulary.within(rest, np.full(len(rest), a))
        assert abs(p.sum() - 1) < 1e-9
        for b, x in zip(rest, p):
            if a in totals:
                left = totals[a] - sum(c - lm_scoring.DISCOUNT for (y, _), c in kept.items() if y == a)
                assert abs(x - (max(kept.get((a, b), 0) - lm_scoring.DISCOUNT, 0) + left * vocabulary.share[b]) / totals[a]) < 1e-9
            else:
                assert abs(x - vocabulary.share[b]) < 1e-9
    assert (vocabulary.within(np.flatnonzero(~vocabulary.rest), np.zeros(2, int)) == 0).all()


def test_gradient():
    rng = np.random.default_rng(3)
    net = lm_scoring.Attention(inputs=7, width=3, classes=5, window=6)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    ids, target, weight = rng.integers(0, 7, (2, 6)), rng.integers(0, 5, (2, 6)), rng.random((2, 6)) < 0.8

    def loss():
        z, _ = net.forward(ids)
        return -(np.take_along_axis(z, target[..., None], 2)[..., 0] * weight).sum() / weight.sum()

    g = net.gradient(ids, target, weight)
    for k, v in net.p.items():
        for i in rng.integers(0, v.size, 6):
            old = v.flat[i]
            v.flat[i] = old + 1e-5
            up = loss()
            v.flat[i] = old - 1e-5
            down = loss()
            v.flat[i] = old
            assert abs((up - down) / 2e-5 - g[k].flat[i]) < 1e-4, k


def test_empty(spark, empty_dir):
    assert decontamination.op1_decontamination(spark, empty_dir).count() == 0
    assert quality_classifier.op3_quality_classifier(spark, empty_dir).count() == 0
    assert url_filter.op4_url_filter(spark, empty_dir).count() == 0
    assert lm_scoring.op6_lm_scoring(spark, empty_dir).count() == 0


def test_copies_of_many_tasks_are_averaged(spark, rows, monkeypatch):
    """Adding up in between changes nothing but rounding."""
    model = lm_scoring.subword.load(lm_scoring.subword.tokenizer_path())
    coded = [(bytearray(np.array([*model.library.encode(r[1] or "", add_special_tokens=False).ids, model.size], "<i4").tobytes()), 0) for r in rows[:60]]
    docs = spark.createDataFrame(coded, "ids binary, part int").repartition(5).cache()
    args = docs, lm_scoring.Vocabulary(np.ones(model.size + 1)), lm_scoring.prior_logits(np.zeros((lm_scoring.INPUTS + 2, lm_scoring.CLASSES))), 1
    plain = lm_scoring.train(*args).p
    monkeypatch.setattr(lm_scoring, "MODELS", 1)
    summed = lm_scoring.train(*args).p
    fresh = lm_scoring.Attention().p
    assert all(np.allclose(plain[k], summed[k], atol=1e-6) for k in plain) and not np.allclose(plain["out"], fresh["out"])


def test_gradient_of_drawn_classes():
    """Of the softmax over drawn classes, each standing for `share` of them, and the target."""
    rng = np.random.default_rng(3)
    net = lm_scoring.Attention(inputs=7, width=3, classes=9, window=6)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    net.prior = rng.standard_normal((7, 9))
    ids, target, weight = rng.integers(0, 7, (2, 6)), rng.integers(0, 9, (2, 6)), rng.random((2, 6)) < 0.8
    drawn, share = np.array([0, 8, 3, 5]), np.array([1, 1, 3.5, 3.5])

    def loss():
        z, _ = net.forward(ids)
        t = np.take_along_axis(z, target[..., None], 2)[..., 0]
        rest = (np.exp(z[..., drawn]) * share * (drawn != target[..., None])).sum(-1)
        return -((t - np.log(np.exp(t) + rest)) * weight).sum() / weight.sum()

    g = net.gradient(ids, target, weight, drawn, share)
    for k, v in net.p.items():
        for i in rng.integers(0, v.size, 6):
            old = v.flat[i]
            v.flat[i] = old + 1e-5
            up = loss()
            v.flat[i] = old - 1e-5
            down = loss()
            v.flat[i] = old
            assert abs((up - down) / 2e-5 - g[k].flat[i]) < 1e-4, k


def test_groups_share_one_softmax_over_all_classes(monkeypatch):
    """Probabilities of grouped classes sum to one, start as the prior's, and the gradient is that of their logs."""
    rng = np.random.default_rng(3)
    prior = rng.standard_normal((7, 9)) * 3
    net = lm_scoring.Grouped(inputs=7, width=3, classes=9, window=6, prior=prior, groups=4)
    assert sorted(np.concatenate(net.members).tolist()) == list(range(9)) and len(net.members) == 4
    flat = lm_scoring.Attention(inputs=7, width=3, classes=9, window=6, prior=prior)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    ids, target, weight = rng.integers(0, 7, (2, 6)), rng.integers(0, 9, (2, 6)), rng.random((2, 6)) < 0.8
    h = np.zeros((2, 6, 3))
    assert np.allclose(net.logs(h, ids), flat.logs(h, ids))
    net.p |= {k: rng.standard_normal(net.p[k].shape) for k in ("top", "top_bias", "bias")}
    z, _ = net.forward(ids)
    assert np.allclose(np.exp(z).sum(-1), 1)
    assert np.allclose(net.ready().target_logs(ids, target), np.take_along_axis(z, target[..., None], 2)[..., 0])

    def loss():
        return -(np.take_along_axis(net.forward(ids)[0], target[..., None], 2)[..., 0] * weight).sum() / weight.sum()

    g = net.gradient(ids, target, weight)
    assert set(g) == set(net.NAMES)
    for k, v in net.p.items():
        for i in rng.integers(0, v.size, 8):
            old, ends = v.flat[i], []
            for step in (1e-5, -1e-5):
                v.flat[i] = old + step
                ends.append(loss())
            v.flat[i] = old
            assert abs((ends[0] - ends[1]) / 2e-5 - g[k].flat[i]) < 1e-4, k


def test_texts_are_lowered_run_by_run(monkeypatch):
    """A batch is not copied whole; nulls and empty texts stay in their places."""
    monkeypatch.setattr(lm_scoring, "BLOCK", 100)
    texts = pa.array([None, "", *[f"A{i} b C " * 10 for i in range(20)], None])
    parts = list(lm_scoring._lower(texts))
    assert pa.chunked_array(parts).to_pylist() == [(t or "").lower() for t in texts.to_pylist()]
    assert max(p.nbytes for p in parts) < 400
    assert sum(len(at) - 1 for _, _, at in lm_scoring._words(texts)) == len(texts)


def test_scores_are_given_out_run_by_run(spark, monkeypatch):
    """A task holds the scores of one run of texts or ids, not of a whole batch, and gives back what it has freed at its end."""
    given, out = [], {}
    monkeypatch.setattr(lm_scoring, "give_back", lambda: given.append(1))
    monkeypatch.setattr(lm_scoring, "SCORED", 400)
    monkeypatch.setattr(lm_scoring, "BLOCK", 400)

    class Docs:
        sparkSession = spark
        schema = {"key": T.StructField("key", T.LongType())}

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            out["run"] = run
            raise StopIteration

    texts = [f"text {i} of {i * i}" * 5 for i in range(40)]
    sub = lm_scoring.subword.load(lm_scoring.subword.tokenizer_path())
    ids = [np.array([*sub.library.encode(t, add_special_tokens=False).ids, sub.size], "<i4") for t in texts]
    k, c = pa.array(range(40), pa.int64()), pa.array([0] * 40, pa.int32())
    vocabulary, model = lm_scoring.Vocabulary(np.ones(sub.size + 1)), lm_scoring.Grouped(prior=lm_scoring.prior_logits(np.zeros((lm_scoring.INPUTS + 2, lm_scoring.CLASSES))))
    with pytest.raises(StopIteration):
        lm_scoring.model_scores(Docs(), vocabulary, model, None)
    got = list(out["run"](iter([pa.RecordBatch.from_arrays([k, c, pa.array([x.tobytes() for x in ids])], names=["k", "c", "ids"])])))
    assert len(got) > 5 and [x for b in got for x in b.column(0).to_pylist()] == list(range(40)) and len(given) == 1
    words = spark.createDataFrame([(int(h), 2) for h in lm_scoring._hashes(pa.array(["text", "of"]))], "h long, c long")
    with pytest.raises(StopIteration):
        lm_scoring.base_scores(Docs(), words)
    got = list(out["run"](iter([pa.RecordBatch.from_arrays([k, c, k, pa.array(texts)], names=["k", "c", "key", "text"])])))
    assert len(got) > 5 and [x for b in got for x in b.column(2).to_pylist()] == list(range(40)) and len(given) == 2
    assert [x for b in got for x in b.column(3).to_pylist()] == [len(t.split()) + 1 for t in texts]


def test_documents_reach_tasks_in_small_batches(spark, monkeypatch):
    """Ids come to the fitting and scoring tasks in batches of ROWS documents at most; the session's own setting is back afterwards."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, seen, rows = spark.conf.get(name), [], lm_scoring.model_scores
    count = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"]) for b in batches)
    monkeypatch.setattr(lm_scoring, "ROWS", 7)
    monkeypatch.setattr(lm_scoring, "model_scores", lambda ids, *args: seen.extend(r.n for r in ids.coalesce(1).mapInArrow(count, "n long").collect()) or rows(ids, *args))
    assert lm_scoring.score(spark.createDataFrame([(i, f"text {i}") for i in range(40)], "doc_id long, text string")).count() == 40
    assert sum(seen) == 40 and max(seen) <= 7 and spark.conf.get(name) == before


def test_counts_leave_a_task_in_small_batches(monkeypatch):
    monkeypatch.setattr(lm_scoring, "SENT", 16)

    class Docs:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            return run

    texts = [f"word{i} other{i % 7}" for i in range(50)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(50), pa.int64()), pa.array([0] * 50, pa.int32()), pa.array([True] * 50), pa.array(texts)], names=["k", "c", "train", "text"])
    got = [b for b in lm_scoring.encoded(Docs(), lm_scoring.subword.tokenizer_path())(iter([batch])) if b.column(0)[0].as_py() != "doc"]
    assert max(b.num_rows for b in got) == 16
    words = {k: n for b in got if b.column(0)[0].as_py() == "word" for k, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist())}
    want = Counter(w for t in texts for w in t.split())
    assert words == {lm_scoring.END_WORD: 50} | {int(h): want[w] for w, h in zip(want, lm_scoring._hashes(pa.array(list(want))))}
