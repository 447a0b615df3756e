"""Whole queries of op3 and op4 against walks and fits written out, and operators on tables with clashing columns."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from corpusloom.llm import decontamination, license_scan, lm_scoring, quality_classifier, sharding, url_filter

LINK = re.compile(url_filter._LINK)


def pages():
    rng = random.Random(9)
    hosts = ["com", "example.com", "a.example.com", "b.a.example.com", "net", "example.net", "x.net", "org", "blog.org", "far.away.org", "one.io", "two.io", "three.io", "y.two.io", "lone.dev"]
    paths = ["/en/1", "/en/7", "/de/8", "/de/1", "/es/2", "/", "", "/x?en", "/en/71#a"]
    rows = []
    for i in range(140):
        links = "".join(f'<a href="https://{rng.choice(hosts).upper() if rng.random() < 0.2 else rng.choice(hosts)}/p{i}">x</a>' for _ in range(rng.randint(0, 3)))
        rows.append((i, f"https://{rng.choice(hosts)}{rng.choice(paths)}", f"<p>{links}</p>"))
    return rows + [(200, None, None), (201, "no scheme", "<a href='https://one.io/'>"), (202, "https://fresh.site/", None), (3, *rows[3][1:])]


def walked(rows):
    """Verdicts by the solved linear systems over host edges and seeds."""
    parsed, judged = {}, []
    for page, url, html in rows:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = [(len(r), v) for v, r in url_filter.RULES if host and ("." + host).endswith("." + r.partition("/")[0]) and path.startswith("/" + r.partition("/")[2])]
        judged.append((page, host, max(fits)[1] if fits else None, html or ""))
    edges, names = Counter(), {h for _, h, _, _ in judged if h}
    for _, host, _, html in judged:
        for other in LINK.findall(html) if host else ():
            other = "".join(c.lower() if "A" <= c <= "Z" else c for c in other)
            names.add(other)
            if other != host:
                edges[host, other] += 1.0
    for h in sorted(names):
        labels = h.split(".")
        for i in range(len(labels) - 2):
            edges[".".join(labels[i:]), ".".join(labels[i + 1 :])] = edges.get((".".join(labels[i:]), ".".join(labels[i + 1 :])), 0)
            parsed[".".join(labels[i:]), ".".join(labels[i + 1 :])] = 1
    for a, b in parsed:
        edges[a, b] += 1
        edges[b, a] += 1
    names = sorted(names | {x for e in edges for x in e})
    at = {h: i for i, h in enumerate(names)}
    scores = []
    for verdict, flip in (("allow", False), ("block", True)):
        m, start = np.zeros((len(names),) * 2), np.zeros(len(names))
        for (a, b), w in edges.items():
            a, b = (b, a) if flip else (a, b)
            m[at[b], at[a]] += w
        m /= np.maximum(m.sum(0), 1e-300)
        for _, host, v, _ in judged:
            if host and v == verdict:
                start[at[host]] += 1
        start /= max(1, start.sum())
        scores.append(np.linalg.solve(np.eye(len(names)) - url_filter.DAMPING * m, (1 - url_filter.DAMPING) * start))
    trust, distrust = scores
    bad = {h: distrust[i] >= url_filter.RATIO * trust[i] and distrust[i] > 1 / len(names) for h, i in at.items()}
    return sorted(((p, v or ("block" if h and bad[h] else "allow")) for p, h, v, _ in judged), key=repr)


def test_verdicts_against_a_walk(spark, tmp_path):
    rows = pages()
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(((r.page_id, r.verdict) for r in url_filter.op4_url_filter(spark, str(tmp_path)).collect()), key=repr)
    want = walked(rows)
    assert got == want and {v for _, v in want} == {"allow", "block"}


def features(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(zip(w, w[1:], w[2:]))
    rep = sum(any(grams[tuple(w[j : j + 3])] > 1 for j in range(max(0, i - 2), min(i, len(w) - 3) + 1)) for i in range(len(w)))
    from corpusloom.llm.quality_rules import STOP_WORDS

    upper = sum(bool(re.match(r"[A-ZÀ-ÖØ-Þ]{2}", x)) and not any(c.islower() for c in x) for x in w)
    n, m = max(1, len(w)), max(1, len(lines))
    counts = (sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), rep, sum(x.endswith("!") for x in w), upper, sum(x.lower() in STOP_WORDS for x in w))
    return (math.log1p(len(w)), *(x / n for x in counts), (len(lines) - len(set(lines))) / m, math.log1p(len(w) / m))


def test_classifier_against_its_parts(spark, tmp_path, rows):
    """Features, choice of labelled rows, fit and scores, each written out."""
    rng = random.Random(2)
    docs = [(r[0], r[1]) for r in rows] + [(1000 + i, " ".join(rng.choice(["the", "of", "WORD", "x!", "ok", "$$"][: 2 + 4 * (i % 2)]) for _ in range(rng.randint(5, 90)))) for i in range(160)]
    labels = [(d, int(features(t)[5] > 0.1), 0) for d, t in docs if d is not None and rng.random() < 0.9] + [(1001, 1, 0), (None, 1, 0), (1002, None, 0), (99999, 1, 1)]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 4 == 2
    y = {}
    for d, q, _ in labels:
        if d is not None and q is not None and not held(d):
            y[d] = max(q, y.get(d, 0))
    data = sorted((d, min((y[d], *features(t)) for e, t in docs if e == d)) for d in {d for d, _ in docs if d in y})
    table = np.array([r for _, r in data], float)
    intercept, rules = quality_classifier.fit_rules(table[:, 1:], table[:, 0])
    want = []
    for d, t in docs:
        x = np.array([features(t)])
        p = 1 / (1 + math.exp(-(intercept + sum(w * quality_classifier.holds(x, r)[0] for r, w in rules))))
        want.append((d, held(d), p))
    got = [(r.doc_id, r.held_out, r.score) for r in quality_classifier.op3_quality_classifier(spark, str(tmp_path)).collect()]
    by = lambda rows: sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    assert all(a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-9 for a, b in zip(by(got), by(want), strict=True)) and len(rules) > 0


CLASHES = ["k", "c", "key", "size", "shard", "slot", "rank", "start", "id", "host", "row", "judged", "x", "h", "f_words", "n_words", "score", "places", "n"]


def wide(df, key):
    return df.withColumns({c: df[key] * (i + 2) for i, c in enumerate(CLASHES)})


def same(a, b, *columns):
    rows = lambda df: sorted((tuple(r[c] for c in columns) for r in df.select(*columns).collect()), key=repr)
    return rows(a) == rows(b)


@pytest.fixture
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def test_sharding_takes_any_key_and_extra_columns(spark, docs):
    plain = sharding.shard(docs)
    assert same(sharding.shard(wide(docs, "doc_id")), plain, *plain.columns)
    for name in ("key", "size", "Text_CRC32", "slot", "r"):
        out = sharding.shard(docs.withColumnRenamed("doc_id", name), key=name)
        clash = name.lower() if name.lower() in ("size", "text_crc32", "slot") else None
        assert out.columns == [name, *(f"{c}_" if c == clash else c for c in ("size", "text_crc32", "shard", "slot"))]
        assert same(out.toDF(*plain.columns), plain, *plain.columns)
    assert sharding.shard(docs.limit(0).withColumnRenamed("doc_id", "size"), key="size").columns == ["size", "size_", "text_crc32", "shard", "slot"]


def test_other_operators_take_clashing_columns(spark, docs):
    items = spark.createDataFrame([(1, docs.where("doc_id = 3").first().text)], "item_id long, text string")
    few = docs.where("doc_id < 40")
    assert same(decontamination.decontaminate(wide(few, "doc_id"), items), decontamination.decontaminate(few, items), "doc_id", "text")
    assert same(license_scan.license_scan(wide(few, "doc_id")), license_scan.license_scan(few), "doc_id", "n_words", "score")
    names = list(quality_classifier.FEATURES)
    assert same(quality_classifier.with_features(wide(few, "doc_id"), "text"), quality_classifier.with_features(few, "text"), "doc_id", *names)
    p = spark.createDataFrame(pages(), "page_id long, url string, html string")
    judged = url_filter.judge_urls(wide(p, "page_id"))
    assert same(judged, url_filter.judge_urls(p), "page_id", "host", "path", "rule", "verdict") and judged.where("n <> page_id * 20").count() == 0
    a, b = (lm_scoring.score(x).select("doc_id", "n_tokens", "base_score").collect() for x in (wide(few, "doc_id"), few))
    assert sorted(map(tuple, a), key=repr) == sorted(map(tuple, b), key=repr)
