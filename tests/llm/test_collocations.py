import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import collocations
from corpusloom.llm.collocations import keys_of, pack, radix_order, sort_and_count, width_of


def brute(rows, longest=3, least=10, inside=50, top=2000):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", t):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for m in range(1, longest + 1):
                f[lang or "und"].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        longer = Counter()
        for p, a in found.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    longer[p[i : i + m]] = max(longer[p[i : i + m]], a)
        best = []
        for p, a in found.items():
            score, k = min((1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            if not longer[p] or 100 * longer[p] < inside * a:
                best.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, r, p.decode(), -a, x, y, n[lang], -s) for r, (s, a, p, x, y) in enumerate(sorted(best)[:top], 1)]
    return sorted(out)


def texts():
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(30)] + ["The", "of", "é\x01", "é", "東京", "a-b"]
    rows = [(" ".join(rng.choice(vocabulary[rng.randrange(len(vocabulary)) :]) + rng.choice(["", "", "", ".", "\n", "\t x"]) for _ in range(rng.randint(0, 90))), rng.choice(["en", "de", None])) for _ in range(200)]
    return rows + [(None, "en"), ("", "xx"), (None, None), (" \t ", "fr"), rows[0], rows[0], ("new york city " * 4000, "en"), ("of the " * 15, "fr"), ("x" * 40000 + " y " + "x" * 40000, "fr"), ("é\x01 b. é b. " * 12, "it")]


def test_query_against_brute_force(spark, tmp_path):
    rows = texts()
    df = spark.createDataFrame([(i, *r, "k", 3) for i, r in enumerate(rows)], "doc_id long, text string, lang string, key string, n int").repartition(5)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in collocations.op13_collocations(spark, str(tmp_path)).collect())
    assert got == brute(rows) and len(got) > 100


def test_small_blocks_ranges_and_reports(spark, monkeypatch):
    rows = texts()[:120] + texts()[200:]
    df = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    for name, x in (("BLOCK", 500), ("RANGE", 20), ("BUCKETS", 3)):
        monkeypatch.setattr(collocations, name, x)
    for options in ({}, {"top": 7, "least": 4}, {"longest": 2}, {"longest": 5, "inside": 80, "least": 6}):
        assert sorted(tuple(r) for r in collocations.collocations(df, **options).collect()) == brute(rows, **options), options


def test_ranges_of_repeated_texts_stay_small(spark, monkeypatch):
    """All blocks hold the same keys: a sample that draws a key in all blocks or in none left a few ranges with all runs."""
    rows = [(" ".join(f"w{i}" for i in range(60)), "en")] * 300
    for name, x in (("BLOCK", 100), ("RANGE", 200)):
        monkeypatch.setattr(collocations, name, x)
    real, sizes = collocations.counted, []

    def spy(found, *options):
        sizes.extend(r.n for r in found.groupBy("range").agg(F.sum(F.size("counts")).alias("n")).collect())
        return real(found, *options)

    monkeypatch.setattr(collocations, "counted", spy)
    got = collocations.collocations(spark.createDataFrame(rows, "text string, lang string").repartition(3))
    assert sorted(tuple(r) for r in got.collect()) == brute(rows) and sum(sizes) == 300 * 59 and max(sizes) < 1500


def test_batches_and_row_groups_are_bounded(spark, monkeypatch):
    """A task's whole partition went to its worker as one batch, and all blocks of a task were one row group."""
    rows = [(" ".join(f"w{(i * 7 + j * j) % 90}" for j in range(60)), "en") for i in range(200)]
    for name, x in (("BLOCK", 100), ("RANGE", 200), ("SENT", 3000)):
        monkeypatch.setattr(collocations, name, x, raising=False)
    real, sent, groups = collocations.counted, [], []

    def spy(found, *options):
        def sizes(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([b.nbytes], pa.int64()), pa.array([b.num_rows], pa.int64())], names=["n", "rows"])

        x = found.repartition(2, "range").mapInArrow(sizes, "n long, rows long").collect()
        sent.extend((r.n, r.rows) for r in x)
        return real(found, *options)

    def written(df, real=collocations.materialize, **options):
        out = real(df, **options)
        if {"codes", "ids"} & set(out.columns):
            groups.extend(m.row_group(i).num_rows for f in out.inputFiles() for m in [pq.ParquetFile(f.removeprefix("file://")).metadata] for i in range(m.num_row_groups))
        return out

    monkeypatch.setattr(collocations, "counted", spy)
    monkeypatch.setattr(collocations, "materialize", written)
    got = collocations.collocations(spark.createDataFrame(rows, "text string, lang string").repartition(2))
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)
    assert len(sent) > 10 and max(n for n, k in sent if k > 1) < 9000 and len(groups) > 50 and max(groups) <= collocations.GROUP


def test_empty_tables_and_texts(spark, empty_dir):
    df = collocations.op13_collocations(spark, empty_dir)
    assert df.count() == 0 and df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and {t for c, t in df.dtypes if c not in ("lang", "phrase")} == {"bigint"}
    assert collocations.collocations(spark.createDataFrame([(None, "en"), ("", None)], "text string, lang string")).count() == 0


def test_scores_of_large_counts_are_exact(spark):
    big = 10**13
    words = spark.createDataFrame([("en", "a", 3 * big + 1, 1), ("en", "b", 2 * big, 2)], "lang string, word string, f long, id long").withColumn("key", F.unhex(F.lpad(F.hex("id"), 4, "0")))
    phrases = spark.createDataFrame([(bytes([0, 1, 0, 2]), big + 7)], "key binary, f long")
    r = collocations.scored(phrases, words, 2).first()
    assert r.score == 1_000_000 * (big + 7) ** 2 // ((3 * big + 1) * 2 * big) and (r.a, r.l, r.r) == (big + 7, 3 * big + 1, 2 * big)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**31 - 1) | st.integers(0, 3), min_size=3, max_size=3), max_size=30), st.sampled_from([4, 6, 8]))
def test_radix_sort_counts_runs(rows, width):
    ids = np.array(rows, np.int64).reshape(-1, 3)
    keys, counts = sort_and_count(pack(ids, width), np.ones(len(ids), np.int64))
    want = sorted(Counter(map(tuple, rows)).items())
    assert counts.tolist() == [n for _, n in want] and [x.tobytes() for x in keys] == [b"".join(i.to_bytes(width, "big") for i in k) for k, _ in want]
    assert sorted(radix_order(pack(ids, width)).tolist()) == list(range(len(ids)))


def test_keys_stop_at_breaks():
    ids = np.array([1, 2, 3, 0, 4, 0, 5, 6])
    want = [(1, 2, 3), (2, 3, 0), (5, 6, 0)]
    assert [x.tobytes() for x in keys_of(ids, 3, 2)] == [b"".join(i.to_bytes(2, "big") for i in k) for k in want]
    assert [width_of(x) for x in (0, 1, 65535, 65536, 2**32)] == [2, 2, 2, 4, 6]
