import random

import corpus_pipeline
from corpusloom.llm import subword

from .conftest import SCHEMA, prose
from .test_models import brute_leaks
from .test_rows_ops import WORD, brute_components
from .test_suffix_and_packing import check_packed


def brute(rows, items, keeps):
    rows = [r for r in rows if keeps[r[0]]]
    roots = {c for _, _, c in brute_components(rows)}
    rows = [r for r in rows if r[0] in roots]
    count = {}
    for r in rows:
        b = r[1].encode()
        for i in range(len(b) - 199):
            count[b[i : i + 200]] = count.get(b[i : i + 200], 0) + 1
    cut = []
    for r in rows:
        b, gone = r[1].encode(), [False] * len(r[1].encode())
        for i in range(len(b) - 199):
            if count[b[i : i + 200]] > 1:
                gone[i : i + 200] = [True] * 200
        left, i = b"", 0
        while i < len(b):
            j = i
            while j < len(b) and gone[j] == gone[i]:
                j += 1
            if not gone[i] or j - i < 400 and len(b[i:j].split()) < 51:
                left += b[i:j]
            i = j
        cut.append((r[0], left.decode()))
    cut = [r for r in cut if WORD.search(r[1])]
    bad = {d for d, _ in brute_leaks(cut, items)}
    return [r for r in cut if r[0] not in bad]


def test_pipeline_against_brute_force(spark, tmp_path):
    rng = random.Random(12)
    passage, item = prose(rng, 90), prose(rng, 30)
    rows = [(i, " the ".join([prose(rng, 30), *[passage] * (i % 5 == 0), *[item] * (i % 7 == 3), prose(rng, 60)]), "en", "s", 1) for i in range(40)]
    rows += [(100 + i, rows[i][1], "en", "s", 1) for i in range(5)] + [(200 + i, rows[i][1] + " more", "en", "s", 1) for i in range(6, 12)] + [(300, "### " * 90, "en", "s", 1), (301, None, None, None, None)]
    items = [(0, item), (1, prose(rng, 25))]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    keeps = {r[0]: False for r in rows} | {r.doc_id: True for r in corpus_pipeline.STAGES[0][1](spark, docs, str(tmp_path)).collect()}
    assert not keeps[300] and not keeps[301] and sum(keeps.values()) > 40
    want = brute(rows, items, keeps)
    model = subword.load(subword.tokenizer_path()).library
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.length) for r in out) == sorted((d, len(model.encode(t, add_special_tokens=False).ids) + 1) for d, t in want)
    assert 5 < len(want) < len(rows) - 10
    check_packed(out, 4096)


def test_passages_of_over_50_words_are_cut(spark, tmp_path):
    """Passages of 51 to 70 words that several documents share go; shorter ones and texts of their own stay."""
    rng = random.Random(21)
    passages = [prose(rng, n) for n in (51, 55, 60, 70)]
    short = prose(rng, 45)
    own = [[prose(rng, 40), prose(rng, 40)] for _ in range(24)]
    rows = [(i, f"{a} | {passages[i % 4]} | {b}", "en", "s", 1) for i, (a, b) in enumerate(own[:16])] + [(i, f"{own[i][0]} | {short} | {own[i][1]}", "en", "s", 1) for i in range(16, 24)]
    out = {r.doc_id: r.text for r in corpus_pipeline.STAGES[2][1](spark, spark.createDataFrame(rows, SCHEMA), str(tmp_path)).collect()}
    for i, (a, b) in enumerate(own):
        if i < 16:
            # characters beside the passage that agree by chance go with it
            assert a[:-9] in out[i] and b[9:] in out[i] and len(out[i]) <= len(a) + len(b) + 6
        else:
            assert out[i] == rows[i][1]


CLASHES = ["k", "c", "spans", "removed_spans", "H", "d", "h_", "fp", "root", "component_id", "salt", "rank", "before", "by_word", "by_line", "once", "kept", "n_words", "row", "key", "host", "judged", "_k", "_w", "_l", "_h"]


def test_stages_take_clashing_columns(spark, sf_dir, empty_dir):
    """Extra columns pass through the stages, whatever their names."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    wide = docs.withColumns({c: docs["doc_id"] * (i + 2) for i, c in enumerate(CLASHES)})
    for _, stage in corpus_pipeline.STAGES[:4]:
        plain, out = stage(spark, docs, empty_dir), stage(spark, wide, empty_dir)
        assert out.columns == wide.columns
        got = out.collect()
        assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted(((r.doc_id, r.text) for r in plain.collect()), key=repr)
        for r in got:
            assert all(r[c] == (None if r.doc_id is None else r.doc_id * (i + 2)) for i, c in enumerate(CLASHES))


def test_stages_keep_the_columns(spark, sf_dir, rows):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes


def test_empty(spark, empty_dir):
    assert corpus_pipeline.run(spark, empty_dir).count() == 0
