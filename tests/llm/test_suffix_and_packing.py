import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from corpusloom.llm import packing, substring_dedup, subword, suffix_array
from corpusloom.llm.common import table

from .test_rows_ops import as_rows


@pytest.mark.parametrize("symbols", [1, 2, 5, 200])
def test_suffix_array_and_lcp(symbols):
    rng = random.Random(symbols)
    for _ in range(60):
        t = [rng.randint(1, symbols) for _ in range(rng.randint(1, 120))] + [0]
        sa = suffix_array.suffix_array(np.array(t))
        assert sa.tolist() == sorted(range(len(t)), key=lambda i: t[i:])
        phi, plcp = suffix_array.permuted_lcp(np.array(t, np.uint8), sa)
        for i, j in enumerate(phi):
            if j >= 0:
                n = int(plcp[i])
                assert t[i : i + n] == t[j : j + n] and t[i + n : i + n + 1] != t[j + n : j + n + 1]


def brute_spans(texts, width):
    count = Counter(t[i : i + width] for t in texts for i in range(len(t) - width + 1))
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - width + 1):
            if count[t[i : i + width]] > 1:
                gone[i : i + width] = [True] * width
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone) if not g)).hexdigest()))
    return out


def test_removed_bytes(spark, sf_dir, rows):
    want = [(r[0], *x) for r, x in zip(rows, brute_spans([(r[1] or "").encode() for r in rows], 400))]
    got = substring_dedup.op7_suffix_array_dedup(spark, sf_dir)
    assert sum(w[2] > 0 for w in want) > 8
    assert as_rows(got) == sorted(want, key=repr)


def test_removed_bytes_at_another_length_and_small_shards(spark):
    rng = random.Random(9)
    words = ["ab", "abc", "é", "zz", "q"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(25)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    spans = substring_dedup.repeated_spans(df, "doc_id", "text", min_len=24, gram=6, run=7, shard_bytes=200)
    want = [(i, *x) for i, x in enumerate(brute_spans([t.encode() for t in texts], 24))]
    assert as_rows(substring_dedup.digests(df, spans)) == sorted(want, key=repr)


def test_hot_groups_are_cut_into_windows(spark):
    """A passage that many texts share in other surroundings; also exact copies and a text that repeats itself."""
    rng = random.Random(17)
    own = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    passage, long = own(30), own(60)
    texts = [own(40) + passage + own(40) for _ in range(40)] + [own(20) + long + own(20) for _ in range(30)] + [own(10) + passage + own(9)] * 5 + [passage * 3, "x" * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = sorted(((i, *x) for i, x in enumerate(brute_spans([t.encode() for t in texts], 24))), key=repr)
    for hot in (2, 10**6):
        spans = substring_dedup.repeated_spans(df, "doc_id", "text", min_len=24, gram=6, run=7, shard_bytes=200, hot=hot)
        assert as_rows(substring_dedup.digests(df, spans)) == want


def test_runs_of_one_byte_at_the_least_length(spark):
    rng = random.Random(4)
    texts = [c * n for c, n in zip("abc", (400, 401, 402))] + ["".join(rng.choices("qrstuvw", k=150)) + c * n + "".join(rng.choices("qrstuvw", k=150)) for c, n in zip("defghijkl", (400, 401, 402) * 3)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = [(i, *x) for i, x in enumerate(brute_spans([t.encode() for t in texts], 400))]
    assert [w[2] for w in want[:3]] == [0, 401, 402]
    assert as_rows(substring_dedup.digests(df, substring_dedup.repeated_spans(df, "doc_id", "text"))) == sorted(want, key=repr)


def test_cut_text_keeps_whole_characters(spark, sf_dir, rows):
    docs = table(spark, sf_dir, "documents")
    out = substring_dedup.dedup_substrings(docs)
    assert out.columns == [*docs.columns, "removed_spans"] and out.count() == len(rows)
    assert substring_dedup.whole_characters("aéb".encode(), [(0, 2)]) == [(0, 1)]
    assert substring_dedup.whole_characters("aéb".encode(), [(2, 4)]) == [(3, 4)]


def test_subword_ids_equal_the_library(rows):
    model = subword.load(subword.tokenizer_path())
    texts = [r[1] for r in rows] + ["It's 12 3's <|endoftext|> ÀÉß× ÷ x'll İ Σας ΑΣ 東京 é " + "z" * 50 + " " + "é" * 30, "ﬁ ½ a\x85b\x1cc"]
    got = [ids[a:b].tolist() for ids, at in model.texts(pa.array(texts), block=5000) for a, b in zip(at[:-1], at[1:])]
    assert got == [model.library.encode(t or "", add_special_tokens=False).ids for t in texts]


def check_packed(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for v in by.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing(spark, sf_dir, rows):
    model = subword.load(subword.tokenizer_path()).library
    want = []
    for r in rows:
        ids = [*model.encode(r[1] or "", add_special_tokens=False).ids, 1]
        want += [(r[0], p, s, len(ids[s : s + 4096]), zlib.crc32(np.array(ids[s : s + 4096], "<u4").tobytes())) for p, s in enumerate(range(0, len(ids), 4096))]
    out = packing.op8_best_fit_packing(spark, sf_dir)
    got = out.collect()
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    assert check_packed(got, 4096) <= -(-sum(w[3] for w in want) // 4096) + 1


def test_packing_takes_clashing_columns(spark, sf_dir):
    found = packing.pieces(table(spark, sf_dir, "documents"))
    names = ["salt", "rank", "before", "n", "sequence_id", "offset", "SALT_"]
    out = packing.pack(found.withColumns({c: found["length"] * (i + 2) for i, c in enumerate(names)}))
    assert sorted(out.columns) == sorted([*found.columns, *names])
    got = out.collect()
    assert len(got) == found.count() and all(r.salt == r.length * 2 and r["SALT_"] == r.length * 8 for r in got)
    check_packed(got, 4096)


def test_plan_fills_every_slot_once():
    rng = random.Random(2)
    for capacity in (5, 64):
        counts = {n: rng.randint(1, 40) for n in rng.sample(range(1, capacity + 1), capacity // 2)}
        slots = packing.plan(counts, capacity)
        for n, c in counts.items():
            assert sorted(r for length, rank, k, _, _ in slots if length == n for r in range(rank, rank + k)) == list(range(c))
        rows = [type("R", (), {"sequence_id": first + i, "offset": offset, "length": length}) for length, _, k, first, offset in slots for i in range(k)]
        assert check_packed(rows, capacity) <= 1.3 * sum(n * c for n, c in counts.items()) / capacity + 1


def test_empty(spark, empty_dir):
    assert packing.op8_best_fit_packing(spark, empty_dir).count() == 0
    assert substring_dedup.op7_suffix_array_dedup(spark, empty_dir).count() == 0


def test_waves_are_dealt_without_a_call_for_each_bucket(monkeypatch):
    """Also where the symbols need more than 16 bits."""
    rng = np.random.default_rng(8)
    texts = [np.append(rng.integers(1, size, 3000), 0) for size in (3, 200)]
    texts.append(np.append(np.where(rng.random(3000) < 0.9, 70_000, 5), 0))
    monkeypatch.setattr(np, "split", None)
    for t in texts:
        sa = suffix_array.suffix_array(t)
        x, ends = t.tolist(), sa.tolist()
        assert sorted(ends) == list(range(len(x))) and all(x[a:] < x[b:] for a, b in zip(ends, ends[1:]))  # noqa: B905
