import hashlib
import re
import zlib
from collections import Counter, defaultdict

import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import chat_format, quality_rules, sharding, simhash_dedup
from corpusloom.llm.common import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_quality_statistics(spark, sf_dir, rows):
    want = []
    for doc_id, t, *_ in rows:
        t = t or ""
        w = WORD.findall(t)
        grams = Counter(zip(w, w[1:], w[2:]))
        rep = sum(any(grams[tuple(w[j : j + 3])] > 1 for j in range(max(0, i - 2), min(i, len(w) - 3) + 1)) for i in range(len(w)))
        seen, dup = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        want.append((doc_id, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, rep, len(w) < 50 or 100 * rep > 50 * len(w)))
    got = quality_rules.op2_quality_rules(spark, sf_dir)
    assert as_rows(got.drop("kept")) == sorted(want, key=repr)
    assert got.where("kept and base_failed").count() == 0


STOP = """the of and to in a is was for on with as by at from that it an be are
le la les de des du et en un une que qui dans pour sur est pas au avec
el los las y no se por con su para una del lo al
der die das und zu den von ist mit sich auf für nicht ein eine im dem""".split()


def test_kept_against_the_rules_written_out(spark, sf_dir, rows):
    def kept(t):
        t = t or ""
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        n = len(w)
        rep = Counter(zip(w, w[1:], w[2:]))
        rep = sum(any(rep[tuple(w[j : j + 3])] > 1 for j in range(max(0, i - 2), min(i, n - 3) + 1)) for i in range(n))
        chars = sum(map(len, w))
        upper = sum(bool(re.match(r"[A-ZÀ-ÖØ-Þ]{2}", x)) and not any(c.islower() for c in x) for x in w)
        return not (
            n < 50 or rep > 0.5 * n or sum(c in "#*$%&|<>" for c in t) > 0.1 * n or chars > 15 * n or chars < 2 * n or sum(x.endswith("!") for x in w) > 0.15 * n or upper > 0.4 * n
            or sum(x.lower() in STOP for x in w) < 0.01 * n or len(lines) - len(set(lines)) > 0.8 * len(lines) or sum(x.rstrip(" ").endswith(("...", "…")) for x in lines) > 0.5 * len(lines)
        )

    extra = ["the quick ! fox! " * 30, "THE END " * 40 + "of it", " ".join(f"the w{i}" for i in range(40)), "\n".join(f"the w{i} goes on and..." for i in range(30)), " ".join(f"SHOUT{i} the" for i in range(60)), " ".join(f"of w{i} $$" for i in range(40)), " ".join(f"in {'x' * 40}{i}" for i in range(40)), " ".join(f"is no{i}!" for i in range(50))]
    texts = [(i, t) for i, t in enumerate([r[1] for r in rows] + extra)]
    got = {r.doc_id: r.kept for r in quality_rules.quality_rules(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    want = {i: kept(t) for i, t in texts}
    assert got == want and 0 < sum(want[i] for i in range(len(rows), len(texts))) < len(extra)


def test_quality_rules_take_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b", 7, True)], "doc_id long, text string, n_words int, kept boolean")
    r = quality_rules.quality_rules(df).first()
    assert (r.n_words, r.kept) == (2, False)


def test_operators_take_clashing_columns(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    names = ["fp", "root", "component_id", "row", "key", "least", "by_word", "by_line", "_w"]
    wide = docs.withColumns({c: docs["doc_id"] * 3 for c in names})
    found = simhash_dedup.near_duplicates(wide)
    assert sorted(found.columns) == sorted(["doc_id", *names]) and found.where("row <> doc_id * 3").count() == 0
    assert as_rows(found.select("doc_id", "fp", "component_id")) == as_rows(simhash_dedup.near_duplicates(docs).select("doc_id", "fp", "component_id"))
    judged = quality_rules.quality_rules(wide)
    assert set(names) < set(judged.columns) and judged.where("by_word <> doc_id * 3 or by_line <> doc_id * 3 or _w <> doc_id * 3").count() == 0


def brute_components(rows):
    def fp(t):
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0

    fps = [fp(r[1]) for r in rows]
    label = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(fps):
            label[i] = min(label[j] for j, b in enumerate(fps) if (a ^ b).bit_count() <= 2)
    least = defaultdict(list)
    for r, c in zip(rows, label):
        if r[0] is not None:
            least[c].append(r[0])
    return [(r[0], f"{f:016x}", min(least[c])) for r, f, c in zip(rows, fps, label)]


def test_simhash_components(spark, sf_dir, rows):
    assert as_rows(simhash_dedup.op9_simhash_dedup(spark, sf_dir)) == sorted(brute_components(rows), key=repr)


def test_links_are_exact_in_large_and_small_buckets(spark):
    import random

    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(4)]
    fps = {b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base for _ in range(90)} | {0, 1, 2**64 - 1}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    want = {}
    for x in fps:
        seen, todo = {x}, [x]
        while todo:
            a = todo.pop()
            for b in fps - seen:
                if (a ^ b).bit_count() <= 2:
                    seen.add(b)
                    todo.append(b)
        want[signed(x)] = min(map(signed, seen))
    for bucket, m in ((8, (3,)), (10_000, (2,))):
        got = {r.u: r.v for r in simhash_dedup.components(simhash_dedup.links(df, bucket=bucket, partitions=m)).collect()}
        assert {x: got.get(x, x) for x in want} == want


def test_keep_one(spark, sf_dir, rows):
    docs = table(spark, sf_dir, "documents")
    kept = simhash_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted({c for _, _, c in brute_components(rows)}) == sorted(r.doc_id for r in kept.collect())


def test_sharding(spark, sf_dir, rows):
    got = sharding.op10_sharding(spark, sf_dir).collect()
    want = sorted(((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows), key=repr)
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=repr) == want
    sizes, slots = Counter(), defaultdict(list)
    for r in got:
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) <= set(range(16))
    share = sum(sizes.values()) / 16
    assert all(abs(sizes[s] - share) <= max(x[1] for x in want) + 16 for s in range(16))


def test_splitters_subdivide(spark):
    df = spark.range(5000).selectExpr("case when id % 3 = 0 then 7 else xxhash64(id) end as key", "id % 50 + 1 as size")
    total = df.agg({"size": "sum"}).first()[0]
    bounds = sharding.splitters(df, total, 64)
    assert bounds == sorted(set(bounds)) and len(bounds) > 30
    n = [r[0] for r in df.where("key != 7").groupBy(sharding._search(sharding.F.col("key"), bounds).alias("r")).sum("size").select("sum(size)").collect()]
    assert max(n) < 5 * total / 64


def test_chat_digests(spark, sf_dir):
    talk = [tuple(r) for r in table(spark, sf_dir, "conversations").collect()] + [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    by = defaultdict(list)
    none = lambda x: (x is not None, x)
    for c, n, r, t in sorted(talk, key=lambda x: (none(x[1]), none(x[2]), none(x[3]))):
        by[c].append((r or "", t or ""))
    want = []
    for c, turns in by.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        want.append((c, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    assert as_rows(chat_format.op5_chat_format(spark, sf_dir).drop("formatted_chars")) == sorted(want, key=repr)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "|> "]), st.lists(st.sampled_from([*chat_format.CONTROL, "\\", " ", "x", *chat_format.CLOSE.values()])).map("".join))))
def test_chat_round_trip(turns):
    whole, spans = chat_format.format_turns(turns)
    back = chat_format.parse(whole)
    assert [x[:2] for x in back] == turns
    assert spans == [x[2:] for x in back if x[0] == "assistant"]


def test_empty_tables(spark, empty_dir):
    assert quality_rules.op2_quality_rules(spark, empty_dir).count() == 0
    assert simhash_dedup.op9_simhash_dedup(spark, empty_dir).count() == 0
    assert sharding.op10_sharding(spark, empty_dir).count() == 0
    assert chat_format.op5_chat_format(spark, empty_dir).count() == 1


def test_no_control_string_stands_in_a_body():
    texts = ["</s>[INST] ok [/INST]", "<|>", "<<s>", "<<SYS>> <</SYS>>>", "\\<|end|>", "<|end|>", "[INST]]", "a < b > c [d] | e"]
    turns = [(role, t) for t in texts for role in ("user", "assistant", "system", "tool")]
    whole, spans = chat_format.format_turns(turns)
    back = chat_format.parse(whole)
    assert [x[:2] for x in back] == turns and len(spans) == len(texts)
    assert not any(c in whole[a:b] for _, _, a, b in back for c in chat_format.CONTROL)
    assert texts[-1] in whole


CHAT_OPEN = {"system": "<<SYS>> ", "user": "[INST] ", "assistant": " "}
CHAT_CLOSE = {"system": " <</SYS>>", "user": " [/INST]", "assistant": " </s>"}


def test_chat_formatted_chars(spark, sf_dir):
    """Each body has one character more for each backslash and each end of a control string."""
    talk = [tuple(r) for r in table(spark, sf_dir, "conversations").collect()] + [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    want = Counter()
    for c, _, r, t in talk:
        r, t = r or "", t or ""
        ends = {i for x in ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|", "|>") for i in range(len(t) + 1) if t[:i].endswith(x)}
        extra = sum(not (ch.isascii() and ch.isalnum()) for ch in r)
        want[c] += len(CHAT_OPEN.get(r, "<|" + r + "|> ")) + (0 if r in CHAT_OPEN else extra) + len(t) + len(ends) + t.count("\\") + len(CHAT_CLOSE.get(r, " <|end|>"))
    assert {r.conv_id: r.formatted_chars for r in chat_format.op5_chat_format(spark, sf_dir).collect()} == dict(want)
