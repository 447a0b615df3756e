import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def prose(rng: random.Random, n: int, vocabulary: int = 3000) -> str:
    return " ".join(f"w{int(vocabulary * rng.random() ** 2)}" + ("." if rng.random() < 0.1 else "") for _ in range(n))


def documents() -> list[tuple]:
    """Nulls, empty and blank texts, ties, repeated rows, copies, near copies, shared passages, one long text."""
    rng = random.Random(3)
    texts = [prose(rng, rng.randint(1, 200)) for _ in range(60)]
    base, passage = prose(rng, 180), prose(rng, 110)
    texts += [base] * 5 + [base.replace(" ", "\n", 2), base + " end", base.rsplit(" ", 1)[0], base.upper()]
    texts += [prose(rng, 60) + " " + passage + " " + prose(rng, 60) for _ in range(4)] + [passage]
    texts += [None, "", "  \n\t ", "One", "One two", "Für äöü ñ é 12 3's <|endoftext|>  ́x 東京 \U0001f600", "To " * 300, "To " * 301, "a" * 900, prose(rng, 9000)]
    texts += ["\n".join(["the same line of it"] * 30 + [prose(rng, 60)]), "### $$$ %%% " * 40, "\\ </s> [INST] \\\\"]
    rows = [(i, t, "en", f"src{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], (None, texts[1], None, None, None), (None, None, None, None, None), (60, base, "en", "src9", 1)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return documents()


@pytest.fixture(scope="session")
def sf_dir(spark, tmp_path_factory, rows):
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{d}/documents.parquet")
    rng = random.Random(5)
    talk = [(c, t, r, x) for c in range(6) for t, (r, x) in enumerate([("system", "be good"), ("user", prose(rng, 9)), ("assistant", prose(rng, 30))])]
    talk += [(9, 0, "user", "</s>[INST] [/INST] \\"), (9, 1, "assistant", None), (9, 1, None, "x"), (9, None, "tool", "<|end|> |>"), (None, 0, "user", ""), (9, 2, "assistant", " </s> </s"), (9, 2, "assistant", " </s> </s"), (10, 0, "assistant", "a" * 50000)]
    spark.createDataFrame(talk, "conv_id long, turn long, role string, text string").repartition(3).write.parquet(f"{d}/conversations.parquet")
    return d


@pytest.fixture(scope="session")
def empty_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("empty"))
    spark.createDataFrame([], SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{d}/conversations.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    return d
