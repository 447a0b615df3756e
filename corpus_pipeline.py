"""Corpus pipeline: each stage works on all that its predecessor kept, and its decisions take effect.

quality_rules drops rejected documents; simhash_dedup keeps the document of the smallest id of each group of near copies;
suffix_array_dedup cuts what is covered by strings of 200 bytes that stand elsewhere too, where that makes a stretch of over
50 words or of 400 bytes (characters stay whole), and drops documents without a word left; 51 words have 200 bytes if they
average 3 letters; decontamination drops documents that hold a benchmark item; best_fit_packing packs what is left.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom import share_code
from corpusloom.llm import common, decontamination, packing, quality_rules, simhash_dedup, substring_dedup

#: Repeated passages that are cut: of so many words, found as strings of so many bytes.
PASSAGE_WORDS, PASSAGE_BYTES = 51, 200


def _stage(run):
    @wraps(run)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        share_code(spark)
        return run(spark, docs, sf_dir)

    return stage


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    held = docs.select(F.struct(*docs.columns).alias("row"), "text")
    return quality_rules.passing(quality_rules.quality_rules(held)).select("row.*")


def _near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_dedup.keep_one(docs)


def _substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    held = docs.select("doc_id", "text", F.struct(*(c for c in docs.columns if c not in ("doc_id", "text"))).alias("row"))
    cut = substring_dedup.dedup_substrings(held, min_words=PASSAGE_WORDS, min_bytes=substring_dedup.MIN_LEN, min_len=PASSAGE_BYTES)
    columns = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return cut.where(F.col("text").rlike("[^\\x20\\x09-\\x0D]")).select(*(columns.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


def _benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(docs, common.table(spark, sf_dir, "benchmark"))


def _pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(common.materialize(packing.pieces(docs)))


STAGES = [
    ("quality_rules", _stage(_quality)),
    ("simhash_dedup", _stage(_near)),
    ("suffix_array_dedup", _stage(_substrings)),
    ("decontamination", _stage(_benchmark)),
    ("best_fit_packing", _stage(_pack)),
]

#: SQL can't express the stages; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each result but the last is written to the shared folder and reread."""
    docs, last = common.table(spark, sf_dir, "documents"), []
    for i, (_, stage) in enumerate(STAGES):
        made = len(common.scratch())
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        docs = common.materialize(out)
        written = common.scratch()[made:]
        common.release(spark, [*last, *written[:-1]])  # the input of the stage, and what it wrote on the way
        last = written[-1:]
    return docs
