"""Queries of the generation drivers, with a deterministic generator that fails on chosen prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import generate
from .dialog import SPLIT, query, split_of, table
from .linkage import raw_side, turn_side


def echo(prompts: list[str]) -> list[str]:
    """The first quoted text of each prompt, reworded by rule; fails as a whole if one holds `zu`."""
    quoted = [p.split('"')[1] if p.count('"') > 1 else p for p in prompts]
    if any("zu" in q for q in quoted):
        raise RuntimeError("no answer")
    return ["\n".join(["1. please " + q[:40], "Positive: go on, " + q[:40], '"then turn ' + q[-30:].replace("\n", " ") + '"']) if q[:1] != "A" else None for q in (x.replace("\n", " ") for x in quoted)]


_CLEAN = "trim(regexp_replace(trim(regexp_replace(trim(regexp_replace(trim(regexp_replace(text, '\\(.*?\\)', '', 'g')), '\\[.*?\\]', '', 'g')), '(?i)Note:.*', '', 'g')), '(?i)Additional context:.*', '', 'g'))"


@query("generated_turns", f"""WITH t AS (SELECT conv_id, turn, text, {_CLEAN} AS q, len(regexp_extract_all(text, '\\S+')) >= 3 AS wanted FROM conversations),
 o AS (SELECT conv_id, turn, {SPLIT.format("conv_id")} AS split, wanted, contains(q, 'zu') OR starts_with(q, 'A') AS failed FROM t)
 SELECT split, count(DISTINCT conv_id) AS episodes, count(*) FILTER (wanted) AS answered, count(*) FILTER (wanted AND NOT failed) AS successful, count(*) FILTER (wanted AND failed) AS failed FROM o GROUP BY split""")
def generated_turns(spark, sf_dir):
    """Turns through prompt, generator and validation, counted by split."""
    done = generate.augmented(table(spark, sf_dir, "conversations").withColumn("key", F.struct("conv_id", "turn")), "key", "text", echo)
    return generate.augmentation_counts(done, split_of(F.col("conv_id")), "conv_id")


@query("regenerated_rows")
def regenerated_rows(spark, sf_dir):
    """Instructions with new answers where a turn is linked: the link's ratio has no SQL, tests hold the stages against loops."""
    turns = turn_side(spark, sf_dir)
    done = generate.regenerated(raw_side(spark, sf_dir), turns, "route_index", "place", "answer", echo)
    return done.select("route_index", "status", F.md5("instructions").alias("instructions_md5"), "error")
