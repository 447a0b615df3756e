"""Record linkage of raw instructions to flattened turns: an equi-join on answer, map and turn, then two text ratios.

The texts of each side are collapsed to distinct ones first, so copies are compared once. Inside a block of equal answer, map
and turn, only texts in neighbouring bands of length meet, letter counts bound the ratio from above before any text is
compared, equal texts need no comparison, longest common subsequences bound it again, and blocks are matched on what is left,
until it is known whether the ratio passes. Nothing that could pass is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.matching import above_column, band, bound, profile
from .dialog import SPLIT, flatten_turns, query, split_of, table

KEYS = ["answer_key", "map_name", "turn_id"]
#: What counts as blank at the ends of a text.
_SPACE = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def plain(text: Column) -> Column:
    return F.lower(F.btrim(text, F.lit(_SPACE)))


def answer_key(answer: Column) -> Column:
    """The first eight digits of the hash of the answer in plain form."""
    return F.substring(F.md5(plain(answer)), 1, 8)


def raw_keys(raw: DataFrame) -> DataFrame:
    """Question and answer rows of raw with answer_key, turn_id, question and first_instruction.

    raw: instructions ([QUE] question [INS] answer), pre_dialogs, map_name and route_index (route_turn). A marker that the
    first earlier dialog lacks counts as standing just before its first character, of which four are then cut."""
    x, head = F.col("instructions"), F.element_at("pre_dialogs", 1)
    que, ins = F.locate("[QUE]", x), F.locate("[INS]", x)
    after = lambda text, at: F.substring(text, at + 5, F.length(text))
    columns = {
        "answer_key": answer_key(after(x, ins)),
        "question": F.coalesce(plain(F.substring(x, que + 5, F.greatest(F.lit(0), ins - que - 5))), F.lit("")),
        "first_instruction": F.coalesce(plain(after(head, F.locate("[INS]", head))), F.lit("")),
        "turn_id": F.substring("route_index", F.locate("_", F.col("route_index")) + 1, F.length("route_index")).try_cast("long") - 1,
    }
    return raw.where(x.contains("[QUE]") & x.contains("[INS]")).withColumns(columns)


def linked(raw: DataFrame, turns: DataFrame, key: str, order: str, least: float = 0.9) -> DataFrame:
    """key of raw and the least order of the turns that it is linked to; rows without one are left out.

    raw: as raw_keys takes it. turns: order, episode_id, map_name, turn_id, question, answer, first_instruction; augmented
    episodes (aug_pattern in their id) are left out. Linked: equal answer key, map and turn, and both ratios above least."""
    mine = raw_keys(raw).select(F.col(key).alias("raw_key"), *KEYS, "question", "first_instruction")
    other = turns.where(~F.coalesce(F.col("episode_id").contains("aug_pattern"), F.lit(False)))
    texts = [F.coalesce(plain(F.col(c)), F.lit("")).alias(c) for c in ("question", "first_instruction")]
    other = other.select(F.col(order).alias("turn_key"), answer_key(F.col("answer")).alias("answer_key"), "map_name", F.col("turn_id").cast("long").alias("turn_id"), *texts)
    both = [*KEYS, "question", "first_instruction"]
    right = other.groupBy(*both).agg(F.min("turn_key").alias("turn_key")).withColumns({"q2": F.col("question"), "f2": F.col("first_instruction")}).drop("question", "first_instruction")
    right = right.withColumns({"p2": F.array(profile(F.col("q2")), profile(F.col("f2"))), "band": band(F.col("q2"), least)})
    left = mine.select(*both).distinct().withColumns({"p1": F.array(profile(F.col("question")), profile(F.col("first_instruction"))), "band": band(F.col("question"), least)})
    left = left.withColumn("band", F.explode(F.array(*[F.col("band") + i for i in (-1, 0, 1)])))
    pairs = left.join(right, [*KEYS, "band"]).where((bound(F.col("p2")[0], F.col("p1")[0]) > least) & (bound(F.col("p2")[1], F.col("p1")[1]) > least)).drop("p1", "p2", "band")
    alike = pairs.where(above_column("q2", "question", "f2", "first_instruction", least))
    best = alike.groupBy(*both).agg(F.min("turn_key").alias("turn_key"))
    return mine.join(best, both).select(F.col("raw_key").alias(key), "turn_key")


def raw_side(spark, sf_dir: str) -> DataFrame:
    """Stand-in of raw instructions: each answered turn, with questions that are whole, cut, mangled or reversed."""
    turns = flatten_turns(table(spark, sf_dir, "conversations"))
    q, f = F.coalesce("question", F.lit("")), F.coalesce("first_instruction", F.lit(""))
    kind = F.pmod("conv_id", F.lit(4))
    edited = F.when(kind == 0, q).when(kind == 1, F.substring(q, F.lit(1), (F.length(q) * 0.95).cast("int"))).when(kind == 2, F.replace(q, F.lit("th"), F.lit("ht"))).otherwise(F.reverse(q))
    return turns.select(
        F.concat("conv_id", F.lit("_"), F.col("turn") + 1).alias("route_index"), split_of(F.col("conv_id")).alias("map_name"),
        F.concat(F.lit("[QUE] "), edited, F.lit(" [INS] "), F.translate("answer", "aeioun", "AEIOUN"), F.lit(" ")).alias("instructions"),
        F.array(F.concat(F.lit("[INS]"), F.when(F.col("conv_id") % 3 == 0, F.replace(f, F.lit("the "), F.lit("a "))).otherwise(f))).alias("pre_dialogs"),
    )


def turn_side(spark, sf_dir: str) -> DataFrame:
    """Stand-in of flattened turns: every turn, one with another question before it, and augmented copies."""
    turns = flatten_turns(table(spark, sf_dir, "conversations"))
    base = turns.select("conv_id", "turn", split_of(F.col("conv_id")).alias("map_name"), F.col("turn").alias("turn_id"), "question", "answer", "first_instruction")
    kinds = F.explode(F.array(F.struct(F.lit(0).alias("copy"), F.lit("").alias("mark")), F.struct(F.lit(1).alias("copy"), F.lit("").alias("mark")), F.struct(F.lit(2).alias("copy"), F.lit("aug_pattern_").alias("mark"))))
    made = base.select("*", kinds.alias("x")).withColumn("question", F.when((F.col("x.copy") == 0) & (F.col("turn") % 2 == 0), F.reverse("question")).otherwise(F.col("question")))
    return made.select(F.struct("conv_id", "turn", "x.copy").alias("place"), F.concat("x.mark", F.col("conv_id").cast("string")).alias("episode_id"), "map_name", "turn_id", "question", "answer", "first_instruction")


@query("linkage_ratio")
def linkage_ratio(spark, sf_dir):
    """The matcher ratio has no form in SQL: tests hold it against the standard library, and the join against a loop."""
    found = linked(raw_side(spark, sf_dir), turn_side(spark, sf_dir), "route_index", "place")
    return found.select("route_index", "turn_key.*")


_TRIM = "chr(32) || chr(9) || chr(10) || chr(13)"


@query(
    "linkage_blocks",
    f"""WITH c AS (SELECT conv_id, turn, text AS answer, first_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS f FROM conversations),
 t AS (SELECT conv_id, conv_id || '_' || (turn + 1) AS route_index, {SPLIT.format("conv_id")} AS map_name, turn, md5(lower(trim(answer, {_TRIM})))[:8] AS answer_key, lower(trim(CASE WHEN conv_id % 3 = 0 THEN replace(coalesce(f, ''), 'the ', 'a ') ELSE coalesce(f, '') END, {_TRIM})) AS first_instruction FROM c WHERE turn > 0),
 n AS (SELECT answer_key, map_name, turn, 2 * count(*) AS candidates FROM t GROUP BY ALL)
 SELECT route_index, answer_key, first_instruction, candidates FROM t JOIN n USING (answer_key, map_name, turn)""",
)
def linkage_blocks(spark, sf_dir):
    """Raw rows with their parsed first instruction and the number of turns that the equi-join brings, by the hash's head."""
    raw = raw_keys(raw_side(spark, sf_dir)).select("route_index", *KEYS, "first_instruction")
    turns = turn_side(spark, sf_dir).where(~F.col("episode_id").contains("aug_pattern"))
    sizes = turns.groupBy(answer_key(F.col("answer")).alias("answer_key"), "map_name", F.col("turn_id").cast("long").alias("turn_id")).agg(F.count(F.lit(1)).alias("candidates"))
    return raw.join(sizes, KEYS).select("route_index", "answer_key", "first_instruction", "candidates")
