"""Repair, rewriting, validation and bookkeeping of dialog rows. Stand-ins: conversations, and texts and paraphrases from part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T
from .dialog import SPLIT, by_turn, query, split_of, table
from .texts import ANSWER, CATS, PAIR, A, I, V, answers, feats_sql, groups_sql, instructions, lst, pairs, paraphrased  # noqa: F401

NONE = "CAST(NULL AS VARCHAR)"


@query("nested_turn_filter", "SELECT conv_id, count(*) AS turns, md5(string_agg(text, '|' ORDER BY turn)) AS texts_md5 FROM conversations WHERE turn > 0 GROUP BY 1")
def nested_turn_filter(spark, sf_dir):
    """Drops the first turn inside each episode's array, then episodes left empty."""
    nested = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("dialogs"))
    later = nested.withColumn("dialogs", F.filter("dialogs", lambda d: d["turn"] > 0)).where(F.size("dialogs") > 0)
    return later.select("conv_id", F.size("dialogs").cast("long").alias("turns"), F.md5(F.array_join(F.transform("dialogs", lambda d: d["text"]), "|")).alias("texts_md5"))


@query("turn_restructure", "SELECT json_object('conv_id', conv_id, 'split', " + SPLIT.format("conv_id") + ")::VARCHAR AS episode, json_object('turn', turn, 'role', role)::VARCHAR AS dialog FROM conversations")
def turn_restructure(spark, sf_dir):
    """Flat rows as a struct of the episode and one of the turn."""
    x = table(spark, sf_dir, "conversations").select(F.struct("conv_id", split_of(F.col("conv_id")).alias("split")).alias("episode"), F.struct("turn", "role").alias("dialog"))
    return x.select(F.to_json("episode").alias("episode"), F.to_json("dialog").alias("dialog"))


@query("observation_branch", "SELECT vec_id, vec_id % 4 <> 0 AS observed, CASE WHEN vec_id % 4 <> 0 THEN round(embedding[1]::DOUBLE, 6) ELSE 0.0::DOUBLE END AS first_value, CASE WHEN vec_id % 4 <> 0 THEN len(embedding) ELSE 64 END AS width FROM embeddings")
def observation_branch(spark, sf_dir):
    """A missing observation becomes a blank one of the same width."""
    x = table(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("vec_id") % 4 != 0, F.transform("embedding", lambda v: v.cast("double"))).alias("view"))
    blank = F.array_repeat(F.lit(0.0), 64)
    v = F.coalesce("view", blank)
    return x.select("vec_id", F.col("view").isNotNull().alias("observed"), F.round(v[0], 6).alias("first_value"), F.size(v).cast("long").alias("width"))


@query("optional_defaults", f"SELECT p_partkey, coalesce(np0, 0)::BIGINT AS positives, np0 IS NOT NULL AS has_paraphrases, CASE WHEN p_size % 5 = 0 THEN 'unknown' ELSE 'size ' || p_size END AS destination FROM {V}")
def optional_defaults(spark, sf_dir):
    x = paraphrased(spark, sf_dir).withColumn("d", F.when(F.col("p_size") % 5 != 0, F.concat(F.lit("size "), F.col("p_size").cast("string"))))
    return x.select("p_partkey", F.coalesce(F.size("p.positives"), F.lit(0)).cast("long").alias("positives"), F.col("p").isNotNull().alias("has_paraphrases"), F.coalesce("d", F.lit("unknown")).alias("destination"))


def contrastive(p: Column) -> dict[str, Column]:
    """The first two positives and the first negative; null where there is none."""
    return {"positive_text": F.get(p["positives"], F.lit(0)), "positive_text_2": F.get(p["positives"], F.lit(1)), "negative_text": F.get(p["negatives"], F.lit(0))}


_CONTRASTIVE = "CASE WHEN np > 0 THEN 'head to the red building' END AS positive_text, CASE WHEN np > 1 THEN 'go on past the road' END AS positive_text_2, CASE WHEN nn > 0 THEN 'turn back' END AS negative_text"


@query("contrastive_projection", f"SELECT p_partkey, {_CONTRASTIVE} FROM {V}")
def contrastive_projection(spark, sf_dir):
    x = paraphrased(spark, sf_dir)
    return x.select("p_partkey", *(c.alias(k) for k, c in contrastive(F.col("p")).items()))


@query("contrastive_flatten", f"SELECT p_partkey, positive_text IS NOT NULL AS has_positive, negative_text IS NOT NULL AS has_negative, coalesce(positive_text, '') AS positive_input, coalesce(positive_text_2, positive_text, '') AS positive_input_2, coalesce(negative_text, '') AS negative_input FROM (SELECT p_partkey, {_CONTRASTIVE} FROM {V})")
def contrastive_flatten(spark, sf_dir):
    """The contrastive texts as columns of the turn's row, with flags; a missing second positive repeats the first."""
    x = paraphrased(spark, sf_dir).withColumns(contrastive(F.col("p")))
    return x.select("p_partkey", F.col("positive_text").isNotNull().alias("has_positive"), F.col("negative_text").isNotNull().alias("has_negative"), F.coalesce("positive_text", F.lit("")).alias("positive_input"), F.coalesce("positive_text_2", "positive_text", F.lit("")).alias("positive_input_2"), F.coalesce("negative_text", F.lit("")).alias("negative_input"))


def updated_instruction(x: Column, answer: Column) -> Column:
    """Question and tag, the tag alone, or neither is kept in front of the new answer."""
    both = x.contains("[QUE]") & x.contains("[INS]")
    question = F.btrim(F.replace(F.split_part(x, F.lit("[INS]"), F.lit(1)), F.lit("[QUE]"), F.lit("")))
    return F.when(both, F.concat(F.lit("[QUE] "), question, F.lit(" [INS] "), answer)).when(x.contains("[INS]"), F.concat(F.lit("[INS] "), answer)).otherwise(answer)


def _branches(spark, sf_dir) -> DataFrame:
    """Instructions with question and tag, with the tag alone, and with neither."""
    t = F.when(F.col("p_size") % 3 == 0, F.col("t")).when(F.col("p_size") % 3 == 1, F.concat(F.lit("[INS]"), F.split_part("t", F.lit("[INS]"), F.lit(2)))).otherwise(F.btrim(F.split_part("t", F.lit("[INS]"), F.lit(2))))
    answer = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("fly to "), F.col("p_partkey").cast("string"))).otherwise(F.btrim(F.split_part("t", F.lit("[INS]"), F.lit(2))))
    return instructions(spark, sf_dir).select("p_partkey", t.alias("t"), answer.alias("answer"))


_B = f"(SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN t WHEN 1 THEN '[INS]' || split_part(t, '[INS]', 2) ELSE trim(split_part(t, '[INS]', 2)) END AS t, CASE WHEN p_partkey % 2 = 0 THEN 'fly to ' || p_partkey ELSE trim(split_part(t, '[INS]', 2)) END AS answer FROM {I})"
_UPDATED = "CASE WHEN contains(t, '[QUE]') AND contains(t, '[INS]') THEN '[QUE] ' || trim(replace(split_part(t, '[INS]', 1), '[QUE]', '')) || ' [INS] ' || answer WHEN contains(t, '[INS]') THEN '[INS] ' || answer ELSE answer END"


@query("instruction_update", f"SELECT p_partkey, {_UPDATED} AS instruction FROM {_B}")
def instruction_update(spark, sf_dir):
    return _branches(spark, sf_dir).select("p_partkey", updated_instruction(F.col("t"), F.col("answer")).alias("instruction"))


@query("changed_answers", f"SELECT p_partkey, trim(list_last(string_split(u, '[INS]'))) AS new_answer FROM (SELECT p_partkey, t, {_UPDATED} AS u FROM {_B}) WHERE u <> t")
def changed_answers(spark, sf_dir):
    """Rows whose instruction changed, with the answer read back from behind the last tag."""
    x = _branches(spark, sf_dir).withColumn("u", updated_instruction(F.col("t"), F.col("answer"))).where("u <> t")
    return x.select("p_partkey", F.btrim(F.element_at(F.split("u", "\\[INS\\]"), -1)).alias("new_answer"))


def parse_history(context: Column, first: Column) -> Column:
    """'Question: q' and 'Answer: a' of each turn in a dialog context."""
    rest = F.split(F.replace(context, F.concat(F.lit("First Instruction: "), first), F.lit("")), "Question:")
    turns = F.filter(F.slice(rest, 2, F.greatest(F.size(rest), F.lit(1))), lambda p: p.contains("Answer:"))
    answer = lambda p: F.btrim(F.substr(p, F.locate("Answer:", p) + 7))
    return F.flatten(F.transform(turns, lambda p: F.array(F.concat(F.lit("Question: "), F.btrim(F.split_part(p, F.lit("Answer:"), F.lit(1)))), F.concat(F.lit("Answer: "), answer(p)))))


_CONTEXT = "'First Instruction: ' || t || CASE WHEN p_size % 3 > 0 THEN ' Question: where is ' || p_size || ' Answer: by the road' ELSE '' END || CASE WHEN p_size % 3 > 1 THEN ' Question: is it far Answer: no' ELSE '' END || CASE WHEN p_size % 7 = 0 THEN ' Question: unanswered' ELSE '' END"


@query("history_parse", f"SELECT p_partkey, array_to_string(flatten(list_transform(list_filter(string_split(replace(c, 'First Instruction: ' || t, ''), 'Question:')[2:], lambda p: contains(p, 'Answer:')), lambda p: ['Question: ' || trim(split_part(p, 'Answer:', 1)), 'Answer: ' || trim(substr(p, instr(p, 'Answer:') + 7))])), '|') AS history FROM (SELECT p_partkey, t, {_CONTEXT} AS c FROM {A})")
def history_parse(spark, sf_dir):
    s, lit = F.col("p_size"), F.lit
    none = lit("")
    c = F.concat(lit("First Instruction: "), "t", F.when(s % 3 > 0, F.concat(lit(" Question: where is "), s.cast("string"), lit(" Answer: by the road"))).otherwise(none), F.when(s % 3 > 1, " Question: is it far Answer: no").otherwise(none), F.when(s % 7 == 0, " Question: unanswered").otherwise(none))
    return answers(spark, sf_dir).select("p_partkey", F.array_join(parse_history(c, F.col("t")), "|").alias("history"))


@query("score_records", "SELECT p_partkey, array_to_string(list_filter(['embedding=' || (p_partkey * 37 % 100), CASE WHEN p_size % 5 > 0 THEN 'direction=' || (p_partkey * 53 % 100) END, CASE WHEN p_size % 3 > 0 THEN 'landmark=' || (p_partkey * 71 % 100) END], lambda x: x IS NOT NULL), ',') AS scores FROM part")
def score_records(spark, sf_dir):
    """The scores that a row has, by name; missing ones are left out."""
    v = lambda k: (F.col("p_partkey") * k % 100).cast("string")
    s = F.col("p_size")
    named = F.array(F.struct(F.lit("embedding").alias("name"), v(37).alias("value")), F.struct(F.lit("direction").alias("name"), F.when(s % 5 > 0, v(53)).alias("value")), F.struct(F.lit("landmark").alias("name"), F.when(s % 3 > 0, v(71)).alias("value")))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(F.filter(named, lambda x: x["value"].isNotNull()), lambda x: F.concat(x["name"], F.lit("="), x["value"])), ",").alias("scores"))


@query("attach_negatives", "SELECT a.vec_id, n.vec_id AS negative, n.label AS negative_label, n.vec_id IS NOT NULL AS has_negative FROM embeddings a LEFT JOIN embeddings n ON n.vec_id = (a.vec_id * 7 + 3) % (SELECT count(*) FROM embeddings) AND n.label <> a.label")
def attach_negatives(spark, sf_dir):
    """Mined negatives join their anchors as one more struct; anchors without any stay."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    n = F.broadcast(e.agg(F.count(F.lit(1)).alias("n")))
    found = e.crossJoin(n).select("vec_id", F.col("label").alias("own"), ((F.col("vec_id") * 7 + 3) % F.col("n")).alias("j")).join(e.select(F.col("vec_id").alias("j"), "label"), "j").where("own <> label")
    mined = found.select("vec_id", F.struct(F.col("j").alias("vec_id"), "label").alias("negative"))
    return e.join(mined, "vec_id", "left").select("vec_id", F.col("negative.vec_id").alias("negative"), F.col("negative.label").alias("negative_label"), F.col("negative").isNotNull().alias("has_negative"))


@query("issue_map_join", f"WITH i AS (SELECT p_partkey // 10 AS episode, p_partkey, np || 'P' || nn || 'N' AS issue FROM {V} WHERE np0 IS NOT NULL AND (np <> 2 OR nn <> 1)) SELECT v.p_partkey // 10 AS episode, v.p_partkey, i.issue FROM {V} v LEFT JOIN i USING (p_partkey) WHERE v.p_partkey // 10 IN (SELECT episode FROM i)")
def issue_map_join(spark, sf_dir):
    """Episodes with an issue, all their turns, and the issue of each turn that has one."""
    x = paraphrased(spark, sf_dir).withColumn("episode", F.floor(F.col("p_partkey") / 10))
    issues = x.where("p is not null and (np <> 2 or nn <> 1)").select("episode", "p_partkey", F.concat(F.col("np").cast("string"), F.lit("P"), F.col("nn").cast("string"), F.lit("N")).alias("issue"))
    return x.join(issues.select("episode").distinct(), "episode", "left_semi").join(issues.select("p_partkey", "issue"), "p_partkey", "left").select("episode", "p_partkey", "issue")


@query("answer_cache", f"WITH c AS (SELECT DISTINCT lower(trim(t)) AS k FROM {A}) SELECT p_partkey, len(string_split_regex(k, '\\s+')) AS words, length(k) >= 20 AS long_enough FROM {A} JOIN c ON k = lower(trim(t))")
def answer_cache(spark, sf_dir):
    """Each distinct normalized answer is computed on once, and its values go back to all rows that hold it."""
    x = answers(spark, sf_dir).withColumn("k", T.normalize_answer(F.col("t")))
    cache = x.select("k").distinct().select("k", F.size(T.tokens(F.col("k"))).cast("long").alias("words"), (F.length("k") >= 20).alias("long_enough"))
    return x.join(cache, "k").select("p_partkey", "words", "long_enough")


@query("positional_results", f"SELECT p_partkey, i AS pos, CASE WHEN i < nn THEN 'valid' ELSE 'missing' END AS result FROM (SELECT p_partkey, nn, unnest(range(np)) AS i FROM {V})")
def positional_results(spark, sf_dir):
    """Texts and their results by position; a text without a result is an issue."""
    x = paraphrased(spark, sf_dir).where("np > 0").select("p_partkey", F.posexplode("p.positives").alias("pos", "text"), F.transform("p.negatives", lambda n: F.lit("valid")).alias("results"))
    return x.select("p_partkey", F.col("pos").cast("long").alias("pos"), F.coalesce(F.get("results", F.col("pos")), F.lit("missing")).alias("result"))


_TOTALS = f"(SELECT count(*) AS turns, count(np0) AS paraphrased, count(*) FILTER (np0 IS NOT NULL AND np = 2 AND nn = 1) AS correct, sum(np) AS positives, sum(nn) AS negatives FROM {V})"


@query("verify_success", f"SELECT paraphrased = turns AS full_coverage, correct = paraphrased AS correct_structure, positives = 2 * paraphrased AS positive_count, negatives = paraphrased AS negative_count, turns - paraphrased AS missing, (paraphrased = turns AND correct = paraphrased AND positives = 2 * paraphrased AND negatives = paraphrased) AS passed FROM {_TOTALS}")
def verify_success(spark, sf_dir):
    """Totals over all splits against the four criteria."""
    has = F.col("p").isNotNull()
    t = paraphrased(spark, sf_dir).agg(F.count(F.lit(1)).alias("turns"), F.count("p").alias("paraphrased"), F.count_if(has & (F.col("np") == 2) & (F.col("nn") == 1)).alias("correct"), F.sum("np").alias("positives"), F.sum("nn").alias("negatives"))
    t = t.selectExpr("paraphrased = turns AS full_coverage", "correct = paraphrased AS correct_structure", "positives = 2 * paraphrased AS positive_count", "negatives = paraphrased AS negative_count", "turns - paraphrased AS missing")
    return t.withColumn("passed", F.expr("full_coverage AND correct_structure AND positive_count AND negative_count"))


#: Validation results of the paraphrases: of position i, formulas over the key; where p_size % 7 = 0 a result is missing, where
#: p_size % 13 = 0 the whole analysis.
_RESULT = "SELECT p_partkey, split, 'P' AS kind, i, (p_partkey * 37 + i * 11) % 100 / 100.0::DOUBLE AS sim, (p_partkey + i) % 3 > 0 AS ok, (p_partkey + i) % 4 > 0 AS listed, false AS changed, p_size % 7 = 0 AND i = np - 1 AS missing FROM (SELECT *, unnest(range(np)) AS i FROM {v}) UNION ALL SELECT p_partkey, split, 'N', i, (p_partkey * 37 + i * 11) % 100 / 100.0::DOUBLE, (p_partkey + i) % 3 > 0, (p_partkey + i) % 4 > 0, (p_partkey + i) % 2 = 0, p_size % 7 = 0 AND i = nn - 1 FROM (SELECT *, unnest(range(nn)) AS i FROM {v})"
_WITH = f"(SELECT * FROM {V} WHERE np0 IS NOT NULL AND p_size % 13 <> 0)"


def validations(x: DataFrame) -> DataFrame:
    """kind (P or N), position, similarity, validity by the result (ok) and by the list (listed), spatial change."""
    x = x.where("p is not null and p_size % 13 <> 0")
    rows = lambda n, kind: F.transform(F.filter(F.sequence(F.lit(0), F.col(n)), lambda i: i < F.col(n)), lambda i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), ((F.col("p_size") % 7 == 0) & (i == F.col(n) - 1)).alias("missing")))
    x = x.select("p_partkey", "split", F.explode(F.concat(rows("np", "P"), rows("nn", "N"))).alias("r")).select("p_partkey", "split", "r.*")
    k, i = F.col("p_partkey"), F.col("i")
    return x.withColumns({"sim": ((k * 37 + i * 11) % 100).cast("double") / 100, "ok": (k + i) % 3 > 0, "listed": (k + i) % 4 > 0, "changed": (F.col("kind") == "N") & ((k + i) % 2 == 0)})


@query("verify_issue_types", f"""WITH r AS ({_RESULT.format(v=_WITH)}), i AS (
 SELECT split, unnest([CASE WHEN np0 IS NULL AND p_partkey % 2 = 0 THEN 'missing_paraphrases_short' WHEN np0 IS NULL THEN 'missing_paraphrases_long' END, CASE WHEN np0 IS NOT NULL AND (np <> 2 OR nn <> 1) THEN 'structure_issues' END, CASE WHEN np0 IS NOT NULL AND p_size % 13 = 0 THEN 'validation_issues' END]) AS issue FROM {V}
 UNION ALL SELECT split, unnest([CASE WHEN missing THEN 'missing_validation_results' END, CASE WHEN NOT missing AND listed <> ok THEN 'validation_inconsistencies' END, CASE WHEN missing OR ok THEN NULL WHEN kind = 'P' AND sim < 0.5 THEN 'low_embedding_similarity' WHEN kind = 'N' AND sim >= 0.92 THEN 'high_embedding_similarity' WHEN kind = 'N' AND NOT changed THEN 'insufficient_spatial_changes' END]) FROM r)
 SELECT split, issue, count(*) AS n FROM i WHERE issue IS NOT NULL GROUP BY 1, 2""")
def verify_issue_types(spark, sf_dir):
    """Issues of nine types, of turns and of single validation results."""
    x = paraphrased(spark, sf_dir)
    has, structure = F.col("p").isNotNull(), (F.col("np") != 2) | (F.col("nn") != 1)
    turn = F.array(F.when(~has, F.when(F.col("p_partkey") % 2 == 0, "missing_paraphrases_short").otherwise("missing_paraphrases_long")), F.when(has & structure, "structure_issues"), F.when(has & (F.col("p_size") % 13 == 0), "validation_issues"))
    live = ~F.col("missing")
    rejected = live & ~F.col("ok")
    one = F.array(F.when(F.col("missing"), "missing_validation_results"), F.when(live & (F.col("listed") != F.col("ok")), "validation_inconsistencies"), F.when(rejected & (F.col("kind") == "P") & (F.col("sim") < 0.5), "low_embedding_similarity").when(rejected & (F.col("kind") == "N") & (F.col("sim") >= 0.92), "high_embedding_similarity").when(rejected & (F.col("kind") == "N") & ~F.col("changed"), "insufficient_spatial_changes"))
    every = x.select("split", F.explode(turn).alias("issue")).unionAll(validations(x).select("split", F.explode(one).alias("issue")))
    return every.where("issue is not null").groupBy("split", "issue").agg(F.count(F.lit(1)).alias("n"))


@query("verify_counters", f"""WITH r AS (SELECT p_partkey, count(*) FILTER (kind = 'P' AND listed) AS vp, count(*) FILTER (kind = 'N' AND listed) AS vn FROM ({_RESULT.format(v=_WITH)}) GROUP BY 1), x AS (SELECT v.*, coalesce(vp, 0) AS vp, coalesce(vn, 0) AS vn FROM {V} v LEFT JOIN r USING (p_partkey))
 SELECT split, count(DISTINCT p_partkey // 10) AS total_episodes, count(*) AS total_dialogs, count(*) AS dialogs_with_answers, count(np0) AS dialogs_with_paraphrases, count(*) FILTER (np0 IS NOT NULL AND np = 2 AND nn = 1) AS correct_structure, count(*) FILTER (np0 IS NOT NULL AND p_size % 13 = 0) AS validation_issues,
 count(*) FILTER (np0 IS NOT NULL AND np + nn > 0 AND vp + vn = np + nn) AS perfect_validations, count(*) FILTER (np0 IS NOT NULL AND vp + vn > 0 AND vp + vn < np + nn) AS partial_validations, count(*) FILTER (np0 IS NOT NULL AND vp + vn = 0) AS failed_validations,
 sum(np)::BIGINT AS total_positives_generated, sum(nn)::BIGINT AS total_negatives_generated, sum(vp)::BIGINT AS total_valid_positives, sum(vn)::BIGINT AS total_valid_negatives FROM x GROUP BY 1""")
def verify_counters(spark, sf_dir):
    """The thirteen counters of each split."""
    x = paraphrased(spark, sf_dir)
    valid = validations(x).groupBy("p_partkey").agg(F.count_if((F.col("kind") == "P") & F.col("listed")).alias("vp"), F.count_if((F.col("kind") == "N") & F.col("listed")).alias("vn"))
    x = x.join(valid, "p_partkey", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("vp", "vn")})
    has, made, good = F.col("p").isNotNull(), F.col("np") + F.col("nn"), F.col("vp") + F.col("vn")
    count = {
        "dialogs_with_paraphrases": has, "correct_structure": has & (F.col("np") == 2) & (F.col("nn") == 1), "validation_issues": has & (F.col("p_size") % 13 == 0),
        "perfect_validations": has & (made > 0) & (good == made), "partial_validations": has & (good > 0) & (good < made), "failed_validations": has & (good == 0),
    }
    sums = {"total_positives_generated": "np", "total_negatives_generated": "nn", "total_valid_positives": "vp", "total_valid_negatives": "vn"}
    every = F.count(F.lit(1))
    return x.groupBy("split").agg(F.count_distinct(F.floor(F.col("p_partkey") / 10)).alias("total_episodes"), every.alias("total_dialogs"), every.alias("dialogs_with_answers"), *(F.count_if(c).alias(k) for k, c in count.items()), *(F.sum(c).cast("long").alias(k) for k, c in sums.items()))


@query("hint_usage", "SELECT hint, count(*) AS n FROM (SELECT CASE p_size % 5 WHEN 0 THEN 'none' WHEN 1 THEN 'spatial' WHEN 2 THEN 'movement' WHEN 3 THEN 'landmark' ELSE 'navigation' END AS hint FROM part) GROUP BY 1")
def hint_usage(spark, sf_dir):
    keys = F.array(*[F.lit(k) for k in ("none", *L.HINTS)])
    return table(spark, sf_dir, "part").select(F.get(keys, (F.col("p_size") % 5).cast("int")).alias("hint")).groupBy("hint").agg(F.count(F.lit(1)).alias("n"))


@query("hinted_prompts", "SELECT p_partkey, CASE p_size % 5 " + " ".join(f"WHEN {i} THEN '{v.replace(chr(39), chr(39) * 2)} '" for i, v in enumerate(L.HINTS.values(), 1)) + f" ELSE '' END || t AS prompt FROM {A}")
def hinted_prompts(spark, sf_dir):
    """One of four hints, or none, before the text."""
    hints = F.array(F.lit(""), *[F.lit(v + " ") for v in L.HINTS.values()])
    return answers(spark, sf_dir).select("p_partkey", F.concat(F.get(hints, (F.col("p_size") % 5).cast("int")), "t").alias("prompt"))


@query("generation_metric_avg", "SELECT round(avg((p_partkey * 37 % 100) / 100.0::DOUBLE), 6) AS bleu4, round(avg(CASE WHEN p_size % 4 > 0 THEN (p_partkey * 53 % 100) / 100.0::DOUBLE END), 6) AS rouge_l, round(avg(CASE WHEN p_size % 9 > 0 THEN (p_partkey * 71 % 100) / 100.0::DOUBLE END), 6) AS total FROM part")
def generation_metric_avg(spark, sf_dir):
    """A metric that a row lacks doesn't count."""
    v = lambda k: (F.col("p_partkey") * k % 100) / 100.0
    return table(spark, sf_dir, "part").agg(F.round(F.avg(v(37)), 6).alias("bleu4"), F.round(F.avg(F.when(F.col("p_size") % 4 > 0, v(53))), 6).alias("rouge_l"), F.round(F.avg(F.when(F.col("p_size") % 9 > 0, v(71))), 6).alias("total"))


@query("batch_validation_rates", f"SELECT split, sum(p)::BIGINT AS positives, sum(vp)::BIGINT AS valid_positives, round(coalesce(sum(vp) / nullif(sum(p), 0)::DOUBLE, 0), 6) AS positive_rate, round(coalesce(sum(vn) / nullif(sum(n), 0)::DOUBLE, 0), 6) AS negative_rate, round(coalesce((sum(vp) + sum(vn)) / nullif(sum(p) + sum(n), 0)::DOUBLE, 0), 6) AS overall_rate FROM (SELECT split, (kind = 'P')::INT AS p, (kind = 'N')::INT AS n, (kind = 'P' AND ok)::INT AS vp, (kind = 'N' AND ok)::INT AS vn FROM ({_RESULT.format(v=_WITH)})) GROUP BY 1")
def batch_validation_rates(spark, sf_dir):
    c = lambda kind, ok=False: F.count_if((F.col("kind") == kind) & (F.col("ok") if ok else F.lit(True)))
    x = validations(paraphrased(spark, sf_dir)).groupBy("split").agg(c("P").alias("positives"), c("P", True).alias("valid_positives"), c("N").alias("n"), c("N", True).alias("vn"))
    rate = lambda a, b: F.round(F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0)), 6)
    p, vp, n, vn = (F.col(k) for k in ("positives", "valid_positives", "n", "vn"))
    return x.select("split", "positives", "valid_positives", rate(vp, p).alias("positive_rate"), rate(vn, n).alias("negative_rate"), rate(vp + vn, p + n).alias("overall_rate"))


@query("max_token_length", "SELECT split, max(CASE WHEN p_size % 9 > 0 THEN p_size % 9 - 1 END)::BIGINT AS longest FROM (SELECT p_size, " + SPLIT.format("p_partkey") + " AS split FROM part) GROUP BY 1")
def max_token_length(spark, sf_dir):
    """The greatest place of the end id (1) in padded rows; rows without it don't count."""
    ids = F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.when(i == F.col("p_size") % 9, 1).otherwise(5))
    x = table(spark, sf_dir, "part").select(split_of(F.col("p_partkey")).alias("split"), F.array_position(ids, 1).alias("at"))
    return x.groupBy("split").agg(F.max(F.when(F.col("at") > 0, F.col("at") - 1)).alias("longest"))


@query("repair_counters", f"SELECT coalesce(split, 'all') AS split, count(*) AS found, count(*) FILTER (np > 0) AS fixed, count(*) FILTER (np = 0) AS failed, round(100.0::DOUBLE * count(*) FILTER (np > 0) / count(*), 6) AS fix_rate FROM {V} WHERE np0 IS NOT NULL AND (np <> 2 OR nn <> 1) GROUP BY ROLLUP (split)")
def repair_counters(spark, sf_dir):
    """Structure issues found, repaired (those with a positive to start from) and failed; of each split and of all."""
    x = paraphrased(spark, sf_dir).where("p is not null and (np <> 2 or nn <> 1)")
    out = x.rollup("split").agg(F.count(F.lit(1)).alias("found"), F.count_if(F.col("np") > 0).alias("fixed"), F.count_if(F.col("np") == 0).alias("failed"))
    return out.withColumns({"split": F.coalesce("split", F.lit("all")), "fix_rate": F.round(F.coalesce(F.try_divide(100.0 * F.col("fixed"), F.col("found")), F.lit(0.0)), 6)})


@query("current_observation", "SELECT conv_id, turn, coalesce(lag(role || turn || 'b') OVER (PARTITION BY conv_id ORDER BY turn), role || turn || 'a') AS corners FROM conversations")
def current_observation(spark, sf_dir):
    """The last step of the turn before; of the first turn its own first step."""
    step = lambda s: F.concat("role", F.col("turn").cast("string"), F.lit(s))
    x = table(spark, sf_dir, "conversations").withColumn("path", F.array(step("a"), step("b")))
    return x.select("conv_id", "turn", F.coalesce(F.lag(F.element_at("path", -1)).over(by_turn()), F.col("path")[0]).alias("corners"))


ROUTE = "('m_' || conv_id || '_' || (turn + 1))"


@query("route_parse", f"SELECT conv_id, turn, regexp_replace({ROUTE}, '_[^_]*$', '') AS route, regexp_extract({ROUTE}, '_([0-9]+)$', 1)::BIGINT AS step, substr({ROUTE}, instr({ROUTE}, '_') + 1) AS after_first FROM conversations")
def route_parse(spark, sf_dir):
    """Route and step are parted at the last underscore; linkage reads what stands behind the first."""
    r = F.concat(F.lit("m_"), F.col("conv_id").cast("string"), F.lit("_"), (F.col("turn") + 1).cast("string"))
    x = table(spark, sf_dir, "conversations").withColumn("r", r)
    return x.select("conv_id", "turn", F.regexp_replace("r", "_[^_]*$", "").alias("route"), F.substring_index("r", "_", -1).cast("long").alias("step"), F.substr("r", F.locate("_", F.col("r")) + 1).alias("after_first"))


@query("route_order", f"SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id % 5, regexp_replace({ROUTE}, '_[^_]*$', '') ORDER BY regexp_extract({ROUTE}, '_([0-9]+)$', 1)::BIGINT) AS place FROM conversations")
def route_order(spark, sf_dir):
    """Rows of a map and route in the order of the numbers at their ends."""
    x = table(spark, sf_dir, "conversations").withColumn("r", F.concat(F.lit("m_"), F.col("conv_id").cast("string"), F.lit("_"), (F.col("turn") + 1).cast("string")))
    w = Window.partitionBy(F.col("conv_id") % 5, F.regexp_replace("r", "_[^_]*$", "")).orderBy(F.substring_index("r", "_", -1).cast("long"))
    return x.select("conv_id", "turn", F.row_number().over(w).cast("long").alias("place"))


@query("rank_head", "SELECT o_orderkey, o_orderkey % 8 AS shard FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderkey % 8 ORDER BY o_orderkey) <= 20")
def rank_head(spark, sf_dir):
    """The first 20 rows of each rank: the limit is the feature, and Spark keeps 20 rows a partition before the shuffle."""
    w = Window.partitionBy("shard").orderBy("o_orderkey")
    x = table(spark, sf_dir, "orders").select("o_orderkey", F.pmod("o_orderkey", F.lit(8)).alias("shard"))
    return x.withColumn("r", F.row_number().over(w)).where("r <= 20").select("o_orderkey", "shard")


@query("union_augmented", f"SELECT 'o' || p_partkey AS id, false AS augmented, t AS answer FROM {A} UNION ALL SELECT 'a' || p_partkey, true, 'head to the red building' FROM {V} WHERE np > 0")
def union_augmented(spark, sf_dir):
    a = answers(spark, sf_dir).select(F.concat(F.lit("o"), F.col("p_partkey").cast("string")).alias("id"), F.lit(False).alias("augmented"), F.col("t").alias("answer"))
    b = paraphrased(spark, sf_dir).where("np > 0").select(F.concat(F.lit("a"), F.col("p_partkey").cast("string")).alias("id"), F.lit(True).alias("augmented"), F.get("p.positives", F.lit(0)).alias("answer"))
    return a.unionByName(b)


@query("lexicon_union", f"SELECT term, count(t) AS n FROM (SELECT unnest(list_sort(list_distinct(list_concat({lst(L.COLORS)}, {lst(L.SHAPES)}, {lst(L.LANDMARKS)})))[1:35]) AS term) LEFT JOIN {A} ON contains(lower(t), term) GROUP BY term HAVING count(t) > 0")
def lexicon_union(spark, sf_dir):
    """The first 35 terms of three lexicons that any answer holds, with the number of those."""
    every = F.slice(F.array_sort(F.array_union(F.array_union(T.strings(L.COLORS), T.strings(L.SHAPES)), T.strings(L.LANDMARKS))), 1, 35)
    held = answers(spark, sf_dir).select(F.explode(F.filter(every, lambda term: F.contains(F.lower("t"), term))).alias("term"))
    return held.groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def validator_direction(a: Column, b: Column) -> Column:
    """As the evaluator's, over features as found: hours compare as written, none on either side is 1."""
    hours = lambda x: F.array_sort(F.array_distinct(F.filter(F.transform(x, T.clock_hour_raw), lambda h: h.isNotNull())))
    clock = F.when((F.size(hours(a)) > 0) & (hours(a) == hours(b)), 1.0).otherwise(0.0)
    none = lambda x: F.size(x) == 0
    return F.when(none(a) & none(b), 1.0).when(none(a) | none(b), 0.0).otherwise(F.greatest(clock, T.matched(a, b, T.synonyms(L.DIRECTION_GROUPS, L.DIRECTIONS))))


def validator_landmark(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(T.landmark_score(b, a))


def _validator_sql() -> str:
    hours = lambda a: f"list_sort(list_distinct(list_filter(list_transform({a}, lambda d: nullif(regexp_extract(d, '(\\d+)\\s*o''?clock', 1), '')), lambda h: h IS NOT NULL)))"
    near = lambda p, gs: f"len(list_filter({gs}, lambda s: list_contains(s, g) AND len(list_filter({p}, lambda q: len(list_filter(s, lambda y: contains(q, y))) > 0)) > 0)) > 0"
    f = ", ".join(f"{feats_sql(f'lower({c})', k, L.VALIDATOR, False)} AS {s}_{k}" for s, c in (("p", "pred"), ("g", "gold")) for k in L.VALIDATOR)
    direction = f"CASE WHEN len(g_directions) = 0 AND len(p_directions) = 0 THEN 1.0 WHEN len(g_directions) = 0 OR len(p_directions) = 0 THEN 0.0 ELSE greatest(CASE WHEN len({hours('g_directions')}) > 0 AND {hours('g_directions')} = {hours('p_directions')} THEN 1.0 ELSE 0.0 END, len(list_filter(g_directions, lambda g: list_contains(p_directions, g) OR {near('p_directions', groups_sql(L.DIRECTION_GROUPS))})) / len(g_directions)::DOUBLE) END"
    pl, gl = "array_to_string(p_landmarks, ' ')", "array_to_string(g_landmarks, ' ')"
    landmark = f"CASE WHEN len(g_landmarks) = 0 AND len(p_landmarks) = 0 THEN 1.0 WHEN len(g_landmarks) = 0 OR len(p_landmarks) = 0 THEN 0.0 WHEN replace({pl}, ' ', '') = replace({gl}, ' ', '') THEN 1.0 WHEN contains({pl}, {gl}) OR contains({gl}, {pl}) THEN 0.8 ELSE len(list_filter(g_landmarks, lambda g: {near('p_landmarks', groups_sql(L.LANDMARK_GROUPS))})) / len(g_landmarks)::DOUBLE END"
    part = lambda c: f"CASE WHEN len(g_{c}) = 0 THEN 1.0 ELSE len(list_intersect(p_{c}, g_{c})) / len(g_{c})::DOUBLE END"
    return f"(SELECT p_partkey, ({direction})::DOUBLE AS direction, ({landmark})::DOUBLE AS landmark, ({part('movement_verbs')})::DOUBLE AS movement, ({part('spatial_relations')})::DOUBLE AS relations FROM (SELECT p_partkey, {f} FROM {PAIR}))"


def preservation(spark, sf_dir) -> DataFrame:
    """Similarity of each category of the validator's features, of a text (gold) and its paraphrase."""
    x = pairs(spark, sf_dir).select("p_partkey", *(T.features(F.col(c), k, L.VALIDATOR, False).alias(f"{s}_{k}") for s, c in (("p", "pred"), ("g", "gold")) for k in L.VALIDATOR))
    c = lambda s, k: F.col(f"{s}_{k}")
    part = lambda k: F.when(F.size(c("g", k)) == 0, 1.0).otherwise(F.size(F.array_intersect(c("p", k), c("g", k))) / F.size(c("g", k)))
    return x.select("p_partkey", validator_direction(c("g", "directions"), c("p", "directions")).alias("direction"), validator_landmark(c("g", "landmarks"), c("p", "landmarks")).alias("landmark"), part("movement_verbs").alias("movement"), part("spatial_relations").alias("relations"))


_VALIDATOR = _validator_sql()


@query("validator_similarity", f"SELECT p_partkey, round(direction, 6) AS direction, round(landmark, 6) AS landmark FROM {_VALIDATOR}")
def validator_similarity(spark, sf_dir):
    return preservation(spark, sf_dir).select("p_partkey", F.round("direction", 6).alias("direction"), F.round("landmark", 6).alias("landmark"))


@query("feature_preservation", f"SELECT p_partkey, direction > 0.8 AS directions, landmark > 0.7 AS landmarks, movement > 0.5 AS movement_verbs, relations > 0.5 AS spatial_relations FROM {_VALIDATOR}")
def feature_preservation(spark, sf_dir):
    return preservation(spark, sf_dir).selectExpr("p_partkey", "direction > 0.8 AS directions", "landmark > 0.7 AS landmarks", "movement > 0.5 AS movement_verbs", "relations > 0.5 AS spatial_relations")


def parse_short_answer(response: Column) -> Column:
    """positives (2 at most) and negatives (1) of a sectioned response; lines without a section's name continue the one
    before while it has room."""
    lines = F.filter(F.transform(F.split(response, "\n"), T.strip), lambda s: s != "")
    none = F.array().cast("array<string>")
    start = F.struct(F.lit("").alias("at"), none.alias("pos"), none.alias("neg"))

    def step(s: Column, line: Column) -> Column:
        up = F.upper(line)
        content = T.strip(F.substr(line, F.locate(":", line) + 1))
        held = F.when((content != "") & (content != line), F.array(content)).otherwise(none)
        positive, negative = up.contains("POSITIVE 1") | up.contains("POSITIVE 2"), up.contains("NEGATIVE 1")
        more = ~up.contains("POSITIVE") & ~up.contains("NEGATIVE")
        to_pos = more & (s["at"] == "pos") & (F.size(s["pos"]) < 2)
        to_neg = more & (s["at"] == "neg") & (F.size(s["neg"]) < 1)
        return F.struct(
            F.when(positive, "pos").when(negative, "neg").otherwise(s["at"]).alias("at"),
            F.when(positive, F.concat(s["pos"], held)).when(to_pos, F.concat(s["pos"], F.array(line))).otherwise(s["pos"]).alias("pos"),
            F.when(~positive & negative, F.concat(s["neg"], held)).when(to_neg, F.concat(s["neg"], F.array(line))).otherwise(s["neg"]).alias("neg"),
        )

    return F.aggregate(lines, start, step, lambda s: F.struct(F.slice(s["pos"], 1, 2).alias("positives"), F.slice(s["neg"], 1, 1).alias("negatives")))


def short_answer(answer: Column, response: Column) -> Column:
    """Parsed sections, filled up by the rules where some are missing."""
    fill = lambda p: F.struct(F.slice(F.concat(p["positives"], T.rule_positives(answer)), 1, 2).alias("positives"), F.slice(F.concat(p["negatives"], F.array(T.rule_negative(answer))), 1, 1).alias("negatives"))
    return T.let(parse_short_answer(response), fill)


@query("short_answer_parse", f"SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'go ' || p_size || '|then on' WHEN 1 THEN 'go on|' || CASE p_size % 2 WHEN 0 THEN 'move ok' ELSE '(nothing)' END ELSE 'move ok|move ok' END AS positives, CASE p_size % 2 WHEN 0 THEN 'not: that' ELSE 'go the other way' END AS negatives FROM {I}")
def short_answer_parse(spark, sf_dir):
    """Sections with content, continued on the next line, and missing ones."""
    s = F.col("p_size")
    pos = F.when(s % 3 == 0, F.concat(F.lit("Positive 1: go "), s.cast("string"), F.lit("\n\n  POSITIVE 2:\n then on \nignored\n"))).when(s % 3 == 1, "positive 1:\ngo on\n").otherwise("")
    x = instructions(spark, sf_dir).select("p_partkey", short_answer(F.lit("ok"), F.concat(pos, F.when(s % 2 == 0, "NEGATIVE 1: not: that\nmore").otherwise("(nothing)"))).alias("a"))
    x = x.select("p_partkey", "a.positives", "a.negatives")
    return x.select("p_partkey", F.array_join("positives", "|").alias("positives"), F.array_join("negatives", "|").alias("negatives"))


@query("combined_split", "SELECT p_partkey, array_to_string(CASE WHEN n >= 3 THEN l[1:2] ELSE l[1:(n // 2)] END, '|') AS positives, array_to_string(CASE WHEN n >= 3 THEN l[3:3] ELSE l[(n // 2 + 1):] END, '|') AS negatives FROM (SELECT p_partkey, p_size % 5 AS n, list_transform(range(p_size % 5), lambda i: 'text ' || i) AS l FROM part)")
def combined_split(spark, sf_dir):
    """Three texts or more give two positives and a negative; fewer are halved."""
    n = (F.col("p_size") % 5).cast("int")
    texts = F.filter(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.when(i < n, F.concat(F.lit("text "), i.cast("string")))), lambda t: t.isNotNull())
    x = table(spark, sf_dir, "part").select("p_partkey", n.alias("n"), texts.alias("l"))
    half = F.floor(F.col("n") / 2).cast("int")
    positives = F.when(F.col("n") >= 3, F.slice("l", 1, 2)).otherwise(F.slice("l", F.lit(1), half))
    negatives = F.when(F.col("n") >= 3, F.slice("l", 3, 1)).otherwise(F.slice("l", half + 1, F.lit(5)))
    return x.select("p_partkey", F.array_join(positives, "|").alias("positives"), F.array_join(negatives, "|").alias("negatives"))


@query("token_pad", f"SELECT p_partkey, array_to_string(list_concat(w, list_transform(range(10), lambda i: '<pad>'))[1:10], ' ') AS padded, least(len(w), 10) AS real FROM (SELECT p_partkey, list_filter(string_split_regex(t, '\\s+'), lambda x: x <> '') AS w FROM {A})")
def token_pad(spark, sf_dir, size: int = 10):
    """Tokens cut or padded to a fixed number, and how many are real (the mask)."""
    x = answers(spark, sf_dir).select("p_partkey", T.tokens(F.col("t")).alias("w"))
    return x.select("p_partkey", F.array_join(F.slice(F.concat("w", F.array_repeat(F.lit("<pad>"), size)), 1, size), " ").alias("padded"), F.least(F.size("w"), F.lit(size)).cast("long").alias("real"))


def section_records(lines: DataFrame, key: str) -> DataFrame:
    """One row for each [section] of numbered lines: type and its k=v fields; blank and # lines don't count, a
    'convolutional' section has batch_normalize 0 unless it says otherwise. lines: key, line, text."""
    at = Window.partitionBy(key).orderBy("line")
    x = lines.where((T.strip(F.col("text")) != "") & ~F.col("text").startswith("#")).withColumn("text", T.strip(F.col("text")))
    x = x.withColumn("section", F.sum(F.when(F.col("text").startswith("["), 1).otherwise(0)).over(at))
    head = F.max(F.when(F.col("text").startswith("["), F.rtrim(F.substring_index(F.substr("text", F.lit(2)), "]", 1)))).alias("type")
    field = F.when(~F.col("text").startswith("["), F.struct("line", F.rtrim(F.split_part("text", F.lit("="), F.lit(1))).alias("k"), F.btrim(F.split_part("text", F.lit("="), F.lit(2))).alias("v")))
    rows = x.groupBy(key, "section").agg(head, F.array_sort(F.collect_list(field)).alias("f"))
    base = F.when(F.col("type") == "convolutional", F.array(F.struct(F.lit(0).alias("line"), F.lit("batch_normalize").alias("k"), F.lit("0").alias("v")))).otherwise(F.array().cast("array<struct<line:int,k:string,v:string>>"))
    every = F.concat(base, F.col("f").cast("array<struct<line:int,k:string,v:string>>"))
    last = F.filter(every, lambda a: ~F.exists(every, lambda b: (b["k"] == a["k"]) & (b["line"] > a["line"])))
    return rows.select(key, F.col("section").cast("long"), "type", F.map_from_entries(F.transform(last, lambda a: F.struct(a["k"], a["v"]))).alias("fields"))


@query("section_config_records", "SELECT page_id, unnest([1, 2, 3])::BIGINT AS section, unnest(['net', 'convolutional', 'convolutional']) AS type, unnest(['channels=3', 'batch_normalize=0,filters=' || page_id, 'batch_normalize=1,filters=32']) AS fields FROM pages")
def section_config_records(spark, sf_dir):
    """Comments, blanks around names, defaults and fields that override them."""
    text = F.concat(F.lit("# comment\n[net]\n channels = 3 \n\n[convolutional ]\nfilters="), F.col("page_id").cast("string"), F.lit("\n[convolutional]\nbatch_normalize=1\n#filters=1\nfilters=32"))
    lines = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.split(text, "\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)
    found = section_records(lines, "page_id")
    pairs_ = F.transform(F.array_sort(F.map_entries("fields")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return found.select("page_id", "section", "type", F.array_join(pairs_, ",").alias("fields"))


_PARSER = [("\\(.*?\\)", ""), ("\\[.*?\\]", ""), ("(?i)Note:.*", ""), ("(?i)Additional context:.*", ""), ("^[0-9]+\\.?\\s*", ""), ("(?i)^(Positive|Negative)\\s*Paraphrases?:", ""), ("(?i)^(Positives?|Negatives?):", "")]


def _clean_sql(x: str) -> str:
    for p, r in _PARSER:
        x = f"trim(regexp_replace({x}, '{p}', '{r}', 'g'), E' \\t')"
    return f"regexp_replace({x}, '^[\"'']|[\"'']$', '', 'g')"


_RESPONSE = "'Positive Paraphrases:' || chr(10) || '1. Head to the red ' || p_size || ' building.' || chr(10) || 'Short' || chr(10) || 'Note: ignore this line please' || chr(10) || CASE WHEN p_size % 2 = 0 THEN '(3) \"Go past the road\"' ELSE '2 [aside] Positives: fly over the river (maybe)' END || chr(10) || 'Explanation: it is a longer line' || chr(10) || 'Negatives: turn back at the tower' || chr(10) || 'Stay where you are now' || chr(10) || 'One line more than wanted'"


@query("response_lines", f"SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(r, chr(10)), lambda s: {_clean_sql('trim(s)')}), lambda s: length(s) > 10 AND NOT regexp_matches(lower(s), '^(positive|negative)') AND NOT contains(lower(s), 'note:') AND NOT contains(lower(s), 'additional context') AND NOT contains(lower(s), 'explanation:'))[1:3], '|') AS parsed FROM (SELECT p_partkey, {_RESPONSE} AS r FROM part)")
def response_lines(spark, sf_dir):
    """A response whose lines need every removal, the length test and the limit of three."""
    s, lit = F.col("p_size"), F.lit
    r = F.concat(lit("Positive Paraphrases:\n1. Head to the red "), s.cast("string"), lit(" building.\nShort\nNote: ignore this line please\n"), F.when(s % 2 == 0, '(3) "Go past the road"').otherwise("2 [aside] Positives: fly over the river (maybe)"), lit("\nExplanation: it is a longer line\nNegatives: turn back at the tower\nStay where you are now\nOne line more than wanted"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(T.parse_response(r), "|").alias("parsed"))
