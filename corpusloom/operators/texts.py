"""Scoring, verification and profiling of instruction texts. Stand-in: texts derived from part (and a paired part as prediction)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T
from .dialog import query, split_of, spread, table


def lst(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def any_in(x: str, values) -> str:
    return "(" + " OR ".join(f"contains({x}, '" + v.replace("'", "''") + "')" for v in values) + ")"


TEXT = "'[QUE] which way to the ' || p_name || '? [INS] turn ' || CASE p_size % 4 WHEN 0 THEN 'left' WHEN 1 THEN 'right' WHEN 2 THEN 'north' ELSE 'northeast' END || ' to your ' || p_size % 14 || CASE p_size % 3 WHEN 0 THEN '''o clock' WHEN 1 THEN ' o''clock' ELSE 'o''clock' END || ', grey ' || CASE p_partkey % 5 WHEN 0 THEN 'building' WHEN 1 THEN 'structure' WHEN 2 THEN 'parking lot' WHEN 3 THEN 'square  house' ELSE 'road' END || ' near the road'"


def instructions(spark, sf_dir) -> DataFrame:
    pick = lambda k, n, *v: F.element_at(F.array(*[F.lit(x) for x in v]), (F.col(k) % n).cast("int") + 1)
    part = spread(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_name"))
    return part.select("p_partkey", "p_size", F.concat(F.lit("[QUE] which way to the "), "p_name", F.lit("? [INS] turn "), pick("p_size", 4, "left", "right", "north", "northeast"), F.lit(" to your "), (F.col("p_size") % 14).cast("string"), pick("p_size", 3, "'o clock", " o'clock", "o'clock"), F.lit(", grey "), pick("p_partkey", 5, "building", "structure", "parking lot", "square  house", "road"), F.lit(" near the road")).alias("t"))


I = f"(SELECT p_partkey, p_size, {TEXT} AS t FROM part)"
ANSWER = "trim(substr(t, instr(t, '[INS]') + 5))"
A = f"(SELECT p_partkey, p_size, {ANSWER} AS t FROM {I})"


def answers(spark, sf_dir) -> DataFrame:
    return instructions(spark, sf_dir).select("p_partkey", "p_size", T.answer_of(F.col("t")).alias("t"))


@query("qa_split", f"SELECT p_partkey, trim(substr(t, 6, instr(t, '[INS]') - 6)) AS question, {ANSWER} AS answer FROM {I}")
def qa_split(spark, sf_dir):
    return instructions(spark, sf_dir).select("p_partkey", T.question_of(F.col("t")).alias("question"), T.answer_of(F.col("t")).alias("answer"))


@query("pre_dialog_rewrite", f"SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'Question: ' || trim(substr(t, 6, instr(t, '[INS]') - 6)) || ' Answer: ' || {ANSWER} WHEN p_size % 3 = 1 THEN 'First Instruction: ' || {ANSWER} END AS item FROM {I}")
def pre_dialog_rewrite(spark, sf_dir):
    """Both markers, only [INS], or none (dropped)."""
    x = instructions(spark, sf_dir).withColumn("t", F.when(F.col("p_size") % 3 == 0, F.col("t")).when(F.col("p_size") % 3 == 1, F.concat(F.lit("[INS]"), F.split_part(F.col("t"), F.lit("[INS]"), F.lit(2)))).otherwise("none"))
    t = F.col("t")
    item = F.when(t.contains("[QUE]") & t.contains("[INS]"), F.concat(F.lit("Question: "), T.question_of(t), F.lit(" Answer: "), T.answer_of(t))).when(t.contains("[INS]"), F.concat(F.lit("First Instruction: "), T.answer_of(t)))
    return x.select("p_partkey", item.alias("item"))


def norm_sql(x: str) -> str:
    for p, r in [(r"(\d+)''o\s+clock", r"\1 o''clock"), (r"(\d+)o''clock", r"\1 o''clock"), (r"(\d+)\s+o\s+clock", r"\1 o''clock"), (r"(\d+)\s*o''clock''", r"\1 o''clock"), (r"(^|[^0-9])(0*(?:\d|1[0-2]))\s*o''clock", r"\1\2 o''clock"), (r"(?i)\bgrey\b", "gray"), (r"\s+", " ")]:
        x = f"regexp_replace({x}, '{p}', '{r}', 'g')"
    return f"trim({x})"


N = f"(SELECT p_partkey, p_size, {norm_sql('t')} AS t FROM {A})"


@query("clock_normalize", f"SELECT p_partkey, t AS normalized FROM {N}")
def clock_normalize(spark, sf_dir):
    return answers(spark, sf_dir).select("p_partkey", T.normalize(F.col("t")).alias("normalized"))


@query("clock_hour", f"SELECT p_partkey, CASE WHEN h BETWEEN 1 AND 12 THEN h::VARCHAR END AS hour FROM (SELECT p_partkey, try_cast(regexp_extract(t, '(\\d+)\\s*o''?clock', 1) AS INT) AS h FROM {N})")
def q_clock_hour(spark, sf_dir):
    return answers(spark, sf_dir).select("p_partkey", T.clock_hour(F.col("t")).alias("hour"))


@query("clock_hour_raw", f"SELECT p_partkey, nullif(regexp_extract(t, '(\\d+)\\s*o''?clock', 1), '') AS hour FROM {A}")
def q_clock_hour_raw(spark, sf_dir):
    return answers(spark, sf_dir).select("p_partkey", T.clock_hour_raw(F.col("t")).alias("hour"))


YN = f"CASE WHEN {any_in('lower(t)', L.YES)} THEN true WHEN {any_in('lower(t)', L.NO)} THEN false END"


@query("yesno", f"SELECT p_partkey, {YN} AS answer FROM {A}")
def yesno(spark, sf_dir):
    return answers(spark, sf_dir).select("p_partkey", T.yes_no(F.col("t")).alias("answer"))


def feats_sql(t: str, category: str, lexicon: dict = L.EVAL, canonicalize: bool = True) -> str:
    terms, groups = lexicon[category]
    found = f"list_filter({lst(terms)}, lambda w: regexp_matches({t}, '\\b' || w || '\\b'))"
    if category == "directions":
        found = f"list_concat(regexp_extract_all({t}, '\\d+\\s*o''?clock'), {found})"
    if canonicalize:
        first: dict = {}
        for name, members in groups.items():
            for m in members:
                first.setdefault(m, name)
        cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in first.items())
        found = f"list_transform({found}, lambda w: CASE w {cases} ELSE w END)"
    return f"list_sort(list_distinct({found}))"


CATS = list(L.EVAL)


@query("spatial_features", "SELECT p_partkey, " + ", ".join(f"array_to_string({feats_sql('lower(t)', c)}, ',') AS {c}" for c in CATS) + f" FROM {A}")
def spatial_features(spark, sf_dir):
    return answers(spark, sf_dir).select("p_partkey", *[F.array_join(T.features(F.col("t"), c), ",").alias(c) for c in CATS])


@query("validator_features", "SELECT p_partkey, " + ", ".join(f"array_to_string({feats_sql('lower(t)', c, L.VALIDATOR, False)}, ',') AS {c}" for c in L.VALIDATOR) + f" FROM {A}")
def validator_features(spark, sf_dir):
    return answers(spark, sf_dir).select("p_partkey", *[F.array_join(T.features(F.col("t"), c, L.VALIDATOR, False), ",").alias(c) for c in L.VALIDATOR])


def scored_pairs(pairs: DataFrame) -> DataFrame:
    """key, pred, gold -> all scores; normalized texts and features are materialised once, in one projection."""
    x = pairs.withColumns({"pn": T.normalize(F.col("pred")), "gn": T.normalize(F.col("gold"))})
    x = x.withColumns({f"{s}_{c}": T.features(F.col(f"{s}n"), c) for s in "pg" for c in CATS} | {f"r_{c}": F.size(T.features(F.col("gold"), c)) > 0 for c in CATS if c != "directions"})
    p, g = (lambda c: F.col(f"p_{c}")), (lambda c: F.col(f"g_{c}"))
    x = x.withColumns({
        "direction": T.direction_score(p("directions"), g("directions")),
        "yesno": T.yesno_score(F.col("pred"), F.col("gold")),
        "attribute": T.attribute_score(p("colors"), g("colors"), p("shapes"), g("shapes")),
        "landmark": T.landmark_score(p("landmarks"), g("landmarks")),
        "movement": T.movement_score(p("movement_verbs"), g("movement_verbs")),
        "form": F.when(T.banned(F.col("pred"), F.col("gold")), 0.0).otherwise(1.0),
    })
    on = {"direction": F.lit(True), "form": F.lit(True), "yesno": T.yes_no(F.col("gold")).isNotNull(), "attribute": F.col("r_colors") | F.col("r_shapes"), "landmark": F.col("r_landmarks"), "movement": F.col("r_movement_verbs")}
    part = lambda c, w: F.when(c, w).otherwise(0.0)
    num, den = F.lit(0.0), F.lit(0.0)
    for k, c in on.items():
        num, den = num + part(c, L.WEIGHTS[k] * F.col(k)), den + part(c, F.lit(L.WEIGHTS[k]))
    return x.withColumns({"total": num / den} | {f"on_{k}": c for k, c in on.items()})


def pairs(spark, sf_dir) -> DataFrame:
    a = answers(spark, sf_dir)
    n = F.broadcast(a.agg(F.count(F.lit(1)).alias("n")))
    other = a.select(F.col("p_partkey").alias("j"), F.col("t").alias("pred"))
    return a.crossJoin(n).withColumn("j", (F.col("p_partkey") * 7 + 3) % F.col("n")).join(other, "j").select("p_partkey", "pred", F.col("t").alias("gold"))


PAIR = f"(SELECT a.p_partkey, b.t AS pred, a.t AS gold FROM {A} a JOIN {A} b ON b.p_partkey = (a.p_partkey * 7 + 3) % (SELECT count(*) FROM part))"


def groups_sql(groups: dict) -> str:
    return "[" + ", ".join(lst(g) for g in groups.values()) + "]"


def _score_sql() -> str:
    f = ", ".join(f"{feats_sql(f'lower({norm_sql(c)})', k)} AS {s}_{k}" for s, c in (("p", "pred"), ("g", "gold")) for k in CATS)
    hours = lambda a: f"list_sort(list_distinct(list_filter(list_transform({a}, lambda d: try_cast(regexp_extract(d, '(\\d+)\\s*o''?clock', 1) AS INT)), lambda h: h BETWEEN 1 AND 12)))"
    near = lambda p, gs: f"len(list_filter({gs}, lambda s: list_contains(s, g) AND len(list_filter({p}, lambda q: len(list_filter(s, lambda y: contains(q, y))) > 0)) > 0)) > 0"
    direction = f"CASE WHEN len(g_directions) = 0 AND len(p_directions) = 0 THEN 1.0 WHEN len(g_directions) = 0 OR len(p_directions) = 0 THEN 0.0 ELSE greatest(CASE WHEN len({hours('g_directions')}) > 0 AND {hours('g_directions')} = {hours('p_directions')} THEN 1.0 ELSE 0.0 END, len(list_filter(g_directions, lambda g: list_contains(p_directions, g) OR {near('p_directions', groups_sql(L.DIRECTION_GROUPS))})) / len(g_directions)::DOUBLE) END"
    part = lambda c: f"CASE WHEN len(g_{c}) > 0 THEN len(list_intersect(p_{c}, g_{c})) / len(g_{c})::DOUBLE END"
    attribute = f"coalesce((({part('colors')}) + ({part('shapes')})) / 2, {part('colors')}, {part('shapes')}, 0.0)"
    pl, gl = "array_to_string(p_landmarks, ' ')", "array_to_string(g_landmarks, ' ')"
    landmark = f"CASE WHEN len(g_landmarks) = 0 OR len(p_landmarks) = 0 THEN 0.0 WHEN replace({pl}, ' ', '') = replace({gl}, ' ', '') THEN 1.0 WHEN contains({pl}, {gl}) OR contains({gl}, {pl}) THEN 0.8 ELSE len(list_filter(g_landmarks, lambda g: {near('p_landmarks', groups_sql(L.LANDMARK_GROUPS))})) / len(g_landmarks)::DOUBLE END"
    movement = f"CASE WHEN len(g_movement_verbs) = 0 OR len(p_movement_verbs) = 0 THEN 0.0 ELSE len(list_filter(g_movement_verbs, lambda g: list_contains(p_movement_verbs, g) OR coalesce(list_has_any(list_filter({groups_sql(L.MOVEMENT_GROUPS)}, lambda s: list_contains(s, g))[1], p_movement_verbs), false))) / len(g_movement_verbs)::DOUBLE END"
    yn = lambda c: YN.replace("lower(t)", f"lower({c})")
    form = " OR ".join(f"(contains(lower(pred), '{b.lower()}') AND NOT contains(lower(gold), '{b.lower()}'))" for b in L.BANNED)
    on = {"yesno": f"({yn('gold')}) IS NOT NULL", "attribute": f"len({feats_sql('lower(gold)', 'colors')}) + len({feats_sql('lower(gold)', 'shapes')}) > 0", "landmark": f"len({feats_sql('lower(gold)', 'landmarks')}) > 0", "movement": f"len({feats_sql('lower(gold)', 'movement_verbs')}) > 0"}
    ons = ", ".join(f"{c} AS on_{k}" for k, c in on.items())
    scores = f"SELECT *, {direction} AS direction, CASE WHEN ({yn('pred')}) = ({yn('gold')}) THEN 1.0 ELSE 0.0 END AS yesno, {attribute} AS attribute, {landmark} AS landmark, {movement} AS movement, CASE WHEN {form} THEN 0.0 ELSE 1.0 END AS form, {ons} FROM (SELECT *, {f} FROM {PAIR})"
    w = L.WEIGHTS
    num = "direction * 1.0 + form * 0.2" + "".join(f" + CASE WHEN on_{k} THEN {w[k]} * {k} ELSE 0 END" for k in on)
    den = "1.2" + "".join(f" + CASE WHEN on_{k} THEN {w[k]} ELSE 0 END" for k in on)
    return f"(SELECT *, ({num})::DOUBLE / ({den})::DOUBLE AS total FROM ({scores}))"


SCORES = _score_sql()
KINDS = ("direction", "yesno", "attribute", "landmark", "movement", "form", "total")


@query("composite_score", "SELECT p_partkey, " + ", ".join(f"round({k}::DOUBLE, 6) AS {k}" for k in KINDS) + f" FROM {SCORES}")
def composite_score(spark, sf_dir):
    return scored_pairs(pairs(spark, sf_dir)).select("p_partkey", *[F.round(k, 6).alias(k) for k in KINDS])


@query("conditional_metric_avg", "SELECT " + ", ".join(f"round(coalesce(avg({k}::DOUBLE) FILTER ({'on_' + k if k in ('yesno', 'attribute', 'landmark', 'movement') else 'true'}), 0), 6) AS {k}" for k in KINDS) + f" FROM {SCORES}")
def conditional_metric_avg(spark, sf_dir):
    """Each score is averaged over the rows whose gold text has what it measures."""
    x = scored_pairs(pairs(spark, sf_dir))
    return x.agg(*[F.round(F.coalesce(F.avg(F.when(F.col(f"on_{k}"), F.col(k)) if k != "total" else F.col(k)), F.lit(0.0)), 6).alias(k) for k in KINDS])


@query("task_router", "SELECT p_partkey, CASE WHEN " + " OR ".join(f"regexp_matches(lower(t), '{p}')" for p in L.QUESTION_CUES) + f" THEN 'attribute_complete' ELSE 'precision_short' END AS task, CASE WHEN {any_in('lower(t)', L.ATTRIBUTE_CUES)} OR {any_in('lower(t)', [*L.COLORS, *L.SHAPES])} THEN 'attribute_complete' ELSE 'precision_short' END AS oracle_task FROM {A}")
def task_router(spark, sf_dir):
    return answers(spark, sf_dir).select("p_partkey", T.task_type(F.col("t")).alias("task"), T.task_type_oracle(F.col("t"), F.col("t")).alias("oracle_task"))


@query("hint_prefix", "SELECT p_partkey, '" + L.HINTS["spatial"].replace("'", "''") + f" ' || t AS hinted, t AS stripped FROM {A}")
def hint_prefix(spark, sf_dir):
    hint = L.HINTS["spatial"] + " "
    x = answers(spark, sf_dir).withColumn("hinted", F.concat(F.lit(hint), "t"))
    return x.select("p_partkey", "hinted", F.when(F.col("hinted").startswith(hint), F.substr("hinted", F.lit(len(hint) + 1))).otherwise(F.col("hinted")).alias("stripped"))


@query("truncate_preview", f"SELECT p_partkey, CASE WHEN length(t) <= 30 THEN t ELSE left(t, 27) || '...' END AS preview FROM {A}")
def truncate_preview(spark, sf_dir):
    return answers(spark, sf_dir).select("p_partkey", T.preview(F.col("t"), 30).alias("preview"))


_pos = "CASE " + " ".join(f"WHEN contains(upper(t), '{k}') THEN {lst(v)}" for k, v in L.POSITIVES.items()) + " ELSE [] END"


@query("rule_positives", f"SELECT p_partkey, array_to_string(list_concat({_pos}, CASE WHEN contains(upper(t), 'O''CLOCK') OR contains(upper(t), 'OCLOCK') THEN ['head towards ' || lower(t), 'move to ' || lower(t)] ELSE [] END, ['move ' || lower(t), 'move ' || lower(t)])[1:2], '|') AS positives FROM (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN substr(t, 6) ELSE 'ok ' || substr(t, 18) END AS t FROM {A})")
def q_rule_positives(spark, sf_dir):
    return _short(spark, sf_dir).select("p_partkey", F.array_join(T.rule_positives(F.col("t")), "|").alias("positives"))


def _short(spark, sf_dir) -> DataFrame:
    return answers(spark, sf_dir).select("p_partkey", F.when(F.col("p_size") % 2 == 0, F.substr("t", F.lit(6))).otherwise(F.concat(F.lit("ok "), F.substr("t", F.lit(18)))).alias("t"))


@query("rule_negatives", "SELECT p_partkey, CASE " + " ".join(f"WHEN contains(upper(t), '{k}') THEN 'go {v}'" for k, v in L.OPPOSITES.items()) + f" WHEN contains(upper(t), 'O''CLOCK') THEN 'go in the opposite direction' ELSE 'go the other way' END AS negative FROM (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN substr(t, 6) ELSE 'ok ' || substr(t, 18) END AS t FROM {A})")
def q_rule_negatives(spark, sf_dir):
    return _short(spark, sf_dir).select("p_partkey", T.rule_negative(F.col("t")).alias("negative"))


@query("simple_paraphrase", "SELECT p_partkey, CASE " + " ".join(f"WHEN contains(lower(t), '{a}') THEN regexp_replace(t, '(?i){a}', '{b.replace(chr(39), chr(39) * 2)}', 'g')" for a, b in L.SUBSTITUTIONS.items()) + f" ELSE t END AS paraphrase FROM {A}")
def q_simple_paraphrase(spark, sf_dir):
    return answers(spark, sf_dir).select("p_partkey", T.simple_paraphrase(F.col("t")).alias("paraphrase"))


@query("category_routing", f"SELECT p_partkey, CASE WHEN regexp_matches(lower(t), '\\d+\\s*o''?clock') THEN 'clock_directions' WHEN {any_in('lower(t)', ['north', 'south', 'east', 'west'])} THEN 'cardinal_directions' WHEN {any_in('lower(t)', ['next to', 'in front of', 'behind', 'above', 'below', 'near', 'across from'])} THEN 'spatial_relations' ELSE 'other' END AS category FROM (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN t ELSE regexp_replace(t, ' to your .*clock', '') END AS t FROM {A})")
def category_routing(spark, sf_dir):
    x = answers(spark, sf_dir).select("p_partkey", F.when(F.col("p_size") % 5 == 0, F.col("t")).otherwise(F.regexp_replace("t", " to your .*clock", "")).alias("t"))
    return x.select("p_partkey", F.coalesce(T.category(F.col("t")), F.lit("other")).alias("category"))


@query("few_shot_topk", f"SELECT category, p_partkey FROM (SELECT p_partkey, len(string_split_regex(t, '\\s+')) AS words, CASE WHEN contains(t, 'northeast') THEN 'b' ELSE 'a' END AS category FROM {A}) WHERE words BETWEEN 8 AND 25 QUALIFY row_number() OVER (PARTITION BY category ORDER BY words, p_partkey) <= 3")
def few_shot_topk(spark, sf_dir):
    from pyspark.sql import Window

    x = answers(spark, sf_dir).select("p_partkey", F.size(T.tokens(F.col("t"))).alias("words"), F.when(F.col("t").contains("northeast"), "b").otherwise("a").alias("category")).where("words between 8 and 25")
    return x.withColumn("r", F.row_number().over(Window.partitionBy("category").orderBy("words", "p_partkey"))).where("r <= 3").select("category", "p_partkey")


@query("pattern_freq", " UNION ALL ".join(f"SELECT '{k.replace(chr(39), chr(39) * 2)}' AS pattern, count(*) AS n FROM {A} WHERE regexp_matches(lower(t), '{p.replace(chr(39), chr(39) * 2)}') HAVING count(*) >= 2" for k, p in L.PATTERNS.items()))
def pattern_freq(spark, sf_dir):
    """One pass: a conditional count for each pattern, then a row for each."""
    counts = answers(spark, sf_dir).agg(*[F.count_if(F.lower("t").rlike(p)).alias(f"c{i}") for i, p in enumerate(L.PATTERNS.values())])
    rows = F.array(*[F.struct(F.lit(k).alias("pattern"), F.col(f"c{i}").alias("n")) for i, k in enumerate(L.PATTERNS)])
    return counts.select(F.explode(rows).alias("r")).select("r.*").where("n >= 2")


@query("vocab_topk", f"WITH w AS (SELECT unnest(string_split_regex(lower(t), '\\s+')) AS word FROM {A}), v AS (" + " UNION ALL ".join(f"SELECT '{c}' AS category, unnest({lst(t)}) AS word" for c, t in L.VOCABULARY.items()) + ") SELECT category, word, count(*) AS n FROM w JOIN v USING (word) GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY category ORDER BY n DESC, word) <= 10")
def vocab_topk(spark, sf_dir):
    from pyspark.sql import Window

    vocabulary = spark.createDataFrame([(c, w) for c, ws in L.VOCABULARY.items() for w in ws], "category string, word string")
    n = answers(spark, sf_dir).select(F.explode(T.tokens(F.lower("t"))).alias("word")).join(F.broadcast(vocabulary), "word").groupBy("category", "word").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("r", F.row_number().over(Window.partitionBy("category").orderBy(F.desc("n"), "word"))).where("r <= 10").drop("r")


@query("starter_ngrams", f"WITH s AS (SELECT string_split_regex(t, '\\s+') AS w FROM {A}), g AS (SELECT array_to_string(w[1:2], ' ') AS gram FROM s UNION ALL SELECT array_to_string(w[1:3], ' ') FROM s) SELECT gram, count(*) AS n FROM g GROUP BY 1 HAVING count(*) >= 3 ORDER BY n DESC, gram LIMIT 15")
def starter_ngrams(spark, sf_dir):
    w = answers(spark, sf_dir).select(T.tokens(F.col("t")).alias("w"))
    grams = w.select(F.explode(F.array(*[F.array_join(F.slice("w", 1, k), " ") for k in (2, 3)])).alias("gram"))
    return grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n >= 3").orderBy(F.desc("n"), "gram").limit(15)


@query("spatial_tokens", f"SELECT DISTINCT unnest(regexp_extract_all(lower(t), '\\d+\\s*o''?clock|north\\w*|left|right')) AS token FROM {A}")
def spatial_tokens(spark, sf_dir):
    return answers(spark, sf_dir).select(F.explode(F.regexp_extract_all(F.lower("t"), F.lit("\\d+\\s*o'?clock|north\\w*|left|right"), 0)).alias("token")).distinct()


@query("indicator_counts", f"SELECT count(*) FILTER (contains(lower(t), 'clock')) AS clock, count(*) FILTER (contains(lower(t), 'building')) AS building, count(*) FILTER (length(t) < 50) AS short FROM {A}")
def indicator_counts(spark, sf_dir):
    t = F.lower("t")
    return answers(spark, sf_dir).agg(F.count_if(t.contains("clock")).alias("clock"), F.count_if(t.contains("building")).alias("building"), F.count_if(F.length("t") < 50).alias("short"))


@query("llm_response_parse", f"SELECT p_partkey, trim(regexp_replace(t, '\\(.*?\\)|\\[.*?\\]', '', 'g')) AS parsed FROM {A}")
def llm_response_parse(spark, sf_dir):
    """A generated response around each answer; only the answer survives the parser."""
    response = F.concat(F.lit("Positive Paraphrases:\n1. "), "t", F.lit("\nShort\nNote: ignore this line please\n(aside)"))
    return answers(spark, sf_dir).select("p_partkey", F.array_join(T.parse_response(response), "|").alias("parsed"))


#: Paraphrases as verified: the first p_size % 4 of three positives, the first p_size % 3 of two negatives, none where p_size % 11 = 0.
def paraphrased(spark, sf_dir) -> DataFrame:
    pos, neg = T.strings(["head to the red building", "go on past the road", "fly on"]), T.strings(["turn back", "stop here"])
    s = F.col("p_size").cast("int")
    x = table(spark, sf_dir, "part").select("p_partkey", split_of(F.col("p_partkey")).alias("split"), "p_size", F.when(s % 11 != 0, F.struct(F.slice(pos, F.lit(1), s % 4).alias("positives"), F.slice(neg, F.lit(1), s % 3).alias("negatives"))).alias("p"))
    return x.withColumns({"np": F.coalesce(F.size("p.positives"), F.lit(0)), "nn": F.coalesce(F.size("p.negatives"), F.lit(0))})


V = "(SELECT p_partkey, CASE p_partkey % 10 WHEN 8 THEN 'val_seen' WHEN 9 THEN 'val_unseen' ELSE 'train' END AS split, p_size, CASE WHEN p_size % 11 = 0 THEN NULL ELSE p_size % 4 END AS np0, CASE WHEN p_size % 11 = 0 THEN 0 ELSE p_size % 4 END AS np, CASE WHEN p_size % 11 = 0 THEN 0 ELSE p_size % 3 END AS nn FROM part)"


@query("verify_counts", f"SELECT coalesce(split, 'all') AS split, count(*) AS turns, count(np0) AS paraphrased, sum(np)::BIGINT AS positives, sum(nn)::BIGINT AS negatives, count(*) FILTER (np >= 2 AND nn >= 1) AS perfect, count(*) FILTER (np + nn > 0 AND NOT (np >= 2 AND nn >= 1)) AS partial, count(*) FILTER (np + nn = 0) AS failed, round(coalesce(count(np0) * 1.0 / nullif(count(*), 0), 0), 6) AS coverage FROM {V} GROUP BY ROLLUP (split)")
def verify_counts(spark, sf_dir):
    perfect = (F.col("np") >= 2) & (F.col("nn") >= 1)
    some = F.col("np") + F.col("nn") > 0
    out = paraphrased(spark, sf_dir).rollup("split").agg(F.count(F.lit(1)).alias("turns"), F.count("p").alias("paraphrased"), F.sum("np").alias("positives"), F.sum("nn").alias("negatives"), F.count_if(perfect).alias("perfect"), F.count_if(some & ~perfect).alias("partial"), F.count_if(~some).alias("failed"))
    return out.withColumns({"split": F.coalesce("split", F.lit("all")), "coverage": F.round(F.coalesce(F.try_divide(F.col("paraphrased").cast("double"), F.col("turns")), F.lit(0.0)), 6)})


@query("verify_issues", f"WITH i AS (SELECT split, p_partkey, unnest(list_filter([CASE WHEN np0 IS NULL THEN 'missing' END, CASE WHEN np0 IS NOT NULL AND np < 2 THEN 'few_positives' END, CASE WHEN np0 IS NOT NULL AND nn < 1 THEN 'no_negative' END], lambda x: x IS NOT NULL)) AS issue FROM {V}) SELECT split, issue, count(*) AS n, array_to_string(list(p_partkey ORDER BY p_partkey)[1:3], ',') AS examples FROM i GROUP BY 1, 2")
def verify_issues(spark, sf_dir):
    """Issues by type; examples come from a window limited to three rows, so no group is collected."""
    from pyspark.sql import Window

    kinds = F.array(F.when(F.col("p").isNull(), "missing"), F.when(F.col("p").isNotNull() & (F.col("np") < 2), "few_positives"), F.when(F.col("p").isNotNull() & (F.col("nn") < 1), "no_negative"))
    i = paraphrased(spark, sf_dir).select("split", "p_partkey", F.explode(F.filter(kinds, lambda x: x.isNotNull())).alias("issue"))
    n = i.groupBy("split", "issue").agg(F.count(F.lit(1)).alias("n"))
    top = i.withColumn("r", F.row_number().over(Window.partitionBy("split", "issue").orderBy("p_partkey"))).where("r <= 3").groupBy("split", "issue").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p_partkey")), lambda k: k.cast("string")), ",").alias("examples"))
    return n.join(top, ["split", "issue"])


@query("structure_issues", f"SELECT p_partkey, np::BIGINT AS np, nn::BIGINT AS nn FROM {V} WHERE np0 IS NOT NULL AND (np <> 2 OR nn <> 1)")
def structure_issues(spark, sf_dir):
    return paraphrased(spark, sf_dir).where("p is not null and (np <> 2 or nn <> 1)").select("p_partkey", F.col("np").cast("long"), F.col("nn").cast("long"))


@query("short_answers", "SELECT conv_id, turn FROM conversations WHERE turn > 0 AND length(trim(text)) < 50 AND len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) >= 3")
def short_answers(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where((F.col("turn") > 0) & (F.length(F.btrim("text")) < 50) & (F.size(T.tokens(F.col("text"))) >= 3)).select("conv_id", "turn")


@query("validation_rules", "SELECT p_partkey, e > 0.5 AND (d > 0.7 OR l > 0.5 OR (e + d + l) / 3 > 0.6) AS positive_ok, e > 0.3 AND e < 0.92 AND (d < 0.7 OR l < 0.7) AS negative_ok FROM (SELECT p_partkey, (p_partkey * 37 % 100) / 100.0::DOUBLE AS e, (p_partkey * 53 % 100) / 100.0::DOUBLE AS d, (p_partkey * 71 % 100) / 100.0::DOUBLE AS l FROM part)")
def validation_rules(spark, sf_dir):
    v = lambda k: (F.col("p_partkey") * k % 100) / 100.0
    x = table(spark, sf_dir, "part").select("p_partkey", v(37).alias("e"), v(53).alias("d"), v(71).alias("l"))
    return x.selectExpr("p_partkey", "e > 0.5 AND (d > 0.7 OR l > 0.5 OR (e + d + l) / 3 > 0.6) AS positive_ok", "e > 0.3 AND e < 0.92 AND (d < 0.7 OR l < 0.7) AS negative_ok")


@query("set_changes", f"SELECT p_partkey, array_to_string(list_sort(list_filter(g, lambda x: NOT list_contains(p, x))), ',') AS removed, array_to_string(list_sort(list_filter(p, lambda x: NOT list_contains(g, x))), ',') AS added FROM (SELECT p_partkey, {feats_sql('lower(pred)', 'directions')} AS p, {feats_sql('lower(gold)', 'directions')} AS g FROM {PAIR})")
def set_changes(spark, sf_dir):
    x = pairs(spark, sf_dir).select("p_partkey", T.features(F.col("pred"), "directions").alias("p"), T.features(F.col("gold"), "directions").alias("g"))
    diff = lambda a, b: F.array_join(F.array_sort(F.array_except(a, b)), ",")
    return x.select("p_partkey", diff("g", "p").alias("removed"), diff("p", "g").alias("added"))


@query("phrase_reuse_histogram", "SELECT uses, count(*) AS phrases FROM (SELECT lower(trim(text)) AS k, count(*) AS uses FROM documents GROUP BY 1) GROUP BY 1")
def phrase_reuse_histogram(spark, sf_dir):
    uses = table(spark, sf_dir, "documents").groupBy(F.lower(F.btrim("text")).alias("k")).agg(F.count(F.lit(1)).alias("uses"))
    return uses.groupBy("uses").agg(F.count(F.lit(1)).alias("phrases"))
