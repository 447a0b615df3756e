"""Profiles of answers and of a corpus, with oracles that state the rule: token sets, categories, reuse, totals, sections, files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T
from ..plans.scratch import scratch_path
from ..sources import corpus
from . import curation, miner, mining
from .dialog import SPLIT, X1, query, split_of, sub_trajectories, table
from .texts import A, any_in, answers, lst

#: Patterns of the tokens that a paraphrase must keep (fixed values).
SPATIAL_TOKENS = {
    "clock_positions": r"\d+\s*o'?clock",
    "cardinal_directions": r"\b(?:north|south|east|west|northeast|northwest|southeast|southwest)\b",
    "spatial_prepositions": r"\b(?:next to|in front of|behind|above|below|near|across from|over|under)\b",
    "landmarks": r"\b(?:building|structure|house|container|parking|road|field|tree|tower)\b",
}
_MORE = ("near the red building", "then go on", "behind the road and over it", "past a tall tower.", "at 3 o'clock", "in front of a house", "southwest of here")
_MORE_SQL = f"(SELECT p_partkey, p_size, CASE p_size % 8 WHEN 7 THEN 'plain words' ELSE regexp_replace(t, ' to your .*clock|north\\w*', '', 'g') || ' ' || {lst(_MORE)}[(p_size % 8 + 1)::INT] END AS t FROM {A})"


def varied(spark, sf_dir) -> DataFrame:
    """Answers whose ends fall into every category, and some into none."""
    end = F.get(T.strings(_MORE), (F.col("p_size") % 8).cast("int"))
    changed = F.concat(F.regexp_replace("t", " to your .*clock|north\\w*", ""), F.lit(" "), end)
    return answers(spark, sf_dir).withColumn("t", F.when(F.col("p_size") % 8 == 7, "plain words").otherwise(changed))


def spatial_tokens(rows: DataFrame, column: str) -> DataFrame:
    """category and token: the distinct tokens of each category."""
    low = F.lower(column)
    found = F.array(*[F.struct(F.lit(k).alias("category"), F.regexp_extract_all(low, F.lit(p), 0).alias("tokens")) for k, p in SPATIAL_TOKENS.items()])
    return rows.select(F.explode(found).alias("x")).select("x.category", F.explode("x.tokens").alias("token")).distinct()


@query("spatial_token_sets", " UNION ALL ".join(f"SELECT DISTINCT '{k}' AS category, unnest(regexp_extract_all(lower(t), '{p.replace(chr(39), chr(39) * 2)}')) AS token FROM {_MORE_SQL}" for k, p in SPATIAL_TOKENS.items()))
def spatial_token_sets(spark, sf_dir):
    return spatial_tokens(varied(spark, sf_dir), "t")


@query("category_of_answers", f"""SELECT p_partkey, CASE WHEN regexp_matches(lower(t), '\\d+\\s*o''?clock') THEN 'clock_directions' WHEN {any_in("lower(t)", ["north", "south", "east", "west"])} THEN 'cardinal_directions'
 WHEN {any_in("lower(t)", ["next to", "in front of", "behind", "above", "below", "near", "across from"])} THEN 'spatial_relations' WHEN regexp_matches(lower(t), '(red|blue|green|white|gray|grey|black|brown)\\s+(building|structure|house|container)') THEN 'landmark_descriptions'
 WHEN contains(t, '.') OR contains(lower(t), 'then') OR contains(lower(t), 'and') THEN 'complex_instructions' ELSE 'other' END AS category FROM (SELECT p_partkey, CASE WHEN p_size % 16 = 0 THEN replace(t, 'near ', '') ELSE t END AS t FROM {_MORE_SQL})""")
def category_of_answers(spark, sf_dir):
    x = varied(spark, sf_dir).withColumn("t", F.when(F.col("p_size") % 16 == 0, F.replace("t", F.lit("near "), F.lit(""))).otherwise(F.col("t")))
    return x.select("p_partkey", F.coalesce(T.category(F.col("t")), F.lit("other")).alias("category"))


def reuse(used: DataFrame, good: DataFrame, phrase: str = "phrase") -> DataFrame:
    """One row: uses, distinct phrases, most and mean uses of one, distinct good phrases, and the share of those in use."""
    counts = used.groupBy(phrase).agg(F.count(F.lit(1)).alias("uses"))
    a = counts.agg(F.sum("uses").alias("used"), F.count(F.lit(1)).alias("unique_phrases"), F.max("uses").alias("max_reuse"), F.avg("uses").alias("avg_reuse"))
    b = good.agg(F.count_distinct(phrase).alias("good_phrases"))
    return a.crossJoin(b).withColumn("diversity_ratio", F.coalesce(F.try_divide(F.col("unique_phrases"), F.col("good_phrases")), F.lit(0.0)))  # a row each


@query("phrase_reuse", f"""WITH p AS (SELECT vec_id, lower(trim(answer)) AS phrase, length(trim(answer)) >= 20 AS good FROM {mining.ANSWERS}), n AS (SELECT q.phrase FROM p JOIN p q ON q.vec_id = (p.vec_id * 7 + 3) % (SELECT count(*) FROM embeddings)),
 c AS (SELECT phrase, count(*) AS uses FROM n GROUP BY 1)
 SELECT sum(uses)::BIGINT AS used, count(*) AS unique_phrases, max(uses) AS max_reuse, round(avg(uses), 6) AS avg_reuse, (SELECT count(DISTINCT phrase) FROM p WHERE good) AS good_phrases, round(count(*) / (SELECT count(DISTINCT phrase) FROM p WHERE good)::DOUBLE, 6) AS diversity_ratio FROM c""")
def phrase_reuse(spark, sf_dir):
    """Each row's negative is its partner; good phrases are those of 20 characters."""
    p = miner.answered(spark, sf_dir, blacklist=0).select("id", mining.plain_phrase(F.col("answer")).alias("phrase"), "good")
    n = F.broadcast(p.agg(F.count(F.lit(1)).alias("n")))
    used = p.crossJoin(n).select(((F.col("id") * 7 + 3) % F.col("n")).alias("id")).join(p.select("id", "phrase"), "id")
    x = reuse(used, p.where("good"))
    return x.select("used", "unique_phrases", "max_reuse", F.round("avg_reuse", 6).alias("avg_reuse"), "good_phrases", F.round("diversity_ratio", 6).alias("diversity_ratio"))


@query("corpus_totals", X1 + f""", a AS (SELECT conv_id, conv_id::VARCHAR AS id, false AS augmented, n FROM e UNION ALL SELECT conv_id, conv_id || 'aug_pattern_' || pattern_no, true, len(pattern) FROM r)
 SELECT {SPLIT.format("conv_id")} AS split, count(*) FILTER (NOT augmented) AS original, count(*) FILTER (augmented) AS augmented, count(*) AS episodes, sum(n)::BIGINT AS turns, coalesce(sum(n) FILTER (augmented), 0)::BIGINT AS augmented_turns FROM a GROUP BY 1""")
def corpus_totals(spark, sf_dir):
    """Episodes and turns of each split, original and augmented."""
    talk = table(spark, sf_dir, "conversations")
    original = talk.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).withColumn("augmented", F.lit(False))
    made = sub_trajectories(talk).select("conv_id", F.size("pattern").cast("long").alias("n"), F.lit(True).alias("augmented"))
    x = original.select("conv_id", "n", "augmented").unionByName(made).withColumn("split", split_of(F.col("conv_id")))
    return x.groupBy("split").agg(F.count_if(~F.col("augmented")).alias("original"), F.count_if("augmented").alias("augmented"), F.count(F.lit(1)).alias("episodes"), F.sum("n").alias("turns"), F.coalesce(F.sum(F.when(F.col("augmented"), F.col("n"))), F.lit(0)).cast("long").alias("augmented_turns"))


def header(rows: DataFrame, instructions: str) -> Column:
    """The first instruction of an episode, without its marker."""
    return F.replace(rows[instructions], F.lit("[INS] "), F.lit(""))


@query("episode_header", "SELECT conv_id, replace('[INS] ' || text, '[INS] ', '') AS first_instruction FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1")
def episode_header(spark, sf_dir):
    first = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.concat(F.lit("[INS] "), F.min_by("text", "turn")).alias("instructions"))
    return first.select("conv_id", header(first, "instructions").alias("first_instruction"))


_P14 = f"(SELECT p_partkey, p_size % 3 AS turn, CASE WHEN p_size % 2 = 0 THEN t ELSE t || ' and on to the far end of the long road' END AS t, p_size % 11 = 0 OR p_size % 5 = 0 AS missing FROM {A})"


@query("short_answers_unparaphrased", f"SELECT p_partkey FROM {_P14} WHERE turn > 0 AND missing AND length(trim(t)) < 50")
def short_answers_unparaphrased(spark, sf_dir):
    """Turns after the first with a short answer that has no paraphrases yet."""
    s = F.col("p_size")
    x = answers(spark, sf_dir).select("p_partkey", (s % 3).alias("turn"), F.when(s % 2 == 0, F.col("t")).otherwise(F.concat("t", F.lit(" and on to the far end of the long road"))).alias("t"), F.when((s % 11 != 0) & (s % 5 != 0), F.struct(F.lit("a").alias("positives"))).alias("paraphrases"))
    return x.where((F.col("turn") > 0) & F.col("paraphrases").isNull() & (F.length(T.strip(F.col("t"))) < 50)).select("p_partkey")


_RESPONSE = "(SELECT p_partkey, p_size, CASE p_size % 4 WHEN 0 THEN 'Positive 1: go ' || t || chr(10) || chr(10) || '  POSITIVE 2:' || chr(10) || ' then ' || t || chr(10) || 'ignored' || chr(10) WHEN 1 THEN 'positive 1:' || chr(10) || t || chr(10) WHEN 2 THEN 'Some words: none' || chr(10) || 'Negative 1: ' || t || chr(10) || 'more' || chr(10) || 'POSITIVE 2: late' || chr(10) ELSE '' END || CASE WHEN p_size % 3 = 0 THEN 'NEGATIVE 1: not: ' || t || chr(10) || 'more' ELSE '(nothing)' END AS r FROM " + A + ")"
_SECTIONS = f"""WITH l AS (SELECT p_partkey, i, trim(x, E' \\t') AS line FROM (SELECT p_partkey, generate_subscripts(a, 1) AS i, unnest(a) AS x FROM (SELECT p_partkey, string_split(r, chr(10)) AS a FROM {_RESPONSE})) WHERE trim(x, E' \\t') <> ''),
 k AS (SELECT *, CASE WHEN contains(upper(line), 'POSITIVE 1') OR contains(upper(line), 'POSITIVE 2') THEN 'pos' WHEN contains(upper(line), 'NEGATIVE 1') THEN 'neg' END AS head FROM l),
 s AS (SELECT *, last_value(head IGNORE NULLS) OVER (PARTITION BY p_partkey ORDER BY i) AS sec FROM k),
 c AS (SELECT p_partkey, i, sec, CASE WHEN head IS NOT NULL THEN nullif(trim(substr(line, instr(line, ':') + 1), E' \\t'), CASE WHEN contains(line, ':') THEN '' ELSE line END) WHEN NOT contains(upper(line), 'POSITIVE') AND NOT contains(upper(line), 'NEGATIVE') THEN line END AS v FROM s WHERE sec IS NOT NULL)
 SELECT a.p_partkey, coalesce(array_to_string((SELECT list(v ORDER BY i) FROM c WHERE c.p_partkey = a.p_partkey AND sec = 'pos' AND v IS NOT NULL)[1:2], '|'), '') AS positives, coalesce(array_to_string((SELECT list(v ORDER BY i) FROM c WHERE c.p_partkey = a.p_partkey AND sec = 'neg' AND v IS NOT NULL)[1:1], '|'), '') AS negatives FROM {A} a"""


@query("short_answer_sections", _SECTIONS)
def short_answer_sections(spark, sf_dir):
    """Sections of responses made of the answers: with content on the line, on the next one, in another order, and none."""
    s, t, nl = F.col("p_size"), F.col("t"), F.lit("\n")
    head = F.when(s % 4 == 0, F.concat(F.lit("Positive 1: go "), t, F.lit("\n\n  POSITIVE 2:\n then "), t, F.lit("\nignored\n"))).when(s % 4 == 1, F.concat(F.lit("positive 1:\n"), t, nl))
    head = head.when(s % 4 == 2, F.concat(F.lit("Some words: none\nNegative 1: "), t, F.lit("\nmore\nPOSITIVE 2: late\n"))).otherwise("")
    r = F.concat(head, F.when(s % 3 == 0, F.concat(F.lit("NEGATIVE 1: not: "), t, F.lit("\nmore"))).otherwise("(nothing)"))
    x = answers(spark, sf_dir).select("p_partkey", curation.parse_short_answer(r).alias("a")).select("p_partkey", "a.*")
    return x.select("p_partkey", F.array_join("positives", "|").alias("positives"), F.array_join("negatives", "|").alias("negatives"))


_CONFIG = "'# comment' || chr(10) || '[net]' || chr(10) || ' channels = ' || page_id % 7 || ' ' || chr(10) || chr(10) || '[convolutional ]' || chr(10) || 'filters=' || page_id || chr(10) || CASE WHEN page_id % 2 = 0 THEN 'filters = 8' || chr(10) ELSE '#filters=9' || chr(10) END || '[convolutional]' || chr(10) || 'batch_normalize=1' || chr(10) || 'url=' || split_part(url, '=', 1)"


@query("config_sections", f"""WITH l AS (SELECT page_id, generate_subscripts(a, 1) AS i, trim(unnest(a)) AS line FROM (SELECT page_id, string_split({_CONFIG}, chr(10)) AS a FROM pages)),
 k AS (SELECT *, sum(CASE WHEN starts_with(line, '[') THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY i) AS section FROM l WHERE line <> '' AND NOT starts_with(line, '#')),
 h AS (SELECT page_id, section, rtrim(split_part(substr(line, 2), ']', 1)) AS type FROM k WHERE starts_with(line, '[')),
 f AS (SELECT page_id, section, i, rtrim(split_part(line, '=', 1)) AS name, trim(split_part(line, '=', 2)) AS value FROM k WHERE NOT starts_with(line, '[') UNION ALL SELECT page_id, section, 0, 'batch_normalize', '0' FROM h WHERE type = 'convolutional'),
 d AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY page_id, section, name ORDER BY i DESC) = 1)
 SELECT page_id, section::BIGINT AS section, type, (SELECT string_agg(name || '=' || value, ',' ORDER BY name) FROM d WHERE d.page_id = h.page_id AND d.section = h.section) AS fields FROM h""")
def config_sections(spark, sf_dir):
    """Sections of configs that are made of each page: blanks, comments, defaults, and fields that come twice."""
    c, nl = F.col("page_id"), F.lit("\n")
    text = F.concat(F.lit("# comment\n[net]\n channels = "), (c % 7).cast("string"), F.lit(" \n\n[convolutional ]\nfilters="), c.cast("string"), nl, F.when(c % 2 == 0, "filters = 8\n").otherwise("#filters=9\n"), F.lit("[convolutional]\nbatch_normalize=1\nurl="), F.split_part("url", F.lit("="), F.lit(1)))
    lines = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.split(text, "\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)
    found = curation.section_records(lines, "page_id")
    pairs = F.transform(F.array_sort(F.map_entries("fields")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return found.select("page_id", "section", "type", F.array_join(pairs, ",").alias("fields"))


@query("split_tables", f"SELECT * FROM (SELECT conv_id, turn, {SPLIT.format('conv_id')} AS split FROM conversations) WHERE split <> 'train'")
def split_tables(spark, sf_dir):
    """Splits as one partitioned table, of which two are read."""
    root = scratch_path(spark)
    table(spark, sf_dir, "conversations").withColumn("split", split_of(F.col("conv_id"))).write.partitionBy("split").parquet(root)
    return corpus.read_splits(spark, corpus.first_existing(spark, f"{root}-none", root), "val_seen", "val_unseen").select("conv_id", "turn", "split")


@query("chunked_files", "SELECT o_orderkey, o_totalprice * CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END AS o_totalprice FROM orders")
def chunked_files(spark, sf_dir):
    """A table in files of a thousand rows, to which later chunks are added: of each key the last chunk counts."""
    path = f"{corpus.split_path(scratch_path(spark), 'train')}"
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.lit(1).alias("chunk"))
    corpus.write_chunks(orders, path)
    corpus.write_chunks(orders.where("o_orderkey % 3 = 0").withColumns({"o_totalprice": F.col("o_totalprice") * 2, "chunk": F.lit(2)}), path, keep=True)
    return corpus.last_wins(spark.read.parquet(path), "o_orderkey", "chunk").select("o_orderkey", "o_totalprice")


def lexicon_counts(rows: DataFrame, column: str, terms: list[str]) -> DataFrame:
    """term and n: the rows that hold each term; all terms, also those of no row."""
    every = rows.sparkSession.createDataFrame([(t,) for t in terms], "term string")
    held = rows.select(F.explode(F.filter(T.strings(terms), lambda t: F.contains(F.lower(column), t))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return every.join(F.broadcast(held), "term", "left").select("term", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


_TERMS = sorted({*L.COLORS, *L.SHAPES, *L.LANDMARKS})


@query("lexicon_counts", f"SELECT term, count(t) AS n FROM (SELECT unnest({lst(_TERMS)}) AS term) LEFT JOIN {_MORE_SQL} ON contains(lower(t), term) GROUP BY term")
def q_lexicon_counts(spark, sf_dir):
    """The terms of three lexicons and the answers that hold them."""
    return lexicon_counts(varied(spark, sf_dir), "t", _TERMS)


