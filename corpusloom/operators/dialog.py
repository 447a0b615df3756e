"""Episodes and turns: flattening, histories, sub-trajectories, splits, overlays. Stand-ins: conversations (episode = conv_id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer partitions than there are cores is dealt to all of them, for work that costs much a row; others stay."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def split_of(key: Column) -> Column:
    return F.when(F.pmod(key, F.lit(10)) == 8, "val_seen").when(F.pmod(key, F.lit(10)) == 9, "val_unseen").otherwise("train")


SPLIT = "CASE {0} % 10 WHEN 8 THEN 'val_seen' WHEN 9 THEN 'val_unseen' ELSE 'train' END"


def by_turn():
    return Window.partitionBy("conv_id").orderBy("turn")


def flatten_turns(talk: DataFrame) -> DataFrame:
    """Turn rows with question, answer and the episode's first instruction; the first turn of each is dropped."""
    whole = by_turn().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.first(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(whole)
    return talk.select("conv_id", "turn", F.lag("text").over(by_turn()).alias("question"), F.col("text").alias("answer"), first.alias("first_instruction")).where("turn > 0")


@query("turn_flatten", "SELECT * FROM (SELECT conv_id, turn, lag(text) OVER w AS question, text AS answer, first_value(CASE WHEN role='user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS first_instruction FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE turn > 0")
def turn_flatten(spark, sf_dir):
    return flatten_turns(table(spark, sf_dir, "conversations"))


def dialog_context(talk: DataFrame, keep: int = 3) -> DataFrame:
    """The last `keep` history items and the question, joined by blanks."""
    last = by_turn().rowsBetween(-keep, -1)
    return talk.select("conv_id", "turn", F.concat_ws(" ", F.collect_list("text").over(last), F.concat(F.lit("Question: "), "text")).alias("context"))


@query("dialog_context", "SELECT conv_id, turn, concat_ws(' ', array_to_string(nullif(list(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), []), ' '), 'Question: ' || text) AS context FROM conversations")
def q_dialog_context(spark, sf_dir):
    return dialog_context(table(spark, sf_dir, "conversations"))


@query("prev_observations", "SELECT conv_id, turn, md5(coalesce(array_to_string(list(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '|'), '')) AS history_md5 FROM conversations")
def prev_observations(spark, sf_dir):
    before = by_turn().rowsBetween(Window.unboundedPreceding, -1)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(F.array_join(F.collect_list("text").over(before), "|")).alias("history_md5"))


@query("episode_ids", "SELECT doc_id, source || '_' || row_number() OVER (PARTITION BY source ORDER BY doc_id) AS episode_id FROM documents")
def episode_ids(spark, sf_dir):
    ranked = ranks(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", "source")
    return ranked.select("doc_id", F.concat("source", F.lit("_"), (F.col("rank") + 1).cast("string")).alias("episode_id"))


def segment_episodes(rows: DataFrame, group: str, order: str, length: str) -> DataFrame:
    """Headers found by following pointers: the row after a header is that many rows on. One fold over each group's lengths."""
    seq = rows.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(order, length))).alias("x"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("heads"), F.lit(0).alias("i"))
    step = lambda s, r: F.struct(F.when(s["i"] == s["at"], s["at"] + F.greatest(r[length].cast("int"), F.lit(1))).otherwise(s["at"]).alias("at"), F.when(s["i"] == s["at"], F.concat(s["heads"], F.array(s["i"]))).otherwise(s["heads"]).alias("heads"), (s["i"] + 1).alias("i"))
    return seq.select(group, F.posexplode(F.aggregate("x", start, step)["heads"]).alias("episode", "head"))


@query("episode_segments", """WITH RECURSIVE r AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, greatest(o_orderkey % 4, 1) AS n FROM orders),
 h AS (SELECT o_custkey, 0::BIGINT AS episode, 0::BIGINT AS head FROM r WHERE i = 0 UNION ALL SELECT h.o_custkey, h.episode + 1, h.head + r.n FROM h JOIN r ON r.o_custkey = h.o_custkey AND r.i = h.head WHERE EXISTS (SELECT 1 FROM r r2 WHERE r2.o_custkey = h.o_custkey AND r2.i = h.head + r.n))
 SELECT o_custkey, episode, head FROM h""")
def episode_segments(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderkey") % 4).alias("n"))
    return segment_episodes(orders, "o_custkey", "o_orderkey", "n").select("o_custkey", F.col("episode").cast("long"), F.col("head").cast("long"))


def patterns(n: Column, most: int = 3) -> Column:
    """Turn subsets of an episode of n turns, in order of definition: skip one, skip two, every second, three, two."""
    last = n - 1
    evens = F.sequence(F.lit(0), last, F.lit(2))
    skip = lambda k: F.filter(F.sequence(F.lit(0), last), lambda i: i != k)
    fixed = lambda *a: F.array(*[F.array(*[F.lit(x) for x in p]) for p in a])
    many = F.array_distinct(F.array(skip(1), skip(2), evens, F.array(F.lit(0), F.floor(n / 2).cast("int"), last), F.array(F.lit(0), last)))
    return F.slice(F.when(n < 3, F.array().cast("array<array<int>>")).when(n == 3, fixed([0, 2])).when(n == 4, fixed([0, 1, 3], [0, 2, 3], [0, 3])).otherwise(many), 1, most)


def sub_trajectories(talk: DataFrame, most: int = 3) -> DataFrame:
    """Augmented episodes: id, pattern and its turns renumbered, each with the history of the pattern's earlier turns."""
    eps = talk.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("turns")).withColumn("n", F.size("turns"))
    out = eps.select("conv_id", "turns", F.posexplode(patterns(F.col("n"), most)).alias("pattern_no", "pattern"))
    return out.withColumn("aug_id", F.concat(F.col("conv_id").cast("string"), F.lit("aug_pattern_"), F.col("pattern_no").cast("string")))


X1 = """WITH e AS (SELECT conv_id, list(text ORDER BY turn) AS t, count(*) AS n FROM conversations GROUP BY conv_id),
p AS (SELECT *, CASE WHEN n < 3 THEN [] WHEN n = 3 THEN [[0,2]] WHEN n = 4 THEN [[0,1,3],[0,2,3],[0,3]] ELSE [list_filter(range(n), lambda i: i <> 1), list_filter(range(n), lambda i: i <> 2), range(0, n, 2), [0, n // 2, n - 1], [0, n - 1]] END AS ps FROM e),
x AS (SELECT conv_id, t, unnest(ps) AS pattern, generate_subscripts(ps, 1) AS k FROM p),
d AS (SELECT conv_id, any_value(t) AS t, pattern, min(k) AS k FROM x GROUP BY conv_id, pattern),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY k) - 1 AS pattern_no FROM d QUALIFY pattern_no < 3) """


@query("sub_trajectories", X1 + "SELECT conv_id, conv_id || 'aug_pattern_' || pattern_no AS aug_id, array_to_string(pattern, ',') AS pattern FROM r")
def q_sub_trajectories(spark, sf_dir):
    return sub_trajectories(table(spark, sf_dir, "conversations")).select("conv_id", "aug_id", F.array_join(F.transform("pattern", lambda i: i.cast("string")), ",").alias("pattern"))


@query("sub_trajectory_turns", X1 + ", u AS (SELECT conv_id, pattern_no, t, pattern, generate_subscripts(pattern, 1) - 1 AS turn_id, unnest(pattern) AS old_turn FROM r) SELECT conv_id || 'aug_pattern_' || pattern_no AS aug_id, turn_id, old_turn::BIGINT AS old_turn, md5(array_to_string(list_transform(pattern[1:turn_id], lambda i: t[i + 1]), '|')) AS history_md5 FROM u")
def sub_trajectory_turns(spark, sf_dir):
    aug = sub_trajectories(table(spark, sf_dir, "conversations"))
    x = aug.select("aug_id", "turns", "pattern", F.posexplode("pattern").alias("turn_id", "old"))
    history = F.transform(F.slice("pattern", F.lit(1), F.col("turn_id")), lambda i: F.get("turns", i)["text"])
    return x.select("aug_id", F.col("turn_id").cast("long"), F.col("old").cast("long").alias("old_turn"), F.md5(F.array_join(history, "|")).alias("history_md5"))


@query("trajectory_histogram", "SELECT n, count(*) AS episodes, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id) GROUP BY n")
def trajectory_histogram(spark, sf_dir):
    sizes = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("episodes"))
    return sizes.crossJoin(F.broadcast(sizes.agg(F.sum("episodes").alias("all")))).select("n", "episodes", F.round(100.0 * F.col("episodes") / F.col("all"), 6).alias("pct"))


@query("split_rollup", f"SELECT coalesce(s, 'all') AS split, count(DISTINCT conv_id) AS episodes, count(*) AS turns, round(coalesce(count(*) FILTER (role = 'assistant') * 1.0 / nullif(count(*), 0), 0), 6) AS answer_rate FROM (SELECT *, {SPLIT.format('conv_id')} AS s FROM conversations) GROUP BY ROLLUP (s)")
def split_rollup(spark, sf_dir):
    talk = table(spark, sf_dir, "conversations").withColumn("s", split_of(F.col("conv_id")))
    rate = F.coalesce(F.try_divide(F.count_if(F.col("role") == "assistant").cast("double"), F.count(F.lit(1))), F.lit(0.0))
    return talk.rollup("s").agg(F.countDistinct("conv_id").alias("episodes"), F.count(F.lit(1)).alias("turns"), F.round(rate, 6).alias("answer_rate")).select(F.coalesce("s", F.lit("all")).alias("split"), "episodes", "turns", "answer_rate")


@query("running_success", "SELECT conv_id, turn, round(avg(CASE WHEN length(text) > 200 THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), 6) AS rate FROM conversations")
def running_success(spark, sf_dir):
    so_far = by_turn().rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.round(F.avg(F.when(F.length("text") > 200, 1.0).otherwise(0.0)).over(so_far), 6).alias("rate"))


def propagate_instructions(talk: DataFrame) -> DataFrame:
    """Each turn's list of earlier texts, rebuilt from the (new) texts of the turns before it."""
    before = by_turn().rowsBetween(Window.unboundedPreceding, -1)
    return talk.select("conv_id", "turn", F.collect_list(F.concat(F.lit("[INS] "), F.upper("text"))).over(before).alias("pre_dialogs"))


@query("pre_dialog_propagate", "SELECT conv_id, turn, coalesce(len(l), 0) AS n, md5(coalesce(array_to_string(l, '|'), '')) AS pre_md5 FROM (SELECT conv_id, turn, list('[INS] ' || upper(role)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l FROM conversations)")
def pre_dialog_propagate(spark, sf_dir):
    out = propagate_instructions(table(spark, sf_dir, "conversations").withColumn("text", F.col("role")))
    return out.select("conv_id", "turn", F.size("pre_dialogs").cast("long").alias("n"), F.md5(F.array_join("pre_dialogs", "|")).alias("pre_md5"))


@query("block_partition", "SELECT o_orderkey, ntile(7) OVER (ORDER BY o_orderkey) AS block FROM orders")
def block_partition(spark, sf_dir):
    """Contiguous blocks; the first ones take the remainder. Ranks are counted in key ranges, so no task holds all rows."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey")
    return blocks(rows, "o_orderkey", 7).select("o_orderkey", F.col("block").cast("long"))


def ranks(rows: DataFrame, key: str, *group: str, bits: int = 12) -> DataFrame:
    """rows with rank (from 0) by an integer key, in each group. Rows are counted in ranges of 2^bits keys, ranges in ranges
    of ranges, so that no task holds a group's rows: the last level has a row for 2^(2 bits) keys."""
    width = lambda c: F.shiftright(c, bits)
    near, far = "_near", "_far"
    ranged = rows.withColumn(near, width(F.col(key).cast("long"))).withColumn(far, width(F.col(near)))
    sizes = ranged.groupBy(*group, far, near).agg(F.count(F.lit(1)).alias("_n"))
    before = lambda by, *part: F.sum("_n").over(Window.partitionBy(*part).orderBy(by)) - F.col("_n")
    wide = sizes.groupBy(*group, far).agg(F.sum("_n").alias("_n"))
    offsets = sizes.withColumn("_a", before(near, *group, far)).join(wide.withColumn("_b", before(far, *group) if group else before(far, F.lit(0))).drop("_n"), [*group, far]).select(*group, near, (F.col("_a") + F.col("_b")).alias("_before"))
    inner = F.row_number().over(Window.partitionBy(*group, near).orderBy(key)) - 1
    return ranged.withColumn("_i", inner).join(offsets, [*group, near]).withColumn("rank", F.col("_i") + F.col("_before")).drop(near, far, "_i", "_before")


def global_rank(rows: DataFrame, key: str) -> DataFrame:
    return ranks(rows, key)


def blocks(rows: DataFrame, key: str, n: int) -> DataFrame:
    total = rows.agg(F.count(F.lit(1)).alias("_t"))
    ranked = global_rank(rows, key).crossJoin(F.broadcast(total))
    size, rest = F.floor(F.col("_t") / n), F.col("_t") % n
    big = rest * (size + 1)
    return ranked.withColumn("block", F.when(F.col("rank") < big, F.floor(F.col("rank") / (size + 1))).otherwise(rest + F.floor(F.try_divide(F.col("rank") - big, size))) + 1).drop("_t")


@query("mod_shard", "SELECT o_orderkey, o_orderkey % 8 AS shard FROM orders WHERE o_orderkey % 8 IN (2, 5)")
def mod_shard(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.pmod("o_orderkey", F.lit(8)).alias("shard")).where(F.col("shard").isin(2, 5))


@query("fixed_sample", "SELECT o_orderkey FROM orders ORDER BY md5(o_orderkey::VARCHAR || ':42'), o_orderkey LIMIT 100")
def fixed_sample(spark, sf_dir):
    """A sample of fixed size, the same in any engine: the sample is the feature, hence the limit."""
    return table(spark, sf_dir, "orders").select("o_orderkey").orderBy(F.md5(F.concat(F.col("o_orderkey").cast("string"), F.lit(":42"))), "o_orderkey").limit(100)


@query("prefix_sample", "SELECT o_orderkey FROM orders QUALIFY row_number() OVER (ORDER BY o_orderkey) <= floor(count(*) OVER () * 0.1)")
def prefix_sample(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey")
    total = F.broadcast(rows.agg(F.count(F.lit(1)).alias("t")))
    return global_rank(rows, "o_orderkey").crossJoin(total).where(F.col("rank") < F.floor(F.col("t") * 0.1)).select("o_orderkey")


@query("overlay_results", "SELECT conv_id, turn, coalesce(u.t, c.text) AS text, u.t IS NOT NULL AS changed FROM conversations c LEFT JOIN (SELECT conv_id AS c2, turn AS t2, '[NEW] ' || text AS t FROM conversations WHERE turn % 3 = 1) u ON c2 = conv_id AND t2 = turn")
def overlay_results(spark, sf_dir):
    talk = table(spark, sf_dir, "conversations")
    update = talk.where("turn % 3 = 1").select("conv_id", "turn", F.concat(F.lit("[NEW] "), "text").alias("t"))
    return talk.join(update, ["conv_id", "turn"], "left").select("conv_id", "turn", F.coalesce("t", "text").alias("text"), F.col("t").isNotNull().alias("changed"))


@query("last_chunk_wins", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1")
def last_chunk_wins(spark, sf_dir):
    last = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by(F.struct("o_orderkey", "o_totalprice"), "o_orderkey").alias("x"))
    return last.select("o_custkey", "x.*")


@query("pad_to_fixed", "SELECT conv_id, array_to_string(list_concat(l, list_transform(range(5), lambda i: l[len(l)]))[1:5], ',') AS padded FROM (SELECT conv_id, list(role ORDER BY turn) AS l FROM conversations GROUP BY conv_id)")
def pad_to_fixed(spark, sf_dir):
    """Truncates to five, or pads with the last."""
    roles = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("x")).select("conv_id", F.transform("x", lambda r: r["role"]).alias("l"))
    return roles.select("conv_id", F.array_join(F.slice(F.concat("l", F.array_repeat(F.element_at("l", -1), 5)), 1, 5), ",").alias("padded"))


@query("linkage_equi", f"WITH p AS (SELECT conv_id, turn, md5(lower(trim(text))) AS k, {SPLIT.format('conv_id')} AS s FROM conversations) SELECT a.conv_id, a.turn, b.conv_id AS found_conv, b.turn AS found_turn FROM p a LEFT JOIN p b ON a.k = b.k AND a.turn = b.turn AND a.s = b.s QUALIFY row_number() OVER (PARTITION BY a.conv_id, a.turn ORDER BY b.conv_id, b.turn) = 1")
def linkage_equi(spark, sf_dir):
    """Links rows by full hash of the normalized answer, turn and map; the first match wins."""
    p = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(F.lower(F.btrim("text"))).alias("k"), split_of(F.col("conv_id")).alias("s"))
    best = p.groupBy("k", "turn", "s").agg(F.min(F.struct("conv_id", "turn")).alias("b")).select("k", "s", "turn", F.col("b.conv_id").alias("found_conv"), F.col("b.turn").alias("found_turn"))
    return p.join(best, ["k", "turn", "s"], "left").select("conv_id", "turn", "found_conv", "found_turn")


@query("split_leakage", f"WITH p AS (SELECT md5(text) AS k, {SPLIT.format('doc_id')} AS s FROM documents) SELECT a.s AS split, b.s AS other, count(DISTINCT a.k) AS shared FROM p a JOIN p b ON a.k = b.k AND a.s < b.s GROUP BY 1, 2")
def split_leakage(spark, sf_dir):
    """Distinct texts that stand in two splits; one row for each text, split and other split."""
    p = table(spark, sf_dir, "documents").select(F.md5("text").alias("k"), split_of(F.col("doc_id")).alias("s")).distinct()
    by = p.groupBy("k").agg(F.array_sort(F.collect_set("s")).alias("x")).where("size(x) > 1")
    pairs = by.select(F.explode("x").alias("split"), "x").select("split", F.explode(F.filter("x", lambda o: o > F.col("split"))).alias("other"))
    return pairs.groupBy("split", "other").agg(F.count(F.lit(1)).alias("shared"))


@query("section_config_parse", "SELECT page_id, sum(h) OVER (PARTITION BY page_id ORDER BY line) AS section, line, text FROM (SELECT page_id, generate_subscripts(l, 1) AS line, unnest(l) AS text, CASE WHEN starts_with(unnest(l), '[') THEN 1 ELSE 0 END AS h FROM (SELECT page_id, ['[net]', 'id=' || page_id, '[conv]', 'filters=32'] AS l FROM pages))")
def section_config_parse(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("[net]\nid="), F.col("page_id").cast("string"), F.lit("\n[conv]\nfilters=32")).alias("text"))
    return sections(pages, "page_id", "text").select("page_id", "section", F.col("line").cast("long"), "text")


def sections(configs: DataFrame, key: str, text: str) -> DataFrame:
    """Lines numbered by the section whose [header] stands before them."""
    lines = configs.select(key, F.posexplode(F.split(text, "\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)
    return lines.withColumn("section", F.sum(F.when(F.col("text").startswith("["), 1).otherwise(0)).over(Window.partitionBy(key).orderBy("line")))
