"""Schedules, order-dependent training states, losses and token metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import schedules
from ..functions.text import cosine, dot
from .dialog import ORACLE_SQL, QUERIES, query, table  # noqa: F401

P = "((epoch - {a}) / ({b} - {a}.0))"


def _lerp(a, b, x, y):
    p = f"((epoch - {a}) / ({b} - {a})::DOUBLE)"
    return f"({x} * (1 - {p}) + {y} * {p})"


SCHEDULES = f"""SELECT epoch,
 round(CASE WHEN epoch <= 112 THEN {_lerp(0, 112, 1.0, 0.7)} WHEN epoch <= 262 THEN {_lerp(112, 262, 0.7, 0.3)} WHEN epoch < 375 THEN {_lerp(262, 375, 0.3, 0.0)} ELSE 0.0 END, 6) AS curriculum,
 round(CASE WHEN epoch <= 112 THEN 10.0 WHEN epoch <= 262 THEN {_lerp(112, 262, 10.0, 7.0)} WHEN epoch < 375 THEN 7.0 WHEN epoch < 450 THEN {_lerp(375, 450, 7.0, 3.0)} ELSE 3.0 END, 6) AS contrastive,
 round(CASE WHEN epoch <= 112 THEN 0.1 WHEN epoch <= 262 THEN {_lerp(112, 262, 0.1, 0.8)} WHEN epoch < 375 THEN {_lerp(262, 375, 0.8, 1.2)} WHEN epoch < 525 THEN 0.6 WHEN epoch < 550 THEN {_lerp(525, 550, 0.6, 0.8)} ELSE 0.8 END, 6) AS ce,
 round(CASE WHEN epoch <= 112 THEN 0.8 WHEN epoch <= 262 THEN {_lerp(112, 262, 0.8, 0.3)} WHEN epoch < 375 THEN {_lerp(262, 375, 0.3, 0.05)} ELSE 0.05 END, 6) AS destination,
 round(CASE WHEN epoch <= 112 THEN 0.5 WHEN epoch <= 262 THEN {_lerp(112, 262, 0.5, 1.0)} WHEN epoch < 375 THEN {_lerp(262, 375, 1.0, 0.7)} WHEN epoch < 525 THEN {_lerp(375, 525, 0.7, 1.2)} ELSE 1.4 END, 6) AS kd
FROM (SELECT o_orderkey AS epoch FROM orders)"""


def steps(spark, sf_dir, name: str) -> DataFrame:
    """Stand-in of logged steps: the keys of orders."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias(name))


@query("weight_schedules", "SELECT epoch, curriculum::DOUBLE AS curriculum, contrastive::DOUBLE AS contrastive, ce::DOUBLE AS ce, destination::DOUBLE AS destination, kd::DOUBLE AS kd FROM (" + SCHEDULES + ")")
def weight_schedules(spark, sf_dir):
    e = steps(spark, sf_dir, "epoch")
    return e.select("epoch", *[F.round(c, 6).alias(k) for k, c in schedules.weights(F.col("epoch")).items()])


@query("linear_schedule", "SELECT o_orderkey AS epoch, round(1.0::DOUBLE + (0.2 - 1.0) * least(greatest(o_orderkey / 400.0::DOUBLE, 0.0), 1.0), 6) AS weight FROM orders")
def linear_schedule(spark, sf_dir):
    return steps(spark, sf_dir, "epoch").select("epoch", F.round(schedules.linear(F.col("epoch"), 1.0, 0.2, 400), 6).alias("weight"))


@query("lr_schedule", "SELECT step, round(CASE WHEN step < 100 THEN step / 100.0::DOUBLE WHEN step < 250 THEN greatest(0.0, 0.5 * (1.0 + cos(pi() * (step - 100) / 150.0::DOUBLE))) ELSE greatest(0.0, 0.3 * (1.0 + cos(pi() * (step - 250) / 750.0::DOUBLE))) END, 6) AS rate FROM (SELECT o_orderkey AS step FROM orders)")
def lr_schedule(spark, sf_dir):
    return steps(spark, sf_dir, "step").select("step", F.round(schedules.learning_rate(F.col("step"), 100, 1000), 6).alias("rate"))


def daily_losses(events: DataFrame) -> DataFrame:
    return events.groupBy(F.to_date("ts").alias("day")).agg(F.avg("value").alias("loss"))


DAILY = "SELECT CAST(ts AS DATE) AS day, avg(value) AS loss FROM events GROUP BY 1"


@query("adaptive_revival", f"SELECT day, round(m, 6) AS recent, n >= 2 AND m < 52 AS flag, coalesce(NOT lag(n >= 2 AND m < 52) OVER (ORDER BY day), true) AND n >= 2 AND m < 52 AS is_new FROM (SELECT day, avg(loss) OVER w AS m, count(*) OVER w AS n FROM ({DAILY}) WINDOW w AS (ORDER BY day ROWS 3 PRECEDING))")
def adaptive_revival(spark, sf_dir):
    """A flag where the mean of the last four losses is low; new where it was not set before."""
    by_day = Window.orderBy("day")  # one row a day
    w = by_day.rowsBetween(-3, 0)
    x = daily_losses(table(spark, sf_dir, "events")).select("day", F.avg("loss").over(w).alias("m"), F.count(F.lit(1)).over(w).alias("n"))
    x = x.withColumn("flag", (F.col("n") >= 2) & (F.col("m") < 52))
    return x.select("day", F.round("m", 6).alias("recent"), "flag", (F.coalesce(~F.lag("flag").over(by_day), F.lit(True)) & F.col("flag")).alias("is_new"))


def early_stopping(losses: Column, delta: float = 0.002, patience: int = 20) -> Column:
    """Fold over losses in order: best, counter and the place where patience ran out (-1: never)."""
    start = F.struct(F.lit(float("inf")).alias("best"), F.lit(0).alias("counter"), F.lit(-1).alias("stopped"), F.lit(0).alias("i"))

    def step(s, v):
        better = v < s["best"] * (1 - delta)
        counter = F.when(better, 0).otherwise(s["counter"] + 1)
        over = s["stopped"] >= 0
        return F.struct(F.when(~over & better, v).otherwise(s["best"]).alias("best"), F.when(over, s["counter"]).otherwise(counter).alias("counter"), F.when(~over & (counter >= patience), s["i"]).otherwise(s["stopped"]).alias("stopped"), (s["i"] + 1).alias("i"))

    return F.aggregate(losses, start, step)


RECURSIVE = f"WITH RECURSIVE d AS (SELECT loss, row_number() OVER (ORDER BY day) AS i FROM ({DAILY})), "


@query("early_stopping", RECURSIVE + "s AS (SELECT 0::BIGINT AS i, 1e308::DOUBLE AS best, 0::BIGINT AS counter UNION ALL SELECT d.i, CASE WHEN loss < best * 0.998 THEN loss ELSE best END, CASE WHEN loss < best * 0.998 THEN 0 ELSE counter + 1 END FROM s JOIN d ON d.i = s.i + 1) SELECT round(best, 6) AS best, counter FROM s ORDER BY i DESC LIMIT 1")
def q_early_stopping(spark, sf_dir):
    x = daily_losses(table(spark, sf_dir, "events")).agg(F.array_sort(F.collect_list(F.struct("day", "loss"))).alias("x"))
    s = early_stopping(F.transform("x", lambda r: r["loss"]), patience=10**6)
    return x.select(s.alias("s")).select(F.round("s.best", 6).alias("best"), F.col("s.counter").cast("long").alias("counter"))


@query("ema", RECURSIVE + "s AS (SELECT i, loss AS e FROM d WHERE i = 1 UNION ALL SELECT d.i, 0.9::DOUBLE * e + 0.1::DOUBLE * loss FROM s JOIN d ON d.i = s.i + 1) SELECT round(e, 6) AS ema FROM s ORDER BY i DESC LIMIT 1")
def ema(spark, sf_dir):
    x = daily_losses(table(spark, sf_dir, "events")).agg(F.array_sort(F.collect_list(F.struct("day", "loss"))).alias("x"))
    return x.select(F.round(F.aggregate("x", F.lit(None).cast("double"), lambda s, r: F.coalesce(0.9 * s + 0.1 * r["loss"], r["loss"])), 6).alias("ema"))


@query("token_accuracy", "WITH t AS (SELECT l_orderkey, list(l_linenumber % 5 ORDER BY l_linenumber) AS p, list(l_partkey % 5 ORDER BY l_linenumber) AS g FROM lineitem GROUP BY 1), r AS (SELECT list_sum(list_transform(range(len(p)), lambda i: CASE WHEN g[i + 1] <> 0 AND p[i + 1] = g[i + 1] THEN 1 ELSE 0 END)) AS c, len(list_filter(g, lambda x: x <> 0)) AS n FROM t) SELECT round(avg(c / n::DOUBLE) FILTER (n > 0), 6) AS macro, round(sum(c) / sum(n)::DOUBLE, 6) AS micro FROM r")
def token_accuracy(spark, sf_dir):
    """Padding (0) is masked; mean of the rows' accuracies, and accuracy over all tokens."""
    t = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", (F.col("l_linenumber") % 5).cast("long").alias("p"), (F.col("l_partkey") % 5).cast("long").alias("g")))).alias("x"))
    real = F.filter("x", lambda r: r["g"] != 0)
    r = t.select(F.size(F.filter(real, lambda r: r["p"] == r["g"])).alias("c"), F.size(real).alias("n"))
    return r.select(F.col("c").cast("double"), "n").agg(F.round(F.avg(F.when(F.col("n") > 0, F.col("c") / F.col("n"))), 6).alias("macro"), F.round(F.sum("c") / F.sum("n"), 6).alias("micro"))


PAIRS = "SELECT a.vec_id, a.embedding::DOUBLE[] AS x, b.embedding::DOUBLE[] AS p, c.embedding::DOUBLE[] AS n FROM embeddings a JOIN embeddings b ON b.vec_id = (a.vec_id * 7 + 3) % (SELECT count(*) FROM embeddings) JOIN embeddings c ON c.vec_id = (a.vec_id * 11 + 5) % (SELECT count(*) FROM embeddings)"


def triples(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    n = F.broadcast(e.agg(F.count(F.lit(1)).alias("t")))
    a = e.crossJoin(n).select("vec_id", F.col("embedding").alias("x"), ((F.col("vec_id") * 7 + 3) % F.col("t")).alias("j"), ((F.col("vec_id") * 11 + 5) % F.col("t")).alias("k"))
    return a.join(e.select(F.col("vec_id").alias("j"), F.col("embedding").alias("p")), "j").join(e.select(F.col("vec_id").alias("k"), F.col("embedding").alias("n")), "k")


def triplet_loss(a: Column, p: Column, n: Column, margin: float = 0.5, distance: str = "cosine") -> Column:
    if distance == "l2":
        d = lambda u, v: F.aggregate(F.zip_with(u, v, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)
    else:
        d = lambda u, v: 1 - cosine(u, v)
    return F.greatest(d(a, p) - d(a, n) + margin, F.lit(0.0))


@query("triplet_loss", f"SELECT round(avg(l) FILTER (l > 0), 6) AS mean_active, round(avg(l), 6) AS mean_all FROM (SELECT greatest(0, list_cosine_similarity(x, n) - list_cosine_similarity(x, p) + 0.5) AS l FROM ({PAIRS}))")
def q_triplet_loss(spark, sf_dir):
    loss = triples(spark, sf_dir).select(triplet_loss(F.col("x"), F.col("p"), F.col("n")).alias("l"))
    return loss.agg(F.round(F.avg(F.when(F.col("l") > 0, F.col("l"))), 6).alias("mean_active"), F.round(F.avg("l"), 6).alias("mean_all"))


@query("infonce_loss", f"SELECT round(avg(-ln(exp(list_cosine_similarity(x, p) / 0.2) / (exp(list_cosine_similarity(x, p) / 0.2) + exp(list_cosine_similarity(x, n) / 0.2)))), 6) AS loss FROM ({PAIRS})")
def infonce_loss(spark, sf_dir):
    t = triples(spark, sf_dir).select(F.exp(cosine(F.col("x"), F.col("p")) / 0.2).alias("p"), F.exp(cosine(F.col("x"), F.col("n")) / 0.2).alias("n"))
    return t.agg(F.round(F.avg(-F.log(F.col("p") / (F.col("p") + F.col("n")))), 6).alias("loss"))


@query("supcon_loss", "WITH b AS (SELECT vec_id, label, vec_id // 50 AS g, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT a.vec_id, a.label = b.label AS pos, list_inner_product(a.e, b.e) / 0.1 AS z FROM b a JOIN b ON a.g = b.g AND a.vec_id <> b.vec_id), m AS (SELECT vec_id, max(z) AS m FROM s GROUP BY 1), l AS (SELECT s.vec_id, avg(z) FILTER (pos) AS p, ln(sum(exp(z - m))) + any_value(m) AS lse FROM s JOIN m USING (vec_id) GROUP BY 1) SELECT round(avg(lse - p), 6) AS loss, count(p) AS anchors FROM l")
def supcon_loss(spark, sf_dir):
    """Within batches of 50, self left out, sums of exponentials shifted by their greatest."""
    b = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.floor(F.col("vec_id") / 50).alias("g"), F.col("embedding").alias("e"))
    o = b.select("g", F.col("vec_id").alias("v2"), F.col("label").alias("l2"), F.col("e").alias("e2"))
    s = b.join(o, "g").where("vec_id <> v2").select("vec_id", (F.col("label") == F.col("l2")).alias("pos"), (dot(F.col("e"), F.col("e2")) / 0.1).alias("z"))
    g = s.groupBy("vec_id").agg(F.avg(F.when(F.col("pos"), F.col("z"))).alias("p"), F.collect_list("z").alias("zs"), F.max("z").alias("m"))
    lse = F.log(F.aggregate("zs", F.lit(0.0), lambda t, z: t + F.exp(z - F.col("m")))) + F.col("m")
    return g.select("p", lse.alias("lse")).agg(F.round(F.avg(F.col("lse") - F.col("p")), 6).alias("loss"), F.count("p").alias("anchors"))


@query("weighted_total_loss", f"SELECT vec_id, round(0.6 * x[1] + 0.0001 * least(sqrt(list_inner_product(n, n)), 1000) + 0.05 * p[1] + 3.0 * n[1] + 1.4 * x[2], 6) AS total FROM ({PAIRS})")
def weighted_total_loss(spark, sf_dir):
    d = lambda c, i: F.col(c)[i].cast("double")
    return triples(spark, sf_dir).select("vec_id", F.round(0.6 * d("x", 0) + 0.0001 * F.least(F.sqrt(dot(F.col("n"), F.col("n"))), F.lit(1000.0)) + 0.05 * d("p", 0) + 3.0 * d("n", 0) + 1.4 * d("x", 1), 6).alias("total"))


@query("softdot_attention", f"SELECT vec_id, round((exp(a) * 1.0 + exp(b) * 2.0) / (exp(a) + exp(b)), 6) AS pooled FROM (SELECT vec_id, list_inner_product(x, p) AS a, list_inner_product(x, n) AS b FROM ({PAIRS}))")
def softdot_attention(spark, sf_dir):
    t = triples(spark, sf_dir).select("vec_id", F.exp(dot(F.col("x"), F.col("p"))).alias("a"), F.exp(dot(F.col("x"), F.col("n"))).alias("b"))
    return t.select("vec_id", F.round((F.col("a") + F.col("b") * 2.0) / (F.col("a") + F.col("b")), 6).alias("pooled"))


@query("gps_to_pixel", "SELECT p_partkey, round_even((p_size % 7 / 2.0 - 0) / 0.5, 0)::DOUBLE AS x, round_even((p_partkey % 9 / 4.0 - 0) / 0.5, 0)::DOUBLE AS y FROM part")
def gps_to_pixel(spark, sf_dir):
    """Half-even rounding."""
    pixel = lambda v: F.bround(v / 0.5)
    return table(spark, sf_dir, "part").select("p_partkey", pixel((F.col("p_size") % 7) / 2.0).alias("x"), pixel((F.col("p_partkey") % 9) / 4.0).alias("y"))


def schedule_phase(epoch: Column, planned: int = 375) -> Column:
    return F.when(epoch < int(0.3 * planned), "build").when(epoch < int(0.7 * planned), "balance").when(epoch < planned, "tune").otherwise("extended")


@query("schedule_table", "SELECT *, CASE WHEN epoch < 112 THEN 'build' WHEN epoch < 262 THEN 'balance' WHEN epoch < 375 THEN 'tune' ELSE 'extended' END AS phase FROM (SELECT epoch, curriculum::DOUBLE AS curriculum, contrastive::DOUBLE AS contrastive, ce::DOUBLE AS ce, destination::DOUBLE AS destination, kd::DOUBLE AS kd FROM (" + SCHEDULES + ")) WHERE epoch IN (0, 56, 112, 187, 262, 318, 374, 475, 2999)")
def schedule_table(spark, sf_dir, planned: int = 375, most: int = 3000):
    """All weights at those steps that are one of nine key epochs, with the name of the phase."""
    a, b = int(0.3 * planned), int(0.7 * planned)
    epochs = [0, a // 2, a, (a + b) // 2, b, (b + planned) // 2, planned - 1, planned + 100, most - 1]
    e = steps(spark, sf_dir, "epoch").where(F.col("epoch").isin(epochs))
    return e.select("epoch", *[F.round(c, 6).alias(k) for k, c in schedules.weights(F.col("epoch")).items()], schedule_phase(F.col("epoch"), planned).alias("phase"))


@query("cosine_loss", f"SELECT round(1 - avg(list_cosine_similarity(x, p)), 6) AS loss FROM ({PAIRS})")
def cosine_loss(spark, sf_dir):
    return triples(spark, sf_dir).agg(F.round(1 - F.avg(cosine(F.col("x"), F.col("p"))), 6).alias("loss"))


def normalized_mse(a: Column, b: Column) -> Column:
    """Mean squared difference of the two vectors brought to length one."""
    return (dot(a, a) / dot(a, a) + dot(b, b) / dot(b, b) - 2 * cosine(a, b)) / F.size(a)


@query("normalized_mse_loss", f"SELECT round(avg(list_sum(list_transform(range(len(x)), lambda i: power(x[i + 1] / sqrt(list_inner_product(x, x)) - p[i + 1] / sqrt(list_inner_product(p, p)), 2))) / len(x)), 6) AS loss FROM ({PAIRS})")
def normalized_mse_loss(spark, sf_dir):
    return triples(spark, sf_dir).agg(F.round(F.avg(normalized_mse(F.col("x"), F.col("p"))), 6).alias("loss"))


@query("infonce_multi_positive", f"SELECT round(avg(-ln(pos / (pos + exp(list_cosine_similarity(x, n) / 0.2) + 1e-12))), 6) AS loss FROM (SELECT x, n, (exp(list_cosine_similarity(x, p) / 0.2) + exp(list_cosine_similarity(x, list_transform(range(len(x)), lambda i: x[i + 1] + p[i + 1])) / 0.2)) / 2 AS pos FROM ({PAIRS}))")
def infonce_multi_positive(spark, sf_dir):
    """Two positives, whose exponentials are averaged, against one explicit negative."""
    second = F.zip_with("x", "p", lambda a, b: a.cast("double") + b.cast("double"))
    e = lambda c: F.exp(cosine(F.col("x"), c) / 0.2)
    t = triples(spark, sf_dir).select(((e(F.col("p")) + e(second)) / 2).alias("pos"), e(F.col("n")).alias("neg"))
    return t.agg(F.round(F.avg(-F.log(F.col("pos") / (F.col("pos") + F.col("neg") + 1e-12))), 6).alias("loss"))


def infonce_in_batch(rows: DataFrame, temperature: float = 0.2) -> DataFrame:
    """vec_id and loss; rows: vec_id, batch, x, p. Negatives are all anchors and positives of the batch but the anchor itself;
    its own positive counts among them too. Batches have a fixed size, so the join within them is bounded."""
    both = rows.select("batch", F.explode(F.array(F.struct(F.col("vec_id").alias("own"), F.col("x").alias("v")), F.struct(F.lit(None).cast("long").alias("own"), F.col("p").alias("v")))).alias("o")).select("batch", "o.*")
    z = lambda a, b: F.exp(cosine(F.col(a), F.col(b)) / temperature)
    met = rows.join(both, "batch").where(F.col("own").isNull() | (F.col("own") != F.col("vec_id")))
    total = met.groupBy("vec_id").agg(F.sum(z("x", "v")).alias("all"))
    return rows.select("vec_id", z("x", "p").alias("pos")).join(total, "vec_id").select("vec_id", (-F.log(F.col("pos") / (F.col("pos") + F.col("all") + 1e-12))).alias("loss"))


@query("infonce_in_batch", f"WITH t AS (SELECT *, vec_id // 25 AS b FROM ({PAIRS})), o AS (SELECT b, vec_id AS own, x AS v FROM t UNION ALL SELECT b, NULL, p FROM t), s AS (SELECT t.vec_id, any_value(exp(list_cosine_similarity(x, p) / 0.2)) AS pos, sum(exp(list_cosine_similarity(x, v) / 0.2)) AS neg FROM t JOIN o ON t.b = o.b AND (own IS NULL OR own <> t.vec_id) GROUP BY 1) SELECT round(avg(-ln(pos / (pos + neg + 1e-12))), 6) AS loss FROM s")
def q_infonce_in_batch(spark, sf_dir):
    t = triples(spark, sf_dir).select("vec_id", F.floor(F.col("vec_id") / 25).alias("batch"), "x", "p")
    return infonce_in_batch(t).agg(F.round(F.avg("loss"), 6).alias("loss"))


LOSSES = {"triplet": lambda x, p, n: triplet_loss(x, p, n), "triplet_l2": lambda x, p, n: triplet_loss(x, p, n, distance="l2"), "infonce": lambda x, p, n: -F.log(F.exp(cosine(x, p) / 0.2) / (F.exp(cosine(x, p) / 0.2) + F.exp(cosine(x, n) / 0.2))), "cosine": lambda x, p, n: 1 - cosine(x, p), "mse": lambda x, p, n: normalized_mse(x, p)}


def loss_of(kind: str, x: Column, p: Column, n: Column) -> Column:
    """The loss of a name."""
    if kind not in LOSSES:
        raise ValueError(f"unknown loss {kind!r}; there are {', '.join(LOSSES)}")
    return LOSSES[kind](x, p, n)


@query("loss_dispatch", f"SELECT round(avg(greatest(0, list_cosine_similarity(x, n) - list_cosine_similarity(x, p) + 0.5)), 6) AS triplet, round(avg(greatest(0, power(list_distance(x, p), 2) - power(list_distance(x, n), 2) + 0.5)), 6) AS triplet_l2, round(avg(-ln(exp(list_cosine_similarity(x, p) / 0.2) / (exp(list_cosine_similarity(x, p) / 0.2) + exp(list_cosine_similarity(x, n) / 0.2)))), 6) AS infonce, round(avg(1 - list_cosine_similarity(x, p)), 6) AS cosine FROM ({PAIRS})")
def loss_dispatch(spark, sf_dir):
    t = triples(spark, sf_dir)
    return t.agg(*(F.round(F.avg(loss_of(k, F.col("x"), F.col("p"), F.col("n"))), 6).alias(k) for k in ("triplet", "triplet_l2", "infonce", "cosine")))


def masked_mean(values: Column, mask: Column) -> Column:
    """Mean of the vectors whose mask is 1; zeros where none is."""
    real = F.filter(F.arrays_zip(values.alias("v"), mask.alias("m")), lambda r: r["m"] == 1)
    n = F.greatest(F.size(real), F.lit(1))
    zero = F.transform(values[0], lambda x: F.lit(0.0))
    return F.transform(F.aggregate(real, zero, lambda s, r: F.zip_with(s, r["v"], lambda a, b: a + b)), lambda x: x / n)


@query("masked_mean_pool", f"SELECT vec_id, round(CASE m WHEN 0 THEN 0 WHEN 1 THEN x[1] WHEN 2 THEN (x[1] + p[1]) / 2 ELSE (x[1] + p[1] + n[1]) / 3 END, 6) AS first, round(CASE m WHEN 0 THEN 0 WHEN 1 THEN x[64] WHEN 2 THEN (x[64] + p[64]) / 2 ELSE (x[64] + p[64] + n[64]) / 3 END, 6) AS last FROM (SELECT *, vec_id % 4 AS m FROM ({PAIRS}))")
def masked_mean_pool(spark, sf_dir):
    d = lambda c: F.transform(c, lambda v: v.cast("double"))
    mask = F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda i: (i < F.col("vec_id") % 4).cast("int"))
    x = triples(spark, sf_dir).select("vec_id", F.array(d("x"), d("p"), d("n")).alias("v"), mask.alias("m")).select("vec_id", masked_mean(F.col("v"), F.col("m")).alias("f"))
    return x.select("vec_id", F.round(F.col("f")[0], 6).alias("first"), F.round(F.col("f")[63], 6).alias("last"))
