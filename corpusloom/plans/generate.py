"""Drivers around an external generator: batched calls with retries, one failure a row, and work that is resumed from what is written.

The generator is any function from a list of prompts to a list of responses; it runs in the tasks, so it brings its own model.
Equal prompts are asked once. Prompts are dealt into chunks by their hash, and each chunk is a job whose responses are written
before the next one begins: a run that is given the same folder again asks only for the chunks that aren't there yet.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text
from ..operators import curation, generation, linkage
from ..operators.texts import scored_pairs
from ..sources.corpus import exists
from .scratch import scratch_path, written

Model = Callable[[list[str]], list[str]]

#: What a prompt asks for, with the cleaned instruction in place of {instruction}.
TEMPLATES = {
    "positive": 'Reword this flight instruction twice. Keep every direction, clock position and landmark as it is, and add no notes.\nInstruction: "{instruction}"\nTwo rewordings, one a line:',
    "negative": 'Reword this flight instruction once so that it leads elsewhere: change its direction or clock position, and its landmark, in a way that stays plausible. Add no notes.\nInstruction: "{instruction}"\nOne rewording:',
    "combined": 'Reword this flight instruction three times, one a line, without notes. The first two keep every direction, clock position and landmark; the third changes direction and landmark in a way that stays plausible.\nInstruction: "{instruction}"\nThree rewordings:',
}


def prompt(instruction: Column, kind: str = "combined", examples: list[tuple[str, str]] = ()) -> Column:
    """The prompt for an instruction without its notes; examples (input, output) come first, three at most."""
    before, after = TEMPLATES[kind].split("{instruction}")
    shown = "".join(f"Example {i}:\nInput: {a}\nOutput: {b}\n\n" for i, (a, b) in enumerate(examples[:3], 1))
    return F.concat(F.lit(shown + before), text.main_instruction(instruction), F.lit(after))


def ask(model: Model, prompts: list[str], attempts: int) -> list[tuple[str | None, str | None, int]]:
    """Response, error and calls of each prompt: a batch that keeps failing is halved, until the prompts that fail stand alone."""
    out: list = [None] * len(prompts)
    groups, calls = [list(range(len(prompts)))] if prompts else [], [0] * len(prompts)
    while groups:
        group = groups.pop()
        for _ in range(attempts):
            for i in group:
                calls[i] += 1
            try:
                got = model([prompts[i] for i in group])
                if len(got) != len(group):
                    raise ValueError(f"{len(got)} responses to {len(group)} prompts")
            except Exception as e:  # whatever a model raises is that batch's failure, not the job's
                error = f"{type(e).__name__}: {e}"
                continue
            for i, response in zip(group, got, strict=True):
                out[i] = (response, None if response is not None else "no response", calls[i])
            break
        else:
            if len(group) == 1:
                out[group[0]] = (None, error, calls[group[0]])
            else:
                groups += [group[len(group) // 2 :], group[: len(group) // 2]]
    return out


def responses(prompts: DataFrame, model: Model, batch: int, attempts: int) -> DataFrame:
    """prompt, response, error and calls. prompts: one column prompt."""

    def work(batches):
        for b in batches:
            every = b.column(0).to_pylist()
            for i in range(0, len(every), batch):
                some = every[i : i + batch]
                cols = list(zip(*ask(model, some, attempts), strict=True))
                kinds = (pa.string(), pa.string(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["prompt", "response", "error", "calls"])

    return prompts.mapInArrow(work, "prompt string, response string, error string, calls int")


def generated(rows: DataFrame, prompt: str, model: Model, batch: int = 16, attempts: int = 3, chunks: int = 1, root: str | None = None, again: bool = False) -> DataFrame:
    """rows with response, error and calls; every row once, those with a null prompt without a call.

    root: a folder; chunks that a run before has written there aren't asked again, and with `again` their failed prompts are.
    The same root needs the same number of chunks."""
    spark = rows.sparkSession
    root = root or scratch_path(spark)
    asked = rows.where(F.col(prompt).isNotNull()).select(F.col(prompt).alias("prompt")).distinct().withColumn("chunk", F.pmod(F.xxhash64("prompt"), F.lit(chunks)).cast("int"))
    missing = [i for i in range(chunks) if not exists(spark, f"{root}/chunk={i}/_SUCCESS")]
    if len(missing) > 1:
        asked = written(asked, "chunk")
    for i in missing:
        responses(asked.where(F.col("chunk") == i).select("prompt"), model, batch, attempts).write.mode("overwrite").parquet(f"{root}/chunk={i}")
    schema = "prompt string, response string, error string, calls int"
    found = spark.read.schema(schema).parquet(*[f"{root}/chunk={i}" for i in range(chunks)])
    if again:
        n = 0
        while exists(spark, f"{root}/again={n}/_SUCCESS"):
            n += 1
        last = spark.read.schema(schema).parquet(*[f"{root}/again={i}" for i in range(n)]) if n else found.where("false")
        failed = found.where("error is not null").select("prompt").join(last.where("error is null").select("prompt"), "prompt", "left_anti")
        responses(failed, model, batch, attempts).write.mode("overwrite").parquet(f"{root}/again={n}")
    later = []
    while exists(spark, f"{root}/again={len(later)}/_SUCCESS"):
        later.append(f"{root}/again={len(later)}")
    if later:
        # the first answer counts, or else the last failure
        every = spark.read.schema(schema).parquet(*later).unionByName(found).groupBy("prompt").agg(F.max(F.struct(F.col("error").isNull().alias("ok"), "response", "error")).alias("m"), F.sum("calls").cast("int").alias("calls"))
        found = every.select("prompt", "m.response", "m.error", "calls")
    return rows.join(found.withColumnRenamed("prompt", "_prompt"), F.col(prompt) == F.col("_prompt"), "left").drop("_prompt")


def overlap(a: Column, b: Column) -> Column:
    """Share of words in common; stands where an embedding's similarity would."""
    words = lambda x: F.array_distinct(text.tokens(F.lower(x)))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(words(a), words(b))), F.size(F.array_union(words(a), words(b)))), F.lit(0.0))


def judged(candidate: Column, answer: Column, positive: bool, similarity=overlap) -> Column:
    """Whether a rewording is a valid positive (alike, and in direction or landmark too) or negative (alike, but not in both)."""
    feature = lambda x, k: text.features(x, k, L.VALIDATOR, False)
    d = curation.validator_direction(feature(answer, "directions"), feature(candidate, "directions"))
    n = curation.validator_landmark(feature(answer, "landmarks"), feature(candidate, "landmarks"))
    e = similarity(answer, candidate)
    return (e > 0.5) & ((d > 0.7) | (n > 0.5) | ((e + d + n) / 3 > 0.6)) if positive else (e > 0.3) & (e < 0.92) & ((d < 0.7) | (n < 0.7))


def split_response(response: Column) -> Column:
    """Positives and negatives of a response's lines: of three or more the first two and the third, of fewer each half."""
    cut = lambda x: F.struct(F.slice(x, 1, F.when(F.size(x) >= 3, 2).otherwise(F.floor(F.size(x) / 2).cast("int"))).alias("positives"), F.slice(x, F.when(F.size(x) >= 3, 3).otherwise(F.floor(F.size(x) / 2).cast("int") + 1), F.greatest(F.lit(1), F.size(x))).alias("negatives"))
    return text.let(text.parse_response(response, 3), cut)


def fallback(answer: Column) -> Column:
    """The rules' rewordings, which are valid by definition."""
    positives, negatives = text.rule_positives(answer), F.array(text.rule_negative(answer))
    return F.struct(positives.alias("positives"), negatives.alias("negatives"), positives.alias("valid_positives"), negatives.alias("valid_negatives"), F.lit("fallback_patterns").alias("method"))


def augmented(turns: DataFrame, key: str, answer: str, model: Model, rules: bool = False, similarity=overlap, **calls) -> DataFrame:
    """turns with paraphrases (positives, negatives, those that are valid, method) and outcome of each turn.

    outcome: short (no answer of three words, so none is asked for), success, or failed: the model failed or named nothing;
    then the rules' rewordings take its place if `rules`, or else nothing does. calls: options of generated()."""
    a = F.col(answer)
    wanted = F.size(text.tokens(F.coalesce(a, F.lit("")))) >= 3
    x = generated(turns.withColumn("_prompt_", F.when(wanted, prompt(a))), "_prompt_", model, **calls).withColumn("_s", split_response(F.col("response")))
    got = F.col("error").isNull() & (F.size("_s.positives") + F.size("_s.negatives") > 0)
    outcome = F.when(F.col("_prompt_").isNull(), "short").when(F.coalesce(got, F.lit(False)), "success").otherwise("failed")
    # one candidate a row, so that each is judged by the same projection
    marked = lambda side, positive: F.transform(f"_s.{side}", lambda c: F.struct(F.lit(positive).alias("positive"), c.alias("text")))
    lists = x.select(key, F.col(answer).alias("_a"), F.posexplode(F.concat(marked("positives", True), marked("negatives", False))).alias("_i", "_c"))
    each = lists.withColumn("_ok", F.when(F.col("_c.positive"), judged(F.col("_c.text"), F.col("_a"), True, similarity)).otherwise(judged(F.col("_c.text"), F.col("_a"), False, similarity)))
    pick = lambda p: F.transform(F.filter(F.array_sort(F.collect_list(F.struct("_i", "_c", "_ok"))), lambda e: e["_ok"] & (e["_c"]["positive"] == p)), lambda e: e["_c"]["text"])
    valid = each.groupBy(key).agg(pick(True).alias("_vp"), pick(False).alias("_vn"))
    none = F.array().cast("array<string>")
    made = F.struct(F.col("_s.positives").alias("positives"), F.col("_s.negatives").alias("negatives"), F.coalesce("_vp", none).alias("valid_positives"), F.coalesce("_vn", none).alias("valid_negatives"), F.lit("model").alias("method"))
    done = x.withColumn("outcome", outcome).join(valid, key, "left")
    paraphrases = F.when(F.col("outcome") == "success", made)
    paraphrases = paraphrases.when(F.col("outcome") == "failed", fallback(a)) if rules else paraphrases
    return done.withColumn("paraphrases", paraphrases).drop("_prompt_", "_s", "_vp", "_vn", "response")


def augmentation_counts(done: DataFrame, split: Column, episode: str) -> DataFrame:
    """Episodes, answered turns, successes and failures by split."""
    by = done.groupBy(split.alias("split"))
    count = lambda *o: F.count_if(F.col("outcome").isin(*o))
    return by.agg(F.count_distinct(episode).alias("episodes"), count("success", "failed").alias("answered"), count("success").alias("successful"), count("failed").alias("failed"))


def regenerated(raw: DataFrame, turns: DataFrame, key: str, order: str, context: str, model: Model, **calls) -> DataFrame:
    """raw with a new instruction where its turn is found and the model answers, and the row as it was otherwise.

    raw and turns: as linkage.linked takes them; context: the column of turns that the model is asked with. Added: turn_key,
    original (the instruction before), status (unmatched, failed, same, new) and error."""
    found = written(linkage.linked(raw, turns, key, order))  # prompts and answers both read the links
    asked = found.join(turns.select(F.col(order).alias("turn_key"), F.col(context).alias("_context")), "turn_key")
    answers = generated(asked, "_context", model, **calls).select(key, "turn_key", F.btrim("response").alias("_new"), "error")
    x = raw.join(answers, key, "left")
    new = F.when(F.col("_new").isNotNull(), curation.updated_instruction(F.col("instructions"), F.col("_new"))).otherwise(F.col("instructions"))
    status = F.when(F.col("turn_key").isNull(), "unmatched").when(F.col("_new").isNull(), "failed").when(new == F.col("instructions"), "same").otherwise("new")
    return x.withColumns({"original": F.col("instructions"), "instructions": new, "status": status}).drop("_new")


def answer_after_tag(instruction: Column) -> Column:
    return F.btrim(F.element_at(F.split(instruction, "\\[INS\\]"), -1))


def regeneration_scores(done: DataFrame, key: str) -> DataFrame:
    """Scores of the rows with a new instruction: those of composite_score, bleu4 and rouge_l."""
    pairs = done.where("status = 'new'").select(key, answer_after_tag(F.col("instructions")).alias("pred"), answer_after_tag(F.col("original")).alias("gold"))
    kinds = ("direction", "yesno", "attribute", "landmark", "movement", "form", "total")
    scored = scored_pairs(pairs).select(key, *kinds, generation.rouge_l("pred", "gold").alias("rouge_l"))
    return scored.join(generation.bleu4(pairs, key, "pred", "gold"), key)
