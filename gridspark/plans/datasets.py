"""Task sets and training rows built from answers, samples and examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.constants import QUANTILES
from gridspark.functions.stats import hash_normal
from gridspark.operators.sampling import distinct_capped, hash_order
from gridspark.plans.answers import extract_query, normalize_query

Q = list(QUANTILES)


# ---------------------------------------------------------------- tasks
def task_rows(answers: DataFrame, template: str, params: list[str], answer: str) -> DataFrame:
    """All keys of an answer table as tasks with a stable id; degenerate (null) answers are dropped."""
    body = F.to_json(F.struct(*[F.col(p).cast("string").alias(p) for p in sorted(params)]))
    rows = answers.filter(F.col(answer).isNotNull()).withColumn("params", body)
    return rows.select(F.concat(F.lit(template + "-"), F.substring(F.sha1("params"), 1, 10)).alias("task_id"),
                       F.lit(template).alias("template_id"), "params", F.col(answer).cast("string").alias("answer"))


def pick_tasks(tasks: DataFrame, per_template: int, seed: str, by: list[str] | None = None) -> DataFrame:
    """Up to n distinct tasks per template (and split) in hash order; the bound is applied before the shuffle.

    Of rows that share a task id the smallest by its other columns stays."""
    rest = [c for c in tasks.columns if c != "task_id"]
    single = tasks.groupBy("task_id").agg(F.min(F.struct(*rest)).alias("_r")).select("task_id", "_r.*").select(*tasks.columns)
    keys = by or ["template_id"]
    order = hash_order(seed, F.col("task_id"))
    w = Window.partitionBy(*keys).orderBy(order, "task_id")
    return (single.withColumn("_rn", F.row_number().over(w))
            .filter(F.col("_rn") <= per_template).drop("_rn"))


def summarize_tasks(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("split").agg(
        F.count("*").alias("tasks"), F.count_distinct("template_id").alias("templates"),
        *[F.count_if(F.col("difficulty") == d).alias(f"difficulty_{d}") for d in (1, 2, 3)])


# ---------------------------------------------------------------- chat rows from correct answers
def correct_examples(results: DataFrame, tasks: DataFrame, cap: int = 2) -> DataFrame:
    """Correct answers with a query, each query once per task, the first `cap` in arrival order."""
    known = results.join(tasks.select("task_id"), "task_id", "left_semi").filter(F.col("outcome") == "correct")
    rows = known.withColumn("query", extract_query("completion")).filter(F.length("query") > 0)
    return distinct_capped(rows, "task_id", normalize_query("query"), "sample_idx", cap)


def chat_rows(examples: DataFrame, tasks: DataFrame, system: str) -> DataFrame:
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    rows = examples.join(tasks.select("task_id", "question"), "task_id")
    return rows.select("task_id", "template_id", F.col("model").alias("source_model"), F.array(
        message("system", F.lit(system)), message("user", F.col("question")),
        message("assistant", F.trim("completion"))).alias("messages"))


def coverage(results: DataFrame, examples: DataFrame) -> DataFrame:
    """Attempted tasks and whether they yielded an example; the rest are the ones never solved."""
    done = examples.select("task_id").distinct().withColumn("covered", F.lit(True))
    tried = results.select("task_id").distinct()
    return tried.join(done, "task_id", "left").withColumn("covered", F.coalesce("covered", F.lit(False)))


# ---------------------------------------------------------------- weighted prompt set
def prompt_weights(tasks: DataFrame, results: DataFrame, keep_fraction: float = 0.1, seed: str = "keep") -> DataFrame:
    """Mixed pass rate three times, never solved and unseen once, always solved with a small hashed chance."""
    rate = results.groupBy("task_id").agg(F.avg((F.col("outcome") == "correct").cast("double")).alias("_rate"))
    bucket = F.conv(F.substring(hash_order(seed, F.col("task_id")), 1, 8), 16, 10).cast("double") / 4294967296.0
    r = F.col("_rate")
    kind = (F.when(r.isNull(), "unseen").when(r == 0, "never").when(r < 1, "mixed")
            .when(bucket < keep_fraction, "always_kept").otherwise("always_dropped"))
    copies = F.when(F.col("kind") == "mixed", 3).when(F.col("kind") == "always_dropped", 0).otherwise(1)
    return tasks.join(rate, "task_id", "left").withColumn("kind", kind).withColumn("copies", copies).drop("_rate")


def weighted_prompts(weighted: DataFrame) -> DataFrame:
    reps = F.explode(F.array_repeat(F.lit(1), F.col("copies")))
    return weighted.filter(F.col("copies") > 0).select("*", reps.alias("_one")).drop("_one")


# ---------------------------------------------------------------- anchored targets
def anchored_targets(baseline: DataFrame, width_sd: float = 0.0, shift_sd: float = 0.0, seed: str = "0") -> DataFrame:
    """Baseline quantiles as compact JSON per example, optionally with one hashed width and shift per example.

    baseline: id, hour_ending and quantiles; a group is the few hours of one example."""
    rows = F.array_sort(F.collect_list(F.struct("hour_ending", *Q)))
    one = baseline.groupBy("id").agg(rows.alias("_rows"), F.avg((F.col("p90") - F.col("p10")) / 2).alias("_half"))
    scale = F.exp(width_sd * hash_normal(F.lit(seed), F.col("id"), F.lit("width")))
    shift = shift_sd * F.col("_half") * hash_normal(F.lit(seed), F.col("id"), F.lit("shift"))
    one = one.withColumns({"width_factor": scale, "median_shift": shift})

    def entry(r: Column) -> Column:
        m = r["p50"] + F.col("median_shift")
        low = m - F.col("width_factor") * (r["p50"] - r["p10"])
        high = m + F.col("width_factor") * (r["p90"] - r["p50"])
        number = lambda c: F.rint(c).cast("bigint").cast("string")
        return F.concat(F.lit('{"he":'), r["hour_ending"].cast("string"), F.lit(',"p10":'), number(low),
                        F.lit(',"p50":'), number(m), F.lit(',"p90":'), number(high), F.lit("}"))

    text = F.concat(F.lit('{"hours":['), F.array_join(F.transform("_rows", entry), ","), F.lit("]}"))
    return one.select("id", "width_factor", "median_shift", text.alias("target"))


# ---------------------------------------------------------------- example rows to tasks
def example_tasks(examples: DataFrame, zones: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Nested examples with string hour keys: only the listed hours are kept, a listed hour without a label raises."""
    hours = F.col("hours").cast("array<int>")

    def listed(c: str) -> Column:
        return F.map_filter(F.transform_keys(c, lambda k, _: k.cast("int")), lambda k, _: F.array_contains(hours, k))

    rows = examples.filter(F.col("zone").isin(zones)) if zones else examples
    rows = rows.orderBy("id").limit(limit) if limit is not None else rows
    rows = rows.withColumns({"baseline": listed("baseline"), "actual_error": listed("actual_error")})
    whole = (F.size(F.array_except(hours, F.map_keys("baseline"))) == 0) & (F.size(F.array_except(hours, F.map_keys("actual_error"))) == 0)
    checked = F.when(whole, F.col("id")).otherwise(F.raise_error(F.concat(F.col("id"), F.lit(": listed hours lack a label"))))
    return rows.withColumn("id", checked)
