"""Evaluation reports over scored samples and quantile runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.constants import OUTCOMES, QUANTILES, THEMES, Z90
from gridspark.functions import stats as S
from gridspark.operators.bootstrap import interval, resampled_sums
from gridspark.operators.selection import exact_quantiles
from gridspark.plans.bulletins import bulletins_for_days, theme_flags

Q = list(QUANTILES)
RUN = ["model", "backend", "split"]


# ---------------------------------------------------------------- sampled answers
def task_partials(samples: DataFrame) -> DataFrame:
    """One row per task and run: everything a report needs from the raw samples."""
    return samples.groupBy(*RUN, "family", "difficulty", "template_id", "task_id").agg(
        F.count("*").alias("n"), *[F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES],
        F.sum("reward").alias("reward"), F.sum("latency_s").alias("latency"), F.sum("output_tokens").alias("tokens"),
        F.count("output_tokens").alias("token_rows"), F.sum("cost_usd").alias("cost"))


def report(samples: DataFrame) -> DataFrame:
    """Metrics overall and by family, difficulty and template in one pass over the per-task rows."""
    t = task_partials(samples).withColumn("difficulty", F.col("difficulty").cast("string"))
    n, c = F.col("n"), F.col("correct")
    share = {o: F.sum(o) / F.sum("n") for o in OUTCOMES}
    k_min = F.min("n")
    grouped = t.groupingSets(
        [RUN, RUN + ["family"], RUN + ["difficulty"], RUN + ["template_id"]], *RUN, "family", "difficulty", "template_id")
    gid = F.grouping_id()
    kind = (F.when(gid == 7, "overall").when(gid == 3, "family").when(gid == 5, "difficulty").otherwise("template"))
    out = grouped.agg(
        kind.alias("group_type"), F.count("*").alias("tasks"), F.sum("n").alias("samples"), k_min.alias("k_min"),
        F.avg(c / n).alias("pass_1"), F.when(k_min >= 5, F.avg(S.pass_at_k(n, c, 5))).alias("pass_5"),
        F.when(k_min >= 10, F.avg(S.pass_at_k(n, c, 10))).alias("pass_10"),
        F.avg((n == c).cast("double")).alias("consistency"), F.count_if(c == 0).alias("never_solved"),
        *[e.alias(o) for o, e in share.items()],
        (F.sum("reward") / F.sum("n")).alias("mean_reward"), (F.sum("latency") / F.sum("n")).alias("mean_latency_s"),
        F.try_divide(F.sum("tokens"), F.sum("token_rows")).alias("mean_output_tokens"), F.sum("cost").alias("total_cost_usd"))
    return out.withColumn("group_value", F.coalesce("family", "difficulty", "template_id", F.lit("all"))).drop(
        "family", "difficulty", "template_id")


# ---------------------------------------------------------------- quantile runs
def common_ids(runs: DataFrame, n_runs: int | None = None, key: str = "id") -> DataFrame:
    """Rows whose id occurs in every run. An id's group is its few hours in each run, so one shuffle by id settles it;
    pass the number of runs to save counting them."""
    total = F.lit(n_runs) if n_runs else runs.select(F.count_distinct("run")).scalar()
    seen = F.size(F.collect_set("run").over(Window.partitionBy(key)))
    return runs.withColumn("_seen", seen).withColumn("_total", total).filter(F.col("_seen") == F.col("_total")).drop("_seen", "_total")


def with_fallback(runs: DataFrame) -> DataFrame:
    """Unparsed answers count as a zero-width forecast at zero."""
    return runs.withColumn("parse_ok", F.col("p50").isNotNull()).withColumns({q: F.coalesce(q, F.lit(0.0)) for q in Q})


def per_example(runs: DataFrame) -> DataFrame:
    below = [F.avg((F.col("y") < F.col(q)).cast("double")).alias(f"below_{q}") for q in Q]
    return runs.groupBy("run", "id", "zone", "day").agg(
        F.avg(S.quantile_loss("y")).alias("loss"), F.min(F.col("parse_ok").cast("int")).alias("parse_ok"),
        F.avg(F.col("p90") - F.col("p10")).alias("width"), F.avg(S.covered("y")).alias("covered"), *below)


def run_summary(scored: DataFrame) -> DataFrame:
    """Means per run; model scores over parsed rows only, plus the reward where the models agreed.
    scored: run, id, reward, parse_ok, pinball, baseline_pinball, covered, width, models_agreed."""
    ok = F.col("parse_ok")
    only = lambda c: F.avg(F.when(ok, F.col(c)))
    return scored.groupBy("run").agg(
        F.count("*").alias("n"), (100 * (1 - F.avg(ok.cast("double")))).alias("parse_fail_pct"), F.avg("reward").alias("reward"),
        only("pinball").alias("pinball"), F.avg("baseline_pinball").alias("baseline_pinball"),
        only("covered").alias("coverage"), only("width").alias("width"),
        F.avg(F.when(F.col("models_agreed"), F.col("reward"))).alias("reward_models_agreed"))


def paired(examples: DataFrame, reference: str) -> DataFrame:
    """Every run's examples next to the reference run's loss on the same id (one row per run and id)."""
    ref = F.max(F.when(F.col("run") == reference, F.col("loss"))).over(Window.partitionBy("id"))
    return (examples.withColumn("ref_loss", ref).filter(F.col("ref_loss").isNotNull())
            .withColumn("delta", F.col("loss") - F.col("ref_loss")))


def paired_comparison(pairs: DataFrame, replicates: int, seed: str = "") -> DataFrame:
    """Mean difference to the reference with a day-clustered interval and the share of resamples that are better.

    Everything follows from one row per run and day."""
    per_day = pairs.groupBy("run", "day").agg(
        F.sum("delta").alias("_d"), F.count("*").alias("_n"), F.sum("loss").alias("_l"), F.sum("ref_loss").alias("_r"),
        F.sum("covered").alias("_c"))
    boot = resampled_sums(per_day, ["run"], "day", ["_d", "_n"], replicates, seed).withColumn("_m", F.col("_d") / F.col("_n"))
    lo, hi = interval("_m")
    spread = boot.groupBy("run").agg(lo.alias("lo"), hi.alias("hi"), F.avg((F.col("_m") < 0).cast("double")).alias("p_better"))
    mean = lambda c: F.sum(c) / F.sum("_n")
    point = per_day.groupBy("run").agg(
        F.sum("_n").alias("n"), F.count("*").alias("days"), mean("_l").alias("loss"), mean("_r").alias("ref_loss"),
        mean("_d").alias("delta"), mean("_c").alias("coverage"))
    out = point.join(spread, "run")
    pct = lambda c: 100 * F.col(c) / F.col("ref_loss")
    return out.withColumns({"delta_pct": pct("delta"), "ci_lo_pct": pct("lo"), "ci_hi_pct": pct("hi")}).drop("lo", "hi")


def zone_skill(pairs: DataFrame, system_zone: str = "system_total") -> DataFrame:
    """Mean over zones of 1 - loss ratio, the system total apart."""
    per_zone = pairs.groupBy("run", "zone").agg((1 - F.avg("loss") / F.avg("ref_loss")).alias("_s"))
    is_system = F.col("zone") == system_zone
    return per_zone.groupBy("run").agg((100 * F.avg(F.when(~is_system, F.col("_s")))).alias("zone_skill_pct"),
                                       (100 * F.max(F.when(is_system, F.col("_s")))).alias("system_skill_pct"))


def zone_skill_interval(pairs: DataFrame, replicates: int, system_zone: str = "system_total", seed: str = "") -> DataFrame:
    """Day-clustered interval of the zone skill; zones without rows in a resample drop out of its mean."""
    per_day = pairs.groupBy("run", "zone", "day").agg(F.sum("loss").alias("_l"), F.sum("ref_loss").alias("_r"))
    sums = resampled_sums(per_day, ["run", "zone"], "day", ["_l", "_r"], replicates, seed).filter(F.col("zone") != system_zone)
    skill = sums.groupBy("replicate", "run").agg((100 * F.avg(1 - F.try_divide("_l", "_r"))).alias("_s"))
    lo, hi = interval("_s")
    return skill.groupBy("run").agg(lo.alias("lo"), hi.alias("hi"))


def calibration(runs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Shares below each quantile and inside one, two, beyond three sigma of a normal with the same p10-p90 range."""
    sigma = F.greatest(F.col("p90") - F.col("p10"), F.lit(1e-9)) / (2 * Z90)
    z = F.abs(F.col("y") - F.col("p50")) / sigma
    share = lambda cond: F.avg(cond.cast("double"))
    return runs.groupBy(*(keys or ["run"])).agg(
        *[share(F.col("y") < F.col(q)).alias(f"below_{q}") for q in Q],
        share(z < 1).alias("within_1sd"), share(z < 2).alias("within_2sd"), share(z > 3).alias("beyond_3sd"))


def slices(pairs: DataFrame, columns: list[str], themes: str | None = None) -> DataFrame:
    """Loss against the reference for every value of every slice column, and of every theme if `themes` names a mask column.

    Rows are summed per combination of values first; only these few sums are unpivoted."""
    sums = pairs.groupBy("run", *columns, *([themes] if themes else [])).agg(
        F.count("*").alias("n"), F.sum("loss").alias("loss"), F.sum("ref_loss").alias("ref_loss"))
    values = {c: F.col(c).cast("string") for c in columns}
    if themes:
        values |= {f"theme_{k}": (F.getbit(themes, F.lit(bit)) == 1).cast("string") for bit, k in enumerate(THEMES)}
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("slice"), value.alias("value")) for c, value in values.items()]))
    rows = sums.select("run", "n", "loss", "ref_loss", cells.alias("c")).select("run", "n", "loss", "ref_loss", "c.*")
    return rows.groupBy("slice", "value", "run").agg(
        F.sum("n").alias("n"), (100 * (F.sum("loss") / F.sum("ref_loss") - 1)).alias("vs_ref_pct"))


def theme_masks(zone_days: DataFrame, bulletins: DataFrame, text: str = "reasoning_text", margin_minutes: int = 5) -> DataFrame:
    """zone, day, themes: bit k is set if the latest bulletin before the day's cutoff of any of the zone's offices holds theme k.

    zone_days: zone, office, day. Texts shrink to a mask in the scan, so neither the as-of nor the join moves them. Zone-days
    without a bulletin have no row."""
    bits = [F.when(flag, F.lit(1 << bit)).otherwise(F.lit(0)) for bit, flag in enumerate(theme_flags(text).values())]
    marked = bulletins.select("office", "issued_utc", "doc_id", F.col(text).alias("reasoning_text"), reduce(Column.bitwiseOR, bits).cast("long").alias("themes"))
    hit = bulletins_for_days(zone_days.withColumnRenamed("day", "operating_date"), marked, ["doc_id", "themes"], margin_minutes)
    return hit.groupBy("zone", F.col("operating_date").alias("day")).agg(F.bit_or("themes").alias("themes"))


def hour_slices(long: DataFrame, reference: str) -> DataFrame:
    """Loss per hour ending against the reference run's loss at that hour; only one row per run and hour is compared."""
    per = long.groupBy("run", "hour_ending").agg(F.count("*").alias("n"), F.avg(S.quantile_loss("y")).alias("loss"))
    ref = F.max(F.when(F.col("run") == reference, F.col("loss"))).over(Window.partitionBy("hour_ending"))
    return per.select(F.lit("hour_ending").alias("slice"), F.concat(F.lit("HE"), "hour_ending").alias("value"), "run", "n",
                      (100 * (F.col("loss") / ref - 1)).alias("vs_ref_pct"))


def pivot_slice(sliced: DataFrame, name: str, values: list[str]) -> DataFrame:
    """One slice as a run-by-value table."""
    return sliced.filter(F.col("slice") == name).groupBy("run").pivot("value", values).agg(F.first("vs_ref_pct"))


def price_weights(rows: DataFrame, zero_as_missing: bool = True) -> DataFrame:
    """Non-negative price weights; a missing (or exactly zero) price takes the median of the run's known prices.

    The medians are selected by rank over value ranges, so a run's prices never meet in one task."""
    known = F.col("price").isNotNull() & (~(F.col("price") == 0) if zero_as_missing else F.lit(True))
    w = F.when(known, F.greatest("price", F.lit(0.0)))
    found = exact_quantiles(rows.select("run", F.when(known, F.col("price")).alias("price")), "price", [0.5], ["run"])
    med = found.select("run", F.get("quantiles", F.lit(0)).alias("_med"))
    return rows.join(med, "run", "left").withColumn("weight", F.coalesce(w, F.col("_med"))).drop("_med")


def extra_metrics(runs: DataFrame, prices: DataFrame, climate: DataFrame, reference: str) -> DataFrame:
    """Price-weighted loss, accuracy of the median against no correction, skill against the same range every day."""
    rows = price_weights(runs.join(prices, ["zone", "day", "hour_ending"], "left"))
    c = climate.select("zone", "hour_ending", *[F.col(q).alias(f"c_{q}") for q in Q])
    rows = rows.join(c, ["zone", "hour_ending"], "left").withColumn("_loss", S.quantile_loss("y"))
    sums = rows.groupBy("run").agg(
        (F.sum(F.col("weight") * F.col("_loss")) / F.sum("weight")).alias("price_weighted"),
        F.avg(F.abs(F.col("y") - F.col("p50"))).alias("p50_mae"), F.avg(F.abs("y")).alias("plain_mae"),
        (100 * (1 - F.avg("_loss") / F.avg(S.quantile_loss("y", "c_")))).alias("skill_vs_climate_pct"))
    ref = sums.filter(F.col("run") == reference).select("price_weighted").scalar()
    return sums.withColumn("_ref", ref).withColumns({
        "price_weighted_vs_ref_pct": 100 * (F.col("price_weighted") / F.col("_ref") - 1),
        "p50_vs_plain_pct": 100 * (F.col("p50_mae") / F.col("plain_mae") - 1)}).drop("_ref")


# ---------------------------------------------------------------- rollouts and logs
def rollout_diversity(rollouts: DataFrame) -> DataFrame:
    """Per model: distinct answers per prompt, groups with reward variance, share of echoes, parse rate.
    rollouts: model, prompt_id, answer, reward, parse_ok, echo."""
    groups = rollouts.groupBy("model", "prompt_id").agg(
        F.count_distinct("answer").alias("_distinct"), F.stddev_pop("reward").alias("_std"), F.avg("reward").alias("_mean"),
        F.avg(F.col("echo").cast("double")).alias("_echo"), F.avg(F.col("parse_ok").cast("double")).alias("_ok"))
    return groups.groupBy("model").agg(
        F.count("*").alias("prompts"), F.avg("_ok").alias("parse_rate"), F.avg("_distinct").alias("mean_distinct"),
        F.avg((F.col("_std") > 1e-6).cast("double")).alias("groups_with_variance"), F.avg("_std").alias("mean_std"),
        F.avg("_mean").alias("mean_reward"), F.avg("_echo").alias("echo_share"))


def reconcile(logged: DataFrame, recomputed: DataFrame, key: str, tolerance: float = 1e-9) -> DataFrame:
    """Rows whose logged reward differs from the recomputed one."""
    both = logged.select(key, F.col("reward").alias("logged")).join(recomputed.select(key, F.col("reward").alias("recomputed")), key)
    return both.filter(F.abs(F.col("logged") - F.col("recomputed")) > tolerance)


STEP_LINE = r"Evaluated \S+ \| Policy v(\d+) \|.*?\| Reward (-?[0-9.]+)"


def best_checkpoints(lines: DataFrame) -> DataFrame:
    """Best step per run by its last logged reward, later step on ties. lines: run, line_no, line."""
    plain = F.regexp_replace("line", "\u001b\\[[0-9;]*m", "")
    rows = lines.filter(plain.rlike(STEP_LINE)).select(
        "run", "line_no", F.regexp_extract(plain, STEP_LINE, 1).cast("int").alias("step"),
        F.regexp_extract(plain, STEP_LINE, 2).cast("double").alias("reward"))
    last = rows.groupBy("run", "step").agg(F.max_by("reward", "line_no").alias("reward"))
    w = Window.partitionBy("run").orderBy(F.desc("reward"), F.desc("step"))
    return last.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def run_shares(df: DataFrame, column: Column) -> DataFrame:
    return df.groupBy("run").agg(F.avg(column.cast("double")).alias("share"))
