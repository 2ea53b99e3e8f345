"""Scores of quantile forecasts and of typed answers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.constants import INVALID_REWARD, LOCAL_TZ, QUANTILES, REWARDS, UNORDERED_PENALTY
from gridspark.functions import stats as S
from gridspark.functions import timeconv as T
from gridspark.functions.timeconv import col

Q = list(QUANTILES)


# ---------------------------------------------------------------- quantile forecasts
def example_scores(long: DataFrame, keys: list[str]) -> DataFrame:
    """Loss, coverage, width and shares below each quantile per example, from one row per hour."""
    below = {f"below_{q}": F.avg((F.col("y") < F.col(q)).cast("double")) for q in Q}
    return long.groupBy(*keys).agg(
        F.avg(S.quantile_loss("y")).alias("loss"), F.avg(S.covered("y")).alias("covered"),
        F.avg(F.col("p90") - F.col("p10")).alias("width"), *[c.alias(n) for n, c in below.items()],
        F.count("*").alias("hours"))


def percentile_reward(model_loss: Column, base_loss: Column, parse_ok: Column, reordered: Column,
                      scale: Column | None = None) -> Column:
    """Skill against the baseline, minus a penalty for unordered quantiles; invalid answers get the fixed worst."""
    skill = S.relative_skill(model_loss, base_loss)
    if scale is not None:
        skill = F.when(F.coalesce(scale, F.lit(0.0)) != 0, S.scaled_skill(model_loss, base_loss, scale)).otherwise(skill)
    less = skill - F.when(F.coalesce(reordered, F.lit(False)), UNORDERED_PENALTY).otherwise(0.0)
    return F.when(F.coalesce(parse_ok, F.lit(False)), F.greatest(less, F.lit(INVALID_REWARD))).otherwise(INVALID_REWARD)


def apply_scale(df: DataFrame, scale: Column | str, prefix: str = "") -> DataFrame:
    """Widen or tighten an interval around its median."""
    scale, m = col(scale), F.col(f"{prefix}p50")
    return df.withColumns({f"{prefix}{q}": m + scale * (F.col(f"{prefix}{q}") - m) for q in ("p10", "p90")})


def scale_rewards(baseline: DataFrame, scales: DataFrame) -> DataFrame:
    """Reward of answering only with a width factor. baseline: id, he, quantiles, y; scales: id, scale (null = invalid)."""
    rows = baseline.join(scales, "id")
    scaled = apply_scale(rows.withColumns({f"m_{q}": F.col(q) for q in Q}), "scale", "m_")
    sums = scaled.groupBy("id").agg(F.first("scale").alias("scale"), F.avg(S.quantile_loss("y")).alias("_base"),
                                    F.avg(S.quantile_loss("y", "m_")).alias("_model"))
    return sums.select("id", "scale", F.when(F.col("scale").isNull(), INVALID_REWARD).otherwise(
        S.relative_skill(F.col("_model"), F.col("_base"))).alias("reward"))


def zone_reward_scale(examples: DataFrame, is_train: Column) -> DataFrame:
    """Median training loss per zone attached to every example. A zone's group is bounded by its days."""
    scale = examples.filter(is_train).groupBy("zone").agg(F.round(F.percentile("loss", F.lit(0.5)), 2).alias("reward_scale"))
    return examples.join(scale, "zone", "left")


def score_completions(parsed: DataFrame, baseline: DataFrame) -> DataFrame:
    """Score parsed completions. parsed: id, parse_ok, reordered, hours map he -> (p10, p50, p90);
    baseline: id, he, base quantiles, y. Unparsed rows keep null model scores."""
    # an id has a few hours, so its baseline folds to one row and the answers are read once
    hourly = baseline.groupBy("id").agg(F.collect_list(F.struct("hour_ending", "y", *[F.col(q).alias(f"b_{q}") for q in Q])).alias("_rows"))
    given = F.try_element_at("hours", F.col("_r.hour_ending").cast("int"))
    rows = parsed.join(hourly, "id").select("id", "parse_ok", "reordered", "hours", F.explode("_rows").alias("_r")).select(
        "id", "parse_ok", "reordered", "_r.*", *[given[q].alias(q) for q in Q])
    out = rows.groupBy("id", "parse_ok", "reordered").agg(
        F.avg(S.quantile_loss("y")).alias("pinball"), F.avg(S.quantile_loss("y", "b_")).alias("baseline_pinball"),
        F.avg(S.covered("y")).alias("covered"), F.avg(F.col("p90") - F.col("p10")).alias("width"))
    reward = percentile_reward(F.col("pinball"), F.col("baseline_pinball"), F.col("parse_ok"), F.col("reordered"))
    blank = lambda c: F.when(F.col("parse_ok"), F.col(c)).alias(c)
    return out.select("id", reward.alias("reward"), "parse_ok", blank("pinball"), "baseline_pinball", blank("covered"), blank("width"))


def echo_run(baseline: DataFrame, name: str) -> DataFrame:
    """The baseline's own quantiles as a run; its reward is zero by construction."""
    return baseline.withColumn("run", F.lit(name))


# ---------------------------------------------------------------- typed answers
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def as_number(v: Column) -> Column:
    plain = F.trim(F.regexp_replace(v, "[,$]", ""))
    return F.when(plain.rlike(_NUMBER), plain.try_cast("double"))


def as_minute(v: Column, tz: Column) -> Column:
    """Timestamp text to wall time in the answer's zone, floored to the minute; an offset in the text is honoured."""
    text = F.trim(v)
    zone = F.regexp_extract(text, r"(?:[+-]\d{2}:?\d{2}|Z)$", 0)
    naive = F.regexp_replace(text, r"\s*(?:(?<=:\d\d)[+-]\d{2}:?\d{2}|Z)$", "").try_cast("timestamp_ntz")
    sign = F.when(zone.startswith("-"), -1).otherwise(1)
    digits = F.regexp_replace(zone, r"[^0-9]", "")
    offset = F.when(F.length(digits) == 4, sign * (F.substring(digits, 1, 2).try_cast("int") * 60
                                                   + F.substring(digits, 3, 2).try_cast("int"))).otherwise(0)
    has_zone = F.length(zone) > 0
    utc = naive - T.minutes(F.coalesce(offset, F.lit(0)))
    tz = F.coalesce(tz, F.lit(LOCAL_TZ))
    local = F.when(tz == "UTC", utc).when(tz == LOCAL_TZ, T.utc_to_local(utc)).otherwise(F.convert_timezone(F.lit("UTC"), tz, utc))
    return T.floor_minutes(F.when(has_zone, local).otherwise(naive), 1)


def as_category(v: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(v), r"^['\"]+|['\"]+$", ""))


def answer_matches(kind: Column, expected: Column, got: Column, tol_abs: Column, tol_rel: Column, tz: Column,
                   ordered: Column) -> Column:
    """Tolerant comparison; `expected` and `got` are string arrays (one element for scalar answers)."""
    want, have = F.get(expected, F.lit(0)), F.get(got, F.lit(0))
    w, h = as_number(want), as_number(have)
    number = F.abs(h - w) <= F.greatest(tol_abs, tol_rel * F.abs(w)) + 1e-9
    integer = (F.abs(h - F.rint(h)) < 1e-9) & (F.rint(h) == F.rint(w))
    timestamp = as_minute(have, tz) == as_minute(want, tz)
    category = as_category(have) == as_category(want)
    wl, hl = F.transform(expected, as_category), F.transform(got, as_category)
    unique = F.size(F.array_distinct(hl)) == F.size(hl)
    same_set = F.array_sort(F.array_distinct(hl)) == F.array_sort(F.array_distinct(wl))
    listed = F.when(ordered, hl == wl).otherwise(unique & same_set)
    out = (F.when(kind == "number", number).when(kind == "integer", integer).when(kind == "timestamp", timestamp)
           .when(kind == "category", category).when(kind == "list", listed))
    return F.coalesce(out, F.lit(False))


def answer_outcome(kind: Column, has_sql: Column, ran: Column, n_columns: Column, n_rows: Column, truncated: Column,
                   matches: Column) -> Column:
    shape_ok = F.when(kind == "list", (n_columns == 1) & ~truncated).otherwise((n_columns == 1) & (n_rows == 1))
    return (F.when(~has_sql, "format_error").when(~ran, "sql_error").when(~shape_ok, "format_error")
            .when(matches, "correct").otherwise("wrong_answer"))


def outcome_reward(outcome: Column | str) -> Column:
    outcome = col(outcome)
    return reduce(lambda acc, kv: acc.when(outcome == kv[0], kv[1]), list(REWARDS.items())[1:],
                  F.when(outcome == "correct", REWARDS["correct"]))


def grade(truth: DataFrame, answers: DataFrame) -> DataFrame:
    """Grade submitted answers. answers: task_id, has_sql, ran, n_columns, values (array), one row per task.

    A boolean column `truncated`, if the answers have it, says which lists a query run has cut."""
    rows = truth.join(answers, "task_id")
    matches = answer_matches(F.col("answer_type"), F.col("expected"), F.col("values"), F.col("tol_abs"), F.col("tol_rel"),
                             F.col("tz"), F.col("ordered"))
    n = F.size("values")
    cut = F.coalesce("truncated", F.lit(False)) if "truncated" in answers.columns else F.lit(False)
    outcome = answer_outcome(F.col("answer_type"), F.col("has_sql"), F.col("ran"), F.col("n_columns"), n, cut, matches)
    return rows.select("task_id", "answer_type", outcome.alias("outcome")).withColumn("reward", outcome_reward("outcome"))
