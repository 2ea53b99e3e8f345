"""Clips, ordered projections, wide/long reshapes, recodes and keep-last dedup."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.functions.timeconv import col
from gridspark.operators.ranking import latest_per_key


def clip_range(df: DataFrame, start: dt.date, end: dt.date | None, column: str = "start_local") -> DataFrame:
    """Rows whose local start lies in [start, end], both days included."""
    out = df.filter(F.col(column) >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        out = out.filter(F.col(column) < F.lit(end + dt.timedelta(days=1)).cast("timestamp_ntz"))
    return out


def conform(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """Exactly these columns, in this order, cast to these types."""
    return df.select(*[F.col(c).cast(t).alias(c) for c, t in schema.items()])


def recode(c: Column | str, mapping: dict[str, str]) -> Column:
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.element_at(F.create_map(*pairs), col(c))


def melt(df: DataFrame, ids: list[str], mapping: dict[str, str], variable: str, value: str) -> DataFrame:
    """Wide columns to rows, named through a recode; columns missing from the input are skipped."""
    have = [c for c in mapping if c in df.columns]
    long = df.unpivot(ids, have, "_variable", value)
    return long.withColumn(variable, recode("_variable", {c: mapping[c] for c in have})).drop("_variable")


def models_to_columns(df: DataFrame, key: list[str], models: list[str], value: str, prefix: str = "") -> DataFrame:
    """One column per model, duplicates averaged. The model list is given, so no extra pass collects it."""
    wide = df.groupBy(*key).pivot("model", models).agg(F.avg(value))
    return wide.select(*key, *[F.col(m).alias(prefix + m) for m in models])


def model_stats(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """Count, min, max, sample deviation, median and mean over the models of one key, nulls skipped."""
    per_model = df.groupBy(*key, "model").agg(F.avg(value).alias("_v"))
    return per_model.groupBy(*key).agg(
        F.count("_v").alias("n_models"), F.min("_v").alias("fc_min"), F.max("_v").alias("fc_max"),
        F.stddev_samp("_v").alias("fc_std"), F.percentile("_v", F.lit(0.5)).alias("fc_median"),
        F.avg("_v").alias("fc_mean"))


def row_stats(cols: list[str]) -> dict[str, Column]:
    """The same statistics across columns of one row, without a shuffle."""
    have = F.filter(F.array(*[F.col(c).cast("double") for c in cols]), lambda x: x.isNotNull())
    n = F.size(have)
    mean = F.try_divide(F.aggregate(have, F.lit(0.0), lambda a, x: a + x), n)
    ss = F.aggregate(have, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
    srt = F.array_sort(have)
    lower, upper = F.get(srt, F.floor((n - 1) / 2).cast("int")), F.get(srt, F.floor(n / 2).cast("int"))
    return {"n_models": n, "v_min": F.array_min(have), "v_max": F.array_max(have), "v_mean": mean,
            "v_std": F.when(n > 1, F.sqrt(ss / (n - 1))), "v_median": (lower + upper) / 2}


def keep_last(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    return latest_per_key(df, key, order)


def distinct_content(df: DataFrame, content: list[str], row_id: str) -> DataFrame:
    """First row (by id) of every group of identical content.

    The digest is the grouping key and only ids are aggregated, so a text with very many copies costs one id per
    map task; the texts themselves are then picked by a semi join on the unique id."""
    digest = F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in content]))
    first = df.select(digest.alias("_digest"), row_id).groupBy("_digest").agg(F.min(row_id).alias(row_id))
    return df.join(first.select(row_id), row_id, "left_semi")


def stack_all(frames: list[DataFrame]) -> DataFrame:
    """Union by column name; columns missing from a part are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
