"""Top-1 / top-2 picks per group.

Each pick filters `row_number()` to a small constant, which Spark turns into a group limit below the shuffle: a
group holding a third of all rows sends at most that many candidates per map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.functions.timeconv import col


def first_by_max(df: DataFrame, keys: list[str], value: str, tie: str, keep: list[str]) -> DataFrame:
    """The row with the highest value per group; equal values go to the smallest `tie`."""
    w = Window.partitionBy(*keys).orderBy(F.col(value).desc(), F.col(tie))
    top = df.filter(F.col(value).isNotNull()).withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1)
    return top.select(*keys, value, *[c for c in keep if c not in (value, *keys)])


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Keep the last row per key by an explicit order."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def top_two_with_margin(df: DataFrame, keys: list[str], value: str, label: str, min_margin: float,
                        tie: str | None = None) -> DataFrame:
    """Winner per group, dropped when the runner-up is closer than `min_margin`.

    `row_number() <= 2` is pushed below the shuffle as a per-task group limit."""
    w = Window.partitionBy(*keys).orderBy(F.col(value).desc(), F.col(tie or label))
    ranked = (df.filter(F.col(value).isNotNull()).withColumn("_rn", F.row_number().over(w))
              .filter(F.col("_rn") <= 2))
    pair = ranked.groupBy(*keys).agg(
        F.max(F.when(F.col("_rn") == 1, F.col(label))).alias(label),
        F.max(F.when(F.col("_rn") == 1, F.col(value))).alias(value),
        F.max(F.when(F.col("_rn") == 2, F.col(value))).alias("_second"))
    return pair.filter(F.col(value) - F.col("_second") >= min_margin).drop("_second")


def any_true(c: Column | str) -> Column:
    return F.max(col(c).cast("int"))
