"""Gaps, runs and spikes over interval series.

Windows never span an entity's whole history: they are cut by month, and what a row needs from the neighbouring
month is either padded in (runs) or stitched from per-month edges (gaps). One entity with a third of all rows
thus spreads over as many tasks as it has months.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridspark.functions import timeconv as T


def gaps(df: DataFrame, entity: list[str], start: str, expected_minutes: int) -> DataFrame:
    """Consecutive starts further apart than one interval: entity, gap_from, gap_to, gap_minutes."""
    chunk = F.trunc(F.col(start).cast("date"), "MM")
    rows = df.select(*entity, F.col(start).alias("gap_to"), chunk.alias("_chunk"))
    inside = rows.withColumn("gap_from", F.lag("gap_to").over(Window.partitionBy(*entity, "_chunk").orderBy("gap_to")))
    edges = rows.groupBy(*entity, "_chunk").agg(F.min("gap_to").alias("gap_to"), F.max("gap_to").alias("_last"))
    # one row per entity and month is left here, so ordering an entity's months is cheap
    across = edges.withColumn("gap_from", F.lag("_last").over(Window.partitionBy(*entity).orderBy("_chunk")))
    both = inside.select(*entity, "gap_from", "gap_to").unionByName(across.select(*entity, "gap_from", "gap_to"))
    minutes = T.interval_minutes(F.col("gap_to") - F.col("gap_from"))
    return (both.filter(F.col("gap_from").isNotNull()).withColumn("gap_minutes", minutes)
            .filter(F.col("gap_minutes") > expected_minutes))


def longest_runs(df: DataFrame, keys: list[str], order: str, value: str, thresholds: list[float]) -> DataFrame:
    """Longest run of consecutive rows at or above each threshold, inside each group.

    One sort serves all thresholds: a row's run length is its position minus that of the last low row."""
    w = Window.partitionBy(*keys).orderBy(order)
    rows = df.select(*keys, order, value).withColumn("_rn", F.row_number().over(w))
    run = {}
    for i, x in enumerate(thresholds):
        low = ~F.coalesce(F.col(value) >= x, F.lit(False))
        run[f"_r{i}"] = F.col("_rn") - F.coalesce(F.max(F.when(low, F.col("_rn"))).over(w), F.lit(0))
    best = rows.withColumns(run).groupBy(*keys).agg(*[F.max(f"_r{i}").alias(f"_m{i}") for i in range(len(thresholds))])
    pairs = F.explode(F.array(*[F.struct(F.lit(float(x)).alias("threshold"), F.col(f"_m{i}").alias("longest"))
                                for i, x in enumerate(thresholds)]))
    return (best.select(*keys, pairs.alias("p")).select(*keys, "p.threshold", "p.longest")
            .filter(F.col("longest") > 0))


def padded_months(df: DataFrame, day: str, pad_days: int = 2) -> DataFrame:
    """Copy rows within `pad_days` of a month edge into the neighbouring month's group as well."""
    d = F.col(day)
    months = F.array_distinct(F.array(T.month_key(d), T.month_key(F.date_sub(d, pad_days)),
                                      T.month_key(F.date_add(d, pad_days))))
    return df.withColumn("target_month", F.explode(months))


def spike_counts(df: DataFrame, entity: list[str], order: str, day: str, value: str,
                 thresholds: list[float], min_lengths: list[int]) -> DataFrame:
    """Maximal runs at or above a threshold with a minimum length, counted in the month they start in."""
    rows = padded_months(df.select(*entity, order, day, value), day)
    w = Window.partitionBy(*entity, "target_month").orderBy(order)
    longest = max(min_lengths)
    rows = rows.withColumns({f"_h{i}": F.coalesce(F.col(value) >= x, F.lit(False)) for i, x in enumerate(thresholds)})
    around = {}
    for i in range(len(thresholds)):
        around[f"_b{i}"] = F.coalesce(F.lag(f"_h{i}").over(w), F.lit(False))
        for k in range(1, longest):
            around[f"_a{i}_{k}"] = F.coalesce(F.lead(f"_h{i}", k).over(w), F.lit(False))
    rows = rows.withColumns(around)

    def starts_run(i: int, k: int):
        ahead = [F.col(f"_a{i}_{j}") for j in range(1, k)]
        return reduce(lambda a, b: a & b, ahead, F.col(f"_h{i}") & ~F.col(f"_b{i}"))

    mine = rows.filter(F.col("target_month") == T.month_key(day))
    cells = [(i, x, k) for i, x in enumerate(thresholds) for k in min_lengths]
    counts = mine.groupBy(*entity, F.col("target_month").alias("month")).agg(
        *[F.count_if(starts_run(i, k)).alias(f"_n{i}_{k}") for i, _, k in cells])
    pairs = F.explode(F.array(*[
        F.struct(F.lit(float(x)).alias("threshold"), F.lit(k).alias("min_length"), F.col(f"_n{i}_{k}").alias("events"))
        for i, x, k in cells]))
    return (counts.select(*entity, "month", pairs.alias("p"))
            .select(*entity, "month", "p.threshold", "p.min_length", "p.events").filter(F.col("events") > 0))
