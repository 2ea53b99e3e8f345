"""Price statistics by point and period: averages, extremes, time-convention lookups, spreads, thresholds.

Every job takes interval frames with the standard time columns and answers for all points and periods at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridspark.constants import PRICE_THRESHOLDS
from gridspark.functions import timeconv as T
from gridspark.operators.intervals import longest_runs, spike_counts
from gridspark.operators.ranking import first_by_max, top_two_with_margin

DAY = ["point", "operating_date"]
MONTH = ["point", "month"]


# ---------------------------------------------------------------- basic aggregates
def period_average(df: DataFrame, keys: list[str], value: str = "price", scale: float = 1.0) -> DataFrame:
    return df.groupBy(*keys).agg((F.avg(value) / scale).alias("avg_price"))


def period_max(df: DataFrame, keys: list[str] = MONTH) -> DataFrame:
    return df.groupBy(*keys).agg(F.max("price").alias("max_price"))


def period_min(df: DataFrame, keys: list[str] = MONTH) -> DataFrame:
    return df.groupBy(*keys).agg(F.min("price").alias("min_price"))


# ---------------------------------------------------------------- time conventions
def price_by_hour_ending(da: DataFrame) -> DataFrame:
    """Hourly price by label; clock-change days are left out because labels repeat or go missing there."""
    return da.filter(~T.is_change_day("operating_date")).select(*DAY, "hour_ending", "price")


def price_by_utc_start(rt: DataFrame) -> DataFrame:
    return rt.select("point", "start_utc", "price")


def hourly_average_by_label(rt: DataFrame) -> DataFrame:
    normal = rt.filter(~T.is_change_day("operating_date"))
    return normal.groupBy(*DAY, "hour_ending").agg(F.avg("price").alias("avg_price"))


def repeated_hour_prices(da: DataFrame) -> DataFrame:
    """Both occurrences of the hour that happens twice on the autumn change day."""
    fall = da.filter((F.col("hour_ending") == 2) & (T.hours_in_day("operating_date") == 25))
    return fall.select(*DAY, F.when(F.col("repeated_hour"), "second").otherwise("first").alias("occurrence"), "price")


def interval_counts(rt: DataFrame) -> DataFrame:
    return (rt.groupBy(*DAY).agg(F.count("*").alias("intervals"))
            .withColumn("expected", T.hours_in_day("operating_date") * 4))


def peak_interval_utc(rt: DataFrame) -> DataFrame:
    return first_by_max(rt, DAY, "price", "start_utc", ["start_utc"])


def change_day_average(da: DataFrame, require_complete: bool = True) -> DataFrame:
    out = (da.filter(T.is_change_day("operating_date")).groupBy(*DAY)
           .agg(F.avg("price").alias("avg_price"), F.count("*").alias("hours")))
    return out.filter(F.col("hours") == T.hours_in_day("operating_date")) if require_complete else out


# ---------------------------------------------------------------- spreads
def market_spread_day(da: DataFrame, rt: DataFrame) -> DataFrame:
    a = da.groupBy(*DAY).agg(F.avg("price").alias("da_avg"))
    b = rt.groupBy(*DAY).agg(F.avg("price").alias("rt_avg"))
    return a.join(b, DAY).select(*DAY, (F.col("da_avg") - F.col("rt_avg")).alias("spread"))


def _pair_difference(df: DataFrame, period: str, pairs: list[tuple[str, str]]) -> DataFrame:
    """avg(a) - avg(b) per period for fixed point pairs, from one pass over the prices."""
    points = sorted({p for pair in pairs for p in pair})
    avgs = (df.filter(F.col("point").isin(points)).groupBy(period)
            .agg(*[F.avg(F.when(F.col("point") == p, F.col("price"))).alias(f"_{p}") for p in points]))
    cells = F.explode(F.array(*[
        F.struct(F.lit(a).alias("point_a"), F.lit(b).alias("point_b"), (F.col(f"_{a}") - F.col(f"_{b}")).alias("diff"))
        for a, b in pairs]))
    return (avgs.select(period, cells.alias("c")).select(period, "c.point_a", "c.point_b", "c.diff")
            .filter(F.col("diff").isNotNull()))


def basis_month(rt: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    return _pair_difference(rt, "month", pairs).withColumnRenamed("diff", "basis")


def highest_average_point(df: DataFrame, prefix: str = "", margin: float = 0.005) -> DataFrame:
    avgs = df.filter(F.col("point").startswith(prefix)).groupBy("month", "point").agg(F.avg("price").alias("avg_price"))
    return top_two_with_margin(avgs, ["month"], "avg_price", "point", margin)


def largest_market_gap_hour(da: DataFrame, rt: DataFrame, margin: float = 0.01) -> DataFrame:
    keys = DAY + ["hour_ending"]
    hourly = rt.groupBy(*keys).agg(F.avg("price").alias("_rt"))
    gap = (da.filter(~T.is_change_day("operating_date")).join(hourly, keys)
           .select(*keys, F.abs(F.col("price") - F.col("_rt")).alias("gap")))
    return top_two_with_margin(gap, DAY, "gap", "hour_ending", margin)


def widest_spread_day(rt: DataFrame, pairs: list[tuple[str, str]], margin: float = 0.01) -> DataFrame:
    by_day = _pair_difference(rt, "operating_date", pairs).withColumn("month", T.month_key("operating_date"))
    return top_two_with_margin(by_day, ["point_a", "point_b", "month"], "diff", "operating_date", margin)


# ---------------------------------------------------------------- threshold events
def counts_above(df: DataFrame, thresholds: list[float] = PRICE_THRESHOLDS) -> DataFrame:
    """Intervals strictly above each threshold; all thresholds are counted in one pass."""
    counts = df.groupBy(*MONTH).agg(*[F.count_if(F.col("price") > x).alias(f"_n{i}") for i, x in enumerate(thresholds)])
    cells = F.explode(F.array(*[F.struct(F.lit(float(x)).alias("threshold"), F.col(f"_n{i}").alias("intervals"))
                                for i, x in enumerate(thresholds)]))
    return (counts.select(*MONTH, cells.alias("c")).select(*MONTH, "c.threshold", "c.intervals")
            .filter(F.col("intervals") > 0))


def negative_hours(da: DataFrame) -> DataFrame:
    return (da.groupBy(*MONTH).agg(F.count_if(F.col("price") < 0).alias("hours")).filter(F.col("hours") > 0))


def longest_run_month(rt: DataFrame, thresholds: list[float] = PRICE_THRESHOLDS[:6]) -> DataFrame:
    return longest_runs(rt, MONTH, "start_utc", "price", thresholds)


def peak_local_time(rt: DataFrame) -> DataFrame:
    """Local wall time of the monthly maximum; dropped where the wall time is ambiguous."""
    peak = first_by_max(rt, MONTH, "price", "start_utc", ["start_utc", "start_local"])
    return peak.filter(~T.is_ambiguous("start_local"))


def days_exceeding(rt: DataFrame, thresholds: list[float] = PRICE_THRESHOLDS[2:]) -> DataFrame:
    """Sorted list of days with any price above a threshold, for months with any such day."""
    daily = rt.groupBy(*MONTH, "operating_date").agg(F.max("price").alias("_top"))
    flags = F.array(*[F.when(F.col("_top") > x, F.lit(float(x))) for x in thresholds])
    hits = daily.select(*MONTH, "operating_date", F.explode(F.filter(flags, lambda t: t.isNotNull())).alias("threshold"))
    return hits.groupBy(*MONTH, "threshold").agg(F.array_sort(F.collect_set("operating_date")).alias("days"))


def spike_events(rt: DataFrame, thresholds: list[float], min_lengths: list[int]) -> DataFrame:
    return spike_counts(rt, ["point"], "start_utc", "operating_date", "price", thresholds, min_lengths)


# ---------------------------------------------------------------- blocks, shares, year over year
def block_averages(da: DataFrame) -> DataFrame:
    block = T.block_label("operating_date", "hour_ending")
    return da.groupBy(*MONTH, block.alias("block")).agg(F.avg("price").alias("avg_price"))


def change_day_offpeak_average(rt: DataFrame) -> DataFrame:
    he = F.col("hour_ending")
    off = rt.filter(T.is_change_day("operating_date") & ((he <= 6) | (he >= 23)))
    return off.groupBy(*DAY).agg(F.avg("price").alias("avg_price"))


def share_above_market(rt: DataFrame, da: DataFrame) -> DataFrame:
    hourly = (rt.groupBy("point", T.floor_hours("start_utc").alias("start_utc"))
              .agg(F.avg("price").alias("_rt")))
    both = da.join(hourly, ["point", "start_utc"])
    return both.groupBy(*MONTH).agg((100.0 * F.avg((F.col("_rt") > F.col("price")).cast("int"))).alias("share_pct"))


def year_over_year(da: DataFrame, floor: float = 1.0) -> DataFrame:
    """Percent change of the monthly average against the same month a year earlier."""
    now = da.groupBy("point", F.trunc("operating_date", "MM").alias("_m")).agg(F.avg("price").alias("new_avg"))
    # one row per point and month is left, so a point's group is bounded by the calendar
    year_ago = Window.partitionBy("point").orderBy(F.year("_m") * 12 + F.month("_m")).rangeBetween(-12, -12)
    both = now.withColumn("old_avg", F.max("new_avg").over(year_ago)).filter(F.abs("old_avg") >= floor)
    return both.select("point", T.month_key("_m").alias("month"),
                       ((F.col("new_avg") - F.col("old_avg")) / F.col("old_avg") * 100).alias("change_pct"))
