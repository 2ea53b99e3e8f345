"""Period spines: days, months, half years and fixed-length chunks between two dates."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.functions import timeconv as T


def _range(spark: SparkSession, start: dt.date, end: dt.date, step: str) -> DataFrame:
    seq = F.explode(F.sequence(F.lit(start), F.lit(end), F.expr(f"INTERVAL {step}")))
    return spark.range(1).select(seq.alias("start"))


def days(spark: SparkSession, start: dt.date, end: dt.date) -> DataFrame:
    return _range(spark, start, end, "1 DAY").withColumnRenamed("start", "operating_date")


def month_starts(spark: SparkSession, start: dt.date, end: dt.date) -> DataFrame:
    return _range(spark, start.replace(day=1), end, "1 MONTH")


def month_chunks(spark: SparkSession, start: dt.date, end_exclusive: dt.date) -> DataFrame:
    """[from, to) pieces of a range cut at month starts."""
    m = month_starts(spark, start, end_exclusive - dt.timedelta(days=1))
    return m.select(F.greatest("start", F.lit(start)).alias("from_day"),
                    F.least(F.add_months("start", 1), F.lit(end_exclusive)).alias("to_day"))


def fixed_chunks(spark: SparkSession, start: dt.date, end: dt.date, length: int = 183) -> DataFrame:
    """[first, last] pieces of at most `length` days."""
    c = _range(spark, start, end, f"{length} DAY")
    return c.select(F.col("start").alias("first_day"), F.least(F.date_add("start", length - 1), F.lit(end)).alias("last_day"))


def half_years(spark: SparkSession, start_year: int, today: dt.date) -> DataFrame:
    h = _range(spark, dt.date(start_year, 1, 1), today, "6 MONTH")
    return h.select(F.concat(F.year("start").cast("string"), F.when(F.month("start") == 1, "_Jan_Jun").otherwise("_Jul_Dec")).alias("tag"))


def years(spark: SparkSession, start_year: int, end: dt.date) -> DataFrame:
    return _range(spark, dt.date(start_year, 1, 1), end, "1 YEAR").select(F.year("start").alias("year"))


def interval_starts(days_df: DataFrame, length_minutes: int, day: str = "operating_date") -> DataFrame:
    """Every interval start of each local day, 23 to 25 hours long."""
    n = T.hours_in_day(day) * int(60 / length_minutes)
    index = F.explode(F.sequence(F.lit(0), n - 1))
    rows = days_df.select(day, index.alias("_i"))
    return rows.select((T.midnight_utc(day) + T.minutes(F.col("_i") * length_minutes)).alias("start_utc"))
