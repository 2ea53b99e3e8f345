"""Data-quality metrics, completeness sets and leakage guards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.functions import timeconv as T
from gridspark.operators.intervals import gaps


# ---------------------------------------------------------------- profile
def table_profile(df: DataFrame, entity: str | None, name: str) -> DataFrame:
    n_ent = F.count_distinct(F.col(entity)) if entity else F.lit(1)
    return df.agg(F.lit(name).alias("table_name"), F.count("*").alias("n_rows"), n_ent.alias("entities"),
                  F.min("start_utc").alias("first_start"), F.max("start_utc").alias("last_start"),
                  F.min("operating_date").alias("first_day"), F.max("operating_date").alias("last_day"))


def rows_per_month(df: DataFrame) -> DataFrame:
    return df.groupBy(T.month_key("operating_date").alias("month")).agg(F.count("*").alias("n_rows"))


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once, with their multiplicity."""
    return df.groupBy(*key).agg(F.count("*").alias("copies")).filter(F.col("copies") > 1)


def gap_report(df: DataFrame, entity: list[str], minutes: int, top: int = 5) -> tuple[DataFrame, DataFrame]:
    """Number of gaps, and the largest few."""
    found = gaps(df, entity, "start_utc", minutes)
    return found.agg(F.count("*").alias("gaps")), found.orderBy(F.desc("gap_minutes"), *entity, "gap_from").limit(top)


def change_day_counts(df: DataFrame, entity: str | None, per_hour: int) -> DataFrame:
    """Intervals per entity on clock-change days against the expected 23 or 25 hours."""
    n_ent = df.select(F.count_distinct(F.col(entity))).scalar() if entity else F.lit(1)
    days = (df.filter(T.is_change_day("operating_date")).groupBy("operating_date")
            .agg(F.count("*").alias("_n"), F.sum(F.col("repeated_hour").cast("int")).alias("_r")))
    return days.select("operating_date", (F.col("_n") / n_ent).alias("per_entity"),
                       (F.col("_r") / n_ent).alias("repeated_per_entity"),
                       (T.hours_in_day("operating_date") * per_hour).alias("expected"))


def null_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """Share of nulls per column: one pass, then one row per column."""
    rates = df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in columns])
    return rates.unpivot([], columns, "column_name", "null_rate")


def column_catalog(df: DataFrame, name: str) -> DataFrame:
    """Column names and types in order, next to the table's coverage."""
    cover = df.agg(F.min("operating_date").alias("first_day"), F.max("operating_date").alias("last_day"))
    fields = F.explode(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("type_name"))
        for i, f in enumerate(df.schema.fields)]))
    return cover.select(F.lit(name).alias("table_name"), "first_day", "last_day", fields.alias("f")).select(
        "table_name", "first_day", "last_day", "f.position", "f.column_name", "f.type_name")


def issues(df: DataFrame, name: str, entity: str | None, minutes: int, null_limit: float = 0.001) -> DataFrame:
    """One row per violated rule: duplicates, gaps, short or long change days, null rates."""
    ent = [entity] if entity else []
    rows = [
        duplicate_keys(df, ent + ["start_utc"]).agg(F.count("*").cast("double").alias("amount"))
        .select(F.lit("duplicate keys").alias("rule"), F.lit("").alias("detail"), "amount"),
        gaps(df, ent, "start_utc", minutes).agg(F.count("*").cast("double").alias("amount"))
        .select(F.lit("gaps").alias("rule"), F.lit("").alias("detail"), "amount"),
        change_day_counts(df, entity, 60 // minutes).filter(F.col("per_entity") != F.col("expected"))
        .select(F.lit("change day").alias("rule"), F.date_format("operating_date", "yyyy-MM-dd").alias("detail"),
                F.col("per_entity").alias("amount")),
        null_rates(df, df.columns).filter(F.col("null_rate") > null_limit)
        .select(F.lit("nulls").alias("rule"), F.col("column_name").alias("detail"), F.col("null_rate").alias("amount")),
    ]
    both = reduce(DataFrame.unionByName, rows).filter(F.col("amount") > 0)
    return both.select(F.lit(name).alias("table_name"), "rule", "detail", "amount")


# ---------------------------------------------------------------- completeness
def complete_days(df: DataFrame, per_hour: int, entity: str | None = None) -> DataFrame:
    """Days whose row count is intervals per hour x hours in the local day x entities."""
    days = df.groupBy("operating_date").agg(F.count("*").alias("_n"))
    full = T.hours_in_day("operating_date") * per_hour
    if entity:
        n_ent = df.select(F.count_distinct(F.col(entity))).scalar()
        return days.filter(F.col("_n") == full * n_ent).select("operating_date")
    return days.filter(F.col("_n") == full).select("operating_date")


def common_days(tables: list[DataFrame], years: list[int] | None = None, kind: str = "any") -> DataFrame:
    """Days present in every set, once each; kind keeps all, only normal, or only spring/fall/any change days.

    The hours are a sum over a day's one row: a plain filter would be pushed below the aggregates that make the days (and a maximum would
    take their place) and be evaluated for every raw row, where the day stands for a long expression that the JVM does not compile."""
    out = reduce(DataFrame.intersect, tables).select("operating_date").distinct()
    if years is not None:
        out = out.filter(F.year("operating_date").isin(*years))
    h = F.col("_hours")
    keep = {"any": F.lit(True), "normal": h == 24, "change": h != 24, "spring": h == 23, "fall": h == 25}[kind]
    days = out.groupBy("operating_date").agg(F.sum(T.hours_in_day("operating_date")).alias("_hours"))
    return days.filter(keep).select("operating_date")


def complete_months(days: DataFrame) -> DataFrame:
    first = F.trunc("operating_date", "MM")
    return (days.groupBy(first.alias("_m")).agg(F.count("*").alias("_n"))
            .filter(F.col("_n") == F.day(F.last_day("_m"))).select(T.month_key("_m").alias("month")))


def entities(df: DataFrame, column: str, prefix: str = "") -> DataFrame:
    return df.filter(F.col(column).startswith(prefix)).select(column).distinct()


# ---------------------------------------------------------------- guards
class LeakageError(AssertionError):
    """Inputs that were not available at the cutoff."""


def violations(df: DataFrame, source: str, time: Column, limit: Column, null_is_bad: bool) -> DataFrame:
    ok = time < limit
    bad = ~F.coalesce(ok, F.lit(False)) if null_is_bad else F.coalesce(~ok, F.lit(False))
    return df.filter(bad).select(F.lit(source).alias("source"), time.alias("known_at"), limit.alias("limit_at"))


def vintage_violations(df: DataFrame) -> DataFrame:
    limit = T.cutoff_utc("operating_date") - T.hours(F.when(F.col("vintage") == "prev", 24).otherwise(0))
    return violations(df, "vintage", F.col("publish_time"), limit, null_is_bad=True)


def leakage_summary(parts: list[DataFrame]) -> DataFrame:
    """Violations per source over several inputs, with the latest offending time as a sample."""
    both = reduce(DataFrame.unionByName, parts)
    return both.groupBy("source").agg(F.count("*").alias("violations"), F.max("known_at").alias("latest"))


def assert_none(bad: DataFrame, what: str) -> None:
    """Raise with a short sample when any violation exists; only the sample reaches the driver."""
    sample = bad.limit(5).collect()
    if sample:
        raise LeakageError(f"{what}: rows at or after their limit, for example {sample[:3]}")


def assert_unique(df: DataFrame, key: list[str]) -> None:
    sample = duplicate_keys(df, key).limit(3).collect()
    if sample:
        raise AssertionError(f"duplicate keys {sample}")


def split_overlaps(df: DataFrame, label: str, day: str, order: list[str]) -> DataFrame:
    """Pairs of consecutive splits whose day ranges are not strictly ordered (empty when sound)."""
    spans = df.groupBy(label).agg(F.min(day).alias("lo"), F.max(day).alias("hi"))
    pairs = None
    for a, b in zip(order, order[1:]):
        left = spans.filter(F.col(label) == a).select(F.lit(f"{a}<{b}").alias("pair"), F.col("hi").alias("a_hi"))
        right = spans.filter(F.col(label) == b).select(F.lit(f"{a}<{b}").alias("pair"), F.col("lo").alias("b_lo"))
        hit = left.join(right, "pair").filter(F.col("a_hi") >= F.col("b_lo"))
        pairs = hit if pairs is None else pairs.unionByName(hit)
    return pairs


def weight_sums(points: DataFrame) -> DataFrame:
    return points.groupBy("zone").agg(F.sum("weight").alias("weight_sum"), F.count("*").alias("points"))
