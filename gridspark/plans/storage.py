"""Storage revenue: fixed schedules, the best single cycle, and the two-hour optimum."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = ["point", "operating_date"]


@dataclass(frozen=True)
class Schedule:
    name: str
    mw: float
    eff: float
    charge: tuple[int, int]
    discharge: tuple[int, int]

    def cash(self, price: Column, he: Column) -> Column:
        return (F.when(he.between(*self.discharge), self.mw * self.eff * price)
                .when(he.between(*self.charge), -self.mw * price).otherwise(F.lit(0.0)))


def schedule_revenue(prices: DataFrame, keys: list[str], schedules: list[Schedule], hours_per_row: float = 1.0) -> DataFrame:
    """Net revenue of every fixed schedule per group, all schedules in one pass."""
    he = F.col("hour_ending")
    sums = prices.groupBy(*keys).agg(*[
        F.sum(s.cash(F.col("price"), he) * hours_per_row).alias(f"_s{i}") for i, s in enumerate(schedules)])
    cells = F.explode(F.array(*[F.struct(F.lit(s.name).alias("schedule"), F.col(f"_s{i}").alias("revenue"))
                                for i, s in enumerate(schedules)]))
    return sums.select(*keys, cells.alias("c")).select(*keys, "c.schedule", "c.revenue")


def best_single_cycle(da: DataFrame, efficiencies: list[float], mw: float = 1.0) -> DataFrame:
    """Charge once, discharge once later the same day. The cheapest earlier hour is a running minimum,
    so the later-than self join is not needed. A group is one point-day, so at most 25 rows."""
    w = Window.partitionBy(*DAY).orderBy("start_utc").rowsBetween(Window.unboundedPreceding, -1)
    rows = da.select(*DAY, "start_utc", "price").withColumn("_low", F.min("price").over(w))
    gains = rows.groupBy(*DAY).agg(*[
        F.max(mw * (e * F.col("price") - F.col("_low"))).alias(f"_g{i}") for i, e in enumerate(efficiencies)])
    cells = F.explode(F.array(*[F.struct(F.lit(e).alias("eff"), F.greatest(F.lit(0.0), F.col(f"_g{i}")).alias("revenue"))
                                for i, e in enumerate(efficiencies)]))
    return (gains.filter(F.col("_g0").isNotNull()).select(*DAY, cells.alias("c")).select(*DAY, "c.eff", "c.revenue"))


def two_hour_value(prices: Column, eff: float) -> Column:
    """Best revenue over ordered prices for a store of two units, one unit moved per step, empty at both ends.

    The fold keeps the best cash for each fill level; -1e18 stands for a level not reachable yet."""
    none = F.lit(-1e18)
    start = F.struct(F.lit(0.0).alias("e"), none.alias("h"), none.alias("f"))

    def step(best: Column, p: Column) -> Column:
        sell, buy = eff * p, p
        return F.struct(
            F.greatest(best["e"], best["h"] + sell).alias("e"),
            F.greatest(best["h"], best["e"] - buy, best["f"] + sell).alias("h"),
            F.greatest(best["f"], best["h"] - buy).alias("f"))

    return F.aggregate(prices, start, step, lambda best: best["e"])


def two_hour_optimum(da: DataFrame, efficiencies: list[float], hours_required: int | None = 24) -> DataFrame:
    """Optimal revenue per point and day; a group is one point-day, so the collected list is at most 25 long."""
    days = da.groupBy(*DAY).agg(
        F.array_sort(F.collect_list(F.struct("start_utc", "price"))).alias("_rows"))
    if hours_required:
        days = days.filter(F.size("_rows") == hours_required)
    prices = F.transform("_rows", lambda r: r["price"])
    cells = F.explode(F.array(*[F.struct(F.lit(e).alias("eff"), two_hour_value(prices, e).alias("revenue"))
                                for e in efficiencies]))
    return days.select(*DAY, cells.alias("c")).select(*DAY, "c.eff", "c.revenue")
