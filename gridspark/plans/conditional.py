"""Price statistics conditioned on load, generation or forecast error."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.functions import timeconv as T
from gridspark.functions.stats import quantile_at
from gridspark.operators.ranking import first_by_max, top_two_with_margin

MONTH = ["point", "month"]


def net_load(load: DataFrame, fuel: DataFrame, wind: str = "Wind", solar: str = "Solar") -> DataFrame:
    """Hourly load minus the hour's mean wind and solar output."""
    hourly = (fuel.filter(F.col("fuel").isin(wind, solar))
              .groupBy(T.floor_hours("start_utc").alias("start_utc"))
              .agg(F.avg(F.when(F.col("fuel") == wind, F.col("generation"))).alias("_wind"),
                   F.avg(F.when(F.col("fuel") == solar, F.col("generation"))).alias("_solar")))
    return (load.join(hourly, "start_utc")
            .select("start_utc", "operating_date", "month",
                    (F.col("total") - F.col("_wind") - F.col("_solar")).alias("net_load")))


def _floored(value, q: float, step: float):
    return (F.floor(quantile_at(value, F.lit(q)) / step) * step).alias("threshold")


def price_in_high_net_load(rt: DataFrame, net: DataFrame, quantiles: list[float], step: float) -> DataFrame:
    """Average price inside the month's hours above each floored net-load quantile.

    All quantiles come from one grouping; an hour keeps the list of those it passes, which is expanded only after the join and
    the first, per hour, sums."""
    limit = net.groupBy("month").agg(*[_floored("net_load", q, step).alias(f"_q{i}") for i, q in enumerate(quantiles)])
    cells = F.array(*[F.struct(F.lit(q).alias("q"), F.col(f"_q{i}").alias("threshold")) for i, q in enumerate(quantiles)])
    hot = net.join(limit, "month").withColumn("_hot", F.filter(cells, lambda c: F.col("net_load") > c["threshold"])).filter(F.size("_hot") > 0)
    hot = hot.select("start_utc", F.col("month").alias("net_month"), "_hot")
    prices = rt.groupBy("point", T.floor_hours("start_utc").alias("start_utc")).agg(F.sum("price").alias("_s"), F.count("price").alias("_n"))
    rows = prices.join(hot, "start_utc").select("point", F.col("net_month").alias("month"), "_s", "_n", F.explode("_hot").alias("_h"))
    return rows.groupBy("point", "month", F.col("_h.q").alias("q")).agg(
        (F.sum("_s") / F.sum("_n")).alias("avg_price"), F.max("_h.threshold").alias("threshold"))


def fuel_share_peak_day(fuel: DataFrame, fuels: list[str], excluded: str, margin: float = 1e-4) -> DataFrame:
    """Day of the month with the highest share of each fuel in all generation except storage charging."""
    day = fuel.groupBy("month", "operating_date").agg(
        F.sum(F.when(F.col("fuel") != excluded, F.col("energy"))).alias("_all"),
        *[F.sum(F.when(F.col("fuel") == f, F.col("energy"))).alias(f"_e{i}") for i, f in enumerate(fuels)])
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("fuel"), F.try_divide(F.col(f"_e{i}"), F.col("_all")).alias("share"))
                                for i, f in enumerate(fuels)]))
    shares = day.select("month", "operating_date", cells.alias("c")).select("month", "operating_date", "c.fuel", "c.share")
    return top_two_with_margin(shares, ["month", "fuel"], "share", "operating_date", margin)


def generation_when_negative(rt: DataFrame, fuel: DataFrame, fuel_name: str, min_intervals: int = 4) -> DataFrame:
    gen = fuel.filter(F.col("fuel") == fuel_name).select("start_utc", "generation")
    low = rt.filter(F.col("price") < 0).select(*MONTH, "start_utc")
    return (low.join(gen, "start_utc").groupBy(*MONTH)
            .agg(F.count("*").alias("intervals"), F.avg("generation").alias("avg_generation"))
            .filter(F.col("intervals") >= min_intervals))


def price_in_high_load(da: DataFrame, load: DataFrame, quantiles: list[float], step: float) -> DataFrame:
    """Average hourly price in the hours whose load exceeds floored monthly load quantiles."""
    limits = load.groupBy("month").agg(*[
        (F.floor(quantile_at("total", F.lit(q)) / step) * step).alias(f"_x{i}") for i, q in enumerate(quantiles)])
    hours = load.join(limits, "month").select("start_utc", "total", *[f"_x{i}" for i in range(len(quantiles))])
    joined = da.select(*MONTH, "start_utc", "price").join(hours, "start_utc")
    over = [F.avg(F.when(F.col("total") > F.col(f"_x{i}"), F.col("price"))).alias(f"_a{i}") for i in range(len(quantiles))]
    cells = F.explode(F.array(*[F.struct(F.lit(q).alias("quantile"), F.col(f"_a{i}").alias("avg_price"))
                                for i, q in enumerate(quantiles)]))
    return (joined.groupBy(*MONTH).agg(*over).select(*MONTH, cells.alias("c"))
            .select(*MONTH, "c.quantile", "c.avg_price").filter(F.col("avg_price").isNotNull()))


def generation_at_peak(rt: DataFrame, fuel: DataFrame, fuels: list[str]) -> DataFrame:
    """Total output of the given fuels in each point's highest-priced interval of the month."""
    peak = first_by_max(rt, MONTH, "price", "start_utc", ["start_utc"])
    gen = (fuel.filter(F.col("fuel").isin(fuels)).groupBy("start_utc").agg(F.sum("generation").alias("generation")))
    return peak.join(gen, "start_utc").select(*MONTH, "start_utc", "generation")


def load_weighted_average(rt: DataFrame, load: DataFrame) -> DataFrame:
    hourly = rt.groupBy(*MONTH, T.floor_hours("start_utc").alias("start_utc")).agg(F.avg("price").alias("_p"))
    both = hourly.join(load.select("start_utc", "total"), "start_utc")
    return both.groupBy(*MONTH).agg(F.try_divide(F.sum(F.col("_p") * F.col("total")), F.sum("total")).alias("avg_price"))


def price_at_peak_net_load(rt: DataFrame, net: DataFrame, margin: float = 1.0) -> DataFrame:
    top = top_two_with_margin(net, ["month"], "net_load", "start_utc", margin)
    prices = rt.select("point", "price", T.floor_hours("start_utc").alias("start_utc"))
    return (prices.join(top, "start_utc").groupBy("point", "month", "start_utc").agg(F.avg("price").alias("avg_price")))


# ---------------------------------------------------------------- forecast error
def forecast_error_day(fc: DataFrame) -> DataFrame:
    e = F.col("forecast") - F.col("actual")
    return fc.groupBy("zone", "operating_date").agg(F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("bias"))


def over_forecast_hour(fc: DataFrame, margin: float = 0.01) -> DataFrame:
    e = fc.filter(~T.is_change_day("operating_date")).withColumn("over", F.col("forecast") - F.col("actual"))
    return top_two_with_margin(e, ["zone", "operating_date"], "over", "hour_ending", margin)


def price_when_over_forecast(rt: DataFrame, fc: DataFrame, step: float) -> DataFrame:
    """Average price in the hours whose shortfall exceeds the day's floored median absolute error."""
    keys = ["zone", "operating_date"]
    limit = fc.groupBy(*keys).agg(_floored(F.abs(F.col("forecast") - F.col("actual")), 0.5, step))
    short = (fc.join(limit, keys).filter(F.col("forecast") - F.col("actual") > F.col("threshold"))
             .select(*keys, "start_utc", "threshold"))
    prices = rt.select("point", "price", T.floor_hours("start_utc").alias("start_utc"))
    return (prices.join(short, "start_utc").groupBy("point", *keys)
            .agg(F.avg("price").alias("avg_price"), F.max("threshold").alias("threshold")))


def forecast_peak_hour(fc: DataFrame, margin: float = 0.01) -> DataFrame:
    normal = fc.filter(~T.is_change_day("operating_date"))
    return top_two_with_margin(normal, ["zone", "operating_date"], "forecast", "hour_ending", margin)
