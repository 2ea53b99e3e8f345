"""What a forecast is worth: two-settlement storage days and imbalance cost, for a price taker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.constants import COMMIT_BASE, COMMIT_MIN, FLEET, MARKET_REDESIGN
from gridspark.functions.stats import clip

DAY = ["point", "operating_date"]


def fleet_size(fleet: dict = FLEET) -> tuple[float, float]:
    """Power in MW and energy in MWh."""
    return fleet["units"] * fleet["unit_kw"] / 1000, fleet["units"] * fleet["unit_kwh"] / 1000


def complete_price_days(da: DataFrame, rt: DataFrame) -> DataFrame:
    """Days with exactly 24 hourly and 96 quarter-hourly prices."""
    a = da.groupBy(*DAY).agg(F.count("*").alias("_a")).filter(F.col("_a") == 24)
    b = rt.groupBy(*DAY).agg(F.count("*").alias("_b")).filter(F.col("_b") == 96)
    return a.join(b, DAY).select(*DAY)


def commitment_fraction(width: Column | str, reference: Column | str) -> Column:
    """Wider predicted range, smaller day-ahead commitment; no usable width gives the base fraction."""
    width = F.col(width) if isinstance(width, str) else width
    reference = F.col(reference) if isinstance(reference, str) else reference
    usable = width.isNotNull() & ~F.isnan(width) & (width > 0)
    return F.when(usable, clip(COMMIT_BASE * F.try_divide(reference, width), COMMIT_MIN, 1.0)).otherwise(COMMIT_BASE)


def day_ahead_awards(da: DataFrame, fractions: DataFrame, fleet: dict = FLEET) -> DataFrame:
    """Commit energy in the two dearest hours above the marginal cost, on days with all 24 prices.

    A window group is one point-day of 24 hours; completeness comes from the same window as the prices."""
    power, energy = fleet_size(fleet)
    day = Window.partitionBy(*DAY)
    he = F.col("hour_ending")
    rows = da.withColumns({
        "_hours": F.count("*").over(day),
        "night": F.avg(F.when(he <= 6, F.col("price"))).over(day), "_max": F.max("price").over(day),
        "_rank": F.row_number().over(day.orderBy(F.desc("price"), "hour_ending"))}).filter(F.col("_hours") == 24)
    cost = F.col("night") / fleet["rte"] + fleet["degradation"]
    rows = rows.withColumn("_top", (F.col("_rank") <= 2) & (F.col("price") > cost)).join(fractions, DAY)
    tops = F.sum(F.col("_top").cast("int")).over(Window.partitionBy(*DAY, "policy"))
    committed = F.least(F.col("fraction") * power * tops, F.col("fraction") * energy)
    return rows.withColumns({"committed": F.when(tops > 0, committed).otherwise(0.0),
                             "award": F.when(F.col("_top"), committed / tops).otherwise(0.0),
                             "threshold": F.greatest(F.col("_max"), cost)}).select(
        *DAY, "policy", "fraction", "hour_ending", "price", "night", "committed", "award", "threshold")


def held_back_dispatch(awards: DataFrame, rt: DataFrame, fleet: dict = FLEET) -> DataFrame:
    """Real-time discharge of the energy not committed, HE 7-22, after an interval whose price beat the threshold.

    Greedy use of a fixed amount in time order is min(cumulative capacity, amount), so a running sum replaces the
    loop: what an interval gets is the growth of that minimum. A group is one point-day; only days with all 96
    quarter-hours count."""
    power, energy = fleet_size(fleet)
    order = ["hour_ending", "quarter"]
    point_day = Window.partitionBy(*DAY)
    quarters = rt.select(*DAY, *order, F.col("price").alias("rt_price"), F.lag("price").over(point_day.orderBy(*order)).alias("_prev"),
                         F.count("*").over(point_day).alias("_quarters")).filter(F.col("_quarters") == 96)
    rows = quarters.join(awards.withColumnRenamed("price", "da_price"), DAY + ["hour_ending"])
    go = F.col("hour_ending").between(7, 22) & F.coalesce(F.col("_prev") > F.col("threshold"), F.lit(False))
    rows = rows.withColumn("_cap", F.when(go, (power - F.col("award")) * 0.25).otherwise(0.0))
    day = Window.partitionBy(*DAY, "policy").orderBy(*order)
    used = F.sum("_cap").over(day.rowsBetween(Window.unboundedPreceding, 0))
    left = F.lit(energy) - F.col("committed")
    return rows.withColumn("extra_mwh", F.least(used, left) - F.least(used - F.col("_cap"), left))


def settle_days(da: DataFrame, rt: DataFrame, fractions: DataFrame, fleet: dict = FLEET) -> DataFrame:
    """Money per point, whole price day and policy. `fractions`: point, operating_date, policy, fraction.

    Every hour has four quarters on such a day, so day-ahead income is summed from the quarter rows as well."""
    rows = held_back_dispatch(day_ahead_awards(da, fractions, fleet), rt, fleet).groupBy(*DAY, "policy").agg(
        (F.sum(F.col("award") * F.col("da_price")) / 4).alias("da_rev"), F.max("committed").alias("committed"),
        F.max("night").alias("night"), F.max("fraction").alias("fraction"),
        F.sum(F.col("extra_mwh") * F.col("rt_price")).alias("rt_rev"), F.sum("extra_mwh").alias("extra_mwh"))
    rows = rows.withColumn("discharged", F.col("committed") + F.col("extra_mwh"))
    rows = rows.withColumns({"charge_cost": F.col("discharged") / fleet["rte"] * F.col("night"),
                             "wear": F.col("discharged") * fleet["degradation"]})
    return rows.withColumn("total", F.col("da_rev") + F.col("rt_rev") - F.col("charge_cost") - F.col("wear"))


def account(schedule: DataFrame, degradation: float = 0.0) -> DataFrame:
    """Plain two-settlement accounting of given awards and output.

    schedule: keys point/day, award (MW), output (MW), da_price, rt_price per quarter hour; charge_mwh, charge_price."""
    energy = (F.col("output") - F.col("award")) * 0.25
    sums = schedule.groupBy(*DAY).agg(
        F.sum(F.col("award") * F.col("da_price") * 0.25).alias("da_rev"), F.sum(energy * F.col("rt_price")).alias("rt_rev"),
        (F.max("charge_mwh") * F.max("charge_price")).alias("charge_cost"),
        (F.sum(F.greatest("output", F.lit(0.0))) * 0.25).alias("discharged"))
    return sums.withColumn("total", F.col("da_rev") + F.col("rt_rev") - F.col("charge_cost") - F.col("discharged") * degradation)


def commitment_uplift(da: DataFrame, rt: DataFrame, widths: DataFrame, reference: DataFrame, fleet: dict = FLEET,
                      redesign=MARKET_REDESIGN) -> DataFrame:
    """Fixed against width-aware commitment per point and day, with the market era."""
    rows = widths.join(reference, "point")
    policies = F.explode(F.array(
        F.struct(F.lit("fixed").alias("policy"), F.lit(COMMIT_BASE).alias("fraction")),
        F.struct(F.lit("adaptive").alias("policy"), commitment_fraction("width", "ref_width").alias("fraction"))))
    fractions = rows.select(*DAY, policies.alias("p")).select(*DAY, "p.policy", "p.fraction")
    money = settle_days(da, rt, fractions, fleet)
    pick = lambda name, c: F.max(F.when(F.col("policy") == name, F.col(c)))
    out = money.groupBy(*DAY).agg(pick("adaptive", "fraction").alias("fraction"), pick("fixed", "total").alias("fixed_usd"),
                                  pick("adaptive", "total").alias("adaptive_usd"))
    era = F.when(F.col("operating_date") >= F.lit(redesign), "after").otherwise("before")
    return out.withColumns({"era": era, "uplift_usd": F.col("adaptive_usd") - F.col("fixed_usd")})


def era_totals(uplift: DataFrame) -> DataFrame:
    return uplift.groupBy("era").agg(F.sum("fixed_usd").alias("fixed_usd"), F.sum("adaptive_usd").alias("adaptive_usd"),
                                     F.sum("uplift_usd").alias("uplift_usd"), F.count("*").alias("days"))


def imbalance(runs: DataFrame, prices: DataFrame, zone_load: DataFrame) -> DataFrame:
    """Energy settled in real time and its cost, per run, for a portfolio of 1000 MW on average in each zone.

    runs: run, zone, day, hour_ending, p50, y; prices: zone, day, hour_ending, da, rt; zone_load: zone, load."""
    rows = runs.join(prices, ["zone", "day", "hour_ending"]).join(zone_load, "zone")
    k, spread = 1000.0 / F.col("load"), F.col("rt") - F.col("da")
    rows = rows.filter(spread.isNotNull()).select(
        "run", ((F.col("y") - F.col("p50")) * k).alias("_m"), (F.col("y") * k).alias("_p"), spread.alias("_s"))
    out = rows.groupBy("run").agg(
        F.count("*").alias("zone_hours"), F.sum(F.abs("_m")).alias("mwh_model"), F.sum(F.abs("_p")).alias("mwh_plain"),
        F.sum(F.col("_m") * F.col("_s")).alias("cost_model"), F.sum(F.col("_p") * F.col("_s")).alias("cost_plain"),
        F.sum(F.abs("_m") * F.abs("_s")).alias("risk_model"), F.sum(F.abs("_p") * F.abs("_s")).alias("risk_plain"))
    return out.withColumns({"mwh_change_pct": 100 * (F.col("mwh_model") / F.col("mwh_plain") - 1),
                            "risk_change_pct": 100 * (F.col("risk_model") / F.col("risk_plain") - 1)})
