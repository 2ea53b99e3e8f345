"""Cluster bootstrap without repeated rows: whole days are drawn, and every replicate sums from one table of day totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def day_table(per_day: DataFrame, keys: list[str], day: str, sums: list[str]) -> Column:
    """One value, found when the query runs: an array of (k, v) where v has the key's totals at each day's position, null where
    it has none. Its size is keys x days, bounded by the calendar whatever the rows behind the totals."""
    own = F.struct(*[F.col(c).cast("double").alias(c) for c in sums])
    days = per_day.groupBy(day).agg(F.collect_list(F.struct(F.struct(*keys).alias("k"), own.alias("s"))).alias("_e"))
    table = days.agg(F.sort_array(F.collect_list(F.struct(day, "_e")))["_e"].alias("_days"))
    found = F.array_distinct(F.flatten("_days")["k"])
    by_key = F.transform(found, lambda k: F.struct(k.alias("k"), F.transform(
        "_days", lambda d: F.filter(d, lambda e: e["k"].eqNullSafe(k))).alias("v")))
    dense = F.transform(by_key, lambda r: F.struct(r["k"].alias("k"), F.transform(r["v"], lambda e: F.get(e["s"], F.lit(0))).alias("v")))
    return table.select(dense).scalar()


def resampled_sums(per_day: DataFrame, keys: list[str], day: str, sums: list[str], replicates: int, seed: str = "") -> DataFrame:
    """(replicate, *keys, *sums): each total summed over as many drawn days as there are, for every replicate.

    A replicate is a row: its draws are an array of day positions made in the row, and its sums come from the day table by
    position. Nothing is exploded per day or shuffled; a key none of whose days is drawn has no row."""
    spark = per_day.sparkSession
    reps = spark.range(0, replicates, 1, min(replicates, 64)).select(
        F.col("id").alias("replicate"), day_table(per_day, keys, day, sums).alias("_t"))
    total = F.size(F.get("_t", F.lit(0))["v"]).cast("bigint")

    def drawn(draw: Column) -> Column:
        digest = F.md5(F.concat_ws("-", *([F.lit(seed)] if seed else []), "replicate", draw))
        return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % total).cast("int")

    reps = reps.filter(F.size("_t") > 0).withColumn("_at", F.transform(F.sequence(F.lit(0).cast("bigint"), total - 1), drawn))
    zero = F.struct(F.lit(0).alias("_hit"), *[F.lit(0.0).alias(c) for c in sums])

    def add(acc: Column, x: Column) -> Column:
        return F.when(x.isNull(), acc).otherwise(F.struct((acc["_hit"] + 1).alias("_hit"), *[(acc[c] + F.coalesce(x[c], F.lit(0.0))).alias(c) for c in sums]))

    def totals(r: Column) -> Column:
        return F.struct(r["k"].alias("k"), F.aggregate(F.transform("_at", lambda p: F.get(r["v"], p)), zero, add).alias("s"))

    out = reps.select("replicate", F.explode(F.transform("_t", totals)).alias("_r")).filter(F.col("_r.s._hit") > 0)
    return out.select("replicate", *[F.col(f"_r.k.{k}").alias(k) for k in keys], *[F.col(f"_r.s.{c}").alias(c) for c in sums])


def interval(statistic: Column | str, level: float = 0.95) -> tuple[Column, Column]:
    """Percentile interval over the replicates of one key."""
    tail = (1 - level) / 2
    return F.percentile(statistic, F.lit(tail)), F.percentile(statistic, F.lit(1 - tail))
