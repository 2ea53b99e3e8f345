"""Exact quantiles of groups of any size: ranks are narrowed down by counting value ranges, never by sorting a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS = 36
#: a level's range is cut into at most 2^17 parts, and a range of the last level holds at most 2^16 different numbers
LEVELS = (34, 17, 0)


def ordered_code(x: Column) -> Column:
    """A whole number that never falls as `x` grows: sign, binary exponent and 36 bits of the fraction. NaN comes last."""
    size = F.abs(x)
    exponent = F.floor(F.log2(size))
    fraction = F.floor((size / F.pow(F.lit(2.0), exponent) - 1) * 2.0 ** BITS)
    code = (exponent + 1100) * F.lit(1 << BITS) + F.greatest(F.lit(0), F.least(fraction, F.lit((1 << BITS) - 1)))
    known = F.when(size == 0, 0).when(size == float("inf"), 1 << 60).otherwise(code)
    return F.when(F.isnan(x), 1 << 61).otherwise(F.when(x < 0, -known).otherwise(known)).cast("bigint")


def exact_quantiles(df: DataFrame, value: str, quantiles: list[float], keys: list[str] | None = None) -> DataFrame:
    """(*keys, quantiles): interpolated quantiles of each group's known values, in the order asked for.

    Level by level, rows are counted per range of values (combined map-side), the ranges that hold the wanted ranks are kept, and
    only their rows are counted again in finer ranges; the last level counts single values. Hence a task holds at most the 2^17
    parts of one range whatever the group's size or its number of different values, for the price of one pass over `df` per level:
    write a costly `df` to a table first. Nulls are left out, a group without values has no row, a null key is a group."""
    keys = keys or []
    key = F.struct(*keys) if keys else F.lit(0)
    rows = df.select(key.alias("_key"), F.col(value).cast("double").alias("_x")).filter(F.col("_x").isNotNull())
    rows = rows.withColumn("_code", ordered_code(F.col("_x")))
    parts = [F.shiftright("_code", s) for s in LEVELS] + [F.col("_x")]
    last = F.col("_all") - 1
    lows = [F.least(F.floor(q * last), last) for q in quantiles]
    ranks = {f"_r{i}": r for i, r in enumerate(r for low in lows for r in (low, F.least(low + 1, last)))}
    first = rows.groupBy("_key", parts[0].alias("_part")).agg(F.count("*").alias("_n"))
    state = first.withColumn("_all", F.sum("_n").over(Window.partitionBy("_key"))).withColumns(ranks).withColumn("_in", F.lit(0))
    for outer, part in zip(parts, [*parts[1:], None], strict=True):
        # a range keeps, per wanted rank, how many values of the range come before it; null where the rank lies elsewhere
        order = Window.partitionBy("_key", "_in").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        state = state.withColumn("_below", F.coalesce(F.sum("_n").over(order), F.lit(0)))
        state = state.select("_key", F.col("_part").alias("_in"), "_all", *[F.when(
            (F.col(r) >= F.col("_below")) & (F.col(r) < F.col("_below") + F.col("_n")), F.col(r) - F.col("_below")).alias(r) for r in ranks])
        state = state.filter(F.coalesce(*ranks).isNotNull())
        if part is not None:
            inside = rows.withColumn("_in", outer).join(state, ["_key", "_in"])
            state = inside.groupBy("_key", "_in", part.alias("_part")).agg(F.count("*").alias("_n"), *[F.max(c).alias(c) for c in ("_all", *ranks)])
    found = state.groupBy("_key").agg(F.max("_all").alias("_all"), *[F.max(F.when(F.col(r).isNotNull(), F.col("_in"))).alias(f"_v{r}") for r in ranks])

    def between(i: int) -> Column:
        a, b, share = F.col(f"_v_r{2 * i}"), F.col(f"_v_r{2 * i + 1}"), quantiles[i] * last - lows[i]
        return F.when((share == 0) | (a == b), a).otherwise(a + share * (b - a))

    return found.select(*[f"_key.{k}" for k in keys], F.array(*[between(i) for i in range(len(quantiles))]).alias("quantiles"))
