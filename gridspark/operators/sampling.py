"""Top rows, round-robin subsets, capped picks per key, deterministic hold-outs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def capped_rows(df: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """First `limit` rows and whether more exist: one row more is fetched than shown."""
    top = df.orderBy(*order).limit(limit + 1)
    more = top.select(F.count("*") > limit).scalar()
    return top.orderBy(*order).limit(limit).withColumn("truncated", more)


def round_robin(df: DataFrame, group: str, row_id: str, limit: int) -> DataFrame:
    """First row of every group, then every second one, ... up to `limit` rows.

    No group can contribute more than `limit` rows, and that bound is applied before the shuffle."""
    w = Window.partitionBy(group).orderBy(row_id)
    ranked = df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= limit)
    return ranked.orderBy("_rn", group).limit(limit).drop("_rn")


def distinct_capped(df: DataFrame, key: str, content: Column, order: str, cap: int) -> DataFrame:
    """Per key the first `cap` rows of different content, in arrival order."""
    rows = df.withColumn("_content", content)
    first = rows.groupBy(key, "_content").agg(F.min(order).alias(order))
    w = Window.partitionBy(key).orderBy(order)
    kept = first.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= cap).select(key, order)
    return rows.join(kept, [key, order], "left_semi").drop("_content")


def hash_order(seed: Column | str, c: Column) -> Column:
    seed = F.lit(seed) if isinstance(seed, str) else seed
    return F.md5(F.concat_ws("-", seed, c))


def hold_out(ids: DataFrame, column: str, fraction: float, seed: str) -> DataFrame:
    """About `fraction` of the distinct ids (at least one): the smallest hashes, whatever the input order.

    Ids are counted in 65,536 hash buckets. Buckets below the boundary are taken whole and only the boundary bucket is
    ranked, so no task ever sorts the whole id list; the driver sees bucket counts alone."""
    rows = ids.select(column).distinct().withColumn("_h", hash_order(seed, F.col(column)))
    rows = rows.withColumn("_b", F.conv(F.substring("_h", 1, 4), 16, 10).cast("int"))
    counts = sorted((r["_b"], r["n"]) for r in rows.groupBy("_b").agg(F.count("*").alias("n")).collect())
    want = max(1, round(sum(n for _, n in counts) * fraction))
    edge, rest = -1, 0
    for b, n in counts:
        edge, rest = b, want
        if n >= want:
            break
        want -= n
    whole = rows.filter(F.col("_b") < edge).select(column)
    w = Window.partitionBy("_b").orderBy("_h", column)
    part = rows.filter(F.col("_b") == edge).withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= rest).select(column)
    return whole.unionByName(part)
