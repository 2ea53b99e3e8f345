"""Ordinal positions and contiguous blocks of distinct days without one global sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def day_positions(days: DataFrame, day: str) -> DataFrame:
    """0-based position of every distinct day.

    Days are ranked inside their year; the count of earlier years comes from a map with one entry per year."""
    distinct = days.select(day).distinct().withColumn("_y", F.year(day))
    per_year = distinct.groupBy("_y").agg(F.count("*").alias("_n")).select(F.collect_list(F.struct("_y", "_n")))
    counts = per_year.scalar()
    rank = F.row_number().over(Window.partitionBy("_y").orderBy(day)) - 1
    before = F.aggregate(F.filter("_counts", lambda c: c["_y"] < F.col("_y")), F.lit(0).cast("bigint"),
                         lambda acc, c: acc + c["_n"])
    return distinct.withColumn("_counts", counts).select(day, (before + rank).cast("bigint").alias("position"))


def time_blocks(days: DataFrame, day: str, n_blocks: int) -> DataFrame:
    """Contiguous blocks of distinct days; the first blocks take the extra days."""
    pos = day_positions(days, day)
    total = days.select(F.count_distinct(F.col(day))).scalar()
    rows = pos.withColumn("_total", total)
    q, r = F.floor(F.col("_total") / n_blocks), F.col("_total") % n_blocks
    p = F.col("position")
    block = F.when(p < (q + 1) * r, F.floor(p / (q + 1))).otherwise(r + F.floor(F.try_divide(p - (q + 1) * r, q)))
    return rows.select(day, block.cast("int").alias("block"))
