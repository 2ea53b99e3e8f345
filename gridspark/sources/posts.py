"""Post listings: localised post times and listing clean-up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.constants import LOCAL_TZ
from gridspark.functions import timeconv as T


def localize_post_times(df: DataFrame, local: str, order: str, tz: str = LOCAL_TZ) -> DataFrame:
    """Naive local post times to instants. In a repeated hour the first post by `order` is daylight time, the rest
    standard time. Only posts inside repeated hours (one hour a year) are grouped to find their first."""
    hour = T.floor_hours(local)
    first = (df.filter(T.is_ambiguous(local, tz)).groupBy(hour.alias("_hour")).agg(F.min(order).alias("_first")))
    out = df.withColumn("_hour", hour).join(first, "_hour", "left")
    repeated = F.col(order) != F.col("_first")
    return out.withColumn("post_time_utc", T.local_to_utc(local, repeated, tz)).drop("_hour", "_first")


def clean_listing(docs: DataFrame) -> DataFrame:
    """Drop markup twins and empty ids, keep one row per id (the earliest listed name)."""
    named = docs.filter((F.length(F.trim(F.col("doc_id").cast("string"))) > 0)
                        & ~F.lower(F.coalesce("friendly_name", F.lit(""))).contains("xml"))
    rest = [c for c in docs.columns if c != "doc_id"]
    picked = named.groupBy("doc_id").agg(F.min(F.struct(*rest)).alias("_r"))
    return picked.select("doc_id", *[F.col("_r")[c].alias(c) for c in rest])
