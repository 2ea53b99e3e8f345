"""As-of lookups without a range join.

Daily cutoffs: every instant belongs to exactly one "next cutoff", so the right side shrinks to one row per key and
day (combined map-side) before anything is matched. Arbitrary instants: rows are matched inside groups of a key and some
minutes, and the last value of earlier groups is carried in from their summary, so no group spans a key's whole history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridspark.functions import timeconv as T
from gridspark.operators.ranking import latest_per_key


def latest_before_cutoff(days: DataFrame, right: DataFrame, time: str, order: list[str], keep: list[str],
                         keys: list[str] | None = None, lead_minutes: int = 0, max_age_days: int | None = 6,
                         day: str = "operating_date") -> DataFrame:
    """Latest `right` row strictly before each day's cutoff minus a lead; older than `max_age_days` is no match.

    `days` holds the wanted (keys, day) pairs. The result has one row per pair with a match."""
    keys = keys or []
    bucket = right.filter(F.col(time).isNotNull()).withColumn("_bucket", T.next_cutoff_day(time, lead_minutes))
    reduced = latest_per_key(bucket, keys + ["_bucket"], [time, *order])
    wanted = days.select(*keys, day).distinct()
    payload = F.struct(time, *[c for c in dict.fromkeys(order + keep) if c != time])
    if max_age_days is not None:
        reach = F.explode(F.sequence(F.lit(0), F.lit(max_age_days)))
        spread = reduced.select(*keys, "_bucket", payload.alias("_row"), reach.alias("_k")).select(
            *keys, "_row", F.date_add("_bucket", F.col("_k")).alias(day))
        best = spread.join(wanted, keys + [day], "left_semi").groupBy(*keys, day).agg(F.max("_row").alias("_row"))
        target = T.cutoff_utc(day) - T.minutes(lead_minutes)
        best = best.filter(F.col("_row")[time] >= target - T.hours(24 * max_age_days))
    else:
        rows = (reduced.select(*keys, F.col("_bucket").alias(day), payload.alias("_row"), F.lit(False).alias("_want"))
                .unionByName(wanted.select(*keys, day, F.lit(None).cast(reduced.select(payload.alias("p")).schema["p"].dataType)
                                           .alias("_row"), F.lit(True).alias("_want"))))
        # one row per key and day is left, so a key's group is bounded by the calendar
        w = Window.partitionBy(*keys).orderBy(day, F.col("_row").isNull())
        best = (rows.withColumn("_row", F.last("_row", ignorenulls=True).over(w))
                .filter(F.col("_want") & F.col("_row").isNotNull()))
    names = [time, *[c for c in dict.fromkeys(order + keep) if c != time]]
    return best.select(*keys, day, *[F.col("_row")[c].alias(c) for c in names])


def select_vintages(posts: DataFrame, days: DataFrame, max_age_days: int = 6) -> DataFrame:
    """Latest post before each day's cutoff ("dam") and before 24 absolute hours earlier ("prev")."""
    out = []
    for vintage, lead in (("dam", 0), ("prev", 24 * 60)):
        hit = latest_before_cutoff(days, posts, "post_time_utc", ["doc_id"], ["doc_id"], lead_minutes=lead,
                                   max_age_days=max_age_days)
        out.append(hit.withColumns({
            "vintage": F.lit(vintage), "cutoff_utc": T.cutoff_utc("operating_date"),
            "target_utc": T.cutoff_utc("operating_date") - T.minutes(lead)}))
    return out[0].unionByName(out[1])


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, values: list[str],
              strict: bool = False, max_age_minutes: int | None = None, tie: list[str] | None = None, bucket_minutes: int = 15) -> DataFrame:
    """For every left row the latest right row at or before (strict: before) its time, per key.

    Adds `values` and the matched `right_time`; left rows without a match keep nulls. Rows are sorted per key and bucket of
    `bucket_minutes`, so a busy key and day is spread over many tasks."""
    tie = tie or []
    row = F.struct(F.col(right_time).alias("_t"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(tie)],
                   *[F.col(c).alias(f"_v{i}") for i, c in enumerate(values)])
    r = right.filter(F.col(right_time).isNotNull()).select(*by, T.floor_minutes(right_time, bucket_minutes).alias("_bucket"), row.alias("_row"))
    row_type = r.schema["_row"].dataType
    l = left.withColumns({"_bucket": T.floor_minutes(left_time, bucket_minutes), "_at": F.col(left_time)})
    # at equal times a right row sorts before the left row it may match, after it when strict
    both = (l.withColumns({"_row": F.lit(None).cast(row_type), "_side": F.lit(1)})
            .unionByName(r.withColumns({"_at": F.col("_row")["_t"], "_side": F.lit(2 if strict else 0)}),
                         allowMissingColumns=True))
    w = (Window.partitionBy(*by, "_bucket").orderBy("_at", "_side", *[F.col("_row")[f"_k{i}"] for i in range(len(tie))])
         .rowsBetween(Window.unboundedPreceding, 0))
    inside = both.withColumn("_hit", F.last("_row", ignorenulls=True).over(w)).filter(F.col("_side") == 1)
    ends = r.groupBy(*by, "_bucket").agg(F.max("_row").alias("_end"))
    steps = (ends.unionByName(l.select(*by, "_bucket").distinct().withColumn("_end", F.lit(None).cast(row_type)))
            .groupBy(*by, "_bucket").agg(F.max("_end").alias("_end")))
    # one row per key and bucket is left, so a key's group is bounded by the calendar
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = steps.select(*by, "_bucket", F.last("_end", ignorenulls=True).over(before).alias("_carry"))
    out = inside.join(carry, [*by, "_bucket"], "left").withColumn("_hit", F.coalesce("_hit", "_carry"))
    if max_age_minutes is not None:
        fresh = F.col("_hit")["_t"] >= F.col(left_time) - T.minutes(max_age_minutes)
        out = out.withColumn("_hit", F.when(fresh, F.col("_hit")))
    matched = right_time if right_time not in left.columns else f"matched_{right_time}"
    return out.select(*left.columns, F.col("_hit")["_t"].alias(matched),
                      *[F.col("_hit")[f"_v{i}"].alias(c) for i, c in enumerate(values)])


def latest_publication(pubs: DataFrame, value: str, keys: list[str], publish: str = "publish_time",
                       start: str = "start_utc") -> DataFrame:
    """Per interval the last publication in the 24 hours up to and including 10:00 local the day before."""
    day = F.to_date(T.utc_to_local(start))
    cut_local = F.date_sub(day, 1).cast("timestamp_ntz") + T.hours(10)
    cut = T.local_to_utc(cut_local)
    live = pubs.filter(F.col(value).isNotNull() & (F.col(publish) <= cut) & (F.col(publish) > cut - T.hours(24)))
    return latest_per_key(live, keys + [start], [publish]).select(*keys, start, publish, value)
