"""Landed frames to canonical interval tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.constants import LOAD_COLUMNS, POINT_TYPES, SERVICES
from gridspark.functions import timeconv as T
from gridspark.operators.asof import latest_publication
from gridspark.operators.ranking import latest_per_key
from gridspark.operators.reshape import melt, recode


def prices(raw: DataFrame, minutes: int) -> DataFrame:
    """start_utc, point, point type code, price -> standard price table."""
    rows = T.add_time_columns(raw, "start_utc", minutes)
    return rows.withColumns({"point_type": recode("point_type", POINT_TYPES), "price": F.col("price").try_cast("double")})


def load(raw: DataFrame) -> DataFrame:
    """Rename the wide zone columns and turn anything that is not a number into null."""
    rows = T.add_time_columns(raw, "start_utc", 60)
    return rows.withColumns({new: F.col(f"`{old}`").try_cast("double") for old, new in LOAD_COLUMNS.items()}).drop(
        *[c for c in LOAD_COLUMNS if c not in LOAD_COLUMNS.values()])


def energy_to_power(df: DataFrame) -> DataFrame:
    """Energy of a 15-minute interval as average power."""
    return df.withColumn("generation", F.col("energy") * 4.0)


def service_prices(raw: DataFrame) -> DataFrame:
    """Wide service columns with local date, hour-ending text and repeated flag to one row per service and hour.
    The published hour label is kept as it is, also on change days."""
    he = F.substring(F.trim("Hour Ending"), 1, 2).cast("int")
    local = F.to_date("Delivery Date", "MM/dd/yyyy").cast("timestamp_ntz") + T.hours(he - 1)
    repeated = F.trim("Repeated Hour Flag") == "Y"
    rows = raw.withColumns({"_he": he, "start_utc": T.local_to_utc(local, repeated)})
    rows = T.add_time_columns(rows, "start_utc", 60).withColumn("hour_ending", F.col("_he"))
    services = [s for s in SERVICES if s in raw.columns]
    ids = ["start_utc", "end_utc", "start_local", "end_local", "operating_date", "hour_ending", "repeated_hour"]
    numeric = rows.select(*ids, *[F.col(s).try_cast("double").alias(s) for s in services])
    return melt(numeric, ids, {s: s for s in services}, "service", "price")


def renewable_forecast(pubs: DataFrame, keys: list[str]) -> DataFrame:
    """Day-ahead forecast joined with the latest published actual of the same interval."""
    fc = latest_publication(pubs, "forecast", keys)
    act = latest_per_key(pubs.filter(F.col("actual").isNotNull()), keys + ["start_utc"], ["publish_time"]).select(
        *keys, "start_utc", "actual")
    both = T.add_time_columns(fc.join(act, keys + ["start_utc"]), "start_utc", 60)
    return both.withColumn("publish_time_local", T.utc_to_local("publish_time"))


def load_forecast(pubs: DataFrame, keys: list[str]) -> DataFrame:
    fc = T.add_time_columns(latest_publication(pubs, "forecast", keys), "start_utc", 60)
    return fc.withColumn("publish_time_local", T.utc_to_local("publish_time"))


def zone_load(wide: DataFrame, zones: dict[str, str]) -> DataFrame:
    ids = ["operating_date", "hour_ending", "repeated_hour", "start_utc"]
    return melt(wide, ids, zones, "zone", "actual_mw")
