"""Scans of landed files into raw frames: CSV, JSON, JSON lines, text and parquet."""

from __future__ import annotations

import logging
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from gridspark.constants import FORECAST_ZONE_COLUMNS, LOCAL_TZ, POINT_TYPES, WEATHER_VARIABLES
from gridspark.functions import timeconv as T
from gridspark.operators.reshape import melt, recode
from gridspark.plans.bulletins import FRAME, framed
from gridspark.sources.posts import clean_listing, localize_post_times

LOG = logging.getLogger(__name__)


# ---------------------------------------------------------------- parquet and JSON lines
def wider_type(spark: SparkSession, types: list[ST.DataType]) -> ST.DataType:
    """The type all given ones widen to (whole numbers to double, dates to timestamps); text takes in everything else."""
    if any(isinstance(t, ST.StringType) for t in types):
        return ST.StringType()
    try:
        return spark.range(0).select(F.coalesce(*[F.lit(None).cast(t) for t in types]).alias("c")).schema["c"].dataType
    except AnalysisException:
        if any(isinstance(t, (ST.StructType, ST.ArrayType, ST.MapType)) for t in types):
            raise
        return ST.StringType()


def _like_groups(spark: SparkSession, files: list[str], options: dict[str, str]) -> list[tuple[list[str], ST.StructType]]:
    """Files in groups whose schemas Spark can merge. A set that cannot be merged is halved, so the number of merges (each one a
    job over footers) follows the number of times the types change along the file names, not the number of files."""
    try:
        return [(files, spark.read.options(mergeSchema="true", **options).parquet(*files).schema)]
    except (PySparkException, Py4JJavaError) as e:
        if len(files) == 1 or "CANNOT_MERGE" not in str(e):
            raise
    middle = len(files) // 2
    return _like_groups(spark, files[:middle], options) + _like_groups(spark, files[middle:], options)


def read_parquet(spark: SparkSession, path: str | list[str], columns: list[str] | None = None) -> DataFrame:
    """Month files united by column name, narrowed to the wanted columns so the scan is pruned.

    A column whose type differs between files takes the wider type, with a line in the log; one that files lack is null."""
    paths = [path] if isinstance(path, str) else list(path)
    options = {"basePath": paths[0]} if isinstance(path, str) and not path.endswith(".parquet") else {}
    reader = spark.read.options(mergeSchema="true", **options)
    try:
        df = reader.parquet(*paths)
    except (PySparkException, Py4JJavaError) as e:
        if "CANNOT_MERGE" not in str(e):
            raise
        files = sorted(spark.read.options(**options).parquet(*paths).inputFiles())
        df = _united(spark, _like_groups(spark, files, options), options)
    return df.select(*columns) if columns else df


def _united(spark: SparkSession, groups: list[tuple[list[str], ST.StructType]], options: dict[str, str]) -> DataFrame:
    found: dict[str, list[ST.DataType]] = {}
    for _, schema in groups:
        for f in schema.fields:
            seen = found.setdefault(f.name, [])
            if f.dataType not in seen:
                seen.append(f.dataType)
    widened = {name: wider_type(spark, types) if len(types) > 1 else types[0] for name, types in found.items()}
    for name, types in found.items():
        if len(types) > 1:
            LOG.warning("column %s: %s read as %s", name, ", ".join(t.simpleString() for t in types), widened[name].simpleString())
    alike: dict[str, tuple[list[str], ST.StructType]] = {}
    for files, schema in groups:
        alike.setdefault(schema.json(), ([], schema))[0].extend(files)
    parts = [spark.read.options(**options).schema(schema).parquet(*files).select(*[F.col(f.name).cast(widened[f.name]).alias(f.name) for f in schema.fields])
             for files, schema in alike.values()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).select(*widened)


def read_json_lines(spark: SparkSession, path: str | list[str], schema: ST.StructType | str) -> DataFrame:
    """Declared schema; broken lines are dropped, as a resumed run expects."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def _csv(spark: SparkSession, path) -> DataFrame:
    """All columns as trimmed-header strings, files aligned by column name; types are decided by the caller.

    Files are read in groups of one header each, so no file's columns are taken under another's header; a column that a
    group lacks is null. `_file` is the file's name."""
    paths = [path] if isinstance(path, str) else list(path)
    tops = spark.read.text(paths).filter("_metadata.file_block_start = 0").groupBy(F.col("_metadata.file_path").alias("file")) \
        .agg(F.first("value").alias("top"))
    groups: dict[str, list[str]] = {}
    for r in tops.orderBy("file").collect():
        groups.setdefault(r.top, []).append(r.file)
    out = None
    for files in groups.values():
        raw = spark.read.option("header", True).option("inferSchema", False).option("enforceSchema", False).csv(files)
        part = raw.select("*", F.col("_metadata.file_name").alias("_file"))
        part = part.toDF(*[c.strip() for c in part.columns])
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError(f"no file with a header line under {paths}")
    return out


def number(c: Column | str) -> Column:
    return F.regexp_replace(F.trim(T.col(c)), ",", "").try_cast("double")


# ---------------------------------------------------------------- CSV
def read_balancing_area(spark: SparkSession, path, area: str) -> DataFrame:
    """One area's published forecast and demand per hour end; the last row wins for a repeated hour end."""
    raw = _csv(spark, path).select("Balancing Authority", "UTC Time at End of Hour", "Demand Forecast (MW)", "Demand (MW)")
    end = F.to_timestamp_ntz(F.trim("UTC Time at End of Hour"), F.lit("M/d/yyyy h:mm:ss a"))
    return raw.filter(F.trim("Balancing Authority") == area).select(
        end.alias("interval_end_utc"), number(F.col("`Demand Forecast (MW)`")).alias("forecast_mw"),
        number(F.col("`Demand (MW)`")).alias("demand_mw"))


def read_service_prices(spark: SparkSession, path) -> DataFrame:
    """Wide service price files with trimmed headers."""
    return _csv(spark, path).drop("_file")


def read_model_forecasts(spark: SparkSession, path) -> DataFrame:
    """Forecast-by-model files to rows by zone. The document id is the file name up to its first dot."""
    raw = _csv(spark, path).withColumn("doc_id", F.regexp_extract("_file", r"^([^.]*)", 1)).drop("_file")
    flag = next((c for c in ("DSTFlag", "Repeated Hour Flag") if c in raw.columns), None)
    repeated = F.coalesce(F.trim(F.col(f"`{flag}`")) == "Y", F.lit(False)) if flag else F.lit(False)
    zones = {c: z for c, z in FORECAST_ZONE_COLUMNS.items() if c in raw.columns}
    rows = raw.select(
        F.to_date(F.trim("DeliveryDate"), "MM/dd/yyyy").alias("operating_date"),
        F.split("HourEnding", ":")[0].cast("int").alias("hour_ending"), repeated.alias("repeated_hour"),
        F.trim("Model").alias("model"), (F.trim("InUseFlag") == "Y").alias("in_use"), "doc_id",
        *[F.col(c).cast("double").alias(c) for c in zones])
    return melt(rows, ["operating_date", "hour_ending", "repeated_hour", "model", "in_use", "doc_id"], zones, "zone", "forecast")


# ---------------------------------------------------------------- price archives and generation sheets
def price_archive(rows: DataFrame, points: list[str], tz: str = LOCAL_TZ) -> DataFrame:
    """Archive rows (strings) to start, point, type code and price. Rows of other points or types are dropped first.

    Real-time rows carry an hour and an interval number, day-ahead rows an 'HH:00' hour ending and no type."""
    name = "Settlement Point Name" if "Settlement Point Name" in rows.columns else "Settlement Point"
    point = F.trim(F.col(f"`{name}`"))
    guessed = (F.when(point == "HB_HUBAVG", "AH").when(point == "HB_BUSAVG", "SH")
               .when(point.startswith("HB_"), "HU").otherwise("LZ"))
    kind = F.trim(F.col("`Settlement Point Type`")) if "Settlement Point Type" in rows.columns else guessed
    live = rows.withColumns({"point": point, "point_type": kind}).filter(
        F.col("point").isin(points) & F.col("point_type").isin(list(POINT_TYPES)))
    he = (F.col("`Delivery Hour`").cast("int") if "Delivery Hour" in rows.columns
          else F.substring(F.trim("Hour Ending"), 1, 2).cast("int"))
    local = F.to_date(F.trim("Delivery Date"), "MM/dd/yyyy").cast("timestamp_ntz") + T.hours(he - 1)
    if "Delivery Interval" in rows.columns:
        local = local + T.minutes((F.col("`Delivery Interval`").cast("int") - 1) * 15)
    repeated = F.trim("Repeated Hour Flag") == "Y"
    return live.select(T.local_to_utc(local, repeated, tz).alias("start_utc"), "point", "point_type",
                       F.col("`Settlement Point Price`").cast("double").alias("price"))


def generation_sheet(rows: DataFrame, tz: str = LOCAL_TZ) -> DataFrame:
    """Wide sheet (one column per interval end) to long intervals.

    Columns of the repeated hour belong after 2:00 and are skipped when empty; on the short day the empty hour is
    skipped; a row whose remaining count is not the day's interval count is dropped."""
    cols = [c for c in rows.columns if ":" in c]
    repeated = [c for c in cols if "DST" in c]
    order = []
    for c in (c for c in cols if "DST" not in c):
        order.append(c)
        if c in ("2:00", "02:00"):
            order += repeated
    cell = lambda c: F.struct(F.col(f"`{c}`").try_cast("double").alias("v"), F.lit(c in repeated).alias("extra"))
    day = F.to_date("Date")
    out = rows.filter(F.col("Date").isNotNull() & F.col("Fuel").isNotNull()).withColumns(
        {"_day": day, "_all": F.array(*[cell(c) for c in order]), "_want": T.hours_in_day(day, tz) * 4})
    kept = F.filter("_all", lambda x: ~(x["extra"] & x["v"].isNull()))
    out = out.withColumn("_kept", kept).withColumn("_vals", F.when(
        F.size("_kept") > F.col("_want"), F.filter("_kept", lambda x: x["v"].isNotNull())).otherwise(F.col("_kept")))
    out = out.filter(F.size("_vals") == F.col("_want"))
    settlement = F.trim("Settlement Type") if "Settlement Type" in rows.columns else F.lit("")
    long = out.select(F.trim("Fuel").alias("fuel"), settlement.alias("settlement_type"), "_day", F.posexplode("_vals").alias("_i", "_x"))
    return long.select((T.midnight_utc("_day", tz) + T.minutes(F.col("_i") * 15)).alias("start_utc"), "fuel", "settlement_type",
                       F.col("_x.v").alias("energy"))


# ---------------------------------------------------------------- JSON
def weather_responses(responses: DataFrame, lead_days: int = 2) -> DataFrame:
    """Parallel hourly arrays (`point`, `model`, `hourly` struct) to rows; absent variables become null columns."""
    have = responses.schema["hourly"].dataType.fieldNames()
    suffix = f"_previous_day{lead_days}"
    live = {v: c for v, c in WEATHER_VARIABLES.items() if v + suffix in have}
    zipped = F.explode(F.arrays_zip("hourly.time", *[F.col(f"hourly.{v}{suffix}") for v in live]))
    rows = responses.select("point", "model", zipped.alias("h"))
    cols = [(F.col(f"h.{v}{suffix}").cast("float") if v in live else F.lit(None).cast("float")).alias(c)
            for v, c in WEATHER_VARIABLES.items()]
    return rows.select("point", "model", F.col("h.time").cast("timestamp_ntz").alias("valid_time_utc"), *cols)


def document_listing(listing: DataFrame, tz: str = LOCAL_TZ) -> DataFrame:
    """Archive listing rows (doc_id, friendly_name, post_datetime) to clean, localised posts."""
    rows = clean_listing(listing).withColumns({"doc_id": F.col("doc_id").cast("bigint"),
                                               "post_local": F.substring("post_datetime", 1, 19).cast("timestamp_ntz")})
    return localize_post_times(rows, "post_local", "doc_id", tz).select("doc_id", "friendly_name", "post_time_utc")


def read_listing(spark: SparkSession, path) -> DataFrame:
    schema = "archives array<struct<doc_id: string, friendly_name: string, post_datetime: string>>"
    return document_listing(spark.read.schema(schema).json(path).select(F.inline("archives")))


def bulletin_pieces(spark: SparkSession, path, windows: DataFrame | None = None) -> DataFrame:
    """Pieces of response files, with the file's name (`file`) and, from `windows` (file, win_start, win_end), its window.

    Files are read up to each frame character, so a framed file of any size is many tasks and only a piece must fit in a row. A
    record as long as its file has no frame in it: such a file is one row, cut at header lines. `product_no` counts inside a row."""
    rows = spark.read.option("lineSep", FRAME).text(path).select(
        F.col("value").alias("raw"), F.col("_metadata.file_name").alias("file"),
        (F.octet_length("value") < F.col("_metadata.file_size")).alias("_piece"))
    if windows is not None:
        rows = rows.join(windows.select("file", "win_start", "win_end"), "file", "left")
    return framed(rows, is_piece="_piece").drop("_piece")


def read_bulletins(spark: SparkSession, path, windows: DataFrame | None = None) -> DataFrame:
    """The pieces that are products; `rejected_pieces` of `bulletin_pieces` lists the others."""
    return bulletin_pieces(spark, path, windows).filter(F.col("wmo_header").isNotNull())
