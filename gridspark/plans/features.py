"""Cut-off-aware hourly features: forecasts, recent errors, peak context, weather, and training examples.

Windows here run over frames already reduced to one row per zone, hour and day, so a window group is bounded by the
number of days in the calendar, whatever the size of the raw tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.constants import (PEAK_HOURS, QUANTILES, SYSTEM_OFFICES, WEATHER_MODELS, WEATHER_POINTS, WEATHER_VARIABLES,
                                 ZONE_LABEL, ZONE_OFFICES)
from gridspark.functions import stats as S
from gridspark.functions import timeconv as T
from gridspark.operators.reshape import recode, row_stats
from gridspark.plans.bulletins import bulletins_for_days

KEY = ["zone", "operating_date", "hour_ending"]
WEATHER_COLUMNS = list(WEATHER_VARIABLES.values())


def day_number(day: str | Column = "operating_date") -> Column:
    return F.datediff(T.col(day), F.lit("1970-01-01").cast("date"))


# ---------------------------------------------------------------- forecasts and labels
def vintage_age(selection: DataFrame, limit_hours: float = 6.0) -> DataFrame:
    """How old the chosen day-ahead posts were at the cutoff: median, maximum, and how many were too old."""
    age = T.interval_seconds(F.col("cutoff_utc") - F.col("post_time_utc")) / 3600
    dam = selection.filter(F.col("vintage") == "dam").select(age.alias("age"))
    return dam.agg(F.percentile("age", F.lit(0.5)).alias("median_hours"), F.max("age").alias("max_hours"),
                   F.count_if(F.col("age") > limit_hours).alias("over_limit"))


def vintage_long(selection: DataFrame, documents: DataFrame) -> DataFrame:
    """Rows of the selected documents for the operating day they were selected for."""
    rows = documents.join(selection.select("doc_id", "operating_date", "vintage", "post_time_utc"),
                          ["doc_id", "operating_date"])
    return rows.withColumnRenamed("post_time_utc", "publish_time")


def forecast_frame(vintage: DataFrame, models: list[str]) -> DataFrame:
    """In-use forecast, spread over all models, revision since the prior vintage, per-model deviation."""
    rows = vintage.filter(~F.col("repeated_hour"))

    def per_model_parts(name: str) -> list[Column]:
        live = (F.col("vintage") == name) & F.col("in_use") & F.col("forecast").isNotNull()
        return [F.min(F.when(live, F.col("forecast"))).alias(f"{name}_f"), F.max(F.when(live, F.col("publish_time"))).alias(f"{name}_p")]

    per_model = rows.groupBy(*KEY, "model").agg(
        F.avg(F.when(F.col("vintage") == "dam", F.col("forecast"))).alias("_v"), *per_model_parts("dam"), *per_model_parts("prev"))

    def first(name: str) -> Column:
        # the first model by name that is in use
        return F.min_by(F.struct(F.col(f"{name}_f").alias("f"), "model"), F.when(F.col(f"{name}_f").isNotNull(), F.col("model")))

    both = per_model.groupBy(*KEY).agg(
        first("dam").alias("_now"), F.max("dam_p").alias("fc_publish_utc"), first("prev").alias("_before"), F.max("prev_p").alias("prev_publish_utc"),
        F.count("_v").alias("n_models"), F.min("_v").alias("fc_min"), F.max("_v").alias("fc_max"), F.stddev_samp("_v").alias("fc_std"),
        F.percentile("_v", F.lit(0.5)).alias("fc_median"), *[F.max(F.when(F.col("model") == m, F.col("_v"))).alias(f"_m_{m}") for m in models])
    out = both.filter(F.col("_now").isNotNull()).select(
        *KEY, F.col("_now.f").alias("fc_inuse"), F.col("_now.model").alias("inuse_model"), "fc_publish_utc", "n_models", "fc_min", "fc_max", "fc_std",
        "fc_median", F.col("_before.f").alias("fc_prev"), "prev_publish_utc", *[f"_m_{m}" for m in models])
    return out.withColumns({
        **{f"dev_{m}": F.col(f"_m_{m}") - F.col("fc_inuse") for m in models},
        "fc_range": F.col("fc_max") - F.col("fc_min"),
        "inuse_minus_median": F.col("fc_inuse") - F.col("fc_median"),
        "revision": F.col("fc_inuse") - F.col("fc_prev"),
        "fc_visible": F.lit(True),
    }).drop(*[f"_m_{m}" for m in models])


def fallback_forecasts(hourly: DataFrame) -> DataFrame:
    """Single published forecast per hour end, for use when vintages are missing; never a visible input.

    `hourly`: interval_end_utc, forecast_mw, demand_mw (deduplicated by the caller)."""
    rows = T.add_time_columns(hourly.withColumn("start_utc", F.col("interval_end_utc") - T.hours(1)), "start_utc", 60)
    posted = T.local_to_utc(F.date_sub("operating_date", 1).cast("timestamp_ntz") + T.hours(14.5))
    return rows.select(
        F.lit("system_total").alias("zone"), "operating_date", "hour_ending", "repeated_hour",
        F.col("forecast_mw").alias("fc_inuse"), "demand_mw", posted.alias("fc_publish_utc"),
        F.lit(False).alias("fc_visible"))


def label_errors(fc: DataFrame, actual: DataFrame) -> DataFrame:
    return fc.join(actual, KEY).withColumn("error", F.col("actual_mw") - F.col("fc_inuse"))


# ---------------------------------------------------------------- causal history
def recent_errors(df: DataFrame, value: str = "error", lag_days: int = 2) -> DataFrame:
    """Same zone and hour, days up to D minus the lag, on a calendar-day axis (missing days stay missing)."""
    w = Window.partitionBy("zone", "hour_ending").orderBy(day_number())
    exact = w.rangeBetween(-lag_days, -lag_days)
    week, month = w.rangeBetween(-lag_days - 6, -lag_days), w.rangeBetween(-lag_days - 29, -lag_days)
    x = F.col(value)
    return df.withColumns({
        "err_lag2": F.max(x).over(exact),
        "err_mean7": F.when(F.count(x).over(week) >= 4, F.avg(x).over(week)),
        "err_mae7": F.when(F.count(x).over(week) >= 4, F.avg(F.abs(x)).over(week)),
        "err_mae30": F.when(F.count(x).over(month) >= 15, F.avg(F.abs(x)).over(month)),
    })


def peak_ratio(daily: DataFrame, lag_days: int = 2, min_days: int = 3, reach_days: int = 31) -> DataFrame:
    """Forecast peak over the highest actual so far this month; early in a month the 31 days before it count too.

    `daily`: operating_date, fc_peak, act_peak (one row per day)."""
    ms = F.trunc("operating_date", "MM")
    so_far = Window.partitionBy(ms).orderBy(day_number()).rangeBetween(Window.unboundedPreceding, -lag_days)
    rows = daily.withColumns({"_ms": ms, "_n": F.count("act_peak").over(so_far), "_here": F.max("act_peak").over(so_far)})
    targets = F.filter(F.array(F.add_months(ms, 1).cast("date"), F.add_months(ms, 2).cast("date")),
                       lambda m: F.datediff(m, F.col("operating_date")) <= reach_days)
    prior = (daily.select("operating_date", "act_peak", F.explode(targets).alias("_ms")).groupBy("_ms").agg(
        F.max("act_peak").alias("_all"),
        F.max(F.when(F.datediff("_ms", "operating_date") >= lag_days, F.col("act_peak"))).alias("_old")))
    out = rows.join(prior, "_ms", "left")
    before = F.when(F.col("operating_date") == F.col("_ms"), F.col("_old")).otherwise(F.col("_all"))
    ref = F.when(F.col("_n") >= min_days, F.col("_here")).otherwise(F.greatest("_here", before))
    return out.select("operating_date", "fc_peak", ref.alias("ref_peak"),
                      F.when(ref > 0, F.col("fc_peak") / ref).alias("sys_peak_ratio"))


def summer_peak_season(df: DataFrame) -> DataFrame:
    d = F.col("operating_date")
    flag = F.month(d).between(6, 9) & (F.weekday(d) < 5) & ~T.is_federal_holiday(d)
    return df.withColumn("is_peak_season", flag)


# ---------------------------------------------------------------- weather
def assemble_weather(rows: DataFrame, models: list[str] | None = None) -> DataFrame:
    """Long per-model point weather to one row per point and hour: model means, per-model columns, model count,
    latest possible issue time among the models present, and the label of the hour ending at the valid time."""
    specs = {m: (c, s, lat) for m, c, s, lat in WEATHER_MODELS}
    models = models or list(specs)
    present = F.coalesce(*[F.col(c) for c in WEATHER_COLUMNS]).isNotNull()
    bound = None
    for m in models:
        c, s, lat = specs[m]
        b = T.issued_bound("valid_time_utc", c, s, lat)
        bound = F.when(F.col("model") == m, b) if bound is None else bound.when(F.col("model") == m, b)
    live = rows.filter(F.col("model").isin(models) & present).withColumn("_issued", bound)
    aggs = [F.avg(c).alias(c) for c in WEATHER_COLUMNS]
    aggs += [F.avg(F.when(F.col("model") == m, F.col(c))).alias(f"{c}__{m}") for c in WEATHER_COLUMNS for m in models]
    aggs += [F.count_distinct(F.when(F.col("temp_c").isNotNull(), F.col("model"))).alias("n_models"),
             F.max("_issued").alias("issued_utc_max")]
    wide = live.groupBy("point", "valid_time_utc").agg(*aggs)
    labelled = T.add_time_columns(wide.withColumn("start_utc", F.col("valid_time_utc") - T.hours(1)), "start_utc", 60)
    zone = recode("point", {p[0]: p[1] for p in WEATHER_POINTS})
    return labelled.withColumn("zone", zone).drop("start_utc", "end_utc", "start_local", "end_local")


def zone_weather(points: DataFrame) -> DataFrame:
    """Weighted mean over a zone's points; missing values are skipped and the weights rescaled."""
    values = [c for c in points.columns if c.split("__")[0] in WEATHER_COLUMNS]
    weight = F.element_at(F.create_map(*[F.lit(x) for p in WEATHER_POINTS for x in (p[0], p[5])]), F.col("point"))
    rows = points.withColumn("_w", weight)
    return rows.groupBy("operating_date", "hour_ending", "repeated_hour", "zone").agg(
        *[S.weighted_mean(c, "_w").alias(c) for c in values], F.max("issued_utc_max").alias("issued_utc_max"))


def weather_features(zones: DataFrame, models: list[str]) -> DataFrame:
    """Spread between models and the change from the previous observed day at the same hour."""
    def spread(column: str) -> Column:
        return row_stats([f"{column}__{m}" for m in models])["v_std"]

    w = Window.partitionBy("zone", "hour_ending").orderBy("operating_date")
    out = zones.filter(~F.col("repeated_hour")).withColumns({
        "temp_spread_c": spread("temp_c"), "cloud_spread_pct": spread("cloud_cover_pct"),
        "temp_delta_d1": F.col("temp_c") - F.lag("temp_c").over(w)})
    return out.select(*KEY, *WEATHER_COLUMNS, "temp_spread_c", "cloud_spread_pct", "temp_delta_d1",
                      F.col("issued_utc_max").alias("wx_issued_utc"))


def system_weather(zones: DataFrame, loads: DataFrame, columns: list[str]) -> DataFrame:
    """Load-weighted mean over zones per hour; a missing zone value counts as that hour's plain mean.

    sum(w v) + mean(v) * sum(w where v missing) is the filled sum, so no window is needed. `loads`: zone, load."""
    total = loads.select(F.sum("load")).scalar()
    rows = zones.join(loads.select("zone", (F.col("load") / total).alias("_w")), "zone")

    def filled(c: str) -> Column:
        gap = F.coalesce(F.sum(F.when(F.col(c).isNull(), F.col("_w"))), F.lit(0.0))
        return F.try_divide(F.sum(F.col("_w") * F.col(c)) + F.avg(c) * gap, F.sum("_w"))

    return rows.groupBy("operating_date", "hour_ending").agg(
        *[filled(c).alias(c) for c in columns], F.max("wx_issued_utc").alias("wx_issued_utc")
    ).withColumn("zone", F.lit("system_total"))


# ---------------------------------------------------------------- audit features
def relative_spreads(df: DataFrame) -> DataFrame:
    cols = ["fc_std", "fc_range", "inuse_minus_median", "revision"]
    return df.withColumns({f"{c}_rel": F.try_divide(F.col(c), F.col("fc_inuse")) for c in cols})


def daily_error_lags(df: DataFrame, lags: tuple[int, ...] = (2, 3)) -> DataFrame:
    daily = df.groupBy("zone", "operating_date").agg(F.avg("error").alias("day_err"))
    w = Window.partitionBy("zone").orderBy(day_number())
    return daily.withColumns({f"day_err_lag{k}": F.max("day_err").over(w.rangeBetween(-k, -k)) for k in lags})


def model_track_record(vintage: DataFrame, actual: DataFrame, lag_days: int = 2) -> DataFrame:
    """Each model's own bias over 7 and error size over 30 earlier days, by zone and day."""
    dam = vintage.filter((F.col("vintage") == "dam") & ~F.col("repeated_hour"))
    miss = (dam.groupBy(*KEY, "model").agg(F.avg("forecast").alias("_f")).join(actual, KEY)
            .groupBy("zone", "model", "operating_date").agg(F.avg(F.col("actual_mw") - F.col("_f")).alias("_e")))
    w = Window.partitionBy("zone", "model").orderBy(day_number())
    week, month = w.rangeBetween(-lag_days - 6, -lag_days), w.rangeBetween(-lag_days - 29, -lag_days)
    return miss.select("zone", "model", "operating_date",
                       F.when(F.count("_e").over(week) >= 4, F.avg("_e").over(week)).alias("trk_bias7"),
                       F.when(F.count("_e").over(month) >= 15, F.avg(F.abs("_e")).over(month)).alias("trk_mae30"))


def in_use_against_best(track: DataFrame, in_use: DataFrame) -> DataFrame:
    """The in-use model's recent error size next to the best model's. `in_use`: zone, operating_date, inuse_model."""
    both = in_use.join(track, ["zone", "operating_date"])
    out = both.groupBy("zone", "operating_date", "inuse_model").agg(
        F.max(F.when(F.col("model") == F.col("inuse_model"), F.col("trk_mae30"))).alias("trk_inuse_mae30"),
        F.min("trk_mae30").alias("trk_best_mae30"))
    return out.withColumn("trk_inuse_minus_best", F.col("trk_inuse_mae30") - F.col("trk_best_mae30"))


def model_revisions(vintage: DataFrame) -> DataFrame:
    by = vintage.filter(~F.col("repeated_hour")).groupBy(*KEY, "model").agg(
        F.avg(F.when(F.col("vintage") == "dam", F.col("forecast"))).alias("_d"),
        F.avg(F.when(F.col("vintage") == "prev", F.col("forecast"))).alias("_p"))
    return by.select(*KEY, "model", (F.col("_d") - F.col("_p")).alias("model_revision"))


def heat_proxy(temp_c: Column | str, dewpoint_c: Column | str) -> Column:
    fahrenheit = lambda c: T.col(c) * 9 / 5 + 32
    return fahrenheit(temp_c) + 0.5 * F.greatest(fahrenheit(dewpoint_c) - 55, F.lit(0.0))


# ---------------------------------------------------------------- assembled frame
def hourly_features(fc: DataFrame, actual: DataFrame, weather: DataFrame | None = None,
                    hours: list[int] = PEAK_HOURS, splits=None) -> DataFrame:
    """Label, causal history, peak context, calendar, weather and split for the peak hours."""
    rows = recent_errors(label_errors(fc, actual))
    system = rows.filter(F.col("zone") == "system_total").groupBy("operating_date").agg(
        F.max("fc_inuse").alias("fc_peak"), F.max("actual_mw").alias("act_peak"))
    rows = rows.filter(F.col("hour_ending").isin(hours))
    rows = summer_peak_season(T.add_calendar(rows))
    rows = rows.join(peak_ratio(system).select("operating_date", "sys_peak_ratio"), "operating_date", "left")
    if weather is not None:
        rows = rows.join(weather, KEY, "left")
    label = T.split_label("operating_date", splits) if splits else T.split_label("operating_date")
    return rows.withColumn("split", label).filter(F.col("split").isNotNull())


# ---------------------------------------------------------------- examples
def quantile_map(prefix: str = "") -> Column:
    entry = F.struct(F.col("hour_ending"), F.struct(*[F.round(prefix + k, 1).alias(k) for k in QUANTILES]))
    return F.map_from_entries(F.array_sort(F.collect_list(entry)))


def train_thresholds(df: DataFrame) -> DataFrame:
    """Per zone, from training days only: median model range and the 80th percentile of the absolute error."""
    return df.filter(F.col("split") == "train").groupBy("zone").agg(
        F.percentile("fc_range", F.lit(0.5)).alias("agree_limit"),
        F.percentile(F.abs("error"), F.lit(0.8)).alias("miss_limit"))


def build_examples(df: DataFrame, baseline_name: str, hours: list[int] = PEAK_HOURS) -> DataFrame:
    """One nested row per zone and day that has every hour and no missing value; a group is one zone-day.

    Means and limits are compared at six decimals, so a tie does not hang on the order in which a mean was summed."""
    level = lambda c: F.round(c, 6)
    full = F.count_if(F.col("error").isNotNull() & F.col("p10").isNotNull() & F.col("p50").isNotNull()
                      & F.col("p90").isNotNull())
    days = df.filter(F.col("hour_ending").isin(hours)).groupBy("zone", "operating_date").agg(
        full.alias("_full"), F.count("*").alias("_n"), F.count_distinct("hour_ending").alias("_hours"),
        F.first("split").alias("split"), quantile_map().alias("baseline"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("hour_ending", F.round("error", 1).alias("e"))))).alias("actual_error"),
        F.avg("fc_range").alias("fc_range_mean"), F.max(F.abs("error")).alias("_worst"),
        F.min_by("inuse_model", "hour_ending").alias("inuse_model"))
    whole = days.filter((F.col("_n") == len(hours)) & (F.col("_hours") == len(hours)) & (F.col("_full") == len(hours)))
    out = whole.join(train_thresholds(df), "zone", "left")
    return out.select(
        F.concat_ws("_", F.date_format("operating_date", "yyyy-MM-dd"), "zone").alias("id"), "zone", "operating_date",
        "split", F.lit(hours).alias("hours"), "baseline", "actual_error",
        (level("fc_range_mean") <= level("agree_limit")).alias("models_agreed"),
        (level("_worst") >= level("miss_limit")).alias("big_miss"),
        F.round("fc_range_mean", 1).alias("fc_range_mean"), "inuse_model", F.lit(baseline_name).alias("baseline_name"),
        T.cutoff_utc("operating_date").alias("cutoff_utc"))


def zone_offices(zone_days: DataFrame, offices: dict[str, list[str]] | None = None) -> DataFrame:
    """A row per zone-day and weather office that serves the zone, with the office's place in the zone's list."""
    offices = offices or {**ZONE_OFFICES, "system_total": SYSTEM_OFFICES}
    listed = F.create_map(*[x for zone, names in offices.items() for x in (F.lit(zone), F.array(*[F.lit(n) for n in names]))])
    return zone_days.select("zone", "operating_date", F.posexplode(F.try_element_at(listed, "zone")).alias("place", "office"))


def text_sources(zone_days: DataFrame, bulletins: DataFrame, row_id: str, offices: dict[str, list[str]] | None = None) -> DataFrame:
    """The bulletin each office had out before the zone-day's cutoff: zone, operating_date, place, office, issued_utc and the row id.

    Only ids and times go through the lookup; texts are joined by id where they are wanted."""
    return bulletins_for_days(zone_offices(zone_days, offices), bulletins, keep=[row_id])


def attach_provenance(examples: DataFrame, sources: DataFrame) -> DataFrame:
    """List of (office, issue time) behind each example, in the order of the zone's offices; null where there is none.

    At most three offices serve one zone-day."""
    listed = sources.groupBy("zone", "operating_date").agg(
        F.array_sort(F.collect_list(F.struct("place", "office", "issued_utc"))).alias("_all"))
    listed = listed.select("zone", "operating_date", F.transform(
        "_all", lambda s: F.struct(s["office"].alias("office"), s["issued_utc"].alias("issued_utc"))).alias("sources"))
    return examples.join(listed, ["zone", "operating_date"], "left")


# ---------------------------------------------------------------- prompt text
def _number(c: Column, signed: bool = False, decimals: int = 0) -> Column:
    """Rounded to six places first, so that sums added in another order print alike."""
    return F.when(c.isNull(), "n/a").otherwise(F.format_string(f"%{'+' if signed else ''},.{decimals}f", F.round(c.cast("double"), 6)))


def _quantile_text() -> Column:
    return F.concat_ws(" / ", *[_number(F.col(k), True) for k in QUANTILES])


def prompt_lines(df: DataFrame, variant: str = "full", texts: DataFrame | None = None) -> DataFrame:
    """User text of one zone-day in one of three variants.

    numeric: a line per hour (forecast, model range, weather, quantiles), the in-use model, the peak-season line, recent errors.
    text: hours with quantiles only, then the bulletins. full: both. The request for the hours closes all of them.
    Forecast columns are left out of a day whose forecast is not visible at the cutoff (`fc_visible` false), weather columns of a
    day without any temperature; the season line needs a ratio. A group is one zone-day. `texts`: see `bulletin_blocks`."""
    if variant not in ("full", "numeric", "text"):
        raise ValueError(f"no prompt variant {variant}")

    def have(name: str, kind: str) -> Column:
        return F.col(name) if name in df.columns else F.lit(None).cast(kind)

    def at_first_hour(name: str, kind: str) -> Column:
        return F.min_by(F.struct(have(name, kind).alias("v")), "hour_ending")["v"]

    def fahrenheit(name: str) -> Column:
        return _number(have(name, "double") * 9 / 5 + 32)

    forecast = F.concat_ws(" | ", _number(F.col("fc_inuse")), F.concat(_number(F.col("fc_min")), F.lit(" .. "), _number(F.col("fc_max"))),
                           _number(F.col("inuse_minus_median"), True), _number(F.col("revision"), True))
    weather = F.concat_ws(" | ", fahrenheit("temp_c"), fahrenheit("dewpoint_c"), _number(have("cloud_cover_pct", "double")),
                          _number(have("temp_spread_c", "double") * 9 / 5, decimals=1))
    numeric = variant != "text"
    inputs = [forecast.alias("forecast"), weather.alias("weather"), _number(F.col("err_lag2"), True).alias("lag")] if numeric else []
    hour = F.struct("hour_ending", _quantile_text().alias("quantiles"), *inputs)
    of_day = [F.bool_or(have("temp_c", "double").isNotNull()).alias("_wx"), F.coalesce(at_first_hour("fc_visible", "boolean"), F.lit(True)).alias("_fc"),
              *[F.avg(c).alias(f"_{c}") for c in ("err_mean7", "err_mae7", "err_mae30")],
              *[at_first_hour(c, k).alias(f"_{c}") for c, k in (("n_models", "int"), ("inuse_model", "string"), ("is_peak_season", "boolean"),
                                                                ("sys_peak_ratio", "double"))]] if numeric else []
    day = df.groupBy("zone", "operating_date").agg(F.array_sort(F.collect_list(hour)).alias("_h"), *of_day)
    d = F.col("operating_date")
    title = F.concat(F.lit("Zone: "), F.coalesce(recode("zone", ZONE_LABEL), F.col("zone")), F.lit("\nOperating day: a "), F.date_format(d, "EEEE"),
                     F.lit(" in "), F.date_format(d, "MMMM"), F.when(T.is_federal_holiday(d), " (federal holiday)").otherwise(""),
                     F.when(T.is_change_day(d), " (clock-change day)").otherwise(""))
    hours = F.array_join(F.transform("_h", lambda h: h["hour_ending"].cast("string")), ", ")
    ask = F.concat(F.lit("Predict the error distribution for hours "), hours)
    if numeric:
        models = F.coalesce(F.concat(F.lit(" ("), F.col("_n_models").cast("string"), F.lit(" models)")), F.lit(""))
        head = F.concat_ws(" | ", F.lit("HE"), F.when(F.col("_fc"), F.concat(F.lit("forecast MW | model range"), models, F.lit(" | in use minus median | revision"))),
                           F.when(F.col("_wx"), "temp F | dewpoint F | cloud % | temp spread F"), F.lit("stat p10 / p50 / p90"))
        lines = F.transform("_h", lambda h: F.concat_ws(" | ", h["hour_ending"].cast("string"), F.when(F.col("_fc"), h["forecast"]),
                                                        F.when(F.col("_wx"), h["weather"]), h["quantiles"]))
        in_use = F.when(F.col("_fc"), F.concat(F.lit("Model in use: "), F.coalesce("_inuse_model", F.lit("n/a"))))
        season = F.when(F.col("_is_peak_season") & F.col("_sys_peak_ratio").isNotNull(), F.concat(
            F.lit("Summer peak season: the system's forecast peak is "), _number(100 * F.col("_sys_peak_ratio")),
            F.lit("% of its highest recent load; large users may curtail")))
        recent = F.concat(F.lit("Errors through two days ago: latest day "), F.array_join(F.transform("_h", lambda h: h["lag"]), ", "),
                          F.lit("; 7-day mean "), _number(F.col("_err_mean7"), True), F.lit(", mean absolute "), _number(F.col("_err_mae7")),
                          F.lit("; 30-day mean absolute "), _number(F.col("_err_mae30")))
        parts = [title, head, F.array_join(lines, "\n"), in_use, season, recent]
    else:
        lines = F.transform("_h", lambda h: F.concat_ws(" | ", h["hour_ending"].cast("string"), h["quantiles"]))
        parts = [title, F.lit("HE | stat p10 / p50 / p90"), F.array_join(lines, "\n")]
    if variant != "numeric" and texts is not None:
        day = day.join(bulletin_blocks(texts), ["zone", "operating_date"], "left")
        parts.append(F.col("_blocks"))
    return day.select("zone", "operating_date", F.lit(variant).alias("variant"), F.concat_ws("\n", *parts, ask).alias("prompt"))


def bulletin_blocks(texts: DataFrame) -> DataFrame:
    """A zone-day's bulletins with their age in hours, in the order of its offices. `texts`: zone, operating_date, place, office,
    issued_utc, prompt_text (null: left out); at most three offices serve one zone-day."""
    age = F.floor(T.interval_seconds(T.cutoff_utc("operating_date") - F.col("issued_utc")) / 3600 + 0.5).cast("int")
    block = F.concat(F.lit("Latest discussion of office "), F.col("office"), F.lit(" ("), age.cast("string"),
                     F.lit(' h before the cutoff):\n"""\n'), F.col("prompt_text"), F.lit('\n"""'))
    return texts.filter(F.col("prompt_text").isNotNull()).groupBy("zone", "operating_date").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("place", block.alias("block")))), lambda b: b["block"]), "\n").alias("_blocks"))
