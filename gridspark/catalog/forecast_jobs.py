"""Registered feature, baseline, scoring, evaluation and money jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridspark.catalog.registry import job
from gridspark.catalog.text_jobs import SQL_CLEANED
from gridspark.catalog.time_jobs import SQL_FEDERAL
from gridspark.catalog.views import sql_cutoff, sql_hours, sql_local
from gridspark.constants import THEMES, WEATHER_MODELS, WEATHER_VARIABLES
from gridspark.functions import stats as S
from gridspark.functions import timeconv as T
from gridspark.operators import blocks, reshape
from gridspark.operators.bootstrap import resampled_sums
from gridspark.plans import baselines as B
from gridspark.plans import bulletins as N
from gridspark.plans import evaluate as E
from gridspark.plans import features as X
from gridspark.plans import money as R
from gridspark.plans import scoring as M
from gridspark.session import cut_lineage

COLS = list(WEATHER_VARIABLES.values())
TRAIN_END = "1999-01-01"


def _train(v):
    return v.daily.filter(F.col("operating_date") < F.lit(TRAIN_END).cast("date"))


def _dated(df):
    return df


# ---------------------------------------------------------------- windows over daily history
_W4 = "PARTITION BY zone, hour_ending ORDER BY operating_date RANGE BETWEEN INTERVAL {a} DAYS PRECEDING AND INTERVAL {b} DAYS PRECEDING"


@job("w04_causal_rolling", "zone hour_ending:i operating_date:d err_lag2:4 err_mean7:4 err_mae7:4 err_mae30:4",
     f"""SELECT zone, hour_ending, operating_date, max(error) OVER ({_W4.format(a=2, b=2)}) AS err_lag2,
            CASE WHEN count(error) OVER ({_W4.format(a=8, b=2)}) >= 4 THEN avg(error) OVER ({_W4.format(a=8, b=2)}) END AS err_mean7,
            CASE WHEN count(error) OVER ({_W4.format(a=8, b=2)}) >= 4 THEN avg(abs(error)) OVER ({_W4.format(a=8, b=2)}) END AS err_mae7,
            CASE WHEN count(error) OVER ({_W4.format(a=31, b=2)}) >= 15 THEN avg(abs(error)) OVER ({_W4.format(a=31, b=2)}) END AS err_mae30
         FROM daily""")
def _(v):
    return X.recent_errors(v.daily)


@job("w05_trailing_quantiles", "zone hour_ending:i operating_date:d p10:2 p50:2 p90:2", "SELECT * FROM trail90")
def _(v):
    return v.trailing


@job("w06_change_from_previous_day", "zone hour_ending:i operating_date:d delta:4",
     "SELECT zone, hour_ending, operating_date, y - lag(y) OVER (PARTITION BY zone, hour_ending ORDER BY operating_date) AS delta FROM daily")
def _(v):
    from pyspark.sql import Window
    w = Window.partitionBy("zone", "hour_ending").orderBy("operating_date")
    return v.daily.withColumn("delta", F.col("y") - F.lag("y").over(w))


@job("w08_time_blocks", "operating_date:d block:i",
     "SELECT operating_date, ntile(7) OVER (ORDER BY operating_date) - 1 AS block FROM (SELECT DISTINCT operating_date FROM daily)")
def _(v):
    return blocks.time_blocks(v.daily, "operating_date", 7)


@job("j16_peak_ratio", "operating_date:d fc_peak:2 ref_peak:2 sys_peak_ratio:6",
     """WITH d AS (SELECT operating_date, max(quantity) AS fc_peak, max(spread) AS act_peak FROM daily GROUP BY 1),
        h AS (SELECT d.operating_date, d.fc_peak, max(p.act_peak) AS all_max,
                     max(p.act_peak) FILTER (WHERE month(p.operating_date) = month(d.operating_date)) AS month_max,
                     count(p.act_peak) FILTER (WHERE month(p.operating_date) = month(d.operating_date)) AS n
              FROM d LEFT JOIN d p ON p.operating_date <= d.operating_date - 2 AND p.operating_date >= date_trunc('month', d.operating_date) - INTERVAL 31 DAY
              GROUP BY 1, 2)
        SELECT operating_date, fc_peak, CASE WHEN n >= 3 THEN month_max ELSE all_max END AS ref_peak,
               CASE WHEN ref_peak > 0 THEN fc_peak / ref_peak END AS sys_peak_ratio FROM h""")
def _(v):
    return X.peak_ratio(v.daily.groupBy("operating_date").agg(F.max("quantity").alias("fc_peak"), F.max("spread").alias("act_peak")))


# ---------------------------------------------------------------- forecast features
_F1 = """
WITH dam AS (SELECT * FROM vintage WHERE vintage = 'dam'), prev AS (SELECT * FROM vintage WHERE vintage = 'prev'),
st AS (SELECT zone, operating_date, hour_ending, count(*) AS n_models, min(f) AS fc_min, max(f) AS fc_max, stddev_samp(f) AS fc_std, median(f) AS fc_median,
              max(f) FILTER (WHERE model = 'm1') AS m1, max(f) FILTER (WHERE model = 'm2') AS m2, max(f) FILTER (WHERE model = 'm3') AS m3
       FROM (SELECT zone, operating_date, hour_ending, model, avg(forecast) AS f FROM dam GROUP BY ALL) GROUP BY 1, 2, 3),
i AS (SELECT zone, operating_date, hour_ending, arg_min(forecast, model) AS fc_inuse, min(model) AS inuse_model, max(publish_time) AS fc_publish_utc FROM dam WHERE in_use GROUP BY 1, 2, 3),
p AS (SELECT zone, operating_date, hour_ending, arg_min(forecast, model) AS fc_prev FROM prev WHERE in_use GROUP BY 1, 2, 3)
SELECT i.*, st.n_models, fc_min, fc_max, fc_std, fc_median, fc_prev, fc_max - fc_min AS fc_range, fc_inuse - fc_median AS inuse_minus_median,
       fc_inuse - fc_prev AS revision, m1 - fc_inuse AS dev_m1, m2 - fc_inuse AS dev_m2, m3 - fc_inuse AS dev_m3
FROM i LEFT JOIN st USING (zone, operating_date, hour_ending) LEFT JOIN p USING (zone, operating_date, hour_ending)"""


def _fc(v):
    return X.forecast_frame(v.vintage, ["m1", "m2", "m3"])


@job("f01_forecast_frame", "zone operating_date:d hour_ending:i fc_inuse:4 inuse_model fc_publish_utc:t n_models:i fc_min:4 fc_max:4 fc_std:4 "
     "fc_median:4 fc_prev:4 fc_range:4 inuse_minus_median:4 revision:4 dev_m1:4 dev_m2:4 dev_m3:4", _F1)
def _(v):
    return _fc(v)


@job("f02_fallback_forecasts", "zone operating_date:d hour_ending:i repeated_hour:b fc_inuse:2 fc_publish_utc:t fc_visible:b",
     f"""SELECT 'system_total' AS zone, operating_date, hour_ending, repeated_hour, total AS fc_inuse, false AS fc_visible,
               (CAST(operating_date - 1 AS TIMESTAMP) + INTERVAL 870 MINUTE) AT TIME ZONE 'America/Chicago' AT TIME ZONE 'UTC' AS fc_publish_utc FROM load60""")
def _(v):
    rows = v.load60.select((F.col("start_utc") + T.hours(1)).alias("interval_end_utc"), F.col("total").alias("forecast_mw"),
                           F.lit(None).cast("double").alias("demand_mw"))
    return X.fallback_forecasts(rows)


@job("f08_vintage_long", "doc_id:l operating_date:d vintage publish_time:t event_type value:2",
     """WITH s AS (SELECT CAST(ts AS DATE) AS operating_date, max(event_id) AS doc_id, max(ts) AS publish_time, v.vintage FROM events, (VALUES ('dam'), ('prev')) v(vintage)
                   WHERE vintage = 'dam' OR extract(hour FROM ts) < 12 GROUP BY 1, 4)
        SELECT e.event_id AS doc_id, s.operating_date, s.vintage, s.publish_time, e.event_type, e.value
        FROM events e JOIN s ON s.doc_id = e.event_id AND s.operating_date = CAST(e.ts AS DATE)""")
def _(v):
    docs = v.events.select(F.col("event_id").alias("doc_id"), F.to_date("ts").alias("operating_date"), "event_type", "value", "ts")
    pick = lambda cond, name: (docs.filter(cond).groupBy("operating_date").agg(
        F.max("doc_id").alias("doc_id"), F.max("ts").alias("post_time_utc")).withColumn("vintage", F.lit(name)))
    sel = pick(F.lit(True), "dam").unionByName(pick(F.hour("ts") < 12, "prev"))
    return X.vintage_long(sel, docs.drop("ts"))


@job("f10_wind_solar_forecast", "zone start_utc:t publish_time:t publish_time_local:t forecast:4 actual:4 hour_ending:i",
     f"""WITH p AS (SELECT p.*, CASE WHEN extract(hour FROM p.start_utc) % 5 <> 1 THEN a.price END AS actual FROM publications p
                    LEFT JOIN iv60 a ON a.point = p.zone AND a.start_utc = p.start_utc),
         c AS (SELECT *, (CAST(CAST({sql_local('start_utc')} AS DATE) - 1 AS TIMESTAMP) + INTERVAL 10 HOUR) AT TIME ZONE 'America/Chicago' AT TIME ZONE 'UTC' AS cut FROM p),
         f AS (SELECT zone, start_utc, publish_time, forecast FROM c WHERE forecast IS NOT NULL AND publish_time <= cut AND publish_time > cut - INTERVAL 24 HOUR
               QUALIFY row_number() OVER (PARTITION BY zone, start_utc ORDER BY publish_time DESC) = 1),
         a AS (SELECT zone, start_utc, arg_max(actual, publish_time) AS actual FROM p WHERE actual IS NOT NULL GROUP BY 1, 2)
         SELECT f.*, {sql_local('publish_time')} AS publish_time_local, a.actual, extract(hour FROM {sql_local('start_utc')}) + 1 AS hour_ending
         FROM f JOIN a USING (zone, start_utc)""")
def _(v):
    from gridspark.sources.normalize import renewable_forecast
    act = v.iv60.filter(F.hour("start_utc") % 5 != 1).select(F.col("point").alias("zone"), "start_utc", F.col("price").alias("actual"))
    return renewable_forecast(v.publications.join(act, ["zone", "start_utc"], "left"), ["zone"])


_MODELS = [m[0] for m in WEATHER_MODELS]
_BOUNDS = {"gfs": (1, 6, 8), "ecmwf": (3, 6, 8), "icon": (1, 6, 5), "gem": (3, 12, 7)}


def _sql_bound(m: str) -> str:
    step, cycle, lat = _BOUNDS[m]
    # the grid is six-hourly, so valid times are always on every model's native step
    return f"time_bucket(INTERVAL '{cycle} hours', valid_time_utc - INTERVAL 48 HOUR, TIMESTAMP '2000-01-01') + INTERVAL {lat} HOUR"


_F5 = f"""SELECT w.point, p.zone, w.valid_time_utc, {", ".join(f"avg({c}) AS {c}" for c in COLS)},
    {", ".join(f"avg({c}) FILTER (WHERE model = '{m}') AS {c}__{m}" for c in ("temp_c", "cloud_cover_pct") for m in _MODELS)},
    count(temp_c) AS n_models, max(CASE model {" ".join(f"WHEN '{m}' THEN {_sql_bound(m)}" for m in _MODELS)} END) AS issued_utc_max,
    CAST({sql_local("(valid_time_utc - INTERVAL 1 HOUR)")} AS DATE) AS operating_date,
    CAST(extract(hour FROM {sql_local("(valid_time_utc - INTERVAL 1 HOUR)")}) AS INTEGER) + 1 AS hour_ending
    FROM weather_rows w JOIN weather_points p USING (point)
    WHERE coalesce({", ".join(COLS)}) IS NOT NULL GROUP BY w.point, p.zone, w.valid_time_utc"""


def _points(v):
    return X.assemble_weather(v.weather_rows)


@job("f05_weather_assemble", "point zone valid_time_utc:t operating_date:d hour_ending:i n_models:i issued_utc_max:t temp_c:6 dewpoint_c:6 "
     "cloud_cover_pct:6 wind_speed_kmh:6 precip_mm:6 temp_c__gfs:4 cloud_cover_pct__gem:4", _F5)
def _(v):
    return _points(v)


def _wm(c: str) -> str:
    return f"sum(weight * {c}) / nullif(sum(CASE WHEN {c} IS NOT NULL THEN weight END), 0)"


_A5 = f"""SELECT operating_date, hour_ending, w.zone, max(issued_utc_max) AS issued_utc_max, {", ".join(f"{_wm(c)} AS {c}" for c in COLS)},
    {", ".join(f"{_wm(f'{c}__{m}')} AS {c}__{m}" for c in ("temp_c", "cloud_cover_pct") for m in _MODELS)}
    FROM ({_F5}) w JOIN weather_points p USING (point) GROUP BY 1, 2, 3"""


@job("a05_zone_weather", "operating_date:d hour_ending:i zone issued_utc_max:t temp_c:6 dewpoint_c:6 cloud_cover_pct:6 wind_speed_kmh:6 precip_mm:6", _A5)
def _(v):
    return X.zone_weather(_points(v))


_F6 = f"""SELECT z.*, (SELECT stddev_samp(x) FROM unnest([{", ".join(f"temp_c__{m}" for m in _MODELS)}]) t(x)) AS temp_spread_c,
    (SELECT stddev_samp(x) FROM unnest([{", ".join(f"cloud_cover_pct__{m}" for m in _MODELS)}]) t(x)) AS cloud_spread_pct,
    temp_c - lag(temp_c) OVER (PARTITION BY zone, hour_ending ORDER BY operating_date) AS temp_delta_d1 FROM ({_A5}) z"""


@job("f06_weather_features", "zone operating_date:d hour_ending:i temp_c:6 temp_spread_c:6 cloud_spread_pct:6 temp_delta_d1:6 wx_issued_utc:t",
     f"SELECT *, issued_utc_max AS wx_issued_utc FROM ({_F6})")
def _(v):
    return X.weather_features(X.zone_weather(_points(v)), _MODELS)


@job("a06_system_weather", "zone operating_date:d hour_ending:i temp_c:6 precip_mm:6 wx_issued_utc:t",
     f"""WITH z AS ({_F6}), l AS (SELECT p.zone, sum(value) AS load FROM events JOIN weather_points p ON p.idx = user_id % 19 GROUP BY 1),
         w AS (SELECT z.*, load / (SELECT sum(load) FROM l) AS wt, coalesce(temp_c, avg(temp_c) OVER g) AS t, coalesce(precip_mm, avg(precip_mm) OVER g) AS r
               FROM z JOIN l USING (zone) WINDOW g AS (PARTITION BY operating_date, hour_ending))
         SELECT 'system_total' AS zone, operating_date, hour_ending, sum(wt * t) / sum(wt) AS temp_c, sum(wt * r) / sum(wt) AS precip_mm,
                max(issued_utc_max) AS wx_issued_utc FROM w GROUP BY 2, 3""")
def _(v):
    from gridspark.constants import WEATHER_POINTS
    zones = X.weather_features(X.zone_weather(_points(v)), _MODELS)
    zone_of = F.get(F.array(*[F.lit(p[1]) for p in WEATHER_POINTS]), (F.col("user_id") % len(WEATHER_POINTS)).cast("int"))
    loads = v.events.groupBy(zone_of.alias("zone")).agg(F.sum("value").alias("load"))
    return X.system_weather(zones, loads, ["temp_c", "precip_mm"])


_SPLITS = [("train", "1995-01-01", "1998-12-31"), ("val", "1999-01-08", "1999-12-31"), ("test", "2000-01-08", "2001-12-31")]


def _splits():
    import datetime as dt
    return [(n, dt.date.fromisoformat(a), dt.date.fromisoformat(b)) for n, a, b in _SPLITS]


def _hourly(v):
    """Feature frame over the long daily history: quantity stands for the forecast range, spread for other inputs."""
    fc = v.daily.select("zone", "operating_date", "hour_ending", F.lit(0.0).alias("fc_inuse"),
                        F.col("quantity").alias("fc_range"), F.col("spread").alias("fc_std"), F.lit("m1").alias("inuse_model"))
    act = v.daily.select("zone", "operating_date", "hour_ending", F.col("error").alias("actual_mw"))
    return X.hourly_features(fc, act, splits=_splits())


_F7_SPLIT = "CASE " + " ".join(f"WHEN operating_date BETWEEN DATE '{a}' AND DATE '{b}' THEN '{n}'" for n, a, b in _SPLITS) + " END"
_F7 = f"""SELECT d.zone, d.hour_ending, d.operating_date, round(d.error, 4) AS error, {_F7_SPLIT} AS split, month(d.operating_date) AS month_num, isodow(d.operating_date) - 1 AS dow,
    max(error) OVER ({_W4.format(a=2, b=2)}) AS err_lag2,
    CASE WHEN count(error) OVER ({_W4.format(a=31, b=2)}) >= 15 THEN avg(abs(error)) OVER ({_W4.format(a=31, b=2)}) END AS err_mae30 FROM daily d"""


@job("f07_hourly_features", "zone hour_ending:i operating_date:d split error:2 month_num:i dow:i err_lag2:4 err_mae30:4",
     f"SELECT * FROM ({_F7}) WHERE split IS NOT NULL")
def _(v):
    return _hourly(v)


@job("f04_peak_season", "operating_date:d is_peak_season:b",
     """SELECT DISTINCT operating_date, month(operating_date) BETWEEN 6 AND 9 AND isodow(operating_date) <= 5
            AND NOT (month(operating_date) = 7 AND ((day(operating_date) = 4) OR (day(operating_date) = 3 AND isodow(operating_date) = 5)
                     OR (day(operating_date) = 5 AND isodow(operating_date) = 1)))
            AND NOT (month(operating_date) = 9 AND isodow(operating_date) = 1 AND day(operating_date) <= 7) AS is_peak_season FROM daily""")
def _(v):
    return X.summer_peak_season(v.daily.select("operating_date").distinct())


@job("f11_daily_error_lags", "zone operating_date:d day_err:4 day_err_lag2:4 day_err_lag3:4",
     """WITH d AS (SELECT zone, operating_date, avg(error) AS day_err FROM daily GROUP BY 1, 2)
        SELECT d.*, a.day_err AS day_err_lag2, b.day_err AS day_err_lag3 FROM d LEFT JOIN d a ON a.zone = d.zone AND a.operating_date = d.operating_date - 2
        LEFT JOIN d b ON b.zone = d.zone AND b.operating_date = d.operating_date - 3""")
def _(v):
    return X.daily_error_lags(v.daily)


_TRACK = """SELECT zone, model, operating_date,
      CASE WHEN count(e) OVER (PARTITION BY zone, model ORDER BY operating_date RANGE BETWEEN INTERVAL 8 DAYS PRECEDING AND INTERVAL 2 DAYS PRECEDING) >= 4
           THEN avg(e) OVER (PARTITION BY zone, model ORDER BY operating_date RANGE BETWEEN INTERVAL 8 DAYS PRECEDING AND INTERVAL 2 DAYS PRECEDING) END AS trk_bias7,
      CASE WHEN count(e) OVER (PARTITION BY zone, model ORDER BY operating_date RANGE BETWEEN INTERVAL 31 DAYS PRECEDING AND INTERVAL 2 DAYS PRECEDING) >= 15
           THEN avg(abs(e)) OVER (PARTITION BY zone, model ORDER BY operating_date RANGE BETWEEN INTERVAL 31 DAYS PRECEDING AND INTERVAL 2 DAYS PRECEDING) END AS trk_mae30
    FROM (SELECT v.zone, v.model, v.operating_date, avg(a.price - v.forecast) AS e FROM vintage v
          JOIN iv60 a ON a.point = v.zone AND a.operating_date = v.operating_date AND a.hour_ending = v.hour_ending WHERE v.vintage = 'dam' GROUP BY 1, 2, 3)"""


def _track(v):
    act = v.iv60.select(F.col("point").alias("zone"), "operating_date", "hour_ending", F.col("price").alias("actual_mw"))
    return X.model_track_record(v.vintage, act)


@job("f11_model_track_record", "zone model operating_date:d trk_bias7:6 trk_mae30:6", _TRACK)
def _(v):
    return _track(v)


@job("f11_in_use_against_best", "zone operating_date:d inuse_model trk_inuse_mae30:6 trk_best_mae30:6 trk_inuse_minus_best:6",
     f"""WITH t AS ({_TRACK}), u AS (SELECT DISTINCT zone, operating_date, model AS inuse_model FROM vintage WHERE in_use AND vintage = 'dam')
         SELECT u.zone, u.operating_date, inuse_model, max(trk_mae30) FILTER (WHERE model = inuse_model) AS trk_inuse_mae30, min(trk_mae30) AS trk_best_mae30,
                max(trk_mae30) FILTER (WHERE model = inuse_model) - min(trk_mae30) AS trk_inuse_minus_best
         FROM u JOIN t ON t.zone = u.zone AND t.operating_date = u.operating_date GROUP BY 1, 2, 3""")
def _(v):
    used = v.vintage.filter("in_use AND vintage = 'dam'").select("zone", "operating_date", F.col("model").alias("inuse_model")).distinct()
    return X.in_use_against_best(_track(v), used)


@job("f11_model_revisions", "zone operating_date:d hour_ending:i model model_revision:4",
     """SELECT zone, operating_date, hour_ending, model, avg(forecast) FILTER (WHERE vintage = 'dam') - avg(forecast) FILTER (WHERE vintage = 'prev') AS model_revision
        FROM vintage GROUP BY 1, 2, 3, 4""")
def _(v):
    return X.model_revisions(v.vintage)


@job("f11_relative_and_heat", "zone operating_date:d hour_ending:i fc_std_rel:6 fc_range_rel:6 revision_rel:6 heat:4",
     f"""SELECT zone, operating_date, hour_ending, fc_std / nullif(fc_inuse, 0) AS fc_std_rel, fc_range / nullif(fc_inuse, 0) AS fc_range_rel,
               revision / nullif(fc_inuse, 0) AS revision_rel, (fc_max * 9 / 5 + 32) + 0.5 * greatest(fc_min * 9 / 5 + 32 - 55, 0) AS heat FROM ({_F1})""")
def _(v):
    return X.relative_spreads(_fc(v)).withColumn("heat", X.heat_proxy("fc_max", "fc_min"))


def _with_quantiles(v):
    rows = _hourly(v).join(v.climate, ["zone", "hour_ending"])
    return rows


def _examples_sql(agreed: str, missed: str) -> str:
    return f"""WITH h AS (SELECT f.*, d.quantity AS fc_range, c.p10, c.p50, c.p90 FROM ({_F7}) f JOIN daily d USING (zone, hour_ending, operating_date)
             JOIN climate c USING (zone, hour_ending) WHERE f.split IS NOT NULL),
    t AS (SELECT zone, quantile_cont(fc_range, 0.5) AS a, quantile_cont(abs(error), 0.8) AS m FROM h WHERE split = 'train' GROUP BY 1),
    g AS (SELECT zone, operating_date, min(split) AS split, avg(fc_range) AS r, max(abs(error)) AS w, count(*) AS n,
                 string_agg(CAST(hour_ending AS VARCHAR) || '=' || CAST(round(CAST(error AS DECIMAL(18, 2)), 1) AS VARCHAR), ';' ORDER BY hour_ending) AS errors,
                 string_agg(CAST(round(CAST(p90 AS DECIMAL(18, 2)), 1) AS VARCHAR), ';' ORDER BY hour_ending) AS upper FROM h GROUP BY 1, 2)
    SELECT strftime(g.operating_date, '%Y-%m-%d') || '_' || zone AS id, zone, g.operating_date, split, {agreed} AS models_agreed, {missed} AS big_miss,
           round(r, 1) AS fc_range_mean, errors, upper, {sql_cutoff('operating_date')} AS cutoff_utc FROM g JOIN t USING (zone) WHERE n = 5"""


_EX = _examples_sql("r <= a", "w >= m")
# flags at six decimals, as the job compares them: means and limits are sums of doubles, whose last digits hang on the order of rows
_EX_FLAGS = _examples_sql("round(r, 6) <= round(a, 6)", "round(w, 6) >= round(m, 6)")


@job("f12_examples", "id zone operating_date:d split models_agreed:b big_miss:b errors upper cutoff_utc:t", _EX_FLAGS)
def _(v):
    ex = X.build_examples(_with_quantiles(v), "climate")
    hours = F.array_sort(F.map_keys("actual_error"))
    fmt = lambda c: F.format_string("%.1f", c)
    return ex.withColumns({
        "errors": F.array_join(F.transform(hours, lambda h: F.concat(h.cast("string"), F.lit("="), fmt(F.element_at("actual_error", h)))), ";"),
        "upper": F.array_join(F.transform(hours, lambda h: fmt(F.element_at("baseline", h)["p90"])), ";")})


#: the bulletins' days brought into the last year of the forecasts, and up to three offices per zone
_BULLETIN_SHIFT = 9497
_SLICE_OFFICES = {"A": ["src0", "src1"], "N": ["src2"], "R": ["src3", "src4", "src5"]}
_PLACES = f"""places(zone, place, office) AS (VALUES {", ".join(f"('{z}', {i}, '{o}')" for z, os in _SLICE_OFFICES.items() for i, o in enumerate(os))}),
    dated AS (SELECT office, doc_id, issued_utc - INTERVAL {_BULLETIN_SHIFT} DAY AS issued_utc, text FROM bulletins WHERE length(trim(text)) > 0
              QUALIFY row_number() OVER (PARTITION BY office, issued_utc ORDER BY doc_id DESC) = 1),
    asked AS (SELECT zone, place, office, operating_date, {sql_cutoff('operating_date')} AS cutoff
              FROM (SELECT DISTINCT zone, operating_date FROM daily) JOIN places USING (zone)),
    sources AS (SELECT asked.*, b.doc_id, b.issued_utc, b.text FROM asked ASOF JOIN dated b ON b.office = asked.office AND b.issued_utc < asked.cutoff - INTERVAL 5 MINUTE)"""


def _dated_bulletins(v):
    return v.bulletins.select("office", "doc_id", (F.col("issued_utc") - F.make_dt_interval(F.lit(_BULLETIN_SHIFT))).alias("issued_utc"),
                              F.col("text").alias("reasoning_text"))


def _text_sources(v):
    return X.text_sources(v.daily.select("zone", "operating_date").distinct(), _dated_bulletins(v), "doc_id", _SLICE_OFFICES)


@job("f12_text_sources", "id zone operating_date:d sources",
     f"""WITH {_PLACES}, e AS ({_EX}), l AS (SELECT zone, operating_date, string_agg(office || ' ' || strftime(issued_utc, '%Y-%m-%d %H:%M:%S'), ',' ORDER BY place) AS sources
              FROM sources GROUP BY 1, 2)
         SELECT e.id, e.zone, e.operating_date, coalesce(l.sources, '') AS sources FROM e LEFT JOIN l USING (zone, operating_date)""")
def _(v):
    ex = X.attach_provenance(X.build_examples(_with_quantiles(v), "climate").select("id", "zone", "operating_date"), _text_sources(v))
    shown = F.transform("sources", lambda s: F.concat_ws(" ", s["office"], F.date_format(s["issued_utc"], "yyyy-MM-dd HH:mm:ss")))
    return ex.withColumn("sources", F.coalesce(F.array_join(shown, ","), F.lit("")))


def _mw(x: str, signed: bool = False) -> str:
    return (f"CASE WHEN ({x}) IS NULL THEN 'n/a' ELSE CASE WHEN ({x}) < 0 THEN '-' ELSE '{'+' if signed else ''}' END"
            f" || format('{{:,}}', CAST(round(round(abs({x}), 6)) AS BIGINT)) END")


def _piped(*cells: str) -> str:
    return " || ' | ' || ".join(cells)


# every third day has no weather, every seventh no visible forecast; quantity and spread stand for the inputs
_P_ROWS = f"""p AS (SELECT d.zone, d.operating_date, d.hour_ending, c.p10, c.p50, c.p90, day(d.operating_date) % 7 <> 0 AS fc,
           day(d.operating_date) % 3 <> 0 AS wx, month(d.operating_date) BETWEEN 6 AND 9 AND isodow(d.operating_date) <= 5 AND NOT {SQL_FEDERAL.replace('operating_date', 'd.operating_date')} AS season,
           quantity * 1000 AS fc_inuse, quantity * 900 AS fc_min, quantity * 1100 AS fc_max, spread - 5 AS imm, quantity - 25 AS rev, quantity AS t, spread AS dew, quantity * 2 AS cl,
           max(error) OVER ({_W4.format(a=2, b=2)}) AS lag2,
           CASE WHEN count(error) OVER ({_W4.format(a=8, b=2)}) >= 4 THEN avg(error) OVER ({_W4.format(a=8, b=2)}) END AS m7,
           CASE WHEN count(error) OVER ({_W4.format(a=8, b=2)}) >= 4 THEN avg(abs(error)) OVER ({_W4.format(a=8, b=2)}) END AS a7,
           CASE WHEN count(error) OVER ({_W4.format(a=31, b=2)}) >= 15 THEN avg(abs(error)) OVER ({_W4.format(a=31, b=2)}) END AS a30
         FROM daily d JOIN climate c USING (zone, hour_ending))"""
_P_QUANT = " || ' / ' || ".join(_mw(q, True) for q in ("p10", "p50", "p90"))
_P_FC = _piped(_mw("fc_inuse"), f"{_mw('fc_min')} || ' .. ' || {_mw('fc_max')}", _mw("imm", True), _mw("rev", True))
_P_WX = _piped(_mw("t * 9 / 5 + 32"), _mw("dew * 9 / 5 + 32"), _mw("cl"), "format('{:.1f}', round(round(dew * 9 / 5, 6), 1))")
_P_HOURS = "'Predict the error distribution for hours ' || string_agg(CAST(hour_ending AS VARCHAR), ', ' ORDER BY hour_ending)"
_P_DAYS = f"""g AS (SELECT zone, operating_date, 'Zone: ' || zone || chr(10) || 'Operating day: a ' || strftime(operating_date, '%A') || ' in ' || strftime(operating_date, '%B')
             || CASE WHEN {SQL_FEDERAL} THEN ' (federal holiday)' ELSE '' END || CASE WHEN {sql_hours('operating_date')} <> 24 THEN ' (clock-change day)' ELSE '' END AS title,
           'HE | ' || CASE WHEN bool_and(fc) THEN 'forecast MW | model range (3 models) | in use minus median | revision | ' ELSE '' END
             || CASE WHEN bool_and(wx) THEN 'temp F | dewpoint F | cloud % | temp spread F | ' ELSE '' END || 'stat p10 / p50 / p90' AS head,
           string_agg(hour_ending || ' | ' || CASE WHEN fc THEN {_P_FC} || ' | ' ELSE '' END || CASE WHEN wx THEN {_P_WX} || ' | ' ELSE '' END || {_P_QUANT}, chr(10) ORDER BY hour_ending) AS lines,
           CASE WHEN bool_and(fc) THEN 'Model in use: m' || (day(operating_date) % 2) || chr(10) ELSE '' END AS in_use,
           CASE WHEN bool_and(season) THEN 'Summer peak season: the system''s forecast peak is ' || {_mw('100 * (arg_min(t, hour_ending) / 50)')} || '% of its highest recent load; large users may curtail' || chr(10)
                ELSE '' END AS season,
           'Errors through two days ago: latest day ' || string_agg({_mw('lag2', True)}, ', ' ORDER BY hour_ending) || '; 7-day mean ' || {_mw('avg(m7)', True)}
             || ', mean absolute ' || {_mw('avg(a7)')} || '; 30-day mean absolute ' || {_mw('avg(a30)')} AS recent,
           string_agg(hour_ending || ' | ' || {_P_QUANT}, chr(10) ORDER BY hour_ending) AS plain, {_P_HOURS} AS ask FROM p GROUP BY 1, 2)"""
_P_TEXT = f"""b AS (SELECT zone, operating_date, string_agg('Latest discussion of office ' || office || ' (' || CAST(floor((epoch_us(cutoff) - epoch_us(issued_utc)) / 3.6e9 + 0.5) AS INTEGER)
             || ' h before the cutoff):' || chr(10) || '\"\"\"' || chr(10) || {SQL_CLEANED.replace('raw_text', 'text')} || chr(10) || '\"\"\"', chr(10) ORDER BY place) || chr(10) AS blocks FROM sources GROUP BY 1, 2)"""
_P_NUM = "title || chr(10) || head || chr(10) || lines || chr(10) || in_use || season || recent || chr(10)"


@job("f13_prompts", "zone operating_date:d variant chars:i digest",
     f"""WITH {_PLACES}, {_P_ROWS}, {_P_DAYS}, {_P_TEXT},
         x AS (SELECT zone, operating_date, variant, CASE variant WHEN 'text' THEN title || chr(10) || 'HE | stat p10 / p50 / p90' || chr(10) || plain || chr(10) ELSE {_P_NUM} END
                   || CASE WHEN variant = 'numeric' THEN '' ELSE coalesce(blocks, '') END || ask AS prompt
               FROM g LEFT JOIN b USING (zone, operating_date), (VALUES ('full'), ('numeric'), ('text')) k(variant))
         SELECT zone, operating_date, variant, length(prompt) AS chars, md5(prompt) AS digest FROM x""")
def _(v):
    d, q, s = F.day("operating_date"), F.col("quantity"), F.col("spread")
    wet = lambda c: F.when(d % 3 != 0, c)
    rows = X.summer_peak_season(X.recent_errors(v.daily)).join(v.climate, ["zone", "hour_ending"]).withColumns({
        "fc_visible": d % 7 != 0, "n_models": F.lit(3), "inuse_model": F.concat(F.lit("m"), d % 2), "fc_inuse": q * 1000, "fc_min": q * 900, "fc_max": q * 1100,
        "inuse_minus_median": s - 5, "revision": q - 25, "sys_peak_ratio": q / 50, "temp_c": wet(q), "dewpoint_c": wet(s), "cloud_cover_pct": wet(q * 2),
        "temp_spread_c": wet(s)})
    texts = _text_sources(v).join(v.bulletins.select("doc_id", N.clean_text("text").alias("prompt_text")), "doc_id")
    out = reshape.stack_all([X.prompt_lines(rows, k, texts) for k in ("full", "numeric", "text")])
    return out.withColumns({"chars": F.length("prompt"), "digest": F.md5("prompt")})


# ---------------------------------------------------------------- baselines
@job("b01_climatology", "zone hour_ending:i p10:4 p50:4 p90:4",
     """SELECT zone, hour_ending, quantile_cont(error, 0.1) AS p10, quantile_cont(error, 0.5) AS p50, quantile_cont(error, 0.9) AS p90
        FROM daily GROUP BY 1, 2""")
def _(v):
    return B.climatology(v.daily)


_B3 = """WITH m AS (SELECT quantile_cont(spread, 0.5) AS a, quantile_cont(quantity, 0.5) AS b FROM daily WHERE operating_date < DATE '1999-01-01'),
    s AS (SELECT daily.*, greatest((spread / a + quantity / b) / 2, 0.2) AS sc FROM daily, m),
    z AS (SELECT zone, quantile_cont(error / sc, 0.1) AS z1, quantile_cont(error / sc, 0.5) AS z5, quantile_cont(error / sc, 0.9) AS z9
          FROM s WHERE operating_date < DATE '1999-01-01' GROUP BY 1)
    SELECT s.zone, s.operating_date, s.hour_ending, z1 * sc AS p10, z5 * sc AS p50, z9 * sc AS p90 FROM s JOIN z USING (zone) WHERE s.operating_date >= DATE '1999-01-01'"""


@job("b03_scale_heuristic", "zone operating_date:d hour_ending:i p10:3 p50:3 p90:3", _B3)
def _(v):
    test = v.daily.filter(F.col("operating_date") >= F.lit(TRAIN_END).cast("date"))
    return B.scale_heuristic(_train(v), test, ["spread", "quantity"])


def _clim_rows(v):
    return v.daily.join(v.climate, ["zone", "hour_ending"]).select(*X.KEY, "p10", "p50", "p90")


_CLIM_ROWS = "SELECT zone, operating_date, hour_ending, p10, p50, p90, error FROM daily JOIN climate USING (zone, hour_ending)"
_SORT3 = "least({a}, {b}, {c}) AS p10, {a} + {b} + {c} - least({a}, {b}, {c}) - greatest({a}, {b}, {c}) AS p50, greatest({a}, {b}, {c}) AS p90"


@job("b07_conformal", "zone operating_date:d hour_ending:i p10:3 p50:3 p90:3",
     f"""WITH r AS ({_CLIM_ROWS}), a AS (SELECT zone, quantile_cont(greatest(p10 - error, error - p90), 0.8) AS a FROM r GROUP BY 1)
         SELECT zone, operating_date, hour_ending, {_SORT3.format(a='(p10 - a)', b='p50', c='(p90 + a)')} FROM r JOIN a USING (zone)""")
def _(v):
    pred = _clim_rows(v)
    return B.apply_adjustment(pred, B.conformal_adjustment(pred, v.daily))


@job("b07_conformal_out_of_fold", "zone operating_date:d hour_ending:i block:i p10:3 p50:3 p90:3",
     f"""WITH b AS (SELECT operating_date, ntile(3) OVER (ORDER BY operating_date) - 1 AS block FROM (SELECT DISTINCT operating_date FROM daily)),
         r AS (SELECT * FROM ({_CLIM_ROWS}) JOIN b USING (operating_date)),
         a AS (SELECT r.zone, k.block, quantile_cont(greatest(p10 - error, error - p90), 0.8) AS a FROM r, (VALUES (0), (1), (2)) k(block)
               WHERE r.block <> k.block GROUP BY 1, 2)
         SELECT zone, operating_date, hour_ending, block, {_SORT3.format(a='(p10 - a)', b='p50', c='(p90 + a)')} FROM r JOIN a USING (zone, block)""")
def _(v):
    pred = _clim_rows(v).join(blocks.time_blocks(v.daily, "operating_date", 3), "operating_date")
    return B.calibrate_out_of_fold(pred, v.daily, 3)


@job("b09_ensemble", "zone operating_date:d hour_ending:i p10:4 p50:4 p90:4",
     f"""WITH r AS ({_CLIM_ROWS}) SELECT zone, operating_date, hour_ending,
         {_SORT3.format(a='((r.p10 + t.p10) / 2)', b='((r.p50 + t.p50) / 2)', c='((r.p90 + t.p90) / 2)')}
         FROM r JOIN trail90 t USING (zone, operating_date, hour_ending) WHERE t.p50 IS NOT NULL""")
def _(v):
    return B.average_of(_clim_rows(v), v.trailing.filter("p50 IS NOT NULL"))


@job("b10_zone_normalized", "zone operating_date:d hour_ending:i error:6",
     """SELECT d.zone, operating_date, hour_ending, error / s AS error FROM daily d JOIN (
            SELECT zone, avg(abs(error)) AS s FROM daily WHERE operating_date < DATE '1999-01-01' GROUP BY 1) USING (zone)""")
def _(v):
    return B.normalized_target(v.daily, B.zone_scale(_train(v)))


@job("b10_normalized_forecast", "zone operating_date:d hour_ending:i p10:4 p50:4 p90:4",
     """WITH t AS (SELECT * FROM daily WHERE operating_date < DATE '1999-01-01'), s AS (SELECT zone, avg(abs(error)) AS s FROM t GROUP BY 1),
             q AS (SELECT hour_ending, quantile_cont(error / s, 0.1) AS a, quantile_cont(error / s, 0.5) AS b, quantile_cont(error / s, 0.9) AS c
                   FROM t JOIN s USING (zone) GROUP BY 1)
        SELECT zone, operating_date, hour_ending, a * s AS p10, b * s AS p50, c * s AS p90 FROM daily JOIN q USING (hour_ending) JOIN s USING (zone)
        WHERE operating_date >= DATE '1999-01-01'""")
def _(v):
    return B.normalized_forecast(_train(v), v.daily.filter(F.col("operating_date") >= F.lit(TRAIN_END).cast("date")))


_LOSS = "(greatest(0.1 * (y - p10), -0.9 * (y - p10)) + greatest(0.5 * (y - p50), -0.5 * (y - p50)) + greatest(0.9 * (y - p90), -0.1 * (y - p90))) / 3"


@job("b11_baseline_selection", "zone operating_date:d hour_ending:i p10:2 p50:2 p90:2 baseline_name",
     f"""WITH w AS (SELECT c.zone, c.day AS operating_date, c.hour_ending, c.y, c.p10 AS c1, c.p50 AS c5, c.p90 AS c9, h.p10 AS h1, h.p50 AS h5, h.p90 AS h9
                    FROM quant c JOIN quant h ON h.id = c.id AND h.hour_ending = c.hour_ending AND h.run = 'hist' WHERE c.run = 'clim'),
         val AS (SELECT * FROM w WHERE year(operating_date) = 1999 AND h5 IS NOT NULL),
         l AS (SELECT (SELECT avg({_LOSS}) FROM (SELECT y, c1 AS p10, c5 AS p50, c9 AS p90 FROM val)) AS lc,
                      (SELECT avg({_LOSS}) FROM (SELECT y, h1 AS p10, h5 AS p50, h9 AS p90 FROM val)) AS lh)
         SELECT zone, operating_date, hour_ending, CASE WHEN lc <= lh THEN c1 ELSE coalesce(h1, c1) END AS p10,
                CASE WHEN lc <= lh THEN c5 ELSE coalesce(h5, c5) END AS p50, CASE WHEN lc <= lh THEN c9 ELSE coalesce(h9, c9) END AS p90,
                CASE WHEN lc <= lh THEN 'clim' ELSE 'hist' END AS baseline_name FROM w, l""")
def _(v):
    c = v.climate.select("zone", "hour_ending", *[F.col(q).alias(f"clim_{q}") for q in B.Q])
    h = v.trailing.select(*X.KEY, *[F.col(q).alias(f"hist_{q}") for q in B.Q])
    rows = v.daily.join(c, ["zone", "hour_ending"]).join(h, X.KEY)
    return B.select_baseline(rows, ["clim", "hist"], F.year("operating_date") == 1999, fill="clim")


# Forests have no SQL twin; they are judged by loss and coverage in the tests.
_FEATS = ["hour_ending", "fc_range", "fc_std", "err_lag2", "err_mean7", "err_mae30", "month_num", "dow"]
_ZONES = ["A", "N", "R"]


def _train_test(v):
    """Training rows, and the later rows to predict: validation and test split."""
    rows = _hourly(v).select(*X.KEY, "error", "split", *[c for c in _FEATS if c != "hour_ending"])
    return rows.filter("split = 'train'"), rows.filter("split IN ('val', 'test')")


@job("b04_quantile_forest", "zone operating_date:d hour_ending:i p10:2 p50:2 p90:2")
def _(v):
    tr, te = map(cut_lineage, _train_test(v))    # read by the fit, the leaf counts and the lookup
    return B.quantile_forest(tr, te, _FEATS, _ZONES)


@job("b06_blocked_out_of_fold", "zone operating_date:d hour_ending:i block:i p10:2 p50:2 p90:2")
def _(v):
    tr, te = _train_test(v)
    oof, test = B.blocked_predictions(tr, te, lambda a, b: B.quantile_forest(a, b, _FEATS, _ZONES), n_blocks=5)
    calibrated = B.calibrate_out_of_fold(oof, tr, 5)
    return reshape.stack_all([calibrated, B.apply_adjustment(test, B.conformal_adjustment(oof, tr)).withColumn("block", F.lit(-1))])


@job("b08_two_stage", "zone operating_date:d hour_ending:i p10:2 p50:2 p90:2")
def _(v):
    tr, te = _train_test(v)
    return B.two_stage(tr, te, _FEATS, _ZONES)


_PERIOD_B = ("1997-01-01", "1997-01-08")


@job("b12_ablation_grid", "experiment period n:l loss:4 coverage:4 vs_first_pct:4")
def _(v):
    tr, te = _train_test(v)
    day = F.col("operating_date")
    periods = {"A": (tr, te.filter("split = 'val'")),
               "B": (tr.filter(day < F.lit(_PERIOD_B[0]).cast("date")), tr.filter(day >= F.lit(_PERIOD_B[1]).cast("date")))}
    return B.ablation_grid(periods, {"base": {}, "wider": {"extra": ["err_mean7"]}, "recent": {"half_life": 365.0},
                                     "two_seeds": {"seeds": [0, 1]}}, ["hour_ending", "fc_range", "err_mae30"], _ZONES)


# ---------------------------------------------------------------- scoring
_FILLED = "SELECT run, id, zone, day, hour_ending, y, p50 IS NOT NULL AS parse_ok, coalesce(p10, 0) AS p10, coalesce(p50, 0) AS p50, coalesce(p90, 0) AS p90 FROM quant"
_PER_EX = f"""SELECT run, id, zone, day, avg({_LOSS}) AS loss, min(parse_ok::INT) AS parse_ok, avg(p90 - p10) AS width,
    avg((y >= p10 AND y <= p90)::INT) AS covered, avg((y < p10)::INT) AS below_p10, avg((y < p50)::INT) AS below_p50, avg((y < p90)::INT) AS below_p90
    FROM ({_FILLED}) GROUP BY 1, 2, 3, 4"""


def _examples(v):
    return E.per_example(E.with_fallback(E.common_ids(v.quant, 2)))


@job("m03_pinball_per_example", "run id zone day:d loss:4 width:4 covered:4 parse_ok:i below_p10:4 below_p50:4 below_p90:4", _PER_EX)
def _(v):
    return _examples(v)


@job("m05_relative_skill", "id skill:6 reward_unordered:6",
     f"""WITH p AS ({_PER_EX}), j AS (SELECT h.id, greatest(-1, least(1, (c.loss - h.loss) / greatest(c.loss, 5.0))) AS skill, h.parse_ok = 1 AS ok
            FROM p h JOIN p c ON c.id = h.id AND c.run = 'clim' WHERE h.run = 'hist')
         SELECT id, CASE WHEN ok THEN skill ELSE -1 END AS skill, CASE WHEN ok THEN greatest(skill - 0.1, -1) ELSE -1 END AS reward_unordered FROM j""")
def _(v):
    ex = _examples(v)
    rows = E.paired(ex, "clim").filter("run = 'hist'").withColumnRenamed("ref_loss", "base")
    ok = F.col("parse_ok") == 1
    return rows.select("id", M.percentile_reward(F.col("loss"), F.col("base"), ok, F.lit(False)).alias("skill"),
                       M.percentile_reward(F.col("loss"), F.col("base"), ok, F.lit(True)).alias("reward_unordered"))


@job("m05_scaled_reward", "id reward_scale:2 reward:6 reward_unordered:6",
     f"""WITH p AS ({_PER_EX}), s AS (SELECT zone, round(quantile_cont(loss, 0.5), 2) AS s FROM p WHERE run = 'clim' AND day < DATE '1999-01-01' GROUP BY 1),
              j AS (SELECT h.id, s, greatest(-1, least(1, CASE WHEN coalesce(s, 0) <> 0 THEN (c.loss - h.loss) / s ELSE (c.loss - h.loss) / greatest(c.loss, 5.0) END)) AS r,
                           h.parse_ok = 1 AS ok FROM p h JOIN p c ON c.id = h.id AND c.run = 'clim' LEFT JOIN s ON s.zone = h.zone WHERE h.run = 'hist')
         SELECT id, s AS reward_scale, CASE WHEN ok THEN r ELSE -1 END AS reward, CASE WHEN ok THEN greatest(r - 0.1, -1) ELSE -1 END AS reward_unordered FROM j""")
def _(v):
    pairs = E.paired(_examples(v), "clim").withColumnRenamed("ref_loss", "base")
    train = (F.col("day") < F.lit(TRAIN_END).cast("date")) & (F.col("run") == "clim")
    rows = M.zone_reward_scale(pairs, train).filter("run = 'hist'")
    reward = [M.percentile_reward(F.col("loss"), F.col("base"), F.col("parse_ok") == 1, F.lit(swapped), F.col("reward_scale")) for swapped in (False, True)]
    return rows.select("id", "reward_scale", reward[0].alias("reward"), reward[1].alias("reward_unordered"))


@job("m06_scaled_interval_reward", "id scale:2 reward:6",
     f"""WITH s AS (SELECT id, CASE WHEN day(day) % 5 = 0 THEN NULL ELSE 0.5 + day(day) % 5 * 0.5 END AS scale, hour_ending, y, p10, p50, p90 FROM quant WHERE run = 'clim'),
         l AS (SELECT id, max(scale) AS scale, avg({_LOSS}) AS base FROM s GROUP BY 1),
         m AS (SELECT id, avg({_LOSS}) AS model FROM (SELECT id, y, p50 + scale * (p10 - p50) AS p10, p50, p50 + scale * (p90 - p50) AS p90 FROM s) GROUP BY 1)
         SELECT id, scale, CASE WHEN scale IS NULL THEN -1 ELSE greatest(-1, least(1, (base - model) / greatest(base, 5.0))) END AS reward FROM l JOIN m USING (id)""")
def _(v):
    base = v.clim_run.select("id", "day", "y", "p10", "p50", "p90")
    d = F.day("day") % 5
    scales = base.select("id", F.when(d != 0, 0.5 + d * 0.5).alias("scale")).distinct()
    return M.scale_rewards(base.drop("day"), scales)


@job("m07_zone_reward_scale", "id reward_scale:2",
     f"""WITH p AS ({_PER_EX}) SELECT id, s AS reward_scale FROM p JOIN (SELECT zone, round(quantile_cont(loss, 0.5), 2) AS s FROM p
            WHERE run = 'clim' AND day < DATE '1999-01-01' GROUP BY 1) USING (zone) WHERE run = 'clim'""")
def _(v):
    ex = _examples(v).filter("run = 'clim'")
    return M.zone_reward_scale(ex, F.col("day") < F.lit(TRAIN_END).cast("date"))


_VERDICT = """SELECT id, zone, day, CAST(day(day) % 7 AS INTEGER) AS k, hour_ending, y, p10, p50, p90, k NOT IN (4, 6) AS ok, k = 3 AND p10 <> p90 AS swapped
    FROM quant WHERE run = 'clim'"""


@job("x11_parse_quantile_answers", "id parse_ok:b reordered:b hours:i p10_sum:2 p90_sum:2",
     f"""SELECT id, bool_and(ok) AS parse_ok, bool_or(swapped) AS reordered, count(*) FILTER (WHERE ok) AS hours,
               sum(p10) FILTER (WHERE ok) AS p10_sum, sum(p90) FILTER (WHERE ok) AS p90_sum FROM ({_VERDICT}) GROUP BY 1""")
def _(v):
    from gridspark.plans.answers import parse_quantiles
    vals = F.map_values("hours_map")
    total = lambda q: F.when(F.col("parse_ok"), F.aggregate(vals, F.lit(0.0), lambda a, x: a + x[q]))
    out = parse_quantiles(v.completions, "text", "hours")
    return out.select("id", "parse_ok", "reordered", F.coalesce(F.when(F.col("parse_ok"), F.size("hours_map")), F.lit(0)).alias("hours"),
                      total("p10").alias("p10_sum"), total("p90").alias("p90_sum"))


@job("m08_score_completions", "id reward:6 parse_ok:b pinball:4 baseline_pinball:4 covered:4 width:4",
     f"""WITH b AS (SELECT q.id, q.hour_ending, q.y, q.p10, q.p50 + 100 AS p50, q.p90 + 200 AS p90 FROM quant q WHERE run = 'clim'),
         bl AS (SELECT id, avg({_LOSS}) AS base FROM b GROUP BY 1),
         m AS (SELECT id, bool_and(ok) AS ok, bool_or(swapped) AS sw, avg({_LOSS}) AS loss, avg((y BETWEEN p10 AND p90)::INT) AS cov, avg(p90 - p10) AS width FROM ({_VERDICT}) GROUP BY 1)
         SELECT id, CASE WHEN ok THEN greatest(-1, greatest(-1, least(1, (base - loss) / greatest(base, 5.0))) - CASE WHEN sw THEN 0.1 ELSE 0 END) ELSE -1 END AS reward,
                ok AS parse_ok, CASE WHEN ok THEN loss END AS pinball, base AS baseline_pinball, CASE WHEN ok THEN cov END AS covered, CASE WHEN ok THEN width END AS width
         FROM m JOIN bl USING (id)""")
def _(v):
    from gridspark.plans.answers import parse_quantiles
    parsed = parse_quantiles(v.completions, "text", "hours").withColumn("hours", F.col("hours_map"))
    base = v.clim_run.select("id", "hour_ending", "y", "p10", (F.col("p50") + 100).alias("p50"), (F.col("p90") + 200).alias("p90"))
    return M.score_completions(parsed, base)


@job("m09_echo_run", "id reward:6",
     "SELECT DISTINCT id, 0 AS reward FROM quant WHERE run = 'clim'")
def _(v):
    q = v.clim_run
    entry = F.struct("hour_ending", F.struct("p10", "p50", "p90").alias("q"))
    parsed = M.echo_run(q, "echo").groupBy("id").agg(F.map_from_entries(F.collect_list(entry)).alias("hours")).withColumns(
        {"parse_ok": F.lit(True), "reordered": F.lit(False)})
    return M.score_completions(parsed, q)


@job("m02_grade_answers", "task_id answer_type outcome reward:2",
     """WITH u AS (SELECT user_id, count(DISTINCT event_type) AS k FROM events GROUP BY 1)
        SELECT 'task' || user_id AS task_id, ['number', 'integer', 'timestamp', 'category', 'list'][CAST(user_id % 5 AS INTEGER) + 1] AS answer_type,
               CASE WHEN user_id % 11 = 0 THEN 'format_error' WHEN user_id % 13 = 0 THEN 'sql_error' WHEN user_id % 17 = 0 THEN 'format_error'
                    WHEN CASE user_id % 5 WHEN 0 THEN user_id % 4 <= 1 WHEN 1 THEN user_id % 4 <> 3 WHEN 2 THEN user_id % 4 <= 1
                              WHEN 3 THEN user_id % 4 <> 3 ELSE user_id % 4 <= 1 END THEN 'correct' ELSE 'wrong_answer' END AS outcome,
               CASE outcome WHEN 'correct' THEN 1.0 WHEN 'format_error' THEN -0.2 ELSE 0 END AS reward FROM u""")
def _(v):
    return M.grade(*v.graded)


# ---------------------------------------------------------------- evaluation
def _pass(k: int) -> str:
    prod = " * ".join(f"greatest(n - c - {i}, 0) / nullif(n - {i}, 0)" for i in range(k))
    return f"CASE WHEN n - c < {k} THEN 1.0 ELSE 1.0 - {prod} END"


_E2 = f"""WITH t AS (SELECT model, backend, split, family, difficulty::VARCHAR AS difficulty, template_id, task_id, count(*)::DOUBLE AS n,
        count(*) FILTER (WHERE outcome = 'correct')::DOUBLE AS c, count(*) FILTER (WHERE outcome = 'sql_error') AS e, sum(reward) AS r, sum(latency_s) AS l,
        sum(output_tokens) AS o, count(output_tokens) AS oc, sum(cost_usd) AS cost FROM samples GROUP BY ALL),
    g AS (SELECT *, 'overall' AS group_type, 'all' AS group_value FROM t UNION ALL SELECT *, 'family', family FROM t
          UNION ALL SELECT *, 'difficulty', difficulty FROM t UNION ALL SELECT *, 'template', template_id FROM t)
    SELECT model, backend, split, group_type, group_value, count(*) AS tasks, sum(n) AS samples, min(n) AS k_min, avg(c / n) AS pass_1,
           CASE WHEN min(n) >= 5 THEN avg({_pass(5)}) END AS pass_5, CASE WHEN min(n) >= 10 THEN avg({_pass(10)}) END AS pass_10,
           avg((c = n)::INT) AS consistency, count(*) FILTER (WHERE c = 0) AS never_solved, sum(c) / sum(n) AS correct, sum(e) / sum(n) AS sql_error,
           sum(r) / sum(n) AS mean_reward, sum(l) / sum(n) AS mean_latency_s, sum(o) / sum(oc) AS mean_output_tokens, sum(cost) AS total_cost_usd
    FROM g GROUP BY 1, 2, 3, 4, 5"""


@job("e02_outcome_report", "model backend split group_type group_value tasks:l samples:l k_min:l pass_1:6 pass_5:6 pass_10:6 consistency:6 never_solved:l "
     "correct:6 sql_error:6 mean_reward:6 mean_latency_s:6 mean_output_tokens:6 total_cost_usd:2", _E2)
def _(v):
    return E.report(v.samples)


@job("e01_pass_at_k", "task_id n:l c:l pass_1:6 pass_5:6 pass_10:6",
     f"""SELECT task_id, n, c, {_pass(1)} AS pass_1, {_pass(5)} AS pass_5, {_pass(10)} AS pass_10 FROM (
            SELECT task_id, count(*)::DOUBLE AS n, count(*) FILTER (WHERE outcome = 'correct')::DOUBLE AS c FROM samples GROUP BY 1)""")
def _(v):
    t = v.samples.groupBy("task_id").agg(F.count("*").alias("n"), F.count_if(F.col("outcome") == "correct").alias("c"))
    return t.withColumns({f"pass_{k}": S.pass_at_k(F.col("n"), F.col("c"), k) for k in (1, 5, 10)})


@job("j13_common_ids", "run id rows:l",
     """WITH s AS (SELECT * FROM quant WHERE p50 IS NOT NULL) SELECT run, id, count(*) AS rows FROM s
        WHERE id IN (SELECT id FROM s GROUP BY id HAVING count(DISTINCT run) = 2) GROUP BY 1, 2""")
def _(v):
    return E.common_ids(v.quant.filter("p50 IS NOT NULL")).groupBy("run", "id").agg(F.count("*").alias("rows"))


@job("e03_run_summary", "run n:l parse_fail_pct:4 reward:6 pinball:4 baseline_pinball:4 coverage:6 width:4 reward_models_agreed:6",
     f"""WITH p AS ({_PER_EX}), s AS (SELECT h.run, h.parse_ok = 1 AS ok, h.loss, c.loss AS base, h.covered, h.width, day(h.day) % 2 = 0 AS agreed,
            CASE WHEN h.parse_ok = 1 THEN greatest(-1, least(1, (c.loss - h.loss) / greatest(c.loss, 5.0))) ELSE -1 END AS reward
            FROM p h JOIN p c ON c.id = h.id AND c.run = 'clim')
         SELECT run, count(*) AS n, 100 * (1 - avg(ok::INT)) AS parse_fail_pct, avg(reward) AS reward, avg(loss) FILTER (WHERE ok) AS pinball,
                avg(base) AS baseline_pinball, avg(covered) FILTER (WHERE ok) AS coverage, avg(width) FILTER (WHERE ok) AS width,
                avg(reward) FILTER (WHERE agreed) AS reward_models_agreed FROM s GROUP BY 1""")
def _(v):
    ex = _examples(v)
    ok = F.col("parse_ok") == 1
    rows = E.paired(ex, "clim").withColumnRenamed("ref_loss", "baseline_pinball").withColumns({
        "reward": M.percentile_reward(F.col("loss"), F.col("baseline_pinball"), ok, F.lit(False)), "parse_ok": ok,
        "pinball": F.col("loss"), "models_agreed": F.day("day") % 2 == 0})
    return E.run_summary(rows)


_REPS = 2000
_DRAWS = f"""days AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS pos FROM (SELECT DISTINCT day FROM quant)),
    picks AS MATERIALIZED (SELECT r.r AS replicate, CAST('0x' || substr(md5(r.r || '-' || k.pos), 1, 8) AS BIGINT) % c.n AS pos
                           FROM range({_REPS}) r(r), days k, (SELECT count(*) AS n FROM days) c),
    draws AS (SELECT replicate, day FROM picks JOIN days USING (pos))"""
_PAIRS = f"pairs AS (SELECT a.*, b.loss AS ref_loss, round(a.loss - b.loss, 6) AS delta FROM ({_PER_EX}) a JOIN ({_PER_EX}) b ON b.id = a.id AND b.run = 'clim')"


def _pairs(v):
    return E.paired(_examples(v), "clim")


@job("e05_paired_comparison", "run n:l days:l loss:4 ref_loss:4 delta:4 delta_pct:4 ci_lo_pct:4 ci_hi_pct:4 p_better:4 coverage:4",
     f"""WITH {_PAIRS}, {_DRAWS}, pd AS (SELECT run, day, sum(delta) AS d, count(*) AS n FROM pairs GROUP BY 1, 2),
         b AS (SELECT replicate, run, sum(d) / sum(n) AS m FROM draws JOIN pd USING (day) GROUP BY 1, 2),
         s AS (SELECT run, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi, avg((m < 0)::INT) AS p_better FROM b GROUP BY 1)
         SELECT run, count(*) AS n, count(DISTINCT day) AS days, avg(loss) AS loss, avg(ref_loss) AS ref_loss, avg(delta) AS delta, 100 * avg(delta) / avg(ref_loss) AS delta_pct,
                100 * min(lo) / avg(ref_loss) AS ci_lo_pct, 100 * min(hi) / avg(ref_loss) AS ci_hi_pct, min(p_better) AS p_better, avg(covered) AS coverage
         FROM pairs JOIN s USING (run) GROUP BY 1""")
def _(v):
    return E.paired_comparison(_pairs(v), _REPS)


@job("e06_cluster_bootstrap", "replicate:l run mean_delta:4",
     f"""WITH {_PAIRS}, {_DRAWS} SELECT replicate, run, sum(delta) / count(*) AS mean_delta FROM draws JOIN pairs USING (day) GROUP BY 1, 2""")
def _(v):
    per_day = _pairs(v).groupBy("run", "day").agg(F.sum("delta").alias("d"), F.count("*").alias("n"))
    return resampled_sums(per_day, ["run"], "day", ["d", "n"], _REPS).withColumn("mean_delta", F.col("d") / F.col("n"))


@job("e07_zone_skill", "run zone_skill_pct:4 system_skill_pct:4",
     f"""WITH {_PAIRS}, z AS (SELECT run, zone, 1 - avg(loss) / avg(ref_loss) AS s FROM pairs GROUP BY 1, 2)
         SELECT run, 100 * avg(s) FILTER (WHERE zone <> 'R') AS zone_skill_pct, 100 * max(s) FILTER (WHERE zone = 'R') AS system_skill_pct FROM z GROUP BY 1""")
def _(v):
    return E.zone_skill(_pairs(v), system_zone="R")


@job("e07_zone_skill_interval", "run lo:4 hi:4",
     f"""WITH {_PAIRS}, {_DRAWS}, z AS (SELECT replicate, run, zone, 1 - sum(loss) / sum(ref_loss) AS s FROM draws JOIN pairs USING (day) WHERE zone <> 'R' GROUP BY 1, 2, 3),
         m AS (SELECT replicate, run, 100 * avg(s) AS s FROM z GROUP BY 1, 2)
         SELECT run, quantile_cont(s, 0.025) AS lo, quantile_cont(s, 0.975) AS hi FROM m GROUP BY 1""")
def _(v):
    return E.zone_skill_interval(_pairs(v), _REPS, system_zone="R")


_CAL = """avg((y < p10)::INT) AS below_p10, avg((y < p50)::INT) AS below_p50, avg((y < p90)::INT) AS below_p90, avg((z < 1)::INT) AS within_1sd,
    avg((z < 2)::INT) AS within_2sd, avg((z > 3)::INT) AS beyond_3sd"""
_CAL_ROWS = f"(SELECT *, abs(y - p50) / (greatest(p90 - p10, 1e-9) / (2 * 1.2816)) AS z FROM ({_FILLED}))"


@job("e08_calibration", "run below_p10:6 below_p50:6 below_p90:6 within_1sd:6 within_2sd:6 beyond_3sd:6",
     f"SELECT run, {_CAL} FROM {_CAL_ROWS} GROUP BY 1")
def _(v):
    return E.calibration(E.with_fallback(v.quant))


@job("e08_zone_calibration", "run zone below_p10:6 below_p90:6", f"SELECT run, zone, {_CAL} FROM {_CAL_ROWS} GROUP BY 1, 2")
def _(v):
    return E.calibration(E.with_fallback(v.quant), ["run", "zone"])


_THEME_WORDS = {name: words for name, words in zip(THEMES, ("Storms", "hail", "record high", "flooding", "tropical", "benign"), strict=True)}
_SLICE_TEXT = "text || " + " || ".join(f"CASE WHEN doc_id % {k + 2} = 0 THEN ' {w}' ELSE '' END" for k, w in enumerate(_THEME_WORDS.values()))
_THEMED = f"""z(zone, office) AS (VALUES {", ".join(f"('{z}', '{o}')" for z, os in _SLICE_OFFICES.items() for o in os)}),
    b AS (SELECT office, doc_id, issued_utc - INTERVAL {_BULLETIN_SHIFT} DAY AS issued, lower({_SLICE_TEXT}) AS t FROM bulletins
          WHERE length(trim({_SLICE_TEXT})) > 0 QUALIFY row_number() OVER (PARTITION BY office, issued_utc ORDER BY doc_id DESC) = 1),
    zd AS (SELECT zone, office, day, {sql_cutoff('day')} - INTERVAL 5 MINUTE AS lim FROM (SELECT DISTINCT zone, day FROM pairs) JOIN z USING (zone)),
    flags AS (SELECT zone, day, {", ".join(f"bool_or(regexp_matches(t, '{p}')) AS theme_{k}" for k, p in THEMES.items())}
              FROM zd ASOF JOIN b ON b.office = zd.office AND b.issued < zd.lim GROUP BY 1, 2),
    themed AS (SELECT pairs.*, flags.* EXCLUDE (zone, day) FROM pairs LEFT JOIN flags USING (zone, day))"""
_SLICE_SQL = " UNION ALL ".join(
    f"SELECT '{name}' AS slice, CAST({e} AS VARCHAR) AS value, run, loss, ref_loss FROM themed"
    for name, e in (("zone", "zone"), ("month", "strftime(day, '%m')"), ("models_agreed", "day(day) % 2 = 0"), ("big_miss", "ref_loss > 5000"),
                    *((f"theme_{k}", f"coalesce(theme_{k}, false)") for k in THEMES)))
_HOUR_SQL = f"""SELECT 'hour_ending' AS slice, 'HE' || a.hour_ending AS value, a.run, a.n, 100 * (a.l / b.l - 1) AS vs_ref_pct
    FROM (SELECT run, hour_ending, count(*) AS n, avg({_LOSS}) AS l FROM ({_FILLED}) GROUP BY 1, 2) a
    JOIN (SELECT hour_ending, avg({_LOSS}) AS l FROM ({_FILLED}) WHERE run = 'clim' GROUP BY 1) b USING (hour_ending)"""


def _sliced(v, themes: bool = False):
    rows = _pairs(v).withColumns({"month": F.date_format("day", "MM"), "models_agreed": F.day("day") % 2 == 0,
                                  "big_miss": F.col("ref_loss") > 5000})
    if not themes:
        return E.slices(rows, ["zone", "month", "models_agreed", "big_miss"])
    bulletins = v.bulletins.select("office", "doc_id", (F.col("issued_utc") - F.make_dt_interval(F.lit(_BULLETIN_SHIFT))).alias("issued_utc"),
                                   F.expr(_SLICE_TEXT).alias("reasoning_text"))
    office = F.explode(F.array(*[F.struct(F.lit(z).alias("z"), F.lit(o).alias("office")) for z, os in _SLICE_OFFICES.items() for o in os]))
    zone_days = v.daily.select("zone", F.col("operating_date").alias("day")).distinct().select("zone", "day", office.alias("o")) \
        .filter("zone = o.z").select("zone", "o.office", "day")
    masks = E.theme_masks(zone_days, bulletins)
    return E.slices(rows.join(masks, ["zone", "day"], "left").fillna(0, ["themes"]), ["zone", "month", "models_agreed", "big_miss"], "themes")


@job("e09_slices", "slice value run n:l vs_ref_pct:4",
     f"""WITH {_PAIRS}, {_THEMED} SELECT slice, value, run, count(*) AS n, 100 * (avg(loss) / avg(ref_loss) - 1) AS vs_ref_pct FROM ({_SLICE_SQL}) GROUP BY 1, 2, 3
         UNION ALL {_HOUR_SQL}""")
def _(v):
    return _sliced(v, themes=True).unionByName(E.hour_slices(E.with_fallback(E.common_ids(v.quant, 2)), "clim"))


@job("a15_slice_pivot", "run A:4 N:4 R:4",
     f"""WITH {_PAIRS} SELECT run, {", ".join(f"100 * (avg(loss) FILTER (WHERE zone = '{z}') / avg(ref_loss) FILTER (WHERE zone = '{z}') - 1) AS {z}" for z in "ANR")}
         FROM pairs GROUP BY 1""")
def _(v):
    return E.pivot_slice(_sliced(v), "zone", ["A", "N", "R"])


_PRICES = """SELECT zone, operating_date AS day, hour_ending, CASE WHEN day(operating_date) % 6 = 0 THEN 0 WHEN day(operating_date) % 7 <> 0 THEN quantity - 15 END AS price FROM daily"""


@job("e10_extra_metrics", "run price_weighted:4 price_weighted_vs_ref_pct:4 p50_mae:4 plain_mae:4 p50_vs_plain_pct:4 skill_vs_climate_pct:4",
     f"""WITH r AS (SELECT f.*, x.price, c.p10 AS c1, c.p50 AS c5, c.p90 AS c9 FROM ({_FILLED}) f LEFT JOIN ({_PRICES}) x USING (zone, day, hour_ending)
             LEFT JOIN climate c USING (zone, hour_ending)),
         m AS (SELECT run, quantile_cont(price, 0.5) FILTER (WHERE price <> 0) AS med FROM r GROUP BY 1),
         w AS (SELECT r.run, y, p50, {_LOSS} AS loss, CASE WHEN price <> 0 THEN greatest(price, 0) ELSE med END AS w,
                      {_LOSS.replace('p10', 'c1').replace('p50', 'c5').replace('p90', 'c9')} AS closs FROM r JOIN m USING (run)),
         s AS (SELECT run, sum(w * loss) / sum(w) AS pw, avg(abs(y - p50)) AS mae, avg(abs(y)) AS plain, 100 * (1 - avg(loss) / avg(closs)) AS sk FROM w GROUP BY 1)
         SELECT run, pw AS price_weighted, 100 * (pw / (SELECT pw FROM s WHERE run = 'clim') - 1) AS price_weighted_vs_ref_pct, mae AS p50_mae, plain AS plain_mae,
                100 * (mae / plain - 1) AS p50_vs_plain_pct, sk AS skill_vs_climate_pct FROM s""")
def _(v):
    d = F.day("operating_date")
    price = F.when(d % 6 == 0, 0.0).when(d % 7 != 0, F.col("quantity") - 15)
    prices = v.daily.select("zone", F.col("operating_date").alias("day"), "hour_ending", price.alias("price"))
    return E.extra_metrics(E.with_fallback(v.quant), prices, v.climate, "clim")


@job("e11_rollout_diversity", "model prompts:l parse_rate:6 mean_distinct:6 groups_with_variance:6 mean_std:6 mean_reward:6 echo_share:6",
     """WITH g AS (SELECT model, task_id, count(DISTINCT outcome || output_tokens % 3) AS d, stddev_pop(reward) AS s, avg(reward) AS m, avg((output_tokens % 3 = 0)::INT) AS e,
            avg((outcome <> 'format_error')::INT) AS ok FROM samples GROUP BY 1, 2)
        SELECT model, count(*) AS prompts, avg(ok) AS parse_rate, avg(d) AS mean_distinct, avg((s > 1e-6)::INT) AS groups_with_variance, avg(s) AS mean_std,
               avg(m) AS mean_reward, avg(e) AS echo_share FROM g GROUP BY 1""")
def _(v):
    third = F.col("output_tokens") % 3
    rows = v.samples.select("model", F.col("task_id").alias("prompt_id"), F.concat("outcome", third).alias("answer"), "reward",
                            (F.col("outcome") != "format_error").alias("parse_ok"), (third == 0).alias("echo"))
    return E.rollout_diversity(rows)


@job("e12_reward_reconciliation", "sample_idx:l logged:4 recomputed:4",
     """SELECT sample_idx, reward + CASE WHEN sample_idx % 97 = 0 THEN 0.5 ELSE 0 END AS logged, reward AS recomputed FROM samples WHERE sample_idx % 97 = 0""")
def _(v):
    logged = v.samples.select("sample_idx", (F.col("reward") + F.when(F.col("sample_idx") % 97 == 0, 0.5).otherwise(0.0)).alias("reward"))
    again = v.samples.select("sample_idx", M.outcome_reward("outcome").alias("reward"))
    return E.reconcile(logged, again, "sample_idx")


@job("e13_best_checkpoint", "run step:i reward:2",
     """WITH l AS (SELECT event_type AS run, user_id AS step, arg_max(round(value, 1), event_id) AS reward FROM events WHERE event_id % 4 <> 1 GROUP BY 1, 2)
        SELECT run, step, reward FROM l QUALIFY row_number() OVER (PARTITION BY run ORDER BY reward DESC, step DESC) = 1""")
def _(v):
    line = F.when(F.col("event_id") % 4 != 1, F.format_string(
        "\u001b[32m12:00\u001b[0m Evaluated val | Policy v%d | time 3s | Reward %s | done", "user_id", F.round("value", 1).cast("string"))).otherwise("step finished")
    return E.best_checkpoints(v.events.select(F.col("event_type").alias("run"), F.col("event_id").alias("line_no"), line.alias("line")))


# ---------------------------------------------------------------- money
def _widths(v):
    w = v.da_full.groupBy("point", "operating_date").agg((F.max("price") - F.min("price")).alias("width"))
    ref = w.groupBy("point").agg(F.percentile("width", F.lit(0.5)).alias("ref_width"))
    return w, ref


_MONEY = """WITH cd AS (SELECT point, operating_date FROM da_full GROUP BY 1, 2 HAVING count(*) = 24),
    wd AS (SELECT point, operating_date, max(price) - min(price) AS width FROM da_full GROUP BY 1, 2),
    rw AS (SELECT point, quantile_cont(width, 0.5) AS ref FROM wd GROUP BY 1),
    pol AS (SELECT point, operating_date, policy, CASE policy WHEN 'fixed' THEN 0.8 ELSE CASE WHEN width > 0 THEN least(greatest(0.8 * ref / width, 0.2), 1.0) ELSE 0.8 END END AS f
            FROM wd JOIN rw USING (point) JOIN cd USING (point, operating_date), (VALUES ('fixed'), ('adaptive')) p(policy)),
    h AS (SELECT d.point, d.operating_date, hour_ending, price, avg(price) FILTER (WHERE hour_ending <= 6) OVER g AS night, max(price) OVER g AS mx,
                 row_number() OVER (PARTITION BY d.point, d.operating_date ORDER BY price DESC, hour_ending) AS rk
          FROM da_full d JOIN cd USING (point, operating_date) WINDOW g AS (PARTITION BY d.point, d.operating_date)),
    t AS (SELECT h.*, policy, f, (rk <= 2 AND price > night / 0.85 + 10)::INT AS top FROM h JOIN pol USING (point, operating_date)),
    aw AS (SELECT *, sum(top) OVER (PARTITION BY point, operating_date, policy) AS tops FROM t),
    a AS (SELECT *, CASE WHEN tops > 0 THEN least(f * 20 * tops, f * 39.2) ELSE 0 END AS com,
                 CASE WHEN top = 1 THEN least(f * 20 * tops, f * 39.2) / tops ELSE 0 END AS award FROM aw),
    q AS (SELECT point, operating_date, hour_ending, quarter, price AS rt, lag(price) OVER (PARTITION BY point, operating_date ORDER BY hour_ending, quarter) AS pr,
                 row_number() OVER (PARTITION BY point, operating_date ORDER BY hour_ending, quarter) AS i FROM rt_full),
    z AS (SELECT q.*, a.policy, a.award, a.com, (q.hour_ending BETWEEN 7 AND 22 AND pr > greatest(mx, night / 0.85 + 10)) AS go FROM q JOIN a USING (point, operating_date, hour_ending)),
    cp AS (SELECT *, CASE WHEN go THEN (20 - award) / 4 ELSE 0 END AS cap FROM z),
    us AS (SELECT *, sum(cap) OVER (PARTITION BY point, operating_date, policy ORDER BY i) AS used FROM cp),
    fin AS (SELECT point, operating_date, policy, max(com) + max(least(used, 39.2 - com)) AS dis,
                   sum((least(used, 39.2 - com) - least(used - cap, 39.2 - com)) * rt) AS rt_rev FROM us GROUP BY 1, 2, 3 HAVING count(*) = 96),
    m AS (SELECT a.point, a.operating_date, a.policy, max(a.f) AS fraction, sum(a.award * a.price) AS da_rev, max(a.night) AS night FROM a GROUP BY 1, 2, 3),
    money AS (SELECT m.*, rt_rev, dis AS discharged, dis / 0.85 * night AS charge_cost, dis * 10 AS wear, da_rev + rt_rev - dis / 0.85 * night - dis * 10 AS total
              FROM m JOIN fin USING (point, operating_date, policy)),
    up AS (SELECT point, operating_date, max(fraction) FILTER (WHERE policy = 'adaptive') AS fraction, max(total) FILTER (WHERE policy = 'fixed') AS fixed_usd,
                  max(total) FILTER (WHERE policy = 'adaptive') AS adaptive_usd, CASE WHEN operating_date >= DATE '2024-01-16' THEN 'after' ELSE 'before' END AS era
           FROM money GROUP BY 1, 2)
"""


def _policies(v):
    w, ref = _widths(v)
    pol = F.explode(F.array(F.struct(F.lit("fixed").alias("policy"), F.lit(0.8).alias("fraction")),
                            F.struct(F.lit("adaptive").alias("policy"), R.commitment_fraction("width", "ref_width").alias("fraction"))))
    return w.join(ref, "point").select("point", "operating_date", pol.alias("p")).select("point", "operating_date", "p.policy", "p.fraction")


def _uplift(v):
    import datetime as dt
    return R.commitment_uplift(v.da_full, v.rt_full, *_widths(v), redesign=dt.date(2024, 1, 16))


@job("r03_settled_days", "point operating_date:d policy fraction:4 da_rev:2 rt_rev:2 discharged:4 charge_cost:2 wear:4 total:2", _MONEY + "SELECT * FROM money")
def _(v):
    return R.settle_days(v.da_full, v.rt_full, _policies(v))


@job("r05_complete_price_days", "point operating_date:d",
     """SELECT point, operating_date FROM da_full GROUP BY 1, 2 HAVING count(*) = 24
        INTERSECT SELECT point, operating_date FROM rt_full GROUP BY 1, 2 HAVING count(*) = 96""")
def _(v):
    return R.complete_price_days(v.da_full, v.rt_full)


@job("r06_commitment_uplift", "point operating_date:d era fraction:4 fixed_usd:2 adaptive_usd:2", _MONEY + "SELECT * FROM up")
def _(v):
    return _uplift(v)


@job("a16_era_totals", "era fixed_usd:1 adaptive_usd:1 uplift_usd:1 days:l",
     _MONEY + """SELECT era, sum(fixed_usd) AS fixed_usd, sum(adaptive_usd) AS adaptive_usd, sum(adaptive_usd - fixed_usd) AS uplift_usd, count(*) AS days FROM up GROUP BY 1""")
def _(v):
    return R.era_totals(_uplift(v))


@job("w13_capped_allocation", "point operating_date:d hour_ending:i quarter:i policy extra_mwh:6",
     _MONEY + """SELECT point, operating_date, hour_ending, quarter, policy, least(used, 39.2 - com) - least(used - cap, 39.2 - com) AS extra_mwh
        FROM us JOIN fin USING (point, operating_date, policy)""")
def _(v):
    return R.held_back_dispatch(R.day_ahead_awards(v.da_full, _policies(v)), v.rt_full)


@job("r01_two_settlement", "point operating_date:d da_rev:2 rt_rev:2 discharged:4 total:2",
     """SELECT point, operating_date, sum(award * da) * 0.25 AS da_rev, sum((output - award) * rt) * 0.25 AS rt_rev, sum(greatest(output, 0)) * 0.25 AS discharged,
              sum(award * da) * 0.25 + sum((output - award) * rt) * 0.25 - 100 - 10 * sum(greatest(output, 0)) * 0.25 AS total
        FROM (SELECT r.point, r.operating_date, r.price AS rt, d.price AS da, CASE WHEN r.hour_ending >= 18 THEN 5 ELSE 0 END AS award,
                     CASE WHEN r.hour_ending >= 17 THEN r.quarter * 2 - 2 ELSE 0 END AS output
              FROM rt_full r JOIN da_full d USING (point, operating_date, hour_ending)) GROUP BY 1, 2""")
def _(v):
    da = v.da_full.select("point", "operating_date", "hour_ending", F.col("price").alias("da_price"))
    rows = v.rt_full.withColumnRenamed("price", "rt_price").join(da, ["point", "operating_date", "hour_ending"])
    he = F.col("hour_ending")
    return R.account(rows.withColumns({"award": F.when(he >= 18, 5.0).otherwise(0.0),
                                       "output": F.when(he >= 17, F.col("quarter") * 2.0 - 2).otherwise(0.0),
                                       "charge_mwh": F.lit(10.0), "charge_price": F.lit(10.0)}), degradation=10.0)


@job("r07_imbalance", "run zone_hours:l mwh_model:3 mwh_plain:3 cost_model:1 cost_plain:1 risk_model:1 risk_plain:1 mwh_change_pct:4 risk_change_pct:4",
     f"""WITH p AS (SELECT zone, operating_date AS day, hour_ending, y / 1000 AS da, y / 1000 + spread - 5 AS rt FROM daily),
         l AS (SELECT zone, avg(y) AS load FROM daily GROUP BY 1),
         r AS (SELECT run, (y - p50) * 1000.0 / load AS m, y * 1000.0 / load AS pl, rt - da AS s FROM ({_FILLED}) JOIN p USING (zone, day, hour_ending) JOIN l USING (zone))
         SELECT run, count(*) AS zone_hours, sum(abs(m)) AS mwh_model, sum(abs(pl)) AS mwh_plain, sum(m * s) AS cost_model, sum(pl * s) AS cost_plain,
                sum(abs(m) * abs(s)) AS risk_model, sum(abs(pl) * abs(s)) AS risk_plain, 100 * (sum(abs(m)) / sum(abs(pl)) - 1) AS mwh_change_pct,
                100 * (sum(abs(m) * abs(s)) / sum(abs(pl) * abs(s)) - 1) AS risk_change_pct FROM r GROUP BY 1""")
def _(v):
    da = F.col("y") / 1000
    prices = v.daily.select("zone", F.col("operating_date").alias("day"), "hour_ending", da.alias("da"),
                            (da + F.col("spread") - 5).alias("rt"))
    loads = v.daily.groupBy("zone").agg(F.avg("y").alias("load"))
    return R.imbalance(E.with_fallback(v.quant), prices, loads)
