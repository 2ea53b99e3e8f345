"""Registered time and calendar jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridspark.catalog.price_jobs import SQL_BLOCK, SQL_HOLIDAY
from gridspark.catalog.registry import job
from gridspark.catalog.views import sql_cutoff, sql_hours, sql_local, sql_repeated, sql_utc
from gridspark.functions import timeconv as T
from gridspark.operators import asof, reshape
from gridspark.sources.posts import localize_post_times

LOCAL_STAMPS = """SELECT CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS doc_id, l_orderkey % 2 = 1 AS flag,
    l_shipdate + INTERVAL 23 YEAR + to_minutes(CAST((l_orderkey * 4 + l_linenumber) % 96 * 15 AS BIGINT)) AS post_local FROM lineitem"""


def _stamps(v):
    """Local wall times of seven years, some inside clock-change hours."""
    li = v.table("lineitem")
    slot = (F.col("l_orderkey") * 4 + F.col("l_linenumber")) % 96
    return li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("doc_id"),
                     (F.col("l_orderkey") % 2 == 1).alias("flag"),
                     (F.col("l_shipdate") + F.expr("INTERVAL '23' YEAR") + T.minutes(slot * 15)).alias("post_local"))


def _days(v, years: int = 25):
    day = F.to_date(F.col("l_shipdate") + F.make_ym_interval(F.lit(years)))
    return v.table("lineitem").select(day.alias("operating_date")).distinct()


DAYS = "SELECT DISTINCT CAST(l_shipdate + INTERVAL 25 YEAR AS DATE) AS operating_date FROM lineitem"


@job("t01_time_columns", "point start_utc:t end_utc:t start_local:t end_local:t operating_date:d hour_ending:i quarter:i repeated_hour:b",
     f"""SELECT *, start_utc + INTERVAL 15 MINUTE AS end_utc, {sql_local("(start_utc + INTERVAL 15 MINUTE)")} AS end_local FROM ship15""")
def _(v):
    return v.ship15


@job("t02_hour_ending_by_offset", "operating_date:d hour_ending:i repeated_hour:b starts:l",
     "SELECT operating_date, hour_ending, repeated_hour, count(DISTINCT start_utc) AS starts FROM ship60 GROUP BY 1, 2, 3")
def _(v):
    return (v.ship60.groupBy("operating_date", "hour_ending", "repeated_hour")
            .agg(F.count_distinct("start_utc").alias("starts")))


@job("t03_cutoff", "operating_date:d cutoff_utc:t", f"SELECT operating_date, {sql_cutoff('operating_date')} AS cutoff_utc FROM ({DAYS})")
def _(v):
    return _days(v).withColumn("cutoff_utc", T.cutoff_utc("operating_date"))


@job("t04_local_to_utc", "doc_id:l start_utc:t",
     f"""SELECT doc_id, CASE WHEN {sql_local('u')} <> post_local THEN date_trunc('hour', u)
                             WHEN NOT flag AND {sql_local("(u - INTERVAL 1 HOUR)")} = post_local THEN u - INTERVAL 1 HOUR ELSE u END AS start_utc
         FROM (SELECT *, {sql_utc('post_local')} AS u FROM ({LOCAL_STAMPS}))""")
def _(v):
    return _stamps(v).select("doc_id", T.local_to_utc("post_local", F.col("flag")).alias("start_utc"))


@job("t05_localize_posts", "doc_id:l post_time_utc:t",
     f"""SELECT doc_id, CASE WHEN {sql_local('u')} <> post_local THEN date_trunc('hour', u)
                WHEN {sql_local("(u - INTERVAL 1 HOUR)")} = post_local AND
                     row_number() OVER (PARTITION BY date_trunc('hour', post_local) ORDER BY doc_id) = 1
                THEN u - INTERVAL 1 HOUR ELSE u END AS post_time_utc
         FROM (SELECT *, {sql_utc('post_local')} AS u FROM ({LOCAL_STAMPS}))""")
def _(v):
    return localize_post_times(_stamps(v), "post_local", "doc_id")


@job("t06_hours_in_day", "operating_date:d hours:i change_day:b",
     f"SELECT operating_date, {sql_hours('operating_date')} AS hours, {sql_hours('operating_date')} <> 24 AS change_day FROM ({DAYS})")
def _(v):
    return _days(v).select("operating_date", T.hours_in_day("operating_date").alias("hours"),
                           T.is_change_day("operating_date").alias("change_day"))


@job("t07_month_bounds", "month first_day:d last_day:d label days:l",
     f"""SELECT strftime(operating_date, '%Y-%m') AS month, date_trunc('month', operating_date) AS first_day,
                last_day(operating_date) AS last_day, strftime(operating_date, '%B %Y') AS label, count(*) AS days
         FROM ({DAYS}) GROUP BY ALL""")
def _(v):
    d = F.col("operating_date")
    return (_days(v).groupBy(T.month_key(d).alias("month"), F.trunc(d, "MM").alias("first_day"),
                             F.last_day(d).alias("last_day"), T.month_label(d).alias("label"))
            .agg(F.count("*").alias("days")))


@job("t08_offpeak_holidays", "operating_date:d",
     f"SELECT operating_date FROM ({DAYS}) WHERE {SQL_HOLIDAY.format(d='operating_date')}")
def _(v):
    return _days(v).filter(T.is_offpeak_holiday("operating_date"))


@job("t09_block_hours", "block month hours:l",
     f"SELECT block, month, count(*) AS hours FROM (SELECT month, {SQL_BLOCK} AS block FROM ship60) GROUP BY 1, 2")
def _(v):
    return (v.ship60.groupBy(T.block_label("operating_date", "hour_ending").alias("block"), "month")
            .agg(F.count("*").alias("hours")))


_D = "operating_date"
SQL_FEDERAL = f"""(
   (month({_D}) = 1 AND day({_D}) = 1 AND isodow({_D}) <= 5) OR (month({_D}) = 1 AND day({_D}) = 2 AND isodow({_D}) = 1)
OR (month({_D}) = 12 AND day({_D}) = 31 AND isodow({_D}) = 5)
OR (month({_D}) = 1 AND isodow({_D}) = 1 AND day({_D}) BETWEEN 15 AND 21)
OR (month({_D}) = 2 AND isodow({_D}) = 1 AND day({_D}) BETWEEN 15 AND 21)
OR (month({_D}) = 5 AND isodow({_D}) = 1 AND day({_D}) >= 25)
OR (year({_D}) >= 2021 AND month({_D}) = 6 AND ((day({_D}) = 19 AND isodow({_D}) <= 5) OR (day({_D}) = 18 AND isodow({_D}) = 5) OR (day({_D}) = 20 AND isodow({_D}) = 1)))
OR (month({_D}) = 7 AND ((day({_D}) = 4 AND isodow({_D}) <= 5) OR (day({_D}) = 3 AND isodow({_D}) = 5) OR (day({_D}) = 5 AND isodow({_D}) = 1)))
OR (month({_D}) = 9 AND isodow({_D}) = 1 AND day({_D}) <= 7) OR (month({_D}) = 10 AND isodow({_D}) = 1 AND day({_D}) BETWEEN 8 AND 14)
OR (month({_D}) = 11 AND ((day({_D}) = 11 AND isodow({_D}) <= 5) OR (day({_D}) = 10 AND isodow({_D}) = 5) OR (day({_D}) = 12 AND isodow({_D}) = 1)))
OR (month({_D}) = 11 AND isodow({_D}) = 4 AND day({_D}) BETWEEN 22 AND 28)
OR (month({_D}) = 12 AND ((day({_D}) = 25 AND isodow({_D}) <= 5) OR (day({_D}) = 24 AND isodow({_D}) = 5) OR (day({_D}) = 26 AND isodow({_D}) = 1))))"""


@job("t10_calendar_features", "operating_date:d month_num:i dow:i is_holiday:b dst_change_day:b",
     f"""SELECT operating_date, month(operating_date) AS month_num, isodow(operating_date) - 1 AS dow, {SQL_FEDERAL} AS is_holiday,
                {sql_hours('operating_date')} <> 24 AS dst_change_day FROM ({DAYS})""")
def _(v):
    return T.add_calendar(_days(v))


_RUN = """CASE WHEN {step} = 1 OR (extract(hour FROM start_utc) % {step} = 0 AND extract(minute FROM start_utc) = 0) THEN start_utc
     ELSE time_bucket(INTERVAL '{step} hours', start_utc, TIMESTAMP '2000-01-01') + INTERVAL {step2} HOUR END"""
_BOUND = "time_bucket(INTERVAL '{cycle} hours', (" + _RUN + ") - INTERVAL 48 HOUR, TIMESTAMP '2000-01-01') + INTERVAL {lat} HOUR"


@job("t11_run_issue_bounds", "start_utc:t gfs_issued:t ecmwf_issued:t icon_issued:t gem_issued:t",
     "SELECT DISTINCT start_utc, " + ", ".join(
         _BOUND.format(step=s, step2=2 * s, cycle=c, lat=int(lat)) + f" AS {m}_issued"
         for m, c, s, lat in (("gfs", 6, 1, 8), ("ecmwf", 6, 3, 8), ("icon", 6, 1, 5), ("gem", 12, 3, 7))) + " FROM ship15")
def _(v):
    from gridspark.constants import WEATHER_MODELS
    return v.ship15.select("start_utc").distinct().withColumns(
        {f"{m}_issued": T.issued_bound("start_utc", c, s, lat) for m, c, s, lat in WEATHER_MODELS})


@job("t12_resolve_day_stamp", "ws:t we:t dd:i hh:i mm:i resolved:t",
     """WITH x AS (SELECT *, row_number() OVER () AS id FROM (
            SELECT DISTINCT 1 + l_partkey % 31 AS dd, l_suppkey % 24 AS hh, l_orderkey % 60 AS mm, l_shipdate AS ws,
                   l_shipdate + to_days(CAST(1 + l_linenumber * 4 AS INTEGER)) AS we FROM lineitem)),
        m AS (SELECT DISTINCT x.*, date_trunc('month', a) + to_months(k) AS mo
              FROM x, (VALUES (-1), (0), (1)) k(k), LATERAL (SELECT unnest([ws, we - INTERVAL 1 SECOND]) AS a)),
        c AS (SELECT id, ws, we, make_timestamp(CAST(year(mo) AS BIGINT), CAST(month(mo) AS BIGINT), dd, hh, mm, 0.0) AS t
              FROM m WHERE dd <= day(last_day(mo))),
        d AS (SELECT *, CASE WHEN t < ws THEN epoch(ws) - epoch(t) WHEN t >= we THEN epoch(t) - epoch(we) ELSE 0 END AS dist FROM c)
        SELECT ws, we, dd, hh, mm, b.t AS resolved FROM x LEFT JOIN (
            SELECT id, t, dist FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY dist, t) = 1) b ON b.id = x.id AND b.dist <= 3 * 86400""")
def _(v):
    li = v.table("lineitem")
    x = li.select((1 + F.col("l_partkey") % 31).alias("dd"), (F.col("l_suppkey") % 24).alias("hh"),
                  (F.col("l_orderkey") % 60).alias("mm"), F.col("l_shipdate").alias("ws"),
                  (F.col("l_shipdate") + T.hours(24 * (1 + F.col("l_linenumber") * 4))).alias("we")).distinct()
    return x.withColumn("resolved", T.resolve_day_stamp(F.col("dd"), F.col("hh"), F.col("mm"), F.col("ws"), F.col("we")))


@job("t13_time_splits", "operating_date:d split year_split",
     f"""SELECT operating_date, CASE WHEN operating_date BETWEEN DATE '2023-01-01' AND DATE '2025-08-31' THEN 'train'
                WHEN operating_date BETWEEN DATE '2025-09-08' AND DATE '2026-02-28' THEN 'val'
                WHEN operating_date BETWEEN DATE '2026-03-08' AND DATE '2026-08-31' THEN 'test' END AS split,
                CASE WHEN year(operating_date) IN (2023, 2024) THEN 'train' WHEN year(operating_date) > 2024 THEN 'test_in_template' END AS year_split
         FROM ({DAYS})""")
def _(v):
    return _days(v).select("operating_date", T.split_label("operating_date").alias("split"),
                           T.year_split("operating_date", [2023, 2024]).alias("year_split"))


# ---------------------------------------------------------------- as-of and other joins
_J1 = f"""WITH d AS ({DAYS.replace('l_shipdate + INTERVAL 25 YEAR', "ts + INTERVAL 3 DAY").replace('lineitem', 'events')}),
    t AS (SELECT operating_date, vintage, {sql_cutoff('operating_date')} AS cutoff_utc,
                 {sql_cutoff('operating_date')} - to_hours(CASE vintage WHEN 'prev' THEN 24 ELSE 0 END) AS target_utc
          FROM d, (VALUES ('dam'), ('prev')) v(vintage))
    SELECT operating_date, vintage, cutoff_utc, target_utc, p.doc_id, p.post_time_utc FROM t ASOF JOIN (
        SELECT post_time_utc, max(doc_id) AS doc_id FROM posts GROUP BY 1) p ON p.post_time_utc < t.target_utc
    WHERE target_utc - p.post_time_utc <= INTERVAL 6 DAY"""


def _event_days(v):
    return v.events.select(F.to_date(F.col("ts") + F.expr("INTERVAL '3' DAY")).alias("operating_date")).distinct()


@job("j01_asof_vintages", "operating_date:d vintage cutoff_utc:t target_utc:t doc_id:l post_time_utc:t", _J1)
def _(v):
    return asof.select_vintages(v.posts, _event_days(v))


@job("f09_vintage_age", "median_hours:4 max_hours:4 over_limit:l",
     f"""SELECT quantile_cont(age, 0.5) AS median_hours, max(age) AS max_hours, count(*) FILTER (WHERE age > 0.1) AS over_limit
         FROM (SELECT (epoch_us(cutoff_utc) - epoch_us(post_time_utc)) / 3.6e9 AS age FROM ({_J1}) WHERE vintage = 'dam')""")
def _(v):
    from gridspark.plans.features import vintage_age
    return vintage_age(asof.select_vintages(v.posts, _event_days(v)), limit_hours=0.1)


@job("j02_latest_publication", "zone start_utc:t publish_time:t forecast:4",
     f"""SELECT zone, start_utc, publish_time, forecast FROM (
            SELECT *, {sql_utc(f"CAST(CAST({sql_local('start_utc')} AS DATE) - 1 AS TIMESTAMP) + INTERVAL 10 HOUR")} AS cut FROM publications WHERE forecast IS NOT NULL)
         WHERE publish_time <= cut AND publish_time > cut - INTERVAL 24 HOUR
         QUALIFY row_number() OVER (PARTITION BY zone, start_utc ORDER BY publish_time DESC) = 1""")
def _(v):
    return asof.latest_publication(v.publications, "forecast", ["zone"])


_OFFICES = "('z0', 'src0'), ('z1', 'src1'), ('z2', 'src7'), ('system_total', 'src3'), ('system_total', 'src4'), ('system_total', 'src5')"


@job("j03_asof_bulletins", "zone office operating_date:d doc_id:l issued_utc:t",
     f"""WITH zd AS (SELECT DISTINCT z.zone, z.office, CAST(issued_utc + INTERVAL 1 DAY AS DATE) AS operating_date
                     FROM bulletins, (VALUES {_OFFICES}) z(zone, office)),
         b AS (SELECT office, issued_utc, doc_id FROM bulletins WHERE length(trim(text)) > 0
               QUALIFY row_number() OVER (PARTITION BY office, issued_utc ORDER BY doc_id DESC) = 1)
         SELECT zd.zone, zd.office, operating_date, b.doc_id, b.issued_utc FROM
            (SELECT *, {sql_cutoff('operating_date')} - INTERVAL 5 MINUTE AS lim FROM zd) zd ASOF JOIN b
            ON zd.office = b.office AND b.issued_utc < zd.lim""")
def _(v):
    from gridspark.plans.bulletins import bulletins_for_days
    days = v.bulletins.select(F.to_date(F.col("issued_utc") + F.expr("INTERVAL '1' DAY")).alias("operating_date")).distinct()
    zones = {"z0": ["src0"], "z1": ["src1"], "z2": ["src7"], "system_total": ["src3", "src4", "src5"]}
    offices = F.explode(F.array(*[F.struct(F.lit(z).alias("zone"), F.lit(o).alias("office")) for z, os in zones.items() for o in os]))
    zone_days = days.select("operating_date", offices.alias("o")).select("o.zone", "o.office", "operating_date")
    return bulletins_for_days(zone_days, v.bulletins.withColumnRenamed("text", "reasoning_text"), keep=["doc_id"])


@job("j04_latest_before_instant", "vec_id:l office asked:t doc_id:l issued_utc:t",
     """WITH q AS (SELECT event_id AS vec_id, 'src' || (event_id % 20) AS office, ts AS asked FROM events),
        b AS (SELECT office, issued_utc, max(doc_id) AS doc_id FROM bulletins GROUP BY 1, 2)
        SELECT q.*, b.doc_id, b.issued_utc FROM q ASOF LEFT JOIN b ON q.office = b.office AND b.issued_utc < q.asked""")
def _(v):
    q = v.events.select(F.col("event_id").alias("vec_id"), F.concat(F.lit("src"), F.col("event_id") % 20).alias("office"),
                        F.col("ts").alias("asked"))
    return asof.asof_join(q, v.bulletins, ["office"], "asked", "issued_utc", ["doc_id"], strict=True, tie=["doc_id"])


@job("j04_latest_within_age", "vec_id:l point asked:t start_utc:t price:4",
     """WITH q AS (SELECT event_id AS vec_id, event_type AS point, ts AS asked FROM events)
        SELECT q.*, CASE WHEN b.start_utc >= q.asked - INTERVAL 10 MINUTE THEN b.start_utc END AS start_utc,
               CASE WHEN b.start_utc >= q.asked - INTERVAL 10 MINUTE THEN b.price END AS price
        FROM q ASOF LEFT JOIN iv15 b ON q.point = b.point AND b.start_utc <= q.asked""")
def _(v):
    q = v.events.select(F.col("event_id").alias("vec_id"), F.col("event_type").alias("point"), F.col("ts").alias("asked"))
    return asof.asof_join(q, v.iv15, ["point"], "asked", "start_utc", ["price"], max_age_minutes=10)


@job("j06_forecast_actual_join", "zone operating_date:d hour_ending:i forecast:4 actual_mw:4 error:4",
     """SELECT f.zone, f.operating_date, f.hour_ending, f.forecast, a.price AS actual_mw, a.price - f.forecast AS error
        FROM vintage f JOIN iv60 a ON a.point = f.zone AND a.operating_date = f.operating_date AND a.hour_ending = f.hour_ending
        WHERE f.vintage = 'dam' AND f.in_use""")
def _(v):
    from gridspark.plans.features import label_errors
    fc = v.vintage.filter("vintage = 'dam' AND in_use").select("zone", "operating_date", "hour_ending", F.col("forecast").alias("fc_inuse"))
    act = v.iv60.select(F.col("point").alias("zone"), "operating_date", "hour_ending", F.col("price").alias("actual_mw"))
    return label_errors(fc, act).withColumnRenamed("fc_inuse", "forecast")


@job("j08_models_full_outer", "zone start_utc:t m1:4 m2:4",
     """SELECT coalesce(a.zone, b.zone) AS zone, coalesce(a.start_utc, b.start_utc) AS start_utc, a.p AS m1, b.p AS m2
        FROM (SELECT point AS zone, start_utc, price AS p FROM iv60) a FULL OUTER JOIN
             (SELECT point AS zone, start_utc + INTERVAL 30 HOUR AS start_utc, price AS p FROM iv60) b
        ON a.zone = b.zone AND a.start_utc = b.start_utc""")
def _(v):
    base = v.iv60.select(F.col("point").alias("zone"), "start_utc", "price")
    long = base.withColumn("model", F.lit("m1")).unionByName(
        base.withColumns({"start_utc": F.col("start_utc") + T.hours(30), "model": F.lit("m2")}))
    return reshape.models_to_columns(long, ["zone", "start_utc"], ["m1", "m2"], "price")


@job("j11_later_hour_pairs", "point operating_date:d best_gain:4",
     """SELECT c.point, c.operating_date, max(d.price - c.price) AS best_gain FROM iv15 c JOIN iv15 d
        ON d.point = c.point AND d.operating_date = c.operating_date AND d.start_utc > c.start_utc GROUP BY 1, 2""")
def _(v):
    from gridspark.plans.storage import DAY
    from pyspark.sql import Window
    w = Window.partitionBy(*DAY).orderBy("start_utc").rowsBetween(Window.unboundedPreceding, -1)
    gain = F.col("price") - F.min("price").over(w)
    return v.iv15.select(*DAY, gain.alias("_g")).groupBy(*DAY).agg(F.max("_g").alias("best_gain")).filter("best_gain IS NOT NULL")


@job("j14_never_solved", "task_id",
     "SELECT DISTINCT task_id FROM samples WHERE task_id NOT IN (SELECT task_id FROM samples WHERE outcome = 'correct')")
def _(v):
    s = v.samples
    return s.select("task_id").distinct().join(s.filter("outcome = 'correct'"), "task_id", "left_anti")
