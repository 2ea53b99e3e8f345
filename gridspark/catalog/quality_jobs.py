"""Registered data-quality, completeness, guard, reshape and dedup jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridspark.catalog.registry import job
from gridspark.catalog.views import sql_cutoff, sql_hours
from gridspark.functions import timeconv as T
from gridspark.operators import intervals, quality, reshape


@job("d01_table_profile", "table_name n_rows:l entities:l first_start:t last_start:t first_day:d last_day:d",
     " UNION ALL ".join(
         f"""SELECT '{t}' AS table_name, count(*) AS n_rows, {f"count(DISTINCT {e})" if e else "1"} AS entities, min(start_utc) AS first_start,
             max(start_utc) AS last_start, min(operating_date) AS first_day, max(operating_date) AS last_day FROM {t}"""
         for t, e in (("iv15", "point"), ("iv60", "point"), ("load60", None), ("fuel15", "fuel"), ("ship15", "point"))))
def _(v):
    return reshape.stack_all([quality.table_profile(v.iv15, "point", "iv15"), quality.table_profile(v.iv60, "point", "iv60"),
                              quality.table_profile(v.load60, None, "load60"), quality.table_profile(v.fuel15, "fuel", "fuel15"),
                              quality.table_profile(v.ship15, "point", "ship15")])


@job("d02_rows_per_month", "month n_rows:l", "SELECT month, count(*) AS n_rows FROM ship15 GROUP BY 1")
def _(v):
    return quality.rows_per_month(v.ship15)


_RAW = "SELECT event_type AS point, time_bucket(INTERVAL '15 minutes', ts) AS start_utc FROM events"


def _raw(v):
    return v.events.select(F.col("event_type").alias("point"), T.floor_minutes("ts", 15).alias("start_utc"), "value")


@job("d03_duplicate_keys", "point start_utc:t copies:l",
     f"SELECT point, start_utc, count(*) AS copies FROM ({_RAW}) GROUP BY ALL HAVING count(*) > 1")
def _(v):
    return quality.duplicate_keys(_raw(v), ["point", "start_utc"])


_GAPS = """SELECT * FROM (SELECT point, lag(start_utc) OVER (PARTITION BY point ORDER BY start_utc) AS gap_from, start_utc AS gap_to,
    date_diff('minute', gap_from, start_utc) AS gap_minutes FROM {t}) WHERE gap_minutes > 15"""


@job("d04_gaps", "point gap_from:t gap_to:t gap_minutes:l", _GAPS.format(t="iv15"))
def _(v):
    return intervals.gaps(v.iv15, ["point"], "start_utc", 15)


@job("w01_gaps_long_history", "point gap_from:t gap_to:t gap_minutes:l", _GAPS.format(t="ship15"))
def _(v):
    return intervals.gaps(v.ship15, ["point"], "start_utc", 15)


@job("d04_largest_gaps", "point gap_from:t gap_to:t gap_minutes:l",
     _GAPS.format(t="iv15") + " ORDER BY gap_minutes DESC, point, gap_from LIMIT 5")
def _(v):
    return quality.gap_report(v.iv15, ["point"], 15)[1]


@job("d04_gap_count", "gaps:l", f"SELECT count(*) AS gaps FROM ({_GAPS.format(t='iv15')})")
def _(v):
    return quality.gap_report(v.iv15, ["point"], 15)[0]


_D5 = f"""SELECT operating_date, count(*) / (SELECT count(DISTINCT point) FROM ship15) AS per_entity,
    sum(repeated_hour::INT) / (SELECT count(DISTINCT point) FROM ship15) AS repeated_per_entity,
    {sql_hours('operating_date')} * 4 AS expected FROM ship15 WHERE {sql_hours('operating_date')} <> 24 GROUP BY 1"""


@job("d05_change_day_counts", "operating_date:d per_entity:6 repeated_per_entity:6 expected:i", _D5)
def _(v):
    return quality.change_day_counts(v.ship15, "point", 4)


_NULLS = """SELECT column_name, null_rate FROM (SELECT avg((zone IS NULL)::INT) AS zone, avg((start_utc IS NULL)::INT) AS start_utc,
    avg((publish_time IS NULL)::INT) AS publish_time, avg((forecast IS NULL)::INT) AS forecast FROM publications)
    UNPIVOT (null_rate FOR column_name IN (zone, start_utc, publish_time, forecast))"""


@job("d06_null_rates", "column_name null_rate:6", _NULLS)
def _(v):
    return quality.null_rates(v.publications, ["zone", "start_utc", "publish_time", "forecast"])


@job("d07_issues", "table_name rule detail amount:6",
     f"""SELECT 'ship15' AS table_name, 'gaps' AS rule, '' AS detail, count(*) AS amount FROM ({_GAPS.format(t='ship15')})
         UNION ALL SELECT 'ship15', 'change day', strftime(operating_date, '%Y-%m-%d'), per_entity FROM ({_D5}) WHERE per_entity <> expected
         UNION ALL SELECT 'publications', 'nulls', column_name, null_rate FROM ({_NULLS}) WHERE null_rate > 0.001
         UNION ALL SELECT 'raw', 'duplicate keys', '', count(*) FROM (SELECT point, start_utc FROM ({_RAW}) GROUP BY ALL HAVING count(*) > 1)""")
def _(v):
    nulls = (quality.null_rates(v.publications, ["zone", "start_utc", "publish_time", "forecast"]).filter("null_rate > 0.001")
             .select(F.lit("publications").alias("table_name"), F.lit("nulls").alias("rule"),
                     F.col("column_name").alias("detail"), F.col("null_rate").alias("amount")))
    dups = (quality.duplicate_keys(_raw(v), ["point", "start_utc"]).agg(F.count("*").cast("double").alias("amount"))
            .select(F.lit("raw").alias("table_name"), F.lit("duplicate keys").alias("rule"), F.lit("").alias("detail"), "amount"))
    return reshape.stack_all([quality.issues(v.ship15, "ship15", "point", 15), nulls, dups])


@job("d08_column_catalog", "table_name first_day:d last_day:d position:i column_name type_name",
     """SELECT 'daily' AS table_name, min(operating_date) AS first_day, max(operating_date) AS last_day, c.position, c.column_name, c.type_name
        FROM daily, (VALUES (0, 'zone', 'string'), (1, 'hour_ending', 'int'), (2, 'operating_date', 'date'), (3, 'y', 'double'),
             (4, 'quantity', 'double'), (5, 'spread', 'double'), (6, 'error', 'double')) c(position, column_name, type_name) GROUP BY ALL""")
def _(v):
    return quality.column_catalog(v.daily, "daily")


# ---------------------------------------------------------------- completeness
_C1 = "SELECT operating_date FROM {t} GROUP BY 1 HAVING count(*) = " + sql_hours("operating_date") + " * {k}{e}"
_IV60 = _C1.format(t="iv60", k=1, e=" * (SELECT count(DISTINCT point) FROM iv60)")
_LOAD = _C1.format(t="load60", k=1, e="")


@job("c01_complete_days", "table_name operating_date:d",
     f"SELECT 'load60' AS table_name, operating_date FROM ({_LOAD}) UNION ALL SELECT 'iv60', operating_date FROM ({_IV60})")
def _(v):
    return (quality.complete_days(v.load60, 1).withColumn("table_name", F.lit("load60"))
            .unionByName(quality.complete_days(v.iv60, 1, "point").withColumn("table_name", F.lit("iv60"))))


@job("c02_common_days", "operating_date:d",
     f"""SELECT operating_date FROM (SELECT operating_date FROM ({_LOAD}) INTERSECT SELECT operating_date FROM iv15)
         WHERE year(operating_date) IN (2024) AND {sql_hours('operating_date')} = 24""")
def _(v):
    return quality.common_days([quality.complete_days(v.load60, 1), v.iv15.select("operating_date")], [2024], "normal")


@job("c02_spring_days", "operating_date:d",
     f"SELECT DISTINCT operating_date FROM ship15 WHERE {sql_hours('operating_date')} = 23")
def _(v):
    return quality.common_days([v.ship15.select("operating_date").distinct()], kind="spring")


@job("c03_complete_months", "month",
     """SELECT strftime(operating_date, '%Y-%m') AS month FROM (SELECT DISTINCT operating_date FROM ship60)
        GROUP BY 1 HAVING count(*) = day(last_day(min(operating_date)))""")
def _(v):
    return quality.complete_months(v.ship60.select("operating_date").distinct())


@job("c04_entities", "point", "SELECT DISTINCT point FROM iv60 WHERE point LIKE 'p%'")
def _(v):
    return quality.entities(v.iv60, "point", "p")


# ---------------------------------------------------------------- guards
_V1 = f"""SELECT operating_date, vintage, publish_time, {sql_cutoff('operating_date')}
    - to_hours(CASE WHEN vintage = 'prev' THEN 24 ELSE 0 END) AS lim FROM vintage"""


@job("v01_vintage_leakage", "source known_at:t limit_at:t",
     f"SELECT 'vintage' AS source, publish_time AS known_at, lim AS limit_at FROM ({_V1}) WHERE NOT coalesce(publish_time < lim, false)")
def _(v):
    return quality.vintage_violations(v.vintage)


@job("v02_issue_leakage_null_is_bad", "source known_at:t limit_at:t",
     f"""SELECT 'weather' AS source, p AS known_at, lim AS limit_at FROM (
            SELECT CASE WHEN hour_ending <> 5 THEN publish_time END AS p, {sql_cutoff('operating_date')} AS lim FROM vintage)
         WHERE NOT coalesce(p < lim, false)""")
def _(v):
    issued = F.when(F.col("hour_ending") != 5, F.col("publish_time"))
    return quality.violations(v.vintage, "weather", issued, T.cutoff_utc("operating_date"), null_is_bad=True)


@job("v03_leakage_by_source", "source violations:l latest:t",
     f"""SELECT source, count(*) AS violations, max(p) AS latest FROM (
            SELECT vintage AS source, publish_time AS p, lim FROM ({_V1})
            UNION ALL SELECT 'late', CASE WHEN vintage = 'dam' THEN publish_time + INTERVAL 20 MINUTE END, lim FROM ({_V1}))
         WHERE p IS NOT NULL AND NOT p < lim GROUP BY 1""")
def _(v):
    limit = T.cutoff_utc("operating_date") - T.hours(F.when(F.col("vintage") == "prev", 24).otherwise(0))
    part = lambda name, rows, t: quality.violations(rows, name, t, limit, null_is_bad=False)
    late = F.when(F.col("vintage") == "dam", F.col("publish_time") + T.minutes(20))
    return quality.leakage_summary([part("dam", v.vintage.filter("vintage = 'dam'"), F.col("publish_time")),
                                    part("prev", v.vintage.filter("vintage = 'prev'"), F.col("publish_time")),
                                    part("late", v.vintage, late)])


@job("v04_split_overlaps", "pair a_hi:d b_lo:d",
     """WITH s AS (SELECT 'q' || l_linenumber AS label, min(l_shipdate) AS lo, max(l_shipdate) AS hi FROM lineitem GROUP BY 1)
        SELECT 'q1<q2' AS pair, a.hi AS a_hi, b.lo AS b_lo FROM s a, s b WHERE a.label = 'q1' AND b.label = 'q2' AND a.hi >= b.lo
        UNION ALL SELECT 'q2<q3', a.hi, b.lo FROM s a, s b WHERE a.label = 'q2' AND b.label = 'q3' AND a.hi >= b.lo""")
def _(v):
    rows = v.table("lineitem").select(F.concat(F.lit("q"), "l_linenumber").alias("label"), F.col("l_shipdate").alias("day"))
    return quality.split_overlaps(rows, "label", "day", ["q1", "q2", "q3"])


@job("v05_key_uniqueness", "operating_date:d hour_ending:i repeated_hour:b copies:l",
     """SELECT operating_date, hour_ending, repeated_hour, count(*) AS copies FROM ship60
        GROUP BY 1, 2, 3 HAVING count(*) > 1""")
def _(v):
    return quality.duplicate_keys(v.ship60, ["operating_date", "hour_ending", "repeated_hour"])


@job("v06_weight_sums", "zone weight_sum:6 points:l",
     """SELECT l_returnflag AS zone, sum(w) AS weight_sum, count(*) AS points FROM (
            SELECT l_returnflag, l_linestatus, count(*) / sum(count(*)) OVER (PARTITION BY l_returnflag) AS w FROM lineitem GROUP BY 1, 2) GROUP BY 1""")
def _(v):
    from pyspark.sql import Window
    n = v.table("lineitem").groupBy(F.col("l_returnflag").alias("zone"), "l_linestatus").agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("zone"))
    return quality.weight_sums(n.withColumn("weight", share))


# ---------------------------------------------------------------- reshapes and dedup
@job("p01_clip_range", "point start_utc:t start_local:t",
     """SELECT point, start_utc, start_local FROM iv15 WHERE start_local >= TIMESTAMP '2024-01-05' AND start_local < TIMESTAMP '2024-01-11'""")
def _(v):
    import datetime as dt
    return reshape.clip_range(v.iv15, dt.date(2024, 1, 5), dt.date(2024, 1, 10))


@job("p02_conform_columns", "settlement_point operating_date:d hour_ending:i price_usd:4",
     "SELECT point AS settlement_point, operating_date, hour_ending, price AS price_usd FROM iv60")
def _(v):
    renamed = v.iv60.withColumnsRenamed({"point": "settlement_point", "price": "price_usd"})
    return reshape.conform(renamed, {"settlement_point": "string", "operating_date": "date", "hour_ending": "smallint",
                                     "price_usd": "double"})


@job("p03_recode_types", "point kind price:4",
     "SELECT point, CASE point WHEN 'view' THEN 'hub' WHEN 'click' THEN 'load_zone' END AS kind, price FROM iv60")
def _(v):
    return v.iv60.select("point", reshape.recode("point", {"view": "hub", "click": "load_zone"}).alias("kind"), "price")


@job("p05_energy_to_power", "fuel start_utc:t energy:2 generation:2", "SELECT fuel, start_utc, energy, generation FROM fuel15")
def _(v):
    from gridspark.sources.normalize import energy_to_power
    return energy_to_power(v.fuel15.drop("generation"))


@job("p06_columns_to_rows", "operating_date:d hour_ending:i zone service amount:2",
     """SELECT operating_date, hour_ending, zone, CASE c WHEN 'y' THEN 'price' WHEN 'quantity' THEN 'volume' ELSE 'width' END AS service, amount
        FROM (SELECT operating_date, hour_ending, zone, y, quantity, spread FROM daily)
        UNPIVOT INCLUDE NULLS (amount FOR c IN (y, quantity, spread))""")
def _(v):
    return reshape.melt(v.daily, ["operating_date", "hour_ending", "zone"],
                        {"y": "price", "quantity": "volume", "spread": "width", "absent": "none"}, "service", "amount")


@job("p08_models_to_columns", "zone operating_date:d hour_ending:i m1:4 m2:4 m3:4",
     """SELECT zone, operating_date, hour_ending, avg(forecast) FILTER (WHERE model = 'm1') AS m1, avg(forecast) FILTER (WHERE model = 'm2') AS m2,
        avg(forecast) FILTER (WHERE model = 'm3') AS m3 FROM vintage WHERE vintage = 'dam' GROUP BY 1, 2, 3""")
def _(v):
    return reshape.models_to_columns(v.vintage.filter("vintage = 'dam'"), ["zone", "operating_date", "hour_ending"],
                                     ["m1", "m2", "m3"], "forecast")


@job("p10_keep_last", "user_id:l event_id:l ts:t event_type",
     "SELECT user_id, event_id, ts, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def _(v):
    return reshape.keep_last(v.events, ["user_id"], ["ts", "event_id"])


@job("p11_distinct_content", "doc_id:l lang",
     "SELECT min(doc_id) AS doc_id, min(lang) AS lang FROM documents GROUP BY md5(coalesce(lang, '') || '|' || coalesce(text, ''))")
def _(v):
    return reshape.distinct_content(v.table("documents"), ["lang", "text"], "doc_id")


_STATS = """SELECT zone, operating_date, hour_ending, count(f) AS n_models, min(f) AS v_min, max(f) AS v_max, avg(f) AS v_mean,
    stddev_samp(f) AS v_std, median(f) AS v_median FROM (
    SELECT zone, operating_date, hour_ending, model, avg(forecast) AS f FROM vintage WHERE vintage = 'dam' GROUP BY ALL) GROUP BY 1, 2, 3"""


@job("p12_model_stats_long", "zone operating_date:d hour_ending:i n_models:i v_min:4 v_max:4 v_mean:4 v_std:4 v_median:4", _STATS)
def _(v):
    return reshape.model_stats(v.vintage.filter("vintage = 'dam'"), ["zone", "operating_date", "hour_ending"], "forecast").withColumnsRenamed(
        {"fc_min": "v_min", "fc_max": "v_max", "fc_mean": "v_mean", "fc_std": "v_std", "fc_median": "v_median"})


@job("p12_row_stats_wide", "zone operating_date:d hour_ending:i n_models:i v_min:4 v_max:4 v_mean:4 v_std:4 v_median:4", _STATS)
def _(v):
    key = ["zone", "operating_date", "hour_ending"]
    wide = reshape.models_to_columns(v.vintage.filter("vintage = 'dam'"), key, ["m1", "m2", "m3"], "forecast")
    return wide.withColumns(reshape.row_stats(["m1", "m2", "m3"]))


@job("p13_predicate_forms", "event_id:l flagged:b",
     """SELECT event_id, value > 50 OR event_type = 'view' AS flagged FROM events WHERE value BETWEEN 10 AND 90 AND event_type IN ('view', 'click', 'error')
        AND NOT (user_id = 7) AND props LIKE '%k%' AND props NOT LIKE '%\\_%' ESCAPE '\\' AND event_type <> 'signup' AND ts IS NOT NULL AND value >= 11""")
def _(v):
    c = F.col
    return v.events.filter(
        c("value").between(10, 90) & c("event_type").isin("view", "click", "error") & ~(c("user_id") == 7)
        & c("props").like("%k%") & ~c("props").like("%\\_%") & (c("event_type") != "signup") & c("ts").isNotNull()
        & (c("value") >= 11)).select("event_id", ((c("value") > 50) | (c("event_type") == "view")).alias("flagged"))


@job("o03_union_all", "name_key:l kind", """SELECT n_nationkey AS name_key, 'nation' AS kind FROM nation UNION ALL
        SELECT s_suppkey, 'supplier' FROM supplier UNION ALL SELECT c_custkey, 'customer' FROM customer""")
def _(v):
    part = lambda t, k: v.table(t).select(F.col(k).cast("bigint").alias("name_key"), F.lit(t).alias("kind"))
    return reshape.stack_all([part("nation", "n_nationkey"), part("supplier", "s_suppkey"), part("customer", "c_custkey")])


@job("o05_except_days", "operating_date:d",
     "SELECT DISTINCT operating_date FROM iv60 EXCEPT SELECT operating_date FROM (" + _IV60 + ")")
def _(v):
    return v.iv60.select("operating_date").subtract(quality.complete_days(v.iv60, 1, "point"))


@job("o01_ordered_rows", "point start_utc:t price:4 truncated:b",
     """SELECT point, start_utc, price, (SELECT count(*) FROM iv60) > 1000 AS truncated FROM iv60 ORDER BY price DESC, start_utc, point LIMIT 1000""")
def _(v):
    from gridspark.operators.sampling import capped_rows
    return capped_rows(v.iv60, [F.desc("price"), F.asc("start_utc"), F.asc("point")], 1000)
