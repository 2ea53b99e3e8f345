"""Registered price queries (one per question template), each with the SQL it must agree with."""

from __future__ import annotations

from gridspark.catalog.registry import job
from gridspark.catalog.views import sql_hours, sql_local
from gridspark.constants import EFFICIENCIES, NET_LOAD_QUANTILES, PRICE_THRESHOLDS, SPIKE_MIN_LENGTHS, SPIKE_THRESHOLDS
from gridspark.plans import conditional as C
from gridspark.plans import prices as P
from gridspark.plans import storage as S

PAIRS = [("click", "view"), ("purchase", "signup"), ("error", "view"), ("signup", "click")]
SCHEDULES = [S.Schedule("night_evening", 10, 0.85, (2, 5), (18, 21)), S.Schedule("midday_peak", 1, 0.9, (11, 12), (19, 20)),
             S.Schedule("one_hour", 100, 1.0, (4, 4), (17, 17)), S.Schedule("three_hour", 20, 0.88, (12, 14), (16, 18))]

_pairs = ", ".join(f"('{a}', '{b}')" for a, b in PAIRS)
_thresholds = ", ".join(f"({x})" for x in PRICE_THRESHOLDS)
_effs = ", ".join(f"({e})" for e in EFFICIENCIES)
_schedules = ", ".join(f"('{s.name}', {s.mw}, {s.eff}, {s.charge[0]}, {s.charge[1]}, {s.discharge[0]}, {s.discharge[1]})"
                       for s in SCHEDULES)


# ---------------------------------------------------------------- basic aggregates
@job("q01_rt_avg_day", "point operating_date:d avg_price:6",
     "SELECT point, operating_date, avg(price) AS avg_price FROM iv15 GROUP BY 1, 2")
def _(v):
    return P.period_average(v.iv15, P.DAY)


@job("q02_da_max_month", "point month max_price:6", "SELECT point, month, max(price) AS max_price FROM iv60 GROUP BY 1, 2")
def _(v):
    return P.period_max(v.iv60)


@job("q03_rt_min_month", "point month min_price:6", "SELECT point, month, min(price) AS min_price FROM iv15 GROUP BY 1, 2")
def _(v):
    return P.period_min(v.iv15)


@job("q04_as_avg_month", "zone month avg_price:4",
     "SELECT zone, strftime(operating_date, '%Y-%m') AS month, avg(y) AS avg_price FROM daily GROUP BY 1, 2")
def _(v):
    from gridspark.functions.timeconv import month_key
    return P.period_average(v.daily.withColumn("month", month_key("operating_date")), ["zone", "month"], "y")


@job("q05_rt_avg_cents_kwh_month", "point month avg_price:6",
     "SELECT point, month, avg(price) / 10 AS avg_price FROM iv15 GROUP BY 1, 2")
def _(v):
    return P.period_average(v.iv15, P.MONTH, scale=10.0)


# ---------------------------------------------------------------- time conventions
@job("q06_da_price_he", "point operating_date:d hour_ending:i price:4",
     f"SELECT point, operating_date, hour_ending, price FROM ship60 WHERE {sql_hours('operating_date')} = 24")
def _(v):
    return P.price_by_hour_ending(v.ship60)


@job("q07_rt_price_utc_interval", "point start_utc:t price:4", "SELECT point, start_utc, price FROM iv15")
def _(v):
    return P.price_by_utc_start(v.iv15)


@job("q08_rt_hour_avg_he", "point operating_date:d hour_ending:i avg_price:6",
     f"""SELECT point, operating_date, hour_ending, avg(price) AS avg_price FROM iv15
         WHERE {sql_hours('operating_date')} = 24 GROUP BY 1, 2, 3""")
def _(v):
    return P.hourly_average_by_label(v.iv15)


@job("q09_dst_repeated_hour_da", "point operating_date:d occurrence price:4",
     f"""SELECT point, operating_date, CASE WHEN repeated_hour THEN 'second' ELSE 'first' END AS occurrence, price
         FROM ship60 WHERE hour_ending = 2 AND {sql_hours('operating_date')} = 25""")
def _(v):
    return P.repeated_hour_prices(v.ship60)


@job("q10_interval_count_day", "point operating_date:d intervals:l expected:l",
     f"""SELECT point, operating_date, count(*) AS intervals, {sql_hours('operating_date')} * 4 AS expected
         FROM ship15 GROUP BY 1, 2""")
def _(v):
    return P.interval_counts(v.ship15)


@job("q11_peak_rt_utc", "point operating_date:d start_utc:t",
     """SELECT point, operating_date, start_utc FROM iv15
        QUALIFY row_number() OVER (PARTITION BY point, operating_date ORDER BY price DESC, start_utc) = 1""")
def _(v):
    return P.peak_interval_utc(v.iv15)


@job("q12_da_daily_avg_dst_day", "point operating_date:d hours:l avg_price:6",
     f"""SELECT point, operating_date, count(*) AS hours, avg(price) AS avg_price FROM ship60
         WHERE {sql_hours('operating_date')} <> 24 GROUP BY 1, 2""")
def _(v):
    return P.change_day_average(v.ship60, require_complete=False)


@job("q12_da_daily_avg_complete_dst_day", "point operating_date:d avg_price:6",
     f"""SELECT 'all' AS point, operating_date, avg(p) AS avg_price
         FROM (SELECT operating_date, start_utc, avg(price) AS p FROM ship60 GROUP BY 1, 2)
         WHERE {sql_hours('operating_date')} <> 24 GROUP BY operating_date
         HAVING count(*) = {sql_hours('operating_date')}""")
def _(v):
    from pyspark.sql import functions as F
    system = (v.ship60.groupBy("operating_date", "start_utc").agg(F.avg("price").alias("price"))
              .withColumn("point", F.lit("all")))
    return P.change_day_average(system)


# ---------------------------------------------------------------- spreads
@job("q13_da_rt_spread_day", "point operating_date:d spread:6",
     """SELECT point, operating_date, a - b AS spread
        FROM (SELECT point, operating_date, avg(price) AS a FROM iv60 GROUP BY 1, 2)
        JOIN (SELECT point, operating_date, avg(price) AS b FROM iv15 GROUP BY 1, 2) USING (point, operating_date)""")
def _(v):
    return P.market_spread_day(v.iv60, v.iv15)


@job("q14_hub_lz_basis_month", "month point_a point_b basis:6",
     f"""SELECT month, point_a, point_b, avg(price) FILTER (WHERE point = point_a)
              - avg(price) FILTER (WHERE point = point_b) AS basis
         FROM iv15, (VALUES {_pairs}) p(point_a, point_b) GROUP BY 1, 2, 3 HAVING basis IS NOT NULL""")
def _(v):
    return P.basis_month(v.iv15, PAIRS)


_TOP2 = """SELECT * FROM (
    SELECT *, row_number() OVER w AS rn, lead({v}) OVER w AS runner_up FROM ({src})
    WHERE {v} IS NOT NULL WINDOW w AS (PARTITION BY {keys} ORDER BY {v} DESC, {tie})) WHERE rn = 1 AND {v} - runner_up >= {eps}"""


@job("q15_highest_avg_lz_month", "month point avg_price:6",
     _TOP2.format(v="avg_price", keys="month", tie="point", eps=0.005,
                  src="SELECT month, point, avg(price) AS avg_price FROM iv60 GROUP BY 1, 2"))
def _(v):
    return P.highest_average_point(v.iv60)


@job("q16_max_hourly_da_rt_gap_he", "point operating_date:d hour_ending:i",
     _TOP2.format(v="gap", keys="point, operating_date", tie="hour_ending", eps=0.01, src=f"""
        SELECT d.point, d.operating_date, d.hour_ending, abs(d.price - r.p) AS gap FROM iv60 d
        JOIN (SELECT point, operating_date, hour_ending, avg(price) AS p FROM iv15 GROUP BY 1, 2, 3) r
        USING (point, operating_date, hour_ending) WHERE {sql_hours('operating_date')} = 24"""))
def _(v):
    return P.largest_market_gap_hour(v.iv60, v.iv15)


@job("q17_hub_spread_max_day", "point_a point_b month operating_date:d",
     _TOP2.format(v="s", keys="point_a, point_b, month", tie="operating_date", eps=0.01, src=f"""
        SELECT point_a, point_b, month, operating_date, avg(price) FILTER (WHERE point = point_a)
             - avg(price) FILTER (WHERE point = point_b) AS s
        FROM iv15, (VALUES {_pairs}) p(point_a, point_b) GROUP BY 1, 2, 3, 4"""))
def _(v):
    return P.widest_spread_day(v.iv15, PAIRS)


# ---------------------------------------------------------------- conditional
_NET = """SELECT l.start_utc, l.month, l.total - g.w - g.s AS net FROM load60 l JOIN (
    SELECT date_trunc('hour', start_utc) AS h, avg(generation) FILTER (WHERE fuel = 'view') AS w,
           avg(generation) FILTER (WHERE fuel = 'click') AS s FROM fuel15 GROUP BY 1) g ON g.h = l.start_utc
    WHERE g.w IS NOT NULL AND g.s IS NOT NULL"""


def _net(v):
    return C.net_load(v.load60, v.fuel15, wind="view", solar="click").filter("net_load IS NOT NULL")


@job("q18_rt_avg_high_netload_month", "point month q:2 threshold:2 avg_price:6",
     f"""WITH net AS ({_NET}), q AS ({" UNION ALL ".join(f"SELECT month, {q} AS q, floor(quantile_cont(net, {q}) / 10) * 10 AS x FROM net GROUP BY 1" for q in NET_LOAD_QUANTILES)})
         SELECT r.point, n.month, q.q, max(q.x) AS threshold, avg(r.price) AS avg_price
         FROM iv15 r JOIN net n ON date_trunc('hour', r.start_utc) = n.start_utc JOIN q ON q.month = n.month
         WHERE n.net > q.x GROUP BY 1, 2, 3""")
def _(v):
    return C.price_in_high_net_load(v.iv15, _net(v), NET_LOAD_QUANTILES, 10)


@job("q19_solar_share_max_day", "month fuel operating_date:d",
     _TOP2.format(v="s", keys="month, fuel", tie="operating_date", eps=1e-4, src="""
        SELECT month, f AS fuel, operating_date, sum(energy) FILTER (WHERE fuel = f) / sum(energy) FILTER (WHERE fuel <> 'error') AS s
        FROM fuel15, (VALUES ('view'), ('click')) x(f) GROUP BY 1, 2, 3"""))
def _(v):
    return C.fuel_share_peak_day(v.fuel15, ["view", "click"], excluded="error")


@job("q20_wind_avg_negative_rt", "point month intervals:l avg_generation:4",
     """SELECT r.point, r.month, count(*) AS intervals, avg(f.generation) AS avg_generation FROM iv15 r
        JOIN fuel15 f ON f.start_utc = r.start_utc AND f.fuel = 'view' WHERE r.price < 0 GROUP BY 1, 2 HAVING count(*) >= 4""")
def _(v):
    return C.generation_when_negative(v.iv15, v.fuel15, "view")


@job("q21_da_avg_high_load_hours", "point month quantile:2 avg_price:6",
     """WITH x AS (SELECT month, q, floor(CASE q WHEN 0.5 THEN quantile_cont(total, 0.5) WHEN 0.8 THEN quantile_cont(total, 0.8)
                          ELSE quantile_cont(total, 0.95) END / 10) * 10 AS lim
                   FROM load60, (VALUES (0.5), (0.8), (0.95)) v(q) GROUP BY 1, 2)
        SELECT d.point, d.month, x.q AS quantile, avg(d.price) AS avg_price
        FROM iv60 d JOIN load60 l USING (start_utc) JOIN x ON x.month = l.month
        WHERE l.total > x.lim GROUP BY 1, 2, 3""")
def _(v):
    return C.price_in_high_load(v.iv60, v.load60, [0.5, 0.8, 0.95], 10)


@job("q22_gas_gen_at_peak_price", "point month start_utc:t generation:2",
     """WITH pk AS (SELECT point, month, start_utc FROM iv15
                    QUALIFY row_number() OVER (PARTITION BY point, month ORDER BY price DESC, start_utc) = 1)
        SELECT pk.point, pk.month, start_utc, sum(f.generation) AS generation FROM fuel15 f JOIN pk USING (start_utc)
        WHERE f.fuel IN ('view', 'purchase', 'error') GROUP BY 1, 2, 3""")
def _(v):
    return C.generation_at_peak(v.iv15, v.fuel15, ["view", "purchase", "error"])


# ---------------------------------------------------------------- events
@job("q23_count_rt_above_month", "point month threshold:1 intervals:l",
     f"""SELECT point, month, x AS threshold, count(*) AS intervals FROM iv15, (VALUES {_thresholds}) t(x)
         WHERE price > x GROUP BY 1, 2, 3""")
def _(v):
    return P.counts_above(v.iv15)


@job("q24_count_da_negative_month", "point month hours:l",
     "SELECT point, month, count(*) AS hours FROM iv60 WHERE price < 0 GROUP BY 1, 2")
def _(v):
    return P.negative_hours(v.iv60)


@job("q25_longest_run_above", "point month threshold:1 longest:l",
     f"""WITH x AS (SELECT point, month, t, price >= t AS hi,
                row_number() OVER (PARTITION BY point, month, t ORDER BY start_utc)
              - row_number() OVER (PARTITION BY point, month, t, price >= t ORDER BY start_utc) AS grp
              FROM iv15, (VALUES {", ".join(f"({x})" for x in PRICE_THRESHOLDS[:6])}) v(t))
         SELECT point, month, t AS threshold, max(c) AS longest
         FROM (SELECT point, month, t, grp, count(*) AS c FROM x WHERE hi GROUP BY ALL) GROUP BY 1, 2, 3""")
def _(v):
    return P.longest_run_month(v.iv15)


@job("q26_peak_rt_local_month", "point month start_local:t",
     f"""SELECT point, month, start_local FROM (SELECT * FROM ship15
            QUALIFY row_number() OVER (PARTITION BY point, month ORDER BY price DESC, start_utc) = 1)
         WHERE NOT (hour_ending = 2 AND {sql_hours('operating_date')} = 25)""")
def _(v):
    return P.peak_local_time(v.ship15)


@job("q27_days_rt_exceeded_list", "point month threshold:1 days:a",
     f"""SELECT point, month, x AS threshold, list(DISTINCT d ORDER BY d) AS days FROM (
            SELECT point, month, strftime(operating_date, '%Y-%m-%d') AS d, x FROM iv15, (VALUES {_thresholds}) t(x)
            WHERE price > x AND x >= 75) GROUP BY 1, 2, 3""")
def _(v):
    return P.days_exceeding(v.iv15)


@job("q27_days_short_threshold", "point month threshold:1 days:a",
     """SELECT point, month, 65.0 AS threshold, list(DISTINCT d ORDER BY d) AS days FROM (
            SELECT point, month, strftime(operating_date, '%Y-%m-%d') AS d FROM iv15 WHERE price > 65)
        GROUP BY 1, 2""")
def _(v):
    return P.days_exceeding(v.iv15, [65.0])


# ---------------------------------------------------------------- forecast error
@job("q28_renewable_fc_mae_day", "zone operating_date:d mae:6",
     "SELECT zone, operating_date, avg(abs(forecast - actual)) AS mae FROM fc60 GROUP BY 1, 2")
def _(v):
    return C.forecast_error_day(v.fc60)


@job("q29_renewable_fc_bias_day", "zone operating_date:d bias:6",
     "SELECT zone, operating_date, avg(forecast - actual) AS bias FROM fc60 GROUP BY 1, 2")
def _(v):
    return C.forecast_error_day(v.fc60)


@job("q30_wind_overforecast_peak_he", "zone operating_date:d hour_ending:i",
     _TOP2.format(v="e", keys="zone, operating_date", tie="hour_ending", eps=0.01, src=f"""
        SELECT zone, operating_date, hour_ending, forecast - actual AS e FROM fc60 WHERE {sql_hours('operating_date')} = 24"""))
def _(v):
    return C.over_forecast_hour(v.fc60)


@job("q31_rt_avg_wind_overforecast", "point zone operating_date:d threshold:2 avg_price:6",
     """WITH m AS (SELECT zone, operating_date, floor(quantile_cont(abs(forecast - actual), 0.5) / 5) * 5 AS x FROM fc60 GROUP BY 1, 2)
        SELECT r.point, w.zone, w.operating_date, max(m.x) AS threshold, avg(r.price) AS avg_price
        FROM iv15 r JOIN fc60 w ON date_trunc('hour', r.start_utc) = w.start_utc
        JOIN m ON m.zone = w.zone AND m.operating_date = w.operating_date
        WHERE w.forecast - w.actual > m.x GROUP BY 1, 2, 3""")
def _(v):
    return C.price_when_over_forecast(v.iv15, v.fc60, 5)


@job("q32_load_fc_peak_he", "zone operating_date:d hour_ending:i",
     _TOP2.format(v="forecast", keys="zone, operating_date", tie="hour_ending", eps=0.01, src=f"""
        SELECT zone, operating_date, hour_ending, forecast FROM fc60 WHERE {sql_hours('operating_date')} = 24"""))
def _(v):
    return C.forecast_peak_hour(v.fc60)


# ---------------------------------------------------------------- storage
_REV = """SELECT {keys}, name AS schedule, sum({f} * CASE WHEN hour_ending BETWEEN ds AND de THEN mw * eff * price
              WHEN hour_ending BETWEEN cs AND ce THEN -mw * price ELSE 0 END) AS revenue
          FROM {t}, (VALUES """ + _schedules + """) s(name, mw, eff, cs, ce, ds, de) GROUP BY ALL"""


@job("q33_battery_fixed_da_revenue", "point operating_date:d schedule revenue:4",
     _REV.format(keys="point, operating_date", f=1, t="iv60"))
def _(v):
    return S.schedule_revenue(v.iv60, S.DAY, SCHEDULES)


@job("q33_battery_fixed_rt_revenue", "point operating_date:d schedule revenue:4",
     _REV.format(keys="point, operating_date", f=0.25, t="iv15"))
def _(v):
    return S.schedule_revenue(v.iv15, S.DAY, SCHEDULES, 0.25)


@job("q34_battery_best_arbitrage_da", "point operating_date:d eff:2 revenue:6",
     f"""SELECT c.point, c.operating_date, eff, greatest(0, max(eff * d.price - c.price)) AS revenue
         FROM iv60 c JOIN iv60 d ON d.point = c.point AND d.operating_date = c.operating_date AND d.start_utc > c.start_utc,
              (VALUES {_effs}) e(eff) GROUP BY 1, 2, 3""")
def _(v):
    return S.best_single_cycle(v.iv60, EFFICIENCIES)


@job("q35_battery_monthly_fixed_da_revenue", "point month schedule revenue:4",
     _REV.format(keys="point, month", f=1, t="iv60"))
def _(v):
    return S.schedule_revenue(v.iv60, P.MONTH, SCHEDULES)


# ---------------------------------------------------------------- advanced
# Holiday rules written out by weekday and day of month, independent of the library's date arithmetic.
SQL_HOLIDAY = """(
    (month({d}) = 1 AND ((day({d}) = 1 AND isodow({d}) <> 7) OR (day({d}) = 2 AND isodow({d}) = 1)))
 OR (month({d}) = 7 AND ((day({d}) = 4 AND isodow({d}) <> 7) OR (day({d}) = 5 AND isodow({d}) = 1)))
 OR (month({d}) = 12 AND ((day({d}) = 25 AND isodow({d}) <> 7) OR (day({d}) = 26 AND isodow({d}) = 1)))
 OR (month({d}) = 5 AND isodow({d}) = 1 AND day({d}) >= 25) OR (month({d}) = 9 AND isodow({d}) = 1 AND day({d}) <= 7)
 OR (month({d}) = 11 AND isodow({d}) = 4 AND day({d}) BETWEEN 22 AND 28))"""
SQL_BLOCK = ("CASE WHEN hour_ending <= 6 OR hour_ending >= 23 THEN '7x8' WHEN isodow({d}) >= 6 OR " + SQL_HOLIDAY
             + " THEN '2x16' ELSE '5x16' END").replace("{d}", "operating_date")


@job("q36_block_avg_da_month", "point month block avg_price:6",
     f"SELECT point, month, {SQL_BLOCK} AS block, avg(price) AS avg_price FROM ship60 GROUP BY 1, 2, 3")
def _(v):
    return P.block_averages(v.ship60)


_DP = """
WITH RECURSIVE h AS (
    SELECT point, operating_date, price, row_number() OVER (PARTITION BY point, operating_date ORDER BY start_utc) AS i,
           count(*) OVER (PARTITION BY point, operating_date) AS n FROM {t}),
dp(point, operating_date, i, n, eff, b0, b1, b2) AS (
    SELECT DISTINCT point, operating_date, CAST(0 AS BIGINT), n, CAST(eff AS DOUBLE), CAST(0 AS DOUBLE), CAST(-1e18 AS DOUBLE), CAST(-1e18 AS DOUBLE)
    FROM h, (VALUES """ + _effs + """) e(eff)
  UNION ALL
    SELECT d.point, d.operating_date, h.i, d.n, d.eff, greatest(b0, b1 + d.eff * price),
           greatest(b1, b0 - price, b2 + d.eff * price), greatest(b2, b1 - price)
    FROM dp d JOIN h ON h.point = d.point AND h.operating_date = d.operating_date AND h.i = d.i + 1)
SELECT point, operating_date, eff, b0 AS revenue FROM dp WHERE i = n {extra}"""


@job("q37_battery_2h_optimal_da", "point operating_date:d eff:2 revenue:6", _DP.replace("{t}", "iv60").replace("{extra}", "AND n = 24"))
def _(v):
    return S.two_hour_optimum(v.iv60, EFFICIENCIES)


@job("w14_two_hour_value_any_length", "point operating_date:d eff:2 revenue:6", _DP.replace("{t}", "iv60").replace("{extra}", ""))
def _(v):
    return S.two_hour_optimum(v.iv60, EFFICIENCIES, hours_required=None)


@job("q38_load_weighted_rt_month", "point month avg_price:6",
     """WITH rt AS (SELECT point, month, date_trunc('hour', start_utc) AS h, avg(price) AS p FROM iv15 GROUP BY 1, 2, 3)
        SELECT rt.point, rt.month, sum(rt.p * l.total) / sum(l.total) AS avg_price FROM rt JOIN load60 l ON l.start_utc = rt.h GROUP BY 1, 2""")
def _(v):
    return C.load_weighted_average(v.iv15, v.load60)


@job("q39_price_spike_events", "point month threshold:1 min_length:i events:l",
     f"""WITH x AS (SELECT *, row_number() OVER (PARTITION BY point, t ORDER BY start_utc)
                - row_number() OVER (PARTITION BY point, t, price >= t ORDER BY start_utc) AS grp
              FROM iv15, (VALUES {", ".join(f"({float(x)})" for x in [10, 20, 30] + SPIKE_THRESHOLDS)}) v(t)),
         runs AS (SELECT point, t, grp, arg_min(month, start_utc) AS month, count(*) AS len FROM x WHERE price >= t GROUP BY 1, 2, 3)
         SELECT point, month, t AS threshold, k AS min_length, count(*) AS events
         FROM runs, (VALUES (1), (2), (4)) m(k) WHERE len >= k GROUP BY 1, 2, 3, 4""")
def _(v):
    return P.spike_events(v.iv15, [10, 20, 30] + SPIKE_THRESHOLDS, SPIKE_MIN_LENGTHS)


@job("q40_peak_netload_hour_rt", "point month start_utc:t avg_price:6",
     f"""WITH net AS ({_NET}), top AS ({_TOP2.format(v="net", keys="month", tie="start_utc", eps=1.0, src="SELECT * FROM net")})
         SELECT r.point, top.month, top.start_utc, avg(r.price) AS avg_price
         FROM iv15 r JOIN top ON date_trunc('hour', r.start_utc) = top.start_utc GROUP BY 1, 2, 3""")
def _(v):
    return C.price_at_peak_net_load(v.iv15, _net(v))


@job("q41_rt_above_da_share", "point month share_pct:6",
     """WITH rt AS (SELECT point, date_trunc('hour', start_utc) AS h, avg(price) AS p FROM iv15 GROUP BY 1, 2)
        SELECT d.point, d.month, 100.0 * avg((rt.p > d.price)::INT) AS share_pct
        FROM iv60 d JOIN rt ON rt.h = d.start_utc AND rt.point = d.point GROUP BY 1, 2""")
def _(v):
    return P.share_above_market(v.iv15, v.iv60)


@job("q42_yoy_da_change", "point month change_pct:6",
     """WITH m AS (SELECT point, date_trunc('month', operating_date) AS mo, avg(price) AS p FROM ship60 GROUP BY 1, 2)
        SELECT a.point, strftime(a.mo, '%Y-%m') AS month, (a.p - b.p) / b.p * 100 AS change_pct
        FROM m a JOIN m b ON b.point = a.point AND b.mo = a.mo - INTERVAL 1 YEAR WHERE abs(b.p) >= 1""")
def _(v):
    return P.year_over_year(v.ship60)


@job("q43_fallback_day_7x8_rt", "point operating_date:d avg_price:6",
     f"""SELECT point, operating_date, avg(price) AS avg_price FROM ship15
         WHERE {sql_hours('operating_date')} <> 24 AND (hour_ending <= 6 OR hour_ending >= 23) GROUP BY 1, 2""")
def _(v):
    return P.change_day_offpeak_average(v.ship15)


@job("q44_net_load_hourly", "start_utc:t net_load:4", f"SELECT start_utc, net AS net_load FROM ({_NET})")
def _(v):
    return _net(v)
