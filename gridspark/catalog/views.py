"""Canonical market tables derived from the given tables, once for Spark and once as SQL for the checks.

The given tables hold no market data, so every view maps them onto the shapes the jobs work on: `events` become
interval prices, load and generation; `lineitem` becomes a long daily history and a multi-year price table that
crosses clock changes; `documents` become bulletins.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.constants import LOCAL_TZ, WEATHER_MODELS, WEATHER_POINTS
from gridspark.functions import timeconv as T

MODEL_LAGS = [("m1", 24), ("m2", 48), ("m3", 168)]


def cents(c: Column, digits: int = 4) -> Column:
    """Published values carry a fixed number of decimals."""
    return F.round(c + 10.0 ** -(digits + 3), digits)


def sql_cents(e: str, digits: int = 4) -> str:
    return f"(round(CAST({e} AS DOUBLE) + 1e-{digits + 3}, {digits}) + 0.0)"


def sql_local(e: str) -> str:
    return f"(({e}) AT TIME ZONE 'UTC') AT TIME ZONE '{LOCAL_TZ}'"


def sql_utc(e: str) -> str:
    return f"(({e}) AT TIME ZONE '{LOCAL_TZ}') AT TIME ZONE 'UTC'"


def sql_hours(day: str) -> str:
    return (f"CAST(date_diff('minute', {sql_utc(f'CAST({day} AS TIMESTAMP)')}, "
            f"{sql_utc(f'CAST({day} + 1 AS TIMESTAMP)')}) // 60 AS INTEGER)")


def sql_cutoff(day: str) -> str:
    return sql_utc(f"CAST({day} - 1 AS TIMESTAMP) + INTERVAL 10 HOUR")


def sql_repeated(ts: str) -> str:
    back = f"({ts} - INTERVAL 1 HOUR)"
    return f"({sql_local(ts)} = {sql_local(back)})"


def sql_time(ts: str) -> str:
    local = sql_local(ts)
    return (f"{local} AS start_local, CAST({local} AS DATE) AS operating_date, "
            f"strftime({local}, '%Y-%m') AS month, CAST(extract(hour FROM {local}) AS INTEGER) + 1 AS hour_ending, "
            f"CAST(extract(minute FROM {local}) AS INTEGER) // 15 + 1 AS quarter, {sql_repeated(ts)} AS repeated_hour")


class Views:
    """Lazy canonical frames over one folder of the given tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # ---------------------------------------------------------------- interval tables
    @cached_property
    def events(self) -> DataFrame:
        return self.table("events")

    def _interval(self, keys: dict[str, Column], aggs: list[Column], width: int) -> DataFrame:
        start = T.floor_minutes("ts", 15) if width == 15 else T.floor_hours("ts")
        cells = self.events.groupBy(*[c.alias(n) for n, c in keys.items()], start.alias("start_utc")).agg(*aggs)
        return T.add_time_columns(cells, "start_utc", width).withColumn("month", T.month_key("operating_date"))

    @cached_property
    def iv15(self) -> DataFrame:
        return self._interval({"point": F.col("event_type")}, [cents(F.avg("value") - 30).alias("price")], 15)

    @cached_property
    def iv60(self) -> DataFrame:
        return self._interval({"point": F.col("event_type")}, [cents(F.avg("value") - 25).alias("price")], 60)

    @cached_property
    def load60(self) -> DataFrame:
        return self._interval({}, [F.round(F.sum("value"), 2).alias("total")], 60)

    @cached_property
    def fuel15(self) -> DataFrame:
        cells = self._interval({"fuel": F.col("event_type")}, [F.round(F.sum("value"), 2).alias("energy")], 15)
        return cells.withColumn("generation", F.col("energy") * 4.0)

    @cached_property
    def ship15(self) -> DataFrame:
        """Seven years of 15-minute prices (2018-2024) that cross every clock change."""
        li = self.table("lineitem")
        slot = (F.col("l_orderkey") * 4 + F.col("l_linenumber")) % 112
        ts = F.col("l_shipdate") + F.expr("INTERVAL '23' YEAR") + T.minutes(slot * 15)
        cells = li.groupBy(F.col("l_returnflag").alias("point"), ts.alias("start_utc")).agg(
            cents(F.avg("l_extendedprice") / 1000 - 30).alias("price"))
        return T.add_time_columns(cells, "start_utc", 15).withColumn("month", T.month_key("operating_date"))

    @cached_property
    def ship60(self) -> DataFrame:
        li = self.table("lineitem")
        slot = (F.col("l_orderkey") * 4 + F.col("l_linenumber")) % 112
        ts = F.col("l_shipdate") + F.expr("INTERVAL '23' YEAR") + T.hours(F.floor(slot / 4))
        cells = li.groupBy(F.col("l_returnflag").alias("point"), ts.alias("start_utc")).agg(
            cents(F.avg("l_extendedprice") / 1000 - 25).alias("price"))
        return T.add_time_columns(cells, "start_utc", 60).withColumn("month", T.month_key("operating_date"))

    # ---------------------------------------------------------------- forecasts
    @cached_property
    def publications(self) -> DataFrame:
        """Hourly forecasts issued several times for one interval, with the actual once it is known."""
        lags = F.explode(F.array(*[F.struct(F.lit(h).alias("lag_h"), F.lit(d).alias("delay_min"))
                                   for h, d in ((24, 0), (24, 360), (48, 0), (20, 15))]))
        base = self.iv60.select("point", "start_utc", "price").withColumn("lag", lags)
        target = F.col("start_utc") + T.hours(F.col("lag.lag_h"))
        return base.select(
            F.col("point").alias("zone"), target.alias("start_utc"),
            (F.col("start_utc") + T.minutes(F.col("lag.delay_min")) - T.hours(12)).alias("publish_time"),
            F.when(F.hour("start_utc") % 7 != 3, F.col("price") + F.col("lag.delay_min") / 100).alias("forecast"))

    @cached_property
    def fc60(self) -> DataFrame:
        a = self.iv60.select(F.col("point").alias("zone"), "start_utc", F.col("price").alias("actual"))
        f = self.iv60.select(F.col("point").alias("zone"), (F.col("start_utc") + T.hours(24)).alias("start_utc"),
                             F.col("price").alias("forecast"))
        out = T.add_time_columns(a.join(f, ["zone", "start_utc"]), "start_utc", 60)
        return out.withColumns({"publish_time": F.col("start_utc") - T.hours(20),
                                "month": T.month_key("operating_date")})

    @cached_property
    def vintage(self) -> DataFrame:
        """Bitemporal forecasts: three models, two vintages per operating hour."""
        rows = F.explode(F.array(*[
            F.struct(F.lit(m).alias("model"), F.lit(i).alias("idx"), F.lit(lag + extra).alias("lag_h"),
                     F.lit(v).alias("vintage"))
            for i, (m, lag) in enumerate(MODEL_LAGS) for v, extra in (("dam", 0), ("prev", 24))]))
        base = self.iv60.select("point", "start_utc", "price").withColumn("m", rows)
        out = T.add_time_columns(
            base.select(F.col("point").alias("zone"), (F.col("start_utc") + T.hours(F.col("m.lag_h"))).alias("start_utc"),
                        F.col("price").alias("forecast"), "m.model", "m.vintage", "m.idx"), "start_utc", 60)
        cut = T.cutoff_utc("operating_date")
        publish = (cut - T.hours(F.when(F.col("vintage") == "prev", 24).otherwise(0))
                   - T.minutes(30) + T.minutes(F.when(F.col("hour_ending") == 24, 45).otherwise(0)))
        return out.select("zone", "operating_date", "hour_ending", "repeated_hour", "model", "vintage", "forecast",
                          (F.day("operating_date") % 3 == F.col("idx")).alias("in_use"),
                          publish.alias("publish_time"))

    @cached_property
    def posts(self) -> DataFrame:
        return self.events.select(F.col("event_id").alias("doc_id"), F.col("ts").alias("post_time_utc"))

    # ---------------------------------------------------------------- long daily history
    @cached_property
    def daily(self) -> DataFrame:
        li = self.table("lineitem")
        cells = li.groupBy(
            F.col("l_returnflag").alias("zone"), (F.col("l_linenumber") % 5 + 16).cast("int").alias("hour_ending"),
            F.to_date("l_shipdate").alias("operating_date")).agg(
                cents(F.avg("l_extendedprice"), 2).alias("y"), cents(F.avg("l_quantity"), 2).alias("quantity"),
                cents(F.avg("l_discount") * 100, 2).alias("spread"))
        level = li.groupBy(F.col("l_returnflag").alias("zone")).agg(cents(F.avg("l_extendedprice"), 0).alias("level"))
        return cells.join(level, "zone").withColumn("error", F.round(F.col("y") - F.col("level"), 2)).drop("level")

    # ---------------------------------------------------------------- scored samples and answers
    @cached_property
    def samples(self) -> DataFrame:
        outcome = (F.when(F.col("user_id") % 10 == 3, "wrong_answer").when(F.col("event_type") == "purchase", "correct").when(F.col("event_type") == "error", "sql_error")
                   .when(F.col("event_type") == "signup", "format_error")
                   .when(F.col("user_id") % 5 == 0, "correct").otherwise("wrong_answer"))
        u = F.col("user_id")
        return self.events.select(
            F.concat(F.lit("task"), u).alias("task_id"), F.concat(F.lit("t"), u % 40).alias("template_id"),
            F.concat(F.lit("f"), u % 8).alias("family"), (u % 3 + 1).cast("int").alias("difficulty"),
            F.lit("train").alias("split"), F.col("event_id").alias("sample_idx"),
            F.concat(F.lit("model"), F.col("event_id") % 2).alias("model"), F.lit("local").alias("backend"),
            outcome.alias("outcome"),
            F.when(outcome == "correct", 1.0).when(outcome == "format_error", -0.2).otherwise(0.0).alias("reward"),
            (F.col("value") / 10).alias("latency_s"), F.floor("value").cast("int").alias("output_tokens"),
            F.when(F.col("event_id") % 3 == 0, F.floor("value").cast("double") / 100).alias("cost_usd"))

    @cached_property
    def bulletins(self) -> DataFrame:
        """Documents framed as forecaster bulletins with titled sections."""
        d = self.table("documents")
        issued = F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")) + T.minutes(F.col("doc_id") * 37 % 500000)
        half = F.floor(F.length("text") / 2).cast("int")
        header = F.concat(F.lit("FXUS64 K"), F.translate(F.lpad(F.upper("source"), 4, "X").substr(2, 3), "0123456789", "ABCDEFGHIJ"), F.lit(" "),
                          F.date_format(issued, "ddHHmm"))
        body = F.concat_ws(
            "\n", header, F.lit("AFD"), F.lit(""), F.lit("Area Forecast Discussion"),
            F.concat(F.date_format(issued, "hmm a"), F.lit(" UTC Mon "), F.date_format(issued, "MMM d yyyy")),
            F.lit(""), F.when(F.col("doc_id") % 3 == 0, F.lit("...New Short Term...")),
            F.lit("Quiet weather with little change."), F.lit(""),
            F.concat(F.lit(".SHORT TERM (TONIGHT)..."), F.when(F.col("doc_id") % 2 == 0, "/NEW/").otherwise("")),
            F.lit("Issued at 105 PM CDT Sat Jul 1 2023"), F.substring(F.col("text"), F.lit(1), half), F.lit("&&"),
            F.lit(".LONG TERM /SATURDAY ONWARD/..."), F.expr("substring(text, cast(floor(length(text)/2) as int) + 1)"),
            F.lit("A storm in 2024."), F.lit("&&"),
            F.lit(".AVIATION..."), F.lit("VFR."), F.lit("$$"))
        return d.select("doc_id", F.col("source").alias("office"), issued.alias("issued_utc"),
                        body.alias("raw_text"), "text", "lang")


    # ---------------------------------------------------------------- quantile runs
    @cached_property
    def climate(self) -> DataFrame:
        from gridspark.plans.baselines import climatology
        q = climatology(self.daily.filter(F.col("operating_date") < F.lit("1999-01-01").cast("date")))
        return q.withColumns({k: cents(F.col(k), 2) for k in ("p10", "p50", "p90")})

    @cached_property
    def trailing(self) -> DataFrame:
        from gridspark.plans.baselines import trailing_quantiles
        q = trailing_quantiles(self.daily)
        return q.withColumns({k: cents(F.col(k), 2) for k in ("p10", "p50", "p90")})

    @cached_property
    def quant(self) -> DataFrame:
        """Two runs on the same zone-days: climatology, and trailing quantiles (missing at first)."""
        from gridspark.plans.baselines import trailing_quantiles
        names = ("p10", "p50", "p90")
        hist = trailing_quantiles(self.daily, keep=["error"])
        clim = self.climate.withColumnsRenamed({k: f"c_{k}" for k in names})
        both = F.explode(F.array(
            F.struct(F.lit("clim").alias("run"), *[F.col(f"c_{k}").alias(k) for k in names]),
            F.struct(F.lit("hist").alias("run"), *[cents(F.col(k), 2).alias(k) for k in names])))
        rows = hist.join(clim, ["zone", "hour_ending"]).select("zone", "hour_ending", F.col("operating_date").alias("day"),
                                                               F.col("error").alias("y"), both.alias("r"))
        return rows.select("r.run", F.concat_ws("_", "zone", F.date_format("day", "yyyy-MM-dd")).alias("id"), "zone", "day",
                           "hour_ending", "r.p10", "r.p50", "r.p90", "y")

    @cached_property
    def clim_run(self) -> DataFrame:
        """The climatology run alone, without the trailing windows."""
        rows = self.daily.join(self.climate, ["zone", "hour_ending"])
        return rows.select(F.lit("clim").alias("run"),
                           F.concat_ws("_", "zone", F.date_format("operating_date", "yyyy-MM-dd")).alias("id"), "zone",
                           F.col("operating_date").alias("day"), "hour_ending", "p10", "p50", "p90", F.col("error").alias("y"))

    @cached_property
    def completions(self) -> DataFrame:
        """Answer text per zone-day from the climatology run: plain, fenced, in prose, unordered, broken, quoted, boolean."""
        q = self.clim_run
        k = F.day("day") % 7
        num = lambda c: F.format_string("%.2f", F.col(c))
        lo, hi = F.when(F.col("k") == 3, num("p90")).otherwise(num("p10")), F.when(F.col("k") == 3, num("p10")).otherwise(num("p90"))
        mid = (F.when(F.col("k") == 5, F.concat(F.when(F.col("p50") >= 0, "+").otherwise(""), num("p50")))
               .when(F.col("k") == 6, "true").otherwise(num("p50")))
        low = F.when(F.col("k") == 5, F.concat(F.lit('"'), lo, F.lit('"'))).otherwise(lo)
        row = F.concat(F.lit('{"he":'), F.col("hour_ending").cast("string"), F.lit(', "p10": '), low, F.lit(', "p50": '), mid,
                       F.lit(', "p90": '), hi, F.lit("}"))
        rows = q.withColumn("k", k).withColumn("row", row).groupBy("id", "zone", "day", "k").agg(
            F.array_sort(F.collect_list(F.struct("hour_ending", "row"))).alias("r"))
        body = F.concat(F.lit('{"hours": ['), F.array_join(F.transform("r", lambda x: x["row"]), ", "),
                        F.when(F.col("k") == 4, "]").otherwise("]}"))
        text = (F.when(F.col("k") == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
                .when(F.col("k") == 2, F.concat(F.lit("Here you go:\n"), body, F.lit("\nThanks"))).otherwise(body))
        return rows.select("id", "zone", "day", "k", F.transform("r", lambda x: x["hour_ending"]).alias("hours"), text.alias("text"))

    # ---------------------------------------------------------------- typed answers
    @cached_property
    def graded(self) -> tuple[DataFrame, DataFrame]:
        """Truth and submitted answers per user, wrong in a known way."""
        per = self.events.groupBy("user_id").agg(
            cents(F.avg("value"), 2).alias("avg_value"), F.count("*").alias("n"), F.max("ts").alias("last_ts"),
            F.min("event_type").alias("first_type"), F.array_sort(F.collect_set("event_type")).alias("types"))
        u, kind = F.col("user_id"), F.col("user_id") % 5
        off = u % 4
        name = F.get(F.array(*[F.lit(x) for x in ("number", "integer", "timestamp", "category", "list")]), kind.cast("int"))
        expected = (F.when(kind == 0, F.array(F.format_string("%.2f", F.col("avg_value"))))
                    .when(kind == 1, F.array(F.col("n").cast("string")))
                    .when(kind == 2, F.array(F.date_format(T.utc_to_local("last_ts"), "yyyy-MM-dd HH:mm")))
                    .when(kind == 3, F.array("first_type")).otherwise(F.col("types")))
        truth = per.select(F.concat(F.lit("task"), u).alias("task_id"), name.alias("answer_type"), expected.alias("expected"),
                           F.when(kind == 0, 0.01).otherwise(0.0).alias("tol_abs"), F.lit(0.0).alias("tol_rel"),
                           F.lit(LOCAL_TZ).alias("tz"), F.lit(False).alias("ordered"))
        number = F.format_string("%s%.3f", F.when(off == 1, "$").otherwise(""), F.col("avg_value") + off * 0.01)
        stamp = F.when(off <= 1, F.concat(F.date_format("last_ts", "yyyy-MM-dd HH:mm:ss"), F.lit("+00:00"))).otherwise(
            F.date_format("last_ts", "yyyy-MM-dd HH:mm:ss"))
        cat = F.when(off == 3, "nothing").otherwise(F.concat(F.lit(" '"), F.upper("first_type"), F.lit("' ")))
        listed = (F.when(off == 2, F.slice("types", 2, 100)).when(off == 3, F.array_append("types", F.get("types", F.lit(0))))
                  .otherwise(F.reverse("types")))
        values = (F.when(kind == 0, F.array(number))
                  .when(kind == 1, F.array(F.format_string("%.1f", F.col("n") + F.when(off == 3, 0.5).otherwise(0.0))))
                  .when(kind == 2, F.array(stamp)).when(kind == 3, F.array(cat)).otherwise(listed))
        answers = per.select(F.concat(F.lit("task"), u).alias("task_id"), values.alias("values"), (u % 11 != 0).alias("has_sql"),
                             (u % 13 != 0).alias("ran"), F.when(u % 17 == 0, 2).otherwise(1).alias("n_columns"))
        return truth, answers

    # ---------------------------------------------------------------- weather and whole price days
    @cached_property
    def weather_rows(self) -> DataFrame:
        """Sparse point weather of four models on a six-hour grid."""
        names = F.array(*[F.lit(p[0]) for p in WEATHER_POINTS])
        models = F.array(*[F.lit(m[0]) for m in WEATHER_MODELS])
        kind, x = F.col("event_type"), F.col("value")
        return self.events.groupBy(
            F.get(names, (F.col("user_id") % len(WEATHER_POINTS)).cast("int")).alias("point"),
            F.get(models, (F.col("event_id") % len(WEATHER_MODELS)).cast("int")).alias("model"),
            T.floor_hours("ts", 6).alias("valid_time_utc")).agg(
                cents(F.avg(F.when(kind != "error", x / 3)), 4).alias("temp_c"), cents(F.avg(x / 4), 4).alias("dewpoint_c"),
                cents(F.avg(F.when(kind == "view", x)), 4).alias("cloud_cover_pct"), cents(F.avg(x * 0.8), 4).alias("wind_speed_kmh"),
                cents(F.avg(F.when(kind == "signup", x / 50)), 4).alias("precip_mm"))

    @cached_property
    def da_full(self) -> DataFrame:
        """Two price points with every hour that had any event."""
        point = F.explode(F.array(*[F.struct(F.lit(p).alias("point"), F.lit(k).alias("k")) for p, k in (("A", 8.0), ("B", 5.0))]))
        rows = self.load60.withColumn("p", point)
        return rows.select("p.point", "operating_date", "hour_ending", "start_utc", cents(F.col("total") / F.col("p.k"), 2).alias("price"),
                           F.floor("total").cast("bigint").alias("whole"))

    @cached_property
    def rt_full(self) -> DataFrame:
        q = self.da_full.withColumn("quarter", F.explode(F.sequence(F.lit(1), F.lit(4))))
        bump = (F.col("whole") * (F.col("quarter") + 2) % 83 - 30).cast("double")
        return q.select("point", "operating_date", "hour_ending", "quarter", F.round(F.col("price") + bump, 2).alias("price"))


# -------------------------------------------------------------------------------------------- SQL twins
_INTERVALS = "SELECT *, {time} FROM (SELECT {keys} time_bucket(INTERVAL '{w} minutes', ts) AS start_utc, {agg} FROM events GROUP BY ALL)"
_SLOT = "(l_orderkey * 4 + l_linenumber) % 112"
_SHIP = ("SELECT *, {time} FROM (SELECT l_returnflag AS point, l_shipdate + INTERVAL 23 YEAR + {step} AS start_utc, "
         "{agg} AS price FROM lineitem GROUP BY ALL)")
_TIME = sql_time("start_utc")

SQL_VIEWS: dict[str, str] = {
    "iv15": _INTERVALS.format(time=_TIME, keys="event_type AS point,", w=15,
                              agg=sql_cents("avg(value) - 30") + " AS price"),
    "iv60": _INTERVALS.format(time=_TIME, keys="event_type AS point,", w=60,
                              agg=sql_cents("avg(value) - 25") + " AS price"),
    "load60": _INTERVALS.format(time=_TIME, keys="", w=60, agg="round(sum(value), 2) AS total"),
    "fuel15": "SELECT *, energy * 4.0 AS generation FROM (" + _INTERVALS.format(
        time=_TIME, keys="event_type AS fuel,", w=15, agg="round(sum(value), 2) AS energy") + ")",
    "ship15": _SHIP.format(time=_TIME, step=f"to_minutes(CAST({_SLOT} * 15 AS BIGINT))",
                           agg=sql_cents("avg(l_extendedprice) / 1000 - 30")),
    "ship60": _SHIP.format(time=_TIME, step=f"to_hours(CAST({_SLOT} // 4 AS BIGINT))",
                           agg=sql_cents("avg(l_extendedprice) / 1000 - 25")),
    "publications": """
        SELECT point AS zone, start_utc + to_hours(lag_h) AS start_utc,
               start_utc + to_minutes(delay_min) - INTERVAL 12 HOUR AS publish_time,
               CASE WHEN extract(hour FROM start_utc) % 7 <> 3 THEN price + delay_min / 100 END AS forecast
        FROM iv60, (VALUES (24, 0), (24, 360), (48, 0), (20, 15)) v(lag_h, delay_min)""",
    "fc60": f"""
        SELECT a.point AS zone, a.start_utc, a.price AS actual, f.price AS forecast,
               a.start_utc - INTERVAL 20 HOUR AS publish_time, {sql_time('a.start_utc')}
        FROM iv60 a JOIN iv60 f ON f.point = a.point AND f.start_utc = a.start_utc - INTERVAL 24 HOUR""",
    "vintage": f"""
        SELECT zone, operating_date, hour_ending, repeated_hour, model, vintage, forecast,
               extract(day FROM operating_date) % 3 = idx AS in_use,
               {sql_cutoff('operating_date')} - to_hours(CASE WHEN vintage = 'prev' THEN 24 ELSE 0 END)
                 - INTERVAL 30 MINUTE + to_minutes(CASE WHEN hour_ending = 24 THEN 45 ELSE 0 END) AS publish_time
        FROM (SELECT *, {_TIME} FROM (
            SELECT point AS zone, start_utc + to_hours(lag_h) AS start_utc, price AS forecast, model, vintage, idx
            FROM iv60, (VALUES ('m1', 0, 24, 'dam'), ('m1', 0, 48, 'prev'), ('m2', 1, 48, 'dam'), ('m2', 1, 72, 'prev'),
                               ('m3', 2, 168, 'dam'), ('m3', 2, 192, 'prev')) v(model, idx, lag_h, vintage)))""",
    "posts": "SELECT event_id AS doc_id, ts AS post_time_utc FROM events",
    "daily": f"""
        SELECT c.*, round(c.y - z.level, 2) AS error
        FROM (SELECT l_returnflag AS zone, CAST(l_linenumber % 5 + 16 AS INTEGER) AS hour_ending,
                     CAST(l_shipdate AS DATE) AS operating_date, {sql_cents('avg(l_extendedprice)', 2)} AS y,
                     {sql_cents('avg(l_quantity)', 2)} AS quantity, {sql_cents('avg(l_discount) * 100', 2)} AS spread
              FROM lineitem GROUP BY ALL) c
        JOIN (SELECT l_returnflag AS zone, {sql_cents('avg(l_extendedprice)', 0)} AS level FROM lineitem GROUP BY 1) z
        USING (zone)""",
    "samples": """
        SELECT *, CASE outcome WHEN 'correct' THEN 1.0 WHEN 'format_error' THEN -0.2 ELSE 0.0 END::DOUBLE AS reward
        FROM (SELECT 'task' || user_id AS task_id, 't' || (user_id % 40) AS template_id, 'f' || (user_id % 8) AS family,
                     CAST(user_id % 3 + 1 AS INTEGER) AS difficulty, 'train' AS split, event_id AS sample_idx,
                     'model' || (event_id % 2) AS model, 'local' AS backend,
                     CASE WHEN user_id % 10 = 3 THEN 'wrong_answer' WHEN event_type = 'purchase' THEN 'correct' WHEN event_type = 'error' THEN 'sql_error'
                          WHEN event_type = 'signup' THEN 'format_error' WHEN user_id % 5 = 0 THEN 'correct'
                          ELSE 'wrong_answer' END AS outcome,
                     value / 10 AS latency_s, CAST(floor(value) AS INTEGER) AS output_tokens,
                     CASE WHEN event_id % 3 = 0 THEN floor(value) / 100 END AS cost_usd FROM events)""",
    "bulletins": r"""
        SELECT doc_id, source AS office, issued AS issued_utc, text, lang,
               concat_ws(chr(10), 'FXUS64 K' || translate(substr(substr('XXXX', 1, greatest(4 - length(source), 0)) || upper(source), 2, 3), '0123456789', 'ABCDEFGHIJ') || ' ' || strftime(issued, '%d%H%M'),
                 'AFD', '', 'Area Forecast Discussion',
                 strftime(issued, '%-I%M %p') || ' UTC Mon ' || strftime(issued, '%b %-d %Y'), '',
                 CASE WHEN doc_id % 3 = 0 THEN '...New Short Term...' END,
                 'Quiet weather with little change.', '',
                 '.SHORT TERM (TONIGHT)...' || CASE WHEN doc_id % 2 = 0 THEN '/NEW/' ELSE '' END,
                 'Issued at 105 PM CDT Sat Jul 1 2023', substr(text, 1, CAST(length(text) // 2 AS BIGINT)), '&&',
                 '.LONG TERM /SATURDAY ONWARD/...', substr(text, CAST(length(text) // 2 AS BIGINT) + 1),
                 'A storm in 2024.', '&&', '.AVIATION...', 'VFR.', '$$') AS raw_text
        FROM (SELECT *, TIMESTAMP '2024-01-01' + to_minutes(doc_id * 37 % 500000) AS issued FROM documents)""",
    "climate": "SELECT zone, hour_ending, " + ", ".join(
        f"{sql_cents(f'quantile_cont(error, {t})', 2)} AS {q}" for q, t in (("p10", 0.1), ("p50", 0.5), ("p90", 0.9)))
        + " FROM daily WHERE operating_date < DATE '1999-01-01' GROUP BY 1, 2",
    "trail90": """
        SELECT d.zone, d.hour_ending, d.operating_date, """ + ", ".join(f"{sql_cents('s.' + q, 2)} AS {q}" for q in ("p10", "p50", "p90")) + """
        FROM daily d ASOF LEFT JOIN (
            SELECT zone, hour_ending, operating_date, """ + ", ".join(
                f"CASE WHEN count(error) OVER w >= 20 THEN quantile_cont(error, {t}) OVER w END AS {q}"
                for q, t in (("p10", 0.1), ("p50", 0.5), ("p90", 0.9))) + """ FROM daily
            WINDOW w AS (PARTITION BY zone, hour_ending ORDER BY operating_date RANGE BETWEEN INTERVAL 89 DAYS PRECEDING AND CURRENT ROW)) s
        ON s.zone = d.zone AND s.hour_ending = d.hour_ending AND s.operating_date <= d.operating_date - 2""",
    "quant": """
        SELECT run, zone || '_' || strftime(operating_date, '%Y-%m-%d') AS id, zone, operating_date AS day, hour_ending, p10, p50, p90, y FROM (
            SELECT 'clim' AS run, d.zone, d.hour_ending, d.operating_date, p10, p50, p90, error AS y FROM daily d JOIN climate USING (zone, hour_ending)
            UNION ALL SELECT 'hist', d.zone, d.hour_ending, d.operating_date, p10, p50, p90, error FROM daily d
            JOIN trail90 t ON t.zone = d.zone AND t.hour_ending = d.hour_ending AND t.operating_date = d.operating_date)""",
    "weather_points": "SELECT * FROM (VALUES " + ", ".join(
        f"({i}, '{p[0]}', '{p[1]}', {p[5]})" for i, p in enumerate(WEATHER_POINTS)) + ") p(idx, point, zone, weight)",
    "weather_rows": f"""
        SELECT p.point, ['gfs', 'ecmwf', 'icon', 'gem'][CAST(event_id % 4 AS INTEGER) + 1] AS model,
               time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '2000-01-01') AS valid_time_utc,
               {sql_cents("avg(CASE WHEN event_type <> 'error' THEN value / 3 END)")} AS temp_c, {sql_cents('avg(value / 4)')} AS dewpoint_c,
               {sql_cents("avg(CASE WHEN event_type = 'view' THEN value END)")} AS cloud_cover_pct, {sql_cents('avg(value * 0.8)')} AS wind_speed_kmh,
               {sql_cents("avg(CASE WHEN event_type = 'signup' THEN value / 50 END)")} AS precip_mm
        FROM events JOIN weather_points p ON p.idx = user_id % {len(WEATHER_POINTS)} GROUP BY 1, 2, 3""",
    "da_full": f"""SELECT point, operating_date, hour_ending, start_utc, {sql_cents('total / k', 2)} AS price, CAST(floor(total) AS BIGINT) AS whole
        FROM load60, (VALUES ('A', 8.0), ('B', 5.0)) p(point, k)""",
    "rt_full": """SELECT point, operating_date, hour_ending, q AS quarter, round(price + (whole * (q + 2) % 83 - 30), 2) AS price
        FROM da_full, (VALUES (1), (2), (3), (4)) v(q)""",
}
