import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from gridspark import schemas
from gridspark.constants import FORECAST_ZONE_COLUMNS
from gridspark.operators.reshape import conform
from gridspark.plans.features import fallback_forecasts
from gridspark.operators.reshape import keep_last
from gridspark.functions import timeconv as T
from gridspark.sources import normalize, readers, sinks, spines


def test_balancing_area(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('Balancing Authority,Other,UTC Time at End of Hour,Demand Forecast (MW),Demand (MW)\n'
                 'AAA ,x,11/3/2024 6:00:00 AM,"41,000","40,500"\nAAA,x,11/3/2024 7:00:00 AM,41000,\nAAA,x,11/3/2024 8:00:00 AM,1,2\n'
                 'AAA,x,11/3/2024 9:00:00 AM,1,2\nBBB,x,11/3/2024 9:00:00 AM,1,2\n')
    df = readers.read_balancing_area(spark, str(p), "AAA")
    rows = df.orderBy("interval_end_utc").collect()
    assert len(rows) == 4 and rows[0].forecast_mw == 41000 and rows[1].demand_mw is None
    out = fallback_forecasts(keep_last(df, ["interval_end_utc"], ["forecast_mw"])).orderBy("fc_publish_utc", "repeated_hour", "hour_ending").collect()
    assert sorted((r.hour_ending, r.repeated_hour) for r in out) == [(1, False), (2, False), (2, True), (3, False)]


def test_model_forecasts(spark, tmp_path):
    zones = list(FORECAST_ZONE_COLUMNS)
    head = "DeliveryDate,HourEnding," + ",".join(zones) + ",Model,InUseFlag,DSTFlag    \n"
    body = "".join(f"07/15/2024,{h}:00," + ",".join("7.0" for _ in zones) + f",{m} ,{'Y' if m == 'E' else 'N'},N\n" for h in range(1, 25) for m in ("E", "A3"))
    for name in ("101", "102"):
        (tmp_path / f"{name}.csv").write_text(head + body)
    df = readers.read_model_forecasts(spark, str(tmp_path))
    assert df.count() == 2 * 24 * 9 * 2 and {r.doc_id for r in df.select("doc_id").distinct().collect()} == {"101", "102"}
    south = df.filter("zone = 'south' AND in_use").first()
    assert south.forecast == 7.0 and south.model == "E" and not south.repeated_hour


def test_price_archive(spark):
    rows = [("11/03/2024", "2", "1", "Y", "HB_WEST", "HU", "10.5"), ("11/03/2024", "2", "1", "N", "HB_WEST", "HU", "9"), ("11/03/2024", "2", "4", "N", "LZ_WEST", "LZEW", "1"),
            ("07/01/2024", "24", "4", "N", "OTHER", "LZ", "1")]
    rt = spark.createDataFrame(rows, "`Delivery Date` string, `Delivery Hour` string, `Delivery Interval` string, `Repeated Hour Flag` string, "
                                     "`Settlement Point Name` string, `Settlement Point Type` string, `Settlement Point Price` string")
    out = readers.price_archive(rt, ["HB_WEST", "LZ_WEST"]).orderBy("start_utc").collect()
    assert [r.start_utc for r in out] == [dt.datetime(2024, 11, 3, 6), dt.datetime(2024, 11, 3, 7)] and out[1].price == 10.5
    da = spark.createDataFrame([("07/01/2024", "01:00", "N", "HB_BUSAVG", "3"), ("07/01/2024", "24:00", "N", "LZ_WEST", "4")],
                               "`Delivery Date` string, `Hour Ending` string, `Repeated Hour Flag` string, `Settlement Point` string, `Settlement Point Price` string")
    std = normalize.prices(readers.price_archive(da, ["HB_BUSAVG", "LZ_WEST"]), 60).orderBy("start_utc").collect()
    assert [(r.point_type, r.hour_ending) for r in std] == [("hub", 1), ("load_zone", 24)]


def test_generation_sheet(spark):
    labels = [f"{(m // 60) % 24}:{m % 60:02d}" for m in range(15, 1441, 15)]
    extra = ["01:15 (DST)", "01:30 (DST)", "01:45 (DST)", "02:00 (DST)"]
    cols = labels[:8] + extra + labels[8:]
    def row(day, skip=(), with_extra=False, fuel="Wind"):
        return [day, fuel, "TYPE"] + [None if (c in skip or ("DST" in c and not with_extra)) else str(float(i)) for i, c in enumerate(cols)]
    gap = ("2:15", "2:30", "2:45", "3:00")
    data = [row("2024-07-01"), row("2024-03-10", gap), row("2024-11-03", with_extra=True), row("2024-07-02", with_extra=True, fuel="Bad")]
    schema = "Date string, Fuel string, `Settlement Type` string, " + ", ".join(f"`{c}` string" for c in cols)
    out = readers.generation_sheet(spark.createDataFrame(data, schema))
    per_day = {(r.d, r.fuel): r.n for r in out.groupBy(F.to_date(T.utc_to_local("start_utc")).alias("d"), "fuel").agg(F.count("*").alias("n")).collect()}
    d = dt.date
    assert per_day == {(d(2024, 7, 1), "Wind"): 96, (d(2024, 3, 10), "Wind"): 92, (d(2024, 11, 3), "Wind"): 100}
    fall = out.filter(F.col("start_utc") == F.lit("2024-11-03 07:00:00").cast("timestamp_ntz")).first()
    assert fall.energy == 8.0  # first repeated-hour column


def test_weather_json(spark, tmp_path):
    p = tmp_path / "w.json"
    p.write_text(json.dumps({"point": "dfw", "model": "gfs", "hourly": {"time": ["2024-07-16T05:00", "2024-07-16T06:00"], "temperature_2m_previous_day2": [10.0, None]}}))
    out = readers.weather_responses(spark.read.json(str(p))).orderBy("valid_time_utc").collect()
    assert [r.temp_c for r in out] == [10.0, None] and out[0].valid_time_utc == dt.datetime(2024, 7, 16, 5) and out[0].dewpoint_c is None


def test_listing(spark, tmp_path):
    p = tmp_path / "l.json"
    docs = [("1", "a csv", "2024-11-03T01:30:00"), ("2", "b csv", "2024-11-03T01:30:00.000"), ("2", "b csv", "2024-11-03T01:30:00.000"), ("3", "c XML", "2024-11-03T01:00:00"), ("", "d", "2024-11-03T01:00:00")]
    p.write_text(json.dumps({"archives": [dict(zip(("doc_id", "friendly_name", "post_datetime"), d)) for d in docs]}))
    rows = readers.read_listing(spark, str(p)).orderBy("doc_id").collect()
    assert [(r.doc_id, r.post_time_utc.hour) for r in rows] == [(1, 6), (2, 7)]


def test_bulletin_files(spark, tmp_path):
    (tmp_path / "x.txt").write_text("\x01FXUS64 KFWD 011939\nbody\n\x03\x01no header\n\x03")
    rows = readers.read_bulletins(spark, str(tmp_path)).collect()
    assert len(rows) == 1 and rows[0].wmo_header == "FXUS64 KFWD 011939"


def test_json_lines_resume_and_splits(spark, tmp_path):
    p = tmp_path / "r.jsonl"
    p.write_text('{"task_id": "a", "sample_idx": 0}\n{"task_id": "a", "sam\n{"task_id": "b", "sample_idx": 1}\n')
    done = readers.read_json_lines(spark, str(p), "task_id string, sample_idx int")
    assert done.count() == 2
    want = spark.createDataFrame([("a", 0), ("a", 1), ("b", 1)], "task_id string, sample_idx int")
    assert [tuple(r) for r in sinks.remaining(want, done, ["task_id", "sample_idx"]).collect()] == [("a", 1)]
    rows = spark.createDataFrame([("train", "b", 1), ("train", "a", 2), ("val", "c", 3)], "split string, id string, x int")
    out = str(tmp_path / "out")
    sinks.write_json_lines(rows, out, ["split"], "id")
    back = spark.read.schema("split string, id string, x int").json(out)
    assert sorted((r.split, r.id, r.x) for r in back.collect()) == [("train", "a", 2), ("train", "b", 1), ("val", "c", 3)]


def test_month_sink_keeps_settled_months(spark, tmp_path):
    path = str(tmp_path / "t")
    def frame(v, months=("2024-01-15", "2024-02-15")):
        return spark.createDataFrame([(m, v) for m in months], "s string, v int").select(F.col("s").cast("timestamp_ntz").alias("start_local"), "v")
    assert sinks.write_months(frame(1), path) == ["2024-01", "2024-02"]
    assert sinks.write_months(frame(2), path) == []
    assert sinks.write_months(frame(3, ("2024-02-15", "2024-03-15")), path, ["2024-02"]) == ["2024-02", "2024-03"]
    got = {r.month: r.v for r in readers.read_parquet(spark, path).select("month", "v").collect()}
    assert {str(k): v for k, v in got.items()} == {"2024-01": 1, "2024-02": 3, "2024-03": 3}
    assert sinks.recent_months(dt.date(2024, 1, 9)) == ["2024-01", "2023-12"]


def test_sorted_table_and_conform(spark, tmp_path):
    day = spines.days(spark, dt.date(2024, 7, 1), dt.date(2024, 7, 3))
    rows = normalize.prices(spines.interval_starts(day, 60).withColumns({"point": F.lit("HB_WEST"), "point_type": F.lit("HU"), "price": F.lit("1.5")}), 60)
    name = "da_price_hourly"
    typed = conform(rows, schemas.TABLES[name])
    path = str(tmp_path / name)
    for _ in range(2):
        sinks.build_table(typed, path, schemas.SORT_KEYS[name], 2)
    back = spark.read.parquet(path)
    assert back.columns == list(schemas.TABLES[name]) and back.count() == 72 and dict(back.dtypes)["hour_ending"] == "smallint"


def test_load_services_and_forecasts(spark):
    load = spark.createDataFrame([("2024-07-01 05:00", "1", "x", "3")], "s string, Coast string, `Far West` string, Total string")
    for c in ("East", "North", "North Central", "South", "South Central", "West"):
        load = load.withColumn(c, F.lit("2"))
    r = normalize.load(load.withColumn("start_utc", F.col("s").cast("timestamp_ntz"))).first()
    assert (r.coast_mw, r.far_west_mw, r.total_mw, r.hour_ending) == (1.0, None, 3.0, 1)
    raw = spark.createDataFrame([("03/10/2024", "03:00", "N", "1", "2"), ("11/03/2024", "02:00", "Y", "3", None)],
                                "`Delivery Date` string, `Hour Ending` string, `Repeated Hour Flag` string, REGUP string, RRS string")
    rows = {(x.service, x.hour_ending): x for x in normalize.service_prices(raw).collect()}
    assert len(rows) == 4 and rows[("REGUP", 2)].repeated_hour and rows[("RRS", 2)].price is None
    assert rows[("REGUP", 3)].start_utc == dt.datetime(2024, 3, 10, 8)


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.23456, None)], "run string, x double, y double")
    assert "| a | 1.235 | - |" in sinks.markdown(df, "T")
    sinks.write_csv(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).first().run == "a"
    with pytest.raises(ValueError):
        sinks.markdown(spark.range(5), "T", limit=3)


def test_service_prices_with_different_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Date,REGUP ,REGDN\n1,1.0,2.0\n")
    (tmp_path / "b.csv").write_text("Date,REGDN,REGUP,ECRS\n2,4.0,3.0,5.0\n")
    (tmp_path / "c.csv").write_text("Date,REGUP ,REGDN\n3,6.0,7.0\n")
    got = {r.Date: (r.REGUP, r.REGDN, r.ECRS) for r in readers.read_service_prices(spark, str(tmp_path)).collect()}
    assert got == {"1": ("1.0", "2.0", None), "2": ("3.0", "4.0", "5.0"), "3": ("6.0", "7.0", None)}


def test_framed_file_is_read_by_many_tasks(spark, tmp_path):
    from gridspark.plans import bulletins as N
    body = "\n".join(f"line {i} FXUS64" for i in range(40))
    pieces = [f"FXUS64 KFWD {d:02d}{h:02d}00\r\n{body}\nFXUS64 KHGX 010203\ninside {d} {h}\n\x03" for d in range(1, 21) for h in range(24)]
    (tmp_path / "a.txt").write_text("\x01" + "\x01".join(pieces) + "\x01no header\n\x03", newline="")
    (tmp_path / "b.txt").write_text("FXUS64 KFWD 011939\nfirst\nFXUS64 KFWD 012039\nsecond\n")
    (tmp_path / "c.txt").write_text("FXUS64 KFWD 021939\nonly\nFXUS64 KFWD 022039\nstill the first\n\x01")
    (tmp_path / "d.txt").write_text("")
    windows = spark.createDataFrame([(f"{n}.txt", dt.datetime(2024, 7, 1), dt.datetime(2024, 7, 21)) for n in "ab"], "file string, win_start timestamp_ntz, win_end timestamp_ntz")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
        df = readers.read_bulletins(spark, str(tmp_path), windows)
        got = sorted((r.file, r.wmo_header, r.body) for r in df.collect())
        assert spark.read.option("lineSep", "\x01").text(str(tmp_path / "a.txt")).rdd.getNumPartitions() > 10
        bad = N.rejected_pieces(readers.bulletin_pieces(spark, str(tmp_path), windows)).select("file", "reason").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    whole = spark.read.text(str(tmp_path), wholetext=True).select(F.col("value").alias("raw"), F.col("_metadata.file_name").alias("file"))
    assert got == sorted((r.file, r.wmo_header, r.body) for r in N.split_products(whole).collect())
    assert len(got) == len(pieces) + 2 + 1 and {r.win_start for r in df.filter("file <> 'c.txt'").collect()} == {dt.datetime(2024, 7, 1)}
    assert sorted((r.file, r.reason) for r in bad if r.file == "a.txt" and r.reason == "no header line") == [("a.txt", "no header line")]


def test_types_that_drift_between_months(spark, tmp_path, caplog):
    path = str(tmp_path / "t")
    months = {"2024-01": "CAST(1 AS BIGINT) AS v, DATE '2024-01-05' AS at, 'a' AS k, 7 AS old",
              "2024-02": "CAST(2.5 AS DOUBLE) AS v, TIMESTAMP_NTZ '2024-02-05 06:00:00' AS at, 'b' AS k",
              "2024-03": "CAST(3 AS BIGINT) AS v, DATE '2024-03-05' AS at, 'c' AS k, 8 AS old", "2024-04": "CAST(4 AS INT) AS v, DATE '2024-04-05' AS at, 9 AS k"}
    for m, columns in months.items():
        spark.sql(f"SELECT {columns}").write.parquet(f"{path}/month={m}")
    df = readers.read_parquet(spark, path)
    assert dict(df.dtypes) == {"v": "double", "at": "timestamp_ntz", "k": "string", "old": "int", "month": dict(df.dtypes)["month"]}
    got = [tuple(r) for r in df.selectExpr("v", "at", "k", "old", "CAST(month AS string)").orderBy("at").collect()]
    at = lambda m, h=0: dt.datetime(2024, m, 5, h)
    assert got == [(1.0, at(1), "a", 7, "2024-01"), (2.5, at(2, 6), "b", None, "2024-02"), (3.0, at(3), "c", 8, "2024-03"), (4.0, at(4), "9", None, "2024-04")]
    assert "column v" in caplog.text and "read as double" in caplog.text
    pruned = readers.read_parquet(spark, path, ["v"])._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<v:" in pruned and "k:string" not in pruned


def test_month_sink_reads_its_input_once(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([("2024-01-15", 1), ("2024-02-15", 1)], "s string, v int").select(F.col("s").cast("timestamp_ntz").alias("start_local"), "v")
    sinks.write_months(rows, path)
    reads = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    once = rows.filter("v = 1").mapInArrow(count, rows.schema)
    assert sinks.write_months(once, path, ["2024-02", "2024-03"]) == ["2024-02"] and reads.value == 2
    assert sinks.write_months(rows.filter("v = 2"), path, ["2024-02"]) == []


def test_table_is_put_back_after_a_broken_swap(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.build_table(spark.range(5), path, ["id"])
    (tmp_path / "t").rename(tmp_path / "t__replaced")
    broken = spark.range(3).select(F.raise_error(F.lit("lost")).cast("long").alias("id"))
    with pytest.raises(Exception, match="lost"):
        sinks.build_table(broken, path, ["id"])
    assert spark.read.parquet(path).count() == 5 and not sinks.restore_table(spark, path)
    sinks.build_table(spark.range(3), path, ["id"])
    assert spark.read.parquet(path).count() == 3 and not (tmp_path / "t__replaced").exists()
