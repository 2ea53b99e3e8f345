import datetime as dt

import pytest
from pyspark.sql import functions as F

from gridspark.operators import asof, quality
from gridspark.functions import timeconv as T


def posts(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, s string").select(
        "doc_id", F.col("s").cast("timestamp_ntz").alias("post_time_utc"))


def days(spark, *ds):
    return spark.createDataFrame([(dt.date.fromisoformat(d),) for d in ds], "operating_date date")


def picks(spark, texts, *ds, **kw):
    out = asof.select_vintages(posts(spark, texts), days(spark, *ds), **kw).collect()
    return {(str(r.operating_date), r.vintage): r.post_time_utc.strftime("%m-%d %H:%M") for r in out}


def test_strict_and_previous_day(spark):
    got = picks(spark, ["2024-07-13 14:30", "2024-07-13 15:30", "2024-07-14 14:30", "2024-07-14 15:00"], "2024-07-15")
    assert got == {("2024-07-15", "dam"): "07-14 14:30", ("2024-07-15", "prev"): "07-13 14:30"}


def test_max_age_and_missing(spark):
    assert set(picks(spark, ["2024-07-08 14:59"], "2024-07-15")) == {("2024-07-15", "prev")}
    assert set(picks(spark, ["2024-07-08 15:00"], "2024-07-15")) == {("2024-07-15", "dam"), ("2024-07-15", "prev")}
    assert picks(spark, ["2024-07-07 14:59"], "2024-07-15") == {}
    assert picks(spark, ["2024-07-20 10:00"], "2024-07-15") == {}


def test_previous_target_is_24_absolute_hours(spark):
    hourly = [f"2024-03-{d:02d} {h:02d}:30" for d in (8, 9, 10) for h in range(24)]
    got = picks(spark, hourly, "2024-03-11")
    assert got[("2024-03-11", "dam")] == "03-10 14:30" and got[("2024-03-11", "prev")] == "03-09 14:30"  # 08:30 standard time
    hourly = [f"2024-11-{d:02d} {h:02d}:30" for d in (1, 2, 3) for h in range(24)]
    assert picks(spark, hourly, "2024-11-04")[("2024-11-04", "prev")] == "11-02 15:30"  # 10:30 daylight time


def test_tie_takes_highest_id_and_dates_share_documents(spark):
    rows = asof.select_vintages(posts(spark, ["2024-07-14 14:30", "2024-07-14 14:30"]), days(spark, "2024-07-15")).collect()
    assert [r.doc_id for r in rows] == [1]
    many = [f"2024-06-{d:02d} 14:30" for d in range(1, 31)]
    span = [f"2024-06-{d:02d}" for d in range(5, 26)]
    out = asof.select_vintages(posts(spark, many), days(spark, *span))
    assert out.count() == 42 and out.select("doc_id").distinct().count() == 22


def test_future_rows_do_not_change_the_past(spark):
    base = [f"2024-06-{d:02d} {h:02d}:10" for d in range(1, 10) for h in (3, 14, 20)]
    before = picks(spark, base, "2024-06-05", "2024-06-08")
    after = picks(spark, base + ["2024-06-07 15:00", "2024-06-20 00:00"], "2024-06-05", "2024-06-08")
    assert before == after


@pytest.mark.parametrize("strict", [True, False])
def test_general_asof_against_brute_force(spark, strict):
    left = [("a", f"2024-01-{1 + i % 9:02d} {i % 24:02d}:{(i * 7) % 60:02d}") for i in range(120)] + [("b", "2024-01-05 00:00")]
    right = [("a", f"2024-01-{1 + (i * 3) % 8:02d} {(i * 5) % 24:02d}:{(i * 7) % 60:02d}", i) for i in range(40)]
    l = spark.createDataFrame(left, "k string, s string").select("k", F.col("s").cast("timestamp_ntz").alias("at"))
    r = spark.createDataFrame(right, "k string, s string, v int").select("k", F.col("s").cast("timestamp_ntz").alias("rt"), "v")
    got = sorted((x.k, x["at"], x.rt) for x in asof.asof_join(l, r, ["k"], "at", "rt", ["v"], strict=strict, tie=["v"]).collect())
    rs = [(k, dt.datetime.fromisoformat(s)) for k, s, _ in right]
    want = []
    for k, s in left:
        at = dt.datetime.fromisoformat(s)
        best = [t for kk, t in rs if kk == k and (t < at if strict else t <= at)]
        want.append((k, at, max(best) if best else None))
    assert got == sorted(want, key=lambda x: (x[0], x[1], x[2] or dt.datetime.min)) or sorted(map(str, got)) == sorted(map(str, want))


def test_guards(spark):
    df = spark.createDataFrame([("2024-07-15", "dam", "2024-07-14 14:59"), ("2024-07-15", "dam", "2024-07-14 15:00"), ("2024-07-15", "prev", None)],
                               "d string, vintage string, p string").select(
        F.col("d").cast("date").alias("operating_date"), "vintage", F.col("p").cast("timestamp_ntz").alias("publish_time"))
    bad = quality.vintage_violations(df)
    assert bad.count() == 2
    with pytest.raises(quality.LeakageError):
        quality.assert_none(bad, "vintage")
    quality.assert_none(bad.filter("1 = 0"), "vintage")
    soft = quality.violations(df, "x", F.col("publish_time"), T.cutoff_utc("operating_date"), null_is_bad=False)
    assert soft.count() == 1
    with pytest.raises(AssertionError):
        quality.assert_unique(df, ["operating_date"])
