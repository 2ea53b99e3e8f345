import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from gridspark.functions import timeconv as T
from gridspark.operators import blocks, intervals, reshape, sampling
from gridspark.plans import baselines as B
from gridspark.plans import features as X
from gridspark.plans import money as R
from gridspark.plans import storage as S


def series(spark, values, start="2024-01-30 00:00"):
    rows = [("p", i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "point string, i int, price double")
    return T.add_time_columns(df.withColumn("start_utc", F.lit(start).cast("timestamp_ntz") + T.minutes(F.col("i") * 15)), "start_utc", 15).withColumn(
        "month", T.month_key("operating_date"))


def test_spike_crossing_a_month_counts_once(spark):
    n = 96 * 4
    edge = 24 + 96 * 2  # local midnight of February 1st
    values = [100.0 if edge - 2 <= i < edge + 2 or i in (5, 300, 301) else 0.0 for i in range(n)]
    out = intervals.spike_counts(series(spark, values), ["point"], "start_utc", "operating_date", "price", [50.0], [1, 2, 4]).collect()
    got = {(r.month, r.min_length): r.events for r in out}
    assert got == {("2024-01", 1): 2, ("2024-01", 2): 1, ("2024-01", 4): 1, ("2024-02", 1): 1, ("2024-02", 2): 1}


def test_runs_and_gaps_against_brute_force(spark):
    rnd = random.Random(3)
    values = [rnd.choice([0.0, 30.0, 60.0, None]) for _ in range(400)]
    df = series(spark, values)
    runs = {(r.month, r.threshold): r.longest for r in intervals.longest_runs(df, ["point", "month"], "start_utc", "price", [25.0, 50.0]).collect()}
    rows = df.orderBy("start_utc").collect()
    for month in {r.month for r in rows}:
        for x in (25.0, 50.0):
            best = cur = 0
            for r in rows:
                if r.month == month:
                    cur = cur + 1 if r.price is not None and r.price >= x else 0
                    best = max(best, cur)
            assert runs.get((month, x), 0) == best
    kept = [i for i in range(400) if rnd.random() < 0.6]
    part = df.filter(F.col("i").isin(kept))
    want = [(b - a) * 15 for a, b in zip(kept, kept[1:]) if b - a > 1]
    assert sorted(r.gap_minutes for r in intervals.gaps(part, ["point"], "start_utc", 15).collect()) == sorted(want)


@pytest.mark.parametrize("prices,eff,best", [([10, 20, 30], 1.0, 20.0), ([10, 10, 50, 50], 1.0, 80.0), ([50, 10], 1.0, 0.0), ([0, 100], 0.9, 90.0)])
def test_two_hour_value(spark, prices, eff, best):
    arr = F.array(*[F.lit(float(p)) for p in prices])
    assert spark.range(1).select(S.two_hour_value(arr, eff)).first()[0] == pytest.approx(best)


def history(spark, n=120, seed=1):
    rnd = random.Random(seed)
    rows = [(z, dt.date(2024, 1, 1) + dt.timedelta(days=d), h, rnd.gauss(0, 100)) for z in "AB" for h in (16, 17) for d in range(n)]
    return rows, spark.createDataFrame(rows, "zone string, operating_date date, hour_ending int, error double")


def test_causality(spark):
    rows, df = history(spark, 60)
    changed = df.withColumn("error", F.when(F.col("operating_date") == F.lit(dt.date(2024, 2, 9)), 1e6).otherwise(F.col("error")))
    for fn in (X.recent_errors, lambda d: B.trailing_quantiles(d, 30, 5)):
        a = {(r.zone, r.hour_ending, r.operating_date): r for r in fn(df).collect()}
        b = {(r.zone, r.hour_ending, r.operating_date): r for r in fn(changed).collect()}
        cols = [c for c in next(iter(a.values())).asDict() if c not in ("error",)]
        differ = {k[2] for k in a if any(a[k][c] != b[k][c] for c in cols)}
        assert min(differ) == dt.date(2024, 2, 11)  # visible two days later, not before


def test_calibrated_coverage(spark):
    _, df = history(spark, 500, seed=7)
    narrow = df.select(*X.KEY).withColumns({"p10": F.lit(-20.0), "p50": F.lit(0.0), "p90": F.lit(20.0)})
    out = B.apply_adjustment(narrow, B.conformal_adjustment(narrow, df)).join(df, X.KEY)
    cover = out.select(F.avg(((F.col("error") >= F.col("p10")) & (F.col("error") <= F.col("p90"))).cast("double"))).first()[0]
    assert abs(cover - 0.8) < 0.06


def test_forest_width_follows_the_spread(spark):
    rnd = random.Random(5)
    rows = []
    for d in range(700):
        s = rnd.uniform(10, 200)
        rows.append(("A", dt.date(2022, 1, 1) + dt.timedelta(days=d), 16, s, rnd.gauss(0, s)))
    df = spark.createDataFrame(rows, "zone string, operating_date date, hour_ending int, spread double, error double")
    tr, te = df.filter("operating_date < '2023-06-01'"), df.filter("operating_date >= '2023-06-01'")
    pred = B.quantile_forest(tr, te, ["spread"], ["A"], trees=10, depth=4).join(te, X.KEY).withColumn("w", F.col("p90") - F.col("p10"))
    corr, cover = pred.select(F.corr("w", "spread"), F.avg(F.col("error").between(F.col("p10"), F.col("p90")).cast("double"))).first()
    assert corr > 0.7 and 0.68 < cover < 0.92


def test_leaf_lookup_equals_quantiles_of_the_leaves(spark):
    """The row-local table against exact quantiles of each leaf's training errors, within the width of a bin."""
    from pyspark.ml.functions import vector_to_array
    rnd = random.Random(3)
    rows = [("A", dt.date(2022, 1, 1) + dt.timedelta(days=d), 16, float(d % 9), rnd.gauss(0, 50) + 30 * (d % 9)) for d in range(600)]
    df = spark.createDataFrame(rows, "zone string, operating_date date, hour_ending int, spread double, error double")
    x = B._features(df, ["spread"], ["A"])
    model = B._forest(x, "error", 5, 3, 20, 0, None)
    table = spark.range(1).select(B.leaf_quantiles(model, x).alias("t")).first().t
    by_leaf = {}
    for r in model.transform(x).select("error", vector_to_array("_leaves").alias("l")).collect():
        for tree, leaf in enumerate(r.l):
            by_leaf.setdefault((tree, int(leaf)), []).append(r.error)
    assert sum(len(t) for t in table) == len(by_leaf)
    for (tree, leaf), errors in by_leaf.items():
        errors.sort()
        for tau, got in zip(B.TAUS, table[tree][leaf], strict=True):
            exact = errors[int(tau * (len(errors) - 1))]
            assert abs(got - exact) <= 0.05 * abs(exact) + 0.05
    assert B.quantile_forest(df, df, ["spread"], ["A"], trees=5, depth=3).count() == 600


def test_time_blocks_follow_even_split(spark):
    for n, k in ((13, 5), (20, 7), (3, 5)):
        days = spark.createDataFrame([(dt.date(2023, 12, 28) + dt.timedelta(days=i),) for i in range(n)], "d date")
        got = [r.block for r in blocks.time_blocks(days, "d", k).orderBy("d").collect()]
        sizes = [n // k + (1 if b < n % k else 0) for b in range(k)]
        assert got == [b for b, s in enumerate(sizes) for _ in range(s)]


def test_dispatch_keeps_its_bounds(spark):
    """Whatever the prices: nothing is sold without a trigger or beyond the capacity, and all of the store goes if capacity allows."""
    rnd = random.Random(11)
    da_rows, rt_rows = [], []
    for d in range(12):
        day = dt.date(2024, 5, 1) + dt.timedelta(days=d)
        da_rows += [("A", day, h, rnd.uniform(5, 120)) for h in range(1, 25)]
        rt_rows += [("A", day, h, q, rnd.uniform(0, 250)) for h in range(1, 25) for q in range(1, 5)]
    da = spark.createDataFrame(da_rows, "point string, operating_date date, hour_ending int, price double")
    rt = spark.createDataFrame(rt_rows, "point string, operating_date date, hour_ending int, quarter int, price double")
    fr = da.select("point", "operating_date").distinct().withColumns({"policy": F.lit("fixed"), "fraction": F.lit(0.8)})
    rows = R.held_back_dispatch(R.day_ahead_awards(da, fr), rt).orderBy("operating_date", "hour_ending", "quarter").collect()
    assert len(rows) == 12 * 96
    price = {(r[1], r[2], r[3]): r[4] for r in rt_rows}
    for day in {r.operating_date for r in rows}:
        mine = [r for r in rows if r.operating_date == day]
        room = 0.0
        for r in mine:
            before = price.get((day, r.hour_ending, r.quarter - 1) if r.quarter > 1 else (day, r.hour_ending - 1, 4))
            triggered = 7 <= r.hour_ending <= 22 and before is not None and before > r.threshold
            room += (20.0 - r.award) / 4 if triggered else 0.0
            assert -1e-9 <= r.extra_mwh <= (20.0 - r.award) / 4 + 1e-9 and (triggered or r.extra_mwh == 0)
        assert sum(r.extra_mwh for r in mine) == pytest.approx(min(room, 39.2 - mine[0].committed))
    settled = R.settle_days(da, rt, fr).collect()
    assert len(settled) == 12
    assert all(r.discharged <= 39.2 + 1e-9 and r.total == pytest.approx(r.da_rev + r.rt_rev - r.charge_cost - r.wear) for r in settled)


def test_a_settled_day_by_hand(spark):
    day = dt.date(2024, 5, 1)
    da = spark.createDataFrame([("A", day, h, 100.0 if h == 20 else 20.0) for h in range(1, 25)], "point string, operating_date date, hour_ending int, price double")
    rt = spark.createDataFrame([("A", day, h, q, 500.0 if (h, q) in ((10, 1), (10, 2)) else 0.0) for h in range(1, 25) for q in range(1, 5)],
                               "point string, operating_date date, hour_ending int, quarter int, price double")
    fr = spark.createDataFrame([("A", day, "fixed", 0.8)], "point string, operating_date date, policy string, fraction double")
    r = R.settle_days(da, rt, fr).first()
    # one hour beats 20 / 0.85 + 10: 16 MWh sold ahead; the prices of 10:1 and 10:2 trigger 10:2 and 10:3, 5 MWh each
    assert (r.da_rev, r.rt_rev, r.discharged) == (pytest.approx(1600.0), pytest.approx(2500.0), pytest.approx(26.0))
    assert r.total == pytest.approx(1600 + 2500 - 26 / 0.85 * 20 - 26 * 10)


def test_commitment_fraction(spark):
    f = lambda w: spark.range(1).select(R.commitment_fraction(F.lit(w), F.lit(100.0))).first()[0]
    assert (f(100.0), f(50.0), f(10000.0), f(0.0), f(None if False else float("nan"))) == (0.8, 1.0, 0.2, 0.8, 0.8)


def test_accounting_identities(spark):
    rows = [("A", dt.date(2024, 1, 1), 5.0, 5.0, 40.0, 99.0, 0.0, 0.0)] * 4
    df = spark.createDataFrame(rows, "point string, operating_date date, award double, output double, da_price double, rt_price double, charge_mwh double, charge_price double")
    exact = R.account(df).first()
    assert exact.total == exact.da_rev == pytest.approx(200) and exact.rt_rev == 0
    idle = R.account(df.withColumns({"award": F.lit(0.0), "output": F.lit(0.0)})).first()
    assert idle.total == 0
    short = R.account(df.withColumn("output", F.lit(0.0))).first()
    assert short.total == pytest.approx(200 - 5 * 99)


def test_sampling(spark):
    ids = [f"t{i}" for i in range(44)]
    a = {r.id for r in sampling.hold_out(spark.createDataFrame([(i,) for i in ids], "id string"), "id", 0.2, "s").collect()}
    b = {r.id for r in sampling.hold_out(spark.createDataFrame([(i,) for i in reversed(ids)], "id string"), "id", 0.2, "s").collect()}
    assert a == b and len(a) == 9
    rows = [(g, f"{g}{i:02d}") for g, n in (("a", 30), ("b", 2), ("c", 1)) for i in range(n)]
    out = [r.k for r in sampling.round_robin(spark.createDataFrame(rows, "g string, k string"), "g", "k", 6).collect()]
    assert sorted(out) == ["a00", "a01", "a02", "b00", "b01", "c00"]


def test_weighted_zone_mean_and_model_counts(spark):
    rows = [("houston_iah", "gfs", "2024-07-16 05:00", 10.0), ("houston_iah", "icon", "2024-07-16 05:00", 11.0), ("galveston", "gfs", "2024-07-16 05:00", None)]
    df = spark.createDataFrame(rows, "point string, model string, s string, temp_c double").withColumn("valid_time_utc", F.col("s").cast("timestamp_ntz"))
    for c in X.WEATHER_COLUMNS[1:]:
        df = df.withColumn(c, F.lit(1.0) if c == "precip_mm" else F.lit(None).cast("double"))
    pts = {r.point: r for r in X.assemble_weather(df).collect()}
    assert pts["houston_iah"].temp_c == 10.5 and pts["houston_iah"].n_models == 2 and pts["galveston"].n_models == 0
    assert (pts["houston_iah"].operating_date, pts["houston_iah"].hour_ending) == (dt.date(2024, 7, 15), 24)
    (z,) = X.zone_weather(X.assemble_weather(df)).collect()
    assert z.zone == "coast" and z.temp_c == pytest.approx(10.5)


def test_row_stats(spark):
    df = spark.createDataFrame([(1.0, None, 3.0), (None, None, 2.0), (None, None, None)], "a double, b double, c double")
    out = df.select(*[c.alias(n) for n, c in reshape.row_stats(["a", "b", "c"]).items()]).collect()
    assert out[0].v_mean == 2 and out[0].v_median == 2 and out[0].v_std == pytest.approx(2 ** 0.5)
    assert out[1].v_std is None and out[1].n_models == 1 and out[2].v_mean is None
