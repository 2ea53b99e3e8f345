import pytest
from pyspark.sql import functions as F

from gridspark.functions import stats as S
from gridspark.plans import evaluate as E
from gridspark.plans import scoring as M


def scalar(spark, c):
    return spark.range(1).select(c).first()[0]


def test_pinball_and_pass_at_k(spark):
    assert scalar(spark, S.pinball(F.lit(100.0), F.lit(0.0), 0.9)) == pytest.approx(90)
    assert scalar(spark, S.pinball(F.lit(-100.0), F.lit(0.0), 0.9)) == pytest.approx(10)
    p = lambda n, c, k: scalar(spark, S.pass_at_k(F.lit(n), F.lit(c), k))
    assert (p(10, 0, 1), p(10, 10, 5)) == (0.0, 1.0)
    assert p(10, 3, 1) == pytest.approx(0.3) and p(10, 1, 5) == pytest.approx(0.5)


def test_rewards(spark):
    r = lambda m, b, ok=True, re=False, scale=None: scalar(spark, M.percentile_reward(
        F.lit(m), F.lit(b), F.lit(ok), F.lit(re), F.lit(scale) if scale else None))
    assert r(100.0, 100.0) == 0 and r(0.0, 100.0) == 1 and r(900.0, 100.0) == -1 and r(1.0, 1.0, ok=False) == -1
    assert r(100.0, 100.0, re=True) == pytest.approx(-0.1) and r(900.0, 100.0, re=True) == -1
    assert -1 <= r(1.0, 0.0) < 0  # floor keeps tiny baselines finite
    assert r(90.0, 100.0, scale=50.0) == pytest.approx(0.2) and r(0.0, 5000.0, scale=10.0) == 1


def test_scale_rewards_direction(spark):
    rows = [("calm", 10.0), ("wild", 2500.0)]
    base = spark.createDataFrame([(f"{n}{s}", y, -800.0, 0.0, 800.0) for n, y in rows for s in ("_half", "_wide", "_one")],
                                 "id string, y double, p10 double, p50 double, p90 double")
    scales = spark.createDataFrame([(f"{n}{s}", k) for n, _ in rows for s, k in (("_half", 0.5), ("_wide", 2.5), ("_one", 1.0))] + [("none", None)],
                                   "id string, scale double")
    got = {r.id: r.reward for r in M.scale_rewards(base, scales).collect()}
    assert got["calm_half"] > 0 > got["wild_half"] and got["wild_wide"] > 0 and got["calm_one"] == got["wild_one"] == 0


def match(spark, kind, want, got, tol=0.0, tz="UTC", ordered=False):
    arr = lambda xs: F.array(*[F.lit(x).cast("string") for x in xs])
    return scalar(spark, M.answer_matches(F.lit(kind), arr(want), arr(got), F.lit(tol), F.lit(0.0), F.lit(tz), F.lit(ordered)))


def test_answers(spark):
    assert match(spark, "number", ["12.34"], ["12.345"], 0.01) and not match(spark, "number", ["12.34"], ["12.36"], 0.01)
    assert match(spark, "number", ["1234.5"], ["$1,234.50"]) and not match(spark, "number", ["1"], [None])
    assert match(spark, "integer", ["96"], ["96.0"]) and not match(spark, "integer", ["96"], ["96.5"])
    assert match(spark, "category", ["LZ_NORTH"], [" lz_north "])
    assert match(spark, "timestamp", ["2024-07-01 15:00"], ["2024-07-01 15:00:00"])
    assert match(spark, "timestamp", ["2024-07-01 15:00"], ["2024-07-01T10:00:00-05:00"])
    assert match(spark, "timestamp", ["2024-07-01 10:00"], ["2024-07-01T15:00:00Z"], tz="America/Chicago")
    assert not match(spark, "timestamp", ["2024-07-01 15:00"], ["2024-07-01 10:00:00"])
    days = ["2024-01-02", "2024-01-05"]
    assert match(spark, "list", days, days[::-1]) and not match(spark, "list", days, days[::-1], ordered=True)
    assert not match(spark, "list", days, days[:1]) and not match(spark, "list", days, [days[0]] + days)


def test_outcomes(spark):
    def outcome(kind="integer", sql=True, ran=True, cols=1, rows=1, cut=False, ok=True):
        return scalar(spark, M.answer_outcome(*[F.lit(x) for x in (kind, sql, ran, cols, rows, cut, ok)]))
    assert outcome() == "correct" and outcome(ok=False) == "wrong_answer" and outcome(ran=False) == "sql_error"
    assert outcome(sql=False) == outcome(cols=2) == outcome(rows=2) == outcome("list", cut=True) == "format_error"
    assert outcome("list", rows=5) == "correct"


def test_report_smoke(spark):
    outs = {"a": ["correct"] * 5, "b": ["correct", "wrong_answer", "sql_error", "format_error", "wrong_answer"]}
    rows = [(t, "t", "f", 1, "s", i, "m", "b", o, {"correct": 1.0, "format_error": -0.2}.get(o, 0.0), 1.0, 10, None)
            for t, os in outs.items() for i, o in enumerate(os)]
    df = spark.createDataFrame(rows, "task_id string, template_id string, family string, difficulty int, split string, sample_idx int, "
                                     "model string, backend string, outcome string, reward double, latency_s double, output_tokens int, cost_usd double")
    out = {r.group_type: r for r in E.report(df).collect()}
    assert set(out) == {"overall", "family", "difficulty", "template"}
    o = out["overall"]
    assert (o.tasks, o.samples, o.k_min, o.pass_10, o.total_cost_usd) == (2, 10, 5, None, None)
    assert o.pass_1 == pytest.approx(0.6) and o.pass_5 == 1.0 and o.consistency == 0.5


def test_answer_times_follow_the_answers_zone(spark):
    rows = spark.createDataFrame([("2024-07-01 12:00:00Z", "Europe/Berlin"), ("2024-07-01 12:00:00Z", "UTC"), ("2024-07-01 12:00:00Z", None)], "t string, tz string")
    got = [str(r.m) for r in rows.select(M.as_minute(F.col("t"), F.col("tz")).alias("m")).collect()]
    assert got == ["2024-07-01 14:00:00", "2024-07-01 12:00:00", "2024-07-01 07:00:00"]


def test_theme_masks_join_the_offices_of_a_zone(spark):
    import datetime as dt

    from gridspark.constants import THEMES
    from gridspark.plans import evaluate as E
    at = dt.datetime(2024, 3, 4, 6)
    rows = [("x", at, 1, "Thunderstorm and HAIL"), ("y", at, 2, "all quiet"), ("y", at + dt.timedelta(days=1), 3, "hurricane"), ("z", at, 4, None), ("z", at, 5, "  ")]
    posts = spark.createDataFrame(rows, "office string, issued_utc timestamp_ntz, doc_id long, reasoning_text string")
    days = spark.createDataFrame([(z, o, dt.date(2024, 3, d)) for z, o in (("both", "x"), ("both", "y"), ("none", "z")) for d in (1, 5, 8)],
                                 "zone string, office string, day date")
    got = {(r.zone, r.day.day): {k for i, k in enumerate(THEMES) if r.themes >> i & 1} for r in E.theme_masks(days, posts).collect()}
    assert got == {("both", 5): {"storms", "severe", "quiet"}, ("both", 8): {"storms", "severe", "tropical"}}


def test_scaled_reward(spark):
    from pyspark.sql import functions as F

    from gridspark.plans import scoring as M
    rows = [(90.0, 100.0, 50.0, True, False), (90.0, 100.0, 50.0, True, True), (100.0, 100.0, 50.0, True, False), (900.0, 100.0, 50.0, True, True),
            (0.0, 1000.0, 50.0, True, False), (90.0, 100.0, 0.0, True, False), (90.0, 100.0, None, True, False), (90.0, 100.0, 50.0, False, False)]
    df = spark.createDataFrame(rows, "m double, b double, s double, ok boolean, swapped boolean")
    got = [r[0] for r in df.select(M.percentile_reward(*map(F.col, ("m", "b", "ok", "swapped", "s")))).collect()]
    assert [round(x, 6) for x in got] == [0.2, 0.1, 0.0, -1.0, 1.0, 0.1, 0.1, -1.0]


def test_prompt_variants(spark):
    import datetime as dt
    from gridspark.plans import features as X
    hours = "zone string, operating_date date, hour_ending int, p10 double, p50 double, p90 double, fc_inuse double, fc_min double, fc_max double, " \
            "inuse_minus_median double, revision double, n_models int, inuse_model string, fc_visible boolean, temp_c double, dewpoint_c double, " \
            "cloud_cover_pct double, temp_spread_c double, is_peak_season boolean, sys_peak_ratio double, err_lag2 double, err_mean7 double, err_mae7 double, err_mae30 double"
    day, plain = dt.date(2024, 7, 9), dt.date(2024, 3, 10)
    row = (-900.0, 50.0, 1100.0, 12345.0, 12000.0, 13000.0, 10.0, None, 3, "m1", True, 35.0, 20.0, 40.0, 1.0, True, 0.983, -0.4, 5.0, 6.0, None)
    blind = (*row[:10], False, None, None, None, None, False, None, 1.0, 2.0, 3.0, 4.0)
    df = spark.createDataFrame([("coast", day, 17, *row), ("coast", day, 16, *row), ("west", plain, 16, *blind)], hours)
    sources = spark.createDataFrame(
        [("coast", day, 1, "CRP", dt.datetime(2024, 7, 8, 3, 0), "second"), ("coast", day, 0, "HGX", dt.datetime(2024, 7, 8, 9, 0), "first"),
         ("coast", day, 2, "X", dt.datetime(2024, 7, 8, 9, 0), None)],
        "zone string, operating_date date, place int, office string, issued_utc timestamp_ntz, prompt_text string")
    got = {k: {r.zone: r.prompt for r in X.prompt_lines(df, k, sources).collect()} for k in ("full", "numeric", "text")}
    full = got["full"]["coast"].split("\n")
    assert full[:2] == ["Zone: Coast (Houston)", "Operating day: a Tuesday in July"]
    assert full[2] == ("HE | forecast MW | model range (3 models) | in use minus median | revision | temp F | dewpoint F | cloud % | temp spread F | "
                       "stat p10 / p50 / p90")
    assert full[3] == "16 | 12,345 | 12,000 .. 13,000 | +10 | n/a | 95 | 68 | 40 | 1.8 | -900 / +50 / +1,100" and full[4].startswith("17 | ")
    assert full[5:8] == ["Model in use: m1", "Summer peak season: the system's forecast peak is 98% of its highest recent load; large users may curtail",
                         "Errors through two days ago: latest day -0, -0; 7-day mean +5, mean absolute 6; 30-day mean absolute n/a"]
    assert [x for x in full if x in ("first", "second")] == ["first", "second"] and "office X" not in got["full"]["coast"]
    assert full[-1] == "Predict the error distribution for hours 16, 17"
    assert got["numeric"]["coast"] == "\n".join(full[:8] + full[-1:])
    assert got["text"]["coast"] == "\n".join(full[:2] + ["HE | stat p10 / p50 / p90", "16 | -900 / +50 / +1,100", "17 | -900 / +50 / +1,100"] + full[8:])
    assert got["full"]["west"].split("\n") == [
        "Zone: West (Abilene/San Angelo)", "Operating day: a Sunday in March (clock-change day)", "HE | stat p10 / p50 / p90", "16 | -900 / +50 / +1,100",
        "Errors through two days ago: latest day +1; 7-day mean +2, mean absolute 3; 30-day mean absolute 4", "Predict the error distribution for hours 16"]


def test_text_sources_take_the_zone_offices_in_order(spark):
    import datetime as dt
    from gridspark.plans import features as X
    day = dt.date(2024, 7, 9)
    days = spark.createDataFrame([("coast", day), ("nowhere", day)], "zone string, operating_date date")
    at = lambda d, h, m=0: dt.datetime(2024, 7, d, h, m)
    # the cutoff of the day is fixed in UTC by the market clock; anything of the same evening is too late
    bulletins = spark.createDataFrame(
        [("HGX", 1, at(7, 3), "a"), ("HGX", 2, at(8, 3), "b"), ("HGX", 3, at(8, 23), "late"), ("CRP", 4, at(6, 1), "c"), ("CRP", 5, at(8, 1), " "), ("MAF", 6, at(8, 1), "x")],
        "office string, doc_id long, issued_utc timestamp_ntz, reasoning_text string")
    found = X.text_sources(days, bulletins, "doc_id")
    out = {r.zone: r.sources for r in X.attach_provenance(days, found).collect()}
    assert [(s.office, s.issued_utc) for s in out["coast"]] == [("HGX", at(8, 3)), ("CRP", at(6, 1))] and out["nowhere"] is None


def test_flags_of_equal_mean_and_limit_do_not_hang_on_the_order_of_rows(spark):
    import datetime as dt
    from gridspark.plans import features as X
    ranges = [0.2, 0.2, 0.7, 0.1, 0.3]  # their mean is 0.3, which a sum of doubles misses in some orders
    day = dt.date(1998, 3, 2)
    # the other days put the median at 0.3
    errors = [0.1] * 5
    rows = [("A", day, h, "train", r, e) for h, r, e in zip(range(16, 21), ranges, errors, strict=True)]
    rows += [("A", day + dt.timedelta(days=d), h, "train", 0.3, 0.1) for d in range(1, 8) for h in range(16, 21)]
    flags = set()
    for turn in range(5):
        turned = spark.createDataFrame(rows[turn:5] + rows[:turn] + rows[5:], "zone string, operating_date date, hour_ending int, split string, fc_range double, error double")
        full = turned.coalesce(1).withColumns({**{q: F.lit(1.0) for q in ("p10", "p50", "p90")}, "inuse_model": F.lit("m1")})
        flags |= {r.models_agreed for r in X.build_examples(full, "climate").filter(F.col("operating_date") == day).collect()}
    assert flags == {True}
