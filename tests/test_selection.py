"""Quantiles by rank selection against sorted lists."""

import math
import random

import pytest

from gridspark.operators.selection import exact_quantiles, ordered_code

QS = [0.0, 0.1, 0.5, 0.9, 1.0]


def plain(values, q):
    h = q * (len(values) - 1)
    low = math.floor(h)
    a, b = values[low], values[min(low + 1, len(values) - 1)]
    return a if h == low or a == b else a + (h - low) * (b - a)


def test_quantiles_equal_sorted_lists(spark):
    rnd = random.Random(5)
    groups = {
        "normal": [rnd.gauss(0, 1e3) for _ in range(3001)], "ties": [float(rnd.randrange(5)) for _ in range(2000)], "one": [7.25],
        "two": [-1.0, 4.0], "wide": [rnd.choice([-1, 1]) * 10.0 ** rnd.uniform(-300, 300) for _ in range(2000)],
        "close": [1.0 + k * 2.0 ** -52 for k in range(1000)], "zeros": [0.0, -0.0, 5e-324, -5e-324, 0.0], "powers": [2.0 ** k for k in range(-60, 60)],
        "infinite": [float("-inf"), 1.0, 2.0, 3.0, float("inf")], None: [1.0, 2.0, 9.0]}
    rows = [(k, x) for k, xs in groups.items() for x in xs] + [("one", None), ("none", None)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, x double").repartition(7)
    got = {r.g: r.quantiles for r in exact_quantiles(df, "x", QS, ["g"]).collect()}
    assert set(got) == set(groups)
    for k, xs in groups.items():
        want = [plain(sorted(xs), q) for q in QS]
        assert got[k] == pytest.approx(want, rel=1e-12, abs=0, nan_ok=True), k  # between infinities there is no number


def test_whole_table_and_empty_table(spark):
    df = spark.range(1001).selectExpr("id * 0.5 AS x")
    assert [r.quantiles for r in exact_quantiles(df, "x", [0.25, 0.5]).collect()] == [[125.0, 250.0]]
    assert exact_quantiles(df.filter("x < 0"), "x", [0.5]).collect() == []


def test_code_never_falls(spark):
    rnd = random.Random(3)
    xs = sorted([rnd.choice([-1, 1]) * 2.0 ** rnd.uniform(-1074, 1023) for _ in range(3000)] + [s * 2.0 ** k * f for s in (-1, 1) for k in range(-50, 50) for f in (
        1, 1 - 2 ** -53, 1 + 2 ** -52)] + [0.0, 5e-324, 1.7976931348623157e308, float("inf"), float("-inf")])
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double")
    codes = [r.c for r in df.select("i", ordered_code(df.x).alias("c")).orderBy("i").collect()]
    assert codes == sorted(codes)
