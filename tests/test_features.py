"""Array scores against numpy, and the cases in which a score has a fixed value."""

import numpy as np
from pyspark.sql import functions as F

from strandline.operators import features, packed


def _stretch(a, n):
    return np.interp(np.linspace(0, 1, n), np.linspace(0, 1, len(a)), a)


def _distance(a, b):
    if not a or not b:
        return 0.3
    n = max(len(a), len(b))
    return 1 / (1 + 8 * np.mean((_stretch(a, n) - _stretch(b, n)) ** 2))


def _pivot(a, b):
    if not a or not b:
        return 0.3
    n = max(len(a), len(b))
    same = like = 0.5
    if n >= 3:
        x, y = np.diff(_stretch(a, n)), np.diff(_stretch(b, n))
        same = np.mean(np.sign(x) == np.sign(y))
        big, small = np.maximum(abs(x), abs(y)), np.minimum(abs(x), abs(y))
        like = np.mean((small / (big + 1e-10))[big > 0.01]) if (big > 0.01).any() else 0.5
    return 0.4 * _distance(a, b) + 0.35 * same + 0.25 * like


def test_array_likeness(spark):
    draw = np.random.default_rng(4)
    rows = [(draw.random(int(draw.integers(0, 9))).tolist(), draw.random(int(draw.integers(0, 9))).tolist()) for _ in range(40)] + [([0.5] * 4, [0.5] * 4), (None, [1.0])]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    for r in df.select("a", "b", features.pivot_likeness(a, b).alias("p"), features.distance_likeness(a, b).alias("d")).collect():
        assert abs(r["p"] - _pivot(r["a"], r["b"])) < 1e-9 and abs(r["d"] - _distance(r["a"], r["b"])) < 1e-9


def _line(spark, y):
    return spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(y)], "symbol string, idx int, y double")


def test_trends_go_stale(spark):
    points = spark.createDataFrame([], "symbol string, idx int, is_high boolean, price double")
    up = features.trends(_line(spark, np.linspace(0, 1, 90)), points).first()
    assert (up["direction"], up["is_active"]) == ("up", True) and up["confidence"] > 0.8
    turned = features.trends(_line(spark, np.r_[np.linspace(0, 1, 60), np.linspace(1, 0.45, 20)]), points).first()
    assert turned["direction"] == "up" and not turned["is_active"]
    flat = features.trends(_line(spark, np.zeros(30)), points).first()
    assert flat["direction"] is None and flat["confidence"] == 0 and flat["is_active"]


def test_scores_without_pivots(spark):
    points = spark.createDataFrame([], "symbol string, idx int, is_high boolean, price double")
    assert features.quality(_line(spark, np.linspace(0, 1, 30)), points).first()["quality"] == 0
    assert features.geometry(points).count() == 0


def test_small_swings_go_by_the_range(spark):
    y = [0.0, 0.2, 0.1, 0.9, 1.0, 0.95, 0.97, 0.5]
    marks = [(0, False), (4, True), (5, False), (6, True), (7, False)]
    df = spark.createDataFrame([(y, marks)], "y array<double>, m array<struct<idx: int, is_high: boolean>>")
    got = df.select(packed.without_small(F.col("m"), F.col("y")).alias("m")).first()["m"]
    assert [tuple(m) for m in got] == [(0, False), (4, True), (7, False)]
