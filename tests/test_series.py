"""Windows, folds, patterns and likeness on hand-made series."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions import shapes
from strandline.operators import folds, levels, patterns, similarity, validation, windows


def bars(spark, closes, symbol="a", half=0.0):
    rows = [(symbol, i, c, c * (1 + half), c * (1 - half), c, 1000) for i, c in enumerate(map(float, closes))]
    return spark.createDataFrame(rows, "symbol string, idx int, open double, high double, low double, close double, volume long")


def piecewise(*legs):
    out = []
    for a, b, n in legs:
        out += np.linspace(a, b, n).tolist()[1 if out else 0 :]
    return out


def test_atr_of_short_series(spark):
    rows = [("a", 0, 11.0, 9.0, 10.0)]
    df = spark.createDataFrame(rows, "symbol string, idx int, high double, low double, close double")
    assert windows.atr(df).collect()[0]["atr"] == 2.0
    assert windows.atr(df.limit(0)).count() == 0


def test_vol_scale_has_a_floor(spark):
    df = bars(spark, np.linspace(100, 120, 500), half=1e-9)
    assert windows.vol_scale(df).collect()[0]["vol_scale"] == pytest.approx(0.2)


def test_zones_are_gaps_and_islands(spark):
    points = spark.createDataFrame([("a", i, True, p) for i, p in enumerate([100.0, 100.2, 110.0, 110.1, 130.0])], "symbol string, idx int, is_high boolean, price double")
    scale = spark.createDataFrame([("a", 1.0)], "symbol string, vol_scale double")
    found = sorted((round(r["price"], 2), r["touches"]) for r in levels.zones(points, scale).collect())
    assert found == [(100.1, 2), (110.05, 2)]


def test_double_top_and_no_repaint(spark):
    closes = piecewise((100, 120, 15), (120, 110, 8), (110, 120, 8), (120, 104, 12))
    df = bars(spark, closes)
    lines = windows.normalised(df).select("symbol", "idx", "y", "close")
    top = patterns.double_extremes(lines, windows.pivots(lines, 5, "y", "y")).collect()
    assert len(top) == 1 and (top[0]["i"], top[0]["j"]) == (14, 28)
    cand = spark.createDataFrame([("a", 28, 110.0, 10.0, False)], "symbol string, from_idx int, level double, height double, up boolean")
    done = patterns.confirm(df, cand).collect()[0]
    assert done["state"] == "confirmed" and done["confirmed_at"] == done["breakout"] + 1
    cut = patterns.confirm(df.where(f"idx < {done['confirmed_at']}"), cand).collect()[0]
    assert cut["state"] == "pending" and cut["breakout"] == done["breakout"]


def test_confirm_falls_back(spark):
    df = bars(spark, [10, 10, 12, 5, 5])
    cand = spark.createDataFrame([("a", 0, 11.0, 2.0, True), ("a", 0, 99.0, 2.0, True)], "symbol string, from_idx int, level double, height double, up boolean")
    assert sorted(r["state"] for r in patterns.confirm(df, cand).collect()) == ["invalidated", "none"]


def _line_rows(spark, y):
    return spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(y)], "symbol string, idx int, y double")


def test_zigzag_finds_turns_and_leaves_the_last_leg(spark):
    y = piecewise((0, 1, 20), (1, 0.2, 20), (0.2, 0.9, 20), (0.9, 0.1, 20))
    found = sorted((r["idx"], r["is_high"]) for r in folds.zigzag_pivots(_line_rows(spark, y)).collect())
    assert found == [(19, True), (38, False), (57, True)]
    assert folds.zigzag_pivots(_line_rows(spark, piecewise((0, 1, 4), (1, 0, 5)))).count() == 0  # under 11 bars


def test_touches_and_breakouts(spark):
    off, beyond = [0.0, 0.2, 9.0, 0.4, 0.1, 9.0, 9.0, 0.3, 9.0], [0.0, 2.0, 3.0, 0.0, 2.0, 2.0, 2.0, 2.0, 0.0]
    df = spark.createDataFrame([(off, beyond)], "off array<double>, beyond array<double>")
    r = df.select(folds.touches(F.col("off"), F.lit(0.5), F.lit(2)).alias("t"), folds.breakouts(F.col("beyond"), F.lit(1.0), F.lit(2)).alias("b")).first()
    assert r["t"] == [0, 4, 7] and r["b"] == 3


def test_merged_levels(spark):
    rows = [("a", True, 10.0, 2, 1, 5, 0.5), ("a", True, 10.2, 4, 0, 9, 0.4), ("a", False, 10.1, 1, 2, 2, 0.3), ("a", True, 20.0, 1, 3, 3, 0.9)]
    levels_df = spark.createDataFrame(rows, "symbol string, is_high boolean, price double, touches int, first_touch int, last_touch int, strength double")
    scale = spark.createDataFrame([("a", 1.0)], "symbol string, vol_scale double")
    got = sorted((r["price"], r["is_high"], r["touches"], r["first_touch"], r["last_touch"], round(r["strength"], 6)) for r in folds.merge_levels(levels_df, scale).collect())
    assert got == [(10.0, True, 4, 0, 9, 0.9), (10.1, False, 1, 2, 2, 0.3), (20.0, True, 1, 3, 3, 0.9)]


def test_dtw_equals_plain_loops():
    draw = np.random.default_rng(1)
    a, b, band = draw.random((3, 12)), draw.random(12), 4
    for row, got in zip(a, similarity.dtw(a, b, band), strict=True):
        d = np.full((13, 13), np.inf)
        d[0, 0] = 0
        for i in range(1, 13):
            for j in range(max(1, i - band), min(12, i + band) + 1):
                d[i, j] = (row[i - 1] - b[j - 1]) ** 2 + min(d[i - 1, j], d[i, j - 1], d[i - 1, j - 1])
        assert got == pytest.approx(np.sqrt(d[12, 12] / 12))


def test_dedup_depends_on_order(spark):
    rows = [("a", "1h", 80.0, 1), ("a", "4h", 78.0, 2), ("a", "1d", 60.0, 3), ("a", "1h", 90.0, 4)]
    kept = similarity.dedup_matches(spark.createDataFrame(rows, "symbol string, timeframe string, score double, ord int")).collect()
    assert sorted((r["timeframe"], r["score"]) for r in kept) == [("1d", 60.0), ("1h", 90.0)]


def test_labels_are_taken_once(spark):
    events = spark.createDataFrame([("a", "top", 10), ("a", "top", 11), ("b", "top", 50)], "symbol string, pattern_type string, idx int")
    labels = spark.createDataFrame([("a", "top", 9, 12), ("b", "low", 50, 51)], "symbol string, pattern_type string, start int, end int")
    got = {r["symbol"]: (r["tp"], r["fp"], r["fn"]) for r in validation.match_events(events, labels).collect()}
    assert got == {"a": (1, 1, 0), "b": (0, 1, 1)}


def test_preset_lines_interpolate(spark):
    line = spark.range(1).select(shapes.through([(0.2, 0.0), (0.8, 1.0)]).alias("v")).first()["v"]
    x = np.linspace(0, 1, 100)
    assert np.allclose(line, np.interp(x, [0.2, 0.8], [0.0, 1.0]))


def test_partitions_do_not_matter(spark):
    df = bars(spark, np.random.default_rng(3).random(80) + 1, half=0.01)
    a = windows.pivots(df.repartition(1)).collect()
    b = windows.pivots(df.repartition(7)).collect()
    assert sorted(a) == sorted(b)
    assert folds.trend_levels(df.withColumn("open_time", F.col("idx"))).columns == ["symbol", "is_high", "slope", "intercept", "touches", "breakouts", "quality"]


def test_trend_lines_work_out_each_line_once(spark, sf_dir, capsys):
    """A fold in a filter holds the expressions of the arrays it reads, which are then made anew at each of its steps."""
    from strandline.sources.series import event_bars, latest

    folds.trend_lines(latest(event_bars(spark, sf_dir))).explain()
    filters = [x for x in capsys.readouterr().out.splitlines() if "Filter " in x]
    assert filters and not [x for x in filters if "aggregate(" in x]
