"""Replay, levels and klines: no look ahead, blocks that do not matter, plain loops, pruned reads."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import level_driver, replay, validation, windows
from strandline.sources import klines
from strandline.sources.series import settled


def _history(spark, n, seed=1, symbols=("a", "b")):
    rows = []
    for s, symbol in enumerate(symbols):
        draw = np.random.default_rng(seed + s)
        y = 50 + np.cumsum(draw.normal(0, 1, n))
        rows += [(symbol, i, i * 60, float(v), float(v + 0.5), float(v - 0.5), float(v), int(draw.integers(1, 9))) for i, v in enumerate(y)]
    kinds = "symbol string, idx int, open_time long, open double, high double, low double, close double, volume long"
    return spark.createDataFrame(rows, kinds).withColumn("open_time", F.col("open_time").cast("timestamp").cast("timestamp_ntz"))


def test_steps_are_all_windows_whatever_the_blocks(spark):
    bars = _history(spark, 37)
    closes = {s: [r["close"] for r in sorted(bars.where(F.col("symbol") == s).collect(), key=lambda r: r["idx"])] for s in "ab"}
    for chunk in (3, 10, 400):
        got = {(r["symbol"], r["step"]): [b["close"] for b in r["bars"]] for r in replay.steps(bars, 12, chunk=chunk).collect()}
        assert got == {(s, i): c[i - 11 : i + 1] for s, c in closes.items() for i in range(11, 37)}
    assert replay.steps(bars.where("idx < 11"), 12).count() == 0 and replay.steps(bars.limit(0), 12).count() == 0


def test_replay_sees_no_later_bar(spark):
    """What a step says does not change when the series ends there, and all of it lies before it."""
    bars = _history(spark, 75)
    columns = ("symbol", "step", "type", "state", "way", "is_active", "candidate_at", "confirmed_at")
    rows = lambda df: {tuple(r[c] for c in columns) for r in replay.replay_structures(df, 60, settle=settled).collect()}
    whole, cut = rows(bars), rows(bars.where("idx < 66"))
    assert len(whole) == 2 * 16 and {r for r in whole if r[1] < 66} == cut
    for r in whole:
        assert r[6] is None or r[1] - 59 <= r[6] <= r[1]
        assert (r[3] == "confirmed") == (r[7] is not None) == bool(r[5]) and (r[7] is None or r[6] < r[7] <= r[1])


def test_changes(spark):
    said = [("a", 0, None), ("a", 1, None), ("a", 2, "x"), ("a", 3, "x"), ("a", 4, "y"), ("b", 0, "x"), ("b", 1, None)]
    rows = spark.createDataFrame(said, "symbol string, step int, type string")
    assert sorted((r["symbol"], r["step"]) for r in replay.changes(rows, "type").collect()) == [("a", 0), ("a", 2), ("a", 4), ("b", 0), ("b", 1)]


def test_totals_against_loops(spark):
    draw = np.random.default_rng(4)
    said = [(s, t, i, [None, "up", "down"][int(draw.integers(3))], bool(draw.integers(2))) for s in "ab" for t in ("4h", "8h") for i in range(40)]
    rows = spark.createDataFrame(said, "symbol string, timeframe string, step int, type string, is_active boolean")
    labels = [(s, t, ["up", "down"][k % 2], k * 9, k * 9 + 2) for s in "ab" for t in ("4h", "1d") for k in range(4)]
    got = {(r["by"], r["name"]): r for r in replay.totals(rows, spark.createDataFrame(labels, "symbol string, timeframe string, pattern_type string, start int, end int")).collect()}
    tp, n, m = Counter(), Counter(), Counter()
    for s, t, i, kind, active in said:
        if kind:
            n[t, kind] += 1
    taken = set()
    for s, t, i, kind, _ in said:
        for lab in labels:
            if kind and lab[:3] == (s, t, kind) and lab[3] - 3 <= i <= lab[4] + 3 and lab not in taken:
                taken.add(lab)
                tp[t, kind] += 1
                break
    for lab in labels:
        m[lab[1], lab[2]] += 1
    for (by, name), r in got.items():
        inside = [k for k in set(n) | set(m) if by == "all" or name in k]
        hits, seen, there = (sum(c[k] for k in inside) for c in (tp, n, m))
        assert (r["tp"], r["fp"], r["fn"], r["events"]) == (hits, seen - hits, there - hits, seen)
        assert r["precision"] == pytest.approx(hits / seen if seen else 0) and r["recall"] == pytest.approx(hits / there if there else 0)
    assert set(got) == {("all", None), ("pattern", "up"), ("pattern", "down"), ("timeframe", "4h"), ("timeframe", "8h"), ("timeframe", "1d")}
    rates = []
    for s in "ab":
        active = [{kind} if kind and a else set() for x, t, _, kind, a in said if (x, t) == (s, "4h")]
        rates.append(sum(len(p - q) for p, q in zip(active, active[1:], strict=False)) / sum(map(len, active[:-1])))
    assert got["timeframe", "4h"]["repaint_rate"] == pytest.approx(np.mean(rates))


def test_types_do_not_compete_for_labels(spark):
    events = spark.createDataFrame([("a", "up", 10), ("a", "down", 11), ("a", "down", 12)], "symbol string, pattern_type string, idx int")
    labels = spark.createDataFrame([("a", "up", 9, 12), ("a", "down", 9, 12)], "symbol string, pattern_type string, start int, end int")
    by_type = {r["pattern_type"]: (r["tp"], r["fp"], r["fn"]) for r in validation.match_events(events, labels, by_type=True).collect()}
    assert by_type == {"up": (1, 0, 0), "down": (1, 1, 0)}
    assert [tuple(r) for r in validation.match_events(events, labels).collect()] == [("a", 2, 1, 0)]


# --- levels ---


def test_a_level_of_three_touches_and_its_kind(spark):
    """Highs at 60 three times: one resistance with its pivots as touches, though the last close is above it; a channel of two parallel lines."""
    y = np.interp(np.arange(60), [0, 10, 20, 30, 40, 50, 59], [50, 60, 50, 60, 50, 60, 62])
    rows = [("a", i, float(v), float(v), float(v), 5) for i, v in enumerate(y)]
    bars = spark.createDataFrame(rows, "symbol string, idx int, high double, low double, close double, volume long")
    known = level_driver.facts(bars)
    points = level_driver.pivots(bars)
    zones = {(r["is_high"], round(r["price"], 6)): (r["touches"], r["first_touch"], r["last_touch"]) for r in level_driver.zone_levels(points, bars, known).collect()}
    assert zones[False, 50.0] == (2, 20, 40) and zones[True, 60.0][0] >= 2


@pytest.mark.parametrize(("gap", "channel"), [(0.0, True), (0.4, False)])
def test_trend_lines_and_channels(spark, gap, channel):
    x = np.arange(100)
    wave = np.abs((x % 20) - 10) / 10
    top, low = 100 + 0.5 * x, 60 + (0.5 + gap) * x
    close = low + (top - low) * wave
    rows = [("a", int(i), float(c), float(c), float(c), 5) for i, c in zip(x, close, strict=True)]
    bars = spark.createDataFrame(rows, "symbol string, idx int, high double, low double, close double, volume long")
    lines = {r["is_high"]: r for r in level_driver.trendlines(level_driver.pivots(bars), level_driver.facts(bars)).collect()}
    if True in lines and False in lines:
        assert lines[True]["is_channel"] == lines[False]["is_channel"] == channel
    assert lines[True]["slope"] == pytest.approx(0.5, abs=0.02) and lines[True]["touches"] >= 3 and lines[True]["method"] == "consensus"


def test_the_median_line_stands_in(spark):
    """No line through two pivots is near a third one, but that of the medians is near three."""
    points = spark.createDataFrame([("a", 0, True, 0.0), ("a", 10, True, 10.9), ("a", 20, True, 18.4), ("a", 30, True, 30.9), ("a", 40, True, 39.0)], "symbol string, idx int, is_high boolean, price double")
    known = spark.createDataFrame([("a", 1.05, 50, 39.0, 1.0)], "symbol string, vol_scale double, n long, last double, mean_volume double")
    xs = np.array([0, 10, 20, 30, 40.0])
    ys = np.array([0.0, 10.9, 18.4, 30.9, 39.0])
    slopes = [(ys[j] - ys[i]) / (xs[j] - xs[i]) for i in range(5) for j in range(i + 1, 5)]
    most = max(int((np.abs(ys - (ys[i] + (ys[j] - ys[i]) / (xs[j] - xs[i]) * (xs - xs[i]))) <= 0.525).sum()) for i in range(5) for j in range(i + 1, 5))
    got = level_driver.trendlines(points, known).collect()
    slope = float(np.median(slopes))
    near = int((np.abs(ys - slope * xs - np.median(ys - slope * xs)) <= 0.525).sum())
    if most >= 3:
        assert got[0]["method"] == "consensus" and got[0]["touches"] == most
    else:
        assert (len(got) == 1) == (near >= 3) and all(r["method"] == "median" and r["slope"] == pytest.approx(slope) for r in got)


def test_short_and_flat_series_have_no_levels(spark):
    bars = _history(spark, 15)
    flat = _history(spark, 40).withColumns({c: F.lit(5.0) for c in ("open", "high", "low", "close")})
    for df in (bars, flat, bars.limit(0)):
        assert level_driver.level_matches(df).count() == 0
    assert level_driver.level_matches(_history(spark, 60), least_strength=0.5).where("score < 50").count() == 0


# --- klines ---


def test_klines_come_back_and_reads_are_pruned(spark, tmp_path):
    at = f"file://{tmp_path}/klines"
    bars = _history(spark, 25).withColumns({"timeframe": F.lit("4h"), "close_time": F.col("open_time") + F.expr("interval 1 second")})
    klines.write_klines(bars.unionByName(bars.withColumn("timeframe", F.lit("1d"))), at, 10)
    odd = [("a", "4h", '[["x", "1", "2", "3", "4", "5", 6]]'), ("a", "4h", '[[60000, "1", "2", "0", "not a number", "5", 999999]]'), ("c", "4h", '{"code": -1}'), ("d", "4h", "[]"), ("e", "4h", "not json")]
    klines.write_answers(spark.createDataFrame(odd, "symbol string, timeframe string, value string"), at)
    got = klines.klines(spark, at, symbols=["a", "c"], timeframes=["4h"], limit=20)
    plan = got._jdf.queryExecution().explainString(got._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters: [" in plan and "symbol" in plan.split("PartitionFilters")[1].split("]")[0] and "timeframe" in plan.split("PartitionFilters")[1].split("]")[0]
    want = {(i * 60_000, r["open"], r["high"], r["low"], r["close"], float(r["volume"])) for r in bars.where("symbol = 'a'").collect() if (i := r["idx"]) >= 5}
    assert {tuple(r)[2:8] for r in got.collect()} == want
    gone = klines.unavailable(spark, at)
    assert {r["symbol"] for r in gone.collect()} == {"c", "d", "e"}
    assert {r["symbol"] for r in klines.klines(spark, at, blocklist=gone).collect()} == {"a", "b"}
    klines.write_klines(bars.where("idx > 20").withColumn("close_time", F.col("open_time") + F.expr("interval 9 second")).withColumn("close", F.lit(1.0)), at)
    again = klines.klines(spark, at, symbols=["a"], timeframes=["4h"]).collect()
    assert len(again) == 25 and [r["close"] for r in again if r["open_time"] > 20 * 60_000] == [1.0] * 4  # the answer of the later close time counts


def test_universe_falls_back(spark):
    ranked = spark.createDataFrame([("btc", 1, 2e6), ("usdc", 2, 9e9), ("a_b", 3, 9e9), ("toolongname1", 4, 9e9), ("eth", 5, None), ("sol", 6, 5e6)], "symbol string, place long, volume double")
    traded = spark.createDataFrame([("AA", 5e6), ("BB", 7e6), ("DAI", 9e9), ("CC", 1.0)], "symbol string, quote_volume double")
    names = lambda *a, **k: [(r["symbol"], r["origin"]) for r in klines.universe(spark, *a, **k).orderBy("place").collect()]
    assert names(ranked, traded) == [("BTC", "ranked"), ("SOL", "ranked")]
    assert names(ranked.limit(0), traded) == [("BB", "traded"), ("AA", "traded")] and names(None, traded, most=1) == [("BB", "traded")]
    assert names(None, traded.where("quote_volume < 2")) == [(s, "default") for s in klines.DEFAULT_SYMBOLS] and names(None, None, most=2)[-1] == ("ETH", "default")
