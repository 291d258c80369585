"""Chart structures on normalised closes: joins of pivots, interval extremes and segment statistics.

Lines are (symbol, idx, y) with y from 0 to 1, so tolerances are shares of the range. Pivots are those of
``windows.pivots`` on y.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.windows import by_series, in_order


def _sides(points: DataFrame, high: bool) -> DataFrame:
    return points.where(F.col("is_high") == F.lit(high)).select("symbol", "idx", F.col("price").alias("y"))


def pairs(lines: DataFrame, points: DataFrame, high: bool = True) -> DataFrame:
    """Pivot pairs i < j of a kind with the extreme of the line strictly between them."""
    p = _sides(points, high)
    both = p.select("symbol", F.col("idx").alias("i"), F.col("y").alias("yi")).join(p.select("symbol", F.col("idx").alias("j"), F.col("y").alias("yj")), "symbol")
    both = both.where("i < j")
    inner = both.join(lines.select("symbol", F.col("idx").alias("x"), "y"), "symbol").where("x > i and x < j")
    between = F.min("y") if high else F.max("y")
    return inner.groupBy("symbol", "i", "j", "yi", "yj").agg(between.alias("neck"))


def double_extremes(lines: DataFrame, points: DataFrame, high: bool = True, tolerance: float = 0.03, least: float = 0.45) -> DataFrame:
    """Double tops or bottoms (D2, D3): two pivots within ``tolerance`` and a dip of more than .12; the surest pair a series."""
    rows = pairs(lines, points, high).withColumns({"off": F.abs(F.col("yi") - F.col("yj")), "depth": F.abs(F.col("yi") - F.col("neck"))})
    rows = rows.where((F.col("off") < tolerance) & (F.col("depth") > 0.12))
    conf = F.round(0.5 * (1 - F.col("off") / tolerance) + 0.5 * F.least(F.lit(1.0), F.col("depth") / 0.3), 9)
    rows = rows.withColumn("confidence", conf).where(F.col("confidence") > least)
    first = Window.partitionBy("symbol").orderBy(F.col("confidence").desc(), "i", "j")
    return rows.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").select("symbol", "i", "j", "neck", "confidence")


def triple_extremes(lines: DataFrame, points: DataFrame, high: bool = True, tolerance: float = 0.035) -> DataFrame:
    """Triple tops or bottoms (D17, D18): three pivots within ``tolerance`` and dips of more than .10 on both sides."""
    two = pairs(lines, points, high)
    one, other = two.alias("p"), two.alias("q")
    same = (F.col("p.symbol") == F.col("q.symbol")) & (F.col("p.j") == F.col("q.i"))
    rows = one.join(other, same).select(
        "p.symbol", F.col("p.i").alias("i"), F.col("p.j").alias("j"), F.col("q.j").alias("k"), F.col("p.yi").alias("a"), F.col("p.yj").alias("b"), F.col("q.yj").alias("c"),
        F.col("p.neck").alias("n1"), F.col("q.neck").alias("n2"),
    )
    spread = F.greatest("a", "b", "c") - F.least("a", "b", "c")
    depth = F.greatest("a", "b", "c") - F.greatest("n1", "n2") if high else F.least("n1", "n2") - F.least("a", "b", "c")
    rows = rows.withColumns({"spread": spread, "depth": depth}).where((F.col("spread") < tolerance) & (F.col("depth") > 0.10))
    conf = F.round(0.5 * (1 - F.col("spread") / tolerance) + 0.5 * F.least(F.lit(1.0), F.col("depth") / 0.25), 9)
    return rows.withColumn("confidence", conf).where(F.col("confidence") > 0.45).select("symbol", "i", "j", "k", "confidence")


def head_shoulders(points: DataFrame, high: bool = True) -> DataFrame:
    """Head and shoulders over consecutive pivots (D4, D5): shoulders within .18, the head more than .06 beyond both."""
    order = Window.partitionBy("symbol").orderBy("idx")
    rows = _sides(points, high).withColumns({f"{c}{n}": F.lead(c, n).over(order) for c in ("idx", "y") for n in (1, 2)})
    sign = 1 if high else -1
    ahead = F.least(sign * (F.col("y1") - F.col("y")), sign * (F.col("y1") - F.col("y2")))
    rows = rows.withColumns({"off": F.abs(F.col("y") - F.col("y2")), "ahead": ahead}).where((F.col("off") < 0.18) & (F.col("ahead") > 0.06))
    conf = 0.3 * (1 - F.col("off") / 0.18) + 0.4 * F.least(F.lit(1.0), F.col("ahead") / 0.2) + 0.3
    spans = (F.col("idx1") - F.col("idx"), F.col("idx2") - F.col("idx1"))
    conf = F.round(F.when(F.least(*spans) / F.greatest(*spans) < 0.3, conf * 0.7).otherwise(conf), 9)
    return rows.withColumn("confidence", conf).where(F.col("confidence") > 0.5).select("symbol", F.col("idx").alias("left"), F.col("idx1").alias("head"), F.col("idx2").alias("right"), "confidence")


def impulse(lines: DataFrame, n: int = 100) -> DataFrame:
    """Moves of more than .55 of the range within n / 5 bars (D1): the largest of each series, with its direction."""
    rows = lines.withColumn("move", F.lead("y", n // 5).over(in_order()) - F.col("y"))
    best = rows.where(F.abs("move") > 0.55).groupBy("symbol").agg(F.max(F.struct(F.round(F.abs("move"), 9).alias("size"), (-F.col("idx")).alias("at"), F.signum("move").alias("way"))).alias("b"))
    return best.select("symbol", F.col("b.size").alias("size"), (-F.col("b.at")).alias("idx"), F.when(F.col("b.way") > 0, "impulse_up").otherwise("impulse_down").alias("type"))


def flags(lines: DataFrame) -> DataFrame:
    """Bull and bear flags (D6): a pole of .35 up to .3, .4 or .5 of the series, then a quiet drift against it."""
    rows = lines.withColumn("n", F.count("*").over(by_series())).withColumn("split", F.explode(F.array(F.lit(0.3), F.lit(0.4), F.lit(0.5))))
    rows = rows.withColumn("cut", F.floor(F.col("n") * F.col("split")))
    pole, flag = F.col("idx") < F.col("cut"), F.col("idx") >= F.col("cut")
    at = lambda c, when, f: f("y", F.when(when, F.col("idx"))).alias(c)
    rows = rows.groupBy("symbol", "split").agg(
        at("p0", pole, F.min_by), at("p1", pole, F.max_by), at("f0", flag, F.min_by), at("f1", flag, F.max_by),
        (F.max(F.when(flag, F.col("y"))) - F.min(F.when(flag, F.col("y")))).alias("width"),
    )
    rows = rows.withColumns({"pole": F.col("p1") - F.col("p0"), "drift": F.col("f1") - F.col("f0")})
    rows = rows.where((F.abs("pole") >= 0.35) & (F.col("width") <= 0.45) & (F.signum("pole") * F.signum("drift") <= 0))
    conf = F.round(0.5 * F.least(F.lit(1.0), F.abs("pole")) + 0.3 * (1 - F.col("width")) + 0.2, 9)
    return rows.withColumn("confidence", conf).select("symbol", "split", F.when(F.col("pole") > 0, "bull_flag").otherwise("bear_flag").alias("type"), "confidence")


def pivot_fits(points: DataFrame) -> DataFrame:
    """Lines through the highs and through the lows of each series (C1), one row a series."""
    high, low = F.col("is_high"), ~F.col("is_high")
    fit = lambda f, when: f(F.when(when, F.col("price")), F.when(when, F.col("idx")))
    return points.groupBy("symbol").agg(
        fit(F.regr_slope, high).alias("high_slope"), fit(F.regr_intercept, high).alias("high_base"), fit(F.regr_slope, low).alias("low_slope"), fit(F.regr_intercept, low).alias("low_base"),
        F.count_if(high).alias("highs"), F.count_if(low).alias("lows"), F.min("idx").alias("x0"), F.max("idx").alias("x1"),
    )


def shapes(points: DataFrame) -> DataFrame:
    """Channels, wedges and triangles from the two lines (D7, D9, D10): their slopes and how the gap between them changes."""
    rows = pivot_fits(points).where("highs >= 2 and lows >= 2")
    gap = lambda x: (F.col("high_base") + F.col("high_slope") * F.col(x)) - (F.col("low_base") + F.col("low_slope") * F.col(x))
    rows = rows.withColumns({"gap0": gap("x0"), "gap1": gap("x1"), "len": F.col("x1") - F.col("x0")}).where("gap0 > 0")
    rows = rows.withColumns({"convergence": (F.col("gap0") - F.col("gap1")) / F.col("gap0"), "rise": (F.col("high_slope") + F.col("low_slope")) / 2 * F.col("len")})
    up, down = F.col("high_slope") > 0, F.col("high_slope") < 0
    kind = (
        F.when((F.col("convergence") >= 0.15) & up & (F.col("low_slope") > 0), "rising_wedge").when((F.col("convergence") >= 0.15) & down & (F.col("low_slope") < 0), "falling_wedge")
        .when(F.col("convergence").between(0.15, 0.95), "triangle").when((F.abs("convergence") <= 0.4) & (F.col("rise") > 0.15), "channel_up")
        .when((F.abs("convergence") <= 0.4) & (F.col("rise") < -0.15), "channel_down").when(F.abs("convergence") <= 0.4, "horizontal_channel").otherwise("none")
    )
    return rows.select("symbol", "high_slope", "low_slope", "convergence", kind.alias("type"))


def segments(lines: DataFrame) -> DataFrame:
    """Breakout, range and compression tests from segment statistics."""
    n = F.count("*").over(by_series())
    rows = lines.withColumns({"early": F.col("idx") < F.floor(n * 0.65), "half": F.col("idx") < F.floor(n / 2)})
    span = lambda when: F.max(F.when(when, F.col("y"))) - F.min(F.when(when, F.col("y")))
    sd = lambda when: F.stddev_pop(F.when(when, F.col("y")))
    rows = rows.groupBy("symbol").agg(
        span(F.col("early")).alias("r1"), span(~F.col("early")).alias("r2"), sd(F.col("half")).alias("s1"), sd(~F.col("half")).alias("s2"),
        F.abs(F.max_by("y", "idx") - F.min_by("y", "idx")).alias("net"),
    )
    squeeze = F.when(F.col("s1") > 0, 1 - F.col("s2") / F.col("s1")).otherwise(0.0)
    return rows.select(
        "symbol", "r1", "r2", "net", ((F.col("r1") < 0.25) & (F.col("r2") > 0.55)).alias("is_breakout"), (F.col("net") < 0.2).alias("is_range"),
        ((squeeze > 0.35) & (F.col("net") < 0.3)).alias("is_compression"),
    )


def confirm(bars: DataFrame, candidates: DataFrame, wait: int = 1, retreat: float = 0.5) -> DataFrame:
    """First close beyond a candidate's level, then ``wait`` closes that do not retreat by more than ``retreat`` heights.

    ``candidates``: symbol, from_idx, level, height, up. State is confirmed (at breakout + wait), invalidated, pending (too few
    bars yet) or none (no breakout). Only bars up to the confirmation are looked at, so a longer series never changes it.
    """
    rows = candidates.join(bars.select("symbol", F.col("idx").alias("x"), "close"), "symbol").where("x > from_idx")
    beyond = F.when(F.col("up"), F.col("close") > F.col("level")).otherwise(F.col("close") < F.col("level"))
    group = [c for c in candidates.columns]
    first = rows.groupBy(*group).agg(F.min(F.when(beyond, F.col("x"))).alias("breakout"), F.max("x").alias("last"))
    later = first.join(bars.select("symbol", F.col("idx").alias("x"), "close"), "symbol", "left").where(f"breakout is null or (x > breakout and x <= breakout + {wait}) or (x = breakout)")
    back = F.when(F.col("up"), F.col("level") - F.col("close")).otherwise(F.col("close") - F.col("level")) > retreat * F.col("height")
    held = later.groupBy(*group, "breakout", "last").agg(F.coalesce(F.bool_or(back & (F.col("x") > F.col("breakout"))), F.lit(False)).alias("fell_back"))
    state: Column = F.when(F.col("breakout").isNull(), "none").when(F.col("fell_back"), "invalidated").when(F.col("breakout") + wait > F.col("last"), "pending").otherwise("confirmed")
    return held.select(*group, "breakout", state.alias("state"), F.when(state == "confirmed", F.col("breakout") + wait).alias("confirmed_at"))
