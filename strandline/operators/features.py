"""Scores of a series from its line and pivots: prominence, quality, legs, symmetry, convergence, swings, volume, trend.

Lines are (symbol, idx, y) with y from 0 to 1, points the pivots of ``windows.pivots`` on y. Every score is an aggregation or
a window by series, so a query exchanges its bars once and its few pivots with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from strandline.functions.texts import functions_of
from strandline.operators.windows import by_series, in_order


def _pivot_order() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("idx", "is_high")


def _of(high: bool, value: Column | str) -> Column:
    """``value`` for pivots of one kind, else null."""
    return F.when(F.col("is_high") == F.lit(high), value if isinstance(value, Column) else F.col(value))


def prominences(lines: DataFrame, points: DataFrame) -> DataFrame:
    """Points with ``prominence`` (W12): how far a pivot stands out of the line from the pivot before to the one after it."""
    o = _pivot_order()
    spans = points.withColumns({"a": F.coalesce(F.lag("idx").over(o), F.lit(0)), "b": F.coalesce(F.lead("idx").over(o), F.lit(2**31 - 1))})
    near = spans.join(lines.select("symbol", F.col("idx").alias("x"), "y"), "symbol").where("x >= a and x <= b")
    far = near.groupBy("symbol", "idx", "is_high", "price").agg(F.min("y").alias("lo"), F.max("y").alias("hi"))
    out = F.when(F.col("is_high"), F.col("price") - F.col("lo")).otherwise(F.col("hi") - F.col("price"))
    return far.select("symbol", "idx", "is_high", "price", out.alias("prominence"))


def quality(lines: DataFrame, points: DataFrame) -> DataFrame:
    """.25 pivot count + .30 alternation + .25 prominence + .20 evenness of moves (P4); 0 for flat or short lines and under two pivots."""
    turns = prominences(lines, points).withColumn("turn", F.col("is_high") != F.lag("is_high").over(_pivot_order()))
    of_points = turns.groupBy("symbol").agg(
        F.count("*").alias("m"), F.count_if("turn").alias("turns"), F.avg(F.when(F.col("prominence") > 0, F.col("prominence"))).alias("out")
    )
    moves = lines.withColumn("move", F.abs(F.col("y") - F.lag("y").over(in_order())))
    of_lines = moves.groupBy("symbol").agg(
        F.count("*").alias("n"), (F.max("y") - F.min("y")).alias("span"), (F.stddev_pop("move") / (F.avg("move") + 1e-10)).alias("noise")
    )
    score = (
        0.25 * F.least(F.lit(1.0), F.col("m") / 4) + 0.30 * F.col("turns") / F.greatest(F.lit(1), F.col("m") - 1)
        + 0.25 * F.least(F.lit(1.0), F.coalesce("out", F.lit(0.0)) * 5) + 0.20 * F.greatest(F.lit(0.0), 1 - F.col("noise") / 3)
    )
    none = (F.col("n") < 10) | (F.coalesce("m", F.lit(0)) < 2) | (F.col("span") < 1e-10)
    return of_lines.join(of_points, "symbol", "left").select("symbol", F.when(none, 0.0).otherwise(score).alias("quality"))


def legs(lines: DataFrame, points: DataFrame) -> DataFrame:
    """Each leg that ends at a pivot: its slope, the turn at that pivot as a share of a half circle, and its share of all lengths."""
    o = _pivot_order()
    rows = points.join(lines.groupBy("symbol").agg(F.count("*").alias("n")), "symbol")
    rows = rows.withColumns({"dx": (F.col("idx") - F.lag("idx").over(o)) / F.col("n"), "dy": F.col("price") - F.lag("price").over(o)})
    dx, dy, nx, ny = F.col("dx"), F.col("dy"), F.col("nx"), F.col("ny")
    rows = rows.withColumns({"nx": F.lead("dx").over(o), "ny": F.lead("dy").over(o), "length": F.sqrt(dx * dx + dy * dy)})
    rows = rows.withColumn("total", F.sum("length").over(by_series())).where("dx is not null")
    share = F.when(F.col("total") > 0, F.col("length") / F.col("total")).otherwise(F.col("length"))
    turn = F.atan2(dx * ny - dy * nx, dx * nx + dy * ny) / F.pi()
    return rows.select("symbol", "idx", F.tanh(dy / (dx + 1e-10)).alias("slope"), turn.alias("turn"), share.alias("share"))


def swings(points: DataFrame) -> DataFrame:
    """Per series: numbers of highs and lows and the shares of rising and falling steps between those of a kind (W16); 0 without steps."""
    kind = Window.partitionBy("symbol", "is_high").orderBy("idx")
    rows = points.withColumn("step", F.signum(F.col("price") - F.lag("price").over(kind)))
    out = rows.groupBy("symbol").agg(
        F.count(_of(True, "idx")).alias("highs"), F.count(_of(False, "idx")).alias("lows"),
        *[F.count_if((F.col("is_high") == F.lit(high)) & (F.col("step") == way)).alias(name) for name, high, way in (("hh", True, 1), ("lh", True, -1), ("hl", False, 1), ("ll", False, -1))],
    )
    share = lambda c, n: F.when(F.col(n) >= 2, F.col(c) / (F.col(n) - 1)).otherwise(0.0)
    return out.select("symbol", "highs", "lows", share("hh", "highs").alias("hh"), share("lh", "highs").alias("lh"), share("hl", "lows").alias("hl"), share("ll", "lows").alias("ll"))


def geometry(points: DataFrame) -> DataFrame:
    """Symmetry of the halves of the pivots (P5), convergence of the spread (P6) and consistency of the swings."""
    rows = points.withColumns({"r": F.row_number().over(_pivot_order()) - 1, "m": F.count("*").over(by_series())})
    left = rows.where("m >= 4 and r < m div 2").select("symbol", "r", F.col("price").alias("p"), F.col("is_high").alias("h"))
    right = rows.select("symbol", (F.col("m") - 1 - F.col("r")).alias("r"), F.col("price").alias("q"), F.col("is_high").alias("g"))
    alike = 0.5 * (1 - F.least(F.lit(1.0), F.abs(F.col("p") - F.col("q")))) + 0.5 * (F.col("h") == F.col("g")).cast("double")
    mirrored = left.join(right, ["symbol", "r"]).groupBy("symbol").agg(F.avg(alike).alias("symmetry"))
    ends = points.groupBy("symbol").agg(
        F.abs(F.min_by("price", _of(True, "idx")) - F.min_by("price", _of(False, "idx"))).alias("s0"),
        F.abs(F.max_by("price", _of(True, "idx")) - F.max_by("price", _of(False, "idx"))).alias("s1"),
    )
    out = swings(points).join(ends, "symbol").join(mirrored, "symbol", "left")
    some = (F.col("highs") >= 2) & (F.col("lows") >= 2) & (F.col("s0") > 0)
    closer = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("s0") - F.col("s1")) / F.col("s0")))
    steady = F.when(F.col("highs") + F.col("lows") < 3, 0.0).otherwise((F.greatest("hh", "lh") + F.greatest("hl", "ll")) / 2)
    return out.select("symbol", F.coalesce("symmetry", F.lit(0.0)).alias("symmetry"), F.when(some, closer).otherwise(0.0).alias("convergence"), steady.alias("consistency"))


def volume_confirmation(bars: DataFrame, points: DataFrame) -> DataFrame:
    """Volume at pivots, in the second half and in the last 15 % against the mean (P8), 0 to 1; .5 for short series or without volume."""
    rows = bars.withColumn("n", F.count("*").over(by_series()))
    half, tail = F.col("idx") < F.floor(F.col("n") / 2), F.col("idx") >= F.floor(F.col("n") * 0.85)
    v = F.col("volume")
    whole = rows.groupBy("symbol").agg(
        F.max("n").alias("n"), F.avg(v).alias("mean"), F.avg(F.when(half, v)).alias("first"), F.avg(F.when(~half, v)).alias("second"), F.avg(F.when(tail, v)).alias("tail")
    )
    at = points.select("symbol", "idx").join(bars.select("symbol", "idx", "volume"), ["symbol", "idx"]).groupBy("symbol").agg(F.avg("volume").alias("at"))
    out = whole.join(at, "symbol", "left")
    part = lambda ratio, cap, weight: F.least(F.lit(cap), ratio) / cap * weight
    grown = F.when(F.col("first") > 0, F.col("second") / F.col("first")).otherwise(1.0)
    score = part(F.coalesce(F.col("at") / F.col("mean"), F.lit(1.0)), 1.5, 0.3) + part(grown, 1.5, 0.3) + part(F.col("tail") / F.col("mean"), 2.0, 0.4)
    none = (F.col("n") < 10) | (F.col("mean") == 0)
    return out.select("symbol", F.when(none, 0.5).otherwise(F.least(F.lit(1.0), score)).alias("volume_confirmation"))


def important_pivots(lines: DataFrame, points: DataFrame, keep: int = 10) -> DataFrame:
    """The ``keep`` pivots of each series that stand out most (W15); ties go to the later one."""
    o = _pivot_order()
    means = lines.groupBy("symbol").agg(F.avg("y").alias("mean"))
    rows = prominences(lines, points).join(means, "symbol")
    step = lambda f: F.coalesce(F.abs(F.col("price") - f("price").over(o)), F.lit(0.0))
    out = F.when(F.col("prominence") > 0, F.col("prominence")).otherwise(F.abs(F.col("price") - F.col("mean")))
    rows = rows.withColumn("score", F.round(0.5 * out + 0.3 * F.greatest(step(F.lag), step(F.lead)) + 0.2, 9))
    best = Window.partitionBy("symbol").orderBy(F.col("score").desc(), F.col("idx").desc(), F.col("is_high").desc())
    return rows.withColumn("_rn", F.row_number().over(best)).where(F.col("_rn") <= keep).select("symbol", "idx", "is_high", "price", "score")


def trends(lines: DataFrame, points: DataFrame) -> DataFrame:
    """Trend of each series from its move, swings and straightness (D11), and whether its last fifth has not turned against it.

    ``direction`` is up, down or null, ``confidence`` 0 without a trend.
    """
    rows = lines.withColumn("n", F.count("*").over(by_series()))
    cut = F.col("n") - F.greatest(F.lit(5), F.floor(F.col("n") / 5))
    rows = rows.withColumn("cut", cut).groupBy("symbol").agg(
        F.max("n").alias("n"), F.max("cut").alias("cut"), F.min_by("y", "idx").alias("first"), F.max_by("y", "idx").alias("last"), F.min("y").alias("lo"), F.max("y").alias("hi"),
        F.max(F.when(F.col("idx") == F.col("cut"), F.col("y"))).alias("turned_at"), F.min_by("idx", F.struct("y", "idx")).alias("low_at"),
        F.max_by("idx", F.struct(F.col("y"), -F.col("idx"))).alias("high_at"), F.regr_slope("y", "idx").alias("slope"), F.regr_r2("y", "idx").alias("r2"),
    )
    rows = rows.join(swings(points), "symbol", "left").fillna(0, ["highs", "lows", "hh", "lh", "hl", "ll"])
    move, r2 = F.col("last") - F.col("first"), F.col("r2")
    lean = F.tanh(F.col("slope") * F.col("n") / (F.col("hi") - F.col("lo") + 1e-10)) * F.sqrt("r2")
    mixed = lambda a, b: F.least(F.lit(1.0), F.abs(move)) * 0.35 + (F.col(a) + F.col(b)) / 2 * 0.35 + r2 * 0.3
    swing = lambda a, b: ((F.col(a) >= 0.5) | (F.col(b) >= 0.5)) & (mixed(a, b) > 0.35)
    few, flat = (F.col("highs") < 2) | (F.col("lows") < 2), F.col("hi") == F.col("lo")
    way = lambda c: F.when(c > 0, "up").otherwise("down")
    found = lambda direction, confidence: F.struct(direction.alias("direction"), F.least(F.lit(1.0), confidence).alias("confidence"))
    strong_few, straight = (F.abs(move) > 0.4) & (F.abs(lean) > 0.3), (F.abs(move) > 0.55) & (r2 > 0.5)
    trend = (
        F.when(flat | (few & ~strong_few), None).when(few, found(way(lean), 0.5 * F.abs(move) + 0.5 * F.abs(lean)))
        .when((move > 0.15) & swing("hh", "hl"), found(F.lit("up"), mixed("hh", "hl"))).when((move < -0.15) & swing("lh", "ll"), found(F.lit("down"), mixed("lh", "ll")))
        .when(straight, found(way(move), 0.5 * F.abs(move) + 0.5 * r2))
    )
    tail = F.col("last") - F.col("turned_at")
    fell = (tail < -0.35) | ((F.col("high_at") < F.col("cut")) & (F.col("hi") - F.col("last") > 0.45))
    rose = (tail > 0.35) | ((F.col("low_at") < F.col("cut")) & (F.col("last") - F.col("lo") > 0.45))
    rows = rows.withColumn("trend", trend)
    stale = F.when(F.col("n") < 6, False).when(F.col("trend.direction") == "up", fell).when(F.col("trend.direction") == "down", rose).otherwise(False)
    return rows.select("symbol", "trend.direction", F.coalesce("trend.confidence", F.lit(0.0)).alias("confidence"), (~stale).alias("is_active"))


def stretched(a: Column, n: Column) -> Column:
    """``a`` as ``n`` values by linear interpolation from its first to its last (A2)."""
    F = functions_of(a)  # noqa: N806

    def value(i: Column) -> Column:
        at = i * (F.size(a) - 1) / F.greatest(n - 1, F.lit(1))
        low = F.floor(at).cast("int")
        left, right = F.element_at(a, low + 1), F.element_at(a, F.least(low + 2, F.size(a)))
        return left + (right - left) * (at - low)

    return F.transform(F.sequence(F.lit(0), n - 1), value)


def _lacks(a: Column) -> Column:
    F = functions_of(a)  # noqa: N806
    return F.coalesce(F.size(a), F.lit(0)) < 1


def _mean(a: Column) -> Column:
    F = functions_of(a)  # noqa: N806
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def _steps(a: Column) -> Column:
    F = functions_of(a)  # noqa: N806
    return F.zip_with(F.slice(a, 2, F.size(a) - 1), F.slice(a, 1, F.size(a) - 1), lambda x, y: x - y)


def distance_likeness(a: Column, b: Column) -> Column:
    """1 / (1 + 8 mean squared difference) of two arrays at the longer one's length (M4); .3 if one has no values."""
    F = functions_of(a)  # noqa: N806
    n = F.greatest(F.size(a), F.size(b))
    off = _mean(F.zip_with(stretched(a, n), stretched(b, n), lambda x, y: (x - y) * (x - y)))
    return F.when(_lacks(a) | _lacks(b), 0.3).otherwise(1 / (1 + 8 * off))


def pivot_likeness(a: Column, b: Column) -> Column:
    """.40 closeness + .35 equal directions + .25 like magnitudes of two pivot sequences (M3); .3 if one has no values."""
    F = functions_of(a)  # noqa: N806
    n = F.greatest(F.size(a), F.size(b))
    da, db = _steps(stretched(a, n)), _steps(stretched(b, n))
    same = _mean(F.zip_with(da, db, lambda x, y: (F.signum(x) == F.signum(y)).cast("double")))
    ratios = F.zip_with(da, db, lambda x, y: F.when(F.greatest(F.abs(x), F.abs(y)) > 0.01, F.least(F.abs(x), F.abs(y)) / (F.greatest(F.abs(x), F.abs(y)) + 1e-10)))
    sizes = F.array_compact(ratios)
    like = F.when(F.size(sizes) > 0, _mean(sizes)).otherwise(0.5)
    whole = 0.40 * distance_likeness(a, b) + F.when(n >= 3, 0.35 * same + 0.25 * like).otherwise(0.3)
    return F.when(_lacks(a) | _lacks(b), 0.3).otherwise(whole)
