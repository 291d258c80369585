"""Window operators over bars: true range, volatility, pivots, statistics and trend measures.

All take bars with ``symbol`` and ``idx`` (see ``sources.series.latest``) and share one partitioning and order, so one
exchange and one sort serve every window of a query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def by_series() -> WindowSpec:
    return Window.partitionBy("symbol")


def in_order() -> WindowSpec:
    return by_series().orderBy("idx")


def true_range(bars: DataFrame) -> DataFrame:
    """Adds ``tr`` (W1): the largest of high - low and the moves from the close before."""
    before = F.lag("close").over(in_order())
    return bars.withColumn("tr", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))


def atr(bars: DataFrame, n: int = 14) -> DataFrame:
    """symbol, atr: mean of the last ``n`` true ranges."""
    last = Window.partitionBy("symbol").orderBy(F.col("idx").desc())
    return true_range(bars).withColumn("_rn", F.row_number().over(last)).where(F.col("_rn") <= n).groupBy("symbol").agg(F.avg("tr").alias("atr"))


def vol_scale(bars: DataFrame) -> DataFrame:
    """symbol, vol_scale: ATR, but at least 1 % of the range of closes."""
    spans = bars.groupBy("symbol").agg((F.max("close") - F.min("close")).alias("span"))
    return atr(bars).join(spans, "symbol").select("symbol", F.greatest("atr", F.col("span") * 0.01).alias("vol_scale"))


def pivots(bars: DataFrame, k: int = 5, high: str = "high", low: str = "low") -> DataFrame:
    """Centred extrema (W3): bars whose high (low) is the greatest (least) within ``k`` on either side; ends are left out."""
    around = in_order().rowsBetween(-k, k)
    rows = bars.withColumns({
        "_n": F.count("*").over(by_series()), "_top": F.max(high).over(around), "_low": F.min(low).over(around),
    }).where((F.col("idx") >= k) & (F.col("idx") < F.col("_n") - k))
    kinds = F.array(
        F.when(F.col(high) == F.col("_top"), F.struct(F.lit(True).alias("is_high"), F.col(high).alias("price"))),
        F.when(F.col(low) == F.col("_low"), F.struct(F.lit(False).alias("is_high"), F.col(low).alias("price"))),
    )
    rows = rows.select("symbol", "idx", F.explode(F.array_compact(kinds)).alias("p"))
    return rows.select("symbol", "idx", "p.is_high", "p.price")


def strict_extrema(bars: DataFrame, k: int = 3) -> DataFrame:
    """Closes strictly beyond all ``k`` on either side (W4); frames are cut at the ends, the end bars never count."""
    before, after = in_order().rowsBetween(-k, -1), in_order().rowsBetween(1, k)
    close = F.col("close")
    rows = bars.withColumns({
        "is_high": (close > F.max("close").over(before)) & (close > F.max("close").over(after)),
        "is_low": (close < F.min("close").over(before)) & (close < F.min("close").over(after)),
    })
    return rows.where("is_high or is_low").select("symbol", "idx", "close", "is_high")


def series_stats(bars: DataFrame) -> DataFrame:
    """Per series: count, least, greatest, mean, deviation, median and range of closes (G1)."""
    return bars.groupBy("symbol").agg(
        F.count("*").alias("n"), F.min("close").alias("lo"), F.max("close").alias("hi"), F.avg("close").alias("mean"),
        F.stddev_pop("close").alias("sd"), F.percentile("close", F.lit(0.5)).alias("median"), (F.max("close") - F.min("close")).alias("span"),
    )


def arg_extremes(bars: DataFrame) -> DataFrame:
    """First place of the least and of the greatest close."""
    return bars.groupBy("symbol").agg(
        F.min_by("idx", F.struct("close", "idx")).alias("argmin"), F.max_by("idx", F.struct(F.col("close"), -F.col("idx"))).alias("argmax")
    )


def line_fit(bars: DataFrame) -> DataFrame:
    """Least-squares line of closes over places (G3); a flat series has r 0."""
    return bars.groupBy("symbol").agg(
        F.regr_slope("close", "idx").alias("slope"), F.regr_intercept("close", "idx").alias("intercept"), (F.signum(F.regr_slope("close", "idx")) * F.sqrt(F.regr_r2("close", "idx"))).alias("r"),
        F.count("*").alias("n"), (F.max("close") - F.min("close")).alias("span"),
    )


def trend(bars: DataFrame) -> DataFrame:
    """Trend direction tanh(slope n / span) |r|."""
    fit = line_fit(bars)
    return fit.select("symbol", (F.tanh(F.col("slope") * F.col("n") / (F.col("span") + 1e-10)) * F.abs("r")).alias("trend"))


def returns_volatility(bars: DataFrame) -> DataFrame:
    """Deviation of returns."""
    before = F.lag("close").over(in_order())
    rows = bars.withColumn("ret", (F.col("close") - before) / (before + 1e-10))
    return rows.groupBy("symbol").agg(F.stddev_pop("ret").alias("volatility"))


def compression(bars: DataFrame) -> DataFrame:
    """1 - deviation of the second half over that of the first (P3); 0 for short or flat series."""
    rows = bars.withColumn("half", F.col("idx") < F.floor(F.count("*").over(by_series()) / 2))
    rows = rows.groupBy("symbol").agg(
        F.count("*").alias("n"), F.stddev_pop(F.when(F.col("half"), F.col("close"))).alias("s1"), F.stddev_pop(F.when(~F.col("half"), F.col("close"))).alias("s2")
    )
    return rows.select("symbol", F.when((F.col("n") < 20) | (F.col("s1") == 0), 0.0).otherwise(1 - F.col("s2") / F.col("s1")).alias("compression"))


def breakout_strength(bars: DataFrame) -> DataFrame:
    """.3 end move + .3 min(3, ratio of the moves' deviations) / 3 + .4 range break, last quarter against the rest, at most 1 (P7); 0 under 15 bars."""
    n, part = F.count("*").over(by_series()), Window.partitionBy("symbol", "tail").orderBy("idx")
    rows = normalised(bars).withColumns({"n": n, "tail": F.col("idx") >= F.floor(n * 0.75)}).withColumn("move", F.col("y") - F.lag("y").over(part))
    tail = F.col("tail")
    rows = rows.groupBy("symbol").agg(
        F.max("n").alias("n"), F.stddev_pop(F.when(~tail, F.col("move"))).alias("s1"), F.stddev_pop(F.when(tail, F.col("move"))).alias("s2"),
        F.max(F.when(~tail, F.col("y"))).alias("hi"), F.min(F.when(~tail, F.col("y"))).alias("lo"), F.max_by("y", "idx").alias("last"), F.min_by("y", F.when(tail, F.col("idx"))).alias("first"),
    )
    breaks = F.greatest(F.lit(0.0), F.col("last") - F.col("hi")) + F.greatest(F.lit(0.0), F.col("lo") - F.col("last"))
    grown = F.least(F.lit(3.0), F.col("s2") / (F.col("s1") + 1e-10)) / 3
    score = F.least(F.lit(1.0), 0.3 * F.abs(F.col("last") - F.col("first")) + 0.3 * grown + 0.4 * breaks)
    return rows.select("symbol", F.when(F.col("n") < 15, 0.0).otherwise(score).alias("breakout_strength"))


def normalised(bars: DataFrame) -> DataFrame:
    """Adds ``y``: the close from 0 to 1 within its series; a flat series is 0 (A1)."""
    lo, hi = F.min("close").over(by_series()), F.max("close").over(by_series())
    return bars.withColumn("y", F.when(hi - lo < 1e-10, 0.0).otherwise((F.col("close") - lo) / (hi - lo)))


def swing_counts(points: DataFrame) -> DataFrame:
    """Higher and lower highs and lows among pivots of one kind."""
    order = Window.partitionBy("symbol", "is_high").orderBy("idx")
    rows = points.withColumn("up", F.col("price") > F.lag("price").over(order)).withColumn("down", F.col("price") < F.lag("price").over(order))
    count = lambda high, c: F.count_if((F.col("is_high") == F.lit(high)) & F.coalesce(F.col(c), F.lit(False)))
    return rows.groupBy("symbol").agg(count(True, "up").alias("hh"), count(True, "down").alias("lh"), count(False, "up").alias("hl"), count(False, "down").alias("ll"))


def sub_windows(series: DataFrame, sizes: tuple[int, ...] = (30, 50, 70)) -> DataFrame:
    """Each series again for its last 30, 50, 70 bars and as a whole (W20); ``window_size`` is null for the whole."""
    back = Window.partitionBy("symbol").orderBy(F.col("idx").desc())
    rows = series.withColumn("_rn", F.row_number().over(back))
    windows = F.explode(F.array(F.lit(None).cast("int"), *[F.lit(s) for s in sizes]))
    return rows.withColumn("window_size", windows).where("window_size is null or _rn <= window_size").drop("_rn")


def replay(series: DataFrame, n: int = 100) -> DataFrame:
    """Rolling windows of ``n`` bars that slide by one (W22): first and last close and mean of each full window."""
    frame = in_order().rowsBetween(-(n - 1), 0)
    rows = series.withColumns({"n": F.count("*").over(frame), "first_close": F.first("close").over(frame), "mean_close": F.avg("close").over(frame)})
    return rows.where(F.col("n") == n).select("symbol", "idx", "first_close", "close", "mean_close")
