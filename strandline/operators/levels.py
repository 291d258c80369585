"""Support and resistance: density zones, volume profile, round numbers, touches, lines through pivots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BINS = 20


def zones(points: DataFrame, scale: DataFrame, eps: float = 0.5) -> DataFrame:
    """One-dimensional density clusters of pivot prices (L3): sorted prices part where a gap exceeds ``eps`` x scale.

    Single prices are no zone. Exact for two points a cluster, as every price with a neighbour is a core point.
    """
    order = Window.partitionBy("symbol", "is_high").orderBy("price", "idx")
    rows = points.join(scale, "symbol")
    rows = rows.withColumn("_new", F.coalesce((F.col("price") - F.lag("price").over(order) > eps * F.col("vol_scale")).cast("int"), F.lit(1)))
    rows = rows.withColumn("zone", F.sum("_new").over(order))
    found = rows.groupBy("symbol", "is_high", "zone").agg(
        F.percentile("price", F.lit(0.5)).alias("price"), F.count("*").alias("touches"), F.min("idx").alias("first_touch"), F.max("idx").alias("last_touch")
    )
    return found.where(F.col("touches") >= 2).drop("zone")


def volume_histogram(bars: DataFrame) -> DataFrame:
    """Volume by 20 price bins of each series (G5); the greatest close is in the last bin."""
    series = Window.partitionBy("symbol")
    lo, hi = F.min("close").over(series), F.max("close").over(series)
    rows = bars.withColumns({"lo": lo, "width": (hi - lo) / BINS})
    place = F.when(F.col("width") > 0, F.least(F.lit(BINS - 1), F.floor((F.col("close") - F.col("lo")) / F.col("width")))).otherwise(0)
    rows = rows.withColumn("bin", place.cast("int"))
    return rows.groupBy("symbol", "bin", "lo", "width").agg(F.sum("volume").alias("volume"))


def value_area(histogram: DataFrame, share: float = 0.7) -> DataFrame:
    """Point of control and value area (G6): from the fullest bin outwards, the fuller neighbour first, right on ties.

    A fold over the at most 20 bins of a series, as an array.
    """
    rows = histogram.groupBy("symbol", "lo", "width").agg(F.map_from_entries(F.collect_list(F.struct("bin", F.col("volume").cast("double")))).alias("m"))
    rows = rows.withColumn("v", F.expr(f"transform(sequence(0, {BINS - 1}), i -> coalesce(m[i], 0D))"))
    rows = rows.withColumn("poc", F.expr("cast(array_position(v, array_max(v)) - 1 as int)"))
    fold = f"""aggregate(sequence(1, {BINS}), named_struct('a', poc, 'b', poc, 's', array_max(v)), (t, i) ->
        case when t.s >= {share} * aggregate(v, 0D, (x, y) -> x + y) or (t.a = 0 and t.b = {BINS - 1}) then t
             when t.b < {BINS - 1} and (t.a = 0 or v[t.b + 1] >= v[t.a - 1]) then named_struct('a', t.a, 'b', t.b + 1, 's', t.s + v[t.b + 1])
             else named_struct('a', t.a - 1, 'b', t.b, 's', t.s + v[t.a - 1]) end)"""
    rows = rows.withColumn("t", F.expr(fold))
    centre = lambda c: F.col("lo") + (F.col(c) + 0.5) * F.col("width")
    return rows.select("symbol", "poc", F.col("t.a").alias("low_bin"), F.col("t.b").alias("high_bin"), centre("poc").alias("poc_price"), F.col("t.s").alias("area_volume"))


def nice(x: str) -> F.Column:
    """1, 2, 5 or 10 times a power of ten, next to ``x``."""
    power = F.pow(F.lit(10.0), F.floor(F.log10(x)))
    f = F.col(x) / power
    return F.when(f < 1.5, 1.0).when(f < 3, 2.0).when(f < 7, 5.0).otherwise(10.0) * power


def round_levels(bars: DataFrame, scale: DataFrame, reach: int = 3) -> DataFrame:
    """Round prices around the last close with the bars whose high or low comes within half a scale."""
    last = bars.groupBy("symbol").agg(F.max_by("close", "idx").alias("last")).join(scale, "symbol").withColumn("step", nice("vol_scale"))
    levels = last.withColumn("k", F.explode(F.sequence(F.lit(-reach), F.lit(reach))))
    levels = levels.withColumn("level", (F.round(F.col("last") / F.col("step")) + F.col("k")) * F.col("step")).where("level > 0")
    near = F.least(F.abs(F.col("high") - F.col("level")), F.abs(F.col("low") - F.col("level"))) <= 0.5 * F.col("vol_scale")
    touched = bars.select("symbol", "idx", "high", "low").join(levels, "symbol").where(near)
    return touched.groupBy("symbol", "level").agg(F.count("*").alias("touches"), F.max("idx").alias("last_touch"))


def zone_touches(bars: DataFrame, zones: DataFrame, scale: DataFrame) -> DataFrame:
    """Closes within .3 scales of each zone's price (J12), joined on the series key."""
    rows = zones.join(scale, "symbol").join(bars.select("symbol", "idx", "close"), "symbol")
    rows = rows.where(F.abs(F.col("close") - F.col("price")) <= 0.3 * F.col("vol_scale"))
    return rows.groupBy("symbol", "is_high", "price").agg(F.count("*").alias("closes_near"))


def pivot_lines(bars: DataFrame, points: DataFrame, tolerance: float = 0.0015, least: int = 3) -> DataFrame:
    """Lines through two pivots of a kind with the pivots that touch them (J7, J11); ``tolerance`` is a share of the range."""
    a, b = points.alias("a"), points.alias("b")
    same = (F.col("a.symbol") == F.col("b.symbol")) & (F.col("a.is_high") == F.col("b.is_high")) & (F.col("a.idx") < F.col("b.idx"))
    slope = F.try_divide(F.col("b.price") - F.col("a.price"), F.col("b.idx") - F.col("a.idx"))
    lines = a.join(b, same).select("a.symbol", "a.is_high", F.col("a.idx").alias("i"), F.col("b.idx").alias("j"), slope.alias("slope"), F.col("a.price").alias("base"))
    spans = bars.groupBy("symbol").agg((F.max("high") - F.min("low")).alias("span"))
    rows = lines.join(spans, "symbol").join(points.withColumnRenamed("idx", "x"), ["symbol", "is_high"])
    off = F.abs(F.col("price") - (F.col("base") + F.col("slope") * (F.col("x") - F.col("i"))))
    rows = rows.where(off <= tolerance * F.col("span"))
    return rows.groupBy("symbol", "is_high", "i", "j", "slope").agg(F.count("*").alias("touches")).where(F.col("touches") >= least)
