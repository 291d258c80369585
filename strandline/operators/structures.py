"""Curves, poles and squeezes of normalised lines, and the choice of a primary type among all candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.windows import by_series


def curve_fit(lines: DataFrame) -> DataFrame:
    """Least-squares parabola and line of y over centred places with their mean absolute residuals.

    Places are evenly spaced, so odd powers of the centred place sum to zero and both fits have closed forms.
    """
    s = by_series()
    rows = lines.withColumn("x", F.col("idx") - (F.count("*").over(s) - 1) / 2)
    rows = rows.withColumns({
        "n": F.count("*").over(s), "s2": F.sum(F.col("x") ** 2).over(s), "s4": F.sum(F.col("x") ** 4).over(s), "sy": F.sum("y").over(s),
        "sxy": F.sum(F.col("x") * F.col("y")).over(s), "sx2y": F.sum(F.col("x") ** 2 * F.col("y")).over(s),
    })
    rows = rows.withColumn("a", F.try_divide(F.col("n") * F.col("sx2y") - F.col("s2") * F.col("sy"), F.col("n") * F.col("s4") - F.col("s2") ** 2))
    rows = rows.withColumns({"b": F.try_divide("sxy", "s2"), "c": (F.col("sy") - F.col("a") * F.col("s2")) / F.col("n"), "mean": F.col("sy") / F.col("n")})
    curve = F.abs(F.col("y") - (F.col("a") * F.col("x") ** 2 + F.col("b") * F.col("x") + F.col("c")))
    straight = F.abs(F.col("y") - (F.col("b") * F.col("x") + F.col("mean")))
    return rows.groupBy("symbol").agg(F.first("a").alias("a"), F.first("b").alias("b"), F.avg(curve).alias("curve_residual"), F.avg(straight).alias("line_residual"))


def rounding_bottom(lines: DataFrame) -> DataFrame:
    """A low in the middle 35 to 65 % at least .10 under both ends, and a parabola that opens upwards and fits well enough."""
    ends = lines.withColumn("n", F.count("*").over(by_series())).groupBy("symbol").agg(
        F.min_by("idx", F.struct("y", "idx")).alias("low_idx"), F.min("y").alias("low"), F.min_by("y", "idx").alias("first"), F.max_by("y", "idx").alias("last"), F.max("n").alias("n")
    )
    rows = ends.join(curve_fit(lines), "symbol")
    shape = (F.col("low_idx") >= 0.35 * F.col("n")) & (F.col("low_idx") <= 0.65 * F.col("n")) & (F.least("first", "last") - F.col("low") >= 0.10)
    return rows.select("symbol", "low_idx", "a", (shape & (F.col("a") > 0) & (F.col("curve_residual") <= 0.6 * F.col("line_residual"))).alias("found"))


def pennant(lines: DataFrame) -> DataFrame:
    """A rise of .12 or more within the first .6 of a series and, after its top, ranges that converge by .15."""
    rows = lines.withColumn("n", F.count("*").over(by_series()))
    tops = rows.where("idx < 0.6 * n").groupBy("symbol").agg(F.max_by("idx", F.struct(F.col("y"), -F.col("idx"))).alias("top"), F.max("y").alias("high"), F.max("n").alias("n"))
    before = rows.drop("n").join(tops, "symbol")
    region = (F.col("idx") > F.col("top")) & (F.col("idx") <= F.col("top") + F.floor((F.col("n") - F.col("top")) * 0.65))
    half = F.col("idx") <= F.col("top") + F.floor((F.col("n") - F.col("top")) * 0.65 / 2)
    span = lambda when: F.max(F.when(when, F.col("y"))) - F.min(F.when(when, F.col("y")))
    rows = before.groupBy("symbol", "top").agg(
        (F.max("high") - F.min(F.when(F.col("idx") <= F.col("top"), F.col("y")))).alias("pole"), span(region & half).alias("r1"), span(region & ~half).alias("r2")
    )
    tightens = F.when(F.col("r1") > 0, 1 - F.col("r2") / F.col("r1"))
    return rows.select("symbol", "top", "pole", tightens.alias("convergence"), F.coalesce((F.col("pole") >= 0.12) & (tightens >= 0.15), F.lit(False)).alias("found"))


def squeezes(points: DataFrame) -> DataFrame:
    """Flat highs over rising lows, or flat lows under falling highs, with little net move."""
    kind = lambda high: F.col("is_high") if high else ~F.col("is_high")
    pick = lambda f, high: f(F.when(kind(high), F.col("price")), F.when(kind(high), F.col("idx")))
    span = lambda high: F.max(F.when(kind(high), F.col("price"))) - F.min(F.when(kind(high), F.col("price")))
    rows = points.groupBy("symbol").agg(
        F.count("*").alias("n"), span(True).alias("highs"), span(False).alias("lows"), (pick(F.max_by, True) - pick(F.min_by, True)).alias("high_move"), (pick(F.max_by, False) - pick(F.min_by, False)).alias("low_move"),
    )
    kind_of = F.when((F.col("highs") < 0.2) & (F.col("low_move") > 0.1), "squeeze_up").when((F.col("lows") < 0.2) & (F.col("high_move") < -0.1), "squeeze_down")
    return rows.where("n >= 4").select("symbol", "highs", "lows", "high_move", "low_move", kind_of.alias("type"))


def primary_types(candidates: DataFrame) -> DataFrame:
    """The surest type of each series (D24, T8); a runner-up less than .08 behind lowers it to .85 of its confidence.

    ``candidates``: symbol, type, confidence, ord; ties go to the lesser ``ord``.
    """
    best = candidates.groupBy("symbol", "type").agg(F.max("confidence").alias("confidence"), F.min("ord").alias("ord"))
    order = Window.partitionBy("symbol").orderBy(F.col("confidence").desc(), "ord")
    rows = best.withColumns({"_rn": F.row_number().over(order), "next": F.lead("confidence").over(order)}).where("_rn = 1")
    close = F.coalesce(F.col("confidence") - F.col("next") < 0.08, F.lit(False))
    return rows.select("symbol", "type", F.when(close, F.col("confidence") * 0.85).otherwise(F.col("confidence")).alias("confidence"))


def shared_types(candidates: DataFrame) -> DataFrame:
    """For each series, how many types it has in common with the series that is first by name."""
    sets = candidates.groupBy("symbol").agg(F.collect_set("type").alias("types"))
    first = sets.orderBy("symbol").limit(1).select(F.col("symbol").alias("first"), F.col("types").alias("_types"))
    rows = sets.crossJoin(F.broadcast(first))  # one row
    return rows.select("first", F.col("symbol").alias("second"), F.size(F.array_intersect("types", "_types")).alias("shared"))
