"""Operators whose next step depends on what they kept so far, as folds over the arrays of packed series.

A series' bars, or a few levels of it, are one array; Spark folds it where it stands, and series spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions import texts as T
from strandline.functions.texts import Text, added, column, for_columns
from strandline.operators import packed
from strandline.operators.packed import deviation, let, mean, part, steps


def zigzag_pivots(lines: DataFrame) -> DataFrame:
    """Alternating turns of normalised lines (W11, W13): symbol, idx, y, is_high."""
    rows = lines.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("idx", "y"))).alias("b")).select("symbol", F.col("b.idx").alias("at"), F.col("b.y").alias("line"))
    rows = added(rows, {"_turns": packed.zigzag_marks(T.col("line"))})
    rows = added(rows, {"m": packed.without_small(T.col("_turns"), T.col("line"))}).select("symbol", "at", "line", F.explode("m").alias("m"))
    return rows.select("symbol", F.get("at", F.col("m.idx")).cast("int").alias("idx"), F.get("line", F.col("m.idx")).alias("y"), F.col("m.is_high").alias("is_high"))


@for_columns
def touches(off: Text, tolerance: Text, gap: Text) -> Text:
    """Places whose distance ``off`` is within the tolerance, thinned (W9): of places nearer than ``gap``, the closest one holds."""
    def keep(kept: Text, i: Text) -> Text:
        last = T.try_element_at(kept, T.lit(-1))
        fresh = last.isNull() | (i - last >= gap)
        nearer = T.get(off, i) < T.get(off, last)
        return T.when(fresh, T.concat(kept, T.array(i))).when(nearer, T.concat(part(kept, 0, T.size(kept) - 1), T.array(i))).otherwise(kept)

    near = T.filter(T.sequence(T.lit(0), T.size(off) - 1), lambda i: T.get(off, i) <= tolerance)
    return T.aggregate(near, T.array().cast("array<int>"), keep)


@for_columns
def breakouts(beyond: Text, least: Text, gap: Text) -> Text:
    """Runs of two values of ``beyond`` over ``least``, at least ``gap`` places apart."""
    start = T.struct(T.lit(0).alias("run"), (-gap).cast("int").alias("last"), T.lit(0).alias("n"))

    def step(s: Text, i: Text) -> Text:
        run = T.when(T.get(beyond, i) > least, s.run + 1).otherwise(0)
        counts = (run >= 2) & (i - s.last >= gap)
        return T.struct(T.when(counts, 0).otherwise(run).alias("run"), T.when(counts, i).otherwise(s.last).alias("last"), (s.n + counts.cast("int")).alias("n"))

    return T.aggregate(T.sequence(T.lit(0), T.size(beyond) - 1), start, step, lambda s: s.n)


def _once(rows: DataFrame, columns: dict[str, Text]) -> DataFrame:
    """Adds columns that are worked out once a row. A filter on a plain one would take its expression, and those of the columns it names, into each step of its folds."""
    rows = rows.withColumn("_once", F.explode(F.array(F.struct(*[column(c).alias(n) for n, c in columns.items()]))))
    return rows.select("*", *[f"_once.{n}" for n in columns]).drop("_once")


def trend_lines(bars: DataFrame, least: int = 3) -> DataFrame:
    """Lines through each two pivots of a kind of a series with touches, breakouts and a quality from 0 to 100.

    A series is packed once; each pair of its pivots is a row that carries the prices, so a line's fold over the bars is one row's work
    and lines spread over tasks. Columns: symbol, n, is_high, left, right, slope, intercept, touches, breakouts, quality.
    """
    rows = packed.pack(bars)
    sides = F.explode(F.array(*[F.struct(F.lit(high).alias("is_high"), F.col(c).alias("prices")) for c, high in (("highs", True), ("lows", False))]))
    rows = rows.withColumn("whole", F.array_max("highs") - F.array_min("lows")).select("symbol", "closes", "whole", F.size("closes").alias("n"), sides.alias("s"))
    rows = rows.select("symbol", "closes", "whole", "n", "s.is_high", "s.prices", F.greatest(F.lit(2), F.floor(F.col("n") / 20).cast("int")).alias("k")).where("n >= 20")
    around = lambda i: part("prices", i - T.col("k"), i + T.col("k") + 1)
    best = lambda i: T.when(T.col("is_high"), T.array_max(around(i))).otherwise(T.array_min(around(i)))
    rows = added(rows, {"ends": T.filter(T.sequence(T.col("k"), T.col("n") - T.col("k") - 1), lambda i: T.get("prices", i) == best(i))})
    pairs = T.flatten(T.transform("ends", lambda i: T.transform(T.filter("ends", lambda j: j > i), lambda j: T.struct(i.alias("left"), j.alias("right")))))
    rows = rows.withColumn("pair", F.explode(column(pairs))).select("*", "pair.left", "pair.right").drop("pair", "ends")
    rows = rows.repartition("symbol", "is_high", "left", "right")  # a series' lines are work for many tasks
    slope = (T.get("prices", T.col("right")) - T.get("prices", T.col("left"))) / (T.col("right") - T.col("left"))
    rows = added(rows, {"slope": slope})
    rows = added(rows, {"intercept": T.get("prices", T.col("left")) - T.col("slope") * T.col("left")})
    from_line = lambda a: T.transform(a, lambda v, x: v - T.col("intercept") - T.col("slope") * x)
    sign = T.when(T.col("is_high"), 1.0).otherwise(-1.0)
    rows = _once(rows, {"off": T.transform(from_line("prices"), lambda v: T.abs(v)), "beyond": T.transform(from_line("closes"), lambda v: v * sign)})
    rows = _once(rows, {"at": touches(T.col("off"), 0.0015 * T.col("whole"), T.col("k")), "breakouts": breakouts(T.col("beyond"), 0.003 * T.col("whole"), T.col("k"))})
    rows = rows.withColumn("touches", F.size("at")).where((F.col("touches") >= least) & (F.col("breakouts") < 3))
    gaps = steps(T.transform("at", lambda v: v.cast("double")))
    rows = added(rows, {"even": let(gaps, lambda g: 1 / (1 + deviation(g) / mean(g))), "away": mean(T.transform("at", lambda x: T.get("off", x))) / T.col("whole") * 100})
    reach = (F.element_at("at", -1) - F.get("at", F.lit(0))) / F.col("n")
    score = 20 * F.col("touches") + 30 * (1 - F.col("away") / 0.15) + 25 * reach + 25 * F.col("even") - 15 * F.col("breakouts")
    return rows.select("symbol", "n", "is_high", "left", "right", "slope", "intercept", "touches", "breakouts", F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)).alias("quality"))


_TREND = "struct<quality: double, slope: double, intercept: double, touches: int, breakouts: int, is_high: boolean>"


def trend_levels(bars: DataFrame, least: int = 3, keep: int = 10) -> DataFrame:
    """The best ``keep`` lines of ``trend_lines`` of each series (L1, L2, T3): a line is left out if a kept one of its kind is as steep and near it in the middle of the series."""
    made = trend_lines(bars, least)
    one = F.struct((-F.col("quality")).alias("o"), (~F.col("is_high")).alias("low"), "left", "right", F.struct("quality", "slope", "intercept", F.col("touches").cast("int").alias("touches"), F.col("breakouts").cast("int").alias("breakouts"), "is_high").alias("c"))
    rows = made.groupBy("symbol", "n").agg(F.array_sort(F.collect_list(one)).alias("sorted"))

    def merge(kept: Text, row: Text) -> Text:
        c = row.c
        middle = lambda o: o.intercept + o.slope * T.col("n") / 2
        same = lambda o: (o.is_high == c.is_high) & (T.abs(middle(o) - middle(c)) / (T.abs(o.intercept) + 1e-10) < 0.005) & (T.abs(o.slope - c.slope) < 0.01)
        return T.when(T.exists(kept, same), kept).otherwise(T.concat(kept, T.array(c)))

    rows = added(rows, {"kept": T.slice(T.aggregate("sorted", T.array().cast(f"array<{_TREND}>"), merge), 1, keep)}).select("symbol", F.explode("kept").alias("c"))
    return rows.select("symbol", "c.is_high", "c.slope", "c.intercept", "c.touches", "c.breakouts", "c.quality")


def consensus_lines(points: DataFrame, scale: DataFrame, least: int = 3) -> DataFrame:
    """The line with most pivots of a kind within half a scale, over all pairs of them, refitted to those (L6): symbol, is_high, slope, intercept, touches, strength.

    In place of random samples: every pair is tried; ties go to the smaller mean distance, then to the earlier pair. Joins on (symbol, is_high).
    """
    keys = ["symbol", "is_high"]
    p = points.join(scale, "symbol")
    ends = lambda i, v: p.select(*keys, F.col("idx").alias(i), F.col("price").alias(v))
    pairs = ends("i", "pi").join(ends("j", "pj"), keys).where("i < j").withColumn("steep", F.try_divide(F.col("pj") - F.col("pi"), F.col("j") - F.col("i")))
    off = F.abs(F.col("price") - (F.col("pi") + F.col("steep") * (F.col("idx") - F.col("i"))))
    near = pairs.join(p, keys).withColumn("off", off).where(F.col("off") <= 0.5 * F.col("vol_scale"))
    best = near.groupBy(*keys, "i", "j").agg(F.count("*").alias("m"), F.round(F.avg("off"), 9).alias("off")).where(F.col("m") >= least)
    best = best.groupBy(*keys).agg(F.min(F.struct((-F.col("m")).alias("o"), "off", "i", "j")).alias("b")).select(*keys, "b.i", "b.j")
    fitted = near.drop("off").join(best, [*keys, "i", "j"]).groupBy(*keys).agg(F.regr_slope("price", "idx").alias("slope"), F.regr_intercept("price", "idx").alias("intercept"), F.count("*").cast("int").alias("touches"), (F.max("idx") - F.min("idx")).alias("reach"))
    whole = p.groupBy(*keys).agg((F.max("idx") - F.min("idx")).alias("whole"))
    strength = 0.5 * F.least(F.lit(1.0), F.col("touches") / 5) + 0.5 * F.col("reach") / F.greatest(F.lit(1), F.col("whole"))
    return fitted.join(whole, keys).select(*keys, "slope", "intercept", "touches", strength.alias("strength"))


def merge_levels(levels: DataFrame, scale: DataFrame) -> DataFrame:
    """Levels of a kind within .3 scales of a stronger one join it: strengths add up to at most 1 (L8); a series has a few dozen levels. A ``source`` column stays that of the stronger."""
    kept_fields = {"strength": "double", "price": "double", "is_high": "boolean", "touches": "int", "first_touch": "int", "last_touch": "int"} | ({"source": "string"} if "source" in levels.columns else {})
    one = F.struct(*[F.col(c).cast(k).alias(c) for c, k in kept_fields.items()])
    rows = levels.groupBy("symbol").agg(F.collect_list(one).alias("all")).join(scale, "symbol")

    def join(kept: Text, c: Text) -> Text:
        near = lambda o: (o.is_high == c.is_high) & (T.abs(o.price - c.price) < 0.3 * T.col("vol_scale"))
        host = T.array_position(T.transform(kept, near), T.lit(True))
        changed = {"strength": lambda o: T.least(T.lit(1.0), o.strength + c.strength), "touches": lambda o: T.greatest(o.touches, c.touches), "first_touch": lambda o: T.least(o.first_touch, c.first_touch), "last_touch": lambda o: T.greatest(o.last_touch, c.last_touch)}
        joined = lambda o: T.struct(*[(changed[f](o) if f in changed else getattr(o, f)).alias(f) for f in kept_fields])
        return T.when(host == 0, T.concat(kept, T.array(c))).otherwise(T.transform(kept, lambda o, i: T.when(i + 1 == host, joined(o)).otherwise(o)))

    strongest = T.transform(T.array_sort(T.transform("all", lambda c: T.struct((-c.strength).alias("s"), c.price.alias("p"), c.alias("c")))), lambda x: x.c)
    kind = ", ".join(f"{c}: {k}" for c, k in kept_fields.items())
    rows = added(added(rows, {"sorted": strongest}), {"kept": T.aggregate("sorted", T.array().cast(f"array<struct<{kind}>>"), join)})
    out = ["is_high", "price", "touches", "first_touch", "last_touch", "strength", *(["source"] if "source" in kept_fields else [])]
    return rows.select("symbol", F.explode("kept").alias("c")).select("symbol", *[f"c.{c}" for c in out])
