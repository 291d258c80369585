"""All levels of a series (L9): zones, volume profile and round prices of each kind, merged, and the two trend lines with their channel flag.

Every source is rows (series key, price): joins on the key and aggregations. Only the choice which candidate stands too near to one accepted before depends
on order; it is a fold over a series' dozen candidates. Series of under 20 bars or without range have no levels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import texts as T
from strandline.functions.texts import Text, added
from strandline.operators import folds, levels, windows

LEAST_BARS = 20
#: Widths as parts of the scale, strengths of the sources, least touches of a line, and how unlike slopes of a channel may be.
ZONE_EPS, TOO_NEAR, TOUCH, LINE_OFF = 0.5, 0.3, 0.5, 0.5
PROFILE_BASE, ROUND_BASE = 0.25, 0.2
LEAST_TOUCHES = 3
PARALLEL = 0.05


def pivots(bars: DataFrame) -> DataFrame:
    """Highs and lows that are the greatest or least within a twentieth of the series (2 at least) on either side: symbol, idx, is_high, price."""
    rows = bars.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("idx", "high", "low"))).alias("b"))
    rows = rows.select("symbol", F.explode(F.array(*[F.struct(F.lit(h).alias("is_high"), F.col(f"b.{c}").alias("p")) for h, c in ((True, "high"), (False, "low"))])).alias("s"))
    rows = rows.select("symbol", "s.is_high", "s.p", F.greatest(F.lit(2), F.floor(F.size("s.p") / 20).cast("int")).alias("k")).where("size(p) >= 2 * k + 1")
    near = lambda i: T.slice("p", i - T.col("k") + 1, 2 * T.col("k") + 1)
    best = lambda i: T.when(T.col("is_high"), T.array_max(near(i))).otherwise(T.array_min(near(i)))
    ends = T.filter(T.sequence(T.col("k"), T.size("p") - T.col("k") - 1), lambda i: T.get("p", i) == best(i))
    rows = added(rows, {"ends": ends}).select("symbol", "is_high", "p", F.explode("ends").alias("idx"))
    return rows.select("symbol", "idx", "is_high", F.get("p", F.col("idx")).alias("price"))


def facts(bars: DataFrame) -> DataFrame:
    """One row a series that can have levels: symbol, vol_scale, n, last, mean_volume."""
    one = bars.groupBy("symbol").agg(F.count("*").alias("n"), F.max_by("close", "idx").alias("last"), F.avg("volume").alias("mean_volume"))
    return one.where(F.col("n") >= LEAST_BARS).join(windows.vol_scale(bars), "symbol").where("vol_scale > 0")


def _strength(touches: Column, last: Column, volume: Column, base: float) -> Column:
    """Base + .5 for up to five touches + .2 for a late last one + .3 for their volume against the mean (G14), within 0 and 1, four places."""
    heavy = F.when((F.col("mean_volume") > 0) & volume.isNotNull(), F.least(F.lit(1.0), volume / (F.col("mean_volume") + 1e-9))).otherwise(0.0)
    whole = base + 0.5 * F.least(F.lit(1.0), touches / 5) + 0.2 * F.coalesce(last, F.lit(0)) / F.greatest(F.col("n") - 1, F.lit(1)) + 0.3 * heavy
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), whole)), 4)


def _touched(candidates: DataFrame, bars: DataFrame, near: Column) -> DataFrame:
    """Candidates (symbol, price, source, o) with the bars that are ``near`` their price (J12): touches, first_touch, last_touch, volume."""
    rows = candidates.join(bars.select("symbol", "idx", "high", "low", "close", F.col("volume").alias("_v")), "symbol").groupBy("symbol", "price", "source", "o", "vol_scale", "n", "last", "mean_volume")
    hit = lambda c: F.when(near, F.col(c))
    return rows.agg(F.count_if(near).alias("touches"), F.min(hit("idx")).alias("first_touch"), F.max(hit("idx")).alias("last_touch"), F.avg(hit("_v")).alias("volume"))


def zone_levels(points: DataFrame, bars: DataFrame, known: DataFrame) -> DataFrame:
    """Clusters of pivots of a kind (L3); touches are the cluster's pivots."""
    order = Window.partitionBy("symbol", "is_high").orderBy("price", "idx")
    rows = points.join(known, "symbol").join(bars.select("symbol", "idx", F.col("volume").alias("_v")), ["symbol", "idx"])
    apart = F.col("price") - F.lag("price").over(order) > F.greatest(ZONE_EPS * F.col("vol_scale"), F.lit(1e-9))
    rows = rows.withColumn("_new", F.coalesce(apart.cast("int"), F.lit(1))).withColumn("zone", F.sum("_new").over(order))
    rows = rows.groupBy("symbol", "is_high", "zone", "n", "mean_volume").agg(F.percentile("price", F.lit(0.5)).alias("price"), F.count("*").alias("touches"), F.min("idx").alias("first_touch"), F.max("idx").alias("last_touch"), F.avg("_v").alias("volume"))
    return rows.where("touches >= 2").select("symbol", "is_high", "price", "touches", "first_touch", "last_touch", _strength(F.col("touches"), F.col("last_touch"), F.col("volume"), 0.0).alias("strength"), F.lit("zone").alias("source"))


def profile_candidates(bars: DataFrame, known: DataFrame) -> DataFrame:
    """Centres of the fullest bin and of the ends of the value area (L4), in that order; series without volume or range have none."""
    moving = bars.groupBy("symbol").agg(F.max("volume").alias("_v"), F.max("close").alias("_hi"), F.min("close").alias("_lo")).where("_v > 0 and _hi > _lo").select("symbol")
    histogram = levels.volume_histogram(bars.join(moving, "symbol", "left_semi"))
    area = levels.value_area(histogram).join(histogram.select("symbol", "lo", "width").distinct(), "symbol")
    centre = lambda c: F.col("lo") + (F.col(c) + 0.5) * F.col("width")
    three = F.array(*[F.struct(centre(c).alias("price"), F.lit(s).alias("source"), F.lit(o).alias("o")) for o, (c, s) in enumerate((("poc", "volume_poc"), ("high_bin", "volume_vah"), ("low_bin", "volume_val")))])
    return area.select("symbol", F.explode(three).alias("c")).select("symbol", "c.*").join(known, "symbol")


def round_candidates(known: DataFrame) -> DataFrame:
    """Round prices around the last close (L5), rising."""
    rows = known.withColumn("step", levels.nice("vol_scale")).withColumn("k", F.explode(F.sequence(F.lit(-3), F.lit(3))))
    rows = rows.withColumn("price", (F.rint(F.col("last") / F.col("step")) + F.col("k")) * F.col("step")).where("price > 0")
    return rows.select("symbol", "price", F.lit("round_number").alias("source"), (F.col("k") + 10).alias("o"), *[c for c in known.columns if c != "symbol"])


def horizontal_levels(bars: DataFrame, points: DataFrame, known: DataFrame) -> DataFrame:
    """Levels of all sources by kind (U1, U2), merged (L8): symbol, is_high, price, touches, first_touch, last_touch, strength, source.

    Profile and round prices stand aside within .3 scales of a zone or of one accepted before (J13); a round price needs a touch by a high or low. Their
    kind is that of their place to the last close.
    """
    reach = TOUCH * F.col("vol_scale")
    zones = zone_levels(points, bars, known)
    profile = _touched(profile_candidates(bars, known), bars, F.abs(F.col("close") - F.col("price")) <= reach)
    rounds = _touched(round_candidates(known), bars, (F.abs(F.col("high") - F.col("price")) <= reach) | (F.abs(F.col("low") - F.col("price")) <= reach)).where("touches > 0")
    made = profile.withColumn("strength", _strength(F.greatest(F.lit(1), F.col("touches")), F.col("last_touch"), F.col("volume"), PROFILE_BASE))
    made = made.unionByName(rounds.withColumn("strength", _strength(F.col("touches"), F.col("last_touch"), F.col("volume"), ROUND_BASE)))
    newest = F.col("n") - 1
    made = made.select("symbol", "vol_scale", F.struct("o", "price", (F.col("price") > F.col("last")).alias("is_high"), F.col("touches").cast("int").alias("touches"), F.coalesce("first_touch", newest).cast("int").alias("first_touch"), F.coalesce("last_touch", newest).cast("int").alias("last_touch"), "strength", "source").alias("c"))
    offered = made.groupBy("symbol", "vol_scale").agg(F.array_sort(F.collect_list("c")).alias("offered"))
    taken = zones.groupBy("symbol").agg(F.collect_list("price").alias("taken"))
    offered = offered.join(taken, "symbol", "left").withColumn("taken", F.coalesce("taken", F.array().cast("array<double>")))

    def accept(kept: Text, c: Text) -> Text:
        near = lambda price: T.abs(price - c.price) < TOO_NEAR * T.col("vol_scale")
        return T.when(T.exists("taken", near) | T.exists(kept, lambda k: near(k.price)), kept).otherwise(T.concat(kept, T.array(c)))

    kind = "array<struct<o: int, price: double, is_high: boolean, touches: int, first_touch: int, last_touch: int, strength: double, source: string>>"
    accepted = added(offered, {"kept": T.aggregate("offered", T.array().cast(kind), accept)}).select("symbol", F.explode("kept").alias("c")).select("symbol", "c.*").drop("o")
    return folds.merge_levels(zones.unionByName(accepted), known.select("symbol", "vol_scale"))


def trendlines(points: DataFrame, known: DataFrame) -> DataFrame:
    """The line of a series' highs and that of its lows (L6): symbol, is_high, slope, intercept, touches, start, end, strength, method, is_channel.

    The line through two pivots with most pivots of its kind within half a scale, ties to the least mean distance, then to the earlier pair, fitted anew to
    those (method ``consensus``; every pair is tried, so nothing is random). With under three, the median line (``median``: median of all slopes between pairs, median of
    what it leaves), if three pivots are within half a scale of it. ``is_channel``: both lines are there and their slopes differ by at most a twentieth of the larger.
    """
    p = points.join(known.select("symbol", "vol_scale", "n"), "symbol").withColumn("tol", F.greatest(LINE_OFF * F.col("vol_scale"), F.lit(1e-9)))
    keys = ["symbol", "is_high"]
    pairs = p.select(*keys, F.col("idx").alias("i"), F.col("price").alias("pi")).join(p.select(*keys, F.col("idx").alias("j"), F.col("price").alias("pj")), keys).where("i < j")
    pairs = pairs.withColumn("slope", F.try_divide(F.col("pj") - F.col("pi"), F.col("j") - F.col("i")))
    off = F.abs(F.col("price") - (F.col("pi") + F.col("slope") * (F.col("idx") - F.col("i"))))
    near = pairs.join(p, keys).withColumn("off", off).where("off <= tol").groupBy(*keys, "i", "j").agg(F.count("*").alias("m"), F.round(F.avg("off"), 9).alias("off"))
    best = near.groupBy(*keys).agg(F.min(F.struct((-F.col("m")).alias("o"), "off", "i", "j")).alias("b")).select(*keys, "b.i", "b.j", (-F.col("b.o")).alias("m"))
    fitted = pairs.join(best.where(F.col("m") >= LEAST_TOUCHES), [*keys, "i", "j"]).join(p, keys).where(off <= F.col("tol"))
    fitted = fitted.groupBy(*keys, "n").agg(F.regr_slope("price", "idx").alias("slope"), F.regr_intercept("price", "idx").alias("intercept"), F.count("*").alias("touches"), F.min("idx").alias("start"), F.max("idx").alias("end")).withColumn("method", F.lit("consensus"))
    middle = pairs.join(best.where(F.col("m") < LEAST_TOUCHES), keys).groupBy(*keys).agg(F.percentile("slope", F.lit(0.5)).alias("slope"))
    middle = p.join(middle, keys).withColumn("rest", F.col("price") - F.col("slope") * F.col("idx"))
    base = middle.groupBy(*keys).agg(F.percentile("rest", F.lit(0.5)).alias("intercept"))
    middle = middle.join(base, keys).where(F.abs(F.col("rest") - F.col("intercept")) <= F.col("tol")).groupBy(*keys, "n", "slope", "intercept").agg(F.count("*").alias("touches"), F.min("idx").alias("start"), F.max("idx").alias("end"))
    lines = fitted.unionByName(middle.where(F.col("touches") >= LEAST_TOUCHES).withColumn("method", F.lit("median")))
    strength = 0.5 * F.least(F.lit(1.0), F.col("touches") / 5) + 0.5 * (F.col("end") - F.col("start")) / F.greatest(F.col("n") - 1, F.lit(1))
    two = Window.partitionBy("symbol")
    apart = (F.max("slope").over(two) - F.min("slope").over(two)) / F.greatest(F.max(F.abs("slope")).over(two), F.lit(1e-9))
    lines = lines.withColumns({"strength": F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), strength)), 4), "is_channel": (F.count("*").over(two) == 2) & (apart <= PARALLEL)})
    return lines.select(*keys, "slope", "intercept", "touches", "start", "end", "strength", "method", "is_channel")


def level_matches(bars: DataFrame, least_strength: float = 0.0) -> DataFrame:
    """All levels as match rows (L10, F11): structure_type ``level_support`` or ``level_resistance``, score in hundredths of strength, the line and where it stands at the last bar."""
    known = facts(bars)
    points = pivots(bars).join(known.select("symbol"), "symbol", "left_semi")
    flat = horizontal_levels(bars, points, known).select("symbol", "is_high", F.lit(0.0).alias("slope"), F.col("price").alias("intercept"), F.col("touches").cast("long").alias("touches"), "first_touch", "last_touch", "strength", "source", F.lit(False).alias("is_trendline"), F.lit(None).cast("boolean").alias("is_channel"))
    steep = trendlines(points, known).select("symbol", "is_high", "slope", "intercept", "touches", F.col("start").cast("int").alias("first_touch"), F.col("end").cast("int").alias("last_touch"), "strength", F.lit("trendline").alias("source"), F.lit(True).alias("is_trendline"), "is_channel")
    rows = flat.unionByName(steep).where(F.col("strength") >= least_strength).join(known.select("symbol", "n"), "symbol")
    side = F.when(F.col("is_high"), "resistance").otherwise("support")
    label = F.when(F.col("slope") > 1e-9, "rising").when(F.col("slope") < -1e-9, "falling").otherwise("horizontal")
    return rows.select("symbol", F.concat(F.lit("level_"), side).alias("structure_type"), F.round(100 * F.col("strength"), 1).alias("score"), "slope", "intercept", (F.col("slope") * (F.col("n") - 1) + F.col("intercept")).alias("price_at_last"), "touches", "first_touch", "last_touch", label.alias("slope_label"), "source", "is_trendline", "is_channel")
