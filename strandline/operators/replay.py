"""Replay: a detector judges the window behind every bar, as it would have at that time, and what it says is followed from step to step.

Series are cut into blocks of ``CHUNK`` steps that also hold the bars their first windows reach back to, so a long history is many rows, each bar moves
about once and no row holds more than a block. Every step is then a packed series of its own (see ``packed``), or rows of bars for detectors that are joins and windows.
A series of under ``n`` bars has no step. Rows whose keys are alike are one series; bars of one time keep the order of their close.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators import detectors, validation

CHUNK = 400
_BAR = ["idx", "open_time", "high", "low", "close", "volume"]


def placed(bars: DataFrame, *keys: str) -> DataFrame:
    """Adds ``idx``: the place of each bar of the whole series in order of time."""
    return bars.withColumn("idx", F.row_number().over(Window.partitionBy(*keys).orderBy("open_time", "close")) - 1)


def steps(bars: DataFrame, n: int = 100, keys: tuple[str, ...] = ("symbol",), chunk: int = CHUNK) -> DataFrame:
    """The last ``n`` bars at every step (W22): keys, ``step`` (place of the newest bar) and ``bars``, an array in order. ``bars`` has idx without gaps."""
    block = F.explode(F.sequence(F.floor(F.col("idx") / chunk), F.floor((F.col("idx") + n - 1) / chunk)))
    rows = bars.select(*keys, F.struct(*_BAR).alias("bar"), block.alias("_block"))
    rows = rows.groupBy(*keys, "_block").agg(F.array_sort(F.collect_list("bar")).alias("_all"))
    newest = F.filter(F.sequence(F.lit(n - 1), F.size("_all") - 1), lambda i: F.get("_all", i)["idx"] >= F.col("_block") * chunk)
    rows = rows.where(F.size("_all") >= n).select(*keys, "_all", F.explode(newest).alias("_at"))
    return rows.select(*keys, F.get("_all", F.col("_at"))["idx"].alias("step"), F.slice("_all", F.col("_at") - (n - 2), F.lit(n)).alias("bars"))


def step_bars(rows: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Bars of ``steps`` as rows with ``idx`` from 0, for detectors over rows."""
    rows = rows.select(*keys, "step", F.posexplode("bars").alias("idx", "bar"))
    return rows.select(*keys, "step", "idx", *[F.col(f"bar.{c}").alias(c) for c in _BAR[1:]])


def detections(bars: DataFrame, n: int = 100, keys: tuple[str, ...] = ("symbol",), settle: Callable[[DataFrame], DataFrame] = lambda rows: rows, chunk: int = CHUNK) -> DataFrame:
    """Rows of ``detectors.causal`` at every step that passes the quality gate, with all they are judged by; places are those in the window."""
    every = settle(detectors.structures_of(_packed(steps(bars, n, keys, chunk), keys).repartition(*keys, "step"), settle))
    return detectors.causal(every)


def _packed(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return rows.select(*keys, "step", F.col("bars.close").alias("closes"), F.col("bars.high").alias("highs"), F.col("bars.low").alias("lows"), F.transform("bars.volume", lambda v: v.cast("double")).alias("volumes"), F.col("bars.open_time").alias("times"))


def replay_structures(bars: DataFrame, n: int = 100, keys: tuple[str, ...] = ("symbol",), settle: Callable[[DataFrame], DataFrame] = lambda rows: rows, chunk: int = CHUNK) -> DataFrame:
    """The structure at every step (V1): keys, step, time, type, state, way, confidence, is_active, candidate_at and confirmed_at as places in the whole series.

    A step sees no later bar. Windows that are flat or fail the quality gate have no type and the state ``none``.
    """
    every = settle(detectors.structures_of(_packed(steps(bars, n, keys, chunk), keys).repartition(*keys, "step"), settle))
    first = F.col("step") - (n - 1)
    time = F.element_at("times", -1).alias("time")
    found = detectors.causal(every).select(*keys, "step", time, "type", "state", "way", "confidence", "is_active", (first + F.col("candidate_at")).alias("candidate_at"), (first + F.col("confirmed_at")).alias("confirmed_at"))
    rest = every.where("not (size(closes) >= 11 and passes)")
    null = lambda kind, name: F.lit(None).cast(kind).alias(name)
    rest = rest.select(*keys, "step", time, null("string", "type"), F.lit("none").alias("state"), null("string", "way"), F.lit(0.0).alias("confidence"), F.lit(False).alias("is_active"), null("int", "candidate_at"), null("int", "confirmed_at"))
    return found.unionByName(rest)


def changes(rows: DataFrame, *said: str, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Steps at which any of the columns ``said`` differs from the step before, nulls being a value (W24); the first step of a series always counts. Adds ``was_`` columns."""
    order = Window.partitionBy(*keys).orderBy("step")
    before = {f"was_{c}": F.lag(c).over(order) for c in said}
    rows = rows.withColumns(before | {"_first": F.lag("step").over(order).isNull()})
    differs: Column = F.col("_first")
    for c in said:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"was_{c}"))
    return rows.where(differs).drop("_first")


def active_sets(rows: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """What is active at each step, as ``patterns``: the type where it is active, else nothing."""
    return rows.select(*keys, "step", F.array_compact(F.array(F.when(F.col("is_active"), F.col("type")))).alias("patterns"))


def totals(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Totals of a replay (V2, G9, G10): one row a pattern, a timeframe and overall (``by``), from one pass of grouping sets.

    ``rows``: symbol, timeframe, step, type, is_active (a row a step); ``labels``: symbol, timeframe, pattern_type, start, end. events and confirmed count steps with a
    type. Timeframes also have the mean of their series' repaint rates (a rate per symbol and timeframe). tp, fp and fn are sums over series of ``match_events``, patterns
    apart, so precision, recall and f1 of the whole are micro ones. Rates without a case are 0.
    """
    series = F.to_json(F.struct("symbol", "timeframe"))  # one key for both, whatever they hold
    events = rows.where("type is not null").withColumn("pattern_type", F.col("type"))
    counts = events.groupBy("timeframe", "pattern_type").agg(F.count("*").alias("events"), F.count_if("is_active").alias("confirmed"))
    named = lambda df: df.withColumn("symbol", series)
    hits = validation.match_events(named(events.withColumn("idx", F.col("step"))), named(labels), by_type=True)
    hits = hits.withColumn("timeframe", F.get_json_object("symbol", "$.timeframe"))
    parts = counts.select("timeframe", "pattern_type", "events", "confirmed", *[F.lit(0).cast("long").alias(c) for c in ("tp", "fp", "fn")])
    parts = parts.unionByName(hits.select("timeframe", "pattern_type", *[F.lit(0).cast("long").alias(c) for c in ("events", "confirmed")], "tp", "fp", "fn"))
    sums = [F.sum(c).alias(c) for c in ("events", "confirmed", "tp", "fp", "fn")]
    both = parts.groupingSets([["pattern_type"], ["timeframe"], []], "pattern_type", "timeframe").agg(F.grouping_id().alias("g"), *sums)
    repaint = validation.repaint_rate(named(active_sets(rows, ("symbol", "timeframe"))))
    repaint = repaint.groupBy(F.get_json_object("symbol", "$.timeframe").alias("timeframe")).agg(F.avg("rate").alias("repaint_rate"))
    both = both.join(repaint, "timeframe", "left")
    rate = lambda a, b: F.coalesce(F.try_divide(F.col(a), b), F.lit(0.0))
    both = both.withColumns({"precision": rate("tp", F.col("tp") + F.col("fp")), "recall": rate("tp", F.col("tp") + F.col("fn"))})
    both = both.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))
    kind = F.when(F.col("g") == 1, "pattern").when(F.col("g") == 2, "timeframe").otherwise("all")
    return both.select(kind.alias("by"), F.coalesce("pattern_type", "timeframe").alias("name"), "events", "confirmed", "tp", "fp", "fn", "precision", "recall", "f1", F.when(F.col("g") == 2, F.coalesce("repaint_rate", F.lit(0.0))).alias("repaint_rate"))
