"""What scans make of structures: filters, one hit a series, scores with volume and timeframes, and the structure that stands behind a match.

Rows have symbol, timeframe (``4h``, or ``4h_w30`` for a window), ord (the whole series first), type, confidence, patterns (a map), is_active and volume_confirmation.
All steps are filters, aggregations on (symbol, timeframe) and joins on it; no window sees all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Factors for two and for three timeframes of a symbol, and bounds of volume that raise or lower a confidence.
TWO, THREE = 1.04, 1.08
HEAVY, LIGHT = 0.7, 0.3


def base_timeframe(timeframe: str = "timeframe") -> Column:
    """The timeframe without its window."""
    return F.split_part(timeframe, F.lit("_w"), F.lit(1))


def holds_type(kind: str) -> Column:
    """Whether a structure is of the type or has it among its patterns (F9); null types are of none."""
    return F.coalesce(F.col("type") == kind, F.lit(False)) | F.coalesce(F.map_contains_key("patterns", F.lit(kind)), F.lit(False))


def type_hits(rows: DataFrame, kind: str, timeframe: str | None = None, confirmed: bool = False) -> DataFrame:
    """Series that show a type (F8 to F10): symbol, timeframe, is_primary, score, timeframes; one row a symbol and base timeframe.

    Of a series' own structure and its windows the first active one counts. A primary type scores 100, another one its confidence in hundredths, raised by heavy and lowered by
    light volume; symbols that show the type on two or more timeframes, active or not, score higher, at most 100. ``timeframe`` keeps one base timeframe, ``confirmed``
    rows whose ``state`` is confirmed. Rows without a type count in nothing.
    """
    shown = rows.where(F.col("type").isNotNull() & holds_type(kind)).withColumn("_base", base_timeframe())
    wide = shown.groupBy("symbol").agg(F.count_distinct("_base").alias("timeframes"))
    shown = shown.where("is_active")
    if timeframe is not None:
        shown = shown.where(F.col("_base") == timeframe)
    if confirmed:
        shown = shown.where("state = 'confirmed'")
    sure = F.coalesce(F.try_element_at("patterns", F.lit(kind)), F.col("confidence"))
    volume = F.col("volume_confirmation")
    sure = F.when(volume > HEAVY, F.least(F.lit(1.0), sure * (1 + (volume - HEAVY) * 0.3))).when(volume < LIGHT, sure * 0.85).otherwise(sure)
    primary = F.coalesce(F.col("type") == kind, F.lit(False))
    one = F.struct("ord", "timeframe", primary.alias("is_primary"), F.when(primary, 100.0).otherwise(F.round(100 * sure, 1)).alias("score"))
    hits = shown.groupBy("symbol", "_base").agg(F.min(one).alias("h")).join(wide, "symbol")
    factor = F.when(F.col("timeframes") >= 3, THREE).when(F.col("timeframes") >= 2, TWO).otherwise(1.0)
    return hits.select("symbol", F.col("_base").alias("timeframe"), "h.is_primary", F.round(F.least(F.lit(100.0), F.col("h.score") * factor), 1).alias("score"), "timeframes")


def standing_structures(matches: DataFrame, rows: DataFrame) -> DataFrame:
    """Each match (match_id, symbol, timeframe) with the current structure of its symbol and base timeframe (J18): the whole series', else its first window's; null without one."""
    first = rows.where(F.col("type").isNotNull()).groupBy("symbol", base_timeframe().alias("_base")).agg(F.min(F.struct("ord", "timeframe", "type", "confidence")).alias("s"))
    found = matches.withColumn("_base", base_timeframe()).join(first, ["symbol", "_base"], "left")
    return found.select("match_id", "symbol", "timeframe", F.col("s.timeframe").alias("found_in"), F.col("s.type").alias("type"), F.col("s.confidence").alias("confidence"))


def relevant(scored: DataFrame, least: float = 0.5) -> DataFrame:
    """Adds ``is_relevant``: whether the score reaches the threshold (F13); rows without a score are relevant."""
    return scored.withColumn("is_relevant", F.coalesce(F.col("ml_score") >= least, F.lit(True)))


def labels_of(labels: DataFrame, symbol: str | None = None, timeframe: str | None = None) -> DataFrame:
    """Labels of a symbol, of a timeframe, or all."""
    for column, value in (("symbol", symbol), ("timeframe", timeframe)):
        labels = labels if value is None else labels.where(F.col(column) == value)
    return labels


def label_counts(labels: DataFrame) -> DataFrame:
    """Labels by type and in all (G17): name (null for all) and n."""
    return labels.groupingSets([["pattern_type"], []], "pattern_type").agg(F.count("*").alias("n")).withColumnRenamed("pattern_type", "name")


def scan_statistics(symbols: DataFrame, rows: DataFrame) -> DataFrame:
    """One row (G12): total_symbols, symbols_with_data (with any structure) and total_structures, of the asked symbols alone."""
    own = rows.where(F.col("type").isNotNull()).join(symbols.select("symbol").distinct(), "symbol", "left_semi")
    return symbols.agg(F.count_distinct("symbol").alias("total_symbols")).crossJoin(F.broadcast(own.agg(F.count_distinct("symbol").alias("symbols_with_data"), F.count("*").alias("total_structures"))))  # one row each
