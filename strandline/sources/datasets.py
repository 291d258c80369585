"""Labelled series as JSON files (S15): one object a series with its label and its bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_BARS = ("open_time", "open", "high", "low", "close", "volume")
SCHEMA = "symbol string, label string, candles array<struct<open_time: long, open: double, high: double, low: double, close: double, volume: double>>"


def write_dataset(bars: DataFrame, path: str) -> None:
    """Writes bars (symbol, label, idx, open_time in ms, open, high, low, close, volume) as an object a series, bars in order of ``idx``."""
    one = F.struct("idx", *[F.col(c).cast("long" if c == "open_time" else "double").alias(c) for c in _BARS])
    rows = bars.groupBy("symbol", "label").agg(F.array_sort(F.collect_list(one)).alias("b"))
    rows.select("symbol", "label", F.transform("b", lambda b: b.dropFields("idx")).alias("candles")).write.json(path)


def read_dataset(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Bars of such files, also of one array over many lines (``multi_line``): symbol, label (``noise`` where there is none), idx and the bars. Objects without bars give no row."""
    rows = spark.read.schema(SCHEMA).json(path, multiLine=multi_line)
    return rows.select("symbol", F.coalesce("label", F.lit("noise")).alias("label"), F.posexplode("candles").alias("idx", "c")).select("symbol", "label", "idx", *[F.col(f"c.{c}").alias(c) for c in _BARS])
