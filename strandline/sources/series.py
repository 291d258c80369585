"""Series of bars from event and order tables: (symbol, open_time, open, high, low, close, volume)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(ticks: DataFrame, width: str, symbol: str = "event_type", price: str = "value", order: str = "event_id") -> DataFrame:
    """Tumbling bars of ticks (symbol, ts, price): first, highest, lowest, last price, count. One partial aggregation (ST4)."""
    at = F.struct("ts", order)
    grouped = ticks.groupBy(F.col(symbol).alias("symbol"), F.window(F.col("ts").cast("timestamp"), width).start.alias("open_time"))
    made = grouped.agg(
        F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"),
        F.max_by(price, at).alias("close"), F.count("*").alias("volume"),
    )
    return made.withColumn("open_time", F.col("open_time").cast("timestamp_ntz"))


def event_bars(spark: SparkSession, sf_dir: str, width: str = "4 hours") -> DataFrame:
    return bars(table(spark, sf_dir, "events"), width)


def ship_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit price by return flag and ship day; a smooth series with thousands of bars."""
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("symbol"), F.col("l_shipdate").alias("open_time"))
    return rows.agg(
        F.avg(unit).alias("open"), F.max(unit).alias("high"), F.min(unit).alias("low"), F.avg(unit).alias("close"),
        F.sum("l_quantity").cast("long").alias("volume"),
    )


def latest(series: DataFrame, n: int = 100) -> DataFrame:
    """The last ``n`` bars of each symbol with their place ``idx`` from 0 (W20; Spark limits each group before the shuffle)."""
    back = Window.partitionBy("symbol").orderBy(F.col("open_time").desc())
    ahead = Window.partitionBy("symbol").orderBy("open_time")
    rows = series.withColumn("_rn", F.row_number().over(back)).where(F.col("_rn") <= n).drop("_rn")
    return rows.withColumn("idx", F.row_number().over(ahead) - 1)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``); where that is unset, a folder of this process, which only local Spark may use."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return at.rstrip("/") if at else tempfile.mkdtemp(prefix="strandline-")


def settled(rows: DataFrame) -> DataFrame:
    """``rows`` written to a table in the shared folder and read back, so that long expressions are planned once and what follows is planned apart."""
    at = f"{shared_folder(rows.sparkSession)}/settled-{uuid.uuid4().hex}"
    rows.write.parquet(at)
    return rows.sparkSession.read.schema(rows.schema).parquet(at)
