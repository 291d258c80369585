"""Streams of ticks and bars: watermarked bars, the latest bars of each series as keyed state, changes only."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def streamed_bars(ticks: DataFrame, width: str = "4 hours", late: str = "1 hour") -> DataFrame:
    """Tumbling bars of a tick stream (ST4); a bar comes out once the watermark has passed its end."""
    rows = ticks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    at = F.struct("ts", "event_id")
    made = rows.groupBy(F.window("ts", width), F.col("event_type").alias("symbol")).agg(
        F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.count("*").alias("volume")
    )
    return made.select("symbol", F.col("window.start").alias("open_time"), "open", "high", "low", "close", "volume")


def latest_buffer(bars: DataFrame, keep: int = 100) -> DataFrame:
    """The last ``keep`` bars of each symbol as state (ST1, ST2): a newer bar is added, an equal time replaces, an older one is dropped.

    Bars: symbol, open_time (long), close. Each batch gives a symbol's size, first and last time and last close. The state is bounded by ``keep``.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, closes = ([*v] for v in state.get) if state.exists else ([], [])
        rows = pd.concat(list(frames)).sort_values("open_time", kind="stable")
        for t, c in zip(rows["open_time"].tolist(), rows["close"].tolist()):
            if not times or t > times[-1]:
                times.append(t)
                closes.append(c)
            elif t == times[-1]:
                closes[-1] = c
        times, closes = times[-keep:], closes[-keep:]
        state.update((times, closes))
        yield pd.DataFrame({"symbol": [key[0]], "n": [len(times)], "first_time": [times[0]], "last_time": [times[-1]], "last_close": [closes[-1]]})

    return bars.groupBy("symbol").applyInPandasWithState(
        step, "symbol string, n int, first_time long, last_time long, last_close double", "times array<long>, closes array<double>", "update", GroupStateTimeout.NoTimeout
    )


def closed_klines(messages: DataFrame) -> DataFrame:
    """Kline messages (JSON in ``value``) to bars, closed ones only (F16, ST3); what does not parse is left out."""
    schema = "data struct<e:string, s:string, k:struct<t:long, i:string, o:string, h:string, l:string, c:string, v:string, x:boolean>>"
    k = F.from_json("value", schema)["data"]
    rows = messages.select(k.alias("d")).where("d.e = 'kline' and d.k.x and endswith(d.s, 'USDT')")
    number = lambda c: F.col(f"d.k.{c}").try_cast("double")
    made = rows.select(
        F.regexp_replace("d.s", "USDT$", "").alias("symbol"), F.col("d.k.i").alias("timeframe"), F.col("d.k.t").alias("open_time"), number("o").alias("open"),
        number("h").alias("high"), number("l").alias("low"), number("c").alias("close"), number("v").alias("volume"),
    )
    return made.where("open_time is not null and close is not null")


def into_table(rows: DataFrame, path: str, state: str) -> StreamingQuery:
    """Appends every batch to a Parquet table, with the stream's own state in a folder beside it; ends when the input does."""
    def append(batch: DataFrame, _: int) -> None:
        batch.write.mode("append").parquet(path)

    return rows.writeStream.outputMode("update").foreachBatch(append).option("checkpointLocation", state).trigger(availableNow=True).start()


def emitted_once(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """The first event of each key (ST7, U5); with a time column ``ts`` a key is forgotten once the watermark has passed it by ``late``."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def changed_only(structures: DataFrame, least: float = 0.1) -> DataFrame:
    """Structures (symbol, open_time, type, trend) whose type differs from the one before or whose trend moved by more than ``least`` (ST8, W24)."""
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = state.get if state.exists else (None, 0.0)
        rows, out = pd.concat(list(frames)).sort_values("open_time", kind="stable"), []
        for r in rows.itertuples(index=False):
            if r.type != before[0] or abs(r.trend - before[1]) > least:
                out.append(r)
            before = (r.type, float(r.trend))
        state.update(before)
        yield pd.DataFrame(out, columns=rows.columns)

    kinds = "symbol string, open_time long, type string, trend double"
    return structures.select("symbol", "open_time", "type", "trend").groupBy("symbol").applyInPandasWithState(step, kinds, "type string, trend double", "update", GroupStateTimeout.NoTimeout)


def score_histograms(scores: DataFrame, keep: int = 1000, idle_ms: int = 3_600_000) -> DataFrame:
    """After each batch, the histogram in ten bins of the last ``keep`` scores of each symbol it touched (ST11, G7): symbol, bin, n.

    Scores: symbol, at (long), score. State is at most ``keep`` numbers a symbol; a timeout drops a symbol that was idle, and gives its bins as 0. Null
    scores count in nothing. Within a batch scores are in order of ``at``.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept: list[float] = []
        if state.hasTimedOut:
            state.remove()
        else:
            fresh = pd.concat(list(frames)).sort_values(["at", "score"], kind="stable")["score"].dropna().tolist()
            kept = [*(state.get[0] if state.exists else []), *fresh][-keep:]
            state.update((kept,))
            state.setTimeoutDuration(idle_ms)
        bins = [0] * 10
        for s in kept:
            bins[min(9, max(0, int(s * 10 // 1)))] += 1
        yield pd.DataFrame({"symbol": key[0], "bin": list(range(10)), "n": bins})

    rows = scores.select("symbol", "at", "score").groupBy("symbol")
    return rows.applyInPandasWithState(step, "symbol string, bin int, n int", "scores array<double>", "update", GroupStateTimeout.ProcessingTimeTimeout)
