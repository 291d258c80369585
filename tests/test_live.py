"""Streams: buffer rules, closed klines, bars."""

import json
import time

from strandline.streaming import live


def _run(spark, df, name, mode="update"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).collect()


def test_buffer_adds_replaces_and_drops(spark, tmp_path):
    rows = [("a", 900, 1.0), ("a", 1000, 2.0)]
    spark.createDataFrame(rows, "symbol string, open_time long, close double").coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.createDataFrame([("a", 1000, 3.0)], "symbol string, open_time long, close double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.createDataFrame([("a", 900, 9.0)], "symbol string, open_time long, close double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("symbol string, open_time long, close double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = _run(spark, live.latest_buffer(source, keep=2), "buffer_test")
    final = max(out, key=lambda r: (r["last_time"], r["last_close"] == 3.0))
    assert (final["n"], final["first_time"], final["last_time"], final["last_close"]) == (2, 900, 1000, 3.0)


def test_only_closed_klines_of_known_form(spark):
    good = {"data": {"e": "kline", "s": "ABCUSDT", "k": {"t": 1, "T": 2, "i": "1h", "o": "1", "h": "2", "l": "0.5", "c": "1.5", "v": "7", "x": True}}}
    still = {"data": {**good["data"], "k": {**good["data"]["k"], "x": False}}}
    rows = [(json.dumps(good),), (json.dumps(still),), ("no json",), (None,)]
    got = live.closed_klines(spark.createDataFrame(rows, "value string")).collect()
    assert [(r["symbol"], r["close"], r["open_time"]) for r in got] == [("ABC", 1.5, 1)]


def test_score_ring_is_bounded_and_restarts(spark, tmp_path):
    """Ten thousand scores in batches, a restart from the checkpoint in between, and the histogram of the last thousand of each symbol."""
    import numpy as np

    draw = np.random.default_rng(2)
    rows = [(["a", "b"][i % 3 == 0], i, None if i % 997 == 0 else float(draw.uniform(-0.1, 1.1))) for i in range(10_000)]
    seen = []

    def take(batch, _):
        seen.append({(r["symbol"], r["bin"]): r["n"] for r in batch.collect()})

    for part in range(4):
        spark.createDataFrame(rows[part * 2500 : part * 2500 + 2500], "symbol string, at long, score double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema("symbol string, at long, score double").parquet(str(tmp_path / "in"))
        q = live.score_histograms(source).writeStream.outputMode("update").foreachBatch(take).option("checkpointLocation", str(tmp_path / "state")).start()
        for _ in range(300):  # a stream with timeouts looks for ones that are due for ever
            if sum(p["numInputRows"] for p in q.recentProgress) >= 2500:
                break
            time.sleep(0.2)
        q.stop()
    last = {}
    for s in seen:
        last |= s
    for symbol in "ab":
        kept = [s for k, _, s in rows if k == symbol and s is not None][-1000:]
        want = np.bincount(np.clip(np.floor(np.array(kept) * 10), 0, 9).astype(int), minlength=10).tolist()
        assert [last[symbol, b] for b in range(10)] == want and sum(want) == 1000


def test_once_and_changes(spark, tmp_path):
    rows = [("a", 1, "x", 0.0), ("a", 2, "x", 0.05), ("a", 3, "x", 0.3), ("a", 4, "y", 0.3), ("b", 1, "x", 0.0)]
    spark.createDataFrame(rows, "symbol string, open_time long, type string, trend double").coalesce(1).write.parquet(str(tmp_path / "c"))
    source = spark.readStream.schema("symbol string, open_time long, type string, trend double").parquet(str(tmp_path / "c"))
    assert sorted((r["symbol"], r["open_time"]) for r in _run(spark, live.changed_only(source), "changed_test")) == [("a", 1), ("a", 3), ("a", 4), ("b", 1)]
    events = spark.sql("select 'k' as key, timestamp'2024-01-01 00:00:00' as ts union all select 'k', timestamp'2024-01-01 00:10:00' union all select 'm', timestamp'2024-01-01 00:05:00'")
    events.coalesce(1).write.parquet(str(tmp_path / "e"))
    once = live.emitted_once(spark.readStream.schema("key string, ts timestamp").parquet(str(tmp_path / "e")), ["key"])
    assert sorted(r["key"] for r in _run(spark, once, "once_test", "append")) == ["k", "m"]


def test_bars_of_a_stream_are_those_of_a_batch(spark, tmp_path):
    from strandline.sources.series import bars

    ticks = spark.read.parquet("/root/testdata/sf0.001/events.parquet").limit(500)
    ticks.coalesce(1).write.parquet(str(tmp_path / "t"))
    source = spark.readStream.schema(ticks.schema).parquet(str(tmp_path / "t"))
    got = {(r["symbol"], r["open_time"]): r["close"] for r in _run(spark, live.streamed_bars(source), "bars_test", "append")}
    want = {(r["symbol"], r["t"]): r["close"] for r in bars(spark.read.parquet(str(tmp_path / "t")), "4 hours").selectExpr("symbol", "cast(open_time as timestamp) t", "close").collect()}
    assert got and all(want[k] == v for k, v in got.items()) and len(want) - len(got) <= 10  # the last bars wait for the watermark
