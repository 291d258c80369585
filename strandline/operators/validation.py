"""Replay metrics: matching detections to labels, repainting, latency."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def match_events(events: DataFrame, labels: DataFrame, slack: int = 3, by_type: bool = False) -> DataFrame:
    """tp, fp, fn per symbol (or symbol and pattern_type): each detection takes the first free label of its type whose span, widened by ``slack``, holds it.

    Candidates come from a range join on (symbol, pattern_type); the candidate pairs of one symbol and type meet in one group,
    as who takes which label depends on the order of the detections. Types never compete for a label.
    """
    keys = ["symbol", "pattern_type"] if by_type else ["symbol"]
    e = events.select("symbol", "pattern_type", "idx").withColumn("e", F.struct("idx", "pattern_type"))
    near = (F.col("idx") >= F.col("start") - slack) & (F.col("idx") <= F.col("end") + slack)
    pairs = e.join(labels, ["symbol", "pattern_type"]).where(near)

    def run(f: pd.DataFrame) -> pd.DataFrame:
        free, taken = set(), 0
        used_events = set()
        for r in f.sort_values(["idx", "pattern_type", "start", "end"]).itertuples():
            event, label = (r.idx, r.pattern_type), (r.pattern_type, r.start, r.end)
            if event not in used_events and label not in free:
                used_events.add(event)
                free.add(label)
                taken += 1
        return pd.DataFrame([(f["symbol"].iloc[0], f["pattern_type"].iloc[0], taken)], columns=["symbol", "pattern_type", "tp"])

    hits = pairs.drop("e").groupBy("symbol", "pattern_type").applyInPandas(run, "symbol string, pattern_type string, tp long")
    hits = hits.groupBy(*keys).agg(F.sum("tp").alias("tp"))
    counts = events.groupBy(*keys).agg(F.count("*").alias("n")).join(labels.groupBy(*keys).agg(F.count("*").alias("m")), keys, "full")
    rows = counts.join(hits, keys, "left").fillna(0, ["n", "m", "tp"])
    return rows.select(*keys, "tp", (F.col("n") - F.col("tp")).alias("fp"), (F.col("m") - F.col("tp")).alias("fn"))


def repaint_rate(active: DataFrame) -> DataFrame:
    """Share of active patterns (symbol, step, patterns array) that are gone in the next step."""
    later = F.lead("patterns").over(Window.partitionBy("symbol").orderBy("step"))
    rows = active.withColumn("_next", later).where(F.col("_next").isNotNull())
    rows = rows.withColumn("gone", F.size(F.array_except("patterns", "_next"))).withColumn("all", F.size(F.array_distinct("patterns")))
    return rows.groupBy("symbol").agg(F.sum("gone").alias("gone"), F.sum("all").alias("seen")).withColumn("rate", F.coalesce(F.try_divide("gone", "seen"), F.lit(0.0)))


def latency(events: DataFrame) -> DataFrame:
    """Mean bars from candidate to confirmation over confirmed events; null if there is none."""
    wait = F.when(F.col("state") == "confirmed", F.col("confirmed_at") - F.col("from_idx"))
    return events.groupBy("symbol").agg(F.avg(wait).alias("latency"))


def class_rates(truth: DataFrame, found: DataFrame) -> DataFrame:
    """Per class (a label but ``noise``): hits, false alarms, misses, and hit and false alarm rates.

    ``truth``: symbol, label, a row a series; ``found``: symbol, type. A false alarm is a series of another label found as the class.
    """
    rows = truth.join(found.select("symbol", "type").distinct(), "symbol", "left")
    size = truth.groupBy("label").agg(F.count("*").alias("n"))
    every = size.agg(F.sum("n").alias("total"))
    seen = rows.groupBy("label").agg(F.count_if(F.col("type") == F.col("label")).alias("tp"))
    wrong = rows.where("type != label").groupBy(F.col("type").alias("label")).agg(F.count("*").alias("fp"))
    out = size.where("label != 'noise'").join(seen, "label").join(wrong, "label", "left").crossJoin(F.broadcast(every)).fillna(0, ["fp"])
    return out.select("label", "n", "tp", "fp", (F.col("n") - F.col("tp")).alias("fn"), (F.col("tp") / F.col("n")).alias("tpr"), F.try_divide("fp", F.col("total") - F.col("n")).alias("fpr"))
