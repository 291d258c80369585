"""Matches, feedback and validation as tables: joins, deletes, histograms, precision and recall."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def example(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Matches and feedback as the event table has them: every third event is a feedback on itself."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    matches = events.select(F.col("event_id").alias("match_id"), F.concat(F.lit("u"), F.col("user_id")).alias("symbol"), F.col("event_type").alias("timeframe"), F.col("value").alias("score"), "ts")
    even = F.get_json_object("props", "$.k").cast("int") % 2 == 0
    feedback = events.where("event_id % 3 = 0").select(
        F.col("event_id").alias("match_id"), F.when(even, 1).otherwise(0).alias("is_relevant"), F.when(F.col("event_type") == "click", "override").alias("timeframe")
    )
    return matches, feedback


def feedback_with_matches(matches: DataFrame, feedback: DataFrame) -> DataFrame:
    """Feedback with its match; what the feedback says itself comes first."""
    rows = feedback.alias("f").join(matches.alias("m"), "match_id", "left")
    return rows.select("match_id", "is_relevant", F.coalesce("f.timeframe", "m.timeframe").alias("timeframe"), "score")


def feedback_stats(matches: DataFrame, feedback: DataFrame) -> DataFrame:
    """Relevant and irrelevant counts by timeframe of the match."""
    rows = feedback.select("match_id", "is_relevant").join(matches.select("match_id", "timeframe"), "match_id")
    return rows.groupBy("timeframe").agg(F.count("*").alias("n"), F.count_if(F.col("is_relevant") == 1).alias("relevant"), F.count_if(F.col("is_relevant") == 0).alias("irrelevant"))


def delete_feedback(feedback: DataFrame, gone: DataFrame) -> DataFrame:
    """Feedback whose match is not among ``gone``."""
    return feedback.join(gone.select("match_id"), "match_id", "left_anti")


def score_histogram(scores: DataFrame) -> DataFrame:
    """Counts in ten bins of a score from 0 to 1; what lies outside is in the end bins."""
    bin = F.least(F.lit(9), F.greatest(F.lit(0), F.floor(F.col("score") * 10))).cast("int")
    return scores.groupBy(bin.alias("bin")).agg(F.count("*").alias("n"))


def precision_recall(rows: DataFrame) -> DataFrame:
    """tp, fp, fn, precision and recall per ``pattern_type`` of rows with ``predicted`` and ``actual`` (G10, G11); null where undefined."""
    p, a = F.col("predicted"), F.col("actual")
    counts = rows.groupBy("pattern_type").agg(F.count_if(p & a).alias("tp"), F.count_if(p & ~a).alias("fp"), F.count_if(~p & a).alias("fn"))
    return counts.withColumns({"precision": F.try_divide("tp", F.col("tp") + F.col("fp")), "recall": F.try_divide("tp", F.col("tp") + F.col("fn"))})
