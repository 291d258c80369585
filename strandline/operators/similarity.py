"""Likeness of lines: correlation, cosine, squared error, banded time warping, mirrors, bonuses, deduplication."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.texts import functions_of


def _dot(a: Column, b: Column) -> Column:
    F = functions_of(a)  # noqa: N806
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    F = functions_of(a)  # noqa: N806
    norm = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when(norm > 0, _dot(a, b) / norm).otherwise(0.0)


def mse(a: Column, b: Column) -> Column:
    F = functions_of(a)  # noqa: N806
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x) / F.size(a)


def pearson(a: Column, b: Column) -> Column:
    """Correlation of two arrays; 0 where one of them does not vary."""
    F = functions_of(a)  # noqa: N806
    n = F.size(a)
    mean = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / n
    cov, va, vb = _dot(a, b) / n - mean(a) * mean(b), _dot(a, a) / n - mean(a) * mean(a), _dot(b, b) / n - mean(b) * mean(b)
    return F.when((va > 1e-12) & (vb > 1e-12), cov / F.sqrt(va * vb)).otherwise(0.0)


def against(lines: DataFrame, reference: DataFrame) -> DataFrame:
    """Every line with the one reference (J1): a broadcast of a single row, no shuffle."""
    return lines.crossJoin(F.broadcast(reference.limit(1)))


def top_k(scored: DataFrame, k: int, score: str = "score", key: str = "vec_id") -> DataFrame:
    """The ``k`` best, ties to the lesser key; Spark keeps k rows a task."""
    return scored.orderBy(F.col(score).desc(), key).limit(k)


def dtw(a: np.ndarray, b: np.ndarray, band: int) -> np.ndarray:
    """Banded time warping of rows of ``a`` with the line ``b``: one step for all rows at once; sqrt(cost / longer length)."""
    n, m = a.shape[1], len(b)
    band = max(band, abs(n - m))
    last = np.full((len(a), m + 1), np.inf)
    last[:, 0] = 0
    for i in range(1, n + 1):
        now = np.full((len(a), m + 1), np.inf)
        for j in range(max(1, i - band), min(m, i + band) + 1):
            cost = (a[:, i - 1] - b[j - 1]) ** 2
            now[:, j] = cost + np.minimum(np.minimum(last[:, j], now[:, j - 1]), last[:, j - 1])
        last = now
    return np.sqrt(last[:, m] / max(n, m))


def dtw_scores(lines: DataFrame, reference: list[float], column: str, key: str, step: int = 4) -> DataFrame:
    """``key`` and ``dtw`` distance of lines to a reference, both thinned by ``step``, in Arrow batches (M2)."""
    b = np.array(reference[::step])
    band = max(3, len(b) // 5)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            a = np.array([np.asarray(v, float)[::step] for v in f[column]]).reshape(len(f), -1)
            yield pd.DataFrame({key: f[key], "dtw": dtw(a, b, band) if len(f) else []})

    return lines.select(key, column).mapInPandas(run, f"{key} long, dtw double")


def line_score(a: Column, b: Column) -> Column:
    """The parts of a line comparison that need no warping (M1): correlation, squared error, cosine."""
    return F.lit(0.2) * (pearson(a, b) + 1) / 2 + F.lit(0.15) / (1 + 10 * mse(a, b)) + F.lit(0.15) * F.greatest(F.lit(0.0), cosine(a, b))


def mirror_best(scored: DataFrame, score: str, mirrored: str, penalty: float = 0.85) -> DataFrame:
    """The better of a line's score and its mirror's times ``penalty``; the mirror must be strictly better."""
    flipped = F.col(mirrored) * penalty
    return scored.withColumns({"is_mirrored": flipped > F.col(score), "best": F.greatest(F.col(score), flipped)})


def timeframe_bonus(matches: DataFrame) -> DataFrame:
    """x 1.04 for two timeframes of a symbol, x 1.08 for three or more, at most 99.99."""
    n = F.size(F.collect_set("timeframe").over(Window.partitionBy("symbol")))
    factor = F.when(n >= 3, 1.08).when(n == 2, 1.04).otherwise(1.0)
    return matches.withColumn("score", F.round(F.least(F.lit(99.99), F.col("score") * factor), 2))


def dedup_matches(matches: DataFrame, gap: float = 5.0) -> DataFrame:
    """Per symbol in order of ``ord``: the same timeframe keeps the higher score, another within ``gap`` points of a kept one goes.

    The result depends on the order, so it is a fold over each symbol's matches, of which there are few (timeframes x windows).
    """

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        kept: list[dict] = []
        for row in frame.sort_values("ord").to_dict("records"):
            for i, other in enumerate(kept):
                if other["timeframe"] == row["timeframe"]:
                    if row["score"] > other["score"]:
                        kept[i] = row
                    break
                if abs(other["score"] - row["score"]) < gap:
                    break
            else:
                kept.append(row)
        return pd.DataFrame(kept, columns=frame.columns)

    return matches.groupBy("symbol").applyInPandas(fold, matches.schema)
