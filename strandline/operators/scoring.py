"""Likeness of structures: six part scores of packed rows against a reference, the gates on their sum, mirrors, and the scan over all series.

Rows are those of ``detectors.structures``; the reference's columns stand beside them under names with ``ref_``. All parts but time
warping are column expressions, so a scan is one broadcast of the reference and no shuffle until matches are ranked by symbol.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from strandline.functions import texts as T
from strandline.functions.texts import Text, added
from strandline.operators import features, similarity
from strandline.operators.packed import let, mean, part

#: Categories of types, pairs of opposites, and least confidences (fixed values).
CATEGORIES = {
    "directional": ("impulse_up", "impulse_down", "trend_up", "trend_down", "bull_flag", "bear_flag"),
    "reversal": ("double_top", "double_bottom", "head_shoulders", "inv_head_shoulders", "triple_top", "triple_bottom", "cup_and_handle", "rounding_bottom"),
    "consolidation": (
        "compression", "triangle", "range", "accumulation", "squeeze_up", "squeeze_down", "rising_wedge", "falling_wedge", "ascending_triangle", "descending_triangle", "symmetrical_triangle",
        "channel_up", "channel_down", "horizontal_channel", "pennant",
    ),
}
OPPOSITES = {
    "trend_up": "trend_down", "impulse_up": "impulse_down", "bull_flag": "bear_flag", "double_top": "double_bottom", "head_shoulders": "inv_head_shoulders", "squeeze_up": "squeeze_down",
    "rising_wedge": "falling_wedge", "ascending_triangle": "descending_triangle", "channel_up": "channel_down", "triple_top": "triple_bottom",
}
LEAST_CONFIDENCE = {
    0.55: ("impulse_up", "impulse_down"),
    0.50: ("bull_flag", "bear_flag", "head_shoulders", "inv_head_shoulders", "breakout"),
    0.45: ("trend_up", "trend_down", "double_top", "double_bottom", "triple_top", "triple_bottom", "cup_and_handle", "rounding_bottom", "rising_wedge", "falling_wedge", "channel_up", "channel_down", "pennant"),
    0.40: ("triangle", "squeeze_up", "squeeze_down", "ascending_triangle", "descending_triangle", "symmetrical_triangle", "horizontal_channel"),
    0.35: ("compression", "range", "retest"),
}
WEIGHTS = {"lines": 0.25, "pivots": 0.20, "distances": 0.10, "shape": 0.25, "slopes": 0.10, "geometry": 0.10}
#: The columns a comparison reads.
FIELDS = (
    "line", "sequence", "distances", "slopes", "angles", "trend", "volatility", "compression", "type", "confidence", "patterns", "quality", "symmetry", "convergence", "breakout_strength", "consistency",
    "pivot_confidence", "freshness", "volume_confirmation",
)


def _map(d: dict[str, str] | dict[str, float]) -> Text:
    return T.create_map(*[T.lit(v) for kv in d.items() for v in kv])


_CATEGORY = {t: c for c, ts in CATEGORIES.items() for t in ts}
_MIRROR = OPPOSITES | {v: k for k, v in OPPOSITES.items()}
_LEAST = {t: v for v, ts in LEAST_CONFIDENCE.items() for t in ts}


def mirror_type(kind: Text) -> Text:
    """The type of the line turned upside down; most stay as they are."""
    return T.coalesce(T.try_element_at(_map(_MIRROR), kind), kind)


def opposites(a: Text, b: Text) -> Text:
    return T.coalesce(T.try_element_at(_map(_MIRROR), a) == b, T.lit(False))


def same_category(a: Text, b: Text) -> Text:
    one = lambda k: T.try_element_at(_map(_CATEGORY), k)
    return T.coalesce(one(a) == one(b), T.lit(False))


@F.pandas_udf(DoubleType())
def warped(a: pd.Series, b: pd.Series) -> pd.Series:
    """Banded time warping of two lines of one length, every fourth value (M2), all rows of a batch at once."""
    x, y = (np.array([np.asarray(v, float)[::4] for v in s]) for s in (a, b))
    n = x.shape[1]
    band = max(3, n // 5)
    last = np.full((len(x), n + 1), np.inf)
    last[:, 0] = 0
    for i in range(n):
        now = np.full_like(last, np.inf)
        for j in range(max(0, i - band), min(n, i + band + 1)):
            now[:, j + 1] = (x[:, i] - y[:, j]) ** 2 + np.minimum(np.minimum(last[:, j + 1], now[:, j]), last[:, j])
        last = now
    return pd.Series(np.sqrt(last[:, n] / n))


def line_likeness(a: Text, b: Text, dtw: Text) -> Text:
    """.20 correlation, .15 squared error, .15 cosine, .30 time warping, .20 correlation of four quarters (M1)."""
    n = T.size(a)
    whole = (similarity.pearson(a, b) + 1) / 2
    quarter = T.floor(n / 4).cast("int")

    def one(k: Text) -> Text:
        cut = lambda v: part(v, k * quarter, (k + 1) * quarter)
        flat = (T.array_max(cut(a)) - T.array_min(cut(a)) < 1e-10) | (T.array_max(cut(b)) - T.array_min(cut(b)) < 1e-10)
        return T.when(~flat, (similarity.pearson(cut(a), cut(b)) + 1) / 2)

    quarters = let(T.array_compact(T.transform(T.sequence(T.lit(0), T.lit(3)), one)), lambda q: T.when(T.size(q) > 0, mean(q)).otherwise(whole))
    return 0.20 * whole + 0.15 / (1 + 10 * similarity.mse(a, b)) + 0.15 * T.greatest(T.lit(0.0), similarity.cosine(a, b)) + 0.30 / (1 + 5 * dtw) + 0.20 * quarters


def _near(a: Text, b: Text, steep: float) -> Text:
    """1 / (1 + steep times the mean squared difference) at the longer one's length; .5 if one has no values."""
    n = T.greatest(T.size(a), T.size(b))
    off = mean(T.zip_with(features.stretched(a, n), features.stretched(b, n), lambda x, y: (x - y) * (x - y)))
    return T.when((T.size(a) == 0) | (T.size(b) == 0), 0.5).otherwise(1 / (1 + steep * off))


def slope_likeness(s: Text, t: Text, a: Text, b: Text) -> Text:
    """Mean of the likeness of slopes and of turns (M5)."""
    return 0.5 * _near(s, t, 5.0) + 0.5 * _near(a, b, 4.0)


def geometry_likeness(ref: str, own: str) -> Text:
    """Mean over symmetry, convergence, breakout strength and consistency of one less the difference (M6)."""
    parts = [1 - T.least(T.lit(1.0), T.abs(T.col(ref + c) - T.col(own + c))) for c in ("symmetry", "convergence", "breakout_strength", "consistency")]
    return 0.25 * (parts[0] + parts[1] + parts[2] + parts[3])


def _shared(a: Text, b: Text) -> Text:
    return T.array_intersect(T.map_keys(a), T.map_keys(b))


def shape_likeness(ref: str, own: str, lean: Text, kind: Text) -> Text:
    """.20 trend + .10 volatility + .20 compression + .50 type, with up to .30 for patterns both have (M7)."""
    r = lambda c: T.col(ref + c)
    o = lambda c: T.col(own + c)
    near = lambda a, b: 1 - T.least(T.lit(2.0), T.abs(a - b)) / 2
    vol = T.least(r("volatility"), o("volatility")) / (T.greatest(r("volatility"), o("volatility")) + 1e-10)
    common = T.array_max(T.transform(_shared(r("patterns"), o("patterns")), lambda k: T.least(T.element_at(r("patterns"), k), T.element_at(o("patterns"), k))))
    kinds = T.when(r("type") == kind, 1.0).when(same_category(r("type"), kind), 0.60).when(opposites(r("type"), kind), 0.15).otherwise(0.35)
    kinds = T.least(T.lit(1.0), kinds + T.when(common.isNotNull(), T.least(T.lit(0.30), 0.4 * common)).otherwise(0.0))
    return 0.20 * near(r("trend"), lean) + 0.10 * vol + 0.20 * near(r("compression"), o("compression")) + 0.50 * kinds


def gates(score: Text, ref: str, own: str, kind: Text) -> Text:
    """The score times the gates, in this order (M9): types, confidence, quality, pivots, freshness, volume; at most 1."""
    r = lambda c: T.col(ref + c)
    o = lambda c: T.col(own + c)
    unknown = (r("type") == "unknown") | (kind == "unknown")
    types = (
        T.when(r("type") == kind, 1.0).when(T.size(_shared(r("patterns"), o("patterns"))) > 0, 0.95).when(opposites(r("type"), kind), 0.55)
        .when(same_category(r("type"), kind) | unknown, 0.90).otherwise(0.75)
    )

    def sure(k: Text, confidence: Text) -> Text:
        least = T.coalesce(T.try_element_at(_map(_LEAST), k), T.lit(0.30))
        return T.when(confidence < 0.5 * least, 0.6).when(confidence < least, 0.8).otherwise(1.0)

    quality, pivots = (r("quality") + o("quality")) / 2, (r("pivot_confidence") + o("pivot_confidence")) / 2
    for gate in (
        types, T.least(sure(r("type"), r("confidence")), sure(kind, o("confidence"))), T.when(quality < 0.3, 0.8).when(quality < 0.4, 0.9).otherwise(1.0),
        T.when(pivots > 0.6, 1.05).when(pivots < 0.3, 0.92).otherwise(1.0), T.when(o("freshness") < 0.5, 0.6 + 0.8 * o("freshness")).otherwise(1.0),
        T.when(o("volume_confirmation") > 0.7, 1 + 0.3 * (o("volume_confirmation") - 0.7)).when(o("volume_confirmation") < 0.3, 0.85).otherwise(1.0),
    ):
        score = score * gate
    return T.least(T.lit(1.0), score)


def compared(rows: DataFrame, ref: str = "ref_", own: str = "") -> DataFrame:
    """Adds score (0 to 100) and is_mirrored.

    The mirror turns the line, the pivot values, slopes, turns, trend and type; its score is lowered to .60 for opposite types, .90 where
    both consolidate and .85 else, and counts if it is strictly better.
    """
    c = lambda name: T.col(own + name)
    r = lambda name: T.col(ref + name)
    turned = lambda a: T.transform(a, lambda v: 1 - v)
    minus = lambda a: T.transform(a, lambda v: -v)
    rows = added(rows, {"_turned": turned(c("line"))})
    rows = rows.withColumns({"_dtw": warped(ref + "line", own + "line"), "_turned_dtw": warped(ref + "line", "_turned")})

    def whole(line: Text, dtw: Text, sequence: Text, slopes: Text, angles: Text, lean: Text, kind: Text) -> Text:
        parts = {
            "lines": line_likeness(r("line"), line, dtw), "pivots": features.pivot_likeness(r("sequence"), sequence), "distances": features.distance_likeness(r("distances"), c("distances")),
            "shape": shape_likeness(ref, own, lean, kind), "slopes": slope_likeness(r("slopes"), slopes, r("angles"), angles), "geometry": geometry_likeness(ref, own),
        }
        return gates(sum((w * parts[p] for p, w in WEIGHTS.items()), T.lit(0.0)), ref, own, kind)

    consolidating = T.lit(list(CATEGORIES["consolidation"]))
    penalty = T.when(opposites(r("type"), c("type")), 0.60).when(T.array_contains(consolidating, r("type")) & T.array_contains(consolidating, c("type")), 0.90).otherwise(0.85)
    rows = added(rows, {
        "_plain": whole(c("line"), T.col("_dtw"), c("sequence"), c("slopes"), c("angles"), c("trend"), c("type")),
        "_mirror": penalty * whole(T.col("_turned"), T.col("_turned_dtw"), turned(c("sequence")), minus(c("slopes")), minus(c("angles")), -c("trend"), mirror_type(c("type"))),
    })
    return added(rows, {"score": 100 * T.greatest("_plain", "_mirror"), "is_mirrored": T.col("_mirror") > T.col("_plain")}).drop("_turned", "_dtw", "_turned_dtw", "_plain", "_mirror")


def find_matches(rows: DataFrame, reference: DataFrame, threshold: float = 50.0) -> DataFrame:
    """Matches of a reference (one row of ``structures``) among all series (M13): symbol, timeframe, score, type, is_mirrored, the best first.

    Rows without a type, that fail the quality gate of structures (F5), of quality under .2 or no longer active are left out (F6); the unrounded score must reach the
    threshold, held within 0 and 100 (F7, F15); matches of a symbol are deduplicated and raised for several timeframes (M11, M12). ``rows`` needs symbol, timeframe and ord.
    """
    one = reference.limit(1).select(*[F.col(f).alias(f"ref_{f}") for f in FIELDS])
    fit = rows.where((F.col("type").isNotNull()) & F.col("passes") & (F.col("quality") >= 0.2) & F.col("is_active"))
    scored = compared(fit.crossJoin(F.broadcast(one))).where(F.col("score") >= F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.lit(float(threshold)))))
    kept = similarity.dedup_matches(scored.select("symbol", "timeframe", "ord", "type", "is_mirrored", F.round("score", 2).alias("score")))
    return similarity.timeframe_bonus(kept).drop("ord").orderBy(F.col("score").desc(), "symbol", "timeframe")
