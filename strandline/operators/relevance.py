"""A relevance model for detections: features of a detection and its bars, a training set, a random forest, a hard filter."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import texts as T
from strandline.functions.texts import added
from strandline.operators.detectors import scale_of
from strandline.operators.scoring import CATEGORIES

FEATURES = ["ret", "range_share", "rel_volume", "vol10", "mean10", "hour_sin"]
#: Feedback rows a model needs before it filters, and the least score then.
LEAST_FEEDBACK = 20
LEAST_SCORE = 0.5
#: Trees of a forest, and labelled rows it needs.
TREES = 200
LEAST_SAMPLES = 200

#: What a detection's scalars are called as features (fixed order), and the types that have a column each.
SCALARS = {
    "pattern_confidence": "confidence", "quality_score": "quality", "symmetry_score": "symmetry", "convergence_rate": "convergence", "breakout_strength": "breakout_strength",
    "avg_pivot_confidence": "pivot_confidence", "trend_consistency": "consistency", "volume_confirmation": "volume_confirmation", "pattern_freshness": "freshness",
}
TYPES = [*(t for kinds in CATEGORIES.values() for t in kinds), "breakout", "retest", "unknown"]
DETECTION_FEATURES = [*SCALARS, "is_confirmed", "timeframe_minutes", "n_pivots", "volatility_scale", "price_range", "relative_volume", "lag_to_confirmation", *(f"type_{t}" for t in TYPES)]
#: Weight of a row that comes from feedback.
FEEDBACK_WEIGHT = 3.0


def detection_features(rows: DataFrame, minutes: Column | None = None) -> DataFrame:
    """Adds the 48 ``DETECTION_FEATURES`` to rows of ``detectors.causal`` (ML1): scalars, pivots, bars, the bars from candidate to confirmation, a column a type.

    A type that is not in ``TYPES`` has 0 in all; no volume is a relative volume of 1; without a confirmation the lag is 0.
    """
    n, closes, volumes = T.size("closes"), T.col("closes"), T.col("volumes")
    total = lambda a: T.aggregate(a, T.lit(0.0), lambda s, x: s + x)
    recent = T.slice(volumes, T.greatest(T.lit(1), n - 9), T.least(T.lit(10), n))
    price = T.when(total(closes) != 0, total(closes) / n).otherwise(1.0)
    made = {name: T.col(c).cast("double") for name, c in SCALARS.items() if name != c} | {
        "is_confirmed": T.when(T.col("state") == "confirmed", 1.0).otherwise(0.0), "n_pivots": T.size("pivots").cast("double"), "volatility_scale": scale_of(T.col("highs"), T.col("lows"), closes),
        "price_range": (T.array_max(closes) - T.array_min(closes)) / price, "relative_volume": T.when(total(volumes) > 0, total(recent) / T.size(recent) / (total(volumes) / n)).otherwise(1.0),
        "lag_to_confirmation": T.coalesce(T.col("confirmed_at") - T.col("candidate_at"), T.lit(0)).cast("double"),
    }
    rows = added(rows, made).withColumns({f"type_{t}": (F.col("type") == t).cast("double") for t in TYPES})
    return rows.withColumn("timeframe_minutes", F.lit(0.0) if minutes is None else F.coalesce(minutes.cast("double"), F.lit(0.0)))


def training_set(found: DataFrame, truth: DataFrame, key: str = "symbol", feedback: DataFrame | None = None) -> DataFrame:
    """Rows of ``detection_features`` with ``label`` and ``sample_weight`` (ML2): 1 if the detection is confirmed and its type the true one of ``truth`` (key, label).

    ``noise`` is nobody's type. ``feedback``: rows with the features and is_relevant, which weigh ``FEEDBACK_WEIGHT``; those that lack a feature are left out.
    """
    want = truth.select(key, F.col("label").alias("_want"))
    right = (F.col("_want") != "noise") & (F.col("state") == "confirmed") & (F.col("type") == F.col("_want"))
    rows = found.drop("label").join(want, key).select(key, *DETECTION_FEATURES, F.coalesce(right.cast("double"), F.lit(0.0)).alias("label"), F.lit(1.0).alias("sample_weight"))
    if feedback is not None:
        rows = rows.unionByName(feedback.na.drop(subset=DETECTION_FEATURES).select(key, *DETECTION_FEATURES, (F.col("is_relevant") == 1).cast("double").alias("label"), F.lit(FEEDBACK_WEIGHT).alias("sample_weight")))
    return rows


def stratified(rows: DataFrame, *keys: str, settle: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Adds ``apart``: every fourth row of each label in the order of a hash of its keys (ML3), so a quarter of each, with labels of any size over many tasks.

    ``settle`` writes the rows and reads them back; places come from its partitions' counts.
    """
    h = F.xxhash64(*keys)
    order = (F.col("label"), h, F.monotonically_increasing_id())
    placed = settle(rows.where("label is not null").repartitionByRange(*order).sortWithinPartitions("label", h).withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    bases = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    placed = placed.join(bases, "_part").withColumn("_place", F.col("_base") + F.col("_at").bitwiseAND((1 << 33) - 1))
    first = placed.groupBy("label").agg(F.min("_place").alias("_first"))
    return placed.join(F.broadcast(first), "label").withColumn("apart", (F.col("_place") - F.col("_first")) % 4 == 3).drop("_at", "_part", "_base", "_place", "_first")  # a row a label


def trained(rows: DataFrame, settle: Callable[[DataFrame], DataFrame], *keys: str, trees: int = TREES, n_feedback: int = 0) -> tuple[PipelineModel | None, dict]:
    """A model of all rows and what it was worth on a quarter that a first model had not seen (ML3, ML6): n, positive, trained, accuracy, n_feedback."""
    split = stratified(rows, *keys, settle=settle)
    split = settle(split)
    n, positive = split.agg(F.count("*"), F.count_if(F.col("label") == 1)).first()
    facts: dict = {"n": n, "positive": positive, "n_feedback": n_feedback, "trained": False}
    whole = train(split, trees, features=DETECTION_FEATURES)
    if whole is None:
        return None, facts
    first = train(split.where("not apart"), trees, features=DETECTION_FEATURES) or whole
    told = accuracy(score(split.where("apart"), first)).first()
    return whole, facts | {"trained": True, "accuracy": told["accuracy"], "held_out": told["n"]}


def bar_features(bars: DataFrame) -> DataFrame:
    """Features of each bar and its last ten, and the label: the next close is higher (ML1)."""
    order = Window.partitionBy("symbol").orderBy("open_time")
    ten = order.rowsBetween(-9, 0)
    rows = bars.withColumn("ret", (F.col("close") - F.lag("close").over(order)) / (F.lag("close").over(order) + 1e-10))
    rows = rows.withColumns({
        "range_share": (F.col("high") - F.col("low")) / (F.col("close") + 1e-10), "rel_volume": F.col("volume") / F.avg("volume").over(ten),
        "vol10": F.coalesce(F.stddev_pop("ret").over(ten), F.lit(0.0)), "mean10": F.col("close") / (F.avg("close").over(ten) + 1e-10), "hour_sin": F.sin(F.hour("open_time") / 24 * 6.283185307179586),
        "label": (F.lead("close").over(order) > F.col("close")).cast("double"),
    })
    return rows.where("ret is not null")


def one_hot(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """A 0/1 column per value."""
    return df.withColumns({f"{column}_{v}": (F.col(column) == v).cast("double") for v in values})


def held_out(*keys: str) -> Column:
    """A quarter of the rows by a hash of their keys; within each label it is a quarter, too."""
    return F.pmod(F.xxhash64(*keys), F.lit(4)) == 0


def train(rows: DataFrame, trees: int = TREES, seed: int = 42, features: list[str] | None = None) -> PipelineModel | None:
    """A forest with balanced class weights n / (2 n_class) (ML3); None for under ``LEAST_SAMPLES`` rows or one label alone.

    Counts of labels are aggregated and joined back, so no task sees all rows. A column ``sample_weight`` multiplies the class weight.
    """
    labelled = rows.where("label is not null")
    counts = labelled.groupBy("label").agg(F.count("*").alias("_n"))
    seen = [r["_n"] for r in counts.collect()]  # two rows
    if sum(seen) < LEAST_SAMPLES or len(seen) < 2:
        return None
    own = F.col("sample_weight") if "sample_weight" in rows.columns else F.lit(1.0)
    weighted = labelled.join(F.broadcast(counts), "label").withColumn("weight", own * sum(seen) / (2 * F.col("_n")))
    forest = RandomForestClassifier(numTrees=trees, seed=seed, weightCol="weight", maxDepth=5)
    return Pipeline(stages=[VectorAssembler(inputCols=features or FEATURES, outputCol="features"), forest]).fit(weighted)


def accuracy(scored: DataFrame) -> DataFrame:
    """n and the share of rows whose score is on the side of their label (ML5)."""
    return scored.where("label is not null").agg(F.count("*").alias("n"), F.avg((F.col("ml_score") >= 0.5).cast("double").eqNullSafe(F.col("label")).cast("double")).alias("accuracy"))


def importances(model: PipelineModel, keep: int = 10) -> list[tuple[str, float]]:
    """The features a forest rests on most (T9, ML5)."""
    return sorted(zip(model.stages[0].getInputCols(), model.stages[-1].featureImportances.toArray().tolist(), strict=True), key=lambda f: -f[1])[:keep]


def score(rows: DataFrame, model: PipelineModel | None) -> DataFrame:
    """Adds ``ml_score``: probability of label 1, or 1.0 without a model (ML4)."""
    if model is None:
        return rows.withColumn("ml_score", F.lit(1.0))
    return model.transform(rows).withColumn("ml_score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def hard_filter(scored: DataFrame, n_feedback: object) -> DataFrame:
    """Keeps scores of at least ``LEAST_SCORE`` if the model has seen enough feedback; odd counts switch it off (F12, ML7)."""
    try:
        active = int(n_feedback) >= LEAST_FEEDBACK  # type: ignore[call-overload]
    except (TypeError, ValueError):
        active = False
    return scored.where(F.col("ml_score") >= LEAST_SCORE) if active else scored


def retrained(found: DataFrame, truth: DataFrame, feedback: DataFrame | None, save: Callable[[PipelineModel, dict], int], settle: Callable[[DataFrame], DataFrame], key: str = "symbol", trees: int = TREES) -> dict:
    """Trains anew on detections, their truth and the feedback (ML6) and saves the model if there is one: the facts of ``trained`` with ``version`` (None if nothing was saved)."""
    rows = settle(training_set(found, truth, key, feedback))
    n_feedback = 0 if feedback is None else feedback.na.drop(subset=DETECTION_FEATURES).count()
    model, facts = trained(rows, settle, key, trees=trees, n_feedback=n_feedback)
    return facts | {"version": None if model is None else save(model, facts)}
