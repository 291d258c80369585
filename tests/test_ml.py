"""Learning from detections: features, training rows, quarters kept apart, saved models, the filter."""

import json
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import relevance, replay
from strandline.sources.datasets import read_dataset, write_dataset
from strandline.sources.series import settled
from strandline.sources.tables import Models, Store


def _rows(spark, n, seed=3):
    """Rows of features in which confirmed detections of high quality are mostly the relevant ones."""
    draw = np.random.default_rng(seed)
    out = []
    for i in range(n):
        f = dict.fromkeys(relevance.DETECTION_FEATURES, 0.0) | {c: float(draw.random()) for c in list(relevance.SCALARS)}
        f["is_confirmed"] = float(draw.integers(2))
        right = f["is_confirmed"] and f["quality_score"] > 0.4
        out.append((f"s{i}", *f.values(), float(right if draw.random() < 0.95 else not right)))
    return spark.createDataFrame(out, "symbol string, " + ", ".join(f"`{c}` double" for c in relevance.DETECTION_FEATURES) + ", label double")


def test_forty_eight_features(spark):
    assert len(relevance.DETECTION_FEATURES) == len(set(relevance.DETECTION_FEATURES)) == 48
    draw = np.random.default_rng(8)
    y = 50 + np.cumsum(draw.normal(0, 1, 66))
    bars = spark.createDataFrame([("a", i, i, float(v), float(v + 1), float(v - 1), float(v), i % 5) for i, v in enumerate(y)], "symbol string, idx int, open_time long, open double, high double, low double, close double, volume long")
    found = settled(replay.detections(bars, 60, settle=settled))
    rows = relevance.detection_features(found, F.lit(240)).collect()
    assert rows
    for r in rows:
        c, v = np.array(r["closes"]), np.array(r["volumes"])
        assert r["price_range"] == pytest.approx(np.ptp(c) / c.mean()) and r["relative_volume"] == pytest.approx(v[-10:].mean() / v.mean())
        assert r["timeframe_minutes"] == 240 and r["n_pivots"] == len(r["pivots"]) and r["is_confirmed"] == float(r["state"] == "confirmed")
        assert r["lag_to_confirmation"] == (r["confirmed_at"] - r["candidate_at"] if r["confirmed_at"] is not None else 0)
        assert [t for t in relevance.TYPES if r[f"type_{t}"] == 1] == [r["type"]] and r["pattern_confidence"] == r["confidence"]


def test_labels_of_training_rows(spark):
    features = _rows(spark, 5).drop("label").withColumns({"state": F.lit("confirmed"), "type": F.lit("flag")})
    features = features.withColumn("state", F.when(F.col("symbol") == "s1", "open").otherwise("confirmed"))
    truth = spark.createDataFrame([("s0", "flag"), ("s1", "flag"), ("s2", "range"), ("s3", "noise")], "symbol string, label string")
    feedback = features.where("symbol = 's4'").withColumn("is_relevant", F.lit(1))
    lacking = feedback.withColumn("n_pivots", F.lit(None).cast("double"))
    got = {r["symbol"]: (r["label"], r["sample_weight"]) for r in relevance.training_set(features, truth, feedback=feedback.unionByName(lacking)).collect()}
    assert got == {"s0": (1, 1), "s1": (0, 1), "s2": (0, 1), "s3": (0, 1), "s4": (1, relevance.FEEDBACK_WEIGHT)}


def test_a_quarter_of_each_label_is_kept_apart(spark):
    rows = _rows(spark, 403)
    split = relevance.stratified(rows.repartition(5), "symbol", settle=settled).collect()
    counts = Counter((r["label"], r["apart"]) for r in split)
    assert len(split) == 403
    for label in (0.0, 1.0):
        n = counts[label, True] + counts[label, False]
        assert counts[label, True] == n // 4
    again = {r["symbol"] for r in relevance.stratified(rows.repartition(2), "symbol", settle=settled).where("apart").collect()}
    assert again == {r["symbol"] for r in split if r["apart"]}


def test_training_saving_and_filtering(spark, tmp_path):
    models = Models(Store(spark, f"file://{tmp_path}/store"))
    assert models.load() is None
    rows = _rows(spark, 400)
    model, facts = relevance.trained(rows, settled, "symbol", trees=20, n_feedback=25)
    assert facts["trained"] and facts["n"] == 400 and facts["held_out"] == sum(n // 4 for n in (facts["positive"], 400 - facts["positive"])) and facts["accuracy"] > 0.7
    assert (models.save(model, facts), models.save(model, facts | {"n": 1})) == (1, 2) and models.versions() == [1, 2]
    again, kept = models.load(1)
    assert kept == json.loads(json.dumps(facts)) and models.load()[1]["n"] == 1 and models.load(7) is None
    scored = lambda m: [r["ml_score"] for r in relevance.score(rows, m).orderBy("symbol").collect()]
    assert scored(again) == scored(model)
    best = [name for name, _ in relevance.importances(model, 2)]
    assert set(best) == {"is_confirmed", "quality_score"}
    few, facts = relevance.trained(rows.limit(50), settled, "symbol", trees=5)
    assert few is None and not facts["trained"] and set(scored(None)) == {1.0}
    passed = relevance.hard_filter(relevance.score(rows, model), kept["n_feedback"])
    assert 0 < passed.count() < 400 and passed.where("ml_score < 0.5").count() == 0
    for odd in (3, None, "many"):
        assert relevance.hard_filter(relevance.score(rows, model), odd).count() == 400


def test_datasets_of_json(spark, tmp_path):
    bars = spark.createDataFrame([("a", "flag", i, 1000 * i, 1.0, 2.0, 0.5, 1.5 + i, 3) for i in range(4)] + [("b", None, 0, 5, 1.0, 1.0, 1.0, 1.0, 1)], "symbol string, label string, idx int, open_time long, open double, high double, low double, close double, volume long")
    write_dataset(bars, str(tmp_path / "d"))
    got = read_dataset(spark, str(tmp_path / "d")).collect()
    assert {(r["symbol"], r["label"], r["idx"], r["open_time"], r["close"]) for r in got} == {("a", "flag", i, 1000 * i, 1.5 + i) for i in range(4)} | {("b", "noise", 0, 5, 1.0)}
    (tmp_path / "one.json").write_text(json.dumps([{"symbol": "x", "label": "range", "candles": [{"open_time": 1, "close": 2.0}]}, {"symbol": "y", "candles": []}], indent=1))
    assert [(r["symbol"], r["close"], r["high"]) for r in read_dataset(spark, str(tmp_path / "one.json"), True).collect()] == [("x", 2.0, None)]
