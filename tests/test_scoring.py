"""The likeness of two structures, part by part and as a whole, against plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions.texts import col, column, lit
from strandline.operators import scoring

KINDS = ["trend_up", "trend_down", "double_top", "double_bottom", "range", "pennant", "bull_flag", "unknown", "triangle"]


def _pearson(a, b):
    va, vb = np.var(a), np.var(b)
    return float(np.mean((a - a.mean()) * (b - b.mean())) / math.sqrt(va * vb)) if va > 1e-12 and vb > 1e-12 else 0.0


def _warped(a, b):
    x, y = a[::4], b[::4]
    n, band = len(x), max(3, len(x) // 5)
    cost = {(0, 0): 0.0}
    for i in range(1, n + 1):
        for j in range(max(1, i - band), min(n, i + band) + 1):
            cost[i, j] = (x[i - 1] - y[j - 1]) ** 2 + min(cost.get(k, math.inf) for k in ((i - 1, j), (i, j - 1), (i - 1, j - 1)))
    return math.sqrt(cost[n, n] / n)


def _line(a, b):
    whole = (_pearson(a, b) + 1) / 2
    quarters = [(_pearson(p, q) + 1) / 2 for k in range(4) for p, q in [(a[k * 25 : k * 25 + 25], b[k * 25 : k * 25 + 25])] if np.ptp(p) >= 1e-10 and np.ptp(q) >= 1e-10]
    cosine = float(a @ b / math.sqrt((a @ a) * (b @ b))) if (a @ a) * (b @ b) > 0 else 0.0
    return 0.20 * whole + 0.15 / (1 + 10 * float(np.mean((a - b) ** 2))) + 0.15 * max(0, cosine) + 0.30 / (1 + 5 * _warped(a, b)) + 0.20 * (np.mean(quarters) if quarters else whole)


def _stretch(a, n):
    return np.interp(np.linspace(0, len(a) - 1, n), np.arange(len(a)), a)


def _near(a, b, steep):
    if not a or not b:
        return 0.5
    n = max(len(a), len(b))
    return 1 / (1 + steep * float(np.mean((_stretch(a, n) - _stretch(b, n)) ** 2)))


def _slopes(r, o):
    return 0.5 * _near(r["slopes"], o["slopes"], 5) + 0.5 * _near(r["angles"], o["angles"], 4)


def _geometry(r, o):
    return float(np.mean([1 - min(1, abs(r[c] - o[c])) for c in ("symmetry", "convergence", "breakout_strength", "consistency")]))


_GROUP = {t: c for c, ts in scoring.CATEGORIES.items() for t in ts}
_MIRROR = scoring.OPPOSITES | {v: k for k, v in scoring.OPPOSITES.items()}


def _opposite(a, b):
    return _MIRROR.get(a) == b


def _alike(a, b):
    return a in _GROUP and _GROUP[a] == _GROUP.get(b)


def _shape(r, o, lean, kind):
    common = [min(r["patterns"][k], o["patterns"][k]) for k in r["patterns"] if k in o["patterns"]]
    kinds = 1.0 if r["type"] == kind else 0.6 if _alike(r["type"], kind) else 0.15 if _opposite(r["type"], kind) else 0.35
    kinds = min(1.0, kinds + (min(0.30, 0.4 * max(common)) if common else 0))
    vol = min(r["volatility"], o["volatility"]) / (max(r["volatility"], o["volatility"]) + 1e-10)
    near = lambda a, b: 1 - min(2.0, abs(a - b)) / 2
    return 0.20 * near(r["trend"], lean) + 0.10 * vol + 0.20 * near(r["compression"], o["compression"]) + 0.50 * kinds


def _distances(a, b):
    if not a or not b:
        return 0.3
    n = max(len(a), len(b))
    return 1 / (1 + 8 * float(np.mean((_stretch(a, n) - _stretch(b, n)) ** 2)))


def _pivots(a, b):
    if not a or not b:
        return 0.3
    n = max(len(a), len(b))
    x, y = _stretch(a, n), _stretch(b, n)
    da, db = np.diff(x), np.diff(y)
    out = 0.40 * _distances(a, b)
    if n < 3:
        return out + 0.3
    ratios = [min(abs(p), abs(q)) / (max(abs(p), abs(q)) + 1e-10) for p, q in zip(da, db, strict=True) if max(abs(p), abs(q)) > 0.01]
    return out + 0.35 * float(np.mean(np.sign(da) == np.sign(db))) + 0.25 * (float(np.mean(ratios)) if ratios else 0.5)


def _least(kind):
    return next((v for v, ts in scoring.LEAST_CONFIDENCE.items() if kind in ts), 0.30)


def _gates(score, r, o, kind):
    shared = set(r["patterns"]) & set(o["patterns"])
    if r["type"] != kind:
        score *= 0.95 if shared else 0.55 if _opposite(r["type"], kind) else 0.90 if _alike(r["type"], kind) or "unknown" in (r["type"], kind) else 0.75
    sure = lambda k, c: 0.6 if c < 0.5 * _least(k) else 0.8 if c < _least(k) else 1.0
    score *= min(sure(r["type"], r["confidence"]), sure(kind, o["confidence"]))
    quality, pivots = (r["quality"] + o["quality"]) / 2, (r["pivot_confidence"] + o["pivot_confidence"]) / 2
    score *= 0.8 if quality < 0.3 else 0.9 if quality < 0.4 else 1.0
    score *= 1.05 if pivots > 0.6 else 0.92 if pivots < 0.3 else 1.0
    score *= 0.6 + 0.8 * o["freshness"] if o["freshness"] < 0.5 else 1.0
    v = o["volume_confirmation"]
    return min(1.0, score * (1 + 0.3 * (v - 0.7) if v > 0.7 else 0.85 if v < 0.3 else 1.0))


def _whole(r, o, turned):
    line, seq, slopes, angles, lean, kind = o["line"], o["sequence"], o["slopes"], o["angles"], o["trend"], o["type"]
    if turned:
        line, seq, slopes, angles, lean, kind = [1 - v for v in line], [1 - v for v in seq], [-v for v in slopes], [-v for v in angles], -lean, _MIRROR.get(kind, kind)
    own = o | {"slopes": slopes, "angles": angles}
    score = (
        0.25 * _line(np.array(r["line"]), np.array(line)) + 0.20 * _pivots(r["sequence"], seq) + 0.10 * _distances(r["distances"], o["distances"])
        + 0.25 * _shape(r, o, lean, kind) + 0.10 * _slopes(r, own) + 0.10 * _geometry(r, o)
    )
    return _gates(score, r, o, kind)


def _compared(r, o):
    rest = set(scoring.CATEGORIES["consolidation"])
    penalty = 0.60 if _opposite(r["type"], o["type"]) else 0.90 if {r["type"], o["type"]} <= rest else 0.85
    plain, mirror = _whole(r, o, False), penalty * _whole(r, o, True)
    return 100 * max(plain, mirror), mirror > plain


_NUMBERS = ("trend", "volatility", "compression", "confidence", "quality", "symmetry", "convergence", "breakout_strength", "consistency", "pivot_confidence", "freshness", "volume_confirmation")
_SCHEMA = "id int, line array<double>, sequence array<double>, distances array<double>, slopes array<double>, angles array<double>, type string, patterns map<string,double>, " + ", ".join(f"{c} double" for c in _NUMBERS)


def _structures(n, seed):
    draw = np.random.default_rng(seed)
    out = []
    for i in range(n):
        line = np.cumsum(draw.normal(0, 1, 100))
        line = (line - line.min()) / np.ptp(line) if i % 9 else np.full(100, 0.0)
        p = int(draw.integers(0, 8))
        arrays = [draw.random(k).tolist() for k in (p, max(0, p - 1), max(0, p - 1), max(0, p - 2))]
        kinds = draw.choice(KINDS, int(draw.integers(0, 3)), replace=False)
        row = {"id": i, "line": line.tolist(), "sequence": arrays[0], "distances": arrays[1], "slopes": arrays[2], "angles": arrays[3], "type": str(draw.choice(KINDS)), "patterns": {str(k): float(draw.random()) for k in kinds}}
        out.append(row | {c: float(draw.random()) * (2 if c == "trend" else 1) - (1 if c == "trend" else 0) for c in _NUMBERS})
    return out


def test_scores_against_loops(spark):
    """Every pair's score and whether its mirror is better."""
    refs, rows = _structures(3, 1), _structures(30, 2)
    right = spark.createDataFrame([tuple(r.values()) for r in rows], _SCHEMA)
    left = spark.createDataFrame([tuple(r.values()) for r in refs], _SCHEMA)
    both = right.crossJoin(left.select(*[F.col(c).alias(f"ref_{c}") for c in left.columns]))
    got = {(r["ref_id"], r["id"]): (r["score"], r["is_mirrored"]) for r in scoring.compared(both).select("ref_id", "id", "score", "is_mirrored").collect()}
    assert len(got) == 90 and len({m for _, m in got.values()}) == 2
    for r in refs:
        for o in rows:
            score, mirrored = _compared(r, o)
            assert got[r["id"], o["id"]][0] == pytest.approx(score, abs=1e-6) and got[r["id"], o["id"]][1] == mirrored


def test_parts_against_loops(spark):
    rows = _structures(20, 7)
    pairs = [(a, b) for a, b in zip(rows, rows[1:], strict=False)]
    df = spark.createDataFrame([(*(a[c] for c in ("line", "slopes", "angles")), *(b[c] for c in ("line", "slopes", "angles"))) for a, b in pairs], "a array<double>, s array<double>, t array<double>, b array<double>, u array<double>, v array<double>")
    df = df.withColumn("d", scoring.warped("a", "b"))
    line, slope = scoring.line_likeness(col("a"), col("b"), col("d")), scoring.slope_likeness(col("s"), col("u"), col("t"), col("v"))
    for r, (a, b) in zip(df.select("d", column(line).alias("line"), column(slope).alias("slope")).collect(), pairs, strict=True):
        assert r["d"] == pytest.approx(_warped(np.array(a["line"]), np.array(b["line"])))
        assert r["line"] == pytest.approx(_line(np.array(a["line"]), np.array(b["line"]))) and r["slope"] == pytest.approx(_slopes(a, b))


def test_types_and_their_mirrors(spark):
    one = lambda text: spark.range(1).select(column(text).alias("v")).first()["v"]
    for k in KINDS:
        assert one(scoring.mirror_type(lit(k))) == _MIRROR.get(k, k)
        for other in KINDS[:5]:
            assert one(scoring.opposites(lit(k), lit(other))) == _opposite(k, other) and one(scoring.same_category(lit(k), lit(other))) == _alike(k, other)
