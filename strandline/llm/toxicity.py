"""Toxicity by a factorization machine over hashed terms.

A document's features are the words it contains and their stems, hashed. The machine learns a
vector for every term, so that the score has a part for each pair of terms that occur together, such
as an insult and a mention of a group, besides the linear weights. Words are runs of letters and
digits in lower case; a term counts once.

The machine is trained here, with Adagrad on the logistic loss, on a bounded sample of labelled rows
(``SAMPLE`` rows by a hash of the key). A term has weights if it tells the labels apart there by itself (``telling``) or
together with another term, by more than chance gives for so many pairs (``telling_pairs``), so two words that are each neutral but
toxic together are learnt, and the many words that occur by chance leave no noise. Scoring goes over all whole texts.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import whole_text

BUCKETS = 1 << 18
STEMS = (4,)
LEAST_SIGMA = 3.0
#: Pairs are looked for among terms of at least this share of the sampled rows, and must stand out this far.
PAIR_SHARE = 0.02
PAIR_SIGMA = 6.0
FACTORS = 4
SAMPLE = 12_000
LEAST_DOCS = 8
EPOCHS = 12
FOLDS = 5

_TERM = re.compile(r"[^\W_]+")


def terms(text: str) -> np.ndarray:
    """The buckets of a text's distinct words and stems, rising. A stem is the first 4 letters of a longer word."""
    crc = zlib.crc32
    words = set(_TERM.findall(text.lower()))
    found = words | {f"{w[:n]}-" for n in STEMS for w in words if len(w) > n}
    return np.unique(np.array([crc(w.encode("utf-8", "surrogatepass")) for w in found], np.int64) % BUCKETS)


@dataclass
class Machine:
    """Weights of the terms in use. ``place``: for a bucket its row in ``weights`` and ``vectors``; row 0 is nothing."""

    bias: float
    place: np.ndarray
    weights: np.ndarray
    vectors: np.ndarray

    def rows(self, buckets: np.ndarray) -> np.ndarray:
        found = self.place[buckets]
        return found[found > 0]

    def margin(self, rows: np.ndarray) -> float:
        """Bias, linear part and pairs, over a fixed scale so that long documents stay in bounds."""
        v = self.vectors[rows]
        total = v.sum(axis=0)
        return float(self.bias + self.weights[rows].sum() + 0.5 * (total @ total - (v * v).sum()))

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.margin(self.rows(terms(text))), -30, 30))))


def telling(found: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Buckets of enough rows whose count among label 1 is ``LEAST_SIGMA`` standard deviations off chance."""
    none = [np.zeros(0, np.int64)]
    every = np.bincount(np.concatenate([*found, *none]), minlength=BUCKETS)
    toxic = np.bincount(np.concatenate([*(f for f, label in zip(found, y, strict=True) if label), *none]), minlength=BUCKETS)
    share = every / max(1, len(found))
    sigma = np.sqrt(np.maximum(1e-12, y.sum() * share * (1 - share)))
    off = np.where(every >= LEAST_DOCS, np.abs(toxic - y.sum() * share) / sigma, 0)
    return np.flatnonzero(off >= LEAST_SIGMA)


def telling_pairs(found: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Buckets that are part of a pair whose labels are ``PAIR_SIGMA`` standard deviations off what the two terms show apart.

    What they show apart is the sum of their effects: the rate with either one, less that of all rows. Counts of pairs are products of
    0-1 columns, over the sampled rows and frequent terms alone.
    """
    n = len(found)
    every = np.bincount(np.concatenate([*found, np.zeros(0, np.int64)]), minlength=BUCKETS)
    often = np.flatnonzero((every >= max(LEAST_DOCS, PAIR_SHARE * n)) & (every < n))
    if not n or len(often) < 2:
        return np.zeros(0, np.int64)
    place = np.full(BUCKETS, -1, np.int64)
    place[often] = np.arange(len(often))
    there = np.zeros((n, len(often)), np.uint8)
    for row, f in zip(there, found, strict=True):
        row[place[f][place[f] >= 0]] = 1
    many = every[often]
    rate, single = y.mean(), np.array([y[there[:, j] == 1].sum() for j in range(len(often))]) / many
    out = np.zeros(len(often), bool)
    for at in range(0, len(often), 128):  # a block of the pair table at a time, summed up over blocks of rows, so that little is in memory at once
        both = np.zeros((len(many[at : at + 128]), len(often)), np.float32)
        toxic = np.zeros_like(both)
        for start in range(0, n, 1000):
            rows = there[start : start + 1000].astype(np.float32)
            part = rows[:, at : at + 128].T
            both += part @ rows
            toxic += (part * y[start : start + 1000].astype(np.float32)) @ rows
        want = np.clip(single[at : at + 128, None] + single[None, :] - rate, 0.02, 0.98).astype(np.float32)
        off = np.abs(toxic - both * want) / np.sqrt(np.maximum(1e-9, both * want * (1 - want)))
        off[(both < LEAST_DOCS) | (both > 0.9 * np.minimum(many[at : at + 128, None], many[None, :]))] = 0  # a word and its stem
        out |= (off >= PAIR_SIGMA).any(axis=0)
        out[at : at + 128] |= (off >= PAIR_SIGMA).any(axis=1)
    return often[out]


def train(rows: list[np.ndarray], labels: list[int], seed: int = 7) -> Machine:
    """Fits a machine to rows of ``terms``; without both labels there are no weights, and the bias is the labels' log odds."""
    found = [np.asarray(r) for r in rows]
    y = np.array(labels, float)
    rate = (y.sum() + 0.5) / (len(y) + 1)
    used = np.union1d(telling(found, y), telling_pairs(found, y))
    place = np.zeros(BUCKETS, np.int32)
    place[used] = np.arange(1, len(used) + 1)
    draw = np.random.default_rng(seed)
    w, v = np.zeros(len(used) + 1), draw.normal(0, 0.05, (len(used) + 1, FACTORS))
    v[0] = 0
    bias = float(np.log(rate / (1 - rate)))
    machine = Machine(bias, place, w, v)
    if 0 < y.sum() < len(y):
        rows = [machine.rows(f) for f in found]
        gw, gv, gb = np.full(w.shape, 1e-8), np.full(v.shape, 1e-8), 1e-8
        for epoch in range(EPOCHS):
            for i in draw.permutation(len(rows)).tolist():
                r = rows[i]
                total = v[r].sum(axis=0)
                p = 1 / (1 + np.exp(-np.clip(machine.margin(r), -30, 30)))
                g = p - y[i]
                step = g + 2e-5 * w[r]
                gw[r] += step * step
                w[r] -= 0.1 * step / np.sqrt(gw[r])
                turn = g * (total - v[r]) + 2e-3 * v[r]
                gv[r] += turn * turn
                v[r] -= 0.02 * turn / np.sqrt(gv[r])
                gb += g * g
                machine.bias -= 0.1 * g / np.sqrt(gb)
    return machine


def held_out(key: str = "doc_id") -> Column:
    """Rows whose label is not learnt from: CRC-32 of the key as text, modulo 5, is 0. Null keys are."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Machine:
    """Trains on labelled rows out of hold-out: at most ``SAMPLE`` of them, those with the least hash of their key.

    Where a key has several labels, any 1 counts; null labels are left out. Of rows with one key, each counts.
    """
    marks = labels.select(F.col(key).alias("_k"), F.col(label).cast("int").alias("_y")).where("_k is not null and _y is not null")
    marks = marks.groupBy("_k").agg(F.max("_y").alias("_y"))
    marks = marks.withColumn("_h", F.xxhash64("_k")).where(~held_out("_k")).orderBy("_h").limit(SAMPLE)
    rows = docs.select(F.col(key).alias("_k"), whole_text(text).alias("t")).join(F.broadcast(marks), "_k")

    @F.pandas_udf("binary")  # numbers as bytes: as lists of the driver's Python they would take ten times as much
    def buckets(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: terms(t).astype("<i4").tobytes())

    rows = rows.select("_h", F.xxhash64("t").alias("_t"), buckets("t").alias("terms"), "_y")
    found = rows.orderBy("_h", "_t").limit(SAMPLE).toPandas()
    return train([np.frombuffer(t, "<i4") for t in found["terms"]], found["_y"].tolist())


def score(docs: DataFrame, machine: Machine, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, held_out, score and predicted for every row; null and empty texts get the bias alone."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # bounded by BUCKETS and SAMPLE

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = shared.value
        for frame in frames:
            yield pd.DataFrame({"k": frame["k"], "h": frame["h"], "score": [machine.score(t) for t in frame["t"]]})

    rows = docs.select(F.col(key).cast("string").alias("k"), held_out(key).alias("h"), whole_text(text).alias("t"))
    made = rows.mapInPandas(run, "k string, h boolean, score double")
    return made.select(F.col("k").cast("long").alias(key), F.col("h").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fits on ``labels`` and scores every row of ``docs``; nulls, repeats and empty tables as in ``fit`` and ``score``."""
    return score(docs, fit(docs, labels))


def keep_clean(docs: DataFrame, machine: Machine, text: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows that score below ``limit``, columns as they were.

    Null and empty texts have the score of the bias and so stay unless most labels are 1; null keys and repeated rows are judged by
    their text like any other; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    @F.pandas_udf("double")
    def rate(texts: pd.Series) -> pd.Series:
        return texts.map(shared.value.score)

    return docs.where(rate(whole_text(text)) < limit)
