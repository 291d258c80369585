"""Quality of documents by attention over their passages (multiple-instance learning).

A document is a bag of passages of ``PASSAGE`` words; only the bag has a label. Each passage becomes a vector of shares: kinds of
characters, pairs of kinds, lengths of words, words that repeat the one before, and words that are new in the passage. A layer encodes it
to ``h``; the gated attention ``w . (tanh(V h) * sigmoid(U h))``, as a softmax over the document's passages, says how much each counts; the logistic
score is that of the weighted mean of ``h``. So a few passages of junk can decide about a long document, and which do is learnt from labels of documents alone.

The model is trained here with numpy, by Adam, on at most ``SAMPLE`` labelled rows (those of least hash of the key), of which bags of over
``BAG`` passages give ``BAG`` evenly spread ones. Scoring goes over all passages of all whole texts: a long text is encoded in parts of ``PART`` bytes whose
attention sums are added up, so memory does not grow with a document.

Nulls and odd rows: null, empty and blank texts have no passages and get the score of the bias; null keys count as held out and are scored; repeated
rows are scored each, alike; labels that are null are left out, of several for a key the largest counts; an empty table of documents gives no rows, without
labels (or with one kind alone) every score is the labels' smoothed share. Other columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import whole_text
from strandline.llm.toxicity import held_out

PASSAGE = 64
SAMPLE = 8_000
BAG = 64
PART = 1 << 20
ENCODED, GATES = 24, 12
EPOCHS, BATCH, RATE = 12, 64, 0.01

# kinds of bytes: 0 space, 1 line feed, 2 . and , 3 other marks of sentences, 4 quotes and brackets, 5 other signs, 6 digits, 7 capitals, 8 vowels, 9 other small letters, 10 beyond ASCII
_KINDS = 11
_KIND = np.full(256, 5, np.uint8)
_KIND[128:] = 10
for _kind, _bytes in ((0, b" \t\x0b\x0c"), (1, b"\n\r"), (2, b".,"), (3, b";:!?"), (4, b"\"'()[]-"), (6, b"0123456789"), (7, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (9, b"bcdfghjklmnpqrstvwxz"), (8, b"aeiouy")):
    _KIND[np.frombuffer(_bytes, np.uint8)] = _kind
_SPACE = np.isin(np.arange(256), np.frombuffer(b" \t\x0b\x0c\n\r", np.uint8))
_PAIRS = _KINDS * _KINDS
_LENGTHS = 12
#: Shares of pairs of kinds, of kinds, of lengths of words; repeats, new words, words in relation to a full passage.
WIDTH = _PAIRS + _KINDS + _LENGTHS + 3
_POWERS = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64))


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A row of ``WIDTH`` shares for every passage of the texts, and the number of the text it is of. What a passage gets depends on its text alone."""
    cut = [(i, s) for i, t in enumerate(texts) if (s := t.strip(b" \t\x0b\x0c\n\r"))]
    if not cut:
        return np.zeros((0, WIDTH), np.float32), np.zeros(0, np.int64)
    ids, cut = np.array([i for i, _ in cut]), [s for _, s in cut]
    data = np.frombuffer(b" ".join([*cut, b""]), np.uint8)
    firsts = np.concatenate([[0], np.cumsum([len(s) + 1 for s in cut])])
    blank = _SPACE[data]
    inside = ~blank
    starts = np.flatnonzero(inside & np.concatenate([[True], blank[:-1]]))
    ends = np.flatnonzero(blank & np.concatenate([[False], inside[:-1]]))
    lengths = ends - starts
    doc = np.searchsorted(firsts, starts, "right") - 1
    number = np.arange(len(starts)) - np.searchsorted(starts, firsts[:-1])[doc]
    opens = number % PASSAGE == 0
    of_word = np.cumsum(opens) - 1
    edges = np.append(starts[opens], len(data))
    count = len(edges) - 1
    # kinds and pairs of kinds; the space between two texts is a pair of neither
    kind = _KIND[data]
    of_byte = np.repeat(np.arange(count, dtype=np.int32), np.diff(edges))
    pair = kind.astype(np.int32) * _KINDS
    pair[:-1] += kind[1:]
    pair += of_byte * (_PAIRS + 1)
    pair[firsts[1:] - 1] = of_byte[firsts[1:] - 1] * (_PAIRS + 1) + _PAIRS
    pairs = np.bincount(pair, minlength=count * (_PAIRS + 1)).reshape(count, _PAIRS + 1)[:, :_PAIRS]
    size = np.maximum(1, pairs.sum(axis=1))[:, None]
    kinds = pairs.reshape(count, _KINDS, _KINDS).sum(axis=2)
    many = np.bincount(of_word, minlength=count)[:, None]
    long = np.bincount(of_word * _LENGTHS + np.minimum(lengths, _LENGTHS) - 1, minlength=count * _LENGTHS).reshape(count, _LENGTHS)
    # words as hashes; a word's bytes past the 64th take powers from the first again
    places = np.arange(len(data)) - np.repeat(np.append(0, starts[1:]), np.diff(np.append(np.append(0, starts[1:]), len(data))))
    hashed = np.add.reduceat(np.where(inside, (data.astype(np.uint64) + np.uint64(1)) * _POWERS[places & 63], np.uint64(0)), starts)
    same = np.concatenate([[False], (hashed[1:] == hashed[:-1]) & (of_word[1:] == of_word[:-1])])
    again = np.bincount(of_word[same], minlength=count)[:, None]
    distinct = np.unique((of_word.astype(np.uint64) << np.uint64(36)) | (hashed >> np.uint64(28)))
    fresh = np.bincount((distinct >> np.uint64(36)).astype(np.int64), minlength=count)[:, None]
    rows = np.concatenate([pairs / size, kinds / size, long / many, again / many, fresh / many, many / PASSAGE], axis=1)
    return rows.astype(np.float32), ids[doc[opens]]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    """Mean and scale of the shares; ``parts``: encoder E and e, attention V, U and w, score c and b."""

    bias: float
    mean: np.ndarray = field(default_factory=lambda: np.zeros(WIDTH, np.float32))
    scale: np.ndarray = field(default_factory=lambda: np.ones(WIDTH, np.float32))
    parts: dict[str, np.ndarray] = field(default_factory=dict)

    def standard(self, rows: np.ndarray) -> np.ndarray:
        return np.clip((rows - self.mean) / self.scale, -6, 6)

    def encode(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What each passage is encoded to, and its attention before the softmax."""
        p = self.parts
        h = np.tanh(self.standard(rows) @ p["E"] + p["e"])
        return h, (np.tanh(h @ p["V"]) * _sigmoid(h @ p["U"])) @ p["w"]

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """A score for each text. Attention is bounded by the length of ``w``, so sums of its exponentials need no common offset."""
        weight, total = np.zeros(len(texts)), np.zeros((len(texts), ENCODED))
        if self.parts:
            for which, part in _parts(texts):
                rows, of = passages(part)
                if len(rows):
                    h, a = self.encode(rows)
                    at = np.array(which)[of]
                    e = np.exp(a)
                    np.add.at(weight, at, e)
                    np.add.at(total, at, e[:, None] * h)
            out = (total / np.maximum(weight, 1e-30)[:, None]) @ self.parts["c"]
        else:
            out = np.zeros(len(texts))
        return _sigmoid(out + self.bias)


def _parts(texts: list[bytes]) -> Iterator[tuple[list[int], list[bytes]]]:
    """Texts in portions of about ``PART`` bytes; a longer text is cut behind a space, at whole passages as far as its words allow."""
    which, part, held = [], [], 0
    for i, text in enumerate(texts):
        at = 0
        while at < len(text) or at == 0:
            end = len(text)
            if end - at > 2 * PART:
                space = text.find(b" ", at + PART)
                end = space + 1 if space >= 0 else end
            which.append(i)
            part.append(text[at:end])
            held += end - at
            at = max(end, 1)
            if held >= PART:
                yield which, part
                which, part, held = [], [], 0
    if part:
        yield which, part


def train(bags: list[np.ndarray], labels: list[int], seed: int = 11) -> Model:
    """Fits a model to bags of passage rows. Without both labels it has a bias alone."""
    y = np.array(labels, np.float64)
    rate = (y.sum() + 0.5) / (len(y) + 1)
    model = Model(float(np.log(rate / (1 - rate))))
    full = [i for i, b in enumerate(bags) if len(b)]
    if not full or not 0 < y[full].sum() < len(full):
        return model
    rows, y = np.concatenate([bags[i] for i in full]).astype(np.float32), y[full]
    sizes = np.array([len(bags[i]) for i in full])
    begins = np.concatenate([[0], np.cumsum(sizes)])
    model.mean, model.scale = rows.mean(axis=0), np.maximum(rows.std(axis=0), 0.02)
    draw = np.random.default_rng(seed)
    shapes = {"E": (WIDTH, ENCODED), "e": (ENCODED,), "V": (ENCODED, GATES), "U": (ENCODED, GATES), "w": (GATES,), "c": (ENCODED,)}
    p = {k: draw.normal(0, 1 / np.sqrt(s[0]), s) if k != "e" else np.zeros(s) for k, s in shapes.items()}
    p["b"] = np.array([model.bias])
    first, second, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    for _ in range(EPOCHS):
        order = draw.permutation(len(full))
        for i in range(0, len(order), BATCH):
            batch = order[i : i + BATCH]
            n = sizes[batch]
            of = np.repeat(np.arange(len(batch)), n)
            at = np.repeat(begins[batch], n) + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            heads = np.cumsum(n) - n
            x = model.standard(rows[at])
            h = np.tanh(x @ p["E"] + p["e"])
            t, s = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
            e = np.exp((t * s) @ p["w"])
            a = e / np.add.reduceat(e, heads)[of]
            z = np.add.reduceat(a[:, None] * h, heads)
            off = (_sigmoid(z @ p["c"] + p["b"]) - y[batch]) / len(batch)
            # back through the mean, the softmax, the gates and the encoder
            dz = off[:, None] * p["c"]
            da = (dz[of] * h).sum(axis=1)
            dscore = a * (da - np.add.reduceat(a * da, heads)[of])
            dt, ds = dscore[:, None] * p["w"] * s * (1 - t * t), dscore[:, None] * p["w"] * t * s * (1 - s)
            dh = (a[:, None] * dz[of] + dt @ p["V"].T + ds @ p["U"].T) * (1 - h * h)
            grads = {"E": x.T @ dh, "e": dh.sum(axis=0), "V": h.T @ dt, "U": h.T @ ds, "w": (t * s).T @ dscore, "c": z.T @ off, "b": np.array([off.sum()])}
            step += 1
            for k, g in grads.items():
                g = g + 1e-4 * p[k] * (k != "b")
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                p[k] -= RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    model.bias = float(p.pop("b")[0])
    model.parts = p
    return model


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """Trains on labelled rows out of hold-out: at most ``SAMPLE`` of them, those with the least hash of their key; of rows with one key, each counts."""
    marks = labels.select(F.col(key).alias("_k"), F.col(label).cast("int").alias("_y")).where("_k is not null and _y is not null")
    marks = marks.groupBy("_k").agg(F.max("_y").alias("_y"))
    marks = marks.withColumn("_h", F.xxhash64("_k")).where(~held_out("_k")).orderBy("_h").limit(SAMPLE)
    rows = docs.select(F.col(key).alias("_k"), whole_text(text).alias("t")).join(F.broadcast(marks), "_k")  # SAMPLE rows of three numbers
    rows = rows.select("_h", F.xxhash64("t").alias("_t"), F.col("t").cast("binary").alias("t"), "_y")

    def bags(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [passages([t])[0] for t in frame["t"]]
            found = [b[np.linspace(0, len(b) - 1, BAG).astype(int)] if len(b) > BAG else b for b in found]
            yield pd.DataFrame({"_h": frame["_h"], "_t": frame["_t"], "_y": frame["_y"], "bag": [b.astype(np.float16).tobytes() for b in found]})

    made = rows.mapInPandas(bags, "_h long, _t long, _y int, bag binary").orderBy("_h", "_t").limit(SAMPLE).toPandas()
    return train([np.frombuffer(b, np.float16).reshape(-1, WIDTH) for b in made["bag"]], made["_y"].tolist())


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", least: float = 0.3) -> DataFrame:
    """``key``, held_out, score and predicted (1 if the score is ``least`` or more) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"k": frame["k"], "h": frame["h"], "score": shared.value.scores(frame["t"].tolist())})

    # keys go as text: a batch with a null would make them floating-point numbers
    rows = docs.select(F.col(key).cast("string").alias("k"), held_out(key).alias("h"), whole_text(text).cast("binary").alias("t"))
    made = rows.mapInPandas(run, "k string, h boolean, score double")
    return made.select(F.col("k").cast("long").alias(key), F.col("h").alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fits on ``labels`` and scores every row of ``docs``."""
    return score(docs, fit(docs, labels))
