"""Importance resampling of documents towards a target collection, over hashed word features counted in tries.

Words are runs of letters, digits and non-ASCII characters, A-Z in lower case. A document's features are all runs of 1 to ``most``
consecutive words joined by a space; a feature's bucket is the CRC-32 of its UTF-8 bytes modulo ``buckets``. Each task keeps a trie of the
word runs it meets: a node stands for a run, is one word deeper than its parent, and goes on from the parent's CRC state, so a run's bytes are
hashed once and not at each occurrence. While counting, nodes hold counts; they go into the task's bucket totals when the trie has ``NODES``
nodes and at the end, and totals of all tasks are summed by bucket. While scoring, nodes hold the gain of their bucket, and a document's
weight is the sum over the paths its words walk.

A bucket's gain is ``floor(1000 * ln(p / q))`` for the smoothed shares ``p`` in the target and ``q`` in the documents. Scores are weights with Gumbel noise
from a hash of the key, so the documents of the highest scores are a sample without replacement, with odds by weight.

Nulls and odd rows: a null text has no words; a null key has the noise of the text ``null``; repeated rows are documents of their own
and of equal score; ties go to the smaller key (nulls first), then to fewer features. An empty table gives no rows; an empty target has gains from smoothing alone. Other columns are not used.
What a task holds is a trie and ``buckets`` totals; the driver holds ``buckets`` gains.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import materialise, numbered, whole_text

BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
#: A task's trie is emptied after the document that takes it past so many nodes.
NODES = 400_000

#: Bytes that are no part of a word become spaces, A-Z become a-z.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    """The words of a text given as UTF-8."""
    return text.translate(_FOLD).split()


class Node:
    __slots__ = ("count", "gain", "next", "state")

    def __init__(self, state: int, gain: int) -> None:
        self.state, self.gain, self.count, self.next = state, gain, 0, None


class Level(dict):
    """The nodes below one node, by word; a node is made when it is first asked for."""

    def __init__(self, trie: Trie, lead: bytes, state: int) -> None:
        super().__init__()
        self.trie, self.lead, self.state = trie, lead, state

    def __missing__(self, word: bytes) -> Node:
        state = zlib.crc32(self.lead + word, self.state)
        trie = self.trie
        node = self[word] = Node(state, trie.gains[state % trie.buckets] if trie.gains else 0)
        trie.nodes.append(node)
        return node


class Trie:
    """Word runs of 1 to ``most`` words; ``gains``: what the node of each bucket is worth."""

    def __init__(self, most: int, buckets: int, gains: list[int] | None = None) -> None:
        self.most, self.buckets, self.gains = most, buckets, gains
        self.clear()

    def clear(self) -> None:
        self.nodes: list[Node] = []
        self.root = Level(self, b"", 0)

    def walk(self, found: list[bytes]) -> Iterable[Node]:
        """The nodes of all runs, in the order of their first words."""
        return map(self.root.__getitem__, found) if self.most == 1 else self._paths(found)

    def _paths(self, found: list[bytes]) -> Iterator[Node]:
        for at in range(len(found)):
            level = self.root
            for word in found[at : at + self.most]:
                node = level[word]
                yield node
                if node.next is None:
                    node.next = Level(self, b" ", node.state)
                level = node.next

    def drain(self, totals: np.ndarray) -> None:
        """Adds the counts to the bucket totals and empties the trie."""
        states = np.fromiter((n.state for n in self.nodes), np.int64, len(self.nodes))
        counts = np.fromiter((n.count for n in self.nodes), np.int64, len(self.nodes))
        np.add.at(totals, states % self.buckets, counts)
        self.clear()


def bucket_counts(docs: DataFrame, text: str = "text", most: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """``bucket`` and ``n``: occurrences of features over all rows; buckets without any are left out."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie, totals = Trie(most, buckets), np.zeros(buckets, np.int64)
        for frame in frames:
            for data in frame["t"]:
                for node in trie.walk(words(data)):
                    node.count += 1
                if len(trie.nodes) > NODES:
                    trie.drain(totals)
        trie.drain(totals)
        used = np.flatnonzero(totals)
        yield pd.DataFrame({"bucket": used, "n": totals[used]})

    parts = docs.select(whole_text(text).cast("binary").alias("t")).mapInPandas(count, "bucket long, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text", most: int = 1, buckets: int = BUCKETS) -> list[int]:
    """The gain of every bucket, one list of ``buckets`` numbers."""
    own = bucket_counts(docs, text, most, buckets).withColumnRenamed("n", "s")
    wanted = bucket_counts(target, target_text, most, buckets).withColumnRenamed("n", "t")
    table = docs.sparkSession.range(buckets).withColumnRenamed("id", "bucket").join(own, "bucket", "left").join(wanted, "bucket", "left")
    table = materialise(table.na.fill(0, ["s", "t"]), "bucket-totals")
    sums = table.agg(F.sum("s").cast("double").alias("own"), F.sum("t").cast("double").alias("wanted"))
    share = f"(t + 1) * (own + {buckets}) / ((s + 1) * (wanted + {buckets}))"
    made = table.selectExpr("bucket", "cast(s as double) s", "cast(t as double) t").crossJoin(F.broadcast(sums))  # one row
    return [r["g"] for r in made.orderBy("bucket").selectExpr(f"cast(floor(1000 * ln({share})) as long) g").collect()]


def scores(docs: DataFrame, worth: list[int], key: str = "doc_id", text: str = "text", most: int = 1, seed: int = SEED) -> DataFrame:
    """``key``, n_words, n_features, weight and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(worth)  # one number a bucket

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie = Trie(most, len(shared.value), shared.value)
        for frame in frames:
            out = []
            for data in frame["t"]:
                found = words(data)
                out.append((len(found), sum([max(0, len(found) - i) for i in range(most)]), sum([n.gain for n in trie.walk(found)])))
                if len(trie.nodes) > NODES:
                    trie.clear()
            yield pd.DataFrame(out, columns=["n_words", "n_features", "weight"]).assign(k=frame["k"])

    # keys go as text: a batch with a null would make them floating-point numbers
    rows = docs.select(F.col(key).cast("string").alias("k"), whole_text(text).cast("binary").alias("t"))
    rows = rows.mapInPandas(score, "k string, n_words long, n_features long, weight long")
    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce("k", F.lit("null"))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((drawn + 0.5) / 4294967296.0))).cast("long")
    return rows.select(F.col("k").cast("long").alias(key), "n_words", "n_features", "weight", (F.col("weight") + noise).alias("score"))


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", most: int = 1, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """Every row's ``key``, n_words, n_features, weight, score and ``rank`` (null unless drawn).

    Of the N rows of ``least_words`` or more, floor(percent * N / 100) are drawn, highest scores first.
    """
    rows = materialise(scores(docs, gains(docs, target, text, target_text, most, buckets), key, text, most, seed), "resample-scores")
    open_rows = rows.where(F.col("n_words") >= least_words)
    best = (F.col("score").desc(), F.col(key).asc_nulls_first(), F.col("n_features"))
    # rows that are alike in all of these are interchangeable; the last column lets them be split among tasks
    ranked = open_rows.withColumn("_spread", F.monotonically_increasing_id()).repartitionByRange(*best, F.col("_spread")).sortWithinPartitions(*best).drop("_spread")
    ranked = numbered(ranked, "rank", "resample-ranks").withColumn("rank", F.col("rank") + 1)
    drawn = percent * open_rows.count() // 100
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return ranked.unionByName(rows.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))
