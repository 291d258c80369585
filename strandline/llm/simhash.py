"""SimHash near-duplicates by anchor-point covering.

Fingerprints are 64 bits. The first 46 bits are read as two blocks of 23, each covered by the binary
Golay code: every block lies within ``RADIUS`` = 3 of exactly one codeword. Pairs of codewords are the
anchors. A fingerprint is at home at its nearest anchor, and is replicated to every anchor within
covering radius plus threshold: block by block at most 3 bits off, and beyond that no more than
``DISTANCE`` bits over both blocks. If two fingerprints differ in at most ``DISTANCE`` bits, each is among the
visitors at the other's home, so comparing homes with visitors anchor by anchor finds all links.

Only distinct fingerprints are compared, so exact copies cost nothing more, and a home is kept only
as long as other fingerprints visit its anchor. An anchor's group is compared in blocks of
bounded size, and gives a spanning forest of its links instead of all pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import WORD, materialise, sheltered, shuffle_partitions, small, whole_text
from strandline.llm.components import components

SHINGLE = 3
DISTANCE = 2
RADIUS = 3
SEED = 42
#: Generator of the binary Golay code of length 23 (fixed value).
GOLAY = 0b101011100011
#: Visitors by homes compared at once.
BLOCK = 1 << 21

_WORD = re.compile(WORD.encode())
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingle_hashes(text: str) -> np.ndarray:
    """XXH64 of every shingle; of the whole word sequence if it is shorter; none without words."""
    words = _WORD.findall(text.encode("utf-8").translate(_LOWER))
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = (ends[: -SHINGLE + 1] - [len(w) for w in words[: -SHINGLE + 1]]).tolist()
    digest, view = xxhash.xxh64_intdigest, joined
    return np.array([digest(view[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(text: str) -> int:
    """A bit is 1 if it is set in over half of the hashes; 0 for a text without words."""
    counts, n = np.zeros(64, np.int64), 0
    hashes = shingle_hashes(text)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)].astype("<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(part)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``own``, a hash that tells the texts of one key apart, and ``fp``, the fingerprint as a signed long."""

    def make(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            fps = np.array([fingerprint(t) for t in frame["t"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"k": frame["k"], "own": frame["own"], "fp": fps})

    rows = docs.select(F.col(key).cast("string").alias("k"), F.xxhash64(whole_text(text)).alias("own"), whole_text(text).alias("t"))
    return rows.mapInPandas(make, "k string, own long, fp long").select(F.col("k").cast("long").alias(key), "own", "fp")


# --- the covering code ---


def _syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders modulo the generator: 11 bits that are 0 for codewords."""
    words = words.astype(np.int64)
    for bit in range(22, 10, -1):
        words = np.where(words >> bit & 1, words ^ (GOLAY << (bit - 11)), words)
    return words


def _patterns() -> tuple[list[np.ndarray], list[np.ndarray]]:
    """By syndrome: the differences to all codewords within radius + distance, and the bits beyond the radius."""
    from itertools import combinations

    bits = [1 << i for i in range(23)]
    errors = [(sum(c), w) for w in range(RADIUS + DISTANCE + 1) for c in combinations(bits, w)]
    values = np.array([e for e, _ in errors], np.int64)
    beyond = np.maximum(0, np.array([w for _, w in errors]) - RADIUS)
    order = np.argsort(_syndromes(values), kind="stable")
    cuts = np.searchsorted(_syndromes(values)[order], np.arange(1, 2048))
    return np.split(values[order], cuts), np.split(beyond[order], cuts)


_TABLE: list = []


def anchors(fp: int) -> tuple[np.ndarray, np.ndarray]:
    """The anchors of a fingerprint, as 46-bit numbers, and which one is its home."""
    if not _TABLE:
        _TABLE.extend(_patterns())
    values, beyond = _TABLE
    blocks = np.array([fp & 0x7FFFFF, fp >> 23 & 0x7FFFFF])
    s, t = _syndromes(blocks)
    off = beyond[s][:, None] + beyond[t][None, :]
    i, j = np.nonzero(off <= DISTANCE)
    return (blocks[0] ^ values[s][i]) | (blocks[1] ^ values[t][j]) << 23, off[i, j] == 0


def _visits(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each fingerprint at every anchor it is replicated to."""
    for frame in frames:
        fps = frame["fp"].to_numpy(np.int64)
        for start in range(0, len(fps), 2000):
            part = fps[start : start + 2000]
            found = [anchors(int(x)) for x in part.view(np.uint64).tolist()]
            yield pd.DataFrame({
                "anchor": np.concatenate([a for a, _ in found]),
                "fp": np.repeat(part, [len(a) for a, _ in found]),
                "home": np.concatenate([h for _, h in found]),
            })


def _forest(fps: np.ndarray, homes: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links between a group's homes and all its fingerprints, compared in blocks."""
    root = np.arange(len(fps))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = int(root[i])
        return i

    out, words = [], fps.view(np.uint64)
    step = max(1, BLOCK // len(fps))
    for at in range(0, len(homes), step):
        rows = homes[at : at + step]
        near = np.bitwise_count(words[rows][:, None] ^ words[None, :]) <= DISTANCE
        for i, j in zip(*np.nonzero(near), strict=True):
            a, b = find(int(rows[i])), find(int(j))
            if a != b:
                root[a] = b
                out.append((int(fps[rows[i]]), int(fps[j])))
    return out


def _compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come in the order of their anchors; a group may go over several batches."""
    anchor, fps, homes = None, [], []

    def close() -> list[tuple[int, int]]:
        if not homes or len(fps) < 2:
            return []
        every = np.array(fps, np.int64)
        return _forest(every, np.array(homes))

    for frame in frames:
        out = []
        for a, fp, home in zip(frame["anchor"].tolist(), frame["fp"].tolist(), frame["home"].tolist(), strict=True):
            if a != anchor:
                out += close()
                anchor, fps, homes = a, [], []
            if home:
                homes.append(len(fps))
            fps.append(fp)
        yield pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)
    yield pd.DataFrame(close(), columns=["a", "b"], dtype=np.int64)


def links(distinct: DataFrame) -> DataFrame:
    """Links ``a``, ``b`` that connect all distinct fingerprints ``fp`` no more than ``DISTANCE`` bits apart."""
    spark = distinct.sparkSession
    spread = distinct.select("fp").repartition(shuffle_partitions(spark), "fp")  # replicas are many more rows than this
    visits = spread.mapInPandas(_visits, "anchor long, fp long, home boolean")
    groups = visits.repartition("anchor").sortWithinPartitions("anchor")
    return groups.mapInPandas(_compare, "a long, b long")


def _rooted(marked: DataFrame, key: str) -> DataFrame:
    """``fp``, ``least`` (its least key) and ``root`` (the least fingerprint reached by links) of each fingerprint."""
    distinct = materialise(marked.groupBy("fp").agg(F.min(key).alias("least")), "simhash-distinct")
    reached = components(links(distinct))
    roots = distinct.join(reached, distinct["fp"] == reached["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    return materialise(roots, "simhash-roots")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``fp`` and ``component_id``: the least key of the documents reached by links.

    Null texts are empty, texts without words have fingerprint 0 and are linked to each other; null
    keys take part in links and get the class of their group, null where no member has a key;
    repeated rows each get their row; an empty table gives an empty result.
    """
    marked = materialise(fingerprints(docs, key, text), "simhash")
    roots = _rooted(marked, key)
    ids = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = roots.join(ids, "root").select("fp", "component_id")
    return marked.join(classes, "fp").select(key, "fp", "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each class of near-duplicates, that of the least key, nulls last; columns as they were.

    Texts under one key, or without a key, are told apart by a hash. Of repeats of key and text one stays;
    only such rows are grouped, the others' texts stay where they are.
    """
    marked = materialise(fingerprints(docs, key, text).withColumnRenamed(key, "_k").withColumnRenamed("own", "_own"), "simhash")
    roots = _rooted(marked, "_k").select("fp", "root")
    rows_of = marked.groupBy("fp", "_k", "_own").agg(F.count("*").alias("n")).join(roots, "fp")
    firsts = rows_of.groupBy("root").agg(F.min(F.struct(F.col("_k").isNull().alias("no_key"), "_k", "_own", "n")).alias("first"))
    keepers = materialise(firsts.select("first._k", "first._own", "first.n"), "simhash-keepers")
    rows, names = sheltered(docs)
    rows = rows.withColumn("_hash", F.xxhash64(whole_text(names[text])))
    same = F.col(names[key]).eqNullSafe(F.col("_k")) & (F.col("_hash") == F.col("_own"))
    kept = rows.join(small(keepers.where("n = 1").select("_k", "_own"), 32), same, "left_semi")
    again = keepers.where("n > 1").select("_k", "_own")
    if not again.isEmpty():
        kept = kept.unionByName(rows.join(small(again, 32), same, "left_semi").dropDuplicates([names[key], "_hash"]))
    return kept.select(*[F.col(n).alias(c) for c, n in names.items()])
