"""Fuzzy line deduplication by MinHash: signatures and checks in Arrow batches, everything else DataFrame functions.

A line is what stands between line feeds, without white space around it. Blank lines always stay. Equal lines of
any length are found by two hashes (96 bits). Near lines are looked for among lines of ``MIN_CHARS`` characters or more:

* signature: ``BANDS`` times ``ROWS`` minima over all runs of ``SHINGLE`` characters, the same that are checked. Row ``r``
  of a band is a permutation of its own that ranks the runs of fifth ``r`` (by a hash of the run) before all
  others, so one pass over a line feeds each run to a fifth of the permutations. Lines of up to ``SHORT[1]`` runs, whose
  fifths would hold few, have every run ranked by every permutation; those of ``SHORT[0]`` to ``SHORT[1]`` have both signatures,
  so that near lines on either side of the bound still share one;
* banding: a band is ``ROWS`` of these minima. At a similarity of 0.8 a pair shares a band in
  1 - (1 - 0.8**5)**12 = 99 % of cases. Lines of one language share some 4 % of these runs, so bands of 3 would
  fill with strangers as the table grows;
* parities: of a line in a shared band, the number of its different runs, and for each of ``WORDS`` * 64 places by hash whether an odd number of them
  falls there. Sets that differ in d runs differ in at most d places, so these tell most pairs under the bound without their texts and lose none
  above it (``_may_be_near``);
* links: each line of a band is first checked against the band's least line, found by partial aggregation and a
  join that Spark may split. In bands that then hold more than one component, lines of different ones are checked against each other in
  rounds, until all have been (see ``banded_links``). A family whose lines lie just under the bound takes all its pairs;
* check: exact Jaccard similarity of the whole sets of ``SHINGLE``-character runs, ``LEAST`` or more;
* union-find: connected components over checked links; one line per component stays, the first by
  (key, place in the text).

A form with DataFrame functions alone is too slow for its budget (see the README). Texts never move in a shuffle but for
lines with a candidate; what moves are hashes and places. Tables
of counted size within ``BROADCAST_BYTES`` are broadcast, larger ones are shuffled.

Nulls: a null text stays null; a null key sorts last. Rows that share a key are told apart by a hash of their texts; repeats of both keep the same lines.
Empty tables, empty texts and texts of one very long line pass through. A document whose lines all
stand elsewhere keeps an empty text. Further columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import BROADCAST_BYTES, materialise, release, scratch, sheltered, small
from strandline.llm.components import banded_links, components, in_shared_bands

MIN_CHARS = 16
SHINGLE = 5
LEAST = 0.8
BANDS = 12
ROWS = 5
#: Numbers of runs between which a line has a signature of either kind.
SHORT = (48, 64)
SEED = 97
#: Bits of a signature's sketch (one for each minimum, 60) that may differ between most lines at ``LEAST``: 6 are expected there, some 26 between strangers. Links do not depend on it.
MOST_OFF = 20
#: Longs of a line's parities.
WORDS = 16
#: Characters whose signatures are made at once.
CHUNK = 1 << 18
_LAST_KEY = 2**63 - 1


def _lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Lines with their document ``id`` and its text's hash ``own``, place ``pos`` and hashes ``h``, ``g``."""
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(_LAST_KEY)).alias("id"), F.xxhash64(text).alias("own"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    rows = rows.withColumn("line", F.trim("line", F.lit(" \t\r\f\v"))).where("line != ''")
    return rows.withColumns({"h": F.xxhash64("line"), "g": F.hash("line")})


def _long(lines: DataFrame) -> DataFrame:
    return lines.where(F.length("line") >= MIN_CHARS)


def _loc() -> Column:
    """Document, its text's hash and place; they sort in this order."""
    return F.struct("id", "own", "pos")


_MULTIPLIERS = np.random.default_rng(SEED).integers(1 << 62, 1 << 63, (SHINGLE,), np.uint64) | np.uint64(1)
_TURNS = np.random.default_rng(SEED + 1).integers(0, 1 << 32, (BANDS, ROWS, 2)).astype(np.uint32) | np.uint32(1)


def runs(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every run of ``SHINGLE`` characters of lines of at least that length, and how many each line has."""
    points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    n = len(points) - SHINGLE + 1
    x = points[:n] * _MULTIPLIERS[0]
    for j in range(1, SHINGLE):
        x += points[j : n + j] * _MULTIPLIERS[j]
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    inside, ends = np.ones(len(points), bool), np.cumsum(sizes)
    for j in range(1, SHINGLE):
        inside[ends - j] = False  # a run that would go over the end of its line
    return x[inside[:n]], sizes - (SHINGLE - 1)


def _signed(lines: list[str], kind: int) -> tuple[np.ndarray, np.ndarray]:
    """A row of bands a line, and its sketch. Of kind 0 every run has a rank in every row of a band, of kind 1 in that of its fifth."""
    x, sizes = runs(lines)
    fifth = ((x >> np.uint64(32)) * np.uint64(ROWS) >> np.uint64(32)).astype(np.uint8)
    x, owner = x.astype(np.uint32), np.repeat(np.arange(len(lines), dtype=np.int32), sizes)
    bands = np.arange(BANDS, dtype=np.uint64)[:, None] * np.uint64(2) + np.full((BANDS, len(lines)), kind, np.uint64)
    sketch = np.zeros(len(lines), np.uint64)
    for row in range(ROWS):
        if kind:
            at = np.flatnonzero(fifth == row)
            own, of = x[at], owner[at]
        else:
            own, of = x, owner
        least = np.full((BANDS, len(lines)), 0xFFFFFFFF, np.uint32)
        if len(own):
            starts = np.flatnonzero(of[1:] != of[:-1]) + 1
            starts = np.concatenate([[0], starts])
            there = of[starts]
            for band in range(BANDS):
                turn, shift = _TURNS[band, row]
                least[band, there] = np.minimum.reduceat(own * turn ^ shift, starts)
        for bit in least * np.uint32(0x9E3779B1) >> np.uint32(31):
            sketch = sketch << np.uint64(1) | bit
        bands = (bands ^ least) * np.uint64(0x9E3779B97F4A7C15)
        bands ^= bands >> np.uint64(31)
    return bands.T.copy().view(np.int64), sketch.view(np.int64)


def signatures(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which line, its bands as 64-bit hashes, and its sketch; lines of middling length come twice, once of each kind."""
    sizes = np.fromiter(map(len, lines), np.int64, len(lines)) - (SHINGLE - 1)
    which, made = [], []
    for kind, wanted in enumerate((sizes <= SHORT[1], sizes >= SHORT[0])):
        at = np.flatnonzero(wanted)
        if len(at):
            which.append(at)
            made.append(_signed([lines[i] for i in at.tolist()], kind))
    return np.concatenate(which), np.concatenate([b for b, _ in made]), np.concatenate([s for _, s in made])


def _bands(lines: DataFrame) -> DataFrame:
    """``h`` and ``bands`` of each line; a line that repeats within a batch comes once."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, first = np.unique(batch.column(0).to_numpy(), return_index=True)
            texts = batch.column(1).take(pa.array(first)).to_pylist()
            cuts = np.cumsum([len(t) for t in texts]) // CHUNK
            for part in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(cuts)) + 1):
                if len(part):
                    which, bands, _ = signatures([texts[i] for i in part.tolist()])
                    lists = pa.FixedSizeListArray.from_arrays(pa.array(bands.ravel()), BANDS).cast(pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array(h[part][which]), lists], names=["h", "bands"])

    return lines.select("h", "line").mapInArrow(make, "h long, bands array<long>")


def parities(line: str) -> list[int]:
    """The number of a line's different runs, then ``WORDS`` longs: for each place whether an odd number of these runs falls there."""
    x = np.unique(runs([line])[0])
    odd = np.bincount((x >> np.uint64(20)).astype(np.int64) % (64 * WORDS), minlength=64 * WORDS) & 1
    return [len(x), *np.packbits(odd.astype(bool)).view(">i8").tolist()]


def _may_be_near(a: str, b: str) -> Column:
    """Whether lines with parities ``a`` and ``b`` can be alike: at ``LEAST`` their sets of n and m runs differ in at most (n + m) * (1 - LEAST) / (1 + LEAST)."""
    n, m = F.get(a, F.lit(0)), F.get(b, F.lit(0))
    off = sum((F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(2, WORDS + 1)), F.bit_count(F.get(a, F.lit(1)).bitwiseXOR(F.get(b, F.lit(1)))))
    return F.greatest(off.cast("long"), F.abs(n - m)) <= (n + m) * ((1 - LEAST) / (1 + LEAST)) + 1e-6


def _runs_of(line: str) -> set[str]:
    return {line[i : i + SHINGLE] for i in range(len(line) - SHINGLE + 1)}


def jaccard(a: str, b: str) -> float:
    """Likeness of the sets of ``SHINGLE``-character runs of two lines of at least that length."""
    return _overlap(_runs_of(a), _runs_of(b))


def _overlap(a: set[str], b: set[str]) -> float:
    common = len(a & b)
    return common / (len(a) + len(b) - common)


def _checked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs whose lines have a Jaccard similarity of at least ``LEAST``. Lines are joined, not their sets, which are larger."""

    @F.pandas_udf("double")
    def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
        out, last, held = [], None, set()
        for x, y in zip(a, b, strict=True):
            if y != last:  # rows of one line mostly stand together
                last, held = y, _runs_of(y)
            out.append(_overlap(_runs_of(x), held))
        return pd.Series(out, dtype=float)

    with scratch() as keep:
        wanted = materialise(pairs.select(F.explode(F.array("h", "rep")).alias("h")).distinct(), "line-pair-members")
        few = texts.join(small(wanted, 24), "h", "left_semi").select("h", "line")
        both = pairs.join(few, "h").withColumnRenamed("line", "line_a").join(few.select(F.col("h").alias("rep"), F.col("line").alias("line_b")), "rep")
        return keep(materialise(both.where(likeness("line_a", "line_b") >= LEAST).select("h", "rep"), "line-links"))


def _texts(docs: DataFrame, key: str, text: str, wanted: DataFrame) -> DataFrame:
    """``h``, ``line`` and ``mark`` (its parities) of the lines with a hash in ``wanted``."""

    @F.pandas_udf("array<long>")
    def mark(lines: pd.Series) -> pd.Series:
        return pd.Series([parities(x) for x in lines], dtype=object)

    texts = _long(_lines(docs, key, text)).join(small(wanted, 24), "h", "left_semi")
    texts = texts.groupBy("h").agg(F.min("line").alias("line"))
    return materialise(texts.select("h", "line", mark("line").alias("mark")), "line-texts", "zstd")


def doubles(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``id``, ``own`` and ``drop``: per key (null as the largest number) and hash of a text the places of lines that stand elsewhere."""
    with scratch() as keep:
        signed = materialise(_bands(_long(_lines(docs, key, text))), "line-signatures")
        shared = in_shared_bands(signed.select("h", F.explode("bands").alias("band")))
        release(signed)
        texts = _texts(docs, key, text, materialise(shared.select("h").distinct(), "line-wanted"))
        links = banded_links(shared, lambda pairs: _checked(pairs, texts), marks=texts.select("h", "mark"), near=_may_be_near)
        reached = keep(materialise(components(links, "h", "rep").withColumnRenamed("node", "h"), "line-roots"))
    marked = materialise(_lines(docs, key, text).drop("line"), "line-places")
    distinct = materialise(marked.groupBy("h", "g").agg(F.min(_loc()).alias("loc"), F.count("*").alias("n")), "lines")

    # the first place of each class of lines; lines that stand alone have no need of one
    linked = distinct.select("h", "g", "loc", "n").join(reached, "h", "left")
    firsts = materialise(linked.where("root is not null").groupBy("root").agg(F.min("loc").alias("first")), "line-firsts")
    classes = linked.where("n > 1 or root is not null").join(small(firsts, 48), "root", "left")
    classes = materialise(classes.select("h", "g", F.coalesce("first", "loc").alias("stays")), "line-classes")
    places = marked.select("id", "own", "pos", "h", "g").join(small(classes, 56), ["h", "g"])
    places = places.where(_loc() != F.col("stays"))
    return places.groupBy("id", "own").agg(F.collect_set("pos").alias("drop"))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the lines that stand elsewhere, with n_lines and kept_lines."""
    with scratch() as keep:
        gone = keep(materialise(doubles(docs, key, text), "line-drops"))
    size = gone.agg(F.coalesce(F.sum(F.size("drop") * 4 + 72), F.lit(0))).first()[0]
    gone = gone.withColumnRenamed("id", "_id").withColumnRenamed("own", "_own").withColumnRenamed("drop", "_drop")
    gone = F.broadcast(gone) if size <= BROADCAST_BYTES else gone
    made = ["n_lines", "kept_lines"]
    base, names = sheltered(docs)
    base = base.withColumn("_lines", F.split(names[text], "\n"))
    same = (F.coalesce(F.col(names[key]).cast("long"), F.lit(_LAST_KEY)) == F.col("_id")) & (F.xxhash64(names[text]) == F.col("_own"))
    rows = base.join(gone, same, "left")
    places = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_drop"))  # linear in both
    kept = F.when(F.col("_drop").isNull(), F.col("_lines")).otherwise(F.transform(places, lambda i: F.get(F.col("_lines"), i)))
    rows = rows.withColumn("_kept", kept)
    rows = rows.withColumns({names[text]: F.array_join("_kept", "\n"), "n_lines": F.coalesce(F.size("_lines"), F.lit(0)), "kept_lines": F.coalesce(F.size("_kept"), F.lit(0))})
    return rows.select(*[F.col(n).alias(c) for c, n in names.items() if c not in made], *made)
