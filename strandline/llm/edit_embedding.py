"""Document fingerprints by randomised edit embedding.

A text is walked through with random bits that all texts share: at output place ``j`` the current
character is written, and the walk moves on to the next character where the bit for ``j`` and that
character is 1. Texts a few edits apart soon walk in step again, so the edit distance turns into
the Hamming distance of the outputs. Random bits repeat every ``PERIOD`` places.

A fingerprint samples the output. Places are drawn for ranges of doubling size (``SAMPLES`` a range),
so texts of any length share the places of their common ranges; a text has the ranges its output
reaches. A sample is a 4-bit hash of the character there, ``-`` past the end. The likeness of two
fingerprints is the share of output places that agree, each range weighed by its size.

``near_duplicates`` draws bands of samples, checks texts that share a band by the likeness of their whole fingerprints, and gives
classes: each against the least one of the band, then, in bands left with more than one class, against all of the other classes
there (see ``banded_links``). Bits of the samples tell pairs under the bound without their fingerprints and lose none above it
(``_may_be_near``). ``embed_and_link`` gives both results for one table and walks through each text once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import input_bytes, materialise, ordered_buckets, release, scratch, shuffle_partitions, small, whole_text
from strandline.llm.components import banded_links, components, in_shared_bands

PERIOD = 1024
SAMPLES = 64
RANGES = 40
BUCKET_BYTES = 16 * 1024 * 1024
SEED = 1729
#: Bands of sampled places in each of a fingerprint's last two full ranges, and places a band.
BANDS = 18
TAPS = 8
#: Last ranges by which marks are compared first, and longs a range (each one bit of every sample's digit).
MARKED = 5
PLANES = 4


def _walk_tables() -> list[list[int]]:
    """For each of 256 classes of characters and each place: the place after the next move."""
    bits = np.random.default_rng(SEED).random((256, PERIOD)) < 0.5
    bits[:, ::64] = True  # no walk stands still for long
    place = np.where(np.concatenate([bits, bits], axis=1), np.arange(2 * PERIOD), 4 * PERIOD)
    nxt = np.minimum.accumulate(place[:, ::-1], axis=1)[:, ::-1][:, :PERIOD]
    return ((nxt + 1) % PERIOD).tolist()


def _places() -> np.ndarray:
    """Sampled output places, a row per range: [0, 64), [64, 128), [128, 256), ..."""
    draw, rows = np.random.default_rng(SEED + 1), [np.arange(SAMPLES)]
    for r in range(1, RANGES):
        low = SAMPLES << (r - 1)
        rows.append(np.sort(draw.integers(low, 2 * low, SAMPLES)) if low > SAMPLES else np.arange(low, 2 * low))
    return np.array(rows)


_TABLES = _walk_tables()
_PLACES = _places()
_DIGITS = np.frombuffer(b"0123456789abcdef", np.uint8)
_PAST = ord("-")
_VALUE = np.array([int(chr(i), 16) if chr(i) in "0123456789abcdef" else 0 for i in range(256)], np.uint8)


class Walk:
    """A text's walk; ``with_tail`` gives the walk of a text that shares the beginning."""

    def __init__(self, text: str, start: Walk | None = None, keep: int = 0) -> None:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        classes = ((points * np.uint64(2654435761) >> np.uint64(13)) & np.uint64(255)).astype(np.uint8)
        state = int(start.states[keep - 1]) if keep else 0
        tables = _TABLES
        states = np.array([state := tables[c][state] for c in classes.tobytes()], np.int64)
        if keep:
            classes, states = np.concatenate([start.classes[:keep], classes]), np.concatenate([start.states[:keep], states])
        self.classes, self.states = classes, states

    def with_tail(self, keep: int, tail: str) -> Walk:
        return Walk(tail, self, keep)

    def fingerprint(self) -> str:
        if not len(self.states):
            return ""
        steps = (np.diff(self.states, prepend=0) - 1) % PERIOD + 1
        ends = np.cumsum(steps)
        ranges = 1 if ends[-1] <= SAMPLES else int(np.ceil(np.log2(ends[-1] / SAMPLES))) + 1
        places = _PLACES[:ranges].ravel()
        at = np.searchsorted(ends, places, side="right")
        digits = _DIGITS[self.classes[np.minimum(at, len(ends) - 1)] >> 4]
        return np.where(at < len(ends), digits, _PAST).astype(np.uint8).tobytes().decode()


def fingerprint(text: str) -> str:
    return Walk(text).fingerprint()


def likeness(a: str, b: str) -> float:
    """0 to 1; two empty fingerprints are alike, an empty one and another are not."""
    n = max(len(a), len(b))
    if not n:
        return 1.0
    x = np.frombuffer(a.ljust(n, "-").encode(), np.uint8)
    y = np.frombuffer(b.ljust(n, "-").encode(), np.uint8)
    weight = np.repeat(2.0 ** np.maximum(0, np.arange(n // SAMPLES) - 1), SAMPLES)
    there = weight * ((x != _PAST) | (y != _PAST))
    return float((there * (x == y)).sum() / there.sum())


def embed_neighbours(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: ``own`` (a hash of its text), n_chars, its fingerprint, the edited text's, and likeness to that and to the next one's.

    The next document is the one with the next lower key, after the last the first; the edited text
    has the last third of the code points replaced by as many from the start of the next one.

    Texts move once, compressed: rows go to buckets that rise with the key, and the row with the largest key of
    a bucket is also sent to the next bucket (the largest of all to the first) to be looked at there.
    Null texts are empty, null keys come before all others, rows with one key are in the order of a hash of
    their texts; an empty table gives an empty result, and a single row is its own next one.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("k"), whole_text(text).alias("t")).withColumn("own", F.xxhash64("t"))
    parts = max(shuffle_partitions(spark), -(-input_bytes(docs, text) // BUCKET_BYTES))
    # rows without a key, of which there may be any number, are cut by the hash of their texts into as many buckets before all others
    null_bucket = F.floor((F.col("own") / 2.0**64 + 0.5) * (4 * parts - 1)).cast("int") - 4 * parts
    rows = rows.withColumn("bucket", F.when(F.col("k").isNull(), null_bucket).otherwise(ordered_buckets(rows, "k", 4 * parts)))
    # the next bucket that has rows; of the rows, one short one a bucket goes through this window
    order = Window.orderBy("bucket")
    following = F.coalesce(F.lead("bucket").over(order), F.first("bucket").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    marks = materialise(rows.groupBy("bucket").agg(F.max(F.struct("k", "own")).alias("top")).withColumn("following", following), "buckets")
    rows = rows.join(small(marks, 48), "bucket")

    @F.pandas_udf("binary")
    def packed(texts: pd.Series) -> pd.Series:
        return pd.Series([zstandard.compress(t.encode("utf-8", "surrogatepass"), 1) for t in texts], dtype=object)

    rows = rows.withColumn("t", packed("t"))
    own = F.struct(F.col("bucket").alias("to"), F.lit(False).alias("seen"))
    again = F.struct(F.col("following").alias("to"), F.lit(True).alias("seen"))
    at_top = F.col("k").eqNullSafe(F.col("top.k")) & (F.col("own") == F.col("top.own"))
    rows = rows.select("k", "own", "t", F.explode(F.when(at_top, F.array(own, again)).otherwise(F.array(own))).alias("at"))
    rows = rows.select(F.col("at.to").alias("bucket"), F.col("at.seen").alias("seen"), "k", "own", "t")
    rows = rows.repartition(parts, "bucket").sortWithinPartitions("bucket", F.col("seen").desc(), F.col("k").asc_nulls_first(), "own", "t")
    rows = rows.select("bucket", "seen", F.col("k").cast("string").alias("k"), "own", "t")

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        before = None  # text and fingerprint of the row before: the next one in descending order
        for frame in frames:
            out = []
            for seen, k, hashed, t in zip(frame["seen"], frame["k"], frame["own"], frame["t"], strict=True):
                t = zstandard.decompress(t).decode("utf-8", "surrogatepass")
                own = Walk(t)
                mark = own.fingerprint()
                if not seen:
                    n = len(t)
                    cut = n // 3
                    tail = before[0][:cut]
                    edited = own.with_tail(n - cut, tail).fingerprint()
                    sha = hashlib.sha256((t[: n - cut] + tail).encode()).hexdigest()
                    out.append((k, hashed, n, sha, mark, edited, likeness(mark, edited), likeness(mark, before[1])))
                before = (t, mark)
            yield pd.DataFrame(out, columns=["k", "own", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    made = rows.mapInPandas(walk, "k string, own long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return made.withColumn("k", F.col("k").cast("long")).withColumnRenamed("k", key)


_SAMPLED = np.array([np.random.default_rng([SEED + 2, i]).choice(SAMPLES, TAPS, replace=False) for i in range(BANDS)])
_CODE = np.array([16 if i == _PAST else v for i, v in enumerate(_VALUE.tolist())], np.uint64)


def bands(fps: list[str]) -> np.ndarray:
    """A row of bands for each fingerprint: the samples at ``TAPS`` places of its last two full ranges, with the numbers of the draw and the range.

    The very last range may hold a few characters alone, so that all texts that end there would look alike.
    """
    spans = np.maximum(np.array([max(2, len(f) // SAMPLES) - 2 for f in fps], np.int64)[:, None] - np.arange(2), 0)
    parts = "".join([f[s * SAMPLES : (s + 1) * SAMPLES].ljust(SAMPLES, "-") for f, row in zip(fps, spans.tolist(), strict=True) for s in row])
    codes = _CODE[np.frombuffer(parts.encode(), np.uint8)].reshape(len(fps), 2, SAMPLES)
    out = (np.arange(BANDS, dtype=np.uint64) * np.uint64(64)) + spans.astype(np.uint64)[:, :, None]
    for t in range(TAPS):
        out = out << np.uint64(5) | codes[:, :, _SAMPLED[:, t]]
    return out.reshape(len(fps), 2 * BANDS).astype(np.int64)


def mark(fp: str) -> list[int]:
    """Ranges of a fingerprint, samples there in the last one, then ``PLANES`` longs for each range (of ``MARKED`` at least), the last one first."""
    ranges = len(fp) // SAMPLES
    digits = _VALUE[np.frombuffer(fp.encode(), np.uint8)].reshape(ranges, SAMPLES)[::-1]
    digits = np.concatenate([digits, np.zeros((max(0, MARKED - ranges), SAMPLES), np.uint8)])
    planes = np.packbits(np.stack([digits >> p & 1 for p in range(PLANES)], axis=1), axis=-1).view(">i8")
    return [ranges, len(fp[-SAMPLES:].rstrip("-")), *planes.ravel().tolist()]


def _may_be_near(a: str, b: str, least: float) -> Column:
    """Whether fingerprints with marks ``a`` and ``b`` can have a likeness of ``least``.

    Of two or more ranges the last weighs as much as all before it, so with k samples there the weights come to (k + SAMPLES) times its own. Samples whose bits differ differ. Where one
    fingerprint has a range more than the other, all its k samples there differ; two more ranges are more than half of the weight.
    What passes by the last ``MARKED`` ranges is compared by all ranges, so that hardly a pair under the bound is left.
    """
    at = lambda x, i: F.get(x, F.lit(i))
    off = F.lit(0)
    for r in range(MARKED):
        bits = None
        for p in range(2 + r * PLANES, 2 + (r + 1) * PLANES):
            other = at(a, p).bitwiseXOR(at(b, p))
            bits = other if bits is None else bits.bitwiseOR(other)
        off += F.bit_count(bits) * 2 ** (MARKED - 1 - r)
    n, m, k, j = at(a, 0), at(b, 0), at(a, 1), at(b, 1)
    whole = lambda k: (k + F.when(F.greatest(n, m) > 1, SAMPLES).otherwise(0)) * (1 - least) + 1e-6
    longer = F.when(n > m, k).otherwise(j)
    more = F.when(F.least(n, m) == 0, F.lit(False)).otherwise((F.abs(n - m) == 1) & (longer <= whole(longer)))
    first = F.when(n == m, off <= whole(F.greatest(k, j)) * 2 ** (MARKED - 1)).otherwise(more if least > 0.5 else F.lit(True))

    def all_off() -> Column:
        """Samples that differ over all ranges, in the weight of the last one; ranges are told by their distance from the longer one's last."""
        most, back = F.greatest(n, m), F.abs(n - m)

        def step(total: Column, r: Column) -> Column:
            bits = None
            for p in range(PLANES):
                x, y = (F.get(v, F.lit(2 + p) + PLANES * (r - (most - size)).cast("int")) for v, size in ((a, n), (b, m)))
                bits = x.bitwiseXOR(y) if bits is None else bits.bitwiseOR(x.bitwiseXOR(y))
            return total + F.bit_count(bits) * F.pow(F.lit(0.5), F.greatest(F.lit(0), F.least(r, most - 2)))

        return F.aggregate(F.sequence(back, most - 1), F.when(n == m, F.lit(0.0)).otherwise(longer.cast("double")), step)

    return first & (F.when((F.least(n, m) == 0) | (F.abs(n - m) > 1), F.lit(True)).otherwise(all_off() <= whole(F.when(n == m, F.greatest(k, j)).otherwise(longer))))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = 0.8) -> DataFrame:
    """``key``, ``own`` (a hash of the text) and ``component_id``, the least key reached by links of likeness ``least`` or more; each key and text once.

    Fingerprints are taken where the texts stand; only equal ones are counted together, so exact copies cost no more. Bands of
    ``TAPS`` places come from the last two full ranges, of which texts of like length share one. At a likeness of 0.8 a pair shares a band of one range in
    1 - (1 - 0.8**8)**18 = 96 % of cases, of both in 99.8 %; strangers, whose samples are alike in a fifth of places, seldom do; see the tests for the recall measured. Null texts are empty; null keys have the class of their group, null where no
    member has a key; an empty table gives an empty result.
    """

    @F.pandas_udf("string")
    def walked(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t) for t in texts], dtype=object)

    rows = docs.select(F.col(key).cast("long").alias("k"), F.xxhash64(whole_text(text)).alias("own"), walked(whole_text(text)).alias("fp"))
    return _classes(materialise(rows, "edit-marks", "zstd"), least).withColumnRenamed("k", key)


def _classes(marked: DataFrame, least: float) -> DataFrame:
    """``k``, ``own`` and ``component_id`` of written rows ``k``, ``own`` and ``fp``."""

    @F.pandas_udf("double")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([likeness(x, y) for x, y in zip(a, b, strict=True)], dtype=float)

    @F.pandas_udf("array<long>")
    def marks(fps: pd.Series) -> pd.Series:
        return pd.Series([mark(f) for f in fps], dtype=object)

    @F.pandas_udf("array<long>")
    def banded(fps: pd.Series) -> pd.Series:
        return pd.Series(list(bands(fps.tolist())), dtype=object)

    marked = marked.withColumn("h", F.xxhash64("fp"))

    def near(a: str, b: str) -> Column:
        return _may_be_near(a, b, least)

    with scratch() as keep:
        signed = materialise(marked.select("h", banded("fp").alias("bands")), "edit-bands", "zstd")
        shared = in_shared_bands(signed.select("h", F.explode("bands").alias("band")))
        release(signed)
        wanted = materialise(shared.select("h").distinct(), "edit-wanted")
        fps = marked.join(small(wanted, 24), "h", "left_semi").groupBy("h").agg(F.min("fp").alias("fp"))
        fps = materialise(fps.select("h", "fp", marks("fp").alias("mark")), "edit-fingerprints", "zstd")

        def check(pairs: DataFrame) -> DataFrame:
            with scratch() as hold:
                wanted = materialise(pairs.select(F.explode(F.array("h", "rep")).alias("h")).distinct(), "edit-pair-members")
                few = fps.join(small(wanted, 24), "h", "left_semi").select("h", "fp")
                both = pairs.join(few, "h").withColumnRenamed("fp", "fp_a").join(few.select(F.col("h").alias("rep"), F.col("fp").alias("fp_b")), "rep")
                return hold(materialise(both.where(alike("fp_a", "fp_b") >= least).select("h", "rep"), "edit-links"))

        links = banded_links(shared, check, marks=fps.select("h", "mark"), near=near)
        reached = keep(materialise(components(links, "h", "rep"), "edit-components")).withColumnRenamed("node", "h")
    keyed = marked.groupBy("k", "own", "h").agg(F.lit(1).alias("_")).drop("_")
    rooted = keyed.join(small(reached, 32), "h", "left").select("k", "own", F.coalesce("root", "h").alias("root"))
    rooted = materialise(rooted, "edit-rooted")
    ids = materialise(rooted.groupBy("root").agg(F.min("k").alias("component_id")), "edit-classes")
    return rooted.join(small(ids, 32), "root").select("k", "own", "component_id")


def embed_and_link(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The columns of ``embed_neighbours`` without ``own``, and ``component_id`` of ``near_duplicates``, one row per row of ``docs``."""
    with scratch() as keep:
        rows = keep(materialise(embed_neighbours(docs, key, text), "edit-neighbours", "zstd"))
        classes = keep(materialise(_classes(rows.select(F.col(key).alias("k"), "own", F.col("fingerprint").alias("fp")), 0.8), "edit-ids"))
    classes = classes.select(F.col("k").alias("_k"), F.col("own").alias("_own"), "component_id")
    same = F.col(key).eqNullSafe(F.col("_k")) & (F.col("own") == F.col("_own"))
    return rows.join(small(classes, 48), same, "left").drop("_k", "_own", "own")
