"""Phrase collocations from vertical inverted lists of positions.

Texts, A-Z in lower case, are split at marks and line ends into pieces and those at spaces and tabs into words. Every language is
counted for itself. Tasks gather the words of whole texts into blocks of about ``BLOCK`` words; in a block, each word has the list of its positions. Where a
text goes on past its block, the block also holds the next words, whose positions serve extensions but are not counted.

Level by level, a phrase that is frequent over all blocks is extended by one word: the list of its occurrences, moved on, is merge-joined with the
postings of adjacent words, which are kept where they close a frequent phrase of the same length (a phrase is frequent only if its parts are). The pairs that meet are the
lists of the longer phrases, and the length of a list is the phrase's exact frequency in the block. Lengths are shuffled by ranges of hashed phrase numbers as packed arrays and added up; frequent phrases get numbers,
which go back to the blocks that hold them. Blocks stand in buckets, so it is these numbers that move and not the lists. No list of a frequent phrase is ever in one place: a block's share of it is.

Phrases are scored by their weakest cut, ones inside a longer phrase nearly as frequent are dropped, and ranks within a language come from one sort over ranges of the
whole result, so neither a language nor a word that holds most rows is one task's.

Nulls and odd rows: null texts are empty; a null language is ``und``; repeated rows count each; empty tables give no rows; keys and other
columns are not used. A task's memory is that of a block, a text and a range of about ``RANGE`` numbers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import BROADCAST_BYTES, bucketed, materialise, numbered, release, scratch, shuffle_partitions, small, totals_before, whole_text

LONGEST = 4
LEAST_COUNT = 30
TOP = 2_000
#: A phrase goes if one that holds it has at least this share of its count, in hundredths.
INSIDE_PERCENT = 80
SCALE = 2_000_000
BLOCK = 1 << 19
RANGE = 1 << 20

#: Ends of pieces become a byte that no UTF-8 text holds, tabs become spaces, A-Z become a-z.
_END = b"\xff"
_FOLD = bytes(b + 32 if 65 <= b <= 90 else 255 if chr(b) in ".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))


class _Words(dict):
    """Numbers of a language's words; ``keys`` holds language and word of each number, over all languages of a task's block."""

    def __init__(self, lang: bytes, keys: list[bytes]) -> None:
        super().__init__()
        self.lead, self.keys = lang + b"\0", keys
        self[_END] = -1

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.keys)
        self.keys.append(self.lead + word)
        return number


def _lists(numbers: np.ndarray, own: int, keys: list[bytes]) -> tuple:
    """The lists of a block: keys, counted lengths, lengths and positions; ``numbers`` below 0 are ends of pieces."""
    at = np.flatnonzero(numbers >= 0)
    used, which = np.unique(numbers[at], return_inverse=True)
    order = np.argsort(which, kind="stable")
    lengths = np.bincount(which, minlength=len(used))
    counted = np.bincount(which[at < own], minlength=len(used))
    return [keys[i] for i in used.tolist()], counted, lengths, at[order]


def _blocks(docs: DataFrame, lang: str, text: str, longest: int, block: int) -> DataFrame:
    """One row a block: ``block``, ``own`` (positions from here on are not counted), ``keys``, ``counts``, ``lens`` and ``pos``."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = number = TaskContext.get().partitionId() << 32
        keys: list[bytes] = []
        words: dict[bytes, _Words] = {}
        held: list[np.ndarray] = []
        size = 0

        def rows() -> Iterator[pa.RecordBatch]:
            nonlocal number
            every = np.concatenate(held)
            for at in range(0, len(every), block):
                part = every[at : at + block + longest - 1]
                names, counted, lengths, pos = _lists(part, min(block, len(every) - at), keys)
                values = ([number], [min(block, len(every) - at)], [names], [counted.astype(np.int32)], [lengths.astype("<i4").tobytes()], [_places(pos)])
                kinds = (pa.int64(), pa.int32(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], ["block", "own", "keys", "counts", "lens", "pos"])
                number += 1

        for batch in batches:
            for language, data in zip(batch["lang"].to_pylist(), batch["t"], strict=True):
                own = words.get(language)
                if own is None:
                    own = words[language] = _Words(language, keys)
                found = (data.as_py().translate(_FOLD) + _END).replace(_END, b" \xff ").split(b" ")
                found = np.fromiter(map(own.__getitem__, filter(None, found)), np.int32)
                held.append(found)
                size += len(found)
                if size >= block:
                    yield from rows()
                    keys, words, held, size = [], {}, [], 0
        if held:
            yield from rows()
        assert number - first < 1 << 32

    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).cast("binary").alias("lang"), whole_text(text).cast("binary").alias("t"))
    return rows.mapInArrow(gather, "block long, own int, keys array<binary>, counts array<int>, lens binary, pos binary")


_LEVEL = "block long, own int, ids binary, last binary, lens binary, pos binary"
_LEVEL_KINDS = pa.schema([("block", pa.int64()), ("own", pa.int32()), ("ids", pa.binary()), ("last", pa.binary()), ("lens", pa.binary()), ("pos", pa.binary())])


def _ints(data: bytes | None, kind: str) -> np.ndarray:
    return np.frombuffer(data or b"", kind)


def _rising(values: np.ndarray) -> bytes:
    """Rising numbers for a shuffle: their steps, the bytes of each place together, which compresses well."""
    return np.diff(values.astype("<i8"), prepend=0).view(np.uint8).reshape(-1, 8).T.tobytes()


def _risen(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<i8").ravel())


def _multiplier(modulus: int) -> int:
    """A number without a common divisor with the modulus, as near to .618 of it as products with numbers below it stay within 63 bits."""
    a = max(1, min((2**63 - 1) // modulus, int(0.618 * modulus)))
    while math.gcd(a, modulus) != 1:
        a -= 1
    return a


def _dealt(keys: np.ndarray, ranges: int, modulus: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ranges that get some of the keys, the order of keys by range, where each range's begin, and the rising numbers that stand for the keys in that order.

    A key times a fixed number, modulo ``modulus`` (above all keys), is a number of its own; ranges are even cuts of these, so a word with many followers is spread and steps within a range stay small.
    """
    mixed = keys * np.int64(_multiplier(modulus)) % np.int64(modulus)
    order = np.argsort(mixed)
    mixed = mixed[order]
    to = np.minimum(ranges - 1, (mixed / modulus * ranges).astype(np.int64))
    heads = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])) if len(to) else np.zeros(0, np.int64)
    return to[heads], order, np.append(heads, len(to)), mixed


def _places(pos: np.ndarray) -> bytes:
    """Positions of lists one after the other: steps of 32 bits, the bytes of each place together."""
    return np.diff(pos.astype("<i4"), prepend=np.int32(0)).view(np.uint8).reshape(-1, 4).T.tobytes()


def _positions(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<i4").ravel(), dtype=np.int32)


def _level_row(block: int, own: int, ids: np.ndarray, last: np.ndarray, lens: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
    packed = [ids.astype("<i8").tobytes(), last.astype("<i8").tobytes(), lens.astype("<i4").tobytes(), _places(pos)]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip([block, own, *packed], _LEVEL_KINDS.types, strict=True)], schema=_LEVEL_KINDS)


def _sized(table: DataFrame, total_bytes: int) -> DataFrame:
    """``table`` marked for broadcast if its counted bytes allow it."""
    return F.broadcast(table) if total_bytes <= BROADCAST_BYTES else table


def _word_level(blocks: DataFrame, found: DataFrame) -> DataFrame:
    """The lists of frequent words alone. ``found``: block, places of their keys in the block (``at``), their numbers (``ids``)."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                at, ids = batch["at"][i].values.to_numpy(), batch["ids"][i].values.to_numpy()
                order = np.argsort(at)
                lens = _ints(batch["lens"][i].as_py(), "<i4")
                kept = np.zeros(len(lens), bool)
                kept[at] = True
                pos = _positions(batch["pos"][i].as_py())[np.repeat(kept, lens)]
                yield _level_row(batch["block"][i].as_py(), batch["own"][i].as_py(), ids[order], ids[order], lens[kept], pos)

    rows = blocks.select("block", "own", "lens", "pos").join(found.hint("shuffle_hash"), "block")
    return rows.mapInArrow(keep, _LEVEL)


def extend(ids: np.ndarray, last: np.ndarray, lens: np.ndarray, pos: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge-joins the lists of phrases with adjacent postings: keys of the longer phrases (phrase number times ``base`` plus word number), rising, their lists' lengths, and positions."""
    which = np.repeat(np.arange(len(lens)), lens)
    order = np.argsort(pos)
    pos, which = pos[order], which[order]
    meet = np.flatnonzero(pos[1:] == pos[:-1] + 1)
    keys = ids[which[meet]] * base + last[which[meet + 1]]
    order = np.argsort(keys, kind="stable")
    keys, pos = keys[order], pos[meet][order]
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[heads], np.diff(np.append(heads, len(keys))), pos


def _count(level: DataFrame, base: int, ranges: int, modulus: int, least: int) -> DataFrame:
    """Frequent extensions by range: rows with ``block`` hold which of the keys it dealt are frequent (``keys``: their places, ``nums``: their numbers in the range), the row without has all and their counts."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch[c][i].as_py() for c in batch.schema.names}
                keys, lens, pos = extend(_ints(row["ids"], "<i8"), _ints(row["last"], "<i8"), _ints(row["lens"], "<i4"), _positions(row["pos"]), base)
                if not len(keys):
                    continue
                counts = np.add.reduceat(pos < row["own"], np.cumsum(lens) - lens, dtype=np.int32)
                to, order, edges, keys = _dealt(keys, ranges, modulus)
                counts = counts[order]
                cuts = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
                packed = [_rising(keys[a:b]) for a, b in cuts], [counts[a:b].astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes() for a, b in cuts]
                yield pa.RecordBatch.from_pydict({"range": to, "block": np.full(len(to), row["block"]), "keys": pa.array(packed[0], pa.binary()), "counts": pa.array(packed[1], pa.binary())})

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        parts = [_risen(k) for k in frame["keys"]]
        keys = np.concatenate(parts)
        counts = np.concatenate([np.ascontiguousarray(np.frombuffer(c, np.uint8).reshape(4, -1).T).view("<i4").ravel() for c in frame["counts"]])
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sums = np.add.reduceat(counts, heads, dtype=np.int64)
        often = keys[heads][sums >= least]
        if not len(often):
            return pd.DataFrame({"range": [], "block": [], "keys": [], "nums": []})
        plain = np.array(often.astype(object) * pow(_multiplier(modulus), -1, modulus) % modulus, "<i8")
        out = [(None, plain.tobytes(), sums[sums >= least].astype("<i8").tobytes())]
        for block, part in zip(frame["block"].tolist(), parts, strict=True):
            at = np.minimum(np.searchsorted(often, part), len(often) - 1)
            mine = often[at] == part
            if mine.any():
                out.append((block, _rising(np.flatnonzero(mine)), _rising(at[mine])))
        rows = pd.DataFrame(out, columns=["block", "keys", "nums"])
        return rows.assign(block=rows["block"].astype("Int64"), range=int(frame["range"].iloc[0]))[["range", "block", "keys", "nums"]]

    dealt = level.mapInArrow(deal, "range long, block long, keys binary, counts binary")
    return dealt.groupBy("range").applyInPandas(add, "range long, block long, keys binary, nums binary")


def _entries(found: DataFrame, base: int) -> DataFrame:
    """The frequent phrases of ``_count``: ``id``, ``parent``, ``word`` and ``f``. ``found`` has the number its range begins with in ``first``."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, keys, counts in zip(*(batch[c].to_pylist() for c in ("first", "keys", "nums")), strict=True):
                keys = _ints(keys, "<i8")
                yield pa.RecordBatch.from_pydict({"id": first + np.arange(len(keys)), "parent": keys // base, "word": keys % base, "f": _ints(counts, "<i8")})

    return found.where("block is null").select("first", "keys", "nums").mapInArrow(unpack, "id long, parent long, word long, f long")


def _next_level(level: DataFrame, found: DataFrame, base: int, ranges: int, modulus: int) -> DataFrame:
    """The lists of the frequent extensions, under their numbers."""
    own = found.where("block is not null").select("block", F.struct("range", "first", "keys", "nums").alias("part"))
    own = own.groupBy("block").agg(F.collect_list("part").alias("parts"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch[c][i].as_py() for c in batch.schema.names}
                keys, lens, pos = extend(_ints(row["ids"], "<i8"), _ints(row["last"], "<i8"), _ints(row["lens"], "<i4"), _positions(row["pos"]), base)
                to, order, edges, _ = _dealt(keys, ranges, modulus)
                begins = dict(zip(to.tolist(), edges.tolist(), strict=False))
                at = np.concatenate([order[begins[p["range"]] + _risen(p["keys"])] for p in row["parts"]])
                ids = np.full(len(keys), -1, np.int64)
                ids[at] = np.concatenate([_risen(p["nums"]) + p["first"] for p in row["parts"]])
                kept = ids >= 0
                yield _level_row(row["block"], row["own"], ids[kept], keys[kept] % base, lens[kept], pos[np.repeat(kept, lens)])

    return level.join(own.hint("shuffle_hash"), "block").mapInArrow(keep, _LEVEL)


def frequent_phrases(docs: DataFrame, lang: str = "lang", text: str = "text", longest: int = LONGEST, least: int = LEAST_COUNT, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """All phrases of 1 to ``longest`` words with a count of ``least`` or more (``lang``, ``phrase``, ``k`` words, ``f``), and each language's count of words (``lang``, ``n``)."""
    blocks = bucketed(_blocks(docs, lang, text, longest, block), "phrase-blocks", "block")
    each = blocks.select("block", F.posexplode(F.arrays_zip("keys", "counts")).alias("at", "e")).select("block", "at", F.col("e.keys").alias("key"), F.col("e.counts").alias("c"))
    totals = materialise(each.groupBy("key").agg(F.sum("c").alias("f")), "phrase-words")
    language = F.substring_index(F.col("key").cast("string"), "\0", 1)
    n = materialise(totals.groupBy(language.alias("lang")).agg(F.sum("f").alias("n")).where("n > 0"), "phrase-totals")
    words = materialise(numbered(totals.where(F.col("f") >= least), "id", "phrase-frequent"), "phrase-numbers")
    size = words.agg(F.count("*"), F.sum(F.octet_length("key") + 32)).first()
    base = size[0] + 1
    found = each.where("c >= 0").join(_sized(words.select("key", "id"), size[1] or 0), "key").groupBy("block").agg(F.collect_list("at").alias("at"), F.collect_list("id").alias("ids"))
    level = bucketed(_word_level(blocks, found), "phrase-level-1", "block")
    release(blocks, totals)
    plain = F.col("key").cast("string")
    known = words.select("id", language.alias("lang"), plain.substr(F.length(language) + 2, F.length(plain)).alias("phrase"), F.lit(1).alias("k"), "f")
    known = materialise(known, "phrases-1")
    phrases, spelled = known, small(known.select(F.col("id").alias("word"), F.col("phrase").alias("_word")), 64)
    for k in range(2, longest + 1):
        occurrences = level.agg(F.sum(F.octet_length("pos") / 4)).first()[0] or 0
        ranges = max(shuffle_partitions(docs.sparkSession), int(occurrences) // RANGE + 1)
        modulus = base * (max(base, phrases.count()) + 1)
        if modulus >= 1 << 62:
            raise ValueError("phrase numbers times word numbers pass 62 bits; raise the least count")
        counted = materialise(_count(level, base, ranges, modulus, least), f"phrase-counts-{k}")
        firsts = materialise(counted.where("block is null").select("range", (F.octet_length("keys") / 8).cast("long").alias("_n")), f"phrase-ranges-{k}")
        if firsts.isEmpty():
            break
        firsts = materialise(totals_before(firsts, "range", "_n", "first").drop("_n"), f"phrase-firsts-{k}")
        found = counted.join(small(firsts, 16), "range")
        entries = materialise(_entries(found, base), f"phrase-entries-{k}")
        shorter = known.select(F.col("id").alias("parent"), "lang", F.col("phrase").alias("_lead"))
        known = entries.join(small(shorter, 96), "parent").join(spelled, "word")
        known = materialise(known.select("id", "lang", F.concat_ws(" ", "_lead", "_word").alias("phrase"), F.lit(k).alias("k"), "f"), f"phrases-{k}")
        phrases = phrases.unionByName(known)
        if k < longest:
            after = bucketed(_next_level(level, found, base, ranges, modulus), f"phrase-level-{k}", "block")
            release(level)
            level = after
        release(counted)
    return phrases.drop("id"), n


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", longest: int = LONGEST, least: int = LEAST_COUNT, top: int = TOP, inside: int = INSIDE_PERCENT, block: int = BLOCK) -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A cut after the first words scores ``floor(SCALE * a / (l + r))`` in exact decimals; the lowest cut counts, ties go to the shortest first part.
    """
    with scratch() as keep:
        return keep(materialise(_scored(*frequent_phrases(docs, lang, text, longest, least, block), longest, top, inside), "phrases-best"))


def _scored(phrases: DataFrame, n: DataFrame, longest: int, top: int, inside: int) -> DataFrame:
    w = F.split("phrase", " ")
    longer = phrases.where("k >= 2").select("lang", "phrase", "k", F.col("f").alias("a"), w.alias("w"))
    part = lambda start, size: F.array_join(F.slice("w", start, size), " ")
    cuts = longer.withColumn("j", F.explode(F.sequence(F.lit(1), F.col("k") - 1))).select("lang", "phrase", "a", "j", part(F.lit(1), F.col("j")).alias("first"), part(F.col("j") + 1, F.col("k") - F.col("j")).alias("rest"))
    parts = materialise(phrases.where(F.col("k") < longest).select("lang", "phrase", "f"), "phrase-parts")
    l, r = (small(parts.select("lang", F.col("phrase").alias(c), F.col("f").alias(x)), 96) for c, x in (("first", "l"), ("rest", "r")))  # noqa: E741
    cuts = cuts.join(l, ["lang", "first"]).join(r, ["lang", "rest"])
    # decimals of 38 digits hold every product here exactly
    score = F.expr(f"(cast(a as decimal(20,0)) * cast({SCALE} as decimal(10,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    weakest = cuts.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "j", "l", "r", "a")).alias("m")).select("lang", "phrase", "m.a", "m.l", "m.r", "m.score")
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("k") - m + 1), lambda i: F.array_join(F.slice("w", i, m), " "))))
    held = longer.where("k >= 3").select("lang", F.explode(spans).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("_more"))
    kept = weakest.join(held, ["lang", "phrase"], "left").where(F.coalesce(F.col("_more") * 100 < F.col("a") * inside, F.lit(True)))
    best = (F.col("lang"), F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    ranked = numbered(kept.drop("_more").repartitionByRange(*best).sortWithinPartitions(*best), "rank", "phrase-ranks")
    firsts = materialise(ranked.groupBy("lang").agg(F.min("rank").alias("_first")).join(n, "lang"), "phrase-langs")
    out = ranked.join(small(firsts, 64), "lang").withColumn("rank", F.col("rank") - F.col("_first") + 1)
    return out.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
