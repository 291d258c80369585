"""Best-fit packing of documents into training sequences of several permitted lengths.

Documents are cut into pieces of at most the longest length, counted in words and one end token. Pieces are dealt to
groups of about ``GROUP`` by a hash, and each group is packed on its own, largest first: a piece goes into the
open bin it leaves the least room in; if none has room, a bin is opened. Which lengths may be opened is chosen for all
pieces of a group at once: every set of lengths that holds the longest needed is tried on the sizes at hand, and the one whose
sequences cost least in the end stays (a sequence costs a fixed part, its length, and a part that grows with the square of its
length). Among the lengths of a set, a bin is opened at the one whose tokens cost least when full. In the end
each bin gets the shortest permitted length that holds its contents.

A piece's group follows from its key, a hash of its text, its number and, among rows that are all alike, a count, so reruns and
other partitionings of the input give the same sequences, and rows that repeat are spread over all groups. Groups are
equal in size by construction, so no task grows with the data.

A sequence's text is its pieces one after the other, each closed by ``END``, a character that ``escaped`` takes out of texts; ``bodies`` cuts a sequence's
text and gives the pieces back as they were, whatever they hold. A document that fits is a piece as it stands; the
pieces of a longer one are its words with one space between. So every word stands in exactly one sequence (times the copies of its document).
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import WORD, materialise, small, whole_text, word_count

LENGTHS = (256, 512, 1024, 2048, 4096)
#: Cost of a sequence besides its length, and the length at which attention costs as much as the rest.
FIXED_COST = 64
EVEN_LENGTH = 16_384
GROUP = 4_000
#: Closes every piece in a sequence's text; where a text holds it or ``MARK``, these are written as ``MARK`` and a letter.
END, MARK = "\0", "\1"
#: Rows that are all alike are counted out in runs of so many.
RUN = 10_000


def cost(length: int | np.ndarray) -> float | np.ndarray:
    """What a sequence of this length costs."""
    return FIXED_COST + length + length * length / EVEN_LENGTH


def escaped(body: str) -> str:
    return body.replace(MARK, MARK + "b").replace(END, MARK + "a")


def bodies(text: str) -> list[str]:
    """The pieces of a sequence's text."""
    return [b.replace(MARK + "a", END).replace(MARK + "b", MARK) for b in text.split(END)[:-1]]


def _fit(sizes: list[int], opened: tuple[int, ...]) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each size (largest first), and what each bin holds, when only lengths ``opened`` are opened."""
    cheapest = {}
    for i, length in enumerate(opened):
        best = min(opened[i:], key=lambda n: cost(n) / n)
        cheapest |= dict.fromkeys(range((opened[i - 1] if i else 0) + 1, length + 1), best)
    open_bins: list[list[int]] = [[] for _ in range(opened[-1] + 1)]
    rooms = 0  # bit r is set if a bin has room r
    used: list[int] = []
    bins, offsets = [], []
    for size in sizes:
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            at = open_bins[room].pop()
            if not open_bins[room]:
                rooms &= ~(1 << room)
        else:
            at, room = len(used), cheapest[size]
            used.append(0)
        bins.append(at)
        offsets.append(used[at])
        used[at] += size
        left = room - size
        if left:
            open_bins[left].append(at)
            rooms |= 1 << left
    return bins, offsets, used


def best_fit(sizes: np.ndarray, lengths: tuple[int, ...] = LENGTHS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, offset in it and the bin's final length for each size (1 to the longest length); see the module for the choice of lengths."""
    if not len(sizes):
        return (np.zeros(0, np.int64),) * 3
    order = np.argsort(-sizes, kind="stable")
    falling = sizes[order].tolist()
    needed = min(n for n in lengths if n >= falling[0])
    others = [n for n in lengths if n != needed]
    best = None
    for count in range(len(others) + 1):
        for some in combinations(others, count):
            bins, offsets, used = _fit(falling, tuple(sorted((*some, needed))))
            final = np.array(lengths)[np.searchsorted(lengths, used)]
            total = float(cost(final).sum())
            if best is None or total < best[0]:
                best = (total, bins, offsets, final)
    _, bins, offsets, final = best
    out = np.zeros((3, len(sizes)), np.int64)
    out[:, order] = bins, offsets, final[bins]
    return out[0], out[1], out[2]


def _cut(text: Column, total: Column, longest: int) -> Column:
    """The pieces of a text with ``total`` words and end token: number, first word, size, body."""
    piece = lambda i, start, size, body: F.struct(i.cast("long").alias("piece"), start.cast("long").alias("start"), size.cast("long").alias("size"), body.alias("body"))
    whole = F.array(piece(F.lit(0), F.lit(0), total, text))

    def parts(words: Column) -> Column:
        start = lambda i: i * longest
        body = lambda i: F.array_join(F.slice(words, (start(i) + 1).cast("int"), F.lit(longest)), " ")
        return F.transform(F.sequence(F.lit(0).cast("long"), F.floor((total - 1) / longest)), lambda i: piece(i, start(i), F.least(F.lit(longest), total - start(i)), body(i)))

    # as the variable of an outer function, a long text is cut to words once and not once a piece
    cut = F.transform(F.array(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))), parts)
    return F.when(total <= longest, whole).otherwise(F.element_at(cut, 1))


def pieces(docs: DataFrame, key: str, text: str, longest: int) -> DataFrame:
    """``k``, ``own``, ``copy``, ``piece``, ``start``, ``size``, ``body``; ``copy`` counts rows of one key and text from 0."""
    rows = docs.select(F.col(key).cast("long").alias("k"), whole_text(text).alias("t")).withColumn("own", F.xxhash64("t"))
    again = rows.groupBy("k", "own").agg(F.count("*").alias("n")).where("n > 1")
    again = materialise(again, "pieces-again")
    if again.isEmpty():
        rows = rows.select("k", "own", "t", F.lit(0).cast("long").alias("copy"))
    else:
        same = F.col("k").eqNullSafe(F.col("_k")) & (F.col("own") == F.col("_own"))
        marks = small(again.select(F.col("k").alias("_k"), F.col("own").alias("_own")), 24)
        single = rows.join(marks, same, "left_anti").select("k", "own", "t", F.lit(0).cast("long").alias("copy"))
        # one text for each kind of rows, counted out in runs: no task holds all copies of a row
        texts = rows.join(marks, same, "left_semi").groupBy("k", "own").agg(F.first("t").alias("t"), F.count("*").alias("n"))
        runs = texts.select("k", "own", "t", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / RUN))).alias("run"))
        last = F.least(F.col("n") - 1, F.col("run") * RUN + RUN - 1)
        many = runs.select("k", "own", "t", F.explode(F.sequence(F.col("run") * RUN, last)).alias("copy"))
        rows = single.unionByName(many)
    rows = rows.withColumn("total", word_count("t") + 1)
    return rows.select("k", "own", "copy", F.explode(_cut(F.col("t"), F.col("total"), longest)).alias("p")).select("k", "own", "copy", "p.*")


def _grouped(docs: DataFrame, key: str, text: str, lengths: tuple[int, ...]) -> DataFrame:
    longest = lengths[-1]
    sized = docs.select((F.floor(word_count(text) / longest) + 1).alias("n"))  # the pieces of each row
    count = sized.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    groups = max(1, -(-count // GROUP))
    rows = pieces(docs, key, text, longest)
    rows = rows.withColumn("group", F.pmod(F.xxhash64("k", "own", "piece", "copy"), F.lit(groups)))
    return rows.withColumn("k", F.col("k").cast("string"))


def _packed(frame: pd.DataFrame, lengths: tuple[int, ...]) -> pd.DataFrame:
    """The pieces of a group with their places; the order of equal sizes is that of key, text, piece and copy."""
    frame = frame.sort_values(["size", "k", "own", "piece", "copy"], ascending=[False, True, True, True, True], kind="stable")
    bins, offsets, final = best_fit(frame["size"].to_numpy(np.int64), lengths)
    return frame.assign(bin_id=frame["group"] * (1 << 32) + bins, bin_offset=offsets, bin_length=final)


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", lengths: tuple[int, ...] = LENGTHS) -> DataFrame:
    """One row a piece: ``key``, copy, piece, start, size, bin_id, bin_offset, bin_length.

    Null and empty texts are one end token; null keys are packed like others; of repeated rows each is
    packed, ``copy`` tells them apart; an empty table gives no rows. Other columns aren't used.
    """
    names = ["k", "copy", "piece", "start", "size", "bin_id", "bin_offset", "bin_length"]
    kinds = "k string, copy long, piece long, start long, size long, bin_id long, bin_offset long, bin_length long"
    rows = _grouped(docs, key, text, lengths).drop("body")
    made = rows.groupBy("group").applyInPandas(lambda frame: _packed(frame, lengths)[names], kinds)
    return made.withColumn("k", F.col("k").cast("long")).withColumnRenamed("k", key)


def sequences(docs: DataFrame, key: str = "doc_id", text: str = "text", lengths: tuple[int, ...] = LENGTHS) -> DataFrame:
    """One row a sequence: bin_id, bin_length, used, doc_ids, copies, pieces, starts, sizes and offsets of what it holds in order, and its text.

    Nulls, repeated rows and empty tables: as in ``pack``. A group's texts (``GROUP`` pieces of at most the longest length) are in memory at once.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = _packed(frame, lengths).sort_values(["bin_id", "bin_offset"])
        out = []
        for bin_id, held in frame.groupby("bin_id", sort=False):
            ids = [None if pd.isna(k) else int(k) for k in held["k"]]
            lists = [held[c].tolist() for c in ("copy", "piece", "start", "size", "bin_offset")]
            out.append((bin_id, int(held["bin_length"].iloc[0]), int(held["size"].sum()), ids, *lists, "".join(f"{escaped(b)}{END}" for b in held["body"])))
        return pd.DataFrame(out, columns=names)

    names = ["bin_id", "bin_length", "used", "doc_ids", "copies", "pieces", "starts", "sizes", "offsets", "text"]
    kinds = "bin_id long, bin_length long, used long, " + ", ".join(f"{c} array<long>" for c in names[3:9]) + ", text string"
    return _grouped(docs, key, text, lengths).groupBy("group").applyInPandas(run, kinds)
