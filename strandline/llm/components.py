"""Connected components of a graph of links, as joins and aggregations that survive lost executors.

Every node points at the least node it has seen. A round points all neighbours of a node at the least
one among them (large star, then small star), which keeps components together and shortens
paths, until nothing changes. Each round is written in the folder all executors share, so lineage stays
short, and the round before it goes. Stars aggregate on the driver nothing but a count.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import materialise, release, scratch, small


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Links (a > b): each node's larger (or smaller) neighbours go to the least of them and itself."""
    if large:
        both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        least = least.withColumn("m", F.least("a", "m"))
        out = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = links.groupBy("a").agg(F.min("b").alias("m"))
        out = links.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        out = out.unionByName(least.select("a", F.col("m").alias("b")))
    return out.where(F.col("a") > F.col("b")).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``root`` (the least node of its component) for every node that has a link to another.

    Links may repeat, go either way and loop; null ends are left out. Any type that can be ordered will do.
    """
    links = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    links = materialise(links.where("a is not null and b is not null and a > b").distinct(), "links")
    state = None
    while True:
        before, links = links, materialise(_star(_star(links, large=True), large=False), "stars")
        release(before)
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        state = tuple(now)


#: Leaders of a band in the first round, and how many times as many each round after it has.
LEADERS = 8
GROWTH = 64
#: What a row with a mark takes on the driver while it is broadcast: some 270 bytes, collected, packed and built into a table.
MARK_BYTES = 1200


def _merged(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` with the roots that links between roots ``root`` and ``_root`` leave."""
    moved = materialise(components(found, "root", "_root").withColumnRenamed("root", "_to").withColumnRenamed("node", "root"), "moved-roots")
    return rows.join(small(moved, 32), "root", "left").withColumn("root", F.coalesce("_to", "root")).drop("_to")


def in_shared_bands(members: DataFrame) -> DataFrame:
    """Members ``h`` of a ``band`` (longs) that more than one has, once each, with the band's least member ``rep`` and further columns."""
    tops = members.groupBy("band").agg(F.min("h").alias("rep"), F.max("h").alias("last")).where("rep != last").drop("last")
    return materialise(members.join(small(materialise(tops, "bands"), 32), "band").distinct(), "bands-shared")


def banded_links(members: DataFrame, check: Callable[[DataFrame], DataFrame], most_off: int = 64, marks: DataFrame | None = None, near: Callable[[str, str], Column] | None = None) -> DataFrame:
    """Links ``h``, ``rep`` that connect all members ``h`` of a ``band`` (longs) that ``check`` links, directly or by others.

    ``members`` may come from ``in_shared_bands``. ``marks``: ``h`` and ``mark`` of each member; ``near`` is true for the names of two marks unless ``check``
    cannot link them, so it spares pairs and loses none. Without marks members have a ``sketch``: 64 bits of which near ones have at most ``most_off`` that differ;
    other pairs are not checked.

    Each member is checked against the band's least one, found by partial aggregation and a join that Spark may split. Where members
    are then in more than one component, every other pair of the band is looked at, in rounds: its leaders, ``LEADERS`` by a hash, then ``GROWTH``
    times as many, and so on to the last member, meet the members behind them that are in another component. Bands that have become
    one component, and those whose members have all led, are done; of bands with the same members one is looked at. So no link is lost,
    whatever a band holds, and members that one leader connects are not paired with each other. Tables of the rounds go when the links are written. ``check`` gets pairs ``h``, ``rep`` and returns those that are near.
    """
    with scratch() as keep:
        return keep(materialise(_banded(members, check, most_off, marks, near), "banded-links"))


def _banded(members: DataFrame, check: Callable[[DataFrame], DataFrame], most_off: int, marks: DataFrame | None, near: Callable[[str, str], Column] | None) -> DataFrame:
    shared = members if "rep" in members.columns else in_shared_bands(members)
    pairs = shared.where("h != rep")
    if marks is None:
        near = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= most_off
        heads = materialise(shared.where("h = rep").select("rep", F.col("sketch").alias("_mark")).distinct(), "band-heads")
        pairs = pairs.join(small(heads, 32), "rep").where(near("sketch", "_mark"))
    pairs = materialise(pairs.select("h", "rep").distinct(), "band-pairs")
    if marks is not None:
        held = small(marks, MARK_BYTES)
        pairs = pairs.join(held, "h").join(held.select(F.col("h").alias("rep"), F.col("mark").alias("_mark")), "rep").where(near("mark", "_mark"))
        pairs = materialise(pairs.select("h", "rep"), "band-near-pairs")
    links = check(pairs)

    # the least member has met all others
    roots = materialise(components(links, "h", "rep").select(F.col("node").alias("h"), "root"), "band-roots")
    own = ["h", "band", *(["sketch"] if marks is None else [])]
    rows = shared.where("h != rep").join(small(roots, 32), "h", "left").select(*own, F.coalesce("root", "h").alias("root"))
    rows = materialise(rows, "band-members")
    size, low, high = F.count("*"), 0, LEADERS
    while True:
        same = [F.bit_xor(F.xxhash64(F.lit(i), "h")).alias(f"s{i}") for i in (2, 3)]
        wide = rows.groupBy("band").agg(size.alias("n"), F.min("root").alias("a"), F.max("root").alias("b"), *same).where("a != b")
        wide = wide.groupBy("n", "a", "b", "s2", "s3").agg(F.min("band").alias("band")).select("band", "n")
        wide = materialise(wide, "open-bands")
        if wide.isEmpty():
            return links
        rows = rows.select(*own, "root").join(small(wide, 32), "band")
        rows = materialise(rows.withColumn("turn", (F.xxhash64(F.lit(1), "h") / 2.0**64 + 0.5) * F.col("n")), "open-members")
        marked = rows.withColumnRenamed("sketch", "mark") if marks is None else rows.join(held, "h")
        lead = marked.where((F.col("turn") >= low) & (F.col("turn") < high))
        lead = lead.select("band", F.col("h").alias("rep"), F.col("mark").alias("_mark"), F.col("root").alias("_root"), F.col("turn").alias("_turn"))
        behind = (F.struct("_turn", "rep") < F.struct("turn", "h")) & (F.col("root") != F.col("_root")) & near("mark", "_mark")
        pairs = marked.join(small(materialise(lead, "band-leaders"), 56 if marks is None else MARK_BYTES), "band").where(behind)
        pairs = pairs.select(*[f("h", "rep").alias(n) for f, n in ((F.greatest, "h"), (F.least, "rep"))], "root", "_root").dropDuplicates(["h", "rep"])
        pairs = materialise(pairs, "band-crossing")
        rows = rows.where(F.col("n") >= high)
        if not pairs.isEmpty():
            found = materialise(check(pairs.select("h", "rep")), "crossing-links")
            links = links.unionByName(found)
            rows = _merged(rows, pairs.join(found, ["h", "rep"], "left_semi"))
        size, low, high = F.max("n"), high, high * GROWTH
