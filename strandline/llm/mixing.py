"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only.

Every source gets a target of words from its weight; no target is above ``limit`` times what the
source has, and what is cut off goes to the others by weight until none is above (water filling).
Inside a source, the target is shared among length classes of its documents in the same way, with
longer classes weighing more, so that documents have unequal expected copies ``e`` (0 to ``limit``).
``floor(e)`` copies are certain. The rest ``p = e - floor(e)`` is a document's inclusion probability
in a Pareto order sample: with ``u`` uniform from a hash of the key, documents are ranked by
``(u / (1 - u)) / (p / (1 - p))`` and taken in that order until the source's remaining words are
reached. The size is fixed in words, so a source misses its target by less than one document.

The cut in the ranking is found from a histogram of the ranks (``BINS`` bins a source), then from one of the bin that holds
the cut (``BINS`` bins again), and only the rows of that last bin are put in order: one row in 16 million of evenly spread ones. So no source
is sorted as a whole and a source may hold any share of the rows. Only the table of sources, one row each, meets in one task.

Nulls: a null text has size 0; a null source is a source of its own, last in order; a null key takes
part with a fixed hash; rows of one key and size are in the order of a hash of their texts, and rows with
equal texts as well are alike in all that decides. Repeated rows are documents of their own. A source without words has target
0 and takes nothing. Empty tables give empty results. Further columns are kept as they are; the
columns made here replace columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import materialise, sheltered, small, word_count

#: Bins of a source's ranks; the rows of one bin of one source are put in order in one task.
BINS = 4096


def water_fill(df: DataFrame, total: str, capacity: str, weight: str, out: str, by: list[str]) -> DataFrame:
    """Adds ``out``: shares of ``total`` by ``weight``, none above ``capacity``, per group ``by``.

    Rows reach their capacity in the order of capacity / weight. With the first k full, the rest
    share what is left by weight; a row is full exactly if its capacity / weight is at most the
    level found with all earlier rows full.
    """
    first = F.when(F.col(weight) > 0, F.col(capacity) / F.col(weight)).otherwise(F.lit(float("inf")))
    ahead = Window.partitionBy(*by).orderBy("_edge", F.col(weight).desc(), F.col(capacity))
    before = ahead.rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy(*by)
    df = df.withColumn("_edge", first)
    df = df.withColumns({
        "_left": F.col(total) - F.coalesce(F.sum(capacity).over(before), F.lit(0.0)),
        "_weights": F.sum(weight).over(all_rows) - F.coalesce(F.sum(weight).over(before), F.lit(0.0)),
    })
    level = F.when(F.col("_weights") > 0, F.col("_left") / F.col("_weights")).otherwise(F.lit(0.0))
    df = df.withColumn("_level", level).withColumn("_full", F.col("_edge") <= F.col("_level"))
    # the level of the first row that isn't full holds for all that follow
    df = df.withColumn("_level", F.max(F.when(~F.col("_full"), F.col("_level"))).over(all_rows))
    share = F.when(F.col("_full"), F.col(capacity)).otherwise(F.greatest(F.lit(0.0), F.col("_level") * F.col(weight)))
    return df.withColumn(out, F.least(share, F.col(capacity))).drop("_edge", "_left", "_weights", "_level", "_full")


def source_targets(sizes: DataFrame, share: float, weights: list[float], limit: float) -> DataFrame:
    """One row per source: its size, and its target of words. ``sizes``: source, size."""
    table = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    rank = (F.row_number().over(order) - 1) % len(weights) + 1
    table = table.withColumns({
        "_weight": F.element_at(F.array(*[F.lit(float(w)) for w in weights]), rank.cast("int")),
        "_cap": F.col("source_size") * F.lit(float(limit)),
        "_total": F.sum("source_size").over(Window.partitionBy(F.lit(0))) * F.lit(float(share)),
        "_one": F.lit(0),
    })
    return water_fill(table, "_total", "_cap", "_weight", "target", ["_one"]).select("source", "source_size", "target")


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) from the first 13 hex digits of an MD5 over seed and key."""
    text = F.concat_ws(":", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit("null")))
    number = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double")
    return (number + 0.5) / F.lit(float(2**52))


def _cut(rows: DataFrame, bin_column: str, base: Column, out: str, name: str) -> DataFrame:
    """Per source the bin in which the words of rows by rank reach what is wanted: ``_cs``, ``out``, ``_before`` (words of earlier bins and ``base``), ``_wanted``."""
    bins = rows.groupBy("_src", bin_column).agg(F.sum("size").alias("_words"), F.max("_wanted").alias("_wanted"), F.max(base).alias("_start"))
    upto = Window.partitionBy("_src").orderBy(bin_column)
    bins = bins.withColumn("_before", F.col("_start") + F.sum("_words").over(upto) - F.col("_words"))
    cut = bins.where((F.col("_before") < F.col("_wanted")) & (F.col("_before") + F.col("_words") >= F.col("_wanted")))
    return small(materialise(cut.select(F.col("_src").alias("_cs"), F.col(bin_column).alias(out), "_before", "_wanted"), name), 64)


def pareto_mix(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    share: float = 1.5,
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    limit: float = 2.0,
    seed: int = 20,
    size: str | None = None,
) -> DataFrame:
    """All rows of ``docs`` with size, source_size, target, copies and taken (= copies x size).

    ``size``: a column with the numbers of words, where they are counted already; then no text is needed. Nulls, repeated rows, empty tables and extra columns: see the module's docstring.
    """
    made = ["size", "source_size", "target", "copies", "taken"]
    base, names = sheltered(docs)
    key, text, source = names[key], names.get(text), names[source]
    base = base.withColumns({"size": word_count(text) if size is None else F.col(names[size]), "_tie": F.xxhash64(text) if size is None else F.lit(0).cast("long")})
    group = (F.length(F.bin(F.col("size") + 1)) - 1).cast("int")  # the whole part of log2(size + 1)
    base = base.withColumns({"_src": F.col(source), "_class": group, "_u": uniform(F.col(key), seed)})

    # sources x length classes (at most 64 a source): the only table that is shared out
    classes = base.groupBy(F.col("_src").alias("source"), "_class").agg(F.sum("size").alias("class_size"))
    targets = source_targets(classes.select("source", F.col("class_size").alias("size")), share, list(weights), limit)
    classes = classes.withColumnRenamed("source", "_src")
    classes = classes.join(targets.withColumnRenamed("source", "_ts"), F.col("_src").eqNullSafe(F.col("_ts"))).drop("_ts")
    classes = classes.withColumns({"_w": (F.col("_class") + 1) * F.col("class_size").cast("double"), "_cap": F.col("class_size") * F.lit(float(limit))})
    classes = water_fill(classes, "target", "_cap", "_w", "_class_target", ["_src"])
    expected = F.when(F.col("class_size") > 0, F.col("_class_target") / F.col("class_size")).otherwise(F.lit(0.0))
    classes = classes.withColumn("_e", F.least(F.round(expected, 9), F.lit(float(limit))))
    classes = classes.withColumns({"_sure": F.floor("_e").cast("long"), "_p": F.col("_e") - F.floor("_e")})
    # words still wanted in each source once the certain copies are out
    per_source = Window.partitionBy("_src")
    classes = classes.withColumn("_wanted", F.col("target") - F.sum(F.col("_sure") * F.col("class_size")).over(per_source))
    classes = classes.select(F.col("_src").alias("_cs"), F.col("_class").alias("_cc"), "source_size", "target", "_sure", "_p", "_wanted")
    classes = small(materialise(classes, "mix-classes"), 128)  # written: small enough to be sent to the rows, which then stay where they are
    rows = base.join(classes, F.col("_src").eqNullSafe(F.col("_cs")) & (F.col("_class") == F.col("_cc"))).drop("_cs", "_cc")

    # Pareto order: random odds over inclusion odds; a monotone map to [0, 1) gives the bins
    odds = (F.col("_u") / (1 - F.col("_u"))) / (F.col("_p") / (1 - F.col("_p")))
    rank = F.when((F.col("_p") > 0) & (F.col("size") > 0), odds / (1 + odds))
    rows = rows.withColumn("_rank", rank)
    rows = rows.withColumn("_bin", F.least(F.lit(BINS - 1), F.floor(F.col("_rank") * BINS)).cast("int"))

    # the histogram finds the bin of the cut: all earlier bins are in, all later ones out
    cut = _cut(rows.where(F.col("_rank").isNotNull()), "_bin", F.lit(0.0), "_cut", "mix-cuts")
    rows = rows.join(cut.drop("_wanted"), F.col("_src").eqNullSafe(F.col("_cs")), "left").drop("_cs")
    rows = rows.withColumn("_at_cut", F.coalesce(F.col("_bin") == F.col("_cut"), F.lit(False)))
    sure_in = F.col("_rank").isNotNull() & (F.col("_cut").isNull() | (F.col("_bin") < F.col("_cut"))) & (F.col("_wanted") > 0)
    outside = rows.where(~F.col("_at_cut")).withColumn("_extra", sure_in)

    # that bin is cut again in the same way
    inside = rows.where("_at_cut").withColumn("_fine", F.least(F.lit(BINS - 1), F.floor((F.col("_rank") * BINS - F.col("_bin")) * BINS)).cast("int"))
    fine = _cut(inside, "_fine", F.col("_before"), "_fine_cut", "mix-fine-cuts").withColumnRenamed("_before", "_fine_before").drop("_wanted")
    inside = inside.join(fine, F.col("_src").eqNullSafe(F.col("_cs")), "left").drop("_cs")
    at_fine = F.coalesce(F.col("_fine") == F.col("_fine_cut"), F.lit(False))
    beside = inside.where(~at_fine).withColumn("_extra", F.col("_fine_cut").isNull() | (F.col("_fine") < F.col("_fine_cut")))

    # rows of the bin that holds the cut are taken in order while that brings the sum nearer
    order = Window.partitionBy("_src").orderBy("_rank", F.col(key).asc_nulls_first(), "size", "_tie")
    last = inside.where(at_fine)
    so_far = F.col("_fine_before") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    last = last.withColumn("_extra", so_far - F.col("size") / 2 <= F.col("_wanted"))
    result = outside
    for part in (beside, last):
        result = result.unionByName(part, allowMissingColumns=True)
    result = result.withColumn("copies", F.col("_sure") + F.col("_extra").cast("long"))
    result = result.withColumn("taken", F.col("copies") * F.col("size"))
    return result.select(*[F.col(n).alias(c) for c, n in names.items() if c not in made], *made)


def repeat_copies(mixed: DataFrame) -> DataFrame:
    """One row for each copy taken, with its number ``copy`` from 1; rows with no copy go, so an empty mix stays empty."""
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return mixed.where(F.col("copies") > 0).withColumn("copy", copies)
