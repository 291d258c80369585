"""Labelled synthetic bars: known shapes under small noise and random walks, from hashes alone, so any row can be made anywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.shapes import through

#: Shapes by the type they stand for, as (place, height) from 0 to 1; the last leg breaks the level that confirms them.
SHAPES = {
    "double_top": [(0.0, 0.45), (0.35, 0.9), (0.5, 0.5), (0.65, 0.9), (1.0, 0.4)],
    "double_bottom": [(0.0, 0.55), (0.35, 0.1), (0.5, 0.5), (0.65, 0.1), (1.0, 0.6)],
    "triple_top": [(0.0, 0.45), (0.22, 0.9), (0.34, 0.55), (0.46, 0.9), (0.58, 0.55), (0.7, 0.9), (1.0, 0.45)],
    "triple_bottom": [(0.0, 0.55), (0.22, 0.1), (0.34, 0.45), (0.46, 0.1), (0.58, 0.45), (0.7, 0.1), (1.0, 0.55)],
    "head_shoulders": [(0.0, 0.35), (0.2, 0.65), (0.32, 0.42), (0.48, 0.95), (0.62, 0.42), (0.76, 0.65), (1.0, 0.32)],
    "inv_head_shoulders": [(0.0, 0.65), (0.2, 0.35), (0.32, 0.58), (0.48, 0.05), (0.62, 0.58), (0.76, 0.35), (1.0, 0.68)],
    "cup_and_handle": [(0.0, 0.5), (0.1, 0.85), (0.22, 0.45), (0.35, 0.25), (0.48, 0.45), (0.6, 0.85), (0.72, 0.65), (1.0, 1.0)],
    "rounding_bottom": [(0.0, 0.75), (0.08, 0.85), (0.2, 0.5), (0.35, 0.24), (0.5, 0.15), (0.65, 0.24), (0.8, 0.5), (0.92, 0.85), (1.0, 0.95)],
}


def uniform(*keys: Column) -> Column:
    """A number in (0, 1) from a hash of the keys."""
    return (F.pmod(F.xxhash64(*keys), F.lit(2**40)) + 0.5) / F.lit(float(2**40))


def normal(*keys: Column) -> Column:
    """A standard normal number from two hashes of the keys."""
    return F.sqrt(-2 * F.log(uniform(F.lit(1), *keys))) * F.cos(2 * F.pi() * uniform(F.lit(2), *keys))


def labelled(spark: SparkSession, each: int = 5, noise: int = 10, n: int = 100, seed: int = 7, wobble: float = 0.0015, drift: float = 0.012) -> DataFrame:
    """symbol, label, idx, open_time, open, high, low, close, volume of ``each`` series a shape and ``noise`` random walks.

    A shape's closes are 100 times 1 + .3 height, each with a normal factor of ``wobble``; a walk (label ``noise``) is the running product
    of 1 plus normal moves of ``drift``. High and low enclose open and close; volumes are 1000 to 2000.
    """
    made = spark.range(1)
    kinds = [F.struct(F.lit(k).alias("label"), F.lit(each).alias("of"), through(p, n).alias("height")) for k, p in SHAPES.items()]
    kinds.append(F.struct(F.lit("noise").alias("label"), F.lit(noise).alias("of"), F.array_repeat(F.lit(0.0), n).alias("height")))
    rows = made.select(F.explode(F.array(*kinds)).alias("k")).select("k.label", "k.height", F.explode(F.sequence(F.lit(1), F.col("k.of"))).alias("number"))
    key = lambda i: [F.lit(seed), F.col("label"), F.col("number"), i]
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(n)), F.array().cast("array<double>"), lambda a, i: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(100.0)) * (1 + drift * normal(*key(i))))))
    shaped = F.transform("height", lambda h, i: 100 * (1 + 0.3 * h) * (1 + wobble * normal(*key(i))))
    rows = rows.withColumn("closes", F.when(F.col("label") == "noise", walk).otherwise(shaped))
    rows = rows.select(F.concat_ws("-", "label", "number").alias("symbol"), "label", "number", "closes", F.posexplode("closes").alias("idx", "close"))
    before = F.coalesce(F.get("closes", F.col("idx") - 1), F.col("close"))
    wide = 1 + 0.5 * wobble * uniform(F.lit(3), *key(F.col("idx")))
    return rows.select(
        "symbol", "label", "idx", (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("idx"))).alias("open_time"), before.alias("open"), (F.greatest(before, "close") * wide).alias("high"),
        (F.least(before, "close") / wide).alias("low"), "close", (1000 + F.floor(1000 * uniform(F.lit(4), *key(F.col("idx"))))).cast("long").alias("volume"),
    )
