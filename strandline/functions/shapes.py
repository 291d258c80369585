"""Reference lines: the named presets and lines through given points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Piecewise-linear presets as (place from 0 to 1, height from 0 to 1).
PRESETS = {
    "double_top": [(0.0, 0.0), (0.25, 1.0), (0.5, 0.5), (0.75, 1.0), (1.0, 0.1)],
    "double_bottom": [(0.0, 1.0), (0.25, 0.0), (0.5, 0.5), (0.75, 0.0), (1.0, 0.9)],
    "head_shoulders": [(0.0, 0.0), (0.2, 0.7), (0.35, 0.4), (0.5, 1.0), (0.65, 0.4), (0.8, 0.7), (1.0, 0.0)],
    "trend_up": [(0.0, 0.0), (1.0, 1.0)],
    "trend_down": [(0.0, 1.0), (1.0, 0.0)],
}


def through(points: list[tuple[float, float]], n: int = 100) -> Column:
    """An array of ``n`` heights on the straight lines between points; flat before the first and after the last."""
    points = sorted(points)

    def at(i: Column) -> Column:
        x = i / (n - 1)
        value = F.lit(points[-1][1])
        for (x0, y0), (x1, y1) in reversed(list(zip(points, points[1:]))):
            value = F.when(x <= x1, y0 + (y1 - y0) * (x - x0) / ((x1 - x0) or 1.0)).otherwise(value)
        return F.when(x <= points[0][0], F.lit(points[0][1])).otherwise(value).cast("double")

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), at)


def named_line(name: str, n: int = 100, touches: int = 3) -> Column:
    """A reference line by name (S13): triangle_up, triangle_down, trend_up, trend_down, range, compression, level; any other is a plain wave.

    ``level`` is a quiet line that touches a height ``touches`` times; its noise comes from a hash of the place, so it is the same every time.
    """
    wave = lambda x, turns: F.sin(x * turns * F.pi())
    noise = lambda i, salt: F.pmod(F.xxhash64(F.lit(salt), i), F.lit(1_000_003)) / 1_000_003
    lines = {
        "triangle_up": lambda x, i: 0.5 + wave(x, 8) * (0.5 - x) * 0.5, "triangle_down": lambda x, i: 0.5 + wave(x, 8) * x * 0.5, "trend_up": lambda x, i: x * 0.8 + 0.1 + wave(x, 6) * 0.08,
        "trend_down": lambda x, i: (1 - x) * 0.8 + 0.1 + wave(x, 6) * 0.08, "range": lambda x, i: wave(x, 8) * 0.15 + 0.5, "compression": lambda x, i: wave(x, 10) * 0.3 * F.exp(-2 * x) + 0.5,
    }

    def level(x: Column, i: Column) -> Column:
        value = noise(i, 1) * 0.3 + 0.35
        for t in range(touches):
            at = int((t + 0.5) / touches * n * 0.9)
            value = F.when(i.between(at - 3, at + 2), 0.7 + (noise(i, 2) - 0.5) * 0.04).otherwise(value)
        return value

    made = level if name == "level" else lines.get(name, lambda x, i: wave(x, 4) * 0.3 + 0.5)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: made(i / (n - 1), i))


#: Names that ``named_line`` knows.
NAMED = ("triangle_up", "triangle_down", "trend_up", "trend_down", "range", "compression", "level")


def presets(spark: SparkSession) -> DataFrame:
    """name, line: every preset."""
    rows = spark.range(1)
    made = [rows.select(F.lit(name).alias("name"), through(p).alias("line")) for name, p in PRESETS.items()]
    out = made[0]
    for m in made[1:]:
        out = out.unionByName(m)
    return out
