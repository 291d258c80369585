"""Series as one row each: closes, volumes and lines as arrays, and everything about them as column expressions.

A series here is a symbol's latest bars, so arrays are of bounded length; one aggregation packs them, and no later step moves
a row. Lines have ``POINTS`` values from 0 to 1. Pivots are arrays of structs: idx, y, is_high, prominence, confidence. Steps that depend on
what was kept before are folds (``aggregate``) over those arrays.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions import texts as T
from strandline.functions.texts import Text, added, for_columns
from strandline.operators.features import stretched

POINTS = 100
#: Fixed values of pivot detection: most pivots kept, least bars, least swing, bounds of the swing's multiple.
KEEP = 10
LEAST_BARS = 11
LEAST_SWING = 0.02
SWING_FACTORS = (1.5, 0.8, 3.5)
LEAST_STEP = 0.04
SCALES = (2, 3, 5)

_MARK = "array<struct<idx: int, is_high: boolean>>"


# --- arrays ---


def let(value: Text, body: Callable[[Text], Text]) -> Text:
    """``body`` of a value that is worked out once, however often it is named there."""
    return T.element_at(T.transform(T.array(value), body), 1)


def part(a: Text, start: Text | int, end: Text | int) -> Text:
    """The values at places ``start`` (from 0) up to but not with ``end``."""
    start, end = (T.lit(v) if isinstance(v, (int, float)) else v for v in (start, end))
    return T.slice(a, (start + 1).cast("int"), T.greatest(T.lit(0), end - start).cast("int"))


def total(a: Text) -> Text:
    return T.aggregate(a, T.lit(0.0), lambda s, x: s + x)


def mean(a: Text) -> Text:
    """0 of no values."""
    return T.when(T.size(a) > 0, total(a) / T.size(a)).otherwise(0.0)


def deviation(a: Text) -> Text:
    return let(mean(a), lambda m: T.sqrt(mean(T.transform(a, lambda x: (x - m) * (x - m)))))


def span(a: Text) -> Text:
    return T.when(T.size(a) > 0, T.array_max(a) - T.array_min(a)).otherwise(0.0)


def steps(a: Text) -> Text:
    """Each value less the one before."""
    return T.zip_with(part(a, 1, T.size(a)), part(a, 0, T.size(a) - 1), lambda x, y: x - y)


def sizes(a: Text) -> Text:
    return T.transform(steps(a), T.abs)


def count_of(a: Text, test: Callable[[Text], Text]) -> Text:
    return T.size(T.filter(a, test))


def first_at(a: Text, value: Text) -> Text:
    """The first place (from 0) of a value."""
    return (T.array_position(a, value) - 1).cast("int")


@for_columns
def fit(xs: Text, ys: Text) -> Text:
    """Least-squares line: slope, base, r (0 where one side does not vary) and off, the mean absolute residual."""

    def lines(m: Text) -> Text:
        dx, dy = T.transform(xs, lambda x: x - m.x), T.transform(ys, lambda y: y - m.y)
        dot = lambda a, b: total(T.zip_with(a, b, lambda p, q: p * q))
        return let(T.struct(dot(dx, dx).alias("xx"), dot(dx, dy).alias("xy"), dot(dy, dy).alias("yy")), lambda s: T.struct(
            T.when(s.xx > 0, s.xy / s.xx).otherwise(0.0).alias("slope"), (m.y - T.when(s.xx > 0, s.xy / s.xx).otherwise(0.0) * m.x).alias("base"),
            T.when((s.xx > 0) & (s.yy > 0), s.xy / T.sqrt(s.xx * s.yy)).otherwise(0.0).alias("r"),
        ))

    line = let(T.struct(mean(xs).alias("x"), mean(ys).alias("y")), lines)
    off = lambda s: mean(T.zip_with(xs, ys, lambda x, y: T.abs(y - s.base - s.slope * x)))
    return let(line, lambda s: T.struct(s.slope.alias("slope"), s.base.alias("base"), s.r.alias("r"), off(s).alias("off")))


@for_columns
def places(a: Text) -> Text:
    """0.0, 1.0, ... for each value."""
    return T.transform(T.sequence(T.lit(0), T.size(a) - 1), lambda i: i.cast("double"))


# --- packing and lines ---


def pack(bars: DataFrame, *keys: str) -> DataFrame:
    """One row a series with its bars in order: closes, highs, lows, volumes, times. ``keys``: symbol unless given."""
    keys = keys or ("symbol",)
    fields = ["idx", "open_time", "high", "low", "close", "volume"]
    rows = bars.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("bars"))
    return rows.select(*keys, F.col("bars.close").alias("closes"), F.col("bars.high").alias("highs"), F.col("bars.low").alias("lows"), F.transform("bars.volume", lambda v: v.cast("double")).alias("volumes"), F.col("bars.open_time").alias("times"))


def normal_line(closes: Text, n: int = POINTS) -> Text:
    """``closes`` as ``n`` points by linear interpolation, from 0 to 1; a flat series is 0 (A1)."""
    def scaled(a: Text) -> Text:
        return let(T.struct(T.array_min(a).alias("lo"), span(a).alias("span")), lambda s: T.transform(a, lambda v: T.when(s.span < 1e-10, 0.0).otherwise((v - s.lo) / s.span)))

    return let(stretched(closes, T.lit(n)), scaled)


def smoothing_weights(width: int) -> np.ndarray:
    """Row k: the weights by which a parabola fitted to ``width`` values gives its value at place k."""
    x = np.vander(np.arange(width) - width // 2, 3)
    return x @ np.linalg.pinv(x)


@for_columns
def smoothed(a: Text, width: int) -> Text:
    """Savitzky-Golay smoothing by parabolas (W7); at the ends the first and the last parabola go on."""
    table = T.array(*[T.array(*[T.lit(float(v)) for v in row]) for row in smoothing_weights(width)])

    def value(i: Text) -> Text:
        start = T.greatest(T.lit(0), T.least(i - width // 2, T.size(a) - width))
        return total(T.zip_with(part(a, start, start + width), T.get(table, i - start), lambda x, w: x * w))

    return T.transform(T.sequence(T.lit(0), T.size(a) - 1), value)


def adaptively_smoothed(a: Text) -> Text:
    """Width 5, and once more at width 9 or 11 where the moves are uneven."""
    def again(s: Text) -> Text:
        m = sizes(s)
        return let(T.when(mean(m) > 0, deviation(m) / mean(m)).otherwise(0.0), lambda noise: T.when(noise > 2.0, smoothed(s, 11)).when(noise > 1.5, smoothed(s, 9)).otherwise(s))

    return T.when(T.size(a) < LEAST_BARS, a).otherwise(let(smoothed(a, 5), again))


# --- pivots ---


def _mark(idx: Text, is_high: Text | bool) -> Text:
    return T.struct(idx.cast("int").alias("idx"), (T.lit(is_high) if isinstance(is_high, bool) else is_high).alias("is_high"))


def _none() -> Text:
    return T.array().cast(_MARK)


def zigzag_marks(line: Text) -> Text:
    """Turns of a line by the least swing (W11): the extreme of each finished leg that is far enough from the mark before.

    The swing follows the mean move and how uneven moves are. A leg that ends too early turns the direction and leaves no mark;
    the last, unfinished leg leaves none. Lines of under ``LEAST_BARS`` values have none.
    """
    low, slope, high = SWING_FACTORS

    def limits(m: Text) -> Text:
        w = T.greatest(T.lit(5), T.floor(T.size(line) / 10)).cast("int")
        means = T.transform(T.sequence(T.lit(0), T.size(m) - w), lambda i: mean(part(m, i, i + w)))
        level = T.when(T.size(m) >= w, mean(means)).otherwise(mean(m))
        return let(level, lambda v: T.struct(
            T.greatest(T.lit(LEAST_SWING), v * T.greatest(T.lit(low), T.least(T.lit(high), low + slope * deviation(m) / (v + 1e-10)))).alias("swing"),
            T.greatest(T.lit(3), T.floor(T.size(line) / 20)).alias("space"),
        ))

    def walk(bound: Text) -> Text:
        start = T.struct(T.lit(0).alias("way"), T.lit(0).alias("hi"), T.lit(0).alias("lo"), _none().alias("marks"))

        def step(s: Text, i: Text) -> Text:
            v, top, bottom = T.get(line, i), T.get(line, s.hi), T.get(line, s.lo)
            higher = (s.way >= 0) & (v > top)
            fell = (s.way >= 0) & ~higher & (top - v >= bound.swing)
            lower = (s.way <= 0) & (v < bottom)
            rose = (s.way <= 0) & ~lower & ~fell & (v - bottom >= bound.swing)
            alone = T.size(s.marks) == 0
            clear = lambda at: T.when(s.way == 0, (i > bound.space) & (alone | (at >= bound.space))).otherwise(alone | (at - T.element_at(s.marks, -1).idx >= bound.space))
            found = T.when(fell & clear(s.hi), _mark(s.hi, True)).when(rose & clear(s.lo), _mark(s.lo, False))
            return T.struct(
                T.when(fell, -1).when(rose, 1).otherwise(s.way).alias("way"), T.when(higher | rose, i).otherwise(s.hi).alias("hi"),
                T.when(lower | fell, i).otherwise(s.lo).alias("lo"), T.when(found.isNotNull(), T.concat(s.marks, T.array(found))).otherwise(s.marks).alias("marks"),
            )

        return T.aggregate(T.sequence(T.lit(1), T.size(line) - 1), start, step, lambda s: T.array_sort(s.marks))

    return T.when(T.size(line) < LEAST_BARS, _none()).otherwise(let(sizes(line), lambda m: let(limits(m), walk)))


def adaptive_order(line: Text) -> Text:
    """2 where one move is over 8 times the mean one, 3 where over 4 times, else a twentieth of the line within 3 and 5 (P10)."""
    m = sizes(line)
    return T.when(T.array_max(m) > 8 * mean(m), 2).when(T.array_max(m) > 4 * mean(m), 3).otherwise(T.greatest(T.lit(3), T.least(T.lit(5), T.floor(T.size(line) / 20).cast("int"))))


@for_columns
def strict_marks(a: Text, order: Text) -> Text:
    """Places strictly beyond all ``order`` values on either side, all highs, then all lows; never an end."""
    inner = T.sequence(T.lit(1), T.size(a) - 2)

    def side(is_high: bool) -> Text:
        def beyond(i: Text) -> Text:
            around = T.concat(part(a, T.greatest(T.lit(0), i - order), i), part(a, i + 1, i + 1 + order))
            return T.get(a, i) > T.array_max(around) if is_high else T.get(a, i) < T.array_min(around)

        return T.transform(T.filter(inner, beyond), lambda i: _mark(i, is_high))

    return T.concat(side(True), side(False))


def scale_marks(line: Text) -> Text:
    """Strict extremes of the smoothed line at orders 2, 3, 5 and the adaptive one; the finer order holds its place within two bars."""
    def all_scales(s: Text) -> Text:
        orders = T.array_sort(T.array_distinct(T.array(*[T.lit(k) for k in SCALES], adaptive_order(line).cast("int"))))
        found = T.flatten(T.transform(orders, lambda k: strict_marks(s, k)))
        kept = lambda marks, m: T.when(T.exists(marks, lambda o: T.abs(o.idx - m.idx) <= 2), marks).otherwise(T.concat(marks, T.array(m)))
        return T.array_sort(T.aggregate(found, _none(), kept))

    return T.when(T.size(line) < LEAST_BARS, _none()).otherwise(let(adaptively_smoothed(line), all_scales))


def segment_marks(line: Text) -> Text:
    """The greatest value above and the least below the mean in each eighth of a line."""
    width = T.greatest(T.lit(5), T.floor(T.size(line) / 8).cast("int"))

    def ends(start: Text) -> Text:
        s = part(line, start, start + width)
        top, low = T.array_max(s), T.array_min(s)
        high_mark = T.when(top > mean(line), _mark(start + first_at(s, top), True))
        return T.array_compact(T.array(high_mark, T.when(low < mean(line), _mark(start + first_at(s, low), False))))

    return T.array_sort(T.flatten(T.transform(T.sequence(T.lit(0), T.size(line) - width, width), ends)))


@for_columns
def without_small(marks: Text, line: Text) -> Text:
    """Highs and lows in turn (W13): of neighbours of a kind the more extreme stays, and a swing under the least one ends none."""
    y = lambda m: T.get(line, m.idx)
    least = T.greatest(T.lit(LEAST_STEP), 1.5 * mean(sizes(line)))
    swap = lambda kept, m: T.concat(part(kept, 0, T.size(kept) - 1), T.array(m))
    add = lambda kept, m: T.concat(kept, T.array(m))
    ahead = lambda m, o: T.when(m.is_high, y(m) - y(o)).otherwise(y(o) - y(m))

    def thin(bound: Text) -> Text:
        def first(kept: Text, m: Text) -> Text:
            o = T.element_at(kept, -1)
            return (
                T.when(T.size(kept) == 0, T.array(m)).when(m.is_high == o.is_high, T.when(ahead(m, o) >= 0, swap(kept, m)).otherwise(kept))
                .when((bound.span > 0) & (T.abs(y(m) - y(o)) >= bound.least * bound.span), add(kept, m)).otherwise(kept)
            )

        def second(kept: Text, m: Text) -> Text:
            o = T.try_element_at(kept, T.lit(-1))
            return T.when(T.size(kept) == 0, T.array(m)).when(m.is_high != o.is_high, add(kept, m)).when(ahead(m, o) > 0, swap(kept, m)).otherwise(kept)

        return T.aggregate(T.aggregate(marks, _none(), first), _none(), second)

    return T.when(T.size(marks) <= 2, marks).otherwise(let(T.struct(least.alias("least"), span(line).alias("span")), thin))


def _nearby(marks: Text, i: Text, line: Text) -> tuple[Text, Text]:
    """Places of the marks before and after mark ``i``, or the ends of the line."""
    return T.coalesce(T.get(marks, i - 1).idx, T.lit(0)), T.coalesce(T.get(marks, i + 1).idx, T.size(line) - 1)


def with_prominence(marks: Text, line: Text) -> Text:
    """idx, is_high, y, and how far each mark stands out between its neighbours as a share of the range."""
    def one(m: Text, i: Text) -> Text:
        before, after = _nearby(marks, i, line)
        near, y = part(line, before, after + 1), T.get(line, m.idx)
        out = T.when(m.is_high, y - T.array_min(near)).otherwise(T.array_max(near) - y)
        return T.struct(m.idx.alias("idx"), m.is_high.alias("is_high"), y.alias("y"), T.when(span(line) > 0, out / span(line)).otherwise(0.0).alias("prominence"))

    return T.transform(marks, one)


def confident(marks: Text, scales: Text, line: Text) -> Text:
    """Pivots with ``confidence`` (W14, J14): .35 prominence, .25 marks of other scales within three bars, .20 distance, .20 range around."""
    n = T.size(line)

    def one(p: Text, i: Text) -> Text:
        before, after = T.get(marks, i - 1).idx, T.get(marks, i + 1).idx
        gap = T.coalesce(T.least(p.idx - before, after - p.idx), n)
        tenth = T.floor(n / 10).cast("int")
        around = part(line, T.greatest(T.lit(0), p.idx - tenth), T.least(n, p.idx + tenth))
        score = (
            0.35 * T.least(T.lit(1.0), 2 * p.prominence) + 0.25 * T.least(T.lit(1.0), count_of(scales, lambda m: T.abs(m.idx - p.idx) <= 3) / 3)
            + 0.20 * T.least(T.lit(1.0), gap / (n * 0.15)) + 0.20 * T.least(T.lit(1.0), 1.5 * span(around) / span(line))
        )
        return T.struct(p.idx.alias("idx"), p.y.alias("y"), p.is_high.alias("is_high"), p.prominence.alias("prominence"), T.when(span(line) > 0, score).otherwise(0.0).alias("confidence"))

    return T.transform(marks, one)


def foremost(pivots: Text, line: Text, keep: int = KEEP) -> Text:
    """The ``keep`` pivots that stand out most, in order; ties go to the later one."""
    def scored(p: Text, i: Text) -> Text:
        step = lambda j: T.coalesce(T.abs(p.y - T.get(pivots, j).y) / span(line), T.lit(0.0))
        out = T.when(p.prominence > 0, p.prominence).otherwise(T.abs(p.y - mean(line)) / span(line))
        return T.struct((0.5 * out + 0.3 * T.greatest(step(i - 1), step(i + 1)) + 0.2).alias("score"), p.idx.alias("at"), p.alias("p"))

    best = T.slice(T.reverse(T.array_sort(T.transform(pivots, scored))), 1, keep)
    return T.when(T.size(pivots) <= keep, pivots).otherwise(T.array_sort(T.transform(best, lambda b: b.p)))


def with_pivots(rows: DataFrame, line: str = "line") -> DataFrame:
    """Adds ``pivots`` (P11): turns of the line; strict extremes of all scales where these are under three; ends of segments where those are, too.

    Prominence, thinning, confidence and the choice of the foremost follow. Lines of under ``LEAST_BARS`` values have none.
    """
    line = T.col(line)
    marks = T.when(T.size("_turns") >= 3, T.col("_turns")).when(T.size("_scales") >= 3, T.col("_scales")).otherwise(without_small(segment_marks(line), line))
    rows = added(rows, {"_turns": zigzag_marks(line), "_scales": scale_marks(line)})
    rows = added(rows, {"_marks": T.when(T.size(line) < LEAST_BARS, _none()).otherwise(marks)})
    # prominence is that among the marks before thinning
    rows = added(rows, {"_all": with_prominence(T.col("_marks"), line), "_thin": without_small(T.col("_marks"), line)})
    stays = T.filter("_all", lambda p: T.exists("_thin", lambda m: (m.idx == p.idx) & (m.is_high == p.is_high)))
    rows = added(added(rows, {"_stays": stays}), {"_sure": confident(T.col("_stays"), T.col("_scales"), line)})
    return added(rows, {"pivots": foremost(T.col("_sure"), line)}).drop("_turns", "_scales", "_marks", "_all", "_thin", "_stays", "_sure")


def of_kind(pivots: Text, high: bool) -> Text:
    return T.filter(pivots, lambda p: p.is_high if high else ~p.is_high)


def values(pivots: Text) -> Text:
    return T.transform(pivots, lambda p: p.y)


def idxs(pivots: Text) -> Text:
    return T.transform(pivots, lambda p: p.idx.cast("double"))


# --- scalars of a line and its pivots ---


def trend(line: Text) -> Text:
    """tanh(slope n / range) |r|."""
    return let(fit(places(line), line), lambda f: T.tanh(f.slope * T.size(line) / (span(line) + 1e-10)) * T.abs(f.r))


def volatility(line: Text) -> Text:
    """Deviation of relative moves."""
    return deviation(T.zip_with(steps(line), part(line, 0, T.size(line) - 1), lambda d, before: d / (before + 1e-10)))


def compression(line: Text) -> Text:
    """1 less the deviation of the second half over the first's."""
    n = T.size(line)
    half = T.floor(n / 2).cast("int")
    two = T.struct(deviation(part(line, 0, half)).alias("a"), deviation(part(line, half, n)).alias("b"))
    return T.when(n < 20, 0.0).otherwise(let(two, lambda s: T.when(s.a == 0, 0.0).otherwise(1 - s.b / s.a)))


def quality(line: Text, pivots: Text) -> Text:
    """.25 pivots up to four + .30 turns between kinds + .25 prominence + .20 evenness of moves (P4); 0 under two pivots."""
    n, m = T.size(pivots), sizes(line)
    turns = T.size(T.filter(T.sequence(T.lit(1), n - 1), lambda i: T.get(pivots, i).is_high != T.get(pivots, i - 1).is_high))
    out = mean(T.filter(T.transform(pivots, lambda p: p.prominence), lambda v: v > 0))
    uneven = let(mean(m), lambda v: deviation(m) / (v + 1e-10))
    score = 0.25 * T.least(T.lit(1.0), n / 4) + 0.30 * turns / T.greatest(T.lit(1), n - 1) + 0.25 * T.least(T.lit(1.0), 5 * out) + 0.20 * T.greatest(T.lit(0.0), 1 - uneven / 3)
    return T.when((n < 2) | (span(line) < 1e-10), 0.0).otherwise(score)


def legs(pivots: Text, n: Text) -> Text:
    """dx (as a share of the line), dy of each leg between pivots."""
    return T.transform(T.sequence(T.lit(1), T.greatest(T.lit(1), T.size(pivots) - 1)), lambda i: T.struct(((T.get(pivots, i).idx - T.get(pivots, i - 1).idx) / n).alias("dx"), (T.get(pivots, i).y - T.get(pivots, i - 1).y).alias("dy")))


def _legs_or_none(pivots: Text, n: Text, body: Callable[[Text], Text]) -> Text:
    return T.when(T.size(pivots) < 2, T.array().cast("array<double>")).otherwise(let(legs(pivots, n), body))


def slopes(pivots: Text, n: Text) -> Text:
    """tanh(dy / dx) of each leg."""
    return _legs_or_none(pivots, n, lambda a: T.transform(a, lambda v: T.tanh(v.dy / (v.dx + 1e-10))))


def angles(pivots: Text, n: Text) -> Text:
    """The turn from each leg to the next as a share of a half circle."""
    def turns(a: Text) -> Text:
        both = T.zip_with(part(a, 0, T.size(a) - 1), part(a, 1, T.size(a)), lambda u, v: T.atan2(u.dx * v.dy - u.dy * v.dx, u.dx * v.dx + u.dy * v.dy) / T.pi())
        return T.when(T.size(a) < 2, T.array().cast("array<double>")).otherwise(both)

    return _legs_or_none(pivots, n, turns)


def distances(pivots: Text, n: Text) -> Text:
    """Each leg's length as a share of all."""
    lengths = lambda a: T.transform(a, lambda v: T.sqrt(v.dx * v.dx + v.dy * v.dy))
    return _legs_or_none(pivots, n, lambda a: let(lengths(a), lambda d: let(total(d), lambda t: T.transform(d, lambda x: T.when(t > 0, x / t).otherwise(x)))))


def sequence_of(pivots: Text) -> Text:
    """Pivot values from 0 to 1."""
    v = values(pivots)
    return T.when(T.size(v) == 0, T.array().cast("array<double>")).otherwise(let(T.struct(T.array_min(v).alias("lo"), span(v).alias("span")), lambda s: T.transform(v, lambda y: T.when(s.span > 0, (y - s.lo) / s.span).otherwise(y))))


def symmetry(pivots: Text) -> Text:
    """How alike the halves of the pivots are when one is turned round (P5); 0 under four pivots."""
    n = T.size(pivots)
    half = T.floor(n / 2).cast("int")
    pairs = T.zip_with(part(pivots, 0, half), part(T.reverse(pivots), 0, half), lambda p, q: 0.5 * (1 - T.least(T.lit(1.0), T.abs(p.y - q.y))) + T.when(p.is_high == q.is_high, 0.5).otherwise(0.0))
    return T.when(n < 4, 0.0).otherwise(mean(pairs))


def convergence(pivots: Text) -> Text:
    """The part of the first spread between a high and a low that is gone in the last, within -1 and 1."""
    h, low = values(of_kind(pivots, True)), values(of_kind(pivots, False))
    spreads = T.struct(T.abs(T.get(h, 0) - T.get(low, 0)).alias("a"), T.abs(T.element_at(h, -1) - T.element_at(low, -1)).alias("b"))
    closer = let(spreads, lambda s: T.when(s.a > 0, T.greatest(T.lit(-1.0), T.least(T.lit(1.0), (s.a - s.b) / s.a))).otherwise(0.0))
    return T.when((T.size(h) < 2) | (T.size(low) < 2), 0.0).otherwise(closer)


def breakout_strength(line: Text) -> Text:
    """.3 move of the last quarter + .3 growth of its moves' deviation + .4 break out of the range before (P7); 0 under 15 values."""
    n = T.size(line)
    cut = T.floor(n * 0.75).cast("int")
    body, tail = part(line, 0, cut), part(line, cut, n)
    last = T.get(line, n - 1)
    out = T.greatest(T.lit(0.0), last - T.array_max(body)) + T.greatest(T.lit(0.0), T.array_min(body) - last)
    grown = T.least(T.lit(3.0), deviation(steps(tail)) / (deviation(steps(body)) + 1e-10)) / 3
    return T.when(n < 15, 0.0).otherwise(T.least(T.lit(1.0), 0.3 * T.abs(last - T.get(line, cut)) + 0.3 * grown + 0.4 * out))


def volume_confirmation(volumes: Text, pivots: Text, n: Text) -> Text:
    """Volume at the pivots (rescaled to bars, J19), in the second half and in the last 15 % against the mean."""
    m = T.size(volumes)
    at = T.transform(pivots, lambda p: T.get(volumes, T.least(m - 1, T.floor(p.idx * m / n).cast("int"))))
    half, tail = T.floor(m / 2).cast("int"), T.floor(m * 0.85).cast("int")
    ratio = lambda a, b: T.when(b > 0, a / b).otherwise(1.0)
    score = let(mean(volumes), lambda v: (
        0.3 * T.least(T.lit(1.5), T.when(T.size(at) > 0, ratio(mean(at), v)).otherwise(1.0)) / 1.5
        + 0.3 * T.least(T.lit(1.5), ratio(mean(part(volumes, half, m)), mean(part(volumes, 0, half)))) / 1.5 + 0.4 * T.least(T.lit(2.0), ratio(mean(part(volumes, tail, m)), v)) / 2
    ))
    return T.when((m < 10) | (total(volumes) == 0), 0.5).otherwise(T.least(T.lit(1.0), score))


def swing_share(pivots: Text, high: bool, up: bool) -> Text:
    """The share of steps between pivots of a kind that go up (or down); 0 under two."""
    d = steps(values(of_kind(pivots, high)))
    n = T.size(of_kind(pivots, high))
    return T.when(n < 2, 0.0).otherwise(count_of(d, (lambda x: x > 0) if up else (lambda x: x < 0)) / (n - 1))


def consistency(pivots: Text) -> Text:
    """Mean over highs and lows of the greater share of rising or falling steps (P9); 0 under three pivots."""
    both = [T.greatest(swing_share(pivots, high, True), swing_share(pivots, high, False)) for high in (True, False)]
    return T.when(T.size(pivots) < 3, 0.0).otherwise((both[0] + both[1]) / 2)


def with_scalars(rows: DataFrame) -> DataFrame:
    """All scalars and sequences of a series with ``line``, ``pivots`` and ``volumes``."""
    line, pivots = T.col("line"), T.col("pivots")
    n = T.size(line)
    return added(rows, {
        "trend": trend(line), "volatility": volatility(line), "compression": compression(line), "quality": quality(line, pivots), "symmetry": symmetry(pivots), "convergence": convergence(pivots),
        "breakout_strength": breakout_strength(line), "volume_confirmation": volume_confirmation(T.col("volumes"), pivots, n), "consistency": consistency(pivots), "slopes": slopes(pivots, n), "angles": angles(pivots, n),
        "distances": distances(pivots, n), "sequence": sequence_of(pivots), "pivot_confidence": T.when(T.size(pivots) > 0, mean(T.transform(pivots, lambda p: p.confidence))).otherwise(0.5),
    })


def feature_vector(line: Text, sequence: Text, shares: Text, scalars: list[Text]) -> Text:
    """100 line values, 10 pivot values, 9 leg shares (filled with zeros) and three scalars, weighed .35, .30, .20, .15 (A3)."""
    filled = lambda a, n: T.slice(T.concat(a, T.array_repeat(T.lit(0.0), n)), 1, n)
    weighed = lambda a, w: T.transform(a, lambda x: x * w)
    return T.concat(weighed(line, 0.35), weighed(filled(sequence, 10), 0.30), weighed(filled(shares, 9), 0.20), weighed(T.array(*scalars), 0.15))
