"""Chart structures of packed lines and their pivots, the choice among them, and their confirmation bar by bar.

Every detector is a column expression: a struct of type, confidence and active (whether the tail of the line has not left it), or null.
Geometry that serves both lines from 0 to 1 and raw prices takes the values, their pivots and a scale of volatility (0 for lines), and
gives a candidate: where it is complete, and the level or the pair of lines that prices must break. ``R`` is the range of the values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from strandline.functions import texts as T
from strandline.functions.texts import Text, added, for_columns
from strandline.operators import packed
from strandline.operators.packed import count_of, first_at, fit, idxs, let, mean, of_kind, part, places, span, steps, values

#: Tolerances as shares of the range, least confidences, and the bars and retreat of a confirmation.
DOUBLE_OFF, DOUBLE_DEPTH, LEVEL_CONFIDENCE = 0.03, 0.12, 0.45
TRIPLE_OFF, TRIPLE_RELAXED, TRIPLE_DEPTH = 0.035, 0.06, 0.10
SHOULDERS, HEAD, HEAD_RATIO, DEPTH_RATIO, HEAD_CONFIDENCE = 0.18, 0.06, (0.4, 0.95), (0.15, 0.85), 0.5
WEDGE_CONVERGENCE, WEDGE_FIT = 0.15, 0.7
TRIANGLE_CONVERGENCE, TRIANGLE_RATE, TRIANGLE_FIT, TRIANGLE_CONFIDENCE = (0.15, 0.95), 3.0, 0.75, 0.45
CHANNEL_FIT, CHANNEL_PARALLEL, CHANNEL_CONFIDENCE = 0.80, 0.05, 0.45
CUP_RIM, CUP_DEPTH, CUP_HANDLE, CUP_RELAXED_HANDLE = 0.06, 0.08, 0.5, 0.7
POLE, PENNANT_CONVERGENCE, ROUND_DEPTH = 0.12, 0.15, 0.10
CONFIRM_BARS, RETREAT = 1, 0.5
SCALE_SHARE, FIT_SHARE = 0.5, 2.0
#: Types in the order in which a confirmed one is preferred to the line's own type.
SPECIAL = ("triple_top", "triple_bottom", "cup_and_handle", "pennant", "rounding_bottom")

_FOUND = "struct<type: string, confidence: double, active: boolean>"
_LEVEL = "struct<confidence: double, at: int, way: string, level: double, height: double>"


def _one(v: Text | float) -> Text:
    return T.least(T.lit(1.0), v)


def _pick(found: Text) -> Text:
    """The first of the structs with the greatest confidence (T7); null without any."""
    some = lambda a: T.get(T.filter(a, lambda c: c.confidence == T.array_max(T.transform(a, lambda o: o.confidence))), T.lit(0))
    return let(T.array_compact(found), some)


def _pairs(a: Text) -> Text:
    """All pairs of an array in order."""
    return T.flatten(T.transform(a, lambda p, i: T.transform(part(a, i + 1, T.size(a)), lambda q: T.struct(p.alias("p"), q.alias("q")))))


def _between(pivots: Text, high: bool, a: Text, b: Text) -> Text:
    """Values of the pivots of a kind strictly between two."""
    return values(T.filter(of_kind(pivots, high), lambda p: (p.idx > a.idx) & (p.idx < b.idx)))


def _holds(line: Text, start: Text, left: Callable[[Text, Text], Text], least: int = 3) -> Text:
    """Whether at most half of the values from ``start`` on (by value and place) have left; a tail of under ``least`` values holds."""
    tail = T.transform(T.sequence(start.cast("int"), T.size(line) - 1), lambda i: left(T.get(line, i), i))
    out = let(tail, lambda t: T.when(T.size(t) >= least, count_of(t, lambda x: x) <= 0.5 * T.size(t)).otherwise(True))
    return T.when(start >= T.size(line), True).otherwise(out)


def _found(kind: Text | str, confidence: Text, active: Text | bool = True) -> Text:
    lit = lambda v: T.lit(v) if isinstance(v, (str, bool)) else v
    return T.struct(lit(kind).alias("type"), confidence.cast("double").alias("confidence"), lit(active).alias("active"))


def _level(confidence: Text, at: Text, way: str, level: Text, height: Text) -> Text:
    return T.struct(confidence.alias("confidence"), at.cast("int").alias("at"), T.lit(way).alias("way"), level.alias("level"), height.alias("height"))


# --- geometry: levels ---


@for_columns
def double(y: Text, pivots: Text, high: bool, scale: Text | None = None) -> Text:
    """Two pivots of a kind at one height with an opposite one of depth between them."""
    sign, way = (1, "down") if high else (-1, "up")
    bound = T.greatest(DOUBLE_OFF * span(y), SCALE_SHARE * (T.lit(0.0) if scale is None else scale))

    def all_pairs(e: Text) -> Text:
        def one(two: Text) -> Text:
            inner = _between(pivots, not high, two.p, two.q)
            neck = T.array_min(inner) if high else T.array_max(inner)
            off, depth = T.abs(two.p.y - two.q.y), sign * (two.p.y - neck)
            near = (off < e.bound) & (depth / e.span > DOUBLE_DEPTH)
            return T.when(near, _level(0.5 * (1 - off / e.bound) + 0.5 * _one(depth / e.span / 0.3), two.q.idx, way, neck, depth))

        return _pick(T.transform(_pairs(of_kind(pivots, high)), one))

    return T.when(span(y) > 0, let(T.struct(span(y).alias("span"), bound.alias("bound")), all_pairs))


@for_columns
def triple(y: Text, pivots: Text, high: bool, scale: Text | None = None) -> Text:
    """Three pivots of a kind at one height with opposite ones of depth between (D17, D18); deep tops may be more uneven."""
    sign, way = (1, "down") if high else (-1, "up")
    bound = T.greatest(TRIPLE_OFF * span(y), SCALE_SHARE * (T.lit(0.0) if scale is None else scale))

    def all_triples(e: Text) -> Text:
        def one(p: Text, q: Text, r: Text) -> Text:
            first, second = _between(pivots, not high, p, q), _between(pivots, not high, q, r)
            inner = T.concat(first, second)
            neck = T.array_min(inner) if high else T.array_max(inner)
            three = T.array(p.y, q.y, r.y)
            depth, off = sign * (mean(three) - neck), span(three)
            most = T.when(depth / e.span > 0.15, T.greatest(TRIPLE_RELAXED * e.span, e.bound)).otherwise(e.bound) if high else e.bound
            near = (T.size(first) > 0) & (T.size(second) > 0) & (depth / e.span > TRIPLE_DEPTH) & (off < most)
            return T.when(near, _level(0.5 * (1 - off / most) + 0.5 * _one(depth / e.span / 0.3), r.idx, way, neck, depth))

        k = of_kind(pivots, high)
        nested = T.transform(_pairs(k), lambda two: T.transform(T.filter(k, lambda r: r.idx > two.q.idx), lambda r: one(two.p, two.q, r)))
        return _pick(T.flatten(nested))

    return T.when(span(y) > 0, let(T.struct(span(y).alias("span"), bound.alias("bound")), all_triples))


def _heads(y: Text, pivots: Text, high: bool, weigh: Callable[..., Text]) -> Text:
    """Consecutive pivots of a kind with the middle one beyond both (J9); ``weigh`` gives the confidence, null where it is none."""
    sign, way, k = (1, "down", of_kind(pivots, high)) if high else (-1, "up", of_kind(pivots, high))

    def one(i: Text) -> Text:
        left, head, right = T.get(k, i), T.get(k, i + 1), T.get(k, i + 2)
        beyond = T.least(sign * (head.y - left.y), sign * (head.y - right.y)) / span(y)
        off, neck = T.abs(left.y - right.y) / span(y), _between(pivots, not high, left, right)
        sure = weigh(left, head, right, off, beyond, neck)
        out = _level(sure, right.idx, way, T.when(T.size(neck) > 0, mean(neck)), T.abs(head.y - mean(neck)))
        return T.when((off < SHOULDERS) & (beyond > HEAD) & sure.isNotNull(), out)

    return T.when((span(y) > 0) & (T.size(k) >= 3), _pick(T.transform(T.sequence(T.lit(0), T.greatest(T.lit(0), T.size(k) - 3)), one)))


def head_shoulders(y: Text, pivots: Text, high: bool) -> Text:
    """Head and shoulders of a line (D4, D5), with the neck, proportions and times weighed."""
    def weigh(left: Text, head: Text, right: Text, off: Text, beyond: Text, neck: Text) -> Text:
        sure = 0.3 * (1 - off / SHOULDERS) + 0.4 * _one(beyond / 0.15) + T.when(T.size(neck) >= 2, 0.2).otherwise(0.0) + 0.1
        middle = (left.y + right.y) / 2
        if high:
            ratio, (low, top) = T.when(head.y > 0, middle / head.y).otherwise(0.0), HEAD_RATIO
        else:
            ratio, (low, top) = T.when((T.size(neck) > 0) & (mean(neck) > head.y), (mean(neck) - middle) / (mean(neck) - head.y)), DEPTH_RATIO
        times = head.idx - left.idx, right.idx - head.idx
        sure = T.when((ratio < low) | (ratio > top), 0.6).otherwise(1.0) * sure
        return sure * T.when(T.least(*times) / T.greatest(*times) < 0.3, 0.7).otherwise(1.0)

    return _heads(y, pivots, high, weigh)


def head_shoulders_of_prices(y: Text, pivots: Text, high: bool) -> Text:
    """Head and shoulders that has a neck to break."""
    return _heads(y, pivots, high, lambda left, head, right, off, beyond, neck: T.when(T.size(neck) > 0, 0.4 * (1 - off / SHOULDERS) + 0.4 * _one(beyond / 0.15) + 0.2))


def cup(y: Text, pivots: Text, scale: Text | None = None) -> Text:
    """A cup between two rims and the first low after it as its handle (D19); else ``_wide_cup``."""
    lows, r = of_kind(pivots, False), span(y)
    bound = T.greatest(CUP_RIM * r, SCALE_SHARE * (T.lit(0.0) if scale is None else scale))

    def one(two: Text) -> Text:
        inner = T.filter(lows, lambda p: (p.idx > two.p.idx) & (p.idx < two.q.idx))
        bottom, handle = _lowest(inner), T.get(T.filter(lows, lambda p: p.idx > two.q.idx), T.lit(0))
        rim, half = T.least(two.p.y, two.q.y), (two.q.idx - two.p.idx) / 2
        depth, even = rim - bottom.y, 1 - _one(T.abs(bottom.idx - (two.p.idx + two.q.idx) / 2) / half)
        back = (two.q.y - handle.y) / T.greatest(depth, T.lit(1e-9))
        fits = (two.q.idx - two.p.idx >= 8) & (T.abs(two.p.y - two.q.y) < bound) & (depth / r >= CUP_DEPTH) & (even >= 0.3) & back.between(0.0, CUP_HANDLE)
        return T.when(fits, _level(0.4 * even + 0.3 * (1 - back) + 0.3 * _one(depth / r / 0.3), handle.idx, "up", T.greatest(two.p.y, two.q.y), depth))

    strict = _pick(T.transform(_pairs(of_kind(pivots, True)), one))
    return T.when(r > 0, let(strict, lambda s: T.coalesce(s, _wide_cup(y, lows))))


def _lowest(pivots: Text) -> Text:
    """The first of the pivots with the least value; null without any."""
    return T.get(T.filter(pivots, lambda p: p.y == T.array_min(values(pivots))), T.lit(0))


def _wide_cup(y: Text, lows: Text) -> Text:
    """A cup whose rims are the highest values before its bottom and about as far behind it, with a shallow handle or none."""
    n, r = T.size(y), span(y)

    def around(b: Text) -> Text:
        rim = T.array_max(part(y, 0, b.idx))
        return T.struct(b.idx.alias("at"), b.y.alias("y"), first_at(y, rim).alias("left"), rim.alias("left_y"))

    def right(s: Text) -> Text:
        wide = s.at - s.left
        start, end = s.at + T.greatest(T.lit(2), T.floor(0.6 * wide)), T.least(n, s.at + T.floor(1.4 * wide) + 1)
        near = part(y, start, end)
        return T.struct(s.at.alias("at"), s.y.alias("y"), s.left.alias("left"), s.left_y.alias("left_y"), (start + first_at(near, T.array_max(near))).cast("int").alias("right"), T.array_max(near).alias("right_y"), wide.alias("wide"))

    def judged(s: Text) -> Text:
        rim, half = T.least(s.left_y, s.right_y), (s.right - s.left) / 2
        depth, even = rim - s.y, 1 - _one(T.abs(s.at - (s.left + s.right) / 2) / T.greatest(half, T.lit(1e-9)))
        tail = part(y, s.right + 1, n)
        handled = T.size(tail) >= 2
        low = T.array_min(tail)
        back = T.when(handled, (s.right_y - low) / T.greatest(depth, T.lit(1e-9))).otherwise(0.0)
        at = T.when(handled, s.right + 1 + first_at(tail, low)).otherwise(s.right)
        fits = (s.left <= 0.40 * n) & (s.wide >= 4) & (s.right >= 0.55 * n) & (depth / r >= CUP_DEPTH) & (T.abs(s.left_y - s.right_y) / r < 0.10) & (even >= 0.3) & (back <= CUP_RELAXED_HANDLE)
        calm = T.when(back > 0, 1 - _one(back)).otherwise(0.7)
        return T.when(fits, _level(0.9 * (0.4 * even + 0.3 * calm + 0.3 * _one(depth / r / 0.3)), at, "up", T.greatest(s.left_y, s.right_y), depth))

    bottom = _lowest(T.filter(lows, lambda p: (p.idx > 0.15 * n) & (p.idx < 0.85 * n)))
    inside = lambda b: T.when((n >= 20) & (b.idx >= 6) & (b.idx <= n - 6), let(let(around(b), right), judged))
    return let(bottom, inside)


def pennant(y: Text) -> Text:
    """A pole up within the first part of the values, then swings that narrow."""
    n = T.size(y)
    head = part(y, 0, T.greatest(T.lit(10), T.floor(n * 0.6)))

    def pole(low: Text) -> Text:
        after = part(head, low, T.size(head))
        return T.struct(low.alias("low"), (low + first_at(after, T.array_max(after))).alias("top"), T.size(after).alias("left"))

    def judged(s: Text) -> Text:
        move = (T.get(y, s.top) - T.get(y, s.low)) / T.greatest(T.get(y, s.low), T.lit(1e-9))
        end = T.least(n - 1, s.top + T.greatest(T.lit(8), T.floor(0.65 * (n - s.top))))
        region = part(y, s.top, end)
        half = T.floor(T.size(region) / 2)
        narrower = 1 - span(part(region, half, T.size(region))) / span(part(region, 0, half))
        wide = span(part(region, 0, half)) > 0
        fits = (s.left >= 3) & (s.top > s.low) & (move >= POLE) & (n - s.top >= 10) & (T.size(region) >= 8) & wide
        sure = T.when(wide, 0.5 * _one(move / 0.25) + 0.5 * _one(narrower))
        height = T.greatest(T.get(y, s.top) - T.get(y, s.low), 0.03 * span(y))
        return T.when(fits, T.when(T.when(wide, narrower) >= PENNANT_CONVERGENCE, _level(sure, end - 1, "up", T.get(y, s.top), height)))

    return T.when((n >= 20) & (span(y) > 0), let(let(first_at(head, T.array_min(head)), pole), judged))


@for_columns
def parabola(y: Text) -> Text:
    """a (the curvature) and the mean absolute residuals of a fitted parabola and line (G4); places are even, so odd sums vanish."""
    n = T.size(y)
    x = T.transform(T.sequence(T.lit(0), n - 1), lambda i: i - (n - 1) / 2)
    power = lambda k: packed.total(T.transform(x, lambda v: v**k))
    with_y = lambda k: packed.total(T.zip_with(x, y, lambda v, w: v**k * w))
    sums = T.struct(n.alias("n"), power(2).alias("s2"), power(4).alias("s4"), packed.total(y).alias("y"), with_y(1).alias("xy"), with_y(2).alias("xxy"))

    def solved(s: Text) -> Text:
        a = (s.n * s.xxy - s.s2 * s.y) / (s.n * s.s4 - s.s2 * s.s2)
        return T.struct(a.alias("a"), (s.xy / s.s2).alias("b"), ((s.y - a * s.s2) / s.n).alias("c"), (s.y / s.n).alias("mean"))

    off = lambda s, curved: mean(T.zip_with(x, y, lambda v, w: T.abs(w - (s.a * v * v + s.b * v + s.c if curved else s.b * v + s.mean))))
    return let(let(sums, solved), lambda s: T.struct(s.a.alias("a"), off(s, True).alias("off"), off(s, False).alias("line_off")))


def rounding(y: Text, pivots: Text, scale: Text | None = None) -> Text:
    """The lowest pivot in the middle third, and a parabola from the rim before it to as far behind it that fits far better than a line."""
    n, r = T.size(y), span(y)
    most = T.greatest(r, FIT_SHARE * (T.lit(0.0) if scale is None else scale))

    def judged(s: Text) -> Text:
        def fitted(f: Text) -> Text:
            smooth, depth = T.greatest(T.lit(0.0), 1 - f.off / most), s.rim.y - s.low.y
            fits = (f.a > 0) & (smooth >= 0.6) & (f.off <= 0.6 * f.line_off)
            return T.when(fits, _level(0.5 * _one(depth / r / 0.3) + 0.5 * smooth, s.low.idx, "up", s.rim.y, depth))

        end = T.least(n - 1, 2 * s.low.idx - s.rim.idx)
        fits = (s.low.idx >= 0.35 * n) & (s.low.idx <= 0.65 * n) & ((s.rim.y - s.low.y) / r >= ROUND_DEPTH) & (end - s.rim.idx >= 6)
        return T.when(fits, let(parabola(part(y, s.rim.idx, end + 1)), fitted))

    def rim(low: Text) -> Text:
        before = T.filter(of_kind(pivots, True), lambda p: p.idx < low.idx)
        return T.struct(low.alias("low"), T.get(T.filter(before, lambda p: p.y == T.array_max(values(before))), T.lit(0)).alias("rim"))

    return T.when((n >= 20) & (r > 0), let(let(_lowest(of_kind(pivots, False)), rim), judged))


# --- geometry: pairs of lines ---


def pivot_lines(y: Text, pivots: Text, scale: Text | None = None) -> Text:
    """Lines through the highs and through the lows (C1): h, l, the gaps at first and last place, and the fit; null under two of a kind."""
    h, low = of_kind(pivots, True), of_kind(pivots, False)
    first, last = T.get(pivots, T.lit(0)).idx, T.greatest(T.element_at(pivots, -1).idx, T.size(y) - 1)
    most = T.greatest(span(y), FIT_SHARE * (T.lit(0.0) if scale is None else scale))
    two = T.struct(fit(idxs(h), values(h)).alias("h"), fit(idxs(low), values(low)).alias("l"))

    def gaps(s: Text) -> Text:
        gap = lambda x: s.h.base + s.h.slope * x - s.l.base - s.l.slope * x
        return T.struct(s.h.alias("h"), s.l.alias("l"), gap(first).alias("gap0"), gap(last).alias("gap1"), first.alias("x0"), last.alias("x1"), T.greatest(T.lit(0.0), 1 - (s.h.off + s.l.off) / (2 * most)).alias("fit"))

    return T.when((T.size(h) >= 2) & (T.size(low) >= 2) & (span(y) > 0), let(two, gaps))


def _inside(line: Text, s: Text) -> Text:
    """Whether the last 15 % stay between two lines, but for .02 of the range."""
    margin = 0.02 * span(line)
    out = lambda v, i: (v > s.h.base + s.h.slope * i + margin) | (v < s.l.base + s.l.slope * i - margin)
    return _holds(line, T.floor(T.size(line) * 0.85), out, 1)


def wedge(line: Text, pivots: Text) -> Text:
    """Both lines rise, or both fall, and come together."""
    def judged(s: Text) -> Text:
        closer = 1 - s.gap1 / s.gap0
        kind = T.when((s.h.slope > 0) & (s.l.slope > 0), "rising_wedge").when((s.h.slope < 0) & (s.l.slope < 0), "falling_wedge")
        fits = kind.isNotNull() & (s.gap0 > 0) & (s.gap1 > 0)
        sure = _one(0.4 * closer + 0.4 * s.fit + 0.2)
        return T.when(fits, T.when((closer >= WEDGE_CONVERGENCE) & (s.fit >= WEDGE_FIT), _found(kind, sure, _inside(line, s))))

    return let(pivot_lines(line, pivots), judged)


def triangle(line: Text, pivots: Text, squeeze: Text) -> Text:
    """Lines that come together, one of them or neither flat (D9); the type tells which."""
    n, r = T.size(line), span(line)
    half = T.floor(n / 2)
    h, low = values(of_kind(pivots, True)), values(of_kind(pivots, False))
    halves = T.array(span(part(line, 0, half)), span(part(line, half, n)))
    even = (T.array_min(halves) <= 0) | (T.array_max(halves) <= 3.0 * T.array_min(halves))
    # no pivot far beyond the others of its kind
    alone = lambda a, end: T.when(T.size(a) >= 3, T.abs(T.element_at(T.array_sort(a), end) - T.element_at(T.array_sort(a), end + (1 if end > 0 else -1))) / r > 0.4).otherwise(False)
    share = lambda a, test: T.when(T.size(a) >= 3, count_of(steps(a), test) / (T.size(a) - 1)).otherwise(1.0)
    calm = (T.abs(T.element_at(line, -1) - T.get(line, T.lit(0))) / r <= 0.35) & even & ~alone(h, -1) & ~alone(low, 1)

    def judged(s: Text) -> Text:
        steady = ~((s.h.slope < 0) & (share(h, lambda d: d < 0) < 0.5)) & ~((s.l.slope > 0) & (share(low, lambda d: d > 0) < 0.5))
        both = (s.h.slope < 0) & (s.l.slope > 0)
        falls = (s.h.slope < 0) & (T.abs(s.l.slope) < 0.3 * T.abs(s.h.slope))
        rises = (s.l.slope > 0) & (T.abs(s.h.slope) < 0.3 * T.abs(s.l.slope))
        kind = T.when(rises, "ascending_triangle").when(falls, "descending_triangle").when(both, "symmetrical_triangle")
        h2, l2 = s.h.r * s.h.r, s.l.r * s.l.r
        straight = ~(both & ((h2 < 0.3) | (l2 < 0.3))) & ~(falls & (h2 < 0.4)) & ~(rises & (l2 < 0.4))
        closer = 1 - s.gap1 / s.gap0
        rate = T.when(s.x1 > s.x0, closer * n / (s.x1 - s.x0) <= TRIANGLE_RATE).otherwise(True)
        sure = _one(0.35 * closer + 0.35 * s.fit + 0.2 * _one(T.size(pivots) / 6) + 0.1 * T.greatest(T.lit(0.0), squeeze))
        fits = closer.between(*TRIANGLE_CONVERGENCE) & (s.gap1 >= 0) & rate & (s.fit >= TRIANGLE_FIT) & straight & (sure > TRIANGLE_CONFIDENCE)
        return T.when(calm & kind.isNotNull() & steady & (s.gap0 > 0), T.when(fits, _found(kind, sure, _inside(line, s))))

    return let(pivot_lines(line, pivots), judged)


def channel(line: Text, pivots: Text) -> Text:
    """Lines of like slope at an even distance (D10); the mean slope tells up, down or horizontal."""
    long = T.greatest(T.lit(1), T.size(line) - 1)

    def judged(s: Text) -> Text:
        rise = lambda f: f.slope * long / span(line)
        off = T.abs(rise(s.h) - rise(s.l))
        relative = off / T.greatest(T.abs(rise(s.h)), T.abs(rise(s.l)), T.lit(0.1))
        wider = T.abs(1 - s.gap1 / s.gap0)
        middle = (rise(s.h) + rise(s.l)) / 2
        kind = T.when(middle > 0.15, "channel_up").when(middle < -0.15, "channel_down").otherwise("horizontal_channel")
        sure = _one(0.5 * s.fit + 0.2 * (1 - _one(relative)) + 0.1 * (1 - wider) + 0.2)
        parallel = (relative <= CHANNEL_PARALLEL) | (off <= 0.1)
        return T.when((s.fit >= CHANNEL_FIT) & parallel & (s.gap0 > 0) & (s.gap1 > 0), T.when((wider <= 0.4) & (sure > CHANNEL_CONFIDENCE), _found(kind, sure, _inside(line, s))))

    return let(pivot_lines(line, pivots), judged)


# --- moves ---


def impulse(line: Text) -> Text:
    """A move of .55 of the range within a fifth of the line, mostly one way, after or before a calm part."""
    n, r = T.size(line), span(line)
    wide = T.greatest(T.lit(3), T.floor(n / 5)).cast("int")

    def one(start: Text) -> Text:
        end = start + wide
        move = T.get(line, end) - T.get(line, start)
        same = count_of(steps(part(line, start, end + 1)), lambda d: d * move > 0) / wide
        calm = lambda a, long: T.when(long & (T.size(a) > 3), span(a) / r < 0.35).otherwise(True)
        fits = (T.abs(move) / r >= 0.55) & (calm(part(line, 0, start), start > 3) | calm(part(line, end, n), end < n - 3)) & (same >= 0.6)
        return T.when(fits, _found(T.when(move > 0, "impulse_up").otherwise("impulse_down"), _one(0.5 * T.abs(move) / r + 0.3 * same + 0.2)))

    best = _pick(T.transform(T.sequence(T.lit(0), T.greatest(T.lit(0), n - wide - 1)), one))
    return T.when((n >= 15) & (r > 0), let(best, lambda b: T.when(b.confidence > 0.55, b)))


def flag(line: Text) -> Text:
    """A pole up to .3, .4 or .5 of the line, then a narrow drift against it."""
    n, r = T.size(line), span(line)

    def one(share: float) -> Text:
        cut = T.floor(n * share).cast("int")
        rest = part(line, cut, n)
        pole, drift = T.get(line, cut - 1) - T.get(line, T.lit(0)), T.element_at(rest, -1) - T.get(rest, T.lit(0))
        kind = T.when((pole > 0) & (drift <= 0), "bull_flag").when((pole < 0) & (drift >= 0), "bear_flag")
        fits = kind.isNotNull() & (T.abs(pole) / r >= 0.35) & (span(rest) / r <= 0.45)
        sure = 0.5 * T.abs(pole) / r + 0.3 * (1 - span(rest) / r) + 0.2
        return T.when(fits, T.struct(sure.alias("confidence"), kind.alias("type"), T.array_max(rest).alias("high"), T.array_min(rest).alias("low")))

    def judged(b: Text) -> Text:
        wide = b.high - b.low
        sure = T.when((wide > 0) & (r - wide < 1.5 * wide), 0.7).otherwise(1.0) * b.confidence
        tail = part(line, T.floor(n * 0.85), n)
        left = T.when(b.type == "bull_flag", mean(tail) > b.high + 0.03 * r).otherwise(mean(tail) < b.low - 0.03 * r)
        return T.when(b.confidence > 0.5, _found(b.type, sure, ~(left & (T.size(tail) > 2))))

    return T.when((n >= 20) & (r > 0), let(_pick(T.array(*[one(s) for s in (0.3, 0.4, 0.5)])), judged))


def squeeze(line: Text, pivots: Text) -> Text:
    """Flat highs over rising lows, or flat lows under falling highs, with little net move."""
    h, low, r = values(of_kind(pivots, True)), values(of_kind(pivots, False)), span(line)
    moved = lambda a: (T.element_at(a, -1) - T.get(a, T.lit(0))) / r
    weigh = lambda flat, rise: 0.4 * (1 - flat / r / 0.2) + 0.4 * _one(T.abs(rise) / 0.25) + 0.2
    some = (T.size(h) >= 2) & (T.size(low) >= 2) & (r > 0)
    calm = T.abs(T.element_at(line, -1) - T.get(line, T.lit(0))) / r <= 0.4
    up, down = (span(h) / r < 0.2) & (moved(low) > 0.1), (span(low) / r < 0.2) & (moved(h) < -0.1)
    return T.when(some, T.when(calm & up, _found("squeeze_up", weigh(span(h), moved(low)))).when(calm & down, _found("squeeze_down", weigh(span(low), moved(h)))))


def trending(line: Text, pivots: Text, lean: Text) -> Text:
    """A trend by its move, swings and straightness (D11), stale once the last fifth goes against it or much of it is lost."""
    n, r = T.size(line), span(line)
    first, last = T.get(line, T.lit(0)), T.element_at(line, -1)
    few = (T.size(of_kind(pivots, True)) < 2) | (T.size(of_kind(pivots, False)) < 2)
    shares = {c: packed.swing_share(pivots, high, up) for c, high, up in (("hh", True, True), ("lh", True, False), ("hl", False, True), ("ll", False, False))}
    seen = T.struct(((last - first) / r).alias("move"), fit(places(line), line).r.alias("r"), few.alias("few"), lean.alias("lean"), *[v.alias(c) for c, v in shares.items()])

    def judged(s: Text) -> Text:
        r2, size = s.r * s.r, T.abs(s.move)
        mixed = lambda a, b: 0.35 * _one(size) + 0.35 * (a + b) / 2 + 0.3 * r2
        swings = lambda a, b: ((a >= 0.5) | (b >= 0.5)) & (mixed(a, b) > 0.35)
        way = lambda v: T.when(v > 0, "trend_up").otherwise("trend_down")
        made = lambda kind, sure: T.struct(kind.alias("type"), _one(sure).alias("confidence"))
        return (
            T.when(s.few, T.when((size > 0.4) & (T.abs(s.lean) > 0.3), made(way(s.lean), 0.5 * size + 0.5 * T.abs(s.lean))))
            .when((s.move > 0.15) & swings(s.hh, s.hl), made(T.lit("trend_up"), mixed(s.hh, s.hl)))
            .when((s.move < -0.15) & swings(s.lh, s.ll), made(T.lit("trend_down"), mixed(s.lh, s.ll)))
            .when((size > 0.55) & (r2 > 0.5), made(way(s.move), 0.5 * size + 0.5 * r2))
        )

    cut = n - T.greatest(T.lit(5), T.floor(n / 5))
    turned = (last - T.get(line, cut.cast("int"))) / r
    top, low = T.array_max(line), T.array_min(line)
    lost = T.when(T.lit(True), (turned < -0.35) | ((first_at(line, top) < cut) & ((top - last) / r > 0.45)))
    won = (turned > 0.35) | ((first_at(line, low) < cut) & ((last - low) / r > 0.45))
    fresh = lambda t: (n < 6) | ~T.when(t.type == "trend_up", lost).otherwise(won)
    return T.when(r > 0, let(let(seen, judged), lambda t: T.when(t.isNotNull(), _found(t.type, t.confidence, fresh(t)))))


def quiet_kinds(line: Text, pivots: Text, lean: Text, narrower: Text) -> list[Text]:
    """Breakout, range, compression and accumulation (D13 to D16), each a struct or null."""
    n, r = T.size(line), span(line)
    cut = T.floor(n * 0.65)
    early, late = span(part(line, 0, cut)) / r, span(part(line, cut, n)) / r
    net = T.abs(T.element_at(line, -1) - T.get(line, T.lit(0))) / r
    h, low = values(of_kind(pivots, True)), values(of_kind(pivots, False))
    broke = 0.5 * (1 - early) + 0.5 * late
    flat = (T.abs(lean) < 0.1) & (net < 0.2) & (T.size(h) >= 2) & (T.size(low) >= 2) & (span(h) / r < 0.15) & (span(low) / r < 0.15)
    return [T.when(r > 0, c) for c in (
        T.when((n > 15) & (early < 0.25) & (late > 0.55) & (broke > 0.6), _found("breakout", broke)),
        T.when(flat, _found("range", 0.3 * (1 - span(h) / r) + 0.3 * (1 - span(low) / r) + 0.4 * (1 - T.abs(lean)))),
        T.when((narrower > 0.35) & (net < 0.3), _found("compression", _one(0.7 * narrower))),
        T.when((T.abs(lean) < 0.12) & (T.size(pivots) >= 4) & (net < 0.2), _found("accumulation", T.lit(0.3))),
    )]


# --- all structures of a line ---


def _levels_of(line: Text, pivots: Text) -> list[Text]:
    """Head and shoulders and doubles of a line with their activity."""
    n, margin = T.size(line), 0.02 * span(line)

    def judge(kind: str, made: Text, high: bool, least: float) -> Text:
        def judged(c: Text) -> Text:
            beyond = lambda v, _: v < c.level - margin if high else v > c.level + margin
            holds = _holds(line, T.greatest(c.at, T.floor(n * 0.8).cast("int")), beyond)
            return T.when(c.confidence > least, _found(kind, c.confidence, c.level.isNull() | holds))

        return let(made, judged)

    return [
        judge("head_shoulders", head_shoulders(line, pivots, True), True, HEAD_CONFIDENCE), judge("inv_head_shoulders", head_shoulders(line, pivots, False), False, HEAD_CONFIDENCE),
        judge("double_top", double(line, pivots, True), True, LEVEL_CONFIDENCE), judge("double_bottom", double(line, pivots, False), False, LEVEL_CONFIDENCE),
    ]


def special_kinds(line: Text, pivots: Text) -> Text:
    """A map from each special type (D17 to D22) of at least ``LEVEL_CONFIDENCE`` to its confidence."""
    made = [triple(line, pivots, True), triple(line, pivots, False), cup(line, pivots), pennant(line), rounding(line, pivots)]
    entry = lambda kind, made: let(made, lambda v: T.when(v.confidence >= LEVEL_CONFIDENCE, T.struct(T.lit(kind).alias("k"), T.round(v.confidence, 3).alias("v"))))
    entries = [entry(kind, c) for kind, c in zip(SPECIAL, made, strict=True)]
    return T.map_from_entries(T.array_compact(T.array(*entries)))


def classified(rows: DataFrame) -> DataFrame:
    """Adds type, confidence, patterns, is_active and freshness to packed rows with ``line``, ``pivots``, ``trend`` and ``compression``.

    All detectors give candidates; those the line has left are stale and count only where no other is there, at half their confidence. A
    runner-up less than .08 behind lowers the first to .85. ``patterns``: the best confidence of every active type and special type (U6).
    """
    line, pivots, lean = T.col("line"), T.col("pivots"), T.col("trend")
    quiet = quiet_kinds(line, pivots, lean, T.col("compression"))
    every = [
        impulse(line), trending(line, pivots, lean), quiet[0], flag(line), *_levels_of(line, pivots), wedge(line, pivots), squeeze(line, pivots),
        triangle(line, pivots, T.col("compression")), channel(line, pivots), *quiet[1:],
    ]
    rows = added(rows, {f"_c{i}": c.cast(_FOUND) for i, c in enumerate(every)} | {"_special": special_kinds(line, pivots)})
    rows = added(rows, {"_all": T.array_compact(T.array(*[T.col(f"_c{i}") for i in range(len(every))]))}).drop(*[f"_c{i}" for i in range(len(every))])
    rows = added(rows, {"_live": T.filter("_all", lambda c: c.active)})
    rows = added(rows, {"_used": T.when(T.size("_live") > 0, T.col("_live")).otherwise(T.col("_all"))})
    order = T.array_sort(T.transform("_used", lambda c, i: T.struct((-c.confidence).alias("o"), i.alias("i"), c.alias("c"))))
    rows = added(rows, {"_order": order})
    first, second = T.get("_order", T.lit(0)).c, T.get("_order", T.lit(1)).c
    live = T.size("_live") > 0
    sure = first.confidence * T.when(live, 1.0).otherwise(0.5)
    sure = T.when(T.size("_used") > 1, T.when(sure - second.confidence < 0.08, sure * 0.85).otherwise(sure)).otherwise(sure)
    kinds = T.aggregate("_live", T.map_from_arrays(T.array().cast("array<string>"), T.array().cast("array<double>")), lambda m, c: _greatest(m, T.create_map(c.type, T.round(c.confidence, 3))))
    # of special types with equal confidence the first in order
    top = T.get(T.array_sort(T.transform(T.map_entries("_special"), lambda e, i: T.struct((-e.value).alias("o"), i.alias("i"), e.key.alias("k"), e.value.alias("v")))), T.lit(0))
    alone, some = (T.size("_all") == 0) & (T.size("_special") > 0), T.size("_all") > 0
    return added(rows, {
        "type": T.when(some, first.type).when(alone, top.k).otherwise("unknown"), "confidence": T.when(some, sure).when(alone, top.v).otherwise(0.0),
        "patterns": _greatest(kinds, T.col("_special")), "is_active": ~some | live, "freshness": T.when(some & ~live, 0.3).otherwise(1.0),
    }).drop("_special", "_all", "_live", "_used", "_order")


def _greatest(a: Text, b: Text) -> Text:
    return T.map_zip_with(a, b, lambda k, x, y: T.greatest(x, y))


def structures(bars: DataFrame, *keys: str, settle: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """Every series with its line, pivots, scalars and structure (D25): series of at least ten bars that are not flat; the rest stays with a null type.

    ``passes``: whether its quality reaches .35 (F5). ``settle`` gets the rows with pivots and those with scalars, to write them, say, so that
    each part is planned apart.
    """
    return structures_of(packed.pack(bars, *keys), settle)


def structures_of(rows: DataFrame, settle: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """``structures`` of rows that are packed already: closes, highs, lows, volumes and times."""
    rows = added(rows, {"line": packed.normal_line(T.col("closes"))})
    rows = classified(settle(packed.with_scalars(settle(packed.with_pivots(rows)))))
    good = (T.size("closes") >= 10) & (span(T.col("closes")) >= 1e-10)
    return added(rows, {"type": T.when(good, T.col("type")), "passes": good & (T.col("quality") >= 0.35)})


# --- confirmation: only bars up to the confirmation are looked at ---


def raw_pivots(closes: Text, pivots: Text) -> Text:
    """Pivots of a line at the nearest extreme close within two bars of their place (C5, J20); of two at one bar the first stays."""
    n = T.size(closes)

    def moved(p: Text) -> Text:
        at = T.bround(p.idx / (packed.POINTS - 1) * (n - 1)).cast("int")
        start = T.greatest(T.lit(0), at - 2)
        near = part(closes, start, T.least(n, at + 3))
        idx = start + first_at(near, T.when(p.is_high, T.array_max(near)).otherwise(T.array_min(near)))
        return T.struct(idx.cast("int").alias("idx"), T.get(closes, idx).alias("y"), p.is_high.alias("is_high"), p.prominence.alias("prominence"), p.confidence.alias("confidence"))

    once = lambda kept, p: T.when(T.exists(kept, lambda o: o.idx == p.idx), kept).otherwise(T.concat(kept, T.array(p)))
    kind = "array<struct<idx: int, y: double, is_high: boolean, prominence: double, confidence: double>>"
    return T.array_sort(T.aggregate(T.transform(pivots, moved), T.array().cast(kind), once))


_CANDIDATE = (
    "struct<type: string, confidence: double, at: int, family: string, way: string, level: double, height: double, upper: struct<slope: double, base: double>, lower: struct<slope: double, base: double>>"
)


def _candidate(kind: Text | str, family: str, confidence: Text, at: Text, way: Text | str, height: Text, level: Text | None = None, upper: Text | None = None, lower: Text | None = None) -> Text:
    lit = lambda v: T.lit(v) if isinstance(v, str) or v is None else v
    return T.struct(
        lit(kind).alias("type"), confidence.alias("confidence"), at.cast("int").alias("at"), T.lit(family).alias("family"), lit(way).alias("way"), lit(level).cast("double").alias("level"),
        height.alias("height"), lit(upper).cast("struct<slope: double, base: double>").alias("upper"), lit(lower).cast("struct<slope: double, base: double>").alias("lower"),
    ).cast(_CANDIDATE)


def _of_level(kind: str, made: Text) -> Text:
    return let(made, lambda c: T.when(c.isNotNull(), _candidate(kind, "level", c.confidence, c.at, c.way, c.height, c.level)))


def special_candidates(closes: Text, pivots: Text, scale: Text) -> list[Text]:
    """Candidates of the special types in the order of ``SPECIAL``."""
    made = [triple(closes, pivots, True, scale), triple(closes, pivots, False, scale), cup(closes, pivots, scale), pennant(closes), rounding(closes, pivots, scale)]
    return [_of_level(kind, c) for kind, c in zip(SPECIAL, made, strict=True)]


def candidate(kind: Text, closes: Text, pivots: Text, scale: Text) -> Text:
    """What prices must do to confirm a structure of a type that is not special (C2, C3); null for flags, retests and unknown types."""
    n = T.size(closes)
    flat_line = lambda v: T.struct(T.lit(0.0).alias("slope"), v.alias("base"))
    trend_at = n - 3
    body = part(closes, 0, T.greatest(T.lit(1), n - 2))

    def channels(s: Text) -> Text:
        at = T.array_max(T.transform(pivots, lambda p: p.idx))
        least = T.when(kind.endswith("wedge"), WEDGE_FIT).when(kind.endswith("triangle"), TRIANGLE_FIT).otherwise(CHANNEL_FIT)
        way = T.when(kind.isin("ascending_triangle", "falling_wedge"), "up").when(kind.isin("descending_triangle", "rising_wedge"), "down").otherwise("both")
        line = lambda f: T.struct(f.slope.alias("slope"), f.base.alias("base"))
        gap = s.h.base + s.h.slope * at - s.l.base - s.l.slope * at
        return T.when(s.fit >= least, _candidate(kind, "lines", T.lit(0.5), at, way, T.greatest(gap, 0.05 * span(closes)), None, line(s.h), line(s.l)))

    ways = T.when(kind.isin("trend_up", "impulse_up", "squeeze_up", "breakout"), "up").when(kind.isin("trend_down", "impulse_down", "squeeze_down"), "down")
    return (
        T.when(kind == "double_top", _of_level("double_top", double(closes, pivots, True, scale))).when(kind == "double_bottom", _of_level("double_bottom", double(closes, pivots, False, scale)))
        .when(kind == "head_shoulders", _of_level("head_shoulders", head_shoulders_of_prices(closes, pivots, True)))
        .when(kind == "inv_head_shoulders", _of_level("inv_head_shoulders", head_shoulders_of_prices(closes, pivots, False)))
        .when(kind.endswith("triangle") | kind.contains("channel") | kind.endswith("wedge"), let(pivot_lines(closes, pivots, scale), channels))
        .when(ways.isNotNull() & (n >= 3), _candidate(kind, "trend", T.lit(0.5), trend_at, ways, T.lit(0.0), T.get(closes, trend_at)))
        .when(kind.isin("range", "compression", "accumulation") & (n >= 4) & (span(closes) > 0), _candidate(kind, "range", T.lit(0.5), T.size(body) - 1, "both", span(body), None, flat_line(T.array_max(body)), flat_line(T.array_min(body))))
    )


@for_columns
def confirmation(closes: Text, c: Text) -> Text:
    """State (confirmed, invalidated, open), bar and way of a candidate, from the closes behind it alone.

    Levels and lines: the first close beyond, then ``CONFIRM_BARS`` closes that do not fall back by more than ``RETREAT`` heights.
    Trends: a close beyond the reference and a next one no worse. Ranges: a close beyond a bound by a tenth of the height.
    """
    n = T.size(closes)
    later = T.when(c.at + 1 < n, T.sequence(c.at + 1, n - 1)).otherwise(T.array().cast("array<int>"))
    result = lambda state, at, way: T.struct(T.lit(state).alias("state"), at.cast("int").alias("at"), way.alias("way"))
    nothing = result("open", T.lit(None), T.lit(None).cast("string"))
    value = lambda i: T.get(closes, i)
    above = lambda i: T.when(c.family == "level", c.level).otherwise(c.upper.base + c.upper.slope * i)
    below = lambda i: T.when(c.family == "level", c.level).otherwise(c.lower.base + c.lower.slope * i)
    side = lambda i, margin: T.when((c.way != "down") & (value(i) > above(i) + margin), "up").when((c.way != "up") & (value(i) < below(i) - margin), "down")

    def broke(margin: Text) -> Text:
        return T.get(T.filter(T.transform(later, lambda i: T.struct(i.alias("i"), side(i, margin).alias("way"))), lambda s: s.way.isNotNull()), T.lit(0))

    def held(b: Text) -> Text:
        room = RETREAT * T.greatest(c.height, T.lit(1e-9))
        back = lambda i: T.when(b.way == "up", value(i) < above(i) - room).otherwise(value(i) > below(i) + room)
        after = T.transform(T.sequence(T.lit(1), T.lit(CONFIRM_BARS)), lambda k: b.i + k)
        return T.when(b.isNull() | (b.i + CONFIRM_BARS >= n), nothing).when(T.exists(after, back), result("invalidated", T.lit(None), T.lit(None).cast("string"))).otherwise(result("confirmed", b.i + CONFIRM_BARS, b.way))

    goes = lambda i: T.when(c.way == "up", (value(i) > c.level) & (value(i + 1) >= value(i))).otherwise((value(i) < c.level) & (value(i + 1) <= value(i)))
    follow = T.get(T.filter(later, lambda i: (i < n - 1) & goes(i)), T.lit(0))
    out_of_range = let(broke(RETREAT * 0.2 * T.greatest(c.height, T.lit(1e-9))), lambda b: T.when(b.isNull(), nothing).otherwise(result("confirmed", b.i, b.way)))
    trend_state = let(follow, lambda i: T.when(i.isNull(), nothing).otherwise(result("confirmed", i + 1, c.way)))
    return T.when(c.family.isin("level", "lines"), let(broke(T.lit(0.0)), held)).when(c.family == "trend", trend_state).when(c.family == "range", out_of_range)


def scale_of(highs: Text, lows: Text, closes: Text) -> Text:
    """Mean of the last 14 true ranges, but at least 1 % of the range of closes."""
    def one(i: Text) -> Text:
        before = T.get(closes, i - 1)
        wide = T.get(highs, i) - T.get(lows, i)
        return T.when(i == 0, wide).otherwise(T.greatest(wide, T.abs(T.get(highs, i) - before), T.abs(T.get(lows, i) - before)))

    ranges = T.transform(T.sequence(T.lit(0), T.size(closes) - 1), one)
    return T.greatest(mean(part(ranges, T.greatest(T.lit(0), T.size(closes) - 14), T.size(closes))), 0.01 * span(closes))


def causal(rows: DataFrame) -> DataFrame:
    """Confirmed structures of rows of ``structures`` (C6): the first special type that is confirmed, else the line's own type.

    Adds candidate_at, candidate_time, confirmed_at, confirmed_time, state, and sets type, confidence, is_active and freshness after them.
    """
    rows = added(rows.where("size(closes) >= 11 and passes"), {"_scale": scale_of(T.col("highs"), T.col("lows"), T.col("closes"))})
    rows = added(rows, {"_raw": raw_pivots(T.col("closes"), T.col("pivots"))})
    given, kind, own = (T.col("closes"), T.col("_raw"), T.col("_scale")), T.col("type"), len(SPECIAL)
    made = special_candidates(*given)
    rows = added(rows, {f"_c{i}": c for i, c in enumerate([*made, candidate(kind, *given)])})
    special = [T.when(kind == k, T.col(f"_c{i}")) for i, k in enumerate(SPECIAL)]
    rows = added(rows, {f"_c{own}": T.coalesce(*special, T.col(f"_c{own}"))})
    rows = added(rows, {f"_r{i}": T.when(T.col(f"_c{i}").isNotNull(), confirmation(T.col("closes"), T.col(f"_c{i}"))) for i in range(own + 1)})
    tries = [T.struct(T.col(f"_c{i}").alias("c"), T.col(f"_r{i}").alias("r")) for i in range(own + 1)]
    first = [T.when((T.col(f"_r{i}.state") == "confirmed") & (kind != k), tries[i]) for i, k in enumerate(SPECIAL)]
    choice = T.coalesce(*first, T.when(T.col(f"_c{own}").isNotNull(), tries[own]))
    rows = added(rows, {"_pick": choice}).drop(*[f"_{x}{i}" for i in range(own + 1) for x in "cr"], "_scale", "_raw")
    c, r = T.col("_pick.c"), T.col("_pick.r")
    there, time = T.col("_pick").isNotNull(), lambda i: T.get("times", i)
    confirmed = T.coalesce(r.state == "confirmed", T.lit(False))
    return added(rows, {
        "candidate_at": c.at, "candidate_time": time(c.at), "confirmed_at": r.at, "confirmed_time": time(r.at), "state": T.coalesce(r.state, T.lit("none")), "way": r.way,
        "type": T.coalesce(c.type, T.col("type")), "confidence": T.coalesce(c.confidence, T.col("confidence")),
        "patterns": T.when(there, _replaced(T.col("patterns"), c)).otherwise(T.col("patterns")),
        "is_active": confirmed, "freshness": T.when(confirmed, 1.0).when(r.state == "invalidated", 0.0).otherwise(0.5),
    }).drop("_pick")


def _replaced(patterns: Text, c: Text) -> Text:
    return T.map_concat(T.map_filter(patterns, lambda k, v: k != c.type), T.create_map(c.type, c.confidence))
