"""The queries of the series operators, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions import shapes
from strandline.functions import texts
from strandline.operators import detectors, features, folds, level_driver, levels, packed, patterns, relevance, replay, scans, scoring, similarity, store, structures, validation, windows
from strandline.sources import datasets, klines
from strandline.sources.tables import Models, Store
from strandline.sources.series import event_bars, latest, settled, shared_folder, ship_days, table
from strandline.streaming import live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_BARS = """bars AS (SELECT event_type AS symbol, time_bucket(INTERVAL '4 hours', ts) AS open_time, arg_min(value, row(ts, event_id)) AS open,
  max(value) AS high, min(value) AS low, arg_max(value, row(ts, event_id)) AS close, count(*) AS volume FROM events GROUP BY 1, 2),
l AS (SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY open_time DESC) <= 100),
s AS (SELECT *, (row_number() OVER (PARTITION BY symbol ORDER BY open_time) - 1)::INTEGER AS idx FROM l)"""
_TR = """tr AS (SELECT *, greatest(high - low, abs(high - lag(close) OVER o), abs(low - lag(close) OVER o)) AS tr,
  row_number() OVER (PARTITION BY symbol ORDER BY idx DESC) AS rn FROM s WINDOW o AS (PARTITION BY symbol ORDER BY idx)),
atr AS (SELECT symbol, avg(tr) AS atr FROM tr WHERE rn <= 14 GROUP BY 1),
scale AS (SELECT symbol, greatest(atr, 0.01 * span) AS vol_scale FROM atr JOIN (SELECT symbol, max(close) - min(close) AS span FROM s GROUP BY 1) USING (symbol))"""
_PIV = """pw AS (SELECT *, count(*) OVER (PARTITION BY symbol) AS n, max(high) OVER a AS top, min(low) OVER a AS bot FROM s
  WINDOW a AS (PARTITION BY symbol ORDER BY idx ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)),
piv AS (SELECT symbol, idx, true AS is_high, high AS price FROM pw WHERE idx >= 5 AND idx < n - 5 AND high = top
  UNION ALL SELECT symbol, idx, false, low FROM pw WHERE idx >= 5 AND idx < n - 5 AND low = bot)"""
_NORM = """nm AS (SELECT symbol, idx, CASE WHEN max(close) OVER p - min(close) OVER p < 1e-10 THEN 0.0
  ELSE (close - min(close) OVER p) / (max(close) OVER p - min(close) OVER p) END AS y, close FROM s WINDOW p AS (PARTITION BY symbol)),
np AS (SELECT *, count(*) OVER (PARTITION BY symbol) AS n, max(y) OVER a AS top, min(y) OVER a AS bot FROM nm
  WINDOW a AS (PARTITION BY symbol ORDER BY idx ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)),
yp AS (SELECT symbol, idx, true AS is_high, y AS price FROM np WHERE idx >= 5 AND idx < n - 5 AND y = top
  UNION ALL SELECT symbol, idx, false, y FROM np WHERE idx >= 5 AND idx < n - 5 AND y = bot)"""


def query(sql: str | None = None, *ctes: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + sql
        return f

    return add


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Floating-point columns to ``places``, without negative zeros."""
    return df.withColumns({c: F.round(F.col(c), places) + 0.0 for c, t in df.dtypes if t == "double"})


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(event_bars(spark, sf_dir))


def lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Normalised lines and their pivots."""
    norm = windows.normalised(series(spark, sf_dir)).select("symbol", "idx", "y", "close")
    return norm, windows.pivots(norm, 5, "y", "y")


# --- bars and windows ---


@query("SELECT symbol, open_time, open, high, low, close, volume FROM bars", _BARS)
def ohlcv_4h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_bars(spark, sf_dir)


@query("SELECT symbol, idx, open_time, close, volume FROM s", _BARS)
def latest_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series(spark, sf_dir).select("symbol", "idx", "open_time", "close", "volume")


@query("SELECT symbol, round(atr, 6) AS atr FROM atr", _BARS, _TR)
def atr14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(windows.atr(series(spark, sf_dir)))


@query("SELECT symbol, round(vol_scale, 6) AS vol_scale FROM scale", _BARS, _TR)
def vol_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(windows.vol_scale(series(spark, sf_dir)))


@query("SELECT symbol, idx, is_high, price FROM piv", _BARS, _PIV)
def pivots_k5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.pivots(series(spark, sf_dir))


@query(
    """SELECT symbol, idx, close, h AS is_high FROM (SELECT symbol, idx, close, close > max(close) OVER b AND close > max(close) OVER a AS h,
    close < min(close) OVER b AND close < min(close) OVER a AS w FROM s WINDOW b AS (PARTITION BY symbol ORDER BY idx ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING),
    a AS (PARTITION BY symbol ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)) WHERE h OR w""", _BARS)
def strict_extrema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.strict_extrema(series(spark, sf_dir))


@query(
    """SELECT symbol, count(*) AS n, min(close) AS lo, max(close) AS hi, round(avg(close), 6) AS mean, round(stddev_pop(close), 6) AS sd,
    round(quantile_cont(close, 0.5), 6) AS median, round(max(close) - min(close), 6) AS span FROM s GROUP BY 1""", _BARS)
def series_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(windows.series_stats(series(spark, sf_dir)))


@query("SELECT symbol, arg_min(idx, row(close, idx)) AS argmin, arg_max(idx, row(close, -idx)) AS argmax FROM s GROUP BY 1", _BARS)
def argminmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.arg_extremes(series(spark, sf_dir))


@query(
    """SELECT symbol, round(regr_slope(close, idx), 6) AS slope, round(regr_intercept(close, idx), 6) AS intercept, round(corr(close, idx), 6) AS r FROM s GROUP BY 1""", _BARS)
def linreg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(windows.line_fit(series(spark, sf_dir)).select("symbol", "slope", "intercept", "r"))


@query(
    """SELECT symbol, round(tanh(regr_slope(close, idx) * count(*) / (max(close) - min(close) + 1e-10)) * abs(corr(close, idx)), 6) AS trend FROM s GROUP BY 1""", _BARS)
def trend_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(windows.trend(series(spark, sf_dir)))


@query(
    """SELECT symbol, round(stddev_pop(r), 6) AS volatility FROM (SELECT symbol, (close - lag(close) OVER o) / (lag(close) OVER o + 1e-10) AS r FROM s
    WINDOW o AS (PARTITION BY symbol ORDER BY idx)) GROUP BY 1""", _BARS)
def volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(windows.returns_volatility(series(spark, sf_dir)))


@query(
    """SELECT symbol, round(CASE WHEN count(*) < 20 OR stddev_pop(close) FILTER (half) = 0 THEN 0.0 ELSE 1 - stddev_pop(close) FILTER (NOT half) / stddev_pop(close) FILTER (half) END, 6)
    AS compression FROM (SELECT *, idx < floor(count(*) OVER (PARTITION BY symbol) / 2) AS half FROM s) GROUP BY 1""", _BARS)
def compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(windows.compression(series(spark, sf_dir)))


@query(
    """SELECT symbol, round(CASE WHEN n < 15 THEN 0.0 ELSE least(1.0, 0.3 * abs(last - first) + 0.3 * least(3.0, s2 / (s1 + 1e-10)) / 3 + 0.4 * (greatest(0.0, last - hi) + greatest(0.0, lo - last))) END, 6) AS breakout_strength
    FROM (SELECT symbol, count(*) AS n, stddev_pop(mv) FILTER (NOT t) AS s1, stddev_pop(mv) FILTER (t) AS s2, max(y) FILTER (NOT t) AS hi, min(y) FILTER (NOT t) AS lo, arg_max(y, idx) AS last, arg_min(y, idx) FILTER (t) AS first
    FROM (SELECT *, y - lag(y) OVER (PARTITION BY symbol, t ORDER BY idx) AS mv FROM (SELECT *, idx >= floor(count(*) OVER (PARTITION BY symbol) * 0.75) AS t FROM nm)) GROUP BY 1)""", _BARS, _NORM)
def breakout_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(windows.breakout_strength(series(spark, sf_dir)))


@query(
    """SELECT symbol, count(*) FILTER (is_high AND price > b) AS hh, count(*) FILTER (is_high AND price < b) AS lh, count(*) FILTER (NOT is_high AND price > b) AS hl,
    count(*) FILTER (NOT is_high AND price < b) AS ll FROM (SELECT *, lag(price) OVER (PARTITION BY symbol, is_high ORDER BY idx) AS b FROM piv) GROUP BY 1""", _BARS, _PIV)
def hh_hl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.swing_counts(windows.pivots(series(spark, sf_dir)))


@query("SELECT symbol, idx, round(y, 6) AS y FROM nm", _BARS, _NORM)
def normalize_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(windows.normalised(series(spark, sf_dir)).select("symbol", "idx", "y"))


@query(
    """SELECT symbol, w::INTEGER AS window_size, count(*) AS n, round(avg(close), 6) AS mean FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY idx DESC) AS rn FROM s),
    (VALUES (NULL), (30), (50), (70)) v(w) WHERE w IS NULL OR rn <= w GROUP BY 1, 2""", _BARS)
def sub_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = windows.sub_windows(series(spark, sf_dir))
    return rounded(rows.groupBy("symbol", "window_size").agg(F.count("*").alias("n"), F.avg("close").alias("mean")))


@query(
    """SELECT symbol, idx, first_close, close, round(m, 6) AS mean_close FROM (SELECT symbol, idx, close, count(*) OVER w AS n, first(close) OVER w AS first_close, avg(close) OVER w AS m
    FROM a WINDOW w AS (PARTITION BY symbol ORDER BY idx ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)) WHERE n = 100""",
    _BARS, "a AS (SELECT *, (row_number() OVER (PARTITION BY symbol ORDER BY open_time) - 1)::INTEGER AS idx FROM bars)")
def replay_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(windows.replay(latest(event_bars(spark, sf_dir), 1 << 30)))


@query(
    """SELECT symbol, open_time, close FROM (SELECT *, sign(close - lag(close) OVER o) AS d, lag(close) OVER o AS b FROM s WINDOW o AS (PARTITION BY symbol ORDER BY idx))
    WHERE b IS NULL OR abs(close - b) > 0.1 * b""", _BARS)
def change_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars whose close moved by more than a tenth since the bar before, and each first bar."""
    before = F.lag("close").over(windows.in_order())
    rows = series(spark, sf_dir).withColumn("_b", before)
    return rows.where("_b is null or abs(close - _b) > 0.1 * _b").select("symbol", "open_time", "close")


# --- levels ---

_ZONES = """zn AS (SELECT *, sum(new) OVER (PARTITION BY symbol, is_high ORDER BY price, idx) AS zone FROM (SELECT piv.*, vol_scale,
  CASE WHEN price - lag(price) OVER (PARTITION BY symbol, is_high ORDER BY price, idx) <= {eps} * vol_scale THEN 0 ELSE 1 END AS new FROM piv JOIN scale USING (symbol))),
zones AS (SELECT symbol, is_high, quantile_cont(price, 0.5) AS price, count(*) AS touches, min(idx) AS first_touch, max(idx) AS last_touch FROM zn GROUP BY symbol, is_high, zone HAVING count(*) >= 2)"""


@query("SELECT symbol, is_high, round(price, 6) AS price, touches, first_touch, last_touch FROM zones", _BARS, _TR, _PIV, _ZONES.format(eps=0.5))
def dbscan_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = series(spark, sf_dir)
    return rounded(levels.zones(windows.pivots(bars), windows.vol_scale(bars)))


@query("SELECT symbol, is_high, round(price, 6) AS price, touches, first_touch, last_touch FROM zones", _BARS, _TR, _PIV, _ZONES.format(eps=0.02))
def dbscan_zones_fine(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = series(spark, sf_dir)
    return rounded(levels.zones(windows.pivots(bars), windows.vol_scale(bars), 0.02))


@query(
    """SELECT symbol, is_high, round(price, 6) AS price, count(*) AS closes_near FROM zones JOIN scale USING (symbol) JOIN (SELECT symbol, close FROM s) c USING (symbol)
    WHERE abs(close - price) <= 0.3 * vol_scale GROUP BY symbol, is_high, price""", _BARS, _TR, _PIV, _ZONES.format(eps=0.02))
def zone_touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = series(spark, sf_dir)
    scale = windows.vol_scale(bars)
    return rounded(levels.zone_touches(bars, levels.zones(windows.pivots(bars), scale, 0.02), scale))


_HIST = """hist AS (SELECT symbol, CASE WHEN w > 0 THEN least(19, floor((close - lo) / w)) ELSE 0 END::INTEGER AS bin, lo, w, sum(volume)::BIGINT AS volume FROM
  (SELECT symbol, close, volume, min(close) OVER p AS lo, (max(close) OVER p - min(close) OVER p) / 20 AS w FROM s WINDOW p AS (PARTITION BY symbol)) GROUP BY ALL)"""


@query("SELECT symbol, bin, volume FROM hist", _BARS, _HIST)
def volume_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return levels.volume_histogram(series(spark, sf_dir)).select("symbol", "bin", "volume")


@query(
    """SELECT symbol, poc, a AS low_bin, b AS high_bin, round(lo + (poc + 0.5) * w, 6) AS poc_price, t::DOUBLE AS area_volume FROM (SELECT * FROM grown QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY step DESC) = 1)""",
    "RECURSIVE " + _BARS, _HIST,
    "full_h AS (SELECT k.symbol, g.bin::INTEGER AS bin, k.lo, k.w, coalesce(h.volume, 0) AS v FROM (SELECT DISTINCT symbol, lo, w FROM hist) k, range(20) g(bin) LEFT JOIN hist h ON h.symbol = k.symbol AND h.bin = g.bin)",
    "tops AS (SELECT symbol, lo, w, arg_max(bin, row(v, -bin)) AS poc, sum(v) AS total, max(v) AS best, list(v ORDER BY bin) AS vs FROM full_h GROUP BY ALL)",
    """grown AS (SELECT symbol, lo, w, poc, total, vs, poc AS a, poc AS b, best::DOUBLE AS t, 0 AS step FROM tops UNION ALL
    SELECT symbol, lo, w, poc, total, vs, CASE WHEN r THEN a ELSE a - 1 END, CASE WHEN r THEN b + 1 ELSE b END, t + CASE WHEN r THEN vs[b + 2] ELSE vs[a] END, step + 1 FROM
    (SELECT *, b < 19 AND (a = 0 OR vs[b + 2] >= vs[a]) AS r FROM grown WHERE t < 0.7 * total AND (a > 0 OR b < 19)))""")
def poc_value_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(levels.value_area(levels.volume_histogram(series(spark, sf_dir))))


@query(
    """SELECT symbol, round(level, 6) AS level, count(*) AS touches, max(idx) AS last_touch FROM (SELECT symbol, vol_scale, (round(last / step) + k) * step AS level FROM
    (SELECT *, CASE WHEN f < 1.5 THEN 1.0 WHEN f < 3 THEN 2.0 WHEN f < 7 THEN 5.0 ELSE 10.0 END * p AS step FROM (SELECT *, pow(10.0, floor(log10(vol_scale))) AS p, vol_scale / pow(10.0, floor(log10(vol_scale))) AS f
    FROM (SELECT symbol, arg_max(close, idx) AS last FROM s GROUP BY 1) JOIN scale USING (symbol))), range(-3, 4) r(k)) v JOIN s USING (symbol)
    WHERE level > 0 AND least(abs(high - level), abs(low - level)) <= 0.5 * vol_scale GROUP BY 1, 2""", _BARS, _TR)
def round_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = series(spark, sf_dir)
    return rounded(levels.round_levels(bars, windows.vol_scale(bars)))


@query(
    """SELECT symbol, is_high, i, j, round(slope, 6) AS slope, count(*) AS touches FROM (SELECT a.symbol, a.is_high, a.idx AS i, b.idx AS j, (b.price - a.price) / (b.idx - a.idx) AS slope, a.price AS base
    FROM piv a JOIN piv b ON a.symbol = b.symbol AND a.is_high = b.is_high AND a.idx < b.idx) JOIN (SELECT symbol, max(high) - min(low) AS span FROM s GROUP BY 1) USING (symbol)
    JOIN (SELECT symbol, is_high, idx AS x, price FROM piv) t USING (symbol, is_high) WHERE abs(price - (base + slope * (x - i))) <= 0.0015 * span GROUP BY ALL HAVING count(*) >= 3""", _BARS, _PIV)
def pivot_pairs_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = series(spark, sf_dir)
    return rounded(levels.pivot_lines(bars, windows.pivots(bars)))


# --- patterns ---


def _pairs_sql(high: bool) -> str:
    kind, agg = ("is_high", "min") if high else ("NOT is_high", "max")
    return f"""pr AS (SELECT a.symbol, a.idx AS i, b.idx AS j, a.price AS yi, b.price AS yj, {agg}(n.y) AS neck FROM (SELECT * FROM yp WHERE {kind}) a JOIN (SELECT * FROM yp WHERE {kind}) b
    ON a.symbol = b.symbol AND a.idx < b.idx JOIN nm n ON n.symbol = a.symbol AND n.idx > a.idx AND n.idx < b.idx GROUP BY ALL)"""


_DOUBLE = """SELECT symbol, i, j, round(neck, 6) AS neck, round(c, 6) AS confidence FROM (SELECT *, round(0.5 * (1 - abs(yi - yj) / 0.1) + 0.5 * least(1.0, abs(yi - neck) / 0.3), 9) AS c FROM pr
  WHERE abs(yi - yj) < 0.1 AND abs(yi - neck) > 0.12) WHERE c > 0.45 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY c DESC, i, j) = 1"""


@query(_DOUBLE, _BARS, _NORM, _pairs_sql(True))
def double_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(patterns.double_extremes(*lines(spark, sf_dir), True, 0.1))


@query(_DOUBLE, _BARS, _NORM, _pairs_sql(False))
def double_bottom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(patterns.double_extremes(*lines(spark, sf_dir), False, 0.1))


_TRIPLE = """SELECT symbol, i, j, k, round(c, 6) AS confidence FROM (SELECT *, round(0.5 * (1 - spread / 0.1) + 0.5 * least(1.0, depth / 0.25), 9) AS c FROM (SELECT p.symbol, p.i, p.j, q.j AS k,
  greatest(p.yi, p.yj, q.yj) - least(p.yi, p.yj, q.yj) AS spread, {depth} AS depth FROM pr p JOIN pr q ON p.symbol = q.symbol AND p.j = q.i) WHERE spread < 0.1 AND depth > 0.10) WHERE c > 0.45"""


@query(_TRIPLE.format(depth="greatest(p.yi, p.yj, q.yj) - greatest(p.neck, q.neck)"), _BARS, _NORM, _pairs_sql(True))
def triple_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(patterns.triple_extremes(*lines(spark, sf_dir), True, 0.1))


@query(_TRIPLE.format(depth="least(p.neck, q.neck) - least(p.yi, p.yj, q.yj)"), _BARS, _NORM, _pairs_sql(False))
def triple_bottom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(patterns.triple_extremes(*lines(spark, sf_dir), False, 0.1))


_HS = """SELECT symbol, l AS "left", h AS head, r AS "right", round(c2, 6) AS confidence FROM (SELECT *, round(CASE WHEN least(h - l, r - h) / greatest(h - l, r - h) < 0.3 THEN c * 0.7 ELSE c END, 9) AS c2 FROM
  (SELECT *, 0.3 * (1 - off / 0.18) + 0.4 * least(1.0, ahead / 0.2) + 0.3 AS c FROM (SELECT symbol, idx AS l, lead(idx) OVER o AS h, lead(idx, 2) OVER o AS r, abs(price - lead(price, 2) OVER o) AS off,
  least({s} * (lead(price) OVER o - price), {s} * (lead(price) OVER o - lead(price, 2) OVER o)) AS ahead FROM yp WHERE {kind} WINDOW o AS (PARTITION BY symbol ORDER BY idx)) WHERE off < 0.18 AND ahead > 0.06)) WHERE c2 > 0.5"""


@query(_HS.format(s=1, kind="is_high"), _BARS, _NORM)
def head_shoulders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(patterns.head_shoulders(lines(spark, sf_dir)[1], True))


@query(_HS.format(s=-1, kind="NOT is_high"), _BARS, _NORM)
def inverse_head_shoulders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(patterns.head_shoulders(lines(spark, sf_dir)[1], False))


@query(
    """SELECT symbol, round(m, 6) AS size, idx, CASE WHEN mv > 0 THEN 'impulse_up' ELSE 'impulse_down' END AS type FROM (SELECT symbol, idx, mv, round(abs(mv), 9) AS m FROM
    (SELECT symbol, idx, lead(y, 20) OVER (PARTITION BY symbol ORDER BY idx) - y AS mv FROM nm) WHERE abs(mv) > 0.55) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY m DESC, idx) = 1""", _BARS, _NORM)
def impulse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(patterns.impulse(lines(spark, sf_dir)[0]))


@query(
    """SELECT symbol, split, CASE WHEN pole > 0 THEN 'bull_flag' ELSE 'bear_flag' END AS type, round(0.5 * least(1.0, abs(pole)) + 0.3 * (1 - width) + 0.2, 6) AS confidence FROM
    (SELECT symbol, split, arg_max(y, idx) FILTER (idx < cut) - arg_min(y, idx) FILTER (idx < cut) AS pole, arg_max(y, idx) FILTER (idx >= cut) - arg_min(y, idx) FILTER (idx >= cut) AS drift,
    max(y) FILTER (idx >= cut) - min(y) FILTER (idx >= cut) AS width FROM (SELECT *, floor(count(*) OVER (PARTITION BY symbol, split) * split) AS cut FROM nm, (VALUES (0.3::DOUBLE), (0.4), (0.5)) v(split)) GROUP BY 1, 2)
    WHERE abs(pole) >= 0.35 AND width <= 0.45 AND sign(pole) * sign(drift) <= 0""", _BARS, _NORM)
def flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(patterns.flags(lines(spark, sf_dir)[0]))


@query(
    """SELECT symbol, round(hs, 6) AS high_slope, round(ls, 6) AS low_slope, round(c, 6) AS convergence, CASE WHEN c >= 0.15 AND hs > 0 AND ls > 0 THEN 'rising_wedge' WHEN c >= 0.15 AND hs < 0 AND ls < 0 THEN 'falling_wedge'
    WHEN c BETWEEN 0.15 AND 0.95 THEN 'triangle' WHEN abs(c) <= 0.4 AND rise > 0.15 THEN 'channel_up' WHEN abs(c) <= 0.4 AND rise < -0.15 THEN 'channel_down' WHEN abs(c) <= 0.4 THEN 'horizontal_channel' ELSE 'none' END AS type
    FROM (SELECT *, (g0 - g1) / g0 AS c, (hs + ls) / 2 * (x1 - x0) AS rise FROM (SELECT *, (hb + hs * x0) - (lb + ls * x0) AS g0, (hb + hs * x1) - (lb + ls * x1) AS g1 FROM (SELECT symbol, regr_slope(price, idx) FILTER (is_high) AS hs,
    regr_intercept(price, idx) FILTER (is_high) AS hb, regr_slope(price, idx) FILTER (NOT is_high) AS ls, regr_intercept(price, idx) FILTER (NOT is_high) AS lb, count(*) FILTER (is_high) AS h, count(*) FILTER (NOT is_high) AS l,
    min(idx) AS x0, max(idx) AS x1 FROM yp GROUP BY 1) WHERE h >= 2 AND l >= 2) WHERE g0 > 0)""", _BARS, _NORM)
def channel_wedge_triangle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(patterns.shapes(lines(spark, sf_dir)[1]))


@query(
    """SELECT symbol, round(r1, 6) AS r1, round(r2, 6) AS r2, round(net, 6) AS net, r1 < 0.25 AND r2 > 0.55 AS is_breakout, net < 0.2 AS is_range, CASE WHEN s1 > 0 THEN 1 - s2 / s1 ELSE 0 END > 0.35 AND net < 0.3 AS is_compression FROM
    (SELECT symbol, max(y) FILTER (e) - min(y) FILTER (e) AS r1, max(y) FILTER (NOT e) - min(y) FILTER (NOT e) AS r2, stddev_pop(y) FILTER (h) AS s1, stddev_pop(y) FILTER (NOT h) AS s2, abs(arg_max(y, idx) - arg_min(y, idx)) AS net
    FROM (SELECT *, idx < floor(count(*) OVER p * 0.65) AS e, idx < floor(count(*) OVER p / 2) AS h FROM nm WINDOW p AS (PARTITION BY symbol)) GROUP BY 1)""", _BARS, _NORM)
def breakout_range_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(patterns.segments(lines(spark, sf_dir)[0]))


_CONFIRM = """SELECT symbol, from_idx, level, height, up, breakout, state, CASE WHEN state = 'confirmed' THEN breakout + 1 END AS confirmed_at FROM (SELECT *, CASE WHEN breakout IS NULL THEN 'none' WHEN fell THEN 'invalidated'
  WHEN breakout + 1 > last THEN 'pending' ELSE 'confirmed' END AS state FROM (SELECT f.*, coalesce((SELECT bool_or(level - close > 0.5 * height) FROM s n WHERE n.symbol = f.symbol AND n.idx = f.breakout + 1), false) AS fell FROM
  (SELECT c.*, min(s.idx) FILTER (s.close > c.level) AS breakout, max(s.idx) AS last FROM cand c JOIN s ON s.symbol = c.symbol AND s.idx > c.from_idx GROUP BY ALL) f))"""


@query(_CONFIRM, _BARS, _TR, _PIV, "cand AS (SELECT symbol, idx AS from_idx, price * 0.9 AS level, vol_scale AS height, true AS up FROM piv JOIN scale USING (symbol) WHERE is_high)")
def confirm_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closes beyond nine tenths of each high pivot after it, confirmed one bar later or fallen back."""
    bars = series(spark, sf_dir)
    points = windows.pivots(bars).where("is_high").join(windows.vol_scale(bars), "symbol")
    candidates = points.select("symbol", F.col("idx").alias("from_idx"), (F.col("price") * 0.9).alias("level"), F.col("vol_scale").alias("height"), F.lit(True).alias("up"))
    return patterns.confirm(bars, candidates)


# --- likeness ---

_V = "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS a FROM embeddings), r AS (SELECT a AS b FROM v ORDER BY vec_id LIMIT 1)"
_SUMS = """m AS (SELECT vec_id, label, list_sum(list_transform(list_zip(a, b), lambda p: p[1] * p[2])) AS ab, list_sum(list_transform(a, lambda x: x * x)) AS aa, list_sum(list_transform(b, lambda x: x * x)) AS bb,
  list_sum(a) AS sa, list_sum(b) AS sb, list_sum(list_transform(list_zip(a, b), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS dd, len(a) AS n FROM v, r)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("a"))
    return similarity.against(rows, rows.orderBy("vec_id").limit(1).select(F.col("a").alias("b")))


@query("SELECT vec_id, round(CASE WHEN aa > 0 AND bb > 0 THEN ab / (sqrt(aa) * sqrt(bb)) ELSE 0 END, 6) AS score FROM m ORDER BY score DESC, vec_id LIMIT 20", _V, _SUMS)
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = vectors(spark, sf_dir).select("vec_id", F.round(similarity.cosine(F.col("a"), F.col("b")), 6).alias("score"))
    return similarity.top_k(scored, 20)


@query("SELECT vec_id, round((ab / n - sa / n * sb / n) / sqrt((aa / n - (sa / n) ** 2) * (bb / n - (sb / n) ** 2)), 6) AS score FROM m ORDER BY score DESC, vec_id LIMIT 20", _V, _SUMS)
def pearson_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = vectors(spark, sf_dir).select("vec_id", F.round(similarity.pearson(F.col("a"), F.col("b")), 6).alias("score"))
    return similarity.top_k(scored, 20)


@query("SELECT vec_id, round(-dd / n, 6) AS score FROM m ORDER BY score DESC, vec_id LIMIT 20", _V, _SUMS)
def mse_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = vectors(spark, sf_dir).select("vec_id", F.round(-similarity.mse(F.col("a"), F.col("b")), 6).alias("score"))
    return similarity.top_k(scored, 20)


@query(
    """SELECT vec_id, round(greatest(p, 0.85 * q), 6) AS best, 0.85 * q > p AS is_mirrored FROM (SELECT vec_id, (c + 1) / 2 AS p, (1 - c) / 2 AS q FROM
    (SELECT vec_id, (ab / n - sa / n * sb / n) / sqrt((aa / n - (sa / n) ** 2) * (bb / n - (sb / n) ** 2)) AS c FROM m))""", _V, _SUMS)
def mirror_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation with the reference or, at a penalty, with its mirror image."""
    r = similarity.pearson(F.col("a"), F.col("b"))
    scored = vectors(spark, sf_dir).select("vec_id", ((r + 1) / 2).alias("p"), ((1 - r) / 2).alias("q"))
    return rounded(similarity.mirror_best(scored, "p", "q").select("vec_id", "best", "is_mirrored"))


@query()
def dtw_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 vectors nearest to the first one under banded time warping; its one row comes to the driver."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    reference = rows.orderBy("vec_id").first()["a"]
    return similarity.dtw_scores(rows, reference, "a", "vec_id", 1).orderBy("dtw", "vec_id").limit(20)


# --- matches, feedback, validation ---

_MATCH = """mt AS (SELECT event_id AS match_id, 'u' || user_id AS symbol, event_type AS timeframe, value AS score, ts FROM events),
fb AS (SELECT event_id AS match_id, CASE WHEN (props->>'$.k')::INTEGER % 2 = 0 THEN 1 ELSE 0 END AS is_relevant, CASE WHEN event_type = 'click' THEN 'override' END AS timeframe FROM events WHERE event_id % 3 = 0)"""


@query("SELECT match_id, is_relevant, coalesce(fb.timeframe, mt.timeframe) AS timeframe, score FROM fb LEFT JOIN mt USING (match_id)", _MATCH)
def feedback_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.feedback_with_matches(*store.example(spark, sf_dir))


@query("SELECT mt.timeframe, count(*) AS n, count(*) FILTER (is_relevant = 1) AS relevant, count(*) FILTER (is_relevant = 0) AS irrelevant FROM fb JOIN mt USING (match_id) GROUP BY 1", _MATCH)
def feedback_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.feedback_stats(*store.example(spark, sf_dir))


@query("SELECT match_id, is_relevant FROM fb WHERE match_id NOT IN (SELECT match_id FROM mt WHERE timeframe = 'error')", _MATCH)
def semi_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    matches, feedback = store.example(spark, sf_dir)
    return store.delete_feedback(feedback, matches.where("timeframe = 'error'")).select("match_id", "is_relevant")


@query("SELECT least(9, greatest(0, floor(score / 100 * 10)))::INTEGER AS bin, count(*) AS n FROM mt GROUP BY 1", _MATCH)
def score_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.score_histogram(store.example(spark, sf_dir)[0].withColumn("score", F.col("score") / 100))


@query(
    """SELECT symbol, timeframe, round(least(99.99, score * CASE WHEN n >= 3 THEN 1.08 WHEN n = 2 THEN 1.04 ELSE 1 END), 2) AS score FROM (SELECT symbol, timeframe, max(score) AS score FROM mt GROUP BY 1, 2)
    JOIN (SELECT symbol, count(DISTINCT timeframe) AS n FROM mt GROUP BY 1) USING (symbol)""", _MATCH)
def mtf_bonus(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = store.example(spark, sf_dir)[0].groupBy("symbol", "timeframe").agg(F.max("score").alias("score"))
    return similarity.timeframe_bonus(best)


@query()
def dedup_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = store.example(spark, sf_dir)[0].groupBy("symbol", "timeframe").agg(F.max("score").alias("score"))
    order = Window.partitionBy("symbol").orderBy("timeframe")
    return similarity.dedup_matches(best.withColumn("ord", F.row_number().over(order)))


@query("SELECT event_type AS symbol, sum(value * 1000)::DOUBLE AS quote_volume FROM events GROUP BY 1 HAVING sum(value * 1000) >= 1000 ORDER BY 2 DESC LIMIT 3")
def liquid_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most liquid symbols above a least volume (F1, T1). Whole cents, so that sums are exact."""
    rows = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("symbol")).agg(F.sum(F.col("value") * 1000).alias("quote_volume"))
    return rounded(rows.where("quote_volume >= 1000").orderBy(F.col("quote_volume").desc()).limit(3), 3)


ORACLES["liquid_topn"] = "SELECT symbol, round(quote_volume, 3) AS quote_volume FROM (" + ORACLES["liquid_topn"] + ")"


@query("SELECT symbol, round((arg_max(close, idx) - arg_min(close, idx)) / arg_min(close, idx) * 100, 6) AS change FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY idx DESC) AS rn FROM s) WHERE rn <= 6 GROUP BY 1 ORDER BY change DESC", _BARS)
def movers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change over the last six bars of each series, 24 hours, the largest first (T6); shorter series give what they have."""
    back = Window.partitionBy("symbol").orderBy(F.col("idx").desc())
    rows = series(spark, sf_dir).withColumn("rn", F.row_number().over(back)).where("rn <= 6")
    rows = rows.groupBy("symbol").agg(F.min_by("close", "idx").alias("first"), F.max_by("close", "idx").alias("last"))
    return rounded(rows.select("symbol", ((F.col("last") - F.col("first")) / F.col("first") * 100).alias("change"))).orderBy(F.col("change").desc())


@query(
    """SELECT event_type AS pattern_type, tp, fp, fn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall FROM (SELECT event_type, count(*) FILTER (p AND t) AS tp, count(*) FILTER (p AND NOT t) AS fp,
    count(*) FILTER (NOT p AND t) AS fn FROM (SELECT event_type, value > 10 AS p, (props->>'$.k')::INTEGER > 50 AS t FROM events) GROUP BY 1)""")
def prf1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision and recall per pattern."""
    rows = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("pattern_type"), (F.col("value") > 10).alias("predicted"), (F.get_json_object("props", "$.k").cast("int") > 50).alias("actual")
    )
    return rounded(store.precision_recall(rows))


@query("SELECT event_type, (props->>'$.k')::INTEGER % 10 AS k, count(*) AS n FROM events GROUP BY 1, 2")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of JSON text by a declared schema; text that does not parse gives null."""
    rows = table(spark, sf_dir, "events").withColumn("p", F.from_json("props", "k int"))
    return rows.groupBy("event_type", (F.col("p.k") % 10).alias("k")).agg(F.count("*").alias("n"))


@query("SELECT symbol, count(*) AS n, round(avg(close), 4) AS mean FROM (SELECT l_returnflag AS symbol, l_shipdate, avg(l_extendedprice / l_quantity) AS close FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def ship_day_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ship_days(spark, sf_dir).groupBy("symbol").agg(F.count("*").alias("n"), F.avg("close").alias("mean")), 4)


# --- folds, validation, learning, streams: held against plain references in the tests ---


@query()
def zigzag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(folds.zigzag_pivots(lines(spark, sf_dir)[0]))


@query()
def trend_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(folds.trend_levels(series(spark, sf_dir)))


_LINES = """lp AS (SELECT piv.*, greatest(0.5 * vol_scale, 1e-9) AS tol FROM piv JOIN scale USING (symbol)),
lq AS (SELECT a.symbol, a.is_high, a.idx AS i, b.idx AS j, a.price AS pi, (b.price - a.price) / (b.idx - a.idx) AS steep FROM lp a JOIN lp b ON a.symbol = b.symbol AND a.is_high = b.is_high AND a.idx < b.idx),
ln AS (SELECT lq.*, idx, price, abs(price - (pi + steep * (idx - i))) AS off FROM lq JOIN lp USING (symbol, is_high) WHERE abs(price - (pi + steep * (idx - i))) <= tol),
lb AS (SELECT * FROM (SELECT symbol, is_high, i, j, count(*) AS m, round(avg(off), 9) AS away FROM ln GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY symbol, is_high ORDER BY m DESC, away, i, j) = 1),
lf AS (SELECT symbol, is_high, regr_slope(price, idx) AS slope, regr_intercept(price, idx) AS intercept, count(*) AS touches, min(idx) AS a, max(idx) AS b FROM ln JOIN lb USING (symbol, is_high, i, j) WHERE m >= 3 GROUP BY 1, 2)"""


@query(
    """SELECT symbol, is_high, round(slope, 6) AS slope, round(intercept, 6) AS intercept, touches::INTEGER AS touches, round(0.5 * least(1.0, touches / 5) + 0.5 * (b - a) / greatest(1, whole), 6) AS strength FROM lf
    JOIN (SELECT symbol, is_high, max(idx) - min(idx) AS whole FROM piv GROUP BY 1, 2) USING (symbol, is_high)""", _BARS, _TR, _PIV, _LINES)
def consensus_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = series(spark, sf_dir)
    return rounded(folds.consensus_lines(windows.pivots(bars), windows.vol_scale(bars)))


@query()
def merged_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zones, strongest first, merged."""
    bars = series(spark, sf_dir)
    scale = windows.vol_scale(bars)
    found = levels.zones(windows.pivots(bars), scale, 0.02)
    strength = 0.2 + 0.5 * F.least(F.lit(1.0), F.col("touches") / 5) + 0.2 * F.col("last_touch") / 100
    return rounded(folds.merge_levels(found.withColumn("strength", strength), scale))


@query()
def range_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict extrema as detections, pivots as labels a bar wide."""
    bars = series(spark, sf_dir)
    kind = F.when(F.col("is_high"), "high").otherwise("low").alias("pattern_type")
    events = windows.strict_extrema(bars).select("symbol", kind, "idx")
    labels = windows.pivots(bars).select("symbol", kind, F.col("idx").alias("start"), (F.col("idx") + 1).alias("end"))
    return validation.match_events(events, labels)


@query(
    """SELECT symbol, sum(gone)::BIGINT AS gone, sum(seen)::BIGINT AS seen, round(coalesce(sum(gone) / nullif(sum(seen), 0), 0), 6) AS rate FROM (SELECT symbol, len(list_filter(p, lambda x: NOT list_contains(q, x))) AS gone, len(p) AS seen FROM
    (SELECT symbol, p, lead(p) OVER (PARTITION BY symbol ORDER BY step) AS q FROM (SELECT symbol, idx // 10 AS step, list(DISTINCT CASE WHEN close > 20 THEN 'high' WHEN close > 10 THEN 'mid' ELSE 'low' END) AS p FROM s GROUP BY 1, 2))
    WHERE q IS NOT NULL) GROUP BY 1""", _BARS)
def repaint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of closes of ten bars that are gone in the next ten."""
    kind = F.when(F.col("close") > 20, "high").when(F.col("close") > 10, "mid").otherwise("low")
    active = series(spark, sf_dir).groupBy("symbol", F.floor(F.col("idx") / 10).alias("step")).agg(F.collect_set(kind).alias("patterns"))
    return rounded(validation.repaint_rate(active))


@query("SELECT symbol, round(avg(confirmed_at - from_idx), 6) AS latency FROM (" + _CONFIRM + ") GROUP BY 1", _BARS, _TR, _PIV, "cand AS (SELECT symbol, idx AS from_idx, price * 0.9 AS level, vol_scale AS height, true AS up FROM piv JOIN scale USING (symbol) WHERE is_high)")
def latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(validation.latency(confirm_level(spark, sf_dir)))


@query()
def rf_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the bars that the forest was not trained on (ML1, ML3, ML4)."""
    rows = relevance.bar_features(event_bars(spark, sf_dir))
    apart = relevance.held_out("symbol", "open_time")
    return relevance.score(rows.where(apart), relevance.train(rows.where(~apart))).select("symbol", "open_time", F.round("ml_score", 6).alias("ml_score"))


@query("SELECT symbol, timeframe, is_click, is_view FROM (SELECT 'u' || user_id AS symbol, event_type AS timeframe, (event_type = 'click')::DOUBLE AS is_click, (event_type = 'view')::DOUBLE AS is_view FROM events)")
def one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relevance.one_hot(store.example(spark, sf_dir)[0], "timeframe", ["click", "view"])
    return rows.select("symbol", "timeframe", F.col("timeframe_click").alias("is_click"), F.col("timeframe_view").alias("is_view"))


def framed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest bars of every series as a whole and for its last 30, 50 and 70 bars (W20), with ``timeframe`` and its order ``ord`` (whole first)."""
    rows = windows.sub_windows(series(spark, sf_dir))
    size = F.coalesce("window_size", F.lit(0))
    return rows.withColumns({"timeframe": F.when(size == 0, "4h").otherwise(F.concat(F.lit("4h_w"), size.cast("string"))), "ord": size})


def all_structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(detectors.structures(framed(spark, sf_dir), "symbol", "timeframe", "ord", settle=settled))


@query()
def structure_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every series and window with its structure and scalars (D1 to D25, P1 to P13, A1, A3, F5); the type filter (F9) looks into ``patterns``, too."""
    rows = all_structures(spark, sf_dir)
    scalars = ["confidence", "freshness", "quality", "trend", "volatility", "compression", "symmetry", "convergence", "breakout_strength", "volume_confirmation", "consistency", "pivot_confidence"]
    vector = texts.column(packed.total(packed.feature_vector(*map(texts.col, ("line", "sequence", "distances")), [texts.col(c) for c in ("trend", "volatility", "compression")])))
    return rows.select("symbol", "timeframe", "type", "is_active", "passes", F.size("pivots").alias("pivots"), F.array_sort(F.map_keys("patterns")).alias("patterns"), F.round(vector, 5).alias("vector_sum"), *[(F.round(c, 6) + 0.0).alias(c) for c in scalars])


@query()
def causal_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structures confirmed bar by bar (C1 to C6); ``state`` tells confirmed, invalidated, open or none. F10 keeps the confirmed ones."""
    rows = detectors.causal(all_structures(spark, sf_dir))
    return rows.select("symbol", "timeframe", "type", "state", "way", "candidate_at", "candidate_time", "confirmed_at", "confirmed_time", "is_active", "freshness", F.round("confidence", 6).alias("confidence"))


@query()
def similarity_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All series and windows against the whole series of the first symbol, mirrors too, by score."""
    rows = all_structures(spark, sf_dir)
    return scoring.find_matches(rows, rows.where("ord = 0").orderBy("symbol"))


_STRENGTH = "round(greatest(0, least(1, {base} + 0.5 * least(1.0, {t} / 5) + 0.2 * coalesce({last}, 0) / greatest(n - 1, 1) + 0.3 * CASE WHEN mv > 0 AND {v} IS NOT NULL THEN least(1.0, {v} / (mv + 1e-9)) ELSE 0 END)), 4)"
_LEVELS = f"""fx AS (SELECT symbol, count(*) AS n, arg_max(close, idx) AS last, avg(volume) AS mv, vol_scale FROM s JOIN scale USING (symbol) GROUP BY symbol, vol_scale HAVING count(*) >= 20 AND vol_scale > 0),
zo AS (SELECT *, sum(fresh) OVER (PARTITION BY symbol, is_high ORDER BY price, idx) AS zone FROM (SELECT piv.*, s.volume AS v, n, mv, coalesce((price - lag(price) OVER (PARTITION BY symbol, is_high ORDER BY price, idx) > greatest(0.5 * vol_scale, 1e-9))::INTEGER, 1) AS fresh
  FROM piv JOIN fx USING (symbol) JOIN s USING (symbol, idx))),
zl AS (SELECT symbol, is_high, median(price) AS price, count(*) AS touches, min(idx) AS first_touch, max(idx) AS last_touch, {_STRENGTH.format(base="0", t="count(*)", last="max(idx)", v="avg(v)")} AS strength, 'zone' AS source FROM zo GROUP BY symbol, is_high, zone, n, mv HAVING count(*) >= 2),
hb AS (SELECT symbol, least(19, floor((close - lo) / w))::INTEGER AS bin, lo, w, sum(volume) AS v FROM (SELECT *, min(close) OVER p AS lo, (max(close) OVER p - min(close) OVER p) / 20 AS w FROM s WINDOW p AS (PARTITION BY symbol)) WHERE w > 0 GROUP BY ALL),
hg AS (SELECT symbol, lo, w, list(coalesce(v, 0) ORDER BY b.bin) AS h FROM (SELECT DISTINCT symbol, lo, w FROM hb) CROSS JOIN (SELECT unnest(range(20))::INTEGER AS bin) b LEFT JOIN hb USING (symbol, lo, w, bin) GROUP BY 1, 2, 3 HAVING sum(v) > 0),
va AS (SELECT symbol, lo, w, h, list_position(h, list_max(h)) - 1 AS poc, list_reduce(list_prepend([list_position(h, list_max(h)) - 1, list_position(h, list_max(h)) - 1, list_max(h)]::DOUBLE[], list_transform(range(20), lambda i: [0.0::DOUBLE])), lambda t, x: CASE WHEN t[3] >= 0.7 * list_sum(h) OR (t[1] = 0 AND t[2] = 19) THEN t
  WHEN t[2] < 19 AND (t[1] = 0 OR h[t[2]::INT + 2] >= h[t[1]::INT]) THEN [t[1], t[2] + 1, t[3] + h[t[2]::INT + 2]] ELSE [t[1] - 1, t[2], t[3] + h[t[1]::INT]] END) AS t FROM hg),
ca AS (SELECT symbol, unnest([lo + (poc + 0.5) * w, lo + (t[2] + 0.5) * w, lo + (t[1] + 0.5) * w]) AS price, unnest(['volume_poc', 'volume_vah', 'volume_val']) AS source, unnest([0, 1, 2]) AS o FROM va
  UNION ALL SELECT symbol, (round_even(last / step, 0) + k) * step, 'round_number', k + 10 FROM (SELECT *, unnest(range(-3, 4)) AS k FROM (SELECT symbol, last, CASE WHEN vol_scale / p < 1.5 THEN 1 WHEN vol_scale / p < 3 THEN 2 WHEN vol_scale / p < 7 THEN 5 ELSE 10 END * p AS step FROM (SELECT *, pow(10.0, floor(log10(vol_scale))) AS p FROM fx))) WHERE (round_even(last / step, 0) + k) * step > 0),
ct AS (SELECT ca.symbol, price, source, o, count(*) FILTER (hit) AS touches, min(idx) FILTER (hit) AS a, max(idx) FILTER (hit) AS b, avg(volume) FILTER (hit) AS v FROM (SELECT ca.*, idx, volume, CASE WHEN o < 10 THEN abs(close - price) <= 0.5 * vol_scale ELSE abs(high - price) <= 0.5 * vol_scale OR abs(low - price) <= 0.5 * vol_scale END AS hit
  FROM ca JOIN fx USING (symbol) JOIN s USING (symbol)) ca GROUP BY ALL),
cs AS (SELECT symbol, price > last AS is_high, price, o, source, touches, coalesce(a, n - 1) AS first_touch, coalesce(b, n - 1) AS last_touch, {_STRENGTH.format(base="CASE WHEN o < 10 THEN 0.25 ELSE 0.2 END", t="greatest(touches, 1)", last="b", v="v")} AS strength FROM ct JOIN fx USING (symbol) WHERE o < 10 OR touches > 0),
ck AS (SELECT symbol, list_reduce(list_prepend(coalesce(any_value(z), []::DOUBLE[]), list([price] ORDER BY o)), lambda k, c: CASE WHEN len(list_filter(k, lambda p: abs(p - c[1]) < 0.3 * any_tol)) > 0 THEN k ELSE list_append(k, c[1]) END) AS kept FROM
  (SELECT cs.*, vol_scale AS any_tol FROM cs JOIN fx USING (symbol)) LEFT JOIN (SELECT symbol, list(price) AS z FROM zl GROUP BY 1) USING (symbol) GROUP BY symbol, any_tol),
al AS (SELECT symbol, is_high, price, touches, first_touch, last_touch, strength, source FROM zl UNION ALL SELECT symbol, is_high, price, touches, first_touch, last_touch, strength, source FROM cs JOIN ck USING (symbol) WHERE list_contains(kept, price)),
mg AS (SELECT symbol, is_high, list_reduce(list_prepend([]::DOUBLE[][], list([[strength, price, touches, first_touch, last_touch, code]]::DOUBLE[][] ORDER BY strength DESC, price)), lambda k, c: CASE WHEN len(list_filter(k, lambda o: abs(o[2] - c[1][2]) < tol)) = 0 THEN list_concat(k, c)
  ELSE list_transform(k, lambda o, i: CASE WHEN i = list_position(list_transform(k, lambda q: abs(q[2] - c[1][2]) < tol), true) THEN [least(1.0, o[1] + c[1][1]), o[2], greatest(o[3], c[1][3]), least(o[4], c[1][4]), greatest(o[5], c[1][5]), o[6]] ELSE o END) END) AS kept
  FROM (SELECT al.*, 0.3 * vol_scale AS tol, list_position(['zone', 'volume_poc', 'volume_vah', 'volume_val', 'round_number'], source) AS code FROM al JOIN fx USING (symbol)) GROUP BY symbol, is_high, tol),
fl AS (SELECT symbol, is_high, 0.0 AS slope, k[2] AS intercept, k[3]::BIGINT AS touches, k[4]::INTEGER AS first_touch, k[5]::INTEGER AS last_touch, k[1] AS strength, ['zone', 'volume_poc', 'volume_vah', 'volume_val', 'round_number'][k[6]::INTEGER] AS source, false AS is_trendline, NULL::BOOLEAN AS is_channel FROM (SELECT symbol, is_high, unnest(kept) AS k FROM mg)),
md AS (SELECT lp.symbol, lp.is_high, slope, tol, idx, price - slope * idx AS rest FROM lp JOIN (SELECT symbol, is_high, median(steep) AS slope FROM lq JOIN (SELECT symbol, is_high FROM lb WHERE m < 3) USING (symbol, is_high) GROUP BY 1, 2) USING (symbol, is_high)),
me AS (SELECT symbol, is_high, slope, c AS intercept, count(*) AS touches, min(idx) AS a, max(idx) AS b FROM (SELECT *, median(rest) OVER (PARTITION BY symbol, is_high) AS c FROM md) WHERE abs(rest - c) <= tol GROUP BY ALL HAVING count(*) >= 3),
st AS (SELECT symbol, is_high, slope, intercept, touches, a::INTEGER AS first_touch, b::INTEGER AS last_touch, round(greatest(0, least(1, 0.5 * least(1.0, touches / 5) + 0.5 * (b - a) / greatest(n - 1, 1))), 4) AS strength, 'trendline' AS source, true AS is_trendline,
  count(*) OVER w = 2 AND (max(slope) OVER w - min(slope) OVER w) / greatest(max(abs(slope)) OVER w, 1e-9) <= 0.05 AS is_channel FROM (SELECT * FROM lf UNION ALL SELECT * FROM me) JOIN fx USING (symbol) WINDOW w AS (PARTITION BY symbol))"""


@query(
    """SELECT symbol, 'level_' || CASE WHEN is_high THEN 'resistance' ELSE 'support' END AS structure_type, round(100 * strength, 1) AS score, round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(slope * (n - 1) + intercept, 6) AS price_at_last, touches, first_touch, last_touch,
    CASE WHEN slope > 1e-9 THEN 'rising' WHEN slope < -1e-9 THEN 'falling' ELSE 'horizontal' END AS slope_label, source, is_trendline, is_channel FROM (SELECT * FROM fl UNION ALL SELECT * FROM st) JOIN fx USING (symbol)""", _BARS, _TR, _PIV, _LINES, _LEVELS)
def levels_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All levels of every series as match rows: zones, profile, round prices and trend lines."""
    return rounded(level_driver.level_matches(settled(series(spark, sf_dir))))


@query()
def stream_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest bars of each event type after all events went through a stream, batch by batch into a table; the stream ends when its input does."""
    import uuid

    schema = table(spark, sf_dir, "events").schema
    ticks = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    bars = ticks.select(F.col("event_type").alias("symbol"), F.unix_millis(F.col("ts").cast("timestamp")).alias("open_time"), F.col("value").alias("close"))
    at = f"{shared_folder(spark)}/stream-buffer-{uuid.uuid4().hex}"
    out = live.latest_buffer(bars)
    run = live.into_table(out, f"{at}/rows", f"{at}/state")
    run.awaitTermination()
    last = Window.partitionBy("symbol").orderBy(F.col("last_time").desc())
    return spark.read.schema(out.schema).parquet(f"{at}/rows").withColumn("_rn", F.row_number().over(last)).where("_rn = 1").drop("_rn")


# --- curves, squeezes, types ---

_FIT = """fx AS (SELECT *, idx - (count(*) OVER p - 1) / 2 AS x FROM nm WINDOW p AS (PARTITION BY symbol)),
fs AS (SELECT *, count(*) OVER p AS n, sum(x ** 2) OVER p AS s2, sum(x ** 4) OVER p AS s4, sum(y) OVER p AS sy, sum(x * y) OVER p AS sxy, sum(x ** 2 * y) OVER p AS sx2y FROM fx WINDOW p AS (PARTITION BY symbol)),
fab AS (SELECT *, (n * sx2y - s2 * sy) / (n * s4 - s2 ** 2) AS a, sxy / s2 AS b FROM fs),
fit AS (SELECT symbol, any_value(a) AS a, any_value(b) AS b, avg(abs(y - (a * x ** 2 + b * x + (sy - a * s2) / n))) AS cr, avg(abs(y - (b * x + sy / n))) AS lr FROM fab GROUP BY 1)"""


@query("SELECT symbol, round(a, 6) AS a, round(b, 6) AS b, round(cr, 6) AS curve_residual, round(lr, 6) AS line_residual FROM fit", _BARS, _NORM, _FIT)
def quadfit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(structures.curve_fit(lines(spark, sf_dir)[0]))


@query(
    """SELECT symbol, low_idx, round(a, 6) AS a, low_idx >= 0.35 * n AND low_idx <= 0.65 * n AND least(f, l) - low >= 0.10 AND a > 0 AND cr <= 0.6 * lr AS found FROM (SELECT symbol, arg_min(idx, row(y, idx)) AS low_idx, min(y) AS low,
    arg_min(y, idx) AS f, arg_max(y, idx) AS l, count(*) AS n FROM nm GROUP BY 1) JOIN fit USING (symbol)""", _BARS, _NORM, _FIT)
def rounding_bottom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(structures.rounding_bottom(lines(spark, sf_dir)[0]))


@query(
    """SELECT symbol, top, round(pole, 6) AS pole, round(c, 6) AS convergence, coalesce(pole >= 0.12 AND c >= 0.15, false) AS found FROM (SELECT symbol, top, pole, CASE WHEN r1 > 0 THEN 1 - r2 / r1 END AS c FROM
    (SELECT symbol, top, max(high) - min(y) FILTER (idx <= top) AS pole, max(y) FILTER (g AND h) - min(y) FILTER (g AND h) AS r1, max(y) FILTER (g AND NOT h) - min(y) FILTER (g AND NOT h) AS r2 FROM
    (SELECT *, idx > top AND idx <= top + floor((n - top) * 0.65) AS g, idx <= top + floor((n - top) * 0.65 / 2) AS h FROM nm JOIN
    (SELECT symbol, arg_max(idx, row(y, -idx)) AS top, max(y) AS high, max(n) AS n FROM (SELECT *, count(*) OVER (PARTITION BY symbol) AS n FROM nm) WHERE idx < 0.6 * n GROUP BY 1) USING (symbol)) GROUP BY 1, 2))""", _BARS, _NORM)
def pennant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(structures.pennant(lines(spark, sf_dir)[0]))


@query(
    """SELECT symbol, round(h, 6) AS highs, round(l, 6) AS lows, round(hm, 6) AS high_move, round(lm, 6) AS low_move, CASE WHEN h < 0.2 AND lm > 0.1 THEN 'squeeze_up' WHEN l < 0.2 AND hm < -0.1 THEN 'squeeze_down' END AS type FROM
    (SELECT symbol, count(*) AS n, max(price) FILTER (is_high) - min(price) FILTER (is_high) AS h, max(price) FILTER (NOT is_high) - min(price) FILTER (NOT is_high) AS l,
    arg_max(price, idx) FILTER (is_high) - arg_min(price, idx) FILTER (is_high) AS hm, arg_max(price, idx) FILTER (NOT is_high) - arg_min(price, idx) FILTER (NOT is_high) AS lm FROM yp GROUP BY 1) WHERE n >= 4""", _BARS, _NORM)
def squeeze(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(structures.squeezes(lines(spark, sf_dir)[1]))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, type, confidence, ord of all detectors on the latest lines."""
    norm, points = lines(spark, sf_dir)
    found = [
        ("double_top", patterns.double_extremes(norm, points, True, 0.1)), ("double_bottom", patterns.double_extremes(norm, points, False, 0.1)),
        ("triple_top", patterns.triple_extremes(norm, points, True, 0.1)), ("triple_bottom", patterns.triple_extremes(norm, points, False, 0.1)),
        ("head_shoulders", patterns.head_shoulders(points, True)), ("inv_head_shoulders", patterns.head_shoulders(points, False)),
    ]
    rows = [d.select("symbol", F.lit(name).alias("type"), "confidence", F.lit(i).alias("ord")) for i, (name, d) in enumerate(found)]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


@query()
def type_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The type scan: every series with its primary type, the surest first."""
    return rounded(structures.primary_types(candidates(spark, sf_dir))).orderBy(F.col("confidence").desc(), "symbol")


@query()
def pattern_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each series the number of types it shares with the first one, a single row."""
    return structures.shared_types(candidates(spark, sf_dir))


# --- scores of lines and pivots ---

_PROM = """prom AS (SELECT p.symbol, p.idx, is_high, price, CASE WHEN is_high THEN price - min(y) ELSE max(y) - price END AS prominence FROM (SELECT *, coalesce(lag(idx) OVER o, 0) AS a, coalesce(lead(idx) OVER o, 2147483647) AS b
  FROM yp WINDOW o AS (PARTITION BY symbol ORDER BY idx, is_high)) p JOIN nm ON nm.symbol = p.symbol AND nm.idx BETWEEN a AND b GROUP BY p.symbol, p.idx, is_high, price)"""
_SWINGS = """sw AS (SELECT symbol, highs, lows, CASE WHEN highs >= 2 THEN hh / (highs - 1) ELSE 0 END AS hh, CASE WHEN highs >= 2 THEN lh / (highs - 1) ELSE 0 END AS lh, CASE WHEN lows >= 2 THEN hl / (lows - 1) ELSE 0 END AS hl,
  CASE WHEN lows >= 2 THEN ll / (lows - 1) ELSE 0 END AS ll FROM (SELECT symbol, count(*) FILTER (is_high) AS highs, count(*) FILTER (NOT is_high) AS lows, count(*) FILTER (is_high AND d > 0) AS hh, count(*) FILTER (is_high AND d < 0) AS lh,
  count(*) FILTER (NOT is_high AND d > 0) AS hl, count(*) FILTER (NOT is_high AND d < 0) AS ll FROM (SELECT *, price - lag(price) OVER (PARTITION BY symbol, is_high ORDER BY idx) AS d FROM yp) GROUP BY 1))"""


@query("SELECT symbol, idx, is_high, round(price, 6) AS price, round(prominence, 6) AS prominence FROM prom", _BARS, _NORM, _PROM)
def pivot_prominence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.prominences(*lines(spark, sf_dir)))


@query(
    """SELECT symbol, round(CASE WHEN n < 10 OR coalesce(m, 0) < 2 OR span < 1e-10 THEN 0.0 ELSE 0.25 * least(1.0, m / 4) + 0.30 * turns / greatest(1, m - 1) + 0.25 * least(1.0, coalesce(o, 0) * 5) + 0.20 * greatest(0.0, 1 - noise / 3) END, 6) AS quality
    FROM (SELECT symbol, count(*) AS n, max(y) - min(y) AS span, stddev_pop(mv) / (avg(mv) + 1e-10) AS noise FROM (SELECT symbol, y, abs(y - lag(y) OVER (PARTITION BY symbol ORDER BY idx)) AS mv FROM nm) GROUP BY 1) LEFT JOIN
    (SELECT symbol, count(*) AS m, count(*) FILTER (turn) AS turns, avg(prominence) FILTER (prominence > 0) AS o FROM (SELECT *, is_high <> lag(is_high) OVER (PARTITION BY symbol ORDER BY idx, is_high) AS turn FROM prom) GROUP BY 1) USING (symbol)""",
    _BARS, _NORM, _PROM)
def quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.quality(*lines(spark, sf_dir)))


@query(
    """SELECT symbol, idx, round(tanh(dy / (dx + 1e-10)), 6) AS slope, round(atan2(dx * ny - dy * nx, dx * nx + dy * ny) / pi(), 6) AS turn, round(CASE WHEN t > 0 THEN d / t ELSE d END, 6) AS share FROM
    (SELECT *, sum(d) OVER (PARTITION BY symbol) AS t FROM (SELECT *, lead(dx) OVER o AS nx, lead(dy) OVER o AS ny, sqrt(dx * dx + dy * dy) AS d FROM (SELECT symbol, idx, is_high, (idx - lag(idx) OVER o) / n AS dx, price - lag(price) OVER o AS dy
    FROM yp JOIN (SELECT symbol, count(*) AS n FROM nm GROUP BY 1) USING (symbol) WINDOW o AS (PARTITION BY symbol ORDER BY idx, is_high)) WINDOW o AS (PARTITION BY symbol ORDER BY idx, is_high))) WHERE dx IS NOT NULL""", _BARS, _NORM)
def pivot_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.legs(*lines(spark, sf_dir)))


@query("SELECT symbol, highs, lows, round(hh, 6) AS hh, round(lh, 6) AS lh, round(hl, 6) AS hl, round(ll, 6) AS ll FROM sw", _BARS, _NORM, _SWINGS)
def swing_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.swings(lines(spark, sf_dir)[1]))


@query(
    """SELECT symbol, round(coalesce(sy, 0), 6) AS symmetry, round(CASE WHEN highs >= 2 AND lows >= 2 AND s0 > 0 THEN greatest(-1.0, least(1.0, (s0 - s1) / s0)) ELSE 0 END, 6) AS convergence,
    round(CASE WHEN highs + lows < 3 THEN 0 ELSE (greatest(hh, lh) + greatest(hl, ll)) / 2 END, 6) AS consistency FROM sw JOIN (SELECT symbol, abs(arg_min(price, idx) FILTER (is_high) - arg_min(price, idx) FILTER (NOT is_high)) AS s0,
    abs(arg_max(price, idx) FILTER (is_high) - arg_max(price, idx) FILTER (NOT is_high)) AS s1 FROM yp GROUP BY 1) USING (symbol) LEFT JOIN (SELECT a.symbol, avg(0.5 * (1 - least(1.0, abs(a.price - b.price))) + CASE WHEN a.is_high = b.is_high THEN 0.5 ELSE 0 END) AS sy
    FROM rk a JOIN rk b ON a.symbol = b.symbol AND b.r = a.m - 1 - a.r WHERE a.m >= 4 AND a.r < a.m // 2 GROUP BY 1) USING (symbol)""", _BARS, _NORM, _SWINGS,
    "rk AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY idx, is_high) - 1 AS r, count(*) OVER (PARTITION BY symbol) AS m FROM yp)")
def pivot_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.geometry(lines(spark, sf_dir)[1]))


@query(
    """SELECT symbol, round(CASE WHEN n < 10 OR mean = 0 THEN 0.5 ELSE least(1.0, least(1.5, coalesce(at_p / mean, 1)) / 1.5 * 0.3 + least(1.5, CASE WHEN v1 > 0 THEN v2 / v1 ELSE 1 END) / 1.5 * 0.3 + least(2.0, vt / mean) / 2.0 * 0.4) END, 6) AS volume_confirmation
    FROM (SELECT symbol, count(*) AS n, avg(volume) AS mean, avg(volume) FILTER (idx < floor(c / 2)) AS v1, avg(volume) FILTER (idx >= floor(c / 2)) AS v2, avg(volume) FILTER (idx >= floor(c * 0.85)) AS vt FROM (SELECT *, count(*) OVER (PARTITION BY symbol) AS c FROM s) GROUP BY 1)
    LEFT JOIN (SELECT symbol, avg(volume) AS at_p FROM piv JOIN (SELECT symbol, idx, volume FROM s) USING (symbol, idx) GROUP BY 1) USING (symbol)""", _BARS, _PIV)
def volume_confirmation(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = series(spark, sf_dir)
    return rounded(features.volume_confirmation(bars, windows.pivots(bars)))


@query(
    """SELECT symbol, idx, is_high, round(price, 6) AS price, round(score, 6) AS score FROM (SELECT *, round(0.5 * CASE WHEN prominence > 0 THEN prominence ELSE abs(price - mean) END + 0.3 * greatest(coalesce(abs(price - lag(price) OVER o), 0), coalesce(abs(price - lead(price) OVER o), 0)) + 0.2, 9) AS score
    FROM prom JOIN (SELECT symbol, avg(y) AS mean FROM nm GROUP BY 1) USING (symbol) WINDOW o AS (PARTITION BY symbol ORDER BY idx, is_high)) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY score DESC, idx DESC, is_high DESC) <= 10""", _BARS, _NORM, _PROM)
def important_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.important_pivots(*lines(spark, sf_dir)))


@query(
    """SELECT symbol, dir AS direction, round(CASE WHEN dir IS NULL THEN 0 ELSE least(1.0, conf) END, 6) AS confidence, NOT coalesce(CASE WHEN n < 6 THEN false WHEN dir = 'up' THEN last - tv < -0.35 OR (high_at < cut AND hi - last > 0.45) WHEN dir = 'down' THEN last - tv > 0.35 OR (low_at < cut AND last - lo > 0.45) END, false) AS is_active FROM
    (SELECT *, CASE WHEN few THEN CASE WHEN abs(mv) > 0.4 AND abs(lean) > 0.3 THEN CASE WHEN lean > 0 THEN 'up' ELSE 'down' END END WHEN mv > 0.15 AND (hh >= 0.5 OR hl >= 0.5) AND cu > 0.35 THEN 'up' WHEN mv < -0.15 AND (lh >= 0.5 OR ll >= 0.5) AND cd > 0.35 THEN 'down'
    WHEN abs(mv) > 0.55 AND r2 > 0.5 THEN CASE WHEN mv > 0 THEN 'up' ELSE 'down' END END AS dir, CASE WHEN few THEN CASE WHEN abs(mv) > 0.4 AND abs(lean) > 0.3 THEN 0.5 * abs(mv) + 0.5 * abs(lean) END WHEN mv > 0.15 AND (hh >= 0.5 OR hl >= 0.5) AND cu > 0.35 THEN cu
    WHEN mv < -0.15 AND (lh >= 0.5 OR ll >= 0.5) AND cd > 0.35 THEN cd WHEN abs(mv) > 0.55 AND r2 > 0.5 THEN 0.5 * abs(mv) + 0.5 * r2 END AS conf FROM
    (SELECT *, least(1.0, abs(mv)) * 0.35 + (hh + hl) / 2 * 0.35 + r2 * 0.3 AS cu, least(1.0, abs(mv)) * 0.35 + (lh + ll) / 2 * 0.35 + r2 * 0.3 AS cd, highs < 2 OR lows < 2 AS few FROM
    (SELECT l.*, coalesce(highs, 0) AS highs, coalesce(lows, 0) AS lows, coalesce(hh, 0) AS hh, coalesce(hl, 0) AS hl, coalesce(lh, 0) AS lh, coalesce(ll, 0) AS ll FROM (SELECT symbol, count(*) AS n, max(cut) AS cut, arg_max(y, idx) AS last, arg_max(y, idx) - arg_min(y, idx) AS mv, min(y) AS lo, max(y) AS hi,
    max(y) FILTER (idx = cut) AS tv, arg_min(idx, row(y, idx)) AS low_at, arg_max(idx, row(y, -idx)) AS high_at, corr(y, idx) ** 2 AS r2, tanh(regr_slope(y, idx) * count(*) / (max(y) - min(y) + 1e-10)) * abs(corr(y, idx)) AS lean FROM
    (SELECT *, c - greatest(5, floor(c / 5)) AS cut FROM (SELECT *, count(*) OVER (PARTITION BY symbol) AS c FROM nm)) GROUP BY 1) l LEFT JOIN sw USING (symbol))))""", _BARS, _NORM, _SWINGS)
def trend_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.trends(*lines(spark, sf_dir)))


@query()
def pivot_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pivot sequences and leg lengths of every series against those of the first one, a single row."""
    norm, points = lines(spark, sf_dir)
    spoken = points.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("idx", "is_high", "price"))).alias("p")).select("symbol", F.col("p.price").alias("p"))
    lengths = features.legs(norm, points).groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("idx", "share"))).alias("d")).select("symbol", F.col("d.share").alias("d"))
    rows = spoken.join(lengths, "symbol", "left")
    rows = similarity.against(rows, rows.orderBy("symbol").select(F.col("p").alias("q"), F.col("d").alias("e")))
    return rounded(rows.select("symbol", features.pivot_likeness(F.col("p"), F.col("q")).alias("pivots"), features.distance_likeness(F.col("d"), F.col("e")).alias("distances")))


# --- replay: what detectors say at every bar ---

_FRAMES = """fb AS (SELECT event_type AS symbol, '4h' AS timeframe, time_bucket(INTERVAL '4 hours', ts) AS open_time, arg_min(value, row(ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, row(ts, event_id)) AS close, count(*) AS volume FROM events GROUP BY 1, 2, 3
  UNION ALL SELECT event_type, '8h', time_bucket(INTERVAL '8 hours', ts), arg_min(value, row(ts, event_id)), max(value), min(value), arg_max(value, row(ts, event_id)), count(*) FROM events GROUP BY 1, 2, 3),
rb AS (SELECT *, (row_number() OVER (PARTITION BY symbol, timeframe ORDER BY open_time, close) - 1)::INTEGER AS place FROM fb)"""
_STEPS = _FRAMES + """,
s AS (SELECT a.symbol || '@' || a.timeframe || '@' || a.place AS symbol, b.place - a.place + 49 AS idx, b.open_time, b.open, b.high, b.low, b.close, b.volume FROM rb a JOIN rb b ON a.symbol = b.symbol AND a.timeframe = b.timeframe AND b.place BETWEEN a.place - 49 AND a.place WHERE a.place >= 49)"""
_REPLAY = "rt AS (SELECT split_part(symbol, '@', 1) AS symbol, split_part(symbol, '@', 2) AS timeframe, split_part(symbol, '@', 3)::INTEGER AS step, direction, confidence, is_active FROM (" + ORACLES["trend_states"].replace(_BARS, _STEPS) + "))"


def framed_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All bars of every symbol at two widths, with their places."""
    rows = [event_bars(spark, sf_dir, width).withColumn("timeframe", F.lit(name)) for width, name in (("4 hours", "4h"), ("8 hours", "8h"))]
    return replay.placed(rows[0].unionByName(rows[1]), "symbol", "timeframe")


@query("SELECT * FROM rt", _REPLAY)
def replay_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trend over the last 50 bars at every step of every series and width."""
    keys = ("symbol", "timeframe")
    rows = replay.step_bars(replay.steps(framed_history(spark, sf_dir), 50, keys), keys)
    one = F.concat_ws("@", "symbol", "timeframe", F.col("step").cast("string"))
    norm = settled(windows.normalised(rows.withColumn("symbol", one)).select("symbol", "idx", "y"))
    found = rounded(features.trends(norm, windows.pivots(norm, 5, "y", "y")))
    at = lambda i: F.split_part("symbol", F.lit("@"), F.lit(i))
    return found.select(at(1).alias("symbol"), at(2).alias("timeframe"), at(3).cast("int").alias("step"), "direction", "confidence", "is_active")


@query(
    """SELECT symbol, timeframe, step, direction, is_active, was_direction, was_is_active FROM (SELECT *, lag(direction) OVER o AS was_direction, lag(is_active) OVER o AS was_is_active, lag(step) OVER o IS NULL AS first FROM rt
    WINDOW o AS (PARTITION BY symbol, timeframe ORDER BY step)) WHERE first OR direction IS DISTINCT FROM was_direction OR is_active IS DISTINCT FROM was_is_active""", _REPLAY)
def structure_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The steps at which the trend or its activity changes."""
    rows = replay_trends(spark, sf_dir).drop("confidence")
    return replay.changes(rows, "direction", "is_active", keys=("symbol", "timeframe"))


@query(
    """SELECT CASE g WHEN 1 THEN 'pattern' WHEN 2 THEN 'timeframe' ELSE 'all' END AS "by", coalesce(pattern_type, t.timeframe) AS name, events, confirmed, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall,
    round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 6) AS f1, CASE WHEN g = 2 THEN round(coalesce(rate, 0), 6) END AS repaint_rate FROM
    (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall FROM (SELECT pattern_type, timeframe, grouping_id(pattern_type, timeframe) AS g, sum(n)::BIGINT AS events, sum(c)::BIGINT AS confirmed,
    sum(h)::BIGINT AS tp, (sum(n) - sum(h))::BIGINT AS fp, (sum(m) - sum(h))::BIGINT AS fn FROM parts GROUP BY GROUPING SETS ((pattern_type), (timeframe), ()))) t LEFT JOIN rates USING (timeframe)""",
    _REPLAY, _FRAMES,
    """labels AS (SELECT symbol, timeframe, CASE WHEN arg_max(close, place) > arg_min(close, place) THEN 'up' ELSE 'down' END AS pattern_type, min(place) AS start, max(place) AS "end" FROM rb WHERE place % 25 BETWEEN 5 AND 15 GROUP BY symbol, timeframe, place // 25),
    parts AS (SELECT timeframe, direction AS pattern_type, 1 AS n, is_active::INTEGER AS c, 0 AS m, 0 AS h FROM rt WHERE direction IS NOT NULL
    UNION ALL SELECT timeframe, pattern_type, 0, 0, 1, (EXISTS (FROM rt WHERE rt.symbol = labels.symbol AND rt.timeframe = labels.timeframe AND rt.direction = labels.pattern_type AND rt.step BETWEEN labels.start - 3 AND labels."end" + 3))::INTEGER FROM labels),
    rates AS (SELECT timeframe, avg(rate) AS rate FROM (SELECT symbol, timeframe, coalesce(sum((p AND (NOT np OR direction <> nd))::INTEGER) / nullif(sum(p::INTEGER), 0), 0) AS rate FROM (SELECT *, lead(p) OVER o AS np, lead(direction) OVER o AS nd FROM
    (SELECT symbol, timeframe, step, direction, is_active AND direction IS NOT NULL AS p FROM rt) WINDOW o AS (PARTITION BY symbol, timeframe ORDER BY step)) WHERE np IS NOT NULL GROUP BY 1, 2) GROUP BY 1)""")
def replay_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of the replayed trends against labels of the moves of every 25 bars."""
    rows = settled(replay_trends(spark, sf_dir).withColumnRenamed("direction", "type"))
    marks = framed_history(spark, sf_dir).where("idx % 25 between 5 and 15").groupBy("symbol", "timeframe", F.floor(F.col("idx") / 25).alias("b"))
    marks = marks.agg(F.max_by("close", "idx").alias("last"), F.min_by("close", "idx").alias("first"), F.min("idx").alias("start"), F.max("idx").alias("end"))
    labels = marks.select("symbol", "timeframe", F.when(F.col("last") > F.col("first"), "up").otherwise("down").alias("pattern_type"), "start", "end")
    return rounded(replay.totals(rows, labels))


@query()
def replay_structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The confirmed structure at every bar of every series (V1, W22): a step sees no later bar."""
    rows = replay.placed(event_bars(spark, sf_dir), "symbol")
    return rounded(replay.replay_structures(rows, settle=settled))


# --- klines, tickers and the universe, from files of answers ---


def exchange(spark: SparkSession, sf_dir: str) -> str:
    """A folder of answers made from the events: bars of two widths of every event type, and an error for one of them."""
    import uuid

    at = f"{shared_folder(spark)}/klines-{uuid.uuid4().hex}"
    width = F.when(F.col("timeframe") == "4h", F.expr("interval 4 hours")).otherwise(F.expr("interval 8 hours"))
    rows = framed_history(spark, sf_dir).withColumn("close_time", F.col("open_time") + width - F.expr("interval 1 millisecond"))
    klines.write_klines(rows, at, 70)
    gone = rows.where("symbol = 'error'").select("symbol", "timeframe").limit(1).withColumn("value", F.lit('{"code": -1121, "msg": "Invalid symbol."}'))
    klines.write_answers(gone, at)
    return at


@query("SELECT symbol, timeframe, epoch_ms(open_time) AS open_time, open, high, low, close, volume::DOUBLE AS volume, epoch_ms(open_time) + 14399999 AS close_time FROM fb WHERE timeframe = '4h' AND symbol <> 'error' QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY open_time DESC) <= 100", _FRAMES)
def klines_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 100 bars of every symbol at one timeframe, read from the answers; a symbol with an error is on the blocklist."""
    at = exchange(spark, sf_dir)
    return klines.klines(spark, at, timeframes=["4h"], blocklist=klines.unavailable(spark, at))


@query(
    """SELECT symbol, timeframe, coalesce(bars, 0) AS bars, last_close, last_time FROM (SELECT DISTINCT event_type AS symbol FROM events UNION ALL SELECT 'nothing') CROSS JOIN (SELECT unnest(['4h', '8h', '1d']) AS timeframe) LEFT JOIN
    (SELECT symbol, timeframe, count(*) AS bars, arg_max(close, open_time) AS last_close, max(epoch_ms(open_time) + CASE timeframe WHEN '4h' THEN 14399999 ELSE 28799999 END) AS last_time FROM (FROM fb WHERE symbol <> 'error' QUALIFY row_number() OVER (PARTITION BY symbol, timeframe ORDER BY open_time DESC) <= 60) GROUP BY 1, 2) USING (symbol, timeframe)""", _FRAMES)
def klines_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every symbol at every timeframe with what was found for it."""
    at = exchange(spark, sf_dir)
    names = table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol")).distinct().unionByName(spark.createDataFrame([("nothing",)], "symbol string"))
    return klines.asked(klines.klines(spark, at, limit=60, blocklist=klines.unavailable(spark, at)), names, ["4h", "8h", "1d"])


_PAIRS = """tk AS (SELECT upper(event_type) || CASE WHEN event_type = 'purchase' THEN 'BTC' ELSE 'USDT' END AS symbol, (arg_max(value, event_id) - arg_min(value, event_id)) / arg_min(value, event_id) * 100 AS pct, sum(value * 100) AS volume FROM events WHERE value > 0 GROUP BY 1, event_type)"""


def pairs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickers of trading pairs as text, made from the events; one pair has another quote."""
    kind = F.col("event_type")
    rows = table(spark, sf_dir, "events").where("value > 0").groupBy(F.concat(F.upper(kind), F.when(kind == "purchase", "BTC").otherwise("USDT")).alias("symbol"))
    rows = rows.agg(F.min_by("value", "event_id").alias("first"), F.max_by("value", "event_id").alias("last"), F.sum(F.col("value") * 100).alias("v"))
    return rows.select("symbol", ((F.col("last") - F.col("first")) / F.col("first") * 100).cast("string").alias("price_change_percent"), F.col("v").cast("string").alias("quote_volume"))


@query("SELECT replace(symbol, 'USDT', '') AS symbol, round(pct, 2) AS change, round(volume, 2) AS quote_volume FROM tk WHERE suffix(symbol, 'USDT')", _PAIRS)
def ticker_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes and volumes of the pairs against one quote."""
    return klines.tickers(pairs_of(spark, sf_dir)).withColumn("quote_volume", F.round("quote_volume", 2))


@query("SELECT t.symbol, change, quote_volume, bars FROM (SELECT replace(symbol, 'USDT', '') AS symbol, round(pct, 2) AS change, round(volume, 2) AS quote_volume FROM tk WHERE suffix(symbol, 'USDT')) t RIGHT JOIN (SELECT upper(symbol) AS symbol, count(*) AS bars FROM fb WHERE timeframe = '4h' GROUP BY 1) USING (symbol)".replace("t.symbol", "symbol"), _PAIRS, _FRAMES)
def change_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each series with its symbol's 24 h change (J5); none for a symbol without a ticker."""
    rows = framed_history(spark, sf_dir).where("timeframe = '4h'").groupBy(F.upper("symbol").alias("symbol")).agg(F.count("*").alias("bars"))
    return rows.join(ticker_scan(spark, sf_dir), "symbol", "left").select("symbol", "change", "quote_volume", "bars")


#: Names from parts, some made into names that cannot have a market.
_COINS = """cn AS (SELECT CASE p_partkey % 7 WHEN 0 THEN 'USDC' WHEN 1 THEN 'WETH' WHEN 2 THEN upper(replace(p_name, ' ', '_')) WHEN 3 THEN upper(replace(p_name, ' ', '')) ELSE upper(split_part(p_name, ' ', 1)) || p_size END AS symbol, (p_retailprice * 100)::BIGINT::DOUBLE * p_size AS volume, p_partkey AS place FROM part),
  ok AS (SELECT * FROM cn WHERE symbol NOT IN ('USDC', 'WETH') AND NOT contains(symbol, '_') AND length(symbol) <= 10 AND volume >= 1000000)"""


def coins(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, name = F.col("p_partkey") % 7, F.col("p_name")
    symbol = F.when(k == 0, "USDC").when(k == 1, "WETH").when(k == 2, F.upper(F.replace(name, F.lit(" "), F.lit("_")))).when(k == 3, F.upper(F.replace(name, F.lit(" "), F.lit("")))).otherwise(F.concat(F.upper(F.split_part(name, F.lit(" "), F.lit(1))), F.col("p_size").cast("string")))
    return table(spark, sf_dir, "part").select(symbol.alias("symbol"), (F.round(F.col("p_retailprice") * 100).cast("long").cast("double") * F.col("p_size")).alias("volume"), F.col("p_partkey").alias("place"))


@query("SELECT symbol, row_number() OVER (ORDER BY min(place), symbol)::INTEGER AS place, 'ranked' AS origin FROM ok GROUP BY symbol ORDER BY min(place), symbol LIMIT 30", _COINS)
def universe_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The universe from the ranked source."""
    return klines.universe(spark, coins(spark, sf_dir), None)


@query("SELECT symbol, row_number() OVER (ORDER BY max(volume) DESC, symbol)::INTEGER AS place, 'traded' AS origin FROM ok GROUP BY symbol ORDER BY max(volume) DESC, symbol LIMIT 30", _COINS)
def universe_traded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The universe where the ranked source gives no row: the most traded."""
    rows = coins(spark, sf_dir)
    return klines.universe(spark, rows.limit(0), rows.select("symbol", F.col("volume").alias("quote_volume")))


# --- stored tables ---


def filled_store(spark: SparkSession, sf_dir: str) -> Store:
    """Structures (users), their matches (events) and feedback (every third event), put in by inserts; structures of every fifth user are deleted with all that hangs on them."""
    import uuid

    store_ = Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")
    events = table(spark, sf_dir, "events")
    names = store_.insert("structures", events.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("name"), "user_id").distinct())
    own = names.select(F.col("id").alias("structure_id"), "user_id")
    rows = events.join(own, "user_id").select("structure_id", "event_id", F.col("event_type").alias("timeframe"), F.col("value").alias("score"))
    first, second = (store_.insert("matches", rows.where(F.col("event_id") % 2 == i)) for i in (0, 1))
    found = first.unionByName(second).where(F.col("event_id") % 3 == 0)
    store_.insert("feedback", found.select(F.col("id").alias("match_id"), (F.col("event_id") % 2).cast("int").alias("is_relevant"), "event_id"))
    store_.delete("structures", names.where(F.col("user_id") % 5 == 0).select("id"))
    return store_


@query(
    """SELECT 'structures' AS name, count(DISTINCT user_id) AS n, sum(DISTINCT user_id)::BIGINT AS sum FROM events WHERE user_id % 5 <> 0 UNION ALL SELECT 'matches', count(*), sum(event_id)::BIGINT FROM events WHERE user_id % 5 <> 0
    UNION ALL SELECT 'feedback', count(*), sum(event_id)::BIGINT FROM events WHERE user_id % 5 <> 0 AND event_id % 3 = 0""")
def store_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of three stored tables after a delete that cascades."""
    kept = filled_store(spark, sf_dir)
    count = lambda name, c: kept.read(name).agg(F.count("*").alias("n"), F.sum(c).alias("sum")).select(F.lit(name).alias("name"), "n", "sum")
    return count("structures", "user_id").unionByName(count("matches", "event_id")).unionByName(count("feedback", "event_id"))


@query("SELECT event_id, event_type AS timeframe, value AS score FROM events WHERE user_id % 5 <> 0 AND event_type = 'click' ORDER BY value DESC, event_id LIMIT 50")
def store_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best stored matches of a timeframe, in order (T5, F8)."""
    return filled_store(spark, sf_dir).latest("matches", 50, F.col("score").desc(), F.col("event_id"), where=F.col("timeframe") == "click").select("event_id", "timeframe", "score")


# --- learning from detections ---


@query()
def ml_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections at every bar with the score of a forest that did not see them (ML1 to ML4, S20).

    A detection is relevant if the close five bars on lies on its side; the model is saved, loaded by version and scores the quarter that was kept apart.
    """
    import uuid

    bars = settled(replay.placed(event_bars(spark, sf_dir), "symbol"))
    found = relevance.detection_features(settled(replay.detections(bars, settle=settled)), F.lit(240))
    later = bars.select("symbol", (F.col("idx") - 5).alias("step"), F.col("close").alias("later"))
    rows = found.join(later, ["symbol", "step"]).withColumn("up", F.col("later") > F.element_at("closes", -1))
    says_up = F.col("way").eqNullSafe("up") | (F.col("way").isNull() & (F.col("trend") > 0))
    rows = rows.withColumn("label", (says_up == F.col("up")).cast("double")).select("symbol", "step", "type", "label", *relevance.DETECTION_FEATURES)
    split = settled(relevance.stratified(rows, "symbol", "step", settle=settled))
    model = relevance.train(split.where("not apart"), 50, features=relevance.DETECTION_FEATURES)
    if model is not None:
        models = Models(Store(spark, f"{shared_folder(spark)}/models-{uuid.uuid4().hex}"))
        model, _ = models.load(models.save(model, {"n": split.count()}))
    return relevance.score(split.where("apart"), model).select("symbol", "step", "type", "label", F.round("ml_score", 6).alias("ml_score"))


# --- scans: filters and what stands behind a match ---

_HELD = """hs AS (SELECT 'u' || user_id % 40 AS symbol, event_type || ['', '_w30', '_w50'][event_id % 3 + 1] AS timeframe, (event_id % 3)::INTEGER AS ord, event_id, CASE WHEN k % 11 = 0 THEN NULL ELSE ['double_top', 'flag', 'range'][k % 3 + 1] END AS type, ['range', 'flag', 'pennant'][k % 2 + 1 + (k % 5 = 0)::INTEGER] AS other,
  k / 100.0 AS confidence, (k % 50) / 50.0 AS sure, event_id % 4 <> 0 AS is_active, (k * 7 % 100) / 100.0 AS volume, event_type AS base FROM (SELECT *, (props->>'$.k')::INTEGER AS k FROM events))"""


def held_structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structures as the event table has them: types, patterns and confidences by the number in ``props``."""
    k, i = F.get_json_object("props", "$.k").cast("int"), F.col("event_id")
    pick = lambda values, at: F.element_at(F.array(*[F.lit(v) for v in values]), at.cast("int") + 1)
    other = pick(("range", "flag", "pennant"), k % 2 + (k % 5 == 0).cast("int"))
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), (F.col("user_id") % 40).cast("string")).alias("symbol"), F.concat("event_type", pick(("", "_w30", "_w50"), i % 3)).alias("timeframe"), (i % 3).cast("int").alias("ord"),
        F.when(k % 11 != 0, pick(("double_top", "flag", "range"), k % 3)).alias("type"), (k / 100).alias("confidence"), F.create_map(other, (k % 50) / 50).alias("patterns"), (i % 4 != 0).alias("is_active"), (k * 7 % 100 / 100).alias("volume_confirmation"),
    )


@query(
    """SELECT symbol, base AS timeframe, is_primary, round(least(100.0, score * CASE WHEN w >= 3 THEN 1.08 WHEN w >= 2 THEN 1.04 ELSE 1.0 END), 1) AS score, w AS timeframes FROM (SELECT * FROM (SELECT *, coalesce(type = 'flag', false) AS is_primary, CASE WHEN type = 'flag' THEN 100.0 ELSE round(100 * CASE WHEN volume > 0.7 THEN least(1.0, c * (1 + (volume - 0.7) * 0.3)) WHEN volume < 0.3 THEN c * 0.85 ELSE c END, 1) END AS score
    FROM (SELECT *, CASE WHEN other = 'flag' THEN sure ELSE confidence END AS c FROM hs WHERE type IS NOT NULL AND (type = 'flag' OR other = 'flag'))) WHERE is_active QUALIFY row_number() OVER (PARTITION BY symbol, base ORDER BY ord, timeframe, is_primary, score) = 1)
    JOIN (SELECT symbol, count(DISTINCT base) AS w FROM hs WHERE type IS NOT NULL AND (type = 'flag' OR other = 'flag') GROUP BY 1) USING (symbol)""", _HELD)
def type_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series that show a type, with volume and timeframes in the score."""
    return scans.type_hits(held_structures(spark, sf_dir), "flag")


ORACLES["type_hits_of_timeframe"] = ORACLES["type_hits"].replace("WHERE is_active QUALIFY", "WHERE is_active AND base = 'click' QUALIFY")


def type_hits_of_timeframe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for one base timeframe, its windows included (F8)."""
    return scans.type_hits(held_structures(spark, sf_dir), "flag", timeframe="click")


QUERIES["type_hits_of_timeframe"] = type_hits_of_timeframe


@query(
    """SELECT m.event_id AS match_id, m.symbol, m.timeframe, s.timeframe AS found_in, s.type, s.confidence FROM (SELECT event_id, 'u' || user_id % 50 AS symbol, event_type || CASE WHEN event_id % 5 = 0 THEN '_w70' ELSE '' END AS timeframe, event_type AS base FROM events WHERE value > 10) m
    LEFT JOIN (SELECT * FROM hs WHERE type IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol, base ORDER BY ord, timeframe, type, confidence) = 1) s ON s.symbol = m.symbol AND s.base = m.base""", _HELD)
def standing_structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current structure behind each match: its own series, else the first of its windows."""
    rows = table(spark, sf_dir, "events").where("value > 10")
    found = rows.select(F.col("event_id").alias("match_id"), F.concat(F.lit("u"), (F.col("user_id") % 50).cast("string")).alias("symbol"), F.concat("event_type", F.when(F.col("event_id") % 5 == 0, "_w70").otherwise("")).alias("timeframe"))
    return scans.standing_structures(found, held_structures(spark, sf_dir))


@query("SELECT * FROM (SELECT count(DISTINCT 'u' || user_id % 60) AS total_symbols FROM events) CROSS JOIN (SELECT count(DISTINCT symbol) AS symbols_with_data, count(*) AS total_structures FROM hs WHERE type IS NOT NULL AND symbol IN (SELECT 'u' || user_id % 60 FROM events))", _HELD)
def scan_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the asked symbols have structures, and how many these are."""
    asked = table(spark, sf_dir, "events").select(F.concat(F.lit("u"), (F.col("user_id") % 60).cast("string")).alias("symbol"))
    return scans.scan_statistics(asked, held_structures(spark, sf_dir))


@query("SELECT type AS name, count(*) AS n FROM hs WHERE symbol = 'u3' AND base = 'click' AND NOT contains(timeframe, '_w') GROUP BY GROUPING SETS ((type), ())", _HELD)
def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of a symbol and timeframe by type and in all."""
    labels = held_structures(spark, sf_dir).withColumnRenamed("type", "pattern_type")
    return scans.label_counts(scans.labels_of(labels, "u3", "click"))


@query("SELECT event_id AS match_id, event_type AS timeframe, value AS score, coalesce(CASE WHEN k % 7 <> 0 THEN k / 100.0 END >= 0.5, true) AS is_relevant FROM (SELECT *, (props->>'$.k')::INTEGER AS k FROM events)")
def relevant_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches with whether their score of relevance reaches the threshold; without a score they do."""
    k = F.get_json_object("props", "$.k").cast("int")
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("match_id"), F.col("event_type").alias("timeframe"), F.col("value").alias("score"), F.when(k % 7 != 0, k / 100).alias("ml_score"))
    return scans.relevant(rows).drop("ml_score")


@query(
    """SELECT symbol, name, round(CASE WHEN va > 1e-12 AND vb > 1e-12 THEN cov / sqrt(va * vb) ELSE 0 END, 6) AS pearson FROM (SELECT symbol, name, avg(y * v) - avg(y) * avg(v) AS cov, avg(y * y) - avg(y) ** 2 AS va, avg(v * v) - avg(v) ** 2 AS vb FROM (SELECT symbol, idx, y FROM nm WHERE symbol IN (SELECT symbol FROM nm GROUP BY 1 HAVING count(*) = 100)) JOIN
    (SELECT i AS idx, name, CASE name WHEN 'triangle_up' THEN 0.5 + sin(x * 8 * pi()) * (0.5 - x) * 0.5 WHEN 'triangle_down' THEN 0.5 + sin(x * 8 * pi()) * x * 0.5 WHEN 'trend_up' THEN x * 0.8 + 0.1 + sin(x * 6 * pi()) * 0.08 WHEN 'trend_down' THEN (1 - x) * 0.8 + 0.1 + sin(x * 6 * pi()) * 0.08
    WHEN 'range' THEN sin(x * 8 * pi()) * 0.15 + 0.5 ELSE sin(x * 10 * pi()) * 0.3 * exp(-2 * x) + 0.5 END AS v FROM (SELECT i, i / 99 AS x FROM range(100) r(i)) CROSS JOIN (SELECT unnest(['triangle_up', 'triangle_down', 'trend_up', 'trend_down', 'range', 'compression']) AS name)) USING (idx) GROUP BY 1, 2)""", _BARS, _NORM)
def preset_likeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How every series of 100 bars goes with each named line (S13, J1): the lines are a few arrays beside each row."""
    norm, _ = lines(spark, sf_dir)
    rows = norm.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("idx", "y"))).alias("b")).where("size(b) = 100").select("symbol", F.col("b.y").alias("y"))
    named = F.array(*[F.struct(F.lit(name).alias("name"), shapes.named_line(name).alias("v")) for name in shapes.NAMED[:-1]])
    rows = settled(rows.select("symbol", "y", F.explode(named).alias("p")))
    return rounded(rows.select("symbol", "p.name", similarity.pearson(F.col("y"), F.col("p.v")).alias("pearson")))


# --- the same detectors on walks, at the surveyed tolerances ---

#: Each user group's running balance of its events, whole numbers, one bar an event: lines that wander, so that every shape occurs.
_WALKS = """wk AS (SELECT 'u' || user_id % 30 AS symbol, ts AS open_time, sum(round(value * 100)::BIGINT % 200 - 100) OVER (PARTITION BY user_id % 30 ORDER BY ts, event_id)::DOUBLE AS close, row_number() OVER (PARTITION BY user_id % 30 ORDER BY ts DESC, event_id DESC) AS rn FROM events),
s AS (SELECT symbol, open_time, close AS open, close AS high, close AS low, close, 1 AS volume, (row_number() OVER (PARTITION BY symbol ORDER BY rn DESC) - 1)::INTEGER AS idx FROM wk WHERE rn <= 100)"""


def walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("symbol").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").withColumn("symbol", F.concat(F.lit("u"), (F.col("user_id") % 30).cast("string")))
    rows = rows.select("symbol", "ts", "event_id", F.sum(F.round(F.col("value") * 100).cast("long") % 200 - 100).over(order).cast("double").alias("close"))
    back = Window.partitionBy("symbol").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    rows = rows.withColumn("rn", F.row_number().over(back)).where("rn <= 100")
    return rows.select("symbol", F.col("ts").alias("open_time"), *[F.col("close").alias(c) for c in ("open", "high", "low", "close")], F.lit(1).cast("long").alias("volume"), (F.row_number().over(order) - 1).alias("idx"))


def walk_lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    norm = windows.normalised(walks(spark, sf_dir)).select("symbol", "idx", "y", "close")
    return norm, windows.pivots(norm, 5, "y", "y")


def _on_walks(name: str, run: Callable[[DataFrame, DataFrame], DataFrame], **tolerance: str) -> None:
    """Registers the query ``name`` on walks; ``was`` and ``now``: the tolerance in its SQL."""
    sql = ORACLES[name].replace(_BARS, _WALKS)
    if tolerance:
        sql = sql.replace(f"/ {tolerance['was']})", f"/ {tolerance['now']})").replace(f"< {tolerance['was']} ", f"< {tolerance['now']} ")
    ORACLES[f"walk_{name}"] = sql
    QUERIES[f"walk_{name}"] = lambda spark, sf_dir: rounded(run(*walk_lines(spark, sf_dir)))


_on_walks("double_top", lambda n, p: patterns.double_extremes(n, p, True), was="0.1", now="0.03")
_on_walks("double_bottom", lambda n, p: patterns.double_extremes(n, p, False), was="0.1", now="0.03")
_on_walks("triple_top", lambda n, p: patterns.triple_extremes(n, p, True), was="0.1", now="0.035")
_on_walks("triple_bottom", lambda n, p: patterns.triple_extremes(n, p, False), was="0.1", now="0.035")
_on_walks("head_shoulders", lambda n, p: patterns.head_shoulders(p, True))
_on_walks("inverse_head_shoulders", lambda n, p: patterns.head_shoulders(p, False))
_on_walks("flag", lambda n, p: patterns.flags(n))
_on_walks("impulse", lambda n, p: patterns.impulse(n))
_on_walks("trend_states", lambda n, p: features.trends(n, p))
_on_walks("rounding_bottom", lambda n, p: structures.rounding_bottom(n))
_on_walks("pennant", lambda n, p: structures.pennant(n))
_on_walks("squeeze", lambda n, p: structures.squeezes(p))
_on_walks("important_pivots", lambda n, p: features.important_pivots(n, p))


@query("SELECT symbol, timeframe AS label, place AS idx, epoch_ms(open_time) AS open_time, high, low, close, volume::DOUBLE AS volume FROM rb", _FRAMES)
def json_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series written as JSON objects with their bars and read back."""
    import uuid

    at = f"{shared_folder(spark)}/dataset-{uuid.uuid4().hex}"
    rows = framed_history(spark, sf_dir).withColumn("open_time", F.unix_millis(F.col("open_time").cast("timestamp"))).withColumnRenamed("timeframe", "label")
    datasets.write_dataset(rows, at)
    return datasets.read_dataset(spark, at).drop("open")
