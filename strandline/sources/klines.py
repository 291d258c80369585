"""Klines, tickers and the universe of symbols from the JSON an exchange answers with, kept as files by series.

A folder holds ``symbol=.../timeframe=.../`` with text files, one answer a line: an array of bars, each an array of twelve values by position (open time in ms, open, high,
low, close, volume, close time, ...), prices as text; or an error object. Filters on symbol and timeframe prune folders, so a scan lists and reads
the asked series alone; the bars' limit is applied per series before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Stable coins, names without a market, and the symbols used where no source answers.
STABLE_COINS = ("USDT", "USDC", "BUSD", "DAI", "TUSD", "USDP", "FDUSD", "PYUSD", "GUSD", "FRAX", "USDS", "USDE")
WITHOUT_MARKET = ("WBT", "FIGR_HELOC", "WETH", "STETH", "WSTETH", "LEO", "BTCB", "WEETH", "SUSDE", "CBBTC")
DEFAULT_SYMBOLS = (
    "BTC", "ETH", "BNB", "SOL", "XRP", "ADA", "DOGE", "AVAX", "DOT", "MATIC", "LINK", "LTC", "ATOM", "UNI", "XLM", "TRX", "NEAR", "APT", "FIL", "ARB", "OP", "INJ", "SUI", "SEI", "TIA",
    "PEPE", "SHIB", "BONK", "WIF", "FLOKI",
)
LONGEST_NAME = 10
QUOTE = "USDT"
_SERIES = ["symbol", "timeframe"]


def write_klines(bars: DataFrame, path: str, answer: int = 500) -> None:
    """Writes bars (symbol, timeframe, open_time as timestamp, open, high, low, close, volume, close_time) as answers of at most ``answer`` bars."""
    ms = lambda c: F.unix_millis(F.col(c).cast("timestamp")).cast("string")
    text = lambda c: F.concat(F.lit('"'), F.col(c).cast("string"), F.lit('"'))
    zero = F.lit('"0"')
    one = F.concat(F.lit("["), F.concat_ws(",", ms("open_time"), *[text(c) for c in ("open", "high", "low", "close", "volume")], ms("close_time"), zero, F.lit("0"), zero, zero, zero), F.lit("]"))
    place = F.row_number().over(Window.partitionBy(*_SERIES).orderBy("open_time")) - 1
    rows = bars.select(*_SERIES, F.floor(place / answer).alias("_a"), F.struct(ms("open_time").cast("long").alias("t"), one.alias("j")).alias("b"))
    rows = rows.groupBy(*_SERIES, "_a").agg(F.array_sort(F.collect_list("b")).alias("b"))
    rows.select(*_SERIES, F.concat(F.lit("["), F.concat_ws(",", "b.j"), F.lit("]")).alias("value")).write.mode("append").partitionBy(*_SERIES).text(path)


def write_answers(answers: DataFrame, path: str) -> None:
    """Appends answers as they came: symbol, timeframe, value."""
    answers.select(*_SERIES, "value").write.mode("append").partitionBy(*_SERIES).text(path)


def answers(spark: SparkSession, path: str) -> DataFrame:
    """symbol, timeframe, and ``rows``: an array of arrays of text, null for an answer that is not one."""
    raw = spark.read.schema("value string, symbol string, timeframe string").text(path)
    return raw.select(*_SERIES, F.from_json("value", "array<array<string>>").alias("rows"))


def unavailable(spark: SparkSession, path: str) -> DataFrame:
    """Symbols of which an answer was no array or an empty one: the blocklist of later scans."""
    return answers(spark, path).where("rows is null or size(rows) = 0").select("symbol").distinct()


def klines(spark: SparkSession, path: str, symbols: list[str] | None = None, timeframes: list[str] | None = None, limit: int = 100, blocklist: DataFrame | None = None) -> DataFrame:
    """The last ``limit`` bars of each asked series (S1 to S3): symbol, timeframe, open_time, open, high, low, close, volume, close_time (times in ms).

    ``symbols`` and ``timeframes`` prune folders; symbols of ``blocklist`` are left out by an anti-join. Bars of one time are one: that of the latest close time. A bar with
    a value that is no number is left out.
    """
    raw = spark.read.schema("value string, symbol string, timeframe string").text(path)
    if symbols is not None:
        raw = raw.where(F.col("symbol").isin(*symbols))
    if timeframes is not None:
        raw = raw.where(F.col("timeframe").isin(*timeframes))
    if blocklist is not None:
        raw = raw.join(blocklist.select("symbol"), "symbol", "left_anti")
    rows = raw.select(*_SERIES, F.explode(F.from_json("value", "array<array<string>>")).alias("k"))
    number = lambda i, name, kind: F.expr(f"try_cast(get(k, {i}) as {kind})").alias(name)
    rows = rows.select(*_SERIES, number(0, "open_time", "bigint"), *[number(i, c, "double") for i, c in enumerate(("open", "high", "low", "close", "volume"), 1)], number(6, "close_time", "bigint")).na.drop()
    once = Window.partitionBy(*_SERIES, "open_time").orderBy(F.col("close_time").desc(), "close")
    newest = Window.partitionBy(*_SERIES).orderBy(F.col("open_time").desc())
    rows = rows.withColumn("_rn", F.row_number().over(once)).where("_rn = 1").withColumn("_rn", F.row_number().over(newest))
    return rows.where(F.col("_rn") <= limit).drop("_rn")


def asked(found: DataFrame, symbols: DataFrame, timeframes: list[str]) -> DataFrame:
    """Every symbol at every timeframe (S7) with the bars found and the last close and its time (J6): 0 bars where a series gave none. ``symbols``: one column, symbol."""
    wanted = symbols.select("symbol", F.explode(F.lit(timeframes)).alias("timeframe"))
    have = found.groupBy(*_SERIES).agg(F.count("*").alias("bars"), F.max_by("close", "open_time").alias("last_close"), F.max("close_time").alias("last_time"))
    return wanted.join(have, _SERIES, "left").na.fill(0, ["bars"])


def tickers(raw: DataFrame, quote: str = QUOTE) -> DataFrame:
    """Base symbol, change in percent (two places) and quote volume of pairs against ``quote`` (S4); a volume that is no number is null."""
    rows = raw.where(F.col("symbol").endswith(quote))
    change = F.round(F.coalesce(F.expr("try_cast(price_change_percent as double)"), F.lit(0.0)), 2)
    return rows.select(F.replace("symbol", F.lit(quote), F.lit("")).alias("symbol"), change.alias("change"), F.expr("try_cast(quote_volume as double)").alias("quote_volume"))


def valid(symbol: str = "symbol") -> Column:
    """Whether a symbol can have a market (F2): no stable coin, not known to be without one, no underscore, at most ten letters."""
    name = F.col(symbol)
    return ~name.isin(*STABLE_COINS) & ~name.isin(*WITHOUT_MARKET) & ~name.contains("_") & (F.length(name) <= LONGEST_NAME)


def universe(spark: SparkSession, ranked: DataFrame | None, traded: DataFrame | None, most: int = 30, least_volume: float = 1e6) -> DataFrame:
    """The symbols to scan: symbol, place and origin.

    From ``ranked`` (symbol, place, volume; by place) if it has any row, else the most traded of ``traded`` (symbol, quote_volume) that pass, else ``DEFAULT_SYMBOLS``.
    Both keep valid symbols of at least ``least_volume`` alone; the defaults are not filtered. One row a symbol; ties of volume by name.
    """
    first = None
    if ranked is not None and not ranked.isEmpty():
        rows = ranked.select(F.upper("symbol").alias("symbol"), "place", F.coalesce("volume", F.lit(0.0)).alias("volume")).where(valid() & (F.col("volume") >= least_volume))
        first = rows.groupBy("symbol").agg(F.min("place").alias("o")).withColumn("origin", F.lit("ranked"))
    elif traded is not None:
        rows = traded.where(valid() & (F.col("quote_volume") >= least_volume)).groupBy("symbol").agg((-F.max("quote_volume")).alias("o")).withColumn("origin", F.lit("traded"))
        first = None if rows.isEmpty() else rows
    if first is None:
        first = spark.createDataFrame([(s, i, "default") for i, s in enumerate(DEFAULT_SYMBOLS)], "symbol string, o long, origin string")
    best = first.orderBy("o", "symbol").limit(most)  # at most ``most`` rows meet
    return best.select("symbol", (F.row_number().over(Window.orderBy("o", "symbol"))).alias("place"), "origin")
