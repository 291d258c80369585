"""What the text operators share: the shared folder, whole texts, sizes and ordered buckets."""

from __future__ import annotations

import atexit
import shutil
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space (fixed value of the contract).
WORD = r"[^\x20\x09-\x0D]+"

_own_dirs: dict[str, str] = {}
#: Names of bucketed tables by their folder's name.
_tables: dict[str, str] = {}
#: Tables written since the innermost ``scratch`` began.
_written: ContextVar[list[DataFrame] | None] = ContextVar("written", default=None)
#: With this setting Spark removes the shuffle files of a query when it ends, not when the driver happens to collect its garbage.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or our own where that is unset and Spark runs in one process.

    On a cluster an unset folder raises, as each executor would write to a disk of its own. ``checkpoint()`` needs the context's checkpoint folder too, so it is set when Spark has none.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own_dirs:
            _own_dirs[app] = f"/tmp/checkpoints/strandline-{uuid.uuid4().hex}"
            atexit.register(shutil.rmtree, _own_dirs[app], ignore_errors=True)
        at = _own_dirs[app]
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Writes ``df`` to a Parquet table in the shared folder and reads it back: lineage ends there, and the shuffle files it took go."""
    path = fresh_path(df.sparkSession, name)
    with _clean_shuffles(df.sparkSession):
        df.write.option("compression", codec).parquet(path)
    return _noted(df.sparkSession.read.schema(df.schema).parquet(path))


@contextmanager
def _clean_shuffles(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEAN)
        else:
            spark.conf.set(_CLEAN, before)


def _noted(table: DataFrame) -> DataFrame:
    if (written := _written.get()) is not None:
        written.append(table)
    return table


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Removes the tables written within it at its end, but for those given to the function it yields; these are then the outer one's."""
    outer, inner, kept = _written.get(), [], []
    mark = _written.set(inner)

    def keep(table: DataFrame) -> DataFrame:
        kept.append(table)
        return table

    try:
        yield keep
    finally:
        _written.reset(mark)
        for table in inner:
            if not any(table is k for k in kept):
                release(table)
            elif outer is not None:
                outer.append(table)


def bucketed(df: DataFrame, name: str, column: str) -> DataFrame:
    """Like ``materialise``, as a table in as many buckets of ``column`` as there are shuffle partitions: joins on it move the other side alone."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    table = f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    with _clean_shuffles(spark):
        df.write.format("parquet").option("compression", "zstd").bucketBy(shuffle_partitions(spark), column).option("path", path).saveAsTable(table)
    _tables[path.rsplit("/", 1)[1]] = table
    return _noted(spark.table(table))


def sheltered(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` under names that no column made on the way has, and the new name of each column."""
    names = {c: f"in_{i}" for i, c in enumerate(df.columns)}
    return df.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), names


def whole_text(column: str = "text") -> Column:
    """The text itself; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def word_count(column: str = "text") -> Column:
    """Words of a text as a long; null and blank texts have none."""
    return F.expr(rf"regexp_count(coalesce({column}, ''), r'{WORD}')").cast("long")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ordered_buckets(df: DataFrame, key: str, buckets: int, knots: int = 64) -> Column:
    """A bucket number that rises with the long column ``key``; nulls share the first bucket.

    A piecewise linear estimate of the key's distribution: ``knots`` quantiles come to the driver,
    and each span between two of them is cut evenly. What the driver holds does not grow with the
    rows, and any number of buckets can be made. Equal keys share a bucket.
    """
    parts = [i / knots for i in range(knots + 1)]
    row = df.select(F.percentile_approx(key, parts, 10_000).alias("q")).first()
    marks = sorted(set(row["q"] or []))
    if len(marks) < 2:
        return F.lit(0).cast("int")
    each = max(1, -(-buckets // (len(marks) - 1)))
    lows, highs = marks[:-1], marks[1:]
    span = F.greatest(F.lit(1), F.size(F.filter(F.lit(lows), lambda m: m <= F.col(key))))
    low = F.element_at(F.lit(lows), span).cast("double")
    high = F.element_at(F.lit(highs), span).cast("double")
    step = F.floor((F.col(key).cast("double") - low) / (high - low) * each)
    step = F.least(F.lit(each - 1), F.greatest(F.lit(0), step))
    return F.when(F.col(key).isNull(), 0).otherwise((span - 1) * each + step).cast("int")


def input_bytes(df: DataFrame, column: str) -> int:
    """UTF-8 bytes of a string column over all rows."""
    return int(df.select(F.sum(F.octet_length(F.coalesce(F.col(column), F.lit(""))))).first()[0] or 0)


#: Tables up to this many bytes may be broadcast; beyond it a join shuffles both sides.
BROADCAST_BYTES = 48 * 1024 * 1024


def small(table: DataFrame, row_bytes: int) -> DataFrame:
    """``table`` marked for broadcast if its counted rows of ``row_bytes`` stay within ``BROADCAST_BYTES``; else as it is.

    ``table`` should be written already, as its rows are counted.
    """
    return F.broadcast(table) if table.count() * row_bytes <= BROADCAST_BYTES else table


def totals_before(df: DataFrame, order: str, value: str, out: str, block: int = 4096) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over all rows of a lesser ``order`` (a long, each once).

    Sums of blocks of ``block`` orders meet in one window, single rows only within their block.
    """
    rows = df.withColumn("_block", F.floor(F.col(order) / block))
    blocks = rows.groupBy("_block").agg(F.sum(value).alias("_sum"))
    ahead = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("_block", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(blocks, "_block").withColumn(out, F.col("_base") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return rows.drop("_block", "_base")


def numbered(df: DataFrame, out: str, name: str) -> DataFrame:
    """Writes ``df`` and adds ``out``: 0, 1, 2, ... through its partitions one after the other, in the order rows stand in each.

    Only the row counts of partitions meet in one window.
    """
    rows = materialise(df.withColumn("_at", F.monotonically_increasing_id()), name)
    rows = rows.withColumn("_part", F.shiftright("_at", 33))
    counts = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_base"))
    rows = rows.join(small(materialise(bases, f"{name}-bases"), 16), "_part")
    return rows.withColumn(out, F.col("_base") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at", "_part", "_base")


def release(*tables: DataFrame) -> None:
    """Removes tables that ``materialise`` or ``bucketed`` wrote, once nothing reads them any more."""
    for table in tables:
        session = table.sparkSession
        home = shared_dir(session).split(":", 1)[-1]
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            at = session._jvm.org.apache.hadoop.fs.Path(folder)
            if at.toUri().getPath().startswith(home.rstrip("/") + "/"):
                at.getFileSystem(session._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
                if name := _tables.pop(at.getName(), None):
                    session.sql(f"DROP TABLE IF EXISTS {name}")
