"""Helpers shared by the operators: shared storage, size-checked broadcasts, prefix sums, memory of workers."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Characters that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

#: A table of at most this many short rows may be broadcast.
BROADCAST_ROWS = 100_000


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that all executors share, removed when the session's JVM ends.

    The folder is the cluster's ``spark.checkpoint.dir``; only a local session without that setting, as in
    tests, gets one in the local temporary folder.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lexlake-")
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage and is computed once."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._lexlake_path = path
    return table


def forget(*tables: DataFrame) -> None:
    """Delete tables of ``written`` whose last reader has run."""
    for table in tables:
        spark = table.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(table._lexlake_path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as keep it apart from the columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def arrow_rows(spark: SparkSession, rows: int = 1024) -> None:
    """Hand texts to Python in batches of at most so many rows, for the rest of the session: whole texts are long
    rows, and the default batch of 10 000 would hold them several times over in the JVM and in Python."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


@contextlib.contextmanager
def arrow_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """For what runs inside, batches of at most so many rows go to Python: for rows that hold a block of rows each."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def trimmed() -> None:
    """Give freed memory of this Python worker back to the system: workers stay for later tasks, beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast for a side of at most ``limit`` known rows; beyond, leave the join to shuffle."""
    return F.broadcast(df) if rows <= limit else df


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` where ``value`` is computed once, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def prefix_sums(totals: DataFrame, keys: list[str], index: str, value: str, out: str, radix: int = 1024) -> DataFrame:
    """Exclusive running sums of ``value`` along ``index`` (a long from 0) for each ``keys``.

    ``totals`` has one row per (keys, index). Rows are summed in runs of ``radix`` indexes, then
    the runs among themselves, so one task never gets more than ``radix`` rows of a key, or a
    ``radix``-th of a key's rows. Returns keys, index and ``out``; null keys are keys as any.
    """
    runs = totals.withColumn("_run", F.expr(f"{index} div {radix}"))
    near = Window.partitionBy(*keys, "_run").orderBy(index).rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_near", F.coalesce(F.sum(value).over(near), F.lit(0)))
    far = Window.partitionBy(*keys).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    sums = runs.groupBy(*keys, "_run").agg(F.sum(value).alias("_sum"))
    sums = sums.withColumn("_far", F.coalesce(F.sum("_sum").over(far), F.lit(0))).drop("_sum")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*keys, "_run"]]
    on = same[0]
    for x in same[1:]:
        on = on & x
    joined = runs.alias("a").join(sums.alias("b"), on)
    return joined.select(*[F.col(f"a.{k}") for k in [*keys, index]], (F.col("a._near") + F.col("b._far")).alias(out))
