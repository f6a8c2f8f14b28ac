"""Session defaults shared by tests, benchmarks and scripts."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int | str = "*", memory: str = "8g", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with adaptive execution, UTC and Arrow transfer."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("lexlake")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Make the library importable for Python workers: where their environment doesn't name its folder, as a zip file."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = (spark._jvm.System.getenv("PYTHONPATH") or "").split(os.pathsep)
    context = spark.sparkContext
    if root in known or getattr(context, "_lexlake_shipped", False):
        return
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="lexlake-"), "lexlake"), "zip", root, "lexlake")
    context.addPyFile(archive)
    context._lexlake_shipped = True


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder (see ``checkpointed``), removed when the session's JVM ends."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lexlake-")
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def small(df: DataFrame, limit: int = 100_000) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``limit`` rows, short ones; beyond, joins shuffle."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once, its lineage cut, in the folder that ``spark.checkpoint.dir`` names; a local session without
    that setting gets a temporary one."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        root = context.getConf().get("spark.checkpoint.dir")
        if not root and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(root or "file://" + tempfile.mkdtemp(prefix="lexlake-"))
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str, rows: int = 0) -> DataFrame:
    """``df`` computed once, as a Parquet table in the shared folder (see ``scratch``); with ``rows`` in files of so many at most: a task that reads
    it takes small files by their number, so what it reads is bounded in rows too."""
    path = scratch(df.sparkSession, name)
    df.write.option("maxRecordsPerFile", rows).parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._lexlake_path = path
    return table


def forget(*tables: DataFrame) -> None:
    """Delete tables of ``written`` whose last reader has run."""
    for table in tables:
        spark = table.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(table._lexlake_path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def partitions(spark: SparkSession, rows: int, each: int) -> int:
    """How many partitions hold ``rows`` at ``each`` at most, one for each core at least: a task's share doesn't grow with the input."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // each))
