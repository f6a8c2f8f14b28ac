"""Pipelines with a record of their runs: rows and time of every step, where its output is, and what failed.

A step is a name and a function of DataFrames. Its output is written to the run's folder, counted while it is written (an observation, no second pass),
and a row goes to the record. A run that failed is taken up again at its first step without a finished row; what is finished is read back, not made again.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

RECORD = "run_id string, place int, step string, status string, rows_in long, rows_out long, seconds double, output string, error string"


@dataclass(frozen=True)
class Step:
    """``make`` turns the output of the step before into this one's; ``counts`` are further aggregates of its rows to observe."""

    name: str
    make: Callable[[DataFrame], DataFrame]


class StepFailed(RuntimeError):
    """A step raised; the record says which and why."""


def record(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the record: one for each time a step finished or failed."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/record")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], RECORD)
    return spark.read.schema(RECORD).json(f"{path}/record")


def _noted(spark: SparkSession, path: str, row: tuple) -> None:
    spark.createDataFrame([row], RECORD).coalesce(1).write.mode("append").json(f"{path}/record")


def run(source: DataFrame, steps: list[Step], path: str, run_id: str) -> DataFrame:
    """The last step's output. Steps of this run that the record calls done are not made again."""
    spark = source.sparkSession
    names = [s.name for s in steps]
    if len(set(names)) < len(names):
        raise ValueError("steps need names of their own")
    done = {r["step"]: r for r in record(spark, path).filter((F.col("run_id") == run_id) & (F.col("status") == "done")).collect()}
    rows, before = source, None
    for place, step in enumerate(steps):
        if step.name in done:
            rows, before = spark.read.parquet(done[step.name]["output"]), done[step.name]["rows_out"]
            continue
        output, began = f"{path}/{run_id}/{place:03d}-{step.name}", time.perf_counter()
        observed = Observation(f"{run_id}-{step.name}")
        try:
            step.make(rows).observe(observed, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(output)
        except Exception as e:
            _noted(spark, path, (run_id, place, step.name, "failed", before, None, time.perf_counter() - began, None, str(e)[:500]))
            raise StepFailed(f"{step.name}: {e}") from e
        n = observed.get["rows"]
        _noted(spark, path, (run_id, place, step.name, "done", before, n, time.perf_counter() - began, output, None))
        rows, before = spark.read.parquet(output), n
        done[step.name] = None
    return rows


def totals(runs: DataFrame) -> DataFrame:
    """run_id, steps, failed, rows_out (of the last step done), seconds."""
    last = F.max_by("rows_out", F.when(F.col("status") == "done", F.col("place")))
    return runs.groupBy("run_id").agg(F.count_if(F.col("status") == "done").alias("steps"), F.count_if(F.col("status") == "failed").alias("failed"), last.alias("rows_out"), F.sum("seconds").alias("seconds"))
