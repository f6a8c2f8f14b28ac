"""Ordered migrations of a table, each applied once and recorded.

A migration makes the next version of the whole table in a folder of its own; then one line of the record names it, and with that line the version is the
table. A sitting that is killed leaves no line for what it did not finish, and the next one makes that again.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

RECORD = "number int, name string, folder string, seconds double"


@dataclass(frozen=True)
class Migration:
    """``change`` turns the table as the migrations before left it into the next version; numbers begin at 1 and leave no gaps."""

    number: int
    name: str
    change: Callable[[DataFrame], DataFrame]


def record(spark: SparkSession, path: str) -> DataFrame:
    """What was applied, by number; 0 is the table as it was made."""
    return spark.read.schema(RECORD).json(f"{path}/record").orderBy("number")


def _noted(spark: SparkSession, path: str, row: tuple) -> None:
    spark.createDataFrame([row], RECORD).coalesce(1).write.mode("append").json(f"{path}/record")


def create(rows: DataFrame, path: str) -> None:
    """Version 0 of a table."""
    began = time.perf_counter()
    rows.write.parquet(f"{path}/version=0")
    _noted(rows.sparkSession, path, (0, "", "version=0", time.perf_counter() - began))


def read(spark: SparkSession, path: str) -> DataFrame:
    """The table after the last migration."""
    return spark.read.parquet(f"{path}/{record(spark, path).collect()[-1]['folder']}")


def apply(spark: SparkSession, path: str, migrations: list[Migration]) -> list[int]:
    """Apply those of the migrations that are not on record, in order; returns their numbers. The list must begin with all that are on record, under the
    names they have there."""
    migrations = sorted(migrations, key=lambda m: m.number)
    if [m.number for m in migrations] != list(range(1, len(migrations) + 1)):
        raise ValueError("numbers of migrations must begin at 1 and leave no gaps")
    done = {r["number"]: r["name"] for r in record(spark, path).collect() if r["number"]}
    for number, name in done.items():
        if number > len(migrations) or migrations[number - 1].name != name:
            raise ValueError(f"migration {number} is on record as {name!r}")
    applied = []
    for m in migrations[len(done) :]:
        began, folder = time.perf_counter(), f"version={m.number}"
        m.change(read(spark, path)).write.mode("overwrite").parquet(f"{path}/{folder}")
        _noted(spark, path, (m.number, m.name, folder, time.perf_counter() - began))
        applied.append(m.number)
    return applied
