"""Writers: partitioned graph tables, keyed merges of tables, JSON lines, migrations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_nodes(nodes: DataFrame, path: str) -> None:
    """Nodes as one partition per label, so that a query of one label reads that alone."""
    nodes.write.mode("overwrite").partitionBy("label").parquet(path)


def write_edges(edges: DataFrame, path: str) -> None:
    """Edges as one partition per kind."""
    edges.write.mode("overwrite").partitionBy("rel").parquet(path)


def replaced(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Old rows but those with the key of a new one, and the new ones (one per key)."""
    return old.join(new, key, "left_anti").unionByName(new.dropDuplicates(key), allowMissingColumns=True)


def merge_into(new: DataFrame, path: str, key: list[str], next_path: str) -> None:
    """Merge rows into the table at ``path`` by writing the merged one to ``next_path``; readers move on when it is whole."""
    replaced(new.sparkSession.read.parquet(path), new, key).write.parquet(next_path)


def migrate(source: DataFrame, target: DataFrame, key: list[str]) -> DataFrame:
    """The rows of ``source`` that ``target`` lacks, in target's columns: appending them twice adds nothing."""
    columns = [F.col(c).cast(target.schema[c].dataType).alias(c) if c in source.columns else F.lit(None).cast(target.schema[c].dataType).alias(c) for c in target.columns]
    return source.dropDuplicates(key).join(target, key, "left_anti").select(*columns)


def evolve(old: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``old`` with the columns of a newer schema that it lacks, as nulls."""
    return old.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in old.columns})


def json_lines(rows: DataFrame, path: str, order: str | None = None) -> None:
    """One JSON object per line, ordered over all files where an order is asked for."""
    (rows.orderBy(order) if order else rows).select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def dictionary(spark, names: dict[str, int], label: str) -> DataFrame:
    """Nodes of a dictionary of constants: id (its code), label, name in title case."""
    rows = spark.createDataFrame(sorted((str(v), k) for k, v in names.items()), "id string, name string")
    return rows.select("id", F.lit(label).alias("label"), F.initcap(F.replace(F.lower("name"), F.lit("_"), F.lit(" "))).alias("name"))
