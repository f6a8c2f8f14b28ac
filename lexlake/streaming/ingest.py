"""Ingest of laws as a stream: files of landed laws, so many at a time, become rows of node and edge tables.

A micro-batch writes its rows to a folder of its own, named by its number, and overwrites what an attempt before it left there; then a marker makes it visible.
Readers take marked batches only and the newest row of each key, so a batch that is killed and run again leaves the tables as if it had run once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from lexlake.operators import law_tree
from lexlake.session import forget, small, written
from lexlake.sources import laws

LANDED = "law_id string, xml string"


def landed(spark: SparkSession, path: str, files: int = 8) -> DataFrame:
    """A stream of laws from JSON files of a folder, at most so many files in a micro-batch."""
    return spark.readStream.schema(LANDED).option("maxFilesPerTrigger", files).json(path)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def saved(batch: DataFrame, number: int, path: str, after_write=None) -> None:
    """Write a batch's nodes and edges, then its marker; ``after_write`` runs between the two (tests fail there)."""
    spark = batch.sparkSession
    versions = law_tree.article_versions(law_tree.distributed(laws.law_lines(batch.dropDuplicates(["law_id"]))))
    # both tables are made from versions that are worked out once
    versions = written(versions.select("law_id", "article_id", "node_type", "name", "next_id"), "law-versions")
    nodes, edges = law_tree.graph_rows(versions)
    nodes.write.mode("overwrite").parquet(f"{path}/nodes/batch={number}")
    edges.write.mode("overwrite").parquet(f"{path}/edges/batch={number}")
    forget(versions)
    if after_write:
        after_write(number)
    spark.createDataFrame([(number,)], "batch long").coalesce(1).write.mode("overwrite").json(f"{path}/done/batch={number}")


def ingest(stream: DataFrame, path: str, checkpoint: str, after_write=None) -> StreamingQuery:
    """Run over all files there are, a micro-batch at a time; started again with its checkpoint, it goes on where it was."""
    writer = stream.writeStream.foreachBatch(lambda b, n: saved(b, n, path, after_write))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """nodes (by id) or edges (by src, rel, dst) of all finished batches, of equal keys the newest."""
    key = ["id"] if name == "nodes" else ["src", "rel", "dst"]
    if not _exists(spark, f"{path}/done"):
        raise FileNotFoundError(f"{path}: no finished batch")
    done = spark.read.schema("batch long").json(f"{path}/done").select("batch").distinct()
    rows = spark.read.parquet(f"{path}/{name}").withColumn("batch", F.col("batch").cast("long")).join(small(done), "batch", "left_semi")
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest if c != "batch"])
