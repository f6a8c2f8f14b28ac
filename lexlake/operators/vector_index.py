"""An inverted-file vector index on disk: lists of vectors by nearest centroid, for cosine similarity.

    <path>/centroids   list, centroid: fitted on a bounded sample, the ``SAMPLE_ROWS`` vectors with the least hashes of their ids
    <path>/lists       id, vector, partitioned by list; every vector with a length is in exactly one
    <path>/radii       list, cosine: the least cosine of a vector of the list to its centroid, a row for each list and each write

A search ranks the centroids for every query and reads only the lists that some query probes. With ``exact`` a second round probes every
list that, by the angle from the query to its centroid and its radius, may still hold a nearer vector than the k-th found; the result is then
that of a full scan. Lists of any size are cut into blocks of vectors and queries (``blocks.nearest``), so a hot list is many tasks' work.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexlake.operators.blocks import matrix, nearest
from lexlake.session import checkpointed

SAMPLE_ROWS = 65_536
MOST_LISTS = 4_096
ROUNDS = 12
#: Vectors of a list that one file holds, about.
FILE_ROWS = 250_000


def _units(vectors: np.ndarray) -> np.ndarray:
    lengths = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(lengths > 0, lengths, 1)


def fitted(sample: np.ndarray, lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of unit length by spherical k-means from evenly spaced sample rows; a centroid that no row is nearest to goes to the row that is
    worst served."""
    sample = _units(sample)
    centroids = sample[np.linspace(0, len(sample) - 1, min(lists, len(sample))).astype(int)]
    for _ in range(rounds):
        near, best = np.empty(len(sample), np.int64), np.empty(len(sample))
        for s in range(0, len(sample), 8192):
            cos = sample[s : s + 8192] @ centroids.T
            near[s : s + 8192], best[s : s + 8192] = cos.argmax(1), cos.max(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, sample)
        empty = np.flatnonzero(np.bincount(near, minlength=len(centroids)) == 0)
        sums[empty] = sample[np.argsort(best)[: len(empty)]]
        centroids = _units(sums)
    return centroids


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """id, vector, list, cosine (to the list's centroid) of the vectors (id, vector) that have a length."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cos = _units(matrix(batch.column("vector"))) @ centroids.T
                columns = [batch.column("id"), batch.column("vector"), pa.array(cos.argmax(1).astype(np.int32)), pa.array(cos.max(1))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "vector", "list", "cosine"])

    length = F.aggregate("vector", F.lit(0.0), lambda a, x: a + F.abs(x.cast("double")))
    rows = vectors.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<float>").alias("vector")).filter("id IS NOT NULL").filter(length > 0)
    return rows.mapInArrow(assign, "id long, vector array<float>, list int, cosine double")


def _written(rows: DataFrame, path: str) -> None:
    """Append assigned vectors, a list's files of ``FILE_ROWS`` rows each, and their radii."""
    spark = rows.sparkSession
    staged = f"{path}/staged"
    rows.write.mode("overwrite").parquet(staged)
    rows = spark.read.schema(rows.schema).parquet(staged)
    sizes = rows.groupBy("list").agg(F.ceil(F.count("*") / FILE_ROWS).cast("int").alias("_files"), F.min("cosine").alias("cosine"))
    dealt = rows.join(F.broadcast(sizes.select("list", "_files")), "list").withColumn("_file", F.pmod(F.xxhash64("id"), F.col("_files")))
    dealt.repartition("list", "_file").sortWithinPartitions("list").select("id", "vector", "list").write.mode("append").partitionBy("list").parquet(f"{path}/lists")
    sizes.select("list", "cosine").coalesce(1).write.mode("append").parquet(f"{path}/radii")
    fs, at = _files(spark, staged)
    fs.delete(at, True)


def create(vectors: DataFrame, path: str, lists: int | None = None) -> None:
    """Index vectors (id long, vector) at a path where there is none yet; about a list for each square root of their number by default."""
    spark = vectors.sparkSession
    fs, at = _files(spark, f"{path}/centroids")
    if fs.exists(at):
        raise FileExistsError(path)
    known = vectors.filter("vector IS NOT NULL")
    lists = lists or min(MOST_LISTS, max(1, math.isqrt(known.count())))
    sample = known.select("vector", F.xxhash64("id").alias("h"), "id").orderBy("h", "id").limit(SAMPLE_ROWS).select("vector").toArrow()
    rows = matrix(sample.column("vector").combine_chunks()) if sample.num_rows else np.zeros((0, 1))
    rows = rows[np.linalg.norm(rows, axis=1) > 0]
    centroids = fitted(rows, lists) if len(rows) else rows
    table = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "list int, centroid array<double>")
    table.coalesce(1).write.parquet(f"{path}/centroids")
    if len(rows):
        _written(_assigned(vectors, centroids), path)


def centroids_of(spark: SparkSession, path: str) -> np.ndarray:
    """The centroids, by list; at most ``MOST_LISTS`` unless more were asked for."""
    rows = spark.read.parquet(f"{path}/centroids").orderBy("list").collect()
    return np.array([r["centroid"] for r in rows])


def add(vectors: DataFrame, path: str) -> None:
    """Append vectors to their lists; ids that are there already are there twice."""
    centroids = centroids_of(vectors.sparkSession, path)
    if not len(centroids):
        raise ValueError("the index was made without vectors: drop and create it")
    _written(_assigned(vectors, centroids), path)


def drop(spark: SparkSession, path: str) -> bool:
    """Delete the index; whether there was one."""
    fs, at = _files(spark, path)
    return fs.delete(at, True)


def _probes(queries: DataFrame, centroids: np.ndarray, radii: np.ndarray, first: int, end: int) -> DataFrame:
    """query_no and list: of each query's centroids by nearness those from ``first`` up to ``end`` whose list can hold a vector of cosine
    ``least`` (a column of ``queries``; null: any), by the angle to the centroid and the list's radius."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 256):
                part = batch.slice(s, 256)
                cos = np.clip(_units(matrix(part.column("vector"))) @ centroids.T, -1, 1)
                order = np.argsort(-cos, axis=1, kind="stable")[:, first:end]
                near = np.take_along_axis(cos, order, 1)
                bound = np.cos(np.maximum(np.arccos(near) - np.arccos(np.clip(radii, -1, 1))[order], 0))
                # a hair of slack, as bounds and scores are rounded
                row, place = np.nonzero(bound >= part.column("least").fill_null(-2.0).to_numpy()[:, None] - 1e-7)
                yield pa.RecordBatch.from_arrays([part.column("query_no").take(pa.array(row)), pa.array(order[row, place], pa.int32())], ["query_no", "list"])

    return queries.select("query_no", "vector", "least").mapInArrow(probe, "query_no long, list int")


def search(queries: DataFrame, path: str, k: int, probes: int, exact: bool = False) -> DataFrame:
    """query_no, id, score, rank: the k vectors of greatest cosine of each query (query_no long, unique; vector), ties by id."""
    spark = queries.sparkSession
    centroids = centroids_of(spark, path)
    if not len(centroids):
        return spark.createDataFrame([], "query_no long, id long, score double, rank int")
    least = dict(spark.read.parquet(f"{path}/radii").groupBy("list").agg(F.min("cosine")).collect())
    radii = np.array([least.get(i, 1.0) for i in range(len(centroids))])
    length = F.aggregate("vector", F.lit(0.0), lambda a, x: a + F.abs(x.cast("double")))
    queries = queries.filter(length > 0).select(F.col("query_no").cast("long").alias("query_no"), "vector", F.lit(None).cast("double").alias("least"))
    stored = spark.read.parquet(f"{path}/lists").select("id", "vector", F.col("list").cast("int").alias("key"))

    def round_of(asked: DataFrame) -> DataFrame:
        # the lists asked for, at most all, prune the partitions that are read
        wanted = [r[0] for r in asked.select("list").distinct().collect()]
        own = asked.select("query_no", F.col("list").alias("key")).join(queries.select("query_no", "vector"), "query_no")
        return nearest(own, stored.filter(F.col("key").isin(wanted)), k)

    first = round_of(_probes(queries, centroids, radii, 0, probes))
    if not exact:
        return first
    first = checkpointed(first)
    reached = first.groupBy("query_no").agg(F.when(F.max("rank") >= k, F.min("score")).alias("least"))
    more = round_of(_probes(queries.drop("least").join(reached, "query_no", "left"), centroids, radii, probes, len(centroids)))
    rank = F.row_number().over(Window.partitionBy("query_no").orderBy(F.desc("score"), "id"))
    both = first.drop("rank").unionByName(more.drop("rank")).withColumn("rank", rank)
    return both.filter(F.col("rank") <= k)
