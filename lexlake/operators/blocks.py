"""Nearest vectors by block products: both sides of a search may exceed any one task's memory.

Queries and vectors that share a key (a list of an index, or one key for a search of all) are cut into blocks by hash, as many as their
numbers ask for. Each pair of blocks is one sorted run of a shuffle: a task takes in the run's queries, streams its vectors as Arrow
batches, and keeps the k best of each query by matrix products. The few that are left of every block are ranked once more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries that a task holds at a time, and vectors that pass by them, about.
QUERY_BLOCK, VECTOR_BLOCK = 1024, 100_000
#: Scores are compared to so many decimals: sums in another order must not break ties.
DECIMALS = 9


def matrix(column: pa.Array) -> np.ndarray:
    """Arrays of one length as rows of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def scores(queries: np.ndarray, vectors: np.ndarray, metric: str) -> np.ndarray:
    """A row of scores for each query, the greater the nearer (euclidean: the distance below zero); not a number without a length."""
    dots = queries @ vectors.T
    if metric == "dot":
        return np.round(dots, DECIMALS)
    lengths = (queries**2).sum(1)[:, None], (vectors**2).sum(1)[None, :]
    if metric == "euclidean":
        return np.round(-np.sqrt(np.maximum(lengths[0] + lengths[1] - 2 * dots, 0)), DECIMALS)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.round(dots / np.sqrt(lengths[0] * lengths[1]), DECIMALS)


class _Best:
    """The k best of each query of a block."""

    def __init__(self, k: int, metric: str, last_id: bool):
        self.k, self.metric, self.sign = k, metric, -1 if last_id else 1
        self.numbers: list[np.ndarray] = []
        self.parts: list[np.ndarray] = []
        self.queries: np.ndarray | None = None

    def ask(self, numbers: np.ndarray, queries: np.ndarray) -> None:
        self.numbers.append(numbers)
        self.parts.append(queries)

    def see(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        if not self.parts:
            return
        if self.queries is None:
            self.queries = np.concatenate(self.parts)
            self.found = [(np.zeros(0), np.zeros(0, np.int64)) for _ in self.queries]
        for i, row in enumerate(scores(self.queries, vectors, self.metric)):
            s, there = self.found[i]
            near = np.flatnonzero(row >= s[-1] if len(s) == self.k else ~np.isnan(row))
            if len(near):
                s, there = np.concatenate((s, row[near])), np.concatenate((there, ids[near]))
                order = np.lexsort((self.sign * there, -s))[: self.k]
                self.found[i] = s[order], there[order]

    def rows(self) -> pa.RecordBatch | None:
        if self.queries is None:
            return None
        sizes = [len(s) for s, _ in self.found]
        numbers = np.repeat(np.concatenate(self.numbers), sizes)
        columns = [pa.array(numbers), pa.array(np.concatenate([i for _, i in self.found])), pa.array(np.concatenate([s for s, _ in self.found]))]
        return pa.RecordBatch.from_arrays(columns, ["query_no", "id", "score"])


def nearest(queries: DataFrame, vectors: DataFrame, k: int, metric: str = "cosine", last_id: bool = False) -> DataFrame:
    """query_no, id, score, rank: of each query the k vectors of its keys with the best scores; ties by id, ascending or, with ``last_id``,
    descending.

    ``queries``: key, query_no, vector; ``vectors``: key, id, vector (long keys, numbers and ids). A query may have several keys, a vector
    one. Vectors that are null or, by angle, without length have no score; a query without any has no rows.
    """
    sides = [queries.select(F.col("key").cast("long"), F.col("query_no").cast("long").alias("no"), "vector"), vectors.select(F.col("key").cast("long"), F.col("id").cast("long").alias("no"), "vector")]
    sides = [s.filter("key IS NOT NULL AND no IS NOT NULL AND vector IS NOT NULL") for s in sides]

    def blocks(side: DataFrame, size: int, name: str) -> DataFrame:
        return side.groupBy("key").agg(F.ceil(F.count("*") / size).cast("int").alias(name))

    cut = blocks(sides[0], QUERY_BLOCK, "qs").join(blocks(sides[1], VECTOR_BLOCK, "vs"), "key")

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    own = F.pmod(F.xxhash64("no"), F.col("qs")).cast("int")
    asked = sides[0].join(cut, "key").select("key", own.alias("q"), every("vs").alias("v"), F.lit(0).alias("side"), "no", "vector")
    own = F.pmod(F.xxhash64("no"), F.col("vs")).cast("int")
    seen = sides[1].join(cut, "key").select("key", every("qs").alias("q"), own.alias("v"), F.lit(1).alias("side"), "no", "vector")
    runs = asked.unionByName(seen).repartition("key", "q", "v").sortWithinPartitions("key", "q", "v", "side")

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, best = None, None
        for batch in batches:
            marks = np.stack([batch.column(c).to_numpy() for c in ("key", "q", "v", "side")])
            cuts = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                *run, side = marks[:, a].tolist()
                if run != at:
                    if best and (rows := best.rows()):
                        yield rows
                    at, best = run, _Best(k, metric, last_id)
                part = batch.slice(a, b - a)
                (best.see if side else best.ask)(part.column("no").to_numpy(), matrix(part.column("vector")))
        if best and (rows := best.rows()):
            yield rows

    found = runs.mapInArrow(products, "query_no long, id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_no").orderBy(F.desc("score"), F.desc("id") if last_id else F.asc("id")))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)
