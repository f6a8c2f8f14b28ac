"""Scores of exams, and of retrieval strategies against each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def score(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """total, answered, correct, score: right answers in percent of the answered, 0 if none was."""
    right = F.count_if(F.col("answer") == F.col("key"))
    out = rows.groupBy(*by).agg(F.count("*").alias("total"), F.count("answer").alias("answered"), right.alias("correct"))
    return out.withColumn("score", F.when(F.col("answered") == 0, 0.0).otherwise(100.0 * F.col("correct") / F.col("answered")))


def overlap(hits: DataFrame, k: int) -> DataFrame:
    """a, b, shared, share: of each pair of strategies, the results that both have."""
    left = hits.select(F.col("strategy").alias("a"), "id").distinct()
    right = hits.select(F.col("strategy").alias("b"), "id").distinct()
    pairs = left.join(right, "id").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    return pairs.withColumn("share", 100.0 * F.col("shared") / k)


def per_strategy(hits: DataFrame) -> DataFrame:
    """strategy, n, mean_score."""
    return hits.groupBy("strategy").agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"))
