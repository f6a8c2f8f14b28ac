"""Batches for calls of a bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexlake.operators.folds import folded
from lexlake.session import checkpointed, small

MAX_ITEMS, MAX_TOKENS, MAX_CHARS = 100, 18_000, 72_000


def bins(items: DataFrame, id_: str, text: str, block: str, max_items: int = MAX_ITEMS, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """block, id, n_tokens, bin_no: each block's items, in order, in as few bins as a greedy pass needs.

    A bin is closed when the next item would exceed its items or tokens (a quarter of the
    characters; texts are cut at ``MAX_CHARS``, a null one has none). Only numbers move, and a task holds one bin's totals.
    """
    tokens = F.coalesce(F.floor(F.least(F.char_length(text), F.lit(MAX_CHARS)) / 4).cast("int"), F.lit(0))

    def step(state: tuple[int, int, int], n: int) -> tuple[tuple[int, int, int], tuple]:
        number, k, t = state
        if k and (k >= max_items or t + n > max_tokens):
            number, k, t = number + 1, 0, 0
        return (number, k + 1, t + n), (number,)

    rows = items.select(block, id_, tokens.alias("n_tokens"))
    return folded(rows, block, [id_], "n_tokens", "bin_no int", (0, 0, 0), step)


def placed(items: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``items`` with ``place``, from 0 along the order of each key, null keys included.

    Rows are sorted in ranges of (key, order); a row's place is that in its range and what the ranges before it hold of its key. No task sees
    more than its range, so a key may have any number of rows. The rows are kept in the shared folder: leave out columns that aren't needed.
    """
    keys = [*by, *order]
    rows = items.repartitionByRange(*keys, F.xxhash64(*items.columns)).sortWithinPartitions(*keys, F.xxhash64(*items.columns))
    rows = checkpointed(rows.withColumn("_at", F.monotonically_increasing_id())).withColumn("_run", F.shiftright("_at", 33))
    heads = rows.groupBy(*by, "_run").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    heads = heads.select("_run", (before - F.col("_first")).alias("_shift"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(by)]).withColumnRenamed("_run", "_of")
    on = F.col("_run") == F.col("_of")
    for i, k in enumerate(by):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(small(heads), on).withColumn("place", F.col("_at") + F.col("_shift")).select(*items.columns, "place")


def numbered_chunks(items: DataFrame, by: list[str], order: str, size: int = 500) -> DataFrame:
    """``items`` with chunk_no, runs of ``size`` rows of each key."""
    rows = placed(items, by, [order])
    return rows.withColumn("chunk_no", F.expr(f"cast(place div {size} as int)")).drop("place")
