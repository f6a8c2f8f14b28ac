"""Conversations: listings, last messages, context history, merged metadata, cascading deletes, token budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexlake.operators.folds import folded


def listing(messages: DataFrame) -> DataFrame:
    """conv_id, n_messages, last_turn, preview: the first 100 characters of the first user message."""
    user = F.col("role") == "user"
    return messages.groupBy("conv_id").agg(
        F.count("*").alias("n_messages"),
        F.max("turn").alias("last_turn"),
        F.substring(F.min_by(F.when(user, F.col("text")), F.when(user, F.col("turn"))), 1, 100).alias("preview"),
    )


def last_messages(messages: DataFrame, n: int = 10) -> DataFrame:
    """The last ``n`` messages of every conversation."""
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return messages.withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") <= n).drop("_rn")


def context_history(messages: DataFrame, n: int = 3) -> DataFrame:
    """The last ``n`` answers of every conversation with their age (0: newest) and is_immediate."""
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    rows = messages.filter("role = 'assistant'").withColumn("age", F.row_number().over(newest) - 1)
    return rows.filter(F.col("age") < n).withColumn("is_immediate", F.col("age") == 0)


def last_context(messages: DataFrame) -> DataFrame:
    """conv_id, turn, text of the newest answer."""
    best = F.max_by(F.struct("turn", "text"), "turn").alias("b")
    return messages.filter("role = 'assistant'").groupBy("conv_id").agg(best).select("conv_id", "b.turn", "b.text")


def with_citations(messages: DataFrame, citations: DataFrame, on: list[str], key: str) -> DataFrame:
    """Messages with the ordered array of their citations' keys (empty: none), by one join."""
    per = citations.groupBy(*on).agg(F.sort_array(F.collect_list(key)).alias("citations"))
    return messages.join(per, on, "left").withColumn("citations", F.coalesce("citations", F.array().cast("array<string>")))


def merged_metadata(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Shallow merge of a map column ``metadata``: new entries win."""
    both = old.select(key, F.col("metadata").alias("_o")).join(new.select(key, F.col("metadata").alias("_n")), key, "full")
    empty = F.create_map().cast("map<string,string>")
    o, n = F.coalesce("_o", empty), F.coalesce("_n", empty)
    kept = F.map_filter(o, lambda k, _: ~F.array_contains(F.map_keys(n), k))
    return both.select(key, F.map_concat(kept, n).alias("metadata"))


def deleted(parent: DataFrame, child: DataFrame, gone: DataFrame, key: str, owner: str) -> tuple[DataFrame, DataFrame]:
    """Parent and child tables without the rows that their owner deleted (``gone``: key and owner); children follow."""
    own = parent.join(gone, [key, owner], "left_semi").select(key)
    return parent.join(own, key, "left_anti"), child.join(own, key, "left_anti")


def budget(requests: DataFrame, balance: int, by: str, order: list[str], cost: str) -> DataFrame:
    """``requests`` (key, order, cost) with accepted and left, for a balance per key: in order, a request is accepted if
    what is left covers it, else rejected without effect; a request without a cost is neither."""

    def step(left: float, cost: float | None) -> tuple[float, tuple]:
        fits = None if cost is None else cost <= left
        left = left - cost if fits else left
        return left, (fits, left)

    rows = requests.select(by, *order, F.col(cost).cast("double").alias(cost))
    return folded(rows, by, order, cost, "accepted boolean, left double", float(balance), step)


def owned_feedback(feedback: DataFrame, messages: DataFrame, conversations: DataFrame) -> DataFrame:
    """Feedback (conv_id, turn, user_id and more) on a message that exists, by the owner of its conversation alone."""
    on_message = feedback.join(messages.select("conv_id", "turn"), ["conv_id", "turn"], "left_semi")
    return on_message.join(conversations.select("conv_id", "user_id"), ["conv_id", "user_id"], "left_semi")
