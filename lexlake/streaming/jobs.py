"""Streaming counterparts: daily counters, sessions by inactivity, sliding usage, token budgets."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.query import StreamingQuery


def daily_counters(events: DataFrame, late: str = "1 day") -> DataFrame:
    """day, event_type, n over event time; days close when the watermark passes them."""
    day = F.window("ts", "1 day")
    rows = events.withWatermark("ts", late).groupBy(day, "event_type").agg(F.count("*").alias("n"))
    return rows.select(F.to_date("window.start").alias("day"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """user_id, started_at, ended_at, n_events of sessions that a pause closes."""
    rows = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("n_events"))
    return rows.select("user_id", F.col("s.start").alias("started_at"), F.col("s.end").alias("ended_at"), "n_events")


def usage(events: DataFrame, width: str = "60 seconds", step: str = "10 seconds", late: str = "1 minute") -> DataFrame:
    """start, end, used: sums over sliding windows of event time."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", width, step).alias("w")).agg(F.sum("value").alias("used"))
    return rows.select("w.start", "w.end", "used")


BUDGET = "user_id long, event_id long, accepted boolean, left double"


def token_budget(requests: DataFrame, balance: float) -> DataFrame:
    """Requests (user_id, event_id, value) accepted or rejected against each user's balance, which state keeps."""

    def spend(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        left = state.get[0] if state.exists else balance
        for rows in batches:
            out = []
            for event_id, value in rows.sort_values("event_id")[["event_id", "value"]].itertuples(index=False):
                fits = value <= left
                left -= value if fits else 0
                out.append((key[0], event_id, fits, left))
            yield pd.DataFrame(out, columns=["user_id", "event_id", "accepted", "left"])
        state.update((left,))

    return requests.groupBy("user_id").applyInPandasWithState(spend, BUDGET, "left double", "append", GroupStateTimeout.NoTimeout)


def merge_daily(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write closed days to a table, a micro-batch at a time; a replayed batch overwrites itself."""

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return counts.writeStream.foreachBatch(save).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
