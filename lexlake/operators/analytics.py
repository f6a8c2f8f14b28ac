"""Usage analytics: filters with optional bounds, sessions by inactivity, daily metrics, sliding sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def optional_filter(df: DataFrame, **bounds: tuple[Column, object]) -> DataFrame:
    """Conjunction of the conditions whose value isn't None: name=(condition of the value, value)."""
    for make, value in bounds.values():
        if value is not None:
            df = df.filter(make(value))
    return df


def between(df: DataFrame, column: str, start: str | None = None, end: str | None = None, kind: str | None = None) -> DataFrame:
    """Events of a closed time range and a type, each bound optional; conditions reach the scan."""
    if kind is not None:
        df = df.filter(F.col("event_type") == kind)
    if start is not None:
        df = df.filter(F.col(column) >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        df = df.filter(F.col(column) <= F.lit(end).cast("timestamp_ntz"))
    return df


def sessions(events: DataFrame, user: str = "user_id", ts: str = "ts", key: str = "event_id", gap_minutes: int = 30) -> DataFrame:
    """``events`` with session_no, from 1 per user: a pause longer than the gap begins a session."""
    order = Window.partitionBy(user).orderBy(ts, key)
    pause = F.col(ts) - F.lag(ts).over(order)
    begins = F.when(pause <= F.expr(f"INTERVAL {gap_minutes} MINUTES"), 0).otherwise(1)
    return events.withColumn("_begins", begins).withColumn("session_no", F.sum("_begins").over(order)).drop("_begins")


def sliced_sessions(events: DataFrame, user: str = "user_id", ts: str = "ts", key: str = "event_id", gap_minutes: int = 30, slice_minutes: int = 1440) -> DataFrame:
    """``sessions`` in two passes, for users with more rows than one task should sort: a window sees a user's rows of one slice of time alone.

    A slice's summary is its first and last time and the sessions begun after its first row. Over the summaries, a row for each user and slice, it follows
    whether a slice's first row begins a session, and how many began before; both are joined back. Rows without a time are a slice of their own, before all.
    """
    minute = F.floor(F.unix_micros(F.col(ts).cast("timestamp_ltz")) / (60_000_000 * slice_minutes))
    rows = events.withColumn("_slice", F.coalesce(minute, F.lit(-(1 << 62))))
    near = Window.partitionBy(user, "_slice").orderBy(ts, key)
    gap = F.expr(f"INTERVAL {gap_minutes} MINUTES")
    place = F.row_number().over(near)
    begins = F.when(place == 1, 0).when(F.col(ts) - F.lag(ts).over(near) <= gap, 0).otherwise(1)
    rows = rows.withColumn("_begins", begins).withColumn("_within", F.sum("_begins").over(near))
    heads = rows.groupBy(user, "_slice").agg(F.min(ts).alias("_first"), F.max(ts).alias("_last"), F.max("_within").alias("_within"))
    along = Window.partitionBy(user).orderBy("_slice")
    heads = heads.withColumn("_new", F.when(F.col("_first") - F.lag("_last").over(along) <= gap, 0).otherwise(1))
    heads = heads.withColumn("_upto", F.sum(F.col("_new") + F.col("_within")).over(along) - F.col("_within"))
    heads = heads.select(F.col(user).alias("_user"), F.col("_slice").alias("_of"), "_upto")
    joined = rows.join(heads, F.col(user).eqNullSafe(F.col("_user")) & (F.col("_slice") == F.col("_of")))
    return joined.withColumn("session_no", F.col("_upto") + F.col("_within")).drop("_slice", "_begins", "_within", "_user", "_of", "_upto")


def session_table(events: DataFrame, gap_minutes: int = 30) -> DataFrame:
    """user_id, session_no, started_at, last_activity_at, n_events."""
    marked = sessions(events, gap_minutes=gap_minutes)
    return marked.groupBy("user_id", "session_no").agg(F.min("ts").alias("started_at"), F.max("ts").alias("last_activity_at"), F.count("*").alias("n_events"))


def end_stale(sessions_df: DataFrame, now: Column, idle_minutes: int = 30) -> DataFrame:
    """Sessions with ended_at: the last activity of those idle for longer than allowed, null of the live."""
    idle = F.col("last_activity_at") < now - F.expr(f"INTERVAL {idle_minutes} MINUTES")
    return sessions_df.withColumn("ended_at", F.when(idle, F.col("last_activity_at")))


def sliding_usage(events: DataFrame, seconds: int, value: str = "value", by: tuple[str, ...] = ("user_id",), slice_seconds: int | None = None) -> DataFrame:
    """``events`` with usage: sum of ``value`` of the same key over the seconds up to and with the row, to the microsecond.

    With ``slice_seconds`` (no less than ``seconds``) a window sees one slice of a key's time: a row goes to its own slice and, if it counts for rows after
    the slice's end, once more to the next, where it is dropped after it has counted.
    """
    timed = events.withColumn("_us", F.unix_micros(F.col("ts").cast("timestamp")))
    micros = 1_000_000 * seconds
    if slice_seconds is None:
        frame = Window.partitionBy(*by).orderBy("_us").rangeBetween(-micros, 0)
        return timed.withColumn("usage", F.sum(value).over(frame)).drop("_us")
    if slice_seconds < seconds:
        raise ValueError("a slice must be as long as the time that is looked back")
    own = F.floor(F.col("_us") / (1_000_000 * slice_seconds))
    ahead = F.floor((F.col("_us") + micros) / (1_000_000 * slice_seconds))
    timed = timed.withColumn("_own", own).withColumn("_slice", F.explode(F.array_distinct(F.array("_own", F.coalesce(ahead, "_own")))))
    frame = Window.partitionBy(*by, "_slice").orderBy("_us").rangeBetween(-micros, 0)
    return timed.withColumn("usage", F.sum(value).over(frame)).filter(F.col("_slice").eqNullSafe(F.col("_own"))).drop("_us", "_own", "_slice")


def merge_counters(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Keyed upsert of counters: equal keys add up."""
    numbers = [c for c in old.columns if c != key]
    return old.unionByName(new, allowMissingColumns=True).groupBy(key).agg(*[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in numbers])


def merge_peaks(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Keyed upsert of maxima: the greater value stays."""
    return old.unionByName(new).groupBy(key).agg(F.max(value).alias(value))


def unexpired(entries: DataFrame, ts: str, now: Column, hours: int = 24) -> DataFrame:
    """Entries younger than ``hours`` at ``now``; those without a time have expired."""
    return entries.filter(F.col(ts) > now - F.expr(f"INTERVAL {hours} HOURS"))


def merged_stats(parts: list[DataFrame], by: list[str], counters: list[str]) -> DataFrame:
    """Counters of several tables of partial sums as one: each key once, what a table lacks counts as 0."""
    rows = parts[0].select(*by, *counters)
    for part in parts[1:]:
        rows = rows.unionByName(part.select(*by, *counters))
    return rows.groupBy(*by).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counters])
