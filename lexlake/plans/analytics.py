"""Queries over events and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexlake.operators import analytics as ops
from lexlake.plans.catalogue import query, table

STAMP = "yyyy-MM-dd HH:mm:ss"


def stamp(column: str):
    """A timestamp as text of fixed format, null if null."""
    return F.date_format(F.col(column).cast("timestamp"), STAMP)


def _last(events: DataFrame):
    """The last event's time, one value, as a literal: bounds from it reach the scan."""
    (now,) = events.agg(F.max("ts")).first()
    return F.lit(now).cast("timestamp_ntz")


@query("SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-20 00:00:00' GROUP BY event_type")
def event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by type in a closed range."""
    return ops.between(table(spark, sf_dir, "events"), "ts", "2024-01-05 00:00:00", "2024-01-20 00:00:00").groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT event_id, user_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, value FROM events WHERE event_type = 'purchase' AND ts >= TIMESTAMP '2024-01-10 00:00:00' ORDER BY events.ts DESC, event_id LIMIT 50")
def optional_event_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest events of a type since a date (end left open)."""
    rows = ops.between(table(spark, sf_dir, "events"), "ts", start="2024-01-10 00:00:00", kind="purchase")
    return rows.orderBy(F.desc("ts"), "event_id").limit(50).select("event_id", "user_id", stamp("ts").alias("ts"), "value")


@query("SELECT event_id, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-12 00:00:00' AND TIMESTAMP '2024-01-12 12:00:00'")
def events_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events of a closed range."""
    return ops.between(table(spark, sf_dir, "events"), "ts", "2024-01-12 00:00:00", "2024-01-12 12:00:00").select("event_id", "event_type", stamp("ts").alias("ts"))


@query("SELECT count(DISTINCT user_id) AS active_users FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 720 MINUTE")
def distinct_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users active in the last twelve hours of the data."""
    events = table(spark, sf_dir, "events")
    return events.filter(F.col("ts") > _last(events) - F.expr("INTERVAL 720 MINUTES")).agg(F.countDistinct("user_id").alias("active_users"))


@query("SELECT CAST(ts AS DATE)::VARCHAR AS day, count(*) AS errors, count(DISTINCT user_id) AS users FROM events WHERE event_type = 'error' AND ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY 1")
def error_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors by day over the last seven days of the data."""
    events = table(spark, sf_dir, "events")
    rows = events.filter(F.col("ts") >= _last(events) - F.expr("INTERVAL 7 DAYS")).filter("event_type = 'error'")
    return rows.groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("errors"), F.countDistinct("user_id").alias("users"))


def _sessions_sql(minutes: int) -> str:
    return f"""WITH e AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL {minutes} MINUTE THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
      s AS (SELECT *, CAST(sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session_no FROM e),
      t AS (SELECT user_id, session_no, min(ts) AS a, max(ts) AS z, count(*) AS n_events FROM s GROUP BY ALL)"""


def _session_query(minutes: int):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = ops.session_table(table(spark, sf_dir, "events"), minutes)
        return rows.select("user_id", "session_no", stamp("started_at").alias("started_at"), stamp("last_activity_at").alias("last_activity_at"), "n_events")

    return run


for _name, _minutes in (("sessions_30m", 30), ("sessions_12h", 720)):
    _f = _session_query(_minutes)
    _f.__name__ = _name
    query(_sessions_sql(_minutes) + " SELECT user_id, session_no, strftime(a, '%Y-%m-%d %H:%M:%S') AS started_at, strftime(z, '%Y-%m-%d %H:%M:%S') AS last_activity_at, n_events FROM t")(_f)


@query(_sessions_sql(30) + " SELECT user_id, session_no, CASE WHEN z < (SELECT max(ts) FROM events) - INTERVAL 30 MINUTE THEN strftime(z, '%Y-%m-%d %H:%M:%S') END AS ended_at FROM t")
def stale_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions with the time they ended, null for those alive at the data's last moment."""
    events = table(spark, sf_dir, "events")
    rows = ops.end_stale(ops.session_table(events), _last(events))
    return rows.select("user_id", "session_no", stamp("ended_at").alias("ended_at"))


@query(_sessions_sql(30) + " SELECT user_id, session_no, n_events FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY z DESC, session_no DESC) AS rn FROM t) WHERE rn = 1")
def active_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's latest session."""
    rows = ops.session_table(table(spark, sf_dir, "events"))
    best = F.max_by(F.struct("session_no", "n_events"), F.struct("last_activity_at", "session_no")).alias("b")
    return rows.groupBy("user_id").agg(best).select("user_id", "b.session_no", "b.n_events")


@query("""SELECT CAST(ts AS DATE)::VARCHAR AS day, count(*) AS requests, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS errors,
  count(DISTINCT user_id) AS users, round(sum(value), 2) AS value FROM events GROUP BY 1""")
def daily_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics by day."""
    rows = table(spark, sf_dir, "events").groupBy(F.to_date("ts").cast("string").alias("day"))
    return rows.agg(F.count("*").alias("requests"), F.count_if(F.col("event_type") == "error").alias("errors"), F.countDistinct("user_id").alias("users"), F.round(F.sum("value"), 2).alias("value"))


@query("""SELECT day::VARCHAR AS day, CAST(count(ts) AS BIGINT) AS requests FROM (SELECT CAST(unnest(range(TIMESTAMP '2023-12-30', TIMESTAMP '2024-02-02', INTERVAL 1 DAY)) AS DATE) AS day)
  LEFT JOIN events ON CAST(ts AS DATE) = day GROUP BY day""")
def metrics_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of every day of a range, 0 where there were none."""
    days = spark.sql("SELECT explode(sequence(DATE'2023-12-30', DATE'2024-02-01')) AS day")
    counts = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return days.join(counts, "day", "left").select(F.col("day").cast("string").alias("day"), F.coalesce("n", F.lit(0)).alias("requests"))




@query("SELECT CAST(ts AS DATE)::VARCHAR AS day, count(*) AS requests, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS errors FROM events GROUP BY 1")
def daily_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of two batches of events merged by day."""
    events = table(spark, sf_dir, "events")

    def batch(kind: str) -> DataFrame:
        rows = events.filter(kind).groupBy(F.to_date("ts").cast("string").alias("day"))
        return rows.agg(F.count("*").alias("requests"), F.count_if(F.col("event_type") == "error").alias("errors"))

    return ops.merge_counters(batch("event_type IN ('error', 'view')"), batch("event_type NOT IN ('error', 'view')"), "day")


@query("""SELECT day, max(n) AS peak FROM (SELECT CAST(ts AS DATE)::VARCHAR AS day, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY day""")
def peak_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily peaks of two batches merged by the greater."""
    events = table(spark, sf_dir, "events")

    def batch(kind: str) -> DataFrame:
        return events.filter(kind).groupBy(F.to_date("ts").cast("string").alias("day"), "event_type").agg(F.count("*").alias("n")).groupBy("day").agg(F.max("n").alias("peak"))

    return ops.merge_peaks(batch("event_type IN ('error', 'view')"), batch("event_type NOT IN ('error', 'view')"), "day", "peak")


@query("""SELECT event_id, user_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY epoch(ts)::BIGINT RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW), 4) AS usage
  FROM (SELECT * REPLACE (date_trunc('second', ts) AS ts) FROM events)""")
def usage_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's user's sum of values over the hour before it, in whole seconds."""
    rows = ops.sliding_usage(table(spark, sf_dir, "events").withColumn("ts", F.date_trunc("second", "ts")), 3600)
    return rows.select("event_id", "user_id", F.round("usage", 4).alias("usage"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number out of the JSON details of every event; unreadable JSON gives null."""
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"))


@query("SELECT user_id, count(*) AS surveys FROM events WHERE event_type = 'signup' GROUP BY user_id")
def surveys_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms handed in by each user (sign-ups stand in)."""
    return table(spark, sf_dir, "events").filter("event_type = 'signup'").groupBy("user_id").agg(F.count("*").alias("surveys"))


@query("""SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean_value, round(sum(value), 2) AS total,
  CAST(sum(CASE WHEN value > 100 THEN 1 ELSE 0 END) AS BIGINT) AS large FROM events GROUP BY event_type""")
def batch_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, mean and conditional counts by type."""
    rows = table(spark, sf_dir, "events").groupBy("event_type")
    return rows.agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean_value"), F.round(F.sum("value"), 2).alias("total"), F.count_if(F.col("value") > 100).alias("large"))


@query("SELECT event_id, user_id FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 24 HOUR")
def unexpired_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries less than a day old at the last event's time, which is one row and goes into the plan as a literal."""
    events = table(spark, sf_dir, "events")
    return ops.unexpired(events, "ts", _last(events)).select("event_id", "user_id")


@query("SELECT event_type, count(*) AS n, count(*) FILTER (value > 50) AS n_large FROM events GROUP BY event_type")
def merged_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by type, merged from the statistics of four parts of the events."""
    counted = [F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("n_large")]
    per = table(spark, sf_dir, "events").groupBy((F.col("event_id") % 4).alias("worker"), "event_type").agg(*counted)
    return ops.merged_stats([per.filter(F.col("worker") < 2), per.filter(F.col("worker") >= 2)], ["event_type"], ["n", "n_large"])


@query(_sessions_sql(30) + " SELECT user_id, session_no, n_events FROM t")
def sessions_sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of all users in two passes over slices of a day, as users with most of the rows need."""
    rows = ops.sliced_sessions(table(spark, sf_dir, "events"), gap_minutes=30, slice_minutes=1440)
    return rows.groupBy("user_id", "session_no").agg(F.count("*").alias("n_events"))


@query("SELECT event_id, round(sum(value) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECOND PRECEDING AND CURRENT ROW), 4) AS usage FROM events")
def usage_sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every kind of event used in the hour up to each event; the five kinds are cut into slices of six hours."""
    rows = ops.sliding_usage(table(spark, sf_dir, "events"), 3600, by=("event_type",), slice_seconds=21600)
    return rows.select("event_id", F.round("usage", 4).alias("usage"))
