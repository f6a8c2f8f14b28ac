"""Queries over version chains: a customer's orders are the versions of one article."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexlake.operators import versions as ops
from lexlake.plans.analytics import stamp
from lexlake.plans.catalogue import query, table

_CHAIN = "c AS (SELECT *, lead(o_orderdate) OVER w AS valid_to, lag(o_orderkey) OVER w AS prev_id, lead(o_orderkey) OVER w AS next_id FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))"
_DAY = "'%Y-%m-%d %H:%M:%S'"


def _chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.closed(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderkey", "o_orderdate")


@query(f"WITH {_CHAIN} SELECT o_orderkey, strftime(o_orderdate, {_DAY}) AS valid_from, strftime(valid_to, {_DAY}) AS valid_to, prev_id, next_id FROM c")
def version_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every version with its validity and neighbours."""
    return _chain(spark, sf_dir).select("o_orderkey", stamp("valid_from").alias("valid_from"), stamp("valid_to").alias("valid_to"), "prev_id", "next_id")


@query(f"WITH {_CHAIN} SELECT o_orderkey, valid_to IS NULL AS is_current FROM c")
def validity_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a version is the one in force."""
    return _chain(spark, sf_dir).select("o_orderkey", F.col("valid_to").isNull().alias("is_current"))


@query("SELECT o_orderkey, round(row_number() OVER w::DOUBLE / count(*) OVER (PARTITION BY o_custkey), 6) AS score FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def version_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions scored by their place in the history."""
    return ops.version_scored(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_orderkey", F.round("score", 6).alias("score"))


@query("SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS latest_id FROM orders GROUP BY o_custkey")
def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last version of every chain."""
    return ops.latest(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderkey")


@query(f"""WITH RECURSIVE {_CHAIN}, h AS (SELECT o_orderkey AS root, o_orderkey AS id, next_id, 0 AS depth FROM c WHERE prev_id IS NULL
  UNION ALL SELECT h.root, c.o_orderkey, c.next_id, h.depth + 1 FROM h JOIN c ON c.o_orderkey = h.next_id) SELECT root, id, depth FROM h""")
def version_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every version with the first of its chain and its distance from it: a window does what following next links would."""
    return ops.history(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderkey")


@query("SELECT a.o_orderkey AS id, count(b.o_orderkey) AS later FROM orders a LEFT JOIN orders b ON a.o_custkey = b.o_custkey AND (b.o_orderdate, b.o_orderkey) > (a.o_orderdate, a.o_orderkey) GROUP BY 1")
def next_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many versions follow each."""
    from pyspark.sql import Window

    order = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.row_number().over(order) - 1).cast("long").alias("later"))


@query("""WITH l AS (SELECT row_number() OVER () AS line, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, o_custkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
  r AS (SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, o.o_orderkey AS as_of_id, row_number() OVER (PARTITION BY l.line ORDER BY o.o_orderdate DESC NULLS LAST, o.o_orderkey DESC NULLS LAST) AS rn
    FROM l LEFT JOIN orders o ON o.o_custkey = l.o_custkey AND o.o_orderdate <= l.l_shipdate) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, as_of_id FROM r WHERE rn = 1""")
def asof_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line with the order of its customer that was in force when it shipped."""
    orders = table(spark, sf_dir, "orders")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    lines = lines.join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).drop("o_orderkey")
    return ops.as_of(lines, orders, ["o_custkey"], "l_shipdate", "o_orderdate", "o_orderkey").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "as_of_id")


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, row_number() OVER () AS line FROM lineitem),
  r AS (SELECT l.*, o.o_orderkey AS as_of_id, row_number() OVER (PARTITION BY line ORDER BY o.o_orderdate DESC NULLS LAST, o.o_orderkey DESC NULLS LAST) AS rn FROM l LEFT JOIN orders o ON o.o_custkey = l.l_suppkey AND o.o_orderdate <= l.l_shipdate)
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, as_of_id FROM r WHERE rn = 1""")
def asof_sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line with the order, of the customer with its supplier's number, that was the last when it shipped; keys are cut into slices of time."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", F.col("l_suppkey").alias("o_custkey"))
    found = ops.sliced_as_of(lines, table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey"), ["o_custkey"], "l_shipdate", "o_orderdate", "o_orderkey")
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "as_of_id")


@query(f"""WITH {_CHAIN} SELECT e.event_id, max_by(c.o_orderkey, (c.o_orderdate, c.o_orderkey)) AS target_id FROM (SELECT *, ts - INTERVAL 9000 DAY AS at FROM events) e JOIN c ON c.o_custkey = e.user_id AND c.o_orderdate <= e.at AND (c.valid_to IS NULL OR e.at < c.valid_to) GROUP BY 1""")
def valid_at_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their user's version in force at a time, for any intervals."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("o_custkey"), "event_id", (F.col("ts") - F.expr("INTERVAL 9000 DAYS")).alias("at"))
    return ops.valid_at(events, _chain(spark, sf_dir), ["o_custkey"], "event_id", "at", "o_orderkey")


_LINES = "l AS (SELECT l_orderkey, l_partkey, sum(l_quantity) AS q FROM lineitem GROUP BY ALL)"
_DIFF = f"""WITH {_CHAIN}, {_LINES}, p AS (SELECT o_orderkey AS id, prev_id FROM c WHERE prev_id IS NOT NULL),
  o AS (SELECT p.id, l.l_partkey, l.q FROM p JOIN l ON l.l_orderkey = p.prev_id), n AS (SELECT p.id, l.l_partkey, l.q FROM p JOIN l ON l.l_orderkey = p.id),
  x AS (SELECT coalesce(o.id, n.id) AS id, coalesce(o.l_partkey, n.l_partkey) AS part, CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' WHEN o.q IS DISTINCT FROM n.q THEN 'modified' END AS change
    FROM o FULL JOIN n ON o.id = n.id AND o.l_partkey = n.l_partkey)"""


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.col("l_partkey").alias("part")).agg(F.sum("l_quantity").alias("q"))
    links = _chain(spark, sf_dir).filter("prev_id IS NOT NULL").select(F.col("o_orderkey").alias("id"), "prev_id")
    old = links.join(lines, F.col("prev_id") == F.col("l_orderkey")).select("id", "part", "q")
    new = links.join(lines, F.col("id") == F.col("l_orderkey")).select("id", "part", "q")
    return ops.differences(old, new, ["id", "part"], "q")


@query(_DIFF + " SELECT id, part, change FROM x WHERE change IS NOT NULL")
def diff_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that each version adds, drops or changes against the one before."""
    return _changes(spark, sf_dir)


@query(_DIFF + " SELECT id, CASE WHEN bool_or(change = 'removed') THEN 'removed' WHEN bool_or(change = 'modified') THEN 'modified' ELSE 'added' END AS change FROM x WHERE change IS NOT NULL GROUP BY id")
def change_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest change of every version."""
    return ops.strongest_change(_changes(spark, sf_dir), ["id"])


@query(_DIFF + """, y AS (SELECT id, list_sort(list(DISTINCT part::VARCHAR)) AS items, count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'modified') AS modified, count(*) FILTER (change = 'removed') AS removed FROM x WHERE change IS NOT NULL GROUP BY id)
  SELECT id, added, modified, removed, array_to_string(items[1:10], ', ') || CASE WHEN len(items) > 10 THEN ', ...' ELSE '' END AS summary FROM y""")
def change_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and first items of every version's changes."""
    return ops.change_summary(_changes(spark, sf_dir), ["id"], "part")
