"""Queries that put answers' contexts together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexlake.operators import context as ops
from lexlake.operators import versions
from lexlake.plans.catalogue import query, table


@query("""SELECT o_orderkey AS id, coalesce(lag(o_orderkey) OVER w::VARCHAR, '') AS previous_versions,
  coalesce(array_to_string(list(o_orderkey::VARCHAR) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), ','), '') AS next_versions
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def version_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every version with the one before it and all after it."""
    return ops.version_context(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderkey")


@query("""SELECT o_orderkey AS id, o_custkey AS law_id, c_name AS title, lag(o_orderkey) OVER w AS prev_id, lead(o_orderkey) OVER w AS next_id
  FROM orders LEFT JOIN customer ON c_custkey = o_custkey WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def article_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles with their law and the versions around them."""
    orders = table(spark, sf_dir, "orders")
    chain = versions.closed(orders, ["o_custkey"], "o_orderkey", "o_orderdate").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("law_id"), "prev_id", "next_id")
    laws = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("law_id"), F.col("c_name").alias("title"))
    return ops.articles_of(orders.select(F.col("o_orderkey").alias("id")), chain, laws).select("id", "law_id", "title", "prev_id", "next_id")


@query("""SELECT o_orderkey AS event_id, o_custkey AS target, coalesce(a.articles, '') AS articles FROM orders LEFT JOIN
  (SELECT l_orderkey, array_to_string(list_sort(list(l_partkey::VARCHAR || ':' || CASE WHEN l_returnflag = 'R' THEN 'removed' ELSE 'added' END)), ',') AS articles FROM lineitem GROUP BY 1) a ON a.l_orderkey = o_orderkey""")
def law_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change events with what they changed."""
    events = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id"), F.col("o_custkey").alias("target"))
    change = F.when(F.col("l_returnflag") == "R", "removed").otherwise("added")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("event_id"), F.col("l_partkey").alias("article_id"), change.alias("change"))
    return ops.law_changes(events, lines).select("event_id", "target", "articles")


@query("""WITH u AS (SELECT conv_id, turn, text, 0 AS l FROM conversations WHERE role = 'user' UNION ALL SELECT conv_id, turn, text, 1 FROM conversations),
  f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY l) AS rn FROM u) WHERE rn = 1)
  SELECT conv_id, turn AS id, row_number() OVER (PARTITION BY conv_id ORDER BY l, turn) AS index, '[' || row_number() OVER (PARTITION BY conv_id ORDER BY l, turn) || '] ' || text AS text FROM f""")
def context_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered contexts from two lists: what was asked first, then the rest."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("id"), F.col("turn").alias("position"), "text", "role")
    rows = ops.assembled([turns.filter("role = 'user'"), turns], "conv_id")
    return rows.select("conv_id", "id", F.col("index").cast("long").alias("index"), "text")


@query("""SELECT doc_id, round(list_sum(list_transform(v, lambda x: x * x)), 6) AS squared, round(v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS first
  FROM (SELECT doc_id, list_transform(range(16), lambda k: ('0x' || substr(sha256(text), (2 * k + 1)::INT, 2))::INT - 127.5::DOUBLE) AS v FROM documents)""")
def stub_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic vectors of all texts: first component, and squared length before scaling."""
    docs = table(spark, sf_dir, "documents")
    raw = [F.conv(F.substring(F.sha2("text", 256), 2 * k + 1, 2), 16, 10).cast("double") - 127.5 for k in range(16)]
    squared = sum((x * x for x in raw), F.lit(0.0))
    return docs.select("doc_id", F.round(squared, 6).alias("squared"), F.round(ops.stub_embedding(F.col("text"))[0], 6).alias("first"))


@query("""SELECT item_id, count(DISTINCT q) AS queries FROM (SELECT item_id, text AS q FROM benchmark UNION ALL SELECT item_id, text || ' ' || o FROM benchmark, (VALUES ('sí'), ('no')) t(o)) GROUP BY item_id""")
def exam_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches that each question asks for: itself, and itself with every option."""
    options = F.create_map(F.lit("a"), F.lit("sí"), F.lit("b"), F.lit("no"))
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("number"), F.col("text").alias("question"), options.alias("options"))
    return ops.question_queries(rows).groupBy(F.col("number").alias("item_id")).agg(F.countDistinct("query").alias("queries"))


@query("""SELECT event_type, user_id, n, share FROM (SELECT event_type, user_id, n, round(n::DOUBLE / sum(n) OVER (PARTITION BY event_type), 6) AS share, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, user_id) AS rn FROM (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL)) WHERE rn <= 5""")
def top_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most active users of every event type, with their share."""
    counts = table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    best = Window.partitionBy("event_type").orderBy(F.desc("n"), "user_id")
    rows = counts.withColumns({"share": F.round(F.col("n") / F.sum("n").over(Window.partitionBy("event_type")), 6), "rn": F.row_number().over(best)})
    return rows.filter("rn <= 5").select("event_type", "user_id", "n", "share")
