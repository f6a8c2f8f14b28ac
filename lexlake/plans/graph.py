"""Graph queries: lines, orders, customers, nations and regions are the hierarchy, lines the references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexlake.operators import graph as ops
from lexlake.operators import trees, versions
from lexlake.plans.catalogue import query, table


def _hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    def edge(name: str, child: str, a: str, parent: str, b: str) -> DataFrame:
        return table(spark, sf_dir, name).select(F.concat(F.lit(child), F.col(a).cast("string")).alias("src"), F.lit("PART_OF").alias("rel"), F.concat(F.lit(parent), F.col(b).cast("string")).alias("dst"))

    return edge("orders", "o", "o_orderkey", "c", "o_custkey").unionByName(edge("customer", "c", "c_custkey", "n", "c_nationkey")).unionByName(edge("nation", "n", "n_nationkey", "r", "n_regionkey"))


_EDGES = """e AS (SELECT 'o' || o_orderkey AS src, 'c' || o_custkey AS dst FROM orders UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)"""
_DOWN = f"WITH RECURSIVE {_EDGES}, t AS (SELECT dst AS root, src AS id, 1 AS depth FROM e WHERE dst LIKE 'r%' UNION ALL SELECT t.root, e.src, t.depth + 1 FROM t JOIN e ON e.dst = t.id)"


@query(_DOWN + " SELECT root, depth, count(*) AS n FROM t GROUP BY ALL")
def descendants_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many nodes lie how deep below every root."""
    roots = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"))
    return ops.closure(_hierarchy(spark, sf_dir), roots, 4).groupBy("root", "depth").agg(F.count("*").alias("n"))


@query(_DOWN + " SELECT id, root FROM t WHERE id LIKE 'o%'")
def part_of_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The root of every order."""
    roots = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"))
    return ops.closure(_hierarchy(spark, sf_dir), roots, 3).filter("depth = 3").select("id", "root")


@query(_DOWN + " SELECT (SELECT count(*) FROM e) - count(*) AS edges_left, count(*) AS deleted FROM t WHERE root = 'r1'")
def delete_subtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of the edges when one root and all below it are deleted."""
    edges = _hierarchy(spark, sf_dir)
    nodes = edges.select(F.col("src").alias("id")).distinct()
    roots = spark.createDataFrame([("r1",)], "id string")
    _, left = ops.without_subtree(nodes, edges, roots, 3)
    counts = left.agg(F.count("*").alias("edges_left"))
    return counts.join(edges.agg(F.count("*").alias("_all")), F.lit(True)).select("edges_left", (F.col("_all") - F.col("edges_left")).alias("deleted"))


@query("SELECT d.doc_id, s.doc_id AS sibling FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) d JOIN (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) s ON d.source = s.source AND abs(d.rn - s.rn) BETWEEN 1 AND 2")
def siblings_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents up to two places away in the same source."""
    return ops.siblings(table(spark, sf_dir, "documents"), "source", "doc_id", "doc_id", 2)


def _references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"))


@query("SELECT src, dst, place FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dst) AS place FROM (SELECT DISTINCT l_orderkey AS src, l_partkey AS dst FROM lineitem)) WHERE place <= 3")
def referred_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three parts that every order refers to."""
    return ops.first_references(_references(spark, sf_dir), 3).select("src", "dst", F.col("place").cast("long").alias("place"))


@query("SELECT l_orderkey AS id, least(count(DISTINCT l_partkey), 20) AS degree FROM lineitem GROUP BY 1")
def out_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of every order, capped."""
    return ops.degree(_references(spark, sf_dir), 20)


@query("SELECT l_partkey AS id, count(DISTINCT l_orderkey) AS degree FROM lineitem GROUP BY 1")
def in_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References to every part."""
    return ops.degree(_references(spark, sf_dir), incoming=True)


@query("SELECT DISTINCT o_orderkey FROM part JOIN lineitem ON l_partkey = p_partkey JOIN orders ON o_orderkey = l_orderkey WHERE p_size <= 5")
def subject_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with a part of some subject."""
    parts = table(spark, sf_dir, "part").filter("p_size <= 5").select(F.col("p_partkey").alias("l_partkey"))
    lines = table(spark, sf_dir, "lineitem").join(parts, "l_partkey", "left_semi").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").join(lines, "o_orderkey", "left_semi").select("o_orderkey")


@query("SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def missing_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels whose document has no vector."""
    edges = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("dst"))
    return ops.missing_ends(edges, table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"))).select(F.col("dst").alias("doc_id"))


@query("SELECT o_orderkey, coalesce(CASE WHEN p_size <= 20 THEN 'part:' || p_partkey END, 'supplier:' || s_suppkey) AS target FROM (SELECT l_orderkey AS o_orderkey, min(l_partkey) AS p, min(l_suppkey) AS s FROM lineitem GROUP BY 1) LEFT JOIN part ON p_partkey = p AND p_size <= 20 LEFT JOIN supplier ON s_suppkey = s")
def fallback_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part an order refers to, or else its supplier."""
    refs = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_partkey").alias("p_partkey"), F.min("l_suppkey").alias("s_suppkey"))
    parts = table(spark, sf_dir, "part").filter("p_size <= 20").select("p_partkey", F.lit(True).alias("_part"))
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", F.lit(True).alias("_supplier"))
    rows = refs.join(parts, "p_partkey", "left").join(suppliers, "s_suppkey", "left")
    name = lambda kind, c, known: F.when(F.col(known), F.concat(F.lit(kind), F.col(c).cast("string")))
    return rows.select("o_orderkey", F.coalesce(name("part:", "p_partkey", "_part"), name("supplier:", "s_suppkey", "_supplier")).alias("target"))


@query("""SELECT coalesce(c.c_custkey, u.id) AS id, coalesce(u.name, c.c_name) AS name, c.c_mktsegment AS segment, u.note FROM customer c FULL JOIN
  (SELECT o_custkey + 1000 AS id, CASE WHEN max(o_totalprice) > 200000 THEN 'large' END AS name, 'seen' AS note FROM orders GROUP BY 1) u ON u.id = c.c_custkey""")
def node_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes merged by key: new properties replace, null ones leave the old, new keys are added."""
    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    new = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") + 1000).alias("id")).agg(F.when(F.max("o_totalprice") > 200_000, "large").alias("name"), F.lit("seen").alias("note"))
    return ops.upsert_nodes(old, new).select("id", "name", "segment", "note")


@query("""SELECT DISTINCT 'o' || l_orderkey AS src, 'REFERS_TO' AS rel, 'p' || l_partkey AS dst FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey LEFT JOIN part ON p_partkey = l_partkey
  WHERE l_returnflag = 'R' OR o_orderstatus = 'F' AND p_size <= 25""")
def edge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges merged: old ones, and new ones where both ends are known."""
    lines = table(spark, sf_dir, "lineitem")
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    edges = lines.select(name("o", "l_orderkey").alias("src"), F.lit("REFERS_TO").alias("rel"), name("p", "l_partkey").alias("dst"), (F.col("l_returnflag") == "R").alias("known"))
    nodes = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(name("o", "o_orderkey").alias("id"))
    nodes = nodes.unionByName(table(spark, sf_dir, "part").filter("p_size <= 25").select(name("p", "p_partkey").alias("id")))
    return ops.upsert_edges(edges.filter("known"), edges.filter("NOT known"), nodes)


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def unique_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that occur more than once."""
    lines = table(spark, sf_dir, "lineitem").withColumn("id", F.struct("l_orderkey", "l_linenumber"))
    return ops.duplicate_keys(lines).select("id.l_orderkey", "id.l_linenumber", "n")


@query("""WITH h AS (SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank, o_custkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20),
  m AS (SELECT h.rank, h.id AS old, (SELECT arg_max(o.o_orderkey, (o.o_orderdate, o.o_orderkey)) FROM orders o WHERE o.o_custkey = h.o_custkey) AS id FROM h),
  r AS (SELECT DISTINCT m.rank, p.dst AS id, p.place FROM m JOIN (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dst) AS place FROM (SELECT DISTINCT l_orderkey AS src, -l_partkey AS dst FROM lineitem)) p ON p.src = m.id AND p.place <= 3),
  u AS (SELECT id, rank, 0 AS place, 'hit' AS kind, id <> old AS hopped FROM m UNION ALL SELECT id, rank, place, 'reference', false FROM r)
  SELECT id, rank, kind, hopped FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rank, place) AS rn FROM u) WHERE rn = 1""")
def hop_and_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits moved to their latest versions, with what those refer to."""
    from pyspark.sql import Window

    orders = table(spark, sf_dir, "orders")
    top = orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)
    hits = top.select(F.col("o_orderkey").alias("id"), F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("o_totalprice"), "o_orderkey")).cast("long").alias("rank"), "o_custkey")
    newest = versions.latest(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderkey")
    newest = hits.select("id", "o_custkey").join(newest, "o_custkey").select("id", "latest_id")
    refs = _references(spark, sf_dir).select("src", (-F.col("dst")).alias("dst"))
    return ops.hop_and_expand(hits.select("id", "rank"), newest, refs, 3)


def _roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"))


@query(_DOWN + " SELECT root, depth, count(*) AS n FROM t GROUP BY ALL")
def label_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many nodes lie how deep below every root, by ranges of pre-order numbers."""
    return trees.descendants(trees.labelled(_hierarchy(spark, sf_dir)), _roots(spark, sf_dir)).groupBy("root", "depth").agg(F.count("*").alias("n"))


@query(f"""WITH RECURSIVE {_EDGES}, t AS (SELECT dst AS root, src AS id FROM e WHERE dst LIKE 'n%' UNION ALL SELECT t.root, e.src FROM t JOIN e ON e.dst = t.id)
  SELECT e.src, e.dst FROM e WHERE e.src NOT IN (SELECT id FROM t WHERE root IN ('n3', 'n8')) AND e.dst NOT IN (SELECT id FROM t WHERE root IN ('n3', 'n8')) AND e.src NOT IN ('n3', 'n8') AND e.dst NOT IN ('n3', 'n8')""")
def label_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges left when two nations and all below them are deleted, by ranges of pre-order numbers."""
    edges = _hierarchy(spark, sf_dir)
    labels = trees.labelled(edges)
    roots = labels.filter(F.col("id").isin("n3", "n8")).select("id")
    return trees.without(labels.select("id"), edges, labels, roots)[1].select("src", "dst")


@query(f"""WITH RECURSIVE {_EDGES}, t AS (SELECT dst AS root, dst AS id, [dst] AS path FROM e WHERE dst LIKE 'r%' UNION SELECT t.root, e.src, list_append(t.path, e.src) FROM t JOIN e ON e.dst = t.id),
  n AS (SELECT root, id, row_number() OVER (PARTITION BY root ORDER BY path) AS seq FROM t) SELECT root, id, seq, root || '_' || seq AS seq_id FROM n""")
def label_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node's place in its tree's pre-order, and an id of it."""
    return trees.numbered(trees.labelled(_hierarchy(spark, sf_dir)), F.col("root")).select("root", "id", F.col("seq").cast("long").alias("seq"), "seq_id")


@query("SELECT 'c' || c_custkey AS src, 'r' || n_regionkey AS dst FROM customer JOIN nation ON n_nationkey = c_nationkey UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders")
def contracted_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hierarchy without nations: what was below them is linked to what is above."""
    edges = _hierarchy(spark, sf_dir)
    return trees.contracted(edges, edges.filter("src LIKE 'n%'").select(F.col("src").alias("id"))).select("src", "dst")
