"""Forests by interval labels: what lies below a node is a range of numbers, and reading a tree in order is a sort.

``labelled`` finds every node's ancestors by pointer doubling (a join for each doubling of the depth, not for each level) and numbers the
nodes in pre-order by one range-partitioned sort on their paths; no task numbers more than its own range. Stored in that order, a condition on
``pre`` prunes what a scan reads. ``contracted`` takes nodes out and relinks what is below them by the same doubling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexlake.session import checkpointed, small

def _doubled(pointers: DataFrame, step) -> DataFrame:
    """``pointers`` (id, to, ...) after everything has followed its pointer to the end; ``step(far)`` gives the columns of a row from its own
    and those of the row that it points to. Rows on or below cycles are left out: they still point somewhere when every path must have ended."""
    rows = checkpointed(pointers)
    for _ in range(rows.count().bit_length() + 1):
        if rows.filter("to IS NOT NULL").isEmpty():
            break
        far = rows.select(F.col("id").alias("_far_id"), F.struct(*[c for c in rows.columns if c != "id"]).alias("_far"))
        joined = rows.filter("to IS NOT NULL").join(far, F.col("to") == F.col("_far_id"), "left")
        rows = checkpointed(rows.filter("to IS NULL").unionByName(joined.select("id", *step(F.col("_far")))))
    return rows.filter("to IS NULL")


def labelled(edges: DataFrame, order: Column | None = None) -> DataFrame:
    """id, root, depth, ancestors (root first), pre, last of every node of a forest of edges (src, dst): src is a child of dst.

    Children are read by ``order`` (an expression over the edges) and then by id. A node's descendants are those with ``pre`` above its own and
    up to its ``last``; numbers ascend but have gaps. A node with several parents is the child of the least; nodes on or below a cycle are left out.
    """
    key = F.struct((order if order is not None else F.lit(0)).alias("o"), F.col("src").alias("id"))
    child = edges.filter("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst", key.alias("k")).groupBy("src").agg(F.min(F.struct("dst", "k")).alias("m"))
    child = child.select(F.col("src").alias("id"), F.col("m.dst").alias("to"), F.lit(False).alias("lost"), F.array("m.dst").alias("ancestors"), F.array("m.k").alias("path"))
    tops = edges.select(F.col("dst").alias("id")).filter("id IS NOT NULL").distinct().join(child.select("id"), "id", "left_anti")
    kinds = dict(child.dtypes)
    tops = tops.select("id", F.lit(None).cast(kinds["to"]).alias("to"), F.lit(False).alias("lost"), F.array().cast(kinds["ancestors"]).alias("ancestors"), F.array().cast(kinds["path"]).alias("path"))

    def step(far: Column) -> list[Column]:
        above = F.concat(far["ancestors"], F.col("ancestors"))
        # an ancestor met twice: a cycle, which must not make longer and longer lists
        lost = far["lost"] | (F.size(F.array_distinct(above)) < F.size(above))
        none = [F.array().cast(kinds[c]) for c in ("ancestors", "path")]
        return [F.when(~lost, far["to"]).alias("to"), lost.alias("lost"), F.when(lost, none[0]).otherwise(above).alias("ancestors"), F.when(lost, none[1]).otherwise(F.concat(far["path"], F.col("path"))).alias("path")]

    rows = _doubled(child.unionByName(tops), step).filter("NOT lost")
    root = F.coalesce(F.get("ancestors", F.lit(0)), F.col("id"))
    rows = rows.select("id", root.alias("root"), F.size("ancestors").alias("depth"), "ancestors", "path")
    rows = checkpointed(rows.repartitionByRange("root", "path").sortWithinPartitions("root", "path").withColumn("pre", F.monotonically_increasing_id()).drop("path"))
    below = rows.select(F.explode("ancestors").alias("id"), "pre").groupBy("id").agg(F.max("pre").alias("_last"))
    return rows.join(below, "id", "left").withColumn("last", F.coalesce("_last", "pre")).drop("_last")


def descendants(labels: DataFrame, roots: DataFrame) -> DataFrame:
    """root, id, depth (steps below) of all nodes below the roots (column id, distinct).

    A few roots are ranges broadcast to one scan of the labels; more are met through the nodes' own ancestors, so no row meets the other rows
    of its tree.
    """
    few = roots.select("id").limit(1001).count() <= 1000
    if few:
        ranges = labels.join(F.broadcast(roots.select("id").distinct()), "id", "left_semi").select(F.col("id").alias("_top"), F.col("pre").alias("_pre"), F.col("last").alias("_last"), F.col("depth").alias("_depth"))
        inside = labels.join(F.broadcast(ranges), (F.col("pre") > F.col("_pre")) & (F.col("pre") <= F.col("_last")))
        return inside.select(F.col("_top").alias("root"), "id", (F.col("depth") - F.col("_depth")).alias("depth"))
    above = labels.select("id", F.col("depth").alias("_own"), F.posexplode("ancestors").alias("_at", "root"))
    return above.join(roots.select(F.col("id").alias("root")).distinct(), "root", "left_semi").select("root", "id", (F.col("_own") - F.col("_at")).alias("depth"))


def without(nodes: DataFrame, edges: DataFrame, labels: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges left when the roots and all below them are deleted, with the edges that touch them."""
    gone = descendants(labels, roots).select("id").unionByName(roots.select("id")).distinct()
    nodes = nodes.join(gone, "id", "left_anti")
    for end in ("src", "dst"):
        edges = edges.join(gone.withColumnRenamed("id", end), end, "left_anti")
    return nodes, edges


def in_order(labels: DataFrame, texts: DataFrame, by: str = "root", sep: str = "\n\n", step: str = "") -> DataFrame:
    """``by`` and text: the texts (id, text) of each tree in pre-order, each indented by ``step`` for a level; nodes without a text are left out."""
    line = F.concat(F.repeat(F.lit(step), F.greatest(F.col("depth") - 1, F.lit(0))), F.col("text"))
    rows = labels.join(texts.select("id", "text").filter("text <> ''"), "id").groupBy(by).agg(F.array_sort(F.collect_list(F.struct("pre", line.alias("t")))).alias("_l"))
    return rows.select(by, F.array_join(F.transform("_l", lambda x: x["t"]), sep).alias("text"))


def contracted(edges: DataFrame, skipped: DataFrame) -> DataFrame:
    """Edges (src, dst) between the nodes that stay: a child whose parent is ``skipped`` (column id) goes to the next node above that isn't. What has no
    such node above it has no edge."""
    marked = edges.filter("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct()
    gone = skipped.select("id").distinct()
    up = marked.join(gone.withColumnRenamed("id", "src"), "src", "left_semi").groupBy("src").agg(F.min("dst").alias("dst"))
    stays = up.join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti").select(F.col("src").alias("id"), F.lit(None).cast(dict(up.dtypes)["dst"]).alias("to"), F.col("dst").alias("end"))
    goes = up.join(gone.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id"), F.col("dst").alias("to"), F.lit(None).cast(dict(up.dtypes)["dst"]).alias("end"))
    ends = _doubled(stays.unionByName(goes), lambda far: [far["to"].alias("to"), far["end"].alias("end")]).select(F.col("id").alias("dst"), "end")
    kept = marked.join(gone.withColumnRenamed("id", "src"), "src", "left_anti")
    direct = kept.join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst")
    moved = kept.join(small(ends), "dst").filter("end IS NOT NULL").select("src", F.col("end").alias("dst"))
    return direct.unionByName(moved).distinct()


def numbered(labels: DataFrame, name: Column, first: int = 1) -> DataFrame:
    """``labels`` with ``seq``: the node's place in its tree's pre-order, from ``first``, and ``seq_id``, ``name`` (of the tree) and it, as ``<name>_<seq>``.

    Trees that lie in several ranges of the labels' order are numbered by range, the ranges' sizes added up.
    """
    from pyspark.sql import Window

    part = F.shiftright("pre", 33)
    near = F.row_number().over(Window.partitionBy("root", part).orderBy("pre"))
    rows = labels.withColumn("_part", part).withColumn("_near", near)
    sizes = rows.groupBy("root", "_part").agg(F.count("*").alias("_n"))
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy("root").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    rows = rows.join(sizes, ["root", "_part"]).withColumn("seq", F.col("_before") + F.col("_near") + (first - 1)).drop("_part", "_near", "_before")
    return rows.withColumn("seq_id", F.concat_ws("_", name, F.col("seq").cast("string")))
