"""Property-graph operators on node and edge tables.

Nodes are a table per label keyed by id; edges have src, rel, dst. Upserts rewrite by join, since
Parquet has no merge; all are functions of DataFrames to DataFrames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexlake.session import checkpointed


def upsert_nodes(old: DataFrame, new: DataFrame, key: str = "id", order: str | None = None) -> DataFrame:
    """Keyed merge: properties that the new row has replace, the others stay; new keys are added.

    Of several new rows with a key one counts, whole: the last by the column ``order`` (which is not stored), ties and
    tables without an order by the rows' values.
    """
    columns = [c for c in new.columns if c not in (key, order)]
    row = F.struct(*columns)
    last = F.max(F.struct(F.col(order).alias("_order"), row.alias("_row")) if order else F.struct(row.alias("_row")))
    fresh = new.groupBy(key).agg(last.alias("_last")).select(key, "_last._row.*")
    both = old.alias("o").join(fresh.alias("n"), key, "full")
    names = list(dict.fromkeys([*old.columns, *fresh.columns]))

    def merged(c: str):
        sides = [F.col(f"{side}.{c}") for side, df in (("n", fresh), ("o", old)) if c in df.columns]
        return F.coalesce(*sides).alias(c)

    return both.select(key, *[merged(c) for c in names if c != key])


def upsert_edges(old: DataFrame, new: DataFrame, nodes: DataFrame) -> DataFrame:
    """Old and new edges once each; new ones need both their ends among ``nodes`` (column id)."""
    ends = new.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")
    return old.select("src", "rel", "dst").unionByName(ends.select("src", "rel", "dst")).dropDuplicates(["src", "rel", "dst"])


def duplicate_keys(nodes: DataFrame, key: str = "id") -> DataFrame:
    """Keys that break uniqueness, with how often they occur."""
    return nodes.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def missing_ends(edges: DataFrame, nodes: DataFrame, end: str = "dst") -> DataFrame:
    """Edges whose end is no node."""
    return edges.join(nodes.select(F.col("id").alias(end)), end, "left_anti")


def closure(edges: DataFrame, roots: DataFrame, max_depth: int | None = 10, down: bool = True) -> DataFrame:
    """root, id, depth (the least) of every node that is reached from ``roots`` (column id) along edges, in at most
    ``max_depth`` steps (None: however many). A root's own node is not reached again.

    A frontier goes a step at a time; what was found before is taken out, so cycles end and nodes with several
    paths count once. The loop stops when nothing is new.
    """
    a, b = ("dst", "src") if down else ("src", "dst")
    step = edges.select(F.col(a).alias("_at"), F.col(b).alias("_next"))
    seen = roots.select(F.col("id").alias("root"), "id").distinct().withColumn("depth", F.lit(0))
    level, depth = seen, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        level = level.join(step, F.col("id") == F.col("_at")).select("root", F.col("_next").alias("id")).distinct()
        level = checkpointed(level.join(seen, ["root", "id"], "left_anti").withColumn("depth", F.lit(depth)))
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen.filter("depth > 0")


def without_subtree(nodes: DataFrame, edges: DataFrame, roots: DataFrame, max_depth: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges left when ``roots`` and all that is part of them are deleted, with the edges that touch them."""
    inside = closure(edges, roots, max_depth).select("id").unionByName(roots.select("id")).distinct()
    nodes = nodes.join(inside, "id", "left_anti")
    for end in ("src", "dst"):
        edges = edges.join(inside.withColumnRenamed("id", end), end, "left_anti")
    return nodes, edges


def siblings(rows: DataFrame, parent: str, id_: str, order: str, window: int | None = None) -> DataFrame:
    """id and sibling: rows of the same parent, all or up to ``window`` places away."""
    placed = rows.select(parent, id_, F.row_number().over(Window.partitionBy(parent).orderBy(order)).alias("_at"))
    other = placed.select(parent, F.col(id_).alias("sibling"), F.col("_at").alias("_other"))
    if window is None:
        return placed.join(other, parent).filter(F.col(id_) != F.col("sibling")).select(id_, "sibling")
    near = placed.withColumn("_other", F.explode(F.sequence(F.col("_at") - window, F.col("_at") + window)))
    return near.join(other, [parent, "_other"]).filter(F.col(id_) != F.col("sibling")).select(id_, "sibling")


def first_references(edges: DataFrame, n: int) -> DataFrame:
    """The first ``n`` distinct targets of every source, by id."""
    order = Window.partitionBy("src").orderBy("dst")
    return edges.select("src", "dst").distinct().withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)


def degree(edges: DataFrame, most: int | None = None, incoming: bool = False) -> DataFrame:
    """id and degree: distinct targets of a source (or sources of a target), perhaps capped."""
    a, b = ("dst", "src") if incoming else ("src", "dst")
    n = F.countDistinct(b)
    return edges.groupBy(F.col(a).alias("id")).agg((F.least(n, F.lit(most)) if most else n).alias("degree"))


def hop_and_expand(hits: DataFrame, latest: DataFrame, edges: DataFrame, n: int) -> DataFrame:
    """id, rank, kind, hopped: hits moved on to their latest version (``latest``: id, latest_id), then their
    first ``n`` references; of an id the first place stays, and a hit comes before its references."""
    moved = hits.join(latest, "id", "left").withColumn("_to", F.coalesce("latest_id", "id"))
    own = moved.select(F.col("_to").alias("id"), "rank", F.lit(0).alias("place"), F.lit("hit").alias("kind"), (F.col("_to") != F.col("id")).alias("hopped"))
    refs = first_references(edges, n).join(own.select(F.col("id").alias("src"), "rank").distinct(), "src")
    refs = refs.select(F.col("dst").alias("id"), "rank", "place", F.lit("reference").alias("kind"), F.lit(False).alias("hopped"))
    best = F.min_by(F.struct("rank", "kind", "hopped"), F.struct("rank", "place")).alias("b")
    return own.unionByName(refs).groupBy("id").agg(best).select("id", "b.rank", "b.kind", "b.hopped")
