"""Merkle manifest of a table: an external-memory node store, and proofs read from it by coordinate.

Rows become leaves, the leaves of a group (a source) a tree, and the trees' roots the leaves of one more tree. Up to 16
consecutive nodes have one parent, the digest of their digests' hexadecimal text on end; a level of one node is the root.

Leaves are sorted into runs by (group, key); a run's rows know their places from sums over all runs' heads. The store is Parquet, a
folder for each level with (tree, place, digest, n), n the nodes of that level; each level is made from the one below alone. A block is
the leaves and inner nodes below one node of level 3, at most 4 369. The path from a block up is found once, by joins of the few upper
nodes; then blocks are dealt out by (tree, block), sorted by level and place, and one scan over them gives every leaf its proof. No task
holds more than one block, and a lost one is done again from the tables.

Defined results: nulls in any column are told from all values, the null group comes first, null keys before others; leaves with equal keys
are ordered by digest, so repeated rows are equal leaves side by side; whole texts enter their leaf; an empty table has no root and no
proofs; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexlake.llm.common import forget, shared_dir, small, written

FAN_BITS = 4
FAN = 1 << FAN_BITS
BLOCK_LEVELS = 3
NODE = "tree long, place long, digest binary, n long"
STEPS = "array<struct<left:string,right:string>>"
#: Trees whose roots' paths (some kilobytes each) may be broadcast.
MOST_PATHS = 1000


@dataclass
class Store:
    """``nodes``: a table for each level of the groups' trees; ``top``: likewise of the tree over their roots; ``entries``: tree,
    place, n (leaves of the tree) and the columns of a leaf; ``trees``: tree, name, n, root; ``root``: None without rows."""

    nodes: list[DataFrame]
    top: list[DataFrame]
    entries: DataFrame
    trees: DataFrame
    root: str | None

    def forget(self) -> None:
        """Delete the store's tables."""
        forget(*self.nodes, *self.top, self.entries, self.trees)


def leaf(*values: Column) -> Column:
    """Digest of a row: of each value ``-`` if it is null, else its bytes' number, a colon, and itself."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]).cast("binary"), 256)


def verified(digest: Column, steps: Column) -> Column:
    """The root that a leaf's digest and its steps (array<struct<left, right>>) lead to."""
    return F.aggregate(steps, digest, lambda d, s: F.sha2(F.concat(s["left"], d, s["right"]).cast("binary"), 256))


def _placed(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Leaves (group, key, leaf, any others) with tree, place and n, and the trees (tree, name, n) in order of their names.

    Runs are ranges of (group, key, leaf); a row's number comes from its place in its run. ``heads`` has a row for each group of
    each run; the windows over it see one run's groups, one group's runs, or one row for each run.
    """
    spread = F.monotonically_increasing_id()
    runs = leaves.repartitionByRange("group", "key", "leaf", spread).sortWithinPartitions("group", "key", "leaf")
    runs = written(runs.withColumn("at", F.monotonically_increasing_id()), "merkle-runs")
    run, row = F.shiftright("at", 33).alias("run"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    heads = runs.groupBy(run, "group").agg(F.min(row).alias("first"), F.count("*").alias("rows"))
    of_group = Window.partitionBy("group")
    heads = heads.withColumns({
        "before": F.coalesce(F.sum("rows").over(of_group.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "n": F.sum("rows").over(of_group),
        "new": (F.min("run").over(of_group) == F.col("run")).cast("long"),
    })
    heads = written(heads.withColumn("nth", F.sum("new").over(Window.partitionBy("run").orderBy("first"))), "merkle-heads")
    base = heads.groupBy("run").agg(F.sum("new").alias("groups"))
    base = base.select("run", F.coalesce(F.sum("groups").over(Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    trees = heads.filter("new = 1").join(base, "run").select((F.col("base") + F.col("nth") - 1).alias("tree"), F.col("group").alias("name"), "n")
    trees = written(trees, "merkle-trees")
    named = heads.join(small(trees.select("tree", "name"), trees.count()), F.col("group").eqNullSafe(F.col("name")))
    named = named.select("run", F.col("group").alias("its_group"), "tree", (F.col("before") - F.col("first")).alias("shift"), "n")
    same = (F.shiftright("at", 33) == F.col("run")) & F.col("group").eqNullSafe(F.col("its_group"))
    entries = runs.join(small(named, heads.count()), same).withColumn("place", F.col("shift") + row).drop("at", "run", "its_group", "shift")
    entries = written(entries, "merkle-entries")
    forget(runs, heads)
    return entries, trees


def _levels(spark: SparkSession, leaves: DataFrame) -> list[DataFrame]:
    """All levels of the trees over ``leaves`` (as NODE), each written and made from the one before."""
    path = shared_dir(spark, "merkle-nodes")

    def stored(nodes: DataFrame, level: int) -> DataFrame:
        at = f"{path}/level={level}"
        nodes.write.parquet(at)
        table = spark.read.schema(NODE).parquet(at)
        table._lexlake_path = at
        return table

    found = [stored(leaves, 0)]
    most = found[0].agg(F.max("n")).first()[0] or 0
    while most > 1:
        runs = found[-1].filter("n > 1").groupBy("tree", F.shiftright("place", FAN_BITS).alias("place"))
        up = runs.agg(F.sort_array(F.collect_list(F.struct(F.col("place").alias("at"), F.lower(F.hex("digest")).alias("h")))).alias("under"), F.max("n").alias("n"))
        digest = F.unhex(F.sha2(F.array_join("under.h", "").cast("binary"), 256))
        most = (most + FAN - 1) >> FAN_BITS
        found.append(stored(up.select("tree", "place", digest.alias("digest"), F.shiftright(F.col("n") + (FAN - 1), FAN_BITS).alias("n")), len(found)))
    return found


def _roots(levels: list[DataFrame]) -> DataFrame:
    """tree and digest of every tree's root."""
    rows = levels[0].filter("n = 1")
    for nodes in levels[1:]:
        rows = rows.unionByName(nodes.filter("n = 1"))
    return rows.select("tree", "digest")


def build(leaves: DataFrame) -> Store:
    """The store of leaves (group string, key, leaf string: hexadecimal; other columns are carried along)."""
    spark = leaves.sparkSession
    entries, trees = _placed(leaves)
    nodes = _levels(spark, entries.select("tree", "place", F.unhex("leaf").alias("digest"), "n"))
    roots = _roots(nodes)
    top = _levels(spark, roots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place"), "digest", F.lit(trees.count()).cast("long").alias("n")))
    last = _roots(top).first()
    named = written(trees.join(roots, "tree").select("tree", "name", "n", F.lower(F.hex("digest")).alias("root")), "merkle-roots")
    forget(trees)
    return Store(nodes, top, entries, named, bytes(last["digest"]).hex() if last else None)


def _paths(levels: list[DataFrame], lowest: int) -> DataFrame:
    """tree, place, steps: of all nodes of level ``lowest``, the steps from there to their tree's root."""
    upper = None
    for nodes in reversed(levels[lowest:]):
        found = nodes.filter("n = 1").select("tree", "place", F.array().cast(STEPS).alias("steps"))
        if upper is not None:
            run = F.shiftright("place", FAN_BITS)
            runs = nodes.filter("n > 1").groupBy("tree", run.alias("run")).agg(F.sort_array(F.collect_list(F.struct("place", F.lower(F.hex("digest")).alias("h")))).alias("under"))
            each = runs.select("tree", "run", "under.h", F.posexplode("under").alias("i", "node"))
            step = F.struct(F.array_join(F.expr("slice(h, 1, i)"), "").alias("left"), F.array_join(F.expr(f"slice(h, i + 2, {FAN})"), "").alias("right"))
            each = each.select("tree", "run", F.col("node.place").alias("place"), step.alias("step"))
            joined = each.join(upper.select("tree", F.col("place").alias("run"), "steps"), ["tree", "run"])
            found = found.unionByName(joined.select("tree", "place", F.concat(F.array("step"), "steps").alias("steps")))
        upper = found
    return upper


def _blocks(store: Store) -> DataFrame:
    """tree, block, n (leaves of the tree), root (the tree's), steps from the block's node to the last root."""
    trees = store.trees
    from_root = _paths(store.top, 0).select(F.col("place").alias("tree"), F.col("steps").alias("more"))
    low = trees.filter(F.col("n") <= FAN ** (BLOCK_LEVELS - 1)).select("tree", F.lit(0).cast("long").alias("block"), F.array().cast(STEPS).alias("steps"))
    blocks = low if len(store.nodes) <= BLOCK_LEVELS else low.unionByName(_paths(store.nodes, BLOCK_LEVELS).withColumnRenamed("place", "block"))
    count = trees.count()
    ends = trees.select("tree", "n", "root").join(from_root, "tree")
    return blocks.join(small(ends, count, MOST_PATHS), "tree").select("tree", "block", "n", "root", F.concat("steps", "more").alias("steps"))


class _Block:
    """One block while it is scanned: its path up, inner nodes and entries."""

    def __init__(self, row: dict):
        self.n, self.root, self.upper = row["n"], row["root"], [(s["left"], s["right"]) for s in row["steps"]]
        self.levels: list[list[str]] = [[] for _ in range(BLOCK_LEVELS)]
        self.entries: list[dict] = []
        self.known: dict[tuple[int, int], tuple[str, str]] = {}
        self.tail = "".join(a + b for a, b in self.upper)

    def steps(self, at: int) -> list[tuple[str, str]]:
        """The steps of the leaf at a place within the block, up to the block's node."""
        found, left = [], self.n
        for level, nodes in enumerate(self.levels):
            if left == 1:
                break
            if (step := self.known.get((level, at))) is None:
                run = at & ~(FAN - 1)
                step = self.known[level, at] = ("".join(nodes[run:at]), "".join(nodes[at + 1 : run + FAN]))
            found.append(step)
            at, left = at >> FAN_BITS, (left + FAN - 1) >> FAN_BITS
        return found


def _scan(store: Store, columns: list[str], emit: Callable[[_Block], pa.RecordBatch], schema: str) -> DataFrame:
    """Every block with its nodes and entries, sorted, through ``emit``."""
    parts = [store.entries.select("tree", F.shiftright("place", FAN_BITS * BLOCK_LEVELS).alias("block"), F.lit(0).alias("level"), "place", "leaf", *columns)]
    for k, nodes in enumerate(store.nodes[1:BLOCK_LEVELS], 1):
        parts.append(nodes.select("tree", F.shiftright("place", FAN_BITS * (BLOCK_LEVELS - k)).alias("block"), F.lit(k).alias("level"), "place", F.lower(F.hex("digest")).alias("leaf")))
    parts.append(_blocks(store).withColumn("level", F.lit(BLOCK_LEVELS)))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    rows = rows.repartition("tree", "block").sortWithinPartitions("tree", "block", F.desc("level"), "place")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = None
        for batch in batches:
            for row in batch.to_pylist():
                if row["level"] == BLOCK_LEVELS:
                    if block:
                        yield emit(block)
                    block = _Block(row)
                else:
                    block.levels[row["level"]].append(row["leaf"])
                    if row["level"] == 0:
                        block.entries.append(row)
        if block:
            yield emit(block)

    return rows.mapInArrow(scan, schema)


def proofs(store: Store, columns: list[str] | None = None) -> DataFrame:
    """The leaf and steps of every entry, with the named columns of its row."""
    columns = ["key"] if columns is None else columns
    kinds = dict(store.entries.dtypes)

    def emit(block: _Block) -> pa.RecordBatch:
        first = block.entries[0]["place"]
        steps = [[{"left": a, "right": b} for a, b in block.steps(e["place"] - first) + block.upper] for e in block.entries]
        step = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
        batch = pa.RecordBatch.from_pylist([{c: e[c] for c in (*columns, "leaf")} for e in block.entries], _arrow(kinds, [*columns, "leaf"]))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(steps, step)], [*columns, "leaf", "steps"])

    return _scan(store, columns, emit, ", ".join(f"{c} {kinds[c]}" for c in [*columns, "leaf"]) + f", steps {STEPS}")


def _arrow(kinds: dict[str, str], names: list[str]) -> pa.Schema:
    known = {"bigint": pa.int64(), "string": pa.string()}
    return pa.schema([(n, known[kinds[n]]) for n in names])


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def audit(store: Store) -> DataFrame:
    """key, leaf, subroot, proof_sha256 (of all steps' digests on end) and folded_root: the root that ``changed``, if it isn't null,
    or else the leaf leads to."""

    def emit(block: _Block) -> pa.RecordBatch:
        first, rows = block.entries[0]["place"], []
        for e in block.entries:
            steps = block.steps(e["place"] - first)
            at = e["changed"] or e["leaf"]
            for a, b in steps + block.upper:
                at = _digest(a + at + b)
            rows.append((e["key"], e["leaf"], block.root, _digest("".join(a + b for a, b in steps) + block.tail), at))
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k == 0 else pa.string()) for k, c in enumerate(columns)], ["key", "leaf", "subroot", "proof_sha256", "folded_root"])

    return _scan(store, ["key", "changed"], emit, "key long, leaf string, subroot string, proof_sha256 string, folded_root string")


def document_leaves(docs: DataFrame) -> DataFrame:
    """Leaves of documents, by source and doc_id; ``changed``: where 5 divides the doc_id's crc32, the leaf of the text with A-Z lower-cased."""
    head = [F.col("doc_id").cast("long"), F.col("source"), F.col("lang"), F.col("n_chars").cast("long")]
    lowered = F.translate(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 5 == 0
    return docs.select(F.col("source").cast("string").alias("group"), head[0].alias("key"), leaf(*head, F.col("text")).alias("leaf"), F.when(tampered, leaf(*head, lowered)).alias("changed"))


def report(docs: DataFrame) -> DataFrame:
    """Digests, proofs and the result of a check after tampering, for every document; texts are read once."""
    leaves = written(document_leaves(docs), "merkle-leaves")
    store = build(leaves)
    forget(leaves)
    root = F.lit(store.root).cast("string")
    return audit(store).select(F.col("key").alias("doc_id"), "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))
