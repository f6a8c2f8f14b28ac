"""Version chains: closing of validity intervals, history, latest versions, as-of links, differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexlake.session import small

EARLIEST = "1800-01-01"


def closed(rows: DataFrame, chain: list[str], id_: str, start: str) -> DataFrame:
    """``rows`` with valid_from, valid_to, prev_id, next_id: a version holds until the next of its chain begins."""
    begin = F.coalesce(F.col(start), F.lit(EARLIEST).cast("timestamp_ntz"))
    order = Window.partitionBy(*chain).orderBy("valid_from", id_)
    rows = rows.withColumn("valid_from", begin)
    return rows.withColumns({"valid_to": F.lead("valid_from").over(order), "prev_id": F.lag(id_).over(order), "next_id": F.lead(id_).over(order)})


def version_scored(rows: DataFrame, chain: list[str], order: list[str]) -> DataFrame:
    """``rows`` with score (place + 1) / n along their chain."""
    place = F.row_number().over(Window.partitionBy(*chain).orderBy(*order))
    return rows.withColumn("score", place / F.count("*").over(Window.partitionBy(*chain)))


def latest(rows: DataFrame, chain: list[str], order: list[str], id_: str) -> DataFrame:
    """Chain and latest_id, the last version's."""
    return rows.groupBy(*chain).agg(F.max_by(id_, F.struct(*order)).alias("latest_id"))


def history(rows: DataFrame, chain: list[str], order: list[str], id_: str) -> DataFrame:
    """root, id, depth of every version: the first of its chain, itself, and the steps between."""
    along = Window.partitionBy(*chain).orderBy(*order)
    return rows.select(F.first(id_).over(along).alias("root"), F.col(id_).alias("id"), (F.row_number().over(along) - 1).alias("depth"))


def in_force(at: Column, valid_from: Column, valid_to: Column) -> Column:
    """Half-open validity; without a date everything is in force, without a start nothing else is."""
    return at.isNull() | (valid_from.isNotNull() & (valid_from <= at) & (valid_to.isNull() | (at < valid_to)))


def as_of(left: DataFrame, versions: DataFrame, by: list[str], at: str, start: str, id_: str) -> DataFrame:
    """``left`` with as_of_id: the version of the same key that began last at or before ``at``.

    Both sides are laid in one order by key and time and the last version seen is carried on, so no
    row meets all versions of its key. Right for chains in which a version ends where the next begins.
    """
    stacked = left.select(*by, F.col(at).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(versions.schema[id_].dataType).alias("_id"), F.struct(*left.columns).alias("_row"))
    own = versions.select(*by, F.col(start).alias("_t"), F.lit(0).alias("_side"), F.col(id_).alias("_id"), F.lit(None).cast(stacked.schema["_row"].dataType).alias("_row"))
    order = Window.partitionBy(*by).orderBy("_t", "_side", "_id")
    both = stacked.unionByName(own).withColumn("as_of_id", F.last("_id", ignorenulls=True).over(order))
    return both.filter("_side = 1").select("_row.*", "as_of_id")


def sliced_as_of(left: DataFrame, versions: DataFrame, by: list[str], at: str, start: str, id_: str, slice_days: int = 90) -> DataFrame:
    """``as_of`` for keys with more rows than a task should sort: a window sees one slice of a key's time.

    What a slice starts with is the last version of the slices before it, from a row for each key and slice; rows without a time have none.
    """
    number = F.floor(F.unix_micros(F.col("_t").cast("timestamp_ltz")) / (86_400_000_000 * slice_days))
    kind = versions.schema[id_].dataType
    stacked = left.select(*by, F.col(at).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(kind).alias("_id"), F.struct(*left.columns).alias("_row"))
    own = versions.select(*by, F.col(start).alias("_t"), F.lit(0).alias("_side"), F.col(id_).alias("_id"), F.lit(None).cast(stacked.schema["_row"].dataType).alias("_row")).filter("_t IS NOT NULL")
    both = stacked.unionByName(own).withColumn("_slice", number)
    near = Window.partitionBy(*by, "_slice").orderBy("_t", "_side", "_id")
    both = both.withColumn("_near", F.last("_id", ignorenulls=True).over(near)).filter("_side = 1")
    heads = own.withColumn("_slice", number).groupBy(*by, "_slice").agg(F.max(F.struct("_t", "_id")).alias("_last"))
    asked = stacked.withColumn("_slice", number).select(*by, "_slice").distinct().withColumn("_last", F.lit(None).cast(heads.schema["_last"].dataType))
    along = Window.partitionBy(*by).orderBy("_slice").rangeBetween(Window.unboundedPreceding, -1)
    heads = heads.unionByName(asked).withColumn("_before", F.last("_last", ignorenulls=True).over(along)["_id"])
    heads = heads.filter("_slice IS NOT NULL").groupBy(*by, "_slice").agg(F.max("_before").alias("_before"))
    return both.join(heads, [*by, "_slice"], "left").select("_row.*", F.when(F.col("_t").isNotNull(), F.coalesce("_near", "_before")).alias("as_of_id"))


#: Of the time that a key's versions span, at most 2 ** LEVELS buckets are made.
LEVELS = 16


def _micros(t: Column) -> Column:
    return F.unix_micros(t.cast("timestamp_ltz"))


def _nodes(first: Column, end: Column, levels: Column) -> Column:
    """The fewest (level, node) whose buckets, 2 ** level each, make up the buckets from ``first`` up to ``end``, of 2 ** ``levels`` in all."""
    node = lambda level, n: F.struct(level.alias("level"), n.alias("node"))
    start = F.struct(first.alias("a"), end.alias("b"), F.array().cast("array<struct<level:int,node:bigint>>").alias("out"))

    def step(acc: Column, level: Column) -> Column:
        a, b, out = acc["a"], acc["b"], acc["out"]
        left, right = (a < b) & (a % 2 == 1), (a < b) & (b % 2 == 1)
        none = F.array().cast("array<struct<level:int,node:bigint>>")
        out = F.concat(out, F.when(left, F.array(node(level, a))).otherwise(none), F.when(right, F.array(node(level, b - 1))).otherwise(none))
        a, b = F.when(left, a + 1).otherwise(a), F.when((a < b) & (b % 2 == 1), b - 1).otherwise(b)
        return F.struct(F.shiftright(a, 1).alias("a"), F.shiftright(b, 1).alias("b"), out.alias("out"))

    return F.aggregate(F.sequence(F.lit(0), levels), start, step, lambda acc: acc["out"])


def valid_at(left: DataFrame, versions: DataFrame, by: list[str], left_id: str, at: str, id_: str) -> DataFrame:
    """left_id and target_id for any intervals: of the versions in force the one that began last (unknown starts first).

    The time that a key's versions span is cut into about as many buckets as it has versions. A version is laid over the buckets that it
    touches: where it begins or ends by itself, with its bounds checked, over whole buckets by the fewest nodes of a binary tree above them, of
    which only the best version is kept. A row looks up its own bucket and the nodes above it, so a pair meets in one place alone, no row
    meets all versions of its key, and a key with most rows is spread over its buckets. Rows without a time take their key's best version.
    """
    keyed = versions.select(*by, F.col(id_).alias("_id"), "valid_from", "valid_to", _micros(F.col("valid_from")).alias("_a"), _micros(F.col("valid_to")).alias("_b"))
    rank = F.struct(F.col("valid_from").isNull().alias("unknown"), F.col("valid_from").alias("begins"), F.col("_id").alias("id"))
    span = keyed.groupBy(*by).agg(F.min("_a").alias("_lo"), F.greatest(F.max("_a"), F.max("_b")).alias("_hi"), F.count("_a").alias("_n"), F.max(rank).alias("_best"))
    levels = F.least(F.lit(LEVELS), F.ceil(F.log2(F.greatest("_n", F.lit(1))))).cast("int")
    span = span.withColumn("_levels", levels).withColumn("_width", F.expr("(_hi - _lo) div shiftleft(1L, _levels) + 1"))
    span = small(span.select(*by, "_lo", "_hi", "_levels", "_width", "_best"))

    rows = left.select(*by, left_id, F.col(at).alias("_at")).join(span, by)
    whenever = rows.filter("_at IS NULL").select(left_id, F.col("_best").alias("rank"))
    timed = rows.filter("_at IS NOT NULL").withColumn("_t", _micros(F.col("_at"))).filter("_t >= _lo")
    timed = timed.withColumn("_bucket", F.expr("(least(_t, _hi) - _lo) div _width"))

    laid = keyed.filter("_a IS NOT NULL AND (_b IS NULL OR _a < _b)").join(span, by).select(*by, rank.alias("rank"), "_a", "_b", F.expr("(_a - _lo) div _width").alias("_first"), F.expr("(_b - _lo) div _width").alias("_last"), F.expr("shiftleft(1L, _levels)").alias("_all"), "_levels")
    ends = laid.select(*by, "rank", "_a", "_b", F.explode(F.array_distinct(F.array_compact(F.array("_first", "_last")))).alias("_bucket"))
    inner = laid.filter("_first + 1 < coalesce(_last, _all)").select(*by, "rank", F.explode(_nodes(F.col("_first") + 1, F.coalesce("_last", "_all"), F.col("_levels"))).alias("n"))
    inner = inner.groupBy(*by, F.col("n.level").alias("_level"), F.col("n.node").alias("_node")).agg(F.max("rank").alias("rank"))

    asks = timed.select(*by, left_id, "_t", "_bucket")
    near = asks.join(ends, [*by, "_bucket"]).filter("_a <= _t AND (_b IS NULL OR _t < _b)").select(left_id, "rank")
    above = timed.select(*by, left_id, "_bucket", F.explode(F.sequence(F.lit(0), F.col("_levels"))).alias("_level"))
    above = above.withColumn("_node", F.expr("shiftright(_bucket, _level)")).join(inner, [*by, "_level", "_node"]).select(left_id, "rank")
    return whenever.unionByName(near).unionByName(above).groupBy(left_id).agg(F.max("rank").alias("_best")).select(left_id, F.col("_best.id").alias("target_id"))


def differences(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys and change: added, removed or modified (null-safe comparison of ``value``)."""
    a, b = old.select(*keys, F.col(value).alias("_o"), F.lit(True).alias("_a")), new.select(*keys, F.col(value).alias("_n"), F.lit(True).alias("_b"))
    rows = a.join(b, keys, "full")
    kind = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("_o").eqNullSafe(F.col("_n")), "modified")
    return rows.withColumn("change", kind).filter("change IS NOT NULL").select(*keys, "change")


def strongest_change(changes: DataFrame, by: list[str]) -> DataFrame:
    """The strongest change of a group: removed before modified before added."""
    rank = F.when(F.col("change") == "removed", 3).when(F.col("change") == "modified", 2).otherwise(1)
    return changes.groupBy(*by).agg(F.max_by("change", rank).alias("change"))


def change_summary(changes: DataFrame, by: list[str], item: str, shown: int = 10) -> DataFrame:
    """Counts of each kind of change, and the first items by name, with dots if there are more."""
    items = F.sort_array(F.collect_set(F.col(item).cast("string")))
    rows = changes.groupBy(*by).agg(*[F.count_if(F.col("change") == k).alias(k) for k in ("added", "modified", "removed")], items.alias("_items"))
    text = F.concat(F.array_join(F.slice("_items", 1, shown), ", "), F.when(F.size("_items") > shown, ", ...").otherwise(""))
    return rows.withColumn("summary", text).drop("_items")
