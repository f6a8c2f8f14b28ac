"""Mixing sources to target weights with a low-discrepancy schedule.

Slot ``i`` of the mix is the point ``frac((i + 1/2) / golden ratio)`` (or a van der Corput point), looked up
in the cumulative target shares of the sources. Slots are ranked per source, and slot rank ``r`` takes block
``r`` of the source: its documents in shuffled order, laid end to end, repeated up to ``max_repeat`` times, and
cut into blocks of equal words. What the slots take is the mix: a source gets as many blocks as points fell into
its share, which is its target but for a few blocks, and blocks without a slot are not taken.

Defined results: a null or empty text has size 0 and is taken 0 times; a null source is a
source of its own, ordered last; repeated rows are mixed as separate documents; an empty table
gives an empty mix; a source whose share no point meets (its target is less than a few blocks) is not taken.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexlake.llm.common import GAP, SPACES, WORD, fresh, prefix_sums, small, written

#: Fractional parts of 1/phi and of 2**20/phi, phi the golden ratio: together they keep points exact for 2**40 slots.
GOLDEN, GOLDEN_20 = 0.6180339887498949, (2**20 * 0.6180339887498949) % 1.0


#: A mix has about so many slots, until blocks reach their largest size.
SLOTS, MOST_WORDS = 1 << 18, 1024


def golden(slot: Column) -> Column:
    """Golden-ratio points: frac((slot + 1/2) / phi)."""
    low, high = slot % 1048576 + 0.5, F.floor(slot / 1048576)
    return ((low * GOLDEN) % 1.0 + (high * GOLDEN_20) % 1.0) % 1.0


def van_der_corput(slot: Column) -> Column:
    """Van der Corput points: the binary digits of the slot mirrored at the point."""
    digits = F.reverse(F.lpad(F.bin(slot), 48, "0"))
    return F.conv(digits, 2, 10).cast("double") / float(1 << 48)


@dataclass
class Mix:
    """``sources``: source, source_rank, weight, source_size, target; ``documents``: every input row with
    its source's columns and its place (source_rank, bucket, place, nth, start); ``segments``: slot,
    source_rank, block, doc_id, bucket, place, epoch, first_word, words, in no order (order by slot)."""

    sources: DataFrame
    documents: DataFrame
    segments: DataFrame


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words of the whole text; null: 0) and a hash of the text."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64("text").alias("text_hash"),
    )


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeat: int = 3) -> DataFrame:
    """One row per source: weights repeat along the sources by code point (null last); all sizes are
    shared out by weight, no source above ``max_repeat`` times its size, excess going to the others.

    With sources ordered by (cap / weight), those that stop at their cap are the first few, and
    running sums give the level of all others. The windows see one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("source_rank", F.row_number().over(by_name) - 1)
    array = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("weight", F.get(array, F.col("source_rank") % len(weights)))
    per = per.withColumn("_cap", F.col("source_size") * F.lit(float(max_repeat)))
    every = Window.partitionBy(F.lit(0))
    before = Window.partitionBy(F.lit(0)).orderBy(F.col("_cap") / F.col("weight"), "source_rank").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    share = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    per = per.withColumn("_level", left / share)
    free = F.when(F.col("_cap") / F.col("weight") > F.col("_level"), F.struct(F.col("_cap") / F.col("weight"), "source_rank", "_level"))
    per = per.withColumn("_free", F.min(free).over(every))
    target = F.least("_cap", F.coalesce(F.col("weight") * F.col("_free._level"), F.col("_cap")))
    return per.select("source", "source_rank", "weight", "source_size", target.alias("target"))


def slots(spark, sources: DataFrame, n_slots: int, n_sources: int, points: Callable[[Column], Column] = golden) -> DataFrame:
    """slot, source_rank and rank (of the slot among its source's), for the first ``n_slots`` of ``points``.

    A grid over (0, 1) turns the lookup in cumulative shares into an equi-join, and ranks are
    counted in runs of slots, so a source with most of the slots is not one task's.
    """
    grid = 1 << max(10, (4 * n_sources).bit_length())
    by_rank = Window.orderBy("source_rank").rowsBetween(Window.unboundedPreceding, 0)
    edge = sources.filter("target > 0").select("source_rank", "target", F.sum("target").over(by_rank).alias("_to"))
    total = F.max("_to").over(Window.partitionBy(F.lit(0)))
    edge = edge.select("source_rank", ((F.col("_to") - F.col("target")) / total).alias("lo"), F.when(F.col("_to") >= total, 2.0).otherwise(F.col("_to") / total).alias("hi"))
    cells = F.sequence(F.floor(F.col("lo") * grid), F.least(F.lit(grid - 1).cast("long"), F.floor(F.col("hi") * grid)))
    edge = edge.select("source_rank", "lo", "hi", F.explode(cells).alias("cell"))
    dealt = spark.range(n_slots).select(F.col("id").alias("slot"), points(F.col("id")).alias("u"))
    dealt = dealt.withColumn("cell", F.least(F.floor(F.col("u") * grid), F.lit(grid - 1).cast("long")))
    edge = small(edge, grid + 2 * n_sources)
    dealt = dealt.join(edge, "cell").filter("u >= lo AND u < hi").select("slot", "source_rank", F.expr("slot div 256").alias("run"))
    counts = dealt.groupBy("source_rank", "run").agg(F.count("*").alias("n"))
    before = prefix_sums(counts, ["source_rank"], "run", "n", "before")
    local = F.row_number().over(Window.partitionBy("source_rank", "run").orderBy("slot")) - 1
    ranked = dealt.withColumn("_local", local).join(before, ["source_rank", "run"])
    return ranked.select("slot", "source_rank", (F.col("before") + F.col("_local")).alias("rank"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeat: int = 3, block_words: int | None = None, seed: int = 17, points: Callable[[Column], Column] = golden) -> Mix:
    """Mix ``docs`` (doc_id, text, source). ``block_words``: words of a block, the unit of the schedule; if not
    given, as many as make about ``SLOTS`` slots, ``MOST_WORDS`` at most.

    Sizes, places and the schedule are written to the shared folder once; texts never move.
    """
    spark = docs.sparkSession
    sizes = written(sized(docs), "mix-sizes")
    totals = sizes.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("words")).first()
    sources = written(targets(sizes, weights, max_repeat), "mix-sources")
    n_sources = sources.count()
    block_words = block_words or max(1, min(MOST_WORDS, totals["words"] // SLOTS))
    n_slots = -(-totals["words"] // block_words)
    schedule = written(slots(spark, sources, n_slots, n_sources, points).withColumnRenamed("rank", "block"), "mix-schedule")
    dealt = schedule.groupBy("source_rank").agg(F.count("*").alias("n_blocks"))
    known = sources.join(dealt, "source_rank", "left").select(F.col("source").alias("_source"), "source_rank", "source_size", "target", F.coalesce("n_blocks", F.lit(0)).alias("n_blocks"))

    buckets = max(1, totals["n"] // 128)
    rows = sizes.join(small(known, n_sources), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rows = rows.withColumn("_hash", F.xxhash64("doc_id", "text_hash", F.lit(seed))).withColumn("bucket", F.pmod("_hash", F.lit(buckets)))
    shuffled = Window.partitionBy("source_rank", "bucket").orderBy("_hash", "doc_id", "size", "text_hash")
    rows = rows.withColumn("place", F.row_number().over(shuffled)).withColumn("nth", F.col("place") - F.rank().over(shuffled))
    rows = rows.withColumn("_start", F.coalesce(F.sum("size").over(shuffled.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    sums = rows.groupBy("source_rank", "bucket").agg(F.sum("size").alias("_sum"))
    before = prefix_sums(sums, ["source_rank"], "bucket", "_sum", "_before")
    rows = rows.join(before, ["source_rank", "bucket"])
    rows = rows.select("doc_id", "source", "size", "text_hash", "source_rank", "source_size", "target", "n_blocks", "bucket", "place", "nth", (F.col("_before") + F.col("_start")).alias("start"))
    rows = written(rows, "mix-documents")

    # only words that a block with a slot may hold are laid out; the join with the schedule then takes them
    stop = F.least(F.col("n_blocks") * block_words, F.col("source_size") * max_repeat)
    laid = rows.filter("size > 0 AND n_blocks > 0").withColumn("_stop", stop)
    laid = laid.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(_stop - 1) div source_size"))))
    laid = laid.withColumn("_from", F.col("epoch") * F.col("source_size") + F.col("start"))
    laid = laid.withColumn("_to", F.least(F.col("_from") + F.col("size"), "_stop")).filter("_to > _from")
    laid = laid.withColumn("block", F.explode(F.sequence(F.expr(f"_from div {block_words}"), F.expr(f"(_to - 1) div {block_words}"))))
    begin = F.greatest("_from", F.col("block") * block_words)
    end = F.least("_to", (F.col("block") + 1) * block_words)
    laid = laid.select("source_rank", "block", "doc_id", "bucket", "place", "epoch", (begin - F.col("_from")).alias("first_word"), (end - begin).alias("words"))
    return Mix(sources, rows, laid.join(schedule, ["source_rank", "block"]))


def documents_taken(docs: DataFrame, **params) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row: words that the segments of its mix take."""
    mixed = mix(docs, **params)
    keys = ["source_rank", "bucket", "place"]
    words = mixed.segments.groupBy(*keys).agg(F.sum("words").alias("taken"))
    found = mixed.documents.join(words, keys, "left")
    return found.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **params) -> DataFrame:
    """The mix as documents, in the order of its slots: ``docs`` with each row as often as the mix takes it, where
    its first block lies, the last time perhaps its first words only (joined by spaces). Rows that it doesn't take go;
    rows without words stay, ahead of the others. Columns stay, n_chars follows the text.

    The taken rows are slim and find their texts by doc_id, source, size and text hash; rows equal in these are told
    apart by number. The result is range-partitioned and sorted by slot.
    """
    columns = docs.columns
    mixed = mix(docs, **params)
    keys = ["source_rank", "bucket", "place"]
    runs = mixed.segments.groupBy(*keys, "epoch").agg(F.min("slot").alias("slot"), F.sum("words").alias("take"))
    taken = mixed.documents.join(runs, keys).withColumn("at", F.col("epoch") * F.col("source_size") + F.col("start"))
    taken = written(taken.select("doc_id", "source", "size", "text_hash", "nth", "slot", "at", "take"), "mix-taken")
    twice = written(taken.filter("nth > 0").select("doc_id", "source", "size", "text_hash").distinct(), "mix-repeated")

    key = fresh(docs, "mix_doc_id", "mix_source", "mix_size", "mix_hash")
    there = fresh(docs, "mixed_doc_id", "mixed_source", "mixed_size", "mixed_hash")
    nth, part, before, its_nth, slot, at, take = fresh(docs, "mix_nth", "mix_part", "mix_before", "mixed_nth", "mixed_slot", "mixed_at", "mixed_take")
    size = key[2]
    rows = docs.withColumns(
        {
            key[0]: F.col("doc_id").cast("long"),
            key[1]: F.col("source").cast("string"),
            size: F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"),
            key[3]: F.xxhash64("text"),
        }
    )
    same = [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(key, there, strict=True)]
    n_twice = twice.count()
    if n_twice:
        again = small(twice.toDF(*there), n_twice)
        held = rows.join(again, same, "left_semi").withColumn(part, F.pmod(F.monotonically_increasing_id(), F.lit(64)))
        held = written(held, "mix-repeated-rows")
        counts = held.groupBy(*key, part).agg(F.count("*").alias("_n"))
        sums = prefix_sums(counts, key, part, "_n", before).toDF(*there, its_nth, before)
        local = F.row_number().over(Window.partitionBy(*key, part).orderBy(F.lit(0))) - 1
        held = held.withColumn(nth, local).join(sums, [*same, F.col(part) == F.col(its_nth)])
        held = held.select(*columns, *key, (F.col(nth) + F.col(before)).cast("long").alias(nth))
        rows = rows.join(again, same, "left_anti").withColumn(nth, F.lit(0).cast("long")).unionByName(held)
    else:
        rows = rows.withColumn(nth, F.lit(0).cast("long"))
    slim = small(taken.toDF(*there, its_nth, slot, at, take), taken.count())
    rows = rows.join(slim, [*same, F.col(nth) == F.col(its_nth)], "left").filter(F.col(take).isNotNull() | (F.col(size) == 0))
    words = F.split(F.btrim("text", F.lit(SPACES)), GAP)
    cut = F.col(take) < F.col(size)
    rows = rows.withColumn("text", F.when(cut, F.array_join(F.slice(words, F.lit(1), F.col(take).cast("int")), " ")).otherwise(F.col("text")))
    if "n_chars" in columns:
        rows = rows.withColumn("n_chars", F.when(cut, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    order = [F.col(slot).asc_nulls_first(), F.col(at), F.col(key[0])]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).select(*columns)
