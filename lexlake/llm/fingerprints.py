"""Document fingerprints: bottom-k sketches of shingle hashes, as Column expressions.

A sketch is the sorted array of the ``k`` smallest distinct 64-bit hashes of a text's shingles of
``n`` words. The sketch of a union is the bottom k of the sketches' union, so sketches of parts
merge (``merged``), in any order and grouping. From two sketches come their resemblance and
containment, from one the number of distinct shingles.

Defined results: a null text is as an empty one and has the empty sketch; a text of fewer than
``n`` words has one shingle, all its words; two empty sketches resemble each other by 1, an empty
and another by 0. Repeated rows and equal texts have equal sketches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexlake.llm.common import GAP, SPACES, let, small

K = 128
SHINGLE_WORDS = 5


def words(text: Column) -> Column:
    """The words of a text; none for a null or blank one."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, GAP))


def shingle_hashes(text: Column, n: int = SHINGLE_WORDS) -> Column:
    """Hash of every shingle of the text, in order, repeats included."""

    def of(h: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.xxhash64(*[h[i + j] for j in range(n)]))
        return F.when(F.size(h) >= n, each).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(words(text), lambda w: F.xxhash64(w)), of)


def bottom(hashes: Column, k: int = K) -> Column:
    """The k smallest distinct values of an array, ascending."""
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def sketch(text: Column, k: int = K, n: int = SHINGLE_WORDS) -> Column:
    """The sketch of a whole text."""
    return bottom(shingle_hashes(text, n), k)


def merged(parts: DataFrame, by: list[str], sketch_col: str = "sketch", k: int = K, fan_in: int = 64) -> DataFrame:
    """One sketch per group of ``by`` from the sketches of its parts.

    Two rounds: parts are first merged in ``fan_in`` salted subgroups, so a group with a third of
    all parts is spread out; each round holds no more than arrays of k values.
    """
    salted = parts.select(*by, F.explode_outer(sketch_col).alias("_h")).withColumn("_salt", F.pmod("_h", F.lit(fan_in)))
    distinct = salted.distinct()
    first = Window.partitionBy(*by, "_salt").orderBy("_h")
    near = distinct.withColumn("_rn", F.row_number().over(first)).filter(F.col("_rn") <= k)
    near = near.groupBy(*by, "_salt").agg(F.collect_list("_h").alias("_part"))
    return near.groupBy(*by).agg(bottom(F.flatten(F.collect_list("_part")), k).alias(sketch_col))


def _shared(a: Column, b: Column, union: Column) -> Column:
    return F.size(F.array_intersect(F.array_intersect(a, b), union)).cast("double")


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimate of the Jaccard similarity of two sketches' shingle sets, 0 to 1."""
    est = let(bottom(F.concat(a, b), k), lambda u: _shared(a, b, u) / F.size(u))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(est)


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimate of the number of distinct shingles; exact below k."""
    share = (F.element_at(a, -1).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(k - 1.0) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimate of the share of a's shingles that b has too, 0 to 1 (an empty a: 1)."""
    j = resemblance(a, b, k)
    both = j / (j + 1.0) * (distinct_count(a, k) + distinct_count(b, k))
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), both / distinct_count(a, k)))


def printed(a: Column) -> Column:
    """A sketch as text: its values in 16 hexadecimal digits each."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def _ranges(docs: DataFrame, n: int) -> tuple[list[int], list[int]]:
    """Lower bounds of about ``n`` ranges of doc_id of about equal numbers of rows (a range's number is that of the
    bounds not above it), and the numbers of ranges of one doc_id that many rows share."""
    shares = F.lit(",".join(str(k / n) for k in range(1, n)) or "0.5")
    cuts = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), F.split(shares, ",").cast("array<double>"), 8 * n).alias("q")).first()["q"]
    often = sorted({a for a, b in zip(cuts or [], (cuts or [])[15:], strict=False) if a == b})
    bounds = sorted({*(cuts or []), *(i + 1 for i in often if i < 2**63 - 1)})
    return bounds, [bounds.index(i) + 1 for i in often]


def with_next(docs: DataFrame, rows_per_bucket: int = 256, max_buckets: int = 65_536) -> DataFrame:
    """doc_id, text, sketch, next_text, next_sketch: each row beside the next by ascending doc_id,
    the last beside the first (nulls last, ties by text hash; a lone row is its own next).

    doc_ids are cut into at most ``max_buckets`` ranges by their approximate quantiles, so that outliers and gaps
    don't matter; a doc_id that many rows share, and rows without one, are cut further by text hash. Each range gets a copy of
    the next range's first row, so a window over one range at a time sees all it needs and every
    text moves once.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = rows.count()
    bounds, often = _ranges(rows, max(1, min(max_buckets, n // rows_per_bucket)))
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("text").alias("h"))
    # binary search in the bounds, then 256 parts of the hash where one doc_id fills a range
    table = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))]) if bounds else F.array().cast("array<int>")
    found = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(table, at + step - 1) <= F.col("doc_id"), at + step).otherwise(at))
    found = F.when(F.col("doc_id").isNull(), len(bounds) + 1).otherwise(found)
    rows = rows.withColumn("_range", found).withColumn("_key", key)
    crowded = F.col("_range").isin(*often, len(bounds) + 1)
    at = F.col("_range").cast("long") * 256 + F.when(crowded, F.shiftright("_key.h", 56) + 128).otherwise(F.lit(0))
    rows = rows.withColumn("_at", at).drop("_range")
    firsts = rows.groupBy("_at").agg(F.min("_key").alias("_first"))
    order = Window.orderBy("_at")
    last = F.max("_at").over(Window.partitionBy(F.lit(0)))
    firsts = firsts.select(F.col("_at").alias("_first_of"), F.col("_first"), F.coalesce(F.lag("_at").over(order), last).alias("_before"))
    firsts = small(firsts, len(bounds) + 2 + 256 * (len(often) + 1))
    rows = rows.join(firsts, (F.col("_at") == F.col("_first_of")) & (F.col("_key") == F.col("_first")), "left")
    rows = rows.withColumn("sketch", sketch(F.col("text")))
    own = F.struct(F.col("_at").alias("at"), F.lit(False).alias("copy"))
    copy = F.struct(F.col("_before").alias("at"), F.lit(True).alias("copy"))
    rows = rows.withColumn("_in", F.explode(F.when(F.col("_first").isNull(), F.array(own)).otherwise(F.array(own, copy))))
    rows = rows.select("doc_id", "text", "sketch", "_key", F.col("_in.at").alias("_at"), F.col("_in.copy").alias("_copy"))
    near = Window.partitionBy("_at").orderBy("_copy", "_key")
    rows = rows.withColumns({"next_text": F.lead("text").over(near), "next_sketch": F.lead("sketch").over(near)})
    return rows.filter(~F.col("_copy")).drop("_key", "_at", "_copy")


def edited_text(text: Column, other: Column) -> Column:
    """The text with its last floor(n / 2) code points replaced by the first as many (or all) of ``other``."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - half), F.substring(other, F.lit(1), half))


def edit_report(docs: DataFrame, k: int = K) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they and the next text's are."""
    rows = with_next(docs)
    rows = rows.withColumn("_edited", edited_text(F.col("text"), F.col("next_text")))
    rows = rows.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"),
        "sketch",
        "next_sketch",
        sketch(F.col("_edited"), k).alias("_edited_sketch"),
    )
    a, b, c = F.col("sketch"), F.col("_edited_sketch"), F.col("next_sketch")
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        printed(a).alias("fingerprint"),
        printed(b).alias("edited_fingerprint"),
        resemblance(a, b, k).alias("near_edited"),
        resemblance(a, c, k).alias("near_next"),
        distinct_count(a, k).alias("shingles"),
        containment(b, a, k).alias("edited_in_text"),
    )
