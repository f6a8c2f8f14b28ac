"""Quality rules with adaptive thresholds, as DataFrame operations.

Every text gets counts (words, their characters, symbols, repeated lines, words in repeated windows) and four
ratios of them. A ratio's distribution in a group of documents is a sketch: a histogram over buckets that grow with
the value, 64 for each power of two, so a value is known within a 64th. Sketches are rows of counts, so those of parts,
of a language's sources, or of all languages merge by adding. From the quartiles of a language's source come the
limits that its documents are held against by a join; a source with few documents takes those of its language, a
language with few those of all.

Defined results: a null text is as an empty one; a text without words fails the base rules and enters no sketch; null
languages and sources are groups of their own; repeated rows count each; an empty table gives an empty result; other columns
are ignored by ``report`` and kept by ``filtered``, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexlake.llm.common import SPACES, fresh, let, small, written
from lexlake.llm.fingerprints import words

SYMBOLS = "#*$%&|<>"
#: Words of a window that is looked for again in its text.
WINDOW = 3
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
#: Buckets for each power of two of a sketch are 2 ** FINE.
FINE = 6
#: Tasks that a group's rows are spread over where limits are joined by shuffle.
SALTS = 16


@dataclass(frozen=True)
class Rule:
    """A ratio: ``scale`` times ``part`` div ``whole``. Its upper limit is the upper quartile and ``spread`` times the distance
    of the quartiles, but ``slack`` at least; with ``low`` there is a lower limit likewise. Values on a limit pass."""

    name: str
    part: str
    whole: str
    scale: int
    slack: int
    low: bool = False
    spread: int = 3


RULES: tuple[Rule, ...] = (
    Rule("symbols", "n_symbols", "n_words", 10_000, 2_000),
    Rule("word_length", "word_chars", "n_words", 1_000, 1_000, True),
    Rule("dup_lines", "n_dup_lines", "n_lines", 1_000, 400),
    Rule("repeats", "n_repeat_words", "n_words", 1_000, 350),
)
#: A sketch of at least so many documents decides; smaller ones are merged.
LEAST_DOCS = 200


def repeated_words(hashes: Column, n: int = WINDOW) -> Column:
    """Words, given by their hashes, that lie in a window of ``n`` found twice or more.

    Windows are sorted by hash beside their places, so equal ones are neighbours; the places of those are sorted again
    and their extents added up.
    """
    none = F.lit(0).cast("long")
    slots = F.transform(F.sequence(F.lit(0), F.size(hashes) - n), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(n)]))

    def covered(windows: Column) -> Column:
        def of(s: Column) -> Column:
            def again(x: Column, i: Column) -> Column:
                return F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))

            places = F.sort_array(F.transform(F.filter(s, again), lambda x: x["i"]))
            start = F.struct(F.lit(0).alias("end"), none.alias("n"))
            return F.aggregate(places, start, lambda a, p: F.struct((p + n).alias("end"), (a["n"] + n - F.greatest(F.lit(0), a["end"] - p)).alias("n")), lambda a: a["n"])

        placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), none).otherwise(let(placed, of))

    return F.when(F.size(hashes) > n, let(slots, covered)).otherwise(none)


def counted(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with the counts of every whole text, and the columns that COUNTS are in (others if a column has that name)."""
    held, lines, *names = fresh(docs, "word_stats", "line_stats", *COUNTS)
    text = F.coalesce(F.col("text"), F.lit(""))

    def of_words(h: Column) -> Column:
        return F.struct(F.size(h).cast("long").alias("n"), repeated_words(h).alias("again"))

    def of_lines(x: Column) -> Column:
        return F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("again"))

    def without(characters: str) -> Column:
        return F.char_length(F.translate(text, characters, "")).cast("long")

    found = docs.withColumns({
        held: let(F.transform(words(F.col("text")), lambda w: F.xxhash64(w)), of_words),
        lines: let(F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != ""), of_lines),
    })
    values = (F.col(held)["n"], without(SPACES), F.char_length(text).cast("long") - without(SYMBOLS), F.col(lines)["n"], F.col(lines)["again"], F.col(held)["again"])
    return found.withColumns(dict(zip(names, values, strict=True))).drop(held, lines), dict(zip(COUNTS, names, strict=True))


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    """Fixed rules: fewer than 50 words, or more than half of them in repeated windows."""
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


def ratio(rule: Rule, names: dict[str, str]) -> Column:
    """A rule's value; null for a text without words."""
    return F.expr(f"({rule.scale} * `{names[rule.part]}`) div nullif(`{names[rule.whole]}`, 0)")


def bucket(value: Column) -> Column:
    """The bucket of a value of 0 or more: itself below 128, then 64 for each power of two."""
    shift = F.greatest(F.lit(0), F.length(F.bin(value)) - 1 - FINE)
    return shift.cast("long") * 2**FINE + F.call_function("shiftright", value, shift)


def bucket_floor(b: Column) -> Column:
    """The least value of a bucket."""
    shift = F.greatest(F.lit(0).cast("long"), F.floor(b / 2**FINE) - 1)
    return F.call_function("shiftleft", b - shift * 2**FINE, shift.cast("int"))


def sketches(stats: DataFrame, names: dict[str, str], by: list[str], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(by, rule, bucket, n): the sketch of every group and rule."""
    each = F.array(*[F.struct(F.lit(k).alias("rule"), ratio(r, names).alias("value")) for k, r in enumerate(rules)])
    rows = stats.select(*by, F.explode(each).alias("_e")).filter("_e.value IS NOT NULL")
    return rows.groupBy(*by, F.col("_e.rule").alias("rule"), bucket(F.col("_e.value")).alias("bucket")).agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of the coarser groups ``by``, or of parts that were sketched apart and put together by union."""
    return sketch.groupBy(*by, "rule", "bucket").agg(F.sum("n").alias("n"))


def quartiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """(by, rule, n, q1, q3): documents and quartiles; a quantile is the least bucket that the share of documents doesn't exceed."""
    every = Window.partitionBy(*by, "rule")
    upto = every.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    rows = sketch.withColumns({"_upto": F.sum("n").over(upto), "_all": F.sum("n").over(every)})
    at = {f"q{k}": bucket_floor(F.min(F.when(4 * F.col("_upto") >= k * F.col("_all"), F.col("bucket")))).alias(f"q{k}") for k in (1, 3)}
    return rows.groupBy(*by, "rule").agg(F.first("_all").alias("n"), *at.values())


def limits(sketch: DataFrame, least: int = LEAST_DOCS, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(lang, source, limits): array<struct<low, high>> by rule, from the finest sketch with ``least`` documents or more."""
    fine, middle, all_ = (quartiles(sketch, ["lang", "source"]), quartiles(merged(sketch, ["lang"]), ["lang"]), quartiles(merged(sketch, []), []))
    joined = fine.alias("f").join(middle.alias("m"), F.col("f.lang").eqNullSafe(F.col("m.lang")) & (F.col("f.rule") == F.col("m.rule"))).join(F.broadcast(all_.alias("a")), F.col("f.rule") == F.col("a.rule"))

    def of(q: str) -> Column:
        return F.when(F.col("f.n") >= least, F.col(f"f.{q}")).when(F.col("m.n") >= least, F.col(f"m.{q}")).otherwise(F.col(f"a.{q}"))

    rule = F.col("f.rule")
    slack, spread = (F.element_at(F.array(*[F.lit(x) for x in xs]), rule + 1) for xs in ([r.slack for r in rules], [r.spread for r in rules]))
    reach = F.greatest(spread * (of("q3") - of("q1")), slack)
    low = F.when(F.element_at(F.array(*[F.lit(r.low) for r in rules]), rule + 1), of("q1") - reach)
    rows = joined.select("f.lang", "f.source", rule.alias("rule"), F.struct(low.alias("low"), (of("q3") + reach).alias("high")).alias("limit"))
    return rows.groupBy("lang", "source").agg(F.map_from_entries(F.collect_list(F.struct("rule", "limit"))).alias("limits"))


def judged(stats: DataFrame, names: dict[str, str], found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``stats`` with base_failed, failed_rules (names, by the rules' order) and kept; columns of these names are replaced.

    Limits are broadcast if they are few; else both sides are shuffled, each group's rows spread over ``SALTS`` tasks.
    """
    lang, source, cuts, salt, its_salt = fresh(stats, "limit_lang", "limit_source", "group_limits", "row_salt", "limit_salt")
    n = found.count()
    found = found.select(F.col("lang").alias(lang), F.col("source").alias(source), F.col("limits").alias(cuts))
    on = F.col("lang").eqNullSafe(F.col(lang)) & F.col("source").eqNullSafe(F.col(source))
    if small(found, n) is found:
        stats = stats.withColumn(salt, F.pmod(F.xxhash64("doc_id", *names.values()), F.lit(SALTS)))
        found = found.withColumn(its_salt, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        on &= F.col(salt) == F.col(its_salt)
    rows = stats.join(small(found, n), on, "left")
    failed = []
    for k, rule in enumerate(rules):
        value, limit = ratio(rule, names), F.col(cuts)[k]
        failed.append(F.when((value > limit["high"]) | F.coalesce(value < limit["low"], F.lit(False)), F.lit(rule.name)))
    base = base_failed(F.col(names["n_words"]), F.col(names["n_repeat_words"]))
    rows = rows.withColumns({"base_failed": base, "failed_rules": F.array_compact(F.array(*failed))})
    return rows.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)).drop(lang, source, cuts, salt, its_salt)


def _slim(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """Counts of every document without its text, written once."""
    stats, names = counted(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text")))
    return written(stats.drop("text"), "quality-counts"), names


def report(docs: DataFrame, least: int = LEAST_DOCS, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts and verdict of every document: one pass over the texts, sketches and join over their counts."""
    stats, names = _slim(docs)
    found = written(limits(sketches(stats, names, ["lang", "source"], rules), least, rules), "quality-limits")
    rows = judged(stats, names, found, rules)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("failed_rules", ",").alias("failed_rules"))


def filtered(docs: DataFrame, least: int = LEAST_DOCS, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that pass, with their columns; counts are taken anew beside the texts rather than stored with them."""
    columns = docs.columns
    held, names = _slim(docs)
    found = written(limits(sketches(held, names, ["lang", "source"], rules), least, rules), "quality-limits")
    apart = docs.select(F.struct(*columns).alias("own_row"), *[F.col(c) for c in ("doc_id", "lang", "source", "text")])
    stats, names = counted(apart)
    rows = judged(stats, names, found, rules).filter("kept")
    return rows.select(*[F.col("own_row")[c].alias(c) for c in columns])
