"""N-gram Jaccard join with adaptive multi-match prefixes, and the components of its links.

Two texts link when the Jaccard similarity of their shingle sets is at least ``percent`` / 100.
Shingles are ordered rare ones first. If a pair must share ``a`` shingles to link, the first
``size - a + m`` shingles of its two sets share ``m`` or more. Every document picks its own ``m``: where its shortest
prefix promises many candidates, it lengthens the prefix and asks for more shared prefix shingles
before a pair is verified. The larger document of a pair decides.

How it runs:

1.  Texts with equal sets are one class, known by its smallest doc_id; only classes go on.
2.  Prefix shingles that one class alone has are dropped: most are.
3.  Star rounds: in every posting list one class is compared with all others, so a group of
    thousands of near copies costs a pair for each member, and verified links merge components.
4.  The last round compares every pair that shares enough prefix shingles and is in different
    components still: in each list, all rows with those outside the list's largest component, of sizes
    that may link (bands of sizes are part of the join's key).
    No link between components is lost, and no list is squared within a component.
5.  Before that, a bitmap of each set's parities (``MAP_WORDS`` times 64 bits, an element toggles one)
    drops pairs: two sets differ in at least as many elements as their bitmaps in bits.
6.  Verification counts on whole sets: one class of a pair sends its set to the other's, which is held once
    for a run of its pairs, so a star's middle isn't copied for each of its members.

Step order and shingle frequency only decide how much work is done, never what links. Tables
between steps are in the shared folder.

Defined results: a null, empty or wordless text has an empty set and links with nothing; a row
without doc_id links with nothing and has no component; rows that share a doc_id are one document
of the component; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexlake.llm.common import arrow_rows, forget, small, written
from lexlake.llm.shingles import mixed, shingle_sets

MAX_MATCHES = 4
SLOT_BITS = 22
STAR_ROUNDS = 2
MAP_WORDS = 4
MAP = [f"map_{k}" for k in range(MAP_WORDS)]
#: Verifying a candidate costs about as much as so many rows of posting lists.
VERIFY_COST = 16
#: Single long keys are short: so many may be broadcast.
BROADCAST_KEYS = 500_000
#: Pairs of one class that are verified in one run.
RUN_PAIRS = 256


@dataclass(frozen=True)
class Rule:
    """Shingles of ``n`` words; ``percent`` of the union must be shared."""

    n: int = 3
    percent: int = 90

    def least_overlap(self, size: np.ndarray | int):
        """Shingles that any partner shares with a set of this size."""
        return -(-size * self.percent // 100)

    def band(self, size: Column) -> Column:
        """A number of the size: sets that link are of the same band or of two next to each other."""
        return F.floor(F.log(size) / -log(self.percent / 100) + 1e-9).cast("int") if 0 < self.percent < 100 else size.cast("int")


def frequent_slots(texts: DataFrame, rule: Rule) -> np.ndarray:
    """Of each of 2**SLOT_BITS hash classes of shingles, the bit length of how many texts have it, 0 for ordinary ones.

    Every task counts all its texts' shingles and reports the classes that stand out of its
    average; the sums, at most one number per class, reach the driver.
    """
    shift = np.uint64(64 - SLOT_BITS)

    def add(counts: np.ndarray, held: list[np.ndarray]) -> None:
        slots, n = np.unique(np.concatenate([*held, np.zeros(0, np.int32)]), return_counts=True)
        counts[slots] += n.astype(np.int32)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SLOT_BITS, np.int32)
        for b in batches:
            held, size = [], 0
            for s in shingle_sets(b.column("text"), rule.n):
                held.append((s >> shift).astype(np.int32))
                size += len(s)
                if size > 1 << 18:
                    add(counts, held)
                    held, size = [], 0
            add(counts, held)
        usual = counts.mean()
        slots = np.flatnonzero(counts >= max(3.0, usual + 4 * np.sqrt(usual)))
        yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int64()), pa.array(counts[slots], pa.int64())], ["slot", "n"])

    found = texts.select("text").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    table = np.zeros(1 << SLOT_BITS, np.uint8)
    arrow = found.toArrow()
    table[arrow.column("slot").to_numpy()] = np.frexp(arrow.column("n").to_numpy().astype(np.float64))[1]
    return table


def prefixes(texts: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, n_shingles, sig_a, sig_b (of the whole set), its bitmap, tokens (the longest prefix, in order)."""
    spark = texts.sparkSession
    slots = spark.sparkContext.broadcast(frequent_slots(texts, rule))
    shift = np.uint64(64 - SLOT_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = slots.value
        for b in batches:
            sizes, a, c, tokens, maps = [], [], [], [], []
            for s in shingle_sets(b.column("text"), rule.n):
                n = len(s)
                take = min(n, n - int(rule.least_overlap(n)) + MAX_MATCHES)
                ranks = rank[(s >> shift).astype(np.int64)]
                first = s[np.argsort(ranks, kind="stable")[:take]] if ranks.any() else s[:take]
                sizes.append(n)
                a.append(int(s.sum(dtype=np.uint64).view(np.int64)))
                c.append(int(mixed(s ^ np.uint64(0x5BF03635)).sum(dtype=np.uint64).view(np.int64)))
                tokens.append(first.view(np.int64))
                odd = np.bincount((s & np.uint64(64 * MAP_WORDS - 1)).astype(np.int64), minlength=64 * MAP_WORDS) & 1
                maps.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
            flat = np.concatenate(tokens) if tokens else np.zeros(0, np.int64)
            offsets = np.concatenate(([0], np.cumsum([len(t) for t in tokens]))).astype(np.int32)
            arrays = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            words = np.array(maps, np.int64).reshape(-1, MAP_WORDS)
            columns = [b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(a, pa.int64()), pa.array(c, pa.int64()), *(pa.array(words[:, k]) for k in range(MAP_WORDS)), arrays]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "sig_a", "sig_b", *MAP, "tokens"])

    return texts.mapInArrow(run, ", ".join(f"{c} long" for c in ["doc_id", "n_shingles", "sig_a", "sig_b", *MAP]) + ", tokens array<long>")


def postings(classes: DataFrame, rule: Rule) -> DataFrame:
    """token, rep, n, common, pos, matches: prefix shingles that two classes or more share, and their place in the order.

    ``matches`` is the number of shared shingles that the class asks for, where the estimated cost of
    its lists and candidates is least.
    ``common`` is how many of the class's shingles another may have at most: all but those of its
    prefix that it has alone.
    """
    base = F.col("n") - F.ceil(F.col("n") * rule.percent / 100) + 1
    rows = classes.select("rep", F.posexplode("tokens").alias("pos", "token"), base.alias("_base"))
    rows = rows.select("token", "rep", "pos", F.greatest(F.lit(1), F.col("pos") - F.col("_base") + 2).cast("int").alias("level"))
    shared = rows.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    rows = rows.join(shared, "token")
    own = classes.select("rep", "n", *MAP, F.size("tokens").alias("_prefix"))
    rows = written(rows.join(own, "rep"), "join-postings")
    per = rows.groupBy("rep").agg(F.max(F.ceil(F.col("n") * rule.percent / 100)).alias("_most"), F.max(F.col("n") - F.col("_prefix")).alias("_rest"), F.count("*").alias("_shared"), *[F.coalesce(F.sum(F.when(F.col("level") <= m, F.col("df") - 1)), F.lit(0)).alias(f"_w{m}") for m in range(1, MAX_MATCHES + 1)])
    costs = F.array(*[F.struct((F.col(f"_w{m}") * (1 + VERIFY_COST / m)).alias("cost"), F.lit(m).alias("m")) for m in range(1, MAX_MATCHES + 1)])
    best = F.array_min(F.filter(costs, lambda c: c["m"] <= F.col("_most")))
    per = per.filter(F.col("_rest") + F.col("_shared") >= F.col("_most"))
    per = per.select("rep", best["m"].alias("matches"), (F.col("_rest") + F.col("_shared")).alias("common"))
    lists = written(rows.join(per, "rep").select("token", *COLUMNS), "join-lists")
    forget(rows)
    return lists


COLUMNS = ("rep", "n", "common", "pos", "matches", *MAP)


def _side(rows: DataFrame, name: str, *more: str) -> DataFrame:
    return rows.select("token", *more, *[F.col(c).alias(f"{name}_{c}") for c in (*COLUMNS, "comp")])


def matched(pairs: DataFrame, rule: Rule, most: int = MAX_MATCHES) -> DataFrame:
    """a, b: pairs of classes (columns x_* and y_*, a row per shared prefix shingle) that share enough of
    them for the larger class of the two (``most`` is always enough), and have enough shingles in common
    with any other for a link."""
    x_larger = F.struct("x_n", "x_rep") > F.struct("y_n", "y_rep")
    need = F.when(x_larger, F.col("x_matches")).otherwise(F.col("y_matches"))
    least = F.ceil((F.col("x_n") + F.col("y_n")) * rule.percent / (100 + rule.percent))
    able = F.least("x_common", "y_common", "x_n", "y_n") >= least
    within = (F.col("x_pos") < F.col("x_n") - least + need) & (F.col("y_pos") < F.col("y_n") - least + need)
    apart = reduce(Column.__add__, [F.bit_count(F.col(f"x_{m}").bitwiseXOR(F.col(f"y_{m}"))) for m in MAP])
    alike = apart <= F.col("x_n") + F.col("y_n") - 2 * least
    rows = pairs.filter((F.col("x_comp") != F.col("y_comp")) & able & within & alike)
    rows = rows.groupBy(F.least("x_rep", "y_rep").alias("a"), F.greatest("x_rep", "y_rep").alias("b")).agg(F.count("*").alias("_k"), F.max(need).alias("_need"))
    return rows.filter(F.col("_k") >= F.least("_need", F.lit(most))).select("a", "b")


def star_pairs(rows: DataFrame, seed: int, rule: Rule) -> DataFrame:
    """Candidates of one class of every list with the list's other classes: the one with the fewest shingles of its
    own, which is nearest to the middle of its group (later rounds: the one of least hash)."""
    alone = F.round((F.col("n") - F.col("common")) / F.col("n"), 2) if seed == 0 else F.lit(0.0)
    order = F.struct(alone.alias("alone"), F.xxhash64("rep", F.lit(seed)).alias("h"), *COLUMNS, "comp")
    center = rows.groupBy("token").agg(F.min(order).alias("_c"), F.min("comp").alias("_lo"), F.max("comp").alias("_hi")).filter("_lo <> _hi")
    center = center.select("token", *[F.col(f"_c.{c}").alias(f"y_{c}") for c in (*COLUMNS, "comp")])
    # a pair shows only where one of it is the list's center, so two of its shared shingles must do here
    return matched(_side(rows, "x").join(center, "token"), rule, 2)


def rest_pairs(rows: DataFrame, rule: Rule) -> DataFrame:
    """Candidates of all classes in different components: of each list, rows outside its largest component with all rows."""
    sizes = rows.groupBy("token", "comp").agg(F.count("*").alias("_n"))
    largest = sizes.groupBy("token").agg(F.max_by("comp", F.struct("_n", "comp")).alias("_largest"), F.count("*").alias("_k")).filter("_k > 1").drop("_k")
    rows = rows.join(largest, "token").withColumn("band", rule.band(F.col("n")))
    near = F.explode(F.array(*[F.col("band") + k for k in (-1, 0, 1)])).alias("band")
    outside = rows.filter("comp <> _largest")
    outside = outside.select(near, *[c for c in outside.columns if c != "band"])
    pairs = _side(outside, "x", "band").join(_side(rows, "y", "band", "_largest"), ["token", "band"])
    return matched(pairs.filter((F.col("y_comp") == F.col("_largest")) | (F.col("x_rep") < F.col("y_rep"))), rule)


def verified(pairs: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    """The candidates whose whole sets link."""
    needed = written(pairs.select(F.col("a").alias("_rep")).unionByName(pairs.select(F.col("b").alias("_rep"))).distinct(), "join-needed")
    own = texts.join(small(needed, needed.count(), BROADCAST_KEYS), F.col("doc_id") == F.col("_rep"), "left_semi")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [s.tobytes() for s in shingle_sets(b.column("text"), rule.n)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, pa.binary())], ["rep", "shingles"])

    found = written(own.mapInArrow(sets, "rep long, shingles binary"), "join-sets")
    single = found.dropDuplicates(["rep", "shingles"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, held = None, []
        for batch in batches:
            pairs = []
            for a, part, b, s in zip(*(batch.column(c).to_pylist() for c in ("a", "part", "b")), batch.column("shingles"), strict=True):
                if run != (a, part):
                    run, held = (a, part), []
                y = np.frombuffer(s.as_buffer(), np.uint64)
                if b is None:
                    held.append(np.array(y))
                    continue
                for x in held:
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * both >= rule.percent * (len(x) + len(y) - both):
                        pairs.append((a, b))
                        break
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])

    # the middle of a star, if it has one, is the end that is held
    ends = pairs.select(F.col("a").alias("_rep")).unionByName(pairs.select(F.col("b").alias("_rep")))
    often = ends.groupBy("_rep").agg(F.count("*").alias("_n"))
    often = small(written(often.filter(F.col("_n") > 1), "join-often"), needed.count(), BROADCAST_KEYS)
    rows = pairs.join(often.toDF("a", "_na"), "a", "left").join(often.toDF("b", "_nb"), "b", "left")
    held = F.when(F.coalesce("_nb", F.lit(1)) > F.coalesce("_na", F.lit(1)), F.col("b")).otherwise(F.col("a"))
    rows = rows.select(held.alias("a"), F.when(held == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("b"))
    runs = rows.groupBy("a").agg(F.expr(f"count(*) div {RUN_PAIRS} + 1").alias("_parts"))
    runs = written(runs, "join-runs")
    slim = small(runs, needed.count(), BROADCAST_KEYS)
    sent = rows.join(slim, "a").select("a", F.pmod(F.xxhash64("b"), F.col("_parts")).alias("part"), "b")
    sent = sent.join(single.withColumnRenamed("rep", "b"), "b").select("a", "part", "b", "shingles")
    own = single.withColumnRenamed("rep", "a").join(slim, "a").select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)).alias("part"), F.lit(None).cast("long").alias("b"), "shingles")
    laid = own.unionByName(sent).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    good = laid.mapInArrow(check, "a long, b long").distinct()
    links = written(good.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "join-links")
    forget(needed, found, runs)
    return links


def components(links: DataFrame) -> DataFrame:
    """rep, comp of every end of a link: comp is the smallest id that links reach. Labels spread along
    links and skip along themselves until none changes."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = written(both, "components-links")
    labels = written(both.groupBy("a").agg(F.least("a", F.min("b")).alias("comp")).withColumnRenamed("a", "rep"), "components")
    held = labels
    while True:
        near = both.join(labels.withColumnsRenamed({"rep": "b", "comp": "_c"}), "b").groupBy("a").agg(F.min("_c").alias("_c"))
        near = near.select(F.col("a").alias("rep"), "_c")
        closer = labels.join(near, "rep").select("rep", F.col("comp").alias("_old"), F.least("comp", "_c").alias("_to"))
        jump = labels.select(F.col("rep").alias("_to"), F.col("comp").alias("_end"))
        following = written(closer.join(jump, "_to").select("rep", "_old", F.least("_to", "_end").alias("comp")), "components")
        changed = following.filter("_old <> comp").limit(1).count()
        forget(held)
        held, labels = following, following.select("rep", "comp")
        if not changed:
            forget(both)
            return labels


def _labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return rows.withColumn("comp", F.col("rep"))
    return rows.join(labels, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))


def join(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:  # noqa: B008
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text)."""
    arrow_rows(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = written(prefixes(texts, rule), "join-prefixes")
    same: list[Column | str] = ["n_shingles", "sig_a", "sig_b"]
    classes = rows.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy(*same).agg(F.min("doc_id").alias("rep"), *[F.min(m).alias(m) for m in MAP], F.min_by("tokens", "doc_id").alias("tokens"))
    classes = written(classes, "join-classes")
    lists = postings(classes.select("rep", F.col("n_shingles").alias("n"), *MAP, "tokens"), rule)
    links, labels = None, None
    for step in [*range(STAR_ROUNDS), None]:
        labelled = _labelled(lists, labels)
        pairs = written(rest_pairs(labelled, rule) if step is None else star_pairs(labelled, step, rule), "join-pairs")
        if not pairs.limit(1).count():
            continue
        more = verified(pairs, texts, rule)
        forget(pairs)
        if more.limit(1).count():
            links = more if links is None else links.unionByName(more)
            labels = components(links)
    forget(lists)
    named = classes.select(*same, "rep")
    if labels is not None:
        named = named.join(labels, "rep", "left").select(*same, F.coalesce("comp", "rep").alias("comp"))
    else:
        named = named.withColumnRenamed("rep", "comp")
    out = rows.select("doc_id", *same).join(named, same, "left")
    whole = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id"))
    return out.select("doc_id", "n_shingles", whole.alias("component_id"))


def one_of_each(docs: DataFrame, rule: Rule = Rule(5, 80)) -> DataFrame:  # noqa: B008
    """``docs`` with the row of smallest doc_id of each component, and all rows that link with nothing; columns stay.

    Of rows that share doc_id and component, any one stays; the dropped ids alone are joined with the texts.
    """
    found = written(join(docs, rule), "join-components")
    gone = found.filter("n_shingles > 0 AND component_id IS NOT NULL AND doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    gone = written(gone, "join-dropped")
    kept = docs.join(small(gone, gone.count(), BROADCAST_KEYS), F.col("doc_id") == F.col("_gone"), "left_anti")
    twice = found.filter("n_shingles > 0 AND doc_id = component_id").groupBy(F.col("doc_id").alias("_twice")).agg(F.count("*").alias("_n")).filter("_n > 1").select("_twice")
    twice = written(twice, "join-repeated")
    n = twice.count()
    if not n:
        return kept
    again = small(twice, n, BROADCAST_KEYS)
    single = kept.join(again, F.col("doc_id") == F.col("_twice"), "left_anti")
    return single.unionByName(kept.join(again, F.col("doc_id") == F.col("_twice"), "left_semi").dropDuplicates(["doc_id"]))
