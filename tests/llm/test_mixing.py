"""Mixing: targets, and the schedule with what it takes, against brute force; caps, ties, edge cases."""

import math
import random
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from lexlake.llm import mixing

SCHEMA = "doc_id long, text string, source string, lang string, size string, target long"


def brute_targets(sizes, weights=(1, 2, 3), repeat=3):
    names = sorted((k for k in sizes if k is not None)) + [None] * (None in sizes)
    w = {k: weights[i % len(weights)] for i, k in enumerate(names)}
    total, at = sum(sizes.values()), {}
    while True:
        rest = total - sum(at.values())
        free = [k for k in names if k not in at]
        share = sum(w[k] for k in free)
        over = [k for k in free if rest * w[k] / share > repeat * sizes[k]]
        if not over:
            return at | {k: rest * w[k] / share for k in free}
        at |= {k: float(repeat * sizes[k]) for k in over}


def spark_hash(doc_id, text, seed=17):
    """Spark's xxhash64 of doc_id, the text's hash and the seed: each with the hash before it as seed; nulls are skipped."""
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    own = 42 if text is None else xxhash.xxh64_intdigest(text.encode(), seed=42)
    h = 42 if doc_id is None else xxhash.xxh64_intdigest(struct.pack("<q", doc_id), seed=42)
    h = xxhash.xxh64_intdigest(struct.pack("<q", signed(own)), seed=h)
    return signed(xxhash.xxh64_intdigest(struct.pack("<i", seed), seed=h)), signed(own)


def golden_points(n):
    phi = 0.6180339887498949
    return [((i % 2**20 + 0.5) * phi % 1.0 + (i // 2**20) * (2**20 * phi % 1.0) % 1.0) % 1.0 for i in range(n)]


def brute_mix(rows, block=None, points=golden_points, repeat=3):
    """The occurrences that the schedule takes, in its order: (slot, row number, words)."""
    words = [len([x for x in (r[1] or "").replace("\t", " ").replace("\n", " ").split(" ") if x]) for r in rows]
    sizes = {}
    for r, n in zip(rows, words, strict=True):
        sizes[r[2]] = sizes.get(r[2], 0) + n
    total = sum(sizes.values())
    block = block or max(1, min(1024, total // 2**18))
    target = brute_targets(sizes)
    names = [k for k in [*sorted(k for k in sizes if k is not None), *([None] * (None in sizes))] if target[k] > 0]
    ends, at = [], 0.0
    for k in names:
        at += target[k]
        ends.append(at)
    slots = {k: [] for k in names}
    for i, u in enumerate(points(math.ceil(total / block))):
        k = next((j for j, e in enumerate(ends) if u < e / ends[-1]), len(names) - 1)
        slots[names[k]].append(i)
    out, buckets = [], max(1, len(rows) // 128)
    for k in names:
        h = {i: spark_hash(r[0], r[1]) for i, r in enumerate(rows) if r[2] == k}
        own = sorted(h, key=lambda i: (h[i][0] % buckets, h[i][0], rows[i][0] is not None, rows[i][0] or 0, words[i], h[i][1]))
        at, stop = 0, min(len(slots[k]) * block, repeat * sizes[k])
        while at < stop:
            for i in own:
                n = min(words[i], stop - at)
                if n > 0:
                    out.append((slots[k][at // block], at, i, n))
                at += max(0, n)
    return [(slot, i, n) for slot, _, i, n in sorted(out)], sizes, target, words


@pytest.mark.parametrize("seed", [1, 2])
def test_targets_and_totals(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(400):
        source = rng.choice(["hot"] * 10 + ["b", "é", "z\U0001f600", None, "one"][: 5 if i else 4])
        rows.append((i, " ".join(["w"] * rng.choice([0, 1, 5, 40, 900])), source, "x", "clash", 7))
    rows += [(401, None, "b", None, None, None), (402, "\x1c \x85 a\tb", "nine", None, None, None), (5, rows[5][1], rows[5][2], None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    sizes = {}
    for _, t, s, *_ in rows:
        n = len([x for x in (t or "").replace("\t", " ").replace("\n", " ").split(" ") if x])
        sizes[s] = sizes.get(s, 0) + n
    for points, brute_points in ((mixing.golden, golden_points), (mixing.van_der_corput, lambda n: [int(f"{i:048b}"[::-1], 2) / 2**48 for i in range(n)])):
        order, _, want, words = brute_mix(rows, 64, brute_points)
        mixed = mixing.mix(docs, block_words=64, points=points)
        per = {r["source_rank"]: r["w"] for r in mixed.segments.groupBy("source_rank").agg(F.sum("words").alias("w")).collect()}
        for r in mixed.sources.collect():
            assert r["source_size"] == sizes[r["source"]]
            assert r["target"] == pytest.approx(want[r["source"]])
            assert abs(per.get(r["source_rank"], 0) - r["target"]) <= 3 * 64
        taken = {}
        for _, i, n in order:
            taken[i] = taken.get(i, 0) + n
        key = lambda x: (x[0] is None, x[0] or 0, x[1], x[2])
        out = mixing.documents_taken(docs.repartition(3), block_words=64, points=points).collect()
        assert sorted(((r["doc_id"], r["size"], r["taken"]) for r in out), key=key) == sorted(((r[0], words[i], taken.get(i, 0)) for i, r in enumerate(rows)), key=key)
        assert all(0 <= r["taken"] <= 3 * r["size"] for r in out)
        blocks = mixed.segments.groupBy("source_rank", "block").agg(F.sum("words").alias("w"), F.countDistinct("slot").alias("n")).collect()
        assert all(b["n"] == 1 and b["w"] <= 64 for b in blocks)


def test_the_points_decide_what_is_taken(spark):
    docs = spark.createDataFrame([(i, "a b c " * (i % 9 + 1), "pqr"[i % 3]) for i in range(200)], "doc_id long, text string, source string")
    mixed = [mixing.mix(docs, block_words=16, points=p) for p in (mixing.golden, mixing.van_der_corput, lambda slot: F.lit(0.99) + 0 * slot)]
    words = [{r["source_rank"]: r["w"] for r in m.segments.groupBy("source_rank").agg(F.sum("words").alias("w")).collect()} for m in mixed]
    orders = [[r["source_rank"] for r in m.segments.select("slot", "source_rank").distinct().orderBy("slot").collect()] for m in mixed]
    assert set(words[2]) == {2} and set(words[0]) == {0, 1, 2}
    assert orders[0] != orders[1]


def test_documents_come_in_slot_order(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("abcd") for _ in range(rng.choice([0, 3, 30, 200]))), rng.choice("xxxyz")) for i in range(150)]
    # rows that are equal, that share doc_id and size, or have no doc_id
    rows += [(7, "a b c", "x"), (7, "a b d", "x"), *[(8, "same words here", "y")] * 5, (None, "q r", "z"), (None, "q r", "z"), (None, "r q", "z"), (900, None, None)]
    docs = spark.createDataFrame([(*r, "slot", 1, 2) for r in rows], "doc_id long, text string, source string, mix_take string, slot long, nth long")
    got = mixing.mixed_documents(docs.repartition(5), block_words=8)
    assert got.columns == docs.columns
    got = [(r["doc_id"], r["text"], r["source"]) for r in got.collect()]
    order, _, _, words = brute_mix(rows, 8)
    whole = lambda i, n: rows[i] if n == words[i] else (rows[i][0], " ".join(rows[i][1].split()[:n]), rows[i][2])
    blank = [r for i, r in enumerate(rows) if not words[i]]
    assert sorted(got[: len(blank)], key=str) == sorted(blank, key=str)
    assert got[len(blank) :] == [whole(i, n) for _, i, n in order]


def test_every_prefix_of_the_schedule_is_near_the_shares(spark):
    docs = spark.createDataFrame([(i, "a b c d " * 30, "pqr"[i % 3]) for i in range(300)], "doc_id long, text string, source string")
    rows = mixing.mix(docs, block_words=16).segments.select("slot", "source_rank").distinct().orderBy("slot").collect()
    n = [0, 0, 0]
    for i, r in enumerate(rows[: len(rows) * 9 // 10], 1):
        n[r["source_rank"]] += 1
        assert all(abs(n[k] - i * (k + 1) / 6) <= 4 for k in range(3))


def test_empty_and_wordless(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.documents_taken(empty).collect() == []
    blank = spark.createDataFrame([(1, None, None), (2, "", "a"), (None, " ", "a")], "doc_id long, text string, source string")
    assert [(r["size"], r["taken"], r["target"]) for r in mixing.documents_taken(blank).collect()] == [(0, 0, 0.0)] * 3
