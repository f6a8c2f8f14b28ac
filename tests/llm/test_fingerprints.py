"""Fingerprints: pairing with the next row, edits, estimates near the truth, merging."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from lexlake.llm import fingerprints as fp

SCHEMA = "doc_id long, text string, sketch string, next_text long"


def shingles(t, n=5):
    w = [x for x in re.split(r"[ \t\n\x0b\x0c\r]+", t or "") if x]
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def jaccard(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def texts(rng, n):
    base = [" ".join(rng.choice(["aé", "b", "ñc", "d\U0001f600", "e", "f"]) + str(rng.randrange(30)) for _ in range(rng.choice([0, 1, 3, 6, 80, 700]))) for _ in range(n)]
    return [rng.choice(base[:i] or [""]) if rng.random() < 0.2 else b for i, b in enumerate(base)]


def test_report_against_brute_force(spark):
    rng = random.Random(5)
    ids = rng.sample(range(-(10**12), 10**13), 600)
    rows = [(i, t, "clash", 1) for i, t in zip(ids, texts(rng, 600), strict=True)]
    rows[3] = (rows[3][0], None, None, None)
    got = {r["doc_id"]: r for r in fp.edit_report(spark.createDataFrame(rows, SCHEMA)).collect()}
    order = sorted(rows)
    assert len(got) == len(rows)
    prints, errors = {}, []
    for k, (i, t, *_) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        r = got[i]
        assert r["n_chars"] == len(t)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert prints.setdefault(t, r["fingerprint"]) == r["fingerprint"]
        for est, other in ((r["near_edited"], edited), (r["near_next"], nxt)):
            errors.append(abs(est - jaccard(shingles(t), shingles(other))))
        if len(shingles(t)) < 64 and len(shingles(edited)) < 64:
            assert errors[-2] < 1e-12
        assert abs(r["shingles"] - len(shingles(t))) <= 0.4 * len(shingles(t))
    assert max(errors) < 0.2 and sum(errors) / len(errors) < 0.01


def test_edge_tables(spark):
    one = spark.createDataFrame([(7, "a b c d e f")], "doc_id long, text string")
    (r,) = fp.edit_report(one).collect()
    assert r["near_next"] == 1.0 and r["n_chars"] == 11
    assert fp.edit_report(one.limit(0)).collect() == []
    odd = spark.createDataFrame([(None, "x"), (1, None), (1, None), (2, ""), (2**62, "y z")], "doc_id long, text string")
    assert len(fp.edit_report(odd).collect()) == 5


def test_order_holds_whatever_the_ids(spark):
    """An outlier, one doc_id on a third of the rows, rows without doc_id: every row is beside the next."""
    rng = random.Random(6)
    rows = [(rng.randrange(50), f"t{k}") for k in range(300)] + [(7, f"hot{k}") for k in range(300)] + [(None, f"none{k % 90}") for k in range(200)]
    rows += [(2**63 - 1, "last"), (-(2**62), "first"), (10**15, "far")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.xxhash64("text"))
    got = fp.with_next(docs.repartition(5), rows_per_bucket=8).select("doc_id", "text", "next_text").collect()
    order = [tuple(r) for r in docs.orderBy(F.col("doc_id").asc_nulls_last(), "h").select("doc_id", "text").collect()]
    want = [(*r, order[(k + 1) % len(order)][1]) for k, r in enumerate(order)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    bounds, often = fp._ranges(docs, 100)
    assert bounds == sorted(set(bounds)) and 7 in [bounds[k - 1] for k in often]


def test_merged_equals_whole(spark):
    rng = random.Random(8)
    parts = [(rng.choice("hhhhk"), " ".join(str(rng.randrange(10**6)) for _ in range(rng.choice([0, 5, 300])))) for _ in range(60)]
    df = spark.createDataFrame(parts, "g string, text string").withColumn("sketch", fp.sketch(F.col("text")))
    got = {r["g"]: r["sketch"] for r in fp.merged(df, ["g"]).collect()}
    for g in "hk":
        whole = df.filter(F.col("g") == g).select(F.explode("sketch").alias("h")).distinct().orderBy("h").limit(fp.K)
        assert got[g] == [r["h"] for r in whole.collect()]


def test_containment(spark):
    rng = random.Random(2)
    w = [str(rng.randrange(10**6)) for _ in range(3000)]
    df = spark.createDataFrame([(" ".join(w[:1000]), " ".join(w))], "a string, b string")
    a, b = fp.sketch(F.col("a")), fp.sketch(F.col("b"))
    (r,) = df.select(fp.containment(a, b).alias("in_b"), fp.containment(b, a).alias("in_a")).collect()
    assert r["in_b"] > 0.75 and abs(r["in_a"] - 1 / 3) < 0.12
