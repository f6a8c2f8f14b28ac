"""Merkle manifest: digests, proofs and folds against plain Python, at several depths and with odd rows."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from lexlake.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, place long, leaf string"


def h(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf_of(r, text):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*r[:4], text)))


def lowered(text):
    return text if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def climb(nodes, at):
    """Root of a level of nodes, and the siblings' digests to the left and right of the node ``at`` on its way up."""
    steps = []
    while len(nodes) > 1:
        run = at - at % 16
        steps.append(("".join(nodes[run:at]), "".join(nodes[at + 1 : run + 16])))
        nodes, at = [h("".join(nodes[k : k + 16])) for k in range(0, len(nodes), 16)], at // 16
    return nodes[0], steps


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: sorted(((r[0] is not None, r[0] or 0, leaf_of(r, r[4]), r) for r in groups[s]), key=lambda x: x[:3]) for s in order}
    roots = [climb([x[2] for x in trees[s]], 0)[0] for s in order]
    out = []
    for k, s in enumerate(order):
        leaves = [x[2] for x in trees[s]]
        root, top = climb(roots, k)
        for i, (_, _, leaf, r) in enumerate(trees[s]):
            steps = climb(leaves, i)[1] + top
            at = leaf_of(r, lowered(r[4])) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else leaf
            for a, b in steps:
                at = h(a + at + b)
            out.append((r[0], leaf, roots[k], root, h("".join(a + b for a, b in steps)), at, at == root))
    return out


def documents(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.mark.parametrize("sizes", [[1], [16, 17, 1], [300, 4100, 40], [1] * 40 + [256, 257]])
def test_against_plain_python(spark, sizes):
    rng = random.Random(len(sizes))
    names = [None, "", "é", "z", "\U0001f600", "a,b"] + [f"s{i}" for i in range(40)]
    rows = [(rng.randrange(10**9), names[k], rng.choice(["en", None, ""]), rng.choice([None, 3]), rng.choice([None, "", "Some Text É", "lower only"]), 1, "x") for k, n in enumerate(sizes) for _ in range(n)]
    got = sorted(map(tuple, merkle.report(documents(spark, rows)).collect()), key=str)
    assert got == sorted(brute(rows), key=str)
    assert {x[-1] for x in got} <= {True, False}


def test_odd_rows(spark):
    rows = [(7, "a", "en", 1, "T", 1, "x")] * 20 + [(None, "a", None, None, None, 1, "x")] * 3 + [(5, None, "en", 1, "Ab" * 200_000, 1, "x"), (5, None, "en", 1, "other", 1, "x"), (2**62, "a", "", 0, "", 1, "x")]
    got = sorted(map(tuple, merkle.report(documents(spark, rows)).collect()), key=str)
    assert got == sorted(brute(rows), key=str)
    assert merkle.report(documents(spark, rows).limit(0)).collect() == []


def test_steps_lead_to_the_root_and_parts_are_told_apart(spark):
    rows = [(i, f"s{i % 3}", "en", i, f"Text {i}", 1, "x") for i in range(700)]
    store = merkle.build(merkle.document_leaves(documents(spark, rows)))
    found = merkle.proofs(store).withColumn("to", merkle.verified(F.col("leaf"), F.col("steps")))
    assert found.count() == 700 and {r["to"] for r in found.select("to").distinct().collect()} == {store.root}
    swapped = found.withColumn("leaf", F.translate("leaf", "a", "b")).filter(merkle.verified(F.col("leaf"), F.col("steps")) == store.root)
    assert swapped.count() == found.filter("leaf not like '%a%'").count()
    one, other = (spark.range(1).select(merkle.leaf(F.lit(a), F.lit(b)).alias("h")).first()["h"] for a, b in (("ab", "c"), ("a", "bc")))
    assert one != other
    store.forget()
