"""N-gram Jaccard join: components against brute force over all pairs, prefixes, edge cases."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from lexlake.llm import ngram_join as nj
from lexlake.llm.shingles import shingle_sets

SCHEMA = "doc_id long, text string, comp long, token string, rep long"


def brute_set(text, n):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in re.split("[ \t\n\x0b\x0c\r]+", t) if x]
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def brute(rows, rule):
    sets = [(i, brute_set(t, rule.n)) for i, t, *_ in rows]
    top = {i: i for i, _ in sets if i is not None}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i is None or j is None or not a or not b:
                continue
            both = len(a & b)
            if 100 * both >= rule.percent * (len(a) + len(b) - both):
                x, y = sorted((find(i), find(j)))
                top[y] = x
    return sorted((str(i), len(s), str(i if i is None else find(i))) for i, s in sets)


def corpus(rng, n):
    vocabulary = [f"w{k}" for k in range(4000)] + ["É", "é", "Straße", "\x1c", "\x85x"]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 9, 12, 40, 150, 400]))] for _ in range(n // 6)]
    out = []
    for _ in range(n):
        w = list(rng.choice(bases if rng.random() < 0.6 else bases[:3]))
        for _ in range(rng.choice([0, 0, 1, 2, 4, 8]) if len(w) > 20 else rng.choice([0, 0, 0, 1])):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        if rng.random() < 0.15:
            w = w + passage
        out.append((" " if rng.random() < 0.9 else "\n\t").join(x.upper() if rng.random() < 0.1 else x for x in w))
    return out


@pytest.mark.parametrize("rule", [nj.Rule(), nj.Rule(5, 80), nj.Rule(1, 50)])
def test_components_against_all_pairs(spark, rule):
    rng = random.Random(rule.n)
    ids = rng.sample(range(-500, 5000), 400)
    rows = [(i, t, 1, "x", 2) for i, t in zip(ids, corpus(rng, 400), strict=True)]
    rows += [(6000, None, 1, "", 0), (6001, "", 1, "", 0), (6002, " \n ", None, None, None), (None, rows[0][1], 0, "", 0), (6003, "a b", 0, "", 0), (6004, "A  B", 0, "", 0), (6003, "a b", 0, "", 0)]
    got = nj.join(spark.createDataFrame(rows, SCHEMA).repartition(5), rule).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == brute(rows, rule)


def test_large_group_of_near_copies(spark):
    rng = random.Random(4)
    base = [f"b{k}" for k in range(300)]
    rows = []
    for i in range(500):
        w = list(base)
        for _ in range(rng.choice([1, 3, 6, 20])):
            w[rng.randrange(300)] = f"x{rng.random()}"
        rows.append((i, " ".join(w), 0, "", 0))
    got = nj.join(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == brute(rows, nj.Rule())


def test_one_of_each_and_empty(spark):
    text = " ".join(f"t{k}" for k in range(200))
    rows = [(9, text, 1, "a", 1), (4, text + " more", 2, "b", 2), (4, text + " more", 2, "b", 2), (7, "other text here at last", 3, "c", 3), (8, None, None, None, None), (8, None, None, None, None), (None, text, 1, "d", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = nj.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["4", "7", "8", "8", "None"]
    assert nj.join(docs.limit(0)).collect() == [] and nj.one_of_each(docs.limit(0)).collect() == []


def test_shingle_sets_by_segments(monkeypatch):
    from lexlake.llm import shingles

    rng = random.Random(1)
    texts = [*corpus(rng, 50), None, "", "  ", "y" * 70_000 + " z " + "y" * 70_001, "a\x0bb\x0cc\rd"]
    whole = [s.tolist() for s in shingle_sets(pa.array(texts), 3)]
    assert [len(s) for s in whole] == [len(brute_set(t, 3)) for t in texts]
    monkeypatch.setattr(shingles, "SEGMENT", 97)
    assert [s.tolist() for s in shingle_sets(pa.array(texts), 3)] == whole
    assert [s.tolist() for s in shingle_sets(pa.array(["skip", *texts]).slice(1), 3)] == whole
    a, b, c = shingle_sets(pa.array(["a b c d", "A B\tC  d", "a b c"]), 3)
    assert a.tolist() == b.tolist() and len(np.intersect1d(a, c)) == 1
