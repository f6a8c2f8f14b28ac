"""Toxicity: held-out accuracy, labels that must not be learned, the risk's gradient, edge cases."""

import random
import zlib

import numpy as np
import pytest

from lexlake.llm import toxicity as tox

SCHEMA = "doc_id long, text string, score double, features string"
BAD = ["vileword", "nastyone", "grimslur", "foulness", "rotbrain"]


def corpus(rng, n, share=0.15):
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7))) for _ in range(rng.randrange(20, 200))]
        bad = rng.random() < share
        for _ in range(rng.randrange(2, 6) if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(BAD).upper() + rng.choice(["", ",", "!"]))
        rows.append((i, " ".join(words), 0.5, "clash"))
        if rng.random() < 0.6:
            labels.append((i, int(bad), bad))
    return rows, labels


@pytest.fixture(scope="module")
def data():
    return corpus(random.Random(12), 3000)


def test_held_out_rows_are_told_apart(spark, data):
    rows, labels = data
    docs = spark.createDataFrame([*rows, (None, None, None, None), (9000, "", 0.0, ""), (9000, "", 0.0, "")], SCHEMA)
    marks = spark.createDataFrame([(i, y) for i, y, _ in labels] + [(None, 1), (5, None)], "doc_id long, toxic int")
    got = tox.report(docs, marks).collect()
    assert len(got) == len(rows) + 3
    by = {r["doc_id"]: r for r in got}
    for i, r in by.items():
        assert r["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= tox.THRESHOLD)
    test = [(by[i]["predicted"], y) for i, y, _ in labels if by[i]["held_out"]]
    assert sum(p == y for p, y in test) / len(test) > 0.97
    assert sum(p for p, y in test if y) / sum(y for _, y in test) > 0.9


def test_held_out_labels_change_nothing(spark, data):
    rows, labels = data
    docs = spark.createDataFrame(rows[:800], SCHEMA)
    secret = [(i, 1 - y) if zlib.crc32(str(i).encode()) % 3 == 1 else (i, y) for i, y, _ in labels]
    a = tox.train(docs, spark.createDataFrame([(i, y) for i, y, _ in labels if i < 800], "doc_id long, toxic int"))
    b = tox.train(docs.repartition(3), spark.createDataFrame([x for x in secret if x[0] < 800], "doc_id long, toxic int"))
    assert a == b and a.weights


def test_without_toxic_and_edges(spark, data):
    rows, _ = data
    model = tox.Model({"vileword": 9.0}, -3.0)
    docs = spark.createDataFrame([(1, "a vileword", 1.0, "x"), (2, None, None, None), (3, "ok", 0.0, "y")], SCHEMA)
    assert [r["doc_id"] for r in tox.without_toxic(docs, model).orderBy("doc_id").collect()] == [2, 3]
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in tox.report(docs, none).collect()} == {0.0}
    assert tox.report(docs.limit(0), spark.createDataFrame([(1, 1)], "doc_id long, toxic int")).collect() == []


def test_risk_falls_and_stays_non_negative():
    rng = np.random.default_rng(0)
    pos = [[0, int(rng.integers(2, 20))] for _ in range(200)]
    unl = [[0, int(rng.integers(2, 20))] if rng.random() < 0.2 else [1, int(rng.integers(2, 20))] for _ in range(1000)]
    w, b = tox.fit_nnpu(pos, unl, 20, 0.2)
    assert w[0] + b > 1 and w[1] + b < -1


def test_words_that_the_sample_lacks_are_learned(spark):
    rng = random.Random(5)
    rows, labels = corpus(rng, 1500)
    toxic = [i for i, y, _ in labels if y and not zlib.crc32(str(i).encode()) % 3 == 1]
    rare = [i for k, i in enumerate(toxic) if k % 10 == 0]
    texts = {i: t for i, t, *_ in rows}
    for i in rare:
        texts[i] = " ".join(w for w in texts[i].split() if w.strip(",!").lower() not in BAD) + " dreckwort"
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    model = tox.train(docs, spark.createDataFrame([x[:2] for x in labels], "doc_id long, toxic int"), max_positives=20)
    assert 5 <= len(rare) and len(toxic) > 90 and model.weights["dreckwort"] > 1
    assert model.score("some dreckwort here") > 0.5 > model.score("some word here")


def test_fit_equals_a_dense_version():
    """The same risk on dense matrices, its gradient by differences, stepped as Adam does."""
    rng = np.random.default_rng(3)
    pos = [sorted(set(rng.integers(0, 6, 3).tolist())) for _ in range(30)]
    unl = [sorted(set(rng.integers(0, 9, 3).tolist())) for _ in range(80)]
    n, prior = 9, 0.3
    x = np.zeros((2, 80, n + 1))
    for k, rows in enumerate((pos, unl)):
        for i, r in enumerate(rows):
            x[k, i, [*r, n]] = 1
    xp, xu = x[0, :30], x[1]

    def negative(w):
        return np.logaddexp(0, xu @ w).mean() - prior * np.logaddexp(0, xp @ w).mean()

    def risk(w):
        below = negative(w)
        value = prior * np.logaddexp(0, -(xp @ w)).mean() + below if below >= 0 else -below
        return value + 0.5e-4 * (w[:n] ** 2).sum()

    w = np.zeros(n + 1)
    w[n] = np.log(prior / (1 - prior))
    m, v, climbs = np.zeros(n + 1), np.zeros(n + 1), 0
    for t in range(1, 121):
        climbs += negative(w) < 0
        g = np.array([(risk(w + d) - risk(w - d)) / 2e-6 for d in np.eye(n + 1) * 1e-6])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.2 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    got, bias = tox.fit_nnpu(pos, unl, n, prior, steps=120, rate=0.2)
    assert np.allclose(got, w[:n], atol=0.02) and abs(bias - w[n]) < 0.02 and climbs > 0


def test_counts_and_choice_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(tox, "HELD_FEATURES", 50)
    rows, labels = corpus(random.Random(3), 400)
    toxic = {i for i, y, _ in labels if y}
    docs = spark.createDataFrame([(i, t, i in toxic or None) for i, t, *_ in rows] + [(None, None, None)], "doc_id long, text string, positive boolean")
    got = {r["feature"]: (r["n"], r["n_pos"]) for r in tox.counts(docs.repartition(3)).collect()}
    want = {"": [1, 0]}
    for i, t, *_ in rows:
        for f in tox.features(t) | {""}:
            n = want.setdefault(f, [0, 0])
            n[0] += 1
            n[1] += i in toxic
    assert got == {f: tuple(n) for f, n in want.items()}
