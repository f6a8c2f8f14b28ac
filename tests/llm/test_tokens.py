"""Encoding against the tokenizers library, token-id files round trip, length histogram, packing."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lexlake.llm import packing, token_counts, token_files
from lexlake.llm.encoding import BYTE_VOCAB, WORD_VOCAB, Encoder

SCHEMA = "doc_id long, text string, ids string, file long"


def direct(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def texts(rng, n):
    bits = ["a", "The ", "don't", " 's", "  ", "\n\n ", "\t", "é", "É", "Σς", "\U0001f600", "１２", "12 3", "...", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "é", "\x1c", "\x85", "　", "﻿", "k m", "日本", "W" * 50, "ﬁ", "İ", "\x0b", "\r\n"]
    return ["".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.randrange(40))) for _ in range(n)]


@pytest.mark.parametrize("name", [BYTE_VOCAB, WORD_VOCAB])
def test_encoder_equals_the_library(name):
    rng = random.Random(3)
    enc, ref = Encoder(name, table_bytes=2000), direct(name)
    for _ in range(6):
        batch = [*texts(rng, 300), None, ""]
        ids, starts = enc.encode(batch, end_id=1)
        for t, part in zip(batch, np.split(ids, starts[1:-1]), strict=True):
            assert part.tolist() == [*ref(t), 1], repr(t)
        assert enc.lengths(batch).tolist() == [len(ref(t)) for t in batch]


def test_words_are_encoded_once(monkeypatch):
    enc, ref, seen = Encoder(BYTE_VOCAB), direct(BYTE_VOCAB), []
    words = enc._words
    monkeypatch.setattr(enc, "_words", lambda parts: seen.extend(parts.to_pylist()) or words(parts))
    for text in ("Gato, gato. gato", "un gato; gato### (gato) gato's\ngato!? gato<|>", "gato, gato###"):
        ids, _ = enc.encode([text])
        assert ids.tolist() == ref(text)
    # at a text's and a line's beginning a word has no space before it
    assert sorted(seen) == ["\x01gato", "\x02Gato", "\x02gato", "\x02un", "gato"]
    assert Encoder(BYTE_VOCAB).tokenizer is enc.tokenizer


@pytest.mark.parametrize("name", [BYTE_VOCAB, WORD_VOCAB])
def test_words_met_often_stay_in_a_full_table(monkeypatch, name):
    enc, ref, seen = Encoder(name, table_bytes=8000), direct(name), []
    words, rng = enc._words, random.Random(12)
    monkeypatch.setattr(enc, "_words", lambda parts: seen.extend(parts.to_pylist()) or words(parts))
    for k in range(30):
        text = "x " + " ".join(f"{w}{rng.choice(enc.marks)}" for w in ("gato", "perro", "ärger")) + " " + " ".join("".join(rng.choices("abcdeö", k=9)) for _ in range(40))
        assert enc.encode([text])[0].tolist() == ref(text)
    # each is encoded once, though new words have filled the table again and again; marks after words take no room in it
    assert [seen.count(w) for w in ("gato", "perro", "ärger")] == [1, 1, 1] and len(seen) > 1200
    assert not [p for p in enc.known if p[-1:] in enc.marks] and enc.held < 8000 + 41 * (enc.ENTRY + 20)


def test_counted_in_either_width():
    rng = np.random.default_rng(4)
    owners = np.sort(rng.integers(0, 40, 900))
    for most in (30, 1 << 27):
        terms = rng.integers(most - 30, most, 900).astype(np.uint32)
        keys, n = packing._counted(terms, owners, 40)
        want = Counter(zip(terms.tolist(), owners.tolist(), strict=True))
        assert list(zip((keys // 40).tolist(), (keys % 40).tolist(), strict=True)) == sorted(want)
        assert dict(zip(sorted(want), n.tolist(), strict=True)) == want
    assert [len(x) for x in packing._counted(np.zeros(0, np.uint32), np.zeros(0, np.int64), 3)] == [0, 0]


@pytest.mark.parametrize("bits", [False, True])
def test_chunks_round_trip(bits):
    rng = np.random.default_rng(1)
    for ids in (rng.integers(0, 50_000, 1003), np.zeros(5), np.array([2**32 - 1, 0, 7]), np.zeros(0)):
        ids = ids.astype(np.uint32)
        assert token_files.unpack_chunk(b"xx" + token_files.pack_chunk(ids, bits), 2).tolist() == ids.tolist()


@pytest.mark.parametrize("bits", [False, True])
def test_files_round_trip(spark, bits):
    rng, ref = random.Random(6), direct(WORD_VOCAB)
    rows = [(i * 7 % 1009, t, "x", 1) for i, t in enumerate(texts(rng, 400))] + [(None, "n", "", 0), (2000, None, None, None), (2001, "z " * 9000, None, None), (2001, "z " * 9000, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = token_files.round_trip(docs, bits=bits, chunk_ids=512, file_chars=3000).orderBy("start").collect()
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    at = 0
    for r, (doc_id, text, *_) in zip(got, want, strict=True):
        ids = np.array([*ref(text), 1], "<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert token_files.round_trip(docs.limit(0)).collect() == []


def test_histogram(spark):
    rng, ref = random.Random(7), direct(BYTE_VOCAB)
    rows = [(i, t, "", 0) for i, t in enumerate([*texts(rng, 300), None, "", "q " * 4000])]
    sizes = [len(ref(t)) for _, t, *_ in rows]
    sums = token_counts.suffix_sums(token_counts.histogram(token_counts.lengths(spark.createDataFrame(rows, SCHEMA)))).cache()
    got = {r["n_tokens"]: r for r in sums.collect()}
    assert {n: r["docs"] for n, r in got.items()} == dict(Counter(sizes))
    for n, r in got.items():
        assert (r["docs_from"], r["tokens_from"]) == (sum(s >= n for s in sizes), sum(s for s in sizes if s >= n))
        assert (r["docs_all"], r["tokens_all"], r["cut_tokens"]) == (len(sizes), sum(sizes), sum(min(s, n) for s in sizes))
        assert r["share_below"] == pytest.approx(sum(s < n for s in sizes) / len(sizes))
    for r in token_counts.at_limits(sums, [0, 5, 37, 10**6]).collect():
        assert (r["docs_over"], r["cut_tokens"]) == (sum(s > r["context"] for s in sizes), sum(min(s, r["context"]) for s in sizes))
    ordered = sorted(sizes)
    for r in token_counts.quantiles(sums, [0.1, 0.5, 1.0]).collect():
        assert r["n_tokens"] == ordered[max(0, int(np.ceil(r["share"] * len(ordered))) - 1)]
    empty = token_counts.lengths(spark.createDataFrame([], SCHEMA))
    assert token_counts.suffix_sums(token_counts.histogram(empty)).collect() == []


def test_packing_is_whole_and_dense(spark):
    rng, ref = random.Random(8), direct(BYTE_VOCAB)
    rows = [(i, t, "", 0) for i, t in enumerate([*texts(rng, 300), None, "", "q r " * 4000, "w" * 9000])] + [(None, "n", "", 0), (7, "dup", "", 0)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = packing.report(docs, window=256, shard_rows=40).collect()
    want = defaultdict(list)
    for i, t, *_ in rows:
        want[i].append(np.array([*ref(t), 1], "<u4"))
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(want)
    for i, ps in pieces.items():
        if len(want[i]) > 1:
            continue
        at = 0
        for p in sorted(ps, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(want[i][0])
            assert p["ids_crc32"] == zlib.crc32(want[i][0][at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(want[i][0])
    assert sum(r["length"] for r in got) == sum(len(x) for xs in want.values() for x in xs)
    for ws in windows.values():
        at = 0
        for offset, n in sorted(ws):
            assert offset == at and n > 0
            at += n
        assert at <= 256 and at & (at - 1) == 0
    assert packing.pack(docs.limit(0)).collect() == []


def test_neighbours_are_the_bm25_best():
    rng = np.random.default_rng(0)
    docs = [rng.integers(100 * (k % 4), 100 * (k % 4) + 60, 30).astype(np.uint32) for k in range(40)]
    index = packing.Bm25(docs)
    for d in range(40):
        best = np.argsort(-index.scores(d))[:10]
        assert all(b % 4 == d % 4 for b in best.tolist())
    sizes, avg = [len(x) for x in docs], 30
    brute = []
    for e in docs:
        s = 0.0
        for t in set(docs[3].tolist()):
            df = sum(t in x for x in docs)
            tf = int((e == t).sum())
            s += max(0, np.log((40 - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(e) / avg))
        brute.append(s)
    assert np.allclose(index.scores(3), brute) and sizes[0] == 30
    packed = packing.pack_shard(docs, window=90)
    by = defaultdict(set)
    for doc, _, _, seq, _ in packed.rows:
        by[seq].add(doc % 4)
    assert sum(len(x) == 1 for x in by.values()) >= len(by) - 5


def test_neighbours_meet_across_the_input(spark):
    rng = random.Random(9)
    topics = [["".join(rng.choice("abcdefghijkl") for _ in range(7)) for _ in range(20)] for _ in range(40)]
    rows = [(i, " ".join(rng.choice(topics[i % 40]) for _ in range(30)), "", 0) for i in range(320)]
    got = packing.report(spark.createDataFrame(rows, SCHEMA).coalesce(4), window=256, shard_rows=16).collect()
    windows = defaultdict(set)
    for r in got:
        windows[r["sequence_id"]].add(r["doc_id"])
    shared = [{d % 40 for d in w} for w in windows.values() if len(w) > 1]
    assert sum(len(x) < len(w) for x, w in zip(shared, (w for w in windows.values() if len(w) > 1), strict=True)) > len(shared) * 0.6


def test_scores_use_the_corpus_and_whole_texts(spark):
    words = [(i, "common rare" if i == 0 else "common other" if i < 5 else "plain", "", 0) for i in range(40)]
    table = packing.encoded(spark.createDataFrame(words, SCHEMA).repartition(3), WORD_VOCAB).cache()
    ref, corpus = direct(WORD_VOCAB), packing.counted(table)
    own = [[*ref(t), 1] for _, t, *_ in words]
    assert (corpus.docs, corpus.tokens) == (40, sum(map(len, own)))
    assert {i: n for i, n in enumerate(corpus.df.tolist()) if n} == Counter(i for x in own for i in set(x))
    rng = np.random.default_rng(1)
    docs = [np.concatenate([rng.integers(100 * (k % 4), 100 * (k % 4) + 60, 64), [500 + k] * 2]).astype(np.uint32) for k in range(64)]
    seqs = defaultdict(set)
    for doc, start, *_, seq, _ in packing.pack_shard(docs, 32).rows:
        if start >= 64:
            seqs[seq].add(doc % 4)
    assert all(len(x) == 1 for x in seqs.values())
