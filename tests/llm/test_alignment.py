"""Alignment of two vocabularies: groups, links and counts against the libraries and plain Python."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from lexlake.llm import alignment
from lexlake.llm.encoding import PieceEncoder

SCHEMA = "doc_id long, text string, batch long, payload string"


@pytest.fixture(scope="module")
def sides():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def tokens(sides, text):
    a, b = sides
    marks = {**{chr(i): i for i in (*range(33, 127), *range(161, 173), *range(174, 256))}}
    rest = [i for i in range(256) if i not in marks.values()]
    marks |= {chr(256 + k): i for k, i in enumerate(rest)}
    ids = a.encode(" " + text, add_special_tokens=False).ids
    one = [(i, bytes(marks[c] for c in a.id_to_token(i))) for i in ids]
    two = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
    return one, two


def brute(sides, rows):
    docs, counts = [], Counter()
    for i, text in rows:
        one, two = tokens(sides, text) if text else ([], [])
        whole = (" " + (text or "")).encode()
        if not text or b"".join(x for _, x in one) != whole or b"".join(x for _, x in two) != whole:
            docs.append((i, 0, 0, [], ""))
            continue
        ends = []
        for side in (one, two):
            at, found = 0, {}
            for k, (_, x) in enumerate(side):
                at += len(x)
                found[at] = k
            ends.append(found)
        groups, links, last = [], [], (0, 0)
        for e in sorted(set(ends[0]) & set(ends[1])):
            now = (ends[0][e] + 1, ends[1][e] + 1)
            groups.append(",".join(str(x[0]) for x in one[last[0] : now[0]]) + "|" + ",".join(str(x[0]) for x in two[last[1] : now[1]]))
            links.append((one[now[0] - 1][0], two[now[1] - 1][0]))
            last = now
        counts.update(links)
        docs.append((i, len(one), len(two), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    return [(i, a, b, len(ls), len(ls), sum(counts[x] == best[x[1]] for x in ls), sum(counts[x] for x in ls), d) for i, a, b, ls, d in docs]


def sample(rng):
    bits = ["the", " ", "  ", "   ", "\n", "\n\n", "\t", "word", "Unter", "été", "▁", "<s>", "<|endoftext|>", "</s>", "<0x41>", "\U0001f600", "日本語", "́", "\x00", " ", "　", "12345", "!!", "...", "'s", "a", "Zu", "\r\n", "ſ", "﻿"]
    return "".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.randrange(40)))


def test_against_plain_python(spark, sides, monkeypatch):
    rng = random.Random(3)
    rows = [(i, sample(rng)) for i in range(400)] + [(400, None), (401, ""), (402, " "), (402, " "), (None, "no id"), (403, "ab " * 60_000), (404, "x" * 50_000), (405, "same text here")] + [(500 + i, "same text here") for i in range(50)]
    docs = spark.createDataFrame([(*r, 1, "p") for r in rows], SCHEMA)
    want = sorted(brute(sides, rows), key=str)
    assert sorted(map(tuple, alignment.report(docs.repartition(3)).collect()), key=str) == want
    assert sum(w[1] > 0 for w in want) > 200 and sum(w[5] < w[4] for w in want) > 100 and any(w[1] == 0 for w in want[:-3])
    monkeypatch.setattr(alignment, "TASK_BYTES", 50)
    assert sorted(map(tuple, alignment.report(docs.repartition(7)).collect()), key=str) == want


def test_pieces_are_those_of_the_library(sides):
    rng = random.Random(4)
    texts = [sample(rng) for _ in range(3000)] + ["", "one two", "one\ntwo three"]
    encoder = PieceEncoder("piece_bpe_32k.model", table_bytes=2000)
    for k in range(0, len(texts), 100):
        ids, at = encoder.encode(texts[k : k + 100])
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [sides[1].encode(t) for t in texts[k : k + 100]]


def test_empty(spark):
    for rows in ([], [(1, None, 1, "p")], [(1, "", 1, "p"), (2, "▁", 1, "p")]):
        got = alignment.report(spark.createDataFrame(rows, SCHEMA)).collect()
        assert [tuple(r) for r in sorted(got)] == [(r[0], 0, 0, 0, 0, 0, 0, "") for r in rows]
