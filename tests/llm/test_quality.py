"""Quality rules: counts and verdicts against plain Python, sketches that merge, odd rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lexlake.llm import quality as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, lang string, source string, text string"


def counts(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    times = {}
    for x in windows:
        times[x] = times.get(x, 0) + 1
    lines = [x for x in text.split("\n") if WORD.search(x)]
    again = {i + k for i, x in enumerate(windows) if times[x] > 1 for k in range(3)}
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in q.SYMBOLS for c in text), "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(again)}


def floor_of(v):
    if v < 128:
        return v
    shift = v.bit_length() - 7
    return v >> shift << shift


def quartile(values, k):
    return floor_of(sorted(values)[-(-k * len(values) // 4) - 1])


def verdicts(rows, least):
    stats = [(i, lang, source, counts(t)) for i, lang, source, t in rows]
    value = lambda c, r: r.scale * c[r.part] // c[r.whole] if c[r.whole] else None
    out = []
    for i, lang, source, c in stats:
        failed = []
        for r in q.RULES:
            v = value(c, r)
            if v is None:
                continue
            for group in ([s for s in stats if s[1:3] == (lang, source)], [s for s in stats if s[1] == lang], stats):
                values = [x for s in group if (x := value(s[3], r)) is not None]
                if len(values) >= least or group is stats:
                    break
            q1, q3 = quartile(values, 1), quartile(values, 3)
            reach = max(r.spread * (q3 - q1), r.slack)
            if v > q3 + reach or r.low and v < q1 - reach:
                failed.append(r.name)
        base = c["n_words"] < 50 or 100 * c["n_repeat_words"] > 50 * c["n_words"]
        out.append((i, *[c[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], base, not base and not failed, ",".join(failed)))
    return out


def sample(rng):
    kind = rng.random()
    some = [rng.choice("abcdefgé\U0001f600") * rng.randrange(1, 9) + rng.choice(["", ",", "."]) for _ in range(rng.randrange(4, 40))]
    words = [rng.choice(some) if kind < 0.3 else "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9 if kind < 0.9 else 40))) for _ in range(rng.randrange(200))]
    if 0.3 < kind < 0.4:
        words = [w + rng.choice(["###", "&&&", "<|>"]) for w in words]
    return "".join(w + rng.choice([" ", " ", "  ", "\t", "\n", "\n\n", "\r\n", "\x0b", "  "]) for w in words) + ("\nagain and again" * rng.randrange(9) if kind > 0.7 else "")


def test_counts_and_verdicts_against_plain_python(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice(["en", "fr", None]), rng.choice(["a", "a", "a", "b", None, ""]), sample(rng)) for i in range(400)]
    rows += [(400, "xx", "y", None), (401, "xx", None, ""), (402, None, None, " \n \t"), (402, None, None, "a b c a b c"), (None, "en", "a", "one two three four")]
    rows += [rows[5], rows[5], (403, "en", "a", "ab " * 100_000), (404, "en", "a", " ".join(f"w{i % 70_000}" for i in range(120_000)))]
    got = q.report(spark.createDataFrame(rows, SCHEMA), least=30)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(verdicts(rows, 30), key=str)
    assert {r["kept"] for r in got.select("kept").distinct().collect()} == {True, False}


def test_limits_by_shuffle_and_clashing_columns(spark, monkeypatch):
    rng = random.Random(8)
    names = ["doc_id", "lang", "source", "text", "n_words", "kept", "own_row", "limits", "bucket", "word_stats", "base_failed"]
    rows = [(i, "en", rng.choice(["a", "b"]), sample(rng), -1, "k", "o", "l", "b", "w", True) for i in range(200)]
    docs = spark.createDataFrame(rows, ", ".join(f"{n} {'long' if n in ('doc_id', 'n_words') else 'boolean' if n == 'base_failed' else 'string'}" for n in names))
    want = sorted(map(tuple, q.report(docs).collect()))
    kept = {r[0] for r in want if r[7]}
    assert sorted(map(tuple, q.filtered(docs).collect())) == [r for r in rows if r[0] in kept]
    from lexlake.llm import common

    monkeypatch.setattr(q, "small", lambda df, rows: common.small(df, rows, 0))
    assert sorted(map(tuple, q.report(docs).collect())) == want


def test_sketches_of_parts_merge(spark):
    rng = random.Random(9)
    docs = spark.createDataFrame([(i, "en", rng.choice("ab"), sample(rng)) for i in range(120)], SCHEMA)
    stats, names = q.counted(docs)
    by = ["lang", "source"]
    whole = q.sketches(stats, names, by)
    parts = q.sketches(stats.filter("doc_id % 3 = 0"), names, by).unionByName(q.sketches(stats.filter("doc_id % 3 > 0"), names, by))
    assert sorted(map(tuple, q.merged(parts, by).collect())) == sorted(map(tuple, whole.collect()))


@pytest.mark.parametrize("v", [0, 1, 127, 128, 129, 255, 256, 1000, 12_345_678, 2**62])
def test_buckets(spark, v):
    r = spark.range(1).select(q.bucket_floor(q.bucket(F.lit(v).cast("long"))).alias("f"), q.bucket(F.lit(v).cast("long")).alias("b")).first()
    assert r["f"] == floor_of(v) and (r["b"] == v if v < 128 else r["b"] > 127)


def test_empty(spark):
    assert q.report(spark.createDataFrame([], SCHEMA)).collect() == []
    assert q.filtered(spark.createDataFrame([], SCHEMA)).columns == ["doc_id", "lang", "source", "text"]
