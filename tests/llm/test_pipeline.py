"""The pipeline against a brute-force version in plain Python, stage by stage."""

import random
from collections import Counter

import public_tokenizers
import pytest
from test_mixing import brute_mix
from test_ngram_join import brute
from test_secret_scan import brute as brute_spans
from test_toxicity import corpus
from tokenizers import Tokenizer

import corpus_pipeline
from lexlake.llm import secret_scan, toxicity
from lexlake.llm.ngram_join import Rule

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(21)
    texts, labels = corpus(rng, 900)
    rows = []
    for i, t, *_ in texts:
        if i % 10 == 3:
            t = rows[-1][1] + " tail"
        if i % 25 == 4:
            t = (t or "") + " password = hunter2hunter2 " + "ab12" * 8
        rows.append((i, t, "en", rng.choice(["hot"] * 6 + ["b", "c", None]), len(t)))
    rows += [(2000, None, None, "b", None), (2001, "", "en", "c", 0), (2002, "x", "en", None, 1)]
    where = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, y, _ in labels], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return where, rows


def mixed_rows(rows):
    order, _, _, words = brute_mix([(r[0], r[1], r[3]) for r in rows])
    out = [r for i, r in enumerate(rows) if not words[i]]
    for _, i, n in order:
        r = rows[i]
        if n < words[i]:
            t = " ".join(r[1].split()[:n])
            r = (r[0], t, *r[2:4], len(t))
        out.append(r)
    return out


def test_stages_against_brute_force(spark, tables):
    where, rows = tables
    docs = spark.read.parquet(f"{where}/documents.parquet")
    key = lambda xs: sorted((tuple(x) for x in xs), key=str)

    model = toxicity.train(docs, spark.read.parquet(f"{where}/labels.parquet"))
    want = [r for r in rows if model.score(r[1]) < toxicity.THRESHOLD]
    assert len(rows) * 0.8 < len(want) < len(rows) * 0.95
    docs = corpus_pipeline.reject_toxic(spark, docs, where).cache()
    assert key(docs.collect()) == key(want)

    group = {i: c for i, _, c in brute(want, Rule(5, 80))}
    want = [r for r in want if group[str(r[0])] == str(r[0])]
    docs = corpus_pipeline.one_of_near_copies(spark, docs, where).cache()
    assert key(docs.collect()) == key(want) and len(want) < 800

    clean = []
    for i, t, lang, source, n in want:
        out, at = "", 0
        for a, _, b, _ in brute_spans(t, secret_scan.RULES):
            if a >= at:
                out, at = out + t[at:a] + "[SECRET]", b
            at = max(at, b)
        new = out + t[at:] if out else t
        clean.append((i, new, lang, source, None if t is None else len(new)))
    docs = corpus_pipeline.redact_secrets(spark, docs, where).cache()
    assert key(docs.collect()) == key(clean) and sum("[SECRET]" in (r[1] or "") for r in clean) > 10

    mixed = mixed_rows(clean)
    docs = corpus_pipeline.mix_sources(spark, docs, where).cache()
    assert docs.columns == [c.split()[0] for c in COLUMNS.split(", ")]
    assert key(docs.collect()) == key(mixed)

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sizes = Counter()
    for i, text, *_ in mixed:
        sizes[i] += len(t.encode(text or "", add_special_tokens=False).ids) + 1
    packed, whole = corpus_pipeline.pack_sequences(spark, docs, where), Counter()
    for r in packed.collect():
        whole[r["doc_id"]] += r["length"]
    assert whole == sizes


def test_run_gives_the_same_pieces(spark, tables):
    where, _ = tables
    rows = corpus_pipeline.run(spark, where).collect()
    assert {r["doc_id"] for r in rows} >= {2000, 2001}
    windows = Counter()
    for r in rows:
        windows[r["sequence_id"]] += r["length"]
    assert all(n <= 2048 and n & (n - 1) == 0 for n in windows.values())
