"""Audio fingerprints: integral image against plain sums, alignment under noise and shifts, search against brute force."""

import io
import random
import wave

import numpy as np
from pyspark.sql import functions as F

from lexlake.llm import audio


def wav(samples, rate=audio.RATE, width=2, channels=1):
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(channels)
        f.setsampwidth(width)
        f.setframerate(rate)
        peak = np.clip(samples / max(1e-9, np.abs(samples).max(initial=0)), -1, 1)
        whole = (peak * (2 ** (8 * width - 1) - 1)).astype("<i8")
        octets = (whole + (128 if width == 1 else 0)).view(np.uint8).reshape(-1, 8)[:, :width]
        f.writeframes(np.repeat(octets[:, None], channels, axis=1).tobytes())
    return out.getvalue()


def own_codes(samples, rate=audio.RATE):
    return audio.codes([audio.resampled(samples, rate)])[0]


def text(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))


def errors(a, b, offset):
    first = max(0, -offset)
    n = min(len(a) - offset, len(b)) - first
    return 1.0 if n <= 0 else sum(bin(x ^ y).count("1") for x, y in zip(a[first + offset :][:n].tolist(), b[first:][:n].tolist(), strict=True)) / 32 / n


def test_filters_are_rectangle_sums():
    rng = np.random.default_rng(1)
    samples = [rng.normal(size=256 * 60), rng.normal(size=0), rng.normal(size=5), rng.normal(size=256 * 40 + 77)]
    bins, frames = audio.chroma(samples)
    assert np.allclose(bins.sum(1)[:58], 1) and frames.tolist() == [58, 0, 16, 38]
    found, _, counts = audio.codes(samples)
    assert counts.tolist() == [43, 0, 1, 23]
    assert found[:43].tolist() == own_codes(samples[0]).tolist() and found[44:].tolist() == own_codes(samples[3]).tolist()
    found = found[:43]
    for i in range(0, len(found), 7):
        bits = 0
        for kind, p, h, w in audio.FILTERS:
            area, half = bins[i : i + w, p : p + h], h // 2 or 1
            part = {0: area[: w // 2].sum(), 1: area[:, :half].sum(), 2: area[w // 4 : w // 4 + w // 2].sum(), 3: area[: w // 2, :half].sum() + area[w // 2 :, half:].sum(), 4: area.sum()}[kind]
            whole = bins[i : i + w].sum() if kind == 4 else area.sum()
            level = int(np.searchsorted(audio.STEPS, np.log((1e-3 + part) / (1e-3 + whole - part))))
            bits = bits << 2 | (level ^ level >> 1)
        assert bits == int(found[i])


def test_integers_depend_on_the_recording_alone():
    """Copies have equal integers whatever is worked on beside them, also where halves of a filter are equal and rounding would decide."""
    rng = random.Random(14)
    samples = [audio.rendered(x)[0] for x in (*(text(rng, rng.randrange(20, 120)) for _ in range(150)), "ha " * 40, "a b " * 30)]
    alone = [audio.codes([x]) for x in samples]
    for _ in range(2):
        order = rng.sample(range(len(samples)), len(samples))
        found, doubts, counts = audio.codes([samples[i] for i in order])
        ends = np.cumsum(counts)
        for i, end, n in zip(order, ends.tolist(), counts.tolist(), strict=True):
            assert found[end - n : end].tolist() == alone[i][0].tolist() and doubts[end - n : end].tolist() == alone[i][1].tolist()


def test_alignment_under_noise_and_other_encodings():
    rng, noise = random.Random(2), np.random.default_rng(2)
    samples, rate = audio.rendered(text(rng, 200))
    a = own_codes(samples, rate)
    for other in (samples + noise.normal(0, 0.05, len(samples)), samples * 0.3):
        assert errors(a, own_codes(other, rate), 0) < 0.12
    assert errors(a, own_codes(samples[audio.HOP * 40 :], rate), 40) == 0
    for data in (wav(samples), wav(samples, width=1), wav(samples, channels=2), wav(samples, width=3), wav(samples, width=4, channels=3)):
        got, rate = audio.wav_samples(data)
        assert len(got) == len(samples) and errors(a, own_codes(got, rate), 0) < 0.1
    assert errors(a, own_codes(*audio.rendered(text(rng, 200))), 0) > 0.25


def test_runs_make_the_whole(monkeypatch):
    """Samples in pieces and runs of any size give the integers, and the means of other rates, of a recording held whole."""
    noise = np.random.default_rng(7)
    span = (audio.SPAN - 1) * audio.HOP + audio.FRAME
    monkeypatch.setattr(audio, "RUN", 1 << 30)
    sounds = [noise.normal(size=n).astype(np.float32) for n in (0, 5, span - 1, span, 4096 + span - 1, 4096 + span, 4096 + span + audio.HOP, 50_000)]
    want = [audio.codes([x]) for x in sounds]
    slow = [audio.resampled(x, 5000) for x in sounds]
    monkeypatch.setattr(audio, "RUN", 4096)
    for x, (codes, doubts, _), other in zip(sounds, want, slow, strict=True):
        for size in (777, 4096, 1 << 20):
            pieces = [x[k : k + size] for k in range(0, len(x), size)]
            runs = list(audio.runs_of_frames(pieces))
            assert all(len(r) < 4096 + span for r in runs)
            got = [audio.codes([r]) for r in runs]
            assert np.concatenate([g[0] for g in got]).tolist() == codes.tolist() and np.concatenate([g[1] for g in got]).tolist() == doubts.tolist()
            got = audio.whole(audio.resampled_pieces(pieces, 5000))
            assert len(got) == len(other) and np.allclose(got, other, atol=1e-5)


def test_long_recordings_among_short_ones(spark):
    """Rows keep their order and integers where a recording is many runs long."""
    rng = random.Random(8)
    texts = [text(rng, n) for n in (30, 0, 9000, 3, 40, 5000)] + [None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "rec long, said string").coalesce(1)
    got = {r["rec"]: r for r in audio.fingerprints(df, ["rec"], "said", audio.rendered_pieces).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        samples, rate = audio.rendered(t)
        assert got[i]["codes"] == own_codes(samples, rate).view(np.int32).tolist() and len(got[i]["doubts"]) == len(got[i]["codes"])
        assert got[i]["seconds"] == len(samples) / rate


def test_rates_meet():
    # the same chords at three usual rates
    def tones(rate):
        rng, out = random.Random(9), []
        for _ in range(60):
            t = np.arange(rate // 4) / rate
            out.append(sum(np.sin(2 * np.pi * 110 * 2 ** (rng.randrange(24) / 12) * t) for _ in range(3)))
        return np.concatenate(out)

    a = own_codes(*audio.wav_samples(wav(tones(44100), 44100)))
    for rate in (8000, 16000, 22050):
        assert errors(a, own_codes(*audio.wav_samples(wav(tones(rate), rate))), 0) < 0.1
    bad = bytearray(wav(tones(8000), 8000))
    bad[24:28] = bytes(4)
    assert [len(audio.wav_samples(x)[0]) for x in (bytes(bad), b"RIFF", None)] == [0, 0, 0]


def test_recall_against_all_offsets(spark):
    """Of pairs that align at some offset by bit errors, at any noise, at least 0.9 are found."""
    rng, noise = random.Random(5), np.random.default_rng(5)
    rows = []
    for k in range(48):
        samples = audio.rendered(text(rng, 30))[0]
        cut = samples[rng.randrange(400) :]
        rows += [(2 * k, wav(samples)), (2 * k + 1, wav(cut + noise.normal(0, (0.05, 0.1, 0.2, 0.3)[k % 4], len(cut))))]
    prints = audio.fingerprints(spark.createDataFrame(rows, "rec long, sound binary"), ["rec"], "sound")
    found = {(r["rec"], m["match_id"]) for r in audio.search(prints, "rec", F.col("rec") % 2 == 0).collect() for m in r["matches"] or []}
    own = [own_codes(*audio.wav_samples(x)) for _, x in rows]
    wanted = set()
    for i in range(0, 96, 2):
        for j in range(96):
            a, b = own[i], own[j]
            offsets = range(audio.LEAST_CODES - len(b), len(a) - audio.LEAST_CODES + 1)
            if i != j and min(errors(a, b, o) for o in offsets) <= audio.MOST_ERRORS:
                wanted.add((i, j))
    assert len(wanted) > 36 and found <= wanted
    assert len(found) >= 0.9 * len(wanted), (len(found), len(wanted))


def test_recall_where_rare_integers_vote(spark):
    """The same where queries are long enough to ask with their rare integers alone, beside many recordings of a common passage."""
    rng, noise = random.Random(6), np.random.default_rng(6)
    common, rows = text(rng, 40), []
    for k in range(40):
        said = text(rng, 80) if k % 2 else " ".join([text(rng, 60), common])
        samples = audio.rendered(said)[0]
        cut = samples[rng.randrange(400) :]
        rows += [(2 * k, wav(samples)), (2 * k + 1, wav(cut + noise.normal(0, (0.05, 0.1, 0.2, 0.3)[k // 2 % 4], len(cut))))]
    prints = audio.fingerprints(spark.createDataFrame(rows, "rec long, sound binary"), ["rec"], "sound")
    found = {(r["rec"], m["match_id"]) for r in audio.search(prints, "rec", F.col("rec") % 2 == 0).collect() for m in r["matches"] or []}
    own = [own_codes(*audio.wav_samples(x)) for _, x in rows]
    assert min(map(len, own[::2])) >= audio.SHORT

    def least(a, b):
        spans = ((max(0, -o), o) for o in range(audio.LEAST_CODES - len(b), len(a) - audio.LEAST_CODES + 1))
        sides = ((a[f + o :][: len(b) - f], b[f:][: len(a) - o - f]) for f, o in spans)
        return min(np.bitwise_count(x ^ y).sum() / 32 / len(x) for x, y in sides)

    wanted = {(i, j) for i in range(0, 80, 2) for j in range(80) if i != j and least(own[i], own[j]) <= audio.MOST_ERRORS}
    assert len(wanted) > 30 and found <= wanted
    assert len(found) >= 0.9 * len(wanted), (len(found), len(wanted))


def test_search_against_brute_force(spark):
    rng = random.Random(3)
    base = [text(rng, 60) for _ in range(30)]
    rows = []
    for i in range(120):
        t = rng.choice(base)
        w = t.split()
        k = rng.randrange(4)
        t = t if k == 0 else " ".join(w[rng.randrange(25) :]) if k == 1 else " ".join([text(rng, 9), t]) if k == 2 else text(rng, 60)
        rows.append((i, wav(audio.rendered(t)[0]), "clash"))
    short = wav(audio.rendered("a b c")[0])
    rows += [(200, None, None), (201, b"no audio", ""), (202, b"", ""), (203, wav(np.zeros(99)), ""), (0, rows[0][1], ""), (205, short, ""), (206, short, ""), (None, rows[1][1], "")]
    df = spark.createDataFrame(rows, "rec long, sound binary, codes string")
    prints = audio.fingerprints(df, ["rec"], "sound")
    got = audio.search(prints, "rec", F.col("rec") % 5 == 0).collect()
    assert len(got) == len(rows)
    own = {i: own_codes(*audio.wav_samples(s)) for i, s, _ in rows}
    same = {}
    for i, c in own.items():
        if i is not None:
            same.setdefault(c.tobytes(), i)
    for r in got:
        a = own[r["rec"]]
        assert r["n_codes"] == len(a)
        if not len(a):
            assert r["class_id"] is None and r["match_id"] is None
            continue
        assert r["class_id"] == same[a.tobytes()]
        options = []
        for j in set(same.values()) - {r["class_id"]} if r["rec"] is not None and r["rec"] % 5 == 0 else []:
            b = own[j]
            if min(len(a), len(b)) >= audio.LEAST_CODES:
                options += [(errors(a, b, o), j) for o in range(audio.LEAST_CODES - len(b), len(a) - audio.LEAST_CODES + 1)]
        want = sorted({j for e, j in options if e <= audio.MOST_ERRORS})
        # pairs that agree by chance over a few integers, near the limit, may have no vote; all that share sound are found
        got_ids = {m["match_id"] for m in r["matches"] or []}
        assert got_ids <= set(want) and {j for e, j in options if e <= 0.1} <= got_ids
        for m in r["matches"] or []:
            assert abs(m["bit_error"] - min(e for e, j in options if j == m["match_id"])) < 1e-12
            assert m["bit_error"] == errors(a, own[m["match_id"]], m["offset"])
    assert sum(r["match_id"] is not None for r in got) > 10


def test_all_that_align_are_named(spark):
    rng, noise = random.Random(4), np.random.default_rng(4)
    talk = text(rng, 60)
    samples = audio.rendered(talk)[0]
    sounds = [samples, audio.rendered(" ".join(talk.split()[20:]))[0], audio.rendered(text(rng, 9) + " " + talk)[0], samples + noise.normal(0, 0.01, len(samples)), audio.rendered(text(rng, 60))[0], samples]
    prints = audio.fingerprints(spark.createDataFrame([(i, wav(x)) for i, x in enumerate(sounds)], "rec long, sound binary"), ["rec"], "sound")
    own = [own_codes(*audio.wav_samples(wav(x))) for x in sounds]
    got = {r["rec"]: r for r in audio.search(prints, "rec", F.col("rec") % 5 == 0).collect()}
    for asks in (0, 5):
        r = got[asks]
        assert r["class_id"] == 0 and {m["match_id"] for m in r["matches"]} == {1, 2, 3}
        assert all(abs(m["bit_error"] - errors(own[0], own[m["match_id"]], m["offset"])) < 1e-12 for m in r["matches"])
        assert r["matches"] == sorted(r["matches"], key=lambda m: (m["bit_error"], -m["votes"], m["match_id"]))
        assert tuple(r["matches"][0]) == (r["match_id"], r["offset"], r["votes"], r["bit_error"])
    assert all(got[i]["matches"] is None for i in range(1, 5))


def test_empty_table(spark):
    df = spark.createDataFrame([], "rec long, sound binary")
    assert audio.search(audio.fingerprints(df, ["rec"], "sound"), "rec", F.col("rec") % 50 == 0).collect() == []


def test_the_exact_way_misses_nothing(spark):
    rng = random.Random(11)
    signed = lambda x: x - (1 << 32) if x >= 1 << 31 else x
    base = [rng.getrandbits(32) for _ in range(60)]
    # four wrong bits in every integer, none of them doubtful: no integer has a vote, and an eighth of the bits is wrong
    noisy = [x ^ sum(1 << b for b in rng.sample(range(12, 32), 4)) for x in base[5:]]
    doubts = sum(k << (5 * k) for k in range(audio.DOUBTS))
    lists = {1: base, 2: noisy, 3: [rng.getrandbits(32) for _ in range(50)], 4: base[:7], 5: []}
    rows = [(i, float(len(x)), [signed(v) for v in x], [doubts] * len(x)) for i, x in lists.items()]
    recordings = spark.createDataFrame(rows, "id long, seconds double, codes array<int>, doubts array<long>")
    found = lambda exact: {r["id"]: (r["match_id"], r["offset"], r["bit_error"]) for r in audio.search(recordings, "id", F.col("id") < 4, exact).collect()}
    assert found(False)[1] == (None, None, None)
    assert found(True) == {1: (2, 5, 0.125), 2: (1, -5, 0.125), 3: (None,) * 3, 4: (None,) * 3, 5: (None,) * 3}


def signed(x):
    return x - (1 << 32) if x >= 1 << 31 else x


def shuffled_rows(spark, recordings, is_query):
    """The rows that a search hands from task to task."""
    store, bus = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jsc.sc().listenerBus()

    def total():
        bus.waitUntilEmpty(30_000)
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = total()
    audio.search(recordings, "id", is_query).collect()
    return total() - before


def test_hits_and_offsets_are_no_rows(spark):
    """What a search shuffles grows with the recordings, though hits grow with recordings times queries."""
    rng = random.Random(12)
    alphabet = [signed(rng.getrandbits(32)) for _ in range(16)]
    doubts = sum(k << (5 * k) for k in range(audio.DOUBTS))
    rows = [(i, 40.0, [rng.choice(alphabet) for _ in range(40)], [doubts] * 40) for i in range(240)]
    few, many = (shuffled_rows(spark, spark.createDataFrame(rows[:n], "id long, seconds double, codes array<int>, doubts array<long>"), F.col("id") % 2 == 0) for n in (80, 240))
    assert many < 4 * few, (few, many)


def voted(lists, doubts, queries):
    """q, r: offset, votes, wrong bits of all that align at an offset with votes, plainly; every integer asks."""
    out = {}
    for q in queries:
        for r, b in enumerate(lists):
            a, votes = lists[q], {}
            for i, x in enumerate(a):
                bits = [1 << (doubts[q][i] >> 5 * k & 31) for k in range(audio.DOUBTS)]
                asks = {x, *(x ^ v for v in bits), *(x ^ v ^ w for v in bits for w in bits)}
                if i and a[i - 1] == x:
                    continue
                for j, y in enumerate(b):
                    if y in asks and not (j and b[j - 1] == y):
                        votes[i - j] = votes.get(i - j, 0) + 1
            options = []
            for o, n in votes.items():
                first = max(0, -o)
                size = min(len(a) - o, len(b)) - first
                if q != r and size >= audio.LEAST_CODES and n * audio.VOTES >= size:
                    error = sum((x ^ y).bit_count() for x, y in zip(a[first + o :][:size], b[first:][:size], strict=True)) / (32.0 * size)
                    options += [(error, -n, abs(o), o)] if error <= audio.MOST_ERRORS else []
            if options:
                error, n, _, o = min(options)
                out[q, r] = (o, -n, error)
    return out


def test_blocks_of_any_size_find_the_same(spark, monkeypatch):
    """Votes, offsets and errors are those of a plain count, for blocks of all recordings and of few, and where hits are counted in turns; recordings
    that only repeat two integers have many hits in one pair."""
    rng = random.Random(13)
    common = [rng.getrandbits(32) for _ in range(30)]
    flip = lambda x: x ^ (1 << rng.randrange(8))
    lists = [[rng.getrandbits(32) for _ in range(rng.randrange(4))] + [flip(x) for x in common[rng.randrange(5) :]] for _ in range(20)]
    lists += [common[:2] * rng.randrange(10, 25) for _ in range(6)] + [common[:7], common[3:11], []]
    doubts = [[sum(bit << (5 * k) for k, bit in enumerate(rng.sample(range(8), audio.DOUBTS))) for _ in x] for x in lists]
    rows = [(i, float(i), [signed(v) for v in x], d) for i, (x, d) in enumerate(zip(lists, doubts, strict=True))]
    recordings = spark.createDataFrame(rows, "id long, seconds double, codes array<int>, doubts array<long>")
    want = voted(lists, doubts, range(0, len(lists), 2))
    assert len(want) > 100
    monkeypatch.setattr(audio, "SHORT", 1 << 20)
    for sizes in ({}, {"BLOCK": 64, "ASKING": 100}, {"BLOCK": 300}):
        for name, value in sizes.items():
            monkeypatch.setattr(audio, name, value)
        got = {(r["id"], m["match_id"]): (m["offset"], m["votes"], m["bit_error"]) for r in audio.search(recordings, "id", F.col("id") % 2 == 0).collect() for m in r["matches"] or []}
        assert got == want
    # in this process, where its bound can be set: all of one block of each, halved down to pairs
    codes = lambda some: np.array([v for x in some for v in x], np.uint32)
    begins = lambda some: np.cumsum([0, *map(len, some)])
    whole, asks = [x for x in lists if x], lists[: len(lists) - 1 : 2]
    turns = [[i for i, x in enumerate(a) if not (i and a[i - 1] == x)] for a in asks]
    owners, at = (np.array(x) for x in zip(*((k, i) for k, t in enumerate(turns) for i in t), strict=True))
    own = np.array([doubts[2 * k][i] for k, i in zip(owners.tolist(), at.tolist(), strict=True)])
    for hits in (audio.HITS, 100, 7):
        monkeypatch.setattr(audio, "HITS", hits)
        asking = audio._Asking.probing(np.arange(0, 2 * len(asks), 2), codes(asks), begins(asks), owners=owners, at=at, doubts=own)
        held = audio._Held(np.arange(len(whole)), codes(whole), begins(whole))
        got = {(r["q"], r["r"]): (r["offset"], r["votes"], r["bit_error"]) for b in audio._aligned_blocks(asking, held) for r in b.to_pylist()}
        assert got == want
