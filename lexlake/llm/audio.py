"""Media columns: chroma fingerprints of audio, and the search for recordings that align.

A recording is brought to ``RATE`` samples a second and becomes frames of three eighths of a second, each the
energy of the twelve pitch classes. Sixteen filters, differences of rectangles in an integral image over the
frames, give two bits each: one packed 32-bit integer per frame. The filters whose value lies nearest to a
threshold are kept too, as the integer's doubtful bits.

Two recordings are candidates at an offset where an integer of one, with up to two of its six most doubtful
bits flipped, is equal to an integer of the other; the offset histogram counts how often. Integers vote by rarity: of
every ``STRETCH`` frames of a query the ``RARE`` whose probes are held least often ask (all of them if it has fewer than ``SHORT`` integers),
by counts over all recordings in ``CLASSES`` hashed classes, which are all that common integers cost. Every offset with votes
for a ``VOTES``-th of the integers that lie beside each other there is then checked by the bit errors of all of them,
and of the offsets that pass, the one with the fewest counts. So evenly noisy recordings are found as well as partly equal ones.

Recordings with equal integers and length are one class, and only classes are searched, so copies
cost nothing but a row each. No list of postings is cut: a pair of blocks with many hits is halved.

Defined results: null, unreadable or empty audio has no integers and aligns with nothing; audio shorter than a
span of frames is padded with silence to one integer, and a recording of fewer than ``LEAST_CODES`` integers aligns
with its equals alone, those of its class; repeated rows have equal fingerprints; an empty table gives an
empty result; columns other than those named are ignored; an id column must not be named seconds, codes or doubts.
"""

from __future__ import annotations

import io
import re
import wave
import zlib
from collections.abc import Callable, Iterable, Iterator
from itertools import batched, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexlake.llm.common import arrow_batches, arrow_rows, forget, small, trimmed, written

#: Samples a second that all audio is brought to, samples of a frame, and from a frame to the next.
RATE, FRAME, HOP = 2048, 768, 256
SPAN = 16
#: Two recordings align at a share of wrong bits of at most this, over at least so many integers.
MOST_ERRORS, LEAST_CODES = 0.15, 8
#: Doubtful bits that are kept of an integer, and samples and frames worked on at a time.
DOUBTS, RUN, FRAMES = 6, 1 << 21, 128
#: One integer in so many must have a vote for an offset to be checked: of recordings that align nearly all have more.
VOTES = 160
#: Of so many frames of a query so many integers ask, the rarest; queries of fewer than so many integers ask with all.
STRETCH, RARE, SHORT = 8, 4, 64
#: Classes in which integers are counted: so many rows are broadcast at any size.
CLASSES = 1 << 18
#: Integers of a block of recordings and of a block of queries, about; hits, or integers beside each other, that are worked on at a time.
BLOCK, ASKING, HITS = 1 << 19, 1 << 16, 1 << 20


def _filters() -> list[tuple[int, int, int, int]]:
    """kind, first pitch class, pitch classes, frames of each filter: kinds in turn, sizes growing."""
    return [(k % 5, (5 * k) % 9, 2 + k % 3, (4, 8, 12, 16)[k // 4]) for k in range(16)]


FILTERS = _filters()
STEPS = (-0.2, 0.0, 0.2)
#: Shares of energy are whole multiples of one part in so many: sums over up to 4 million frames are exact, so an integer doesn't depend on what lies before it.
GRAIN = float(1 << 30)


HERTZ = np.arange(FRAME // 2 + 1) * RATE / FRAME
_CLASS = np.round(12 * np.log2(HERTZ[HERTZ >= 55] / 440)).astype(int) % 12
#: Frequencies from 55 Hz on by pitch class, and where each class begins.
_FOLD = np.flatnonzero(HERTZ >= 55)[np.argsort(_CLASS, kind="stable")]
_BEGINS = np.searchsorted(np.sort(_CLASS), np.arange(12))
_HANN = np.hanning(FRAME).astype(np.float32)
#: The bit of its two that a filter changes where its value crosses the first, second or third of STEPS.
_CROSSING = np.array([1, 2, 1])


def resampled_pieces(pieces: Iterable[np.ndarray], rate: int) -> Iterator[np.ndarray]:
    """Samples at ``RATE``, in pieces: each the mean over its time of the samples given."""
    if rate == RATE:
        yield from pieces
        return
    step, held, base, a = rate / RATE, np.zeros(0, np.float32), 0, 0
    for piece in chain(pieces, [None]):
        held = held if piece is None else np.concatenate((held, piece))
        n = int((base + len(held)) * RATE / rate)
        while a < n:
            b = a + RUN // 8
            if piece is not None and (b > n or int(b * step) + 2 > base + len(held)):
                break
            edges = np.arange(a, min(n, b) + 1) * step
            low, a = int(edges[0]), min(n, b)
            sums = np.concatenate(([0.0], np.cumsum(held[low - base : int(edges[-1]) + 2 - base], dtype=np.float64)))
            yield (np.diff(np.interp(edges - low, np.arange(len(sums)), sums)) / step).astype(np.float32)
            held, base = held[int(a * step) - base :], int(a * step)


def whole(pieces: Iterable[np.ndarray]) -> np.ndarray:
    """All samples in one array."""
    return np.concatenate([np.zeros(0, np.float32), *pieces])


def resampled(samples: np.ndarray, rate: int) -> np.ndarray:
    """Samples at ``RATE`` of a recording that is held whole."""
    return whole(resampled_pieces([samples], rate))


def runs_of_frames(pieces: Iterable[np.ndarray]) -> Iterator[np.ndarray]:
    """The samples in runs whose integers on end are the recording's: a run begins ``RUN`` after the one before, and ends with the frames that its
    last integer spans. Nothing gives one run of nothing."""
    span = (SPAN - 1) * HOP + FRAME
    most, held, cut = RUN - HOP + span, np.zeros(0, np.float32), False
    for piece in pieces:
        held = np.concatenate((held, piece))
        while len(held) > most:
            yield held[:most]
            held, cut = held[RUN:], True
    # what is left after a run has integers of its own only if a whole span is in it
    if not cut or len(held) >= span:
        yield held


def chroma(recordings: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Frames by twelve of all recordings on end, each frame's share of energy in the pitch classes from 55 Hz on,
    and every recording's number of frames: none without samples, else ``SPAN`` at least, the last of them silence."""
    sizes = np.array([max(len(r), FRAME) if len(r) else 0 for r in recordings], np.int64)
    heard = np.where(sizes > 0, (sizes - FRAME) // HOP + 1, 0)
    frames = np.where(heard > 0, np.maximum(heard, SPAN), 0)
    room = np.where(heard > 0, (sizes + HOP - 1) // HOP, 0)
    buffer = np.zeros(int(room.sum()) * HOP + FRAME, np.float32)
    begins = np.cumsum(room) - room
    for r, at in zip(recordings, begins.tolist(), strict=True):
        buffer[at * HOP : at * HOP + len(r)] = r
    within = np.arange(int(heard.sum())) - np.repeat(np.cumsum(heard) - heard, heard)
    source, target = within + np.repeat(begins, heard), within + np.repeat(np.cumsum(frames) - frames, heard)
    windows = np.lib.stride_tricks.sliding_window_view(buffer, FRAME)[::HOP]
    bins = np.zeros((int(frames.sum()), 12))
    # few frames at a time, in arrays that are used again: they stay in the processor's cache
    spectra = np.empty((FRAMES, len(HERTZ)), np.complex64)
    for k in range(0, len(source), FRAMES):
        frame = windows[source[k : k + FRAMES]]
        frame *= _HANN
        waves = np.fft.rfft(frame, axis=1, out=spectra[: len(frame)])
        power = waves.real**2
        power += waves.imag**2
        # summed in one order whatever frames are beside: a matrix product's order depends on their number
        energy = np.add.reduceat(power[:, _FOLD], _BEGINS, axis=1)
        total = energy.sum(axis=1, keepdims=True)
        share = np.divide(energy, total, out=np.zeros_like(energy), where=total > 1e-9)
        bins[target[k : k + FRAMES]] = np.rint(share * GRAIN) / GRAIN
    return bins, frames


def codes(recordings: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The packed integers (uint32) of all recordings, one per frame that a whole span follows; their doubtful bits
    (five bits each in a long, the most doubtful lowest); and each recording's number of integers."""
    bins, frames = chroma(recordings)
    counts = np.maximum(frames - SPAN + 1, 0)
    at = np.arange(int(counts.sum())) + np.repeat(np.cumsum(frames) - frames - np.cumsum(counts) + counts, counts)
    image = np.zeros((len(bins) + 1, 13))
    image[1:, 1:] = bins.cumsum(0).cumsum(1)

    def box(t: int, width: int, p: int, height: int) -> np.ndarray:
        a, b = at + t, at + t + width
        return image[b, p + height] - image[a, p + height] - image[b, p] + image[a, p]

    out = np.zeros(len(at), np.uint32)
    margins, bits = np.empty((len(FILTERS), len(at)), np.float32), np.empty((len(FILTERS), len(at)), np.int8)
    for k, (kind, p, h, w) in enumerate(FILTERS):
        whole = box(0, w, p, h)
        if kind == 0:
            part = box(0, w // 2, p, h)
        elif kind == 1:
            part = box(0, w, p, h // 2 or 1)
        elif kind == 2:
            part = box(w // 4, w // 2, p, h)
        elif kind == 3:
            part = box(0, w // 2, p, h // 2 or 1) + box(w // 2, w - w // 2, p + (h // 2 or 1), h - (h // 2 or 1))
        else:
            part, whole = whole, box(0, w, 0, 12)
        value = np.log((1e-3 + part) / (1e-3 + whole - part))
        level = np.searchsorted(STEPS, value).astype(np.uint32)
        out = (out << np.uint32(2)) | (level ^ (level >> np.uint32(1)))
        apart = np.abs(value - np.array(STEPS)[:, None])
        nearest = apart.argmin(0)
        margins[k], bits[k] = apart[nearest, np.arange(len(at))], 2 * (len(FILTERS) - 1 - k) + _CROSSING[nearest] - 1
    order = np.argsort(margins, axis=0, kind="stable")[:DOUBTS]
    doubts = np.zeros(len(at), np.int64)
    for k, bit in enumerate(np.take_along_axis(bits, order, 0)):
        doubts |= bit.astype(np.int64) << (5 * k)
    return out, doubts, counts


def wav_pieces(data: bytes | None) -> tuple[Iterator[np.ndarray], int]:
    """Samples (first channel), in pieces, and rate of PCM audio in WAV of 8, 16, 24 or 32 bits; nothing if it can't be read or has no rate."""
    try:
        f = wave.open(io.BytesIO(data or b""))  # noqa: SIM115 (read by the generator below)
    except (wave.Error, EOFError, ValueError):
        return iter(()), RATE
    width, channels, rate = f.getsampwidth(), f.getnchannels(), f.getframerate()
    if rate <= 0 or width not in (1, 2, 3, 4):
        return iter(()), RATE

    def read() -> Iterator[np.ndarray]:
        while raw := f.readframes(RUN // channels + 1):
            raw = np.frombuffer(raw, np.uint8, len(raw) // (width * channels) * width * channels)
            octets = raw.reshape(-1, channels, width)[:, 0]
            if width == 1:
                yield (octets[:, 0].astype(np.float32) - 128) / 128
                continue
            values = np.zeros((len(octets), 4), np.uint8)
            values[:, 4 - width :] = octets
            yield (values.reshape(-1).view("<i4") / np.float32(2**31)).astype(np.float32)

    return read(), rate


def wav_samples(data: bytes | None) -> tuple[np.ndarray, int]:
    """All samples and the rate of ``wav_pieces``."""
    pieces, rate = wav_pieces(data)
    return whole(pieces), rate


NOTE = RATE // 4
_NOTES = (np.sin(2 * np.pi * 220 * 2 ** (np.arange(12)[:, None] / 12) * np.arange(NOTE) / RATE) * np.hanning(NOTE)).astype(np.float32)


def rendered_pieces(text: str | None) -> tuple[Iterator[np.ndarray], int]:
    """A text as sound, in pieces: every word a chord of two notes, chosen by its checksum, a quarter of a second long."""

    def read() -> Iterator[np.ndarray]:
        for words in batched(re.finditer(r"\S+", text or ""), RUN // NOTE):
            sums = np.fromiter((zlib.crc32(w[0].encode()) for w in words), np.int64)
            yield (_NOTES[sums % 12] + np.float32(0.6) * _NOTES[sums // 12 % 12]).reshape(-1)

    return read(), RATE


def rendered(text: str | None) -> tuple[np.ndarray, int]:
    """All samples and the rate of ``rendered_pieces``."""
    pieces, rate = rendered_pieces(text)
    return whole(pieces), rate


def fingerprints(df: DataFrame, ids: list[str], column: str, decode: Callable[[object], tuple[Iterable[np.ndarray], int]] = wav_pieces) -> DataFrame:
    """ids, seconds, codes (array of integers) and doubts (array of longs) of every row; ``decode`` gives samples, in pieces, and rate of a value.

    Samples are worked on in runs of about ``RUN``, so a recording of any length costs its integers and a few runs."""
    if {i.lower() for i in ids} & {"seconds", "codes", "doubts"}:
        raise ValueError("an id column may not be named seconds, codes or doubts")
    schema = df.select(*ids).schema
    arrow_rows(df.sparkSession)

    def lists(parts: list[np.ndarray], counts: np.ndarray, type_: pa.DataType) -> pa.ListArray:
        ends = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts), type_))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            begin, seconds, coded, sounds, owners, held, since = 0, [], [], [], [], 0, 0
            for k, value in enumerate(b.column(column)):
                pieces, rate = decode(value.as_py())
                lengths: list[int] = []
                counted = (lengths.append(len(piece)) or piece for piece in pieces)
                for sound in runs_of_frames(resampled_pieces(counted, rate)):
                    sounds.append(sound)
                    owners.append(k - begin)
                    held += len(sound)
                    if held > RUN:
                        coded.append((*codes(sounds), owners))
                        sounds, owners, since, held = [], [], since + held, 0
                seconds.append(sum(lengths) / rate)
                if since + held > RUN or k == b.num_rows - 1:
                    coded.append((*codes(sounds), owners))
                    counts = np.zeros(k + 1 - begin, np.int64)
                    for *_, n, of in coded:
                        np.add.at(counts, np.array(of, np.int64), n)
                    columns = [*(b.column(i).slice(begin, k + 1 - begin) for i in ids), pa.array(seconds, pa.float64())]
                    columns += [lists([c[0].view(np.int32) for c in coded], counts, pa.int32()), lists([c[1] for c in coded], counts, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, [*ids, "seconds", "codes", "doubts"])
                    begin, seconds, coded, sounds, owners, held, since = k + 1, [], [], [], [], 0, 0

    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), "seconds double, codes array<int>, doubts array<long>"])
    return df.select(*ids, column).mapInArrow(run, fields)


def bit_error(a: Column, b: Column, offset: Column) -> Column:
    """Share of wrong bits where a[i + offset] lies beside b[i]."""
    first = F.greatest(F.lit(0), -offset)
    n = F.least(F.size(a) - offset, F.size(b)) - first
    x, y = F.slice(a, first + offset + 1, n), F.slice(b, first + 1, n)
    wrong = F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.cast("long").bitwiseXOR(q.cast("long")).bitwiseAND(F.lit(0xFFFFFFFF)))), F.lit(0), lambda s, v: s + v)
    return F.when(n > 0, wrong / (32.0 * n)).otherwise(1.0)


def probes(code: Column, doubts: Column) -> Column:
    """The integer, and those with one or two of its doubtful bits flipped."""
    bit = [F.call_function("shiftleft", F.lit(1), F.shiftright(doubts, 5 * k).bitwiseAND(F.lit(31)).cast("int")) for k in range(DOUBTS)]
    two = [bit[i].bitwiseXOR(bit[j]) for i in range(DOUBTS) for j in range(i)]
    return F.array(code, *[code.bitwiseXOR(b) for b in (*bit, *two)])


def _flat(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The values of lists on end, and where each begins, with the end of all."""
    ends = np.asarray(lists.offsets, np.int64)
    return lists.flatten(), ends - ends[0]


def _counted(sizes: np.ndarray) -> np.ndarray:
    """0 to n - 1 for each n of the sizes, on end."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _parts(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of neighbours with a sum of ``most`` at most, or of one."""
    sums, a = np.cumsum(sizes), 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(sums, most + (sums[a - 1] if a else 0), "right")))
        yield slice(a, b)
        a = b


class _Block:
    """Recordings: their numbers, and their integers on end."""

    def __init__(self, numbers: np.ndarray, codes: np.ndarray, begins: np.ndarray):
        self.numbers, self.codes, self.begins, self.sizes = numbers, codes, begins[:-1], np.diff(begins)

    def _cut(self, a: int, b: int) -> tuple[np.ndarray, ...]:
        begins = np.append(self.begins, len(self.codes))[a : b + 1]
        return self.numbers[a:b], self.codes[begins[0] : begins[-1]], begins - begins[0]


class _Held(_Block):
    """Recordings that are searched, with their postings (one for each run of one integer) in the order of the integers."""

    def __init__(self, *block: np.ndarray):
        super().__init__(*block)
        changed = np.ones(len(self.codes), bool)
        changed[1:] = self.codes[1:] != self.codes[:-1]
        changed[self.begins] = True
        places = np.flatnonzero(changed)
        self.places = places[np.argsort(self.codes[places])]
        self.sorted = self.codes[self.places]
        self.owners = np.searchsorted(self.begins, self.places, "right") - 1

    def halves(self) -> list[_Held]:
        n = len(self.numbers)
        return [_Held(*self._cut(a, b)) for a, b in ((0, n // 2), (n // 2, n))]


class _Asking(_Block):
    """Recordings that ask, with their probes (of a recording, at a frame) in the order of the integers."""

    def __init__(self, *block: np.ndarray, owners: np.ndarray, at: np.ndarray, probes: np.ndarray):
        super().__init__(*block)
        self.owners, self.at, self.probes = owners, at, probes

    @classmethod
    def probing(cls, *block: np.ndarray, owners: np.ndarray, at: np.ndarray, doubts: np.ndarray) -> _Asking:
        """The integers at these frames ask, as they are and with one or two of their doubtful bits flipped."""
        bits = [np.uint32(1) << (doubts >> (5 * k) & 31).astype(np.uint32) for k in range(DOUBTS)]
        flips = np.stack([np.zeros(len(at), np.uint32), *bits, *[bits[i] ^ bits[j] for i in range(DOUBTS) for j in range(i)]], axis=1)
        probes = (block[1][block[2][owners] + at][:, None] ^ flips).reshape(-1)
        order = np.argsort(probes)
        own = order // flips.shape[1]
        return cls(*block, owners=owners[own], at=at[own], probes=probes[order])

    def halves(self) -> list[_Asking]:
        n, out = len(self.numbers), []
        for a, b in ((0, n // 2), (n // 2, n)):
            own = (self.owners >= a) & (self.owners < b)
            out.append(_Asking(*self._cut(a, b), owners=self.owners[own] - a, at=self.at[own], probes=self.probes[own]))
        return out


def _wrong_bits(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Wrong bits where so many integers of a from x on lie beside those of b from y on."""
    out = np.zeros(len(sizes), np.int64)
    for part in _parts(sizes, HITS):
        n, run = sizes[part], _counted(sizes[part])
        bits = np.bitwise_count(a[np.repeat(x[part], n) + run] ^ b[np.repeat(y[part], n) + run])
        sums = np.concatenate(([0], np.cumsum(bits, dtype=np.int64)))
        ends = np.cumsum(n)
        out[part] = sums[ends] - sums[ends - n]
    return out


def _aligned_blocks(asking: _Asking, held: _Held) -> Iterator[pa.RecordBatch]:
    """q, r, offset, votes, bit_error of all pairs of two blocks that align, each at its best offset. Blocks with more than ``HITS`` hits are halved;
    of one pair of recordings the hits are counted in turns."""
    low = np.searchsorted(held.sorted, asking.probes, "left")
    n = np.searchsorted(held.sorted, asking.probes, "right") - low
    nq, nr = len(asking.numbers), len(held.numbers)
    if n.sum() > HITS and max(nq, nr) > 1:
        for a, h in [(x, held) for x in asking.halves()] if nq > 1 else [(asking, x) for x in held.halves()]:
            yield from _aligned_blocks(a, h)
        return
    # one key for a query, a recording and an offset
    base = int(held.sizes.max(initial=0))
    span = base + int(asking.sizes.max(initial=0))
    keys, votes = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for part in _parts(n, HITS):
        place = np.repeat(low[part], n[part]) + _counted(n[part])
        owner = held.owners[place]
        offset = np.repeat(asking.at[part], n[part]) - (held.places[place] - held.begins[owner])
        more = (np.repeat(asking.owners[part], n[part]) * nr + owner) * span + offset + base
        more, n_more = np.unique(more, return_counts=True)
        keys, same = np.unique(np.concatenate((keys, more)), return_inverse=True) if len(keys) else (more, np.arange(len(more)))
        votes = np.bincount(same, np.concatenate((votes, n_more)), len(keys)).astype(np.int64)
    i, j, offset = keys // span // nr, keys // span % nr, keys % span - base
    first = np.maximum(0, -offset)
    n = np.minimum(asking.sizes[i] - offset, held.sizes[j]) - first
    kept = np.flatnonzero((n >= LEAST_CODES) & (votes * VOTES >= n) & (asking.numbers[i] != held.numbers[j]))
    x, y, n = (asking.begins[i] + first + offset)[kept], (held.begins[j] + first)[kept], n[kept]
    # what has too many wrong bits in the first half has too many
    half = (n + 1) // 2
    wrong = _wrong_bits(asking.codes, held.codes, x, y, half)
    near = np.flatnonzero(wrong / (32.0 * n) <= MOST_ERRORS)
    wrong = wrong[near] + _wrong_bits(asking.codes, held.codes, (x + half)[near], (y + half)[near], (n - half)[near])
    kept, error = kept[near], wrong / (32.0 * n[near])
    near = np.flatnonzero(error <= MOST_ERRORS)
    kept, error = kept[near], error[near]
    i, j, offset, votes = i[kept], j[kept], offset[kept], votes[kept]
    order = np.lexsort((offset, np.abs(offset), -votes, error, j, i))
    best = order[np.concatenate(([True], (np.diff(i[order]) != 0) | (np.diff(j[order]) != 0)))[: len(order)]]
    columns = [asking.numbers[i[best]], held.numbers[j[best]], offset[best].astype(np.int32), votes[best], error[best]]
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["q", "r", "offset", "votes", "bit_error"])


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``_aligned_blocks`` of rows that hold a block of recordings and one of queries each."""

    def block(rows: pa.Array, name: str) -> tuple[np.ndarray, ...]:
        codes, begins = _flat(rows.field("codes"))
        return rows.field(name).to_numpy(), codes.to_numpy().view(np.uint32), begins

    last, held = None, None
    for batch in batches:
        for no, recordings, queries in zip(*(batch.column(c) for c in ("block", "recordings", "queries")), strict=True):
            if no.as_py() != last:
                last, held = no.as_py(), _Held(*block(recordings.values, "r"))
            asks, begins = _flat(queries.values.field("asks"))
            owners = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
            asking = _Asking.probing(*block(queries.values, "q"), owners=owners, at=asks.field("at").to_numpy().astype(np.int64), doubts=asks.field("doubts").to_numpy())
            yield from _aligned_blocks(asking, held)
    trimmed()


def aligned(classes: DataFrame, queries: DataFrame) -> DataFrame:
    """q, r, offset, votes, bit_error: for each query class (column q of ``queries``) every other class (r, codes,
    and, where it is a query's, doubts) that aligns with it, at the offset with the least bit error. Runs of one integer count once.

    Recordings and queries are dealt into blocks of about ``BLOCK`` and ``ASKING`` integers, and every block of recordings meets every block of
    queries in one task, which votes and checks there: hits and offsets are never rows, so what is written and shuffled grows with the recordings.
    """

    # two numbers below 2^31 travel as one long: what is shuffled is a row for every integer
    pair = lambda a, b: F.shiftleft(a.cast("long"), 32) + b
    high, low = lambda c: F.shiftright(c, 32).cast("int"), lambda c: c.bitwiseAND(F.lit((1 << 32) - 1)).cast("int")

    def runs(df: DataFrame, name: str, more: list[str]) -> DataFrame:
        before = F.concat(F.array(F.lit(None).cast("int")), F.slice("codes", 1, F.size("codes") - 1)).alias("before")
        rows = df.select(F.col("r").alias(name), F.size("codes").alias("_n"), F.posexplode(F.arrays_zip("codes", *more, before)).alias("_at", "_z"))
        changed = ~F.col("_z.codes").eqNullSafe(F.col("_z.before"))
        return rows.filter(changed).select(name, pair(F.col("_at"), F.col("_n")).alias(f"at_{name}"), F.col("_z.codes").alias("code"), *[F.col(f"_z.{c}").alias(c) for c in more])

    def blocks(df: DataFrame, n: int, rows: str) -> DataFrame:
        """So many blocks: block, and an array of the rows dealt to it."""
        dealt = df.groupBy(F.pmod(F.xxhash64(df.columns[0]), F.lit(n)).alias("block")).agg(F.collect_list(F.struct(*df.columns)).alias(rows))
        return written(dealt, f"audio-{rows}")

    classes = classes.filter(F.size("codes") >= LEAST_CODES)
    asked = classes.join(small(queries.select(F.col("q").alias("r")), queries.count()), "r", "left_semi")
    own = written(runs(asked, "q", ["doubts"]), "audio-asked")
    # how often a position's probes are held: sums over all recordings, a bounded number of classes
    kind = F.pmod(F.xxhash64("code"), F.lit(CLASSES)).cast("int").alias("_kind")
    held = runs(classes, "r", []).groupBy(kind).agg(F.count("*").alias("_held"))
    load = own.select("q", "at_q", "doubts", F.explode(probes(F.col("code"), F.col("doubts"))).alias("code")).withColumn("_kind", kind)
    load = load.join(F.broadcast(held), "_kind", "left").groupBy("q", "at_q", "doubts").agg(F.sum("_held").alias("_load"))
    turn = F.row_number().over(Window.partitionBy("q", F.floor(high(F.col("at_q")) / STRETCH)).orderBy("_load", "at_q"))
    rare = load.withColumn("_turn", turn).filter((F.col("_turn") <= RARE) | (low(F.col("at_q")) < SHORT))
    rare = rare.groupBy("q").agg(F.collect_list(F.struct(high(F.col("at_q")).alias("at"), "doubts")).alias("asks"))
    number = lambda df, size: -(-(df.agg(F.sum(F.size("codes"))).first()[0] or 1) // size)
    asking = blocks(asked.select(F.col("r").alias("q"), "codes").join(rare, "q"), number(asked, ASKING), "queries").drop("block")
    both = blocks(classes.select("r", "codes"), number(classes, BLOCK), "recordings").crossJoin(asking)
    with arrow_batches(classes.sparkSession, 1):
        return written(both.mapInArrow(_products, "q long, r long, offset int, votes long, bit_error double"), "audio-aligned")


def aligned_exactly(classes: DataFrame, queries: DataFrame) -> DataFrame:
    """``aligned`` without votes: every offset of every pair is checked, so nothing that aligns is missed; ``votes`` counts the integers that are equal
    beside each other. Time grows with the integers of the queries times those of all classes; memory is a pair's two lists at a time, and all tasks share
    the pairs."""
    a = classes.filter(F.size("codes") >= LEAST_CODES).join(queries.select(F.col("q").alias("r")), "r", "left_semi")
    a, b = a.select(F.col("r").alias("q"), F.col("codes").alias("_a")), classes.filter(F.size("codes") >= LEAST_CODES).select("r", F.col("codes").alias("_b"))
    both = a.repartition(a.sparkSession.sparkContext.defaultParallelism, "q").crossJoin(b).filter("q <> r")
    both = both.withColumn("offset", F.explode(F.sequence(LEAST_CODES - F.size("_b"), F.size("_a") - LEAST_CODES)))
    rows = both.withColumn("bit_error", bit_error(F.col("_a"), F.col("_b"), F.col("offset"))).filter(F.col("bit_error") <= MOST_ERRORS)
    first = F.greatest(F.lit(0), -F.col("offset"))
    n = F.least(F.size("_a") - F.col("offset"), F.size("_b")) - first
    same = F.zip_with(F.slice("_a", first + F.col("offset") + 1, n), F.slice("_b", first + 1, n), lambda x, y: x == y)
    return _best(rows.select("q", "r", "offset", F.size(F.filter(same, lambda x: x)).cast("long").alias("votes"), "bit_error"))


def _best(rows: DataFrame) -> DataFrame:
    """Of the offsets (q, r, offset, votes, bit_error) of a pair the one with the least bit error."""
    best = F.min(F.struct("bit_error", (-F.col("votes")).alias("_votes"), F.abs("offset").alias("_far"), "offset")).alias("b")
    best = rows.groupBy("q", "r").agg(best)
    return best.select("q", "r", "b.offset", (-F.col("b._votes")).alias("votes"), "b.bit_error")


def search(recordings: DataFrame, id_: str, is_query: Column, exact: bool = False) -> DataFrame:
    """``recordings`` (id, of any type that has an order, seconds, codes, doubts) with class_id (smallest id of equal
    recordings), copies (their number), and for queries ``matches``, every other class that aligns (match_id, offset, votes,
    bit_error; the least bit error first, null if there is none), and the first of them in columns of its own. Members of
    a class share its class_id. Rows may share an id. ``exact`` checks every offset of every pair of classes instead of those with votes.
    """
    key = F.unhex(F.md5(F.concat_ws(",", F.col("seconds").cast("string"), F.col("codes").cast("array<string>")).cast("binary")))
    # doubtful bits are flipped on the queries' side alone: no other recording's are stored or shuffled
    rows = recordings.select(F.col(id_).alias("_id"), "seconds", "codes", F.when(is_query, F.col("doubts")).alias("doubts"), F.when(F.size("codes") > 0, key).alias("_key"), is_query.alias("_asks"))
    coded = written(rows, "audio-codes")
    whole = [F.min("_id").alias("class_id"), F.count("*").alias("copies"), F.bool_or("_asks").alias("_asks"), F.first("codes").alias("codes"), F.first("doubts", ignorenulls=True).alias("doubts")]
    classes = coded.filter("_key IS NOT NULL").groupBy("_key").agg(*whole)
    # short numbers for classes, fixed by writing them
    classes = written(classes.withColumn("r", F.monotonically_increasing_id()), "audio-classes")
    # from here on a recording's integers are its class's
    kept = written(coded.select("_id", "seconds", F.size("codes").alias("n_codes"), "_key", "_asks"), "audio-recordings")
    forget(coded)
    same = classes.select("_key", "class_id", "copies", "r")
    found = (aligned_exactly if exact else aligned)(classes.select("r", "codes", "doubts"), classes.filter("_asks").select(F.col("r").alias("q")))
    found = found.join(same.select("r", F.col("class_id").alias("match_id")), "r")
    each = F.struct("bit_error", (-F.col("votes")).alias("_votes"), "match_id", "offset")
    found = found.groupBy("q").agg(F.array_sort(F.collect_list(each)).alias("_all"))
    match = lambda m: F.struct(m["match_id"].alias("match_id"), m["offset"].alias("offset"), (-m["_votes"]).alias("votes"), m["bit_error"].alias("bit_error"))
    found = found.select(F.col("q").alias("r"), F.transform("_all", match).alias("matches"))
    found = found.select("r", "matches", F.expr("inline(slice(matches, 1, 1))"))
    out = kept.join(same.join(found, "r", "left").drop("r"), "_key", "left")
    asked = lambda c: F.when(F.col("_asks"), F.col(c)).alias(c)
    return out.select(F.col("_id").alias(id_), "seconds", "n_codes", F.lower(F.hex("_key")).alias("fingerprint"), "class_id", "copies", *map(asked, ("match_id", "offset", "votes", "bit_error", "matches")))
