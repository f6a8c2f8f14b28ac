"""Lexical retrieval packing: windows filled with documents that BM25 finds alike.

Texts are encoded once, into a table of ids; on the way each task counts its documents, their ids and
the documents of every id, so all scores have the document frequencies and the mean length of the
corpus. Documents are then laid in order of their content: each has two keys, the ids that two random
orders, weighted by rarity, put first (equal with the chance of the texts' weighted Jaccard
similarity), and ranges of (key, key, place in the input) are dealt to tasks, so that a key with many
documents is split. Runs of neighbours in that order, bounded in rows and bytes, are shards.

A document first fills windows of its own; what is left of it, its tail, joins the shard's pool. An
inverted index over the shard's whole texts gives BM25 scores: each unused tail in turn is a seed, its
best unused neighbours follow it into its window, and the last to fit is cut, its rest staying in the
pool. What a shard's last window leaves open is cut into powers of two. So no position is padding.
Sequence ids hold the partition in their upper bits.

Defined results: a null or empty text is its end id alone; repeated rows and null doc_ids are
packed each; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexlake.llm.common import arrow_rows, trimmed, written
from lexlake.llm.encoding import BYTE_VOCAB, Encoder, pieces

WINDOW = 2048
END_ID = 1
SHARD_ROWS, SHARD_BYTES = 512, 4_000_000
K1, B = 1.2, 0.75


@dataclass(frozen=True)
class Corpus:
    """Number of documents, ids in all of them, and by id the number of documents that hold it."""

    docs: int
    tokens: int
    df: np.ndarray

    def idf(self, df: np.ndarray) -> np.ndarray:
        return np.maximum(0.0, np.log((self.docs - df + 0.5) / (df + 0.5)))

    def orders(self, keys: int = 2) -> np.ndarray:
        """For each key the ranks of all ids in a random order where rare ones tend to be first; ids that one document
        alone holds, or half of all, have the last rank."""
        idf = self.idf(self.df)
        drawn = np.random.default_rng(11).exponential(size=(keys, len(idf)))
        drawn = np.divide(drawn, idf, out=np.full_like(drawn, np.inf), where=(idf > 0) & (self.df > 1))
        ranks = drawn.argsort(axis=1, kind="stable").argsort(axis=1, kind="stable")
        return np.where(np.isinf(drawn), len(idf), ranks)


def _begins(ordered: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate((np.ones(min(1, len(ordered)), bool), ordered[1:] != ordered[:-1])))


def _counted(terms: np.ndarray, owners: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct term * n + owner in order, owners being below n, and how often each occurs; in 32 bits where they suffice."""
    small = len(terms) == 0 or (int(terms.max()) + 1) * n < 1 << 31
    keys = terms.astype(np.int32 if small else np.int64)
    keys *= n
    keys += owners.astype(keys.dtype)
    keys.sort()
    first = _begins(keys)
    return keys[first], np.diff(first, append=len(keys))


class Bm25:
    """An inverted index over documents given as ids; scores of all for one of them. Document frequencies and the mean
    length are those of ``corpus``, or else of the documents themselves."""

    def __init__(self, docs: list[np.ndarray], corpus: Corpus | None = None):
        sizes = np.fromiter(map(len, docs), np.int64, len(docs))
        self.n = len(docs)
        terms = np.concatenate(docs) if docs else np.zeros(0, np.uint16)
        keys, tf = _counted(terms, np.repeat(np.arange(self.n), sizes), self.n)
        terms, self.docs = keys // max(1, self.n), (keys % max(1, self.n)).astype(np.intp)
        # keys are in order, so a term's are on end
        self.first = _begins(terms)
        self.df = np.diff(self.first, append=len(terms))
        self.vocabulary = terms[self.first]
        of = corpus or Corpus(self.n, int(sizes.sum()), self.df)
        idf = of.idf(corpus.df[self.vocabulary] if corpus else self.df)
        norm = K1 * (1 - B + B * sizes / max(1.0, of.tokens / max(1, of.docs)))
        self.weight = np.repeat(idf, self.df) * tf * (K1 + 1) / (tf + norm[self.docs])
        self.useful = idf > 0
        by_doc = np.argsort(self.docs.astype(np.uint16 if self.n < 1 << 16 else np.int64), kind="stable")
        number = np.repeat(np.arange(len(self.vocabulary), dtype=np.int32), self.df)
        self.of_doc = np.split(number[by_doc], np.cumsum(np.bincount(self.docs, minlength=self.n))[:-1])

    def scores(self, doc: int) -> np.ndarray:
        """BM25 of every document for the terms of ``doc``; terms in half of all or more say nothing."""
        terms = self.of_doc[doc]
        terms = terms[self.useful[terms]]
        df = self.df[terms]
        ends = np.cumsum(df)
        if not len(ends):
            return np.zeros(self.n)
        at = np.arange(ends[-1]) + np.repeat(self.first[terms] - (ends - df), df)
        return np.bincount(self.docs[at], self.weight[at], self.n)


@dataclass
class Pieces:
    """Pieces of a shard: document, start, length, sequence, offset."""

    rows: list[tuple[int, int, int, int, int]] = field(default_factory=list)
    sequence: int = 0

    def fill(self, pieces: list[tuple[int, int, int]]) -> None:
        at = 0
        for doc, start, length in pieces:
            self.rows.append((doc, start, length, self.sequence, at))
            at += length
        self.sequence += 1


def pack_shard(docs: list[np.ndarray], window: int = WINDOW, corpus: Corpus | None = None) -> Pieces:
    """Pack one shard's documents, each with at least one id."""
    out, start, left = Pieces(), np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64)
    for d, ids in enumerate(docs):
        whole = len(ids) - len(ids) % window
        for s in range(0, whole, window):
            out.fill([(d, s, window)])
        start[d], left[d] = whole, len(ids) - whole
    index = Bm25(docs, corpus)
    for seed in range(len(docs)):
        if not left[seed]:
            continue
        pieces, room = [(seed, int(start[seed]), int(left[seed]))], window - int(left[seed])
        left[seed] = 0
        scores = np.where(left > 0, index.scores(seed), -1.0) if room else None
        while room and (best := int(scores.argmax())) >= 0 and scores[best] >= 0:
            n = min(room, int(left[best]))
            pieces.append((best, int(start[best]), n))
            start[best], left[best], room, scores[best] = start[best] + n, left[best] - n, room - n, -1.0
        if room:
            _in_powers(out, pieces, window)
        else:
            out.fill(pieces)
    return out


def _in_powers(out: Pieces, pieces: list[tuple[int, int, int]], window: int) -> None:
    """Lay pieces into sequences whose lengths are powers of two, largest first."""
    total = sum(n for *_, n in pieces)
    power = 1 << max(0, window.bit_length() - 1)
    queue = list(reversed(pieces))
    while total:
        while power > total:
            power >>= 1
        room, now = power, []
        while room:
            doc, s, n = queue.pop()
            take = min(room, n)
            now.append((doc, s, take))
            if take < n:
                queue.append((doc, s + take, n - take))
            room -= take
        out.fill(now)
        total -= power


SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
#: A row is a document, or at the end of each task the counts of its documents.
ENCODED = "doc_id long, place long, ids binary, wide boolean, docs long, tokens long, terms array<int>, df array<long>"


def encoded(docs: DataFrame, vocabulary: str = BYTE_VOCAB, end_id: int = END_ID) -> DataFrame:
    """Rows of ENCODED: every document's place in the input, ids (little-endian, of 4 bytes if wide, else of 2), and the counts."""
    types = [pa.int64(), pa.int64(), pa.binary(), pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())]
    names = [f.split()[0] for f in ENCODED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, first = Encoder(vocabulary), TaskContext.get().partitionId() << 32
        df, n, tokens = np.zeros(1, np.int64), 0, 0
        for b in batches:
            for doc_ids, texts in pieces(b, 1_000_000):
                ids, starts = enc.encode(texts, end_id)
                pairs, _ = _counted(ids, np.repeat(np.arange(len(texts)), np.diff(starts)), len(texts))
                found = np.bincount(pairs // len(texts), minlength=len(df))
                found[: len(df)] += df
                df, tokens = found, tokens + len(ids)
                wide = np.maximum.reduceat(ids, starts[:-1]) >= 1 << 16
                octets = [x.astype("<u4" if w else "<u2").tobytes() for x, w in zip(np.split(ids, starts[1:-1]), wide, strict=True)]
                places = pa.array(np.arange(n, n + len(texts)) + first)
                n += len(texts)
                yield pa.RecordBatch.from_arrays([doc_ids, places, pa.array(octets, pa.binary()), pa.array(wide), *(pa.nulls(len(texts), t) for t in types[4:])], names)
        terms = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip([None, None, None, None, n, tokens, terms, df[terms]], types, strict=True)], names)
        del enc
        trimmed()

    arrow_rows(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, ENCODED)


def counted(table: DataFrame) -> Corpus:
    """The corpus of an ``encoded`` table; the driver gets a row for each id of the vocabulary."""
    counts = table.filter("docs IS NOT NULL")
    n = counts.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    per = counts.select(F.explode(F.arrays_zip("terms", "df")).alias("x")).groupBy("x.terms").agg(F.sum("x.df").alias("df")).collect()
    df = np.zeros(1 + max((r["terms"] for r in per), default=0), np.int64)
    df[[r["terms"] for r in per]] = [r["df"] for r in per]
    return Corpus(n[0], n[1], df)


def _ids(b: pa.RecordBatch) -> Iterator[np.ndarray]:
    """The ids of every row of an ``encoded`` table's batch."""
    return (np.frombuffer(x.as_buffer(), "<u4" if w else "<u2") for x, w in zip(b.column("ids"), b.column("wide").to_pylist(), strict=True))


def _shards(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[list[int | None], list[np.ndarray]]]:
    """doc_ids and ids of so many rows on end, however they come in batches; fewer where they are large."""
    doc_ids, docs, held = [], [], 0
    for b in batches:
        for doc_id, ids in zip(b.column("doc_id").to_pylist(), _ids(b), strict=True):
            if docs and (len(docs) == rows or held + 4 * len(ids) > SHARD_BYTES):
                yield doc_ids, docs
                doc_ids, docs, held = [], [], 0
            doc_ids.append(doc_id)
            docs.append(ids)
            held += 4 * len(ids)
    if docs:
        yield doc_ids, docs


def pack(docs: DataFrame, window: int = WINDOW, vocabulary: str = BYTE_VOCAB, end_id: int = END_ID, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (binary: little-endian uint32), doc_tokens, sequence_id, offset."""
    table = written(encoded(docs, vocabulary, end_id), "packing-ids")
    corpus = counted(table)
    orders = corpus.orders().astype(np.int32)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [*_ids(b), np.zeros(0, np.uint16)]
            ids, at = np.concatenate(found), np.cumsum([0, *map(len, found)])[:-2]
            keys = [pa.array(np.minimum.reduceat(o[ids], at) if len(at) else np.zeros(0, np.int32)) for o in orders]
            yield pa.RecordBatch.from_arrays([*b.columns, *keys], ["doc_id", "place", "ids", "wide", "key", "next_key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 32
        for doc_ids, shard in _shards(batches, shard_rows):
            packed = pack_shard(shard, window, corpus)
            doc, start, length, seq, offset = (np.array(x, np.int64) for x in zip(*packed.rows, strict=True))
            octets = [shard[d][s : s + n].astype("<u4").tobytes() for d, s, n in zip(doc.tolist(), start.tolist(), length.tolist(), strict=True)]
            sizes = np.fromiter(map(len, shard), np.int64, len(shard))[doc]
            columns = [pa.array(doc_ids, pa.int64()).take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(octets, pa.binary()), pa.array(sizes), pa.array(seq + sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
            sequence += packed.sequence
        trimmed()

    rows = table.filter("docs IS NULL").select("doc_id", "place", "ids", "wide").mapInArrow(keyed, "doc_id long, place long, ids binary, wide boolean, key int, next_key int")
    order = ["key", "next_key", "place"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "ids", "wide").mapInArrow(run, SCHEMA)


def report(docs: DataFrame, **params) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    rows = pack(docs, **params)
    return rows.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
