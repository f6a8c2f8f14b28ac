"""Cross-tokenizer alignment: where tokens of two vocabularies end together, and how usual the pairs that do are.

Side A is a byte-level vocabulary, side B a sentencepiece model; both read a text behind one space. Byte offsets at which tokens of both
end cut a text into groups, and the two tokens that end there are linked. Tokens are never empty, so a group's end is one link.

One pass over the texts writes, for each batch of documents, their counts, and the multiplicities of their id pairs as postings dealt into
``BUCKETS`` by B's id. Pair counts are summed map-side first. Then postings and counts are cogrouped: both are shuffled by B's id (its
bucket, and a salt where a bucket has more postings than a task should read), sorted by Spark so that a task streams its counts first and
then its postings batch by batch, finds each B id's highest count, and emits one array of contributions for each batch. These are shuffled
by batch and summed beside the documents' rows. A task holds the counts of its B ids, which the vocabularies bound, and one batch.

Defined results: texts that are null, empty, or not given back whole by the tokens of either side have no tokens, zeros and an empty digest;
repeated rows and rows without doc_id count each; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexlake.llm.common import arrow_rows, forget, written
from lexlake.llm.encoding import BYTE_VOCAB, Encoder, PieceEncoder, byte_level_tokens, piece_tokens, pieces

PIECE_VOCAB = "piece_bpe_32k.model"
BUCKETS = 256
#: Bytes of packed postings of a bucket that one task reads, about; a bucket with more is salted.
TASK_BYTES = 32_000_000
#: Bits of an id of side A in a pair, and of a document's place in its batch.
A_BITS, DOC_BITS = 20, 16
NO_IDS = np.zeros(0, np.int64)


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed string: their numbers of bytes, then themselves."""
    raw = [np.ascontiguousarray(a).tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(np.array([len(raw), *map(len, raw)], "<u8").tobytes() + b"".join(raw))


def unpacked(data: bytes, *kinds: str) -> list[np.ndarray]:
    """The arrays of ``packed``."""
    raw = zstandard.ZstdDecompressor().decompress(data)
    ends = np.cumsum(np.frombuffer(raw, "<u8", len(kinds), 8)).astype(np.int64) + 8 * (1 + len(kinds))
    return [np.frombuffer(raw, k, (e - s) // np.dtype(k).itemsize, s) for k, s, e in zip(kinds, [8 * (1 + len(kinds)), *ends[:-1].tolist()], ends.tolist(), strict=True)]


class Aligner:
    """Both tokenizers, and the bytes and decimal forms of their ids."""

    def __init__(self, a: str = BYTE_VOCAB, b: str = PIECE_VOCAB):
        self.a, self.b = Encoder(a, special_as_text=True), PieceEncoder(b)
        sides = [byte_level_tokens(self.a.tokenizer), piece_tokens(self.b.model)]
        self.size_a, self.size_b = map(len, sides)
        self.tokens = [pa.array(s, pa.large_binary()) for s in sides]
        self.lengths = [np.array(list(map(len, s)), np.int64) for s in sides]
        forms = [[f"{i}{end}" for i in range(n)] for n, ends in ((self.size_a, ",|"), (self.size_b, (",", ";", ""))) for end in ends]
        self.forms = pa.array([x for f in forms for x in f], pa.large_binary())

    def _same(self, side: int, ids: np.ndarray, starts: np.ndarray, want: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether each text's tokens give its bytes."""
        ends = np.concatenate(([0], np.cumsum(self.lengths[side][ids])))[starts]
        data = self.tokens[side].take(pa.array(ids)).buffers()[2]
        got = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        same = np.diff(ends) == np.diff(at)
        if same.all():
            wrong = np.concatenate(([0], np.cumsum(got[: ends[-1]] != want)))
            return wrong[at[1:]] == wrong[at[:-1]]
        for i in np.flatnonzero(same).tolist():
            same[i] = np.array_equal(got[ends[i] : ends[i + 1]], want[at[i] : at[i + 1]])
        return same

    def align(self, texts: pa.Array) -> dict:
        """Of a batch of texts: ``valid``, ``n_a``, ``n_b``, ``n_links`` and ``digest`` for each, and its links as arrays ``doc``, ``a``, ``b``."""
        n = len(texts)
        given = pc.fill_null(pc.not_equal(texts, ""), False).to_numpy(zero_copy_only=False)
        texts = pc.fill_null(texts.cast(pa.large_string()), "").filter(pa.array(given))
        spaced = pc.binary_join_element_wise(pa.scalar(" ", texts.type), texts, pa.scalar("", texts.type))
        (ids_a, at_a), (ids_b, at_b) = self.a.encode(spaced), self.b.encode(texts)
        at = np.concatenate(([0], np.cumsum(pc.binary_length(spaced).to_numpy()))).astype(np.int64)
        data = pa.concat_arrays([spaced]).buffers()[2]
        want = np.frombuffer(data, np.uint8)[: at[-1]] if data is not None else np.zeros(0, np.uint8)
        same = self._same(0, ids_a, at_a, want, at) & self._same(1, ids_b, at_b, want, at)
        sizes = [np.diff(at_a), np.diff(at_b)]
        if not same.all():
            ids_a, ids_b = ids_a[np.repeat(same, sizes[0])], ids_b[np.repeat(same, sizes[1])]
        place = np.flatnonzero(given)[same]
        sizes = [s[same] for s in sizes]
        ends = [np.cumsum(self.lengths[0][ids_a]), np.cumsum(self.lengths[1][ids_b])]
        marks = [np.zeros(int(at[-1]) + 1, bool) for _ in ends]
        for mark, e in zip(marks, ends, strict=True):
            mark[e] = True
        last_a, last_b = marks[1][ends[0]], marks[0][ends[1]]
        own = np.repeat(np.arange(len(place)), sizes[1])
        out = {"valid": np.zeros(n, bool), "n_a": np.zeros(n, np.int64), "n_b": np.zeros(n, np.int64), "n_links": np.zeros(n, np.int64), "digest": [""] * n}
        out["valid"][place], out["n_a"][place], out["n_b"][place] = True, sizes[0], sizes[1]
        out["n_links"][place] = np.bincount(own[last_b], minlength=len(place))
        for i, digest in zip(place.tolist(), self._digests(ids_a, ids_b, last_a, last_b, sizes), strict=True):
            out["digest"][i] = digest
        return out | {"doc": place[own[last_b]], "a": ids_a[last_a].astype(np.int64), "b": ids_b[last_b].astype(np.int64)}

    def _digests(self, ids_a: np.ndarray, ids_b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray, sizes: list[np.ndarray]) -> Iterator[str]:
        """Digest of each text's groups: the ids' decimal forms, each with what follows it, in the groups' order."""
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        before_b = np.concatenate(([0], np.flatnonzero(last_b) + 1))
        upto_a = np.flatnonzero(last_a) + 1
        end = last_b.astype(np.int64)
        end[np.cumsum(sizes[1]) - 1] = 2
        forms = np.empty(len(ids_a) + len(ids_b), np.int64)
        forms[np.arange(len(ids_a)) + before_b[group_a]] = ids_a + last_a * self.size_a
        forms[np.arange(len(ids_b)) + upto_a[group_b]] = ids_b + end * self.size_b + 2 * self.size_a
        _, offsets, data = self.forms.take(pa.array(forms)).buffers()
        cuts = np.frombuffer(offsets, np.int64)[np.concatenate(([0], np.cumsum(sizes[0] + sizes[1])))].tolist()
        data = memoryview(data or b"")
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield hashlib.sha256(data[a:b]).hexdigest()


def _postings(found: dict) -> Iterator[tuple[int, bytes]]:
    """Bucket and packed postings of a batch's links: distinct pairs (b's upper part and a, as differences), documents of each, documents
    (as differences within a pair) and multiplicities."""
    b = found["b"]
    key = ((b % BUCKETS) << 48 | (b // BUCKETS) << (A_BITS + DOC_BITS) | found["a"] << DOC_BITS | found["doc"]).astype(np.int64)
    key.sort()
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else NO_IDS
    times = np.diff(np.append(first, len(key)))
    key = key[first]
    bucket = key >> 48
    cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(key) else NO_IDS
    for s, e in zip(cuts.tolist(), np.append(cuts, len(key))[1:].tolist(), strict=True):
        pair, doc = (key[s:e] & ((1 << 48) - 1)) >> DOC_BITS, key[s:e] & ((1 << DOC_BITS) - 1)
        head = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
        gaps = np.diff(doc, prepend=0)
        gaps[head] = doc[head]
        yield int(bucket[s]), packed(np.diff(pair[head], prepend=0).astype("<u4"), np.diff(np.append(head, e - s)).astype("<u4"), gaps.astype("<u2"), times[s:e].astype("<u4"))


def _read(bucket: int, payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs (b << A_BITS | a, ascending), documents of each, documents, multiplicities."""
    pair, docs_of, gaps, times = unpacked(payload, "<u4", "<u4", "<u2", "<u4")
    pair, docs_of = np.cumsum(pair, dtype=np.int64), docs_of.astype(np.int64)
    total = np.cumsum(gaps, dtype=np.int64)
    head = np.cumsum(docs_of) - docs_of
    doc = total - np.repeat(total[head] - gaps[head], docs_of)
    b = (pair >> A_BITS) * BUCKETS + bucket
    return b << A_BITS | pair & ((1 << A_BITS) - 1), docs_of, doc, times.astype(np.int64)


ENCODED = "batch long, bucket int, payload binary, place int, doc_id long, n_a long, n_b long, n_links long, digest string"


def encoded(docs: DataFrame, a: str = BYTE_VOCAB, b: str = PIECE_VOCAB) -> DataFrame:
    """A row for each document (bucket null) and a row for each batch and bucket with postings; a batch is one task's run of texts."""
    arrow_rows(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = pa.schema([("batch", pa.int64()), ("bucket", pa.int32()), ("payload", pa.binary()), ("place", pa.int32()), ("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_a", "n_b", "n_links")], ("digest", pa.string())])

    def batch(values: dict, n: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(values[f.name], f.type) if f.name in values else pa.nulls(n, f.type) for f in schema], schema=schema)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, number = Aligner(a, b), TaskContext.get().partitionId() << 32
        for x in batches:
            for doc_ids, texts in pieces(x):
                found = both.align(texts)
                n = len(doc_ids)
                yield batch({"batch": np.full(n, number), "place": np.arange(n), "doc_id": doc_ids, **{c: found[c] for c in ("n_a", "n_b", "n_links", "digest")}}, n)
                lists = list(_postings(found))
                if lists:
                    buckets, payloads = zip(*lists, strict=True)
                    yield batch({"batch": np.full(len(lists), number), "bucket": buckets, "payload": payloads}, len(lists))
                number += 1

    return rows.mapInArrow(encode, ENCODED)


def pair_counts(lists: DataFrame, most: int = 2_000_000) -> DataFrame:
    """pair (b << A_BITS | a), n (links that hold it linked) and best (n is b's highest), summed in each task first."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0

        def out() -> pa.RecordBatch:
            key, at = np.unique(np.concatenate(keys), return_inverse=True)
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.bincount(at, np.concatenate(counts)).astype(np.int64))], ["pair", "n"])

        for x in batches:
            for bucket, payload in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True):
                pair, docs_of, _, times = _read(bucket, payload)
                keys.append(pair)
                counts.append(np.add.reduceat(times, np.cumsum(docs_of) - docs_of))
                held += len(pair)
                if held > most:
                    done = out()
                    keys, counts, held = [done.column(0).to_numpy()], [done.column(1).to_numpy()], done.num_rows
                    if held > most // 2:
                        yield done
                        keys, counts, held = [], [], 0
        if keys:
            yield out()

    counts = lists.select("bucket", "payload").mapInArrow(sums, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    of_b = Window.partitionBy(F.shiftright("pair", A_BITS))
    return counts.withColumn("best", F.col("n") == F.max("n").over(of_b))


def contributions(lists: DataFrame, counts: DataFrame) -> DataFrame:
    """batch and packed (places, links that are their B id's best, sums of counts): one row of a batch for each task that holds postings of it."""
    sizes = lists.groupBy("bucket").agg(F.sum(F.octet_length("payload")).alias("bytes")).collect()
    salts = F.create_map(*[F.lit(x) for r in sizes for x in (r["bucket"], 1 + r["bytes"] // TASK_BYTES)]) if sizes else F.lit(None).cast("map<int,bigint>")
    bucket = (F.shiftright("pair", A_BITS) % BUCKETS).cast("int")
    counts = counts.withColumn("bucket", bucket).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts[F.col("bucket")] - 1)))
    lists = lists.select("batch", "bucket", "payload").withColumn("salt", F.pmod(F.xxhash64("batch"), salts[F.col("bucket")]))
    rows = lists.unionByName(counts, allowMissingColumns=True).select("bucket", "salt", "batch", "pair", "n", "best", "payload")
    rows = rows.repartition("bucket", "salt").sortWithinPartitions(F.asc_nulls_first("batch"), "pair")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ns, bests = [], [], []
        table = None
        at, best, total = None, np.zeros(1 << DOC_BITS, np.int64), np.zeros(1 << DOC_BITS, np.int64)

        def out() -> pa.RecordBatch:
            there = np.flatnonzero(total)
            row = packed(there.astype("<u2"), best[there].astype("<i8"), total[there].astype("<i8"))
            best[there] = total[there] = 0
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([row], pa.binary())], ["batch", "payload"])

        for x in batches:
            counted = x.filter(pc.is_valid(x.column("pair")))
            if counted.num_rows:
                keys.append(counted.column("pair").to_numpy())
                ns.append(counted.column("n").to_numpy())
                bests.append(counted.column("best").to_numpy(zero_copy_only=False))
            listed = x.filter(pc.is_valid(x.column("batch")))
            for number, bucket, payload in zip(listed.column("batch").to_pylist(), listed.column("bucket").to_pylist(), listed.column("payload").to_pylist(), strict=True):
                if table is None:
                    table = tuple(np.concatenate(c) for c in (keys, ns, bests))
                if at is not None and number != at:
                    yield out()
                at = number
                pair, docs_of, doc, times = _read(bucket, payload)
                k = np.searchsorted(table[0], pair)
                np.add.at(total, doc, times * np.repeat(table[1][k], docs_of))
                np.add.at(best, doc, times * np.repeat(table[2][k], docs_of))
        if at is not None:
            yield out()

    return rows.mapInArrow(sums, "batch long, payload binary")


def summed(documents: DataFrame, parts: DataFrame) -> DataFrame:
    """The documents' rows with n_best and count_sum, the sums of their batch's contributions."""
    rows = documents.drop("bucket", "payload").unionByName(parts, allowMissingColumns=True)
    rows = rows.repartition("batch").sortWithinPartitions("batch", F.asc_nulls_first("place"))
    columns = ["doc_id", "n_a", "n_b", "n_links", "digest"]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, best, total = None, np.zeros(1 << DOC_BITS, np.int64), np.zeros(1 << DOC_BITS, np.int64)

        for x in batches:
            numbers = x.column("batch").to_numpy()
            cuts = np.flatnonzero(np.diff(numbers)) + 1
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(numbers)], strict=True):
                if e == s:
                    continue
                if numbers[s] != at:
                    at = numbers[s]
                    best[:], total[:] = 0, 0
                part = x.slice(s, e - s)
                for payload in part.column("payload").drop_null().to_pylist():
                    place, b, t = unpacked(payload, "<u2", "<i8", "<i8")
                    best[place] += b
                    total[place] += t
                docs = part.filter(pc.is_valid(part.column("place")))
                if docs.num_rows:
                    place = docs.column("place").to_numpy()
                    yield pa.RecordBatch.from_arrays([*[docs.column(c) for c in columns], pa.array(best[place]), pa.array(total[place])], [*columns, "n_best", "count_sum"])

    return rows.mapInArrow(join, "doc_id long, n_a long, n_b long, n_links long, digest string, n_best long, count_sum long")


def report(docs: DataFrame, a: str = BYTE_VOCAB, b: str = PIECE_VOCAB) -> DataFrame:
    """Counts, digest of the groups and link statistics of every whole text."""
    whole = written(encoded(docs, a, b), "alignment-encoded")
    lists = whole.filter("bucket IS NOT NULL")
    counts = written(pair_counts(lists), "alignment-pairs")
    parts = written(contributions(lists, counts), "alignment-parts")
    rows = written(summed(whole.filter("bucket IS NULL"), parts), "alignment")
    forget(whole, counts, parts)
    return rows.select("doc_id", "n_a", "n_b", F.col("n_links").alias("n_groups"), "n_links", "n_best", "count_sum", F.col("digest").alias("groups_sha256"))
