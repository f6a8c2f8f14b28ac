"""Token-id files with bit-plane shuffled chunks.

A file holds consecutive documents' ids. Ids are cut into chunks of ``CHUNK_IDS``; a chunk is
transposed into byte planes, or bit planes, planes of zeros are left out, and every other plane is
compressed with zstandard. The document table (doc_id, ids) and the chunk index (offset, first id,
number of ids of each chunk) close the file, so a reader finds any document's chunks directly.

    chunk    u32 bytes that follow | u32 ids | u8 planes | u8 bit planes? | u32 bytes of each plane (0: zeros) | planes
    tables   zstandard of: i64 doc_id, u8 doc_id is null?, i64 ids for each document; i64 offset, first id, ids for each chunk
    trailer  u64 offset of tables | u64 documents | u64 chunks | b"BITPLANE"
    A line feed follows each chunk and the trailer: Spark's own writer ends its rows so, and with it files reach every store.

Files are written by Spark tasks, one for each range of doc_ids, and are read through Spark's
binary source, so nothing passes through the driver and a lost task is done again whole.

Defined results: a null or empty text has only the end id; a null doc_id sorts first; repeated
rows are written each; an empty table gives no documents; other columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexlake.llm.common import arrow_rows, shared_dir, small, written
from lexlake.llm.encoding import WORD_VOCAB, Encoder, pieces

CHUNK_IDS = 1 << 16
END_ID = 1
MAGIC = b"BITPLANE"
_HEAD, _TRAILER = struct.Struct("<IIBB"), struct.Struct("<QQQ8s")


def pack_chunk(ids: np.ndarray, bits: bool = False, level: int = 3) -> bytes:
    """A chunk of uint32 ids as byte planes, or as bit planes."""
    octets = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    rows = np.unpackbits(octets, axis=1, bitorder="little").T if bits else octets.T
    press = zstandard.ZstdCompressor(level=level)
    planes = [press.compress(np.packbits(r).tobytes() if bits else r.tobytes()) if r.any() else b"" for r in rows]
    body = struct.pack(f"<{len(planes)}I", *map(len, planes)) + b"".join(planes)
    return _HEAD.pack(_HEAD.size - 4 + len(body), len(ids), len(planes), bits) + body


def unpack_chunk(data: bytes, at: int = 0) -> np.ndarray:
    """The ids of the chunk at an offset."""
    _, n, planes, bits = _HEAD.unpack_from(data, at)
    sizes = struct.unpack_from(f"<{planes}I", data, at + _HEAD.size)
    at += _HEAD.size + 4 * planes
    rows = np.zeros((planes, n), np.uint8)
    plain = zstandard.ZstdDecompressor()
    for k, size in enumerate(sizes):
        if size:
            raw = np.frombuffer(plain.decompress(data[at : at + size]), np.uint8)
            rows[k] = np.unpackbits(raw, count=n) if bits else raw
            at += size
    octets = np.packbits(rows.T, axis=1, bitorder="little") if bits else np.ascontiguousarray(rows.T)
    return octets.reshape(-1).view("<u4").astype(np.uint32)


class FileBuilder:
    """Gathers documents; ``rows`` are the file's parts in order, each to be followed by a line feed."""

    def __init__(self, chunk_ids: int, bits: bool):
        self.chunk_ids, self.bits = chunk_ids, bits
        self.doc_ids: list[int | None] = []
        self.sizes: list[int] = []
        self.index: list[tuple[int, int, int]] = []
        self.rest, self.held, self.at, self.first = [], 0, 0, 0

    def add(self, doc_ids: list[int | None], ids: np.ndarray, sizes: np.ndarray) -> Iterator[bytes]:
        self.doc_ids += doc_ids
        self.sizes += sizes.tolist()
        self.rest.append(ids)
        self.held += len(ids)
        if self.held >= self.chunk_ids:
            whole = np.concatenate(self.rest)
            n = len(whole) - len(whole) % self.chunk_ids
            for k in range(0, n, self.chunk_ids):
                yield self._chunk(whole[k : k + self.chunk_ids])
            self.rest, self.held = [whole[n:]], len(whole) - n

    def _chunk(self, ids: np.ndarray) -> bytes:
        data = pack_chunk(ids, self.bits)
        self.index.append((self.at, self.first, len(ids)))
        self.at, self.first = self.at + len(data) + 1, self.first + len(ids)
        return data

    def close(self) -> Iterator[bytes]:
        if not self.doc_ids:
            return
        if self.held:
            yield self._chunk(np.concatenate(self.rest))
        docs = np.array([i or 0 for i in self.doc_ids], "<i8").tobytes() + np.array([i is None for i in self.doc_ids], np.uint8).tobytes()
        tables = docs + np.array(self.sizes, "<i8").tobytes() + np.array(self.index, "<i8").tobytes()
        yield zstandard.ZstdCompressor().compress(tables) + _TRAILER.pack(self.at, len(self.doc_ids), len(self.index), MAGIC)


def read_file(data: bytes) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """doc_id, start in the file and ids of every document of a file, in order."""
    tables_at, docs, chunks, magic = _TRAILER.unpack_from(data, len(data) - _TRAILER.size - 1)
    if magic != MAGIC:
        raise ValueError("not a token-id file")
    raw = zstandard.ZstdDecompressor().decompress(data[tables_at : len(data) - _TRAILER.size - 1], max_output_size=17 * docs + 24 * chunks)
    doc_ids = np.frombuffer(raw, "<i8", docs)
    missing = np.frombuffer(raw, np.uint8, docs, 8 * docs)
    ends = np.cumsum(np.frombuffer(raw, "<i8", docs, 9 * docs))
    index = np.frombuffer(raw, "<i8", 3 * chunks, 17 * docs).reshape(-1, 3)
    buffer, at, k = np.zeros(0, np.uint32), 0, 0
    for i, end in enumerate(ends.tolist()):
        start = int(ends[i - 1]) if i else 0
        if at + len(buffer) < end:
            more = [buffer[start - at :]]
            held = len(more[0])
            while start + held < end:
                more.append(unpack_chunk(data, int(index[k, 0])))
                held, k = held + len(more[-1]), k + 1
            buffer, at = np.concatenate(more), start
        yield None if missing[i] else int(doc_ids[i]), start, buffer[start - at : end - at]


def write_token_files(docs: DataFrame, path: str, vocabulary: str = WORD_VOCAB, end_id: int = END_ID, bits: bool = False, chunk_ids: int = CHUNK_IDS, file_chars: int = 32_000_000) -> None:
    """Write files under ``path`` whose names sort as their doc_ids do, of about ``file_chars`` characters of text each."""
    arrow_rows(docs.sparkSession)
    chars = docs.agg(F.sum(F.char_length("text"))).first()[0] or 0
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # the two last keys spread and order rows that share a doc_id
    keys = ["doc_id", F.xxhash64("text"), F.monotonically_increasing_id()]
    rows = rows.repartitionByRange(max(1, chars // file_chars), *keys).sortWithinPartitions("doc_id", F.xxhash64("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, built = Encoder(vocabulary), FileBuilder(chunk_ids, bits)
        for b in batches:
            for doc_ids, texts in pieces(b):
                ids, starts = enc.encode(texts, end_id)
                for part in built.add(doc_ids.to_pylist(), ids, np.diff(starts)):
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.binary())], ["part"])
        for part in built.close():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.binary())], ["part"])

    parts = rows.mapInArrow(encode, "part binary")
    parts.select(F.col("part").cast("string").alias("value")).write.option("lineSep", "\n").text(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """file (its number), doc_id, start (ids before it in its file), n_tokens, ids (binary: little-endian uint32)."""
    files = spark.read.format("binaryFile").load(path).filter("length > 0")
    files = files.select(F.regexp_extract("path", r"part-(\d+)", 1).cast("int").alias("file"), "content")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, data in zip(b.column("file"), b.column("content"), strict=True):
                rows, held = [], 0
                for doc_id, start, ids in read_file(data.as_py()):
                    rows.append((doc_id, start, len(ids), ids.astype("<u4").tobytes()))
                    held += len(ids)
                    if held > 1_000_000:
                        yield batch(number.as_py(), rows)
                        rows, held = [], 0
                if rows:
                    yield batch(number.as_py(), rows)

    def batch(number: int, rows: list[tuple]) -> pa.RecordBatch:
        doc_ids, starts, sizes, ids = zip(*rows, strict=True)
        columns = [pa.array([number] * len(rows), pa.int32()), *(pa.array(x, pa.int64()) for x in (doc_ids, starts, sizes)), pa.array(ids, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["file", "doc_id", "start", "n_tokens", "ids"])

    return files.mapInArrow(decode, "file int, doc_id long, start long, n_tokens long, ids binary")


def round_trip(docs: DataFrame, **params) -> DataFrame:
    """Write token-id files of ``docs`` to the shared folder, read them back, and return for each document
    doc_id, start (ids of all documents before it), n_tokens and ids_crc32."""
    spark = docs.sparkSession
    path = shared_dir(spark, "token-files")
    write_token_files(docs, path, **params)
    rows = read_token_files(spark, path).select("file", "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    rows = written(rows, "token-digests")
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("_n"))
    files = files.select("file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rows = rows.join(small(files, files.count()), "file")
    return rows.select("doc_id", (F.col("start") + F.col("_before")).alias("start"), "n_tokens", "ids_crc32")
