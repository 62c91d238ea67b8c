"""Binary token files: patched frame-of-reference blocks with a block index.

A file holds the ids of a range of documents in ascending key order:

    blocks      per BLOCK ids: id - block minimum, packed at the block's width, then the exceptions
                (position as uint16 each, then difference as uint32 each)
    documents   int64 key, uint8 key is present, uint64 number of ids
    index       per block: uint64 start in the file, uint32 minimum, uint8 width, uint16 exceptions
    footer      uint64 starts of documents and index, uint64 number of documents, blocks and ids, magic

The width is what PERCENTILE of a block's differences need; larger ones are exceptions, stored whole. All numbers are
little-endian. The last block is padded with its minimum.

Files are written by the tasks that encode, into a fresh shared folder, under names of their own attempt; a manifest table,
written last, lists those that count, so a task that runs twice does no harm.

Defined cases: a null text is empty and gets only the end id; a null key comes first; rows with equal key keep one after
another; an empty table gives no file.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh_path, text_or_empty
from .tokens import encoder, slices

BLOCK = 256
PERCENTILE = 95
#: Ids packed or unpacked together.
SEGMENT = BLOCK * 512
MAGIC = b"SLPFOR01"
DOCUMENT = np.dtype([("key", "<i8"), ("present", "u1"), ("n", "<u8")])
INDEX = np.dtype([("start", "<u8"), ("low", "<u4"), ("width", "u1"), ("exceptions", "<u2")])
FOOTER = struct.Struct("<5Q8s")


def pack(ids: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The blocks of ids (uint32, padded to whole blocks), and their index without starts."""
    rows = ids.reshape(-1, BLOCK)
    low = rows.min(axis=1)
    delta = rows - low[:, None]
    limit = np.sort(delta, axis=1)[:, (BLOCK * PERCENTILE + 99) // 100 - 1]
    width = np.zeros(len(rows), np.uint8)
    for bit in range(32):
        width[limit >= (1 << bit)] = bit + 1
    outside = delta >= (np.uint64(1) << width.astype(np.uint64))[:, None]
    index = np.zeros(len(rows), INDEX)
    index["low"], index["width"], index["exceptions"] = low, width, outside.sum(axis=1)
    packed: list[bytes] = [b""] * len(rows)
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        if w:
            kept = np.where(outside[at], 0, delta[at]).astype("<u4")
            bits = np.unpackbits(kept.view(np.uint8).reshape(len(at), BLOCK, 4), axis=2, bitorder="little")[:, :, :w]
            for i, line in zip(at, np.packbits(bits.reshape(len(at), BLOCK * int(w)), axis=1, bitorder="little"), strict=True):
                packed[i] = line.tobytes()
    for i in np.flatnonzero(index["exceptions"]):
        where = np.flatnonzero(outside[i])
        packed[i] += where.astype("<u2").tobytes() + delta[i, where].astype("<u4").tobytes()
    return packed, index


def unpack(data: bytes, base: int, index: np.ndarray) -> np.ndarray:
    """The ids of the blocks of index; data starts at the file's place base."""
    rows = np.zeros((len(index), BLOCK), np.uint32)
    raw = np.frombuffer(data, np.uint8)
    starts = index["start"].astype(np.int64) - base
    for w in np.unique(index["width"]):
        at = np.flatnonzero(index["width"] == w)
        size = BLOCK * int(w) // 8
        if w:
            lines = raw[starts[at][:, None] + np.arange(size)]
            bits = np.zeros((len(at), BLOCK, 32), np.uint8)
            bits[:, :, :w] = np.unpackbits(lines, axis=1, bitorder="little").reshape(len(at), BLOCK, int(w))
            rows[at] = np.packbits(bits, axis=2, bitorder="little").view("<u4")[:, :, 0]
    for i in np.flatnonzero(index["exceptions"]):
        n, at = int(index["exceptions"][i]), int(starts[i]) + BLOCK * int(index["width"][i]) // 8
        rows[i, np.frombuffer(data, "<u2", n, at)] = np.frombuffer(data, "<u4", n, at + 2 * n)
    return (rows + index["low"][:, None]).reshape(-1)


class Writer:
    """Writes one file; ids come in document by document and leave in segments."""

    def __init__(self, sink):
        self.sink, self.place, self.n = sink, 0, 0
        self.held: list[bytes] = []
        self.held_n = 0
        self.docs: list[tuple] = []
        self.index: list[np.ndarray] = []

    def add(self, key: int | None, ids: bytes) -> None:
        self.docs.append((key or 0, key is not None, len(ids) // 4))
        self.held.append(ids)
        self.held_n += len(ids) // 4
        if self.held_n >= SEGMENT:
            self.flush(last=False)

    def flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.held), "<u4")
        whole = len(ids) // BLOCK * BLOCK
        rest = ids[whole:]
        if last and len(rest):
            ids, rest = np.concatenate([ids, np.full(-len(ids) % BLOCK, rest.min(), "<u4")]), ids[:0]
            whole = len(ids)
        self.n += self.held_n - len(rest)
        self.held, self.held_n = [rest.tobytes()], len(rest)
        for at in range(0, whole, SEGMENT):
            blocks, index = pack(ids[at : min(at + SEGMENT, whole)])
            index["start"] = self.place + np.concatenate([[0], np.cumsum([len(b) for b in blocks])[:-1]]).astype(np.uint64)
            self.index.append(index)
            data = b"".join(blocks)
            self.sink.write(data)
            self.place += len(data)

    def close(self) -> tuple[int, int]:
        self.flush(last=True)
        docs = np.array(self.docs, DOCUMENT).tobytes()
        index = np.concatenate(self.index) if self.index else np.zeros(0, INDEX)
        self.sink.write(docs + index.tobytes() + FOOTER.pack(self.place, self.place + len(docs), len(self.docs), len(index), self.n, MAGIC))
        return len(self.docs), self.n


class Reader:
    """Reads one file; `source` is seekable."""

    def __init__(self, source):
        self.source = source
        source.seek(source.size() - FOOTER.size)
        self.docs_at, self.index_at, docs, blocks, self.n, magic = FOOTER.unpack(source.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token file")
        source.seek(self.docs_at)
        self.docs = np.frombuffer(source.read(docs * DOCUMENT.itemsize), DOCUMENT)
        source.seek(self.index_at)
        self.index = np.frombuffer(source.read(blocks * INDEX.itemsize), INDEX)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids of places [start, stop), by way of the block index."""
        if start >= stop:
            return np.zeros(0, np.uint32)
        first, last = start // BLOCK, -(-stop // BLOCK)
        base = int(self.index["start"][first])
        end = int(self.index["start"][last]) if last < len(self.index) else self.docs_at
        self.source.seek(base)
        return unpack(self.source.read(end - base), base, self.index[first:last])[start - first * BLOCK : stop - first * BLOCK]

    def segments(self) -> Iterator[np.ndarray]:
        for start in range(0, self.n, SEGMENT):
            yield self.ids(start, min(start + SEGMENT, self.n))


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    """The store of a file or folder. Hadoop's names of S3 mean the same objects as the library's own; hdfs needs libhdfs on the workers."""
    for name in ("s3a://", "s3n://"):
        uri = uri.replace(name, "s3://", 1) if uri.startswith(name) else uri
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_token_files(docs: DataFrame, path: str, *, vocabulary: str, joined: bool, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes and writes docs in ascending key order below `path`; returns the manifest: file, uri, documents, tokens."""
    spark = docs.sparkSession

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, joined).encode
        part, end, writer = TaskContext.get().partitionId(), np.array([end_id], "<u4").tobytes(), None
        for rows, texts in slices(batches):
            if writer is None:
                store, folder = open_fs(f"{path}/files")
                store.create_dir(folder, recursive=True)
                name = f"{part:06d}-{uuid.uuid4().hex}.tok"
                sink = store.open_output_stream(f"{folder}/{name}")
                writer = Writer(sink)
            for k, ids in zip(rows.column("key").to_pylist(), encode(texts), strict=True):
                writer.add(k, ids + end)
        if writer is not None:
            n_docs, n = writer.close()
            sink.close()
            yield pa.RecordBatch.from_pydict({"file": [part], "uri": [f"{path}/files/{name}"], "documents": [n_docs], "tokens": [n]})

    rows = docs.select(F.col(key).cast("bigint").alias("key"), text_or_empty(text).alias("text"))
    tie = F.xxhash64("text")  # many rows may share a key, or have none
    ordered = rows.repartitionByRange("key", tie).sortWithinPartitions("key", tie)
    manifest = ordered.mapInArrow(write, "file long, uri string, documents long, tokens long")
    manifest.write.parquet(f"{path}/manifest")
    return read_manifest(spark, path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per file (as many as write tasks), with `start`, the ids of all files before it."""
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return spark.read.parquet(f"{path}/manifest").withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def read_token_files(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """key, start, n_tokens, ids_crc32 of every document, from the files; each is read segment by segment."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, name = open_fs(row["uri"])
                with store.open_input_file(name) as source:
                    reader = Reader(source)
                    ends = np.cumsum(reader.docs["n"].astype(np.int64))
                    sums, at, crc, doc = [], 0, 0, 0
                    for ids in reader.segments():
                        data, stop = memoryview(ids.astype("<u4").tobytes()), at + len(ids)
                        place = at
                        while doc < len(ends) and ends[doc] <= stop:
                            sums.append(zlib.crc32(data[4 * (place - at) : 4 * (int(ends[doc]) - at)], crc))
                            place, crc, doc = int(ends[doc]), 0, doc + 1
                        crc, at = zlib.crc32(data[4 * (place - at) :], crc), stop
                    n = reader.docs["n"].astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(reader.docs["key"], pa.int64(), mask=reader.docs["present"] == 0),
                            pa.array(row["start"] + ends - n, pa.int64()),
                            pa.array(n, pa.int64()),
                            pa.array(sums, pa.int64()),
                        ],
                        names=[key, "start", "n_tokens", "ids_crc32"],
                    )

    files = read_manifest(spark, path)
    return files.repartitionByRange(max(1, files.count()), "file").mapInArrow(read, f"`{key}` long, start long, n_tokens long, ids_crc32 long")


def token_file_round_trip(docs: DataFrame, *, vocabulary: str, joined: bool, end_id: int) -> DataFrame:
    path = fresh_path(docs.sparkSession, "tokens")
    write_token_files(docs, path, vocabulary=vocabulary, joined=joined, end_id=end_id)
    return read_token_files(docs.sparkSession, path)
