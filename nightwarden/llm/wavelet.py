"""Token ids of whole documents in wavelet matrix files.

A shard is one file that holds the ids of consecutive documents, in ascending doc_id order,
as a wavelet matrix: one bit-plane per bit of an id, each a stable partition of the one above.
With counts of set bits every 512 bits a plane answers rank and select, so the file gives any
token (`access`), how often an id occurs before a place (`rank`), where its k-th occurrence is
(`select`), and all ids of a stretch, without the ids themselves being stored.

Documents are range-partitioned by id, so files follow each other in that order; a task closes
a file after `shard_tokens` ids at the end of a document. A file's name is new for every
attempt, and only the table of files, written by Spark, says which ones count, so lost
executors and repeated tasks leave nothing wrong. Paths may be on any file system that pyarrow
knows.

File layout, little-endian: b"WMX1"; u32 planes, u64 tokens, u64 documents; then blocks of a
u64 size and a zstd frame: the documents' lengths (u32), their ids (i64, the least one for
NULL), and from the highest bit down each plane: its zeros (u64), then its bits, most
significant first.

Defined cases: a NULL or empty text is its end id alone; a NULL doc_id sorts first; rows that
share a doc_id are written one after the other; other columns are not read; an empty table
gives no file.
"""

from __future__ import annotations

import io
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from nightwarden.llm.tokens import encoder
from nightwarden.session import checkpoint_dir, checkpointed

MAGIC, STEP = b"WMX1", 512
TEXTS = 256
#: Ids after which a task closes a file; a document is never divided.
SHARD_TOKENS = 1 << 20
MAX_TASKS = 20_000


class WaveletMatrix:
    """A sequence of unsigned ids as bit-planes."""

    def __init__(self, size: int, planes: list[np.ndarray], zeros: list[int]):
        self.size, self.planes, self.zeros = size, planes, zeros
        self._ranks: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(planes)

    @classmethod
    def of(cls, ids: np.ndarray) -> WaveletMatrix:
        width = max(1, int(ids.max()).bit_length() if len(ids) else 1)
        ids = ids.astype(np.uint16 if width <= 16 else np.uint32)
        planes, zeros = [], []
        for bit in range(width - 1, -1, -1):
            ones = (ids & ids.dtype.type(1 << bit)) != 0
            planes.append(np.packbits(ones))
            low = ids.take(np.flatnonzero(~ones))  # several times faster than a mask
            zeros.append(len(low))
            ids = np.concatenate([low, ids.take(np.flatnonzero(ones))])
        return cls(len(ids), planes, zeros)

    def _bits(self, plane: int) -> np.ndarray:
        return np.unpackbits(self.planes[plane], count=self.size).view(bool)

    def _ones(self, plane: int, at: np.ndarray) -> np.ndarray:
        """Set bits before each place, from the counts every 512 bits and the bytes after them."""
        if self._ranks[plane] is None:
            rows = np.zeros((self.size // STEP + 1, STEP // 8), np.uint8)
            rows.reshape(-1)[: len(self.planes[plane])] = self.planes[plane]
            counts = np.bitwise_count(rows).sum(1, dtype=np.int64)
            self._ranks[plane] = rows, np.cumsum(counts) - counts
        rows, before = self._ranks[plane]
        at = np.asarray(at, np.int64)
        inside = np.unpackbits(rows[at // STEP], axis=-1) & (np.arange(STEP) < (at % STEP)[..., None])
        return before[at // STEP] + inside.sum(-1, dtype=np.int64)

    def access(self, at) -> np.ndarray:
        """The ids at the given places."""
        at = np.asarray(at, np.int64)
        out = np.zeros(at.shape, np.uint32)
        for plane, zeros in enumerate(self.zeros):
            one = (self.planes[plane][at >> 3].astype(np.int64) >> (7 - (at & 7)) & 1).astype(bool)
            ones = self._ones(plane, at)
            at = np.where(one, zeros + ones, at - ones)
            out = out << 1 | one
        return out

    def _range(self, symbol: int, end: int) -> tuple[int, int]:
        """Where the occurrences of an id before `end` lie below the last plane."""
        if symbol >> len(self.planes):
            return 0, 0
        start = 0
        for plane, zeros in enumerate(self.zeros):
            a, b = (int(x) for x in self._ones(plane, np.array([start, end])))
            if symbol >> (len(self.planes) - 1 - plane) & 1:
                start, end = zeros + a, zeros + b
            else:
                start, end = start - a, end - b
        return start, end

    def rank(self, symbol: int, end: int | None = None) -> int:
        """Occurrences of an id before a place; in all without one."""
        start, end = self._range(symbol, self.size if end is None else end)
        return end - start

    def select(self, symbol: int, k: int) -> int:
        """The place of the k-th occurrence, from 0."""
        start, end = self._range(symbol, self.size)
        if not 0 <= k < end - start:
            raise IndexError(f"id {symbol} occurs {end - start} times")
        at = start + k
        for plane in range(len(self.planes) - 1, -1, -1):
            one = symbol >> (len(self.planes) - 1 - plane) & 1
            at = self._select_bit(plane, one, at - self.zeros[plane] if one else at)
        return at

    def _select_bit(self, plane: int, one: int, k: int) -> int:
        """Place of the k-th set or clear bit, by halving over rank."""
        low, high = 0, self.size
        while low < high:
            middle = (low + high) // 2
            ones = int(self._ones(plane, np.array([middle + 1]))[0])
            if (ones if one else middle + 1 - ones) <= k:
                low = middle + 1
            else:
                high = middle
        return low

    def occurrences(self, symbol: int) -> list[int]:
        return [self.select(symbol, k) for k in range(self.rank(symbol))]

    def ids(self) -> np.ndarray:
        """The whole sequence, from the lowest plane up."""
        values = np.zeros(self.size, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for plane in range(len(self.planes) - 1, -1, -1):
            ones, below = self._bits(plane), values
            values = np.empty_like(below)
            values[np.flatnonzero(~ones)] = below[: self.zeros[plane]]
            values[np.flatnonzero(ones)] = below[self.zeros[plane]:] | values.dtype.type(1 << (len(self.planes) - 1 - plane))
        return values.astype(np.uint32)


def to_bytes(ids: np.ndarray, lengths: np.ndarray, doc_ids: np.ndarray) -> bytes:
    matrix, out = WaveletMatrix.of(ids), io.BytesIO()
    pack = zstandard.ZstdCompressor(level=1).compress
    out.write(MAGIC + struct.pack("<IQQ", len(matrix.planes), matrix.size, len(lengths)))
    blocks = [lengths.astype("<u4").tobytes(), doc_ids.astype("<i8").tobytes()]
    blocks += [struct.pack("<Q", zeros) + plane.tobytes() for plane, zeros in zip(matrix.planes, matrix.zeros)]
    for block in map(pack, blocks):
        out.write(struct.pack("<Q", len(block)))
        out.write(block)
    return out.getvalue()


def from_bytes(data: bytes) -> tuple[WaveletMatrix, np.ndarray, np.ndarray]:
    """The matrix, the documents' lengths and their ids."""
    if data[:4] != MAGIC:
        raise ValueError("not a wavelet matrix file")
    planes, size, _ = struct.unpack_from("<IQQ", data, 4)
    at, blocks, unpack = 24, [], zstandard.ZstdDecompressor().decompress
    while at < len(data):
        (n,) = struct.unpack_from("<Q", data, at)
        blocks.append(unpack(data[at + 8:at + 8 + n]))
        at += 8 + n
    bits = [np.frombuffer(b, np.uint8, offset=8) for b in blocks[2:]]
    matrix = WaveletMatrix(size, bits, [struct.unpack_from("<Q", b)[0] for b in blocks[2:]])
    return matrix, np.frombuffer(blocks[0], "<u4"), np.frombuffer(blocks[1], "<i8")


def _open(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """File system and path of a folder given as a URI or as a local path."""
    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = "file://" + folder.removeprefix("file:")
    return pyarrow.fs.FileSystem.from_uri(folder if "://" in folder else f"file://{os.path.abspath(folder)}")


FILES = "task int, number int, path string, n_docs long, n_tokens long"
NO_ID = -(1 << 63)


def write(docs: DataFrame, vocabulary: str, end_id: int, shard_tokens: int = SHARD_TOKENS, folder: str | None = None) -> DataFrame:
    """Write the files; gives the table of files: task, number in it, path, documents, tokens."""
    folder = folder or f"{checkpoint_dir(docs.sparkSession)}/wavelet-{uuid.uuid4().hex}"

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, end = encoder(vocabulary), np.array([end_id], "<u4").tobytes()
        task, number = TaskContext.get().partitionId(), 0
        ids, lengths, doc_ids, held = [], [], [], 0

        def close():
            system, root = _open(folder)
            system.create_dir(root, recursive=True)
            path = f"{root}/{task:06d}-{number:06d}-{uuid.uuid4().hex}.wmx"
            with system.open_output_stream(path) as out:
                out.write(to_bytes(np.frombuffer(b"".join(ids), "<u4"), np.array(lengths), np.array(doc_ids)))
            return pa.RecordBatch.from_pylist([{"task": task, "number": number, "path": path, "n_docs": len(lengths), "n_tokens": held}],
                                              pa.schema([("task", pa.int32()), ("number", pa.int32()), ("path", pa.string()),
                                                         ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

        for batch in batches:
            for k in range(0, batch.num_rows, TEXTS):
                rows = batch.slice(k, TEXTS)
                numbers = rows.column(0).fill_null(NO_ID).to_pylist()
                for doc_id, found in zip(numbers, tokens.ids(rows.column(1).to_pylist())):
                    ids.append(found + end)
                    lengths.append(len(found) // 4 + 1)
                    doc_ids.append(doc_id)
                    held += lengths[-1]
                    if held >= shard_tokens:
                        yield close()
                        number += 1
                        ids, lengths, doc_ids, held = [], [], [], 0
        if lengths:
            yield close()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return checkpointed(ordered.mapInArrow(shards, FILES))


def starts(files: DataFrame) -> DataFrame:
    """The files with `start`, the tokens in all files before; sums per task first, then over tasks."""
    inside = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("task").orderBy("number").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))
    tasks = files.groupBy("task").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tasks = tasks.select("task", before.alias("before"))
    return files.withColumn("inside", inside).join(tasks, "task").withColumn("start", F.col("before") + F.col("inside")).drop("before", "inside")


def read(files: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files themselves."""
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = _open(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with system.open_input_stream(row["path"]) as data:
                    matrix, lengths, doc_ids = from_bytes(data.read())
                ids, ends = matrix.ids().astype("<u4").tobytes(), np.cumsum(lengths, dtype=np.int64)
                begin = ends - lengths
                crc = [zlib.crc32(ids[4 * a:4 * b]) for a, b in zip(begin, ends)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(doc_ids, mask=doc_ids == NO_ID), pa.array(begin + row["start"]),
                    pa.array(lengths.astype(np.int64)), pa.array(np.array(crc, np.int64))], names=names)

    # Rows are tiny and work is not, so the number of tasks is set from the number of files.
    tasks = max(1, min(MAX_TASKS, -(-files.count() // 4)))
    spread = starts(files).select("path", "start").repartition(tasks, "path")
    return spread.mapInArrow(digests, ", ".join(f"{n} long" for n in names))
