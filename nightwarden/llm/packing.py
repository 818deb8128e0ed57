"""Best-fit packing of documents into sequences of a fixed capacity.

The number of pieces of each length is all that a packing depends on, and there are at most
`capacity` lengths. So the plan is made on that histogram: pieces above a third of the
capacity pair at most twice per sequence, the largest with the largest that fits beside it;
smaller ones, in falling length, go where the least room is left. Runs of equal sequences are
planned at once, so the plan takes a moment and is bounded by the capacity, not the corpus.

Pieces then take their places in parallel: the k-th piece of a length gets the k-th place of
that length. A piece's number comes from its number inside its task and from what earlier
tasks hold of that length, so a length that a third of all pieces share is not gathered.

Defined cases: a NULL text is empty; every document has its end id, so an empty one is one
piece of one token; only documents above the capacity are cut; rows that share a doc_id are
packed one by one; input columns other than id and text are not read; an empty table gives
no sequences.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from nightwarden.llm.tokens import encoder
from nightwarden.session import checkpointed

NAMES = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "number"]
TEXTS = 256


def pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int) -> DataFrame:
    """Pieces of every document, with the task they come from and their number there by length."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, seen = encoder(vocabulary), defaultdict(int)
        end, task = np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId()
        for batch in batches:
            for k in range(0, batch.num_rows, TEXTS):
                rows, out = batch.slice(k, TEXTS), []
                for row, ids in enumerate(tokens.ids(rows.column(1).to_pylist())):
                    ids += end
                    for piece, at in enumerate(range(0, len(ids) // 4, capacity)):
                        part = ids[4 * at:4 * (at + capacity)]
                        n = len(part) // 4
                        out.append((row, piece, at, n, zlib.crc32(part), task, seen[n]))
                        seen[n] += 1
                row, *values = (np.array(c) for c in zip(*out))
                columns = [rows.column(0).take(pa.array(row)), *map(pa.array, values)]
                yield pa.RecordBatch.from_arrays(columns, NAMES)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        cut, ", ".join(f"{n} long" for n in NAMES))


class Plan:
    """Places for every length: runs of sequences with the same content, from a histogram."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.sequences = capacity, 0
        self.runs = defaultdict(list)  # length -> (pieces, first sequence, per sequence, offset)
        self.rooms: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> (first sequence, sequences)
        self._pair({n: c for n, c in counts.items() if 3 * n > capacity})
        for n in sorted((n for n in counts if 3 * n <= capacity), reverse=True):
            self._fill(n, counts[n])

    def _open(self, count: int) -> int:
        self.sequences += count
        return self.sequences - count

    def _place(self, n: int, first: int, sequences: int, each: int, offset: int) -> None:
        self.runs[n].append((sequences * each, first, each, offset))

    def _pair(self, left: dict[int, int]) -> None:
        lengths = sorted(n for n in left if left[n])
        while lengths:
            n = lengths[-1]
            at = bisect_left(lengths, self.capacity - n + 1) - 1  # the largest that fits beside n
            if at < 0:
                other, count = 0, left[n]
            elif lengths[at] == n:
                other, count = (n, left[n] // 2) if left[n] > 1 else (lengths[at - 1] if at else 0, 1)
            else:
                other, count = lengths[at], min(left[n], left[lengths[at]])
            first = self._open(count)
            self._place(n, first, count, 1, 0)
            left[n] -= count
            if other:
                self._place(other, first, count, 1, n)
                left[other] -= count
            self.rooms[self.capacity - n - other].append((first, count))
            lengths = [m for m in lengths if left[m]]

    def _fill(self, n: int, count: int) -> None:
        while count:
            rooms = [r for r, held in self.rooms.items() if r >= n and held]
            room = min(rooms, default=self.capacity)
            each = room // n
            if rooms:
                first, sequences = self.rooms[room].pop()
            else:
                sequences = -(-count // each)
                first = self._open(sequences)
            whole = min(sequences, count // each)
            offset = self.capacity - room
            if whole:
                self._place(n, first, whole, each, offset)
                self.rooms[room - each * n].append((first, whole))
                count -= whole * each
            if whole < sequences:
                if count:  # fewer than fill one sequence of the run
                    self._place(n, first + whole, 1, count, offset)
                    self.rooms[room - count * n].append((first + whole, 1))
                    count, whole = 0, whole + 1
                if whole < sequences:
                    self.rooms[room].append((first + whole, sequences - whole))

    def places(self) -> dict[int, tuple[np.ndarray, ...]]:
        """Per length: the number of the first piece of each run, and the run's figures."""
        out = {}
        for n, runs in self.runs.items():
            size, first, each, offset = (np.array(c, np.int64) for c in zip(*runs))
            out[n] = (np.r_[0, np.cumsum(size)[:-1]], first, each, offset)
        return out


def packed(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Every piece with its sequence and its offset there."""
    cut = checkpointed(pieces(docs, vocabulary, capacity, end_id))
    held = cut.groupBy("length", "task").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in held.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    places = Plan(counts, capacity).places()
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = held.select("length", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            number, length = rows.column("number").to_numpy(), rows.column("length").to_numpy()
            sequence, offset = np.empty(len(number), np.int64), np.empty(len(number), np.int64)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                start, first, each, room = places[int(n)]
                run = np.searchsorted(start, number[at], "right") - 1
                inside = number[at] - start[run]
                sequence[at] = first[run] + inside // each[run]
                offset[at] = room[run] + inside % each[run] * n
            yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(sequence), pa.array(offset)], out)

    out = [*NAMES[:5], "sequence_id", "offset"]
    numbered = cut.join(before, ["length", "task"]).select(*NAMES[:5], (F.col("number") + F.col("before")).alias("number"))
    return numbered.mapInArrow(place, ", ".join(f"{n} long" for n in out)).withColumn("piece", F.col("piece").cast("int"))
