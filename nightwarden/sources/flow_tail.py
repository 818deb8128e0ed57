"""Growing CSV files as a stream: a Python data source whose offsets are places in files.

A micro-batch reads what was appended since the one before, up to the last whole line. The offset
of a file holds its length and a checksum of the bytes before it; if the file is shorter, or those
bytes are others, it was cut or replaced and is read from its start. Long stretches are read in
pieces by many tasks, each from the first line that begins in its piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from nightwarden.schemas import MODEL_FLOWS
from nightwarden.sources.flow_files import typed_cells
from nightwarden.sources.text_lines import opened

PIECE_BYTES = 32 << 20
#: Pieces of a file at most, so that a backlog makes longer tasks instead of ever more.
MOST_PIECES = 64
MARK_BYTES = 256
BLOCK_BYTES = 1 << 16
LINES = 4096


@dataclass
class Piece(InputPartition):
    """Lines of a file that begin in [low, high); `whole` if a line begins at low for certain."""

    path: str
    low: int
    high: int
    whole: bool


class TailReader(DataSourceStreamReader):
    def __init__(self, path: str, piece_bytes: int):
        self.path, self.piece_bytes = path, piece_bytes

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """{file: [length of its whole lines, checksum of the bytes before that]}."""
        files, folder = opened(self.path)
        out = {}
        for info in sorted(files.get_file_info(pafs.FileSelector(folder, recursive=True, allow_not_found=True)), key=lambda i: i.path):
            if info.type == pafs.FileType.File and info.path.endswith(".csv"):
                with files.open_input_file(info.path) as f:
                    end = self._last_line_end(f, info.size)
                    if end:
                        out[info.path] = [end, self._mark(f, end)]
        return out

    @staticmethod
    def _last_line_end(f: pa.NativeFile, size: int) -> int:
        while size > 0:
            low = max(0, size - BLOCK_BYTES)
            at = f.read_at(size - low, low).rfind(b"\n")
            if at >= 0:
                return low + at + 1
            size = low
        return 0

    @staticmethod
    def _mark(f: pa.NativeFile, end: int) -> int:
        low = max(0, end - MARK_BYTES)
        return zlib.crc32(f.read_at(end - low, low))

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        files, _ = opened(self.path)
        pieces = []
        for path, (high, mark) in end.items():
            low, known = start.get(path, (0, None))
            if [low, known] == [high, mark]:
                continue
            if low:
                with files.open_input_file(path) as f:
                    if low > high or self._mark(f, low) != known:
                        low = 0
            size = max(self.piece_bytes, -(-(high - low) // MOST_PIECES))
            pieces += [Piece(path, at, min(at + size, high), at == low) for at in range(low, high, size)]
        return pieces

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        files, _ = opened(self.path)
        names = ["file", "at", "header", "value"]
        with files.open_input_file(partition.path) as f:
            header = self._lines(f, 0, 1)
            first = next(header, (0, b""))[1]
            title = first.decode("utf-8-sig", "replace").rstrip("\r\n")
            low = partition.low if partition.whole else partition.low - 1
            lines = self._lines(f, low, partition.high)
            if not partition.whole:
                next(lines, None)  # it began in the piece before
            out: list[tuple[int, str]] = []
            for at, line in lines:
                if at:
                    out.append((at, line.decode("utf-8", "replace").rstrip("\r\n")))
                if len(out) == LINES:
                    yield self._batch(partition.path, title, out, names)
                    out = []
            if out:
                yield self._batch(partition.path, title, out, names)

    @staticmethod
    def _lines(f: pa.NativeFile, low: int, high: int) -> Iterator[tuple[int, bytes]]:
        """(place, line) of lines that begin in [low, high), the last one to its end."""
        f.seek(low)
        rest, at = b"", low
        while at < high:
            block = f.read(BLOCK_BYTES)
            lines = (rest + block).split(b"\n")
            rest = lines.pop()
            for line in lines:
                if at >= high:
                    return
                yield at, line
                at += len(line) + 1
            if not block:
                return

    @staticmethod
    def _batch(path: str, header: str, out: list[tuple[int, str]], names: list[str]) -> pa.RecordBatch:
        n = len(out)
        return pa.RecordBatch.from_arrays(
            [pa.array([path] * n), pa.array([a for a, _ in out], pa.int64()), pa.array([header] * n), pa.array([v for _, v in out])], names)


class FlowCsvTail(DataSource):
    """Options: path of a folder, and pieceBytes."""

    @classmethod
    def name(cls) -> str:
        return "flow_csv_tail"

    def schema(self) -> str:
        return "file string, at bigint, header string, value string"

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options["path"], int(self.options.get("piecebytes", PIECE_BYTES)))


def tail_model_csv(spark: SparkSession, path: str, schema: str = MODEL_FLOWS, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """Model rows of lines as they are appended to the CSV files of a folder, by each file's own header.

    The checkpoint of the query holds the offsets, so a restart goes on where it stopped. A line
    without its end waits for it. Lines equal to the header are headers.
    """
    spark.dataSource.register(FlowCsvTail)
    lines = spark.readStream.format("flow_csv_tail").option("path", path).option("pieceBytes", piece_bytes).load()
    return typed_cells(lines.filter((F.col("value") != F.col("header")) & (F.trim("value") != "")), schema)
