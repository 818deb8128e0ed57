"""Rows of a stream that wait, by time slice, until the watermark has passed them.

Rows that come together wait in entries of a map in the state store: a few thousand rows in order
of time, over as many slices as they span. A passed entry is read and removed; one that the
watermark cuts is written again with the rest. No trigger touches entries that are all later, so
its cost follows the rows that come and go, and one entry; not the slices, and not those that wait.
An entry is one Arrow batch in bytes, so that a row is not turned into Python objects twice on its way.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql.streaming.stateful_processor import StatefulProcessorHandle

ENTRY_ROWS = 1 << 12
_ARROW = {"bigint": pa.int64(), "string": pa.string()}


class Waiting:
    """The waiting rows of one key. `columns` maps names to SQL types; `time` is in microseconds."""

    def __init__(self, handle: StatefulProcessorHandle, columns: dict[str, str], time: str, slice_us: int):
        self.handle, self.columns, self.time, self.slice_us = handle, columns, time, slice_us
        self.schema = pa.schema([(n, _ARROW[t]) for n, t in columns.items()])
        self.entries = handle.getMapState("waiting", "entry bigint", "rows binary")
        self.pending = handle.getValueState("pending", "entries array<bigint>, firsts array<bigint>, lasts array<bigint>")

    def _spans(self) -> dict[int, tuple[int, int]]:
        """First and last slice of every entry."""
        if not self.pending.exists():
            return {}
        entries, firsts, lasts = self.pending.get()
        return dict(zip(entries, zip(firsts, lasts)))

    def _wake(self, spans: dict[int, tuple[int, int]]) -> None:
        """One timer a key: the end of its first waiting slice."""
        if spans:
            firsts, lasts = zip(*spans.values())
            self.pending.update((list(spans), list(firsts), list(lasts)))
            self.handle.registerTimer((min(firsts) + 1) * self.slice_us // 1000)
        else:
            self.pending.clear()

    def _put(self, entry: int, rows: pd.DataFrame) -> tuple[int, int]:
        whole = {c: "int64" for c, t in self.columns.items() if t == "bigint"}
        batch = pa.RecordBatch.from_pandas(rows[list(self.columns)].astype(whole), self.schema, preserve_index=False)
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, self.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as writer:
            writer.write_batch(batch)
        self.entries.updateValue((entry,), (out.getvalue().to_pybytes(),))
        times = rows[self.time]
        return int(times.iloc[0]) // self.slice_us, int(times.iloc[-1]) // self.slice_us

    def add(self, frames: list[pd.DataFrame]) -> None:
        rows, spans = pd.concat(frames).sort_values(self.time, kind="stable"), self._spans()
        entry = max(spans, default=-1) + 1
        for at in range(0, len(rows), ENTRY_ROWS):
            spans[entry] = self._put(entry, rows.iloc[at:at + ENTRY_ROWS])
            entry += 1
        self._wake(spans)

    def empty_until(self, micros: int) -> bool:
        """Whether no row waits that could be at or before a time."""
        return all(first * self.slice_us > micros for first, _ in self._spans().values())

    def passed(self, watermark_ms: int) -> pd.DataFrame | None:
        """Rows of the slices that end by the watermark; they wait no more."""
        spans, frames = self._spans(), []
        end = watermark_ms * 1000 // self.slice_us  # the first slice that does not end by then
        for entry, (first, last) in list(spans.items()):
            if first >= end:
                continue
            rows = pa.ipc.open_stream(bytes(self.entries.getValue((entry,))[0])).read_pandas()
            if last < end:
                del spans[entry]
                self.entries.removeKey((entry,))
            else:
                cut = int(np.searchsorted(rows[self.time].to_numpy(np.int64), end * self.slice_us))
                spans[entry] = self._put(entry, rows.iloc[cut:])
                rows = rows.iloc[:cut]
            frames.append(rows)
        if not frames:
            return None
        self._wake(spans)
        return pd.concat(frames, ignore_index=True)
