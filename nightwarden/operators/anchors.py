"""Greedy anchors: "start here, ignore everything until the span is over, start again".

Both the alert cool-down and the assembly of packets into flows have this shape. Each
start depends on the one before it, so a plain per-key fold would put a hot key into one
task. Instead the timeline of a key is cut into chunks:

1. every chunk is summarised, independently, as a step function: "if the span left open
   by the chunk before ends at x, the span I leave open is y". Only the first span length
   of a chunk can depend on x, and equal answers collapse, so most chunks have one step;
2. the summaries (not the rows) are walked in time order per key to find what really
   enters each chunk;
3. every chunk marks its own rows, again independently.

Rows are handled with numpy in slices of sorted Arrow batches, many keys at a time. A group may
be far larger than a slice: the open span, the lead of its chain and a pending close are carried
from slice to slice, and a summary holds one step per answer that can still differ.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

NOTHING_OPEN = np.iinfo(np.int64).min
NO_LEAD = -1
ANY = np.iinfo(np.int64).max


def changes(table: pa.RecordBatch | pa.Table, columns: list[str]) -> np.ndarray:
    """True where a row differs from the one before it in any of the columns."""
    changed = np.zeros(table.num_rows, dtype=bool)
    if table.num_rows:
        changed[0] = True
    for name in columns:
        values = table.column(name)
        if isinstance(values, pa.ChunkedArray):
            values = values.combine_chunks()
        left, right = values[:-1], values[1:]
        differs = pc.fill_null(pc.not_equal(left, right), False)
        nulls = pc.not_equal(pc.is_null(left), pc.is_null(right))
        changed[1:] |= pc.or_(differs, nulls).to_numpy(zero_copy_only=False)
    return changed


SUMMARY_SCALARS = ["first_at", "last_at", "first_lead"]
SUMMARY_LISTS = ["until", "leaves", "leaves_order", "leads"]

#: Rows handled at once; what is carried from one slice to the next is a few numbers per open span.
SLICE_ROWS = 1 << 16


def _slices(batches: Iterator[pa.RecordBatch], columns: list[str], rows: int) -> Iterator[tuple[pa.RecordBatch, bool]]:
    """Sorted batches in slices of bounded size, each with whether its first group began before it."""
    last = None
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            if last is None:
                goes_on = False
            else:
                seam = pa.Table.from_batches([last, part.select(columns).slice(0, 1)])
                goes_on = not changes(seam, columns)[1]
            last = part.select(columns).slice(part.num_rows - 1)
            yield part, goes_on


class _Slice:
    """Numpy view of sorted rows: pieces of (key, chunk) groups and the spans that start in them.

    A state is (end, order, lead) of arrays: the open span ends at `end` (NOTHING_OPEN: a closing
    row ended it), began at the row `order`, and its chain began with `lead` (NO_LEAD: unknown
    here, as it began before).
    """

    def __init__(self, table: pa.RecordBatch, keys: list[str], micros: str, order: str, closes: str | None,
                 hold: int, chunk_us: int, lead: str | None, idle_us: int | None, seen: int | None):
        n = table.num_rows
        numbers = lambda name: table.column(name).to_numpy(zero_copy_only=False)
        self.n, self.hold = n, hold
        self.at = numbers(micros).astype(np.int64)
        self.order = numbers(order).astype(np.int64)
        self.first = np.flatnonzero(changes(table, keys + ["_chunk"]))
        self.end = np.append(self.first[1:], n)
        sizes = self.end - self.first
        self.group = np.repeat(np.arange(len(self.first)), sizes)
        self.row_end = np.repeat(self.end, sizes)
        self.stride = chunk_us + hold + 2
        self.origin = numbers("_chunk").astype(np.int64)[self.first] * chunk_us
        self.position = self.group * self.stride + (self.at - self.origin[self.group])
        self.closing = numbers(closes).astype(bool) if closes else np.zeros(n, dtype=bool)
        closing = np.flatnonzero(self.closing)
        self.next_close = np.append(closing, n)[np.searchsorted(closing, np.arange(n + 1))]  # first closing row at or after i

        # Where the span opened by row i ends: at a closing row, or at the first row past it.
        i = np.arange(n)
        past = np.searchsorted(self.position, self.position + hold)
        close = self.next_close[i + 1]
        self.closed = close < past
        self.following = np.where(self.closed, close + 1, past)

        # A chain of spans begins anew after a closing row, or after an idle gap.
        self.lead = numbers(lead).astype(np.int64) if lead else np.full(n, NO_LEAD)
        self.idle = np.zeros(n + 1, dtype=bool)
        if idle_us is not None and n:
            self.idle[1:n] = (self.at[1:] - self.at[:-1] > idle_us) & (self.group[1:] == self.group[:-1])
            self.idle[0] = seen is not None and self.at[0] - seen > idle_us
        self.renews = self.closed | self.idle[self.following]

    def entry(self, opens_until: np.ndarray, group: np.ndarray) -> np.ndarray:
        """First start in the groups when the span that enters them ends at the given times."""
        reach = np.clip(opens_until - self.origin[group], 0, self.stride - 1)
        reach = np.where(opens_until == NOTHING_OPEN, 0, reach)
        past = np.searchsorted(self.position, group * self.stride + reach)
        past = np.maximum(past, self.first[group])
        return np.where(opens_until == NOTHING_OPEN, past, np.minimum(past, self.next_close[self.first[group]] + 1))

    def chains(self) -> tuple[np.ndarray, np.ndarray]:
        """Last start reached from a start at each row, and the lead of the chain it then belongs to."""
        index = np.arange(self.n)
        goes_on = self.following < self.row_end
        last = np.where(goes_on, self.following, index)
        leads = np.where(goes_on & self.renews, self.lead[last], NO_LEAD)
        while True:  # pointer jumping
            further = last[last]
            if np.array_equal(further, last):
                return last, leads
            leads = np.where(leads[last] != NO_LEAD, leads[last], leads)
            last = further

    def left_by(self, start: np.ndarray, lead: np.ndarray, chains) -> list[np.ndarray]:
        """States after the slice when the spans that start at the rows `start` carry `lead`."""
        last, leads = chains[0][start], chains[1][start]
        ends = np.where(self.closed[last], NOTHING_OPEN, self.at[last] + self.hold)
        return [ends, self.order[last], np.where(leads != NO_LEAD, leads, lead)]

    def passed(self, state: list[np.ndarray], group: np.ndarray, chains) -> list[np.ndarray]:
        """States after the slice for states that enter the groups."""
        ends, order, lead = state
        at = self.entry(ends, group)
        inside = at < self.end[group]
        start = np.where(inside, at, self.first[group])
        close = self.next_close[self.first[group]]
        cut = (ends != NOTHING_OPEN) & (close < self.end[group]) & (at == close + 1)
        renews = (ends == NOTHING_OPEN) | cut | self.idle[start]
        after = self.left_by(start, np.where(renews, self.lead[start], lead), chains)
        through = [np.where(cut, NOTHING_OPEN, ends), order, lead]
        return [np.where(inside, a, t) for a, t in zip(after, through)]


class _Steps:
    """Step functions of groups: a span that is open until x <= `until` leaves a group as `state`.

    `group` is sorted and `until` rises in a group. `open` says per group whether a longer span
    might still enter: no row yet is late enough, nor a closing one.
    """

    def __init__(self, group: np.ndarray, until: np.ndarray, state: list[np.ndarray], open_: np.ndarray):
        self.group, self.until, self.state, self.open = group, until, state, open_

    @classmethod
    def of(cls, rows: _Slice, chains) -> _Steps:
        """The steps of every group, from its rows in the slice alone."""
        index, groups = np.arange(rows.n), np.arange(len(rows.first))
        reach = np.searchsorted(rows.position, groups * rows.stride + rows.hold - 1)
        close = rows.next_close[rows.first]
        stop = np.minimum(np.minimum(reach, close), rows.end - 1)
        # Of rows at one time, the first is where a span that ends then lets go.
        changed = np.append(True, rows.position[1:] != rows.position[:-1])[:rows.n]
        start = np.flatnonzero((index <= stop[rows.group]) & changed)
        state = rows.left_by(start, np.where(rows.idle[start], rows.lead[start], NO_LEAD), chains)
        # A span that is still open at a closing row ends there; what follows begins anew.
        ending = np.flatnonzero((close < rows.end) & (close <= reach))
        resumes = close[ending] + 1
        inside = resumes < rows.end[ending]
        begin = np.where(inside, resumes, 0)
        resumed = rows.left_by(begin, rows.lead[begin], chains)
        nothing = (NOTHING_OPEN, 0, NO_LEAD)
        resumed = [np.where(inside, r, v) for r, v in zip(resumed, nothing)]
        group = np.concatenate([rows.group[start], ending])
        arrange = np.argsort(group, kind="stable")
        return cls(group[arrange], np.concatenate([rows.at[start], np.full(len(ending), ANY)])[arrange],
                   [np.concatenate([s, r])[arrange] for s, r in zip(state, resumed)], (reach >= rows.end) & (close >= rows.end)).collapsed()

    def collapsed(self) -> _Steps:
        """Neighbouring steps with the same answer are one."""
        ends, order, lead = self.state
        order, lead = np.where(ends == NOTHING_OPEN, 0, order), np.where(ends == NOTHING_OPEN, NO_LEAD, lead)
        state = [ends, order, lead]
        differs = np.ones(len(ends), dtype=bool)
        differs[:-1] = self.group[1:] != self.group[:-1]
        for column in state:
            differs[:-1] |= column[1:] != column[:-1]
        return _Steps(self.group[differs], self.until[differs], [c[differs] for c in state], self.open)

    def part(self, low: int, high: int) -> _Steps:
        """The groups in [low, high), renumbered from 0."""
        at = slice(*np.searchsorted(self.group, [low, high]))
        return _Steps(self.group[at] - low, self.until[at], [c[at] for c in self.state], self.open[low:high])

    def then(self, rows: _Slice, fresh: _Steps, chains) -> _Steps:
        """One group's steps after the slice's first group, whose own steps are `fresh`."""
        state = rows.passed(self.state, np.zeros(len(self.until), dtype=np.int64), chains)
        if not self.open[0]:
            return _Steps(self.group, self.until, state, self.open).collapsed()
        new = fresh.until > (self.until[-1] if len(self.until) else NOTHING_OPEN)
        return _Steps(np.append(self.group, fresh.group[new]), np.append(self.until, fresh.until[new]),
                      [np.append(c, f[new]) for c, f in zip(state, fresh.state)], fresh.open).collapsed()


def anchor_rows(
    rows: DataFrame,
    keys: list[str],
    micros: str,
    order: str,
    span_us: int,
    *,
    bound_included: bool,
    closes: str | None = None,
    chunk_us: int | None = None,
    lead: str | None = None,
    idle_us: int | None = None,
    costly_input: bool = False,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Append ``anchor_us``, ``anchor_order`` and ``is_anchor`` to every row.

    A row starts a new span when none is open. A span stays open for ``span_us`` after its
    start (at exactly ``span_us`` it still is when ``bound_included``); a row whose
    ``closes`` flag is set ends the span it falls into and is part of it. ``order`` (BIGINT)
    breaks ties between rows of the same key and time.

    ``lead`` names a non-negative BIGINT column; ``lead_value`` then holds its value at the row
    that began the current chain of spans: the key's first row, the start after a closing
    row, or (with ``idle_us``) the start after a longer silence. A span that starts because
    the one before it ran out continues the chain.

    The rows are read twice. By default the summary pass shuffles only the columns it needs;
    with ``costly_input`` both passes ask for the same shuffle, which Spark then reuses.
    """
    hold = span_us + 1 if bound_included else span_us
    chunk_us = chunk_us or 40 * span_us
    if chunk_us < hold:
        raise ValueError("a chunk must cover at least one span")
    chunked = rows.withColumn("_chunk", F.floor(F.col(micros) / F.lit(chunk_us)).cast("bigint"))
    group = keys + ["_chunk"]
    key_fields = [f for f in chunked.schema.fields if f.name in keys]
    key_fields.sort(key=lambda f: keys.index(f.name))
    chunk_field = T.StructField("_chunk", T.LongType())

    def summarise(batches):
        held = None  # (key row, first time, first lead, steps) of the group that the slice before left unfinished
        seen = None

        def told(heads, first_at, last_at, first_lead, steps):
            sizes = np.searchsorted(steps.group, np.arange(heads.num_rows + 1)).astype(np.int32)
            return pa.RecordBatch.from_arrays(
                [*heads.columns, *(pa.array(np.asarray(x, np.int64)) for x in (first_at, last_at, first_lead)),
                 *(pa.ListArray.from_arrays(pa.array(sizes), pa.array(v)) for v in (steps.until, *steps.state))],
                names=group + SUMMARY_SCALARS + SUMMARY_LISTS)

        for table, goes_on in _slices(batches, group, slice_rows):
            c = _Slice(table, keys, micros, order, closes, hold, chunk_us, lead, idle_us, seen if goes_on else None)
            chains = c.chains()
            fresh = _Steps.of(c, chains)
            heads, last = table.select(group).take(pa.array(c.first)), len(c.first) - 1
            if goes_on:
                head, first_at, first_lead, steps = held
                held = head, first_at, first_lead, steps.then(c, fresh.part(0, 1), chains)
                seen = c.at[c.end[0] - 1]
            if held and (not goes_on or last):
                yield told(held[0], [held[1]], [seen], [held[2]], held[3])
            if last or not goes_on:
                low = int(goes_on)
                if low < last:
                    first = c.first[low:last]
                    yield told(heads.slice(low, last - low), c.at[first], c.at[c.end[low:last] - 1], c.lead[first], fresh.part(low, last))
                held = heads.slice(last), c.at[c.first[last]], c.lead[c.first[last]], fresh.part(last, last + 1)
            seen = c.at[-1]
        if held:
            yield told(held[0], [held[1]], [seen], [held[2]], held[3])

    def walk(batches):
        before = None  # the summary row before this one, with its resolved exit
        for batch in batches:
            if batch.num_rows == 0:
                continue
            n = batch.num_rows
            new_key = changes(batch, keys)
            if before is not None:
                seam = pa.Table.from_batches([before["keys"], batch.select(keys).slice(0, 1)])
                new_key[0] = changes(seam, keys)[1]
            chunk, first_at, last_at, first_lead = (
                batch.column(k).to_numpy() for k in ["_chunk"] + SUMMARY_SCALARS)
            lists = [batch.column(k) for k in SUMMARY_LISTS]
            offsets = lists[0].offsets.to_numpy()
            until, leaves, leaves_order, leads = [x.values.to_numpy() for x in lists]
            # What a chunk leaves behind when nothing enters it.
            exits, exits_order = leaves[offsets[:-1]].copy(), leaves_order[offsets[:-1]].copy()
            exits_lead = leads[offsets[:-1]]
            exits_lead = np.where(exits_lead == NO_LEAD, first_lead, exits_lead)
            enters = np.full(n, NOTHING_OPEN)
            enters_order, enters_lead = np.zeros(n, dtype=np.int64), np.full(n, NO_LEAD)
            for i in np.flatnonzero(~new_key):
                if i:
                    span_end, span_order, chain, previous, seen = (
                        exits[i - 1], exits_order[i - 1], exits_lead[i - 1], chunk[i - 1], last_at[i - 1])
                else:
                    span_end, span_order, chain, previous, seen = before["exit"]
                if span_end == NOTHING_OPEN or (idle_us is not None and first_at[i] - seen > idle_us):
                    continue  # closed or silent: this chunk begins a new chain
                enters_lead[i] = chain
                steps = slice(offsets[i], offsets[i + 1])
                at = 0
                if previous + 1 == chunk[i] and span_end > first_at[i]:
                    enters[i], enters_order[i] = span_end, span_order
                    at = np.searchsorted(until[steps], span_end)
                if at == steps.stop - steps.start:  # longer than the chunk has rows
                    exits[i], exits_order[i], exits_lead[i] = span_end, span_order, chain
                else:
                    exits[i], exits_order[i] = leaves[steps][at], leaves_order[steps][at]
                    exits_lead[i] = leads[steps][at] if leads[steps][at] != NO_LEAD else chain
            before = {
                "keys": batch.select(keys).slice(n - 1),
                "exit": (exits[-1], exits_order[-1], exits_lead[-1], chunk[-1], last_at[-1]),
            }
            told = np.flatnonzero((enters != NOTHING_OPEN) | (enters_lead != NO_LEAD))
            kept = batch.select(group).take(pa.array(told))
            yield pa.RecordBatch.from_arrays(
                list(kept.columns) + [pa.array(x[told]) for x in (enters, enters_order, enters_lead)],
                names=group + ["enters", "enters_order", "enters_lead"],
            )

    needed = chunked.columns if costly_input else list(
        dict.fromkeys([*group, micros, order, *[c for c in (closes, lead) if c]]))
    summaries = (
        chunked.select(*needed).repartition(*group).sortWithinPartitions(*group, micros, order)
        .mapInArrow(summarise, T.StructType(key_fields + [
            chunk_field, *[T.StructField(k, T.LongType()) for k in SUMMARY_SCALARS],
            *[T.StructField(k, T.ArrayType(T.LongType())) for k in SUMMARY_LISTS],
        ]))
    )
    entering = (
        summaries.repartition(*keys).sortWithinPartitions(*group)
        .mapInArrow(walk, T.StructType(key_fields + [
            chunk_field,
            *[T.StructField(k, T.LongType()) for k in ("enters", "enters_order", "enters_lead")],
        ]))
    )

    def mark(batches):
        carried, seen = None, None  # the state and time the slice before left in its last group
        for table, goes_on in _slices(batches, group, slice_rows):
            c = _Slice(table, keys, micros, order, closes, hold, chunk_us, lead, idle_us, seen if goes_on else None)
            index = np.arange(c.n)
            enters, enters_order, enters_lead = (
                pc.fill_null(table.column(name), unset).to_numpy(zero_copy_only=False)[c.first].copy()
                for name, unset in (("enters", NOTHING_OPEN), ("enters_order", 0), ("enters_lead", NO_LEAD)))
            if goes_on:
                enters[0], enters_order[0], enters_lead[0] = carried
            is_anchor = np.zeros(c.n, dtype=bool)
            at = c.entry(enters, np.arange(len(c.first)))
            at = at[at < c.end]
            while len(at):  # one start of every group per step
                is_anchor[at] = True
                at = c.following[at][c.following[at] < c.row_end[at]]

            def latest(flag):
                found = np.maximum.accumulate(np.where(flag, index, -1))
                own = found >= c.first[c.group]
                return own, np.where(own, found, 0)

            own, anchor = latest(is_anchor)
            # Whether the span a row belongs to has been ended by that row.
            shut = c.closing & ~is_anchor
            added = {
                "anchor_us": np.where(own, c.at[anchor], enters[c.group] - hold),
                "anchor_order": np.where(own, c.order[anchor], enters_order[c.group]),
                "is_anchor": is_anchor,
            }
            chain = np.full(c.n, NO_LEAD)
            if lead:
                renewed = c.idle[:c.n].copy()
                renewed[1:] |= shut[:-1] & (c.group[1:] == c.group[:-1])  # another key's end renews nothing
                renewed[c.first] |= enters_lead == NO_LEAD
                own, begin = latest(is_anchor & renewed)
                chain = added["lead_value"] = np.where(own, c.lead[begin], enters_lead[c.group])
            end = NOTHING_OPEN if shut[-1] else added["anchor_us"][-1] + hold
            carried = end, added["anchor_order"][-1], NO_LEAD if shut[-1] else chain[-1]
            seen = c.at[-1]
            out = table.drop_columns(["_chunk", "enters", "enters_order", "enters_lead"])
            for name, values in added.items():
                out = out.append_column(name, pa.array(values))
            yield out

    added_fields = [T.StructField("anchor_us", T.LongType()), T.StructField("anchor_order", T.LongType()),
                    T.StructField("is_anchor", T.BooleanType())]
    if lead:
        added_fields.append(T.StructField("lead_value", T.LongType()))
    # What enters a chunk is one narrow row at most; the rows keep their layout.
    return (
        chunked.repartition(*group)
        .join(entering, group, "left")
        .select(*rows.columns, "_chunk", "enters", "enters_order", "enters_lead")
        .sortWithinPartitions(*group, micros, order)
        .mapInArrow(mark, T.StructType(list(rows.schema.fields) + added_fields))
    )
