"""Mergeable state of a stretch of packets of one flow.

A state holds counts, moments, first and last times, the open payload run and the open active
stretch, so two neighbouring stretches combine into the state of both without their packets.
Packets become states of one packet each and are combined pairwise, all flows of a slice at
once, until each flow has one. Memory is a slice of rows; a flow carries one state from slice to
slice, from chunk to chunk, and from trigger to trigger of a stream.

What depends on packets before the stretch waits in the state: the gap of its first packet, the
jump of its second, the active stretch its first jump ends, and payload runs at its two ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from nightwarden import fixed_values as fv

FLAGS = ("fin", "syn", "rst", "psh", "ack", "urg", "cwe", "ece")
SPREADS = ("fwd_len", "bwd_len", "len", "iat", "fwd_iat", "bwd_iat", "active", "idle")
MOMENTS = ("n", "mean", "m2", "min", "max", "sum")
SUMS = ("fwd_header", "bwd_header", "fwd_data", "run_states", "run_packets", "run_bytes", "run_us", *(f"{f}_n" for f in FLAGS))
RUN = ("n", "bytes", "first", "last")
TIMES = ("first_us", "last_us", "first_gap", "last_gap", "first_fwd", "last_fwd", "first_bwd", "last_bwd")
INTEGERS = (*SUMS, *TIMES, "fwd_header_min", "bwd_window", "jumped", "first_pg", "last_jump", "runs",
            *(f"{end}_{f}" for end in ("head", "tail") for f in RUN))
FLOATS = tuple(f"{s}_{m}" for s in SPREADS for m in MOMENTS)
FIELDS = (*INTEGERS, *FLOATS)
NONE = -1
NO_MINIMUM = np.iinfo(np.int64).max

State = dict[str, np.ndarray]


def _spread(value: np.ndarray, there: np.ndarray) -> dict[str, np.ndarray]:
    """Moments of at most one value a row."""
    x = np.where(there, value, 0).astype(np.float64)
    return {"n": there.astype(np.float64), "mean": x, "m2": np.zeros(len(x)), "min": np.where(there, x, np.inf),
            "max": np.where(there, x, -np.inf), "sum": x}


def _merged(a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    n = a["n"] + b["n"]
    whole = np.where(n > 0, n, 1)
    apart = b["mean"] - a["mean"]
    return {"n": n, "mean": np.where(a["n"] == 0, b["mean"], np.where(b["n"] == 0, a["mean"], a["mean"] + apart * b["n"] / whole)),
            "m2": a["m2"] + b["m2"] + apart * apart * a["n"] * b["n"] / whole,
            "min": np.minimum(a["min"], b["min"]), "max": np.maximum(a["max"], b["max"]), "sum": a["sum"] + b["sum"]}


def _of(state: State, spread: str) -> dict[str, np.ndarray]:
    return {m: state[f"{spread}_{m}"] for m in MOMENTS}


def _put(state: State, spread: str, moments: dict[str, np.ndarray]) -> None:
    for m, values in moments.items():
        state[f"{spread}_{m}"] = values


def _also(state: State, spread: str, value: np.ndarray, there: np.ndarray) -> None:
    _put(state, spread, _merged(_of(state, spread), _spread(value, there)))


def of_packets(p: dict[str, np.ndarray]) -> State:
    """One state per packet; `p` has ts_us, is_fwd, payload_bytes, header_bytes, tcp_window and the flags."""
    ts, fwd = p["ts_us"].astype(np.int64), p["is_fwd"].astype(bool)
    payload, header = p["payload_bytes"].astype(np.int64), p["header_bytes"].astype(np.int64)
    zero, none, loaded = np.zeros(len(ts), np.int64), np.full(len(ts), NONE), payload > 0
    s: State = {name: zero for name in INTEGERS}
    s |= {
        "first_us": ts, "last_us": ts, "first_fwd": np.where(fwd, ts, NONE), "last_fwd": np.where(fwd, ts, NONE),
        "first_bwd": np.where(fwd, NONE, ts), "last_bwd": np.where(fwd, NONE, ts),
        "fwd_header": np.where(fwd, header, 0), "bwd_header": np.where(fwd, 0, header),
        "fwd_data": (fwd & (payload >= 1)).astype(np.int64), "fwd_header_min": np.where(fwd, header, NO_MINIMUM),
        "bwd_window": np.where(fwd, none, p["tcp_window"].astype(np.int64)), "runs": loaded.astype(np.int64),
        **{f"{f}_n": p[f"flag_{f}"].astype(np.int64) for f in FLAGS}}
    for end in ("head", "tail"):
        s |= {f"{end}_n": loaded.astype(np.int64), f"{end}_bytes": np.where(loaded, payload, 0),
              f"{end}_first": np.where(loaded, ts, 0), f"{end}_last": np.where(loaded, ts, 0)}
    nothing = np.zeros(len(ts), bool)
    for spread in SPREADS:
        there = {"fwd_len": fwd, "bwd_len": ~fwd, "len": ~nothing}.get(spread, nothing)
        _put(s, spread, _spread(payload, there))
    return s


def _run(s: State, end: str) -> list[np.ndarray]:
    return [s[f"{end}_{f}"] for f in RUN]


def _count_run(s: State, run: list[np.ndarray], there: np.ndarray) -> None:
    """A payload run is over; it counts if it is long enough."""
    n, size, first, last = run
    counts = there & (n >= fv.PAYLOAD_RUN_MIN_PACKETS)
    for name, value in (("run_states", 1), ("run_packets", n), ("run_bytes", size), ("run_us", last - first)):
        s[name] = s[name] + np.where(counts, value, 0)


def _jump(s: State, there: np.ndarray, gap: np.ndarray, before: np.ndarray) -> None:
    """A gap that exceeds the one before it by more than the activity timeout, where `there`."""
    known = there & (s["jumped"] > 0)
    _also(s, "idle", gap - before, there)
    stretch = before - s["last_jump"]
    _also(s, "active", stretch, known & (stretch > 0))
    s["first_pg"] = np.where(there & ~known, before, s["first_pg"])
    s["last_jump"] = np.where(there, gap, s["last_jump"])
    s["jumped"] = s["jumped"] | there


def combined(a: State, b: State) -> State:
    """The states of both stretches, `b` right after `a`."""
    s = {name: a[name] + b[name] for name in SUMS}
    for spread in SPREADS:
        _put(s, spread, _merged(_of(a, spread), _of(b, spread)))
    several, more = a["len_n"] >= 2, b["len_n"] >= 2
    gap = b["first_us"] - a["last_us"]
    _also(s, "iat", gap, np.ones(len(gap), bool))
    for side in ("fwd", "bwd"):
        both = (a[f"last_{side}"] != NONE) & (b[f"first_{side}"] != NONE)
        _also(s, f"{side}_iat", b[f"first_{side}"] - a[f"last_{side}"], both)
        s[f"first_{side}"] = np.where(a[f"first_{side}"] != NONE, a[f"first_{side}"], b[f"first_{side}"])
        s[f"last_{side}"] = np.where(b[f"last_{side}"] != NONE, b[f"last_{side}"], a[f"last_{side}"])
    for name in ("jumped", "first_pg", "last_jump"):
        s[name] = a[name]
    _jump(s, several & (gap - a["last_gap"] > fv.ACTIVITY_TIMEOUT_US), gap, a["last_gap"])
    _jump(s, more & (b["first_gap"] - gap > fv.ACTIVITY_TIMEOUT_US), b["first_gap"], gap)
    later, known = b["jumped"] > 0, s["jumped"] > 0
    stretch = b["first_pg"] - s["last_jump"]
    _also(s, "active", stretch, later & known & (stretch > 0))
    s["first_pg"] = np.where(later & ~known, b["first_pg"], s["first_pg"])
    s["last_jump"] = np.where(later, b["last_jump"], s["last_jump"])
    s["jumped"] = (later | known).astype(np.int64)
    s |= {"first_us": a["first_us"], "last_us": b["last_us"], "first_gap": np.where(several, a["first_gap"], gap),
          "last_gap": np.where(more, b["last_gap"], gap), "fwd_header_min": np.minimum(a["fwd_header_min"], b["fwd_header_min"]),
          "bwd_window": np.where(b["bwd_window"] != NONE, b["bwd_window"], a["bwd_window"])}

    # Payload runs: the last of a and the first of b are one run if the silence between is short.
    left, right = a["runs"] > 0, b["runs"] > 0
    touch = left & right & (b["head_first"] - a["tail_last"] <= fv.PAYLOAD_RUN_GAP_US)
    a_tail, b_head = _run(a, "tail"), _run(b, "head")
    joined = [np.where(touch, x, 0) for x in (a_tail[0] + b_head[0], a_tail[1] + b_head[1], a_tail[2], b_head[3])]
    a_inner, b_inner = a["runs"] > 1, b["runs"] > 1
    _count_run(s, joined, touch & a_inner & b_inner)
    _count_run(s, a_tail, left & right & ~touch & a_inner)
    _count_run(s, b_head, left & right & ~touch & b_inner)
    for i, f in enumerate(RUN):
        head = np.where(touch & ~a_inner, joined[i], np.where(left, a[f"head_{f}"], b[f"head_{f}"]))
        tail = np.where(touch & ~b_inner, joined[i], np.where(right, b[f"tail_{f}"], a[f"tail_{f}"]))
        s[f"head_{f}"], s[f"tail_{f}"] = head, tail
    s["runs"] = np.where(left & right, np.where(touch & ~a_inner & ~b_inner, 1, 2), np.maximum(a["runs"], b["runs"]))
    return s


def finished(state: State, head_fwd: np.ndarray, head_payload: np.ndarray, bidirectional: bool) -> State:
    """The state of a whole flow with all that waited counted; its first packet has the given side and payload."""
    s = dict(state)
    second = (s["len_n"] >= 2) & (s["first_gap"] > fv.ACTIVITY_TIMEOUT_US)
    _also(s, "idle", s["first_gap"], second)
    stretch = s["first_pg"] - np.where(second, s["first_gap"], 0)
    _also(s, "active", stretch, (s["jumped"] > 0) & (stretch > 0))
    _count_run(s, _run(s, "head"), s["runs"] > 0)
    _count_run(s, _run(s, "tail"), s["runs"] > 1)
    s["fwd_data"] = s["fwd_data"] - (head_fwd & (head_payload >= 1))
    if not bidirectional:  # one-way flows count their first later forward packet from the epoch
        _also(s, "fwd_iat", s["first_fwd"], ~head_fwd & (s["first_fwd"] != NONE))
    return s


def taken(state: State, at: np.ndarray) -> State:
    return {name: values[at] for name, values in state.items()}


def reduced(state: State, run: np.ndarray) -> tuple[State, np.ndarray]:
    """States of neighbouring rows of a run combined into one; `run` is sorted."""
    while len(run) > 1:
        first = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
        place = np.arange(len(run)) - np.repeat(first, np.diff(np.append(first, len(run))))
        left = np.flatnonzero((place[:-1] % 2 == 0) & (run[1:] == run[:-1]))
        if not len(left):
            break
        pairs = combined(taken(state, left), taken(state, left + 1))
        stays = np.ones(len(run), bool)
        stays[left + 1] = False
        for name, values in state.items():
            values = values.astype(pairs[name].dtype)  # also copies
            values[left] = pairs[name]
            state[name] = values[stays]
        run = run[stays]
    return state, run


def columns(state: State) -> list[pa.Array]:
    return [pa.array(state[name], pa.int64() if name in INTEGERS else pa.float64()) for name in FIELDS]


def read(table: pa.RecordBatch | pa.Table) -> State:
    """States from the columns of a table."""
    return {name: np.asarray(table.column(name)) for name in FIELDS}


#: Columns of a packet that the states need, and those that describe a flow by its first packet.
NEEDED = ("ts_us", "is_fwd", "payload_bytes", "header_bytes", "tcp_window", *(f"flag_{f}" for f in FLAGS))


def packet_states(table: pa.RecordBatch | pa.Table, run: np.ndarray) -> State:
    """One state for each run of a table of packets."""
    packets = {name: table.column(name).to_numpy(zero_copy_only=False) if isinstance(table, pa.RecordBatch)
               else table.column(name).to_numpy() for name in NEEDED}
    return reduced(of_packets(packets), run)[0]


def rows_of_runs(batches: Iterator[pa.RecordBatch], key: list[str], changes, of_batch) -> Iterator[tuple[pa.RecordBatch, State]]:
    """Sorted batches to (first rows, states), one row per run of equal keys.

    `of_batch` gives the states of a batch's runs. A run that a batch leaves unfinished is
    carried as one state.
    """
    held: tuple[pa.RecordBatch, State] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        changed = changes(batch, key)
        first = np.flatnonzero(changed)
        heads, states = batch.take(pa.array(first)), of_batch(batch, np.cumsum(changed) - 1)
        if held:
            seam = pa.Table.from_batches([held[0].select(key), heads.select(key).slice(0, 1)])
            if changes(seam, key)[1]:
                yield held
            else:
                joined = combined(held[1], taken(states, np.array([0])))
                for name in FIELDS:
                    states[name] = np.concatenate([joined[name], states[name][1:]])
                heads = pa.Table.from_batches([held[0], heads.slice(1)]).combine_chunks().to_batches()[0]
        last = np.arange(heads.num_rows)[-1:]
        if heads.num_rows > 1:
            yield heads.slice(0, heads.num_rows - 1), taken(states, np.arange(heads.num_rows - 1))
        held = heads.slice(heads.num_rows - 1), taken(states, last)
    if held:
        yield held
