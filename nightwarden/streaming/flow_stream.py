"""Flows from a packet stream.

Packets wait in time slices until the watermark passes them. The open flow of a conversation is
one mergeable state (`operators/flow_state`): its packets are folded in and forgotten, so an open
flow costs the same whether it has two packets or a million. A flow leaves the state finished
(FIN or RST, timeout, or silence), ready for the 84 columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from nightwarden import fixed_values as fv
from nightwarden.functions import clock, network
from nightwarden.operators import flow_state
from nightwarden.plans import flows, network_detection
from nightwarden.schemas import PACKETS
from nightwarden.streaming.waiting import Waiting

SLICE_US = 5_000_000
#: Packets folded at once.
SLICE_ROWS = 1 << 16
_PACKET = dict(c.split() for c in PACKETS.split(", "))
_HELD = {n: "string" if t == "STRING" else "bigint" for n, t in _PACKET.items() if n != "client_id"}
_TYPES = _PACKET | {"anchor_us": "BIGINT", "anchor_order": "BIGINT", "flow_src_ip": "STRING", "flow_src_port": "INT",
                    "flow_dst_ip": "STRING", "flow_dst_port": "INT", "is_fwd": "BOOLEAN"}
_FIRST = [n for n in ("anchor_us", "anchor_order", *flows.HEAD)]
_NUMBERS = [(n, "BIGINT") for n in flow_state.INTEGERS] + [(n, "DOUBLE") for n in flow_state.FLOATS]
_OUT = "client_id STRING, conversation STRING, " + ", ".join(
    f"{n} {t}" for n, t in [*((n, _TYPES[n]) for n in _FIRST), *_NUMBERS])
_NAMES = [c.split()[0] for c in _OUT.split(", ")]
_OPEN = ", ".join(f"{n} {t}" for n, t in [*((n, _TYPES[n]) for n in _FIRST), ("source", "STRING"), ("port", "BIGINT"), *_NUMBERS])


class Assembly(StatefulProcessor):
    """Flows of one conversation."""

    def __init__(self, timeout_us: int):
        self.timeout_us = timeout_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = Waiting(handle, _HELD, "ts_us", SLICE_US)
        self.open = handle.getValueState("open", _OPEN)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self.waiting.add([pdf[list(_HELD)] for pdf in rows])
        return iter(())

    def _load(self):
        """(first packet's fields, (source, port), state) of the open flow, or nothing."""
        if not self.open.exists():
            return None
        values = self.open.get()
        first = dict(zip(_FIRST, values))
        numbers = values[len(_FIRST) + 2:]
        state = {n: np.array([v], np.int64 if t == "BIGINT" else np.float64) for (n, t), v in zip(_NUMBERS, numbers)}
        return first, tuple(values[len(_FIRST):len(_FIRST) + 2]), state

    def _save(self, flow) -> None:
        first, (source, port), state = flow
        self.open.update(tuple(first[n] for n in _FIRST) + (source, int(port)) + tuple(state[n][0].item() for n, _ in _NUMBERS))

    def _frame(self, key, firsts: dict[str, list], state: flow_state.State) -> pd.DataFrame:
        """Finished flows from the fields of their first packets and their states."""
        done = flow_state.finished(state, np.array(firsts["is_fwd"], bool), np.array(firsts["payload_bytes"], np.int64), True)
        frame = pd.DataFrame({**firsts, **{n: done[n].astype(np.int64 if t == "BIGINT" else np.float64) for n, t in _NUMBERS}})
        for name, kind in _TYPES.items():
            if name in frame and kind in ("INT", "BIGINT"):
                frame[name] = frame[name].astype("int32" if kind == "INT" else "int64")
        frame.insert(0, "client_id", key[0])
        frame.insert(1, "conversation", key[1])
        return frame

    def _runs(self, packets: pd.DataFrame, flow):
        """Where the flows of sorted packets begin, which of them are new, their (source, port), and whether the last is closed."""
        ts, sources, ports = packets["ts_us"].to_numpy(np.int64), packets["src_ip"].tolist(), packets["src_port"].tolist()
        closing = np.flatnonzero(packets["flag_fin"].to_numpy(bool) | packets["flag_rst"].to_numpy(bool))
        begins, fresh, ends, at, closed = [], [], [], 0, flow is None
        if flow:
            start, last, own = flow[0]["anchor_us"], int(flow[2]["last_us"][0]), flow[1]
        while at < len(ts):
            late = not closed and ts[at] - start > self.timeout_us
            new = closed or late
            if new:
                # One that begins because another ran out keeps the endpoints, unless that one was silent.
                inherits = late and ts[at] - last <= self.timeout_us
                start, own = int(ts[at]), own if inherits else (sources[at], int(ports[at]))
            stop = int(np.searchsorted(ts, start + self.timeout_us, "right"))
            ending = int(np.searchsorted(closing, at + 1 if new else at))
            closed = ending < len(closing) and closing[ending] < stop
            stop = int(closing[ending]) + 1 if closed else stop
            begins.append(at)
            fresh.append(new)
            ends.append(own)
            at, last = stop, ts[stop - 1]
        return np.array(begins), fresh, ends, closed

    def _folded(self, key, packets: pd.DataFrame, flow):
        """Fold sorted packets into the open flow and into those after it, all at once: (finished flows, open flow)."""
        begins, fresh, ends, closed = self._runs(packets, flow)
        sizes = np.diff(np.append(begins, len(packets)))
        sources = packets["src_ip"].to_numpy()
        forward = sources == np.repeat(np.array([e[0] for e in ends], object), sizes)
        table = pa.RecordBatch.from_pydict({"is_fwd": forward.astype(bool), **{
            n: packets[n].to_numpy(np.int64) for n in flow_state.NEEDED if n != "is_fwd"}})
        state = flow_state.packet_states(table, np.repeat(np.arange(len(begins)), sizes))
        heads = packets.iloc[begins]
        firsts = {n: (heads[n].astype(bool) if _TYPES[n] == "BOOLEAN" else heads[n]).tolist() for n in _FIRST if n in heads}
        same = [(s, int(p)) == own for s, p, own in zip(heads["src_ip"], heads["src_port"], ends)]
        for to, sides in (("src", ("src", "dst")), ("dst", ("dst", "src"))):
            for field in ("ip", "port"):
                one, other = (heads[f"{side}_{field}"].tolist() for side in sides)
                firsts[f"flow_{to}_{field}"] = [a if s else b for s, a, b in zip(same, one, other)]
        firsts |= {"anchor_us": heads["ts_us"].tolist(), "anchor_order": heads["seq"].tolist(), "is_fwd": forward[begins].astype(bool).tolist()}
        if flow:
            if fresh[0]:  # the open one ran out
                state = {n: np.concatenate([flow[2][n], state[n]]) for n in flow_state.FIELDS}
                firsts = {n: [flow[0][n], *firsts[n]] for n in _FIRST}
                ends = [flow[1], *ends]
            else:
                joined = flow_state.combined(flow[2], flow_state.taken(state, np.array([0])))
                state = {n: np.concatenate([joined[n], state[n][1:]]) for n in flow_state.FIELDS}
                firsts = {n: [flow[0][n], *firsts[n][1:]] for n in _FIRST}
        done = len(ends) if closed else len(ends) - 1
        rest = None if closed else (
            {n: v[-1] for n, v in firsts.items()}, ends[-1], flow_state.taken(state, np.array([done])))
        out = self._frame(key, {n: firsts[n][:done] for n in _FIRST}, flow_state.taken(state, np.arange(done))) if done else None
        return out, rest

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark_ms = timerValues.getCurrentWatermarkInMs()
        flow = self._load()
        packets = self.waiting.passed(watermark_ms)
        if packets is not None:
            packets = packets.sort_values(["ts_us", "seq"], ignore_index=True)
            for at in range(0, len(packets), SLICE_ROWS):
                done, flow = self._folded(key, packets.iloc[at:at + SLICE_ROWS], flow)
                if done is not None:
                    yield done[_NAMES]
        if flow:
            silent_us = int(flow[2]["last_us"][0]) + self.timeout_us
            silent_ms = silent_us // 1000 + 1
            if silent_ms <= watermark_ms and self.waiting.empty_until(silent_us):
                yield self._frame(key, {n: [v] for n, v in flow[0].items()}, flow[2])[_NAMES]
                flow = None
            elif packets is not None:
                self.handle.registerTimer(max(silent_ms, watermark_ms + 1))
        if flow:
            if packets is not None:
                self._save(flow)
        else:
            self.open.clear()

    def close(self) -> None:
        pass


def finished_flows(packets: DataFrame, delay: str = "10 seconds", timeout_us: int = fv.FLOW_TIMEOUT_US) -> DataFrame:
    """Finished flows as states for `flows.state_features`; idle flows are flushed."""
    rows = (
        flows.ip_packets(packets).withColumn("event_time", clock.from_micros(F.col("ts_us")))
        .withWatermark("event_time", delay)
        .withColumn("conversation", network.conversation_key())
    )
    return rows.groupBy("client_id", "conversation").transformWithStateInPandas(
        Assembly(timeout_us), _OUT, "append", "eventTime")


def model_rows(batch: DataFrame) -> DataFrame:
    """Micro-batch of finished flows to model rows."""
    return flows.model_rows(flows.state_features(batch), "client_id", F.col("anchor_order").alias("flow_no"))


def scored_rows(model: network_detection.Model):
    """Per micro-batch: finished flows to scored rows; ``network_alerts`` follows on these."""
    return lambda batch: network_detection.scored(network_detection.scoring_rows(model_rows(batch)), model)
