"""Packets to bidirectional flows with 84 columns.

Packets are ordered by (time, capture order) inside a conversation, i.e. both directions of
one 5-tuple seen by one client. A flow lasts at most the timeout from its first packet.
`packet_features` folds flows into mergeable states (`operators/flow_state`) where they are
marked; the per-packet plans (`inter_arrival`, `active_idle`, `payload_runs`) are windows by flow.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from nightwarden import fixed_values as fv
from nightwarden.functions import clock, network
from nightwarden.functions.numbers import INF, finite_or_zero, or_nan
from nightwarden.operators import flow_state
from nightwarden.operators.anchors import anchor_rows, changes
from nightwarden.session import checkpointed

CONVERSATION = ["client_id", "conversation"]
FLOW_KEY = [*CONVERSATION, "anchor_us", "anchor_order"]
FLAGS = flow_state.FLAGS
CHUNK_TIMEOUTS = 40


def ip_packets(packets: DataFrame) -> DataFrame:
    """TCP and UDP packets; payload never below zero, UDP header always 8 bytes."""
    return packets.filter(F.col("protocol").isin(*fv.PROTOCOL_NUMBERS.values())).withColumns({
        "payload_bytes": F.greatest(F.lit(0), "payload_bytes"),
        "header_bytes": F.when(F.col("protocol") == 17, 8).otherwise(F.col("header_bytes")),
    })


def assign_flows(
    packets: DataFrame, timeout_us: int = fv.FLOW_TIMEOUT_US, bidirectional: bool = True,
    flush_idle: bool = False, chunk_us: int | None = None,
) -> DataFrame:
    """Packets with their flow (``anchor_us``, ``anchor_order``), endpoints and ``is_fwd``.

    A flow ends with a FIN or RST (included) or when a packet comes later than the timeout
    after its first packet; a flow that starts for the latter reason keeps the endpoints of
    the one before. ``flush_idle`` is the live form: a flow silent for longer than the
    timeout was already flushed, so the next packet sets new endpoints.
    """
    one = F.struct(F.col("src_ip"), F.col("src_port"))
    two = F.struct(F.col("dst_ip"), F.col("dst_port"))
    keyed = packets.withColumns({
        "conversation": network.conversation_key(),
        "closes": F.col("flag_fin") | F.col("flag_rst"),
        "side": (one <= two).cast("bigint"),
    })
    anchored = anchor_rows(
        keyed, CONVERSATION, "ts_us", "seq", timeout_us, bound_included=True, closes="closes",
        lead="side", idle_us=timeout_us if flush_idle else None, chunk_us=chunk_us,
        costly_input=True,
    )
    same_side = F.col("side") == F.col("lead_value")
    sided = anchored.withColumns({
        "flow_src_ip": F.when(same_side, F.col("src_ip")).otherwise(F.col("dst_ip")),
        "flow_src_port": F.when(same_side, F.col("src_port")).otherwise(F.col("dst_port")),
        "flow_dst_ip": F.when(same_side, F.col("dst_ip")).otherwise(F.col("src_ip")),
        "flow_dst_port": F.when(same_side, F.col("dst_port")).otherwise(F.col("src_port")),
    })
    forward = F.col("src_ip") == F.col("flow_src_ip")
    if not bidirectional:
        forward = forward | ~F.col("is_anchor")
    return sided.withColumn("is_fwd", forward).drop("closes", "side", "lead_value")


def _in_flow() -> tuple:
    ordered = Window.partitionBy(*FLOW_KEY).orderBy("ts_us", "seq")
    return (
        ordered,
        ordered.rowsBetween(Window.unboundedPreceding, -1),
        ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow),
    )


def _latest(condition: Column, value: Column, frame) -> Column:
    return F.last(F.when(condition, value), ignorenulls=True).over(frame)


def inter_arrival(assigned: DataFrame, bidirectional: bool = True) -> DataFrame:
    """Microseconds since the flow's packet before, and since the one before per direction."""
    ordered, before, _ = _in_flow()
    ts, fwd = F.col("ts_us"), F.col("is_fwd")
    seen_fwd = _latest(fwd, ts, before)
    if not bidirectional:
        seen_fwd = F.when(~F.col("is_anchor"), F.coalesce(seen_fwd, F.lit(0)))
    return assigned.withColumns({
        "packet_no": F.row_number().over(ordered),
        "flow_iat": ts - F.lag(ts).over(ordered),
        "fwd_iat": F.when(fwd, ts - seen_fwd),
        "bwd_iat": F.when(~fwd, ts - _latest(~fwd, ts, before)),
    })


def active_idle(arrivals: DataFrame) -> DataFrame:
    """Active and idle times. They work on gaps: a gap that exceeds the one before it by
    more than the activity timeout ends an active stretch."""
    ordered, before, _ = _in_flow()
    gap = F.coalesce(F.col("flow_iat"), F.lit(0))
    previous = F.coalesce(F.lag(gap).over(ordered), F.lit(0))
    staged = arrivals.withColumns({"_gap": gap, "_previous_gap": previous}).withColumn(
        "_jump", F.col("_gap") - F.col("_previous_gap") > fv.ACTIVITY_TIMEOUT_US)
    began = F.coalesce(_latest(F.col("_jump"), F.col("_gap"), before), F.lit(0))
    stretch = F.col("_previous_gap") - began
    return staged.withColumns({
        "active_us": F.when(F.col("_jump") & (stretch > 0), stretch),
        "idle_us": F.when(F.col("_jump"), F.col("_gap") - F.col("_previous_gap")),
    }).drop("_gap", "_previous_gap", "_jump")


def _payload_marks(packets: DataFrame) -> DataFrame:
    """Position of a payload packet in its run; a run ends at a gap of over a second."""
    _, before, upto = _in_flow()
    ts, loaded = F.col("ts_us"), F.col("payload_bytes") > 0
    seen = _latest(loaded, ts, before)
    staged = packets.withColumn("_seen", seen).withColumn(
        "_opens", loaded & (F.col("_seen").isNull() | (ts - F.col("_seen") > fv.PAYLOAD_RUN_GAP_US)))
    staged = staged.withColumns({
        "_loaded": F.sum(F.when(loaded, 1)).over(upto),
        "_bytes": F.sum(F.when(loaded, F.col("payload_bytes").cast("bigint"))).over(upto),
    })
    opening = F.struct(
        ts.alias("ts"), (F.col("_loaded") - 1).alias("n"),
        (F.col("_bytes") - F.col("payload_bytes")).alias("bytes"))
    return staged.withColumn("_run", F.when(loaded, _latest(F.col("_opens"), opening, upto)))


def payload_runs(assigned: DataFrame) -> DataFrame:
    """Runs of at least four payload packets, one row per run."""
    return (
        _payload_marks(assigned).filter("_run is not null")
        .groupBy(*FLOW_KEY, F.col("_run.n").alias("run_at"))
        .agg(F.count("*").alias("run_packets"), F.sum("payload_bytes").alias("run_bytes"),
             (F.max("ts_us") - F.min("ts_us")).alias("run_us"))
        .filter(F.col("run_packets") >= fv.PAYLOAD_RUN_MIN_PACKETS)
    )


HEAD = ("src_ip", "dst_ip", "src_port", "dst_port", "protocol", "flow_src_ip", "flow_src_port",
        "flow_dst_ip", "flow_dst_port", "payload_bytes", "tcp_window", "is_fwd", "flag_psh", "flag_urg")


def _state_schema(packets: DataFrame) -> T.StructType:
    first = [f for name in (*FLOW_KEY, *HEAD) for f in packets.schema.fields if f.name == name]
    return T.StructType([
        *first, T.StructField("crosses", T.BooleanType()), *(T.StructField(n, T.LongType()) for n in flow_state.INTEGERS),
        *(T.StructField(n, T.DoubleType()) for n in flow_state.FLOATS)])


def _as_rows(heads: pa.RecordBatch, crosses: np.ndarray, state: flow_state.State) -> pa.RecordBatch:
    names = [*FLOW_KEY, *HEAD]
    return pa.RecordBatch.from_arrays(
        [*heads.select(names).columns, pa.array(crosses), *flow_state.columns(state)], [*names, "crosses", *flow_state.FIELDS])


def _finish(heads: pa.RecordBatch, state: flow_state.State, bidirectional: bool) -> flow_state.State:
    first = lambda name: heads.column(name).to_numpy(zero_copy_only=False)
    return flow_state.finished(state, first("is_fwd").astype(bool), first("payload_bytes"), bidirectional)


def _states(ordered: DataFrame, bidirectional: bool, chunk_us: int | None, timeout_us: int) -> DataFrame:
    """One row per flow and chunk from packets in order; flows that stay in their chunk are finished."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for heads, state in flow_state.rows_of_runs(batches, FLOW_KEY, changes, flow_state.packet_states):
            start = heads.column("anchor_us").to_numpy()
            crosses = np.zeros(len(start), bool) if chunk_us is None else start // chunk_us != (start + timeout_us) // chunk_us
            done = _finish(heads, state, bidirectional)
            state = {name: np.where(crosses, state[name], done[name]) for name in flow_state.FIELDS}
            yield _as_rows(heads, crosses, state)

    needed = dict.fromkeys([*FLOW_KEY, *HEAD, *flow_state.NEEDED])
    return ordered.select(*needed).mapInArrow(run, _state_schema(ordered))


def _met(crossing: DataFrame, bidirectional: bool) -> DataFrame:
    """Stretches of flows that reach into the next chunk, combined and finished."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def states(batch, runs):
            return flow_state.reduced(flow_state.read(batch), runs)[0]
        for heads, state in flow_state.rows_of_runs(batches, FLOW_KEY, changes, states):
            yield _as_rows(heads, np.zeros(heads.num_rows, bool), _finish(heads, state, bidirectional))

    return crossing.repartition(*FLOW_KEY).sortWithinPartitions(*FLOW_KEY, "first_us").mapInArrow(run, crossing.schema)


def _totals(states: DataFrame) -> DataFrame:
    """Figures of a flow under the names that the columns are made from."""
    c = F.col

    def spread(name: str) -> list[Column]:
        n, some = c(f"{name}_n"), c(f"{name}_n") > 0
        # Sums of whole numbers are exact in any order; means met pairwise are not.
        return [F.when(some, c(f"{name}_{m}")).alias(f"{name}_{m}") for m in ("sum", "max", "min")] + [
            F.when(some, c(f"{name}_sum") / n).alias(f"{name}_mean"),
            F.when(n > 1, F.sqrt(c(f"{name}_m2") / (n - 1))).alias(f"{name}_std")]

    return states.select(
        *FLOW_KEY, F.struct(*HEAD).alias("head"), c("first_us").alias("start_us"), c("last_us").alias("end_us"),
        c("fwd_len_n").cast("bigint").alias("fwd_n"), c("bwd_len_n").cast("bigint").alias("bwd_n"),
        *[column for name in flow_state.SPREADS for column in spread(name)], (c("len_m2") / c("len_n")).alias("len_var"),
        c("len_n").cast("bigint").alias("packets"), F.when(c("fwd_len_n") > 0, c("fwd_header_min")).alias("fwd_header_min"),
        F.when(c("bwd_window") >= 0, c("bwd_window")).cast("int").alias("bwd_window"), *flow_state.SUMS)


def state_features(states: DataFrame, bidirectional: bool = True, label: str = "No Label") -> DataFrame:
    """The 84 columns per flow of more than one packet from finished states, preceded by the flow key."""
    counted = F.col("packets") if bidirectional else F.col("fwd_n")
    return _totals(states).withColumn("counted", counted).filter("counted > 1").select(
        *FLOW_KEY, "start_us", *_columns(label))


def packet_features(
    packets: DataFrame, timeout_us: int = fv.FLOW_TIMEOUT_US, bidirectional: bool = True, flush_idle: bool = False,
    chunk_us: int | None = None, label: str = "No Label",
) -> DataFrame:
    """Packets to the 84 columns with one exchange of packets.

    The pass that marks flows also folds them into states, slice by slice. Only stretches of
    flows that start less than a timeout before the end of a chunk meet again, as one row each.
    """
    chunk_us = chunk_us or CHUNK_TIMEOUTS * timeout_us
    assigned = assign_flows(packets, timeout_us, bidirectional, flush_idle, chunk_us)
    states = checkpointed(_states(assigned, bidirectional, chunk_us, timeout_us))
    whole = states.filter(~F.col("crosses")).unionByName(_met(states.filter("crosses"), bidirectional))
    return state_features(whole, bidirectional, label)


def flow_features(assigned: DataFrame, bidirectional: bool = True, label: str = "No Label") -> DataFrame:
    """The 84 columns from packets that have their flow already, in any layout."""
    ordered = assigned.repartition(*FLOW_KEY).sortWithinPartitions(*FLOW_KEY, "ts_us", "seq")
    return state_features(_states(ordered, bidirectional, None, fv.FLOW_TIMEOUT_US), bidirectional, label)


def _columns(label: str) -> list[Column]:
    c, head = F.col, lambda name: F.col(f"head.{name}")
    duration = c("end_us") - c("start_us")
    seconds = duration / float(clock.MICROS)
    zero = F.lit(0.0)

    def stats(name: str, *kinds: str) -> list[Column]:
        return [or_nan(c(f"{name}_{kind}")) for kind in kinds]

    def stats_if(condition: Column, name: str, *kinds: str) -> list[Column]:
        return [F.when(condition, x).otherwise(zero) for x in stats(name, *kinds)]

    def rate(count: Column, at_zero: float) -> Column:
        return F.when(duration > 0, count / seconds).otherwise(F.lit(at_zero))

    def share(total: Column, count: Column) -> Column:
        return F.when(count > 0, total / count).otherwise(zero)

    def whole(total: Column, parts: Column) -> Column:
        return F.when(parts != 0, F.floor(total / parts)).otherwise(F.lit(0)).cast("bigint")

    total = F.coalesce(c("fwd_len_sum"), zero) + F.coalesce(c("bwd_len_sum"), zero)
    # The first payload counts twice in the length statistics: add it to the moments.
    n, extra = c("packets"), head("payload_bytes").cast("double")
    mean = (c("len_sum") + extra) / (n + 1)
    variance = (c("len_var") * n + F.pow(extra - c("len_mean"), 2) * n / (n + 1)) / n
    has_fwd, has_bwd = c("fwd_n") > 0, c("bwd_n") > 0
    head_fwd = head("is_fwd")
    values = [
        network.canonical_flow_id("head.src_ip", "head.dst_ip", "head.src_port", "head.dst_port", "head.protocol"),
        head("flow_src_ip"), head("flow_src_port"), head("flow_dst_ip"), head("flow_dst_port"), head("protocol"),
        clock.twelve_hour(c("start_us")), duration, c("fwd_n"), c("bwd_n"),
        F.coalesce(c("fwd_len_sum"), zero), F.coalesce(c("bwd_len_sum"), zero),
        *stats_if(has_fwd, "fwd_len", "max", "min", "mean", "std"),
        *stats_if(has_bwd, "bwd_len", "max", "min", "mean", "std"),
        rate(total, INF), rate(c("counted"), INF),
        *stats("iat", "mean", "std", "max", "min"),
        *stats_if(c("fwd_n") > 1, "fwd_iat", "sum", "mean", "std", "max", "min"),
        *stats_if(c("bwd_n") > 1, "bwd_iat", "sum", "mean", "std", "max", "min"),
        (head_fwd & head("flag_psh")).cast("int"), (~head_fwd & head("flag_psh")).cast("int"),
        (head_fwd & head("flag_urg")).cast("int"), (~head_fwd & head("flag_urg")).cast("int"),
        c("fwd_header"), c("bwd_header"), rate(c("fwd_n"), 0.0), rate(c("bwd_n"), 0.0),
        c("len_min"), c("len_max"), mean, F.sqrt(variance), variance,
        *[c(f"{flag}_n") for flag in FLAGS],
        F.when(has_fwd, F.floor(c("bwd_n") / c("fwd_n"))).otherwise(0).cast("double"),
        share(c("len_sum") + extra, c("counted")), share(c("fwd_len_sum"), c("fwd_n")),
        share(c("bwd_len_sum"), c("bwd_n")),
        # Forward runs are never counted, and the backward byte average repeats column 62.
        F.lit(0), F.lit(0), F.lit(0), F.lit(0),
        whole(c("run_packets"), c("run_states")),
        F.when(c("run_us") != 0, c("run_bytes") / (c("run_us") / float(clock.MICROS))).otherwise(0).cast("bigint"),
        whole(c("fwd_n"), n), whole(F.coalesce(c("fwd_len_sum"), zero), n),
        whole(c("bwd_n"), n), whole(F.coalesce(c("bwd_len_sum"), zero), n),
        F.when(head_fwd, head("tcp_window")).otherwise(0), F.coalesce(c("bwd_window"), F.lit(0)),
        c("fwd_data"), F.when(head_fwd, c("fwd_header_min")).otherwise(0),
        *stats_if(c("active_sum").isNotNull(), "active", "mean", "std", "max", "min"),
        *stats_if(c("idle_sum").isNotNull(), "idle", "mean", "std", "max", "min"),
        F.lit(label),
    ]
    return [value.alias(name) for value, name in zip(values, fv.FLOW_COLUMNS, strict=True)]


def model_rows(flows84: DataFrame, *keep: str) -> DataFrame:
    """The 38 model features (numbers, 0 where not finite) and the flow start in seconds."""
    return flows84.select(
        *keep,
        *[finite_or_zero(F.col(f"`{source}`")).alias(name) for name, source in fv.MODEL_FEATURE_SOURCES.items()],
        F.round(F.col("start_us") / float(clock.MICROS), 6).alias("FlowStartTime"),
    )
