"""Packets and flows."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import views
from checks.register import registrar
from nightwarden import fixed_values as fv
from nightwarden.functions import network, numbers
from nightwarden.plans import flows, learning

QUERIES, ORACLES, query = registrar()


def packets(spark, sf_dir):
    return flows.ip_packets(views.packets(spark, sf_dir))


def assigned(spark, sf_dir, **kw):
    return flows.assign_flows(packets(spark, sf_dir), **kw)


KEY = """client_id || '|' || least(src_ip || '-' || CAST(src_port AS VARCHAR), dst_ip || '-' || CAST(dst_port AS VARCHAR)) || '|' ||
 greatest(src_ip || '-' || CAST(src_port AS VARCHAR), dst_ip || '-' || CAST(dst_port AS VARCHAR)) || '|' || CAST(protocol AS VARCHAR)"""


def flow_ctes(bidirectional: bool = True, flush_idle: bool = False) -> str:
    """Packets with their flow start (seq of its first packet) and forward flag.

    Each packet points to the start that would follow if a flow began there; the starts are
    then the chain of pointers from the first packet of a key.
    """
    new_chain = "nxt.closed_before" + (f" OR r.ts_us - r.prev_us > {fv.FLOW_TIMEOUT_US}" if flush_idle else "")
    forward = "src_ip = flow_src" + ("" if bidirectional else " OR seq <> flow_seq")
    return f"""pk AS (SELECT *, {KEY} AS k, flag_fin OR flag_rst AS closes FROM (
  SELECT * REPLACE (CASE WHEN protocol = 17 THEN 8 ELSE header_bytes END AS header_bytes) FROM ({views.select_sql(views.PACKETS, 'events')}) AS raw)),
ahead AS (SELECT k, seq, src_ip, ts_us, lag(ts_us) OVER (PARTITION BY k ORDER BY ts_us) AS prev_us, lead(seq) OVER (PARTITION BY k ORDER BY ts_us) AS next_seq,
  min(seq) OVER (PARTITION BY k ORDER BY ts_us RANGE BETWEEN {fv.FLOW_TIMEOUT_US + 1} FOLLOWING AND UNBOUNDED FOLLOWING) AS late_seq,
  min(CASE WHEN closes THEN seq END) OVER (PARTITION BY k ORDER BY ts_us ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS close_seq FROM pk),
pointers AS (SELECT a.seq, CASE WHEN a.close_seq IS NOT NULL AND (a.late_seq IS NULL OR a.close_seq < a.late_seq) THEN c.next_seq ELSE a.late_seq END AS next_start,
  a.close_seq IS NOT NULL AND (a.late_seq IS NULL OR a.close_seq < a.late_seq) AS closed_before
  FROM ahead a LEFT JOIN ahead c ON c.seq = a.close_seq),
starts AS (SELECT seq, src_ip AS flow_src FROM ahead WHERE prev_us IS NULL
  UNION ALL SELECT r.seq, CASE WHEN {new_chain} THEN r.src_ip ELSE starts.flow_src END
  FROM starts JOIN pointers nxt ON nxt.seq = starts.seq JOIN ahead r ON r.seq = nxt.next_start),
placed AS (SELECT pk.*, max(starts.seq) OVER (PARTITION BY k ORDER BY ts_us) AS flow_seq FROM pk LEFT JOIN starts ON starts.seq = pk.seq),
p AS (SELECT *, ({forward}) AS fwd, row_number() OVER (PARTITION BY flow_seq ORDER BY ts_us) AS rn FROM (
  SELECT placed.*, starts.flow_src FROM placed JOIN starts ON starts.seq = placed.flow_seq))"""


IAT = """iat AS (SELECT *, ts_us - lag(ts_us) OVER f AS d, CASE WHEN fwd THEN ts_us - lag(ts_us) OVER fd END AS df,
  CASE WHEN NOT fwd THEN ts_us - lag(ts_us) OVER fd END AS db FROM p
  WINDOW f AS (PARTITION BY flow_seq ORDER BY ts_us), fd AS (PARTITION BY flow_seq, fwd ORDER BY ts_us))"""
ACTIVE = f"""gaps AS (SELECT *, coalesce(d, 0) AS g, coalesce(lag(coalesce(d, 0)) OVER (PARTITION BY flow_seq ORDER BY ts_us), 0) AS pg FROM iat),
jumps AS (SELECT *, g - pg > {fv.ACTIVITY_TIMEOUT_US} AS jump, count_if(g - pg > {fv.ACTIVITY_TIMEOUT_US}) OVER (PARTITION BY flow_seq ORDER BY ts_us) AS jno FROM gaps),
since AS (SELECT j.*, coalesce(b.g, 0) AS began FROM jumps j LEFT JOIN (SELECT flow_seq, jno, g FROM jumps WHERE jump) b
  ON b.flow_seq = j.flow_seq AND b.jno = j.jno - CASE WHEN j.jump THEN 1 ELSE 0 END),
act AS (SELECT *, CASE WHEN jump AND pg - began > 0 THEN pg - began END AS active_us, CASE WHEN jump THEN g - pg END AS idle_us FROM since)"""
RUNS = f"""loaded AS (SELECT *, CASE WHEN ts_us - lag(ts_us) OVER (PARTITION BY flow_seq ORDER BY ts_us) <= {fv.PAYLOAD_RUN_GAP_US} THEN 0 ELSE 1 END AS opens FROM p WHERE payload_bytes > 0),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY flow_seq ORDER BY ts_us) AS run_no FROM loaded),
runs AS (SELECT flow_seq, run_no, count(*) AS run_packets, CAST(sum(payload_bytes) AS BIGINT) AS run_bytes, max(ts_us) - min(ts_us) AS run_us
  FROM numbered GROUP BY 1, 2 HAVING count(*) >= {fv.PAYLOAD_RUN_MIN_PACKETS})"""


@query("packet_keys", f"""
SELECT seq, src_ip || '-' || dst_ip || '-' || CAST(src_port AS VARCHAR) || '-' || CAST(dst_port AS VARCHAR) || '-' || CAST(protocol AS VARCHAR) AS forward_key,
  dst_ip || '-' || src_ip || '-' || CAST(dst_port AS VARCHAR) || '-' || CAST(src_port AS VARCHAR) || '-' || CAST(protocol AS VARCHAR) AS backward_key,
  CASE WHEN list_transform(string_split(src_ip, '.'), lambda o: CASE WHEN CAST(o AS INT) > 127 THEN CAST(o AS INT) - 256 ELSE CAST(o AS INT) END)
          > list_transform(string_split(dst_ip, '.'), lambda o: CASE WHEN CAST(o AS INT) > 127 THEN CAST(o AS INT) - 256 ELSE CAST(o AS INT) END)
   THEN dst_ip || '-' || src_ip || '-' || CAST(dst_port AS VARCHAR) || '-' || CAST(src_port AS VARCHAR) ELSE src_ip || '-' || dst_ip || '-' || CAST(src_port AS VARCHAR) || '-' || CAST(dst_port AS VARCHAR) END
   || '-' || CAST(protocol AS VARCHAR) AS flow_id
FROM ({views.select_sql(views.PACKETS, 'events')}) AS raw""")
def packet_keys(spark, sf_dir):
    return packets(spark, sf_dir).select(
        "seq", network.directional_key("src_ip", "dst_ip", "src_port", "dst_port", "protocol").alias("forward_key"),
        network.directional_key("dst_ip", "src_ip", "dst_port", "src_port", "protocol").alias("backward_key"),
        network.canonical_flow_id().alias("flow_id"))


@query("packet_scan", f"""
SELECT seq, CASE WHEN seq % 5 = 3 THEN 17 ELSE 6 END AS protocol, greatest(0, payload_bytes - 200) AS payload_bytes,
  CASE WHEN seq % 5 = 3 THEN 8 ELSE header_bytes END AS header_bytes
FROM ({views.select_sql(views.PACKETS, 'events')}) AS raw WHERE seq % 5 <> 4""")
def packet_scan(spark, sf_dir):
    mixed = views.packets(spark, sf_dir).withColumns({
        "protocol": F.expr("CASE seq % 5 WHEN 3 THEN 17 WHEN 4 THEN 1 ELSE 6 END"),
        "payload_bytes": F.col("payload_bytes") - 200})
    return flows.ip_packets(mixed).select("seq", "protocol", "payload_bytes", "header_bytes")


@query("flow_assembly", f"""WITH RECURSIVE {flow_ctes()}
SELECT flow_seq, any_value(flow_src) AS flow_src_ip, count(*) AS packets, count_if(fwd) AS fwd_packets, min(ts_us) AS start_us, max(ts_us) AS end_us,
  bool_or(closes) AS has_close FROM p GROUP BY flow_seq""")
def flow_assembly(spark, sf_dir):
    marked = assigned(spark, sf_dir).withColumn("closing", F.col("flag_fin") | F.col("flag_rst"))
    return marked.groupBy(*flows.FLOW_KEY).agg(
        F.min("flow_src_ip").alias("flow_src_ip"), F.count("*").alias("packets"), F.count_if("is_fwd").alias("fwd_packets"),
        F.min("ts_us").alias("start_us"), F.max("ts_us").alias("end_us"), F.bool_or("closing").alias("has_close"),
    ).withColumnRenamed("anchor_order", "flow_seq").drop("client_id", "conversation", "anchor_us")


@query("flow_idle_flush", f"""WITH RECURSIVE {flow_ctes(flush_idle=True)}
SELECT flow_seq, any_value(flow_src) AS flow_src_ip, count(*) AS packets, count_if(fwd) AS fwd_packets FROM p GROUP BY flow_seq""")
def flow_idle_flush(spark, sf_dir):
    return assigned(spark, sf_dir, flush_idle=True).groupBy(*flows.FLOW_KEY).agg(
        F.min("flow_src_ip").alias("flow_src_ip"), F.count("*").alias("packets"), F.count_if("is_fwd").alias("fwd_packets"),
    ).withColumnRenamed("anchor_order", "flow_seq").drop("client_id", "conversation", "anchor_us")


@query("inter_arrival", f"""WITH RECURSIVE {flow_ctes()}, {IAT}
SELECT seq, rn AS packet_no, d AS flow_iat, df AS fwd_iat, db AS bwd_iat FROM iat""")
def inter_arrival(spark, sf_dir):
    return flows.inter_arrival(assigned(spark, sf_dir)).select("seq", "packet_no", "flow_iat", "fwd_iat", "bwd_iat")


@query("payload_runs", f"""WITH RECURSIVE {flow_ctes()}, {RUNS}
SELECT flow_seq, run_packets, run_bytes, run_us FROM runs""")
def payload_runs(spark, sf_dir):
    return flows.payload_runs(assigned(spark, sf_dir)).select(
        F.col("anchor_order").alias("flow_seq"), "run_packets", "run_bytes", "run_us")


@query("active_idle", f"""WITH RECURSIVE {flow_ctes()}, {IAT}, {ACTIVE}
SELECT seq, active_us, idle_us FROM act WHERE jump""")
def active_idle(spark, sf_dir):
    return flows.active_idle(flows.inter_arrival(assigned(spark, sf_dir))).filter("idle_us is not null").select(
        "seq", "active_us", "idle_us")


NAN = "CAST('nan' AS DOUBLE)"


def features_sql(bidirectional: bool = True) -> str:
    """The 84 columns, as (name, SQL) over the totals of a flow."""
    def or_nan(e):
        return f"coalesce(CAST({e} AS DOUBLE), {NAN})"

    def stats(e, *kinds, when=None):
        sql = {"sum": f"sum({e})", "mean": f"avg({e})", "std": f"stddev_samp({e})", "max": f"max({e})", "min": f"min({e})"}
        return [f"CASE WHEN {when} THEN {or_nan(sql[k])} ELSE 0.0 END" if when else or_nan(sql[k]) for k in kinds]

    nf, nb, dur = "count_if(fwd)", "count_if(NOT fwd)", "(max(ts_us) - min(ts_us))"
    counted = "count(*)" if bidirectional else nf
    pf, pb = "CASE WHEN fwd THEN payload_bytes END", "CASE WHEN NOT fwd THEN payload_bytes END"
    sf, sb = f"coalesce(sum({pf}), 0)", f"coalesce(sum({pb}), 0)"
    first = lambda e: f"arg_min({e}, rn)"
    # The first payload takes part twice: a doubled list.
    doubled = "flatten([list(payload_bytes), [arg_min(payload_bytes, rn)]])"
    rate = lambda e, z: f"CASE WHEN {dur} > 0 THEN {e} / ({dur} / 1000000.0) ELSE {z} END"
    inf = "CAST('inf' AS DOUBLE)"
    key = lambda a, b: f"{a}_ip || '-' || {b}_ip || '-' || CAST({a}_port AS VARCHAR) || '-' || CAST({b}_port AS VARCHAR) || '-' || CAST(protocol AS VARCHAR)"
    signed = lambda e: f"list_transform(string_split({e}, '.'), lambda o: CASE WHEN CAST(o AS INT) > 127 THEN CAST(o AS INT) - 256 ELSE CAST(o AS INT) END)"
    flow_id = f"CASE WHEN {signed('src_ip')} > {signed('dst_ip')} THEN {key('dst', 'src')} ELSE {key('src', 'dst')} END"
    turn = lambda a, b: f"{first(f'CASE WHEN src_ip = flow_src THEN {a} ELSE {b} END')}"
    flag = lambda f, side: f"CAST({first(f'{side} AND flag_{f}')} AS INT)"
    sub = lambda e: f"CAST(floor({e} / count(*)) AS BIGINT)"
    has_a, has_i = "count(active_us) > 0", "count(idle_us) > 0"
    columns = [
        first(flow_id), first("flow_src"), turn("src_port", "dst_port"), turn("dst_ip", "src_ip"), turn("dst_port", "src_port"), first("protocol"),
        "strftime(make_timestamp(min(ts_us)), '%d/%m/%Y %I:%M:%S %p')", dur, nf, nb, f"CAST({sf} AS DOUBLE)", f"CAST({sb} AS DOUBLE)",
        *stats(pf, "max", "min", "mean", "std", when=f"{nf} > 0"), *stats(pb, "max", "min", "mean", "std", when=f"{nb} > 0"),
        rate(f"({sf} + {sb})", inf), rate(counted, inf),
        *stats("d", "mean", "std", "max", "min"),
        *stats("df", "sum", "mean", "std", "max", "min", when=f"{nf} > 1"), *stats("db", "sum", "mean", "std", "max", "min", when=f"{nb} > 1"),
        flag("psh", "fwd"), flag("psh", "NOT fwd"), flag("urg", "fwd"), flag("urg", "NOT fwd"),
        "CAST(sum(CASE WHEN fwd THEN header_bytes ELSE 0 END) AS BIGINT)", "CAST(sum(CASE WHEN fwd THEN 0 ELSE header_bytes END) AS BIGINT)",
        rate(nf, "0.0"), rate(nb, "0.0"),
        "CAST(min(payload_bytes) AS DOUBLE)", "CAST(max(payload_bytes) AS DOUBLE)",
        f"list_avg({doubled})", f"list_stddev_samp({doubled})", f"list_var_samp({doubled})",
        *[f"count_if(flag_{f})" for f in flows.FLAGS],
        f"CASE WHEN {nf} > 0 THEN floor({nb} / {nf}) ELSE 0.0 END",
        f"CASE WHEN {counted} > 0 THEN (sum(payload_bytes) + {first('payload_bytes')}) / {counted} ELSE 0.0 END",
        f"CASE WHEN {nf} > 0 THEN {sf} / {nf} ELSE 0.0 END", f"CASE WHEN {nb} > 0 THEN {sb} / {nb} ELSE 0.0 END",
        "0", "0", "0", "0",
        "coalesce(any_value(bulk_packets // bulk_states), 0)",
        "coalesce(any_value(CASE WHEN bulk_us <> 0 THEN CAST(trunc(bulk_bytes / (bulk_us / 1000000.0)) AS BIGINT) ELSE 0 END), 0)",
        sub(nf), sub(sf), sub(nb), sub(sb),
        first("CASE WHEN fwd THEN tcp_window ELSE 0 END"), "coalesce(arg_max(CASE WHEN NOT fwd THEN tcp_window END, CASE WHEN NOT fwd THEN rn END), 0)",
        "count_if(fwd AND rn > 1 AND payload_bytes >= 1)",
        f"CASE WHEN {first('fwd')} THEN min(CASE WHEN fwd THEN header_bytes END) ELSE 0 END",
        *stats("active_us", "mean", "std", "max", "min", when=has_a), *stats("idle_us", "mean", "std", "max", "min", when=has_i),
        "'No Label'",
    ]
    named = ",\n ".join(f'{sql} AS "{name}"' for sql, name in zip(columns, fv.FLOW_COLUMNS, strict=True))
    return f"""bulk AS (SELECT flow_seq AS bulk_flow, count(*) AS bulk_states, sum(run_packets) AS bulk_packets, sum(run_bytes) AS bulk_bytes, sum(run_us) AS bulk_us FROM runs GROUP BY 1),
joined AS (SELECT * FROM act LEFT JOIN bulk ON bulk_flow = flow_seq),
flows84 AS (SELECT flow_seq, min(ts_us) AS start_us, {named} FROM joined GROUP BY flow_seq HAVING {counted} > 1)"""


UNI_IAT = IAT.replace("CASE WHEN fwd THEN ts_us - lag(ts_us) OVER fd END AS df",
                      "CASE WHEN fwd AND rn > 1 THEN ts_us - coalesce(lag(ts_us) OVER fd, 0) END AS df")
ALL_FLOW_CTES = f"WITH RECURSIVE {flow_ctes()}, {IAT}, {ACTIVE}, {RUNS},\n{features_sql()}"
UNI_FLOW_CTES = f"WITH RECURSIVE {flow_ctes(False)}, {UNI_IAT}, {ACTIVE}, {RUNS},\n{features_sql(False)}"
DOUBLES = [n for n in fv.FLOW_COLUMNS if n not in ("Flow ID", "Src IP", "Dst IP", "Timestamp", "Label")]
# In one-way form the first forward gap counts from the epoch: shown in coarser units.
SCALE = lambda n, two_way: 1.0 if two_way or not n.startswith("Fwd IAT") else 1e9


def show_sql(two_way: bool = True) -> str:
    return "flow_seq, " + ", ".join(
        f'round(CAST("{n}" AS DOUBLE) / {SCALE(n, two_way)!r}, 4) AS "{n}"' if n in DOUBLES else f'"{n}"' for n in fv.FLOW_COLUMNS)


def shown(flows84, two_way: bool = True):
    return flows84.select(F.col("anchor_order").alias("flow_seq"), *[
        F.round(F.col(f"`{n}`").cast("double") / SCALE(n, two_way), 4).alias(n) if n in DOUBLES else F.col(f"`{n}`")
        for n in fv.FLOW_COLUMNS])


@query("flow_features_84", f"{ALL_FLOW_CTES}\nSELECT {show_sql()} FROM flows84")
def flow_features_84(spark, sf_dir):
    return shown(flows.packet_features(packets(spark, sf_dir)))


@query("flow_features_unidirectional", f"{UNI_FLOW_CTES}\nSELECT {show_sql(False)} FROM flows84")
def flow_features_unidirectional(spark, sf_dir):
    return shown(flows.packet_features(packets(spark, sf_dir), bidirectional=False), False)


_FINITE = lambda n: f'CASE WHEN isfinite(CAST("{n}" AS DOUBLE)) THEN round(CAST("{n}" AS DOUBLE), 4) ELSE 0.0 END'


@query("model_projection", f"{ALL_FLOW_CTES}\nSELECT flow_seq, "
       + ", ".join(f"{_FINITE(s)} AS {m}" for m, s in fv.MODEL_FEATURE_SOURCES.items())
       + ", round(start_us / 1000000.0, 6) AS FlowStartTime FROM flows84")
def model_projection(spark, sf_dir):
    rows = flows.model_rows(flows.packet_features(packets(spark, sf_dir)), "anchor_order")
    return rows.select(F.col("anchor_order").alias("flow_seq"),
                       *[F.round(m, 4).alias(m) for m in fv.MODEL_FEATURE_SOURCES], "FlowStartTime")


@query("flow_labels_from_truth", f"""{ALL_FLOW_CTES},
log AS ({views.select_sql(views.TRUTH_LOG, 'events')}),
phases AS (SELECT *, CAST(unix_us AS BIGINT) / 1000000.0 AS at_s FROM log WHERE unix_us <> 'n/a' AND event <> 'NOTE'),
lagged AS (SELECT *, lag(event) OVER w AS pe, lag(at_s) OVER w AS pa FROM phases WINDOW w AS (PARTITION BY client_id, attack_type ORDER BY line_no)),
win AS (SELECT client_id, pa AS lo, at_s AS hi FROM lagged WHERE event = 'PHASE_END' AND pe = 'PHASE_START')
SELECT f.flow_seq, EXISTS (SELECT 1 FROM win WHERE win.client_id = pk.client_id AND f.start_us / 1000000.0 BETWEEN lo - 30 AND hi + 30) AS in_attack
FROM flows84 f JOIN pk ON pk.seq = f.flow_seq""")
def flow_labels_from_truth(spark, sf_dir):
    """Label column of the flow file: is the flow inside a ground-truth window?"""
    rows = flows.model_rows(flows.packet_features(packets(spark, sf_dir)), "client_id", "anchor_order")
    windows = learning.truth_windows(views.truth_log(spark, sf_dir))
    return learning.windows_hit(rows, windows).select(F.col("anchor_order").alias("flow_seq"), "in_attack")


@query("summary_statistics", """
SELECT k, count(v) AS v_n, coalesce(sum(v), 0.0) AS v_sum, round(coalesce(min(v), CAST('inf' AS DOUBLE)), 6) AS v_min, coalesce(max(v), CAST('-inf' AS DOUBLE)) AS v_max,
  round(coalesce(avg(v), CAST('nan' AS DOUBLE)), 6) AS v_mean, round(coalesce(var_samp(v), CAST('nan' AS DOUBLE)), 4) AS v_variance, round(coalesce(stddev_samp(v), CAST('nan' AS DOUBLE)), 4) AS v_std
FROM (SELECT o_custkey AS k, CASE WHEN o_orderkey % 3 > 0 THEN CAST(floor(o_totalprice / 1000) AS DOUBLE) END AS v FROM orders) GROUP BY k""")
def summary_statistics(spark, sf_dir):
    rows = views.read(spark, sf_dir, "orders").selectExpr(
        "o_custkey AS k", "CASE WHEN o_orderkey % 3 > 0 THEN CAST(floor(o_totalprice / 1000) AS DOUBLE) END AS v")
    out = rows.groupBy("k").agg(*numbers.summary(F.col("v"), "v"))
    return out.withColumns({"v_mean": F.round("v_mean", 6), "v_variance": F.round("v_variance", 4), "v_std": F.round("v_std", 4)})
