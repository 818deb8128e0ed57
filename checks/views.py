"""The given tables seen as security data.

Each view is one list of SQL projections that Spark and the checking SQL both read, so
the two sides start from the same rows. Every view covers its whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from nightwarden import fixed_values as fv

BASE = 1704067200  # 2024-01-01 UTC
# Five events per second with a pause of two minutes after every 500.
CLOCK_MS = f"(CAST({BASE} AS BIGINT) * 1000 + event_id * 200 + CAST(floor(event_id / 500) AS BIGINT) * 120000)"


def pick(number: str, *choices: str) -> str:
    arms = " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(choices))
    return f"(CASE ({number}) % {len(choices)} {arms} END)"


def text(number: str) -> str:
    return f"CAST({number} AS STRING)"


B = "chr(92)"  # backslash, written the same way on both sides
SYS32 = f"'C:' || {B} || 'Windows' || {B} || 'System32' || {B} || "

# Windows event id of each row.
EVENT_ID = f"""(CASE event_type
 WHEN 'error' THEN 4625
 WHEN 'click' THEN CASE WHEN event_id % 3 = 0 THEN 5157 ELSE 5156 END
 WHEN 'view' THEN {pick('event_id', '4688', '4104', '3008')}
 WHEN 'purchase' THEN {pick('event_id', '4769', '4768', '4698', '4732', '4728')}
 ELSE {pick('event_id', '7045', '1102', '4719', '5001', '5010', '5012', '5861', '4756')} END)"""

HOST_HEAD = {
    "log_id": "event_id",
    "at_ms": CLOCK_MS,
    "windows_id": EVENT_ID,
    "computer": f"'pc' || {text('user_id % 2')}",
}
_ON = lambda ids, value: f"CASE WHEN windows_id IN ({ids}) THEN {value} END"
HOT = "user_id % 10 < 4"  # two rows in five share one source
# Event data; NULL means the event lacks the field.
HOST_FIELDS = {
    "IpAddress": _ON("4625, 4768", f"CASE WHEN {HOT} THEN '10.0.0.1' WHEN user_id % 10 = 9 THEN '-' "
                                   f"WHEN user_id % 10 = 8 THEN ' ' ELSE '10.0.0.' || {text('user_id % 10')} END"),
    "WorkstationName": _ON("4625", f"CASE WHEN user_id % 10 = 8 THEN 'WS' || {text('user_id % 3')} ELSE '-' END"),
    "TargetUserName": _ON(
        "4625, 4768, 4769, 4732, 4728, 4756",
        f"CASE WHEN windows_id = 4732 THEN 'BUILTIN-Administrators' WHEN windows_id = 4728 THEN '' "
        f"WHEN windows_id = 4756 THEN 'Helpdesk' WHEN event_id % 29 = 0 THEN '' "
        f"WHEN event_id % 3 > 0 AND {HOT} THEN 'admin' ELSE 'u' || {text('user_id % 37')} END"),
    "SubStatus": _ON("4625", "'0xC000006A'"),
    "TicketEncryptionType": _ON("4769", pick("user_id", "'0x17'", "'0x12'", "' 23 '", "'0x11'")),
    "ServiceName": _ON("4769, 7045", f"CASE WHEN windows_id = 7045 THEN "
                                     f"{pick('user_id', chr(39) + 'psexesvc' + chr(39), chr(39) + 'Updater' + chr(39), chr(39) + 'Spool' + chr(39))} "
                                     f"WHEN user_id % 5 = 0 THEN 'PC$' ELSE 'svc' || {text('user_id % 9')} END"),
    "ClientAddress": _ON("4769", f"'10.2.0.' || {text('user_id % 20')}"),
    "PreAuthType": _ON("4768", pick("user_id", "'0'", "' 0 '", "'2'", "NULL")),
    "ScriptBlockText": _ON("4104", pick(
        "user_id", "'iex (New-Object Net.WebClient).DownloadString(1)'",
        "'$a = [convert]::frombase64string($b) ' || repeat('x', 400)",
        "'[Reflection.Assembly]::Load($b)'", "'Get-ChildItem ' || props", "'powershell -enc AAAA'")),
    "Path": _ON("4104", "CASE WHEN user_id % 2 = 0 THEN 'C:/s.ps1' END"),
    "ImagePath": _ON("7045", pick(
        "event_id + user_id", f"'C:' || {B} || 'Temp' || {B} || 'a.exe'", "'C:/Program Files/a.exe'",
        f"'C:' || {B} || 'Users' || {B} || 'bob' || {B} || 'Downloads' || {B} || 'b.exe'")),
    "AccountName": _ON("7045", "'LocalSystem'"),
    "Namespace": _ON("5861", "'root/subscription'"),
    "Query": _ON("5861", "'SELECT * FROM x ' || repeat('y', 250)"),
    "TaskContent": _ON("4698", pick("user_id", "'<Exec>PowerShell -w hidden</Exec>'", "''", "NULL")),
    "TaskName": _ON("4698", pick("event_id + user_id", "'backup'", "'mshta-job'")),
    "SubjectUserName": _ON("4698, 4732, 4719, 1102, 4688", f"'admin' || {text('user_id % 4')}"),
    "GroupName": _ON("4728", "'Domain Admins'"),
    "MemberName": _ON("4732, 4728, 4756", f"CASE WHEN user_id % 2 = 0 THEN 'cn=u' || {text('user_id % 7')} ELSE '' END"),
    "MemberSid": _ON("4732, 4728, 4756", "'S-1-5-21'"),
    "AuditPolicyChanges": _ON("4719", "'%%8448'"),
    "NewProcessName": _ON("4688", SYS32 + pick(
        "user_id", "'powershell.exe'", "'cmd.exe'", "'Mimikatz.EXE'", "'vssadmin.exe'", "'notepad.exe'", "'NGROK.exe'")),
    "ParentProcessName": _ON("4688", pick(
        "event_id + user_id", f"'C:' || {B} || 'Office' || {B} || 'WINWORD.EXE'", "'C:/Windows/explorer.exe'",
        "'services.exe'", "'C:/Tools/chrome.exe'", "''")),
    "CommandLine": _ON("4688", pick(
        "event_id + user_id", "'vssadmin  Delete  Shadows /all'", "''", "'   '", "'run ' || props", "NULL")),
    "QueryName": _ON("3008", pick(
        "user_id", f"'Evil{'{0}'}.ddns.net'".replace("{0}", "' || " + text("user_id % 11") + " || '"),
        "'pastebin.com.'", "'DDNS.NET'", "'www.example.org'", "'a.b.ngrok.io.'", "'notddns.net'",
        "'beacon.cobaltstrike.com'")),
    "Direction": _ON("5156, 5157", "CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 4 = 0 THEN '%%14593' "
                                   "WHEN event_id % 4 = 1 THEN 'Inbound' ELSE '%%14592' END"),
    "SourceAddress": _ON("5156, 5157", f"CASE WHEN event_id % 31 = 0 THEN '127.0.0.1' WHEN {HOT} THEN '10.1.0.1' "
                                       f"ELSE '10.1.0.' || {text('user_id % 12')} END"),
    "DestPort": _ON("5156, 5157", f"CASE WHEN event_id % 37 = 0 THEN '-' ELSE {text('(user_id * 7 + event_id) % 11')} END"),
    "DestAddress": _ON("5156", pick(
        "event_id + user_id", f"'185.220.101.' || {text('event_id % 40')}", f"'159.203.' || {text('user_id % 100')} || '.7'",
        "'8.8.8.8'", "'45.33.32.156'", "'not-an-ip'", f"'104.236.1.' || {text('user_id')}")),
    "Application": _ON("5156", "'app.exe'"),
    "Protocol": _ON("5156, 5157", "'6'"),
}

EVENT_COLUMNS = {name: name for name in ("event_id", "user_id", "event_type", "props")}


def host_sql() -> str:
    inner = select_sql({**HOST_HEAD, **EVENT_COLUMNS}, "events")
    return select_sql({**{name: name for name in HOST_HEAD}, **HOST_FIELDS}, f"({inner}) AS numbered")


CONV = f"(CASE WHEN {HOT} THEN 0 ELSE user_id % 8 END)"
FORWARD = "(event_id * 31 + user_id) % 5 < 3"
_SIDE = lambda fwd, bwd: f"CASE WHEN {FORWARD} THEN {fwd} ELSE {bwd} END"
_A_IP, _B_IP = f"'192.168.1.' || {text(f'10 + {CONV} * 30')}", "'10.0.0.1'"
_A_PORT, _B_PORT = f"CAST(40000 + {CONV} AS INT)", f"CAST({pick(CONV, '80', '443', '22', '8080')} AS INT)"
PACKETS = {
    "client_id": f"'c' || {text(f'{CONV} % 3')}",
    "seq": "event_id",
    "src_ip": _SIDE(_A_IP, _B_IP),
    "dst_ip": _SIDE(_B_IP, _A_IP),
    "src_port": _SIDE(_A_PORT, _B_PORT),
    "dst_port": _SIDE(_B_PORT, _A_PORT),
    "protocol": f"CASE WHEN {CONV} = 5 THEN 17 ELSE 6 END",
    "ts_us": f"{CLOCK_MS} * 1000 + (event_id * 7919) % 1000 * 37",
    "payload_bytes": "CASE WHEN event_type = 'view' THEN 0 ELSE CAST(floor(value * 4) AS INT) END",
    "header_bytes": "CASE WHEN event_id % 7 = 0 THEN 32 ELSE 20 END",
    "tcp_window": "CAST((event_id * 13) % 65536 AS INT)",
    "flag_fin": "event_type = 'signup' AND event_id % 5 = 0",
    "flag_syn": "event_id % 9 = 0",
    "flag_rst": "event_type = 'error' AND event_id % 11 = 0",
    "flag_psh": "event_id % 4 = 0",
    "flag_ack": "event_id % 2 = 0",
    "flag_urg": "event_id % 50 = 0",
    "flag_cwe": "event_id % 60 = 0",
    "flag_ece": "event_id % 70 = 0",
}

_PORT = pick("l_partkey", "22", "21", "80", "443", "8080", "53", "5353", "3389", "1000 + l_partkey % 400", "1200 + l_suppkey", "8000", "445")
_ZERO = "l_orderkey % 97 = 0"  # rows without any signal
_DOUBLE = lambda x: f"CASE WHEN {_ZERO} THEN CAST(0 AS DOUBLE) ELSE CAST({x} AS DOUBLE) END"
FLOW_HEAD = {
    "flow_no": "l_orderkey * 10 + l_linenumber",
    "client_id": f"'c' || {text('l_suppkey % 5')}",
    "FlowStartTime": f"CASE WHEN l_orderkey % 211 = 0 THEN NULL ELSE CAST({BASE} + (l_orderkey * 7) % 3000 AS DOUBLE) + l_linenumber / 8 END",
}
FLOW_FEATURES = {
    "DestinationPort": f"CAST({_PORT} AS DOUBLE)",
    "FlowDurationMs": _DOUBLE("(l_partkey * 37) % 1000 * CASE WHEN l_returnflag = 'R' THEN 100 ELSE 5000 END"),
    "TotalFwdPackets": _DOUBLE("1 + l_quantity % 25"),
    "TotalLenFwdPackets": _DOUBLE("l_quantity * 40"),
    "FwdPacketLenMax": _DOUBLE("l_extendedprice % 1400"),
    "FwdPacketLenMin": _DOUBLE("l_linenumber * 10"),
    "FwdPacketLenMean": _DOUBLE("l_extendedprice % 700"),
    "FwdPacketLenStd": _DOUBLE("l_extendedprice % 90"),
    "BwdPacketLenMax": _DOUBLE("l_quantity * 20"),
    "BwdPacketLenMin": _DOUBLE("l_linenumber"),
    "BwdPacketLenMean": _DOUBLE("l_quantity * 7"),
    "BwdPacketLenStd": _DOUBLE("l_quantity * 3"),
    "FlowBytesPerSec": _DOUBLE("(l_partkey * 7919) % 3000 * 1000"),
    "FlowPacketsPerSec": _DOUBLE("(l_suppkey * 131 + l_linenumber) % 2000"),
    "FwdPacketsPerSec": _DOUBLE("(l_suppkey * 17) % 1000"),
    "BwdPacketsPerSec": _DOUBLE("CASE WHEN l_linestatus = 'O' THEN 0 ELSE l_linenumber * 3 END"),
    "FlowIATMean": _DOUBLE("l_partkey % 1000 * 10"),
    "FlowIATStd": _DOUBLE("l_partkey % 500 * 10"),
    "FlowIATMax": _DOUBLE("l_partkey % 1000 * 100"),
    "FlowIATMin": _DOUBLE("l_linenumber"),
    "FwdIATTotal": _DOUBLE("l_partkey % 1000 * 500"),
    "FwdIATMean": _DOUBLE("l_partkey % 900 * 10"),
    "FwdIATStd": _DOUBLE("l_suppkey * 1000 % 90000"),
    "FwdIATMax": _DOUBLE("l_partkey % 800 * 100"),
    "FwdIATMin": _DOUBLE("l_linenumber * 2"),
    "BwdIATTotal": _DOUBLE("l_partkey % 700 * 500"),
    "BwdIATMean": _DOUBLE("l_partkey % 600 * 10"),
    "BwdIATStd": _DOUBLE("l_partkey % 300 * 10"),
    "BwdIATMax": _DOUBLE("l_partkey % 1000 * 3000"),
    "BwdIATMin": _DOUBLE("l_linenumber * 3"),
    "MinPacketLength": _DOUBLE("l_quantity * 3"),
    "MaxPacketLength": _DOUBLE("l_quantity * 30"),
    "FINFlagCount": _DOUBLE("l_linenumber % 3 % 2"),
    "PSHFlagCount": _DOUBLE("CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END"),
    "ACKFlagCount": _DOUBLE("CASE WHEN l_linenumber > 4 THEN 0 ELSE 2 END"),
    "InitWinBytesFwd": _DOUBLE("CASE WHEN l_returnflag = 'N' THEN 65535 ELSE 8192 END"),
    "InitWinBytesBwd": _DOUBLE("l_partkey % 8192"),
    "AveragePacketSize": _DOUBLE("l_quantity * 7 % 350"),
}

ATTACK = "(CASE event_type WHEN 'error' THEN 'Password Spray Attack' WHEN 'click' THEN 'Port Scan' WHEN 'view' THEN 'Known Attack Tool Executed: x' WHEN 'purchase' THEN '' ELSE 'UDP Flood' END)"
ALERTS = {
    # Every twentieth alert is sent a second time under the id of the one before it.
    "alert_id": f"'a' || {text('CASE WHEN event_id % 20 = 0 AND event_id > 0 THEN event_id - 1 ELSE event_id END')}",
    "arrival": "event_id",
    "received_at": f"CAST({CLOCK_MS} AS DOUBLE) / 1000",
    "client_id": f"CASE WHEN {HOT} THEN 'PC-0' ELSE 'pc-' || {text('user_id % 10')} END",
    "client_ip": f"'10.9.0.' || {text('user_id % 10')}",
    "track": "CASE WHEN event_type IN ('click', 'signup') THEN 2 WHEN user_id % 13 = 0 THEN 0 ELSE 1 END",
    "attack_type": ATTACK,
    "severity": "CAST(user_id % 4 + 1 AS INT)",
    "confidence": "round(CAST(50 + event_id * 37 % 50 AS DOUBLE) / 100, 4)",
    "event_count": "CAST(event_id % 3 AS INT)",
    "rule_id": "CASE WHEN event_id % 4 = 0 THEN '' WHEN event_type = 'click' THEN 'net_portscan' ELSE 'rule_' || event_type END",
    "mitre_id": f"CASE WHEN event_id % 5 = 0 THEN 'T' || {text('event_id % 7')} ELSE '' END",
    "window_start": f"CASE WHEN event_id % 6 = 0 THEN NULL WHEN event_id % 7 = 0 THEN 'soon' ELSE CAST({BASE} + event_id % 2900 AS STRING) END",
    "window_end": f"CAST({BASE} + event_id % 2900 + 20 AS STRING)",
    "status_sent": "CASE event_id % 9 WHEN 0 THEN 'resolved' WHEN 1 THEN 'false_positive' WHEN 2 THEN 'open' WHEN 3 THEN 'bogus' END",
}

HEARTBEATS = {
    "client_id": f"'c' || {text('o_custkey % 211')}",
    "beat": "o_orderkey",
    "client_ip": f"'10.3.0.' || {text('o_orderkey % 9')}",
    "last_seen": f"CAST({BASE} + (o_orderkey * 7) % 5000 AS DOUBLE)",
    "uptime_seconds": "CAST(floor(o_totalprice) AS INT)",
    "host_track_ok": "o_orderstatus <> 'F'",
    "net_track_ok": "o_orderstatus = 'O'",
    "rule_hits_total": "CAST(o_orderkey % 1000 AS INT)",
}

TRUTH_LOG = {
    "line_no": "event_id",
    "unix_us": f"CASE WHEN event_id % 41 = 0 THEN 'n/a' ELSE CAST(CAST({BASE} AS BIGINT) * 1000000 + event_id * 290001 AS STRING) END",
    "event": "CASE WHEN event_type IN ('click', 'error') THEN 'PHASE_START' WHEN event_type = 'view' THEN 'NOTE' ELSE 'PHASE_END' END",
    "attack_type": f"'atk' || {text('user_id % 7')}",
    "client_id": f"'c' || {text('user_id % 7 % 5')}",
}

UPDATES = {
    "update_no": "vec_id",
    "received_at": f"CAST({BASE} + vec_id AS DOUBLE)",
    "client_id": f"'c' || {text('vec_id % 20')}",
    "track": "CASE WHEN label % 5 = 0 THEN 1 ELSE 2 END",
    "sample_count": "CAST(CASE WHEN vec_id % 31 = 0 THEN 0 WHEN vec_id % 37 = 0 THEN 100001 ELSE vec_id * 37 % 900 + 1 END AS INT)",
    "base_round": "CAST(vec_id % 4 AS INT)",
}


def select_sql(view: dict[str, str], table: str) -> str:
    columns = ",\n  ".join(f'{expr} AS "{name}"' for name, expr in view.items())
    return f"SELECT {columns}\nFROM {table}"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def project(df: DataFrame, view: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{expr} AS `{name}`" for name, expr in view.items()])


def host_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_events_of(read(spark, sf_dir, "events"))


def host_events_of(events: DataFrame) -> DataFrame:
    """Event table (or stream) with its data map, as the readers deliver it."""
    flat = project(
        project(events, {**HOST_HEAD, **EVENT_COLUMNS}),
        {**{name: name for name in HOST_HEAD}, **HOST_FIELDS},
    )
    filled = F.filter(
        F.array(*[F.struct(F.lit(n).alias("key"), F.col(f"`{n}`").alias("value")) for n in HOST_FIELDS]),
        lambda e: e["value"].isNotNull(),
    )
    channels = F.lit("Security")
    for channel, ids in fv.SUBSCRIPTIONS.items():
        channels = F.when(F.col("windows_id").isin(*ids), channel).otherwise(channels)
    return flat.select(
        "log_id", F.lit("provider").alias("provider"), F.col("windows_id").cast("int").alias("event_id"),
        F.col("windows_id").cast("string").alias("event_code"), F.lit("0").alias("level"),
        channels.alias("channel"), "computer", F.timestamp_millis("at_ms").alias("event_time"),
        F.map_from_entries(filled).alias("data"), F.lit("").alias("raw_xml"),
    )


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project(read(spark, sf_dir, "events"), PACKETS)


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project(read(spark, sf_dir, "lineitem"), {**FLOW_HEAD, **FLOW_FEATURES})


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project(read(spark, sf_dir, "events"), ALERTS)


def heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project(read(spark, sf_dir, "orders"), HEARTBEATS)


def truth_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project(read(spark, sf_dir, "events"), TRUTH_LOG)


def updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Client updates; the 64 numbers of a vector become two layers, two biases, scalers."""
    source = read(spark, sf_dir, "embeddings")
    flat = source.selectExpr(
        *[f"{expr} AS `{name}`" for name, expr in UPDATES.items()],
        "transform(embedding, x -> cast(x as double)) AS w",
    )
    layer = lambda start, rows, cols: F.struct(
        F.slice("w", start, rows * max(cols, 1)).alias("values"), F.lit(rows).alias("rows"),
        F.lit(cols).alias("cols"))
    with_scaler = F.col("update_no") % 3 == 0
    empty = F.array().cast("array<double>")
    return flat.select(
        "update_no", "received_at", "client_id", "track", "sample_count", "base_round",
        F.element_at("w", 64).alias("local_loss"),
        F.array(layer(1, 8, 4), layer(33, 4, 3)).alias("coefs"),
        F.array(layer(45, 4, 0), layer(49, 3, 0)).alias("intercepts"),
        F.when(with_scaler, F.slice("w", 52, 6)).otherwise(empty).alias("scaler_mean"),
        F.when(with_scaler, F.slice("w", 58, 6)).otherwise(empty).alias("scaler_scale"),
    )
