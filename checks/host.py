"""Host track: sources, rules, indicator matches, counters."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import views
from checks.register import registrar
from nightwarden import fixed_ioc_lists, fixed_values as fv
from nightwarden.functions import clock, numbers, text
from nightwarden.operators import matching, sliding
from nightwarden.plans import host_detection, host_rules
from nightwarden.sources import event_xml, indicators
from nightwarden.session import configure

QUERIES, ORACLES, query = registrar()
H = f"h AS ({views.host_sql()})"


def f(name: str) -> str:
    return f"coalesce(\"{name}\", '')"


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def snip(expr: str, limit: int = fv.SNIPPET_CHARS) -> str:
    return f"(CASE WHEN length({expr}) > {limit} THEN left({expr}, {limit}) || '…' ELSE {expr} END)"


def hit(expr: str, regex: str) -> str:
    return f"regexp_extract({expr}, {quoted('(?i)' + regex)}, 1)"


def severity_sql(expr: str) -> str:
    return f"(CASE WHEN {expr} >= 0.95 THEN 4 WHEN {expr} >= 0.85 THEN 3 WHEN {expr} >= 0.75 THEN 2 ELSE 1 END)"


LAST_PART = lambda e: f"regexp_extract({e}, '([^\\\\/]*)$', 1)"
BASENAME = lambda e: f"lower({LAST_PART(e)})"

# --- sources ----------------------------------------------------------------------

NS = "http://schemas.microsoft.com/win/2004/08/events/event"


@query("event_xml_normalise", f"""
WITH {H}
SELECT log_id, CAST(windows_id AS INT) AS event_id, computer, at_ms, 'Prov' AS provider,
  trim("TargetUserName") AS user_name, trim("IpAddress") AS ip,
  CASE WHEN log_id % 4 = 0 THEN 'x' || CAST(log_id AS VARCHAR) END AS unnamed,
  CASE WHEN log_id % 5 = 0 THEN 'root' ELSE NULL END AS consumer,
  trim("IpAddress") AS ip_lower_key
FROM h WHERE log_id % 13 <> 0""")
def event_xml_normalise(spark, sf_dir):
    """Event XML written from the event table, some of it broken, and read back."""
    configure(spark)
    events = views.host_events(spark, sf_dir)
    tag = lambda name, value: F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))
    data = F.array_join(F.transform(F.map_entries("data"), lambda e: F.concat(
        F.lit("<Data Name='"), e["key"], F.lit("'>"),
        F.replace(F.replace(e["value"], F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("</Data>"))), "")
    number = F.col("log_id").cast("string")
    unnamed = F.when(F.col("log_id") % 4 == 0, tag("Data", F.concat(F.lit("x"), number))).otherwise("")
    repeated = F.lit("<Data Name='Twice'>a</Data><Data Name='Twice'>b</Data>")
    user = F.when(F.col("log_id") % 5 == 0, F.lit("<UserData><o:E xmlns:o='urn:x'><o:Consumer>root</o:Consumer></o:E></UserData>")).otherwise("")
    stamp = F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    xml = F.concat(
        F.lit(f"<Event xmlns='{NS}'><System><Provider Name='Prov'/><EventID>"), F.col("event_code"),
        F.lit("</EventID><Level>0</Level>"), tag("Channel", F.col("channel")), tag("Computer", F.col("computer")),
        F.lit("<TimeCreated SystemTime='"), stamp, F.lit("'/></System><EventData>"),
        # Unnamed values come first so that their position is known.
        unnamed, data, repeated, F.lit("</EventData>"), user, F.lit("</Event>"))
    broken = F.when(F.col("log_id") % 13 == 0, F.substring(xml, 1, 90)).otherwise(xml)
    parsed = event_xml.parse_events(events.select("log_id", broken.alias("raw_xml")))
    return parsed.filter("data['Twice'] = 'b'").select(
        "log_id", "event_id", "computer", F.unix_millis("event_time").alias("at_ms"), "provider",
        text.field("TargetUserName").alias("user_name"), text.field("IpAddress").alias("ip"),
        text.field("data_0").alias("unnamed"), text.field("Consumer").alias("consumer"),
        text.field("ipaddress").alias("ip_lower_key"))


@query("subscription_filter", f"""
WITH {H}
SELECT log_id, CAST(windows_id AS INT) AS event_id FROM h
WHERE windows_id NOT IN (1102, 5157) AND NOT (windows_id = 7045 AND log_id % 2 = 0)""")
def subscription_filter(spark, sf_dir):
    events = views.host_events(spark, sf_dir)
    odd = events.withColumn("channel", F.when(
        F.col("event_id").isin(1102, 5157), "Application").when(
        (F.col("event_id") == 7045) & (F.col("log_id") % 2 == 0), "Security").otherwise(F.col("channel")))
    return event_xml.subscribed(odd).select("log_id", "event_id")


# --- scalar functions -------------------------------------------------------------

@query("source_resolution", f"""
WITH {H}
SELECT log_id,
  CASE WHEN lower(trim({f('IpAddress')})) NOT IN ('-','','::','::1','0.0.0.0','127.0.0.1','localhost') THEN trim({f('IpAddress')})
       WHEN trim({f('WorkstationName')}) NOT IN ('', '-') THEN trim({f('WorkstationName')}) ELSE 'local console' END AS source,
  lower(trim({f('IpAddress')})) NOT IN ('-','','::','::1','0.0.0.0','127.0.0.1','localhost') AS is_network
FROM h WHERE windows_id = 4625""")
def source_resolution(spark, sf_dir):
    return views.host_events(spark, sf_dir).filter("event_id = 4625").select(
        "log_id", text.source_label(text.field("IpAddress"), text.field("WorkstationName")).alias("source"),
        text.source_is_network(text.field("IpAddress")).alias("is_network"))


@query("snippet_basename", f"""
WITH {H}
SELECT log_id, {snip(f('ScriptBlockText'))} AS script, {BASENAME(f('NewProcessName'))} AS process,
  {BASENAME(f('ParentProcessName'))} AS parent FROM h WHERE windows_id IN (4104, 4688)""")
def snippet_basename(spark, sf_dir):
    return views.host_events(spark, sf_dir).filter("event_id in (4104, 4688)").select(
        "log_id", text.snippet(host_rules.value_of("ScriptBlockText")).alias("script"),
        text.basename(text.field("NewProcessName")).alias("process"),
        text.basename(text.field("ParentProcessName")).alias("parent"))


@query("severity_bucket", f"""
SELECT {severity_sql('c')} AS severity, count(*) AS n, min(c) AS lowest, max(c) AS highest
FROM (SELECT round(l_discount * 5 + l_tax * 6.25, 4) AS c FROM lineitem) GROUP BY 1""")
def severity_bucket(spark, sf_dir):
    c = views.read(spark, sf_dir, "lineitem").selectExpr("round(l_discount * 5 + l_tax * 6.25, 4) AS c")
    return c.groupBy(numbers.severity(F.col("c")).alias("severity")).agg(
        F.count("*").alias("n"), F.min("c").alias("lowest"), F.max("c").alias("highest"))


FAMILIES = {
    "download": fv.DOWNLOAD_CRADLE, "encoded": fv.ENCODED_SCRIPT, "reflection": fv.REFLECTION_LOAD,
    "path": fv.SUSPICIOUS_PATH, "shadow": fv.SHADOW_DELETE, "task": fv.SUSPICIOUS_TASK,
}
_PLANT = views.pick("doc_id", "''", "' x Invoke-WebRequest y'", "' -ENC AAA'", "' GetMethod('", "' shadowcopy  delete '",
                    "' C:' || chr(92) || 'temp' || chr(92) || 'q'", "' rundll32'", "' new-object a.b net.webclient'")


@query("pattern_families", f"""
SELECT doc_id, {', '.join(f"{hit('t', r)} AS {n}_hit" for n, r in FAMILIES.items())}
FROM (SELECT doc_id, text || {_PLANT} AS t FROM documents)""")
def pattern_families(spark, sf_dir):
    whole = views.read(spark, sf_dir, "documents").selectExpr("doc_id", f"text || {_PLANT} AS t")
    return whole.select("doc_id", *[text.trigger(F.col("t"), r).alias(f"{n}_hit") for n, r in FAMILIES.items()])


@query("privileged_groups", """
SELECT c_custkey, (%s) AS privileged FROM (SELECT c_custkey, CASE c_custkey %% 5 WHEN 0 THEN 'CORP-Domain Admins'
  WHEN 1 THEN 'Print Operators' WHEN 2 THEN c_mktsegment WHEN 3 THEN 'remote desktop users ' ELSE c_name END AS g FROM customer)"""
       % " OR ".join(f"contains(lower(g), {quoted(g)})" for g in fv.PRIVILEGED_GROUPS))
def privileged_groups(spark, sf_dir):
    g = views.read(spark, sf_dir, "customer").selectExpr(
        "c_custkey", "CASE c_custkey % 5 WHEN 0 THEN 'CORP-Domain Admins' WHEN 1 THEN 'Print Operators' "
        "WHEN 2 THEN c_mktsegment WHEN 3 THEN 'remote desktop users ' ELSE c_name END AS g")
    return g.select("c_custkey", text.in_privileged_group(F.col("g")).alias("privileged"))


_TIMES = views.pick("event_id", "'2024-01-05T10:00:00+00:00'", "CAST(1704067200 + event_id AS STRING) || '.5'", "'never'",
                    "' 2024-02-01T00:00:00.250+00:00 '", "NULL")


@query("timestamp_parse", f"""
SELECT event_id, round(CASE WHEN contains(t, 'T') THEN epoch_us(TRY_CAST(trim(t) AS TIMESTAMPTZ)) / 1000000.0
  ELSE TRY_CAST(trim(t) AS DOUBLE) END, 3) AS seconds FROM (SELECT event_id, {_TIMES} AS t FROM events)""")
def timestamp_parse(spark, sf_dir):
    configure(spark)
    return views.read(spark, sf_dir, "events").selectExpr("event_id", f"{_TIMES} AS t").select(
        "event_id", F.round(clock.parse_time(F.col("t")), 3).alias("seconds"))


@query("clock_format", f"""
SELECT event_id, strftime(make_timestamp({views.CLOCK_MS} * 1000 + event_id % 2 * 43200000000), '%d/%m/%Y %I:%M:%S %p') AS shown
FROM events""")
def clock_format(spark, sf_dir):
    configure(spark)
    return views.read(spark, sf_dir, "events").selectExpr(
        "event_id", f"{views.CLOCK_MS} * 1000 + event_id % 2 * 43200000000 AS us").select(
        "event_id", clock.twelve_hour(F.col("us")).alias("shown"))


# --- rules ------------------------------------------------------------------------

EV = ("event_id", "CAST(windows_id AS INT)")


def same(*names: str):
    return [(n, f(n)) for n in names]


MEMBER = f"coalesce(nullif({f('MemberName')}, ''), nullif({f('MemberSid')}, ''), '')"
GROUP = f"coalesce(nullif({f('TargetUserName')}, ''), nullif({f('GroupName')}, ''), '')"
TASK = f"coalesce(nullif({f('TaskContent')}, ''), nullif({f('TaskName')}, ''), '')"
SCRIPT = f("ScriptBlockText")
SCRIPT_EVIDENCE = lambda regex: [EV, ("trigger", hit(SCRIPT, regex)), ("script_snip", snip(SCRIPT))]
SCRIPT_PATH = [("script_path", "coalesce(\"Path\", '<no path>')")]
DEFENDER = "(CASE windows_id " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in fv.DEFENDER_LABELS.items()) + " END)"
RULE_SQL = {
    "kerberoasting_rc4": (f"windows_id = 4769 AND trim({f('TicketEncryptionType')}) IN ('0x17','23') AND {f('ServiceName')} NOT LIKE '%$'",
                          [EV, *same("ServiceName", "TargetUserName", "ClientAddress"), ("TicketEncryptionType", f"trim({f('TicketEncryptionType')})")]),
    "asrep_roasting": ("windows_id = 4768 AND trim(coalesce(\"PreAuthType\", '1')) = '0'",
                       [EV, *same("TargetUserName", "IpAddress"), ("PreAuthType", f"trim({f('PreAuthType')})")]),
    "ps_download_cradle": (f"windows_id = 4104 AND {hit(SCRIPT, fv.DOWNLOAD_CRADLE)} <> ''", SCRIPT_EVIDENCE(fv.DOWNLOAD_CRADLE) + SCRIPT_PATH),
    "ps_encoded_command": (f"windows_id = 4104 AND {hit(SCRIPT, fv.ENCODED_SCRIPT)} <> ''", SCRIPT_EVIDENCE(fv.ENCODED_SCRIPT) + SCRIPT_PATH),
    "ps_reflection_load": (f"windows_id = 4104 AND {hit(SCRIPT, fv.REFLECTION_LOAD)} <> ''", SCRIPT_EVIDENCE(fv.REFLECTION_LOAD)),
    "psexec_lateral_movement": (f"windows_id = 7045 AND upper({f('ServiceName')}) = 'PSEXESVC'", [EV, *same("ServiceName", "ImagePath", "AccountName")]),
    "new_service_suspicious_path": (f"windows_id = 7045 AND upper({f('ServiceName')}) <> 'PSEXESVC' AND {hit(f('ImagePath'), fv.SUSPICIOUS_PATH)} <> ''",
                                    [EV, *same("ServiceName", "ImagePath", "AccountName")]),
    "wmi_persistence": ("windows_id = 5861", [EV, ("Namespace", f("Namespace")), ("Query", snip(f("Query"), 200)), ("Name", "''"), ("Consumer", "''")]),
    "scheduled_task_created": ("windows_id = 4698", [EV, ("TaskName", f("TaskName")), ("SubjectUser", f("SubjectUserName")), ("computer", "computer")]),
    "scheduled_task_suspicious": (f"windows_id = 4698 AND {hit(TASK, fv.SUSPICIOUS_TASK)} <> ''",
                                  [EV, ("TaskName", f("TaskName")), ("SubjectUser", f("SubjectUserName")), ("task_snip", snip(TASK))]),
    "privileged_group_modification": ("windows_id IN (4728, 4732, 4756) AND (" + " OR ".join(f"contains(lower({GROUP}), {quoted(g)})" for g in fv.PRIVILEGED_GROUPS) + ")",
                                      [EV, ("MemberName", MEMBER), ("GroupName", GROUP), ("SubjectUser", f("SubjectUserName")), ("SubjectDomain", "''")]),
    "security_log_cleared": ("windows_id = 1102", [EV, ("SubjectUser", f("SubjectUserName")), ("computer", "computer"),
                                                   ("timestamp", "strftime(make_timestamp(at_ms * 1000), '%Y-%m-%dT%H:%M:%S.%fZ')")]),
    "audit_policy_changed": ("windows_id = 4719", [EV, ("SubcategoryId", "''"), *same("AuditPolicyChanges", "SubjectUserName")]),
    "defender_disabled": ("windows_id IN (5001, 5010, 5012)", [EV, ("description", DEFENDER), ("computer", "computer")], f"'Windows Defender ' || {DEFENDER}"),
    "shadow_copy_deletion": (f"windows_id = 4688 AND regexp_matches(lower({f('NewProcessName')}), 'vssadmin|wbadmin|bcdedit|wmic') AND {hit(f('CommandLine'), fv.SHADOW_DELETE)} <> ''",
                             [EV, ("Process", f("NewProcessName")), ("CommandLine", snip(f("CommandLine"))), ("ParentProcess", f("ParentProcessName"))]),
}

# Indicator lists as SQL rows.
_list = lambda t: t.strip().splitlines()
NUM = lambda e: f"(CAST(split_part({e}, '.', 1) AS BIGINT) * 16777216 + CAST(split_part({e}, '.', 2) AS BIGINT) * 65536 + CAST(split_part({e}, '.', 3) AS BIGINT) * 256 + CAST(split_part({e}, '.', 4) AS BIGINT))"


def list_rows(every: int = 1) -> dict[str, str]:
    """The four lists, or every n-th entry of each, as SQL rows."""
    entries = lambda t: list(enumerate(_list(t)))[::every]
    domains = ", ".join(f"({quoted(d[2:] if d.startswith('*.') else d)}, {str(d.startswith('*.')).lower()})" for _, d in entries(fixed_ioc_lists.DOMAINS))
    chains = ", ".join("({}, {})".format(*[quoted(x.strip()) for x in c.split("->")]) for _, c in entries(fixed_ioc_lists.PROCESS_CHAINS))
    return {
        "ioc_domain_match": f"dom(entry, is_suffix) AS (VALUES {domains})",
        "ioc_ip_connection": "adr(line_no, entry) AS (VALUES " + ", ".join(f"({i}, {quoted(a)})" for i, a in entries(fixed_ioc_lists.ADDRESSES)) + """),
net AS (SELECT line_no, entry, """ + NUM("split_part(entry, '/', 1)") + """ AS lo, CAST(pow(2, 32 - CAST(split_part(entry, '/', 2) AS INT)) AS BIGINT) AS span
 FROM adr WHERE contains(entry, '/'))""",
        "ioc_process_name": "nam(name) AS (VALUES " + ", ".join(f"({quoted(n)})" for _, n in entries(fixed_ioc_lists.PROCESS_NAMES)) + ")",
        "ioc_process_chain": f"chn(parent, child) AS (VALUES {chains})",
    }


DOMAIN_ROWS, ADDRESS_ROWS, NAME_ROWS, CHAIN_ROWS = list_rows().values()

DOMAIN_HIT = """(SELECT CASE WHEN d.is_suffix THEN '*.' || d.entry ELSE d.entry END FROM dom d
 WHERE (NOT d.is_suffix AND d.entry = q) OR (d.is_suffix AND (q = d.entry OR suffix(q, '.' || d.entry)))
 ORDER BY d.is_suffix, length(d.entry) DESC LIMIT 1)"""
ADDRESS_HIT = f"""coalesce((SELECT min(entry) FROM adr WHERE entry = a AND NOT contains(entry, '/')),
 (SELECT arg_min(entry, line_no) FROM net WHERE regexp_matches(a, '^[0-9.]+$') AND {NUM('a')} BETWEEN lo AND lo + span - 1))"""
DOMAIN_Q = f"regexp_replace(lower({f('QueryName')}), '\\.+$', '')"

IOC_CTES = {
    "ioc_domain_match": (DOMAIN_ROWS, f"""SELECT *, '' AS at_type FROM (SELECT h.*, m.hit FROM h JOIN
      (SELECT q, {DOMAIN_HIT} AS hit FROM (SELECT DISTINCT {DOMAIN_Q} AS q FROM h WHERE windows_id = 3008)) m ON {DOMAIN_Q} = m.q WHERE windows_id = 3008) WHERE hit IS NOT NULL"""),
    "ioc_ip_connection": (ADDRESS_ROWS, f"""SELECT * FROM (SELECT h.*, m.hit FROM h JOIN
      (SELECT a, {ADDRESS_HIT} AS hit FROM (SELECT DISTINCT trim({f('DestAddress')}) AS a FROM h WHERE windows_id = 5156)) m ON trim({f('DestAddress')}) = m.a WHERE windows_id = 5156) WHERE hit IS NOT NULL"""),
    "ioc_process_name": (NAME_ROWS, f"SELECT h.*, nam.name AS hit FROM h JOIN nam ON {BASENAME(f('NewProcessName'))} = nam.name WHERE windows_id = 4688"),
    "ioc_process_chain": (CHAIN_ROWS, f"""SELECT h.*, parent || ' spawning ' || child AS hit FROM h
      JOIN chn ON {BASENAME(f('ParentProcessName'))} = parent AND {BASENAME(f('NewProcessName'))} = child WHERE windows_id = 4688"""),
}
IOC_EVIDENCE = {
    "ioc_domain_match": ([EV, ("QueryName", f("QueryName")), ("MatchedIOC", "hit"), ("QueryResults", "''")], None),
    "ioc_ip_connection": ([EV, *same("DestAddress", "DestPort"), ("SrcAddress", f("SourceAddress")), ("Application", f("Application")), ("MatchedIOC", "hit")], None),
    "ioc_process_name": ([EV, ("NewProcessName", f("NewProcessName")), ("MatchedIOC", "hit"), ("CommandLine", snip(f("CommandLine"))),
                          ("ParentProcess", f("ParentProcessName")), ("SubjectUser", f("SubjectUserName"))], "'Known Attack Tool Executed: ' || hit"),
    "ioc_process_chain": ([EV, ("ParentProcess", f("ParentProcessName")), ("NewProcess", f("NewProcessName")), ("CommandLine", snip(f("CommandLine"))),
                           ("SubjectUser", f("SubjectUserName")), ("chain_reason", "hit")],
                          f"'Suspicious Process Chain: ' || {LAST_PART(f('ParentProcessName'))} || ' -> ' || {LAST_PART(f('NewProcessName'))}"),
}


def row_sql(rule: str, source: str, evidence, attack: str | None = None, count: str = "1") -> str:
    name, confidence, mitre, tactic = fv.HOST_RULES[rule]
    pairs = ", ".join(f"'{k}', {v}" for k, v in evidence)
    return f"""SELECT log_id, computer, '{rule}' AS rule_id, {attack or quoted(name)} AS attack_type, CAST({confidence} AS DOUBLE) AS confidence,
  {severity_sql(confidence)} AS severity, '{mitre}' AS mitre_id, '{tactic}' AS mitre_tactic, CAST({count} AS INT) AS event_count,
  CAST(json_object({pairs}) AS VARCHAR) AS evidence FROM {source}"""


def shown(found):
    return found.select(
        "log_id", "computer", "rule_id", "attack_type", "confidence", numbers.severity(F.col("confidence")).alias("severity"),
        "mitre_id", "mitre_tactic", "event_count", "evidence")


for _rule, (_condition, _evidence, *_attack) in RULE_SQL.items():
    query(f"rule_{_rule}", f"WITH {H}\n" + row_sql(_rule, f"h WHERE {_condition}", _evidence, *_attack))(
        lambda spark, sf_dir, rule=_rule: shown(host_detection.event_detections(views.host_events(spark, sf_dir), rule)))
for _rule, (_rows, _match) in IOC_CTES.items():
    _evidence, _attack = IOC_EVIDENCE[_rule]
    query(f"rule_{_rule}", f"WITH {H}, {_rows}\n" + row_sql(_rule, f"({_match})", _evidence, _attack))(
        lambda spark, sf_dir, rule=_rule: shown(host_detection.indicator_detections(
            views.host_events(spark, sf_dir), indicators.default_indicators(spark), rule)))

SOURCE = f"""CASE WHEN lower(trim({f('IpAddress')})) NOT IN ('-','','::','::1','0.0.0.0','127.0.0.1','localhost') THEN trim({f('IpAddress')})
 WHEN trim({f('WorkstationName')}) NOT IN ('', '-') THEN trim({f('WorkstationName')}) ELSE 'local console' END"""
USER = f("TargetUserName")
WATCHED = {
    "brute_force_logon": f"SELECT *, {SOURCE} AS source, {USER} AS account, {USER} AS val FROM h WHERE windows_id = 4625",
    "password_spray": f"SELECT *, {SOURCE} AS source, '' AS account, {USER} AS val FROM h WHERE windows_id = 4625",
    "net_portscan": f"""SELECT *, trim({f('SourceAddress')}) AS source, '' AS account, trim({f('DestPort')}) AS val FROM h
 WHERE windows_id IN (5156, 5157) AND ({f('Direction')} = '' OR contains("Direction", '14592') OR contains(lower("Direction"), 'inbound'))
 AND trim({f('SourceAddress')}) NOT IN ('', '-', '0.0.0.0', '::', '::1', '127.0.0.1') AND trim({f('DestPort')}) NOT IN ('', '-')""",
}
REACHED = {
    "brute_force_logon": f"total >= {fv.BRUTE_FORCE_MIN_FAILURES}",
    "password_spray": f"total >= {fv.SPRAY_MIN_FAILURES} AND uniq >= {fv.SPRAY_MIN_USERS}",
    "net_portscan": f"uniq >= {fv.PORT_SCAN_MIN_PORTS}",
}
THRESHOLD_EVIDENCE = {
    "brute_force_logon": ([EV, ("src_ip", "source"), ("failure_count", "total"), ("last_username", "val"), ("SubStatus", f("SubStatus"))], "1"),
    "password_spray": ([EV, ("src_ip", "source"), ("distinct_users", "uniq"), ("window_failures", "total"), ("last_username", "val")], "1"),
    "net_portscan": ([EV, ("src_ip", "source"), ("distinct_ports", "uniq"), ("total_events", "total"), ("last_dst_port", "val"), ("last_protocol", f("Protocol"))], "total"),
}
COUNTED = f"""counted AS (SELECT *, count(*) OVER w AS total, CAST(len(list_distinct(list(nullif(val, '')) OVER w)) AS BIGINT) AS uniq FROM watched
 WINDOW w AS (PARTITION BY computer, source, account ORDER BY at_ms RANGE BETWEEN {fv.WINDOW_SECONDS * 1000} PRECEDING AND CURRENT ROW))"""
# The hit that may fire after this one is the first at least a window later.
FIRED = f"""hits AS (SELECT *, row_number() OVER (PARTITION BY computer, source, account ORDER BY at_ms) AS rn,
  min(log_id) OVER (PARTITION BY computer, source, account ORDER BY at_ms RANGE BETWEEN {fv.WINDOW_SECONDS * 1000} FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt
 FROM counted WHERE %s),
fired AS (SELECT log_id, nxt FROM hits WHERE rn = 1 UNION ALL SELECT hits.log_id, hits.nxt FROM fired JOIN hits ON hits.log_id = fired.nxt)"""
for _rule in WATCHED:
    _evidence, _count = THRESHOLD_EVIDENCE[_rule]
    query(f"rule_{_rule}", f"WITH RECURSIVE {H},\nwatched AS ({WATCHED[_rule]}),\n{COUNTED},\n{FIRED % REACHED[_rule]}\n"
          + row_sql(_rule, "hits WHERE log_id IN (SELECT log_id FROM fired)", _evidence, None, _count))(
        lambda spark, sf_dir, rule=_rule: shown(host_detection.threshold_detections(views.host_events(spark, sf_dir), rule)))


@query("sliding_counts", f"WITH {H},\nwatched AS ({WATCHED['password_spray']}),\n{COUNTED}\n"
       "SELECT log_id, computer, source, total AS window_total, uniq AS window_distinct FROM counted")
def sliding_counts(spark, sf_dir):
    rules = [r for r in host_rules.threshold_rules() if r.rule_id == "password_spray"]
    return host_detection.threshold_counts(views.host_events(spark, sf_dir), rules).select(
        "log_id", "computer", "source", "window_total", "window_distinct")


@query("alert_cooldown", f"WITH RECURSIVE {H},\nwatched AS ({WATCHED['net_portscan']}),\n{COUNTED},\n{FIRED % REACHED['net_portscan']}\n"
       "SELECT computer, source, count(*) AS reached, count_if(log_id IN (SELECT log_id FROM fired)) AS fired FROM hits GROUP BY 1, 2")
def alert_cooldown(spark, sf_dir):
    rules = [r for r in host_rules.threshold_rules() if r.rule_id == "net_portscan"]
    counted = host_detection.threshold_counts(views.host_events(spark, sf_dir), rules)
    hits = host_detection.threshold_hits(counted, rules)
    slim = hits.select("rule", "computer", "source", "account", "at_us", "log_id")
    fired = host_detection.cooled_down(slim).groupBy("computer", "source").agg(F.count("*").alias("fired"))
    return slim.groupBy("computer", "source").agg(F.count("*").alias("reached")).join(fired, ["computer", "source"])


def every_rule_sql() -> str:
    """All rules as one statement: head of the WITH clause and the union."""
    parts = [row_sql(r, f"h WHERE {c}", e, *a) for r, (c, e, *a) in RULE_SQL.items()]
    ctes = [H]
    for rule, (rows, match) in IOC_CTES.items():
        ctes.append(rows)
        evidence, attack = IOC_EVIDENCE[rule]
        parts.append(row_sql(rule, f"({match})", evidence, attack))
    for i, rule in enumerate(WATCHED):
        evidence, count = THRESHOLD_EVIDENCE[rule]
        chain = f"watched AS ({WATCHED[rule]}), {COUNTED}, {FIRED % REACHED[rule]}"
        for name in ("watched", "counted", "hits", "fired"):
            import re
            chain = re.sub(rf"\b{name}\b", f"{name}{i}", chain)
        ctes.append(chain)
        parts.append(row_sql(rule, f"hits{i} WHERE log_id IN (SELECT log_id FROM fired{i})", evidence, None, count))
    return "WITH RECURSIVE " + ",\n".join(ctes) + ",\nfound AS (" + "\nUNION ALL\n".join(parts) + ")\n"


def all_detections(spark, sf_dir):
    return host_detection.detections(views.host_events(spark, sf_dir), indicators.default_indicators(spark))


@query("host_detections", every_rule_sql() + "SELECT rule_id, computer, count(*) AS detections, min(log_id) AS first_log, max(confidence) AS confidence FROM found GROUP BY 1, 2")
def host_detections(spark, sf_dir):
    return all_detections(spark, sf_dir).groupBy("rule_id", "computer").agg(
        F.count("*").alias("detections"), F.min("log_id").alias("first_log"), F.max("confidence").alias("confidence"))


@query("engine_counters", every_rule_sql() + "SELECT computer, count_if(rule_id LIKE 'ioc\\_%' ESCAPE '\\') AS ioc_matches, count_if(rule_id NOT LIKE 'ioc\\_%' ESCAPE '\\') AS rule_hits FROM found GROUP BY 1")
def engine_counters(spark, sf_dir):
    return host_detection.counters(all_detections(spark, sf_dir))


@query("alert_envelope", every_rule_sql() + """SELECT sha256(rule_id || '|' || computer || '|' || CAST(log_id AS VARCHAR)) AS alert_id, computer AS client_id, 1 AS track, attack_type, severity, confidence,
  event_count, evidence, rule_id, mitre_id, mitre_tactic,
  (SELECT strftime(make_timestamp(at_ms * 1000), '%Y-%m-%dT%H:%M:%S.%fZ') FROM h WHERE h.log_id = found.log_id) AS window_start FROM found""")
def alert_envelope(spark, sf_dir):
    return host_detection.alerts(all_detections(spark, sf_dir), F.lit("2024-01-02T00:00:00Z")).select(
        "alert_id", "client_id", "track", "attack_type", "severity", "confidence", "event_count", "evidence",
        "rule_id", "mitre_id", "mitre_tactic", "window_start")


@query("empty_command_lines", f"""WITH {H} SELECT computer, count_if(trim({f('CommandLine')}) = '') AS cmdline_missing, count(*) AS process_creations
FROM h WHERE windows_id = 4688 GROUP BY 1""")
def empty_command_lines(spark, sf_dir):
    return host_detection.missing_command_lines(views.host_events(spark, sf_dir))


# --- indicator lists and matches on their own -------------------------------------

_HOST = "split_part(split_part(url, '//', 2), '/', 1)"
PAGE_DOMAIN = views.pick("page_id", f"'  *.' || upper({_HOST}) || '  # seen'", f"{_HOST} || '.'", "'# note'", f"'*.' || {_HOST}",
                         f"substr({_HOST}, 2)", "' '")
PAGE_QUERY = f"CASE WHEN page_id % 3 = 0 THEN 'www.' || {_HOST} || '..' ELSE {_HOST} END"
CLEAN_DOMAINS = f"""lines AS (SELECT page_id, lower(trim(split_part({PAGE_DOMAIN}, '#', 1))) AS e FROM pages),
dom AS (SELECT DISTINCT CASE WHEN e LIKE '*.%' THEN substr(e, 3) ELSE e END AS entry, e LIKE '*.%' AS is_suffix FROM lines WHERE e <> '')"""


@query("ioc_domain_list", f"WITH {CLEAN_DOMAINS} SELECT entry, is_suffix FROM dom")
def ioc_domain_list(spark, sf_dir):
    lines = views.read(spark, sf_dir, "pages").selectExpr("page_id AS line_no", f"{PAGE_DOMAIN} AS value")
    return indicators.domains(lines)


@query("ioc_domain_join", f"""WITH {CLEAN_DOMAINS},
asked AS (SELECT page_id, regexp_replace(lower({PAGE_QUERY}), '\\.+$', '') AS q FROM pages)
SELECT page_id, {DOMAIN_HIT} AS matched FROM asked""")
def ioc_domain_join(spark, sf_dir):
    pages = views.read(spark, sf_dir, "pages")
    lines = pages.selectExpr("page_id AS line_no", f"{PAGE_DOMAIN} AS value")
    asked = pages.selectExpr("page_id", f"{PAGE_QUERY} AS asked")
    return matching.match_domains(asked, "asked", indicators.domains(lines), "matched").select("page_id", "matched")


ADDRESS_LINE = views.pick(
    "s_suppkey", "'10.' || CAST(s_suppkey % 7 AS STRING) || '.3.9/16'", "'10.2.' || CAST(s_suppkey % 200 AS STRING) || '.0/24 # x'",
    "'10.3.1.' || CAST(s_suppkey % 256 AS STRING)", "'10.400.1.1'", "'10.4.0.0/33'", "'10.5.' || CAST(s_suppkey % 99 AS STRING) || '.77/255.255.255.0'")
DEST = "'10.' || CAST(c_nationkey % 8 AS STRING) || '.' || CAST(c_custkey % 5 AS STRING) || '.' || CAST(c_custkey % 250 AS STRING)"
CLEAN_ADDRESSES = f"""lines AS (SELECT s_suppkey AS line_no, trim(split_part({ADDRESS_LINE}, '#', 1)) AS entry FROM supplier),
parts AS (SELECT line_no, entry, split_part(entry, '/', 1) AS base, CASE split_part(entry, '/', 2) WHEN '255.255.255.0' THEN '24' ELSE split_part(entry, '/', 2) END AS mask
 FROM lines WHERE entry NOT LIKE '10.400%' AND entry NOT LIKE '%/33'),
adr AS (SELECT entry, min(line_no) AS line_no FROM parts WHERE mask = '' GROUP BY 1),
masked AS (SELECT line_no, CAST(mask AS INT) AS prefix, CAST(pow(2, 32 - CAST(mask AS INT)) AS BIGINT) AS span, {NUM('base')} AS n FROM parts WHERE mask <> ''),
net AS (SELECT line_no, prefix, span, n - n % span AS lo, CAST((n - n % span) // 16777216 AS VARCHAR) || '.' || CAST((n - n % span) // 65536 % 256 AS VARCHAR) || '.' ||
 CAST((n - n % span) // 256 % 256 AS VARCHAR) || '.' || CAST((n - n % span) % 256 AS VARCHAR) || '/' || CAST(prefix AS VARCHAR) AS entry FROM masked)"""


@query("ioc_address_list", f"""WITH {CLEAN_ADDRESSES}
SELECT entry AS label, lo, lo + span - 1 AS hi, prefix, line_no FROM net
UNION ALL SELECT entry, {NUM('entry')}, {NUM('entry')}, NULL, line_no FROM adr""")
def ioc_address_list(spark, sf_dir):
    return indicators.addresses(views.read(spark, sf_dir, "supplier").selectExpr("s_suppkey AS line_no", f"{ADDRESS_LINE} AS value"))


@query("ioc_address_join", f"""WITH {CLEAN_ADDRESSES}, asked AS (SELECT c_custkey, {DEST} AS a FROM customer)
SELECT c_custkey, coalesce((SELECT min(entry) FROM adr WHERE entry = a),
 (SELECT arg_min(entry, line_no) FROM net WHERE {NUM('a')} BETWEEN lo AND lo + span - 1)) AS matched FROM asked""")
def ioc_address_join(spark, sf_dir):
    lines = views.read(spark, sf_dir, "supplier").selectExpr("s_suppkey AS line_no", f"{ADDRESS_LINE} AS value")
    asked = views.read(spark, sf_dir, "customer").selectExpr("c_custkey", f"{DEST} AS asked")
    return matching.match_addresses(asked, "asked", indicators.addresses(lines), "matched").select("c_custkey", "matched")


BR = "replace(p_brand, '#', CAST(p_size AS STRING))"
NAME_LINE = views.pick("p_partkey", f"upper({BR}) || '.exe # ' || p_type", f"'  ' || {BR} || '.EXE'", "'#' || p_name", f"{BR} || '-x.exe'", "''")
PATH = f"'C:' || {views.B} || p_type || {views.B} || {BR} || CASE WHEN p_size % 2 = 0 THEN '.exe' ELSE '-x.EXE' END"
CHAIN_LINE = views.pick("p_partkey", f"{BR} || ' -> ' || 'cmd.exe # why'", f"{BR} || '->' || 'cmd.exe odd parent'", "'no arrow'", "p_type || ' -> sh'")


@query("ioc_process_list", f"""SELECT DISTINCT lower(trim(split_part({NAME_LINE}, '#', 1))) AS name FROM part WHERE trim(split_part({NAME_LINE}, '#', 1)) <> ''""")
def ioc_process_list(spark, sf_dir):
    return indicators.process_names(views.read(spark, sf_dir, "part").selectExpr("p_partkey AS line_no", f"{NAME_LINE} AS value"))


@query("ioc_process_join", f"""WITH nam AS (SELECT DISTINCT lower(trim(split_part({NAME_LINE}, '#', 1))) AS name FROM part WHERE trim(split_part({NAME_LINE}, '#', 1)) <> '')
SELECT p_partkey, name AS matched FROM (SELECT *, {BASENAME(PATH)} AS b FROM part) LEFT JOIN nam ON b = name""")
def ioc_process_join(spark, sf_dir):
    part = views.read(spark, sf_dir, "part")
    names = indicators.process_names(part.selectExpr("p_partkey AS line_no", f"{NAME_LINE} AS value"))
    asked = part.selectExpr("p_partkey", f"{PATH} AS path")
    return matching.match_process_names(asked, "path", names, "matched").select("p_partkey", "matched")


CHAINS = f"""chn AS (SELECT parent, child, arg_max(CASE WHEN rest = '' THEN parent || ' spawning ' || child ELSE rest END, p_partkey) AS reason FROM (
 SELECT p_partkey, lower(regexp_extract(e, '^(\\S+)\\s*->\\s*(\\S+)(.*)$', 1)) AS parent, lower(regexp_extract(e, '^(\\S+)\\s*->\\s*(\\S+)(.*)$', 2)) AS child,
 trim(regexp_extract(e, '^(\\S+)\\s*->\\s*(\\S+)(.*)$', 3)) AS rest FROM (SELECT p_partkey, trim(split_part({CHAIN_LINE}, '#', 1)) AS e FROM part)
 WHERE regexp_matches(e, '^(\\S+)\\s*->\\s*(\\S+)(.*)$')) GROUP BY 1, 2)"""


@query("ioc_chain_list", f"WITH {CHAINS} SELECT * FROM chn")
def ioc_chain_list(spark, sf_dir):
    return indicators.process_chains(views.read(spark, sf_dir, "part").selectExpr("p_partkey AS line_no", f"{CHAIN_LINE} AS value"))


@query("ioc_chain_join", f"""WITH {CHAINS} SELECT p_partkey, reason FROM part
LEFT JOIN chn ON lower({BR}) = parent AND child = CASE WHEN p_size % 2 = 0 THEN 'cmd.exe' ELSE 'sh' END""")
def ioc_chain_join(spark, sf_dir):
    part = views.read(spark, sf_dir, "part")
    chains = indicators.process_chains(part.selectExpr("p_partkey AS line_no", f"{CHAIN_LINE} AS value"))
    asked = part.selectExpr("p_partkey", f"'D:/x/' || {BR} AS parent_path", "CASE WHEN p_size % 2 = 0 THEN 'CMD.exe' ELSE 'sh' END AS child_path")
    return matching.match_process_chains(asked, "parent_path", "child_path", chains, "reason").select("p_partkey", "reason")


@query("ioc_list_sizes", f"""WITH {CLEAN_DOMAINS.replace('lines AS', 'dlines AS').replace('FROM lines', 'FROM dlines')}, {CLEAN_ADDRESSES}, {CHAINS}
SELECT 'domains' AS list, count(*) AS entries FROM dom UNION ALL SELECT 'ip_ranges', (SELECT count(*) FROM net) + (SELECT count(*) FROM adr)
UNION ALL SELECT 'process_names', (SELECT count(DISTINCT lower(trim(split_part({NAME_LINE}, '#', 1)))) FROM part WHERE trim(split_part({NAME_LINE}, '#', 1)) <> '')
UNION ALL SELECT 'process_chains', (SELECT count(*) FROM chn)""")
def ioc_list_sizes(spark, sf_dir):
    part = views.read(spark, sf_dir, "part")
    return indicators.from_lines(
        views.read(spark, sf_dir, "pages").selectExpr("page_id AS line_no", f"{PAGE_DOMAIN} AS value"),
        views.read(spark, sf_dir, "supplier").selectExpr("s_suppkey AS line_no", f"{ADDRESS_LINE} AS value"),
        part.selectExpr("p_partkey AS line_no", f"{NAME_LINE} AS value"),
        part.selectExpr("p_partkey AS line_no", f"{CHAIN_LINE} AS value"),
    ).sizes()
