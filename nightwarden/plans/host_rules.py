"""The rule registry: every host rule as Column expressions.

A site adds a rule by appending to one of the lists below; nothing else changes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from nightwarden import fixed_values as fv
from nightwarden.functions import text
from nightwarden.functions.text import field, field_any_case, fill, text_or_empty


@dataclass(frozen=True)
class EventRule:
    """Rule decided by one event alone."""

    rule_id: str
    event_ids: tuple[int, ...]
    condition: Column
    suggestion: Column
    risk_note: Column
    evidence: dict[str, Column]
    attack_type: Column | None = None

    def detection(self) -> Column:
        name, confidence, mitre_id, tactic = fv.HOST_RULES[self.rule_id]
        attack = self.attack_type if self.attack_type is not None else F.lit(name)
        return detection(self.rule_id, attack, confidence, mitre_id, tactic, self.suggestion,
                         self.risk_note, self.evidence, F.lit(1))

    def matched(self) -> Column:
        return F.when(F.col("event_id").isin(*self.event_ids) & self.condition, self.detection())


@dataclass(frozen=True)
class ThresholdRule:
    """Rule on sliding counts per (machine, source, account), fired at most once per window."""

    rule_id: str
    event_ids: tuple[int, ...]
    condition: Column
    fields: tuple[str, ...]  # event data the rule reads; the rest stays behind
    source: Column
    value: Column  # what the distinct count is about
    suggestion: Column
    risk_note: Column
    evidence: dict[str, Column]
    account: Column | None = None
    event_count: Column | None = None
    min_total: int = 0
    min_distinct: int = 0

    def watched(self) -> Column:
        account = self.account if self.account is not None else F.lit("")
        return F.when(
            F.col("event_id").isin(*self.event_ids) & self.condition,
            F.struct(F.lit(self.rule_id).alias("rule"), self.source.alias("source"),
                     account.alias("account"), self.value.alias("value")),
        )

    def reached(self) -> Column:
        return (
            (F.col("rule") == self.rule_id) & (F.col("window_total") >= self.min_total)
            & (F.col("window_distinct") >= self.min_distinct)
        )

    def detection(self) -> Column:
        name, confidence, mitre_id, tactic = fv.HOST_RULES[self.rule_id]
        count = self.event_count if self.event_count is not None else F.lit(1)
        return detection(self.rule_id, F.lit(name), confidence, mitre_id, tactic, self.suggestion,
                         self.risk_note, self.evidence, count)


def detection(rule_id, attack_type, confidence, mitre_id, tactic, suggestion, risk_note,
              evidence, event_count) -> Column:
    return F.struct(
        F.lit(rule_id).alias("rule_id"), attack_type.alias("attack_type"),
        F.lit(float(confidence)).alias("confidence"), F.lit(mitre_id).alias("mitre_id"),
        F.lit(tactic).alias("mitre_tactic"), suggestion.alias("suggestion"),
        risk_note.alias("risk_note"),
        F.to_json(F.struct(*[c.alias(n) for n, c in evidence.items()])).alias("evidence"),
        event_count.cast("int").alias("event_count"),
    )


def value_of(name: str) -> Column:
    return text_or_empty(field(name))


def values(**names: str) -> dict[str, Column]:
    """Evidence entries read straight from event fields."""
    return {shown: value_of(name) for shown, name in names.items()}


def event_rules() -> list[EventRule]:
    event_id = {"event_id": F.col("event_id")}
    script = value_of("ScriptBlockText")
    script_path = F.coalesce(field("Path"), F.lit("<no path>"))
    task = text.first_non_empty(field("TaskContent"), field("TaskContentXml"), field("TaskName"))
    group = text.first_non_empty(field("TargetUserName"), field("GroupName"))
    member = text.first_non_empty(field("MemberName"), field("MemberSid"))
    is_psexec = F.upper(value_of("ServiceName")) == "PSEXESVC"
    command = value_of("CommandLine")
    process = F.lower(value_of("NewProcessName"))
    defender = F.create_map(*[F.lit(x) for pair in fv.DEFENDER_LABELS.items() for x in pair])[F.col("event_id")]

    def script_rule(rule_id: str, regex: str, suggestion: str, risk: str, with_path: bool = True):
        found = text.trigger(script, regex)
        shown = {**event_id, "trigger": found, "script_snip": text.snippet(script)}
        if with_path:
            shown["script_path"] = script_path
        return EventRule(rule_id, (4104,), found != "", F.lit(suggestion), fill(risk, trigger=found), shown)

    return [
        EventRule(
            "kerberoasting_rc4", (4769,),
            text.stripped(value_of("TicketEncryptionType")).isin("0x17", "23")
            & ~F.endswith(value_of("ServiceName"), F.lit("$")),
            fill("Move service account {svc} to AES-only Kerberos and inspect client {client}.",
                 svc=field("ServiceName"), client=field("ClientAddress")),
            F.lit("A ticket sealed with RC4 can be cracked away from the domain."),
            {**event_id, **values(ServiceName="ServiceName", TargetUserName="TargetUserName",
                                  ClientAddress="ClientAddress"),
             "TicketEncryptionType": text.stripped(value_of("TicketEncryptionType"))},
        ),
        EventRule(
            "asrep_roasting", (4768,),
            text.stripped(F.coalesce(field("PreAuthType"), F.lit("1"))) == "0",
            fill("Turn pre-authentication back on for {user} and inspect {ip}.",
                 user=field("TargetUserName"), ip=field("IpAddress")),
            F.lit("The reply hands out material that can be cracked without any logon."),
            {**event_id, **values(TargetUserName="TargetUserName", IpAddress="IpAddress"),
             "PreAuthType": text.stripped(value_of("PreAuthType"))},
        ),
        script_rule(
            "ps_download_cradle", fv.DOWNLOAD_CRADLE,
            "Read the whole script block and find what it fetched.",
            "The script fetches and runs code ({trigger})."),
        script_rule(
            "ps_encoded_command", fv.ENCODED_SCRIPT,
            "Decode the payload and look at the parent process.",
            "Encoded script text ({trigger}) hides the command from logs."),
        script_rule(
            "ps_reflection_load", fv.REFLECTION_LOAD,
            "Keep the script block and a memory image of the process.",
            "Code is loaded into memory by reflection ({trigger}).", with_path=False),
        EventRule(
            "psexec_lateral_movement", (7045,), is_psexec,
            F.lit("Find the machine that installed the service and what it ran."),
            F.lit("A remote party ran a command here with valid credentials."),
            {**event_id, **values(ServiceName="ServiceName", ImagePath="ImagePath",
                                  AccountName="AccountName")},
        ),
        EventRule(
            "new_service_suspicious_path", (7045,),
            ~is_psexec & text.matches(field("ImagePath"), fv.SUSPICIOUS_PATH),
            fill("Inspect the service binary {path} and its signature.", path=field("ImagePath")),
            F.lit("A service started from a user-writable folder."),
            {**event_id, **values(ServiceName="ServiceName", ImagePath="ImagePath",
                                  AccountName="AccountName")},
        ),
        EventRule(
            "wmi_persistence", (5861,), F.lit(True),
            F.lit("List the permanent subscriptions and remove unknown ones."),
            F.lit("A subscription survives restarts and leaves no process to see."),
            {**event_id, "Namespace": value_of("Namespace"),
             "Query": text.snippet(value_of("Query"), 200),
             **values(Name="Name", Consumer="Consumer")},
        ),
        EventRule(
            "scheduled_task_created", (4698,), F.lit(True),
            fill("Confirm that task {task} is wanted.", task=field("TaskName")),
            F.lit("Tasks are a common way to come back after a restart."),
            {**event_id, **values(TaskName="TaskName", SubjectUser="SubjectUserName"),
             "computer": F.col("computer")},
        ),
        EventRule(
            "scheduled_task_suspicious", (4698,), text.matches(task, fv.SUSPICIOUS_TASK),
            fill("Check what task {task} starts and who created it.", task=field("TaskName")),
            F.lit("The task runs a script host or a file from a user-writable folder."),
            {**event_id, **values(TaskName="TaskName", SubjectUser="SubjectUserName"),
             "task_snip": text.snippet(task)},
        ),
        EventRule(
            "privileged_group_modification", (4728, 4732, 4756), text.in_privileged_group(group),
            fill("Confirm that {member} belongs in {group}; undo the change otherwise.",
                 member=F.nullif(member, F.lit("")), group=F.nullif(group, F.lit(""))),
            F.lit("The account keeps raised rights until it is removed."),
            {**event_id, "MemberName": member, "GroupName": group,
             **values(SubjectUser="SubjectUserName", SubjectDomain="SubjectDomainName")},
        ),
        EventRule(
            "security_log_cleared", (1102,), F.lit(True),
            F.lit("Ask who cleared the log and read forwarded copies."),
            F.lit("Evidence on this machine is gone."),
            {**event_id, "SubjectUser": text_or_empty(field_any_case("SubjectUserName")),
             "computer": F.col("computer"),
             "timestamp": F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")},
        ),
        EventRule(
            "audit_policy_changed", (4719,), F.lit(True),
            F.lit("Check that the change was planned; restore the policy otherwise."),
            F.lit("With auditing off, the next steps leave no trace."),
            {**event_id, **values(SubcategoryId="SubcategoryId",
                                  AuditPolicyChanges="AuditPolicyChanges",
                                  SubjectUserName="SubjectUserName")},
        ),
        EventRule(
            "defender_disabled", tuple(fv.DEFENDER_LABELS), F.lit(True),
            F.lit("Turn protection on again and find who turned it off."),
            F.lit("Malware often follows within seconds."),
            {**event_id, "description": defender, "computer": F.col("computer")},
            attack_type=F.concat(F.lit(f"{fv.HOST_RULES['defender_disabled'][0]} "), defender),
        ),
        EventRule(
            "shadow_copy_deletion", (4688,),
            process.rlike("|".join(fv.SHADOW_TOOLS)) & text.matches(command, fv.SHADOW_DELETE),
            F.lit("Isolate the machine now; do not restart it."),
            F.lit("Backups are being removed, encryption may follow."),
            {**event_id, "Process": value_of("NewProcessName"), "CommandLine": text.snippet(command),
             "ParentProcess": value_of("ParentProcessName")},
        ),
    ]


# Columns the indicator joins add before these rules run.
DOMAIN_HIT, ADDRESS_HIT, NAME_HIT, CHAIN_HIT = "domain_hit", "address_hit", "name_hit", "chain_hit"


def indicator_rules() -> list[EventRule]:
    event_id = {"event_id": F.col("event_id")}
    command = text.snippet(value_of("CommandLine"))
    last_part = lambda name: F.regexp_extract(value_of(name), r"([^\\/]*)$", 1)
    return [
        EventRule(
            "ioc_domain_match", (3008,), F.col(DOMAIN_HIT).isNotNull(),
            fill("Block {name} at the resolver and find the asking process.", name=field("QueryName")),
            fill("{name} is on the list as {hit}.", name=field("QueryName"), hit=F.col(DOMAIN_HIT)),
            {**event_id, "QueryName": value_of("QueryName"), "MatchedIOC": F.col(DOMAIN_HIT),
             "QueryResults": value_of("QueryResults")},
        ),
        EventRule(
            "ioc_ip_connection", (5156,), F.col(ADDRESS_HIT).isNotNull(),
            fill("Block {ip} and inspect {app}.", ip=field("DestAddress"), app=field("Application")),
            fill("{ip} is on the list as {hit}.", ip=field("DestAddress"), hit=F.col(ADDRESS_HIT)),
            {**event_id, **values(DestAddress="DestAddress", DestPort="DestPort"),
             "SrcAddress": text_or_empty(F.coalesce(field("SrcAddress"), field("SourceAddress"))),
             "Application": value_of("Application"), "MatchedIOC": F.col(ADDRESS_HIT)},
        ),
        EventRule(
            "ioc_process_name", (4688,), F.col(NAME_HIT).isNotNull(),
            fill("Stop {process} and find how it got here.", process=field("NewProcessName")),
            fill("{hit} is a known attack tool.", hit=F.col(NAME_HIT)),
            {**event_id, "NewProcessName": value_of("NewProcessName"), "MatchedIOC": F.col(NAME_HIT),
             "CommandLine": command,
             **values(ParentProcess="ParentProcessName", SubjectUser="SubjectUserName")},
            attack_type=fill(fv.HOST_RULES["ioc_process_name"][0] + ": {hit}", hit=F.col(NAME_HIT)),
        ),
        EventRule(
            "ioc_process_chain", (4688,), F.col(CHAIN_HIT).isNotNull(),
            fill("Find out why {parent} started {child}.", parent=last_part("ParentProcessName"),
                 child=last_part("NewProcessName")),
            fill("Listed chain: {hit}.", hit=F.col(CHAIN_HIT)),
            {**event_id, **values(ParentProcess="ParentProcessName", NewProcess="NewProcessName"),
             "CommandLine": command, "SubjectUser": value_of("SubjectUserName"),
             "chain_reason": F.col(CHAIN_HIT)},
            attack_type=fill(fv.HOST_RULES["ioc_process_chain"][0] + ": {parent} -> {child}",
                             parent=last_part("ParentProcessName"), child=last_part("NewProcessName")),
        ),
    ]


def threshold_rules(
    brute_force_min: int = fv.BRUTE_FORCE_MIN_FAILURES,
    spray_min_users: int = fv.SPRAY_MIN_USERS,
    spray_min_failures: int = fv.SPRAY_MIN_FAILURES,
    scan_min_ports: int = fv.PORT_SCAN_MIN_PORTS,
) -> list[ThresholdRule]:
    src, total, distinct = F.col("source"), F.col("window_total"), F.col("window_distinct")
    event_id = {"event_id": F.col("event_id")}
    logon = ("IpAddress", "WorkstationName", "TargetUserName", "SubStatus")
    logon_source = text.source_label(field("IpAddress"), field("WorkstationName"))
    action = F.when(
        text.source_is_network(field("IpAddress")), fill("Block {src}. ", src=src)
    ).otherwise(fill("Local logon source ({src}): check sessions and automation. ", src=src))
    user = value_of("TargetUserName")

    direction = text_or_empty(field_any_case("Direction"))
    inbound = (
        (direction == "") | F.contains(direction, F.lit(fv.INBOUND_CODE))
        | F.contains(F.lower(direction), F.lit(fv.INBOUND_WORD))
    )
    scanner = text.stripped(text.first_non_empty(field("SourceAddress"), field("sourceaddress")))
    port = text.stripped(text.first_non_empty(field("DestPort"), field("destport")))
    return [
        ThresholdRule(
            "brute_force_logon", (4625,), F.lit(True), logon, logon_source, user, account=user,
            min_total=brute_force_min,
            suggestion=F.concat(action, F.lit("Review the lockout policy.")),
            risk_note=fill("{n} failed logons from {src} within the window.", n=total, src=src),
            evidence={**event_id, "src_ip": src, "failure_count": total, "last_username": user,
                      "SubStatus": value_of("SubStatus")},
        ),
        ThresholdRule(
            "password_spray", (4625,), F.lit(True), logon, logon_source, user,
            min_total=spray_min_failures, min_distinct=spray_min_users,
            suggestion=F.concat(action, F.lit("Look for a successful logon of the tried accounts.")),
            risk_note=fill("{src} tried {n} different accounts within the window.", n=distinct, src=src),
            evidence={**event_id, "src_ip": src, "distinct_users": distinct,
                      "window_failures": total, "last_username": user},
        ),
        ThresholdRule(
            "net_portscan", (5156, 5157),
            inbound & (scanner != "") & ~scanner.isin(*fv.NON_SCANNER_SOURCES)
            & (port != "") & (port != "-"),
            ("Direction", "direction", "SourceAddress", "sourceaddress", "DestPort", "destport", "Protocol"),
            scanner, port, min_distinct=scan_min_ports,
            suggestion=fill("Block {src}; isolate it if it is one of ours.", src=src),
            risk_note=fill("{src} tried {n} ports in {m} connections within the window.",
                           src=src, n=distinct, m=total),
            evidence={**event_id, "src_ip": src, "distinct_ports": distinct, "total_events": total,
                      "last_dst_port": port, "last_protocol": value_of("Protocol")},
            event_count=total,
        ),
    ]
