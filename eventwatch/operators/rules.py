"""The seven detection rules (D1-D7) and their parameters.

Window rules state what they count and how a firing reads; `plans.detect` runs them together.
Pattern rules look at one event at a time. All rules fire at measure >= threshold.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, functions as F

from ..functions.text import exact_round, filled, fixed0, fixed1, human_bytes, lookup, or_none, sentence
from ..schema import micros


@dataclass(frozen=True)
class RuleParams:
    """Thresholds of every rule, all of them overridable."""

    max_failures: int = 10
    bruteforce_seconds: int = 60
    unique_users: int = 8
    spray_seconds: int = 120
    unique_ports: int = 20
    portscan_seconds: int = 30
    privileged_roles: tuple[str, ...] = ("admin", "root", "sudo", "administrator")
    large_rowcount: int = 5000
    bytes_threshold: int = 52_428_800
    exfil_seconds: int = 60
    distinct_ips: int = 4
    authgeo_seconds: int = 300

    def override(self, **changes) -> RuleParams:
        return replace(self, **changes)


@dataclass(frozen=True)
class Rule:
    """Catalogue facts of one rule."""

    rule_id: str
    handle: str
    name: str
    category: str
    severity: str
    mitre: tuple[str, ...]
    action: str
    summary: str
    kind: str = "rule"
    params: Callable[[RuleParams], dict] = field(default=lambda p: {})


@dataclass(frozen=True)
class WindowRule(Rule):
    """A rule over what one entity did in the last `seconds(p)` seconds.

    `types` are the event types it reads and `applies` the further condition; `value` is what it
    counts distinct, `contributes` marks events that add to the window rather than only read it.
    """

    types: tuple[str, ...] = ()
    applies: Callable[[], Column] = None
    entity: Callable[[], Column] = None
    seconds: Callable[[RuleParams], int] = None
    threshold: Callable[[RuleParams], int] = None
    measure: str = "count"
    value: Callable[[], Column] | None = None
    contributes: Callable[[], Column] | None = None
    amount: Callable[[], Column] | None = None
    members: int = 0  # how many of the window's values a firing lists, smallest first
    counted: bool = True  # whether a firing states the window's count
    reads: Callable[[RuleParams], dict[str, Column]] = None


@dataclass(frozen=True)
class PatternRule(Rule):
    applies: Callable[[RuleParams], Column] = None
    reads: Callable[[RuleParams], dict[str, Column]] = None


c = F.col
AUTH_FAILURE = "authentication_failure"
AUTH_SUCCESS = "authentication_success"


def _texts(*values: Column) -> Column:
    return F.array_compact(F.array(*values))


def _meta(**items: Column) -> Column:
    pairs = [x for k, v in items.items() for x in (F.lit(k), v.cast("string"))]
    return F.create_map(*pairs)


def _steps(top: float, base: float, step: float, extra: float = 0.0) -> list[float]:
    """Confidence per unit of excess over the threshold, up to the cap."""
    out: list[float] = []
    while True:
        raw = min(top, base + step * len(out))
        out.append(round(min(top, raw + extra), 2))
        if raw >= top:
            return out


# --------------------------------------------------------------------------------------------
# Window rules
# --------------------------------------------------------------------------------------------

def _brute_force(p: RuleParams) -> dict[str, Column]:
    breached = c("event_type") == AUTH_SUCCESS
    excess = c("count") - p.max_failures
    return {
        "title": F.concat(F.lit("Brute-force login activity from "), c("source_ip")),
        "description": F.concat(
            c("count").cast("string"), F.lit(" failed authentication attempts from "), c("source_ip"),
            F.lit(" within "), fixed0(c("span")),
            F.lit(f"s (threshold {p.max_failures}/{p.bruteforce_seconds}s), targeting "),
            c("n_distinct").cast("string"), F.lit(" distinct account(s)."),
            F.when(breached, " A subsequent successful login was observed.").otherwise(""),
        ),
        "severity": F.when(breached, "critical").otherwise("high"),
        "confidence": F.when(breached, lookup(_steps(0.99, 0.6, 0.02, 0.15), excess))
        .otherwise(lookup(_steps(0.99, 0.6, 0.02), excess)),
        "correlation_key": F.concat(F.lit("srcip:"), c("source_ip")),
        "affected_host": c("source"),
        "summary": F.concat(c("event_type"), F.lit(" user="), or_none(c("username")), F.lit(" host="), c("source")),
        "involved_users": F.filter(c("members"), lambda u: (u != "") & (u != "-")),
        "involved_hosts": F.array(c("source")),
        "event_count_hint": c("count"),
        "metadata": _meta(
            window_seconds=F.lit(p.bruteforce_seconds),
            span_seconds=fixed1("span"),
            account_breached=breached,
            status=c("status"),
        ),
    }


def _spray(p: RuleParams) -> dict[str, Column]:
    return {
        "title": F.concat(F.lit("Password spraying from "), c("source_ip")),
        "description": F.concat(
            c("source_ip"), F.lit(" attempted authentication against "), c("n_distinct").cast("string"),
            F.lit(" distinct usernames in "), fixed0(c("span")), F.lit("s ("),
            c("count").cast("string"),
            F.lit(" attempts total), a low-and-slow pattern consistent with password spraying."),
        ),
        "severity": F.lit("high"),
        "confidence": lookup(_steps(0.97, 0.55, 0.03), c("n_distinct") - p.unique_users),
        "correlation_key": F.concat(F.lit("srcip:"), c("source_ip"), F.lit(":spray")),
        "affected_host": c("source"),
        "summary": F.concat(F.lit("auth failure user="), or_none(c("username")), F.lit(" host="), c("source")),
        "involved_users": c("members"),
        "involved_hosts": F.array(c("source")),
        "event_count_hint": c("count"),
        "metadata": _meta(distinct_users=c("n_distinct"), window_seconds=F.lit(p.spray_seconds)),
    }


def _port_scan(p: RuleParams) -> dict[str, Column]:
    return {
        "title": F.concat(F.lit("Port scan from "), c("source_ip")),
        "description": F.concat(
            c("source_ip"), F.lit(" contacted "), c("n_distinct").cast("string"),
            F.lit(" unique destination ports in "), fixed0(c("span")), F.lit("s (~"),
            fixed1("rate"), F.lit(f" ports/s, threshold {p.unique_ports}/{p.portscan_seconds}s)."),
        ),
        "severity": F.lit("high"),
        "confidence": lookup(_steps(0.98, 0.6, 0.015), c("n_distinct") - p.unique_ports),
        "correlation_key": F.concat(F.lit("srcip:"), c("source_ip"), F.lit(":portscan")),
        "affected_host": F.coalesce(filled(c("destination_ip")), c("source")),
        "summary": F.concat(
            c("event_type"), F.lit(" -> "), or_none(c("destination_ip")), F.lit(":"),
            or_none(c("destination_port")),
        ),
        "involved_users": F.array().cast("array<string>"),
        "involved_hosts": _texts(filled(c("destination_ip"))),
        "event_count_hint": c("count"),
        "metadata": _meta(
            unique_ports=c("n_distinct"),
            ports_sample=F.to_json(F.transform(c("members"), lambda m: m.cast("int"))),
            window_seconds=F.lit(p.portscan_seconds),
        ),
    }


def _exfiltration(p: RuleParams) -> dict[str, Column]:
    ratio = c("amount") / F.lit(p.bytes_threshold)
    return {
        "title": F.concat(F.lit("High outbound volume from "), c("source_ip")),
        "description": F.concat(
            human_bytes("amount"), F.lit(" transferred from "), c("source_ip"), F.lit(" to "),
            F.coalesce(filled(c("destination_ip")), F.lit("multiple destinations")),
            F.lit(f" within {p.exfil_seconds}s (threshold "), human_bytes(f"{p.bytes_threshold}L"), F.lit(")."),
        ),
        "severity": F.when(ratio >= 3, "high").otherwise("medium"),
        "confidence": exact_round(f"least(0.95D, 0.5D + 0.1D * (amount / {p.bytes_threshold}L))", 2),
        "correlation_key": F.concat(F.lit("srcip:"), c("source_ip"), F.lit(":exfil")),
        "affected_host": c("source"),
        "summary": F.concat(
            human_bytes("bytes_out"), F.lit(" -> "), or_none(c("destination_ip")), F.lit(":"),
            or_none(c("destination_port")),
        ),
        "involved_users": F.array().cast("array<string>"),
        "involved_hosts": _texts(filled(c("destination_ip"))),
        "event_count_hint": F.lit(1).cast("bigint"),
        "metadata": _meta(
            window_bytes=c("amount"), window_seconds=F.lit(p.exfil_seconds), destination=c("destination_ip")
        ),
    }


def _auth_anomaly(p: RuleParams) -> dict[str, Column]:
    return {
        "title": F.concat(F.lit("Unusual authentication pattern for '"), c("username"), F.lit("'")),
        "description": F.concat(
            F.lit("Account '"), c("username"), F.lit("' authenticated *successfully* from "),
            c("n_distinct").cast("string"), F.lit(" distinct source IPs within "),
            fixed0(c("span")), F.lit("s (latest from "), c("source_ip"),
            F.lit(") — possible session hijack or shared/compromised credentials."),
        ),
        "severity": F.when(c("n_distinct") >= p.distinct_ips + 2, "high").otherwise("medium"),
        "confidence": lookup(_steps(0.92, 0.5, 0.1), c("n_distinct") - p.distinct_ips),
        "correlation_key": F.concat(F.lit("user:"), F.lower(c("username")), F.lit(":authgeo")),
        "affected_host": c("source"),
        "summary": F.concat(
            c("username"), F.lit(" login from "), c("source_ip"), F.lit(" ("), or_none(c("status")), F.lit(")"),
        ),
        "involved_users": F.array(c("username")),
        "involved_hosts": F.array(c("source")),
        "event_count_hint": F.lit(1).cast("bigint"),
        "metadata": _meta(distinct_source_ips=F.to_json(c("members"))),
    }


def _has_ip() -> Column:
    return c("source_ip").isNotNull()


def _named() -> Column:
    return filled(c("username")).isNotNull() & filled(c("source_ip")).isNotNull()


EVERY = 2 ** 31 - 1  # no limit

BRUTE_FORCE = WindowRule(
    "RULE-001", "SSH_BRUTE_FORCE", "SSH/Service brute force", "authentication", "high", ("T1110.001",),
    "Investigate the source IP. If not attributable to a known scanner or user, block it at the "
    "firewall and force a credential reset for any account that authenticated successfully from it.",
    "Many failed logins from one source address in a short window.",
    params=lambda p: {"max_failures": p.max_failures, "window_seconds": p.bruteforce_seconds},
    types=(AUTH_FAILURE, AUTH_SUCCESS),
    applies=_has_ip,
    entity=lambda: c("source_ip"),
    seconds=lambda p: p.bruteforce_seconds,
    threshold=lambda p: p.max_failures,
    value=lambda: F.when(c("event_type") == AUTH_FAILURE, F.coalesce(filled(c("username")), F.lit("-"))),
    contributes=lambda: c("event_type") == AUTH_FAILURE,
    members=EVERY,
    reads=_brute_force,
)
SPRAY = WindowRule(
    "RULE-002", "PASSWORD_SPRAY", "Password spraying", "authentication", "high", ("T1110.003",),
    "Confirm whether the source IP is a legitimate gateway (VPN/NAT). If not, block it and review "
    "accounts targeted for weak-password exposure; enable MFA where missing.",
    "One source address failing to log in as many different users.",
    params=lambda p: {"unique_users": p.unique_users, "window_seconds": p.spray_seconds},
    types=(AUTH_FAILURE,),
    applies=_named,
    entity=lambda: c("source_ip"),
    seconds=lambda p: p.spray_seconds,
    threshold=lambda p: p.unique_users,
    measure="n_distinct",
    value=lambda: F.nullif(F.lower(c("username")), F.lit("-")),
    members=25,
    reads=_spray,
)
PORT_SCAN = WindowRule(
    "RULE-003", "PORT_SCAN", "Port scanning", "network", "high", ("T1046",),
    "Treat the source as reconnaissance. Block at the perimeter, check whether any probed service "
    "responded, and review exposure of the scanned ports.",
    "One source address contacting many destination ports.",
    params=lambda p: {"unique_ports": p.unique_ports, "window_seconds": p.portscan_seconds},
    types=("connection_attempt", "firewall_deny", "firewall_allow", "network_flow"),
    applies=lambda: _has_ip() & c("destination_port").isNotNull(),
    entity=lambda: c("source_ip"),
    seconds=lambda p: p.portscan_seconds,
    threshold=lambda p: p.unique_ports,
    measure="n_distinct",
    value=lambda: F.lpad(c("destination_port").cast("string"), 5, "0"),
    members=30,
    reads=_port_scan,
)
EXFILTRATION = WindowRule(
    "RULE-006", "DATA_EXFILTRATION", "Excessive outbound traffic", "network", "medium", ("T1041", "T1048"),
    "Identify the destination and whether it is an approved endpoint. If not, isolate the host, "
    "capture the flow for analysis, and check for staging of archives on the source host.",
    "Outbound bytes between one source and destination above a threshold.",
    params=lambda p: {"bytes_threshold": p.bytes_threshold, "window_seconds": p.exfil_seconds},
    types=("network_flow", "firewall_allow", "http_request"),
    applies=lambda: (c("bytes_out") > 0) & filled(c("source_ip")).isNotNull(),
    entity=lambda: F.concat(c("source_ip"), F.lit("->"), F.coalesce(filled(c("destination_ip")), F.lit("any"))),
    seconds=lambda p: p.exfil_seconds,
    threshold=lambda p: p.bytes_threshold,
    measure="amount",
    amount=lambda: c("bytes_out"),
    reads=_exfiltration,
)
AUTH_ANOMALY = WindowRule(
    "RULE-007", "AUTH_ANOMALY", "Authentication anomaly", "authentication", "medium", ("T1078",),
    "Contact the account owner to confirm the sessions. If unrecognised, invalidate active "
    "sessions, reset credentials, and review what the account accessed during the window.",
    "One account logging in successfully from many source addresses.",
    params=lambda p: {"distinct_ips": p.distinct_ips, "window_seconds": p.authgeo_seconds},
    types=(AUTH_SUCCESS, AUTH_FAILURE),
    applies=lambda: _named() & (c("status") == "success"),
    entity=lambda: F.lower(c("username")),
    seconds=lambda p: p.authgeo_seconds,
    threshold=lambda p: p.distinct_ips,
    measure="n_distinct",
    value=lambda: c("source_ip"),
    members=20,
    counted=False,
    reads=_auth_anomaly,
)

# --------------------------------------------------------------------------------------------
# Pattern rules
# --------------------------------------------------------------------------------------------

# Command words that mark an administrative action, and the off hours in UTC.
ADMIN_WORDS = [
    "sudo", "su ", "usermod", "useradd", "passwd", "chmod 777", "setuid", "visudo", "pkexec",
    "runas", "net localgroup administrators",
]
OFF_HOURS = [22, 23, 0, 1, 2, 3, 4, 5]

# SQL patterns, their labels and weights. The sixth and seventh are written without
# lookahead and with an absolute end so that every regex engine in use reads them alike.
SQL_PATTERNS = [
    (r"\bunion\s+select\b", "UNION-based injection", 0.9),
    (r"\bor\s+1\s*=\s*1\b", "tautology injection (OR 1=1)", 0.85),
    (r"';\s*(drop|delete|update|insert)\b", "stacked-query injection", 0.9),
    (r"\b(information_schema|pg_catalog|sysobjects)\b", "schema enumeration", 0.6),
    (r"\b(load_file|into\s+outfile|pg_read_file|xp_cmdshell)\b", "file / command access", 0.95),
    (
        r"\bselect\s+\*\s+from\s+\w*\b(users|credentials|customers|payment|passwords?)\b[^$:?\n]*(?:\n|\z)",
        "unparameterised bulk read of a sensitive table", 0.5,
    ),
    (r"(['\"]\s*)--\s*\z", "inline comment truncation of a string literal", 0.55),
    (r"\bsleep\s*\(\s*\d+\s*\)|\bwaitfor\s+delay\b", "time-based blind injection", 0.85),
]
BIG_READ_WEIGHT = 0.55


def _has_word(text: Column) -> Column:
    return text.rlike("|".join(ADMIN_WORDS))


def _privesc_parts(p: RuleParams) -> dict[str, Column]:
    roles = [r.lower() for r in p.privileged_roles]
    role = F.lower(F.coalesce(F.element_at(c("metadata"), "user_role"), F.lit("")))
    raw = F.coalesce(filled(c("action")), c("message"), F.lit(""))
    return {
        "role": role,
        "raw": raw,
        "explicit": c("event_type") == "privilege_escalation",
        "low": ~(role.isin(roles) | F.lower(F.coalesce(c("username"), F.lit(""))).isin(roles)),
        "off": F.hour("timestamp").isin(OFF_HOURS),
        "failed": F.coalesce(c("status") == "failure", F.lit(False)),
    }


def _privesc_applies(p: RuleParams) -> Column:
    x = _privesc_parts(p)
    haystack = F.lower(F.concat(F.coalesce(c("action"), F.lit("")), F.lit(" "), F.coalesce(c("message"), F.lit(""))))
    candidate = c("event_type").isin("privilege_escalation", "config_change") | (
        ~c("source_type").isin("web_server", "firewall", "dns")
        & filled(c("username")).isNotNull()
        & _has_word(haystack)
    )
    admin = x["explicit"] | _has_word(F.lower(x["raw"]))
    return candidate & admin & (x["low"] | x["off"] | x["explicit"])


def _privesc(p: RuleParams) -> dict[str, Column]:
    x = _privesc_parts(p)
    user = or_none(c("username"))
    reasons = _texts(
        F.when(x["low"], F.concat(F.lit("actor '"), user, F.lit("' is not a known privileged account"))),
        F.when(x["off"], F.lit("action occurred outside business hours")),
        F.when(x["explicit"], F.lit("host reported an explicit privilege-escalation event")),
        F.when(x["failed"], F.lit("the escalation attempt failed")),
    )
    # one confidence per combination of the four signs
    flags = [("low", 0.35), ("off", 0.15), ("explicit", 0.2), ("failed", 0.05)]
    combination = F.lit(0)
    for bit, (flag, _) in enumerate(flags):
        combination = combination + F.when(x[flag], 1 << bit).otherwise(0)
    scores = [
        round(min(0.95, sum((w for b, (_, w) in enumerate(flags) if n >> b & 1), 0.4)), 2)
        for n in range(1 << len(flags))
    ]
    lowered = F.lower(x["raw"])
    return {
        "title": F.concat(
            F.lit("Privilege escalation by "), F.coalesce(filled(c("username")), F.lit("unknown")),
            F.lit(" on "), c("source"),
        ),
        "description": F.concat(
            F.lit("User '"), user, F.lit("' performed administrative action '"),
            F.coalesce(filled(c("action")), F.substring(lowered, 1, 120)), F.lit("' on "), c("source"),
            F.lit(". "), sentence(reasons), F.lit("."),
        ),
        "severity": F.lit("high"),
        "confidence": lookup(scores, combination),
        "correlation_key": F.concat(F.lit("host:"), c("source"), F.lit(":user:"), user, F.lit(":privesc")),
        "affected_host": c("source"),
        "summary": F.concat(
            user, F.lit("@"), c("source"), F.lit(": "),
            F.coalesce(filled(c("action")), F.substring(lowered, 1, 80)),
        ),
        "involved_users": _texts(filled(c("username"))),
        "involved_hosts": F.array(c("source")),
        "event_count_hint": F.lit(1).cast("bigint"),
        "metadata": _meta(
            reasons=F.to_json(reasons), actor_role=F.when(x["role"] == "", "unknown").otherwise(x["role"])
        ),
    }


def sql_text() -> Column:
    return F.coalesce(filled(F.element_at(c("metadata"), "query")), c("message"), F.lit(""))


def sql_rows() -> Column:
    return F.coalesce(F.element_at(c("metadata"), "rows_returned").try_cast("bigint"), F.lit(0).cast("bigint"))


def _sql_hit(pattern: str) -> Column:
    return sql_text().rlike("(?iU)" + pattern)


def _sql_applies(p: RuleParams) -> Column:
    found = sql_rows() >= p.large_rowcount
    for pattern, _, _ in SQL_PATTERNS:
        found = found | _sql_hit(pattern)
    return c("event_type").isin("db_query", "db_error") & (sql_text() != "") & found


def _sql(p: RuleParams) -> dict[str, Column]:
    big = sql_rows() >= p.large_rowcount
    hits = _texts(
        *[F.when(_sql_hit(pattern), F.lit(label)) for pattern, label, _ in SQL_PATTERNS],
        F.when(big, F.concat(F.lit("large result set ("), sql_rows().cast("string"), F.lit(" rows)"))),
    )
    score = F.greatest(
        *[F.when(_sql_hit(pattern), F.lit(w)).otherwise(0.0) for pattern, _, w in SQL_PATTERNS],
        F.when(big, BIG_READ_WEIGHT).otherwise(0.0),
    )
    user, ip = filled(c("username")), filled(c("source_ip"))
    return {
        "title": F.concat(F.lit("Suspicious SQL from "), F.coalesce(user, ip, F.lit("unknown"))),
        "description": F.concat(
            F.lit("Query on "), c("source"), F.lit(" matched: "), F.concat_ws(", ", hits),
            F.lit(". Query (truncated): "), F.substring(sql_text(), 1, 200),
        ),
        "severity": F.when(score >= 0.85, "high").otherwise("medium"),
        "confidence": score,
        "correlation_key": F.concat(
            F.lit("db:"), c("source"), F.lit(":user:"), or_none(F.coalesce(user, c("source_ip"))), F.lit(":sqli"),
        ),
        "affected_host": c("source"),
        "summary": F.concat(
            F.coalesce(user, F.lit("?")), F.lit(" @ "), c("source"), F.lit(": "), F.substring(sql_text(), 1, 120),
        ),
        "involved_users": _texts(user),
        "involved_hosts": F.array(c("source")),
        "event_count_hint": F.lit(1).cast("bigint"),
        "metadata": _meta(patterns=F.to_json(hits), rows_returned=sql_rows()),
    }


PRIVESC = PatternRule(
    "RULE-004", "PRIVILEGE_ESCALATION", "Privilege escalation", "authentication", "high", ("T1548", "T1078"),
    "Verify the change with the account owner and change-management records. If unsanctioned, "
    "revoke the elevated access, preserve the host for forensics, and rotate credentials.",
    "An administrative action by an unexpected actor or at an unusual hour.",
    params=lambda p: {"privileged_roles": list(p.privileged_roles)},
    applies=_privesc_applies,
    reads=_privesc,
)
SUSPICIOUS_SQL = PatternRule(
    "RULE-005", "SUSPICIOUS_SQL", "Suspicious database activity", "database", "medium", ("T1190", "T1213"),
    "Correlate with the calling application and user. Review DB audit logs for the session, "
    "confirm parameterised queries in the code path, and check for unexpected data volume leaving "
    "the database.",
    "Query text that looks like injection, or a very large result.",
    params=lambda p: {"large_rowcount": p.large_rowcount},
    applies=_sql_applies,
    reads=_sql,
)

RULES: list[Rule] = [BRUTE_FORCE, SPRAY, PORT_SCAN, PRIVESC, SUSPICIOUS_SQL, EXFILTRATION, AUTH_ANOMALY]
WINDOW_RULES: list[WindowRule] = [r for r in RULES if isinstance(r, WindowRule)]
PATTERN_RULES: list[PatternRule] = [r for r in RULES if isinstance(r, PatternRule)]


def event_micros() -> Column:
    return micros(c("timestamp"))
