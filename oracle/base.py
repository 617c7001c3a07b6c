"""Shared parts of the oracle SQL: mapped events, firings by RANGE frames, sequential fold."""

from __future__ import annotations

DAY_US = 86_400_000_000


def sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v) for v in values) + "]"


QUERIES = [
    "SELECT * FROM accounts WHERE id = 1 UNION SELECT login, secret FROM admins",
    "SELECT name FROM items WHERE sku = '' OR 1=1",
    "x'; DROP TABLE invoices",
    "SELECT table_name FROM information_schema.tables",
    "SELECT load_file('/etc/hosts')",
    "SELECT * FROM users",
    "SELECT id FROM members WHERE login = 'root' --",
    "SELECT 1 FROM pg_user WHERE sleep(5) IS NULL",
    "SELECT id, name FROM items WHERE id = $1",
    "UPDATE carts SET qty = ? WHERE id = ?",
    "SELECT count(*) FROM orders WHERE day = :day",
    "INSERT INTO audit (who, what) VALUES ($1, $2)",
]

EV = f"""
raw AS (
  SELECT event_id AS id, epoch_us(ts) AS us, user_id, event_type AS e, value,
         CAST(regexp_extract(props, '"k":\\s*(\\d+)', 1) AS INT) AS k
  FROM events
),
ev AS (
  SELECT CAST(id AS VARCHAR) AS event_id, us, us + (id % 7) * 1000000 AS ing_us,
         'host-' || CAST(user_id % 5 AS VARCHAR) AS source,
         CASE WHEN e IN ('error', 'signup') OR (e = 'view' AND k % 2 = 1) THEN 'linux_server'
              WHEN e = 'view' THEN 'database' ELSE 'firewall' END AS source_type,
         CASE e WHEN 'error' THEN 'authentication_failure' WHEN 'signup' THEN 'authentication_success'
                WHEN 'click' THEN 'firewall_deny' WHEN 'purchase' THEN 'network_flow'
                ELSE CASE WHEN k % 2 = 0 THEN 'db_query' ELSE 'privilege_escalation' END END AS event_type,
         '203.0.113.' || CAST(user_id % 16 + 1 AS VARCHAR) AS source_ip,
         '10.42.0.' || CAST(k % 4 + 1 AS VARCHAR) AS destination_ip,
         k + 1 AS destination_port,
         'user' || CAST(user_id % 11 AS VARCHAR) AS username,
         CASE WHEN e = 'view' AND k % 2 = 1
              THEN (['sudo su -', 'usermod -aG sudo bob', 'cache.refresh'])[k % 3 + 1] END AS action,
         CASE e WHEN 'error' THEN 'failure' WHEN 'click' THEN 'denied' WHEN 'purchase' THEN 'allowed'
                ELSE 'success' END AS status,
         (['info', 'low', 'medium', 'high', 'critical'])[k % 5 + 1] AS severity,
         'event ' || e || ' from k' || CAST(k AS VARCHAR) AS message,
         CASE WHEN e = 'purchase' THEN CAST(floor(value * 1048576) AS BIGINT) ELSE 0 END AS bytes_out,
         CASE WHEN user_id % 4 = 0 THEN 'admin' ELSE 'user' END AS user_role,
         ({sql_list(QUERIES)})[k % 12 + 1] AS query, k * 100 AS rows_returned, k
  FROM raw
)"""


def steps(top: float, base: float, step: float, extra: float = 0.0, n: int = 60) -> str:
    """Confidence by excess, rounded in Python, as an SQL list."""
    return sql_list([round(min(top, min(top, base + step * i) + extra), 2) for i in range(n)])


def rnd(x: str, digits: int) -> str:
    """Correctly rounded decimal of the binary value."""
    return f"CAST(format('{{:.{digits}f}}', CAST({x} AS DOUBLE)) AS DOUBLE)"


def pick(lst: str, excess: str, n: int = 60) -> str:
    return f"({lst})[least({excess}, {n - 1}) + 1]"


def human(n: str) -> str:
    out = f"format('{{:.1f}} PiB', {n} / 1125899906842624.0)"
    for unit, power in (("TiB", 4), ("GiB", 3), ("MiB", 2), ("KiB", 1), ("B", 0)):
        out = f"CASE WHEN {n} < {float(1024 ** (power + 1))} THEN format('{{:.1f}} {unit}', {n} / {float(1024 ** power)}) ELSE {out} END"
    return out


def frame(part: str, w_us: int) -> str:
    return f"(PARTITION BY {part} ORDER BY us RANGE BETWEEN {w_us - 1} PRECEDING AND CURRENT ROW)"


COLS = ("event_id, rule_id, us, title, description, severity, confidence, correlation_key, source_ip, "
        "affected_host, summary, users, hosts, hint, meta")
SPAN0 = "format('{:.0f}', (us - oldest) / 1000000.0)"
SPAN1 = "format('{:.1f}', (us - oldest) / 1000000.0)"
NO_USERS = "CAST([] AS VARCHAR[])"


def rule_001(t: int = 8, w: int = DAY_US) -> str:
    fail = "event_type = 'authentication_failure'"
    win = frame("source_ip", w)
    b = "event_type = 'authentication_success'"
    s = w // 1_000_000
    conf = f"CASE WHEN {b} THEN {pick(steps(.99, .6, .02, .15), f'cnt - {t}')} ELSE {pick(steps(.99, .6, .02), f'cnt - {t}')} END"
    return f"""
SELECT event_id, 'RULE-001' AS rule_id, us, 'Brute-force login activity from ' || source_ip AS title,
  cnt || ' failed authentication attempts from ' || source_ip || ' within ' || {SPAN0} ||
  's (threshold {t}/{s}s), targeting ' || dst || ' distinct account(s).' ||
  CASE WHEN {b} THEN ' A subsequent successful login was observed.' ELSE '' END AS description,
  CASE WHEN {b} THEN 'critical' ELSE 'high' END AS severity, CAST({conf} AS DOUBLE) AS confidence,
  'srcip:' || source_ip AS correlation_key, source_ip, source AS affected_host,
  event_type || ' user=' || username || ' host=' || source AS summary, vals AS users, [source] AS hosts,
  cnt AS hint,
  'account_breached=' || CASE WHEN {b} THEN 'true' ELSE 'false' END || ';span_seconds=' || {SPAN1} ||
  ';status=' || status || ';window_seconds={s}' AS meta
FROM (
  SELECT *, count(*) FILTER (WHERE {fail}) OVER {win} AS cnt,
    count(DISTINCT username) FILTER (WHERE {fail}) OVER {win} AS dst,
    min(us) FILTER (WHERE {fail}) OVER {win} AS oldest,
    list_sort(list_distinct(list(username) FILTER (WHERE {fail}) OVER {win})) AS vals
  FROM ev WHERE event_type IN ('authentication_failure', 'authentication_success')
) WHERE cnt >= {t}"""


def _distinct(src: str, part: str, value: str, w: int) -> str:
    win = frame(part, w)
    return f"""(SELECT *, count(*) OVER {win} AS cnt, count(DISTINCT {value}) OVER {win} AS dst,
    min(us) OVER {win} AS oldest, list_sort(list_distinct(list({value}) OVER {win})) AS vals
  FROM ev WHERE {src})"""


def rule_002(t: int = 4, w: int = DAY_US) -> str:
    return f"""
SELECT event_id, 'RULE-002' AS rule_id, us, 'Password spraying from ' || source_ip AS title,
  source_ip || ' attempted authentication against ' || dst || ' distinct usernames in ' || {SPAN0} || 's (' ||
  cnt || ' attempts total), a low-and-slow pattern consistent with password spraying.' AS description,
  'high' AS severity, CAST({pick(steps(.97, .55, .03), f'dst - {t}')} AS DOUBLE) AS confidence,
  'srcip:' || source_ip || ':spray' AS correlation_key, source_ip, source AS affected_host,
  'auth failure user=' || username || ' host=' || source AS summary, vals[1:25] AS users, [source] AS hosts,
  cnt AS hint, 'distinct_users=' || dst || ';window_seconds={w // 1_000_000}' AS meta
FROM {_distinct("event_type = 'authentication_failure'", 'source_ip', 'lower(username)', w)} WHERE dst >= {t}"""


def rule_003(t: int = 12, w: int = DAY_US) -> str:
    s = w // 1_000_000
    return f"""
SELECT event_id, 'RULE-003' AS rule_id, us, 'Port scan from ' || source_ip AS title,
  source_ip || ' contacted ' || dst || ' unique destination ports in ' || {SPAN0} || 's (~' ||
  format('{{:.1f}}', dst / greatest((us - oldest) / 1000000.0, 1.0)) || ' ports/s, threshold {t}/{s}s).' AS description,
  'high' AS severity, CAST({pick(steps(.98, .6, .015), f'dst - {t}')} AS DOUBLE) AS confidence,
  'srcip:' || source_ip || ':portscan' AS correlation_key, source_ip, destination_ip AS affected_host,
  event_type || ' -> ' || destination_ip || ':' || destination_port AS summary, {NO_USERS} AS users,
  [destination_ip] AS hosts, cnt AS hint,
  'ports_sample=[' || array_to_string(vals[1:30], ',') || '];unique_ports=' || dst || ';window_seconds={s}' AS meta
FROM {_distinct("event_type IN ('firewall_deny', 'network_flow')", 'source_ip', 'destination_port', w)} WHERE dst >= {t}"""


def rule_004() -> str:
    low = "(user_role <> 'admin')"
    off = "(hour(make_timestamp(us)) >= 22 OR hour(make_timestamp(us)) < 6)"
    text = f"""array_to_string(list_filter([
    CASE WHEN {low} THEN 'actor ''' || username || ''' is not a known privileged account' END,
    CASE WHEN {off} THEN 'action occurred outside business hours' END,
    'host reported an explicit privilege-escalation event'], lambda x: x IS NOT NULL), '@@')"""
    return f"""
SELECT event_id, 'RULE-004' AS rule_id, us, 'Privilege escalation by ' || username || ' on ' || source AS title,
  'User ''' || username || ''' performed administrative action ''' || action || ''' on ' || source || '. ' ||
  upper(why[1]) || lower(replace(why[2:], '@@', '; ')) || '.' AS description,
  'high' AS severity,
  {rnd(f'least(0.95, CAST(0.4 AS DOUBLE) + CASE WHEN {low} THEN CAST(0.35 AS DOUBLE) ELSE 0 END + CASE WHEN {off} THEN CAST(0.15 AS DOUBLE) ELSE 0 END + CAST(0.2 AS DOUBLE))', 2)} AS confidence,
  'host:' || source || ':user:' || username || ':privesc' AS correlation_key, source_ip, source AS affected_host,
  username || '@' || source || ': ' || action AS summary, [username] AS users, [source] AS hosts,
  CAST(1 AS BIGINT) AS hint,
  'actor_role=' || user_role || ';reasons=["' || replace(why, '@@', '","') || '"]' AS meta
FROM (SELECT *, {text} AS why FROM ev WHERE event_type = 'privilege_escalation')"""


PATTERNS = [
    (r"\bunion\s+select\b", "UNION-based injection", 0.9),
    (r"\bor\s+1\s*=\s*1\b", "tautology injection (OR 1=1)", 0.85),
    (r"'';\s*(drop|delete|update|insert)\b", "stacked-query injection", 0.9),
    (r"\b(information_schema|pg_catalog|sysobjects)\b", "schema enumeration", 0.6),
    (r"\b(load_file|into\s+outfile|pg_read_file|xp_cmdshell)\b", "file / command access", 0.95),
    (r"\bselect\s+\*\s+from\s+\w*\b(users|credentials|customers|payment|passwords?)\b[^$:?\n]*(?:\n|\z)",
     "unparameterised bulk read of a sensitive table", 0.5),
    (r"([''\"]\s*)--\s*\z", "inline comment truncation of a string literal", 0.55),
    (r"\bsleep\s*\(\s*\d+\s*\)|\bwaitfor\s+delay\b", "time-based blind injection", 0.85),
]


def rule_005() -> str:
    hits = ", ".join(f"CASE WHEN regexp_matches(query, '(?i){p}') THEN '{label}' END" for p, label, _ in PATTERNS)
    score = ", ".join(f"CASE WHEN regexp_matches(query, '(?i){p}') THEN {w} ELSE 0 END" for p, _, w in PATTERNS)
    big = "rows_returned >= 5000"
    return f"""
SELECT event_id, 'RULE-005' AS rule_id, us, 'Suspicious SQL from ' || username AS title,
  'Query on ' || source || ' matched: ' || array_to_string(hits, ', ') || '. Query (truncated): ' || query[1:200] AS description,
  CASE WHEN score >= 0.85 THEN 'high' ELSE 'medium' END AS severity,
  {rnd('least(0.96, score)', 2)} AS confidence,
  'db:' || source || ':user:' || username || ':sqli' AS correlation_key, source_ip, source AS affected_host,
  username || ' @ ' || source || ': ' || query[1:120] AS summary, [username] AS users, [source] AS hosts,
  CAST(1 AS BIGINT) AS hint,
  'patterns=["' || array_to_string(hits, '","') || '"];rows_returned=' || rows_returned AS meta
FROM (
  SELECT *, list_filter([{hits}, CASE WHEN {big} THEN 'large result set (' || rows_returned || ' rows)' END], lambda x: x IS NOT NULL) AS hits,
    CAST(greatest({score}, CASE WHEN {big} THEN 0.55 ELSE 0 END) AS DOUBLE) AS score
  FROM ev WHERE event_type = 'db_query'
) WHERE len(hits) > 0"""


def rule_006(t: int = 500 * 2 ** 20, w: int = DAY_US) -> str:
    s = w // 1_000_000
    return f"""
SELECT event_id, 'RULE-006' AS rule_id, us, 'High outbound volume from ' || source_ip AS title,
  {human('total')} || ' transferred from ' || source_ip || ' to ' || destination_ip || ' within {s}s (threshold ' ||
  {human(f'CAST({t} AS BIGINT)')} || ').' AS description,
  CASE WHEN total / {float(t)} >= 3 THEN 'high' ELSE 'medium' END AS severity,
  {rnd(f'least(0.95, 0.5 + CAST(0.1 AS DOUBLE) * (CAST(total AS DOUBLE) / {t}))', 2)} AS confidence,
  'srcip:' || source_ip || ':exfil' AS correlation_key, source_ip, source AS affected_host,
  {human('bytes_out')} || ' -> ' || destination_ip || ':' || destination_port AS summary, {NO_USERS} AS users,
  [destination_ip] AS hosts, CAST(1 AS BIGINT) AS hint,
  'destination=' || destination_ip || ';window_bytes=' || total || ';window_seconds={s}' AS meta
FROM (
  SELECT *, CAST(sum(bytes_out) OVER {frame('source_ip, destination_ip', w)} AS BIGINT) AS total
  FROM ev WHERE event_type = 'network_flow' AND bytes_out > 0
) WHERE total >= {t}"""


def rule_007(t: int = 5, w: int = DAY_US) -> str:
    return f"""
SELECT event_id, 'RULE-007' AS rule_id, us, 'Unusual authentication pattern for ''' || username || '''' AS title,
  'Account ''' || username || ''' authenticated *successfully* from ' || dst || ' distinct source IPs within ' ||
  {SPAN0} || 's (latest from ' || source_ip || ') — possible session hijack or shared/compromised credentials.' AS description,
  CASE WHEN dst >= {t + 2} THEN 'high' ELSE 'medium' END AS severity,
  CAST({pick(steps(.92, .5, .1), f'dst - {t}')} AS DOUBLE) AS confidence,
  'user:' || lower(username) || ':authgeo' AS correlation_key, source_ip, source AS affected_host,
  username || ' login from ' || source_ip || ' (' || status || ')' AS summary, [username] AS users, [source] AS hosts,
  CAST(1 AS BIGINT) AS hint, 'distinct_source_ips=["' || array_to_string(vals[1:20], '","') || '"]' AS meta
FROM {_distinct("event_type = 'authentication_success'", 'lower(username)', 'source_ip', w)} WHERE dst >= {t}"""


RULE_SQL = {1: rule_001, 2: rule_002, 3: rule_003, 4: rule_004, 5: rule_005, 6: rule_006, 7: rule_007}

DETS = "dets AS (" + " UNION ALL BY NAME ".join(f"({RULE_SQL[i]()})" for i in range(1, 8)) + ")"

TRIAGE = """
tri AS (
  SELECT 'RULE-001' AS rule_id, 'srcip:' || source_ip AS correlation_key, us, event_id
  FROM ev WHERE event_type = 'authentication_success' AND k < 3
)"""

# Firings and closing actions on one timeline; a firing right after a closing action opens an episode.
EPISODES = """
steps AS (
  SELECT rule_id, correlation_key, us, 0 AS kind, event_id AS tie FROM dets
  UNION ALL SELECT rule_id, correlation_key, us, 1, event_id FROM tri
),
marked AS (
  SELECT *, lag(kind) OVER (PARTITION BY rule_id, correlation_key ORDER BY us, kind, tie) AS before FROM steps
),
numbered AS (
  SELECT *, sum(CASE WHEN kind = 0 AND coalesce(before, 1) = 1 THEN 1 ELSE 0 END)
    OVER (PARTITION BY rule_id, correlation_key ORDER BY us, kind, tie ROWS UNBOUNDED PRECEDING) AS episode
  FROM marked
),
epi AS (
  SELECT d.*, CAST(n.episode AS BIGINT) AS episode FROM dets d JOIN numbered n
    ON n.kind = 0 AND n.rule_id = d.rule_id AND n.correlation_key = d.correlation_key AND n.tie = d.event_id
),
closed AS (SELECT DISTINCT rule_id, correlation_key, CAST(episode AS BIGINT) AS episode FROM numbered WHERE kind = 1 AND episode > 0)"""

NO_EPISODES = """
epi AS (SELECT *, CAST(1 AS BIGINT) AS episode FROM dets),
closed AS (SELECT rule_id, correlation_key, episode FROM epi WHERE false)"""

# Sequential fold: the count walks the ordered hints one by one.
FOLD = """
folded AS (
  SELECT rule_id, correlation_key, episode,
    list_reduce(list(hint ORDER BY us, event_id), lambda c, h: greatest(c + 1, h)) AS event_count,
    max(confidence) AS confidence,
    list(severity ORDER BY list_position(['info', 'low', 'medium', 'high', 'critical'], severity) DESC, us, event_id)[1] AS severity,
    list(title ORDER BY list_position(['info', 'low', 'medium', 'high', 'critical'], severity) DESC, us, event_id)[1] AS title,
    list(description ORDER BY list_position(['info', 'low', 'medium', 'high', 'critical'], severity) DESC, us, event_id)[1] AS description,
    arg_min(source_ip, us) AS source_ip, arg_min(affected_host, us) AS affected_host,
    arg_min(event_id, us) AS first_event, min(us) AS first_us, max(us) AS last_us,
    arg_max(meta, us) AS meta,
    list_sort(list_distinct(flatten(list(users))))[1:50] AS users,
    list_sort(list_distinct(flatten(list(hosts))))[1:50] AS hosts,
    list(event_id ORDER BY us, event_id)[-25:] AS evidence,
    list(summary ORDER BY us, event_id)[-25:] AS summaries,
    list(us ORDER BY us, event_id)[-25:] AS evidence_us
  FROM epi GROUP BY ALL
),
alerts AS (
  SELECT f.*, md5(rule_id || '|' || correlation_key || '|' || first_event) AS h,
    h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] AS alert_id,
    CASE WHEN c.episode IS NULL THEN 'open' ELSE 'resolved' END AS status, 'rule' AS detection_kind
  FROM folded f LEFT JOIN closed c USING (rule_id, correlation_key, episode)
)"""

DET_OUT = ("event_id, rule_id, us, title, description, severity, confidence, correlation_key, source_ip, affected_host, "
           "summary, array_to_string(users, ',') AS users, array_to_string(hosts, ',') AS hosts, hint, meta")
ALERT_OUT = ("alert_id, rule_id, correlation_key, episode, status, event_count, confidence, severity, title, description, "
             "source_ip, affected_host, first_us, last_us, meta, array_to_string(users, ',') AS users, "
             "array_to_string(hosts, ',') AS hosts, array_to_string(evidence, ',') AS evidence")


def with_events(body: str, *ctes: str) -> str:
    return "WITH " + ",".join([EV, *ctes]) + "\n" + body


def with_alerts(body: str, *ctes: str) -> str:
    return with_events(body, DETS, TRIAGE, EPISODES, FOLD, *ctes)
