"""SQL counterparts of the named queries, for a second engine on the same tables.

The mapping from the test tables to cases and events is written out again in SQL; nothing
here is generated from the DataFrame code except the fixed rule tables.
"""

from __future__ import annotations

from casewise import taxonomy as X

ORACLE: dict[str, str] = {}


def _text(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(_text(v) if isinstance(v, str) or v is None else str(v) for v in r) + ")" for r in rows)


# ---- derived base tables --------------------------------------------------------------

_DESCRIPTION = """CASE k % 12
  WHEN 0 THEN 'Failed password for account_' || user_id || ' from 172.16.' || (k % 7) || '.' || k || ' port 22'
  WHEN 1 THEN 'Accepted password for account_' || user_id || ' from 172.17.' || (k % 5) || '.' || k
  WHEN 2 THEN 'sudo: account_' || user_id || ' opened a shell'
  WHEN 3 THEN 'USB mass storage attached'
  WHEN 4 THEN 'Process started by scheduler on 192.168.1.' || k
  WHEN 5 THEN 'write to network share'
  WHEN 6 THEN 'Reg key changed'
  WHEN 7 THEN 'network scan of 10.9.8.' || k
  WHEN 8 THEN 'download of archive from 203.0.113.' || k
  WHEN 9 THEN 'heartbeat'
  WHEN 10 THEN 'EXECVE audit record'
  ELSE 'Logged in via console' END"""

_BASE = """base AS (
  SELECT event_id AS seq, ts, user_id, event_type AS kind, value,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         user_id % 8 AS case_id, user_id % 8 * 16 + event_id % 16 AS evidence_id
  FROM events)"""

_NAMES = f"win_names(id, name) AS (VALUES {_values(X.WIN_EVENT_NAMES.items())})"

_EV = f"""{_BASE}, {_NAMES}, ev0 AS (
  SELECT *, CASE WHEN k % 4 = 3 THEN NULL WHEN kind = 'error' THEN '4625' WHEN kind = 'signup' THEN '4720'
    WHEN kind = 'purchase' THEN '4688' WHEN kind = 'view' THEN '4663' ELSE '4624' END AS event_id
  FROM base), ev AS (
  SELECT sha256(evidence_id || '|' || seq) AS event_uid, case_id, evidence_id, seq, CAST(ts AS TIMESTAMP) AS "timestamp",
    FALSE AS ts_inferred, 'EventTable' AS source,
    CASE WHEN event_id IS NOT NULL THEN (SELECT name FROM win_names WHERE id = event_id)
         WHEN kind = 'error' THEN 'AuthFailure' WHEN kind = 'signup' THEN 'PrivilegeEscalation' ELSE 'CSVRecord' END AS event_type,
    event_id,
    CASE WHEN k = 50 THEN NULL WHEN k % 7 = 0 THEN 'user_' || user_id || '@corp.example'
         WHEN k % 7 = 1 THEN 'user_' || user_id ELSE 'CORP\\user_' || user_id END AS "user",
    'host-' || (user_id % 10) AS host,
    CASE WHEN k % 3 <> 0 THEN '10.0.' || (k % 4) || '.' || k END AS ip_address,
    CASE WHEN kind <> 'purchase' THEN NULL WHEN value > 100 THEN 'cmd.exe' WHEN k % 10 = 0 THEN 'wmiprvse.exe'
         WHEN k % 10 < 4 THEN 'powershell.exe' ELSE 'svc_' || k || '.exe' END AS process,
    CASE WHEN kind = 'view' OR k % 25 = 24 THEN '/srv/share/file_' || (seq % 500) END AS file_path,
    CASE WHEN kind = 'error' THEN CASE WHEN value > 20 THEN 'critical' ELSE 'high' END WHEN kind = 'signup' THEN 'high'
         WHEN kind = 'purchase' THEN 'medium' WHEN kind = 'click' AND value > 40 THEN 'high' ELSE 'low' END AS severity,
    {_DESCRIPTION} AS description,
    CASE WHEN kind = 'purchase' THEN CASE WHEN value > 60 THEN 'vssadmin delete shadows /all'
         WHEN k % 9 = 0 THEN 'wmic process list' ELSE 'run ' || k END END AS r_command,
    CASE WHEN kind = 'purchase' AND k % 2 = 0 THEN CASE WHEN k % 5 = 0 THEN 'cmd.exe' ELSE 'explorer.exe' END END AS r_parent,
    CASE WHEN k > 0 THEN CAST(k AS VARCHAR) ELSE '' END AS r_pid,
    CASE WHEN kind = 'view' THEN 'object_' || k END AS r_object,
    CASE WHEN kind = 'signup' AND k % 5 = 0 THEN 'HKLM/Software/Run/item_' || k END AS r_registry,
    CASE WHEN k % 6 = 0 THEN 'UDP' ELSE 'TCP' END AS r_protocol,
    CASE WHEN kind IN ('click', 'error') AND k % 2 = 0
         THEN '10.0.' || ((k * 3 + user_id) % 100 % 4) || '.' || ((k * 3 + user_id) % 100) END AS r_dest,
    CASE WHEN k % 10 = 6 THEN NULL ELSE k * 1000 END AS r_port
  FROM ev0), evs AS (
  SELECT *, severity IN ('high', 'critical') AS is_suspicious,
    CASE severity WHEN 'critical' THEN 0.9::DOUBLE WHEN 'high' THEN 0.7::DOUBLE ELSE 0.2::DOUBLE END AS confidence_score
  FROM ev)"""

_WIN_RULES = [(i, c, a, s) for ids, c, a, s in X.WIN_RULES for i in ids]


def _cascade(part: int) -> str:
    branches = []
    for types, words, *outcome in X.KEYWORD_RULES:
        tests = [f"contains(t, {_text(w)})" for w in types] + [f"contains(d, {_text(w)})" for w in words]
        branches.append(f"WHEN {' OR '.join(tests)} THEN {_text(outcome[part])}")
    return f"CASE {' '.join(branches)} ELSE {_text(X.RULE_OTHERWISE[part])} END"


_NORM = f"""{_EV}, win_rules(id, category, action, severity) AS (VALUES {_values(_WIN_RULES)}), norm AS (
  SELECT e.event_uid, e.case_id, e.evidence_id, e.seq, e."timestamp" AS timestamp_utc, e.host AS hostname, e.host AS device_name,
    CASE WHEN contains("user", '\\') THEN substr("user", strpos("user", '\\') + 1)
         WHEN contains("user", '@') THEN split_part("user", '@', 1) ELSE coalesce("user", 'UNKNOWN_USER') END AS username,
    CASE WHEN contains("user", '\\') THEN split_part("user", '\\', 1)
         WHEN contains("user", '@') THEN substr("user", strpos("user", '@') + 1) END AS domain,
    coalesce(ip_address, nullif(regexp_extract(description, '\\b(?:[0-9]{{1,3}}\\.){{3}}[0-9]{{1,3}}\\b'), '')) AS ip_address,
    process AS process_name, r_pid AS process_id, r_parent AS parent_process, r_command AS command_line, event_type,
    coalesce(w.category, {_cascade(0)}) AS event_category, coalesce(w.severity, {_cascade(2)}) AS severity,
    coalesce(w.action, {_cascade(1)}) AS action,
    r_object AS object_name, file_path, r_registry AS registry_key, r_protocol AS network_protocol, r_dest AS destination_ip,
    r_port AS destination_port, source, source AS parser_source, confidence_score, TRUE AS normalized
  FROM (SELECT *, lower(event_type) AS t, lower(description) AS d FROM evs) e LEFT JOIN win_rules w ON w.id = e.event_id)"""

_CASES = """cases AS (
  SELECT c_custkey AS case_id, c_name AS title, 'Segment ' || c_mktsegment AS description,
    CASE c_custkey % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'in_progress' ELSE 'closed' END AS status,
    CASE c_custkey % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'critical' END AS priority,
    CAST(c_nationkey AS BIGINT) AS investigator_id, c_acctbal < 0 AS is_deleted FROM customer)"""

_FILES = """files AS (
  SELECT doc_id AS evidence_id, CAST(substr(source, 4) AS BIGINT) AS case_id,
    'doc ' || doc_id || CASE doc_id % 6 WHEN 0 THEN '.log' WHEN 1 THEN '.csv' WHEN 2 THEN '.json' WHEN 3 THEN '.exe'
      WHEN 4 THEN '' ELSE '_auth.log' END AS filename,
    CASE doc_id % 6 WHEN 1 THEN 'csv' WHEN 2 THEN 'json' ELSE 'log' END AS file_type,
    CAST(strlen(text) AS BIGINT) AS size, sha256(text) AS sha256, sha1(text) AS sha1, md5(text) AS md5,
    doc_id % 5 <> 0 AS is_parsed, doc_id % 17 = 0 AS is_deleted FROM documents)"""

_EVIDENCE = """evidence AS (
  SELECT evidence_id, min(case_id) AS case_id, 'evidence_' || evidence_id || '.log' AS filename, 'log' AS file_type,
    count(*) AS size, TRUE AS is_parsed, evidence_id % 9 = 0 AS is_deleted FROM evs GROUP BY evidence_id)"""

_CUSTODY = """custody AS (
  SELECT o_orderkey AS log_id, o_custkey AS evidence_id,
    CASE o_orderstatus WHEN 'O' THEN 'UPLOAD' WHEN 'F' THEN 'PARSE' ELSE 'DELETE' END AS action,
    CAST(o_orderdate AS TIMESTAMP) AS "timestamp",
    CASE WHEN o_orderstatus <> 'F' THEN '{"priority":"' || o_orderpriority || '"}' END AS details FROM orders)"""

_RESULTS = """results AS (
  SELECT o_orderkey AS result_id, o_custkey AS case_id, CAST(o_orderdate AS TIMESTAMP) AS validated_at,
    CASE o_orderstatus WHEN 'O' THEN 'PASSED' WHEN 'F' THEN 'PARTIAL' ELSE 'FAILED' END AS validation_status,
    CAST(o_orderkey % 101 AS DOUBLE) AS validation_score, o_orderkey % 7 AS violations_count, o_orderkey % 3 AS resolved_count,
    greatest(0.5::DOUBLE, (o_orderkey % 101) / 100.0::DOUBLE) AS confidence_score FROM orders)"""

_EVENT_TEXT = (
    'event_uid, case_id, evidence_id, seq, "timestamp", ts_inferred, source, event_type, event_id, "user", host, '
    "ip_address, process, file_path, severity, description, is_suspicious, confidence_score"
)


def _add(name: str, ctes: list[str], body: str) -> None:
    ORACLE[name] = f"WITH RECURSIVE {', '.join(ctes)} {body}" if ctes else body


# ---- events and normalization ------------------------------------------------------------

_add(
    "normalize_counts",
    [_NORM],
    """SELECT case_id, event_category, action, severity, count(*) AS event_count, min(timestamp_utc) AS first_seen,
       max(timestamp_utc) AS last_seen FROM norm GROUP BY ALL""",
)
_add("normalize_rows", [_NORM], "SELECT * FROM norm")

_ROWS = """rows0 AS (
  SELECT o_custkey AS case_id, o_orderkey % 64 AS evidence_id, o_orderkey AS seq, o_orderstatus,
    CASE o_orderkey % 6 WHEN 0 THEN 'high' WHEN 1 THEN 'critical' WHEN 4 THEN 'medium' ELSE 'low' END AS severity,
    CASE WHEN o_custkey % 5 = 0 THEN 'UNKNOWN_HOST' ELSE 'host-' || o_custkey END AS host,
    CASE WHEN o_custkey % 7 = 0 THEN 'UNKNOWN_USER' ELSE 'u' || o_custkey END AS "user",
    CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE repeat('Type_', CAST(o_orderkey % 30 AS INTEGER)) END AS event_type0,
    CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE repeat('7', CAST(o_orderkey % 70 AS INTEGER)) END AS event_id0,
    CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE 'Order ' || o_orderstatus END AS description0,
    CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE 'src' || o_orderpriority END AS source0,
    CASE WHEN o_orderkey % 10 IN (0, 1) THEN NULL
         WHEN o_orderkey % 10 = 2 THEN date_trunc('day', o_orderdate::TIMESTAMP) + INTERVAL '10:20:30'
         WHEN o_orderkey % 10 = 3 THEN date_trunc('day', o_orderdate::TIMESTAMP) + INTERVAL '08:20:30.25'
         ELSE date_trunc('second', o_orderdate::TIMESTAMP) END AS ts FROM orders)"""

_UNIVERSAL = """SELECT sha256(evidence_id || '|' || seq) AS event_uid, evidence_id, case_id, seq,
    coalesce(ts, TIMESTAMP '2024-02-01 00:00:00') AS "timestamp", ts IS NULL AS ts_inferred,
    {source} AS source, {event_type} AS event_type,
    nullif(event_id0, '') AS event_id, "user", host, {ip} AS ip_address, CAST(NULL AS VARCHAR) AS process,
    CAST(NULL AS VARCHAR) AS file_path, severity, {description} AS description,
    severity IN ('high', 'critical') AS is_suspicious,
    CASE severity WHEN 'critical' THEN 0.9::DOUBLE WHEN 'high' THEN 0.7::DOUBLE ELSE 0.2::DOUBLE END AS confidence_score
    FROM rows0"""

_add(
    "universal_events",
    [_ROWS],
    _UNIVERSAL.format(
        source="coalesce(nullif(source0, ''), 'System')",
        event_type="coalesce(nullif(event_type0, ''), 'LogEntry')",
        ip="CAST(NULL AS VARCHAR)",
        description="coalesce(description0, 'Parsed event from ' || source0)",
    ),
)
_add(
    "json_roundtrip",
    [_ROWS],
    _UNIVERSAL.format(
        source="'JsonLog'",
        event_type="coalesce(nullif(event_type0, ''), 'JsonLog')",
        ip="nullif(source0, '')",
        description="coalesce(description0, 'record')",
    )
    + " WHERE seq % 13 <> 0",
)

_LINES = f"""parts AS (
  SELECT case_id, evidence_id, seq, k, kind, ts, k % 11 <> 10 AS ok, 'host-' || (user_id % 10) AS host0,
    CASE kind WHEN 'click' THEN 'sshd' WHEN 'view' THEN 'sudo' WHEN 'error' THEN 'sshd' WHEN 'signup' THEN 'useradd' ELSE 'CRON' END AS proc,
    {_DESCRIPTION} AS message FROM base), lines AS (
  SELECT *, CASE WHEN ok THEN message ELSE '-- ' || kind || ' ' || k END AS text,
    CASE WHEN contains(message, 'Failed password') OR contains(message, 'authentication failure') THEN 'failure'
         WHEN contains(message, 'Accepted password') OR contains(message, 'session opened') THEN 'success'
         WHEN contains(message, 'sudo:') OR contains(message, 'root') THEN 'privilege' ELSE 'other' END AS class
  FROM parts)"""

_SYSLOG_END = """SELECT sha256(evidence_id || '|' || seq) AS event_uid, evidence_id, case_id, seq,
    CASE WHEN ok THEN date_trunc('second', ts) ELSE TIMESTAMP '2024-02-01 00:00:00' END AS "timestamp", NOT ok AS ts_inferred,
    source, event_type, event_id, "user", CASE WHEN ok THEN host0 ELSE 'UNKNOWN_HOST' END AS host, ip_address,
    CASE WHEN ok THEN proc END AS process, CAST(NULL AS VARCHAR) AS file_path, severity, text AS description, is_suspicious,
    CASE severity WHEN 'critical' THEN 0.9::DOUBLE WHEN 'high' THEN 0.7::DOUBLE ELSE 0.2::DOUBLE END AS confidence_score FROM shaped"""

_add(
    "syslog_roundtrip",
    [
        _BASE,
        _LINES,
        """shaped0 AS (SELECT *, CASE WHEN ok THEN 'LinuxSyslog' ELSE 'LinuxLog' END AS source,
      CASE WHEN NOT ok THEN 'LogLine' WHEN class = 'failure' THEN 'AuthFailure' WHEN class = 'success' THEN 'AuthSuccess'
           WHEN class = 'privilege' THEN 'PrivilegeEscalation' ELSE 'SyslogMessage' END AS event_type,
      CASE WHEN ok THEN proc END AS event_id,
      CASE WHEN NOT ok THEN 'UNKNOWN_USER'
           WHEN class = 'failure' THEN coalesce(nullif(regexp_extract(message, 'for (invalid user )?([A-Za-z0-9_]+)', 2), ''), 'root')
           WHEN class = 'success' THEN coalesce(nullif(regexp_extract(message, 'for ([A-Za-z0-9_]+)', 1), ''), 'root')
           ELSE 'root' END AS "user",
      CASE WHEN ok AND class IN ('failure', 'success')
           THEN nullif(regexp_extract(message, 'from ([0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3})', 1), '') END AS ip_address,
      CASE WHEN NOT ok THEN 'low' WHEN class = 'failure' THEN 'critical' WHEN class = 'success' THEN 'high'
           WHEN class = 'privilege' THEN 'medium' ELSE 'low' END AS severity FROM lines)""",
        "shaped AS (SELECT *, severity IN ('high', 'critical') AS is_suspicious FROM shaped0)",
    ],
    _SYSLOG_END,
)


def _any(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, {_text(w)})" for w in words) + ")"


_add(
    "syslog_descriptive",
    [
        _BASE,
        _LINES,
        f"""shaped AS (SELECT *, CASE WHEN ok THEN 'Linux Syslog' ELSE 'Linux Log' END AS source, CAST(NULL AS VARCHAR) AS event_id,
      CAST(NULL AS VARCHAR) AS ip_address,
      CASE WHEN NOT ok THEN 'Log Entry'
           WHEN proc = 'sshd' THEN CASE WHEN contains(lower(message), 'accepted') THEN 'SSH Login Success'
             WHEN contains(lower(message), 'failed') OR contains(lower(message), 'invalid') THEN 'SSH Login Failure' ELSE 'SSH Event' END
           WHEN proc = 'sudo' THEN 'Sudo Command' WHEN proc = 'useradd' THEN 'User Created' ELSE 'Cron Job' END AS event_type,
      CASE WHEN NOT ok THEN 'UNKNOWN_USER' ELSE coalesce(
        nullif(regexp_extract(message, '(?i)user ([A-Za-z0-9_]+)', 1), ''),
        nullif(regexp_extract(message, '(?i)for (?:user )?([A-Za-z0-9_]+)(?:\\s|$)', 1), ''),
        nullif(regexp_extract(message, '(?i)by ([A-Za-z0-9_]+)\\b', 1), ''), 'UNKNOWN_USER') END AS "user",
      CASE WHEN NOT ok THEN 'low' WHEN {_any('lower(message)', X.DESCRIPTIVE_SEVERITY[0][1])} THEN 'critical'
           WHEN {_any('lower(message)', X.DESCRIPTIVE_SEVERITY[1][1])} THEN 'high'
           WHEN {_any('lower(message)', X.DESCRIPTIVE_SEVERITY[2][1])} THEN 'medium' ELSE 'low' END AS severity,
      ok AND {_any('lower(message)', X.SUSPICIOUS_WORDS)} AS is_suspicious FROM lines)""",
    ],
    _SYSLOG_END,
)

_WINEVENT = """SELECT event_uid, evidence_id, case_id, seq, "timestamp", FALSE AS ts_inferred, {source} AS source,
    {event_type} AS event_type, event_id, {user} AS "user", host, ip_address, process, CAST(NULL AS VARCHAR) AS file_path, severity,
    {description} AS description, severity IN ('high', 'critical') AS is_suspicious,
    CASE severity WHEN 'critical' THEN 0.9::DOUBLE WHEN 'high' THEN 0.7::DOUBLE ELSE 0.2::DOUBLE END AS confidence_score
    FROM (SELECT * EXCLUDE (severity), {severity} AS severity FROM evs) e WHERE seq % 11 <> 0"""

_ID_SEVERITY = f"""CASE WHEN event_id IN ({', '.join(map(_text, X.WIN_CRITICAL_IDS))}) THEN 'critical'
    WHEN event_id IN ({', '.join(map(_text, X.WIN_HIGH_IDS))}) THEN 'high' ELSE 'low' END"""
_LEVEL_SEVERITY = "CASE seq % 7 WHEN 1 THEN 'critical' WHEN 2 THEN 'high' WHEN 3 THEN 'medium' ELSE 'low' END"
_EVENT_NAME = "coalesce((SELECT name FROM win_names WHERE id = event_id), 'Event ID ' || coalesce(event_id, 'None'))"

_add(
    "winevent_roundtrip",
    [_EV],
    _WINEVENT.format(
        source="'Audit'",
        event_type="coalesce('WinEvent_' || event_id, 'WindowsEvent')",
        user="CASE WHEN seq % 5 <> 0 THEN 'target_' || host ELSE coalesce(\"user\", 'SYSTEM') END",
        severity=_ID_SEVERITY,
        description="'Windows Event Log ID ' || coalesce(event_id, 'None') || ' on ' || host",
    ),
)
_add(
    "winevent_descriptive",
    [_EV],
    _WINEVENT.format(
        source="'Security'",
        event_type=_EVENT_NAME,
        user="coalesce(\"user\", CASE WHEN seq % 5 <> 0 THEN 'target_' || host END, 'UNKNOWN_USER')",
        severity=_LEVEL_SEVERITY,
        description=f"{_EVENT_NAME} || ' — User: ' || coalesce(\"user\", CASE WHEN seq % 5 <> 0 THEN 'target_' || host END, 'Unknown') "
        "|| coalesce(' from ' || ip_address, '')",
    ),
)
_add(
    "win_names",
    [_EV],
    f"SELECT event_uid, {_EVENT_NAME} AS event_name, {_ID_SEVERITY} AS id_severity, {_LEVEL_SEVERITY} AS level_severity FROM evs",
)
_add(
    "edge_weights",
    [],
    """SELECT l_orderkey, l_linenumber, round(1.0::DOUBLE / (
      CASE l_linenumber % 5 WHEN 0 THEN 0.9::DOUBLE WHEN 1 THEN 0.7::DOUBLE WHEN 2 THEN 0.2::DOUBLE ELSE 0.8::DOUBLE END *
      CASE l_linenumber % 4 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE WHEN 2 THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END), 3) AS weight
    FROM lineitem""",
)
_add(
    "heuristics",
    [],
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey = l_partkey THEN 0.0::DOUBLE ELSE
      greatest(0.0::DOUBLE, (l_partkey % 6)::DOUBLE - (CASE WHEN l_suppkey % 5 = 0 THEN 1 ELSE l_suppkey % 5 END)::DOUBLE) * 0.5::DOUBLE END AS gap,
      0.0::DOUBLE AS zero FROM lineitem""",
)

# ---- evidence files ---------------------------------------------------------------------

_add(
    "evidence_inventory",
    [],
    "SELECT page_id, url, CAST(strlen(html) AS BIGINT) AS size, sha256(html) AS sha256, sha1(html) AS sha1, md5(html) AS md5 FROM pages",
)
_add(
    "evidence_gate",
    [_FILES],
    """SELECT evidence_id, replace(filename, ' ', '_') AS clean_name,
      CASE evidence_id % 6 WHEN 1 THEN 'csv' WHEN 2 THEN 'json' WHEN 3 THEN 'exe' WHEN 4 THEN '' ELSE 'log' END AS extension,
      CASE WHEN evidence_id % 6 = 3 THEN 'blocked_extension' WHEN evidence_id % 6 = 4 THEN 'unsupported_extension'
           WHEN size = 0 THEN 'empty_file' END AS reject_reason,
      evidence_id % 6 NOT IN (3, 4) AND size > 0 AS accepted,
      CASE evidence_id % 6 WHEN 1 THEN 'csv' WHEN 2 THEN 'json' WHEN 5 THEN 'syslog' ELSE 'text' END AS format,
      CASE evidence_id % 6 WHEN 1 THEN 'csv' WHEN 2 THEN 'json' ELSE 'log' END AS evidence_type FROM files""",
)
_add(
    "evidence_dedupe",
    [_FILES],
    """SELECT evidence_id, case_id, sha256, size FROM files
      QUALIFY row_number() OVER (PARTITION BY case_id, sha256 ORDER BY evidence_id) = 1""",
)
_add(
    "evidence_duplicates",
    [_FILES],
    """SELECT evidence_id, case_id, min(evidence_id) OVER g AS first_copy,
      evidence_id <> min(evidence_id) OVER g OR bool_or(is_deleted) OVER g AS is_duplicate
      FROM files WINDOW g AS (PARTITION BY case_id, sha256)""",
)
_add(
    "evidence_stages",
    [_NORM, _EVIDENCE, _CASES],
    """SELECT evidence_id, case_id, CASE WHEN case_id IN (SELECT case_id FROM cases WHERE NOT is_deleted) THEN 'CSP_VALIDATED' ELSE 'GRAPH_CREATED' END AS processing_stage
      FROM evidence""",
)
_add(
    "custody_entries",
    [_BASE],
    """SELECT evidence_id, CAST(7 AS BIGINT) AS user_id, 'PARSE' AS action, TIMESTAMP '2024-02-01 00:00:00' AS "timestamp",
      CAST(count(*) AS VARCHAR) AS rows FROM base GROUP BY evidence_id""",
)
_add(
    "custody_trail",
    [_CUSTODY],
    """SELECT * EXCLUDE (details), row_number() OVER (PARTITION BY evidence_id ORDER BY "timestamp", log_id) AS position FROM custody""",
)
_add(
    "recent_activity",
    [_CUSTODY],
    """SELECT log_id, 'Action ''' || action || ''' performed on Evidence #' || evidence_id AS action,
      strftime("timestamp", '%Y-%m-%d %H:%M UTC') AS time,
      CASE action WHEN 'DELETE' THEN 'critical' WHEN 'PARSE' THEN 'high' ELSE 'info' END AS severity,
      coalesce(details, '{}') AS details
      FROM custody ORDER BY custody."timestamp" DESC, log_id DESC LIMIT 6""",
)

# ---- search -----------------------------------------------------------------------------


def _ilike(columns: list[str], needle: str) -> str:
    return "(" + " OR ".join(f"coalesce({c} ILIKE '%{needle}%', FALSE)" for c in columns) + ")"


_EVENT_SEARCH = ["description", '"user"', "host", "process", "ip_address"]
_add(
    "search_events",
    [_EV],
    f"SELECT {_EVENT_TEXT} FROM evs WHERE severity = 'high' AND {_ilike(_EVENT_SEARCH, 'PASSWORD')}",
)
_add(
    "search_normalized",
    [_NORM],
    "SELECT * FROM norm WHERE event_category = 'Process Execution' AND "
    + _ilike(["action", "username", "hostname", "ip_address", "process_name"], "ER"),
)
_add(
    "search_cases",
    [_CASES],
    f"SELECT * FROM cases WHERE NOT is_deleted AND investigator_id = 3 AND status = 'open' AND {_ilike(['title', 'description'], 'segment b')}",
)
_add(
    "search_evidence",
    [_FILES],
    "SELECT * FROM files WHERE NOT is_deleted AND file_type = 'log' AND "
    + _ilike(["filename", "'upload/doc ' || evidence_id", "sha256"], "a1"),
)
_add("suspicious_ranked", [_EV], f"SELECT {_EVENT_TEXT} FROM evs WHERE is_suspicious")
_add(
    "active_alerts",
    [_EV],
    "SELECT event_uid, case_id, severity, event_type FROM evs WHERE severity IN ('high', 'critical')",
)
_add(
    "timeline_keyword",
    [_EV],
    f"""SELECT {_EVENT_TEXT} FROM evs WHERE contains(lower(event_type), 'logon')
      OR contains(lower(coalesce("user", '')), 'logon') OR contains(lower(host), 'logon')""",
)
_add("case_title_search", [_CASES], "SELECT * FROM cases WHERE contains(lower(title), '00012')")
_add(
    "total_matches",
    [_EV],
    f"SELECT case_id, count(*) AS total FROM evs WHERE {_ilike(_EVENT_SEARCH, '10.0.1.')} GROUP BY case_id",
)

# ---- timeline ---------------------------------------------------------------------------

_add(
    "timeline_sequence",
    [_EV],
    """SELECT event_uid, case_id, "timestamp",
      row_number() OVER (PARTITION BY case_id ORDER BY evs."timestamp" NULLS FIRST, seq, event_uid) AS sequence_id FROM evs""",
)
_add(
    "timeline_range",
    [_EV],
    f"""SELECT {_EVENT_TEXT} FROM evs WHERE evs."timestamp" >= TIMESTAMP '2024-01-05 00:00:00'
      AND evs."timestamp" <= TIMESTAMP '2024-01-20 12:00:00' AND severity = 'high'""",
)
_add(
    "timeline_join",
    [_EV, _EVIDENCE],
    """SELECT event_uid, e.evidence_id, f.case_id, e."timestamp", severity FROM evs e JOIN evidence f USING (evidence_id)
      WHERE NOT f.is_deleted""",
)
_add(
    "timeline_page",
    [_EV],
    """SELECT event_uid, case_id, "timestamp", event_type FROM evs WHERE case_id = 3
      ORDER BY evs."timestamp", event_uid LIMIT 100 OFFSET 20""",
)
_add(
    "owned_events",
    [_EV, _CASES],
    "SELECT event_uid, case_id FROM evs WHERE case_id IN (SELECT case_id FROM cases WHERE NOT is_deleted AND investigator_id = 10)",
)
_add(
    "reports_of_owner",
    [_CASES],
    """SELECT o_custkey AS case_id, o_orderkey AS report_id, CAST(o_orderdate AS TIMESTAMP) AS created_at, title
      FROM orders JOIN cases ON cases.case_id = o_custkey WHERE investigator_id = 3""",
)
_add(
    "dashboard_stats",
    [_EV, _CASES, _FILES],
    """SELECT (SELECT count(*) FROM cases WHERE NOT is_deleted) AS total_cases,
      (SELECT count(*) FROM files WHERE NOT is_deleted) AS total_evidence,
      (SELECT count(*) FROM evs WHERE severity IN ('high', 'critical')) AS active_alerts,
      (SELECT count(*) FROM files WHERE NOT is_deleted AND is_parsed) AS timelines_built""",
)

# ---- correlation and detection -------------------------------------------------------------

_add(
    "correlate_events",
    [
        _EV,
        """counted AS (SELECT *,
      CASE WHEN "user" IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY case_id, "user") - 1 END +
      CASE WHEN ip_address IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY case_id, ip_address) - 1 END AS n FROM evs)""",
    ],
    """SELECT event_uid, n AS correlation_count, is_suspicious OR n > 3 AS is_suspicious,
      CASE WHEN n > 3 THEN least(0.95::DOUBLE, 0.5::DOUBLE + n * 0.05::DOUBLE) ELSE confidence_score END AS confidence_score FROM counted""",
)

_RULES = f"rules(rule_name, title, event_type, threshold, severity, confidence) AS (VALUES {_values(X.DETECTION_RULES)})"
_ALERTS = """alerts AS (SELECT e.case_id, r.rule_name, any_value(r.title) AS title, any_value(r.severity) AS severity,
    CAST(any_value(r.confidence) AS DOUBLE) AS confidence, count(*) AS event_count,
    array_to_string(list_slice(list(event_uid ORDER BY e."timestamp" NULLS FIRST, event_uid), 1, 5), ',') AS events
    FROM evs e JOIN rules r ON r.event_type = e.event_type GROUP BY e.case_id, r.rule_name
    HAVING count(*) >= any_value(r.threshold))"""
_add("detect_alerts", [_EV, _RULES, _ALERTS], "SELECT * FROM alerts")
_add(
    "detect_first_events",
    [_EV, _RULES],
    """SELECT case_id, rule_name, row_number() OVER w AS position, event_uid, evs."timestamp" FROM evs JOIN rules USING (event_type)
      WINDOW w AS (PARTITION BY case_id, rule_name ORDER BY evs."timestamp" NULLS FIRST, event_uid) QUALIFY row_number() OVER w <= 5""",
)
_add(
    "detect_windowed",
    [_EV],
    """SELECT case_id, time_bucket(INTERVAL '10 minutes', evs."timestamp") AS window_start,
      time_bucket(INTERVAL '10 minutes', evs."timestamp") + INTERVAL '10 minutes' AS window_end, count(*) AS event_count
      FROM evs WHERE event_type = 'Failed Logon' GROUP BY 1, 2, 3 HAVING count(*) >= 2""",
)

# ---- graph --------------------------------------------------------------------------------

_LABELS = """labelled AS (SELECT *, CASE WHEN domain IS NOT NULL THEN domain || '\\' || username ELSE username END AS user_label,
    'Event_' || event_uid AS event_label, 'Evidence_' || evidence_id AS evidence_label FROM norm)"""


def _descriptor(slot: int, node_type: str, label: str, properties: list[tuple[str, str]], when: str = "TRUE") -> str:
    rows = properties or [(None, "NULL")]
    return " UNION ALL ".join(
        f"SELECT case_id, timestamp_utc, event_uid, {slot} AS slot, '{node_type}' AS node_type, {label} AS node_label, "
        f"{_text(name)} AS name, CAST({value} AS VARCHAR) AS held FROM labelled WHERE {when}"
        for name, value in rows
    )


_ENTITIES = "entities AS (" + " UNION ALL ".join(
    [
        _descriptor(0, "Host", "hostname", [("device_name", "device_name"), ("case_id", "case_id")]),
        _descriptor(1, "User", "user_label", [("username", "username"), ("domain", "domain")]),
        _descriptor(2, "IP_Address", "ip_address", [("type", "'source_ip'")], "ip_address IS NOT NULL"),
        _descriptor(
            3, "IP_Address", "destination_ip", [("type", "'destination_ip'"), ("port", "destination_port")],
            "destination_ip IS NOT NULL",
        ),
        _descriptor(
            4, "Process", "process_name", [("process_id", "process_id"), ("command_line", "command_line")],
            "process_name IS NOT NULL",
        ),
        _descriptor(5, "Parent_Process", "parent_process", [], "parent_process IS NOT NULL"),
        _descriptor(6, "File", "file_path", [("object_name", "object_name")], "file_path IS NOT NULL"),
        _descriptor(7, "Registry_Key", "registry_key", [], "registry_key IS NOT NULL"),
        _descriptor(8, "Evidence", "evidence_label", [("evidence_id", "evidence_id")]),
    ]
) + ")"

_NODES = """latest AS (SELECT case_id, node_type, node_label, name, held FROM entities
    QUALIFY row_number() OVER (PARTITION BY case_id, node_type, node_label, name ORDER BY timestamp_utc DESC, event_uid DESC, slot DESC) = 1),
  merged AS (SELECT case_id, node_type, node_label,
      coalesce(string_agg(name || '=' || coalesce(held, 'null'), ';' ORDER BY name) FILTER (WHERE name IS NOT NULL), '') AS properties
    FROM latest GROUP BY ALL),
  every AS (SELECT * FROM merged UNION ALL
    SELECT case_id, 'Normalized_Event', event_label, 'action=' || action || ';category=' || event_category || ';event_uuid=' || event_uid ||
      ';severity=' || severity || ';timestamp=' || strftime(timestamp_utc, '%Y-%m-%dT%H:%M:%S') ||
      CASE WHEN date_trunc('second', timestamp_utc) = timestamp_utc THEN '' ELSE '.' || strftime(timestamp_utc, '%f') END || '+00:00'
    FROM labelled),
  nodes AS (SELECT case_id, sha256(case_id || '|' || node_type || '|' || node_label) AS node_id, node_type, node_label, properties FROM every)"""


def _relation(src: tuple[str, str], dst: tuple[str, str], edge_type: str, properties: str, when: str, confidence: str = "confidence_score") -> str:
    return (
        f"SELECT case_id, event_uid, timestamp_utc, severity, {src[0]} AS src_type, {src[1]} AS src_label, {dst[0]} AS dst_type, "
        f"{dst[1]} AS dst_label, {edge_type} AS edge_type, {confidence} AS confidence, {properties} AS properties "
        f"FROM labelled WHERE {when}"
    )


_ACTOR = ("CASE WHEN process_name IS NOT NULL THEN 'Process' ELSE 'User' END", "coalesce(process_name, user_label)")
_USER, _HOST, _PROCESS = ("'User'", "user_label"), ("'Host'", "hostname"), ("'Process'", "process_name")
_RELATIONS = "relations AS (" + " UNION ALL ".join(
    [
        _relation(
            _USER, _HOST, "CASE action WHEN 'AUTH_SUCCESS' THEN 'AUTHENTICATED' ELSE 'FAILED_AUTH' END",
            "'action=' || action || ';ip=' || coalesce(ip_address, 'null')",
            "event_category = 'Authentication' AND action IN ('AUTH_SUCCESS', 'AUTH_FAILURE')",
        ),
        _relation(
            _USER, _PROCESS, "'EXECUTED'", "'cmd=' || coalesce(command_line, 'null') || ';pid=' || process_id",
            "process_name IS NOT NULL",
        ),
        _relation(
            ("'Parent_Process'", "parent_process"), _PROCESS, "'SPAWNED'", "'parent=' || parent_process",
            "process_name IS NOT NULL AND parent_process IS NOT NULL",
        ),
        _relation(
            _ACTOR, ("'File'", "file_path"),
            "CASE WHEN contains(lower(action), 'write') OR contains(lower(action), 'create') THEN 'WROTE' "
            "WHEN contains(lower(action), 'read') OR contains(lower(action), 'access') THEN 'READ' "
            "WHEN contains(lower(action), 'delete') THEN 'DELETED' ELSE 'MODIFIED' END",
            "'file=' || file_path", "file_path IS NOT NULL",
        ),
        _relation(
            ("'IP_Address'", "ip_address"), ("'IP_Address'", "destination_ip"), "'COMMUNICATED_WITH'",
            "'port=' || coalesce(CAST(destination_port AS VARCHAR), 'null') || ';protocol=' || network_protocol",
            "ip_address IS NOT NULL AND destination_ip IS NOT NULL",
        ),
        _relation(_ACTOR, ("'Registry_Key'", "registry_key"), "'PERSISTED'", "'key=' || registry_key", "registry_key IS NOT NULL"),
        _relation(
            ("'Normalized_Event'", "event_label"), ("'Evidence'", "evidence_label"), "'BELONGS_TO'",
            "'event_uuid=' || event_uid", "TRUE", "1.0::DOUBLE",
        ),
    ]
) + """), edges AS (SELECT case_id, sha256(case_id || '|' || event_uid || '|' || edge_type) AS edge_id,
    sha256(case_id || '|' || src_type || '|' || src_label) AS src_id, sha256(case_id || '|' || dst_type || '|' || dst_label) AS dst_id,
    src_label, dst_label, edge_type,
    round(1.0::DOUBLE / (confidence * CASE severity WHEN 'critical' THEN 5.0::DOUBLE WHEN 'high' THEN 2.0::DOUBLE
      WHEN 'medium' THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END), 3) AS weight,
    confidence, timestamp_utc AS "timestamp", properties FROM relations)"""

_GRAPH = [_NORM, _LABELS, _ENTITIES, _NODES, _RELATIONS]

_add("graph_nodes", _GRAPH[:4], "SELECT * FROM nodes")
_add("graph_edges", [_NORM, _LABELS, _RELATIONS], "SELECT * FROM edges")
_add(
    "graph_stats",
    [*_GRAPH, _CASES],
    """SELECT c.case_id, coalesce(n, 0) AS node_count, coalesce(e, 0) AS edge_count,
      CASE WHEN coalesce(n, 0) > 1 THEN round(e::DOUBLE / (n::DOUBLE * (n - 1)), 4) ELSE 0.0::DOUBLE END AS density
      FROM cases c LEFT JOIN (SELECT case_id, count(*) AS n FROM nodes GROUP BY 1) USING (case_id)
      LEFT JOIN (SELECT case_id, count(*) AS e FROM edges GROUP BY 1) USING (case_id)""",
)
_add("nodes_of_type", _GRAPH[:4], "SELECT * FROM nodes WHERE node_type = 'IP_Address'")
_add(
    "edges_of_type",
    [_NORM, _LABELS, _RELATIONS],
    """SELECT case_id, edge_id, src_label, dst_label, weight, confidence, "timestamp" FROM edges WHERE edge_type = 'COMMUNICATED_WITH'""",
)
_add(
    "node_search",
    _GRAPH[:4],
    "SELECT case_id, node_id, node_type, node_label FROM nodes WHERE contains(lower(node_label), 'exe') OR contains(lower(node_type), 'exe')",
)
_ENDS = "ends AS (SELECT *, src_id AS node_id FROM edges UNION ALL SELECT *, dst_id FROM edges)"
_add(
    "incident_edges",
    [*_GRAPH, _ENDS],
    "SELECT case_id, node_id, node_type, node_label, edge_id, edge_type FROM ends JOIN nodes USING (case_id, node_id)",
)
_add(
    "incident_counts",
    [*_GRAPH, _ENDS],
    """SELECT n.case_id, n.node_id, node_type, node_label, count(e.edge_id) AS edge_count
      FROM nodes n LEFT JOIN ends e ON e.case_id = n.case_id AND e.node_id = n.node_id GROUP BY ALL""",
)

# An event has one link only, to its evidence; so events are folded into the evidence first,
# and labels then spread along the links of the other nodes until nothing changes.
_COMPONENTS = """inner_nodes AS MATERIALIZED (SELECT case_id, node_id, least(node_id, coalesce(low, node_id)) AS low FROM nodes
    LEFT JOIN (SELECT case_id, dst_id AS node_id, min(src_id) AS low FROM edges WHERE edge_type = 'BELONGS_TO' GROUP BY ALL)
      USING (case_id, node_id) WHERE node_type <> 'Normalized_Event'),
  links AS MATERIALIZED (SELECT DISTINCT case_id, src_id AS a, dst_id AS b FROM edges WHERE src_id <> dst_id AND edge_type <> 'BELONGS_TO'),
  both_ways AS MATERIALIZED (SELECT case_id, a, b FROM links UNION SELECT case_id, b, a FROM links),
  spread(case_id, node_id, low) USING KEY (case_id, node_id) AS (
    SELECT case_id, node_id, low FROM inner_nodes
    UNION
    SELECT w.case_id, w.b, min(s.low) FROM spread s JOIN both_ways w ON w.case_id = s.case_id AND w.a = s.node_id
      JOIN recurring.spread r ON r.case_id = w.case_id AND r.node_id = w.b
    GROUP BY w.case_id, w.b, r.low HAVING min(s.low) < r.low),
  labelled_nodes AS (SELECT * FROM spread UNION ALL SELECT e.case_id, e.src_id, s.low FROM edges e JOIN spread s
    ON s.case_id = e.case_id AND s.node_id = e.dst_id WHERE edge_type = 'BELONGS_TO')"""
_add("connected_components", [*_GRAPH, _COMPONENTS], "SELECT case_id, node_id, low AS component_id FROM labelled_nodes")
_add(
    "component_counts",
    [*_GRAPH, _COMPONENTS],
    "SELECT case_id, count(DISTINCT low) AS components FROM labelled_nodes GROUP BY case_id",
)

# ---- paths --------------------------------------------------------------------------------

_PATHS = """steps AS MATERIALIZED (SELECT case_id, src_label AS a, dst_label AS b, min(greatest(0.01::DOUBLE, weight)) AS w FROM edges
    WHERE src_label <> dst_label GROUP BY ALL),
  addresses AS MATERIALIZED (SELECT case_id, node_label, min(node_label) OVER (PARTITION BY case_id) AS start_node
    FROM nodes WHERE node_type = 'IP_Address'),
  reach(case_id, node, cost) USING KEY (case_id, node) AS (
    SELECT DISTINCT case_id, start_node, 0.0::DOUBLE FROM addresses
    UNION
    SELECT s.case_id, s.b, min(r.cost + s.w) FROM reach r JOIN steps s ON s.case_id = r.case_id AND s.a = r.node
      LEFT JOIN recurring.reach old ON old.case_id = s.case_id AND old.node = s.b
    GROUP BY s.case_id, s.b, old.cost HAVING old.cost IS NULL OR min(r.cost + s.w) < old.cost),
  tight AS MATERIALIZED (SELECT s.case_id, s.a, s.b FROM steps s JOIN reach x ON x.case_id = s.case_id AND x.node = s.a
    JOIN reach y ON y.case_id = s.case_id AND y.node = s.b WHERE x.cost + s.w = y.cost),
  hop(case_id, node, hops) USING KEY (case_id, node) AS (
    SELECT DISTINCT case_id, start_node, 0 FROM addresses
    UNION
    SELECT t.case_id, t.b, min(h.hops) + 1 FROM hop h JOIN tight t ON t.case_id = h.case_id AND t.a = h.node
      LEFT JOIN recurring.hop old ON old.case_id = t.case_id AND old.node = t.b
    GROUP BY t.case_id, t.b, old.hops HAVING old.hops IS NULL OR min(h.hops) + 1 < old.hops),
  before AS MATERIALIZED (SELECT t.case_id, t.b AS node, min(t.a) AS previous FROM tight t JOIN hop x ON x.case_id = t.case_id AND x.node = t.a
    JOIN hop y ON y.case_id = t.case_id AND y.node = t.b WHERE x.hops + 1 = y.hops GROUP BY ALL),
  walk(case_id, goal, node, path, steps) AS (
    SELECT a.case_id, a.node_label, a.node_label, a.node_label, 0 FROM addresses a JOIN reach r ON r.case_id = a.case_id AND r.node = a.node_label
    UNION ALL
    SELECT w.case_id, w.goal, b.previous, b.previous || ' > ' || w.path, w.steps + 1 FROM walk w JOIN before b ON b.case_id = w.case_id AND b.node = w.node),
  ways AS (SELECT case_id, goal, arg_max(path, steps) AS path FROM walk GROUP BY ALL)"""
_PATH_BODY = """SELECT a.case_id || '>' || node_label AS request_id, a.case_id, start_node, node_label AS goal_node,
    CASE WHEN r.cost IS NULL THEN 'no_path' ELSE 'ok' END AS status, r.cost IS NOT NULL AS is_path_found,
    round(r.cost, 4) AS total_cost, coalesce(ways.path, '') AS path{extra} FROM addresses a LEFT JOIN reach r ON r.case_id = a.case_id AND r.node = node_label
    LEFT JOIN ways ON ways.case_id = a.case_id AND ways.goal = node_label"""
_add(
    "cheapest_path",
    [*_GRAPH, _PATHS],
    _PATH_BODY.format(
        extra=""", CASE WHEN r.cost IS NULL THEN (SELECT count(*) FROM reach x WHERE x.case_id = a.case_id)
      ELSE (SELECT count(*) FROM reach x WHERE x.case_id = a.case_id AND x.cost < r.cost) + 1 END AS visited_nodes_count"""
    ),
)


def _level(label: str) -> str:
    return f"(CASE WHEN length({label}) % 4 > 0 THEN length({label}) % 4 ELSE 1 END)::DOUBLE"


_add(
    "goal_path",
    [*_GRAPH, _PATHS],
    _PATH_BODY.format(
        extra=f""", CASE WHEN start_node = node_label THEN 0.0::DOUBLE
      ELSE round(greatest(0.0::DOUBLE, {_level('node_label')} - {_level('start_node')}) * 0.5::DOUBLE, 4) END AS heuristic_cost"""
    ),
)
_add(
    "own_heuristic",
    [*_GRAPH, _PATHS],
    _PATH_BODY.format(
        extra=""", CASE WHEN start_node = node_label THEN 0.0::DOUBLE ELSE 0.01::DOUBLE END AS heuristic_cost,
      CASE WHEN r.cost IS NULL THEN (SELECT count(*) FROM reach x WHERE x.case_id = a.case_id)
      ELSE (SELECT count(*) FROM reach x WHERE x.case_id = a.case_id AND x.node <> node_label AND x.cost + 0.01::DOUBLE < r.cost) + 1 END AS visited_nodes_count"""
    ),
)
_add(
    "path_resolution",
    [*_GRAPH[:4], _CASES],
    """SELECT node_id || '>r' AS request_id, q AS case_id, CASE WHEN q < 1000000 THEN node_label END AS start,
      CASE WHEN q < 1000000 AND n % 3 <> 0 THEN node_label END AS goal,
      CASE WHEN q NOT IN (SELECT case_id FROM cases WHERE NOT is_deleted) THEN 'case_not_found' WHEN n % 3 = 0 THEN 'goal_not_found' END AS status
      FROM (SELECT *, length(node_label) AS n, CASE WHEN length(node_label) % 7 = 0 THEN case_id + 1000000 ELSE case_id END AS q
        FROM nodes WHERE node_type IN ('User', 'Process', 'Host'))""",
)

# ---- validation ------------------------------------------------------------------------------

_FAILURES = """broken AS (SELECT * REPLACE (CASE WHEN edge_type = 'SPAWNED' AND edge_id[1] IN ('0', '1') THEN NULL ELSE src_id END AS src_id)
    FROM edges),
  touching AS (SELECT *, src_id AS node_id FROM broken WHERE src_id IS NOT NULL UNION ALL SELECT *, dst_id FROM broken),
  measured AS (SELECT case_id, node_id,
      bool_or(edge_type = 'SPAWNED' AND src_id IS NULL) AS orphan,
      bool_or(edge_type = 'DELETED') AND NOT bool_or(edge_type IN ('WROTE', 'CREATED', 'READ')) AS bad_file,
      bool_or(edge_type = 'FAILED_AUTH') AND bool_or(edge_type = 'EXECUTED') AND NOT bool_or(edge_type = 'AUTHENTICATED') AS bad_session,
      min({'t': touching."timestamp", 'e': edge_id, 'p': port}) FILTER (WHERE edge_type = 'COMMUNICATED_WITH' AND port > 65535) AS bad
    FROM (SELECT *, TRY_CAST(nullif(regexp_extract(properties, 'port=([0-9]+)', 1), '') AS BIGINT) AS port FROM touching) touching
    GROUP BY case_id, node_id),
  failures AS (
    SELECT case_id, node_id, node_type, node_label, 2 AS rule_id, 'Process Tree Parent-Child Consistency' AS rule_name, 'Process' AS category,
      'RESOLVED' AS status, 'Orphan process execution on ''' || node_label || ''': Missing parent process link.' AS violation_reason,
      'Successfully assigned orphan process to SYSTEM_ROOT virtual parent node.' AS resolution_details
    FROM nodes JOIN measured USING (case_id, node_id) WHERE node_type = 'Process' AND orphan
    UNION ALL SELECT case_id, node_id, node_type, node_label, 3, 'File Lifecycle Operations Consistency', 'File', 'VIOLATION',
      'File lifecycle anomaly on ''' || node_label || ''': File deletion without prior creation or write access.',
      'Infer missing file write reference.'
    FROM nodes JOIN measured USING (case_id, node_id) WHERE node_type = 'File' AND bad_file
    UNION ALL SELECT case_id, node_id, node_type, node_label, 4, 'User Authentication Session Validity', 'Authentication', 'VIOLATION',
      'Authentication violation for ''' || node_label || ''': Process executions recorded with 0 successful authentications.',
      'Flag account for credential theft or lateral movement investigation.'
    FROM nodes JOIN measured USING (case_id, node_id) WHERE node_type = 'User' AND bad_session
    UNION ALL SELECT case_id, node_id, node_type, node_label, 5, 'Network Flow & Protocol Consistency', 'Network', 'VIOLATION',
      'Network port boundary violation on ''' || node_label || ''': Invalid port ' || bad.p || '.',
      'Sanitize port value to standard TCP/UDP range.'
    FROM nodes JOIN measured USING (case_id, node_id) WHERE node_type = 'IP_Address' AND bad IS NOT NULL),
  summary0 AS (SELECT n.case_id, checks, coalesce(violations, 0) AS violations_count, coalesce(resolved, 0) AS resolved_count,
      round((checks - coalesce(violations, 0))::DOUBLE / checks * 100.0::DOUBLE, 2) AS validation_score
    FROM (SELECT case_id, count(*) * 5 AS checks FROM nodes GROUP BY 1) n
    LEFT JOIN (SELECT case_id, count(*) FILTER (WHERE status = 'VIOLATION') AS violations,
      count(*) FILTER (WHERE status = 'RESOLVED') AS resolved FROM failures GROUP BY 1) f USING (case_id)),
  summary AS (SELECT case_id, CASE WHEN violations_count = 0 THEN 'PASSED' WHEN validation_score >= 70 THEN 'PARTIAL' ELSE 'FAILED' END
      AS validation_status, validation_score, violations_count, resolved_count,
      round(greatest(0.5::DOUBLE, validation_score / 100.0::DOUBLE), 2) AS confidence_score FROM summary0)"""
_CHECKED = [*_GRAPH, _FAILURES]
_add("validate_nodes", _CHECKED, "SELECT * FROM failures")
_add("validate_summary", _CHECKED, "SELECT * FROM summary")
_add(
    "validation_records",
    _CHECKED,
    """SELECT case_id, rule_id, node_id, status, violation_reason, resolution_details,
      CASE status WHEN 'VIOLATION' THEN confidence_score ELSE 0.9::DOUBLE END AS confidence FROM failures JOIN summary USING (case_id)""",
)
_add(
    "validation_rules",
    _CHECKED,
    """SELECT r.rule_id, r.rule_name, r.category, r.severity, count(f.node_id) AS failures FROM (VALUES
      (1, 'Temporal Sequence Consistency', 'Temporal', 'medium'), (2, 'Process Tree Parent-Child Consistency', 'Process', 'high'),
      (3, 'File Lifecycle Operations Consistency', 'File', 'medium'), (4, 'User Authentication Session Validity', 'Authentication', 'critical'),
      (5, 'Network Flow & Protocol Consistency', 'Network', 'medium')) r(rule_id, rule_name, category, severity)
      LEFT JOIN failures f ON f.rule_id = r.rule_id GROUP BY ALL""",
)
_add(
    "resolved_nodes",
    _CHECKED,
    """SELECT case_id, node_label, CASE WHEN node_id IN (SELECT node_id FROM failures WHERE status = 'RESOLVED') THEN 'SYSTEM_ROOT' END
      AS resolved_parent FROM nodes WHERE node_type = 'Process'""",
)
_NEWEST = """newest AS (SELECT * FROM results
    QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY validated_at DESC, result_id DESC) = 1)"""
_add("latest_validation", [_RESULTS, _NEWEST], "SELECT * FROM newest")
_add(
    "validation_status",
    [_RESULTS, _NEWEST, _CASES],
    """SELECT c.case_id, coalesce(validation_status, 'UNVALIDATED') AS validation_status, coalesce(validation_score, 0.0) AS validation_score,
      coalesce(violations_count, 0) AS violations_count, coalesce(resolved_count, 0) AS resolved_count,
      coalesce(confidence_score, 0.0) AS confidence_score FROM cases c LEFT JOIN newest USING (case_id)""",
)
_add(
    "violations_newest",
    [_RESULTS],
    """SELECT case_id, result_id AS record_id, validated_at AS created_at, violations_count FROM results
      WHERE validation_status = 'FAILED'""",
)

# ---- inference ----------------------------------------------------------------------------------

_FACTS = """tested AS (SELECT *, upper(action) AS a, upper(coalesce(command_line, '')) AS c, upper(coalesce(process_name, '')) AS p FROM norm),
  single AS (
    SELECT case_id, timestamp_utc, event_uid, 1 AS test, 'AUTH_FAILURE' AS fact_type, 'user:' || username AS entity, action AS value,
      0.9::DOUBLE AS confidence FROM tested WHERE contains(a, 'FAIL') OR contains(a, 'DENIED')
    UNION ALL SELECT case_id, timestamp_utc, event_uid, 2, 'SHADOW_COPY_DELETION', 'host:' || hostname, command_line, 0.95::DOUBLE
      FROM tested WHERE contains(c, 'VSSADMIN') OR contains(c, 'DELETE SHADOWS')
    UNION ALL SELECT case_id, timestamp_utc, event_uid, 3, 'SUSPICIOUS_PROCESS_EXECUTION', 'host:' || hostname, process_name, 0.85::DOUBLE
      FROM tested WHERE contains(p, 'POWERSHELL') OR contains(p, 'CMD.EXE')
    UNION ALL SELECT case_id, timestamp_utc, event_uid, 4, 'WMI_EXECUTION', 'host:' || hostname, coalesce(command_line, process_name), 0.9::DOUBLE
      FROM tested WHERE contains(p, 'WMI') OR contains(c, 'WMI')),
  placed AS (SELECT *, row_number() OVER (PARTITION BY case_id, event_uid ORDER BY test) - 1 AS slot,
      row_number() OVER (PARTITION BY case_id ORDER BY timestamp_utc, event_uid, test) AS number FROM single),
  burst AS (SELECT case_id, 'AUTH_FAILURE_BURST' AS fact_type, 'AUTHENTICATION_SERVICE' AS entity,
      count(*) FILTER (WHERE test = 1) || '_failures' AS value, 0.9::DOUBLE AS confidence, count(*) + 1 AS number
    FROM single GROUP BY case_id HAVING count(*) FILTER (WHERE test = 1) >= 3),
  given AS (SELECT page_id % 8 AS case_id, 'PAGE_' || page_id AS fact_id,
      CASE page_id % 3 WHEN 0 THEN 'MASS_FILE_RENAME' WHEN 1 THEN 'PROCESS_CREATE' ELSE 'NOTE' END AS fact_type,
      'page:' || (page_id % 40) AS entity,
      CASE page_id % 5 WHEN 0 THEN 'PowerShell -enc' WHEN 1 THEN 'vssadmin list' ELSE 'True' END AS value, 1.0::DOUBLE AS confidence FROM pages),
  facts AS (SELECT case_id, sha256(event_uid || '|' || slot) AS fact_id, fact_type, entity, value, confidence FROM placed
    UNION ALL SELECT case_id, 'DB_F_BURST', fact_type, entity, value, confidence FROM burst
    UNION ALL SELECT * FROM given),
  uniq AS (SELECT case_id, min(fact_id) AS fact_id, fact_type, entity, value, arg_min(confidence, fact_id) AS confidence
    FROM facts GROUP BY case_id, fact_type, entity, value)"""

_add("facts", [_NORM, _FACTS], "SELECT * FROM facts")
_add(
    "facts_numbered",
    [_NORM, _FACTS],
    """SELECT case_id, 'DB_F_' || number AS fact_id, fact_type, entity, value, confidence FROM placed
      UNION ALL SELECT case_id, 'DB_F_' || number, fact_type, entity, value, confidence FROM burst""",
)
_add("distinct_facts", [_NORM, _FACTS], "SELECT * FROM uniq")
_add(
    "auth_failure_burst", [_NORM, _FACTS], "SELECT case_id, fact_type, entity, value, confidence FROM burst"
)

_CONCLUSIONS = [
    ("RULE_01_BRUTE_FORCE", "F_BF_01", "SUSPECTED_BRUTE_FORCE", "AUTHENTICATION_SERVICE", "True", 0.85),
    ("RULE_01_BRUTE_FORCE", "F_BF_02", "THREAT_INDICATOR", "ACCOUNT_COMPROMISE_RISK", "HIGH", 0.85),
    ("RULE_02_WMI_LATERAL", "F_LAT_01", "THREAT_TACTIC", "LATERAL_MOVEMENT_WMI", "T1047", 0.90),
    ("RULE_02_WMI_LATERAL", "F_LAT_02", "ALERT_GENERATED", "REMOTE_COMMAND_EXECUTION", "CRITICAL", 0.90),
    ("RULE_03_RANSOMWARE", "F_RANSOM_01", "CRITICAL_THREAT", "RANSOMWARE_ACTIVITY", "T1490", 0.95),
    ("RULE_03_RANSOMWARE", "F_RANSOM_02", "INCIDENT_HYPOTHESIS", "SYSTEM_DESTRUCTIVE_ATTACK", "CRITICAL", 0.95),
]
_HITS = f"""premises AS (SELECT *, fact_type = 'AUTH_FAILURE_BURST' AS p1,
      fact_type IN ('SUSPICIOUS_PROCESS_EXECUTION', 'PROCESS_CREATE') AND (contains(lower(value), 'powershell') OR contains(lower(value), 'cmd.exe')) AS p2a,
      fact_type = 'WMI_EXECUTION' AS p2b,
      fact_type = 'SHADOW_COPY_DELETION' OR contains(lower(value), 'vssadmin') AS p3,
      fact_type IN ('MASS_FILE_RENAME', 'HIGH_ENTROPY_FILE_WRITE') AS c3 FROM uniq),
  fired AS (
    SELECT case_id, 0 AS position, 'RULE_01_BRUTE_FORCE' AS rule_id, 'Brute Force Authentication Pattern' AS rule_name,
      'AUTHENTICATION' AS category, 'HIGH' AS severity FROM premises GROUP BY case_id HAVING bool_or(p1)
    UNION ALL SELECT case_id, 1, 'RULE_02_WMI_LATERAL', 'WMI Remote Script Execution', 'LATERAL_MOVEMENT', 'CRITICAL'
      FROM premises GROUP BY case_id HAVING bool_or(p2a) AND bool_or(p2b)
    UNION ALL SELECT case_id, 2, 'RULE_03_RANSOMWARE', 'Volume Shadow Copy Tampering & Encryption', 'DEFENSE_EVASION', 'CRITICAL'
      FROM premises GROUP BY case_id HAVING bool_or(p3)),
  conclusions(rule_id, fact_id, fact_type, entity, value, confidence) AS (VALUES {_values(_CONCLUSIONS)}),
  derived AS (SELECT case_id, rule_id, c.fact_id, c.fact_type, c.entity, c.value, CAST(c.confidence AS DOUBLE) AS confidence
    FROM fired JOIN conclusions c USING (rule_id))"""
_add("derived_facts", [_NORM, _FACTS, _HITS], "SELECT * FROM derived")
_add(
    "fired_rules",
    [_NORM, _FACTS, _HITS],
    """SELECT case_id, 1 AS round, position, rule_id, rule_name, category, severity,
      string_agg(fact_type || ':' || entity || '=' || value, ';' ORDER BY fact_id) AS derived_facts
      FROM fired JOIN derived USING (case_id, rule_id) GROUP BY ALL""",
)
_add(
    "own_rule",
    [_NORM, _FACTS],
    """SELECT case_id, c.* FROM (SELECT case_id FROM uniq GROUP BY case_id HAVING bool_or(fact_type = 'NOTE') AND bool_or(fact_type = 'MASS_FILE_RENAME')),
      (VALUES ('OWN_01', 'OWN_F1', 'OWN_NOTED', 'files', 'renamed', 0.5::DOUBLE), ('OWN_02', 'OWN_F2', 'OWN_CHAINED', 'files', 'twice', 0.25::DOUBLE))
      c(rule_id, fact_id, fact_type, entity, value, confidence)""",
)
_add(
    "rule_triggers",
    [_NORM, _FACTS, _HITS],
    """SELECT case_id, rule_id, fact_type || ':' || entity AS "trigger", value FROM premises JOIN fired USING (case_id)
      WHERE (position = 0 AND p1) OR (position = 1 AND (p2a OR p2b)) OR (position = 2 AND (p3 OR c3))""",
)
_add(
    "inference_summary",
    [_NORM, _FACTS, _HITS],
    """SELECT case_id, i AS initial_facts_count, u + coalesce(n, 0) AS total_facts_count, coalesce(n, 0) AS derived_facts_count,
      coalesce(r, 0) AS fired_rules_count, CASE WHEN n > 0 THEN 2 ELSE 1 END AS iterations,
      'Forward Chaining completed in ' || CASE WHEN n > 0 THEN 2 ELSE 1 END || ' iteration(s). Fired ' || coalesce(r, 0) ||
      ' rule(s) and derived ' || coalesce(n, 0) || ' new threat fact(s) from ' || i || ' initial evidence fact(s).' AS explanation
      FROM (SELECT case_id, count(*) AS i FROM facts GROUP BY 1) JOIN (SELECT case_id, count(*) AS u FROM uniq GROUP BY 1) USING (case_id)
      LEFT JOIN (SELECT case_id, count(*) AS n FROM derived GROUP BY 1) USING (case_id)
      LEFT JOIN (SELECT case_id, count(*) AS r FROM fired GROUP BY 1) USING (case_id)""",
)

# ---- reports --------------------------------------------------------------------------------------

_SCORED = """scored AS (SELECT case_id, node_type, node_label,
    CASE WHEN t LIKE '%malware%' OR t LIKE '%exploit%' OR l LIKE '%ransomware%' THEN 'critical'
         WHEN t LIKE '%user%' OR t LIKE '%cmd%' OR l LIKE '%admin%' OR l LIKE '%privilege%' THEN 'high'
         WHEN t LIKE '%file%' OR t LIKE '%process%' OR l LIKE '%scan%' THEN 'medium' ELSE 'low' END AS severity,
    CASE WHEN l LIKE '%lateral%' THEN 'Lateral Movement' WHEN l LIKE '%privilege%' OR l LIKE '%escalat%' THEN 'Privilege Escalation'
         WHEN l LIKE '%exfil%' THEN 'Data Exfiltration' WHEN t LIKE '%malware%' THEN 'Malware Execution'
         WHEN t LIKE '%user%' OR t LIKE '%credential%' THEN 'Unauthorized Access'
         WHEN t LIKE '%process%' OR t LIKE '%cmd%' THEN 'Process Execution'
         WHEN t LIKE '%host%' OR t LIKE '%server%' THEN 'Host Compromise' ELSE 'Unknown Activity' END AS category
    FROM (SELECT *, lower(node_type) AS t, lower(node_label) AS l FROM nodes))"""
_add("risk_nodes", [*_GRAPH[:4], _SCORED], "SELECT * FROM scored")
_add(
    "risk_score",
    [*_GRAPH[:4], _SCORED, _RESULTS],
    """SELECT case_id, s AS risk_score, CASE WHEN s >= 75 THEN 'critical' WHEN s >= 50 THEN 'high' WHEN s >= 25 THEN 'medium' ELSE 'low' END
      AS risk_level, coalesce(v, CASE WHEN s > 0 THEN round(100.0::DOUBLE - s * 0.3::DOUBLE, 1) ELSE 0.0::DOUBLE END) AS plausibility
      FROM (SELECT case_id, CAST(least(100, sum(CASE severity WHEN 'critical' THEN 25 WHEN 'high' THEN 15 WHEN 'medium' THEN 8 ELSE 3 END))
        AS BIGINT) AS s FROM scored GROUP BY 1)
      LEFT JOIN (SELECT case_id, max(validation_score) AS v FROM results GROUP BY 1) USING (case_id)""",
)
_add(
    "risk_highlights",
    [*_GRAPH[:4], _SCORED],
    """SELECT case_id, kind, value, position FROM (
      SELECT *, row_number() OVER (PARTITION BY case_id, kind ORDER BY value) AS position FROM (
        SELECT DISTINCT case_id, 'threat' AS kind, upper(replace(category, ' ', '_')) AS value FROM scored WHERE category <> 'Unknown Activity'
        UNION ALL SELECT DISTINCT case_id, 'account', node_label FROM scored WHERE lower(node_type) LIKE '%user%'
        UNION ALL SELECT DISTINCT case_id, 'host', node_label FROM scored WHERE lower(node_type) LIKE '%host%' OR lower(node_type) LIKE '%server%'))
      WHERE position <= CASE kind WHEN 'threat' THEN 4 ELSE 3 END""",
)

_TIME_TEXT = """strftime(e."timestamp", '%Y-%m-%d %H:%M:%S') ||
    CASE WHEN date_trunc('second', e."timestamp") = e."timestamp" THEN '' ELSE '.' || strftime(e."timestamp", '%f') END || '+00:00'"""
_RANKED = """ranked AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY evs."timestamp" NULLS FIRST, event_uid) AS n FROM evs)"""
_add(
    "case_context",
    [*_GRAPH[:4], _EVIDENCE, _CASES, _RANKED],
    f"""SELECT * FROM (
      WITH entities50 AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY node_type, node_label) AS n FROM nodes),
        body AS (
        SELECT case_id, 1 AS section, u.p AS position, u.line FROM cases, LATERAL (VALUES
          (1, 'Case ID: #' || case_id), (2, 'Title: ' || title), (3, 'Description: ' || description), (4, 'Priority: ' || priority),
          (5, 'Status: ' || status)) u(p, line)
        UNION ALL SELECT case_id, 2, row_number() OVER (PARTITION BY case_id ORDER BY evidence_id), '- File: upload/evidence ' || evidence_id || ' (Type: ' || file_type ||
          ', Size: ' || size || ' bytes, Parsed: ' || CASE WHEN is_parsed THEN 'True' ELSE 'False' END || ')' FROM evidence WHERE NOT is_deleted
        UNION ALL SELECT case_id, 3, n, '- Entity [' || node_type || ']: ' || node_label FROM entities50 WHERE n <= 50
        UNION ALL SELECT case_id, 4, n, '[' || {_TIME_TEXT} || '] [' || severity || '] ' || event_type || ' | User: ' || coalesce("user", 'None') ||
          ' | Host: ' || host || ' | ' || description FROM ranked e WHERE n <= 200
        UNION ALL SELECT case_id, 4, 1, '(No parsed events recorded yet in timeline)' FROM cases WHERE case_id NOT IN (SELECT case_id FROM evs))
      SELECT case_id, section, CAST(position AS BIGINT) AS position, line FROM body WHERE case_id IN (SELECT case_id FROM cases)
      UNION ALL SELECT DISTINCT case_id, section, CAST(0 AS BIGINT), '=== ' || CASE section WHEN 1 THEN 'CASE METADATA' WHEN 2 THEN 'UPLOADED EVIDENCE'
        WHEN 3 THEN 'KNOWLEDGE GRAPH ENTITIES' ELSE 'EVIDENCE TIMELINE' END || ' ===' FROM body WHERE case_id IN (SELECT case_id FROM cases))""",
)
_add(
    "investigation_prompt",
    [_EV, _RULES, _ALERTS, _CASES, _RANKED],
    f"""SELECT case_id, section, CAST(position AS BIGINT) AS position, line FROM (
      SELECT case_id, 1 AS section, 1 AS position, '=== CASE INVESTIGATION: ' || title || ' ===' AS line FROM cases
      UNION ALL SELECT case_id, 1, 2, '--- ALERTS ---' FROM cases
      UNION ALL SELECT case_id, 2, row_number() OVER (PARTITION BY case_id ORDER BY rule_name), '[' || upper(severity) || '] ' || title || ' — Rule: ' || rule_name
        FROM alerts
      UNION ALL SELECT case_id, 3, 0, '--- CHRONOLOGICAL TIMELINE ---' FROM cases
      UNION ALL SELECT case_id, 3, n, '[' || {_TIME_TEXT} || '] ' || event_type || ' | User: ' || coalesce("user", 'N/A') || ' | Host: ' || host ||
        ' | IP: ' || coalesce(ip_address, 'N/A') || ' | ' || description FROM ranked e WHERE n <= 150)""",
)
