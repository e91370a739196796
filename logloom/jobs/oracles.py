"""SQL for the queries, written from the rules and the tables, not from the Spark code."""

from __future__ import annotations

_ISO = "strftime(ts, '%Y-%m-%dT%H:%M:%S.%f')"
_MS = "left(strftime({0}, '%Y-%m-%dT%H:%M:%S.%f'), 23) || 'Z'"
_CLEAN = "rtrim(regexp_replace({0}, '[\\x00-\\x1F\\x7F\"\\\\]', ' ', 'g'), ' ')"
_E = "SELECT *, 'web0' || (user_id % 5) AS host, 'u' || user_id AS u, '10.0.0.' || user_id AS addr FROM events"

AUTH = f"""
a AS (SELECT event_id AS seq, {_MS.format("ts")} AS timestamp, host AS hostname, 'auth.log' AS source,
  CASE event_type WHEN 'view' THEN 'user_login' WHEN 'click' THEN 'sudo_session_close' WHEN 'purchase' THEN 'sudo' WHEN 'error' THEN 'ssh_fail' ELSE 'auth_raw' END AS event_type,
  CASE event_type WHEN 'view' THEN 'pam_unix' WHEN 'click' THEN 'pam_unix' WHEN 'purchase' THEN 'sudo' WHEN 'error' THEN 'sshd' ELSE '' END AS process,
  CASE event_type WHEN 'view' THEN 'medium' WHEN 'purchase' THEN 'medium' WHEN 'error' THEN 'high' ELSE 'low' END AS severity,
  CASE WHEN event_type IN ('view', 'purchase', 'error') THEN u ELSE '' END AS "user",
  CASE event_type WHEN 'purchase' THEN '/bin/ls ' || u ELSE '' END AS command,
  CASE event_type WHEN 'error' THEN addr ELSE '' END AS ip,
  {_ISO} || 'Z ' || host || ' ' || CASE event_type
    WHEN 'view' THEN 'sudo: pam_unix(sudo:session): session opened for user root(uid=0) by ' || u || '(uid=1000)'
    WHEN 'click' THEN 'sudo: pam_unix(sudo:session): session closed for user root'
    WHEN 'purchase' THEN 'sudo: ' || u || ' : TTY=pts/0 ; USER=root ; COMMAND=/bin/ls ' || u
    WHEN 'error' THEN 'sshd[7]: Failed password for ' || CASE WHEN user_id % 2 = 0 THEN 'invalid user ' ELSE '' END || u || ' from ' || addr || ' port 22 ssh2'
    ELSE 'sshd[7]: Accepted password for ' || u || ' from ' || addr || ' port 22' END AS raw_log FROM ({_E}))"""

SYSLOG = f"""
s AS (SELECT event_id AS seq, CASE event_type WHEN 'view' THEN {_MS.format("ts - INTERVAL 3 HOUR")} ELSE {_MS.format("ts")} END AS timestamp, host AS hostname, 'syslog' AS source,
  CASE event_type WHEN 'view' THEN 'cron_event' WHEN 'click' THEN 'kernel_event' WHEN 'error' THEN 'syslog_raw' WHEN 'signup' THEN 'user_log' ELSE 'service_event' END AS event_type,
  CASE event_type WHEN 'view' THEN 'CRON' WHEN 'click' THEN 'kernel' WHEN 'error' THEN 'nginx' WHEN 'signup' THEN 'logger' ELSE 'systemd' END AS process,
  CASE event_type WHEN 'view' THEN 'low' WHEN 'click' THEN 'medium' WHEN 'error' THEN 'high' WHEN 'signup' THEN 'low' ELSE 'medium' END AS severity,
  CASE event_type WHEN 'signup' THEN upper(host) ELSE '' END AS "user",
  CASE event_type WHEN 'view' THEN '(root) CMD (job ' || user_id || ')' WHEN 'click' THEN 'usb ' || user_id || ' reset' WHEN 'error' THEN 'Access Denied for "u' || user_id || '"' WHEN 'signup' THEN 'hi ' || user_id ELSE 'unit ' || user_id || ' failed' END AS command,
  '' AS ip,
  {_ISO} || CASE event_type WHEN 'view' THEN '+03:00 ' ELSE 'Z ' END || host || ' ' || CASE event_type
    WHEN 'view' THEN 'CRON[' || event_id || ']: (root) CMD (job ' || user_id || ')' WHEN 'click' THEN 'kernel: usb ' || user_id || ' reset'
    WHEN 'error' THEN 'nginx[9]: Access Denied for  u' || user_id WHEN 'signup' THEN upper(host) || ': hi ' || user_id ELSE 'systemd[1]: unit ' || user_id || ' failed' END AS raw_log FROM ({_E}))"""

SHELL = f"""
b AS (SELECT event_id AS seq, {_MS.format("ts")} AS timestamp, 'web01' AS hostname, 'bash_history' AS source, 'command_history' AS event_type, 'bash' AS process, 'low' AS severity,
  '' AS "user", event_type || chr(9) || (user_id % 2) AS command, '' AS ip, event_type || ' ' || (user_id % 2) AS raw_log FROM events)"""

AUDIT = """
r AS (SELECT event_id AS seq, event_id // 3 AS serial, event_id % 3 AS place, user_id AS u, user_id % 3 = 0 AS bad,
  CASE WHEN (event_id // 3) % 4 = 3 THEN ['USER_LOGIN', 'SYSCALL', 'PROCTITLE'][event_id % 3 + 1]
    WHEN (event_id // 3) % 2 = 0 THEN ['AVC', 'SYSCALL', 'PROCTITLE'][event_id % 3 + 1] ELSE ['SYSCALL', 'PROCTITLE', 'AVC'][event_id % 3 + 1] END AS kind FROM events),
l AS (SELECT *, 'web0' || (serial % 5) AS hostname,
  strftime(to_timestamp(1700000000 + serial) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S') || '.' || lpad(CAST(serial % 1000 AS VARCHAR), 3, '0') || 'Z' AS timestamp,
  'type=' || kind || ' msg=audit(' || (1700000000 + serial) || '.' || lpad(CAST(serial % 1000 AS VARCHAR), 3, '0') || ':' || serial || '): ' || CASE kind
    WHEN 'AVC' THEN 'apparmor= DENIED  comm= c' || u || ' '
    WHEN 'SYSCALL' THEN 'success=' || CASE WHEN bad THEN 'no exit=-13' ELSE 'yes exit=0' END || ' auid=' || u || ' uid=0 comm= s' || u || '  exe= /bin/e' || u || ' '
    WHEN 'PROCTITLE' THEN 'proctitle=''cat /x' || u || ''''
    ELSE 'acct= u' || u || '  res=' || CASE WHEN bad THEN 'failed' ELSE 'success' END END AS raw FROM r)"""

#: Groups as lists of the records they join, in order; then the event of a group.
_GROUPED = """
e AS (SELECT serial, part, min(seq) AS seq, any_value(timestamp) AS timestamp, any_value(hostname) AS hostname,
  max(u) FILTER (kind = 'AVC') AS ua, max(u) FILTER (kind = 'SYSCALL') AS us, max(u) FILTER (kind = 'PROCTITLE') AS up,
  bool_or(bad) FILTER (kind = 'SYSCALL') AS bad, bool_or(kind = 'AVC') AND (bool_or(kind = 'SYSCALL') IS NULL OR min(seq) FILTER (kind = 'AVC') < coalesce(min(seq) FILTER (kind = 'SYSCALL'), 1e18)) AS avc_first,
  max(raw) FILTER (kind = 'AVC') AS ra, max(raw) FILTER (kind = 'SYSCALL') AS rs, max(raw) FILTER (kind = 'PROCTITLE') AS rp FROM g GROUP BY serial, part)
SELECT timestamp, hostname, 'auditd' AS source,
  CASE WHEN ua IS NOT NULL OR bad THEN 'DENIED' WHEN us IS NOT NULL THEN 'SYSCALL' ELSE 'AUDIT' END AS event_type,
  CASE WHEN avc_first THEN 'c' || ua WHEN us IS NOT NULL THEN 's' || us ELSE '' END AS process,
  CASE WHEN ua IS NOT NULL OR bad THEN 'high' WHEN us IS NOT NULL THEN 'medium' ELSE 'low' END AS severity,
  coalesce('auid:' || us, '') AS "user", coalesce('/bin/e' || us, 'cat /x' || up, '') AS command, '' AS ip, rtrim(concat_ws(' | ', ra, rs, rp), ' ') AS raw_log, seq
FROM e"""

_SINGLE = """SELECT timestamp, hostname, 'auditd' AS source, 'USER_LOGIN' AS event_type, '' AS process, CASE WHEN bad THEN 'high' ELSE 'medium' END AS severity,
  'u' || u AS "user", '' AS command, '' AS ip, raw AS raw_log, seq FROM l WHERE kind = 'USER_LOGIN'"""

_COMPLETE = "g AS (SELECT *, 0 AS part FROM l WHERE kind <> 'USER_LOGIN')," + _GROUPED
#: The first two records of a serial that can end a group are at places 0 and 1, or 1 and 2 after a login.
_EAGER = "g AS (SELECT *, CASE WHEN serial % 4 = 3 THEN 0 WHEN place = 2 THEN 1 ELSE 0 END AS part FROM l WHERE kind <> 'USER_LOGIN')," + _GROUPED

_FIELDS = 'timestamp, hostname, source, event_type, process, severity, "user", command, ip, raw_log, seq'

#: Greedy limit: each row points to the first of its key at least a window later; accepted rows are those reached from the first.
_LIMIT = """
k AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY ts, seq) AS n FROM {rows}),
p AS MATERIALIZED (SELECT x.seq, y.n AS nxt FROM k x ASOF JOIN k y ON {same} AND x.ts + INTERVAL {window} SECOND <= y.ts),
w AS (SELECT k.* FROM k WHERE n = 1 UNION ALL SELECT y.* FROM w JOIN p ON p.seq = w.seq JOIN k y ON {match} AND y.n = p.nxt)"""


def _limit(rows: str, key: list[str], window: int) -> str:
    return _LIMIT.format(rows=rows, key=", ".join(key), window=window, same=" AND ".join(f"x.{k} = y.{k}" for k in key), match=" AND ".join(f"y.{k} = w.{k}" for k in key))


_ORDERS = """
o AS (SELECT CAST(o_orderkey AS VARCHAR) AS _id, o_custkey AS cust, o_orderstatus AS status, o_orderpriority AS priority, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS day,
  CASE o_custkey % 3 WHEN 0 THEN '+' || o_custkey WHEN 1 THEN ' ' || o_custkey ELSE o_custkey || 'x' END AS mixed FROM orders)"""


def _orders(where: str) -> str:
    return f"WITH {_ORDERS} SELECT _id, mixed FROM o WHERE {where}"


#: Events of W1 with the filter applied: forced ones, and shell history deduplicated, then limited to one in 3 seconds of a key.
_W1 = f"""WITH RECURSIVE {AUTH}, {SYSLOG}, {SHELL}, {AUDIT},
m AS (WITH {_COMPLETE}), one AS ({_SINGLE}),
al AS (SELECT {_FIELDS} FROM a UNION ALL SELECT {_FIELDS} FROM s UNION ALL SELECT {_FIELDS} FROM b UNION ALL SELECT {_FIELDS} FROM m UNION ALL SELECT {_FIELDS} FROM one),
f AS (SELECT *, contains(raw_log, 'DENIED') OR contains(raw_log, 'success=no') OR contains(raw_log, 'Failed password') OR contains(raw_log, 'Invalid user') OR contains(raw_log, 'sudo:') AS forced FROM al WHERE raw_log <> ''),
q AS (SELECT * FROM f WHERE NOT forced AND NOT contains(event_type, 'syslog_raw')),
z AS (SELECT *, lag(command) OVER (PARTITION BY hostname ORDER BY seq) AS prev FROM q WHERE source = 'bash_history'),
y AS (SELECT *, CAST(timestamp AS TIMESTAMP) AS ts FROM (SELECT {_FIELDS} FROM q WHERE source <> 'bash_history' UNION ALL SELECT {_FIELDS} FROM z WHERE prev IS NULL OR prev <> command)),
{{limit}}
SELECT source, event_type, severity, count(*) AS n FROM (SELECT source, event_type, severity FROM f WHERE forced UNION ALL SELECT source, event_type, severity FROM w) GROUP BY ALL"""

#: Keys are so sparse that few rows have another within 3 seconds: only runs of close rows need recursion.
_W1_LIMIT = """
k AS (SELECT *, hash(hostname, source, event_type, process, "user", ip) AS h, row_number() OVER (PARTITION BY hostname, source, event_type, process, "user", ip ORDER BY ts, seq) AS n FROM y),
g AS (SELECT *, ts - lag(ts) OVER (PARTITION BY h ORDER BY n) < INTERVAL 3 SECOND AS near FROM k),
w AS (SELECT * FROM g WHERE near IS NULL OR NOT near UNION ALL
  SELECT v.* FROM w JOIN g v ON v.h = w.h AND v.n > w.n AND v.n <= w.n + 50 AND v.near AND v.ts >= w.ts + INTERVAL 3 SECOND
    AND NOT EXISTS (SELECT 1 FROM g c WHERE c.h = w.h AND c.n > w.n AND c.n < v.n AND (c.ts >= w.ts + INTERVAL 3 SECOND OR NOT c.near)))"""

_BY_STATUS = "SELECT 'db' || o_orderstatus AS database, o_orderkey AS k, CAST(o_custkey AS VARCHAR) AS cust FROM orders"

#: Requests made of events: when each document begins, and the next delete of its user behind that.
_REQUESTS = """
e AS (SELECT event_id AS seq, user_id AS u, event_type AS kind, 'db' || (user_id % 2) AS database FROM events),
i AS (SELECT *, unnest(range(CASE kind WHEN 'view' THEN 2 ELSE 1 END)) AS place FROM e WHERE kind IN ('view', 'signup')),
d AS (SELECT *, row_number() OVER (PARTITION BY database ORDER BY seq, place) AS id, (SELECT min(seq) FROM e WHERE kind = 'purchase' AND e.u = i.u AND e.seq > i.seq) AS gone FROM i)"""

SQL: dict[str, str] = {
    "tail_lines": f"""WITH {AUTH} SELECT timestamp, hostname, event_type, severity, nullif("user", '') AS "user", nullif(ip, '') AS ip, raw_log FROM a WHERE event_type <> 'user_login'""",
    "rolled_order": f"WITH {SHELL} SELECT command, n AS seq FROM (SELECT command, row_number() OVER (ORDER BY seq) - 1 AS n, lag(command) OVER (ORDER BY seq) AS prev FROM b) WHERE prev IS NULL OR prev <> command",
    "rolled_audit": f"""WITH {AUDIT}, m AS (WITH {_EAGER}) SELECT timestamp, source, event_type, process, severity, "user", command, ip, raw_log, seq FROM m""",
    "stream_dedupe": f"WITH {SHELL} SELECT hostname, command, raw_log FROM (SELECT *, lag(command) OVER (ORDER BY seq) AS prev FROM b) WHERE prev IS NULL OR prev <> command",
    "stream_payloads": f"""WITH {AUTH}, n AS (SELECT hostname, timestamp, row_number() OVER (PARTITION BY hostname ORDER BY timestamp, seq) - 1 AS n FROM a)
      SELECT hostname AS agent_id, n // 50 AS batch_no, count(*) AS n, min(timestamp) AS first, max(timestamp) AS last FROM n GROUP BY hostname, n // 50""",
    "stream_to_table": f"""WITH {AUTH} SELECT hostname AS agent_id, event_type, "user", raw_log, (SELECT count(*) FROM a) AS ids, (SELECT count(*) FROM a) AS last_id FROM a WHERE event_type IN ('ssh_fail', 'sudo') AND "user" LIKE 'u1%'""",
    "table_counts": """SELECT 'loaded' AS step, count(*) AS n FROM orders UNION ALL SELECT unnest(['inserted', 'again']), count(*) FROM events UNION ALL SELECT 'removed', count(*) FROM events WHERE event_type IN ('click', 'view')
      UNION ALL SELECT 'all', count(*) FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT 'none', 0 UNION ALL SELECT 'left in dbNew', count(*) FROM events WHERE event_type NOT IN ('click', 'view')
      UNION ALL SELECT 'left in db' || o_orderstatus, count(*) FROM orders WHERE o_orderstatus <> 'O' GROUP BY ALL""",
    "table_lookup": f"""WITH {_ORDERS} SELECT 'db' || status AS database, _id, mixed FROM o WHERE (mixed IN ('+30', '44x', ' 7')) AND cust > 3 UNION ALL SELECT 'db' || status, _id, mixed FROM o WHERE _id = '33'""",
    "request_log": f"""WITH {_REQUESTS},
      n AS (SELECT e.database, e.seq, e.kind, count(d.id) AS n FROM e LEFT JOIN d ON d.database = e.database AND CASE e.kind WHEN 'purchase' THEN d.gone = e.seq WHEN 'view' THEN d.seq = e.seq WHEN 'signup' THEN d.seq = e.seq
        WHEN 'click' THEN d.u = e.u AND d.seq < e.seq AND coalesce(d.gone > e.seq, true) ELSE (d.u < e.u % 3 + 2 OR (d.u = 1 AND d.kind = 'signup')) AND d.seq < e.seq AND coalesce(d.gone > e.seq, true) END GROUP BY ALL)
      SELECT database, seq, 'success' AS status, CASE kind WHEN 'view' THEN 'Batch inserted: ' || n WHEN 'signup' THEN 'Inserted 1 document' WHEN 'purchase' THEN 'Deleted ' || n ELSE 'Fetched ' || n END AS message, n AS count FROM n""",
    "request_log_documents": f"WITH {_REQUESTS} SELECT database, CAST(id AS VARCHAR) AS _id, CAST(seq AS VARCHAR) AS event FROM d WHERE gone IS NULL",
    "load_pretty": f"""WITH {_ORDERS} SELECT 'mydb' AS database, _id, CAST(cust AS VARCHAR) AS cust, 'a }} of {{"' || status || '", [\\' AS note FROM o""",
    "find_pruned": f"""WITH {AUTH} SELECT timestamp, hostname, "user", severity, raw_log FROM a WHERE timestamp > '2024-01-03T12:00:00' AND timestamp < '2024-01-20' AND "user" LIKE 'u1%' AND severity IN ('high', 'medium')""",
    "pipeline_w3": f"""WITH d AS ({_BY_STATUS}), e AS (SELECT event_id, user_id * 10 AS cust, CASE event_type WHEN 'click' THEN 'dbF' ELSE 'dbO' END AS database FROM events),
t AS (SELECT database, k AS i, NULL AS event, CAST(cust AS BIGINT) AS cust FROM d UNION ALL
  SELECT e.database, (SELECT max(k) FROM d WHERE d.database = e.database) + row_number() OVER (PARTITION BY e.database ORDER BY event_id), CAST(event_id AS VARCHAR), cust FROM e)
SELECT database, CAST(i AS VARCHAR) AS _id, event, CAST(cust AS VARCHAR) AS cust FROM t WHERE (database = 'dbO' AND cust <= 400) OR (database = 'dbF' AND cust >= 50) OR database = 'dbP'""",
    "stream_merge_audit": f"""WITH {AUDIT}, m AS (WITH {_EAGER}), one AS ({_SINGLE}), al AS (SELECT {_FIELDS} FROM m UNION ALL SELECT {_FIELDS} FROM one)
SELECT timestamp, hostname, event_type, nullif(process, '') AS process, severity, nullif("user", '') AS "user", nullif(command, '') AS command, raw_log FROM al""",
    "stream_filter": f"""WITH RECURSIVE {AUTH}, q AS (SELECT *, date_trunc('millisecond', CAST(left(timestamp, 23) AS TIMESTAMP)) AS ts FROM a WHERE event_type <> 'ssh_fail'),
{_limit("q", ["hostname", "event_type", "process", '"user"', "ip"], 21600)}, al AS (SELECT {_FIELDS} FROM w UNION ALL SELECT {_FIELDS} FROM a WHERE event_type = 'ssh_fail')
SELECT timestamp, hostname, event_type, nullif(process, '') AS process, severity, nullif("user", '') AS "user", nullif(ip, '') AS ip, raw_log FROM al""",
    "stream_hot_key": f"""WITH RECURSIVE {AUTH}, flagged AS (SELECT *, event_type = 'ssh_fail' AS f FROM a),
      q AS (SELECT seq, timestamp, CASE WHEN f THEN hostname ELSE 'web01' END AS hostname, CASE WHEN f THEN event_type ELSE 'sudo_session_close' END AS event_type, CASE WHEN f THEN "user" ELSE '' END AS "user",
        CASE WHEN f THEN ip ELSE '' END AS ip, date_trunc('millisecond', CAST(left(timestamp, 23) AS TIMESTAMP)) AS ts FROM flagged),
      {_limit("q", ["hostname", "event_type", '"user"', "ip"], 3600)} SELECT timestamp, hostname, event_type, nullif("user", '') AS "user", nullif(ip, '') AS ip FROM w""",
    "read_lines": f"""WITH {AUTH} SELECT timestamp, event_type, "user", ip, command, raw_log FROM a""",
    "payload_files": f"""WITH {SHELL} SELECT 'mydb' AS database, timestamp, command, CAST(NULL AS VARCHAR) AS "user" FROM b""",
    "load_collection": f"WITH {_ORDERS} SELECT 'mydb' AS database, _id, CAST(cust AS VARCHAR) AS cust, mixed FROM o",
    "collection_routing": f"SELECT database, CAST(k AS VARCHAR) AS _id, cust FROM ({_BY_STATUS}) WHERE database = 'dbF'",
    "insert_by_database": f"""WITH d AS ({_BY_STATUS}), e AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'dbNew' WHEN 'click' THEN 'dbF' ELSE 'dbO' END AS database FROM events)
      SELECT database, CAST(k AS VARCHAR) AS _id, NULL AS event, cust FROM d
      UNION ALL SELECT database, CAST(coalesce((SELECT max(k) FROM d WHERE d.database = e.database), 0) + row_number() OVER (PARTITION BY database ORDER BY event_id) AS VARCHAR), CAST(event_id AS VARCHAR), NULL FROM e""",
    "upsert_by_database": f"""WITH d AS ({_BY_STATUS}), c AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'dbF' ELSE 'dbO' END AS database, user_id AS k, 'e' || max(event_id) AS v FROM events GROUP BY 1, 2)
      SELECT coalesce(d.database, c.database) AS database, CAST(coalesce(d.k, c.k) AS VARCHAR) AS _id, coalesce(v, cust) AS cust FROM d FULL JOIN c ON d.database = c.database AND d.k = c.k""",
    "find_eq_operator": _orders("status = 'F' AND cust = 30"),
    "parse_auth": f"WITH {AUTH} SELECT {_FIELDS} FROM a",
    "parse_syslog": f"WITH {SYSLOG} SELECT {_FIELDS} FROM s",
    "parse_shell": f"WITH {SHELL} SELECT {_FIELDS} FROM b",
    "parse_audit_record": f"WITH {AUDIT} {_SINGLE}",
    "merge_audit_complete": f"WITH {AUDIT}, {_COMPLETE}",
    "merge_audit_eager": f"WITH {AUDIT}, {_EAGER}",
    "to_iso_utc": f"""SELECT event_id, CASE event_id % 5 WHEN 0 THEN {_MS.format("ts - INTERVAL 3 HOUR")}
      WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.000Z' WHEN 2 THEN strftime(ts + INTERVAL 30 MINUTE, '%Y-%m-%dT%H:%M:%S') || substr({_ISO}, 20, 2) || '00Z'
      WHEN 3 THEN {_ISO} || '+0300' ELSE strftime(ts, '%Y') || '-13-01T00:00:00Z' END AS iso FROM events""",
    "sanitize_raw": f"SELECT doc_id, {_CLEAN.format('text')} AS clean FROM documents",
    "normalize_events": f"""SELECT event_id, strftime(ts + INTERVAL 1 HOUR, '%Y-%m-%dT%H:%M:%S') || '.000Z' AS timestamp, CASE WHEN event_id % 2 = 0 THEN 'unknown' ELSE 'syslog' END AS source,
      CASE WHEN event_id % 3 = 0 THEN 'raw' ELSE event_type END AS event_type, CASE WHEN event_id % 5 = 0 THEN 'low' ELSE 'high' END AS severity, 'a b c ' || replace(props, '"', ' ') AS raw_log FROM events""",
    "text_fields": f"""WITH {AUDIT} SELECT seq, timestamp AS time, serial, CASE WHEN kind = 'SYSCALL' THEN CAST(u AS VARCHAR) ELSE '' END AS uid,
      CASE kind WHEN 'AVC' THEN 'c' || u WHEN 'SYSCALL' THEN 's' || u ELSE '' END AS comm, CASE kind WHEN 'PROCTITLE' THEN 'cat /x' || u ELSE '' END AS proctitle,
      CAST(1700000000 + serial AS VARCHAR) AS seconds, CASE kind WHEN 'SYSCALL' THEN '"/bin/e' || u || '"' ELSE '' END AS exe, '' AS lead, kind = 'AVC' AS denied, kind = 'SYSCALL' AS has_exit FROM l""",
    "filter_stateless": f"""WITH {AUTH} SELECT {_FIELDS} FROM a WHERE contains(raw_log, 'Accepted password for u1')
      OR (severity <> 'low' AND NOT contains(event_type, 'sudo_session') AND NOT contains(process, 'pam_') AND NOT contains(raw_log, '10.0.0.9 '))""",
    "keep_override": f"WITH {AUTH} SELECT {_FIELDS} FROM a WHERE event_type IN ('ssh_fail', 'sudo')",
    "drop_empty_raw": f"WITH {AUTH} SELECT {_FIELDS} FROM a WHERE seq % 3 <> 0",
    "dedupe_consecutive": f"WITH {SHELL} SELECT {_FIELDS} FROM (SELECT *, lag(command) OVER (ORDER BY seq) AS prev FROM b) WHERE prev IS NULL OR prev <> command",
    "rate_limit": f"""WITH RECURSIVE base AS (SELECT 'h' || (event_id % 4) AS hostname, event_type, event_id AS seq, ts FROM events),
      {_limit("base", ["hostname", "event_type"], 3600)} SELECT hostname, event_type, seq FROM w""",
    "filter_chain": f"""WITH RECURSIVE base AS (SELECT event_type || chr(9) || (user_id % 2) AS command, event_type || ' ' || (user_id % 2) AS raw, event_id AS seq, ts, 1 AS one FROM events),
      rest AS (SELECT *, lag(command) OVER (ORDER BY seq) AS prev FROM base WHERE NOT contains(raw, 'purchase') AND NOT contains(raw, 'signup 1')),
      kept AS (SELECT command, seq, ts, one FROM rest WHERE prev IS NULL OR prev <> command),
      {_limit("kept", ["one"], 7200)} SELECT command, seq FROM w UNION ALL SELECT command, seq FROM base WHERE contains(raw, 'purchase')""",
    "event_docs": f"""WITH {AUTH} SELECT 'agent-01' AS agent_id, timestamp, hostname, source, event_type, severity, raw_log, nullif("user", '') AS "user", nullif(process, '') AS process, nullif(command, '') AS command, nullif(ip, '') AS ip FROM a""",
    "json_lines": f"""WITH {SHELL} SELECT '{{"agent_id":"agent-01","command":"' || replace(command, chr(9), '\\t') || '","severity":"low","raw_log":"' || raw_log || '"}}' AS value FROM b""",
    "insert_payloads": f"""WITH {SHELL}, n AS (SELECT command, row_number() OVER (ORDER BY timestamp, seq) - 1 AS n FROM b)
      SELECT 'agent-01' AS agent_id, n // 7 AS batch_no, count(*) AS n, arg_min(command, n) AS first FROM n GROUP BY n // 7""",
    "read_payloads": f"""WITH {AUTH} SELECT 'mydb' AS database, timestamp, event_type, nullif("user", '') AS "user", nullif(ip, '') AS ip, raw_log FROM a""",
    "parse_documents": "SELECT CAST(event_id AS VARCHAR) AS _id, event_type AS t, CAST(user_id % 7 AS VARCHAR) AS v FROM events WHERE event_id % 4 <> 0",
    "find_all": _orders("true"),
    "find_eq": _orders("cust = 30 AND cust % 3 <> 2"),
    "find_range": _orders("cust > 250"),
    "find_time_range": _orders("day > '1998-06-01T00:00:00Z' AND day < '1999-01-01'"),
    "find_like": _orders("trim(mixed) LIKE '%1_x'"),
    "find_in": _orders("(cust IN (3, 7) AND cust % 3 <> 2) OR mixed = '44x'"),
    "find_in_table": f"WITH {_ORDERS} SELECT _id FROM o WHERE cust IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')",
    "find_or": _orders("status = 'P' OR cust = 33"),
    "find_and": _orders("status = 'F' AND cust < 300"),
    "find_multi_op": _orders("cust > 100 AND cust < 300 AND priority LIKE '%-_IGH'"),
    "find_mixed_order": _orders("CASE WHEN cust % 3 = 2 THEN mixed > '500' ELSE cust > 500 END"),
    "find_count": f"WITH {_ORDERS} SELECT count(*) AS count FROM o WHERE (cust > 100 AND cust < 300) OR (status = 'F' AND priority LIKE '1-%') OR day > '2000-01-01'",
    "get": f"WITH {_ORDERS} SELECT _id, CAST(cust AS VARCHAR) AS cust, CAST(NULL AS VARCHAR) AS none FROM o WHERE _id = '17'",
    "insert_ids": """SELECT CAST(o_orderkey AS VARCHAR) AS _id, NULL AS event, CAST(o_custkey AS VARCHAR) AS cust FROM orders
      UNION ALL SELECT CAST((SELECT max(o_orderkey) FROM orders) + row_number() OVER (ORDER BY event_id) AS VARCHAR), CAST(event_id AS VARCHAR), NULL FROM events""",
    "upsert": """WITH c AS (SELECT user_id * 2 AS i, 'e' || max(event_id) AS v FROM events GROUP BY 1)
      SELECT CAST(coalesce(o_orderkey, i) AS VARCHAR) AS _id, coalesce(v, CAST(o_custkey AS VARCHAR)) AS cust FROM orders FULL JOIN c ON o_orderkey = i""",
    "delete": """SELECT count(*) FILTER (NOT (o_custkey < 500 AND o_orderstatus IN ('F', 'O'))) AS kept, count(*) FILTER (o_custkey < 500 AND o_orderstatus IN ('F', 'O')) AS removed FROM orders""",
    "union_sources": f"""WITH {AUTH}, {SYSLOG}, {SHELL}, {AUDIT}, m AS (WITH {_COMPLETE}), one AS ({_SINGLE}),
      al AS (SELECT source, severity, timestamp FROM a UNION ALL SELECT source, severity, timestamp FROM s UNION ALL SELECT source, severity, timestamp FROM b UNION ALL SELECT source, severity, timestamp FROM m UNION ALL SELECT source, severity, timestamp FROM one)
      SELECT source, severity, count(*) AS n, CAST(sum(CASE severity WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END) AS BIGINT) AS rank_sum, min(timestamp) AS first, max(timestamp) AS last FROM al GROUP BY source, severity""",
    "pipeline_w1": _W1.replace("{limit}", _W1_LIMIT),
}
