"""DuckDB texts of the building blocks that the registered queries are checked with."""

from __future__ import annotations

from emberlog.functions import fixed_values as fixed
from emberlog.plans import corpus

YEAR = 2024
INGEST = "2024-02-01 00:00:00"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def fold(text: str) -> str:
    """Accented letters as an ASCII word character, since RE2's word boundary only knows ASCII."""
    return f"regexp_replace({text}, '[À-ÖØ-öø-ɏ]', '_', 'g')"


def has(text: str, pattern: str, flags: str = "(?i)") -> str:
    return f"regexp_matches({text}, {lit(flags + pattern)})"


def has_any(text: str, patterns: list[str]) -> str:
    return has(text, "|".join(f"(?:{p})" for p in patterns))


def group(text: str, pattern: str, n: int = 0, flags: str = "") -> str:
    return f"regexp_extract({text}, {lit(flags + pattern)}, {n})"


def fields(text: str, pattern: str, names: list[str], flags: str = "") -> str:
    return f"regexp_extract({text}, {lit(flags + pattern)}, [{', '.join(lit(n) for n in names)}])"


def tags(text: str, table: dict[str, list[str]]) -> str:
    return "concat_ws(',', " + ", ".join(
        f"CASE WHEN {has_any(text, p)} THEN {lit(n)} END" for n, p in table.items()) + ")"


def case(key: str, table: dict, default: str) -> str:
    shown = lambda v: lit(v) if isinstance(v, str) else str(v)
    return f"CASE {key} " + " ".join(f"WHEN {shown(k)} THEN {shown(v)}" for k, v in table.items()) + f" ELSE {default} END"


def stamp_at_start(text: str) -> str:
    pattern = "^(?:" + "|".join(f"(?:{p})" for p in fixed.TIME_LAYOUTS.values()) + ")"
    return f"regexp_replace({group(f'''trim({text}, '[]')''', pattern)}, '\\s+', ' ', 'g')"


def stamp_anywhere(text: str) -> str:
    found = ", ".join(f"nullif({group(text, p)}, '')" for p in fixed.TIME_LAYOUTS.values())
    return f"regexp_replace(coalesce({found}), '\\s+', ' ', 'g')"


def stamp_value(s: str) -> str:
    month = lambda name: f"lpad(CAST((strpos({lit(fixed.MONTHS)}, {name}) + 2) // 3 AS STRING), 2, '0')"
    part = lambda a, n: f"substr({s}, {a}, {n})"
    clock = f"right({s}, 8)"
    return f"""TRY_CAST(CASE
 WHEN regexp_matches({s}, '^[A-Z]') THEN CASE WHEN NOT regexp_matches({s}, '^Feb 0?29 ') THEN
  concat('{YEAR}-', {month(part(1, 3))}, '-', lpad(split_part({s}, ' ', 2), 2, '0'), ' ', {clock}) END
 WHEN {part(3, 1)} = '/' THEN concat({part(8, 4)}, '-', {month(part(4, 3))}, '-', {part(1, 2)}, ' ', {clock})
 WHEN {part(3, 1)} = '-' THEN concat({part(7, 4)}, '-', {part(4, 2)}, '-', {part(1, 2)}, ' ', {clock})
 WHEN {s} <> '' THEN concat({part(1, 4)}, '-', {part(6, 2)}, '-', {part(9, 2)}, ' ', {clock}) END AS TIMESTAMP)"""


def clock(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%d %H:%M:%S')"


def _auth_case(column: str) -> str:
    """CASE over the message patterns in their order."""
    branches = []
    for name, (pattern, user, address) in fixed.AUTH_MESSAGES.items():
        value = {"name": lit(name), "user": group("message", pattern, user) if user else "''",
                 "ip": group("message", pattern, address) if address else "''"}[column]
        branches.append(f"WHEN {has('message', pattern, '')} THEN {value}")
    return "CASE " + " ".join(branches) + " END"


def parsed(lines: str, formats: tuple[str, ...] = ("json", "access", "error", "syslog")) -> str:
    """Entries of a query that gives log_file, line_number, raw_line."""
    web = ["ip", "ident", "usr", "stamp", "method", "url", "protocol", "status", "size", "referer", "agent"]
    err = ["stamp", "module", "level", "pid", "ip", "msg"]
    sysl = ["stamp", "host", "proc", "pid", "msg"]
    on = lambda name, pattern: has("raw_line", pattern, "") if name in formats else "false"
    doc = "CASE WHEN starts_with(raw_line, '{') AND json_valid(raw_line) THEN raw_line END" if "json" in formats else "CAST(NULL AS STRING)"
    kind = lambda key: f"""json_type(doc, '$."{key}"')"""
    text = lambda key: f"""json_extract_string(doc, '$."{key}"')"""
    first = lambda keys, last="NULL": "CASE " + " ".join(
        f"WHEN {kind(k)} IS NOT NULL THEN {text(k)}" for k in keys) + f" ELSE {last} END"
    shown = lambda k: f"CASE {kind(k)} WHEN 'NULL' THEN 'None' WHEN 'BOOLEAN' THEN concat(upper({text(k)}[1]), {text(k)}[2:]) ELSE {text(k)} END"
    status = f"CASE WHEN {kind('status')} IS NOT NULL THEN {shown('status')} WHEN {kind('level')} IS NOT NULL THEN {shown('level')} WHEN doc IS NOT NULL THEN '' END"
    json_time = stamp_at_start(first(["timestamp", "@timestamp", "time"]))
    return f"""
SELECT log_file, line_number, raw_line, log_type, {stamp_value('stamp')} AS ts, source_ip, usr, action, status, message,
 target, url, method, protocol, size, referer, user_agent, status_code, hostname, process, pid, {tags(fold('looked_at'), fixed.INDICATORS)} AS indicators
FROM (
SELECT *,
 CASE k WHEN 'access' THEN concat_ws(' ', w.url, user_agent, raw_line) ELSE message END AS looked_at
FROM (
SELECT *,
 CASE WHEN k = 'json' THEN 'JSON' WHEN k = 'access' THEN 'WEB_ACCESS' WHEN k = 'error' THEN 'WEB_ERROR'
  WHEN is_auth THEN 'AUTH' WHEN k = 'syslog' THEN 'SYSLOG' ELSE 'GENERIC' END AS log_type,
 CASE k WHEN 'access' THEN {stamp_at_start('w.stamp')} WHEN 'error' THEN {stamp_at_start('e.stamp')}
  WHEN 'syslog' THEN {stamp_at_start('s.stamp')} WHEN 'json' THEN {json_time}
  ELSE coalesce({stamp_anywhere('raw_line')}, {json_time}) END AS stamp,
 CASE k WHEN 'access' THEN w.ip WHEN 'error' THEN nullif(e.ip, '') WHEN 'syslog' THEN nullif(auth_ip, '')
  WHEN 'json' THEN {first(["ip", "source_ip", "client_ip"])}
  ELSE coalesce(nullif({group('raw_line', fixed.DOTTED_QUAD, 1)}, ''), {first(["ip", "source_ip", "client_ip"])}) END AS source_ip,
 CASE k WHEN 'access' THEN nullif(w.usr, '-') WHEN 'syslog' THEN nullif(auth_user, '') WHEN 'error' THEN NULL
  ELSE {first(["user", "username"])} END AS usr,
 CASE k WHEN 'access' THEN concat(w.method, ' ', w.url) WHEN 'syslog' THEN auth_name END AS action,
 CASE k WHEN 'access' THEN w.status WHEN 'error' THEN upper(e.level)
  WHEN 'syslog' THEN CASE WHEN regexp_matches(auth_name, 'failed|invalid') THEN 'FAILED'
   WHEN regexp_matches(auth_name, 'accepted|opened') THEN 'SUCCESS' END
  ELSE {status} END AS status,
 CASE WHEN k = 'access' THEN w.url END AS target,
 CASE k WHEN 'access' THEN w.url WHEN 'json' THEN {text('url')} END AS url,
 CASE WHEN k = 'access' THEN w.method END AS method,
 CASE WHEN k = 'access' THEN w.protocol END AS protocol,
 CASE WHEN k = 'access' THEN w.size END AS size,
 CASE WHEN k = 'access' AND w.referer <> '' THEN substr(w.referer, 2, length(w.referer) - 2) END AS referer,
 CASE WHEN k = 'access' AND w.agent <> '' THEN substr(w.agent, 2, length(w.agent) - 2) END AS user_agent,
 CASE WHEN k = 'access' THEN TRY_CAST(w.status AS INT) END AS status_code,
 CASE WHEN k = 'syslog' THEN s.host END AS hostname,
 CASE WHEN k = 'syslog' THEN s.proc END AS process,
 CASE k WHEN 'syslog' THEN nullif(s.pid, '') WHEN 'error' THEN nullif(e.pid, '') END AS pid
FROM (
SELECT *, CASE WHEN is_auth THEN {_auth_case('name')} END AS auth_name,
 CASE WHEN is_auth THEN {_auth_case('user')} END AS auth_user,
 CASE WHEN is_auth THEN {_auth_case('ip')} END AS auth_ip
FROM (
SELECT *,
 k = 'syslog' AND (contains(lower(log_file), 'auth') OR regexp_matches(lower(s.proc), 'sshd|sudo|pam|login')) AS is_auth,
 CASE k WHEN 'json' THEN {first(["message", "msg"], "raw_line")} WHEN 'error' THEN e.msg WHEN 'syslog' THEN s.msg
  ELSE raw_line END AS message
FROM (
SELECT *,
 {fields('raw_line', fixed.WEB_ACCESS_LINE, web)} AS w, {fields('raw_line', fixed.WEB_ERROR_LINE, err)} AS e,
 {fields('raw_line', fixed.SYSLOG_LINE, sysl)} AS s,
 CASE WHEN doc IS NOT NULL AND coalesce({kind('message')}, {kind('msg')}, 'VARCHAR') = 'VARCHAR' THEN 'json'
  WHEN {on('access', fixed.WEB_ACCESS_LINE)} THEN 'access' WHEN {on('error', fixed.WEB_ERROR_LINE)} THEN 'error'
  WHEN {on('syslog', fixed.SYSLOG_LINE)} THEN 'syslog' ELSE 'generic' END AS k
FROM (SELECT *, {doc} AS doc FROM ({lines}) l0) l1) l2) l3) l4) l5) l6"""


ENTRY_COLUMNS = """line_number, log_type, {ts} AS ts, source_ip, usr AS user_name, action, status, message, target,
 indicators, url, method, protocol, size, referer, user_agent, CAST(status_code AS STRING) AS status_code, hostname, process, pid"""


def entry_rows(entries: str, where: str = "true") -> str:
    return f"SELECT log_file, {ENTRY_COLUMNS.format(ts=clock('ts'))} FROM ({entries}) e WHERE {where}"


def extended(lines: str) -> str:
    """Entries of the further formats."""
    F = fixed
    win = ["date", "time", "level", "source", "event_id", "category", "msg"]
    iis = ["date", "time", "s_ip", "method", "stem", "query", "port", "usr", "c_ip", "agent", "referer", "status", "sub", "w32", "taken"]
    iis2 = ["date", "time", "c_ip", "method", "stem", "status"]
    pg = ["stamp", "tz", "pid", "usr", "db", "level", "msg"]
    pg2 = ["stamp", "level", "msg"]
    mye = ["stamp", "thread", "level", "code", "subsystem", "msg"]
    myq = ["stamp", "thread", "command", "argument"]
    ufw = ["action", "iface", "src", "dst", "proto"]
    ipt = ["iface", "oface", "mac", "src", "dst", "proto", "spt", "dpt"]
    wfw = ["date", "time", "action", "proto", "src", "dst", "spt", "dpt"]
    comp = ["container", "stamp", "msg"]
    names = {n: v[0] for n, v in F.SECURITY_EVENTS.items()}
    sevs = {n: v[1] for n, v in F.SECURITY_EVENTS.items()}
    m = lambda p, flags="": has("raw_line", p, flags)
    two = lambda x: f"lpad({x}, 2, '0')"
    d = lambda i: f"split_part(w.date, '/', {i})"
    at = lambda mo, da, t: f"TRY_CAST(concat({d(3)}, '-', {two(d(mo))}, '-', {two(d(da))}, ' ', {t}) AS TIMESTAMP)"
    hour = "TRY_CAST(split_part(w.time, ':', 1) AS INT)"
    rest = "regexp_extract(w.time, '^[0-9]{1,2}:([0-9]{2}:[0-9]{2})', 1)"
    half = f"concat({two(f'''CAST({hour} % 12 + CASE WHEN lower(w.time) LIKE '%pm' THEN 12 ELSE 0 END AS STRING)''')}, ':', {rest})"
    full = f"concat({two('''split_part(w.time, ':', 1)''')}, ':', {rest})"
    win_ts = f"""CASE WHEN regexp_matches(w.time, '(?i)^[0-9]{{1,2}}:[0-9]{{2}}:[0-9]{{2}}\\s+(AM|PM)$')
  THEN CASE WHEN {hour} BETWEEN 1 AND 12 THEN {at(1, 2, half)} END
  WHEN regexp_matches(w.time, '^[0-9]{{1,2}}:[0-9]{{2}}:[0-9]{{2}}$') THEN coalesce({at(1, 2, full)}, {at(2, 1, full)}) END"""
    of_status = lambda s: f"CASE WHEN TRY_CAST({s} AS INT) >= 500 THEN 'ERROR' WHEN TRY_CAST({s} AS INT) >= 400 THEN 'WARNING' ELSE 'INFO' END"
    pg_msg = "CASE k WHEN 'pg' THEN p.msg WHEN 'pg_short' THEN p2.msg END"
    risky = {n: [p] for n, p in F.POSTGRES_RISKY.items()}
    js = lambda key: f"json_extract_string(raw_line, '$.{key}')"
    ev = "TRY_CAST(w.event_id AS INT)"
    cols = {
        "log_type": {"windows": "'WINDOWS_EVENT'", "iis": "'IIS'", "iis_short": "'IIS'", "pg": "'POSTGRESQL'", "pg_short": "'POSTGRESQL'",
                     "mysql_error": "'MYSQL_ERROR'", "mysql_query": "'MYSQL_QUERY'", "ufw": "'FIREWALL_UFW'",
                     "iptables": "'FIREWALL_IPTABLES'", "win_fw": "'FIREWALL_WINDOWS'", "docker": "'DOCKER'", "compose": "'DOCKER_COMPOSE'"},
        "source_ip": {"iis": "i.c_ip", "iis_short": "i2.c_ip", "ufw": "u.src", "iptables": "t.src", "win_fw": "f.src"},
        "usr": {"iis": "i.usr", "iis_short": "'-'", "pg": "p.usr"},
        "action": {"windows": f"coalesce({case(ev, names, 'NULL')}, w.msg)", "iis": "i.method", "iis_short": "i2.method",
                   "mysql_query": "q.command", "ufw": "u.action", "iptables": "'LOG'", "win_fw": "upper(f.action)"},
        "status": {"windows": "w.level", "iis": "i.status", "iis_short": "i2.status", "pg": "upper(p.level)", "pg_short": "upper(p2.level)",
                   "mysql_error": "concat(upper(y.level[1]), lower(y.level[2:]))"},
        "message": {"windows": "w.msg", "iis": "concat(i.method, ' ', i.stem)", "iis_short": "concat(i2.method, ' ', i2.stem)",
                    "pg": "p.msg", "pg_short": "p2.msg", "mysql_error": "y.msg", "mysql_query": "q.argument",
                    "ufw": "concat(u.action, ' ', u.proto, ' from ', u.src, ' to ', u.dst)",
                    "iptables": "concat(t.proto, ' ', t.src, ':', CASE WHEN t.spt = '' THEN 'None' ELSE t.spt END, ' -> ', t.dst, ':', CASE WHEN t.dpt = '' THEN 'None' ELSE t.dpt END)",
                    "win_fw": "concat(upper(f.action), ' ', f.proto, ' ', f.src, ':', f.spt, ' -> ', f.dst, ':', f.dpt)",
                    "docker": f"coalesce({js('log')}, {js('message')}, '')", "compose": "c.msg"},
        "target": {"iis": "i.stem", "iis_short": "i2.stem", "ufw": "u.dst", "iptables": "t.dst", "win_fw": "f.dst"},
        "severity": {"windows": case(ev, sevs, "'INFO'"), "iis": of_status("i.status"), "iis_short": of_status("i2.status"),
                     "pg": f"CASE WHEN risky <> '' THEN 'WARNING' ELSE {case('upper(p.level)', F.POSTGRES_SEVERITY, lit('INFO'))} END",
                     "pg_short": f"CASE WHEN risky <> '' THEN 'WARNING' ELSE {case('upper(p2.level)', F.POSTGRES_SEVERITY, lit('INFO'))} END",
                     "mysql_error": case("concat(upper(y.level[1]), lower(y.level[2:]))", F.MYSQL_SEVERITY, "'INFO'"),
                     "mysql_query": "'INFO'", "ufw": "CASE WHEN u.action = 'BLOCK' THEN 'WARNING' ELSE 'INFO' END",
                     "iptables": "'WARNING'", "win_fw": "CASE WHEN upper(f.action) IN ('DROP', 'DENY') THEN 'WARNING' ELSE 'INFO' END",
                     "docker": f"upper(coalesce({js('level')}, 'INFO'))", "compose": "'INFO'"},
    }
    by_k = lambda table: "CASE k " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items()) + " END"
    picked = ",\n ".join(f"{by_k(v)} AS {n}" for n, v in cols.items())
    stamp = f"""CASE WHEN k IN ('iis') THEN {stamp_at_start("concat(i.date, ' ', i.time)")}
 WHEN k = 'iis_short' THEN {stamp_at_start("concat(i2.date, ' ', i2.time)")} WHEN k = 'win_fw' THEN {stamp_at_start("concat(f.date, ' ', f.time)")}
 WHEN k = 'pg' THEN {stamp_at_start('p.stamp')} WHEN k = 'pg_short' THEN {stamp_at_start('p2.stamp')}
 WHEN k = 'mysql_error' THEN {stamp_at_start('y.stamp')} WHEN k = 'mysql_query' THEN {stamp_at_start('q.stamp')}
 WHEN k = 'compose' THEN {stamp_at_start('c.stamp')} WHEN k = 'docker' THEN {stamp_at_start(js('time'))}
 WHEN k IN ('ufw', 'iptables') THEN {stamp_at_start('raw_line')} END"""
    return f"""SELECT log_file, line_number, raw_line, risky, CASE WHEN k = 'windows' THEN {win_ts} ELSE {stamp_value('stamp')} END AS ts, {picked}
FROM (SELECT *, {stamp} AS stamp, {tags(pg_msg, risky)} AS risky FROM (SELECT *,
 {fields('raw_line', F.WINDOWS_EVENT_LINE, win, '(?i)')} AS w, {fields('raw_line', F.IIS_FULL_LINE, iis)} AS i,
 {fields('raw_line', F.IIS_SHORT_LINE, iis2)} AS i2, {fields('raw_line', F.POSTGRES_LINE, pg)} AS p,
 {fields('raw_line', F.POSTGRES_SHORT_LINE, pg2)} AS p2, {fields('raw_line', F.MYSQL_ERROR_LINE, mye)} AS y,
 {fields('raw_line', F.MYSQL_QUERY_LINE, myq)} AS q, {fields('raw_line', F.UFW_LINE, ufw)} AS u,
 {fields('raw_line', F.IPTABLES_LINE, ipt)} AS t, {fields('raw_line', F.WINDOWS_FIREWALL_LINE, wfw)} AS f,
 {fields('raw_line', F.COMPOSE_LINE, comp)} AS c,
 CASE WHEN {m(F.WINDOWS_EVENT_LINE, '(?i)')} THEN 'windows'
  WHEN NOT starts_with(raw_line, '#') AND {m(F.IIS_FULL_LINE)} THEN 'iis'
  WHEN NOT starts_with(raw_line, '#') AND {m(F.IIS_SHORT_LINE)} THEN 'iis_short'
  WHEN {m(F.POSTGRES_LINE)} THEN 'pg' WHEN {m(F.POSTGRES_SHORT_LINE)} THEN 'pg_short'
  WHEN {m(F.MYSQL_ERROR_LINE)} THEN 'mysql_error' WHEN {m(F.MYSQL_QUERY_LINE)} THEN 'mysql_query'
  WHEN {m(F.UFW_LINE)} THEN 'ufw' WHEN {m(F.IPTABLES_LINE)} THEN 'iptables'
  WHEN {m(F.WINDOWS_FIREWALL_LINE)} THEN 'win_fw'
  WHEN {m(F.JSON_LINE)} AND json_valid(raw_line) THEN 'docker'
  WHEN {m(F.COMPOSE_LINE)} THEN 'compose' END AS k
 FROM ({lines}) l0) l1) l2"""


def extended_rows(entries: str, where: str = "true") -> str:
    return f"""SELECT line_number, log_type, {clock('ts')} AS ts, source_ip, usr AS user_name, action, status, message,
 target, severity FROM ({entries}) e WHERE {where}"""


# --- findings -----------------------------------------------------------------

TYPE_ORDER = {t: i for i, t in enumerate([*fixed.SIGNATURES, "BRUTE_FORCE", "DDOS", "UNAUTHORIZED_ACCESS"])}


def signature_findings(entries: str) -> str:
    """Entries need log_file, line_number, raw_line, url, target, source_ip, ts."""
    text = fold("concat_ws(' ', raw_line, nullif(url, ''))")
    parts = "[" + ", ".join(f"CASE WHEN {has_any(text, p)} THEN {lit(n)} END" for n, p in fixed.SIGNATURES.items()) + "]"
    base = case("type", fixed.BASE_SCORES, "0.5")
    return f"""SELECT log_file, line_number, source_ip, type, {case('type', fixed.SEVERITY_OF_TYPE, lit('MEDIUM'))} AS severity,
 coalesce(nullif(target, ''), url) AS target, concat('Padrão de ', type, ' detetado') AS detail, raw_line AS evidence,
 coalesce(ts, TIMESTAMP '{INGEST}') AS event_ts, CAST(least(1.0, {base} + 0.01) AS DOUBLE) AS score
FROM (SELECT *, unnest({parts}) AS type FROM ({entries}) e0) e1 WHERE type IS NOT NULL"""


def unauthorized_findings(entries: str) -> str:
    return f"""SELECT log_file, line_number, source_ip, 'UNAUTHORIZED_ACCESS' AS type, 'LOW' AS severity, url AS target,
 concat('Acesso não autorizado (HTTP ', status, ')') AS detail, raw_line AS evidence,
 coalesce(ts, TIMESTAMP '{INGEST}') AS event_ts, CAST(0.3 AS DOUBLE) AS score
FROM ({entries}) e0 WHERE log_type IN ('WEB_ACCESS', 'WEB_ERROR') AND status IN ('401', '403')"""


def access_entries() -> str:
    return parsed(corpus.sql_lines("access"), ("access",))


def findings() -> str:
    """Signature and unauthorised findings of the access lines."""
    return f"""SELECT *, {case('type', TYPE_ORDER, '99')} AS place FROM (
 WITH en AS MATERIALIZED ({access_entries()})
 {signature_findings('SELECT * FROM en')} UNION ALL {unauthorized_findings('SELECT * FROM en')}) u"""


ORDER = "log_file, line_number, place"


def reset_fires(rows: str, window_us: int, threshold: int) -> str:
    """Reset-window fires and leftovers; rows have source_ip, t, n (1..) per address.

    A recursive walk over each address: the state is the array of held times.
    """
    young = f"list_filter(w.held, lambda x: r.t - x <= {window_us})"
    return f"""WITH RECURSIVE r AS MATERIALIZED ({rows}),
 w(source_ip, n, t, log_file, line_number, held, fired) AS (
 SELECT source_ip, n, t, log_file, line_number, CASE WHEN {threshold} <= 1 THEN CAST([] AS BIGINT[]) ELSE [t] END, {threshold} <= 1
 FROM r WHERE n = 1
 UNION ALL
 SELECT r.source_ip, r.n, r.t, r.log_file, r.line_number,
  CASE WHEN len({young}) + 1 >= {threshold} THEN CAST([] AS BIGINT[]) ELSE list_append({young}, r.t) END,
  len({young}) + 1 >= {threshold}
 FROM w JOIN r ON r.source_ip = w.source_ip AND r.n = w.n + 1)"""


def reset_part(name: str, rows: str, window_us: int, threshold: int) -> str:
    """``reset_fires`` as parts r_name and w_name of a WITH RECURSIVE."""
    walk = reset_fires(rows, window_us, threshold)
    return walk.replace("WITH RECURSIVE r AS", f"r_{name} AS", 1).replace("w(source_ip", f"w_{name}(source_ip", 1).replace(
        "FROM r WHERE", f"FROM r_{name} r WHERE", 1).replace("FROM w JOIN r ON", f"FROM w_{name} w JOIN r_{name} r ON", 1)
