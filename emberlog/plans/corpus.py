"""Log lines made from the given tables, one line per row of a table.

The tables hold no raw log, so the registered queries first write each event as
a log line. The expressions are plain SQL that Spark and DuckDB both read; only
the few tokens of ``DIALECTS`` differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.session import spread

DIALECTS = {
    "spark": {
        "$clf$": "date_format(ts, 'dd/MMM/yyyy:HH:mm:ss')",
        "$iso$": "date_format(ts, 'yyyy-MM-dd HH:mm:ss')",
        "$day$": "date_format(ts, 'yyyy-MM-dd')",
        "$clock$": "date_format(ts, 'HH:mm:ss')",
        "$sys$": "concat(date_format(ts, 'MMM '), lpad(CAST(day(ts) AS STRING), 2, ' '), date_format(ts, ' HH:mm:ss'))",
        "$slash$": "date_format(ts, 'yyyy/MM/dd HH:mm:ss')",
        "$dmy$": "date_format(ts, 'dd-MM-yyyy HH:mm:ss')",
        "$mdy$": "date_format(ts, 'MM/dd/yyyy')",
        "$half$": "date_format(ts, 'hh:mm:ss a')",
        "$div$": "div",
    },
    "duckdb": {
        "$clf$": "strftime(ts, '%d/%b/%Y:%H:%M:%S')",
        "$iso$": "strftime(ts, '%Y-%m-%d %H:%M:%S')",
        "$day$": "strftime(ts, '%Y-%m-%d')",
        "$clock$": "strftime(ts, '%H:%M:%S')",
        "$sys$": "concat(strftime(ts, '%b '), lpad(CAST(day(ts) AS STRING), 2, ' '), strftime(ts, ' %H:%M:%S'))",
        "$slash$": "strftime(ts, '%Y/%m/%d %H:%M:%S')",
        "$dmy$": "strftime(ts, '%d-%m-%Y %H:%M:%S')",
        "$mdy$": "strftime(ts, '%m/%d/%Y')",
        "$half$": "strftime(ts, '%I:%M:%S %p')",
        "$div$": "//",
    },
}

EVENT_COLUMNS = {
    "event_id": "event_id",
    "ts": "ts",
    "user_id": "user_id",
    "event_type": "event_type",
    "k": "CAST(regexp_extract(props, '[0-9]+', 0) AS INT)",
    "ip": "concat('10.0.', CAST(user_id $div$ 256 AS STRING), '.', CAST(user_id % 256 AS STRING))",
    "uname": "concat('u', CAST(user_id AS STRING))",
}

_QUOTE = "chr(39)"

ACCESS = f"""concat(ip, ' - ', CASE WHEN user_id % 3 = 0 THEN '-' ELSE uname END, ' [', $clf$, ' +0000] "',
 CASE WHEN event_type = 'purchase' THEN 'POST' ELSE 'GET' END, ' ',
 CASE k % 25
  WHEN 0 THEN concat('/search?q=1', {_QUOTE}, 'or', {_QUOTE}, '1', {_QUOTE}, '=', {_QUOTE}, '1')
  WHEN 1 THEN '/list?q=1+union+all+select+pw+from+users'
  WHEN 2 THEN '/page?c=<script>alert(1)</script>'
  WHEN 3 THEN '/go?u=javascript:void(0)'
  WHEN 4 THEN '/static/../../etc/passwd'
  WHEN 5 THEN '/run?cmd=ls;id'
  WHEN 6 THEN '/run?cmd=$(id)'
  WHEN 7 THEN '/.git/config'
  WHEN 8 THEN '/wp-login.php'
  WHEN 9 THEN '/view?f=php://input'
  WHEN 10 THEN '/view?file=report.txt'
  WHEN 11 THEN '/feed?x=<!DOCTYPE[a'
  WHEN 12 THEN concat('/api/v1/orders?id=', CAST(k AS STRING))
  WHEN 13 THEN '/login?password=hunter2'
  WHEN 14 THEN '/mail?to=user@example.com'
  WHEN 15 THEN '/q?a=1 or 2=2'
  WHEN 16 THEN concat('/v2/items/', CAST(user_id AS STRING))
  ELSE concat('/items/', CAST(k AS STRING), '?ref=', CAST(event_id AS STRING), '&p=1') END,
 ' HTTP/1.1" ',
 CASE event_type WHEN 'error' THEN '401' WHEN 'signup' THEN '403' WHEN 'purchase' THEN '500' ELSE '200' END, ' ',
 CASE WHEN k % 7 = 0 THEN '-' ELSE CAST(k * 13 AS STRING) END,
 CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN ' "-"'
  WHEN 2 THEN ' "http://ref.example/" "Mozilla/5.0 (X11; Linux x86_64)"'
  WHEN 3 THEN ' "" "Agent/1.0"' ELSE ' "-" "sqlmap/1.7"' END)"""

ERROR = """concat('[', CASE WHEN event_id % 3 = 0 THEN $iso$ ELSE concat('Tue Mar 05 ', $clock$, '.000001 2024') END, '] [',
 CASE WHEN k % 4 = 0 THEN '' ELSE 'core:' END, CASE k % 3 WHEN 0 THEN 'error' WHEN 1 THEN 'warn' ELSE 'notice' END, '] ',
 CASE WHEN event_id % 2 = 0 THEN concat('[pid ', CAST(user_id AS STRING), ':tid ', CAST(k AS STRING), '] ') ELSE '' END,
 CASE WHEN event_id % 5 <> 0 THEN concat('[client ', ip, ':', CAST(1000 + k AS STRING), '] ') ELSE '' END,
 CASE k % 6 WHEN 0 THEN 'File does not exist: /var/www/a' WHEN 1 THEN 'script ../../etc/passwd not found'
  WHEN 2 THEN 'PHP Warning: include(x.php)' WHEN 3 THEN 'client denied <script>'
  WHEN 4 THEN 'select leak from t where 1' ELSE 'AH00094: ok' END)"""

AUTH = """concat($sys$, ' host', CAST(user_id % 4 AS STRING), ' ',
 CASE k % 12
  WHEN 4 THEN concat('sshd[', CAST(k AS STRING), ']: Failed password for invalid user ', uname, ' from ', ip, ' port 22 ssh2')
  WHEN 5 THEN concat('sshd[', CAST(k AS STRING), ']: Invalid user ', uname, ' from ', ip, ' port 22')
  WHEN 6 THEN concat('sshd[', CAST(k AS STRING), ']: Accepted password for ', uname, ' from ', ip, ' port 22 ssh2')
  WHEN 7 THEN concat('sshd[', CAST(k AS STRING), ']: Accepted publickey for ', uname, ' from ', ip, ' port 22 ssh2')
  WHEN 8 THEN concat('sudo: ', uname, ' : TTY=pts/0 ; PWD=/home ; USER=root ; COMMAND=/bin/ls -l')
  WHEN 9 THEN concat('sshd[', CAST(k AS STRING), ']: Connection closed by authenticating user ', uname, ' ', ip, ' port 22')
  WHEN 10 THEN concat('sshd[', CAST(k AS STRING), ']: pam_unix(sshd:session): session opened for user ', uname, ' by (uid=0)')
  WHEN 11 THEN concat('cron[', CAST(k AS STRING), ']: session closed for user ', uname)
  ELSE concat('sshd[', CAST(k AS STRING), ']: Failed password for ', uname, ' from ', ip, ' port 22 ssh2') END)"""

JSON = """CASE k % 8
 WHEN 0 THEN concat('{"ip":"', ip, '","username":"', uname, '","level":"warn","time":"', $day$, 'T', $clock$, 'Z","msg":"login ok"}')
 WHEN 1 THEN concat('{"source_ip":"', ip, '","user":"', uname, '","status":', CAST(200 + k AS STRING), ',"timestamp":"', $iso$, '","message":"GET /a?x=<script>"}')
 WHEN 2 THEN concat('{broken ', ip)
 WHEN 3 THEN concat('{"client_ip":"', ip, '","message":null,"status":"bad"}')
 WHEN 4 THEN concat('{"ip":"', ip, '","@timestamp":"', $slash$, '","msg":"../../etc/passwd","url":"/b?id=1"}')
 WHEN 5 THEN concat('{"ip":null,"source_ip":"', ip, '","message":"null address","status":null}')
 WHEN 6 THEN concat('{"ip":"', ip, '","message":17}')
 ELSE concat('{"ip":"', ip, '","user":"', uname, '","status":true,"message":"union select 1"}') END"""

GENERIC = """CASE k % 6
 WHEN 0 THEN concat($slash$, ' worker ', ip, ' restarted')
 WHEN 1 THEN concat('note ', $dmy$, ' job ', CAST(k AS STRING), ' done')
 WHEN 2 THEN concat('at ', $clf$, ' peer ', ip, ' said <iframe src=x>')
 WHEN 3 THEN concat('plain text without any stamp ', CAST(event_id AS STRING))
 WHEN 4 THEN concat('# comment ', $iso$, ' from ', ip)
 ELSE concat('Foo 12 ', $clock$, ' bad month ', ip) END"""

MIXED = f"""CASE event_id % 10 WHEN 0 THEN {ACCESS} WHEN 1 THEN {ACCESS} WHEN 2 THEN {ERROR} WHEN 3 THEN {ERROR}
 WHEN 4 THEN {AUTH} WHEN 5 THEN {AUTH} WHEN 6 THEN {JSON} WHEN 7 THEN {JSON} ELSE {GENERIC} END"""

EXTENDED = """CASE event_id % 14
 WHEN 0 THEN concat($mdy$, ' ', $clock$, ' Error Security ', CASE k % 4 WHEN 0 THEN '4625' WHEN 1 THEN '4624' WHEN 2 THEN '1102' ELSE '9999' END, ' Logon account ', uname)
 WHEN 1 THEN concat($mdy$, ' ', $half$, ' Warning Microsoft-Windows 4720 Admin user made')
 WHEN 2 THEN concat($day$, ' ', $clock$, ' 192.0.2.1 GET /x', CAST(k AS STRING), ' q=1 443 - ', ip, ' UA - ', CAST(200 + 100 * (k % 4) AS STRING), ' 0 0 15')
 WHEN 3 THEN concat($day$, ' ', $clock$, ' ', ip, ' POST /y extra words ', CAST(200 + 100 * (k % 4) AS STRING), ' 12')
 WHEN 4 THEN concat($iso$, '.123 UTC [', CAST(k AS STRING), '] ', uname, '@shop ', CASE k % 3 WHEN 0 THEN 'ERROR' WHEN 1 THEN 'LOG' ELSE 'PANIC' END, ':  ',
   CASE k % 5 WHEN 0 THEN 'DROP TABLE x' WHEN 1 THEN 'DELETE FROM t' WHEN 2 THEN 'select pg_shadow' WHEN 3 THEN 'delete from t where a' ELSE 'COPY t TO PROGRAM x' END)
 WHEN 5 THEN concat($iso$, ' ', CASE k % 3 WHEN 0 THEN 'FATAL' WHEN 1 THEN 'LOG' ELSE 'DEBUG1' END, ':  ready')
 WHEN 6 THEN concat($day$, 'T', $clock$, '.000001Z 8 [', CASE k % 3 WHEN 0 THEN 'Warning' WHEN 1 THEN 'ERROR' ELSE 'note' END, '] [MY-', CAST(k AS STRING), '] [Server] slow disk')
 WHEN 7 THEN concat($day$, 'T', $clock$, '.000001Z ', CAST(k AS STRING), ' Query SELECT ', CAST(event_id AS STRING))
 WHEN 8 THEN concat($sys$, ' fw kernel: [UFW ', CASE k % 3 WHEN 0 THEN 'BLOCK' WHEN 1 THEN 'ALLOW' ELSE 'AUDIT' END, '] IN=eth0 OUT= MAC=aa SRC=', ip, ' DST=192.0.2.6 LEN=40 PROTO=TCP SPT=1')
 WHEN 9 THEN concat($sys$, ' fw kernel: IN=eth0 OUT=eth1 SRC=', ip, ' DST=192.0.2.6 LEN=60 PROTO=UDP ', CASE WHEN k % 2 = 0 THEN 'SPT=53 DPT=99 ' ELSE '' END, 'LEN=9')
 WHEN 10 THEN concat($day$, ' ', $clock$, ' ', CASE k % 3 WHEN 0 THEN 'drop' WHEN 1 THEN 'ALLOW' ELSE 'Deny' END, ' TCP ', ip, ' 192.0.2.9 1234 80')
 WHEN 11 THEN concat('{"log":"started ', CAST(k AS STRING), '","stream":"stdout","container_name":"', uname, '","time":"', $day$, 'T', $clock$, '.123456789Z"',
   CASE WHEN k % 2 = 0 THEN ',"level":"error"' ELSE '' END, '}')
 WHEN 12 THEN concat('web_', CAST(user_id AS STRING), ' | ', $day$, 'T', $clock$, '.500000Z started ', CAST(k AS STRING))
 ELSE concat('nothing known here ', CAST(event_id AS STRING)) END"""

CORPORA = {"access": ACCESS, "error": ERROR, "auth": AUTH, "json": JSON, "generic": GENERIC, "mixed": MIXED,
           "extended": EXTENDED}


def written(expression: str, dialect: str) -> str:
    for token, text in DIALECTS[dialect].items():
        expression = expression.replace(token, text)
    return expression


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows are parsed, which is the costly part."""
    return spread(table(spark, sf_dir, name))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_table(spark, sf_dir, "events").selectExpr(
        *[f"{written(e, 'spark')} AS {name}" for name, e in EVENT_COLUMNS.items()])


def lines(spark: SparkSession, sf_dir: str, corpus: str) -> DataFrame:
    """One line per event, in the files ``<corpus>.log``."""
    return events(spark, sf_dir).selectExpr(
        f"'{corpus}.log' AS log_file", "event_id + 1 AS line_number",
        f"{written(CORPORA[corpus], 'spark')} AS raw_line")


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of every document; a document is a file."""
    docs = text_table(spark, sf_dir, "documents")
    return docs.select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("log_file"),
        F.posexplode(F.split("text", "\n")).alias("_p", "_t")).select(
        "log_file", (F.col("_p") + 1).cast("bigint").alias("line_number"), F.btrim("_t").alias("raw_line")).filter(
        "raw_line <> ''")


def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each raw page as one entry text with its url."""
    return text_table(spark, sf_dir, "pages").select(
        F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("log_file"),
        F.lit(1).cast("bigint").alias("line_number"), F.col("html").alias("raw_line"), "url")


def conversation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("log_file"),
        F.posexplode(F.split("text", "\n")).alias("_p", "_t"), "turn").select(
        "log_file", (F.col("turn") * 100000 + F.col("_p") + 1).cast("bigint").alias("line_number"),
        F.btrim("_t").alias("raw_line")).filter("raw_line <> ''")


# --- the same, as DuckDB text ------------------------------------------------

def sql_events() -> str:
    columns = ", ".join(f"{written(e, 'duckdb')} AS {name}" for name, e in EVENT_COLUMNS.items())
    return f"SELECT {columns} FROM events"


def sql_lines(corpus: str) -> str:
    """A query that gives log_file, line_number, raw_line."""
    return (f"SELECT '{corpus}.log' AS log_file, event_id + 1 AS line_number, "
            f"{written(CORPORA[corpus], 'duckdb')} AS raw_line FROM ({sql_events()}) ev")


SQL_DOCUMENT_LINES = """SELECT * FROM (SELECT concat('doc-', doc_id) AS log_file, CAST(p AS BIGINT) AS line_number,
 trim(t) AS raw_line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t,
 generate_subscripts(string_split(text, chr(10)), 1) AS p FROM documents) u) v WHERE raw_line <> ''"""

SQL_CONVERSATION_LINES = """SELECT * FROM (SELECT concat('conv-', conv_id) AS log_file,
 CAST(turn * 100000 + p AS BIGINT) AS line_number, trim(t) AS raw_line
 FROM (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS t,
 generate_subscripts(string_split(text, chr(10)), 1) AS p FROM conversations) u) v WHERE raw_line <> ''"""

SQL_PAGE_LINES = """SELECT concat('page-', page_id) AS log_file, CAST(1 AS BIGINT) AS line_number,
 html AS raw_line, url FROM pages"""
