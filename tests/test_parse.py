from datetime import datetime

import pytest
from pyspark.sql import functions as F

from emberlog.functions.stamps import parse_timestamp
from emberlog.operators.parse import parse_logs, parse_stats
from emberlog.operators.parse_extended import detect_format, extended_stats, parse_extended

CORE = [
    ('203.0.113.7 - alice [05/Mar/2024:09:10:11 +0000] "GET /items?id=7 HTTP/1.1" 200 512 "-" "Agent/1.0"',
     dict(log_type="WEB_ACCESS", user="alice", status="200", target="/items?id=7", ts=datetime(2024, 3, 5, 9, 10, 11),
          attack_indicators=[], user_agent="Agent/1.0", referer="-", size="512", method="GET", action="GET /items?id=7")),
    ('203.0.113.7 - - [05/Mar/2024:09:10:12 +0000] "GET /a/../../b HTTP/1.1" 403 0',
     dict(user=None, attack_indicators=["PATH_TRAVERSAL"], status_code=403, user_agent=None, referer=None)),
    ('203.0.113.7 - - [05/Mar/2024:09:10:13 +0000] "GET /q?a=1 or 2=2 HTTP/1.1" 200 9 "" ""',
     dict(url="/q?a=1", protocol="or 2=2 HTTP/1.1", attack_indicators=["SQL_INJECTION"], referer="", user_agent="")),
    ("Mar  5 09:10:11 host1 sshd[77]: Failed password for bob from 198.51.100.9 port 22 ssh2",
     dict(log_type="AUTH", action="failed_password", status="FAILED", user="bob", source_ip="198.51.100.9",
          ts=datetime(2021, 3, 5, 9, 10, 11), hostname="host1", process="sshd", pid="77")),
    ("Mar  5 09:10:12 host1 sshd[78]: Invalid user carl from 198.51.100.9 port 22",
     dict(log_type="AUTH", action="invalid_user", status="FAILED", user="carl")),
    ("Mar  5 09:10:13 host1 cron[9]: job done", dict(log_type="SYSLOG", action=None, user=None, message="job done")),
    ("[Tue Mar 05 09:10:11.000001 2024] [core:error] [pid 7] [client 198.51.100.9:4444] File does not exist",
     dict(log_type="WEB_ERROR", status="ERROR", source_ip="198.51.100.9", ts=None, pid="7", message="File does not exist")),
    ('{"ip":"192.0.2.4","username":"eve","level":"warn","time":"2024-03-05T09:10:11Z","msg":"ok"}',
     dict(log_type="JSON", user="eve", status="warn", message="ok", source_ip="192.0.2.4", ts=datetime(2024, 3, 5, 9, 10, 11))),
    ('{"ip":null,"source_ip":"192.0.2.5","message":"x","status":null}',
     dict(log_type="JSON", source_ip=None, status="None")),
    ('{"ip":"192.0.2.6","message":null}', dict(log_type="GENERIC", source_ip="192.0.2.6")),
    ("{broken", dict(log_type="GENERIC", source_ip=None)),
    ("2024/03/05 09:10:11 worker 192.0.2.8 restarted",
     dict(log_type="GENERIC", source_ip="192.0.2.8", ts=datetime(2024, 3, 5, 9, 10, 11))),
    ("# comment", dict(log_type="GENERIC")),
]


def test_core_formats(lines):
    rows = parse_logs(lines([t for t, _ in CORE]), default_year=2021).orderBy("line_number").collect()
    for row, (text, wanted) in zip(rows, CORE, strict=True):
        for name, value in wanted.items():
            assert row[name] == value, (text, name, row[name])


def test_auth_by_file_name(lines):
    row = parse_logs(lines(["Mar  5 09:10:13 h cron[9]: job done"], "/var/AUTH.log"), default_year=2024).first()
    assert row["log_type"] == "AUTH"
    assert parse_logs(lines(["Mar  5 09:10:13 h cron[9]: x"], "/auth/a.log"), default_year=2024).first()["log_type"] == "SYSLOG"


@pytest.mark.parametrize("text,value", [
    ("[05/Mar/2024:09:10:11 +0000]", datetime(2024, 3, 5, 9, 10, 11)),
    ("2024-03-05 09:10:11,5", datetime(2024, 3, 5, 9, 10, 11)),
    ("2024-03-05T09:10:11Z", datetime(2024, 3, 5, 9, 10, 11)),
    ("05-03-2024 09:10:11", datetime(2024, 3, 5, 9, 10, 11)),
    ("2024/03/05   09:10:11", datetime(2024, 3, 5, 9, 10, 11)),
    ("Mar 5 09:10:11", datetime(2023, 3, 5, 9, 10, 11)),
    ("1900-03-05 09:10:11", datetime(2023, 3, 5, 9, 10, 11)),
    ("Feb 29 09:10:11", None), ("Foo 12 09:10:11", None), ("2024-02-30 09:10:11", None),
    ("2024-03-05 25:10:11", None), ("2024-03-05 23:59:60", None), ("at 2024-03-05 09:10:11", None), ("", None)])
def test_parse_timestamp(spark, text, value):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(parse_timestamp(F.col("t"), 2023)).first()[0] == value


EXTENDED = [
    ("03/05/2024 09:10:11 Error Security 4625 Logon account failed",
     dict(log_type="WINDOWS_EVENT", action="Logon Failure", severity="WARNING", ts=datetime(2024, 3, 5, 9, 10, 11))),
    ("01/29/2024 14:30:45 PM Error Src 4625 Logon x", dict(log_type="WINDOWS_EVENT", ts=None)),
    ("1/29/2024 12:30:45 AM Error Src 99 Cat text", dict(ts=datetime(2024, 1, 29, 0, 30, 45), action="text", severity="INFO")),
    ("25/12/2024 09:10:11 Info Src 1102 x", dict(ts=datetime(2024, 12, 25, 9, 10, 11), severity="CRITICAL")),
    ("2024-03-05 09:10:11 192.0.2.1 GET /x - 443 - 198.51.100.9 UA - 503 0 0 15",
     dict(log_type="IIS", source_ip="198.51.100.9", user="-", severity="ERROR", status="503", target="/x")),
    ("2024-03-05 09:10:11.123 UTC [42] app@shop ERROR:  DROP TABLE x",
     dict(log_type="POSTGRESQL", user="app", severity="WARNING", status="ERROR")),
    ("2024-03-05 09:10:11.123 UTC [42] app@shop PANIC:  out of space", dict(severity="CRITICAL")),
    ("2024-03-05T09:10:11.000001Z 8 [Warning] [MY-1] [Server] slow disk",
     dict(log_type="MYSQL_ERROR", severity="WARNING", message="slow disk")),
    ("2024-03-05T09:10:11.000001Z 8 Query SELECT 1", dict(log_type="MYSQL_QUERY", action="Query", message="SELECT 1")),
    ("[UFW BLOCK] IN=eth0 OUT= SRC=192.0.2.5 DST=192.0.2.6 PROTO=TCP",
     dict(log_type="FIREWALL_UFW", action="BLOCK", severity="WARNING", message="BLOCK TCP from 192.0.2.5 to 192.0.2.6")),
    ("Jan 29 14:30:45 fw kernel: IN=a OUT=b SRC=10.0.0.1 DST=10.0.0.2 LEN=6 PROTO=UDP LEN=9",
     dict(log_type="FIREWALL_IPTABLES", ts=datetime(2024, 1, 29, 14, 30, 45), message="UDP 10.0.0.1:None -> 10.0.0.2:None")),
    ("2024-03-05 09:10:11 drop TCP 10.0.0.1 10.0.0.2 1234 80", dict(log_type="FIREWALL_WINDOWS", action="DROP", severity="WARNING")),
    ('{"log":"up","stream":"stdout","time":"2024-01-29T14:30:45.123456789Z","level":"warn"}',
     dict(log_type="DOCKER", severity="WARN", message="up", ts=datetime(2024, 1, 29, 14, 30, 45))),
    ("web_1 | 2024-03-05T09:10:11.500000Z started", dict(log_type="DOCKER_COMPOSE", severity="INFO", message="started")),
    ("2024-13-05 09:10:11 drop TCP 10.0.0.1 10.0.0.2 1234 80", dict(log_type=None)),
    ("nothing", dict(log_type=None, severity=None)),
]


def test_extended_formats(lines):
    parsed = parse_extended(lines([t for t, _ in EXTENDED]), default_year=2024)
    for row, (text, wanted) in zip(parsed.orderBy("line_number").collect(), EXTENDED, strict=True):
        for name, value in wanted.items():
            assert row[name] == value, (text, name, row[name])
    formats = {r["format"] for r in detect_format(parsed).select("format").distinct().collect()}
    assert formats == {"windows", "iis", "postgresql", "mysql", "firewall", "docker", None}
    stats = {(r["kind"], r["name"]): r["lines"] for r in extended_stats(parsed).collect()}
    assert stats["lines", "total"] == len(EXTENDED) and stats["lines", "parsed"] == len(EXTENDED) - 2


def test_stats(lines):
    stats = {(r["kind"], r["name"]): r["lines"] for r in parse_stats(
        parse_logs(lines([t for t, _ in CORE]), default_year=2024)).collect()}
    assert stats["lines", "total"] == len(CORE) and stats["log_type", "WEB_ACCESS"] == 3
    assert stats["indicator", "PATH_TRAVERSAL"] == 1
