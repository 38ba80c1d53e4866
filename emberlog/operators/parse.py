"""Lines to entries: the core formats.

Input of every operator: ``log_file``, ``line_number``, ``raw_line`` (already
stripped, no newline inside). Other input columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions import fixed_values as fixed
from emberlog.functions.literals import MESSAGE_PIECES, any_found_in, case_blind, holds_pieces
from emberlog.functions.regex import EXACT, drop_nulls, fields_of, filled, rewrite, unquoted
from emberlog.functions.staging import once
from emberlog.functions.stamps import leading_stamp, stamp_anywhere, stamp_value
from emberlog.schema import ENTRIES

ACCESS, ERROR, SYSLOG = "WEB_ACCESS", "WEB_ERROR", "SYSLOG"
CORE_FORMATS = ("json", "access", "error", "syslog")


def tag_indicators(lowered: str, *, strict: bool = False) -> Column:
    """Attack categories seen in a text, as an array in the fixed order.

    Takes the name of a column made by ``case_blind``, since every pattern reads it. ``strict`` leaves out the patterns that ordinary traffic
    matches too.
    """
    tests = []
    for category, patterns in fixed.INDICATORS.items():
        kept = [p for p in patterns if not (strict and p in fixed.NOISY_PATTERNS)]
        tests.append(F.when(any_found_in(lowered, kept), F.lit(category)))
    return drop_nulls(F.array(*tests))


def auth_fields(column: str) -> Column:
    """['', pattern name, user, address, command] of a sign-in message."""
    message = F.col(column)
    marked = F.when(F.lit(False), message)
    for name, (pattern, user, address) in fixed.AUTH_MESSAGES.items():
        command = 2 if name == "sudo" else 0
        hit = holds_pieces(column, MESSAGE_PIECES[name]) & message.rlike(EXACT + pattern)
        marked = marked.when(hit, rewrite(message, name, pattern, (user, address, command)))
    return fields_of(marked)


def _auth_status(name: Column) -> Column:
    has = lambda words: name.rlike("|".join(words))
    return F.when(has(fixed.FAILED_WORDS), "FAILED").when(has(fixed.SUCCESS_WORDS), "SUCCESS")


def _json_value(key: str) -> Column:
    return F.try_variant_get(F.col("_doc"), f"$['{key}']", "variant")


def _first_present(keys: list[str], last: Column | None = None) -> Column:
    """Value of the first key the document has, as text, even if it is null."""
    picked = F.when(F.lit(False), F.lit(""))
    for key in keys:
        value = _json_value(key)
        picked = picked.when(value.isNotNull(), F.try_variant_get(F.col("_doc"), f"$['{key}']", "string"))
    return picked if last is None else picked.otherwise(last)


def _status_text(keys: list[str]) -> Column:
    """Like the text form a script would print: None for null, True for true."""
    text = F.lit("")
    for key in reversed(keys):
        value = _json_value(key)
        kind = F.schema_of_variant(value)
        shown = F.try_variant_get(F.col("_doc"), f"$['{key}']", "string")
        text = F.when(value.isNull(), text).when(kind == "VOID", "None").when(
            kind == "BOOLEAN", F.initcap(shown)).otherwise(shown)
    return text


def parse_logs(lines: DataFrame, *, default_year: int, formats: tuple[str, ...] = CORE_FORMATS,
               strict: bool = False) -> DataFrame:
    """First matching format wins: JSON, web access, web error, syslog, else generic.

    ``formats`` restricts the formats tried; a line none of them takes becomes
    GENERIC. JSON with a message that is null or not text is no JSON line, though
    its address, user, status and time stay, as in the original behaviour.
    """
    raw = F.col("raw_line")
    marked = raw
    if "access" in formats:
        marked = rewrite(marked, "access", fixed.WEB_ACCESS_LINE, range(1, 12))
    if "error" in formats:
        marked = rewrite(marked, "error", fixed.WEB_ERROR_LINE, range(1, 7))
    if "syslog" in formats:
        marked = rewrite(marked, "syslog", fixed.SYSLOG_LINE, range(1, 6))
    with_json = "json" in formats
    doc = F.when(raw.startswith("{"), F.try_parse_json(raw)) if with_json else F.lit(None).cast("variant")

    staged = once(lines, _doc=doc, _f=fields_of(marked))
    field = lambda i: F.get(F.col("_f"), F.lit(i))
    if with_json:
        message_kind = F.coalesce(*[F.schema_of_variant(_json_value(k)) for k in ("message", "msg")], F.lit("STRING"))
        is_json = F.col("_doc").isNotNull() & (message_kind == "STRING")
    else:
        is_json = F.lit(False)
    layout = F.when(F.size("_f") > 1, field(1)).otherwise("generic")
    staged = staged.withColumn("_k", F.when(is_json, "json").otherwise(layout))

    k = F.col("_k")
    process = F.lower(field(4))
    is_auth = (k == "syslog") & (
        F.contains(F.lower(F.element_at(F.split("log_file", "/"), -1)), F.lit("auth"))
        | process.rlike("|".join(fixed.AUTH_PROCESSES)))
    message = (
        F.when(k == "json", _first_present(["message", "msg"], raw))
        .when(k == "error", field(7))
        .when(k == "syslog", field(6))
        .otherwise(raw)
    )
    stamp = (
        F.when(k.isin("access"), leading_stamp(field(5)))
        .when(k.isin("error", "syslog"), leading_stamp(field(2)))
        .when(k == "json", leading_stamp(_first_present(["timestamp", "@timestamp", "time"])))
        .otherwise(stamp_anywhere(raw) if not with_json else F.coalesce(
            stamp_anywhere(raw), leading_stamp(_first_present(["timestamp", "@timestamp", "time"]))))
    )
    staged = staged.withColumns({"_auth": F.coalesce(is_auth, F.lit(False)), "message": message, "_stamp": stamp})
    signed = F.when(F.col("_auth"), auth_fields("message")) if "syslog" in formats else F.lit(None).cast("array<string>")
    kept = [c for c in staged.columns if c != "ts"]
    staged = once(staged.select(*kept), _a=signed, ts=stamp_value(F.col("_stamp"), default_year))

    auth = lambda i: F.when(F.size("_a") > 1, filled(F.get(F.col("_a"), F.lit(i))))
    access = lambda c: F.when(k == "access", c)
    json_ip = _first_present(["ip", "source_ip", "client_ip"])
    json_user = _first_present(["user", "username"])
    json_status = F.when(F.col("_doc").isNotNull(), _status_text(["status", "level"]))
    agent = access(unquoted(field(12)))
    url = access(field(7))
    if with_json:
        url = F.when(k == "json", F.try_variant_get(F.col("_doc"), "$['url']", "string")).otherwise(url)
    looked_at = F.when(k == "access", F.concat_ws(" ", field(7), agent, raw)).otherwise(F.col("message"))
    status = (
        F.when(k == "access", field(9)).when(k == "error", F.upper(field(4)))
        .when(k == "syslog", _auth_status(auth(1)))
    )
    extra = (
        F.when(k == "access", F.create_map(*_pairs(
            method=field(6), url=field(7), protocol=field(8), size=field(10), referer=unquoted(field(11)),
            user_agent=unquoted(field(12)), status_code=field(9))))
        .when(k == "error", F.create_map(*_pairs(level=field(4), module=filled(field(3)), pid=filled(field(5)))))
        .when(k == "syslog", F.create_map(*_pairs(
            hostname=field(3), process=field(4), pid=filled(field(5)), auth_pattern=auth(1), command=auth(4))))
    )
    if with_json:
        extra = F.when(k == "json", F.try_variant_get(F.col("_doc"), "$", "map<string,string>")).otherwise(extra)
        status = F.when(k.isin("json", "generic"), json_status).otherwise(status)
    generic_ip = filled(F.regexp_extract(raw, fixed.DOTTED_QUAD, 1))
    source_ip = (
        F.when(k == "access", field(2)).when(k == "error", filled(field(6)))
        .when(k == "syslog", auth(3))
        .when(k == "generic", F.coalesce(generic_ip, json_ip) if with_json else generic_ip)
    )
    user = F.when(k == "access", F.nullif(field(4), F.lit("-"))).when(k == "syslog", auth(2))
    if with_json:
        source_ip = F.when(k == "json", json_ip).otherwise(source_ip)
        user = F.when(k.isin("json", "generic"), json_user).otherwise(user)

    staged = staged.withColumn("_low", case_blind(looked_at))
    out = staged.withColumns({
        "log_type": F.when(k == "json", "JSON").when(k == "access", ACCESS).when(k == "error", ERROR)
                     .when(F.col("_auth"), "AUTH").when(k == "syslog", SYSLOG).otherwise("GENERIC"),
        "source_ip": source_ip,
        "user": user,
        "action": F.when(k == "access", F.concat_ws(" ", field(6), field(7))).when(k == "syslog", auth(1)),
        "status": status,
        "target": access(field(7)),
        "severity": F.lit(None).cast("string"),
        "attack_indicators": tag_indicators("_low", strict=strict),
        "extra": extra,
        "url": url,
        "method": access(field(6)),
        "protocol": access(field(8)),
        "size": access(field(10)),
        "referer": access(unquoted(field(11))),
        "user_agent": agent,
        "status_code": access(field(9).try_cast("int")),
        "hostname": F.when(k == "syslog", field(3)),
        "process": F.when(k == "syslog", field(4)),
        "pid": F.when(k.isin("error", "syslog"), filled(field(5))),
    })
    kept = [c for c in lines.columns if c not in ENTRIES.names]
    return out.select(*ENTRIES.names, *kept)


def _pairs(**fields: Column) -> list[Column]:
    return [c for name, value in fields.items() for c in (F.lit(name), value.cast("string"))]


def parse_json_line(lines: DataFrame, *, default_year: int) -> DataFrame:
    return parse_logs(lines, default_year=default_year, formats=("json",)).filter("log_type = 'JSON'")


def parse_web_access(lines: DataFrame, *, default_year: int) -> DataFrame:
    return parse_logs(lines, default_year=default_year, formats=("access",)).filter(F.col("log_type") == ACCESS)


def parse_web_error(lines: DataFrame, *, default_year: int) -> DataFrame:
    return parse_logs(lines, default_year=default_year, formats=("error",)).filter(F.col("log_type") == ERROR)


def parse_syslog(lines: DataFrame, *, default_year: int) -> DataFrame:
    """Syslog and sign-in lines."""
    return parse_logs(lines, default_year=default_year, formats=("syslog",)).filter(
        F.col("log_type").isin(SYSLOG, "AUTH"))


def parse_generic(lines: DataFrame, *, default_year: int) -> DataFrame:
    return parse_logs(lines, default_year=default_year, formats=())


def parse_stats(entries: DataFrame) -> DataFrame:
    """Counts by kind: total, parsed and failed lines, by log type, by indicator."""
    one = F.lit(1)
    keys = F.concat(
        F.array(F.struct(F.lit("lines").alias("kind"), F.lit("total").alias("name")),
                F.struct(F.lit("lines").alias("kind"),
                         F.when(F.col("log_type").isNull(), "failed").otherwise("parsed").alias("name")),
                F.struct(F.lit("log_type").alias("kind"), F.col("log_type").alias("name"))),
        F.transform(F.coalesce("attack_indicators", F.array().cast("array<string>")),
                    lambda i: F.struct(F.lit("indicator").alias("kind"), i.alias("name"))),
    )
    return (
        entries.select(F.explode(keys).alias("key"), one.alias("one"))
        .filter(F.col("key.name").isNotNull())
        .groupBy(F.col("key.kind").alias("kind"), F.col("key.name").alias("name"))
        .agg(F.count("one").alias("lines"))
    )
