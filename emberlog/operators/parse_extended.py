"""Lines to entries: Windows events, IIS, PostgreSQL, MySQL, firewalls, containers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions import fixed_values as fixed
from emberlog.functions.regex import ANY_CASE, EXACT, drop_nulls, fields_of, filled, matches, rewrite
from emberlog.functions.staging import once
from emberlog.functions.stamps import leading_stamp, stamp_value
from emberlog.schema import ENTRIES

# family -> layouts in the order tried: tag, pattern, number of groups, flags
_LAYOUTS = {
    "windows": [("windows", fixed.WINDOWS_EVENT_LINE, 7, ANY_CASE)],
    "iis": [("iis", fixed.IIS_FULL_LINE, 15, EXACT), ("iis_short", fixed.IIS_SHORT_LINE, 6, EXACT)],
    "postgresql": [("pg", fixed.POSTGRES_LINE, 7, EXACT), ("pg_short", fixed.POSTGRES_SHORT_LINE, 3, EXACT)],
    "mysql": [("mysql_error", fixed.MYSQL_ERROR_LINE, 6, EXACT), ("mysql_query", fixed.MYSQL_QUERY_LINE, 4, EXACT)],
    "firewall": [("ufw", fixed.UFW_LINE, 5, EXACT), ("iptables", fixed.IPTABLES_LINE, 8, EXACT),
                 ("win_fw", fixed.WINDOWS_FIREWALL_LINE, 8, EXACT)],
    "docker": [("compose", fixed.COMPOSE_LINE, 3, EXACT)],
}
FAMILIES = tuple(_LAYOUTS)
_LOG_TYPE = {
    "windows": "WINDOWS_EVENT", "iis": "IIS", "iis_short": "IIS", "pg": "POSTGRESQL", "pg_short": "POSTGRESQL",
    "mysql_error": "MYSQL_ERROR", "mysql_query": "MYSQL_QUERY", "ufw": "FIREWALL_UFW",
    "iptables": "FIREWALL_IPTABLES", "win_fw": "FIREWALL_WINDOWS", "docker": "DOCKER", "compose": "DOCKER_COMPOSE",
}
# Tags whose line is refused when its date is impossible.
_DATED = ["iis", "iis_short", "pg", "pg_short", "mysql_error", "mysql_query", "win_fw"]


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def _windows_time(date: Column, clock: Column) -> Column:
    """Month first with AM/PM, then month first and day first on a 24-hour clock."""
    a, b, year = (F.get(F.split(date, "/"), F.lit(i)) for i in range(3))
    two = lambda c: F.lpad(c, 2, "0")
    at = lambda month, day, time: F.concat(year, F.lit("-"), two(month), F.lit("-"), two(day), F.lit(" "), time)
    hour = F.regexp_extract(clock, r"^(\d{1,2}):", 1).try_cast("int")
    rest = F.regexp_extract(clock, r"^\d{1,2}:(\d{2}:\d{2})", 1)
    afternoon = F.when(F.lower(clock).endswith("pm"), 12).otherwise(0)
    half_day = F.when(hour.between(1, 12), F.concat(two((hour % 12 + afternoon).cast("string")), F.lit(":"), rest))
    full_day = F.concat(two(F.split_part(clock, F.lit(":"), F.lit(1))), F.lit(":"), rest)
    has_half = matches(clock, r"^\d{1,2}:\d{2}:\d{2}\s+(AM|PM)$")
    plain = clock.rlike(r"^\d{1,2}:\d{2}:\d{2}$")
    value = lambda text: text.try_cast("timestamp_ntz")
    return (F.when(has_half, value(at(a, b, half_day)))
            .when(plain, F.coalesce(value(at(a, b, full_day)), value(at(b, a, full_day)))))


_ENTRY_TYPES = {n: ENTRIES[n].dataType for n in (
    "source_ip", "user", "action", "status", "message", "target", "severity", "extra", "status_code",
    "user_agent", "pid")}


def _entry(log_type: str, **values) -> Column:
    """The columns one layout fills; the others are null."""
    filled_in = [
        (F.lit(values[name]) if isinstance(values.get(name), str) else values.get(name, F.lit(None))).cast(kind).alias(name)
        for name, kind in _ENTRY_TYPES.items()
    ]
    return F.struct(F.lit(log_type).alias("log_type"), *filled_in)


def _layout_entries(field, value) -> dict[str, Column]:
    """One entry per tag, written from the fields its pattern captured."""
    event_no, level = field(6).try_cast("int"), F.col("_level")
    names = {n: v[0] for n, v in fixed.SECURITY_EVENTS.items()}
    severities = {n: v[1] for n, v in fixed.SECURITY_EVENTS.items()}
    ports = lambda a, b, c, d: F.concat(a, F.lit(":"), b, F.lit(" -> "), c, F.lit(":"), d)
    # an absent port prints as None in the message
    port = lambda i: F.when(field(i) == "", "None").otherwise(field(i))
    of_status = lambda code: F.when(code >= 500, "ERROR").when(code >= 400, "WARNING").otherwise("INFO")
    looked_up = lambda table, key: F.coalesce(F.element_at(_map(table), key), F.lit("INFO"))
    pg_severity = F.when(F.size("_risky") > 0, "WARNING").otherwise(looked_up(fixed.POSTGRES_SEVERITY, level))
    suspicious = filled(F.array_join("_risky", ","))
    full, short = field(13).try_cast("int"), field(7).try_cast("int")
    blocked = F.upper(field(4))
    return {
        "windows": _entry(
            "WINDOWS_EVENT", action=F.coalesce(F.element_at(_map(names), event_no), field(8)), status=field(4),
            message=field(8), severity=looked_up(severities, event_no),
            extra=_fields(event_id=field(6), source=field(5), category=filled(field(7)))),
        "iis": _entry(
            "IIS", source_ip=field(10), user=field(9), action=field(5), status=full.cast("string"),
            message=F.concat_ws(" ", field(5), field(6)), target=field(6), severity=of_status(full),
            extra=_fields(query=field(7), user_agent=field(11), time_taken=field(16)),
            status_code=full, user_agent=field(11)),
        "iis_short": _entry(
            "IIS", source_ip=field(4), user="-", action=field(5), status=short.cast("string"),
            message=F.concat_ws(" ", field(5), field(6)), target=field(6), severity=of_status(short),
            status_code=short),
        "pg": _entry(
            "POSTGRESQL", user=field(5), status=level, message=field(8), severity=pg_severity,
            extra=_fields(pid=field(4), database=field(6), suspicious=suspicious), pid=field(4)),
        "pg_short": _entry(
            "POSTGRESQL", status=level, message=field(4), severity=pg_severity, extra=_fields(suspicious=suspicious)),
        "mysql_error": _entry(
            "MYSQL_ERROR", status=level, message=field(7), severity=looked_up(fixed.MYSQL_SEVERITY, level),
            extra=_fields(thread_id=field(3), error_code=filled(field(5)), subsystem=filled(field(6)))),
        "mysql_query": _entry(
            "MYSQL_QUERY", action=field(4), message=field(5), severity="INFO", extra=_fields(thread_id=field(3))),
        "ufw": _entry(
            "FIREWALL_UFW", source_ip=field(4), action=field(2), target=field(5),
            message=F.concat(field(2), F.lit(" "), field(6), F.lit(" from "), field(4), F.lit(" to "), field(5)),
            severity=F.when(field(2) == "BLOCK", "WARNING").otherwise("INFO"),
            extra=_fields(protocol=field(6), interface=field(3))),
        "iptables": _entry(
            "FIREWALL_IPTABLES", source_ip=field(5), action="LOG", target=field(6), severity="WARNING",
            message=F.concat(field(7), F.lit(" "), ports(field(5), port(8), field(6), port(9))),
            extra=_fields(protocol=field(7), src_port=filled(field(8)), dst_port=filled(field(9)),
                          in_interface=field(2), out_interface=field(3))),
        "win_fw": _entry(
            "FIREWALL_WINDOWS", source_ip=field(6), action=blocked, target=field(7),
            message=F.concat(blocked, F.lit(" "), field(5), F.lit(" "), ports(field(6), field(8), field(7), field(9))),
            severity=F.when(blocked.isin("DROP", "DENY"), "WARNING").otherwise("INFO"),
            extra=_fields(protocol=field(5), src_port=field(8), dst_port=field(9))),
        "docker": _entry(
            "DOCKER", message=F.coalesce(value("log"), value("message"), F.lit("")),
            severity=F.upper(F.coalesce(value("level"), F.lit("INFO"))),
            extra=_fields(stream=value("stream"), container=value("container_name"), attrs=value("attrs"))),
        "compose": _entry("DOCKER_COMPOSE", message=field(4), severity="INFO", extra=_fields(container=field(2))),
    }


def parse_extended(lines: DataFrame, *, default_year: int, families: tuple[str, ...] = FAMILIES) -> DataFrame:
    """First family that takes the line; lines no family takes get a null log_type.

    Firewall lines written through syslog take the time the line starts with.
    """
    raw = F.col("raw_line")
    marked = raw
    for family in FAMILIES:
        if family not in families:
            continue
        for tag, pattern, groups, flags in _LAYOUTS[family]:
            changed = rewrite(marked, tag, pattern, range(1, groups + 1), flags)
            marked = F.when(raw.startswith("#"), marked).otherwise(changed) if family == "iis" else changed
    if "docker" in families:
        doc = F.when(matches(raw, fixed.JSON_LINE, EXACT), F.try_parse_json(raw))
    else:
        doc = F.lit(None).cast("variant")
    field = lambda i: F.get(F.col("_f"), F.lit(i))
    value = lambda key: F.try_variant_get(F.col("_doc"), f"$.{key}", "string")
    k = F.col("_k")

    staged = once(lines, _f=fields_of(marked), _doc=doc)
    staged = staged.withColumn(
        "_k", F.when(F.size("_f") > 1, field(1)).when(F.col("_doc").isNotNull(), "docker"))
    stamp = (
        F.when(k.isin("iis", "iis_short", "win_fw"), F.concat_ws(" ", field(2), field(3)))
        .when(k == "compose", field(3))
        .when(k == "docker", value("time"))
        .when(k.isin("ufw", "iptables"), raw)
        .when(k != "windows", field(2))
    )
    pg_text = F.when(k == "pg", field(8)).when(k == "pg_short", field(4))
    staged = staged.withColumns({
        "_stamp": leading_stamp(stamp),
        "_risky": drop_nulls(F.array(*[
            F.when(matches(pg_text, p), F.lit(name)) for name, p in fixed.POSTGRES_RISKY.items()])),
        "_level": F.when(k == "pg", F.upper(field(7))).when(k == "pg_short", F.upper(field(3)))
                   .when(k == "mysql_error", F.initcap(field(4))),
    })
    staged = once(staged, ts=F.when(k == "windows", _windows_time(field(2), field(3))).otherwise(
        stamp_value(F.col("_stamp"), default_year)))
    entry = F.when(k.isin(_DATED) & F.col("ts").isNull(), F.lit(None))
    wanted = {"docker"} if "docker" in families else set()
    wanted |= {tag for f in families for tag, *_ in _LAYOUTS[f]}
    for tag, columns in _layout_entries(field, value).items():
        if tag in wanted:
            entry = entry.when(k == tag, columns)
    kept = [c for c in lines.columns if c not in ENTRIES.names]
    staged = once(staged, _e=entry)
    known = {"log_file", "line_number", "raw_line", "ts"}
    return staged.select(*[
        F.col(n) if n in known and n in staged.columns
        else F.col(f"_e.{n}").alias(n) if n == "log_type" or n in _ENTRY_TYPES
        else F.lit(None).cast(ENTRIES[n].dataType).alias(n)
        for n in ENTRIES.names], *kept)


def parse_further(entries: DataFrame, *, default_year: int) -> DataFrame:
    """Entries of the core parser with the further formats in place of ``GENERIC`` where one takes the line.

    Lines with a core layout keep it, also where a further format would fit as well.
    """
    core = [F.col(n).alias(f"_core_{n}") for n in ENTRIES.names]
    others = [c for c in entries.columns if c not in ENTRIES.names]
    open_lines = F.when(F.col("log_type") == "GENERIC", F.col("raw_line"))
    again = parse_extended(entries.select("log_file", "line_number", open_lines.alias("raw_line"), *core, *others), default_year=default_year)
    named = F.col("log_type").isNotNull()
    return again.select(*[F.when(named, F.col(n)).otherwise(F.col(f"_core_{n}")).alias(n) for n in ENTRIES.names], *others)


def _fields(**values: Column) -> Column:
    return F.create_map(*[c for name, value in values.items() for c in (F.lit(name), value.cast("string"))])


def detect_format(entries: DataFrame) -> DataFrame:
    """Adds ``format``: the family that took the line."""
    family = {_LOG_TYPE[tag]: name for name, tags in _LAYOUTS.items() for tag, *_ in tags}
    family["DOCKER"] = "docker"
    return entries.withColumn("format", F.when(
        F.col("log_type").isNotNull(), F.element_at(_map(family), F.col("log_type"))))


def _only(family: str):
    def parse(lines: DataFrame, *, default_year: int) -> DataFrame:
        return parse_extended(lines, default_year=default_year, families=(family,)).filter("log_type is not null")
    parse.__doc__ = f"Lines of the {family} family only."
    return parse


parse_windows_event = _only("windows")
parse_iis = _only("iis")
parse_postgresql = _only("postgresql")
parse_mysql = _only("mysql")
parse_firewall = _only("firewall")
parse_container = _only("docker")


def extended_stats(entries: DataFrame) -> DataFrame:
    """Total and parsed lines, and lines by type."""
    keys = F.array(
        F.struct(F.lit("lines").alias("kind"), F.lit("total").alias("name")),
        F.struct(F.lit("lines").alias("kind"), F.when(F.col("log_type").isNotNull(), "parsed").alias("name")),
        F.struct(F.lit("log_type").alias("kind"), F.col("log_type").alias("name")),
    )
    return (entries.select(F.explode(keys).alias("key")).filter("key.name is not null")
            .groupBy(F.col("key.kind").alias("kind"), F.col("key.name").alias("name"))
            .agg(F.count(F.lit(1)).alias("lines")))
