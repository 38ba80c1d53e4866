"""Time stamps of log lines. They carry no zone, so the type is TIMESTAMP_NTZ."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberlog.functions.fixed_values import MONTHS, TIME_LAYOUTS
from emberlog.functions.regex import EXACT, filled

_AT_START = EXACT + "^(?:" + "|".join(f"(?:{p})" for p in TIME_LAYOUTS.values()) + ")"


def leading_stamp(text: Column) -> Column:
    """The stamp a text starts with (square brackets around it are ignored)."""
    return _single_blanks(F.regexp_extract(F.btrim(text, F.lit("[]")), _AT_START, 0))


def stamp_anywhere(text: Column) -> Column:
    """The first layout, in the fixed order, that occurs anywhere in the text."""
    found = F.coalesce(*[filled(F.regexp_extract(text, EXACT + layout, 0)) for layout in TIME_LAYOUTS.values()])
    # every layout ends in a clock; most lines without a stamp hold none
    has_clock = F.contains(text, F.lit(":")) & text.rlike(r"\d{2}:\d{2}:\d{2}")
    return _single_blanks(F.when(has_clock, found))


def _single_blanks(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", " ")


def _month_number(name: Column) -> Column:
    return F.lpad(F.floor((F.instr(F.lit(MONTHS), name) + 2) / 3).cast("string"), 2, "0")


def stamp_value(stamp: Column, default_year: int) -> Column:
    """Value of a stamp cut out by the functions above; null when impossible.

    A stamp without year (or with the year 1900) takes ``default_year``. Without
    a year 29 February is no date, as the check is made against 1900.
    """
    part = lambda start, length: stamp.substr(start, length)
    year_now = F.lit(f"{default_year:04d}")

    def written(year: Column, month: Column, day: Column) -> Column:
        return F.concat(F.when(year == "1900", year_now).otherwise(year), F.lit("-"), month, F.lit("-"), day,
                        F.lit(" "), F.right(stamp, F.lit(8)))

    month_first = F.when(~stamp.rlike("^Feb 0?29 "), written(
        year_now, _month_number(part(1, 3)), F.lpad(F.split_part(stamp, F.lit(" "), F.lit(2)), 2, "0")))
    text = (
        F.when(stamp.rlike("^[A-Z]"), month_first)
        .when(part(3, 1) == "/", written(part(8, 4), _month_number(part(4, 3)), part(1, 2)))
        .when(part(3, 1) == "-", written(part(7, 4), part(4, 2), part(1, 2)))
        .when(stamp != "", written(part(1, 4), part(6, 2), part(9, 2)))
    )
    return text.try_cast("timestamp_ntz")


def parse_timestamp(text: Column, default_year: int) -> Column:
    return stamp_value(leading_stamp(text), default_year)


def micros(ts: Column) -> Column:
    """Microseconds since the epoch; the session zone must be UTC."""
    return F.unix_micros(ts.cast("timestamp"))


def clock_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
