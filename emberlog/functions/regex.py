"""Regular-expression helpers built on Catalyst's own functions.

A line never holds a newline, so a newline is a safe mark: a successful match
rewrites the text as ``\\n<tag>\\n<group>\\n<group>...``. Chained rewrites then give
"first layout wins" in one expression, each layout is matched once however many
groups are read, and everything stays inside code generation.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# (?d): only a newline ends a line, so "." also takes \r and U+0085. (?U): \w, \d, \s and \b know all letters, digits and
# blanks, not those of ASCII alone.
EXACT = "(?dU)"
# (?iu): letters match regardless of case, outside ASCII too.
ANY_CASE = "(?iudU)"


def any_of(patterns: Iterable[str], flags: str = ANY_CASE) -> str:
    """One pattern that matches where at least one of ``patterns`` does."""
    return flags + "|".join(f"(?:{p})" for p in patterns)


def matches(text: Column, patterns: Iterable[str] | str, flags: str = ANY_CASE) -> Column:
    return text.rlike(any_of([patterns] if isinstance(patterns, str) else patterns, flags))


def rewrite(text: Column, tag: str, pattern: str, groups: Iterable[int], flags: str = EXACT) -> Column:
    """Turn a matching text into its marked form; leave any other unchanged.

    A group number of 0 stands for an always-empty field.
    """
    anchored = pattern if pattern.startswith("^") else f"^.*?(?:{pattern})"
    fields = "".join("\n" + (f"${g}" if g else "") for g in groups)
    return F.regexp_replace(text, F.lit(f"{flags}{anchored}[\\s\\S]*"), F.lit(f"\n{tag}{fields}"))


def fields_of(marked: Column) -> Column:
    """Split a marked text; index 1 is the tag, the groups start at index 2."""
    return F.split(marked, "\n", -1)


def filled(text: Column) -> Column:
    """Empty text as null: what an optional group leaves when it is absent."""
    return F.nullif(text, F.lit(""))


def unquoted(text: Column) -> Column:
    """A field captured with its quotes; null when it was absent."""
    return F.when(text != "", text.substr(F.lit(2), F.length(text) - 2))


def drop_nulls(values: Column) -> Column:
    """An array of distinct values without its nulls, inside code generation."""
    return F.array_except(values, F.array(F.lit(None).cast("string")))
