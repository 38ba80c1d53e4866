"""Quality rules whose limits come from the corpus: a sketch per language and source.

Only DataFrame functions. Every row is measured once, in place. Five ratios are kept as whole
numbers and put into buckets of their leading seven bits (an HDR histogram). Counts of buckets are
the sketch: sketches merge by adding counts, give the same result in any order and hold a quantile
to within one part in 64. A ratio is out of bounds when it lies more than ``reach`` quartile
distances outside the middle half of its language and source, as for Tukey's fences, with a least
distance per ratio so that a group of equal rows does not reject its first odd one. A group of fewer than
``least_rows`` rows takes the merged sketch of its language, and that failing the one of all rows.

A document fails the fixed base rules with fewer than 20 words or over 30 % of words in repeated
windows of eight; such rows are left out of the sketches.

Nulls: a null text has no words (and fails); null ``lang`` or ``source`` are values like others.
Equal rows get equal results. Empty tables give empty results. Other columns are passed or not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.functions.staging import once
from emberlog.llm.rows import stored

BLANK = r"[\x20\x09-\x0D]+"
WINDOW = 8
REACH = 3
LEAST_ROWS = 200
LEADING_BITS = 7

#: ratio: (value, least quartile distance, whether too low counts as well)
RATIOS = {
    "word_length": (lambda m: _floor(100 * m("word_chars"), m("n_words")), 100, True),
    "symbols": (lambda m: _floor(10_000 * m("n_symbols"), m("word_chars")), 200, False),
    "dup_lines": (lambda m: _floor(1000 * m("n_dup_lines"), m("n_lines")), 200, False),
    "repeats": (lambda m: _floor(1000 * m("n_repeat_words"), m("n_words")), 100, False),
    "echoes": (lambda m: _floor(1000 * m("n_echo_words"), m("n_words")), 100, False),
}


def _floor(a: Column, b: Column) -> Column:
    """a / b in whole numbers, 0 where b is 0."""
    return F.when(b > 0, F.floor((a - a % b) / b)).otherwise(F.lit(0)).cast("bigint")


def measured(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` of ``docs`` and a struct ``measures`` of its ``text``; works within each row."""
    solid = "[^#*$%&|<>]+"
    rows = docs.select(F.struct(*keep).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    rows = once(rows, words=F.filter(F.split("text", BLANK), lambda w: w != ""),
                lines=F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")))
    n = F.size("words")
    windows = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("words", i, WINDOW))))
    rows = once(rows.select("row", "text", "lines", "words"), windows=windows)
    placed = F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = once(rows.select(
        "row", "windows", F.size("words").cast("bigint").alias("n_words"), F.length(F.regexp_replace("text", BLANK, "")).cast("bigint").alias("word_chars"),
        F.length(F.regexp_replace("text", solid, "")).cast("bigint").alias("n_symbols"), F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.size(F.filter("words", lambda w, i: w == F.get("words", i - 1))).cast("bigint").alias("n_echo_words")),
        placed=F.when(F.size(F.array_distinct("windows")) < F.size("windows"), placed))
    same = lambda x, i: F.coalesce(F.get("placed", i)["h"] == x["h"], F.lit(False))
    twice = F.filter(F.transform("placed", lambda x, i: F.when(same(x, i - 1) | same(x, i + 1), x["i"])), lambda p: p.isNotNull())
    rows = once(rows, again=F.array_sort(twice))
    steps = F.transform("again", lambda p, i: F.when(i == 0, F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), p - F.get("again", i - 1))))
    covered = F.coalesce(F.aggregate(steps, F.lit(0).cast("bigint"), lambda total, step: total + step), F.lit(0).cast("bigint"))
    names = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_echo_words")
    return rows.select("row.*", F.struct(*names, covered.alias("n_repeat_words")).alias("measures"))


def base_failed(m: str = "measures") -> Column:
    words = F.col(f"{m}.n_words")
    return (words < 20) | (100 * F.col(f"{m}.n_repeat_words") > 30 * words)


def _value(ratio: str, m: str = "measures") -> Column:
    return RATIOS[ratio][0](lambda name: F.col(f"{m}.{name}"))


def sketch(rows: DataFrame) -> DataFrame:
    """(lang, source, ratio, bucket, n) of rows with lang, source and measures that pass the base rules."""
    each = F.inline(F.array(*[F.struct(F.lit(r).alias("ratio"), _value(r).alias("v")) for r in RATIOS]))
    shift = F.greatest(F.lit(0), F.length(F.bin("v")) - LEADING_BITS)
    return rows.filter(~base_failed()).select("lang", "source", each).withColumn("shift", shift).select(
        "lang", "source", "ratio", F.expr("shiftleft(shiftright(v, shift), shift)").alias("bucket")).groupBy(
        "lang", "source", "ratio", "bucket").agg(F.count(F.lit(1)).alias("n"))


def quartiles(counts: DataFrame, *group: str) -> DataFrame:
    """Sketches merged to ``group``: its columns, ratio, rows, low and high quartile."""
    keys = [*group, "ratio"]
    merged = counts.groupBy(*keys, "bucket").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("n").over(Window.partitionBy(*keys))
    return merged.withColumns({"upto": upto, "total": total}).groupBy(*keys).agg(
        F.max("total").alias("rows"), F.min(F.when(4 * F.col("upto") >= F.col("total"), F.col("bucket"))).alias("q1"),
        F.min(F.when(4 * F.col("upto") >= 3 * F.col("total"), F.col("bucket"))).alias("q3"))


def fences(counts: DataFrame, *, reach: int = REACH, least_rows: int = LEAST_ROWS) -> DataFrame:
    """(lang, source, fences): the bounds of every ratio for each language and source."""
    named = lambda df, p: df.select(*[F.col(c).alias(f"{p}_{c}") for c in df.columns])
    own, tongue, whole = (named(quartiles(counts, *g), p) for g, p in ((("lang", "source"), "a"), (("lang",), "b"), ((), "c")))
    joined = own.join(tongue, own["a_lang"].eqNullSafe(tongue["b_lang"]) & (own["a_ratio"] == tongue["b_ratio"])).join(whole, own["a_ratio"] == whole["c_ratio"])
    pick = lambda c: F.when(F.col("a_rows") >= least_rows, F.col(f"a_{c}")).when(F.col("b_rows") >= least_rows, F.col(f"b_{c}")).otherwise(F.col(f"c_{c}"))
    rows = joined.select(F.col("a_lang").alias("lang"), F.col("a_source").alias("source"), F.col("a_ratio").alias("ratio"), pick("q1").alias("q1"), pick("q3").alias("q3"))
    bounds = []
    for ratio, (_, least, both) in RATIOS.items():
        span = reach * F.greatest(F.col("q3") - F.col("q1"), F.lit(least))
        mine = lambda c: F.max(F.when(F.col("ratio") == ratio, c))  # noqa: B023, E731
        bounds.append(F.struct((mine(F.col("q1") - span) if both else F.lit(None).cast("bigint")).alias("low"), mine(F.col("q3") + span).alias("high")).alias(ratio))
    return rows.groupBy("lang", "source").agg(F.struct(*bounds).alias("fences"))


def judged(rows: DataFrame, *, reach: int = REACH, least_rows: int = LEAST_ROWS) -> DataFrame:
    """Stored rows with lang, source and measures, plus base_failed and kept.

    The fences are written first, so that Spark knows their size when it picks the join.
    """
    limits = stored(fences(sketch(rows), reach=reach, least_rows=least_rows), "fences").withColumnsRenamed({"lang": "of_lang", "source": "of_source"})
    inside = F.lit(True)
    for ratio in RATIOS:
        for side, beyond in (("low", lambda v, f: v < f), ("high", lambda v, f: v > f)):
            inside &= ~F.coalesce(beyond(_value(ratio), F.col(f"fences.{ratio}.{side}")), F.lit(False))
    joined = rows.join(limits, rows["lang"].eqNullSafe(limits["of_lang"]) & rows["source"].eqNullSafe(limits["of_source"]), "left")
    return joined.select(*[rows[c] for c in rows.columns], base_failed().alias("base_failed"), (~base_failed() & inside).alias("kept"))


def rate(docs: DataFrame, *, reach: int = REACH, least_rows: int = LEAST_ROWS) -> DataFrame:
    """doc_id, the measures, base_failed and kept of every row."""
    rows = stored(measured(docs, "doc_id", "lang", "source"), "measures")
    return judged(rows, reach=reach, least_rows=least_rows).select("doc_id", "measures.*", "base_failed", "kept")


def keep_good(docs: DataFrame, *, reach: int = REACH, least_rows: int = LEAST_ROWS) -> DataFrame:
    """The rows of ``docs`` that are kept, with the columns of ``docs``.

    They are written with their measures, so that nothing is measured twice; the fences join them there.
    """
    packed = docs.select(F.struct("*").alias("whole"), "lang", "source", "text")
    rows = stored(measured(packed, "whole", "lang", "source"), "measured")
    return judged(rows, reach=reach, least_rows=least_rows).filter("kept").select("whole.*")
