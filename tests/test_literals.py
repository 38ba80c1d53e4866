import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from emberlog.functions import fixed_values as fixed
from emberlog.functions.literals import ATTACK_PIECES, MESSAGE_PIECES, any_found_in, case_blind, found_in
from pyspark.sql import functions as F

PATTERNS = [p for table in (fixed.INDICATORS, fixed.SIGNATURES) for ps in table.values() for p in ps] + fixed.SENSITIVE_PATTERNS
BITS = ["union", " select ", "from", "where", "'", '"', " or ", "and", "1", "=", "<script", ">", "drop", " table", "(", ")", "$(",
        "/etc/", "passwd", "..", "/", "\\", "%2e", "&", ";", "-", "?", ".php", "://", "file", "on", "load", "<!doctype", "[",
        "é", "ſ", " ", "x", "curl", "admin", "@", "a.b.cc", "1234", "password", ":", "include", "\n", "\u00a0", "sh", "c:", "windows", "/db", ".zip", "api_key", "system"]
texts = st.lists(st.sampled_from(BITS), max_size=12).map("".join)


def test_every_fixed_pattern_is_listed_and_every_entry_is_used():
    """One pattern, sixteen digits, has no piece."""
    assert {p.lower() for p in PATTERNS} - set(ATTACK_PIECES) == {r"\b\d{4}[- ]?\d{4}[- ]?\d{4}[- ]?\d{4}\b"}
    assert set(ATTACK_PIECES) <= {p.lower() for p in PATTERNS} and set(MESSAGE_PIECES) == set(fixed.AUTH_MESSAGES)


@settings(max_examples=600, deadline=None)
@given(texts)
def test_pieces_are_necessary(text):
    """A text that lacks a needed piece never matches; fixed texts match exactly."""
    for pattern, known in ATTACK_PIECES.items():
        match = re.search(pattern, text) is not None
        if known.texts:
            assert match == any(t in text for t in known.texts), (pattern, text)
        elif match:
            assert all(any(p in text for p in group) for group in known.pieces), (pattern, text)


@pytest.mark.parametrize("name", list(MESSAGE_PIECES))
def test_message_pieces_are_in_the_patterns(name):
    pattern = re.sub(r"\(\?:[^)]*\)\?", "", fixed.AUTH_MESSAGES[name][0])
    assert all(piece in pattern for group in MESSAGE_PIECES[name].pieces for piece in group)


SAMPLES = ["' OR '1'='1", "UNION all SELECT x", "<ScRiPt>", "..%2F", "x; y", "a > b", "/WP-Admin", "file=../x.php?a=b.txt", "<!ENTITY x", "nothing to see", "admin'--",
           "ſelect from where", "cafénc", "nc -l", "1 or 2=2", "eval (x", "p|q", "' or été=1", "'\u00a0or\u2003x = 1", "1\u3000=\u00a01", "drop\u00a0table", "\u0661 or \u0662=\u0663",
           "<img src=x onÉté =", "' and ١=", "éunion select", "c:/Windows", "/db.zip", "api-KEY:"]


def test_found_in_equals_python(spark):
    low = spark.createDataFrame([(s,) for s in SAMPLES], "t string").select("t", case_blind(F.col("t")).alias("low"))
    for table in (fixed.INDICATORS, fixed.SIGNATURES, {"SENSITIVE": fixed.SENSITIVE_PATTERNS}):
        got = low.select("t", *[any_found_in("low", ps).alias(name) for name, ps in table.items()]).collect()
        for row in got:
            for name, patterns in table.items():
                assert row[name] == any(re.search(p, row["t"], re.I) for p in patterns), (row["t"], name)


def test_own_patterns_are_taken_as_they_are(spark):
    own = [r"\S+@corp\b", r"^\W+$", r"\D{5}\d", r"Key\s+is", r"(?:a|b)\B."]
    rows = spark.createDataFrame([(s,) for s in ["me@corp", "!!! ??", "abcde7", "KEY\u00a0IS", "été", "x", "bax", "@corporate"]], "t string").select("t", case_blind(F.col("t")).alias("low"))
    for row in rows.select("t", *[found_in("low", p).alias(str(i)) for i, p in enumerate(own)]).collect():
        for i, pattern in enumerate(own):
            assert row[str(i)] == bool(re.search(pattern, row["t"], re.I)), (row["t"], pattern)
