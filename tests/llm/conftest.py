import random

import pytest

#: Columns that operators use inside, as columns of the input.
CLASHING = "row_file string, row_at int, rank int, code string, n_words int, found int, copies string, copy int, measures int, spans string, spots int, fp string, root int, size string, whole int, kept string"
DDL = f"doc_id bigint, text string, lang string, source string, n_chars bigint, {CLASHING}"


def words(seed: int, n: int) -> str:
    """Prose whose words do not repeat in runs."""
    draw = random.Random(seed)
    return " ".join("".join(draw.choice("abcdefghijklmnop") for _ in range(draw.randrange(2, 9))) for _ in range(n))


@pytest.fixture(scope="session")
def make(spark):
    """Rows (doc_id, text[, lang, source]) as a table with clashing extra columns."""
    def frame(rows):
        full = [(*r, *(("en", "s") if len(r) == 2 else ()), len(r[1] or ""), *[None] * (len(CLASHING.split(",")))) for r in rows]
        return spark.createDataFrame(full, DDL)
    return frame


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, ties, repeated rows, a very long text, characters outside ASCII."""
    shared = words(1, 80)
    return [(1, words(2, 60)), (2, None), (3, ""), (4, " \n\t "), (None, words(3, 40)), (None, None), (5, shared), (5, shared), (5, words(4, 30)),
            (6, words(5, 30) + " " + shared + "\n" + words(6, 30)), (7, "a " * 5000), (8, words(7, 20000)), (9, "x" * 3000), (10, "Été ñandú — ΑΣ 日本語 \U0001f600 " * 9),
            (11, "one"), (12, "The MIT License\n\n\nend"), (13, "token = \"abcdef0123\"")]
