import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from emberlog import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def lines(spark):
    """Lines of one file as the parsers take them."""
    def make(texts, log_file="app.log"):
        rows = [(log_file, i, t) for i, t in enumerate(texts, 1)]
        return spark.createDataFrame(rows, "log_file string, line_number bigint, raw_line string")
    return make
