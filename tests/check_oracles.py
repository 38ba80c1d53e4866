"""Compare the registered queries with DuckDB: python tests/check_oracles.py [sf_dir] [name ...]"""

import glob
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry  # noqa: E402
from emberlog import build_session  # noqa: E402


def normal(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    def cell(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return None
        if isinstance(v, float) and v == int(v):
            return int(v)
        return v.item() if hasattr(v, "item") else v
    return sorted((tuple(cell(v) for v in row) for row in frame.itertuples(index=False)), key=lambda r: tuple((x is None, str(x)) for x in r))


def compare(spark, sf_dir: str, name: str) -> tuple[bool, str]:
    ours = entry.queries()[name](spark, sf_dir).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return True, f"rows only: {len(ours)}"
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    theirs = con.execute(sql).df()
    if sorted(ours.columns) != sorted(theirs.columns):
        return False, f"columns {sorted(ours.columns)} / {sorted(theirs.columns)}"
    a, b = normal(ours), normal(theirs)
    kinds = [(c, str(ours[c].dtype), str(theirs[c].dtype)) for c in sorted(ours.columns) if ours[c].dtype != theirs[c].dtype]
    note = f" types {kinds}" if kinds else ""
    if a == b:
        return True, f"{len(a)} rows{note}"
    gone = [r for r in a if r not in set(b)][:3] if len(a) < 20000 else []
    new = [r for r in b if r not in set(a)][:3] if len(b) < 20000 else []
    return False, f"{len(a)} / {len(b)} rows{note}\n  spark only {gone}\n  duckdb only {new}"


if __name__ == "__main__":
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    names = sys.argv[2:] or list(entry.queries())
    spark = build_session(master="local[8]", **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8",
                                                "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for name in names:
        begin = time.time()
        try:
            good, note = compare(spark, folder, name)
        except Exception as error:  # noqa: BLE001
            good, note = False, f"{type(error).__name__}: {str(error)[:600]}"
        bad += not good
        print(f"{'ok ' if good else 'BAD'} {time.time() - begin:6.1f}s {name}: {note}", flush=True)
    print(f"{len(names) - bad} of {len(names)} good")
