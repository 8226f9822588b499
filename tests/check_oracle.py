"""Run registered queries beside their SQL: python tests/check_oracle.py [sf] [name ...]"""

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402
from labelloom.session import local_session  # noqa: E402


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def rows(frame: pd.DataFrame) -> list[str]:
    columns = sorted(frame.columns)
    return sorted(repr(tuple(map(plain, row))) for row in frame[columns].values.tolist())


def plain(value):
    if value is None or (isinstance(value, float) and value != value):
        return None
    return value.item() if hasattr(value, "item") else value


def compare(spark, connection, name: str, sf_dir: str) -> str | None:
    """None when equal, else what differs."""
    started = time.time()
    got = entry.queries()[name](spark, sf_dir).toPandas()
    spark_seconds = time.time() - started
    started = time.time()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        print(f"{name}: {len(got)} rows, no SQL, {spark_seconds:.1f}s", flush=True)
        return None
    want = connection.execute(sql).fetchdf()
    print(
        f"{name}: {len(got)} rows, spark {spark_seconds:.1f}s, "
        f"sql {time.time() - started:.1f}s",
        flush=True,
    )
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} against {sorted(want.columns)}"
    types = {
        c: (str(got[c].dtype), str(want[c].dtype))
        for c in got.columns
        if str(got[c].dtype) != str(want[c].dtype)
    }
    if types:
        print(f"   types {types}", flush=True)
    left, right = rows(got), rows(want)
    if left == right:
        return None
    extra = sorted(set(left) - set(right))[:3]
    missing = sorted(set(right) - set(left))[:3]
    return f"{len(left)} against {len(right)} rows; only spark {extra}; only sql {missing}"


if __name__ == "__main__":
    sf_dir = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.01'}"
    session = local_session()
    session.sparkContext.setLogLevel("ERROR")
    database = connect(sf_dir)
    bad = 0
    for query in sys.argv[2:] or entry.queries():
        try:
            problem = compare(session, database, query, sf_dir)
        except Exception as error:  # report and go on to the next query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        if problem:
            bad += 1
            print(f"   MISMATCH {query}: {problem}", flush=True)
    print("failed:", bad)
