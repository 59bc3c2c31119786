"""Compare registered queries with their SQL in DuckDB.

    python tests/parity.py [sf_dir] [query …]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def normal_form(df: pd.DataFrame) -> list[tuple]:
    """Rows as tuples of text, columns by name, in a fixed order."""
    columns = sorted(df.columns)

    def text(value: object) -> str:
        if value is None or value is pd.NaT or (isinstance(value, float) and value != value):
            return "NULL"
        if isinstance(value, float):
            return repr(float(value))
        return str(value)

    return sorted(tuple(map(text, row)) for row in df[columns].astype(object).to_numpy())


def compare(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    """None if equal, else what differs."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} against {sorted(want.columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}"
    kinds = [(c, got[c].dtype.kind, want[c].dtype.kind) for c in got.columns]
    odd = [k for k in kinds if k[1] != k[2] and "O" not in k[1:]]
    if odd:
        return f"types {odd}"
    a, b = normal_form(got), normal_form(want)
    different = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    if different:
        return f"{len(different)} rows differ, first {different[0]}"
    return None


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from panelsmith.session import get_session

    arguments = sys.argv[1:]
    sf_dir = arguments.pop(0) if arguments and "/" in arguments[0] else "/root/testdata/sf0.01"
    spark = get_session("parity", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    sql = oracle_sql()
    failures = 0
    for name, function in queries().items():
        if arguments and name not in arguments:
            continue
        start = time.time()
        try:
            got = function(spark, sf_dir).toPandas()
            spent = time.time() - start
            start = time.time()
            if name in sql:
                want = con.execute(sql[name]).df()
                problem = compare(got, want)
                verdict = problem or "equal"
            else:
                problem, verdict = None, "rows only"
        except Exception as e:  # noqa: BLE001 - report and go on
            problem = verdict = f"{type(e).__name__}: {str(e)[:1500]}"
            spent, got = time.time() - start, pd.DataFrame()
        failures += problem is not None
        print(
            f"{'FAIL' if problem else 'ok  '} {name:30s} {len(got):7d} rows "
            f"{spent:6.2f} s, sql {time.time() - start:5.2f} s  {verdict}",
            flush=True,
        )
    print(f"{failures} failures")
    return failures


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
