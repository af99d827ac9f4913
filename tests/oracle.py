"""Run queries on Spark and their oracle text on DuckDB, and compare.

``python -m tests.oracle [sf_dir] [name ...]``
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

import __spark_entry__ as contract
import fixtures

ALL_TABLES = [*fixtures.TABLES, "events", "documents", "pages", "benchmark", "labels", "conversations"]


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in ALL_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "~"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (int, float)):
        return repr(float(x))
    return str(x)


def _canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def compare(spark, con, sf_dir: str, name: str) -> tuple[str | None, int, float]:
    """(problem or None, rows, Spark seconds)."""
    sql = contract.oracle_sql().get(name)
    t = time.time()
    df = contract.queries()[name](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    seconds = time.time() - t
    if sql is None:
        return None, len(got), seconds
    result = con.execute(sql)
    cols = [d[0] for d in result.description]
    types = {d[0]: str(d[1]) for d in result.description}
    want = result.fetchall()
    if sorted(cols) != sorted(df.columns):
        return f"columns: spark only {set(df.columns) - set(cols)}, oracle only {set(cols) - set(df.columns)}", len(got), seconds
    wrong = {c: (t_, types[c]) for c, t_ in df.dtypes if TYPES.get(t_, t_) != types[c]}
    if len(got) != len(want):
        return f"rows: {len(got)} against {len(want)}", len(got), seconds
    a, b = _canonical(df.columns, got), _canonical(cols, want)
    if a != b:
        bad = [(x, y) for x, y in zip(a, b) if x != y]
        return f"{len(bad)} rows differ, e.g. {sorted(df.columns)} {bad[:2]}", len(got), seconds
    if wrong:
        return f"types: {wrong}", len(got), seconds
    return None, len(got), seconds


def main() -> int:
    from ecoframe.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    names = sys.argv[2:] or list(contract.queries())
    spark = build_session(
        master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for name in names:
        try:
            problem, n, seconds = compare(spark, con, sf_dir, name)
        except Exception as error:  # report and go on
            problem, n, seconds = f"{type(error).__name__}: {str(error)[:700]}", -1, 0.0
        failed += problem is not None
        has = "sql" if name in contract.oracle_sql() else "rows"
        print(f"{'FAIL' if problem else 'ok  '} {name:32s} {has} rows={n} {seconds:.2f}s {problem or ''}", flush=True)
    print(f"{len(names) - failed} of {len(names)} agree")
    return failed


if __name__ == "__main__":
    sys.exit(main())
