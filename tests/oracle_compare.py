"""Run registered queries in Spark and their SQL in DuckDB and compare the results as multisets of rows."""

from __future__ import annotations

import glob
import os
import sys
import time
from collections import Counter

import duckdb

TESTDATA = "/root/testdata"


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{folder}/*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return 0.0 if value == 0 else value
    if value is not None and not isinstance(value, (int, str, bool)):
        return str(value)
    return value


def rows(columns, data) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in data)


def compare(spark, con, name, build, sql, folder) -> tuple[int, str]:
    """(number of rows, "" or a description of the first difference)."""
    df = build(spark, folder)
    ours = [tuple(row) for row in df.collect()]
    if sql is None:
        return len(ours), ""
    result = con.execute(sql)
    columns = [c[0] for c in result.description]
    theirs = result.fetchall()
    if sorted(columns) != sorted(df.columns):
        return len(ours), f"columns {sorted(df.columns)} != {sorted(columns)}"
    left, right = rows(df.columns, ours), rows(columns, theirs)
    if left != right:
        extra, lacking = list((left - right).items())[:2], list((right - left).items())[:2]
        return len(ours), f"{len(ours)} rows vs {len(theirs)}; only Spark {extra}; only SQL {lacking}"
    return len(ours), ""


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from citegraph.session import get_session

    scale, names = sys.argv[1], sys.argv[2:]
    spark = get_session("compare", "local[8]", {
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "16g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    folder = f"{TESTDATA}/sf{scale}"
    con, oracles = connect(folder), entry.oracle_sql()
    bad = 0
    for name, build in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            count, problem = compare(spark, con, name, build, oracles.get(name), folder)
        except Exception as error:  # noqa: BLE001 - report every query
            count, problem = -1, f"{type(error).__name__}: {str(error)[:1500]}"
        bad += bool(problem)
        mark = "DIFF" if problem else ("ok" if name in oracles else "rows")
        print(f"{mark:5}{name:32}{count:>9} rows {time.time() - start:6.1f}s  {problem}", flush=True)
    print("differences:", bad)
