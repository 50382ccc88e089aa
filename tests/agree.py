"""Run registered queries beside their SQL in DuckDB and report where they differ.

    python tests/agree.py [sf_dir] [query ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "NaN"
        return 0.0 if value == 0 else value
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def _sorted(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(plain, key=repr)


def difference(spark, con, name: str, query, sql: str | None, sf_dir: str) -> tuple[str, int]:
    """Empty text when both sides agree, and the row count."""
    frame = query(spark, sf_dir)
    columns = frame.columns
    rows = [tuple(r) for r in frame.collect()]
    if sql is None:
        return ("" if rows else "no rows"), len(rows)
    result = con.execute(sql)
    expected_columns = [d[0] for d in result.description]
    expected = result.fetchall()
    if sorted(columns) != sorted(expected_columns):
        return f"columns {sorted(columns)} != {sorted(expected_columns)}", len(rows)
    if len(rows) != len(expected):
        return f"{len(rows)} rows != {len(expected)}", len(rows)
    mine, theirs = _sorted(columns, rows), _sorted(expected_columns, expected)
    wrong = [(a, b) for a, b in zip(mine, theirs) if a != b or [type(x) for x in a] != [type(x) for x in b]]
    if wrong:
        return f"{len(wrong)} rows differ, e.g. {wrong[0]}", len(rows)
    return "", len(rows)


def session(cores: int = 8):
    from pyspark.sql import SparkSession

    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def main() -> int:
    import __spark_entry__ as entry

    args = sys.argv[1:]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    wanted = args[1:]
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, sql = entry.queries(), entry.oracle_sql()
    seen = spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    print(f"{sf_dir}: {seen} orders, {con.execute('select count(*) from orders').fetchone()[0]} in DuckDB", flush=True)
    bad = 0
    for name in wanted or queries:
        start = time.time()
        try:
            text, n = difference(spark, con, name, queries[name], sql.get(name), sf_dir)
        except Exception as error:  # report and go on with the next query
            text, n = f"{type(error).__name__}: {str(error)[:1500]}", 0
        bad += bool(text)
        state = "DIFFERS " + text if text else ("ok" if name in sql else "ok (rows only)")
        print(f"{name:28s} {time.time() - start:6.1f}s {n:7d} {state}", flush=True)
    print(f"{bad} of {len(wanted or queries)} differ")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
