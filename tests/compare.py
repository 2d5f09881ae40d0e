"""Run named queries in Spark and their SQL in DuckDB and compare whole results."""

import sys
import time
from collections import Counter
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

import duckdb  # noqa: E402

TABLES = ("events", "documents", "pages", "conversations")


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def bag(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(row[i] for i in order) for row in rows)


def difference(spark, connection, query, sql, folder):
    """(column names differ, rows only in Spark, rows only in DuckDB, number of rows)."""
    frame = query(spark, folder)
    mine = bag(frame.columns, [tuple(r) for r in frame.collect()])
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    theirs = bag(names, result.fetchall())
    return sorted(frame.columns) != sorted(names), mine - theirs, theirs - mine, mine.total()


def main() -> None:
    from tests.conftest import make_session

    import __spark_entry__ as entry

    folder = sys.argv[1]
    only = sys.argv[2:]
    spark = make_session()
    connection = duck(folder)
    sqls = entry.oracle_sql()
    bad = 0
    for name, query in entry.queries().items():
        if only and name not in only:
            continue
        start = time.time()
        if name not in sqls:
            print(f"{name}: no SQL, {query(spark, folder).count()} rows, {time.time() - start:.1f} s", flush=True)
            continue
        try:
            names, more, less, total = difference(spark, connection, query, sqls[name], folder)
        except Exception as problem:
            bad += 1
            print(f"{name}: FAILED {str(problem)[:600]}", flush=True)
            continue
        verdict = "ok" if not (names or more or less) else "DIFFERS"
        bad += verdict != "ok"
        print(f"{name}: {verdict}, {total} rows, {time.time() - start:.1f} s", flush=True)
        if verdict != "ok":
            print("  names differ" if names else "", list(more)[:2], list(less)[:2], len(more), len(less), flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
