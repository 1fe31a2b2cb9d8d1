"""Compare queries with their SQL twins: ``python -m workload.check [sf] [name ...]``."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def _cell(value):
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    return str(value) if value is not None else None


def _sorted_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    shaped = [tuple(_cell(row[i]) for i in order) for row in rows]
    return sorted(shaped, key=lambda r: tuple((c is None, str(c)) for c in r))


# Names of the same type in the two engines.
TYPES = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string"}


def difference(spark, connection, sf_dir, query, sql) -> str:
    """Empty when query and SQL agree in names, types and rows."""
    df = query(spark, sf_dir)
    found = df.collect()
    result = connection.execute(sql)
    described = [(d[0], str(d[1])) for d in result.description]
    expected = result.fetchall()
    names = [name for name, _ in described]
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    kinds = dict(df.dtypes)
    for name, kind in described:
        if TYPES.get(kind, kind) != kinds[name]:
            return f"type of {name}: {kinds[name]} != {kind}"
    if len(found) != len(expected):
        return f"rows {len(found)} != {len(expected)}"
    left, right = _sorted_rows(df.columns, found), _sorted_rows(names, expected)
    for a, b in zip(left, right):
        if a != b:
            return f"first difference:\n  spark {str(a)[:600]}\n  duck  {str(b)[:600]}"
    return ""


def main() -> None:
    from tallymark import session
    from workload.oracle import ORACLE
    from workload.queries import QUERIES

    args = sys.argv[1:]
    sf_dir = f"/root/testdata/sf{args[0] if args else '0.01'}"
    chosen = args[1:] or list(QUERIES)
    spark = session(
        "check", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = duck(sf_dir)
    bad = 0
    for name in chosen:
        started = time.time()
        if name not in ORACLE:
            count = QUERIES[name](spark, sf_dir).count()
            print(f"rows-only {name}: {count} ({time.time() - started:.1f}s)")
            continue
        try:
            problem = difference(spark, connection, sf_dir, QUERIES[name], ORACLE[name])
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        bad += bool(problem)
        print(f"{'FAIL' if problem else 'ok'} {name} ({time.time() - started:.1f}s) {problem}", flush=True)
    print(f"{bad} of {len(chosen)} differ")


if __name__ == "__main__":
    main()
