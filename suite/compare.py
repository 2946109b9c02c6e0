"""Run queries against their SQL and report differences.

    python -m suite.compare [sf_dir] [name ...]
"""

from __future__ import annotations

import decimal
import math
import sys
import time

from rowsight.fixtures import TABLES


def _plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    if hasattr(v, "tolist"):
        return [_plain(x) for x in v.tolist()]
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(_plain(r[i]) for i in order)) for r in rows)


def oracle_rows(sf_dir: str, sql: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    return sorted(names), rows_of(names, found.fetchall())


def compare(spark, sf_dir: str, query, sql: str | None):
    """(row count, problem or None)"""
    df = query(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    if sql is None:
        return len(got), None
    names, want = oracle_rows(sf_dir, sql)
    if sorted(df.columns) != names:
        return len(got), f"columns {sorted(df.columns)} != {names}"
    if got != want:
        extra, lost = [r for r in got if r not in set(want)][:2], [r for r in want if r not in set(got)][:2]
        return len(got), f"{len(got)} rows, want {len(want)}; extra {extra}; lost {lost}"
    return len(got), None


def main(argv):
    from rowsight.session import local_session
    from suite import oracle, queries

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    sql = oracle.all_sql()
    todo = queries.all_queries()
    bad = 0
    for name, query in todo.items():
        if argv[1:] and name not in argv[1:]:
            continue
        start = time.time()
        try:
            n, problem = compare(spark, sf_dir, query, sql.get(name))
        except Exception as e:  # noqa: BLE001
            n, problem = 0, f"{type(e).__name__}: {str(e)[:1500]}"
        bad += problem is not None
        kind = "sql" if name in sql else "rows"
        print(f"{name:24s} {kind:4s} {n:8d} {time.time() - start:6.2f}s {'ok' if problem is None else 'BAD ' + problem}", flush=True)
    print("unknown sql:", sorted(set(sql) - set(todo)), "bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
