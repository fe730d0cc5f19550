"""Run registered queries in Spark and their SQL in DuckDB and compare the rows.

    python tests/compare.py [sf_dir] [query ...]
"""

from __future__ import annotations

import decimal
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, (float, decimal.Decimal)):
        return round(float(value), 9)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def as_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(row[i]) for i in order) for row in rows]
    return sorted(columns), sorted(out, key=repr)


def compare(spark, con, run, sql, sf_dir) -> tuple[bool, str]:
    df = run(spark, sf_dir)
    mine = as_rows(df.columns, df.collect())
    cursor = con.execute(sql)
    theirs = as_rows([c[0] for c in cursor.description], cursor.fetchall())
    if mine[0] != theirs[0]:
        return False, f"columns {mine[0]} != {theirs[0]}"
    if mine[1] == theirs[1]:
        return True, f"{len(mine[1])} rows"
    a, b = set(mine[1]), set(theirs[1])
    return False, (
        f"{len(mine[1])} vs {len(theirs[1])} rows\n  spark only: {list(a - b)[:2]}"
        f"\n  sql only:   {list(b - a)[:2]}"
    )


def main() -> None:
    from conftest import local_session
    from turnsift.plans.catalog import registered

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = local_session()
    con = duck(sf_dir)
    failed = []
    for name, (run, sql) in registered().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            if sql:
                ok, note = compare(spark, con, run, sql, sf_dir)
            else:
                ok, note = True, f"{run(spark, sf_dir).count()} rows, no SQL"
        except Exception as error:  # noqa: BLE001
            ok, note = False, f"{type(error).__name__}: {str(error)[:300]}"
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.1f}s {note[:1200]}", flush=True)
        if not ok:
            failed.append(name)
    print("failed:", failed)


if __name__ == "__main__":
    main()
