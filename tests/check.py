"""Compare registered queries with their SQL: python -m tests.check [sf_dir] [name ...]"""

from __future__ import annotations

import math
import sys
import time

import duckdb

from __spark_entry__ import oracle_sql, queries

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.12g}")
    return value


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    data = [tuple(plain(row[i]) for i in order) for row in rows]
    return sorted(columns), sorted(data, key=repr)


def compare(spark, con, folder: str, name: str) -> str | None:
    """None if the query and its SQL agree, else what differs."""
    df = queries()[name](spark, folder)
    mine = canonical(df.columns, [tuple(r) for r in df.collect()])
    relation = con.sql(oracle_sql()[name])
    theirs = canonical(relation.columns, relation.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} != {theirs[0]}"
    if len(mine[1]) != len(theirs[1]):
        extra = [r for r in mine[1] if r not in set(theirs[1])][:3]
        missing = [r for r in theirs[1] if r not in set(mine[1])][:3]
        return f"{len(mine[1])} rows != {len(theirs[1])}; only mine {extra}; only SQL {missing}"
    bad = [(a, b) for a, b in zip(mine[1], theirs[1]) if a != b]
    return f"{len(bad)} rows differ, first {bad[0]}" if bad else None


def main() -> int:
    from tests.conftest import make_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(queries())
    spark, con, failed = make_session(), connect(folder), 0
    for name in names:
        start = time.time()
        try:
            problem = compare(spark, con, folder, name) if name in oracle_sql() else "no SQL"
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None
        print(f"{name:24s} {time.time() - start:6.1f}s {'ok' if problem is None else problem[:900]}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main())
