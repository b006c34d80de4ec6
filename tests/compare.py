"""Run registered queries beside their SQL: python -m tests.compare SF_DIR [names...]."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if v is None:
            return (0, "")
        if isinstance(v, bool):
            return (1, str(v))
        if isinstance(v, (int, float)):
            return (2, "nan" if isinstance(v, float) and math.isnan(v) else repr(round(float(v), 9)))
        return (3, str(v))

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def difference(spark, con, query, sql: str, sf_dir: str) -> str | None:
    """None when both sides hold the same rows, else the first difference."""
    got = query(spark, sf_dir)
    left = canonical(got.columns, got.collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    right = canonical(names, cur.fetchall())
    if sorted(got.columns) != sorted(names):
        return f"columns {sorted(got.columns)} / {sorted(names)}"
    if len(left) != len(right):
        extra = [x for x in left if x not in set(right)][:1], [x for x in right if x not in set(left)][:1]
        return f"rows {len(left)} / {len(right)} {extra}"
    for a, b in zip(left, right):
        if a != b:
            return f"{a} / {b}"
    return None


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from srclens.session import local_session

    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark, con = local_session(), duck(sf_dir)
    for name, query in queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            sql = oracle_sql().get(name)
            result = difference(spark, con, query, sql, sf_dir) if sql else f"rows only: {query(spark, sf_dir).count()}"
        except Exception as e:  # noqa: BLE001
            result = "ERROR " + str(e)[:700]
        print(f"{name:26s} {time.time() - start:6.1f}s {'ok' if result is None else result[:900]}", flush=True)
