"""Compares a query with its SQL in DuckDB on the same tables, rows as a bag, columns by name."""

import math
import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    return round(v, 6) if isinstance(v, float) and not math.isnan(v) else v


def compare(spark, sf_dir: str, query, sql: str) -> None:
    import duckdb

    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(_plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = con.execute(f"SELECT * FROM ({sql.strip()})") if not sql.strip().upper().startswith("WITH") else con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = sorted((tuple(_plain(r[i]) for i in order) for r in found.fetchall()), key=repr)
    assert got == want
