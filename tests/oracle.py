"""Compares a query's rows with those of its SQL in DuckDB."""

import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(v) -> str:
    if v is None or v != v:
        return "null"
    return f"{v + 0.0:.7g}" if isinstance(v, float) else str(v)  # zeros have no sign


def same(spark, query, sql: str, folder: str) -> None:
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{folder}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want = con.execute(sql)
    names = sorted(d[0] for d in want.description)
    at = [[d[0] for d in want.description].index(n) for n in names]
    rows = sorted("|".join(value(r[i]) for i in at) for r in want.fetchall())
    df = query(spark, folder)
    assert sorted(df.columns) == names
    assert sorted("|".join(value(r[n]) for n in names) for r in df.collect()) == rows
