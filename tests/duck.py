"""Compare a query with its SQL in DuckDB, without regard to order."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows(df) -> list[str]:
    cols = sorted(df.columns)
    data = df[cols].astype(object).where(df[cols].notna(), None)
    return sorted(map(repr, map(tuple, data.values.tolist())))
