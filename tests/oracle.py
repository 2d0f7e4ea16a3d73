"""Comparison of a query's rows with those of its SQL in DuckDB."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def _cell(x) -> str:
    if x is None or x is pd.NA or x != x:
        return "NULL"
    if isinstance(x, bool):
        return str(x)
    try:
        return repr(round(float(x), 6) + 0.0)
    except (TypeError, ValueError):
        return str(x)


def rows(frame) -> list[tuple[str, ...]]:
    cols = sorted(frame.columns)
    return sorted(tuple(map(_cell, r)) for r in frame[cols].astype(object).itertuples(index=False))


def assert_same(spark_df, connection, sql: str) -> None:
    ours, theirs = spark_df.toPandas(), connection.sql(sql).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)
