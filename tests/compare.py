"""Holds Spark results against DuckDB's."""

from pathlib import Path

import duckdb
import pandas as pd

KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "smallint": "SMALLINT", "timestamp_ntz": "TIMESTAMP",
    "array<bigint>": "BIGINT[]", "array<int>": "INTEGER[]",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for file in Path(sf_dir).iterdir():
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}{'/*.parquet' if file.is_dir() else ''}'")
    return con


def plain(value):
    if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and value != value):
        return "NULL"
    if isinstance(value, float):
        return str(int(value)) if value.is_integer() else repr(round(value, 6))
    if hasattr(value, "__len__") and not isinstance(value, (str, bytes)):
        return str([plain(v) for v in value])
    return str(value)


def rows(frame: pd.DataFrame) -> list[tuple]:
    columns = sorted(frame.columns)
    return sorted(tuple(plain(v) for v in row) for row in frame[columns].itertuples(index=False))


def assert_same(df, con, sql: str) -> None:
    relation = con.sql(sql)
    kinds = dict(zip(relation.columns, map(str, relation.types), strict=True))
    assert {c: KINDS.get(t, t) for c, t in df.dtypes} == kinds
    assert rows(df.toPandas()) == rows(relation.df())
