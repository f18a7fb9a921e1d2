"""Compare registered Spark queries with their DuckDB counterparts: columns, types, rows."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb

TYPES = {
    "BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean",
}


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return con


def differences(df, con, sql: str) -> list[str]:
    """What differs; empty if columns, types and the bag of rows agree."""
    relation = con.sql(sql)
    names = sorted(df.columns)
    found = []
    if names != sorted(relation.columns):
        return [f"columns {names} / {sorted(relation.columns)}"]
    spark_types = dict(df.dtypes)
    duck_types = {n: TYPES.get(str(t), str(t)) for n, t in zip(relation.columns, relation.types)}
    found += [f"type of {n}: {spark_types[n]} / {duck_types[n]}" for n in names if spark_types[n] != duck_types[n]]
    rows = Counter(tuple(row[n] for n in names) for row in df.collect())
    order = [relation.columns.index(n) for n in names]
    other = Counter(tuple(row[i] for i in order) for row in relation.fetchall())
    if rows != other:
        found.append(f"{sum(rows.values())} / {sum(other.values())} rows")
        found += [f"only Spark: {str(r)[:300]}" for r in list(rows - other)[:3]]
        found += [f"only DuckDB: {str(r)[:300]}" for r in list(other - rows)[:3]]
    return found
