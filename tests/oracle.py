"""Compare a Spark result with DuckDB's, whatever the row order."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(
            f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')"
        )
    return connection


def _value(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return value


def _rows(names, rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_value(row[i]) for i in order) for row in rows)


_KINDS = {"TINYINT": "int", "SMALLINT": "int", "INTEGER": "int", "BIGINT": "bigint",
          "VARCHAR": "string", "DOUBLE": "double", "DATE": "date", "BOOLEAN": "boolean",
          "TIMESTAMP": "timestamp_ntz"}


def differences(result, connection, sql: str) -> list[str]:
    expected = connection.execute(sql)
    names = [d[0] for d in expected.description]
    kinds = {d[0]: _KINDS.get(str(d[1]), str(d[1])) for d in expected.description}
    found = []
    if sorted(names) != sorted(result.columns):
        return [f"columns {sorted(result.columns)} != {sorted(names)}"]
    for name, kind in result.dtypes:
        if kinds[name] != kind:
            found.append(f"{name}: {kind} != {kinds[name]}")
    ours = _rows(result.columns, [tuple(r) for r in result.collect()])
    theirs = _rows(names, expected.fetchall())
    if ours != theirs:
        found.append(
            f"{ours.total()} rows != {theirs.total()} rows; only ours {list((ours - theirs))[:2]}; "
            f"only theirs {list((theirs - ours))[:2]}"
        )
    return found
