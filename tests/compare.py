"""Run a query in Spark and its counterpart in DuckDB and compare the rows."""

from __future__ import annotations

import glob
import os

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return 0.0 if value == 0 else value
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        (tuple(_plain(row[i]) for i in order) for row in rows),
        key=lambda row: tuple((v is None, str(type(v)), repr(v)) for v in row),
    )


_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
          "boolean": "BOOLEAN", "tinyint": "TINYINT", "float": "FLOAT"}


def difference(df, con, sql: str) -> str | None:
    """None if both sides agree, else what differs."""
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    types = {d[0]: str(d[1]).upper() for d in result.description}
    expected = _rows(columns, result.fetchall())
    mine = {f.name: _TYPES.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema}
    if sorted(mine) != sorted(columns):
        return f"columns {sorted(mine)} and {sorted(columns)}"
    wrong = {c: (mine[c], types[c]) for c in mine if mine[c] != types[c] and types[c] != "NUMBER"}
    found = _rows(df.columns, [tuple(r) for r in df.collect()])
    if len(found) != len(expected):
        return f"{len(found)} rows, expected {len(expected)}: {found[:2]} / {expected[:2]}"
    for a, b in zip(found, expected):
        if a != b and not all(x == y or (x != x and y != y) for x, y in zip(a, b)):
            return f"{a} / {b} (sorted columns {sorted(columns)})"
    return f"types {wrong}" if wrong else None
