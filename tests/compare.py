"""Compare a catalogue query with its DuckDB statement: columns, row count, sorted values."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"create view {name} as select * from '{path}'")
    return con


def canonical(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return "null" if value is None else str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canonical(r[i]) for i in order) for r in rows)


def difference(df, con, sql: str) -> str | None:
    """None when equal, else a short description."""
    spark_columns = df.columns
    spark_types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    spark_rows = [tuple(r) for r in df.collect()]
    result = con.execute(sql)
    duck_columns = [c[0] for c in result.description]
    duck_types = {c[0]: str(c[1]).lower() for c in result.description}
    duck_rows = result.fetchall()
    if sorted(spark_columns) != sorted(duck_columns):
        return f"columns {sorted(spark_columns)} / {sorted(duck_columns)}"
    same = {"bigint": "bigint", "int": "integer", "double": "double", "string": "varchar",
            "boolean": "boolean"}
    wrong = {c: (spark_types[c], duck_types[c]) for c in spark_columns
             if same.get(spark_types[c]) != duck_types[c]}
    if wrong:
        return f"types {wrong}"
    if not spark_rows:
        return "no rows"
    if len(spark_rows) != len(duck_rows):
        return f"rows {len(spark_rows)} / {len(duck_rows)}"
    left, right = rows_of(spark_columns, spark_rows), rows_of(duck_columns, duck_rows)
    for a, b in zip(left, right):
        if a != b:
            names = sorted(spark_columns)
            cells = [(n, x, y) for n, x, y in zip(names, a, b) if x != y]
            return f"values {[(n, x[:300], y[:300]) for n, x, y in cells][:3]}"
    return None
