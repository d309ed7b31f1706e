"""Compare a Spark result with a SQL result: names, types, rows in any order, values."""

from __future__ import annotations

import math

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return (0, "")
    if isinstance(value, float):
        return (1, repr(value + 0.0))
    return (2, repr(value))


def _rows(records, order):
    return sorted(tuple(_cell(r[i]) for i in order) for r in records)


_KINDS = {
    "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string",
    "BOOLEAN": "boolean", "DATE": "date", "TIMESTAMP": "timestamp",
}


def differences(spark_df, con: duckdb.DuckDBPyConnection, sql: str, shown: int = 3) -> list[str]:
    found = []
    cursor = con.execute(sql)
    description = cursor.description
    expected = cursor.fetchall()
    names = [d[0] for d in description]
    types = {d[0]: _KINDS.get(str(d[1]), str(d[1])) for d in description}
    if sorted(names) != sorted(spark_df.columns):
        return [f"columns {sorted(spark_df.columns)} != {sorted(names)}"]
    for field in spark_df.schema.fields:
        if field.dataType.simpleString() != types[field.name]:
            found.append(
                f"type of {field.name}: {field.dataType.simpleString()} != {types[field.name]}"
            )
    ordered = sorted(names)
    actual = [tuple(r) for r in spark_df.collect()]
    left = _rows(actual, [spark_df.columns.index(n) for n in ordered])
    right = _rows(expected, [names.index(n) for n in ordered])
    if len(left) != len(right):
        found.append(f"rows {len(left)} != {len(right)}")
    only_left = sorted(set(left) - set(right))
    only_right = sorted(set(right) - set(left))
    if only_left or only_right or left != right:
        found.append(f"{len(only_left)} / {len(only_right)} rows differ, columns {ordered}")
        found += [f"  spark  {[c[1] for c in r]}" for r in only_left[:shown]]
        found += [f"  sql    {[c[1] for c in r]}" for r in only_right[:shown]]
    return found
