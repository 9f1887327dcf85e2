"""Spark result against DuckDB result: same columns, types and rows in any order."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
KINDS = {
    "string": "VARCHAR", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN", "int": "INTEGER",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    return tuple(value) if isinstance(value, list) else value


def difference(df, con, sql: str) -> str | None:
    """None where both agree, else what differs."""
    columns = sorted(df.columns)
    relation = con.sql(sql)
    if columns != sorted(relation.columns):
        return f"columns {columns} against {sorted(relation.columns)}"
    kinds = dict(zip(relation.columns, map(str, relation.types)))
    for field in df.schema:
        kind = KINDS.get(field.dataType.simpleString(), field.dataType.simpleString())
        if kind != kinds[field.name]:
            return f"type of {field.name}: {kind} against {kinds[field.name]}"
    ours = Counter(tuple(map(_plain, row)) for row in df.select(columns).collect())
    theirs = Counter(tuple(map(_plain, row)) for row in relation.select(*map(duckdb.ColumnExpression, columns)).fetchall())
    if ours == theirs:
        return None
    extra, lacking = ours - theirs, theirs - ours
    return (
        f"{sum(ours.values())} rows against {sum(theirs.values())}; only here {str(extra.most_common(2))[:600]}; "
        f"only there {str(lacking.most_common(2))[:600]}"
    )
