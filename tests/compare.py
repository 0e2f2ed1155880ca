"""Compare a Spark result with the result of its SQL in DuckDB, row by row."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    if isinstance(value, (list, tuple)) and not hasattr(value, "asDict"):
        return [plain(v) for v in value]
    if hasattr(value, "asDict"):
        return {k: plain(v) for k, v in value.asDict().items()}
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    return value


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((repr([plain(r[i]) for i in order]) for r in rows))


def compare(frame, con, sql):
    """Returns (spark rows, sql rows, problem or None)."""
    mine_names = frame.columns
    mine = rows_of(mine_names, frame.collect())
    if sql is None:
        return len(mine), None, None
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    types = [str(d[1]) for d in cursor.description]
    theirs = rows_of(names, cursor.fetchall())
    if sorted(names) != sorted(mine_names):
        return len(mine), len(theirs), f"columns {sorted(mine_names)} != {sorted(names)}"
    for name, kind in zip(names, types):
        spark_kind = frame.schema[name].dataType.simpleString()
        family = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN",
                  "string": "VARCHAR"}.get(spark_kind)
        if family and kind != family:
            return len(mine), len(theirs), f"type of {name}: {spark_kind} != {kind}"
    if mine != theirs:
        a, b = set(mine), set(theirs)
        return len(mine), len(theirs), (f"{len(a - b)} only here, e.g. {sorted(a - b)[:2]}; "
                                        f"{len(b - a)} only in SQL, e.g. {sorted(b - a)[:2]}")
    return len(mine), len(theirs), None
