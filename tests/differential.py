"""Runs queries on Spark and their SQL on DuckDB and compares rows and types, in any order of rows."""

from __future__ import annotations

import math
import os

import duckdb

from quernstone.session import TABLES

FAMILY = {"TINYINT": "int", "SMALLINT": "int", "INTEGER": "int", "BIGINT": "long", "HUGEINT": "huge", "DOUBLE": "double", "FLOAT": "float", "VARCHAR": "string", "BOOLEAN": "boolean", "DATE": "date", "TIMESTAMP": "timestamp"}
SPARK = {"tinyint": "int", "smallint": "int", "int": "int", "bigint": "long", "double": "double", "float": "float", "string": "string", "boolean": "boolean", "date": "date", "timestamp_ntz": "timestamp"}


def oracle(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows(names: list[str], values) -> list[tuple]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


def differences(spark, con, query, sql: str, sf_dir: str) -> list[str]:
    df = query(spark, sf_dir)
    got = rows(df.columns, df.collect())
    rel = con.sql(sql)
    want = rows(rel.columns, rel.fetchall())
    out = []
    if sorted(df.columns) != sorted(rel.columns):
        return [f"columns {sorted(df.columns)} and {sorted(rel.columns)}"]
    kinds = {c: SPARK.get(t, t) for c, t in df.dtypes}
    for c, t in zip(rel.columns, rel.types, strict=True):
        other = FAMILY.get(str(t), str(t))
        if other in FAMILY.values() and kinds[c] != other:
            out.append(f"type of {c}: {kinds[c]} and {other}")
    if got != want:
        bad = [(a, b) for a, b in zip(got, want, strict=False) if a != b][:2]
        out.append(f"rows {len(got)} and {len(want)}: {bad}"[:700])
    return out
