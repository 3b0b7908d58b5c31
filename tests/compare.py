"""A query and its SQL side by side: row count, columns, types and values, in any order of rows."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    db.execute("SET threads = 4")
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return db


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    return [plain(v) for v in value] if isinstance(value, list) else value


def rows(names: list[str], data: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


KINDS = {"INTEGER": "int", "BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean", "INTEGER[]": "array<int>", "HUGEINT": "hugeint"}


def differences(df, db: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """What differs between a Spark frame and the SQL's result; empty if nothing does."""
    found = db.execute(sql)
    names = [d[0] for d in found.description]
    kinds = {d[0]: KINDS.get(str(d[1]), str(d[1])) for d in found.description}
    theirs = found.fetchall()
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} and {sorted(names)}"]
    wrong = [f"{c}: {k} and {kinds[c]}" for c, k in df.dtypes if k != kinds[c]]
    mine = rows(df.columns, [tuple(r) for r in df.collect()])
    theirs = rows(names, theirs)
    if len(mine) != len(theirs):
        wrong.append(f"rows {len(mine)} and {len(theirs)}")
    apart = [(a, b) for a, b in zip(mine, theirs) if a != b]
    if apart:
        wrong.append(f"{len(apart)} rows differ, as {str(apart[0])[:600]}")
    return wrong
