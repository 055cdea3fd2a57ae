"""Compare a query with its DuckDB SQL: same columns, same rows in any order."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _key(row):
    return tuple((x is None, "" if x is None else str(round(x, 5)) if isinstance(x, float) else str(x)) for x in row)


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9) or (a != a and b != b)
    return a == b


def difference(df, sql, sf_dir):
    """None if they agree, else what differs."""
    db = duckdb.connect()
    db.execute("SET TimeZone='UTC'")
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    rel = db.sql(sql)
    columns = sorted(df.columns)
    if columns != sorted(rel.columns):
        return f"columns {columns} and {sorted(rel.columns)}"
    where = [rel.columns.index(c) for c in columns]
    ours = sorted((tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect()), key=_key)
    theirs = sorted((tuple(r[i] for i in where) for r in rel.fetchall()), key=_key)
    if len(ours) != len(theirs):
        return f"rows {len(ours)} and {len(theirs)}"
    return next((f"{columns}: {x} and {y}" for x, y in zip(ours, theirs) if not all(map(same, x, y))), None)
