"""Runs a query and its SQL on the same tables and compares the rows."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _cell(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (list, tuple)):
        return tuple(map(_cell, value))
    if hasattr(value, "is_integer"):
        value = float(value)
        return "nan" if math.isnan(value) else 0.0 + (float(f"{value:.9g}"))
    return int(value) if hasattr(value, "__int__") and not isinstance(value, str) else str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, sf_dir, query, sql):
    """The rows of both, and the first that differ."""
    df = query(spark, sf_dir)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = rows_of(names, cursor.fetchall())
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert sorted(df.columns) == sorted(names), (df.columns, names)
    differ = [(a, b) for a, b in zip(ours, theirs, strict=False) if a != b]
    return len(ours), len(theirs), differ[:3]
