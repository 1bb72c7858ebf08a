"""Rows of a Spark result and of DuckDB, as multisets of plain values."""

from collections import Counter

SMALL = "/root/testdata/sf0.001"


def plain(value):
    if isinstance(value, float) and value == int(value):
        return int(value)
    return tuple(map(plain, value)) if isinstance(value, list) else value


def spark_rows(df, columns):
    return Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())


def duck_rows(duck, sql, columns):
    table = duck.sql(sql).arrow()
    table = table.read_all() if hasattr(table, "read_all") else table
    return Counter(tuple(plain(r[c]) for c in columns) for r in table.to_pylist())
