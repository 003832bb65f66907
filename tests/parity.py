"""Spark results against DuckDB on the same tables."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(table, names):
    def value(x):
        if isinstance(x, float):
            return "nan" if math.isnan(x) else f"{x + 0.0:.9g}"
        return str(x)

    return sorted(tuple(value(v) for v in r) for r in zip(*(table.column(n).to_pylist() for n in names), strict=True))


def differences(spark, query, sql, sf_dir):
    """None if the results are equal (doubles to nine digits), else what differs."""
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    want = con.execute(sql).to_arrow_table()
    got = query(spark, sf_dir).toArrow()
    names = sorted(got.column_names)
    if names != sorted(want.column_names):
        return names, sorted(want.column_names)
    a, b = rows(got, names), rows(want, names)
    if a != b:
        left, right = sorted(set(a) - set(b))[:3], sorted(set(b) - set(a))[:3]
        return len(a), len(b), names, left, right
    return None
