"""Comparing a query's rows with DuckDB's."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float) or hasattr(value, "quantize"):
        return f"{float(value):.6g}"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def assert_same(df, con, sql):
    theirs = con.sql(sql)
    assert sorted(df.columns) == sorted(theirs.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(theirs.columns, theirs.fetchall())
