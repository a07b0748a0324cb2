"""A query's rows against its SQL in DuckDB, as sorted rows of text."""

import os

import duckdb

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def _plain(value):
    if value is None:
        return "null"
    return f"{value:.6g}" if isinstance(value, float) else str(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(columns), sorted(tuple(_plain(r[k]) for k in order) for r in rows)


def spark_rows(df):
    return _rows(df.columns, df.collect())


def sql_rows(sql, sf_dir=DATA):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    got = con.execute(sql)
    return _rows([c[0] for c in got.description], got.fetchall())
