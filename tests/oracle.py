"""Runs a registered query and its SQL on the same tables and compares rows."""

import math
import os


def connect(folder):
    import duckdb

    c = duckdb.connect()
    for t in os.listdir(folder):
        c.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{t}'")
    return c


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}") + 0.0
    return value


def rows(names, table):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in table), key=repr)


def agree(df, sql, folder):
    cur = connect(folder).execute(sql)
    names = [x[0] for x in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(names, cur.fetchall())
