"""Compare a query with its SQL run by DuckDB over the same tables."""

import glob
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        if os.path.exists(path):
            files = path if os.path.isfile(path) else sorted(glob.glob(f"{path}/*.parquet"))
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet({files if isinstance(files, list) else [files]})")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])

    def text(v):
        if v is None or v != v:
            return "null"
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    return sorted(tuple(text(r[k]) for k in order) for r in rows)


def same(df, con, sql):
    cursor = con.execute(sql)
    columns = [c[0] for c in cursor.description]
    expected = canonical(columns, cursor.fetchall())
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    assert sorted(df.columns) == sorted(columns)
    assert len(got) == len(expected)
    assert got == expected
