"""Runs a query and its SQL and compares the rows."""

import glob
import os

import duckdb


def views(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def same(df, sql, sf_dir):
    con = views(sf_dir)
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    cols = sorted(names)
    order = [names.index(c) for c in cols]
    want = sorted((tuple(r[i] for i in order) for r in cur.fetchall()), key=repr)
    got = sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)
    assert len(got) == len(want)
    assert got == want
