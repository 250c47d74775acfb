"""Run a query and its SQL side by side."""

import math
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{sf_dir}/{name}'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(([row[k] for k in order] for row in rows), key=repr)


def differ(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return not math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    if isinstance(a, (list, tuple)) and isinstance(b, (list, tuple)):
        return len(a) != len(b) or any(differ(x, y) for x, y in zip(a, b, strict=True))
    return type(a) is not type(b) or a != b


def compare(df, con, sql):
    got = rows_of(df.columns, [tuple(x) for x in df.collect()])
    found = con.execute(sql)
    want = rows_of([c[0] for c in found.description], found.fetchall())
    assert sorted(df.columns) == sorted(c[0] for c in con.execute(sql).description)
    assert len(got) == len(want), (len(got), len(want), got[:2], want[:2])
    bad = [(g, w) for g, w in zip(got, want, strict=True) if any(differ(x, y) for x, y in zip(g, w, strict=True))]
    assert not bad, (len(bad), bad[:3])
    assert got
