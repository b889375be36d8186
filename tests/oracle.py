"""Compares a query's rows with those of its SQL in DuckDB."""

import math
from decimal import Decimal
from pathlib import Path

import duckdb


def _plain(x):
    if x is None:
        return (0, "")
    if isinstance(x, (float, Decimal)):
        return (1, "nan") if math.isnan(x) else (1, f"{float(x) + 0.0:.10g}")
    if isinstance(x, bool):
        return (1, str(x))
    return (1, str(x))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def assert_same(spark, query, sql, sf_dir):
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    res = con.execute(sql)
    columns = [c[0] for c in res.description]
    want = rows_of(columns, res.fetchall())
    assert sorted(df.columns) == sorted(columns)
    assert len(got) == len(want), f"{len(got)} rows, {len(want)} by SQL"
    wrong = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    assert not wrong, f"{len(wrong)} rows differ, such as {wrong[:2]}"
    return len(got)
