"""Rows of a Spark query and of DuckDB SQL in one comparable form."""

import datetime
import math
from pathlib import Path

import duckdb


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in rows)


def compare(spark, query, sql, sf_dir):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    df = query(spark, sf_dir)
    assert sorted(df.columns) == sorted(names), (df.columns, names)
    got, expected = rows_of(df.columns, df.collect()), rows_of(names, want.fetchall())
    assert len(got) == len(expected), (len(got), len(expected))
    for a, b in zip(got, expected):
        assert a == b, f"\nspark  {a[:600]}\nduckdb {b[:600]}"
