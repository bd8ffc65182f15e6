"""Runs a query and its SQL over the same tables and compares rows without regard to order."""

from pathlib import Path

import duckdb
import pandas as pd

SF = "/root/testdata/sf0.001"


def connect(sf_dir=SF):
    con = duckdb.connect()
    for p in Path(sf_dir).iterdir():
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def rows(df, columns):
    text = lambda v: "NULL" if pd.isna(v) else repr(float(v)) if isinstance(v, float) else str(v)
    return sorted(tuple(map(text, r)) for r in df[columns].itertuples(index=False))


def same(spark, con, query, sql, sf_dir=SF):
    got, want = query(spark, sf_dir).toPandas(), con.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))
