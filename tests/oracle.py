"""Run a query on Spark and its SQL on DuckDB and compare the rows without order."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 9)
        return str(v) if v is not None and not isinstance(v, int) else v

    return [columns[i] for i in order], sorted([[value(r[i]) for i in order] for r in rows], key=repr)


def duck(sql, sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        source = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{source}')")
    cursor = con.execute(sql)
    return rows_of([d[0] for d in cursor.description], cursor.fetchall())


def spark(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()])
