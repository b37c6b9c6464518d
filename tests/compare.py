"""Order-free comparison of a DataFrame with DuckDB rows."""

import datetime
import decimal
import glob
import math
import os

import duckdb


def connection(d: str):
    c = duckdb.connect()
    for f in glob.glob(d + "/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, decimal.Decimal):
        return plain(float(v))
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, datetime.date) and not isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


def spark_rows(df) -> list[str]:
    cols = sorted(df.columns)
    return sorted(repr(tuple(plain(v) for v in r)) for r in df.select(*[f"`{c}`" for c in cols]).collect())


def duck_rows(con, sql: str, columns) -> list[str]:
    r = con.sql(sql)
    names = list(r.columns)
    assert sorted(names) == sorted(columns), (sorted(names), sorted(columns))
    at = [names.index(c) for c in sorted(columns)]
    return sorted(repr(tuple(plain(row[i]) for i in at)) for row in r.fetchall())
