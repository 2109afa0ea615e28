"""Rows of a query and of its SQL in one form."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def value(v):
    if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) in ("NaT", "<NA>"):
        return "~"
    if type(v).__name__.startswith("float") or type(v).__name__ == "Decimal":
        return f"{float(v):.9g}"
    return str(v)


def rows(frame):
    names = sorted(frame.columns)
    return names, sorted(tuple(value(v) for v in r) for r in frame[names].itertuples(index=False))
