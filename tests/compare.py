"""Where things are, and results of Spark and DuckDB as comparable sorted lists."""

import os

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted(repr([plain(r[c]) for c in names]) for r in df.collect())


def duck_rows(duck, sql):
    r = duck.sql(sql)
    names = sorted(r.columns)
    at = [r.columns.index(c) for c in names]
    return names, sorted(repr([plain(x[i]) for i in at]) for x in r.fetchall())
