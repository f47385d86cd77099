"""Compare a Spark result with its SQL on DuckDB."""

import glob
import math

import duckdb

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        if glob.glob(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    return v


def same(df, con, sql):
    rel = con.sql(sql)
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns), (cols, rel.columns)
    at = [rel.columns.index(c) for c in cols]
    want = sorted((str([_cell(float(r[i]) if type(r[i]).__name__ == "Decimal" else r[i]) for i in at]) for r in rel.fetchall()))
    got = sorted(str([_cell(r[c]) for c in cols]) for r in df.collect())
    assert len(got) == len(want), (len(got), len(want))
    assert got == want, next((g, w) for g, w in zip(got, want, strict=True) if g != w)
