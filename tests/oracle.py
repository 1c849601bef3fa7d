"""Spark rows against DuckDB rows."""

import glob
import math
import os

import duckdb


def _text(v):
    if v is None or isinstance(v, float) and math.isnan(v) or type(v).__name__ in ("NAType", "NaTType"):
        return "NULL"
    if type(v).__name__ in ("bool", "bool_"):
        return str(bool(v))
    if isinstance(v, float):
        return repr(round(v, 9) + 0.0)
    return str(v)


def rows(pdf):
    pdf = pdf[sorted(pdf.columns)]
    return list(pdf.columns), sorted("|".join(map(_text, r)) for r in pdf.itertuples(index=False, name=None))


def duck(sf_dir, sql):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con.sql(sql).df()
