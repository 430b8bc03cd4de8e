"""Comparing a registered query with its SQL."""

from __future__ import annotations

import math

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else int(v) if v == int(v) else v
    return v.item() if hasattr(v, "item") else v


def same_rows(spark_rows, sql_rows) -> None:
    """Fails unless two pandas frames hold the same columns and rows in any order."""
    columns = sorted(spark_rows.columns)
    assert columns == sorted(sql_rows.columns)
    rows = [sorted((tuple(None if v is None or v is pd.NA or v != v else _plain(v) for v in r) for r in f[columns].astype(object).values.tolist()), key=repr) for f in (spark_rows, sql_rows)]
    assert len(rows[0]) == len(rows[1])
    assert rows[0] == rows[1]
