"""Side-by-side run of a registered query and its SQL twin."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pandas as pd


def connect(folder: str):
    con = duckdb.connect()
    for path in glob.glob(os.path.join(folder, "*.parquet")):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def normal(value):
    if value is None or value is pd.NaT or value is pd.NA:
        return None
    if isinstance(value, float) and math.isnan(value):
        return None
    if hasattr(value, "item"):
        value = value.item()
        if isinstance(value, float) and math.isnan(value):
            return None
    if isinstance(value, float):
        return float(repr(value)) + 0.0
    if isinstance(value, (int, bool, str)):
        return value
    return str(value)


def rows(pdf: pd.DataFrame) -> list[tuple]:
    pdf = pdf[sorted(pdf.columns)]
    return sorted((tuple(normal(v) for v in row) for row in pdf.itertuples(index=False, name=None)),
                  key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


def same(a, b) -> bool:
    if isinstance(a, (int, float)) and isinstance(b, (int, float)):
        return float(a) == float(b)
    return a == b


def differences(spark_pdf: pd.DataFrame, sql_pdf: pd.DataFrame, show: int = 3) -> list[str]:
    if sorted(spark_pdf.columns) != sorted(sql_pdf.columns):
        return [f"columns {sorted(spark_pdf.columns)} != {sorted(sql_pdf.columns)}"]
    left, right = rows(spark_pdf), rows(sql_pdf)
    if len(left) != len(right):
        return [f"rows {len(left)} != {len(right)}", f"spark {left[:show]}", f"sql {right[:show]}"]
    bad = [(a, b) for a, b in zip(left, right) if not all(same(x, y) for x, y in zip(a, b))]
    return [f"{len(bad)} of {len(left)} rows differ"] + [f"{a}\n      {b}" for a, b in bad[:show]] if bad else []
