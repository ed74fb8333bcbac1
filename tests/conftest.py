from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ["PYTHONPATH"] = f"{Path(__file__).resolve().parents[1]}:{os.environ.get('PYTHONPATH', '')}"

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    """A value as text that both engines agree on."""
    if isinstance(v, (list, tuple)) or getattr(v, "ndim", 0) == 1:
        return str([plain(x) for x in v])
    if v is None or type(v).__name__ in ("NAType", "NaTType") or v != v:
        return "null"
    if isinstance(v, bool) or type(v).__name__ == "bool":
        return str(bool(v))
    if isinstance(v, (int, float)) or hasattr(v, "dtype"):
        return f"{float(v) + 0.0:.5f}"
    return str(v)


def rows_of(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted(tuple(plain(v) for v in r) for r in pdf[cols].astype(object).itertuples(index=False))
