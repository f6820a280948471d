from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    from quillmere.session import prepare

    made = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .getOrCreate()
    )
    made.sparkContext.setLogLevel("ERROR")
    yield prepare(made)
    made.stop()


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture(scope="session")
def duck():
    """DuckDB with the smallest tables as views."""
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{name}'")
    return con


def rows_of(frame) -> list[str]:
    """Rows with columns in order of name, doubles rounded, as sorted text: what two engines must agree on."""
    import pandas as pd

    def plain(v):
        if isinstance(v, float):
            return None if pd.isna(v) else round(v, 6) + 0.0
        if v is None or (not hasattr(v, "__len__") and pd.isna(v)):
            return None
        if isinstance(v, bool) or type(v).__name__ in ("bool_", "bool"):
            return bool(v)
        if hasattr(v, "year"):
            return str(v)
        return plain(float(v)) if hasattr(v, "__float__") and not isinstance(v, str) else str(v)

    cols = sorted(frame.columns)
    return sorted(repr([plain(v) for v in row]) for row in frame[cols].astype(object).itertuples(index=False))
