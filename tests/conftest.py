from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [str(ROOT), os.environ.get("PYTHONPATH")]))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from refrain.runtime import workers_see_package

    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    workers_see_package(session)
    yield session
    session.stop()


def same_rows(frame, sql: str, sf_dir: str) -> None:
    """The Spark rows equal DuckDB's, in any order."""
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got, want = frame.toPandas(), con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    plain = lambda v: None if pd.isna(v) else v if isinstance(v, (str, bytes)) else bool(v) if str(v) in ("True", "False") else round(float(v), 6)
    rows = lambda df: sorted(repr([plain(v) for v in r]) for r in df[sorted(df.columns)].itertuples(index=False))
    assert rows(got) == rows(want)
