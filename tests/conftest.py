import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    conf = {"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "6g", "spark.sql.session.timeZone": "UTC", "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))}
    session = SparkSession.builder.master("local[*]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    """Sorted rows with columns by name; floats to nine places."""

    def plain(v):
        if v is None or (isinstance(v, float) and v != v) or v is pd.NA:
            return None
        if hasattr(v, "item"):
            v = v.item()
        return round(v, 9) if isinstance(v, float) else v if isinstance(v, (int, bool)) else str(v)

    return sorted((tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False, name=None)), key=lambda r: tuple(map(str, r)))


@pytest.fixture(scope="session")
def same_as_oracle(spark, duck):
    def check(query, sql):
        got, want = query(spark, DATA).toPandas(), duck.sql(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)

    return check
