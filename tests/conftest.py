from __future__ import annotations

import os
import sys
from collections.abc import Callable
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory) -> SparkSession:
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def duck() -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{DATA}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS FROM read_parquet('{path}{'/*' if os.path.isdir(path) else ''}')")
    return con


def plain_rows(rows: list[dict]) -> list[tuple]:
    return sorted(tuple(repr(round(r[k], 9)) if isinstance(r[k], float) else str(r[k]) for k in sorted(r)) for r in rows)


@pytest.fixture(scope="session")
def agree(spark, duck) -> Callable[[Callable, str], None]:
    """Compares a query with its SQL twin on the smallest tables: columns, types and values."""

    def check(query: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
        mine, other = query(spark, DATA).toArrow(), duck.sql(sql).to_arrow_table()
        types = [{n: str(t) for n, t in zip(x.column_names, x.schema.types, strict=True)} for x in (mine, other)]
        assert types[0] == types[1]
        assert plain_rows(mine.to_pylist()) == plain_rows(other.to_pylist())

    return check
