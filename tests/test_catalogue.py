"""Every query of the catalogue equals its SQL in DuckDB, on the smallest tables; with PARCELFLOW_ALL=1 on larger ones."""

import math
import os
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from parcelflow.plans.catalogue import ORACLES, QUERIES

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
SIZE = "sf0.01" if os.environ.get("PARCELFLOW_ALL") else "sf0.001"


@pytest.fixture(scope="module")
def small(sf):
    return str(Path(sf).parent / SIZE)


def canonical(df):
    def one(v):
        if pd.isna(v):
            return ""
        if isinstance(v, str) or type(v).__name__ in ("bool", "bool_"):
            return str(v)
        try:
            return str(round(float(v), 6) + 0.0)
        except (TypeError, ValueError):
            return str(v)[:10]

    return sorted(tuple(one(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, small, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    ours, theirs = QUERIES[name](spark, small).toPandas(), con.execute(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert canonical(ours) == canonical(theirs)


def test_oracles_have_queries():
    assert set(ORACLES) <= set(QUERIES) and len(ORACLES) >= 70 and not math.isnan(len(QUERIES))


def test_rerun_is_the_same_at_other_partitions(spark, sf):
    before = canonical(QUERIES["ck_registry"](spark, sf).toPandas())
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert canonical(QUERIES["ck_registry"](spark, sf).toPandas()) == before
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
