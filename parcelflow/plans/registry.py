"""Where queries and their SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from parcelflow.plans.derived import Derived

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None, observed: bool | None = None) -> Callable:
    """Registers a query; with `observed` given it gets the derived frames, else the session and the folder."""

    def add(f: Callable) -> Callable:
        run = f if observed is None else lambda spark, sf_dir: f(Derived(spark, sf_dir, observed))
        QUERIES[f.__name__] = run
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add
