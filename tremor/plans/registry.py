"""Registry: every operator as a query over the test tables, with its SQL twin
where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tremor.plans.fixtures import Fixture
from tremor.plans.oracle import sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: the same queries over a fixture that the caller keeps
ON_FIXTURE: dict[str, Callable[[Fixture], DataFrame]] = {}


def query(name: str, oracle: str | None = None, **ctes: str):
    """Registers ``fn(Fixture) -> DataFrame`` under ``name``."""

    def deco(fn: Callable[[Fixture], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Fixture(spark, sf_dir))

        run.__name__ = name
        assert name not in QUERIES, name
        QUERIES[name] = run
        ON_FIXTURE[name] = fn
        if oracle is not None:
            ORACLES[name] = sql(oracle, **ctes)
        return fn

    return deco


def load_all() -> None:
    from tremor.plans import (  # noqa: F401
        q_evaluation,
        q_features,
        q_scalars,
        q_scoring,
        q_sources,
        q_streaming,
        q_views,
    )
