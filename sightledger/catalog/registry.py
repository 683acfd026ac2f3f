from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from sightledger.plans.views import Views
from sightledger.session import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register fn(views) under a name, with its SQL twin when there is one."""
    def wrap(fn: Callable[[Views], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Views(ship(spark), sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap
