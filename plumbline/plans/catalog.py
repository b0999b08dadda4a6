"""The list of registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    """Register a plan; ``sql`` is the same result in plain SQL on the same tables."""

    def keep(plan: Plan) -> Plan:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = plan
        if sql is not None:
            ORACLES[name] = sql
        return plan

    return keep


def load() -> None:
    """Import every module that registers queries."""
    from plumbline.plans import (  # noqa: F401
        estimator_queries,
        label_queries,
        metric_queries,
        registry_queries,
        signal_queries,
        solver_queries,
        source_queries,
        split_queries,
    )
