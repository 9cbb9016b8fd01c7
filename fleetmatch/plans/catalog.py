"""All registered queries of the matching operators, with their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fleetmatch.sources.fixtures import Inputs, duckdb

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Registers a function of Inputs as query ``name``; ``oracle`` is DuckDB SQL over the fixtures."""

    def register(make: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: make(Inputs(spark, sf_dir))
        if oracle:
            ORACLES[name] = duckdb(oracle)
        return make

    return register


from fleetmatch.plans import events, reports, spatial, state, streams  # noqa: E402, F401
