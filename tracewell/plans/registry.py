"""All queries of the reference's operators, with the SQL that DuckDB compares them with."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracewell.operators.hold import begin
from tracewell.plans import graphs, ingest, planning, scalars, scoring, traversals, views


def _alone(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A query with intermediate tables of its own."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        begin()
        return query(spark, sf_dir)

    return run


QUERIES: dict = {name: _alone(query) for name, query in {**scoring.QUERIES, **graphs.QUERIES, **scalars.QUERIES, **ingest.QUERIES, **traversals.QUERIES, **views.QUERIES, **planning.QUERIES}.items()}
ORACLES: dict[str, str] = {**scoring.ORACLES, **graphs.ORACLES, **scalars.ORACLES, **ingest.ORACLES, **traversals.ORACLES, **views.ORACLES, **planning.ORACLES}
