"""All queries of the library but those of the training-data part."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from corpusloom.plans import corpus_queries, group_queries, layer_queries, numeric_queries, source_queries, time_queries
from corpusloom.session import ship

_ALL = corpus_queries.QUERIES | group_queries.QUERIES | numeric_queries.QUERIES | layer_queries.QUERIES | source_queries.QUERIES | time_queries.QUERIES


def _ready(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {name: _ready(query) for name, (query, _) in _ALL.items()}
ORACLE_SQL = {name: sql for name, (_, sql) in _ALL.items() if sql}
