"""Named queries over the driver's tables and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decision_queries, metagame_queries, model_queries, rule_queries, tournament_queries, variant_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**metagame_queries.QUERIES, **decision_queries.QUERIES, **rule_queries.QUERIES, **model_queries.QUERIES, **tournament_queries.QUERIES, **variant_queries.QUERIES}
ORACLE_SQL: dict[str, str] = {**metagame_queries.ORACLE_SQL, **decision_queries.ORACLE_SQL, **rule_queries.ORACLE_SQL, **tournament_queries.ORACLE_SQL, **variant_queries.ORACLE_SQL}
