"""Helpers of the query catalog: result typing and the shared inputs of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (ByteType, DateType, DecimalType, FloatType, IntegerType, ShortType,
                               TimestampNTZType, TimestampType)

from claimloom.operators import normalize, pairs, verdicts
from claimloom.session import prepare, stage
from claimloom.sources import derived

Query = Callable[[SparkSession, str], DataFrame]


class Catalog:
    """Named queries, each with the SQL that must give the same rows (or none)."""

    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.checks: dict[str, str] = {}

    def add(self, name: str, check: str | None = None):
        def register(query: Query) -> Query:
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                return plain_types(query(prepare(spark), sf_dir))

            run.__doc__ = query.__doc__
            self.queries[name] = run
            if check is not None:
                self.checks[name] = check
            return query
        return register


def plain_types(df: DataFrame) -> DataFrame:
    """Wide integers, doubles and text only, so results compare across engines."""
    def plain(field):
        kind, column = field.dataType, F.col(f"`{field.name}`")
        if isinstance(kind, (ByteType, ShortType, IntegerType)):
            return column.cast("bigint").alias(field.name)
        if isinstance(kind, (DecimalType, FloatType)):
            return column.cast("double").alias(field.name)
        if isinstance(kind, (DateType, TimestampType, TimestampNTZType)):
            return column.cast("string").alias(field.name)
        return column
    return df.select(*[plain(f) for f in df.schema.fields])


def claims_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted normalized claims of the orders table (a stored stage)."""
    return stage(spark, "claims_n", sf_dir, lambda: normalize.accepted(
        normalize.normalize_claims(derived.order_claims(spark, sf_dir))))


def side_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comparison rows of the claims (a stored stage)."""
    return stage(spark, "sides", sf_dir, lambda: pairs.sides(claims_n(spark, sf_dir)))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.pairs_of(side_rows(spark, sf_dir))


def judged_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts.judged(pairs.scored(candidates(spark, sf_dir)))
