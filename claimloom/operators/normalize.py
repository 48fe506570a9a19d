"""Claim normalization: one projection over the claims, no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.functions.periods import PeriodPolicy, with_period
from claimloom.functions.text import clean_text, entity_name
from claimloom.functions.units import with_unit
from claimloom.sources.registry import alias_lookup


def entity_alias_table(aliases: DataFrame) -> DataFrame:
    """(alias, canonical) text -> cleaned (alias_key, target); conflicting keys keep no target."""
    cleaned = aliases.select(entity_name(F.col("alias")).alias("alias_key"), entity_name(F.col("canonical")).alias("target"))
    return cleaned.groupBy("alias_key").agg(F.min("target").alias("target"), F.countDistinct("target").alias("targets"))


def entity_alias_conflicts(aliases: DataFrame) -> DataFrame:
    return entity_alias_table(aliases).where("targets > 1").select("alias_key", F.col("targets").cast("bigint").alias("targets"))


def normalize_claims(claims: DataFrame, *, metrics: dict[str, list[str]] | None = None,
                     entity_aliases: DataFrame | None = None,
                     policy: PeriodPolicy = PeriodPolicy()) -> DataFrame:
    """Add ``entity_n, metric_n, unit_n, period_n, reject_reason`` to every claim.

    The original columns are kept.  Rows that cannot be normalized carry a reason
    instead of failing the job; see :func:`accepted` and :func:`rejected`.
    """
    texts = (claims
             .withColumn("entity_n", entity_name(F.col("entity_raw")))
             .withColumn("metric_key", clean_text(F.col("metric_raw"))))
    texts = with_period(with_unit(texts, "unit", "unit_n"), "period", "period_n", policy)
    if entity_aliases is not None:
        lookup = entity_alias_table(entity_aliases).withColumnRenamed("alias_key", "entity_n")
        texts = (texts.join(lookup, "entity_n", "left")
                 .withColumn("alias_conflict", F.coalesce(F.col("targets"), F.lit(0)) > 1)
                 .withColumn("entity_n", F.coalesce("target", "entity_n")).drop("target", "targets"))
    else:
        texts = texts.withColumn("alias_conflict", F.lit(False))
    named = alias_lookup(texts, "metric_key", "metric_canonical", metrics)
    reason = F.coalesce(
        F.when(F.col("alias_conflict"), F.lit("conflicting_entity_alias")),
        F.when(F.coalesce(F.col("entity_n"), F.lit("")) == "", F.lit("blank_entity")),
        F.when(F.coalesce(F.col("metric_key"), F.lit("")) == "", F.lit("blank_metric")),
        F.col("unit_n_error"),
        F.col("period_n.error"),
    )
    made = F.struct(
        F.col("entity_n"), F.coalesce("metric_canonical", F.replace("metric_key", F.lit(" "), F.lit("_"))).alias("metric_n"),
        F.col("unit_n"), F.col("period_n"), reason.alias("reject_reason"))
    # One struct per claim out of a generator: a later filter on its fields is applied to the
    # finished row, where a plain projection would have the whole parse repeated inside the filter.
    return named.select(*claims.columns, F.explode(F.array(made)).alias("_n")).select(*claims.columns, "_n.*")


def accepted(normalized: DataFrame) -> DataFrame:
    return normalized.where(F.col("reject_reason").isNull()).drop("reject_reason")


def rejected(normalized: DataFrame) -> DataFrame:
    """Quarantined claims as error rows of the NORMALIZING stage."""
    return normalized.where(F.col("reject_reason").isNotNull()).select(
        "document_id", F.lit("NORMALIZING").alias("stage"), F.col("claim_id").alias("item_id"),
        F.lit("invalid_value").alias("error_type"), F.col("reject_reason").alias("message"))
