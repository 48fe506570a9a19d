"""Integrity rules as queries: each audit returns the rows that break a rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.operators.tables import repeated_keys

# --- fixed values -----------------------------------------------------------
LENGTH_LIMITS = {"entity_n": 255, "metric_n": 255, "unit": 64, "period": 128}
# ---------------------------------------------------------------------------


def _broken(df: DataFrame, rule: str, ok: Column, subject: str) -> DataFrame:
    """A rule is broken only when its predicate is false; unknown (null) passes, as in SQL CHECK."""
    return df.where(~F.coalesce(ok, F.lit(True))).select(
        F.lit(rule).alias("rule"), "document_id", F.col(subject).alias("subject"))


def range_violations(documents: DataFrame, chunks: DataFrame, claims: DataFrame, verdicts: DataFrame) -> DataFrame:
    c = F.col
    parts = [
        _broken(documents, "page_count_nonnegative", c("page_count") >= 0, "document_id"),
        _broken(chunks, "valid_page_range", (c("page_start") >= 1) & (c("page_end") >= c("page_start")), "chunk_id"),
        _broken(claims, "source_page_positive", c("source_page") >= 1, "claim_id"),
        _broken(claims, "claim_confidence_range", c("confidence").between(0, 1), "claim_id"),
        _broken(verdicts, "ordered_distinct_pair", c("claim_a_id") < c("claim_b_id"), "claim_a_id"),
        _broken(verdicts, "verdict_confidence_range", c("confidence").between(0, 1), "claim_a_id"),
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def reference_violations(chunks: DataFrame, claims: DataFrame, verdicts: DataFrame) -> DataFrame:
    orphan_claims = claims.join(chunks.select("document_id", "chunk_id"), ["document_id", "chunk_id"], "left_anti").select(
        F.lit("claim_without_chunk").alias("rule"), "document_id", F.col("claim_id").alias("subject"))
    keys = claims.select("document_id", "claim_id")

    def orphan(side):
        return verdicts.join(keys.withColumnRenamed("claim_id", side), ["document_id", side], "left_anti").select(
            F.lit(f"verdict_without_{side[:-3]}").alias("rule"), "document_id", F.col(side).alias("subject"))

    return orphan_claims.unionByName(orphan("claim_a_id")).unionByName(orphan("claim_b_id"))


def uniqueness_violations(claims: DataFrame, verdicts: DataFrame) -> DataFrame:
    ids = repeated_keys(claims, ["document_id", "claim_id"]).select(
        F.lit("repeated_claim_id").alias("rule"), F.col("claim_id").alias("subject"), "n")
    pairs = repeated_keys(verdicts, ["document_id", "claim_a_id", "claim_b_id"]).select(
        F.lit("repeated_pair").alias("rule"), F.concat_ws("/", "claim_a_id", "claim_b_id").alias("subject"), "n")
    result = ids.unionByName(pairs)
    if "extraction_key" in claims.columns:
        result = result.unionByName(repeated_keys(claims, ["chunk_id", "extraction_key"]).select(
            F.lit("repeated_extraction_key").alias("rule"), F.col("extraction_key").alias("subject"), "n"))
    return result


def length_violations(claims: DataFrame, limits: dict[str, int] = LENGTH_LIMITS) -> DataFrame:
    too_long = F.array_compact(F.array(*[
        F.when(F.length(name) > limit, F.lit(name)) for name, limit in limits.items()]))
    return claims.withColumn("field", F.explode(too_long)).select(
        F.concat(F.lit("too_long_"), "field").alias("rule"), F.col("claim_id").alias("subject"))
