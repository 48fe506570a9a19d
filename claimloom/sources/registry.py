"""Metric registry: canonical metric names and their exact aliases."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.functions.text import clean_text, is_blank

# --- fixed values -----------------------------------------------------------
REGISTRY_VERSION = 1
METRIC_ALIASES = {
    "employee_count": ["number of employees", "employee count", "total employees", "employees", "headcount",
                       "head count", "no. of employees", "no of employees"],
    "shares": ["shares", "number of shares", "share count", "no. of shares"],
    "shares_outstanding": ["outstanding shares", "shares outstanding", "number of outstanding shares",
                           "total shares outstanding"],
    "revenue": ["revenue", "total revenue"],
    "revenue_from_operations": ["revenue from operations"],
    "total_income": ["total income"],
    "hospital_count": ["hospital count", "hospitals"],
    "licensed_bed_count": ["licensed bed", "licensed beds", "licensed bed count"],
}
CANONICAL_NAME = r"^[a-z][a-z0-9]*(?:_[a-z0-9]+)*$"
# ---------------------------------------------------------------------------


def read_metric_registry(path: str) -> dict[str, list[str]]:
    """Read a registry file; repeated keys, other versions and other fields are errors."""
    def unique(pairs):
        keys = [k for k, _ in pairs]
        repeated = sorted({k for k in keys if keys.count(k) > 1})
        if repeated:
            raise ValueError(f"repeated registry keys: {', '.join(repeated)}")
        return dict(pairs)

    with open(path, encoding="utf-8") as handle:
        body = json.load(handle, object_pairs_hook=unique)
    if set(body) != {"version", "metrics"}:
        raise ValueError("a registry holds exactly 'version' and 'metrics'")
    if type(body["version"]) is not int or body["version"] != REGISTRY_VERSION:
        raise ValueError(f"registry version must be {REGISTRY_VERSION}")
    for name, aliases in body["metrics"].items():
        if not isinstance(aliases, list) or not all(isinstance(a, str) for a in aliases):
            raise ValueError(f"aliases of {name} must be a list of strings")
    return body["metrics"]


def registry_rows(spark: SparkSession, metrics: dict[str, list[str]] | None = None) -> DataFrame:
    """One row per (canonical, alias), the canonical name itself included, with the cleaned key."""
    metrics = METRIC_ALIASES if metrics is None else metrics
    rows = [F.struct(F.lit(name).alias("canonical"), F.lit(alias).alias("alias")) for name, aliases in metrics.items() for alias in [name, *aliases]]
    listed = spark.range(1).select(F.inline(F.array(*rows)))  # constants, whose size the optimizer knows
    return listed.withColumn("alias_key", clean_text(F.col("alias")))


_checked: set[str] = set()


def alias_lookup(df: DataFrame, key: str, output: str, metrics: dict[str, list[str]] | None = None) -> DataFrame:
    """Add ``output`` = canonical metric of the cleaned text in ``key`` (null when unknown).

    A registry in which two metrics claim one alias is refused.  The rows are joined; how is Spark's choice by their size.
    """
    metrics = METRIC_ALIASES if metrics is None else metrics
    rows = registry_rows(df.sparkSession, metrics)
    version = json.dumps(metrics, sort_keys=True)
    if version not in _checked:
        conflicts = audit_registry(rows).where("rule = 'conflicting_alias'").select("subject").limit(5).collect()
        if conflicts:
            raise ValueError(f"aliases claimed by more than one metric: {', '.join(r.subject for r in conflicts)}")
        _checked.add(version)
    lookup = rows.select(F.col("alias_key").alias(key), F.col("canonical").alias(output)).distinct()
    return df.join(lookup, key, "left")


def audit_registry(rows: DataFrame) -> DataFrame:
    """Rules broken by registry rows (canonical, alias, alias_key): one row per violation."""
    names = rows.select("canonical").distinct().where(~F.col("canonical").rlike(CANONICAL_NAME)).select(
        F.lit("canonical_not_snake_case").alias("rule"), F.col("canonical").alias("subject"))
    blank = rows.where(is_blank(F.col("alias")) | (F.col("alias_key") == "")).select(
        F.lit("blank_alias").alias("rule"), F.col("canonical").alias("subject"))
    shared = (rows.groupBy("alias_key").agg(F.countDistinct("canonical").alias("n")).where("n > 1")
              .select(F.lit("conflicting_alias").alias("rule"), F.col("alias_key").alias("subject")))
    return names.unionByName(blank).unionByName(shared)
