"""Strict JSON responses of external extractors and chunk records from JSON files."""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
RESPONSE_FIELDS = ["entity_raw", "entity_normalized", "metric_raw", "metric_normalized", "value_text", "value_numeric", "unit",
                   "period", "scope", "qualifier", "claim_text", "source_page", "confidence"]
REQUIRED_FIELDS = ["entity_raw", "entity_normalized", "metric_raw", "metric_normalized", "value_text", "claim_text", "source_page"]
VERDICT_FIELDS = ["candidate_id", "classification", "explanation", "confidence"]
# ---------------------------------------------------------------------------

CLAIM = "struct<" + ",".join(f"{n}:{'bigint' if n == 'source_page' else 'string'}" for n in RESPONSE_FIELDS) + ">"
CHUNK_SCHEMA = ("chunk_id string, page_start int, page_end int, section string, block_types array<string>, text string, "
                "source_block_ids array<string>, estimated_token_count int, metadata string, _corrupt string")


class _Number(str):
    """A JSON number kept as written, so that no digit is lost."""


def _no_repeats(pairs):
    keys = [key for key, _ in pairs]
    if len(set(keys)) != len(keys):
        raise ValueError("duplicate_field")
    return dict(pairs)


def _constant(name):
    raise ValueError("non_finite_number")


def _strict(text: str) -> tuple[str | None, str | None]:
    """(error, claims as JSON with numbers as text) of one response."""
    try:
        body = json.loads(text, parse_float=_Number, parse_int=_Number, parse_constant=_constant, object_pairs_hook=_no_repeats)
    except json.JSONDecodeError:
        return "malformed_json", None
    except ValueError as problem:
        return str(problem), None
    if not isinstance(body, dict) or set(body) != {"claims"} or not isinstance(body["claims"], list):
        return "unexpected_fields", None
    for claim in body["claims"]:
        if not isinstance(claim, dict) or not set(claim) <= set(RESPONSE_FIELDS) or not set(REQUIRED_FIELDS) <= set(claim):
            return "unexpected_fields", None
        for name, value in claim.items():
            number = isinstance(value, _Number)
            if name == "source_page":
                if not number or not value.lstrip("-").isdigit():
                    return "wrong_type", None
                claim[name] = int(value)
            elif value is not None and (not isinstance(value, str) or (number and name not in ("value_numeric", "confidence"))):
                return "wrong_type", None
    return None, json.dumps(body["claims"])


def _strict_batch(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_strict(t) for t in text], columns=["error", "claims"])


def strict_claims(text: Column) -> Column:
    return F.pandas_udf(_strict_batch, "struct<error:string,claims:string>")(text)


def read_claim_responses(df: DataFrame, column: str = "response") -> DataFrame:
    """Add ``error`` and typed ``claims``.  ``from_json`` alone keeps the last of repeated keys, so it cannot be the check."""
    checked = df.withColumn("_r", strict_claims(F.col(column)))
    return checked.withColumn("error", F.col("_r.error")).withColumn(
        "claims", F.from_json("_r.claims", f"array<{CLAIM}>")).drop("_r")


def _strict_verdicts(text: str | None) -> tuple[str | None, str | None]:
    """(error, results as JSON) of one verdict response: exactly the known fields, each once, of their types."""
    try:
        body = json.loads(text or "", parse_constant=_constant, object_pairs_hook=_no_repeats)
    except json.JSONDecodeError:
        return "malformed_json", None
    except ValueError as problem:
        return str(problem), None
    results = body.get("results") if isinstance(body, dict) and set(body) == {"results"} else None
    if not isinstance(results, list) or any(not isinstance(r, dict) or set(r) != set(VERDICT_FIELDS) for r in results):
        return "unexpected_fields", None
    for r in results:
        texts = all(isinstance(r[f], str) for f in VERDICT_FIELDS[:3])
        if not texts or isinstance(r["confidence"], bool) or not isinstance(r["confidence"], (int, float)):
            return "wrong_type", None
        if not math.isfinite(r["confidence"]):
            return "non_finite_number", None
    return None, json.dumps(results)


def _strict_verdict_batch(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_strict_verdicts(t) for t in text], columns=["error", "results"])


def read_verdict_responses(df: DataFrame, column: str = "response") -> DataFrame:
    """Add ``error`` and typed ``results`` of external verdicts; a response with any fault is refused whole."""
    checked = df.withColumn("_r", F.pandas_udf(_strict_verdict_batch, "struct<error:string,results:string>")(F.col(column)))
    kind = "array<struct<candidate_id:string,classification:string,explanation:string,confidence:double>>"
    return checked.withColumn("error", F.col("_r.error")).withColumn("results", F.from_json("_r.results", kind)).drop("_r")


def claim_response(fields: dict[str, Column]) -> Column:
    """JSON text of a one-claim response."""
    return F.to_json(F.struct(F.array(F.struct(*[c.alias(n) for n, c in fields.items()])).alias("claims")), {"ignoreNullFields": "false"})


def read_chunk_records(spark: SparkSession, path: str) -> DataFrame:
    """Chunk records from JSON lines; records that do not parse are kept in ``_corrupt``."""
    return (spark.read.schema(CHUNK_SCHEMA).option("columnNameOfCorruptRecord", "_corrupt").option("mode", "PERMISSIVE").json(path))
