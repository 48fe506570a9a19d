"""Read side: contradictions, details, claim pages, progress, summaries and errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions.units import literal_map

# --- fixed values -----------------------------------------------------------
ACTIVE_STAGES = ["QUEUED", "PARSING", "CHUNKING", "EXTRACTING_CLAIMS", "NORMALIZING", "GENERATING_CANDIDATES", "VERIFYING"]
FINISHED = ["COMPLETED", "COMPLETED_WITH_PENDING_VERIFICATION", "COMPLETED_WITH_WARNINGS", "FAILED", "CANCELLED"]
STAGE_INDEX = {
    "UPLOADED": 0, "QUEUED": 0, "PARSING": 0, "CHUNKING": 1, "EXTRACTING_CLAIMS": 2, "NORMALIZING": 3,
    "GENERATING_CANDIDATES": 3, "EMBEDDING": 3, "SEMANTIC_RETRIEVAL": 3, "VERIFYING": 4, "COMPLETED": 5,
    "COMPLETED_WITH_WARNINGS": 5, "COMPLETED_WITH_PENDING_VERIFICATION": 5,
}
PAGE_LIMIT = 200
QUOTA_CATEGORIES = ["insufficient_quota", "credit_balance_exhausted", "organization_spend_limit_exceeded",
                    "project_spend_limit_exceeded", "organization_usage_limit_exceeded"]
PAGE_BATCH = 25
# ---------------------------------------------------------------------------

CLAIM_FIELDS = ["claim_id", "document_id", "chunk_id", "entity_raw", "entity_n", "metric_raw", "metric_n", "value_text",
                "value_numeric", "unit", "period", "scope", "qualifier", "claim_text", "source_page", "confidence"]
VERDICT_FIELDS = ["document_id", "claim_a_id", "claim_b_id", "classification", "explanation", "confidence", "status", "source"]


def contradiction_filter() -> Column:
    return (F.col("status") == "verified") & (F.col("classification") == "CONTRADICTION")


def visible_contradictions(verdicts: DataFrame, claims_n: DataFrame) -> DataFrame:
    """Verified contradictions whose claims exist in the document and share entity and metric."""
    def side(name):
        return claims_n.select("document_id", F.col("claim_id").alias(f"claim_{name}_id"),
                               F.col("entity_n").alias(f"entity_{name}"), F.col("metric_n").alias(f"metric_{name}"),
                               F.col("value_text").alias(f"value_{name}"))

    found = (verdicts.where(contradiction_filter())
             .join(side("a"), ["document_id", "claim_a_id"]).join(side("b"), ["document_id", "claim_b_id"]))
    return found.where((F.col("entity_a") == F.col("entity_b")) & (F.col("metric_a") == F.col("metric_b")))


def in_order(df: DataFrame) -> DataFrame:
    return df.orderBy("document_id", "claim_a_id", "claim_b_id")


def contradiction_detail(verdicts: DataFrame, claims: DataFrame, chunks: DataFrame) -> DataFrame:
    """Both claims with their source chunk as nested structs; ``problem`` marks a lost context."""
    context = chunks.select("document_id", "chunk_id", F.struct(
        "chunk_id", "page_start", "page_end", "section", "text").alias("context"))
    fields = [c for c in CLAIM_FIELDS if c in claims.columns]
    full = claims.join(context, ["document_id", "chunk_id"], "left").select(
        "document_id", "claim_id", F.struct(*[F.col(c) for c in fields], "context").alias("claim"))
    a = full.select("document_id", F.col("claim_id").alias("claim_a_id"), F.col("claim").alias("claim_a"))
    b = full.select("document_id", F.col("claim_id").alias("claim_b_id"), F.col("claim").alias("claim_b"))
    joined = (verdicts.where(contradiction_filter())
              .join(a, ["document_id", "claim_a_id"], "left").join(b, ["document_id", "claim_b_id"], "left"))
    lost = F.col("claim_a.context").isNull() | F.col("claim_b.context").isNull()
    return joined.withColumn("problem", F.when(lost, F.lit("context_unavailable")))


def claim_page(claims: DataFrame, offset: int = 0, limit: int = 50, document_id: str | None = None) -> DataFrame:
    """One page of claims in (document, page, id) order; every row carries the total."""
    if offset < 0 or not 1 <= limit <= PAGE_LIMIT:
        raise ValueError("offset must be >= 0 and limit between 1 and 200")
    rows = claims if document_id is None else claims.where(F.col("document_id") == document_id)
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    page = rows.orderBy("document_id", "source_page", "claim_id").offset(offset).limit(limit)
    return page.withColumn("total", total.scalar())


def per_document_count(df: DataFrame, name: str, condition: Column | None = None) -> DataFrame:
    rows = df if condition is None else df.where(condition)
    return rows.groupBy("document_id").agg(F.count(F.lit(1)).alias(name))


def progress(documents: DataFrame, chunks: DataFrame, claims: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Progress counters of every document; absent parts count as zero.

    The verified count here takes every verified contradiction, without comparing names.
    """
    chunk_counts = chunks.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("chunks"),
        F.count_if(F.col("extraction_status") == "COMPLETED").alias("chunks_completed"),
        F.count_if(F.col("extraction_status") == "FAILED").alias("chunks_failed"))
    parts = [chunk_counts, per_document_count(claims, "claims"),
             per_document_count(verdicts, "verified_contradictions", contradiction_filter())]
    result = documents
    for part in parts:
        result = result.join(part, "document_id", "left")
    return result.fillna(0, ["chunks", "chunks_completed", "chunks_failed", "claims", "verified_contradictions"])


def chunk_status_pivot(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("document_id").pivot("extraction_status", ["PENDING", "COMPLETED", "FAILED"]).count().fillna(0)


def summaries(documents: DataFrame, counts: list[DataFrame], page_batch: int = PAGE_BATCH) -> DataFrame:
    """Processing summary per document from per-stage aggregates keyed by document_id."""
    result = (documents.withColumn("page_batch_size", F.lit(page_batch))
              .withColumn("total_page_batches", F.ceil(F.col("page_count") / F.lit(page_batch)).cast("bigint")))
    names: list[str] = []
    for part in counts:
        names += [c for c in part.columns if c != "document_id"]
        result = result.join(part, "document_id", "left")
    return result.fillna(0, names)


def public_documents(documents: DataFrame) -> DataFrame:
    """Metadata without storage locations."""
    return documents.select(*[c for c in ["document_id", "filename", "page_count", "status", "created_at", "updated_at"]
                              if c in documents.columns])


def eligible_documents(documents: DataFrame) -> DataFrame:
    """Documents that may be queued: not active, not completed, source stored."""
    return documents.where(~F.col("status").isin(*ACTIVE_STAGES, "COMPLETED")
                           & (F.coalesce(F.col("storage_path"), F.lit("")) != ""))


def queue_problem() -> Column:
    return (F.when(F.col("status").isin(*ACTIVE_STAGES, "COMPLETED"), F.lit("already_processing_or_completed"))
            .when(F.coalesce(F.col("storage_path"), F.lit("")) == "", F.lit("source_unavailable")))


def error_listing(errors: DataFrame, resuming: bool = False) -> DataFrame:
    """Errors per stage and category; a resumed run forgets VERIFYING errors."""
    rows = errors.where(F.col("stage") != "VERIFYING") if resuming else errors
    return rows.groupBy("stage", F.coalesce("category", F.lit("none")).alias("category")).agg(
        F.count(F.lit(1)).alias("errors"), F.countDistinct("document_id").alias("documents"))


def failed_documents(documents: DataFrame, errors: DataFrame, claims: DataFrame) -> DataFrame:
    """A document fails when it was blocked, or has errors and no claims."""
    has = (documents.join(per_document_count(errors, "errors"), "document_id", "left")
           .join(per_document_count(claims, "claims"), "document_id", "left").fillna(0, ["errors", "claims"]))
    blocked = F.col("blocked") if "blocked" in documents.columns else F.lit(False)
    return has.withColumn("outcome", F.when(blocked | ((F.col("errors") > 0) & (F.col("claims") == 0)), F.lit("FAILED"))
                          .otherwise(F.lit("CONTINUE")))


def review_screen(verdicts: DataFrame) -> DataFrame:
    """Confidence percent and provenance badge of each finding."""
    return (verdicts.withColumn("confidence_percent", F.floor(F.col("confidence") * 100 + F.lit(0.5)).cast("bigint"))
            .withColumn("badge", F.when(F.col("source") == "external", F.lit("AI verified")).otherwise(F.lit("Unverified by rules"))))


def stage_index(status: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(STAGE_INDEX), status), F.lit(0))


def evaluated(counts: DataFrame) -> DataFrame:
    return counts.withColumn("candidates_evaluated", F.col("candidates_verified") + F.col("candidates_failed"))


def retry_class(documents: DataFrame) -> DataFrame:
    """Outcome of a job delivery per document, whether it may be retried, and terminal flag."""
    status = F.col("status")
    finished = status.isin("CANCELLED", "COMPLETED", "COMPLETED_WITH_WARNINGS")
    no_source = F.coalesce(F.col("storage_path"), F.lit("")) == ""
    return (documents
            .withColumn("outcome", F.when(finished, status).when(no_source, F.lit("FAILED")).otherwise(F.lit("RUN")))
            .withColumn("retryable", F.when(finished, F.lit(False)).otherwise(no_source | status.isin("FAILED")))
            .withColumn("terminal", status.isin(*FINISHED)))


def result_retryable(status: Column) -> Column:
    return status.isin("FAILED", "COMPLETED_WITH_WARNINGS")


def error_advice(errors: DataFrame) -> DataFrame:
    """The error shown for a document: first EXTRACTING_CLAIMS error, else the first, with advice."""
    order = F.struct(F.when(F.col("stage") == "EXTRACTING_CLAIMS", F.lit(0)).otherwise(F.lit(1)), F.col("position"))
    fields = ["stage", "item_id", "message", "category", "http_status", "provider"]
    chosen = (errors.groupBy("document_id").agg(F.min_by(F.struct(*fields), order).alias("e"))
              .select("document_id", "e.*"))
    who = F.when(F.col("provider").isNull(), F.lit("The AI provider")).otherwise(F.col("provider"))
    return chosen.withColumn(
        "advice",
        F.when(F.col("category").isin(QUOTA_CATEGORIES),
               F.concat(who, F.lit(" credits or spending limits blocked processing. Check the API project's billing and limits, then retry.")))
        .when(F.col("category") == "daily_quota", F.concat(
            who, F.lit(" has reached its daily quota. Check its active limits, then retry after the quota resets.")))
        .when(F.col("http_status") == 429, F.concat(
            who, F.lit(" returned HTTP 429. Check the API project's credits and rate limits, then retry when access is available.")))
        .when(F.col("http_status") == 401, F.concat(
            who, F.lit(" rejected the API key. Check the selected provider's key, then restart.")))
        .when(F.col("http_status") == 403, F.concat(
            who, F.lit(" cannot access the configured model. Check the selected provider's model setting.")))
        .otherwise(F.col("message")))


def advice_without_errors() -> str:
    return "Check the processing details and retry when the service is available."


def latest_status(changes: DataFrame) -> DataFrame:
    return changes.groupBy("document_id").agg(F.max_by("status", "seq").alias("status"), F.max("seq").alias("seq"))

