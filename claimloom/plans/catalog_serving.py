"""Catalog: serving queries, sinks and audits over the claim and verdict tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.operators import audits, pairs, serving, similar, tables
from claimloom.plans import check_sql as sql
from claimloom.plans.catalog import Catalog, claims_n, judged_pairs
from claimloom.plans.catalog_review import CHECKPOINT, all_verdicts, checkpoint, evidence, evidence_claims
from claimloom.session import stage
from claimloom.sources import derived

catalog = Catalog()
add = catalog.add
KEY = ["document_id", "claim_a_id", "claim_b_id"]


def rule_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts of the structured pairs (a stored stage)."""
    return stage(spark, "verdicts", sf, lambda: judged_pairs(spark, sf))


def claim_documents(spark: SparkSession, sf: str) -> DataFrame:
    return claims_n(spark, sf).groupBy("document_id").agg(F.max("source_page").alias("page_count"))


_DOCS = "docs as (select document_id, max(source_page) as page_count from sides group by 1)"


# --- serving ---------------------------------------------------------------------------

@add("srv_01_visible_contradictions", f"""with {sql.JUDGED} select document_id, claim_a_id, claim_b_id, entity_a as entity_n, metric_a as metric_n,
  value_a, value_b, explanation, confidence from verdicts where status = 'verified' and classification = 'CONTRADICTION'
  and entity_a = entity_b and metric_a = metric_b""")
def visible_contradictions(spark, sf):
    """Visible contradictions per document with both values, in order."""
    found = serving.visible_contradictions(judged_pairs(spark, sf), claims_n(spark, sf))
    return serving.in_order(found).select(*KEY, F.col("entity_a").alias("entity_n"), F.col("metric_a").alias("metric_n"),
                                          "value_a", "value_b", "explanation", "confidence")


@add("srv_01_visible_counts", f"""with {sql.JUDGED} select document_id, count(*) as contradictions from verdicts
where classification = 'CONTRADICTION' group by 1""")
def visible_counts(spark, sf):
    found = serving.visible_contradictions(rule_verdicts(spark, sf), claims_n(spark, sf))
    return serving.per_document_count(found, "contradictions")


@add("srv_02_contradiction_detail", f"""with {sql.JUDGED}, chunks as ({sql.CHUNKS})
select v.document_id, v.claim_a_id, v.claim_b_id, a.claim_text as text_a, b.claim_text as text_b, a.source_page::bigint as page_a,
  ca.text as context_a, cb.text as context_b, ca.page_end::bigint as page_end_a,
  case when ca.text is null or cb.text is null then 'context_unavailable' end as problem
from verdicts v join sides a on a.document_id = v.document_id and a.claim_id = v.claim_a_id
join sides b on b.document_id = v.document_id and b.claim_id = v.claim_b_id
left join chunks ca on ca.document_id = v.document_id and ca.chunk_id = 'k' || substr(v.claim_a_id, 2)
left join chunks cb on cb.document_id = v.document_id and cb.chunk_id = 'k' || substr(v.claim_b_id, 2)
where v.classification = 'CONTRADICTION'""")
def contradiction_detail(spark, sf):
    detail = serving.contradiction_detail(rule_verdicts(spark, sf), evidence_claims(spark, sf), derived.order_chunks(spark, sf))
    return detail.select(*KEY, F.col("claim_a.claim_text").alias("text_a"), F.col("claim_b.claim_text").alias("text_b"),
                         F.col("claim_a.source_page").alias("page_a"), F.col("claim_a.context.text").alias("context_a"),
                         F.col("claim_b.context.text").alias("context_b"),
                         F.col("claim_a.context.page_end").alias("page_end_a"), "problem")


@add("srv_03_claim_page", f"""with {sql.SIDES} select document_id, claim_id, source_page::bigint as source_page, count(*) over () as total
from sides order by document_id, source_page, claim_id limit 50 offset 40""")
def claim_page(spark, sf):
    return serving.claim_page(claims_n(spark, sf), offset=40, limit=50).select("document_id", "claim_id", "source_page", "total")


@add("srv_04_progress", f"""with {sql.JUDGED}, chunks as ({sql.CHUNKS}), {_DOCS},
c as (select document_id, count(*) as chunks, count(*) filter (extraction_status = 'COMPLETED') as chunks_completed,
  count(*) filter (extraction_status = 'FAILED') as chunks_failed from chunks group by 1),
n as (select document_id, count(*) as claims from sides group by 1),
v as (select document_id, count(*) as verified_contradictions from verdicts where status = 'verified' and classification = 'CONTRADICTION' group by 1)
select document_id, page_count::bigint as pages, coalesce(chunks, 0) as chunks, coalesce(chunks_completed, 0) as chunks_completed,
  coalesce(chunks_failed, 0) as chunks_failed, coalesce(claims, 0) as claims, coalesce(verified_contradictions, 0) as verified_contradictions
from docs left join c using (document_id) left join n using (document_id) left join v using (document_id)""")
def progress(spark, sf):
    counts = serving.progress(claim_documents(spark, sf), derived.order_chunks(spark, sf), claims_n(spark, sf), rule_verdicts(spark, sf))
    return counts.withColumnRenamed("page_count", "pages")


@add("srv_04_chunk_status_pivot", f"""with chunks as ({sql.CHUNKS}) select document_id, count(*) filter (extraction_status = 'PENDING') as "PENDING",
  count(*) filter (extraction_status = 'COMPLETED') as "COMPLETED", count(*) filter (extraction_status = 'FAILED') as "FAILED" from chunks group by 1""")
def chunk_status_pivot(spark, sf):
    return serving.chunk_status_pivot(derived.order_chunks(spark, sf))


@add("srv_05_processing_summary", f"""with {CHECKPOINT}, {_DOCS},
c as (select document_id, count(*) as chunks, count(*) filter (extraction_status = 'FAILED') as failed_chunks from chunks group by 1),
n as (select document_id, count(*) as claims, count(vec_id) as embeddings_completed from sides left join embeddings on vec_id = cast(substr(claim_id, 2) as bigint) group by 1),
p as (select document_id, count(*) filter (is_structured) as deterministic_candidates, count(*) filter (is_semantic) as semantic_candidates,
  count(*) as candidates_before_filtering, count(*) filter (score >= 0.65) as candidates_after_filtering,
  count(*) filter (classification = 'CONTRADICTION') as verified_contradictions from all_scored group by 1),
q as (select document_id, 1 as external_requests from evidence where insufficient_reason is null group by 1)
select document_id, case when coalesce(failed_chunks, 0) > 0 and coalesce(claims, 0) = 0 then 'FAILED' else 'COMPLETED' end as status, page_count::bigint as pages, page_count::bigint as pages_processed, 25::bigint as page_batch_size,
  ceil(page_count / 25.0)::bigint as total_page_batches, coalesce(chunks, 0) as chunks, coalesce(claims, 0) as claims,
  coalesce(deterministic_candidates, 0) as deterministic_candidates, coalesce(semantic_candidates, 0) as semantic_candidates,
  coalesce(embeddings_completed, 0) as embeddings_completed, coalesce(claims - embeddings_completed, 0) as embeddings_failed, coalesce(claims, 0) as locally_extracted_facts,
  coalesce(candidates_before_filtering, 0) as candidates_before_filtering, coalesce(candidates_after_filtering, 0) as candidates_after_filtering,
  coalesce(external_requests, 0)::bigint as external_requests, coalesce(candidates_pending, 0) as candidates_pending, coalesce(candidates_after_filtering, 0) as candidates_total,
  coalesce(candidates_verified, 0) as candidates_verified, coalesce(candidates_failed, 0) as candidates_failed, coalesce(verified_contradictions, 0) as verified_contradictions
from docs left join c using (document_id) left join n using (document_id) left join p using (document_id) left join q using (document_id) left join checkpoint using (document_id)""")
def processing_summary(spark, sf):
    """Counters of every document, each from the rows it counts; claims without a usable vector are failed embeddings."""
    every = all_verdicts(spark, sf)
    kept = F.col("score") >= F.lit(pairs.SCORE_THRESHOLD)
    pair_counts = every.groupBy("document_id").agg(
        F.count_if("is_structured").alias("deterministic_candidates"), F.count_if("is_semantic").alias("semantic_candidates"),
        F.count(F.lit(1)).alias("candidates_before_filtering"), F.count_if(kept).alias("candidates_after_filtering"),
        F.count_if(serving.contradiction_filter()).alias("verified_contradictions"))
    requests = evidence(spark, sf).where("insufficient_reason is null").select("document_id").distinct().withColumn("external_requests", F.lit(1).cast("bigint"))
    vectors = derived.table(spark, sf, "embeddings").select(
        F.concat(F.lit("c"), F.lpad(F.col("vec_id").cast("string"), 10, "0")).alias("claim_id"), similar.vector_problem(F.col("embedding"), 64).isNull().alias("embedded"))
    claim_counts = claims_n(spark, sf).join(vectors, "claim_id", "left").groupBy("document_id").agg(
        F.count(F.lit(1)).alias("claims"), F.count_if("embedded").alias("embeddings_completed"), F.count_if(~F.coalesce("embedded", F.lit(False))).alias("embeddings_failed"))
    chunk_counts = derived.order_chunks(spark, sf).groupBy("document_id").agg(
        F.count(F.lit(1)).alias("chunks"), F.count_if(F.col("extraction_status") == "FAILED").alias("chunks_failed"))
    whole = serving.summaries(claim_documents(spark, sf), [chunk_counts, claim_counts, pair_counts, requests, checkpoint(spark, sf)])
    failed = (F.col("chunks_failed") > 0) & (F.col("claims") == 0)
    return whole.select(
        "document_id", F.when(failed, "FAILED").otherwise("COMPLETED").alias("status"), F.col("page_count").alias("pages"),
        F.col("page_count").alias("pages_processed"), "page_batch_size", "total_page_batches", "chunks", "claims",
        "deterministic_candidates", "semantic_candidates", "embeddings_completed", "embeddings_failed",
        F.col("claims").alias("locally_extracted_facts"), "candidates_before_filtering", "candidates_after_filtering",
        "external_requests", "candidates_pending", F.col("candidates_after_filtering").alias("candidates_total"),
        "candidates_verified", "candidates_failed", "verified_contradictions")


@add("srv_06_document_metadata", f"with r as ({sql.REGISTRY}) select document_id, filename, page_count::bigint as page_count, status from r")
def document_metadata(spark, sf):
    return serving.public_documents(derived.documents_registry(spark, sf))


@add("srv_07_eligible_documents", f"""with r as ({sql.REGISTRY}) select document_id, status from r
where status not in ('QUEUED','PARSING','CHUNKING','EXTRACTING_CLAIMS','NORMALIZING','GENERATING_CANDIDATES','VERIFYING','COMPLETED') and storage_path is not null""")
def eligible_documents(spark, sf):
    return serving.eligible_documents(derived.documents_registry(spark, sf)).select("document_id", "status")


@add("srv_07_queue_problems", f"""with r as ({sql.REGISTRY}) select document_id,
  case when status in ('QUEUED','PARSING','CHUNKING','EXTRACTING_CLAIMS','NORMALIZING','GENERATING_CANDIDATES','VERIFYING','COMPLETED')
       then 'already_processing_or_completed' when storage_path is null then 'source_unavailable' end as problem from r""")
def queue_problems(spark, sf):
    return derived.documents_registry(spark, sf).select("document_id", serving.queue_problem().alias("problem"))


@add("srv_08_error_listing", f"""with e as ({sql.ERRORS}) select stage, coalesce(category, 'none') as category, count(*) as errors,
  count(distinct document_id) as documents from e group by 1, 2""")
def error_listing(spark, sf):
    return serving.error_listing(derived.document_errors(spark, sf))


@add("srv_08_errors_on_resume", f"""with e as ({sql.ERRORS}) select stage, coalesce(category, 'none') as category, count(*) as errors,
  count(distinct document_id) as documents from e where stage <> 'VERIFYING' group by 1, 2""")
def errors_on_resume(spark, sf):
    return serving.error_listing(derived.document_errors(spark, sf), resuming=True)


@add("srv_09_failed_documents", f"""with r as ({sql.REGISTRY}), e as (select document_id, count(*) as errors from ({sql.ERRORS}) x group by 1),
c as (select 'u' || lpad(cast(o_custkey as varchar), 8, '0') as document_id, count(*) as claims from orders group by 1)
select document_id, coalesce(errors, 0) as errors, coalesce(claims, 0) as claims,
  case when status = 'CANCELLED' or coalesce(errors, 0) > 0 and coalesce(claims, 0) = 0 then 'FAILED' else 'CONTINUE' end as outcome
from r left join e using (document_id) left join c using (document_id)""")
def failed_documents(spark, sf):
    documents = derived.documents_registry(spark, sf).withColumn("blocked", F.col("status") == "CANCELLED")
    claims = derived.table(spark, sf, "orders").select(
        F.concat(F.lit("u"), F.lpad(F.col("o_custkey").cast("string"), 8, "0")).alias("document_id"))
    return serving.failed_documents(documents, derived.document_errors(spark, sf), claims).select(
        "document_id", "errors", "claims", "outcome")


@add("srv_10_review_screen", f"""with {sql.JUDGED} select document_id, claim_a_id, claim_b_id, floor(confidence * 100 + 0.5)::bigint as confidence_percent,
  'Unverified by rules' as badge from verdicts""")
def review_screen(spark, sf):
    return serving.review_screen(rule_verdicts(spark, sf)).select(*KEY, "confidence_percent", "badge")


@add("srv_10_stage_index", f"""with r as ({sql.REGISTRY}) select document_id, case status when 'PARSING' then 0 when 'CHUNKING' then 1
  when 'VERIFYING' then 4 when 'COMPLETED' then 5 when 'COMPLETED_WITH_WARNINGS' then 5 else 0 end::bigint as stage_index from r""")
def stage_index(spark, sf):
    return derived.documents_registry(spark, sf).select("document_id", serving.stage_index(F.col("status")).alias("stage_index"))


@add("srv_11_row_projections", f"""with {sql.SIDES} select claim_id, document_id, chunk_id, entity_raw, entity_n, metric_raw, metric_n, value_text,
  value_numeric::double as value_numeric, unit, period, scope, qualifier, claim_text, source_page::bigint as source_page, confidence::double as confidence from sides""")
def row_projections(spark, sf):
    return claims_n(spark, sf).select(*serving.CLAIM_FIELDS)


@add("srv_11_verdict_rows", f"""with {sql.JUDGED} select document_id, claim_a_id, claim_b_id, classification, explanation, confidence, status, source from verdicts""")
def verdict_rows(spark, sf):
    return rule_verdicts(spark, sf).select(*serving.VERDICT_FIELDS)


@add("srv_12_retry_class", f"""with r as ({sql.REGISTRY}) select document_id, status,
  case when status in ('CANCELLED','COMPLETED','COMPLETED_WITH_WARNINGS') then status when storage_path is null then 'FAILED' else 'RUN' end as outcome,
  case when status in ('CANCELLED','COMPLETED','COMPLETED_WITH_WARNINGS') then false else storage_path is null or status = 'FAILED' end as retryable,
  status in ('FAILED','COMPLETED_WITH_WARNINGS') as result_retryable,
  status in ('COMPLETED','COMPLETED_WITH_PENDING_VERIFICATION','COMPLETED_WITH_WARNINGS','FAILED','CANCELLED') as terminal from r""")
def retry_class(spark, sf):
    classed = serving.retry_class(derived.documents_registry(spark, sf))
    return classed.select("document_id", "status", "outcome", "retryable",
                          serving.result_retryable(F.col("status")).alias("result_retryable"), "terminal")


@add("srv_13_error_advice", f"""with e as ({sql.ERRORS}), f as (select *, row_number() over (partition by document_id
  order by case stage when 'EXTRACTING_CLAIMS' then 0 else 1 end, position) as n from e)
select document_id, stage, item_id, case
  when category = 'insufficient_quota' then coalesce(provider, 'The AI provider') || ' credits or spending limits blocked processing. Check the API project''s billing and limits, then retry.'
  when category = 'daily_quota' then coalesce(provider, 'The AI provider') || ' has reached its daily quota. Check its active limits, then retry after the quota resets.'
  when http_status = 429 then coalesce(provider, 'The AI provider') || ' returned HTTP 429. Check the API project''s credits and rate limits, then retry when access is available.'
  when http_status = 401 then coalesce(provider, 'The AI provider') || ' rejected the API key. Check the selected provider''s key, then restart.'
  when http_status = 403 then coalesce(provider, 'The AI provider') || ' cannot access the configured model. Check the selected provider''s model setting.'
  else message end as advice from f where n = 1""")
def error_advice(spark, sf):
    return serving.error_advice(derived.document_errors(spark, sf)).select("document_id", "stage", "item_id", "advice")


# --- sources on stored tables -------------------------------------------------------------

@add("src_11_chunks_in_order", f"""with c as ({sql.CHUNKS}) select document_id, chunk_id, page_start::bigint as page_start, page_end::bigint as page_end from c
order by document_id, page_start, page_end, chunk_id""")
def chunks_in_order(spark, sf):
    return tables.ordered_read(derived.order_chunks(spark, sf), ["page_start", "page_end", "chunk_id"]).select(
        "document_id", "chunk_id", "page_start", "page_end")


@add("src_12_claims_in_order", f"""with {sql.SIDES} select document_id, claim_id, source_page::bigint as source_page from sides
order by document_id, source_page, claim_id""")
def claims_in_order(spark, sf):
    return tables.ordered_read(claims_n(spark, sf), ["source_page", "claim_id"]).select("document_id", "claim_id", "source_page")


@add("src_13_document_by_id", f"""with r as ({sql.REGISTRY}) select document_id, filename, status from r where document_id = 'u00000042'""")
def document_by_id(spark, sf):
    return derived.documents_registry(spark, sf).where("document_id = 'u00000042'").select("document_id", "filename", "status")


# --- sinks ------------------------------------------------------------------------------------

@add("snk_02_chunk_hashes", f"with c as ({sql.CHUNKS}) select chunk_id, sha256(text) as content_hash from c")
def chunk_hashes(spark, sf):
    return tables.with_content_hash(derived.order_chunks(spark, sf)).select("chunk_id", "content_hash")


@add("snk_03_insert_once_claims", f"""with c as ({sql.CLAIMS})
select chunk_id, claim_id as extraction_key, case when source_page <= 5 then 'stored' else 'second' end as origin from c""")
def insert_once_claims(spark, sf):
    """A batch that repeats stored claims and itself: stored rows win, then the last of the batch."""
    claims = derived.order_claims(spark, sf).withColumn("extraction_key", F.col("claim_id"))
    stored = claims.where("source_page <= 5").select("chunk_id", "extraction_key", F.lit("stored").alias("origin"))
    batch = claims.select("chunk_id", "extraction_key", F.lit("first").alias("origin"), F.lit(1).alias("seq")).unionByName(
        claims.select("chunk_id", "extraction_key", F.lit("second").alias("origin"), F.lit(2).alias("seq")))
    added = tables.insert_once(stored, batch, ["chunk_id", "extraction_key"], "seq").drop("seq")
    return stored.unionByName(added)


@add("snk_04_insert_once_pairs", f"""with {sql.JUDGED} select document_id, claim_a_id, claim_b_id,
  case when score >= 0.65 then 'stored' else 'batch' end as origin from verdicts""")
def insert_once_pairs(spark, sf):
    judged = rule_verdicts(spark, sf)
    stored = judged.where("score >= 0.65").select(*KEY, F.lit("stored").alias("origin"))
    swapped = judged.select("document_id", F.col("claim_b_id").alias("x"), F.col("claim_a_id").alias("y"))
    batch = pairs.canonical_key(swapped, "x", "y").select(*KEY, F.lit("batch").alias("origin"))
    return stored.unionByName(tables.insert_once(stored, batch, KEY, "origin"))


@add("snk_05_upsert_verdicts", f"""with {sql.JUDGED} select document_id, claim_a_id, claim_b_id,
  case when score >= 0.65 then 'UNCERTAIN' else classification end as classification, case when score >= 0.65 then 'external' else 'rules' end as source from verdicts""")
def upsert_verdicts(spark, sf):
    stored = rule_verdicts(spark, sf).select(*KEY, "classification", "source", "score")
    changed = stored.where("score >= 0.65").withColumn("classification", F.lit("UNCERTAIN")).withColumn("source", F.lit("external"))
    return tables.upsert(stored, changed, KEY).select(*KEY, "classification", "source")


@add("snk_08_cascade_delete", f"""with {sql.JUDGED}, chunks as ({sql.CHUNKS})
select 'claims' as table_name, count(*) as rows_left from sides where document_id >= 'd0010'
union all select 'chunks', count(*) from chunks where document_id >= 'd0010'
union all select 'verdicts', count(*) from verdicts where document_id >= 'd0010'""")
def cascade_delete(spark, sf):
    deleted = claim_documents(spark, sf).where("document_id < 'd0010'")

    def left(df, name):
        return tables.without_documents(df, deleted).agg(F.count(F.lit(1)).alias("rows_left")).select(
            F.lit(name).alias("table_name"), "rows_left")

    return (left(claims_n(spark, sf), "claims").unionByName(left(derived.order_chunks(spark, sf), "chunks"))
            .unionByName(left(rule_verdicts(spark, sf), "verdicts")))


# --- audits -------------------------------------------------------------------------------------

_RAW = """documents_raw as (select 'c' || cast(c_custkey as varchar) as document_id, cast(floor(c_acctbal) as bigint) - 500 as page_count from customer),
lines as (select 'r' || cast(l_orderkey as varchar) as document_id, cast(l_partkey as varchar) || '-' || cast(l_suppkey as varchar) as row_id,
  l_linenumber - 1 as page_start, cast(l_quantity as int) as page_end, l_discount * 15 as claim_confidence, l_tax * 20 as verdict_confidence,
  cast(l_partkey as varchar) as x, cast(l_suppkey as varchar) as y from lineitem)"""


def _lines(spark, sf):
    text = {c: F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_suppkey")}
    return derived.table(spark, sf, "lineitem").select(
        F.concat(F.lit("r"), text["l_orderkey"]).alias("document_id"),
        F.concat_ws("-", text["l_partkey"], text["l_suppkey"]).alias("row_id"),
        (F.col("l_linenumber") - 1).alias("page_start"), F.col("l_quantity").cast("int").alias("page_end"),
        (F.col("l_discount") * 15).alias("claim_confidence"), (F.col("l_tax") * 20).alias("verdict_confidence"),
        text["l_partkey"].alias("x"), text["l_suppkey"].alias("y"))


@add("con_01_ranges", f"""with {_RAW}
select 'page_count_nonnegative' as rule, document_id, document_id as subject from documents_raw where page_count < 0
union all select 'valid_page_range', document_id, row_id from lines where page_start < 1 or page_end < page_start
union all select 'source_page_positive', document_id, row_id from lines where page_start < 1
union all select 'claim_confidence_range', document_id, row_id from lines where not claim_confidence between 0 and 1
union all select 'ordered_distinct_pair', document_id, x from lines where not x < y
union all select 'verdict_confidence_range', document_id, x from lines where not verdict_confidence between 0 and 1""")
def ranges(spark, sf):
    """The range rules over customers and line items read as documents, chunks, claims and verdicts."""
    lines = _lines(spark, sf)
    documents = derived.table(spark, sf, "customer").select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("document_id"),
        (F.floor("c_acctbal").cast("bigint") - 500).alias("page_count"))
    chunks = lines.select("document_id", F.col("row_id").alias("chunk_id"), "page_start", "page_end")
    claims = lines.select("document_id", F.col("row_id").alias("claim_id"), F.col("page_start").alias("source_page"),
                          F.col("claim_confidence").alias("confidence"))
    verdicts = lines.select("document_id", F.col("x").alias("claim_a_id"), F.col("y").alias("claim_b_id"),
                            F.col("verdict_confidence").alias("confidence"))
    return audits.range_violations(documents, chunks, claims, verdicts)


@add("con_02_references", f"""with {sql.JUDGED}, chunks as ({sql.CHUNKS}), kept as (select * from sides where source_page > 1)
select 'claim_without_chunk' as rule, k.document_id, k.claim_id as subject from kept k left join chunks c
  on c.document_id = k.document_id and c.chunk_id = 'k' || substr(k.claim_id, 2) where c.chunk_id is null
union all select 'verdict_without_claim_a', v.document_id, v.claim_a_id from verdicts v left join kept k
  on k.document_id = v.document_id and k.claim_id = v.claim_a_id where k.claim_id is null
union all select 'verdict_without_claim_b', v.document_id, v.claim_b_id from verdicts v left join kept k
  on k.document_id = v.document_id and k.claim_id = v.claim_b_id where k.claim_id is null""")
def references(spark, sf):
    kept = evidence_claims(spark, sf).where("source_page > 1")
    return audits.reference_violations(derived.order_chunks(spark, sf), kept, rule_verdicts(spark, sf))


@add("con_03_uniqueness", f"""with {_RAW}
select 'repeated_claim_id' as rule, row_id as subject, count(*) as n from lines group by document_id, row_id having count(*) > 1
union all select 'repeated_pair', x || '/' || y, count(*) from lines group by document_id, x, y having count(*) > 1
union all select 'repeated_extraction_key', y, count(*) from lines group by row_id, y having count(*) > 1""")
def uniqueness(spark, sf):
    lines = _lines(spark, sf)
    claims = lines.select("document_id", F.col("row_id").alias("claim_id"), F.col("row_id").alias("chunk_id"),
                          F.col("y").alias("extraction_key"))
    verdicts = lines.select("document_id", F.col("x").alias("claim_a_id"), F.col("y").alias("claim_b_id"))
    return audits.uniqueness_violations(claims, verdicts)


@add("con_03_lengths", """select 'too_long_entity_n' as rule, cast(doc_id as varchar) as subject from documents where length(text) > 255
union all select 'too_long_metric_n', cast(doc_id as varchar) from documents where length(lang) > 255
union all select 'too_long_unit', cast(doc_id as varchar) from documents where length(source) > 64
union all select 'too_long_period', cast(doc_id as varchar) from documents where length(text) > 128""")
def lengths(spark, sf):
    rows = derived.table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("claim_id"), F.col("text").alias("entity_n"), F.col("lang").alias("metric_n"),
        F.col("source").alias("unit"), F.col("text").alias("period"))
    return audits.length_violations(rows)


# --- incremental bookkeeping that is plain SQL ---------------------------------------------------

@add("str_01_page_batches", f"""with i as ({sql.ITEMS}), d as (select document_id, max(page_number) as pages from i group by 1)
select i.document_id, i.page_number::bigint as page_number, ((i.page_number - 1) // 25)::bigint as page_batch, ceil(d.pages / 25.0)::bigint as total_page_batches,
  (((i.page_number - 1) // 25) * 25 + 1)::bigint as batch_start, least(d.pages, ((i.page_number - 1) // 25) * 25 + 25)::bigint as batch_end, count(*) as items
from i join d using (document_id) group by all""")
def page_batches(spark, sf):
    from claimloom.operators.blocks import page_batch
    items = derived.report_items(spark, sf)
    pages = items.groupBy("document_id").agg(F.max("page_number").alias("pages"))
    per_page = items.groupBy("document_id", "page_number").agg(F.count(F.lit(1)).alias("items"))
    size = serving.PAGE_BATCH
    first = page_batch(F.col("page_number")) * size + 1
    return per_page.join(pages, "document_id").select(
        "document_id", "page_number", page_batch(F.col("page_number")).alias("page_batch"),
        F.ceil(F.col("pages") / F.lit(size)).cast("bigint").alias("total_page_batches"),
        first.alias("batch_start"), F.least(F.col("pages"), first + size - 1).alias("batch_end"), "items")


@add("str_07_latest_status", f"""with s as ({sql.STATUS}) select document_id, arg_max(status, seq) as status, max(seq) as seq from s group by 1""")
def latest_status(spark, sf):
    return serving.latest_status(derived.status_changes(spark, sf))


