"""Catalog: merged pairs, evidence, review queue, answers and final verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimloom.operators import pairs, verdicts
from claimloom.plans import check_sql as sql
from claimloom.plans.catalog import Catalog, candidates, claims_n, side_rows
from claimloom.session import materialize, stage
from claimloom.sources import derived, responses

catalog = Catalog()
add = catalog.add
KEY = ["document_id", "claim_a_id", "claim_b_id"]


def _key_number(column: str = "claim_id"):
    return F.substring(column, 2, 10).cast("bigint")


def links(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbour matches in both directions: each claim and the next one about the same entity."""
    following = Window.partitionBy("document_id", "entity_n").orderBy("claim_id")
    near = (side_rows(spark, sf).select("document_id", "entity_n", "claim_id").withColumn("k", _key_number())
            .withColumn("next_id", F.lead("claim_id").over(following)).where("next_id is not null"))
    forward = near.select("document_id", "claim_id", F.col("next_id").alias("neighbour_id"),
                          (F.lit(0.5) + (F.col("k") % 50).cast("double") / F.lit(100.0)).alias("similarity"))
    back = near.select("document_id", F.col("next_id").alias("claim_id"), F.col("claim_id").alias("neighbour_id"),
                       (F.lit(0.4) + (F.col("k") % 60).cast("double") / F.lit(100.0)).alias("similarity"))
    return forward.unionByName(back)


def structured(spark: SparkSession, sf: str) -> DataFrame:
    df = pairs.labelled(candidates(spark, sf))
    return df.select(*pairs.pair_ids(df), "preliminary_classification")


def merged(spark: SparkSession, sf: str) -> DataFrame:
    return pairs.merge_pairs(structured(spark, sf), pairs.best_similarity(links(spark, sf)))


def all_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Every merged pair scored and judged by the rules (a stored stage)."""
    def build():
        linked = pairs.pairs_by_key(pairs.best_similarity(links(spark, sf)), side_rows(spark, sf))
        return verdicts.judged_together(pairs.labelled(candidates(spark, sf)), linked)
    return stage(spark, "all_verdicts", sf, build)


def queue(spark: SparkSession, sf: str) -> DataFrame:
    """At most ten pairs per document (a stored stage, so that its size is known to the joins that meet it)."""
    def build():
        kept = pairs.above_threshold(all_verdicts(spark, sf))
        return verdicts.review_queue(kept).select(
            *KEY, verdicts.candidate_id().alias("candidate_id"), "score", "queue_rank")
    return stage(spark, "queue", sf, build)


def evidence_claims(spark: SparkSession, sf: str) -> DataFrame:
    return claims_n(spark, sf).withColumn("chunk_id", F.concat(F.lit("k"), F.substring("claim_id", 2, 10)))


def evidence(spark: SparkSession, sf: str) -> DataFrame:
    return verdicts.pair_evidence(queue(spark, sf), evidence_claims(spark, sf), derived.order_chunks(spark, sf))


def answers(queued: DataFrame) -> DataFrame:
    """Answers to the queue as an external checker might send them: some missing, doubled, invalid or unknown."""
    rank = F.col("queue_rank")
    first = queued.where(rank <= 8).select(
        "document_id", "candidate_id",
        F.when(rank == 1, F.lit("CONTRADICTION")).when(rank <= 4, F.lit("CONSISTENT")).otherwise(F.lit("UNCERTAIN")).alias("classification"),
        F.concat(F.lit("checked "), "candidate_id").alias("explanation"),
        F.when(rank == 3, F.lit(1.5)).otherwise(F.lit(0.7)).alias("confidence"))
    again = queued.where(rank == 2).select("document_id", "candidate_id", F.lit("CONSISTENT").alias("classification"),
                                           F.lit("again").alias("explanation"), F.lit(0.5).alias("confidence"))
    unknown = queued.select("document_id", F.concat("candidate_id", F.lit("x")).alias("candidate_id"),
                           F.lit("CONSISTENT").alias("classification"), F.lit("unknown id").alias("explanation"),
                           F.lit(0.5).alias("confidence"))
    return first.unionByName(again).unionByName(unknown)


def intake(spark: SparkSession, sf: str) -> DataFrame:
    return verdicts.take_answers(evidence(spark, sf), answers(queue(spark, sf)))


@add("pai_13_merged_pairs", f"""with {sql.LINKS} select document_id, claim_a_id, claim_b_id, preliminary_classification,
  similarity, is_structured, is_semantic from merged""")
def merged_pairs(spark, sf):
    return merged(spark, sf)


@add("pai_14_best_similarity", f"with {sql.LINKS} select document_id, claim_a_id, claim_b_id, similarity from semantic")
def best_similarity(spark, sf):
    return pairs.best_similarity(links(spark, sf))


@add("pai_15_set_measures", f"""with {sql.LINKS} select document_id, count(*) as pairs, count(*) filter (is_structured and is_semantic) as both_sets,
  count(*) filter (is_structured and not is_semantic) as structured_only, count(*) filter (is_semantic and not is_structured) as semantic_only
from merged group by 1""")
def set_measures(spark, sf):
    s, m = F.col("is_structured"), F.col("is_semantic")
    return merged(spark, sf).groupBy("document_id").agg(
        F.count(F.lit(1)).alias("pairs"), F.count_if(s & m).alias("both_sets"),
        F.count_if(s & ~m).alias("structured_only"), F.count_if(m & ~s).alias("semantic_only"))


@add("pai_16_scores_with_similarity", f"with {sql.LINKS} select document_id, claim_a_id, claim_b_id, score, classification from all_scored")
def scores_with_similarity(spark, sf):
    return all_verdicts(spark, sf).select(*KEY, "score", "classification")


@add("ver_05_pair_evidence", f"""with {sql.EVIDENCE} select document_id, claim_a_id, claim_b_id, claim_a_text, claim_b_text,
  chunk_a, chunk_b, section_a, section_b from evidence""")
def pair_evidence(spark, sf):
    def part(path):
        return F.get_json_object("evidence", f"$.{path}")

    return evidence(spark, sf).select(
        *KEY, part("claim_a.original_claim.claim_text").alias("claim_a_text"),
        part("claim_b.original_claim.claim_text").alias("claim_b_text"),
        part("claim_a.source_context.text").alias("chunk_a"), part("claim_b.source_context.text").alias("chunk_b"),
        part("claim_a.source_context.section").alias("section_a"), part("claim_b.source_context.section").alias("section_b"))


@add("ver_06_insufficient_context", f"with {sql.EVIDENCE} select document_id, claim_a_id, claim_b_id, insufficient_reason from evidence")
def insufficient_context(spark, sf):
    return evidence(spark, sf).select(*KEY, "insufficient_reason")


@add("ver_06_all_claim_grounding", f"""with {sql.EVIDENCE} select coalesce(problem, 'grounded') as problem, count(*) as claims from rec group by 1""")
def claim_grounding(spark, sf):
    """The same chunk checks for every claim, not only queued ones."""
    context = derived.order_chunks(spark, sf).select("document_id", "chunk_id", F.struct(
        "text", "page_start", "page_end").alias("context"))
    checked = evidence_claims(spark, sf).join(context, ["document_id", "chunk_id"], "left")
    problem = verdicts.chunk_problem(F.col("context"), F.col("source_page"), F.col("claim_text"))
    return checked.groupBy(F.coalesce(problem, F.lit("grounded")).alias("problem")).agg(F.count(F.lit(1)).alias("claims"))


@add("ver_07_stale_pairs", f"""with {sql.LINKS},
changed as (select document_id, claim_id, case when k % 29 = 3 then 'identity_mismatch' else 'stale_claim' end as problem
  from (select *, cast(substr(claim_id, 2) as bigint) as k from sides) where k % 29 = 3 or k % 31 = 5)
select document_id, claim_a_id, claim_b_id, min(problem) as problem from (
  select m.document_id, m.claim_a_id, m.claim_b_id, c.problem from merged m join changed c on c.document_id = m.document_id and c.claim_id in (m.claim_a_id, m.claim_b_id))
group by 1, 2, 3""")
def stale_pairs(spark, sf):
    """Claims re-read after an edit: some moved to another chunk, some with another value."""
    snapshot = claims_n(spark, sf)
    k = _key_number()
    stored = (snapshot.withColumn("chunk_id", F.when(k % 29 == 3, F.lit("moved")).otherwise(F.col("chunk_id")))
              .withColumn("value_numeric", F.when(k % 31 == 5, F.lit(-1).cast("decimal(24,8)")).otherwise(F.col("value_numeric"))))
    return verdicts.stale_pairs(merged(spark, sf), snapshot, stored)


@add("ver_08_review_queue", f"with {sql.LINKS} select document_id, claim_a_id, claim_b_id, candidate_id, score, queue_rank from queue")
def review_queue(spark, sf):
    return queue(spark, sf)


@add("ver_09_review_requests", f"""with {sql.EVIDENCE} select document_id, count(*) as candidates,
  string_agg(candidate_id, ',' order by queue_rank) as candidate_ids, 1::bigint as has_request from evidence where insufficient_reason is null group by 1""")
def review_requests(spark, sf):
    requests = verdicts.review_requests(evidence(spark, sf))
    sent = F.size(F.from_json("request", "candidates array<struct<candidate_id string, evidence string>>")["candidates"])
    return requests.select("document_id", "candidates", F.concat_ws(",", "candidate_ids").alias("candidate_ids"),
                           F.when(sent == F.col("candidates"), F.lit(1)).otherwise(F.lit(0)).alias("has_request"))


@add("ver_10_answer_intake", f"with {sql.EVIDENCE}, {sql.ANSWERS} select * from intake")
def answer_intake(spark, sf):
    return intake(spark, sf)


@add("src_10_verdict_responses", f"""with {sql.LINKS}, {sql.ANSWERS} select document_id, candidate_id, classification, explanation,
  confidence, confidence between 0 and 1 as valid from answers""")
def verdict_responses(spark, sf):
    """Answers read back from response documents: JSON text -> typed rows -> validity."""
    body = (answers(queue(spark, sf)).groupBy("document_id", F.pmod(F.xxhash64("candidate_id"), F.lit(16)).alias("part"))
            .agg(F.to_json(F.struct(F.collect_list(F.struct("candidate_id", "classification", "explanation", "confidence"))
                                    .alias("results"))).alias("response")))
    read = responses.read_verdict_responses(body).where("error is null")
    rows = read.select("document_id", F.explode("results").alias("r")).select("document_id", "r.*")
    return rows.withColumn("valid", verdicts.answer_is_valid())


@add("ver_11_merged_verdicts", f"""with {sql.EVIDENCE}, {sql.ANSWERS},
kept as (select document_id, claim_a_id, claim_b_id, 1 as k from all_scored where similarity > 0.9)
select s.document_id, s.claim_a_id, s.claim_b_id,
  case when i.intake = 'VERIFIED' then i.classification when kept.k is not null then 'TEMPORAL_DIFFERENCE' else s.classification end as classification,
  case when i.intake = 'VERIFIED' or kept.k is not null then 'external' else 'rules' end as source,
  case case when i.intake = 'VERIFIED' then i.classification when kept.k is not null then 'TEMPORAL_DIFFERENCE' else s.classification end
    when 'CONTRADICTION' then 'verified' when 'CONSISTENT' then 'dismissed' when 'INSUFFICIENT_CONTEXT' then 'needs_review' else 'contextual_difference' end as status
from all_scored s left join intake i on i.document_id = s.document_id and i.claim_a_id = s.claim_a_id and i.claim_b_id = s.claim_b_id
left join kept on kept.document_id = s.document_id and kept.claim_a_id = s.claim_a_id and kept.claim_b_id = s.claim_b_id""")
def merged_verdicts(spark, sf):
    """Rules, verdicts kept from an earlier external run, and new answers."""
    rules = all_verdicts(spark, sf)
    kept = rules.where(F.col("similarity") > 0.9).select(
        *KEY, F.lit("TEMPORAL_DIFFERENCE").alias("classification"), F.lit("earlier check").alias("explanation"),
        F.lit(0.8).cast("decimal(5,4)").alias("confidence"), F.lit("contextual_difference").alias("status"),
        F.lit("external").alias("source"))
    final = verdicts.merge_verdicts(rules, kept, intake(spark, sf))
    return final.select(*KEY, "classification", "source", "status")


CHECKPOINT = f"""{sql.EVIDENCE}, {sql.ANSWERS},
state as (select s.document_id, coalesce(i.intake, 'VERIFIED') as intake
  from all_scored s left join intake i on i.document_id = s.document_id and i.claim_a_id = s.claim_a_id and i.claim_b_id = s.claim_b_id
  where s.score >= 0.65),
checkpoint as (select document_id, count(*) filter (intake = 'VERIFIED') as candidates_verified, count(*) filter (intake = 'VERIFICATION_FAILED') as candidates_failed,
  count(*) filter (intake = 'VERIFICATION_PENDING') as candidates_pending from state group by 1)"""


def checkpoint(spark: SparkSession, sf: str) -> DataFrame:
    return verdicts.checkpoint_counts(verdicts.checkpoint_state(pairs.above_threshold(all_verdicts(spark, sf)), materialize(intake(spark, sf), "intake")))


@add("ver_12_checkpoint_counts", f"with {CHECKPOINT} select * from checkpoint")
def checkpoint_counts(spark, sf):
    return checkpoint(spark, sf)
