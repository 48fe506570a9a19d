"""Catalog: normalization, pairing, scoring and rule verdicts over the derived claims."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimloom.functions import periods, text
from claimloom.operators import normalize, pairs, verdicts
from claimloom.plans import check_sql as sql
from claimloom.plans.catalog import Catalog, candidates, claims_n, judged_pairs, side_rows
from claimloom.sources import derived, registry

catalog = Catalog()
add = catalog.add
A, B = pairs.A, pairs.B


# --- normalization ------------------------------------------------------------------

@add("nrm_01_clean_text", f"""
with claims as ({sql.CLAIMS}) select claim_id, {sql.clean('entity_raw')} as entity_clean, {sql.clean('unit')} as unit_clean from claims
union all select 't' || cast(doc_id as varchar), {sql.clean("text")}, lang from documents""")
def clean_text(spark, sf):
    claims = derived.order_claims(spark, sf).select(
        "claim_id", text.clean_text(F.col("entity_raw")).alias("entity_clean"), text.clean_text(F.col("unit")).alias("unit_clean"))
    documents = derived.table(spark, sf, "documents").select(
        F.concat(F.lit("t"), F.col("doc_id").cast("string")).alias("claim_id"),
        text.clean_text(F.col("text")).alias("entity_clean"), F.col("lang").alias("unit_clean"))
    return claims.unionByName(documents)


@add("nrm_01_clean_text_nfc", "select doc_id, nfc_normalize(text) as text_nfc from documents")
def nfc(spark, sf):
    return derived.table(spark, sf, "documents").select("doc_id", text.nfc(F.col("text")).alias("text_nfc"))


@add("nrm_02_entity_names", f"with claims as ({sql.CLAIMS}) select claim_id, {sql.entity('entity_raw')} as entity_n from claims")
def entity_names(spark, sf):
    return derived.order_claims(spark, sf).select("claim_id", text.entity_name(F.col("entity_raw")).alias("entity_n"))


_ALIASES = """select 'Customer ' || cast(c_custkey as varchar) || ' Private Limited' as alias,
  'Group ' || cast(c_nationkey as varchar) || ' Holdings Ltd.' as canonical from customer where c_nationkey < 5"""


def _aliases(spark, sf):
    return derived.table(spark, sf, "customer").where("c_nationkey < 5").select(
        F.concat(F.lit("Customer "), F.col("c_custkey").cast("string"), F.lit(" Private Limited")).alias("alias"),
        F.concat(F.lit("Group "), F.col("c_nationkey").cast("string"), F.lit(" Holdings Ltd.")).alias("canonical"))


@add("nrm_03_entity_aliases", f"""
with {sql.NORM}, al as (select {sql.entity('alias')} as k, {sql.entity('canonical')} as target from ({_ALIASES}) x)
select claim_id, coalesce(target, entity_n) as entity_n from norm left join al on entity_n = k""")
def entity_aliases(spark, sf):
    """Aliases of every customer of five nations onto a group name."""
    named = normalize.normalize_claims(derived.order_claims(spark, sf), entity_aliases=_aliases(spark, sf))
    return named.select("claim_id", "entity_n")


@add("nrm_03_alias_conflicts", f"""
select k as alias_key, count(distinct target) as targets from (
  select {sql.entity("'The ' || c_mktsegment || ' Inc.'")} as k, {sql.entity("'nation ' || cast(c_nationkey as varchar)")} as target from customer) x
group by 1 having count(distinct target) > 1""")
def alias_conflicts(spark, sf):
    aliases = derived.table(spark, sf, "customer").select(
        F.concat(F.lit("The "), F.col("c_mktsegment"), F.lit(" Inc.")).alias("alias"),
        F.concat(F.lit("nation "), F.col("c_nationkey").cast("string")).alias("canonical"))
    return normalize.entity_alias_conflicts(aliases)


@add("nrm_04_metric_registry", f"with {sql.NORM} select claim_id, metric_n from norm")
def metric_registry(spark, sf):
    return normalize.normalize_claims(derived.order_claims(spark, sf)).select("claim_id", "metric_n")


@add("nrm_05_registry_audit", f"""
with r as (select p_type as canonical, p_brand as alias, {sql.clean('p_brand')} as alias_key from part)
select 'canonical_not_snake_case' as rule, canonical as subject from (select distinct canonical from r)
 where not regexp_full_match(canonical, '[a-z][a-z0-9]*(?:_[a-z0-9]+)*')
union all select 'conflicting_alias', alias_key from r group by alias_key having count(distinct canonical) > 1""")
def registry_audit(spark, sf):
    """The registry rules applied to part types (as names) and brands (as aliases)."""
    rows = derived.table(spark, sf, "part").select(
        F.col("p_type").alias("canonical"), F.col("p_brand").alias("alias"), text.clean_text(F.col("p_brand")).alias("alias_key"))
    return registry.audit_registry(rows)


@add("nrm_06_units", f"""with {sql.NORM} select claim_id, unit as raw, unit_canonical as canonical, unit_dimension as dimension,
  unit_base as base_unit, cast(unit_scale as double) as scale, unit_known as recognized from norm""")
def unit_structs(spark, sf):
    return normalize.normalize_claims(derived.order_claims(spark, sf)).select("claim_id", "unit_n.*")


_SHAPED, _VALUE = sql.date_of("regexp_replace(period_text, '^year ended ', '')")


@add("nrm_07_dates", f"""
with p as ({sql.PERIODS}), q as (select *, trim(regexp_replace(lower(period), '\\s+', ' ', 'g')) as period_text from p where period is not null)
select claim_id, {_SHAPED} as shaped, cast({_VALUE} as varchar) as date_value from q""")
def dates(spark, sf):
    parsed = periods.with_date(derived.period_texts(spark, sf).where("period is not null"), "period", "d")
    return parsed.select("claim_id", "d.shaped", F.col("d.value").cast("string").alias("date_value"))


@add("nrm_08_periods", f"""
with texts as ({sql.PERIODS}), {sql.period_steps('texts')}
select claim_id, period as raw, case when period_error is null then period_name end as canonical,
  case when period_error is null then period_kind end as kind, cast(fiscal_year as bigint) as fiscal_year,
  cast(case when period_error is null then start_date end as varchar) as start_date,
  cast(case when period_error is null then end_date end as varchar) as end_date, period_error as error from p3""")
def period_structs(spark, sf):
    return (periods.with_period(derived.period_texts(spark, sf), "period", "p")
            .select("claim_id", F.col("period").alias("raw"), "p.canonical", "p.kind", "p.fiscal_year", "p.start_date",
                    "p.end_date", "p.error"))


@add("nrm_08_periods_with_policy", f"""
with texts as ({sql.PERIODS}), {sql.period_steps('texts')},
f as (select claim_id, case when length(fiscal_digits) = 4 then cast(fiscal_digits as int) else 2000 + cast(fiscal_digits as int) end as y
      from p3 where fiscal_digits <> '')
select claim_id, 'FY' || cast(y as varchar) as canonical, cast(y as bigint) as fiscal_year,
  cast(make_date(y - 1, 4, 1) as varchar) as start_date, cast(make_date(y, 3, 31) as varchar) as end_date from f""")
def period_policy(spark, sf):
    fiscal = derived.period_texts(spark, sf).where(F.lower("period").startswith("f"))
    policy = periods.PeriodPolicy(two_digit_century=2000, fiscal_year_end_month=3, fiscal_year_end_day=31, resolve_fiscal_dates=True)
    return periods.with_period(fiscal, "period", "p", policy).select(
        "claim_id", "p.canonical", "p.fiscal_year", "p.start_date", "p.end_date")


@add("nrm_09_normalized_claims", f"""with {sql.NORM} select document_id, chunk_id, claim_id, entity_raw, entity_n, metric_raw, metric_n,
  unit_canonical, period_kind, period_name, cast(value_numeric as double) as value_numeric from norm where period_error is null""")
def normalized(spark, sf):
    return claims_n(spark, sf).select(
        "document_id", "chunk_id", "claim_id", "entity_raw", "entity_n", "metric_raw", "metric_n",
        F.col("unit_n.canonical").alias("unit_canonical"), F.col("period_n.kind").alias("period_kind"),
        F.col("period_n.canonical").alias("period_name"), "value_numeric")


def _damaged(spark, sf):
    """The derived claims with the period spellings of nrm_08 and some blank names and units."""
    key = F.substring("claim_id", 2, 10).cast("bigint")
    spelled = derived.period_texts(spark, sf)
    return (derived.order_claims(spark, sf).drop("period").join(spelled, "claim_id")
            .withColumn("entity_raw", F.when(key % 97 == 5, F.lit(" . ")).otherwise(F.col("entity_raw")))
            .withColumn("metric_raw", F.when(key % 89 == 7, F.lit("  ")).otherwise(F.col("metric_raw")))
            .withColumn("unit", F.when(key % 83 == 11, F.lit(" ;")).otherwise(F.col("unit"))))


_REJECTS = f"""
texts as ({sql.PERIODS}), {sql.period_steps('texts')},
r as (select c.document_id, c.claim_id, case when k % 97 = 5 then 'blank_entity' when k % 89 = 7 then 'blank_metric'
        when k % 83 = 11 then 'blank_unit' else period_error end as reason
      from (select *, cast(substr(claim_id, 2) as bigint) as k from ({sql.CLAIMS}) x) c join p3 on c.claim_id = p3.claim_id)"""


@add("nrm_10_quarantine", f"""with {_REJECTS} select document_id, 'NORMALIZING' as stage, claim_id as item_id,
  'invalid_value' as error_type, reason as message from r where reason is not null""")
def quarantine(spark, sf):
    return normalize.rejected(normalize.normalize_claims(_damaged(spark, sf)))


@add("nrm_10_quarantine_counts", f"""with {_REJECTS} select document_id, count(*) as claims,
  count(*) filter (reason is not null) as rejected, count(*) filter (reason is null) as normalized from r group by 1""")
def quarantine_counts(spark, sf):
    return normalize.normalize_claims(_damaged(spark, sf)).groupBy("document_id").agg(
        F.count(F.lit(1)).alias("claims"), F.count_if(F.col("reject_reason").isNotNull()).alias("rejected"),
        F.count_if(F.col("reject_reason").isNull()).alias("normalized"))


# --- pairing --------------------------------------------------------------------------

@add("pai_01_distinct_records", f"with c as ({sql.CLAIMS}) select claim_id, claim_text from c")
def distinct_records(spark, sf):
    """Every record twice in, once out."""
    claims = derived.order_claims(spark, sf)
    return pairs.distinct_records(claims.unionByName(claims)).select("claim_id", "claim_text")


@add("pai_02_pairing_guards", f"""with {sql.NORM}, g as (select *, cast(substr(claim_id, 2) as bigint) as k from norm)
select case when k % 61 = 3 then null else document_id end as document_id, claim_id,
  case when k % 61 = 3 then 'missing_document' when k % 67 = 5 then 'blank_entity' else 'blank_metric' end as violation
from g where k % 61 = 3 or k % 67 = 5 or k % 71 = 7""")
def pairing_guards(spark, sf):
    key = F.substring("claim_id", 2, 10).cast("bigint")
    damaged = (claims_n(spark, sf).withColumn("document_id", F.when(key % 61 != 3, F.col("document_id")))
               .withColumn("entity_n", F.when(key % 67 == 5, F.lit(" ")).otherwise(F.col("entity_n")))
               .withColumn("metric_n", F.when(key % 71 == 7, F.lit("")).otherwise(F.col("metric_n"))))
    return pairs.guard_violations(damaged)


@add("pai_03_blocked_pairs", f"with {sql.PAIRS} select document_id, claim_a_id, claim_b_id from pairs")
def blocked_pairs(spark, sf):
    df = candidates(spark, sf)
    return df.select(*pairs.pair_ids(df))


@add("pai_03_block_sizes", f"""with {sql.NORM} select document_id, entity_n, metric_n, count(*) as claims
from norm where period_error is null group by 1, 2, 3""")
def block_sizes(spark, sf):
    """Size of every block, so the cost of a hot block is visible before pairing."""
    return claims_n(spark, sf).groupBy(*pairs.KEYS).agg(F.count(F.lit(1)).alias("claims"))


@add("pai_04_labels", f"with c as ({sql.CLAIMS}) select claim_id, {sql.label('claim_text')} as text_label, {sql.label('scope')} as scope_label from c")
def labels(spark, sf):
    return derived.order_claims(spark, sf).select(
        "claim_id", text.label(F.col("claim_text")).alias("text_label"), text.label(F.col("scope")).alias("scope_label"))


@add("pai_05_period_relation", f"with {sql.PAIRS} select document_id, claim_a_id, claim_b_id, period_relation from pairs")
def period_relation(spark, sf):
    df = candidates(spark, sf)
    return df.select(*pairs.pair_ids(df), pairs.period_relation().alias("period_relation"))


@add("pai_06_unit_relation", f"""with {sql.PAIRS} select document_id, claim_a_id, claim_b_id, unit_relation,
  cast(case when unit_relation = 'same' then coalesce(a.unit_scale, 1) else 1 end as double) as scale_a,
  cast(case when unit_relation = 'same' then coalesce(b.unit_scale, 1) else 1 end as double) as scale_b from pairs""")
def unit_relation(spark, sf):
    df = candidates(spark, sf).withColumn("unit_relation", pairs.unit_relation())
    same = F.col("unit_relation") == "same"
    return df.select(*pairs.pair_ids(df), "unit_relation",
                     F.when(same, A["unit_scale"]).otherwise(F.lit(1)).alias("scale_a"),
                     F.when(same, B["unit_scale"]).otherwise(F.lit(1)).alias("scale_b"))


@add("pai_07_scaled_values", f"with {sql.SIDES} select claim_id, cast(base_value as varchar) as base_value from sides")
def scaled_values(spark, sf):
    return side_rows(spark, sf).select("claim_id", F.col("base_value").cast("string").alias("base_value"))


@add("pai_08_disagreeing_pairs", f"""with {sql.PAIRS} select document_id, count(*) as pairs,
  count(distinct claim_a_id) as first_claims, count(distinct claim_b_id) as second_claims from pairs group by 1""")
def disagreeing_pairs(spark, sf):
    df = candidates(spark, sf)
    return df.select(*pairs.pair_ids(df)).groupBy("document_id").agg(
        F.count(F.lit(1)).alias("pairs"), F.countDistinct("claim_a_id").alias("first_claims"),
        F.countDistinct("claim_b_id").alias("second_claims"))


@add("pai_09_qualified_pairs", f"with {sql.PAIRS} select document_id, claim_a_id, claim_b_id, {sql.QUALIFIED} as qualified from pairs")
def qualified_pairs(spark, sf):
    df = candidates(spark, sf)
    return df.select(*pairs.pair_ids(df), pairs.qualified().alias("qualified"))


@add("pai_10_preliminary_class", f"with {sql.LABELLED} select document_id, claim_a_id, claim_b_id, preliminary_classification from classed")
def preliminary_class(spark, sf):
    df = pairs.labelled(candidates(spark, sf))
    return df.select(*pairs.pair_ids(df), "preliminary_classification")


@add("pai_10_class_counts", f"""with {sql.LABELLED} select document_id, preliminary_classification, count(*) as pairs
from classed group by 1, 2""")
def class_counts(spark, sf):
    """Counts per class from distinct comparison rows; the pairs themselves are never produced."""
    return pairs.candidate_counts(side_rows(spark, sf))


_REASON = f"""concat_ws(' ',
  case when period_relation = 'temporal' then 'Different reporting periods; a value change across time is not itself a contradiction.' end,
  case when a.scope_label is distinct from b.scope_label then 'Scope differs or is missing; do not assume the populations match.' end,
  case when {sql.QUALIFIED} then 'Qualifiers need review for reporting basis, bounds, approximation or conditions.' end,
  case when unit_relation <> 'same' then 'Units are incompatible or missing; values cannot be directly compared.'
       when a.value_numeric is not null and b.value_numeric is not null then 'Numeric values differ after exact conversion to the same unit scale.'
       else 'Textual or mixed values differ; semantic verification is needed.' end,
  case when period_relation in ('unknown', 'different_basis') then 'Reporting periods are missing, ambiguous or expressed on different bases.' end,
  case when a.scope_label is null and b.scope_label is null then 'Neither claim states its scope.' end,
  case when preliminary_classification = 'candidate_contradiction' then 'Entity, metric, period, scope and unit match; qualifiers do not indicate uncertainty or a basis difference.' end)"""


@add("pai_11_reasons", f"with {sql.LABELLED} select document_id, claim_a_id, claim_b_id, {_REASON} as reason_for_candidate from classed")
def reasons(spark, sf):
    df = pairs.labelled(candidates(spark, sf))
    return df.select(*pairs.pair_ids(df), "reason_for_candidate")


@add("pai_12_pair_keys", """select 'o' || cast(l_orderkey as varchar) as document_id,
  least(cast(l_partkey as varchar), cast(l_suppkey as varchar)) as claim_a_id,
  greatest(cast(l_partkey as varchar), cast(l_suppkey as varchar)) as claim_b_id, count(*) as seen
from lineitem where l_partkey <> l_suppkey group by 1, 2, 3""")
def pair_keys(spark, sf):
    raw = derived.table(spark, sf, "lineitem").where("l_partkey <> l_suppkey").select(
        F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("document_id"),
        F.col("l_partkey").cast("string").alias("x"), F.col("l_suppkey").cast("string").alias("y"))
    return (pairs.canonical_key(raw, "x", "y").groupBy("document_id", "claim_a_id", "claim_b_id")
            .agg(F.count(F.lit(1)).alias("seen")))


@add("pai_16_scores", f"with {sql.JUDGED} select document_id, claim_a_id, claim_b_id, score from verdicts")
def scores(spark, sf):
    df = pairs.scored(candidates(spark, sf))
    return df.select(*pairs.pair_ids(df), "score")


@add("pai_17_ranked_candidates", f"""with {sql.JUDGED} select document_id, claim_a_id, claim_b_id, score,
  row_number() over (partition by document_id order by score desc, claim_a_id, claim_b_id) as position from verdicts where score >= 0.65""")
def ranked(spark, sf):
    df = pairs.above_threshold(pairs.scored(candidates(spark, sf)))
    return pairs.ranked(df.select(*pairs.pair_ids(df), "score"))


@add("pai_17_threshold_counts", f"""with {sql.JUDGED} select document_id, count(*) filter (score >= 0.65) as kept,
  count(*) filter (score < 0.65) as rejected from verdicts group by 1""")
def threshold_counts(spark, sf):
    keep = F.col("score") >= F.lit(pairs.SCORE_THRESHOLD)
    return pairs.scored(candidates(spark, sf)).select("document_id", "score").groupBy("document_id").agg(
        F.count_if(keep).alias("kept"), F.count_if(~keep).alias("rejected"))


# --- verdicts ---------------------------------------------------------------------------

@add("ver_01_rule_verdicts", f"""with {sql.JUDGED} select document_id, claim_a_id, claim_b_id, classification, confidence, explanation
from verdicts""")
def rule_verdicts(spark, sf):
    return judged_pairs(spark, sf).select("document_id", "claim_a_id", "claim_b_id", "classification", "confidence", "explanation")


def _negated(spark, sf):
    """Claims without values whose texts differ by customer only, some negated, some opposite."""
    key = F.substring("claim_id", 2, 10).cast("bigint")
    words = F.when(key % 4 == 0, F.lit(" was not approved")).when(key % 4 == 1, F.lit(" was approved")).when(
        key % 4 == 2, F.lit(" was rejected")).otherwise(F.lit(" never grew"))
    statement = F.concat(F.lit("Plan"), words)
    return (derived.order_claims(spark, sf).withColumn("value_numeric", F.lit(None).cast("decimal(24,8)"))
            .withColumn("period", F.lit(None).cast("string"))
            .withColumn("value_text", F.concat(F.lit("v"), (key % 3).cast("string"))).withColumn("claim_text", statement))


_TEXT_SIDES = f"""base as ({sql.CLAIMS}),
t as (select document_id, claim_id, {sql.entity('entity_raw')} as entity_n, {sql.clean('metric_raw')} as metric_key,
  'v' || cast(k % 3 as varchar) as value_text,
  'plan' || case k % 4 when 0 then ' was not approved' when 1 then ' was approved' when 2 then ' was rejected' else ' never grew' end as txt
  from (select *, cast(substr(claim_id, 2) as bigint) as k from base) x),
s as (select *, {sql.METRIC_CASE} as metric_n, regexp_matches(txt, '\\b(?:not|never)\\b') as negated,
  trim(regexp_replace(regexp_replace(txt, '\\b(?:not|never)\\b', '', 'g'), '\\s+', ' ', 'g')) as plain_text from t)
"""
_TEXT_PAIRS = f"""with {_TEXT_SIDES}
select a.document_id, a.claim_id as claim_a_id, b.claim_id as claim_b_id, {{0}} from s a join s b
on a.document_id = b.document_id and a.entity_n = b.entity_n and a.metric_n = b.metric_n and a.claim_id < b.claim_id
where a.value_text <> b.value_text"""


@add("ver_02_negation", _TEXT_PAIRS.format("a.negated <> b.negated and a.plain_text = b.plain_text as negation_differs"))
def negation(spark, sf):
    df = pairs.candidate_pairs(normalize.accepted(normalize.normalize_claims(_negated(spark, sf))))
    return df.select(*pairs.pair_ids(df), verdicts.negation_differs().alias("negation_differs"))


@add("ver_03_opposite_terms", _TEXT_PAIRS.format("""a.txt like '%approved%' and b.txt like '%rejected%'
  or a.txt like '%rejected%' and b.txt like '%approved%' as opposite_terms"""))
def opposite_terms(spark, sf):
    df = pairs.candidate_pairs(normalize.accepted(normalize.normalize_claims(_negated(spark, sf))))
    return df.select(*pairs.pair_ids(df), verdicts.opposite_terms().alias("opposite_terms"))


@add("ver_04_status", f"with {sql.JUDGED} select document_id, classification, status, count(*) as pairs from verdicts group by 1, 2, 3")
def status(spark, sf):
    return judged_pairs(spark, sf).groupBy("document_id", "classification", "status").agg(F.count(F.lit(1)).alias("pairs"))
