"""DuckDB text of the shared steps, used to check the Spark queries on the same tables."""

from __future__ import annotations

from claimloom.sources import derived

CLAIMS = derived.duckdb_view(derived.order_claims_sql, "orders")
CHUNKS = derived.duckdb_view(derived.order_chunks_sql, "orders")
PERIODS = derived.duckdb_view(derived.period_texts_sql, "orders")
ITEMS = derived.duckdb_view(derived.report_items_sql, "lineitem")
STATUS = derived.duckdb_view(derived.status_changes_sql, "events")
REGISTRY = derived.duckdb_view(derived.documents_registry_sql, "customer")
ERRORS = derived.duckdb_view(derived.errors_sql, "events")


def clean(x: str) -> str:
    """Cleaned text; the dash step runs twice because matches may share a letter."""
    dash = r"'([\pL\pM\pN_])[‐‑–—-]([\pL\pM\pN_])', '\1 \2', 'g'"
    return (f"trim(regexp_replace(regexp_replace(regexp_replace(lower(nfc_normalize({x})), '[_\\s]+', ' ', 'g'), "
            f"{dash}), {dash}), ' .,:;')")


def label(x: str) -> str:
    return f"nullif(trim(regexp_replace(lower({x}), '\\s+', ' ', 'g')), '')"


def entity(x: str) -> str:
    text = f"regexp_replace({clean(x)}, '^(?:the|this)\\s+', '')"
    for short, full in [("pvt", "private"), ("ltd", "limited"), ("inc", "incorporated")]:
        text = f"regexp_replace({text}, '\\b{short}\\.?\\b\\.?', '{full}', 'g')"
    return text


METRIC_CASE = """case metric_key
  when 'employee count' then 'employee_count' when 'number of employees' then 'employee_count'
  when 'total employees' then 'employee_count' when 'employees' then 'employee_count'
  when 'headcount' then 'employee_count' when 'head count' then 'employee_count'
  when 'no. of employees' then 'employee_count' when 'no of employees' then 'employee_count'
  when 'shares' then 'shares' when 'number of shares' then 'shares' when 'share count' then 'shares'
  when 'no. of shares' then 'shares'
  when 'shares outstanding' then 'shares_outstanding' when 'outstanding shares' then 'shares_outstanding'
  when 'number of outstanding shares' then 'shares_outstanding' when 'total shares outstanding' then 'shares_outstanding'
  when 'revenue' then 'revenue' when 'total revenue' then 'revenue'
  when 'revenue from operations' then 'revenue_from_operations' when 'total income' then 'total_income'
  when 'hospital count' then 'hospital_count' when 'hospitals' then 'hospital_count'
  when 'licensed bed' then 'licensed_bed_count' when 'licensed beds' then 'licensed_bed_count'
  when 'licensed bed count' then 'licensed_bed_count'
  else replace(metric_key, ' ', '_') end"""

UNIT_STEPS = r"""
    regexp_extract(unit_text, '^(inr|₹|indian rupees?|usd|us\$|eur|€|gbp|£)\s*(.*)$', 1) as unit_money,
    rtrim(regexp_extract(unit_text, '^(inr|₹|indian rupees?|usd|us\$|eur|€|gbp|£)\s*(.*)$', 2), '.') as unit_suffix"""

UNIT_BASE = """case when unit_money in ('inr', '₹', 'indian rupee', 'indian rupees') then 'INR'
     when unit_money in ('usd', 'us$') then 'USD' when unit_money in ('eur', '€') then 'EUR'
     when unit_money in ('gbp', '£') then 'GBP' end"""
UNIT_WORD = """case when unit_suffix = '' then '' when unit_suffix in ('crore', 'crores', 'cr') then 'crore'
     when unit_suffix in ('million', 'millions', 'mn') then 'million' when unit_suffix in ('lakh', 'lakhs') then 'lakh'
     when unit_suffix = 'thousand' then 'thousand' when unit_suffix = 'billion' then 'billion' end"""
UNIT_PLAIN = """case when unit_text in ('%', 'percent', 'percentage', 'per cent', 'pct') then 'percent'
     when unit_text in ('percentage point', 'percentage points', 'pp') then 'percentage_point'
     when unit_text in ('basis point', 'basis points', 'bps') then 'basis_point'
     when unit_text in ('employee', 'employees') then 'employees'
     when unit_text in ('person', 'people', 'persons') then 'persons'
     when unit_text in ('share', 'shares') then 'shares' end"""
UNIT_FACTOR = """cast(case money_word when '' then 1 when 'crore' then 10000000 when 'million' then 1000000 when 'lakh' then 100000
     when 'thousand' then 1000 when 'billion' then 1000000000 end as decimal(13,2))"""

MONTH_NUMBER = """(case substr({0}, 1, 3) when 'jan' then 1 when 'feb' then 2 when 'mar' then 3 when 'apr' then 4 when 'may' then 5
  when 'jun' then 6 when 'jul' then 7 when 'aug' then 8 when 'sep' then 9 when 'oct' then 10 when 'nov' then 11 when 'dec' then 12 end)"""
MONTH_WORDS = ("('january','february','march','april','may','june','july','august','september','october','november','december',"
               "'jan','feb','mar','apr','jun','jul','aug','sep','oct','nov','dec')")


def date_of(x: str) -> tuple[str, str]:
    """(shaped, date) of a cleaned date text."""
    a, b = r"'^([a-z]+)\.? (\d{1,2}),? (\d{4})$'", r"'^(\d{1,2}) ([a-z]+)\.? (\d{4})$'"
    iso = f"regexp_matches({x}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$')"
    first = f"regexp_extract({x}, {a}, 1) in {MONTH_WORDS}"
    second = f"regexp_extract({x}, {b}, 2) in {MONTH_WORDS}"

    def made(y, m, d):
        return f"try_cast({y} || '-' || lpad(cast({m} as varchar), 2, '0') || '-' || lpad({d}, 2, '0') as date)"

    value = (f"case when {iso} then try_cast({x} as date) "
             f"when {first} then {made(f'regexp_extract({x}, {a}, 3)', MONTH_NUMBER.format(f'regexp_extract({x}, {a}, 1)'), f'regexp_extract({x}, {a}, 2)')} "
             f"when {second} then {made(f'regexp_extract({x}, {b}, 3)', MONTH_NUMBER.format(f'regexp_extract({x}, {b}, 2)'), f'regexp_extract({x}, {b}, 1)')} end")
    return f"({iso} or {first} or {second})", value


_SHAPED, _DATE = date_of("period_text")
_ENDED_SHAPED, _ENDED = date_of("regexp_extract(period_text, '^year ended (.+)$', 1)")
FISCAL = r"'^(?:fy|fiscal year|financial year)\s*''?([0-9]{2}|[0-9]{4})$'"


def period_steps(source: str) -> str:
    """CTEs ``p1`` and ``p2`` over a relation with a ``period`` column."""
    return rf"""
p1 as (select *, trim(regexp_replace(lower(period), '\s+', ' ', 'g')) as period_text from {source}),
p2 as (select *, regexp_extract(period_text, {FISCAL}, 1) as fiscal_digits,
       {_SHAPED} as is_date, {_DATE} as exact_date, {_ENDED_SHAPED} as is_ended, {_ENDED} as ended_date,
       regexp_matches(period_text, '^\d{{4}}-\d{{2}}$') as is_iso_month,
       try_cast(period_text || '-01' as date) as iso_month_day,
       regexp_matches(period_text, '^\d{{4}}$') as is_year from p1),
p3 as (select *,
       case when period_text is null then null when fiscal_digits <> '' then 'fiscal_year' when is_ended then 'year_ended'
            when is_date then 'date' when is_iso_month then 'month' when is_year then 'year' else 'unknown' end as period_kind,
       case when fiscal_digits <> '' then 'FY' || fiscal_digits
            when is_ended then 'year_ended:' || cast(ended_date as varchar) when is_date then cast(exact_date as varchar)
            when is_iso_month then substr(cast(iso_month_day as varchar), 1, 7) else period_text end as period_name,
       case when length(fiscal_digits) = 4 then cast(fiscal_digits as int) end as fiscal_year,
       case when is_iso_month and not is_date then iso_month_day end as start_date,
       case when is_ended then ended_date when is_date then exact_date when is_iso_month then last_day(iso_month_day) end as end_date,
       case when is_ended and ended_date is null or is_date and exact_date is null and not is_ended
              or is_iso_month and iso_month_day is null
              or is_year and period_text = '0000' then 'invalid_period' end as period_error from p2)"""


NORM = f"""claims as ({CLAIMS}),
n1 as (select *, {entity('entity_raw')} as entity_n, {clean('metric_raw')} as metric_key, {clean('unit')} as unit_text from claims),
n2 as (select *, {METRIC_CASE} as metric_n, {UNIT_STEPS} from n1),
n3 as (select *, {UNIT_BASE} as money_base, {UNIT_WORD} as money_word, {UNIT_PLAIN} as plain_unit from n2),
n4 as (select *, money_base is not null and money_word is not null as is_money from n3),
n5 as (select *,
       case when unit is null then null when is_money then trim(money_base || ' ' || money_word)
            else coalesce(plain_unit, unit_text) end as unit_canonical,
       case when is_money then 'currency' else case plain_unit when 'percent' then 'ratio' when 'percentage_point' then 'percentage_point'
            when 'basis_point' then 'percentage_point' when 'employees' then 'count' when 'persons' then 'count'
            when 'shares' then 'count' end end as unit_dimension,
       case when is_money then money_base else case plain_unit when 'percent' then 'ratio' when 'basis_point' then 'percentage_point'
            else plain_unit end end as unit_base,
       case when is_money then {UNIT_FACTOR} else cast(case plain_unit when 'percent' then 0.01 when 'basis_point' then 0.01
            when 'percentage_point' then 1 when 'employees' then 1 when 'persons' then 1 when 'shares' then 1 end as decimal(13,2)) end as unit_scale,
       case when unit is not null then is_money or plain_unit is not null end as unit_known
       from n4),
{period_steps('n5')},
norm as (select * from p3)"""

SIDES = f"""{NORM},
sides as (select *,
  {label('scope')} as scope_label, nullif(trim(lower(scope)), '') as scope_key, {label('qualifier')} as qualifier_label,
  {label('value_text')} as value_label,
  cast(value_numeric as decimal(24,8)) * cast(coalesce(unit_scale, 1) as decimal(13,2)) as base_value,
  coalesce(period_name, period) as reporting_date,
  case when unit is null then null when unit_known then 'known' || unit_dimension || unit_base else 'as written' || unit_canonical end as unit_key,
  case when qualifier is null then true else len(list_filter(regexp_split_to_array({label('qualifier')}, '\\s*[;,]\\s*'),
       lambda x: x not in ('actual', 'standalone', 'consolidated', 'audited'))) = 0 end as qualifier_plain,
  regexp_matches(lower(claim_text), '\\b(?:not|no|never|without|failed to)\\b|n''t') as negated,
  trim(regexp_replace(regexp_replace(lower(claim_text), '\\b(?:not|no|never|without|failed to)\\b|n''t', '', 'g'), '\\s+', ' ', 'g')) as plain_text,
  lower(claim_text) as lower_text
  from norm where period_error is null)"""

AGREE = """(case when a.value_numeric is not null and b.value_numeric is not null then
    case when a.unit_key is null or b.unit_key is null then a.value_numeric = b.value_numeric
         when a.unit_key = b.unit_key then a.base_value = b.base_value else false end
  when a.value_numeric is null and b.value_numeric is null then a.value_label is not distinct from b.value_label
  else false end)"""
UNIT_REL = "case when a.unit_key is null or b.unit_key is null then 'unknown' when a.unit_key = b.unit_key then 'same' else 'different' end"
PERIOD_REL = """case when a.period_kind is null or b.period_kind is null or a.period_kind = 'unknown' or b.period_kind = 'unknown' then 'unknown'
  when a.period_kind = 'fiscal_year' and a.fiscal_year is null or b.period_kind = 'fiscal_year' and b.fiscal_year is null then 'unknown'
  when a.period_kind = b.period_kind and a.period_name = b.period_name then
    case when a.start_date is distinct from b.start_date or a.end_date is distinct from b.end_date then 'different_basis' else 'same' end
  when a.period_kind = b.period_kind then 'temporal'
  when a.start_date is not null and a.end_date is not null and b.start_date is not null and b.end_date is not null
       and (a.end_date < b.start_date or b.end_date < a.start_date) then 'temporal'
  else 'different_basis' end"""
QUALIFIED = "(a.qualifier_label is distinct from b.qualifier_label or not a.qualifier_plain)"

_OPPOSITES = [("increase", "decrease"), ("approved", "rejected"), ("before", "after"),
              ("true", "false"), ("allowed", "prohibited"), ("above", "below")]
OPPOSITE = "(" + " or ".join(
    f"contains(a.lower_text, '{x}') and contains(b.lower_text, '{y}') or contains(a.lower_text, '{y}') and contains(b.lower_text, '{x}')"
    for x, y in _OPPOSITES) + ")"

VERDICT = f"""case when a.entity_n <> b.entity_n or a.metric_n <> b.metric_n then 'UNCERTAIN|0.4|Unverified by rules; the statements need an AI check.'
  when a.value_numeric <> b.value_numeric then 'CONTRADICTION|0.95|The same metric has different numbers.'
  when a.reporting_date <> b.reporting_date then 'CONTRADICTION|0.95|The same metric has different reporting dates.'
  when a.negated <> b.negated and a.plain_text = b.plain_text then 'CONTRADICTION|0.9|The statements differ by negation.'
  when {OPPOSITE} then 'CONTRADICTION|0.9|The statements contain opposite terms.'
  when a.value_numeric is not distinct from b.value_numeric and a.reporting_date is not distinct from b.reporting_date
    then 'CONSISTENT|0.9|The statements contain the same metric, value, and reporting date.'
  when a.value_text = b.value_text then 'CONSISTENT|0.9|The statements contain the same metric and value.'
  else 'UNCERTAIN|0.4|Unverified by rules; the statements need an AI check.' end"""

SCORE = """case when case when a.value_numeric is not null and b.value_numeric is not null then
      case when a.unit_key is null or b.unit_key is null then a.value_numeric = b.value_numeric
           when a.unit_key = b.unit_key then a.base_value = b.base_value else false end
      else a.value_text is not distinct from b.value_text end then 0.0::double
  when period_relation = 'temporal' then 0.0::double
  when a.scope_key is not null and b.scope_key is not null and a.scope_key <> b.scope_key then 0.0::double
  else least(1.0::double,
      case when a.entity_n = b.entity_n and a.entity_n <> 'document subject' then 0.25::double else 0.0::double end
    + case when a.metric_n = b.metric_n then 0.30::double else 0.0::double end
    + case when period_relation = 'same' then 0.15::double else 0.0::double end
    + case when a.scope_key = b.scope_key then 0.10::double else 0.0::double end
    + 0.10::double
    + 0.25::double * greatest(0.0::double, least(1.0::double, similarity))) end"""

PAIRS = f"""{SIDES},
pairs as (select a.document_id, a.claim_id as claim_a_id, b.claim_id as claim_b_id, a, b,
    {UNIT_REL} as unit_relation, {PERIOD_REL} as period_relation, 0.0::double as similarity
  from sides a join sides b on a.document_id = b.document_id and a.entity_n = b.entity_n and a.metric_n = b.metric_n
   and a.claim_id < b.claim_id and not {AGREE})"""

LABELLED = f"""{PAIRS},
classed as (select *,
  case when period_relation = 'temporal' then 'temporal_difference'
       when a.scope_label is not null and b.scope_label is not null and a.scope_label <> b.scope_label then 'possible_scope_difference'
       when {QUALIFIED} then 'possible_qualifier_difference'
       when unit_relation = 'different' then 'possible_unit_difference'
       when period_relation = 'different_basis' then 'possible_period_difference'
       when period_relation = 'unknown' or a.scope_label is null or b.scope_label is null or unit_relation = 'unknown' then 'insufficient_context'
       when a.value_numeric is null or b.value_numeric is null then 'possible_value_difference'
       else 'candidate_contradiction' end as preliminary_classification from pairs)"""

JUDGED = f"""{PAIRS},
scored as (select *, {SCORE} as score, {VERDICT} as verdict from pairs),
verdicts as (select document_id, claim_a_id, claim_b_id, score, split_part(verdict, '|', 1) as classification,
  cast(split_part(verdict, '|', 2) as double) as confidence, split_part(verdict, '|', 3) as explanation,
  case split_part(verdict, '|', 1) when 'CONTRADICTION' then 'verified' when 'CONSISTENT' then 'dismissed'
       when 'UNRELATED' then 'dismissed' when 'INSUFFICIENT_CONTEXT' then 'needs_review' else 'contextual_difference' end as status,
  'rules' as source, a.entity_n as entity_a, b.entity_n as entity_b, a.metric_n as metric_a, b.metric_n as metric_b,
  a.value_text as value_a, b.value_text as value_b from scored)"""

def linked(links: str) -> str:
    """Merged and scored pairs, given the text of ``links (document_id, claim_id, neighbour_id, similarity)`` over ``sides``."""
    return f"""{LABELLED},
{links}
semantic as (select document_id, least(claim_id, neighbour_id) as claim_a_id, greatest(claim_id, neighbour_id) as claim_b_id,
  greatest(0.0::double, max(similarity)) as similarity from links group by 1, 2, 3),
merged as (select coalesce(s.document_id, m.document_id) as document_id, coalesce(s.claim_a_id, m.claim_a_id) as claim_a_id,
  coalesce(s.claim_b_id, m.claim_b_id) as claim_b_id, coalesce(preliminary_classification, 'possible_value_difference') as preliminary_classification,
  coalesce(m.similarity, 0.0::double) as similarity, s.document_id is not null as is_structured, m.document_id is not null as is_semantic
  from classed s full join semantic m on s.document_id = m.document_id and s.claim_a_id = m.claim_a_id and s.claim_b_id = m.claim_b_id),
all_pairs as (select m.*, a, b, {PERIOD_REL} as period_relation from merged m
  join sides a on a.document_id = m.document_id and a.claim_id = m.claim_a_id
  join sides b on b.document_id = m.document_id and b.claim_id = m.claim_b_id),
all_scored as (select *, {SCORE} as score, split_part({VERDICT}, '|', 1) as classification from all_pairs)"""


_NEXT_CLAIMS = """ordered as (select document_id, claim_id, cast(substr(claim_id, 2) as bigint) as k,
  lead(claim_id) over (partition by document_id, entity_n order by claim_id) as next_id from sides),
links as (select document_id, claim_id, next_id as neighbour_id, 0.5::double + cast(k % 50 as double) / 100.0::double as similarity from ordered where next_id is not null
  union all select document_id, next_id, claim_id, 0.4::double + cast(k % 60 as double) / 100.0::double from ordered where next_id is not null),"""

LINKS = f"""{linked(_NEXT_CLAIMS)},
queue as (select * from (select document_id, claim_a_id, claim_b_id, claim_a_id || '/' || claim_b_id as candidate_id, score,
  row_number() over (partition by document_id order by score desc, claim_a_id, claim_b_id) as queue_rank
  from all_scored where classification = 'UNCERTAIN' and score >= 0.65) where queue_rank <= 10)"""

EVIDENCE = f"""{LINKS}, chunks as ({CHUNKS}),
rec as (select s.document_id, s.claim_id, c.text, c.section, s.claim_text, s.source_page, c.page_start, c.page_end,
  case when c.text is null or trim(c.text) = '' then 'An original source chunk is missing or empty; the pair cannot be verified.'
       when not (s.source_page between c.page_start and c.page_end and contains(c.text, s.claim_text))
         then 'A claim quote or page is not grounded in its original source chunk.' end as problem
  from sides s left join chunks c on c.document_id = s.document_id and c.chunk_id = 'k' || substr(s.claim_id, 2)),
evidence as (select q.*, a.claim_text as claim_a_text, b.claim_text as claim_b_text, a.text as chunk_a, b.text as chunk_b,
  a.section as section_a, b.section as section_b, coalesce(b.problem, a.problem) as insufficient_reason
  from queue q join rec a on a.document_id = q.document_id and a.claim_id = q.claim_a_id
  join rec b on b.document_id = q.document_id and b.claim_id = q.claim_b_id)"""

ANSWERS = """
answers as (
  select document_id, candidate_id, case when queue_rank = 1 then 'CONTRADICTION' when queue_rank <= 4 then 'CONSISTENT' else 'UNCERTAIN' end as classification,
    'checked ' || candidate_id as explanation, case when queue_rank = 3 then 1.5 else 0.7 end::double as confidence from queue where queue_rank <= 8
  union all select document_id, candidate_id, 'CONSISTENT', 'again', 0.5::double from queue where queue_rank = 2
  union all select document_id, candidate_id || 'x', 'CONSISTENT', 'unknown id', 0.5::double from queue),
intake as (select q.document_id, q.claim_a_id, q.claim_b_id, q.candidate_id, case when q.insufficient_reason is null then a.classification else 'INSUFFICIENT_CONTEXT' end as classification,
  coalesce(q.insufficient_reason, a.explanation) as explanation, case when q.insufficient_reason is null then a.confidence else 0.0::double end as confidence,
  case when a.candidate_id is null and q.insufficient_reason is null then 'VERIFICATION_FAILED' else 'VERIFIED' end as intake
  from evidence q left join (select document_id, candidate_id, any_value(classification) as classification, any_value(explanation) as explanation,
    any_value(confidence) as confidence from answers group by 1, 2
    having count(*) = 1 and bool_and(confidence between 0 and 1)) a
  on a.document_id = q.document_id and a.candidate_id = q.candidate_id)"""
