"""Claims, layout items and status streams derived from the star tables.

The star tables hold no reports, so these views phrase their rows as reports: one
claim per order, one layout item per line item.  Each view is a single projection of
its table (no join, no shuffle) and is written once as SQL text that both Spark and
the DuckDB check can run; only the few functions below differ between the two.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.operators.blocks import page_batch
from claimloom.session import spread

SPARK = {
    "str": "string", "ym": "date_format({0}, 'yyyy-MM')", "long_date": "date_format({0}, 'MMMM d, yyyy')",
    "day_first": "date_format({0}, 'd MMM yyyy')", "iso": "date_format({0}, 'yyyy-MM-dd')",
    "stamp": "date_format({0}, 'yyyy-MM-dd HH:mm:ss')", "list": "array({0})",
    "nothing": "cast(array() as array<string>)", "bar": "char(124)", "nl": "char(10)", "idiv": "{0} div {1}",
}
DUCKDB = {
    "str": "varchar", "ym": "strftime({0}, '%Y-%m')", "long_date": "strftime({0}, '%B %-d, %Y')",
    "day_first": "strftime({0}, '%-d %b %Y')", "iso": "strftime({0}, '%Y-%m-%d')",
    "stamp": "strftime({0}, '%Y-%m-%d %H:%M:%S')", "list": "[{0}]", "nothing": "cast([] as varchar[])",
    "bar": "chr(124)", "nl": "chr(10)", "idiv": "{0} // {1}",
}
SLICES = 16  # buckets of page batches per split of the table they come from
SLICE_BYTES = 512 * 1024  # of the table's files per bucket: some 60,000 line items at most, so that a task sorts its bucket in memory


class _Call(str):
    def __call__(self, *args):
        return self.format(*args)


class Sql:
    """Dialect words for an f-string template: ``d.ym('o_orderdate')``, ``d.str``."""

    def __init__(self, words: dict[str, str]):
        for name, text in words.items():
            setattr(self, name, _Call(text))


def order_claims_sql(d: Sql, table: str) -> str:
    """One claim per order; document = customer bucket, entity spelled four ways."""
    value = f"cast(cast(floor(o_totalprice/100000) as bigint) as {d.str})"
    return f"""
select document_id, chunk_id, claim_id, entity_raw, metric_raw, value_text, value_numeric, unit, period, scope, qualifier,
       entity_raw || ' reported ' || metric_raw || case when o_orderkey % 11 = 0 then ' not' else '' end
         || ' of ' || value_text as claim_text,
       source_page, confidence
from (
select o_orderkey,
       'd' || lpad(cast(o_custkey % 50 as {d.str}), 4, '0') as document_id,
       'k' || lpad(cast(o_orderkey % 7 as {d.str}), 2, '0') as chunk_id,
       'c' || lpad(cast(o_orderkey as {d.str}), 10, '0') as claim_id,
       case o_orderkey % 4 when 0 then 'The Customer_' || cast(o_custkey as {d.str}) || ' Pvt. Ltd.'
                           when 1 then 'customer ' || cast(o_custkey as {d.str}) || ' private limited'
                           when 2 then 'Customer-' || cast(o_custkey as {d.str}) || ' Pvt Ltd'
                           else 'CUSTOMER ' || cast(o_custkey as {d.str}) || ' Private Ltd.' end as entity_raw,
       case o_orderkey % 3 when 0 then 'Total Revenue' when 1 then 'revenue' else 'Net Profit' end as metric_raw,
       {value} as value_text,
       cast(floor(o_totalprice/100000) as decimal(24,8)) as value_numeric,
       case o_orderkey % 8 when 0 then 'USD' when 1 then 'US$' when 2 then 'USD million' when 3 then 'usd mn'
                           when 4 then 'INR crore' when 5 then 'Cr' when 6 then null else '%' end as unit,
       case o_orderkey % 5 when 2 then 'FY ' || cast(1996 + o_orderkey % 2 as {d.str})
                           when 3 then {d.ym('o_orderdate')} when 4 then null
                           else cast(1996 + o_orderkey % 2 as {d.str}) end as period,
       case o_orderstatus when 'F' then 'consolidated' when 'O' then 'standalone' else null end as scope,
       case o_orderpriority when '1-URGENT' then 'audited' when '2-HIGH' then 'approximately' else null end as qualifier,
       1 + cast(o_orderkey % 9 as int) as source_page,
       cast(0.6 as decimal(5,4)) as confidence
from {table}) as raw_claims"""


def order_chunks_sql(d: Sql, table: str) -> str:
    """One source chunk per order claim; some blank, some lost (other id), some on other pages or rephrased."""
    key = f"lpad(cast(o_orderkey as {d.str}), 10, '0')"
    return f"""
select document_id, case when k % 17 = 3 then 'x' else 'k' end || substr(claim_id, 2, 10) as chunk_id,
       case when k % 19 = 4 then source_page + 1 else source_page end as page_start,
       cast(source_page + 2 as int) as page_end, 'Section ' || cast(k % 5 as {d.str}) as section,
       case when k % 13 = 2 then '   ' when k % 23 = 5 then 'Rephrased: ' || upper(claim_text)
            else 'Note ' || cast(k as {d.str}) || '. ' || claim_text || '. End.' end as text,
       case k % 5 when 0 then 'PENDING' when 1 then 'FAILED' else 'COMPLETED' end as extraction_status
from (select c.*, cast(substr(claim_id, 2, 10) as bigint) as k from ({order_claims_sql(d, table)}) as c) as keyed"""


def period_texts_sql(d: Sql, table: str) -> str:
    """Every order date spelled in one of twelve ways, some of them invalid."""
    y = f"substr({d.iso('o_orderdate')}, 1, 4)"
    return f"""
select 'c' || lpad(cast(o_orderkey as {d.str}), 10, '0') as claim_id,
       case o_orderkey % 12
         when 0 then 'FY' || substr({y}, 3, 2) when 1 then 'Fiscal  Year ' || {y}
         when 2 then 'Year ended ' || {d.long_date('o_orderdate')} when 3 then {d.day_first('o_orderdate')}
         when 4 then {d.iso('o_orderdate')} when 5 then {d.ym('o_orderdate')}
         when 6 then {y} when 7 then 'Q1 ' || {y}
         when 8 then {y} || '-02-30' when 9 then 'financial year ''' || substr({y}, 3, 2)
         when 10 then '0000' else null end as period
from {table}"""


def report_items_sql(d: Sql, table: str) -> str:
    """One layout item per line item: a report of 100 pages per 100 order keys.

    The line number picks the role (heading, intro, caption, table, note, sentence,
    picture or page header) and the keys pick wording, position and explicit links.
    """
    s = d.str
    key = f"cast(l_orderkey as {s})"
    price = (f"cast(cast(floor(l_extendedprice/1000) as bigint) as {s}) || ',' || "
             f"lpad(cast(cast(floor(l_extendedprice) as bigint) % 1000 as {s}), 3, '0')")
    year = f"substr({d.iso('l_shipdate')}, 1, 4)"
    table_text = (
        f"{d.bar} || ' Year ' || {d.bar} || ' Revenue ' || {d.bar} || ' ' || {year} || ' ' || {d.bar} || {d.nl} || "
        f"{d.bar} || '---' || {d.bar} || '---' || {d.bar} || '---' || {d.bar} || {d.nl} || "
        f"{d.bar} || ' Supplier ' || cast(l_suppkey as {s}) || ' ' || {d.bar} || ' $' || cast(cast(l_quantity as bigint) as {s}) "
        f"|| ' million ' || {d.bar} || ' ' || {price} || ' (1) ' || {d.bar}")
    fact = (f"'Supplier ' || cast(l_suppkey as {s}) || ' reported revenue of $' || {price} || ' million in ' || {year} || "
            f"case l_orderkey % 4 when 0 then ' globally.' when 1 then ' on a consolidated basis.' else '.' end || "
            f"' Headcount was ' || cast(cast(l_quantity as bigint) as {s}) || ' employees on {{0}}.'")
    return f"""
select 'r' || lpad(cast({d.idiv('l_orderkey', '100')} as {s}), 8, '0') as document_id,
       ((l_orderkey % 100) * 8 + l_linenumber) * 100000000 + l_partkey * 1000 + l_suppkey as pos,
       cast(l_orderkey % 100 + 1 as int) as page_number,
       '#/items/' || {key} || '/' || cast(l_linenumber as {s}) as self_ref,
       case when l_linenumber = 1 and l_orderkey % 11 = 0 then 'page_header'
            when l_linenumber = 1 and l_orderkey % 3 = 0 then 'section_header'
            when l_linenumber = 2 and l_orderkey % 2 = 0 then 'caption'
            when l_linenumber in (3, 7) then 'table'
            when l_linenumber = 4 and l_orderkey % 3 = 0 then 'footnote'
            when l_linenumber = 6 and l_orderkey % 5 = 0 then 'picture'
            when l_linenumber = 6 and l_orderkey % 5 = 1 then 'list_item'
            else 'text' end as label,
       case when l_linenumber = 1 and l_orderkey % 3 = 0 then 'Section ' || cast({d.idiv('l_orderkey', '3')} as {s})
            when l_linenumber = 2 and l_orderkey % 2 = 0 then 'Table ' || {key} || ' Shipments of supplier ' || cast(l_suppkey as {s})
            when l_linenumber = 2 then 'The following table lists the deliveries of ' || {year} || '.'
            when l_linenumber in (3, 7) then {table_text}
            when l_linenumber = 4 and l_orderkey % 3 = 1 then 'Source: company records of ' || {year} || '.'
            when l_linenumber = 4 then '(1) Includes returns of part ' || cast(l_partkey as {s}) || '.'
            when l_linenumber = 6 and l_orderkey % 5 = 2 then 'Figure ' || {key} || ' Deliveries'
            when l_linenumber = 6 and l_orderkey % 5 = 3 then '   '
            else {fact.format(f"' || {d.long_date('l_shipdate')} || '")} end as text,
       'sha-' || cast({d.idiv('l_orderkey', '100')} as {s}) as source_sha256,
       cast(50 + 10 * (l_partkey % 3) as double) as box_l,
       cast(40 * l_linenumber + 5 * (l_suppkey % 5) as double) as box_t,
       cast(300 + 20 * (l_partkey % 4) as double) as box_r,
       cast(60 * 1.0 + 40 * l_linenumber + 5 * (l_suppkey % 5) - 40 + 5 * (l_partkey % 4) as double) as box_b,
       case when l_linenumber = 3 and l_orderkey % 4 = 0 then {d.list(f"'#/items/' || {key} || '/2'")}
            else {d.nothing} end as caption_refs,
       case when l_linenumber = 3 and l_orderkey % 6 = 0 then {d.list(f"'#/items/' || {key} || '/4', '#/items/' || {key} || '/9'")}
            else {d.nothing} end as footnote_refs,
       case when l_linenumber = 5 and l_orderkey % 7 = 0 then {d.list(f"'#/body', '#/items/' || {key} || '/3', '#/items/' || {key} || '/6'")}
            else {d.list("'#/body'")} end as parent_refs
from {table}"""


def status_changes_sql(d: Sql, table: str) -> str:
    """Stage changes per document from the event stream (document = user)."""
    return f"""
select 'u' || lpad(cast(user_id as {d.str}), 8, '0') as document_id, event_id as seq,
       {d.stamp('ts')} as changed_at,
       case event_type when 'view' then 'PARSING' when 'click' then 'CHUNKING' when 'signup' then 'EXTRACTING_CLAIMS'
            when 'purchase' then 'COMPLETED' else 'FAILED' end as status
from {table}"""


def documents_registry_sql(d: Sql, table: str) -> str:
    """One registered source document per customer, in every status."""
    return f"""
select 'u' || lpad(cast(c_custkey as {d.str}), 8, '0') as document_id, c_name || '.pdf' as filename,
       case when c_custkey % 9 = 4 then null else 'store/' || cast(c_custkey as {d.str}) end as storage_path,
       cast(c_custkey % 130 as int) as page_count,
       case c_custkey % 8 when 0 then 'UPLOADED' when 1 then 'QUEUED' when 2 then 'PARSING' when 3 then 'VERIFYING'
            when 4 then 'COMPLETED' when 5 then 'FAILED' when 6 then 'CANCELLED' else 'COMPLETED_WITH_WARNINGS' end as status
from {table}"""


def errors_sql(d: Sql, table: str) -> str:
    """Item errors per document from the 'error' events; stage, category and HTTP status vary by key."""
    return f"""
select 'u' || lpad(cast(user_id as {d.str}), 8, '0') as document_id, event_id as position,
       case event_id % 5 when 0 then 'EXTRACTING_CLAIMS' when 1 then 'VERIFYING' when 2 then 'NORMALIZING'
            when 3 then 'EMBEDDING' else 'PARSING' end as stage,
       'i' || cast(event_id as {d.str}) as item_id,
       'stage failed for item ' || cast(event_id as {d.str}) as message,
       case event_id % 7 when 0 then 'insufficient_quota' when 1 then 'daily_quota' when 2 then 'invalid_claim_output'
            else null end as category,
       cast(case event_id % 4 when 0 then 429 when 1 then 401 when 2 then 403 else null end as int) as http_status,
       case event_id % 3 when 0 then 'external' else null end as provider
from {table} where event_type = 'error'"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def _view(spark: SparkSession, sf_dir: str, template, name: str) -> DataFrame:
    return spark.sql(template(Sql(SPARK), "{source}"), source=table(spark, sf_dir, name))


def order_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, order_claims_sql, "orders")


def order_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, order_chunks_sql, "orders")


def period_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, period_texts_sql, "orders")


def report_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, report_items_sql, "lineitem")


_slices: dict[tuple[str, str, str], int] = {}


def slices(spark: SparkSession, sf_dir: str, name: str) -> int:
    """Number of buckets for the page batches made from a table, in proportion to its bytes.

    Splits alone do not tell: there are as many as cores over a wide range of sizes, so buckets would grow with the table until their
    sorts are spilled.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _slices:
        path = f"{sf_dir}/{name}.parquet"
        size = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0] or 0
        _slices[key] = max(SLICES * spark.read.parquet(path).rdd.getNumPartitions(), ceil(size / SLICE_BYTES))
    return _slices[key]


def report_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report items with their page batch, dealt by page batch while they are still narrow line items."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    document = F.expr("'r' || lpad(cast(l_orderkey div 100 as string), 8, '0')")
    dealt = lines.repartition(slices(spark, sf_dir, "lineitem"), document, page_batch(F.expr("cast(l_orderkey % 100 + 1 as int)")))
    items = spark.sql(report_items_sql(Sql(SPARK), "{source}"), source=dealt)
    return items.withColumn("page_batch", page_batch(F.col("page_number")))


def status_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, status_changes_sql, "events")


def documents_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, documents_registry_sql, "customer")


def document_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, errors_sql, "events")


def duckdb_view(template, name: str) -> str:
    """The DuckDB text of one derived view, for the check."""
    return template(Sql(DUCKDB), name)
