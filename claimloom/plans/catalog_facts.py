"""Catalog: chunking and fact extraction over documents, pages, conversations and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.functions import text as tx
from claimloom.operators import chunks, extract, normalize, pairs, reuse, verdicts
from claimloom.plans import check_sql as sql
from claimloom.plans.catalog import Catalog, claims_n
from claimloom.plans.catalog_documents import (BLOCKS, LINES, WALK, line_blocks, line_chunks, page_blocks,
                                               report_blocks, report_chunks, report_claim_parts, report_claims, stored_line_chunks, stored_report_chunks, turn_blocks)
from claimloom.session import materialize, work_dir
from claimloom.sources import derived

catalog = Catalog()
add = catalog.add

# Runs and one-piece chunks of the reports (no report run is longer than a chunk).
RUNS = f"""{BLOCKS},
flow as (select *, lag(block_type) over w as previous_type,
  last_value(case when block_type = 'heading' then text when block_type <> 'table' then section_heading end ignore nulls)
    over (w rows between unbounded preceding and 1 preceding) as section_before
  from blocks window w as (partition by document_id, page_batch order by pos, self_ref, text)),
runs as (select *, sum(case when previous_type is null or block_type = 'table' or previous_type = 'table' or block_type = 'heading' and previous_type <> 'heading'
    or block_type not in ('heading', 'table') and section_heading is not null and section_heading is distinct from section_before then 1 else 0 end)
    over (partition by document_id, page_batch order by pos, self_ref, text rows between unbounded preceding and current row) as run,
  case when block_type = 'table' then coalesce(section_heading, section_before) when block_type = 'heading' then text else coalesce(section_heading, section_before) end as section
  from flow),
consumed as (select r.document_id, r.page_batch, r.run from runs r group by all having bool_and(block_type = 'heading')),
prose as (select * from runs where block_type <> 'table'),
placed as (select *, coalesce(sum(length(text) + 2) over (partition by document_id, page_batch, run order by pos, self_ref, text
    rows between unbounded preceding and 1 preceding), 0)::bigint as start_at from prose),
report_chunks as (select document_id, page_batch, run, string_agg(text, chr(10) || chr(10) order by pos, self_ref) as text, arg_max(section, pos) as section,
  min(page_number) as page_start, max(page_number) as page_end, array_to_string(list_distinct(list(block_type)), ',') as types, count(*) as n_blocks from placed group by all)"""


_TABLE_TEXTS = f"""with recursive {WALK},
claimed as (select document_id, page_batch, block_id from resolved),
flow as (select o.*, case when o.block_type = 'table' then h.heading_text else o.section_heading end as own_section
  from ordered o join headings h on h.document_id = o.document_id and h.page_batch = o.page_batch and h.block_id = o.block_id
  where not exists (select 1 from claimed c where c.document_id = o.document_id and c.page_batch = o.page_batch and c.block_id = o.block_id)),
seen as (select *, lag(block_type) over w as previous_type,
  last_value(case when block_type = 'heading' then text when block_type <> 'table' then own_section end ignore nulls) over (w rows between unbounded preceding and 1 preceding) as section_before
  from flow window w as (partition by document_id, page_batch order by idx)),
marked as (select *, block_type not in ('heading', 'table') and own_section is not null and own_section is distinct from section_before as moved,
  case when block_type = 'table' then coalesce(own_section, section_before) end as section from seen),
state as (select *, last_value(case when block_type = 'heading' then block_id || '|' || text when moved then '|' end ignore nulls)
    over (partition by document_id, page_batch order by idx rows between unbounded preceding and 1 preceding) as heading_state,
  sum(case when block_type <> 'heading' then 1 else 0 end) over (partition by document_id, page_batch order by idx) as island from marked),
parts as (
  select t.document_id, t.page_batch, t.block_id as table_id, 0 as rank, p.idx as ord, p.block_id from state t join state p
    on p.document_id = t.document_id and p.page_batch = t.page_batch and p.block_type = 'heading' and p.island = t.island - 1
    where t.block_type = 'table' and t.previous_type = 'heading' and t.section is not distinct from t.section_before
  union all select t.document_id, t.page_batch, t.block_id, 1, 0, split_part(t.heading_state, '|', 1) from state t join headings h
    on h.document_id = t.document_id and h.page_batch = t.page_batch and h.block_id = t.block_id
    where t.block_type = 'table' and h.heading_id is null and split_part(t.heading_state, '|', 1) <> '' and substr(t.heading_state, strpos(t.heading_state, '|') + 1) = t.section
  union all select document_id, page_batch, block_id, 2, 0, heading_id from headings where block_type = 'table' and heading_id is not null
  union all select r.document_id, r.page_batch, r.table_id, case r.role when 'preceding_paragraph' then 3 when 'captions' then 4 else 6 end, o.idx, r.block_id
    from resolved r join ordered o on o.document_id = r.document_id and o.page_batch = r.page_batch and o.block_id = r.block_id
  union all select document_id, page_batch, block_id, 5, 0, block_id from ordered where block_type = 'table'),
firsts as (select document_id, page_batch, table_id, block_id, min(rank * 1000000 + ord) as place from parts group by all),
table_texts as (select f.document_id, f.page_batch, f.table_id, string_agg(o.text, chr(10) || chr(10) order by f.place) as text, count(*) as n_blocks
  from firsts f join ordered o on o.document_id = f.document_id and o.page_batch = f.page_batch and o.block_id = f.block_id group by all)"""

# Every chunk of the reports, prose and tables, and the blocks in it (no report run is longer than a chunk).
CHUNKS = f"""{_TABLE_TEXTS},
numbered as (select *, sum(case when previous_type is null or block_type = 'table' or previous_type = 'table' or block_type = 'heading' and previous_type <> 'heading' or moved then 1 else 0 end)
    over (partition by document_id, page_batch order by idx rows between unbounded preceding and current row) as run,
  case when block_type = 'heading' then text else coalesce(own_section, section_before) end as run_section from marked),
taken as (select document_id, page_batch, run - 1 as run from numbered where block_type = 'table' and previous_type = 'heading' and section is not distinct from section_before),
chunk_blocks as (select n.document_id, n.page_batch, 'prose' as kind, n.run::varchar as chunk, n.run, n.idx as place, n.block_id, n.text, n.page_number, n.run_section as section
    from numbered n where n.block_type <> 'table' and not exists (select 1 from taken t where t.document_id = n.document_id and t.page_batch = n.page_batch and t.run = n.run)
  union all select f.document_id, f.page_batch, 'table', f.table_id, t.run, f.place, f.block_id, o.text, o.page_number, t.run_section
    from firsts f join ordered o on o.document_id = f.document_id and o.page_batch = f.page_batch and o.block_id = f.block_id
    join numbered t on t.document_id = f.document_id and t.page_batch = f.page_batch and t.block_id = f.table_id),
spans as (select *, coalesce(sum(length(text) + 2) over (partition by document_id, page_batch, kind, chunk order by place rows between unbounded preceding and 1 preceding), 0)::bigint as start_at from chunk_blocks),
all_chunks as (select document_id, page_batch, kind, chunk, run, string_agg(text, chr(10) || chr(10) order by place) as text, arg_max(section, place) as section,
  min(page_number)::bigint as page_start, max(page_number)::bigint as page_end, count(*) as n_blocks from spans group by all)"""


_SPACE = "[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
_LINE_PIECES = f"{LINES}, texts as (select *, sha256(document_id || ':#/lines/' || pos || ':[' || page_number || ']') as block_id from line_blocks)"
_TURN_PIECES = f"""texts as (select *, (page_number - 1) // 25 as page_batch, sha256('conv-' || conv_id || ':#/turns/' || pos || ':[' || page_number || ']') as block_id from (
  select 'v' || lpad(cast(conv_id as varchar), 10, '0') as document_id, conv_id, turn as pos, turn // 5 + 1 as page_number, text from conversations where regexp_matches(text, '[^\\s]')))"""


def _pieces(texts: str) -> str:
    """The splitter as a recursion over the cuts of a run: every batch of headless texts is one run."""
    step = """select *, case when rest <= 4000 then size else coalesce(list_sort(list_transform(near, lambda x: {'d': abs(x - wish), 'x': x}))[1].x, b + least(4000, wish - b)) end as e from (
    select *, case when len(list_filter(ends, lambda x: x between low and high)) > 0 then list_filter(ends, lambda x: x between low and high)
      when len(list_filter(sentences, lambda x: x between low and high)) > 0 then list_filter(sentences, lambda x: x between low and high)
      else list_filter(starts, lambda x: x between low and high) end as near from (
    select *, b + shortest as low, b + least(4000, rest + 320 - shortest) as high, b + ceil((rest + (n_pieces - 1) * 320) / n_pieces)::bigint as wish from (
    select *, least(2400, (rest + 320) // 2) as shortest, greatest(2, ceil((rest - 320) / 3680.0), round_even((rest - 320) / 2880.0, 0)) as n_pieces from (
    select *, size - b as rest from ({0})))))"""
    columns = "document_id, page_batch, size, ends, starts, stops, sentences"
    first = f"select {columns}, 1 as n, 0::bigint as b, 0::bigint as ov from marked"
    after = f"""select {columns}, n + 1 as n, coalesce(case when z[1] < e then least(z[2], e) end, e) as b, e - coalesce(case when z[1] < e then least(z[2], e) end, e) as ov from (
      select *, list_filter(list_zip(starts, stops), lambda x: x[2] > greatest(b + 1, e - 320))[1] as z from cuts where e < size)"""
    return f"""{texts},
placed as (select *, coalesce(sum(length(text) + 2) over (partition by document_id, page_batch order by pos rows between unbounded preceding and 1 preceding), 0)::bigint as start_at from texts),
whole as (select document_id, page_batch, string_agg(text, chr(10) || chr(10) order by pos) as text, list(start_at + length(text) order by pos) as ends from placed group by all),
tokens as (select document_id, page_batch, unnest(regexp_split_to_array(text, '{_SPACE}+')) as token, unnest(list_concat(regexp_extract_all(text, '{_SPACE}+'), [''])) as gap,
  generate_subscripts(regexp_split_to_array(text, '{_SPACE}+'), 1) as i from whole),
gaps as (select *, sum(length(token) + length(gap)) over (partition by document_id, page_batch order by i)::bigint as stop from tokens),
marked as (select w.document_id, w.page_batch, length(any_value(w.text))::bigint as size, any_value(w.ends) as ends, coalesce(list(stop - length(gap) order by i) filter (gap <> ''), []) as starts,
  coalesce(list(stop order by i) filter (gap <> ''), []) as stops, coalesce(list(stop - length(gap) order by i) filter (gap <> '' and regexp_matches(token, '[.!?]["'')\\]]*$')), []) as sentences
  from whole w join gaps g on g.document_id = w.document_id and g.page_batch = w.page_batch group by w.document_id, w.page_batch),
cuts as (select {columns}, n, b, ov, e from ({step.replace("{0}", first)}) union all select {columns}, n, b, ov, e from ({step.replace("{0}", after)})),
raw as (select c.document_id, c.page_batch, c.n, c.b, c.e, c.ov, substr(w.text, c.b + 1, c.e - c.b) as t from cuts c join whole w on w.document_id = c.document_id and w.page_batch = c.page_batch),
cut_texts as (select *, length(t) - length(regexp_replace(t, '^{_SPACE}+', '')) as lead, length(t) - length(regexp_replace(t, '{_SPACE}+$', '')) as tail from raw where regexp_matches(t, '[^\\s]')),
contents as (select *, b + lead as low, e - tail as high, substr(t, lead + 1, length(t) - lead - tail) as content from cut_texts),
met as (select c.document_id, c.page_batch, c.n, p.pos, p.page_number, p.block_id, p.text as block_text, greatest(c.low, p.start_at) - p.start_at as char_start, least(c.high, p.start_at + length(p.text)) - p.start_at as char_end,
  greatest(c.low, p.start_at) - c.low as chunk_char_start, least(c.high, p.start_at + length(p.text)) - c.low as chunk_char_end
  from contents c join placed p on p.document_id = c.document_id and p.page_batch = c.page_batch and greatest(c.low, p.start_at) < least(c.high, p.start_at + length(p.text))),
pages as (select document_id, page_batch, n, min(page_number)::bigint as page_start, max(page_number)::bigint as page_end, list_sort(list_distinct(list(page_number))) as pages,
  list({{'block_id': block_id, 'char_start': char_start, 'char_end': char_end, 'chunk_char_start': chunk_char_start, 'chunk_char_end': chunk_char_end}} order by pos) as spans from met group by all),
split as (select c.document_id, c.page_batch::bigint as page_batch, row_number() over (partition by c.document_id, c.page_batch order by c.n) as seq, p.page_start, p.page_end, c.content, c.n,
  sha256(to_json({{'section': null, 'spans': p.spans, 'text': c.content, 'pages': p.pages}})::varchar) as chunk_id,
  ceil(length(c.content) / 4.0)::bigint as estimated_token_count, greatest(0, c.ov - c.lead)::bigint as overlap_characters, sha256(c.content) as content_hash
  from contents c join pages p on p.document_id = c.document_id and p.page_batch = c.page_batch and p.n = c.n)"""


SPLIT_LINES = f"with recursive {_pieces(_LINE_PIECES)}"
SPLIT_TURNS = f"with recursive {_pieces(_TURN_PIECES)}"


# --- chunks -------------------------------------------------------------------------------------

@add("chk_01_token_estimates", "select doc_id, ceil(length(text) / 4.0)::bigint as tokens from documents")
def token_estimates(spark, sf):
    return derived.table(spark, sf, "documents").select("doc_id", tx.token_estimate(F.col("text")).alias("tokens"))


@add("chk_02_block_offsets", f"""with {LINES} select document_id, page_batch, pos, start_at, start_at + length(text) as end_at from (
  select *, coalesce(sum(length(text) + 2) over (partition by document_id, page_batch order by pos rows between unbounded preceding and 1 preceding), 0)::bigint as start_at from line_blocks)""")
def block_offsets(spark, sf):
    """Character range of every line inside the joined text of its run."""
    lines = line_blocks(spark, sf)
    runs = chunks.prose_runs(chunks.sectioned(lines, chunks.bare_tables(lines)))
    ranges = runs.select("document_id", "page_batch", F.explode("ranges").alias("r"))
    blocks = line_blocks(spark, sf).select("document_id", "page_batch", "block_id", "pos")
    return ranges.select("document_id", "page_batch", "r.block_id", F.col("r.start").alias("start_at"), F.col("r.end").alias("end_at")).join(
        blocks, ["document_id", "page_batch", "block_id"]).drop("block_id")


@add("chk_03_sections", f"with {RUNS} select document_id, block_id, run::bigint as run, section from runs")
def sections(spark, sf):
    rows = report_blocks(spark, sf)
    return chunks.sectioned(rows, chunks.bare_tables(rows)).select("document_id", "block_id", "run", "section")


@add("chk_04_document_chunks", f"{SPLIT_LINES} select document_id, page_batch, seq, chunk_id, page_start, page_end, estimated_token_count, overlap_characters, content_hash from split")
def document_chunks(spark, sf):
    """Every chunk of the plain-text documents with its cut range and size."""
    return line_chunks(spark, sf).select("document_id", "page_batch", "seq", "chunk_id", "page_start", "page_end",
                                         "estimated_token_count", "overlap_characters", "content_hash")


@add("chk_04_page_chunks")
def page_chunks(spark, sf):
    """Chunks of the HTML pages, cut at their headings."""
    return chunks.document_chunks(page_blocks(spark, sf)).select("document_id", "seq", "chunk_id", "section", "estimated_token_count")


@add("chk_04_conversation_chunks", f"{SPLIT_TURNS} select document_id, seq, chunk_id, estimated_token_count, overlap_characters from split")
def conversation_chunks(spark, sf):
    return chunks.document_chunks(turn_blocks(spark, sf)).select("document_id", "seq", "chunk_id", "estimated_token_count", "overlap_characters")


@add("chk_05_sentence_boundaries", """select doc_id, len(regexp_extract_all(text, '[.!?]["'')\\]]*[\\s\\x{a0}\\x{2000}-\\x{200a}\\x{3000}\\x{85}]'))::bigint as boundaries from documents""")
def sentence_boundaries(spark, sf):
    return derived.table(spark, sf, "documents").select("doc_id", chunks.sentence_boundaries(F.col("text")).alias("boundaries"))


@add("chk_06_trimmed_chunks", f"{SPLIT_LINES} select document_id, count(*) as chunks, sum(length(content))::bigint as characters, 0::bigint as untrimmed from split group by 1")
def trimmed_chunks(spark, sf):
    """Chunk texts never start or end with white space; per document counts of chunks and characters."""
    c = line_chunks(spark, sf)
    ragged = F.col("text").rlike(r"(?U)^\s|\s\z")
    return c.groupBy("document_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.length("text")).alias("characters"),
                                        F.count_if(ragged).alias("untrimmed"))


@add("chk_07_source_spans", f"""{CHUNKS} select document_id, page_batch::bigint as page_batch, block_id, 0::bigint as char_start, length(text) as char_end, start_at as chunk_char_start,
  start_at + length(text) as chunk_char_end from spans""")
def source_spans(spark, sf):
    """Spans of all report chunks, prose and tables."""
    return report_chunks(spark, sf).select("document_id", "page_batch", F.explode("spans").alias("s")).select(
        "document_id", "page_batch", "s.block_id", "s.char_start", "s.char_end", "s.chunk_char_start", "s.chunk_char_end")



@add("chk_07_spans_of_cut_runs", f"""{SPLIT_LINES} select s.document_id, s.chunk_id, m.block_id, m.char_start, m.char_end,
  substr(s.content, m.chunk_char_start + 1, m.chunk_char_end - m.chunk_char_start) = substr(m.block_text, m.char_start + 1, m.char_end - m.char_start) as equal_text
from split s join met m on m.document_id = s.document_id and m.page_batch = s.page_batch and m.n = s.n""")
def spans_of_cut_runs(spark, sf):
    """Spans of every document chunk, and whether the chunk text equals the block text at the span."""
    b = line_blocks(spark, sf).select("document_id", "page_batch", "block_id", F.col("text").alias("block_text"))
    joined = chunks.span_texts(line_chunks(spark, sf)).join(b, ["document_id", "page_batch", "block_id"])
    same = F.col("span_text") == F.expr("substring(block_text, char_start + 1, char_end - char_start)")
    return joined.select("document_id", "chunk_id", "block_id", "char_start", "char_end", same.alias("equal_text"))


@add("chk_08_pages_and_types", f"{CHUNKS} select document_id, page_batch::bigint as page_batch, sha256(text) as content_hash, section, page_start, page_end, n_blocks from all_chunks")
def pages_and_types(spark, sf):
    return report_chunks(spark, sf).select("document_id", "page_batch", "content_hash", "section", "page_start", "page_end",
                                           F.size("source_block_ids").alias("n_blocks"))



@add("chk_09_chunk_ids", f"{SPLIT_LINES} select document_id, chunk_id, count(*) as chunks, max(overlap_characters) as overlap from split group by 1, 2")
def chunk_ids(spark, sf):
    """Chunk ids with how many chunks share them: equal ids only for equal content and place."""
    return line_chunks(spark, sf).groupBy("document_id", "chunk_id").agg(F.count(F.lit(1)).alias("chunks"), F.max("overlap_characters").alias("overlap"))


@add("chk_10_table_chunks", f"{_TABLE_TEXTS} select document_id, page_batch::bigint as page_batch, text, n_blocks from table_texts")
def table_chunks(spark, sf):
    return report_chunks(spark, sf).where("kind = 'table'").select("document_id", "page_batch", "text", F.size("source_block_ids").alias("n_blocks"))


@add("chk_11_size_distribution", f"""{CHUNKS}, sized as (select document_id, kind, ceil(length(text) / 4.0)::bigint as tokens from all_chunks)
select document_id, count(*) as total_chunks, count(*) filter (kind = 'prose') as prose_chunks, count(*) filter (kind = 'table') as table_chunks, min(tokens) as min_tokens, max(tokens) as max_tokens,
  round(avg(tokens), 1) as mean_tokens, median(tokens) as median_tokens, count(*) filter (tokens < 600) as under_600,
  count(*) filter (tokens between 600 and 1000) as from_600_to_1000, count(*) filter (tokens > 1000) as over_1000 from sized group by 1""")
def size_distribution(spark, sf):
    return chunks.size_distribution(report_chunks(spark, sf))



@add("chk_11_document_sizes", f"""{SPLIT_LINES} select document_id, count(*) as total_chunks, count(*) as prose_chunks, 0::bigint as table_chunks, min(estimated_token_count) as min_tokens, max(estimated_token_count) as max_tokens,
  round(avg(estimated_token_count), 1) as mean_tokens, median(estimated_token_count) as median_tokens, count(*) filter (estimated_token_count < 600) as under_600,
  count(*) filter (estimated_token_count between 600 and 1000) as from_600_to_1000, count(*) filter (estimated_token_count > 1000) as over_1000 from split group by 1""")
def document_sizes(spark, sf):
    return chunks.size_distribution(line_chunks(spark, sf))


@add("chk_12_example_chunks", f"""{CHUNKS},
slots as (select *, row_number() over (partition by document_id order by page_batch, run) as slot, row_number() over (partition by document_id, kind order by page_batch, run) as kind_slot from all_chunks),
shown as (select * from slots where slot <= 3),
lasts as (select document_id, max(slot) as last_slot, bool_or(kind = 'table') as has_table from shown group by 1)
select s.document_id, s.slot, coalesce(t.kind, s.kind) as kind, sha256(coalesce(t.text, s.text)) as content_hash from shown s join lasts on lasts.document_id = s.document_id
left join slots t on t.document_id = s.document_id and t.kind = 'table' and t.kind_slot = 1 and not has_table and s.slot = last_slot""")
def example_chunks(spark, sf):
    places = report_chunks(spark, sf).select("document_id", "page_batch", "seq", "kind", "content_hash")  # texts and spans stay where they lie
    return chunks.example_chunks(materialize(places, "chunk_places")).select("document_id", "slot", "kind", "content_hash")


# --- extraction -------------------------------------------------------------------------------------

@add("ext_01_evidence_segments", f"""{CHUNKS} select document_id, page_start as page, text as segment_text from all_chunks where page_start = page_end
union all select s.document_id, s.page_number::bigint, s.text from spans s join all_chunks c on c.document_id = s.document_id and c.page_batch = s.page_batch and c.kind = s.kind and c.chunk = s.chunk
  where c.page_start <> c.page_end""")
def evidence_segments(spark, sf):
    return extract.evidence_segments(report_chunks(spark, sf)).select("document_id", "page", "segment_text")



@add("ext_02_span_violations", """select 'r' || cast(l_orderkey as varchar) as document_id, cast(l_partkey as varchar) || '-' || cast(l_suppkey as varchar) as chunk_id,
  case when l_linenumber - 2 < 0 or l_linenumber - 2 >= l_quantity - 5 or l_quantity - 5 > 30 then 'invalid_offsets' else 'invalid_block_identifier' end as problem
from lineitem where l_linenumber - 2 < 0 or l_linenumber - 2 >= l_quantity - 5 or l_quantity - 5 > 30 or l_returnflag = 'R'""")
def span_violations(spark, sf):
    """Line items read as chunks of 30 characters with one span each; returned lines lost their block id."""
    span = F.struct(F.when(F.col("l_returnflag") != "R", F.lit("b")).alias("block_id"), (F.col("l_linenumber") - 2).alias("chunk_char_start"),
                    (F.col("l_quantity").cast("int") - 5).alias("chunk_char_end"))
    rows = derived.table(spark, sf, "lineitem").select(
        F.concat(F.lit("r"), F.col("l_orderkey").cast("string")).alias("document_id"),
        F.concat_ws("-", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("chunk_id"),
        F.repeat(F.lit("x"), 30).alias("text"), F.lit(1).alias("page_start"), F.lit(2).alias("page_end"), F.array(span).alias("spans"))
    return extract.span_violations(rows)


@add("ext_03_sentences", f"""with {LINES}, s as (select document_id, pos, trim(unnest(regexp_split_to_array(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(10), 'g'), '\\n+'))) as sentence from line_blocks)
select document_id, pos, sentence from s where sentence <> ''""")
def sentences(spark, sf):
    """Sentences of every document line."""
    rows = line_blocks(spark, sf).select("document_id", "pos", F.col("text").alias("segment_text"))
    lines = F.transform(F.split("segment_text", extract.CASED + extract.SENTENCE_BREAK), tx.strip)
    return rows.select("document_id", "pos", F.explode(lines).alias("sentence")).where("sentence <> ''")


@add("ext_04_table_rows", f"""with {BLOCKS}, lines as (select document_id, block_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as n from blocks where block_type = 'table')
select document_id, block_id, line as sentence, array_to_string(list_transform(string_split(trim(line, '|'), '|'), lambda c: trim(c)), ';') as cells from lines where n > 2""")
def table_rows(spark, sf):
    """Body rows of every table block: header and separator rows are left out."""
    tables = report_blocks(spark, sf).where("block_type = 'table'").select("document_id", "block_id", F.col("text").alias("segment_text"))
    return extract.sentences(tables).select("document_id", "block_id", "sentence", F.concat_ws(";", extract._cells(F.col("sentence"))).alias("cells"))


_DATE = extract.DATE


@add("ext_05_date_literals", f"""with {BLOCKS} select document_id, block_id, array_to_string(regexp_extract_all(text, '(?i){_DATE}'), ';') as dates from blocks""")
def date_literals(spark, sf):
    found = extract.matches(F.col("text"), extract.ANY_CASE + extract.DATE)
    return report_blocks(spark, sf).select("document_id", "block_id", F.concat_ws(";", F.transform(found, lambda m: m["text"])).alias("dates"))


_NUMBER = (r"(?:[$€£₹]|USD\s*|EUR\s*|GBP\s*|INR\s*)?[+-]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?(?:\s*(?:thousand|million|billion|crore|lakh))?"
           r"(?:\s*(?:%|percent\b|employees\b|people\b|units\b|tonnes\b|kg\b|km\b|MW\b))?")


@add("ext_06_number_literals", f"""with {BLOCKS} select document_id, block_id, array_to_string(regexp_extract_all(text, '(?i)(?:^|[^\\w.])({_NUMBER})', 1), ';') as numbers from blocks""")
def number_literals(spark, sf):
    found = extract.matches(F.col("text"), extract.ANY_CASE + extract.NUMBER)
    return report_blocks(spark, sf).select("document_id", "block_id", F.concat_ws(";", F.transform(found, lambda m: m["text"])).alias("numbers"))


def _report_lines(spark, sf):
    """Sentences of the report chunks with their literals."""
    known = extract.evidence_segments(report_chunks(spark, sf)).where("page is not null")
    return extract.literals(extract.sentences(known))


@add("ext_07_suppressed_numbers")
def suppressed_numbers(spark, sf):
    """Numbers per document: found, and left after dates and bare years are taken out."""
    kept = extract.kept_values(F.col("dates"), F.col("numbers"), F.size("metrics") > 0, F.col("is_table"))
    return _report_lines(spark, sf).groupBy("document_id").agg(
        F.sum(F.size("numbers")).alias("number_matches"), F.sum(F.size("dates")).alias("date_matches"), F.sum(F.size(kept)).alias("kept_values"))


@add("ext_08_nearest_metrics")
def nearest_metrics(spark, sf):
    facts = _report_facts(spark, sf)
    return facts.where("word is not null").groupBy("document_id", "word").agg(F.count(F.lit(1)).alias("values"))


def _report_facts(spark, sf):
    return extract.facts(extract.sentences(extract.evidence_segments(report_chunks(spark, sf)).where("page is not null")))


_SENTENCES = f"""{BLOCKS}, s as (select document_id, block_id, false as is_table, trim(unnest(regexp_split_to_array(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(10), 'g'), '\\n+'))) as sentence
    from blocks where block_type <> 'table'
  union all select document_id, block_id, true, line from (select document_id, block_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as n
    from blocks where block_type = 'table') where n > 2)"""


def _sentences(spark, sf):
    """Sentences of every report block, and every table row."""
    rows = report_blocks(spark, sf).select("document_id", "block_id", F.col("text").alias("segment_text"), F.lit(1).alias("page"))
    return extract.sentences(rows)


@add("ext_09_entities", f"""with {_SENTENCES}, e as (select *, trim(regexp_split_to_array(sentence, '(?i)\\b(?:has|had|reported|reports|recorded|revenue|sales|net profit|profit|employees|headcount)\\b')[1], ' |:,-') as subject from s)
select document_id, block_id, sentence, case when not is_table and subject <> '' and len(regexp_extract_all(subject, '\\S+')) <= 6 then subject else 'document subject' end as entity_raw from e""")
def entities(spark, sf):
    rows = _sentences(spark, sf)
    return rows.select("document_id", "block_id", "sentence", extract.entity_of(F.col("sentence"), F.col("is_table")).alias("entity_raw"))


@add("ext_10_scopes", f"""with {_SENTENCES} select document_id, block_id, sentence, nullif(replace(lower(regexp_extract(sentence,
  '(?i)\\b(global(?:ly)?|domestic|international|consolidated|standalone)\\b', 1)), 'globally', 'global'), '') as scope from s""")
def scopes(spark, sf):
    return _sentences(spark, sf).select("document_id", "block_id", "sentence", extract.scope_of(F.col("sentence")).alias("scope"))


# Values of every sentence and of every table cell with its header: dates first, then the numbers outside of them that are no bare year.
_VALUES = f"""{_SENTENCES}, rows as (select document_id, block_id, list_transform(string_split(trim(l[1], '|'), '|'), lambda c: trim(c)) as headers,
    unnest(list_filter(l[3:], lambda x: x <> '')) as line from (select document_id, block_id, string_split(text, chr(10)) as l from blocks where block_type = 'table')),
  cells as (select document_id, block_id, headers, line, list_transform(string_split(trim(line, '|'), '|'), lambda c: trim(c)) as c from rows),
  texts as (select document_id, block_id, false as is_table, sentence as t, null::bigint as column_no, null as header, null as row_name,
      list_distinct(regexp_extract_all(sentence, '\\b(?:19|20)\\d{{2}}\\b')) as years, regexp_matches(sentence, '(?i){extract.METRIC}') as bare from s where not is_table
    union all select document_id, block_id, true, t, i, header, row_name, list_distinct(regexp_extract_all(header, '\\b(?:19|20)\\d{{2}}\\b')), true
      from (select document_id, block_id, unnest(c) as t, unnest(range(0, len(c))) as i, unnest(headers) as header, c[1] as row_name from cells)),
  found as (select *, unnest(regexp_extract_all(t, '(?i){_DATE}')) as v, true as is_date from texts
    union all select *, unnest(regexp_extract_all(regexp_replace(t, '(?i){_DATE}', 'on', 'g'), '(?i)(?:^|[^\\w.])({_NUMBER})', 1)) as v, false from texts),
  vals as (select * exclude (v), trim(v) as v from found where is_date or not (bare and regexp_matches(trim(v), '^(?:19|20)\\d{{2}}$')))"""


@add("ext_11_table_columns", f"""with {_VALUES} select document_id, block_id, column_no, v as value_text, 'Table column: ' || header as qualifier, row_name as metric_raw from vals where is_table""")
def table_columns(spark, sf):
    """Every value of every table row with its column, the column's header and the row's name."""
    tables = report_blocks(spark, sf).where("block_type = 'table'").select("document_id", "block_id", F.col("text").alias("segment_text"), F.lit(1).alias("page"))
    return extract.facts(extract.sentences(tables)).select("document_id", "block_id", F.col("column_no").cast("bigint").alias("column_no"), "value_text", "qualifier", "metric_raw")


@add("ext_12_fallback_metrics")
def fallback_metrics(spark, sf):
    """Values of the plain documents, where no metric word is near: metric from the text before the value."""
    known = extract.evidence_segments(line_chunks(spark, sf)).where("page is not null")
    facts = extract.facts(extract.sentences(known)).where("word is null")
    return facts.select("document_id", "chunk_id", "value_start", "metric_raw", "value_text")


_SYMBOLS = "case symbol " + " ".join(f"when '{symbol}' then '{code}'" for symbol, code in extract.CURRENCY_SYMBOLS.items()) + " else symbol end"


@add("ext_13_units_and_values", f"""with {_VALUES}, parts as (select *, regexp_extract(v, '(?i)^([$€£₹]|USD|EUR|GBP|INR)', 1) as symbol,
    regexp_extract(v, '(?i)(thousand|million|billion|crore|lakh)', 1) as scale, regexp_extract(v, '(?i)(%|percent|employees|people|units|tonnes|kg|km|MW)$', 1) as thing from vals)
select document_id, block_id, v as value_text, case when not is_date then nullif(array_to_string(list_filter([{_SYMBOLS}, scale, thing], lambda x: x <> ''), ' '), '') end as unit,
  case when not is_date then cast(replace(regexp_extract(v, '[+-]?[0-9][0-9,]*(?:\\.[0-9]+)?'), ',', '') as double) end as value_numeric,
  case when not is_date and len(years) = 1 then years[1] end as period, 0.6::double as confidence from parts""")
def units_and_values(spark, sf):
    """All values of all report sentences and table rows: unit, number, period and confidence."""
    return extract.facts(_sentences(spark, sf)).select("document_id", "block_id", "value_text", "unit", "value_numeric", "period", "confidence")


_VALID = f"""with p as ({sql.PERIODS}), r as (select claim_id, period, o_orderpriority as unit, trim(substr(o_orderpriority, 1, 1)) as digit from p join orders on claim_id = 'c' || lpad(cast(o_orderkey as varchar), 10, '0'))"""


@add("ext_15_claim_problems", f"""{_VALID} select claim_id, array_to_string(list_filter([case when digit = '5' then 'blank_claim_text' end, case when digit = '4' then 'blank_scope' end,
  case when digit = '3' then 'bad_value_numeric' end, case when digit = '2' then 'bad_confidence' end, case when digit = '1' then 'bad_source_page' end,
  case when regexp_matches(trim(period), '^\\d{{4}}$') and trim(period) = '0000' or regexp_matches(trim(period), '^\\d{{4}}-02-30$') then 'bad_period' end], lambda x: x is not null), ',') as problems from r""")
def claim_problems(spark, sf):
    """Order rows read as external claims; the order priority decides which field is damaged."""
    digit = F.substring("o_orderpriority", 1, 1)
    orders = derived.table(spark, sf, "orders").select(
        F.concat(F.lit("c"), F.lpad(F.col("o_orderkey").cast("string"), 10, "0")).alias("claim_id"), digit.alias("digit"), F.col("o_orderpriority").alias("unit"))
    d = F.col("digit")
    rows = orders.join(derived.period_texts(spark, sf), "claim_id").select(
        "claim_id", F.lit("Acme").alias("entity_raw"), F.lit("revenue").alias("metric_raw"), F.lit("12").alias("value_text"),
        F.when(d == "3", F.lit("1,200")).otherwise(F.lit("1.5e3")).alias("value_numeric"), "unit", "period",
        F.when(d == "4", F.lit(" ")).alias("scope"), F.lit(None).cast("string").alias("qualifier"),
        F.when(d == "5", F.lit("\n")).otherwise(F.lit("text")).alias("claim_text"), F.when(d == "1", F.lit(0)).otherwise(F.lit(3)).alias("source_page"),
        F.when(d == "2", F.lit("1.01")).otherwise(F.lit("0.5")).alias("confidence"))
    return rows.select("claim_id", F.concat_ws(",", extract.claim_problems()).alias("problems"))


@add("ext_16_grounding", f"""with {sql.SIDES}, chunks as ({sql.CHUNKS}) select s.claim_id, case when c.text is null or not contains(c.text, s.claim_text) or c.page_start <> s.source_page then 'quote_not_in_evidence' end as problem
from sides s left join chunks c on c.document_id = s.document_id and c.chunk_id = 'k' || substr(s.claim_id, 2)""")
def grounding(spark, sf):
    claims = claims_n(spark, sf).withColumn("chunk_id", F.concat(F.lit("k"), F.substring("claim_id", 2, 10)))
    segments = derived.order_chunks(spark, sf).select("document_id", "chunk_id", F.col("page_start").alias("page"), F.col("text").alias("segment_text"))
    return extract.grounded(claims, segments).select("claim_id", "problem")


@add("ext_16_report_grounding")
def report_grounding(spark, sf):
    """Extracted report claims checked against their evidence: counts per problem."""
    made = stored_report_chunks(spark, sf)
    checked = extract.grounded(extract.extract_claims(made), extract.evidence_segments(made))
    return checked.groupBy("document_id", F.coalesce("problem", F.lit("grounded")).alias("problem")).agg(F.count(F.lit(1)).alias("claims"))


@add("ext_17_content_hashes", """select doc_id, sha256(trim(replace(replace(regexp_replace(text, '\\. ', chr(13) || chr(10), 'g') || ' ', chr(13) || chr(10), chr(10)), chr(13), chr(10)), ' ' || chr(10) || chr(9))) as content_hash from documents""")
def content_hashes(spark, sf):
    """Document texts with Windows line endings hash like their Unix form."""
    windows = F.concat(F.regexp_replace("text", r"\. ", "\r\n"), F.lit(" "))
    return derived.table(spark, sf, "documents").select("doc_id", tx.content_hash(windows).alias("content_hash"))


def _two_runs(spark, sf):
    """The document chunks extracted twice, by two runs that share a cache."""
    cache = reuse.ExtractionCache(spark, f"{work_dir(spark)}/cache")
    return cache, [cache.extract(stored_line_chunks(spark, sf), run) for run in range(2)]


@add("ext_18_reused_extractions")
def reused_extractions(spark, sf):
    """Claims and errors of the document chunks in a second run, which finds every content in the cache."""
    _, (_, second) = _two_runs(spark, sf)
    claims = second.claims.select("document_id", "chunk_id", "value_text", "source_page", "extraction_key", F.lit(None).cast("string").alias("message"))
    none = [F.lit(None).cast(kind).alias(name) for name, kind in (("value_text", "string"), ("source_page", "int"), ("extraction_key", "string"))]
    return claims.unionByName(second.errors.select("document_id", F.col("item_id").alias("chunk_id"), *none, "message"))


@add("ext_18_stored_contents", f"""{SPLIT_LINES}, seg as (select content as t from split where page_start = page_end union all
  select substr(s.content, m.chunk_char_start + 1, m.chunk_char_end - m.chunk_char_start) from split s join met m on m.document_id = s.document_id and m.page_batch = s.page_batch and m.n = s.n where s.page_start <> s.page_end)
select sha256(t) as text_hash, count(*) as places, 1::bigint as extracted, 0::bigint as last_run from seg group by t""")
def stored_contents(spark, sf):
    """Every evidence text: its places, how often two runs over all of them extracted it, and the run that did."""
    cache, _ = _two_runs(spark, sf)
    places, _ = extract.content_places(stored_line_chunks(spark, sf), cache.namespace)
    counted = places.groupBy("content_key", F.sha2("segment_text", 256).alias("text_hash")).agg(F.count(F.lit(1)).alias("places"))
    runs = cache.keys.read().groupBy("content_key").agg(F.count(F.lit(1)).alias("extracted"), F.max("run").alias("last_run"))
    return counted.join(runs, "content_key", "left").drop("content_key")


@add("ext_19_stored_confidence", """select l_orderkey, l_partkey, l_suppkey, round(cast(l_discount as decimal(20,10)) * cast(0.12345 as decimal(6,5)) + cast(l_tax as decimal(20,10)) / 2 , 4)::double as confidence from lineitem""")
def stored_confidence(spark, sf):
    value = F.col("l_discount").cast("decimal(12,10)") * F.lit("0.12345").cast("decimal(6,5)") + F.col("l_tax").cast("decimal(12,10)") / 2
    return derived.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", extract.stored_confidence(value).alias("confidence"))


@add("ext_20_extraction_keys")
def extraction_keys(spark, sf):
    counted = [part.groupBy("document_id", "page_batch", "chunk_id").agg(F.count(F.lit(1)).alias("claims"), F.countDistinct("extraction_key").alias("keys"))
               for part in report_claim_parts(spark, sf)]
    return reduce(DataFrame.unionByName, counted).drop("page_batch")


@add("ext_21_pending_chunks", f"with c as ({sql.CHUNKS}) select document_id, chunk_id from c where extraction_status <> 'COMPLETED'")
def pending_chunks(spark, sf):
    c = derived.order_chunks(spark, sf)
    status = c.select("document_id", "chunk_id", "extraction_status")
    return extract.pending_chunks(c.select("document_id", "chunk_id", "text"), status).select("document_id", "chunk_id")


@add("ext_22_extraction_status", f"""{SPLIT_LINES} select document_id, chunk_id,
  case when regexp_matches(replace(content, ',', ''), '\\d{{17}}|\\.\\d{{8}}\\d*[1-9]') then 'FAILED' else 'COMPLETED' end as extraction_status from split""")
def extraction_status(spark, sf):
    """Status of every document chunk after extraction; numbers beyond the value type are recorded as errors."""
    c = stored_line_chunks(spark, sf)
    errors = extract.overflow_errors(c).unionByName(extract.ungrounded_chunks(c)).unionByName(extract.span_errors(c))
    return extract.extraction_status(c, errors)


# --- whole branch -------------------------------------------------------------------------------------------

@add("ext_report_claims")
def extracted_claims(spark, sf):
    """Every claim of the reports."""
    return report_claims(spark, sf).select("document_id", "claim_id", *extract.CLAIM_FIELDS)


@add("ext_document_claims")
def document_claims(spark, sf):
    """Every claim of the plain-text documents."""
    return extract.extract_claims(line_chunks(spark, sf)).select("document_id", "claim_id", *extract.CLAIM_FIELDS)


@add("pai_10_report_class_counts")
def report_class_counts(spark, sf):
    """Candidate pairs of the extracted report claims per class, counted without listing the pairs."""
    claims = normalize.accepted(normalize.normalize_claims(report_claims(spark, sf)))
    return pairs.candidate_counts(pairs.sides(claims))


@add("ver_report_contradictions")
def report_contradictions(spark, sf):
    """Reports end to end: items, blocks, table context, chunks, facts, normalization, pairs, verdicts per document."""
    claims = normalize.accepted(normalize.normalize_claims(report_claims(spark, sf)))
    judged = verdicts.judged(pairs.scored(pairs.candidate_pairs(claims)))
    return judged.groupBy("document_id", "classification", "explanation").agg(F.count(F.lit(1)).alias("pairs"))
