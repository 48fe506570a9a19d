import random
import re
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from claimloom import session
from claimloom.operators import blocks, chunks, context, extract
from claimloom.plans import catalog_documents
from claimloom.sources import derived, intake, responses
from claimloom.sources import text as ts

SIZES = (80, 60, 100, 8)


# --- splitter -------------------------------------------------------------------------------

@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab c.d!\n", min_size=1, max_size=120), min_size=1, max_size=8))
def test_cuts_cover_the_text(parts):
    text = "\n\n".join(parts)
    ends, at = [], 0
    for part in parts:
        ends.append(at + len(part))
        at += len(part) + 2
    cuts = chunks.cut_points(text, ends, SIZES)
    covered = set()
    for start, end, overlap in cuts:
        assert 0 <= start < end <= len(text) and end - start <= SIZES[2] and 0 <= overlap <= SIZES[3]
        covered.update(range(start, end))
    assert all(text[i].isspace() for i in range(len(text)) if i not in covered)
    assert all(a[1] <= b[1] for a, b in zip(cuts, cuts[1:]))


def test_cut_prefers_block_then_sentence_then_word():
    words = "x" * 9 + " "
    text = words * 30                                   # 300 characters, a word end every 10
    start, end, _ = chunks.cut_points(text, [len(text)], SIZES)[0]
    assert start == 0 and text[end] == " "
    block_end = 74
    assert chunks.cut_points(text, [block_end, len(text)], SIZES)[0][1] == block_end
    sentence = text[:70] + "." + text[71:79] + " " + text[80:]
    sentence = sentence[:71] + " " + sentence[72:]
    assert chunks.cut_points(sentence, [len(text)], SIZES)[0][1] == 71


def test_sizes_are_checked():
    with pytest.raises(ValueError):
        chunks.ChunkSizes(minimum=900)
    with pytest.raises(ValueError):
        chunks.ChunkSizes(overlap=600)
    with pytest.raises(ValueError):
        chunks.ChunkSizes(target=800.0)


def items(spark, rows, source="s"):
    """rows: (pos, label, text) on one page."""
    return spark.createDataFrame([("d", p, 1, f"#/{p}", label, text, source) for p, label, text in rows],
                                 "document_id string, pos int, page_number int, self_ref string, label string, text string, source_sha256 string")


def test_sections_and_headings(spark):
    rows = [(1, "text", "before"), (2, "title", "One"), (3, "section_header", "One.a"), (4, "text", "body"), (5, "picture", "p"),
            (6, "text", "  "), (7, "text", "more"), (8, "section_header", "Two"), (9, "text", "end"), (9, "text", "end")]
    made = blocks.blocks_from_items(items(spark, rows))
    assert [(r.text, r.section_heading, r.context_segment[-1]) for r in made.orderBy("pos").collect()] == [
        ("before", None, "0"), ("One", "One", "0"), ("One.a", "One.a", "0"), ("body", "One.a", "0"), ("more", "One.a", "1"), ("Two", "Two", "1"), ("end", "Two", "1")]
    out = chunks.document_chunks(made).orderBy("seq").collect()
    assert [(r.text, r.section) for r in out] == [("before", None), ("One\n\nOne.a\n\nbody\n\nmore", "One.a"), ("Two\n\nend", "Two")]


def test_table_chunk_takes_its_context(spark):
    text = [("section_header", "Results"), ("text", "The following table lists sales."), ("caption", "Table 1 Sales"), ("table", "| a | b (1) |"),
            ("text", "(1) Restated."), ("text", "Other prose.")]
    rows = [("d", i, 1, f"#/{i}", label, t, "s", 50.0, 100.0 + 30 * i, 300.0, 120.0 + 30 * i, [], [], ["#/body"]) for i, (label, t) in enumerate(text)]
    source = spark.createDataFrame(rows, "document_id string, pos int, page_number int, self_ref string, label string, text string, source_sha256 string, "
                                         "box_l double, box_t double, box_r double, box_b double, caption_refs array<string>, footnote_refs array<string>, parent_refs array<string>")
    rb = blocks.report_blocks(source)
    found = chunks.document_chunks(rb, context.table_context(rb)).orderBy("seq").collect()
    assert [(r.kind, r.text) for r in found] == [
        ("table", "Results\n\nThe following table lists sales.\n\nTable 1 Sales\n\n| a | b (1) |\n\n(1) Restated."),
        ("prose", "Other prose.")]
    assert found[0].section == "Results" and found[0].block_types == ["heading", "paragraph", "caption", "table"]


def test_long_run_spans_match_block_text(spark):
    rng = random.Random(1)
    lines = [" ".join("w" * rng.randint(2, 9) for _ in range(rng.randint(20, 90))) + "." for _ in range(60)]
    docs = spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")
    made = blocks.blocks_from_items(ts.line_items(docs))
    found = chunks.document_chunks(made).orderBy("page_batch", "seq").collect()
    text_of = {r.block_id: r.text for r in made.collect()}
    assert len(found) > 3
    for chunk in found:
        assert chunk.text == chunk.text.strip() and chunk.estimated_token_count <= 1000 and chunk.overlap_characters <= 320
        for s in chunk.spans:
            assert chunk.text[s.chunk_char_start:s.chunk_char_end] == text_of[s.block_id][s.char_start:s.char_end]
    assert "".join(sorted("".join(lines).replace(" ", ""))) == "".join(sorted("".join(lines).replace(" ", "")))
    for line in lines:
        assert any(line[:40] in chunk.text for chunk in found)


def test_page_batches_bound_a_long_document(spark):
    """A document with a third of everything is cut into page batches, and no chunk crosses one."""
    docs = spark.createDataFrame([(1, "\n".join(f"line {i}" for i in range(1000)))], "doc_id long, text string")
    found = chunks.document_chunks(blocks.blocks_from_items(ts.line_items(docs)))
    assert found.select("page_batch").distinct().count() == 8
    assert found.where("floor((page_start - 1) / 25) <> floor((page_end - 1) / 25)").count() == 0


# --- facts -----------------------------------------------------------------------------------

def chunk_rows(spark, texts, page=7):
    rows = [("d", f"k{i}", page, page, None, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "document_id string, chunk_id string, page_start int, page_end int, section string, text string")
    return df.withColumn("spans", F.array().cast("array<struct<block_id:string,char_start:int,char_end:int,chunk_char_start:int,chunk_char_end:int,page_number:int,page_numbers:array<int>>>"))


def test_sentence_facts(spark):
    row = extract.extract_claims(chunk_rows(spark, ["As of March 31, 2025, the company employed 300 people globally."])).orderBy("value_text").collect()
    first, second = row
    assert (first.metric_raw, first.value_text, first.value_numeric, first.unit, first.period) == (
        "As of March  ,  , the company employed", "300 people", Decimal("300"), "people", "2025")
    assert (second.metric_raw, second.value_text, second.value_numeric, second.period) == ("As of", "March 31, 2025", None, None)
    assert {(r.entity_raw, r.scope, r.source_page, float(r.confidence)) for r in row} == {("document subject", "global", 7, 0.6)}


def test_table_facts(spark):
    found = extract.extract_claims(chunk_rows(spark, ["| Year | Revenue |\n|---|---|\n| 2024 | $5 million |"])).collect()
    assert [(r.metric_raw, r.value_text, r.value_numeric, r.unit, r.period, r.qualifier) for r in found] == [
        ("2024", "$5 million", Decimal("5"), "USD million", None, "Table column: Revenue")]


def test_entity_metric_and_repeats(spark):
    text = "Acme Ltd reported revenue of EUR 1,250.5 million in 2023. Acme Ltd reported revenue of EUR 1,250.5 million in 2023."
    found = extract.extract_claims(chunk_rows(spark, [text])).collect()
    assert [(r.entity_raw, r.metric_raw, r.value_text, r.value_numeric, r.unit, r.period) for r in found] == [
        ("Acme Ltd", "revenue", "EUR 1,250.5 million", Decimal("1250.5"), "EUR million", "2023")]


def test_huge_numbers_are_errors_not_claims(spark):
    c = chunk_rows(spark, ["Serial 123456789012345678901234567890 shipped.", "Plain 12 here."])
    assert [r.item_id for r in extract.overflow_errors(c).collect()] == ["k0"]
    status = {r.chunk_id: r.extraction_status for r in extract.extraction_status(c, extract.overflow_errors(c)).collect()}
    assert status == {"k0": "FAILED", "k1": "COMPLETED"}


def test_native_matches_equal_python(spark, sf):
    """Offsets and texts of the literal scan equal Python's finditer over every document line with a digit."""
    lines = ts.line_items(spark.read.parquet(f"{sf}/documents.parquet")).where(F.col("text").rlike(r"\d")).select("text")
    for pattern in (extract.NUMBER, extract.DATE, extract.YEAR, extract.METRIC):
        rows = lines.select("text", extract.matches(F.col("text"), extract.ANY_CASE + pattern).alias("m")).collect()
        for row in rows:
            want = [(m.start(), m.group()) for m in re.finditer(pattern, row.text, re.I)]
            assert [(m.start, m.text) for m in row.m] == want
    assert len(rows) > 10


def test_multi_page_segments(spark):
    span = "array<struct<block_id:string,char_start:int,char_end:int,chunk_char_start:int,chunk_char_end:int,page_number:int,page_numbers:array<int>>>"
    row = ("d", "k", 1, 2, None, "one 1\n\ntwo 2\n\nboth 3", [("a", 0, 5, 0, 5, 1, [1]), ("b", 0, 5, 7, 12, 2, [2]), ("c", 0, 6, 14, 20, 1, [1, 2])])
    c = spark.createDataFrame([row], f"document_id string, chunk_id string, page_start int, page_end int, section string, text string, spans {span}")
    assert [(r.segment_text, r.page) for r in extract.evidence_segments(c).collect()] == [("one 1", 1), ("two 2", 2), ("both 3", None)]
    assert sorted((r.value_text, r.source_page) for r in extract.extract_claims(c).collect()) == [("1", 1), ("2", 2)]
    assert extract.ungrounded_chunks(c).count() == 0 and extract.span_violations(c).count() == 0


SPAN = "array<struct<block_id:string,char_start:int,char_end:int,chunk_char_start:int,chunk_char_end:int,page_number:int,page_numbers:array<int>>>"
CHUNK = f"document_id string, chunk_id string, page_start int, page_end int, section string, text string, spans {SPAN}"


def test_reuse_equals_plain_extraction(spark):
    """One content in most chunks, the same sentence on two pages, Windows line endings, a broken span: reuse changes nothing."""
    said = "Acme has 5 employees."
    rows = [("d", f"k{i}", i + 1, i + 1, None, said, []) for i in range(12)] + [("d", "k12", 1, 1, None, f"  {said}\r\nBeta has 7 units.", [])]
    rows += [("d", f"two{i}", 1, 2, None, f"{said}\n\n{said}", [("a", 0, 21, 0, 21, 1, [1]), ("b", 0, 21, 23, 44, 2, [2])]) for i in range(3)]
    rows += [("d", "broken", 1, 2, None, f"{said}\n\n{said}", [("a", 0, 21, 0, 21, 1, [1]), ("b", 0, 21, 40, 90, 2, [2])])]
    c = spark.createDataFrame(rows, CHUNK)
    claims, errors = extract.extract_distinct(c)
    fields = ["chunk_id", "value_text", "source_page", "extraction_key", "claim_id"]
    found = sorted(claims.select(*fields).collect())
    assert found == sorted(extract.extract_claims(c).select(*fields).collect())
    assert sorted(r.source_page for r in found if r.chunk_id == "two1") == [1, 2]
    assert len({r.claim_id for r in found}) == len(found) == 12 + 2 + 6
    assert [(r.item_id, r.message) for r in errors.collect()] == [("broken", "invalid_offsets")]
    status = {r.chunk_id: r.extraction_status for r in extract.extraction_status(c, errors).collect()}
    assert status.pop("broken") == "FAILED" and set(status.values()) == {"COMPLETED"}


def test_reuse_reports_numbers_that_do_not_fit(spark):
    """At every place of a repeated content, beside its other claims, as the plain extraction does; a plain extractor still plugs in."""
    said = "Total of 12345678901234567 units and 0.123456781 units. Acme has 5 employees."
    c = chunk_rows(spark, [said, "Beta has 7 units.", said, f"{said} More."])
    claims, errors = extract.extract_distinct(c)
    wanted = sorted((r.document_id, r.stage, r.item_id, r.message) for r in extract.overflow_errors(c).collect())
    assert sorted((r.document_id, r.stage, r.item_id, r.message) for r in errors.collect()) == wanted
    assert {(w[2], w[3]) for w in wanted} == {(k, "value_overflow") for k in ("k0", "k2", "k3")}
    assert sorted(r.claim_id for r in claims.collect()) == sorted(r.claim_id for r in extract.extract_claims(c).collect())
    status = {r.chunk_id: r.extraction_status for r in extract.extraction_status(c, errors).collect()}
    assert status == {"k0": "FAILED", "k1": "COMPLETED", "k2": "FAILED", "k3": "FAILED"}
    assert sorted(r.claim_id for r in extract.extract_distinct(c, extract.extract_claims)[0].collect()) == sorted(r.claim_id for r in claims.collect())


def test_numbers_that_do_not_fit_are_errors(spark):
    """Neither rounded together nor silently dropped."""
    c = chunk_rows(spark, ["Share of 0.123456781 units.", "Share of 0.123456784 units.", "Total of 12345678901234567 units.", "Share of 0.12345678 units."])
    assert [r.value_text for r in extract.extract_claims(c).collect()] == ["0.12345678 units"]
    assert sorted(r.item_id for r in extract.overflow_errors(c).collect()) == ["k0", "k1", "k2"]


def test_every_table_becomes_a_chunk(spark):
    """Without context a table stands alone, with the headings right before it; with context nothing is lost either."""
    items = [("d", 1, 1, "#/1", "section_header", "Sales", "s"), ("d", 2, 1, "#/2", "table", "|a|b|\n|:---|:---|\n|x|1|", "s"), ("d", 3, 1, "#/3", "text", "Closing words.", "s")]
    rows = blocks.blocks_from_items(spark.createDataFrame(items, "document_id string, pos bigint, page_number int, self_ref string, label string, text string, source_sha256 string"))
    found = [(r.kind, r.text) for r in chunks.document_chunks(rows).orderBy("seq").collect()]
    assert found == [("table", "Sales\n\n|a|b|\n|:---|:---|\n|x|1|"), ("prose", "Closing words.")]


def test_splitter_cuts_between_words_of_long_runs():
    text = "word " * 4000
    cuts = chunks.cut_points(text, [], SIZES)
    assert cuts[0][0] == 0 and cuts[-1][1] == len(text)
    assert all(b[0] <= a[1] and b[2] == a[1] - b[0] for a, b in zip(cuts, cuts[1:])) and all(text[s - 1] == " " for s, _, _ in cuts[1:])


def test_grounding(spark):
    c = chunk_rows(spark, ["Loss was (1,200) units."])
    rows = [("(1,200)", Decimal("-1200"), "Loss was (1,200) units.", 7, None), ("(1,200)", Decimal("1200"), "Loss was (1,200) units.", 7, "number_not_in_value"),
            ("9", None, "Loss was (1,200) units.", 7, "value_not_in_quote"), ("1,200", None, "Loss was (1,200) units.", 8, "quote_not_in_evidence")]
    claims = spark.createDataFrame([("d", "k0", *r) for r in rows],
                                   "document_id string, chunk_id string, value_text string, value_numeric decimal(24,8), claim_text string, source_page int, want string")
    assert all(r.problem == r.want for r in extract.grounded(claims, extract.evidence_segments(c)).collect())


def test_strict_responses(spark):
    base = '{"entity_raw":"a","entity_normalized":null,"metric_raw":"m","metric_normalized":null,"value_text":"1","value_numeric":%s,"claim_text":"t","source_page":%s}'
    cases = {'{"claims":[' + base % ("0.10000000000000000001", "1") + "]}": None, '{"claims":[],"claims":[]}': "duplicate_field",
             '{"claims":[' + base % ("NaN", "1") + "]}": "non_finite_number", "{": "malformed_json", '{"other":[]}': "unexpected_fields",
             '{"claims":[' + base % ("true", "1") + "]}": "wrong_type", '{"claims":[' + base % ("1", '"1"') + "]}": "wrong_type", '{"claims":[]}': None}
    rows = responses.read_claim_responses(spark.createDataFrame([(c,) for c in cases], "response string")).collect()
    assert {r.response: r.error for r in rows} == cases
    assert rows[0].claims[0].value_numeric == "0.10000000000000000001"


# --- sources ------------------------------------------------------------------------------------

def test_intake_and_user_parser(spark, tmp_path):
    (tmp_path / "good.pdf").write_bytes(b"junk\n%PDF-1.7\nfirst\nsecond")
    (tmp_path / "late.pdf").write_bytes(b" " * 1020 + b"%PDF-1.7")
    (tmp_path / "note.txt").write_bytes(b"%PDF-1.7")
    (tmp_path / "big.PDF").write_bytes(b"%PDF-" + b"x" * 3000)
    files = intake.scan(spark, str(tmp_path))
    refused = {r.path.rsplit("/", 1)[-1]: r.problem for r in intake.refused_files(files, max_bytes=2000).collect()}
    assert refused == {"late.pdf": "bad_signature", "note.txt": "wrong_suffix", "big.PDF": "too_large"}

    def parser(path, content):
        for n, line in enumerate(content.decode().split("\n")[2:]):
            yield {"document_id": path.rsplit("/", 1)[-1], "pos": n, "page_number": 1, "self_ref": f"#/{n}", "label": "text", "text": line, "source_sha256": "s"}

    parsed = intake.parse_files(intake.accepted_files(files, max_bytes=2000), parser)
    assert [r.text for r in blocks.blocks_from_items(parsed).orderBy("pos").collect()] == ["first", "second"]


def test_html_pieces(spark):
    html = "<head><title>x</title></head><body><!-- no --><h1>A &amp; B</h1><p>One<br>two <b>bold</b><p>Three<ul><li>item</ul><footer>end</footer>"
    rows = ts.html_items(spark.createDataFrame([(1, html)], "page_id long, html string")).orderBy("pos").collect()
    assert [(r.label, r.text) for r in rows] == [("title", "A & B"), ("text", "One"), ("text", "two bold"), ("text", "Three"), ("list_item", "item"), ("page_footer", "end")]


def test_chunk_records_keep_corrupt_lines_apart(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"chunk_id":"a","page_start":7,"page_end":7,"text":"t","block_types":["paragraph"]}\nnot json\n')
    rows = responses.read_chunk_records(spark, str(tmp_path)).collect()
    assert [(r.chunk_id, r.page_start) for r in rows if r._corrupt is None] == [("a", 7)] and sum(r._corrupt is not None for r in rows) == 1


# --- stages by page batch ----------------------------------------------------------------------

def shuffled(df):
    """Exchanges of the plan, the small side of a broadcast apart."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning") + plan.count("Exchange RoundRobin")


def test_report_steps_read_stored_batches_without_a_shuffle(spark, sf):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        rb, made = catalog_documents.report_blocks(spark, sf), catalog_documents.report_chunks(spark, sf)
        for df in (context.neighbour_distances(rb), context.table_sections(rb), catalog_documents.table_context(spark, sf),
                   chunks.sectioned(rb, chunks.bare_tables(rb)), extract.sentences(extract.evidence_segments(made.drop("seq")))):
            assert shuffled(df) == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_report_items_are_dealt_once(spark, sf):
    items = derived.report_batches(spark, sf)
    order = Window.partitionBy(*blocks.BATCH).orderBy(*blocks.ORDER)
    assert shuffled(items.withColumn("n", F.row_number().over(order))) == 1
    assert items.rdd.getNumPartitions() == derived.slices(spark, sf, "lineitem")
    assert items.drop("page_batch").exceptAll(derived.report_items(spark, sf)).count() == 0


def test_report_claims_stay_where_their_page_batches_lie(spark, sf):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # what is sent whole here is joined at size
    try:
        whole, cut, of_tables = catalog_documents.report_claim_parts(spark, sf)
        for part in (whole, of_tables):
            assert shuffled(part) == shuffled(part.groupBy("document_id", "page_batch", "chunk_id").count()) == 0
        assert cut.count() == 0  # no report run is longer than a chunk
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_runs_apart_give_the_chunks_of_all_runs(spark, sf):
    """Runs that fit and runs that are cut, apart, against all at once."""
    lines = catalog_documents.line_blocks(spark, sf)
    sections = chunks.sectioned(lines, chunks.bare_tables(lines))
    runs, fields = chunks.prose_runs(sections), ["document_id", "page_batch", "chunk_id", "overlap_characters"]
    apart = [made(runs).select(*fields).collect() for made in (chunks.fitting_run_chunks, chunks.cut_run_chunks)]
    assert all(apart) and sorted(apart[0] + apart[1]) == sorted(chunks.prose_chunks(sections).select(*fields).collect())


def test_spans_carry_their_own_characters_only(spark, sf):
    """A chunk's text repeated beside each of its spans grows with the square of the chunk."""
    made = catalog_documents.line_chunks(spark, sf)
    spans = chunks.span_texts(made)
    assert spans.columns == ["document_id", "page_batch", "chunk_id", "block_id", "char_start", "char_end", "span_text"]
    texts = catalog_documents.line_blocks(spark, sf).select("document_id", "page_batch", "block_id", "text")
    joined = spans.join(texts, ["document_id", "page_batch", "block_id"])
    wrong = joined.where(F.expr("span_text <> substring(text, char_start + 1, char_end - char_start)"))
    assert joined.count() == made.select(F.explode("spans")).count() > 0 and wrong.count() == 0


def test_buckets_grow_with_the_bytes_of_a_table(spark, tmp_path):
    """Whatever its splits are: a bucket that grows with the table no longer fits the sorts of a task."""
    for name, rows in (("small", 1_000), ("large", 2_000_000)):
        (tmp_path / name).mkdir()
        spark.range(rows).select(F.sha2(F.col("id").cast("string"), 256).alias("text")).write.parquet(f"{tmp_path}/{name}/documents.parquet")
    size = sum(f.stat().st_size for f in (tmp_path / "large" / "documents.parquet").glob("*.parquet"))
    spark.conf.set("spark.sql.files.openCostInBytes", "1g")  # one split, as few cores or large files give
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    try:
        small, large = (derived.slices(spark, str(tmp_path / name), "documents") for name in ("small", "large"))
        assert large * derived.SLICE_BYTES >= size > small * derived.SLICE_BYTES
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
        spark.conf.unset("spark.sql.files.minPartitionNum")


def test_rows_of_one_bucket_are_written_without_a_sort(spark, tmp_path):
    spark.range(1_000).write.parquet(f"{tmp_path}/ids")
    ids = spark.read.parquet(f"{tmp_path}/ids").repartition(4, "id")
    stored = session.materialize_by(ids, "ids", ["id"], 4)
    assert len(stored.inputFiles()) == 4 and stored.count() == 1_000
    assert int(spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")) > 0


@pytest.mark.parametrize("stage", ["resolved", "table_context", "report_chunks", "line_chunks"])
def test_a_stage_has_one_file_per_bucket(spark, sf, stage):
    """A task that holds rows of all buckets writes a file for each of them: tasks times buckets."""
    stored = {"report_chunks": catalog_documents.stored_report_chunks, "line_chunks": catalog_documents.stored_line_chunks}
    read = stored.get(stage) or getattr(catalog_documents, stage)
    before = {name: spark.conf.get(name) for name in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as many tasks as at size,
    spark.conf.set("spark.sql.shuffle.partitions", "7")  # and no divisor of the buckets
    try:
        files = read(spark, f"{sf}/.").inputFiles()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert len(files) <= derived.slices(spark, f"{sf}/.", "documents" if stage == "line_chunks" else "lineitem")


@pytest.mark.parametrize("read", [extract.found_facts, extract.evidence_segments, chunks.span_texts])
def test_filters_repeat_neither_trimming_nor_splitting(spark, read):
    """Spark moves filters below columns and writes the columns' expressions into them: texts were trimmed anew for every block of a chunk."""
    rows = blocks.blocks_from_items(items(spark, [(1, "text", "Some words. Sales 12."), (2, "table", "|a|b|\n|-|-|\n|c|3|")]))
    plan = read(chunks.document_chunks(rows))._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if re.match(r"[ :+|-]*Filter ", line)]
    assert filters and not [line for line in filters if "regexp_replace" in line or "split(" in line]
    assert all(row.lead == len(row.raw) - len(row.raw.lstrip()) for row in session.computed(
        spark.createDataFrame([("  a",), ("",)], "raw string"), lead=F.length("raw") - F.length(F.ltrim("raw"))).collect())
