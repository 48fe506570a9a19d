"""Literal facts out of chunks: dates and numbers with entity, metric, unit, period and scope.

The scan uses Spark's regular expressions only.  ``regexp_extract_all`` gives the matches
and ``split`` with the same pattern the text between them, so the offset of every match is
the length of what precedes it; no Python worker is involved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions.text import WS, is_blank, strip
from claimloom.functions.units import literal_map
from claimloom.session import computed

# --- fixed values -----------------------------------------------------------
DATE = (r"\b(?:\d{4}-\d{2}-\d{2}|\d{1,2}[/-]\d{1,2}[/-]\d{4}|(?:January|February|March|April|May|June|July|August|"
        r"September|October|November|December)\s+\d{1,2},?\s+\d{4})\b")
NUMBER = (r"(?<![\w.])([$€£₹]|USD\s*|EUR\s*|GBP\s*|INR\s*)?([+-]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?)"
          r"(?:\s*(thousand|million|billion|crore|lakh))?"
          r"(?:\s*(%|percent\b|employees\b|people\b|units\b|tonnes\b|kg\b|km\b|MW\b))?")
METRIC = (r"\b(?:revenue|sales|net profit|profit|operating margin|margin|employee count|employees|headcount|capacity|"
          r"production|assets|liabilities|cost|expenses|customers|deadline|launch date)\b")
YEAR = r"\b(?:19|20)\d{2}\b"
SUBJECT_END = r"\b(?:has|had|reported|reports|recorded|revenue|sales|net profit|profit|employees|headcount)\b"
SCOPE = r"\b(global(?:ly)?|domestic|international|consolidated|standalone)\b"
SENTENCE_BREAK = rf"(?<=[.!?]){WS}+|\n+"
CURRENCY_SYMBOLS = {"$": "USD", "€": "EUR", "£": "GBP", "₹": "INR"}
LITERAL = r"(?<![\w.])[+-]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.])"
UNKNOWN_ENTITY, TABLE_METRIC, DATE_METRIC, NUMBER_METRIC = "document subject", "table value", "date", "quantity"
ENTITY_WORDS, METRIC_CHARACTERS = 6, 100
CONFIDENCE = "0.6"
# ---------------------------------------------------------------------------

CASED, ANY_CASE = "(?U)", "(?iuU)"
CLAIM_FIELDS = ["entity_raw", "metric_raw", "value_text", "value_numeric", "unit", "period", "scope", "qualifier",
                "claim_text", "source_page", "confidence"]


def matches(text: Column, pattern: str) -> Column:
    """All matches as ``array<struct<start, text>>`` with zero-based offsets."""
    pieces = F.arrays_zip(F.split(text, pattern).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
    nothing = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,text:string>>").alias("found"))

    def step(done, piece):
        start = done["at"] + F.length(piece["gap"])
        hit = F.array(F.struct(start.alias("start"), piece["hit"].alias("text")))
        return F.when(piece["hit"].isNull(), done).otherwise(F.struct(
            (start + F.length(piece["hit"])).alias("at"), F.concat(done["found"], hit).alias("found")))

    return F.aggregate(pieces, nothing, step, lambda done: done["found"])


# --- segments and sentences -------------------------------------------------------------

def evidence_segments(chunks: DataFrame) -> DataFrame:
    """One segment for a one-page chunk, else one per span; the page is null unless it is certain."""
    one_page = F.col("page_start") == F.col("page_end")
    whole = F.array(F.struct(F.lit(0).alias("start"), F.length("text").alias("end"), F.col("page_start").alias("page")))
    parts = F.transform("spans", lambda s: F.struct(
        s["chunk_char_start"].alias("start"), s["chunk_char_end"].alias("end"),
        F.when((F.size(s["page_numbers"]) == 1) & (F.get(s["page_numbers"], 0) == s["page_number"])
               & s["page_number"].between(F.col("page_start"), F.col("page_end")), s["page_number"]).alias("page")))
    return chunks.select("*", F.posexplode(F.when(one_page, whole).otherwise(parts)).alias("segment", "s")).select(
        "*", F.col("s.start").alias("segment_start"), F.col("s.page").alias("page"),
        F.expr("substring(text, s.start + 1, s.end - s.start)").alias("segment_text")).drop("s")


def _span_problem(span: Column) -> Column:
    start, end = span["chunk_char_start"], span["chunk_char_end"]
    return (F.when(start.isNull() | end.isNull() | (start < 0) | (start >= end) | (end > F.length("text")),
                   F.lit("invalid_offsets")).when(span["block_id"].isNull(), F.lit("invalid_block_identifier")))


def is_broken() -> Column:
    """Whether the chunk has several pages and a span with a problem; looks at its own row alone."""
    some = F.coalesce(F.exists("spans", lambda s: _span_problem(s).isNotNull()), F.lit(False))
    return F.coalesce(F.col("page_start") != F.col("page_end"), F.lit(False)) & some


def span_violations(chunks: DataFrame) -> DataFrame:
    """Spans of multi-page chunks that are out of order, out of bounds or without a block."""
    spans = chunks.where("page_start <> page_end").select("document_id", "chunk_id", "text", F.explode("spans").alias("s"))
    return spans.withColumn("problem", _span_problem(F.col("s"))).where("problem is not null").select("document_id", "chunk_id", "problem")


def ungrounded_chunks(chunks: DataFrame) -> DataFrame:
    """Multi-page chunks without any span of a certain page: these cannot be extracted."""
    certain = F.exists("spans", lambda s: (F.size(s["page_numbers"]) == 1) & (F.get(s["page_numbers"], 0) == s["page_number"])
                       & s["page_number"].between(F.col("page_start"), F.col("page_end")))
    return chunks.where((F.col("page_start") != F.col("page_end")) & ~certain).select(
        "document_id", F.lit("EXTRACTING_CLAIMS").alias("stage"), F.col("chunk_id").alias("item_id"),
        F.lit("no_certain_page").alias("message"))


def _cells(sentence: Column) -> Column:
    return F.transform(F.split(F.btrim(sentence, F.lit("|")), r"\|"), strip)


def sentences(segments: DataFrame) -> DataFrame:
    """Sentences and lines of each segment, table rows with their cells and the segment's header row.

    Separator rows and the header row itself are left out.
    """
    pieces = F.filter(F.transform(F.split("segment_text", CASED + SENTENCE_BREAK), strip), lambda s: s != "")
    kept = F.filter("lines", lambda s: ~s.contains("|") | F.exists(_cells(s), lambda c: ~c.rlike(r"^[:\- ]*$")))
    staged = computed(segments.withColumn("lines", pieces), lines=kept)
    header = F.array_min(F.filter(F.transform("lines", lambda s, i: F.when(s.contains("|"), i)), lambda i: i.isNotNull()))
    staged = (staged.withColumn("header_at", header)
              .withColumn("headers", F.when(F.col("header_at").isNotNull(), _cells(F.get("lines", F.col("header_at"))))))
    rows = staged.select("*", F.posexplode("lines").alias("line", "sentence")).drop("lines")
    return (rows.where(F.col("header_at").isNull() | (F.col("line") != F.col("header_at")))
            .withColumn("is_table", F.col("sentence").contains("|")).drop("header_at"))


# --- facts --------------------------------------------------------------------------------

def literals(lines: DataFrame) -> DataFrame:
    """Add the date, number, metric and year matches of each sentence that holds a digit."""
    s = F.col("sentence")
    return (lines.where(s.rlike(r"(?U)\d"))
            .withColumn("dates", matches(s, ANY_CASE + DATE)).withColumn("numbers", matches(s, ANY_CASE + NUMBER))
            .withColumn("metrics", matches(s, ANY_CASE + METRIC))
            .withColumn("years", F.array_distinct(F.regexp_extract_all(s, F.lit(CASED + YEAR), F.lit(0)))))


def subject_of(sentence: Column) -> Column:
    return F.btrim(F.get(F.split(sentence, ANY_CASE + SUBJECT_END, 2), 0), F.lit(" |:,-"))


def named_subject(subject: Column, is_table: Column) -> Column:
    words = F.regexp_count(subject, F.lit(rf"(?U)[^\s\x1c-\x1f]+"))
    return F.when(~is_table & (subject != "") & (words <= ENTITY_WORDS), subject).otherwise(F.lit(UNKNOWN_ENTITY))


def entity_of(sentence: Column, is_table: Column) -> Column:
    """Text before the first verb or metric word when it has at most six words; never for tables."""
    return named_subject(subject_of(sentence), is_table)


def scope_of(sentence: Column) -> Column:
    return F.nullif(F.replace(F.lower(F.regexp_extract(sentence, ANY_CASE + SCOPE, 1)), F.lit("globally"), F.lit("global")), F.lit(""))


def kept_values(dates: Column, numbers: Column, has_metric: Column, is_table: Column) -> Column:
    """Dates, and numbers that are neither part of a date nor a bare year beside a metric or in a table."""
    bare_year = rf"^{YEAR}$"
    free = F.filter(numbers, lambda n: ~F.exists(dates, lambda d: (d["start"] <= n["start"]) & (
        n["start"] < d["start"] + F.length(d["text"]))) & ~(strip(n["text"]).rlike(bare_year) & (has_metric | is_table)))

    def tagged(values, is_date):
        parts = (lambda v: F.lit(None).cast("array<string>")) if is_date else (lambda v: number_parts(v["text"]))
        return F.transform(values, lambda v: F.struct(
            v["start"].alias("start"), strip(v["text"]).alias("text"), F.lit(is_date).alias("is_date"), parts(v).alias("parts")))

    return F.concat(tagged(dates, True), tagged(free, False))


def nearest_metric(metrics: Column, start: Column) -> Column:
    best = F.array_min(F.transform(metrics, lambda m: F.struct(
        F.abs(m["start"] - start).alias("distance"), m["start"].alias("at"), F.lower(m["text"]).alias("word"))))
    return best["word"]


def number_parts(literal: Column) -> Column:
    """Currency, digits, scale word and unit word of a number literal, in one match."""
    parts = F.regexp_replace(literal, ANY_CASE + "^" + NUMBER + "$", "$1\u0001$2\u0001$3\u0001$4")
    return F.transform(F.split(parts, "\u0001"), strip)


def unit_of(parts: Column) -> Column:
    """Currency code, scale word and unit word, joined; null when the literal has none."""
    symbol = F.get(parts, 0)
    currency = F.coalesce(F.try_element_at(literal_map(CURRENCY_SYMBOLS), symbol), symbol)
    words = F.filter(F.array(currency, F.get(parts, 2), F.get(parts, 3)), lambda w: w != "")
    return F.nullif(F.array_join(words, " "), F.lit(""))


def facts(lines: DataFrame) -> DataFrame:
    """One row per value of the sentences, in claim form; ``overflow`` marks numbers that DECIMAL(24,8) cannot hold exactly."""
    has_metric = F.size("metrics") > 0
    found = (literals(lines)
             .withColumn("subject", subject_of(F.col("sentence")))
             .withColumn("entity_raw", named_subject(F.col("subject"), F.col("is_table")))
             .withColumn("scope", scope_of(F.col("sentence")))
             .withColumn("cells", F.when(F.col("is_table"), _cells(F.col("sentence"))))
             .withColumn("v", F.explode(kept_values(F.col("dates"), F.col("numbers"), has_metric, F.col("is_table")))))
    table, is_date, start = F.col("is_table"), F.col("v.is_date"), F.col("v.start")
    staged = (found.withColumn("prefix", F.expr("substring(sentence, 1, v.start)"))
              .withColumn("column_no", F.length("prefix") - F.length(F.replace("prefix", F.lit("|"), F.lit("")))
                          - F.when(F.col("sentence").startswith("|"), 1).otherwise(0))
              .withColumn("header", F.when(table & (F.col("column_no") >= 0), F.nullif(F.get("headers", F.col("column_no")), F.lit(""))))
              .withColumn("word", nearest_metric(F.col("metrics"), start)))
    before = F.when(F.col("word").isNull() & ~table, F.btrim(F.regexp_replace("prefix", ANY_CASE + NUMBER, " "), F.lit(" :|,.-")))
    fallback = F.coalesce(F.nullif(F.when(F.length(before) > METRIC_CHARACTERS, F.expr("right(_before, 100)"))
                                   .otherwise(F.col("_before")), F.lit("")),
                          F.when(is_date, F.lit(DATE_METRIC)).otherwise(F.lit(NUMBER_METRIC)))
    staged = staged.withColumn("_before", before)
    metric = F.when(table, F.coalesce(F.nullif(F.get("cells", 0), F.lit("")), F.col("word"), F.lit(TABLE_METRIC))).otherwise(
        F.coalesce(F.col("word"), fallback))
    years = F.when(table, F.array_distinct(F.regexp_extract_all(F.coalesce("header", F.lit("")), F.lit(CASED + YEAR), F.lit(0)))).otherwise(F.col("years"))
    staged = staged.withColumn("_years", years).withColumn("value_text", F.col("v.text"))
    digits = F.when(~is_date, F.replace(F.get("v.parts", 1), F.lit(","), F.lit("")))
    return (staged.withColumn("metric_raw", metric).withColumn("_digits", digits)
            .withColumn("value_numeric", F.col("_digits").try_cast("decimal(24,8)"))
            .withColumn("overflow", F.col("_digits").isNotNull() & (F.col("value_numeric").isNull() | F.col("_digits").rlike(r"\.\d{8}\d*[1-9]")))
            .withColumn("unit", F.when(~is_date, unit_of(F.col("v.parts"))))
            .withColumn("period", F.when(~is_date & (F.size("_years") == 1), F.get("_years", 0)))
            .withColumn("qualifier", F.concat(F.lit("Table column: "), F.col("header")))
            .withColumn("claim_text", F.col("sentence")).withColumn("source_page", F.col("page"))
            .withColumn("confidence", F.lit(CONFIDENCE).cast("decimal(5,4)"))
            .withColumn("value_start", start).withColumn("is_date", is_date))


def extraction_key() -> Column:
    """Content key of a claim inside its chunk: hash of its fields in name order."""
    return F.sha2(F.to_json(F.struct(*sorted(["chunk_id", *CLAIM_FIELDS])), {"ignoreNullFields": "false"}), 256)


def claim_id() -> Column:
    return F.sha2(F.concat_ws("|", "document_id", "chunk_id", "extraction_key"), 256)


def found_facts(chunks: DataFrame) -> DataFrame:
    """Facts of all chunks whose spans are in order, those that overflow included."""
    return facts(sentences(evidence_segments(chunks.where(~is_broken())).where("page is not null")))


def distinct_claims(found: DataFrame) -> DataFrame:
    """One row per distinct claim of a chunk, with the page batch where the facts still name it.

    The key of a claim stands for its fields, so the fields themselves are compared, before keys are made.  A chunk lies in one page batch:
    facts that name theirs are compared where they lie.
    """
    batch = ["page_batch"] if "page_batch" in found.columns else []
    distinct = found.where("not overflow").select("document_id", *batch, "chunk_id", *CLAIM_FIELDS).distinct()
    return distinct.withColumn("extraction_key", extraction_key()).withColumn("claim_id", claim_id())


def claims_of(found: DataFrame) -> DataFrame:
    """One row per distinct claim of a chunk."""
    return distinct_claims(found).drop("page_batch")


def extract_claims(chunks: DataFrame) -> DataFrame:
    """Claims of all chunks (one row per distinct claim of a chunk)."""
    return claims_of(found_facts(chunks))


def overflows_of(found: DataFrame) -> DataFrame:
    return found.where("overflow").select("document_id", F.lit("EXTRACTING_CLAIMS").alias("stage"), F.col("chunk_id").alias("item_id"),
                                          F.lit("value_overflow").alias("message"))


def overflow_errors(chunks: DataFrame) -> DataFrame:
    return overflows_of(found_facts(chunks))


def span_errors(chunks: DataFrame) -> DataFrame:
    """Chunks that cannot be read because their spans are not in order."""
    return span_violations(chunks).select("document_id", F.lit("EXTRACTING_CLAIMS").alias("stage"), F.col("chunk_id").alias("item_id"), F.col("problem").alias("message"))


# --- progress of extraction ----------------------------------------------------------------

def pending_chunks(chunks: DataFrame, status: DataFrame) -> DataFrame:
    """Chunks whose extraction is not completed yet; ``status`` holds (document_id, chunk_id, extraction_status)."""
    done = status.where("extraction_status = 'COMPLETED'").select("document_id", "chunk_id")
    return chunks.join(done, ["document_id", "chunk_id"], "left_anti")


def extraction_status(chunks: DataFrame, errors: DataFrame) -> DataFrame:
    """COMPLETED for every processed chunk, with or without claims; FAILED where an error was recorded."""
    failed = errors.select("document_id", F.col("item_id").alias("chunk_id")).distinct().withColumn("failed", F.lit(True))
    return chunks.select("document_id", "chunk_id").join(failed, ["document_id", "chunk_id"], "left").select(
        "document_id", "chunk_id", F.when(F.col("failed"), F.lit("FAILED")).otherwise(F.lit("COMPLETED")).alias("extraction_status"))


# --- reuse of results for equal content ---------------------------------------------------------

def content_key(namespace: str) -> Column:
    return F.sha2(F.to_json(F.struct(F.col("segment_text").alias("text"), F.col("section"), F.lit(namespace).alias("extractor")),
                            {"ignoreNullFields": "false"}), 256)


CONTENT_FIELDS = [f for f in CLAIM_FIELDS if f != "source_page"]  # what depends on the evidence text alone


def content_places(chunks: DataFrame, namespace: str) -> tuple[DataFrame, DataFrame]:
    """(document_id, chunk_id, content_key, segment_text, section, source_page) of every evidence text, and the errors of chunks without one."""
    broken = span_errors(chunks)
    sound = chunks.where(~is_broken())
    places = evidence_segments(sound).where("page is not null").select(
        "document_id", "chunk_id", content_key(namespace).alias("content_key"), "segment_text", "section", F.col("page").alias("source_page"))
    return places, broken.unionByName(ungrounded_chunks(sound))


def content_chunks(contents: DataFrame, spans_type) -> DataFrame:
    """Contents (content_key, text, section) as one-page chunks, for an extractor."""
    return contents.select(F.lit("").alias("document_id"), F.col("content_key").alias("chunk_id"), F.lit(1).alias("page_start"), F.lit(1).alias("page_end"),
                           "section", "text", F.array().cast(spans_type).alias("spans"))


def no_facts(spark: SparkSession) -> DataFrame:
    """What ``found_facts`` gives for no chunks."""
    spans = ("array<struct<block_id: string, char_start: int, char_end: int, chunk_char_start: int, chunk_char_end: int, page_number: int, page_numbers: array<int>>>")
    empty = spark.createDataFrame([], f"document_id string, chunk_id string, page_start int, page_end int, section string, text string, spans {spans}")
    return found_facts(empty)


def bound_to_places(places: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(claims, overflow errors) of all places of the contents whose facts (content_key, CONTENT_FIELDS, overflow) are ``found``.

    Copies of a hot content meet its facts in a plain join, whose hot partitions adaptive execution splits.
    """
    at = places.select("document_id", "chunk_id", "content_key", "source_page")
    distinct = found.where("not overflow").select("content_key", *CONTENT_FIELDS).distinct()
    claims = claims_of(at.join(distinct, "content_key").withColumn("overflow", F.lit(False)))
    return claims, overflows_of(at.join(found.where("overflow").select("content_key", "overflow"), "content_key"))


def extract_distinct(chunks: DataFrame, extractor=found_facts, namespace: str = "facts-v1") -> tuple[DataFrame, DataFrame]:
    """Run ``extractor`` once per distinct evidence text and section, and give its claims to every place with that content.

    A claim depends on the text of its segment alone; chunk and page are those of the place, so the result is that of
    ``extractor`` on all chunks.  Facts that the extractor marks as ``overflow`` become errors of every place, as in
    ``overflow_errors``; an extractor without that column has none.  Returns (claims, errors).  ``reuse.ExtractionCache`` keeps what is found for
    later runs.
    """
    places, errors = content_places(chunks, namespace)
    contents = places.groupBy("content_key").agg(F.first("segment_text").alias("text"), F.first("section").alias("section"))
    found = extractor(content_chunks(contents, chunks.schema["spans"].dataType))
    if "overflow" not in found.columns:
        found = found.withColumn("overflow", F.lit(False))
    claims, overflows = bound_to_places(places, found.withColumnRenamed("chunk_id", "content_key"))
    return claims, errors.unionByName(overflows)


# --- grounding -------------------------------------------------------------------------------------

def quoted_numbers(value_text: Column) -> Column:
    """Decimal literals of a quoted value; a value in parentheses is negative."""
    found = F.regexp_extract_all(value_text, F.lit(CASED + LITERAL), F.lit(0))
    numbers = F.transform(found, lambda n: F.replace(n, F.lit(","), F.lit("")).try_cast("decimal(38,8)"))
    negative = strip(value_text).startswith("(") & strip(value_text).endswith(")")
    return F.when(negative, F.transform(numbers, lambda n: -F.abs(n))).otherwise(numbers)


def grounding_problem() -> Column:
    supported = F.array_contains(quoted_numbers(F.col("value_text")), F.col("value_numeric").cast("decimal(38,8)"))
    return (F.when(~F.col("claim_text").contains(F.col("value_text")), F.lit("value_not_in_quote"))
            .when(F.col("value_numeric").isNotNull() & ~supported, F.lit("number_not_in_value")))


def grounded(claims: DataFrame, segments: DataFrame) -> DataFrame:
    """Add ``problem``: value outside the quote, unsupported number, or quote and page not in the evidence."""
    pages = segments.where("page is not null").groupBy("document_id", "chunk_id", "page").agg(
        F.collect_list("segment_text").alias("texts"))
    joined = claims.join(pages.withColumnRenamed("page", "source_page"), ["document_id", "chunk_id", "source_page"], "left")
    quoted = F.coalesce(F.exists("texts", lambda t: t.contains(F.col("claim_text"))), F.lit(False))
    return joined.withColumn("problem", F.coalesce(grounding_problem(), F.when(~quoted, F.lit("quote_not_in_evidence")))).drop("texts")


# --- claim rows from elsewhere -----------------------------------------------------------------------

PLAIN_NUMBER = r"^[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"


def calendar_problem(period: Column) -> Column:
    """Calendar-shaped periods must name a real date; other texts are left alone."""
    p = strip(period)

    def bad(date):
        value = date.try_cast("date")
        return value.isNull() | (F.year(value) < 1)

    parts = F.split(p, "/")
    return (F.when(p.rlike(r"^\d{4}$"), bad(F.concat(p, F.lit("-01-01"))))
            .when(p.rlike(r"^\d{4}-\d{2}$"), bad(F.concat(p, F.lit("-01"))))
            .when(p.rlike(r"^\d{4}-Q[1-4]$"), bad(F.concat(F.substring(p, 1, 4), F.lit("-01-01"))))
            .when(p.rlike(r"^\d{4}-\d{2}-\d{2}$"), bad(p))
            .when(p.rlike(r"^\d{4}-\d{2}-\d{2}/\d{4}-\d{2}-\d{2}$"), bad(F.get(parts, 0)) | bad(F.get(parts, 1)) | (
                F.get(parts, 0) > F.get(parts, 1)))
            .when(p.rlike(r"^\d{4}[-/]"), F.lit(True)).otherwise(F.lit(False)))


def claim_problems() -> Column:
    """Reasons why a claim row (numbers as text) is not acceptable; empty when it is."""
    required = ["entity_raw", "metric_raw", "value_text", "claim_text"]
    optional = ["unit", "period", "scope", "qualifier"]
    checks = [F.when(F.coalesce(is_blank(F.col(c)), F.lit(True)), F.lit(f"blank_{c}")) for c in required]
    checks += [F.when(F.coalesce(is_blank(F.col(c)), F.lit(False)), F.lit(f"blank_{c}")) for c in optional]
    checks += [F.when(F.length("unit") > 64, F.lit("long_unit")), F.when(F.length("period") > 128, F.lit("long_period")),
               F.when(~F.col("value_numeric").rlike(PLAIN_NUMBER), F.lit("bad_value_numeric")),
               F.when(~F.col("confidence").rlike(PLAIN_NUMBER) | ~F.col("confidence").try_cast("double").between(0, 1), F.lit("bad_confidence")),
               F.when(F.coalesce(F.col("source_page") < 1, F.lit(True)), F.lit("bad_source_page")),
               F.when(F.coalesce(calendar_problem(F.col("period")), F.lit(False)), F.lit("bad_period"))]
    return F.array_compact(F.array(*checks))


def stored_confidence(confidence: Column) -> Column:
    """Four decimal places, half up."""
    return F.round(confidence.cast("decimal(20,10)"), 4).cast("decimal(5,4)")
