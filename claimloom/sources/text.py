"""Plain text and HTML tables as parser items, with Spark expressions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.functions.text import is_blank, squeeze

# --- fixed values -----------------------------------------------------------
LINES_PER_PAGE = 5
HIDDEN = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|<head\b.*?</head>"
BLOCK_TAG = (r"(?i)<(/?(?:h[1-6]|p|li|ul|ol|div|article|section|header|footer|nav|table|tr|td|th|caption|figcaption|"
             r"blockquote|pre|body|html|br|hr))\b[^>]*>")
INLINE_TAG = r"<[^>]*>"
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]
# ---------------------------------------------------------------------------


def line_items(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", prefix: str = "t",
               lines_per_page: int = LINES_PER_PAGE) -> DataFrame:
    """Every non-blank line of a plain-text document as a text item; pages hold a fixed number of lines."""
    lines = documents.select(
        F.concat(F.lit(prefix), F.lpad(F.col(id_column).cast("string"), 10, "0")).alias("document_id"),
        F.posexplode(F.split(text_column, "\n")).alias("pos", "text"))
    return lines.where(~is_blank(F.col("text"))).select(
        "document_id", "pos", (F.floor(F.col("pos") / F.lit(lines_per_page)) + 1).cast("int").alias("page_number"),
        F.concat(F.lit("#/lines/"), F.col("pos").cast("string")).alias("self_ref"), F.lit("text").alias("label"), "text",
        F.col("document_id").alias("source_sha256"))


def turn_items(conversations: DataFrame) -> DataFrame:
    """Every turn of a conversation as a text item."""
    return conversations.where(~is_blank(F.col("text"))).select(
        F.concat(F.lit("v"), F.lpad(F.col("conv_id").cast("string"), 10, "0")).alias("document_id"),
        F.col("turn").cast("int").alias("pos"), (F.floor(F.col("turn") / F.lit(LINES_PER_PAGE)) + 1).cast("int").alias("page_number"),
        F.concat(F.lit("#/turns/"), F.col("turn").cast("string")).alias("self_ref"), F.lit("text").alias("label"), "text",
        F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("source_sha256"))


def html_items(pages: DataFrame, per_page: int = LINES_PER_PAGE) -> DataFrame:
    """Block-level elements of HTML pages as items: headings, list items, captions, footers and text.

    Scripts, styles, comments and the head are removed, the markup is cut at block-level
    tags (so unclosed paragraphs end where the next block starts), and inline tags and
    entities are resolved inside each piece.
    """
    marked = F.regexp_replace(F.regexp_replace("html", HIDDEN, ""), BLOCK_TAG, "\u0001$1\u0002")
    pieces = pages.select(
        F.concat(F.lit("h"), F.lpad(F.col("page_id").cast("string"), 10, "0")).alias("document_id"),
        F.posexplode(F.split(marked, "\u0001")).alias("pos", "piece"))
    body = F.regexp_replace(F.element_at(F.split("piece", "\u0002"), -1), INLINE_TAG, "")
    for entity, character in ENTITIES:
        body = F.replace(body, F.lit(entity), F.lit(character))
    tag = F.when(F.col("piece").contains("\u0002"), F.lower(F.get(F.split("piece", "\u0002"), 0))).otherwise(F.lit(""))
    label = (F.when(tag == "h1", F.lit("title")).when(tag.rlike("^h[2-6]$"), F.lit("section_header"))
             .when(tag == "li", F.lit("list_item")).when(tag.isin("caption", "figcaption"), F.lit("caption"))
             .when(tag == "footer", F.lit("page_footer")).otherwise(F.lit("text")))
    read = pieces.select("document_id", "pos", label.alias("label"), squeeze(body).alias("text"))
    return read.where(F.col("text") != "").select(
        "document_id", "pos", (F.floor(F.col("pos") / F.lit(per_page)) + 1).cast("int").alias("page_number"),
        F.concat(F.lit("#/elements/"), F.col("pos").cast("string")).alias("self_ref"), "label", "text",
        F.col("document_id").alias("source_sha256"))
