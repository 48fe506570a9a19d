"""Layout items to typed blocks.

The unit of sequential work is the page batch (25 pages of one document): headings,
context segments and relations never cross it, so every window is bounded however
long a document is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions.text import is_blank
from claimloom.functions.units import literal_map

# --- fixed values -----------------------------------------------------------
PAGE_BATCH = 25
BLOCK_TYPES = {
    "text": "paragraph", "paragraph": "paragraph", "list_item": "paragraph", "code": "paragraph", "formula": "paragraph",
    "title": "heading", "section_header": "heading", "table": "table", "caption": "caption", "footnote": "footnote",
}
PAGE_FURNITURE = ["page_header", "page_footer"]
FLOATING = ["table", "picture"]
# ---------------------------------------------------------------------------

BATCH = ["document_id", "page_batch"]
ORDER = ["pos", "self_ref", "text"]


def page_batch(page_number: Column, size: int = PAGE_BATCH) -> Column:
    return F.floor((page_number - 1) / F.lit(size)).cast("int")


def block_type(label: Column) -> Column:
    return F.try_element_at(literal_map(BLOCK_TYPES), label)


def page_set(page: Column, listed: Column, provenance: Column) -> Column:
    """Own page, listed pages and provenance pages, sorted without repeats."""
    none = F.array().cast("array<int>")
    return F.sort_array(F.array_distinct(F.concat(F.array(page), F.coalesce(listed, none), F.coalesce(provenance, none))))


def page_window(blocks: DataFrame, first: int, last: int) -> DataFrame:
    return blocks.where(F.col("page_number").between(first, last))


def context_segments(items: DataFrame) -> DataFrame:
    """Number of omitted objects (pictures and the like, not page furniture) seen so far in the batch."""
    so_far = Window.partitionBy(*BATCH).orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    omitted = block_type(F.col("label")).isNull() & (F.col("label") != "") & ~F.col("label").isin(PAGE_FURNITURE)
    return items.withColumn("segment", F.sum(F.when(omitted, 1).otherwise(0)).over(so_far).cast("int"))


def block_identity() -> Column:
    pages = F.concat(F.lit("["), F.concat_ws(", ", F.col("page_numbers").cast("array<string>")), F.lit("]"))
    return F.sha2(F.concat_ws(":", "source_sha256", "self_ref", pages), 256)


def first_of_repeats(blocks: DataFrame) -> DataFrame:
    """Repeat items (same source, reference and pages) keep their first occurrence."""
    seen = Window.partitionBy(*BATCH, "block_id").orderBy(*ORDER)
    return blocks.withColumn("_n", F.row_number().over(seen)).where("_n = 1").drop("_n")


def carried_headings(blocks: DataFrame) -> DataFrame:
    so_far = Window.partitionBy(*BATCH).orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    heading = F.when(F.col("block_type") == "heading", F.col("text"))
    return blocks.withColumn("section_heading", F.last(heading, ignorenulls=True).over(so_far))


def scope() -> Column:
    first = F.col("page_batch") * PAGE_BATCH + 1
    return F.concat(F.col("source_sha256"), F.lit(":"), first.cast("string"), F.lit("-"), (first + PAGE_BATCH - 1).cast("string"))


def page_errors(items: DataFrame, total_pages: DataFrame) -> DataFrame:
    """Blocks without pages, or on a page the document does not have."""
    bad = F.coalesce(F.size("page_numbers") == 0, F.lit(True)) | F.exists(
        "page_numbers", lambda p: (p < 1) | (p > F.col("total_pages")))
    return items.join(total_pages, "document_id").where(bad).select(
        "document_id", F.lit("PARSING").alias("stage"), F.col("self_ref").alias("item_id"),
        F.lit("missing_or_invalid_page").alias("message"))


def blocks_from_items(items: DataFrame) -> DataFrame:
    """Typed blocks of parser items: labels mapped, blanks and repeats dropped, headings carried.

    Input: document_id, pos, page_number, self_ref, label, text, source_sha256 and any
    further columns, which are kept.  One shuffle by (document, page batch) serves all windows.
    """
    batched = items.withColumn("page_batch", page_batch(F.col("page_number"))).withColumn("page_numbers", F.array("page_number"))
    typed = (context_segments(batched).withColumn("block_type", block_type(F.col("label")))
             .where(F.col("block_type").isNotNull() & ~is_blank(F.col("text"))).withColumn("block_id", block_identity()))
    named = carried_headings(first_of_repeats(typed))
    return (named.withColumn("context_ref", F.concat_ws(":", scope(), "self_ref"))
            .withColumn("context_segment", F.concat_ws(":", scope(), F.col("segment").cast("string"))).drop("segment"))


# --- explicit relations --------------------------------------------------------------

def _references(items: DataFrame) -> DataFrame:
    """One row per reference of a table or picture: (batch, owner_ref, role, ord, self_ref)."""
    floating = items.where(F.col("label").isin(FLOATING)).withColumn("page_batch", page_batch(F.col("page_number")))
    roles = F.array(F.struct(F.lit("captions").alias("role"), F.col("caption_refs").alias("refs")),
                    F.struct(F.lit("footnotes").alias("role"), F.col("footnote_refs").alias("refs")))
    listed = floating.select(*BATCH, "source_sha256", F.col("self_ref").alias("owner_ref"), F.explode(roles).alias("r"))
    return listed.select(*BATCH, "source_sha256", "owner_ref", "r.role", F.posexplode("r.refs").alias("ord", "self_ref"))


def _owners(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(batch, self_ref) -> the tables and pictures that link to it, and -> its nearest floating ancestor."""
    linked = _references(items).select(*BATCH, "self_ref", F.concat_ws(":", scope(), "owner_ref").alias("owner")).groupBy(
        *BATCH, "self_ref").agg(F.sort_array(F.collect_set("owner")).alias("linked"))
    batched = items.withColumn("page_batch", page_batch(F.col("page_number")))
    floating = batched.where(F.col("label").isin(FLOATING)).select(*BATCH, F.col("self_ref").alias("parent_ref")).distinct()
    parents = batched.select(*BATCH, "source_sha256", "self_ref", F.posexplode("parent_refs").alias("depth", "parent_ref"))
    nearest = (parents.join(floating, [*BATCH, "parent_ref"])
               .groupBy(*BATCH, "self_ref").agg(F.max_by(F.concat_ws(":", scope(), "parent_ref"), "depth").alias("ancestor")))
    return linked, nearest


def _owner_list() -> Column:
    listed = F.coalesce("linked", F.array().cast("array<string>"))
    return F.when(F.col("ancestor").isNull() | F.array_contains(listed, F.col("ancestor")), listed).otherwise(
        F.array_append(listed, F.col("ancestor")))


def owner_refs(items: DataFrame) -> DataFrame:
    """(batch, self_ref) -> context_owner_refs: linking tables and pictures, then the nearest floating ancestor."""
    linked, nearest = _owners(items)
    both = linked.join(nearest, [*BATCH, "self_ref"], "full")
    return both.select(*BATCH, "self_ref", _owner_list().alias("context_owner_refs"))


def relation_ids(items: DataFrame, blocks: DataFrame) -> DataFrame:
    """(batch, table self_ref) -> caption_ids and footnote_ids in reference order; unknown references are dropped."""
    known = blocks.select(*BATCH, "self_ref", "block_id")
    found = _references(items.where("label = 'table'")).distinct().join(known, [*BATCH, "self_ref"])
    grouped = found.groupBy(*BATCH, "owner_ref").agg(F.array_sort(F.collect_list(F.struct("role", "ord", "block_id"))).alias("r"))

    def ids(role):
        return F.transform(F.filter("r", lambda x: x["role"] == role), lambda x: x["block_id"])

    return grouped.select(*BATCH, F.col("owner_ref").alias("self_ref"), ids("captions").alias("caption_ids"),
                          ids("footnotes").alias("footnote_ids"))


def report_blocks(items: DataFrame) -> DataFrame:
    """Blocks with owner references and table relations attached.

    The owners are joined one after the other, because a full join would lose that its rows lie by page batch.
    """
    blocks = blocks_from_items(items)
    none = F.array().cast("array<string>")
    linking, nearest = _owners(items)
    linked = (blocks.join(linking, [*BATCH, "self_ref"], "left").join(nearest, [*BATCH, "self_ref"], "left")
              .withColumn("context_owner_refs", _owner_list()).drop("linked", "ancestor")
              .join(relation_ids(items, blocks), [*BATCH, "self_ref"], "left"))
    for name in ("caption_ids", "footnote_ids"):
        linked = linked.withColumn(name, F.coalesce(name, none))
    return linked


# --- page facts ---------------------------------------------------------------------------

def needs_ocr(has_text: Column, has_image: Column) -> Column:
    return ~has_text & has_image


def policy_runs(pages: DataFrame) -> DataFrame:
    """Consecutive pages with one policy: (document_id, page_number, ocr) -> first and last page of each run."""
    order = Window.partitionBy("document_id", "page_batch", "ocr").orderBy("page_number")
    island = F.col("page_number") - F.row_number().over(order)
    batched = pages.withColumn("page_batch", page_batch(F.col("page_number"))).withColumn("island", island)
    return batched.groupBy("document_id", "page_batch", "ocr", "island").agg(
        F.min("page_number").alias("first_page"), F.max("page_number").alias("last_page"),
        F.count(F.lit(1)).alias("pages")).drop("island")


# --- statistics ------------------------------------------------------------------------------

def block_statistics(blocks: DataFrame) -> DataFrame:
    counts = blocks.groupBy("document_id").agg(
        F.max("page_number").alias("total_pages"), F.count(F.lit(1)).alias("total_blocks"),
        *[F.count_if(F.col("block_type") == t).alias(f"{t}s") for t in ("paragraph", "heading", "table")])
    return counts


def first_blocks(blocks: DataFrame, n: int = 10) -> DataFrame:
    order = Window.partitionBy("document_id").orderBy(*ORDER)
    return blocks.withColumn("row_no", F.row_number().over(order)).where(F.col("row_no") <= n)
