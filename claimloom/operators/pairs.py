"""Candidate pairs: claims of one document that name the same entity and metric but differ.

Everything a pair rule needs from one claim is computed once per claim (``sides``), so
the pair join moves only narrow rows: scaled value, unit key, labels, and bit masks
instead of the claim text.  Claims that agree are excluded inside the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions.text import WS, label, squeeze, strip
from claimloom.session import materialize

# --- fixed values -----------------------------------------------------------
PLAIN_QUALIFIERS = ["actual", "standalone", "consolidated", "audited"]
NEGATION = r"\b(?:not|no|never|without|failed to)\b|n't"
OPPOSITES = [("increase", "decrease"), ("approved", "rejected"), ("before", "after"),
             ("true", "false"), ("allowed", "prohibited"), ("above", "below")]
NO_ENTITY = "document subject"
REASONS = {
    "temporal": "Different reporting periods; a value change across time is not itself a contradiction.",
    "scope": "Scope differs or is missing; do not assume the populations match.",
    "qualifier": "Qualifiers need review for reporting basis, bounds, approximation or conditions.",
    "unit": "Units are incompatible or missing; values cannot be directly compared.",
    "numeric": "Numeric values differ after exact conversion to the same unit scale.",
    "text": "Textual or mixed values differ; semantic verification is needed.",
    "period": "Reporting periods are missing, ambiguous or expressed on different bases.",
    "no_scope": "Neither claim states its scope.",
    "match": "Entity, metric, period, scope and unit match; qualifiers do not indicate uncertainty or a basis difference.",
}
SCORE_THRESHOLD = 0.65
SCORE_ENTITY, SCORE_METRIC, SCORE_PERIOD, SCORE_SCOPE, SCORE_VALUE, SCORE_SIMILARITY = 0.25, 0.30, 0.15, 0.10, 0.10, 0.25
# ---------------------------------------------------------------------------

TILE_ROWS = 4096
LOOKUP_SALTS = 64
KEYS = ["document_id", "entity_n", "metric_n"]
RECORD = ["document_id", "chunk_id", "claim_id", "entity_raw", "metric_raw", "value_text", "value_numeric", "unit",
          "period", "scope", "qualifier", "claim_text", "source_page", "confidence", "entity_n", "metric_n"]


def distinct_records(claims_n: DataFrame) -> DataFrame:
    """Drop records that are identical in every field; separate occurrences stay."""
    return claims_n.dropDuplicates([c for c in RECORD if c in claims_n.columns])


def guard_violations(claims_n: DataFrame) -> DataFrame:
    """Claims that may not enter pairing: blank keys or no document."""
    reason = F.coalesce(
        F.when(F.col("document_id").isNull(), F.lit("missing_document")),
        F.when(F.coalesce(strip(F.col("entity_n")), F.lit("")) == "", F.lit("blank_entity")),
        F.when(F.coalesce(strip(F.col("metric_n")), F.lit("")) == "", F.lit("blank_metric")))
    return claims_n.withColumn("violation", reason).where("violation is not null").select(
        "document_id", "claim_id", "violation")


# --- per-claim features -------------------------------------------------------

def qualifier_is_plain(qualifier_label: Column) -> Column:
    """Every part of the qualifier names a plain reporting basis."""
    parts = F.split(qualifier_label, rf"(?U){WS}*[;,]{WS}*")
    return F.size(F.array_except(parts, F.array(*[F.lit(q) for q in PLAIN_QUALIFIERS]))) == 0


def unit_key(unit_n: Column) -> Column:
    """Two units compare exactly when their keys are equal; null means unknown."""
    return F.when(unit_n.isNotNull(), F.when(
        unit_n["recognized"], F.concat_ws("|", F.lit("known"), unit_n["dimension"], unit_n["base_unit"]))
        .otherwise(F.concat(F.lit("as written|"), unit_n["canonical"])))


def base_value(value: Column, unit_n: Column) -> Column:
    """Exact value in base units: DECIMAL(24,8) x DECIMAL(13,2) needs no rounding."""
    return value.cast("decimal(24,8)") * F.coalesce(unit_n["scale"], F.lit(1).cast("decimal(13,2)"))


def _mask(text: Column, words: list[str]) -> Column:
    mask = F.lit(0)
    for bit, word in enumerate(words):
        mask = mask.bitwiseOR(F.when(text.contains(word), F.lit(1 << bit)).otherwise(F.lit(0)))
    return mask


def sides(claims_n: DataFrame) -> DataFrame:
    """The narrow comparison row of each claim."""
    text = F.col("_text")
    unit_n, period_n = F.col("unit_n"), F.col("period_n")
    lowered = (claims_n.withColumn("_text", F.lower(F.col("claim_text")))
               .withColumn("_negated", text.rlike("(?U)" + NEGATION)))
    staged = lowered.select(
        *KEYS, "chunk_id", "claim_id", "value_numeric", "value_text",
        label(F.col("value_text")).alias("value_label"),
        base_value(F.col("value_numeric"), unit_n).alias("base_value"),
        unit_key(unit_n).alias("unit_key"),
        F.coalesce(unit_n["scale"], F.lit(1).cast("decimal(13,2)")).alias("unit_scale"),
        period_n["kind"].alias("period_kind"), period_n["canonical"].alias("period_name"),
        period_n["fiscal_year"].alias("fiscal_year"), period_n["start_date"].alias("start_date"),
        period_n["end_date"].alias("end_date"),
        F.coalesce(period_n["canonical"], F.col("period")).alias("reporting_date"),
        label(F.col("scope")).alias("scope_label"),
        F.nullif(strip(F.lower(F.col("scope"))), F.lit("")).alias("scope_key"),
        label(F.col("qualifier")).alias("qualifier_label"),
        F.col("_negated").alias("negated"),
        F.sha2(squeeze(F.when(F.col("_negated"), F.regexp_replace(text, "(?U)" + NEGATION, "")).otherwise(text)),
               256).alias("plain_digest"),
        _mask(text, [left for left, _ in OPPOSITES]).alias("left_words"),
        _mask(text, [right for _, right in OPPOSITES]).alias("right_words"),
    )
    return staged.withColumn("qualifier_plain", F.coalesce(qualifier_is_plain(F.col("qualifier_label")), F.lit(True)))


# --- pair rules: columns over the structs ``a`` and ``b`` -------------------------

class Side:
    """One side of a pair row: ``side[field]`` is that field of the struct column (no session needed to create it)."""

    def __init__(self, name: str):
        self.name = name

    def __getitem__(self, field: str) -> Column:
        return F.col(f"{self.name}.{field}")

    def column(self) -> Column:
        return F.col(self.name)


A, B = Side("a"), Side("b")


def period_relation(a: Side = A, b: Side = B) -> Column:
    """unknown / same / different_basis / temporal."""
    def undated(s):
        return s["period_kind"].isNull() | (s["period_kind"] == "unknown") | (
            (s["period_kind"] == "fiscal_year") & s["fiscal_year"].isNull())

    same_kind = a["period_kind"] == b["period_kind"]
    same_dates = a["start_date"].eqNullSafe(b["start_date"]) & a["end_date"].eqNullSafe(b["end_date"])
    apart = F.coalesce((a["end_date"] < b["start_date"]) | (b["end_date"] < a["start_date"]), F.lit(False)) & (
        a["start_date"].isNotNull() & a["end_date"].isNotNull() & b["start_date"].isNotNull() & b["end_date"].isNotNull())
    return (F.when(undated(a) | undated(b), F.lit("unknown"))
            .when(same_kind & (a["period_name"] == b["period_name"]),
                  F.when(same_dates, F.lit("same")).otherwise(F.lit("different_basis")))
            .when(same_kind | apart, F.lit("temporal"))
            .otherwise(F.lit("different_basis")))


def unit_relation(a: Side = A, b: Side = B) -> Column:
    """unknown / same / different."""
    return (F.when(a["unit_key"].isNull() | b["unit_key"].isNull(), F.lit("unknown"))
            .when(a["unit_key"] == b["unit_key"], F.lit("same")).otherwise(F.lit("different")))


def both_numeric(a: Side = A, b: Side = B) -> Column:
    return a["value_numeric"].isNotNull() & b["value_numeric"].isNotNull()


def _equal_numbers(a: Side, b: Side) -> Column:
    """Both numeric, and equal after scaling (same unit) or as written (unit unknown)."""
    no_unit = a["unit_key"].isNull() | b["unit_key"].isNull()
    return both_numeric(a, b) & F.coalesce(
        F.when(no_unit, a["value_numeric"] == b["value_numeric"])
        .otherwise((a["unit_key"] == b["unit_key"]) & (a["base_value"] == b["base_value"])), F.lit(False))


def agrees(a: Side = A, b: Side = B) -> Column:
    """The pair states the same value, so there is nothing to compare."""
    no_numbers = a["value_numeric"].isNull() & b["value_numeric"].isNull()
    return _equal_numbers(a, b) | (no_numbers & a["value_label"].eqNullSafe(b["value_label"]))


def qualified(a: Side = A, b: Side = B) -> Column:
    return ~a["qualifier_label"].eqNullSafe(b["qualifier_label"]) | ~a["qualifier_plain"]


def preliminary_class(a: Side = A, b: Side = B, *, unit: Column | None = None, period: Column | None = None) -> Column:
    unit = unit_relation(a, b) if unit is None else unit
    period = period_relation(a, b) if period is None else period
    scopes = a["scope_label"].isNotNull() & b["scope_label"].isNotNull()
    return (F.when(period == "temporal", F.lit("temporal_difference"))
            .when(scopes & (a["scope_label"] != b["scope_label"]), F.lit("possible_scope_difference"))
            .when(qualified(a, b), F.lit("possible_qualifier_difference"))
            .when(unit == "different", F.lit("possible_unit_difference"))
            .when(period == "different_basis", F.lit("possible_period_difference"))
            .when((period == "unknown") | ~scopes | (unit == "unknown"), F.lit("insufficient_context"))
            .when(~both_numeric(a, b), F.lit("possible_value_difference"))
            .otherwise(F.lit("candidate_contradiction")))


def reason_text(a: Side = A, b: Side = B, *, unit: Column | None = None, period: Column | None = None,
                klass: Column | None = None) -> Column:
    unit = unit_relation(a, b) if unit is None else unit
    period = period_relation(a, b) if period is None else period
    klass = preliminary_class(a, b) if klass is None else klass
    say = {k: F.lit(v) for k, v in REASONS.items()}
    return F.concat_ws(
        " ",
        F.when(period == "temporal", say["temporal"]),
        F.when(~a["scope_label"].eqNullSafe(b["scope_label"]), say["scope"]),
        F.when(qualified(a, b), say["qualifier"]),
        F.when(unit != "same", say["unit"]).when(both_numeric(a, b), say["numeric"]).otherwise(say["text"]),
        F.when(period.isin("unknown", "different_basis"), say["period"]),
        F.when(a["scope_label"].isNull() & b["scope_label"].isNull(), say["no_scope"]),
        F.when(klass == "candidate_contradiction", say["match"]),
    )


def _score_terms(a: Side, b: Side, period: Column | None) -> tuple[Column, Column]:
    """Whether a pair has a local explanation, and its score before similarity: an ordered DOUBLE sum."""
    period = period_relation(a, b) if period is None else period
    same_text = ~both_numeric(a, b) & a["value_text"].eqNullSafe(b["value_text"])
    scopes = a["scope_key"].isNotNull() & b["scope_key"].isNotNull()
    explained = _equal_numbers(a, b) | same_text | (period == "temporal") | (
        scopes & (a["scope_key"] != b["scope_key"]))

    def term(weight: float, holds: Column) -> Column:
        return F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))

    total = term(SCORE_ENTITY, (a["entity_n"] == b["entity_n"]) & (a["entity_n"] != NO_ENTITY))
    total = total + term(SCORE_METRIC, a["metric_n"] == b["metric_n"])
    total = total + term(SCORE_PERIOD, period == "same")
    total = total + term(SCORE_SCOPE, scopes & (a["scope_key"] == b["scope_key"]))
    return explained, total + F.lit(SCORE_VALUE)


def _with_similarity(total: Column, similarity: Column) -> Column:
    return F.least(F.lit(1.0), total + F.lit(SCORE_SIMILARITY) * F.greatest(
        F.lit(0.0), F.least(F.lit(1.0), F.coalesce(similarity, F.lit(0.0)))))


def suspicion_score(similarity: Column, a: Side = A, b: Side = B, *, period: Column | None = None) -> Column:
    """0 for pairs with a local explanation, at most 1."""
    explained, total = _score_terms(a, b, period)
    return F.when(explained, F.lit(0.0)).otherwise(_with_similarity(total, similarity))


def base_score(a: Side = A, b: Side = B) -> Column:
    """The score before similarity, null for pairs with a local explanation: one number that stands for both claims."""
    explained, total = _score_terms(a, b, None)
    return F.when(explained, F.lit(None).cast("double")).otherwise(total)


def score_of_base(base: Column, similarity: Column) -> Column:
    """:func:`suspicion_score` from a stored :func:`base_score`."""
    return F.when(base.isNull(), F.lit(0.0)).otherwise(_with_similarity(base, similarity))


# --- joins ----------------------------------------------------------------------

def hot_blocks(side_rows: DataFrame, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(block_hash, tiles) of the blocks with more than ``tile_rows`` claims.

    Partially aggregated before the shuffle; at most claims / tile_rows rows of 12 bytes.
    A hash collision only splits a block that did not need it.
    """
    return (side_rows.groupBy(F.xxhash64(*KEYS).alias("block_hash")).agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") > tile_rows)
            .select("block_hash", F.ceil(F.col("n") / F.lit(tile_rows)).cast("int").alias("tiles")))


def _tiled(side_rows: DataFrame, hot: DataFrame) -> DataFrame:
    """Spread the rows of a hot block over a triangle of tile pairs (lo <= hi).

    The tile counts are looked up by (block, salt), so the rows of a hot block are not sent to one
    task even for the lookup; the repeated lookup rows stay below claims x salts / tile_rows.
    """
    lookup = hot.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(LOOKUP_SALTS - 1))))
    marked = (side_rows.withColumn("block_hash", F.xxhash64(*KEYS))
              .withColumn("salt", F.pmod(F.xxhash64(F.col("claim_id"), F.lit(1)), F.lit(LOOKUP_SALTS)).cast("int"))
              .join(lookup, ["block_hash", "salt"], "left").drop("block_hash", "salt")
              .withColumn("tiles", F.coalesce("tiles", F.lit(1)))
              .withColumn("tile", F.pmod(F.xxhash64("claim_id"), F.col("tiles")).cast("int")))
    pairs = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda other: F.struct(
        F.least(F.col("tile"), other).alias("lo"), F.greatest(F.col("tile"), other).alias("hi")))
    return marked.withColumn("cell", F.explode(pairs)).select("*", "cell.lo", "cell.hi").drop("cell", "tiles")


def _joined(left: DataFrame, right: DataFrame, condition: Column) -> DataFrame:
    fields = [c for c in left.columns if c not in ("lo", "hi", "tile")]

    def pack(df, name):
        return df.select(*KEYS, "lo", "hi", F.col("tile").alias(f"tile_{name}"),
                         F.struct(*fields).alias(name))

    one_cell = (F.col("lo") == F.col("hi")) | (F.col("tile_a") != F.col("tile_b"))
    joined = pack(left, "a").join(pack(right, "b"), [*KEYS, "lo", "hi"])
    return joined.where(one_cell & condition).select(*KEYS, "a", "b")


def candidate_pairs(claims_n: DataFrame, *, tile_rows: int = TILE_ROWS, dedupe: bool = False,
                    hot: DataFrame | None = None) -> DataFrame:
    """Unordered pairs inside (document, entity, metric) whose values do not agree.

    Both join sides are the same rows, so Spark shuffles them once.  A block with more
    than ``tile_rows`` claims is cut into tiles and each pair of tiles becomes its own
    join key: no task ever meets a whole hot block, and each pair is still produced
    exactly once.  ``dedupe`` drops identical records first, for claims that were not
    read from a keyed claim table.  ``hot`` may pass a written :func:`hot_blocks` table.
    """
    return pairs_of(sides(distinct_records(claims_n) if dedupe else claims_n), tile_rows=tile_rows, hot=hot)


def pairs_of(side_rows: DataFrame, *, tile_rows: int = TILE_ROWS, hot: DataFrame | None = None) -> DataFrame:
    """:func:`candidate_pairs` over rows of :func:`sides` that were already computed (or stored)."""
    cells = _tiled(side_rows, hot_blocks(side_rows, tile_rows) if hot is None else hot)
    return _joined(cells, cells, (A["claim_id"] < B["claim_id"]) & ~agrees())


def candidate_pairs_between(new_claims: DataFrame, stored_claims: DataFrame, *, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Pairs that join a new claim with a stored one (ids put in order)."""
    return pairs_across(sides(new_claims), sides(stored_claims), tile_rows=tile_rows)


def pairs_across(new: DataFrame, stored: DataFrame, *, tile_rows: int = TILE_ROWS) -> DataFrame:
    """:func:`candidate_pairs_between` over stored rows of :func:`sides`."""
    hot = hot_blocks(new.unionByName(stored), tile_rows)
    crossed = _joined_any(_tiled(new, hot), _tiled(stored, hot))
    ordered = A["claim_id"] < B["claim_id"]
    return crossed.select(*KEYS, F.when(ordered, A.column()).otherwise(B.column()).alias("a"),
                          F.when(ordered, B.column()).otherwise(A.column()).alias("b"))


def _joined_any(left: DataFrame, right: DataFrame) -> DataFrame:
    return _joined(left, right, (A["claim_id"] != B["claim_id"]) & ~agrees())


def pairs_by_key(keys: DataFrame, side_rows: DataFrame) -> DataFrame:
    """Attach both comparison rows to (document_id, claim_a_id, claim_b_id, ...) keys."""
    rows, fields = side_rows, side_rows.columns
    a = rows.select("document_id", F.col("claim_id").alias("claim_a_id"), F.struct(*fields).alias("a"))
    b = rows.select("document_id", F.col("claim_id").alias("claim_b_id"), F.struct(*fields).alias("b"))
    return keys.join(a, ["document_id", "claim_a_id"]).join(b, ["document_id", "claim_b_id"])


def labelled(pairs: DataFrame) -> DataFrame:
    """Add unit_relation, period_relation, preliminary_classification and reason_for_candidate."""
    related = pairs.withColumn("unit_relation", unit_relation()).withColumn("period_relation", period_relation())
    unit, period = F.col("unit_relation"), F.col("period_relation")
    classed = related.withColumn("preliminary_classification", preliminary_class(unit=unit, period=period))
    return classed.withColumn("reason_for_candidate", reason_text(
        unit=unit, period=period, klass=F.col("preliminary_classification")))


def pair_ids(pairs: DataFrame) -> list[Column]:
    return [F.col("document_id"), A["claim_id"].alias("claim_a_id"), B["claim_id"].alias("claim_b_id")]


def canonical_key(df: DataFrame, first: str, second: str) -> DataFrame:
    """Ids in order, so that a pair has one key whichever side found it."""
    return df.withColumn("claim_a_id", F.least(first, second)).withColumn("claim_b_id", F.greatest(first, second))


SIGNATURE = ["value_numeric", "value_label", "base_value", "unit_key", "period_kind", "period_name", "fiscal_year",
             "start_date", "end_date", "scope_label", "qualifier_label", "qualifier_plain"]


def candidate_counts(side_rows: DataFrame, *, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Candidate pairs per (document, preliminary class), without producing the pairs.

    Claims that compare alike are counted first (map-side), and only distinct comparison
    rows of a block are joined; each joined row stands for n_a x n_b pairs.
    """
    grouped = (side_rows.groupBy(*KEYS, *SIGNATURE).agg(F.count(F.lit(1)).alias("n"))
               .withColumn("claim_id", F.sha2(F.to_json(F.struct(*SIGNATURE), {"ignoreNullFields": "false"}), 256)))
    cells = _tiled(grouped, hot_blocks(grouped, tile_rows))
    joined = _joined(cells, cells, (A["claim_id"] < B["claim_id"]) & ~agrees())
    return (joined.withColumn("preliminary_classification", preliminary_class())
            .groupBy("document_id", "preliminary_classification")
            .agg(F.sum(A["n"] * B["n"]).cast("bigint").alias("pairs")))


def merge_pairs(structured: DataFrame, semantic: DataFrame) -> DataFrame:
    """One row per pair key; a structured label wins, similarity is the best seen.

    ``structured``: key columns + preliminary_classification; ``semantic``: key columns + similarity.
    """
    key = ["document_id", "claim_a_id", "claim_b_id"]
    left = structured.select(*key, "preliminary_classification", F.lit(None).cast("double").alias("similarity"),
                             F.lit(True).alias("is_structured"), F.lit(False).alias("is_semantic"))
    right = semantic.select(*key, F.lit(None).cast("string").alias("preliminary_classification"), "similarity",
                            F.lit(False).alias("is_structured"), F.lit(True).alias("is_semantic"))
    return left.unionByName(right).groupBy(*key).agg(
        F.coalesce(F.max("preliminary_classification"), F.lit("possible_value_difference")).alias("preliminary_classification"),
        F.coalesce(F.max("similarity"), F.lit(0.0)).alias("similarity"),
        F.max("is_structured").alias("is_structured"), F.max("is_semantic").alias("is_semantic"))


def best_similarity(matches: DataFrame) -> DataFrame:
    """(claim_id, neighbour_id, similarity) of both directions -> best similarity per pair, floor 0."""
    return (canonical_key(matches, "claim_id", "neighbour_id")
            .groupBy("document_id", "claim_a_id", "claim_b_id")
            .agg(F.greatest(F.lit(0.0), F.max("similarity")).alias("similarity")))


def scored(pairs: DataFrame, similarity: Column | None = None) -> DataFrame:
    similarity = F.lit(0.0) if similarity is None else similarity
    return pairs.withColumn("score", suspicion_score(similarity))


def above_threshold(scored_pairs: DataFrame, threshold: float = SCORE_THRESHOLD) -> DataFrame:
    if not 0 <= threshold <= 1:
        raise ValueError("threshold must lie in [0, 1]")
    return scored_pairs.where(F.col("score") >= F.lit(threshold))


def ranked(scored_pairs: DataFrame) -> DataFrame:
    """Add ``position``: best score first, then ids, per document.

    A document may hold very many pairs, so the rows are sorted over ranges and stored; a position is the row's
    place in its range plus the rows of the document in the ranges before, of which there is one count per range.
    """
    columns = scored_pairs.columns
    in_order = ["document_id", F.desc("score"), "claim_a_id", "claim_b_id"]
    placed = materialize(scored_pairs.repartitionByRange(*in_order).sortWithinPartitions(*in_order)
                         .withColumn("range", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id()), "ranked")
    before = Window.partitionBy("document_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = (placed.groupBy("document_id", "range").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))
              .withColumn("earlier", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"))
    return (placed.join(ranges, ["document_id", "range"])
            .withColumn("position", F.col("row") - F.col("first") + F.col("earlier") + 1).select(*columns, "position"))
