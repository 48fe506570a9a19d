"""Catalog: embeddings and neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.operators import similar, vector_index
from claimloom.plans import check_sql as sql
from claimloom.plans.catalog import Catalog, claims_n
from claimloom.sources import derived

catalog = Catalog()
add = catalog.add
THRESHOLD = 0.30  # same-label vectors of the given table never reach the default threshold


def vector_claims(spark: SparkSession, sf: str) -> DataFrame:
    """The embeddings table read as claims: document = label, claim = vec_id."""
    return derived.table(spark, sf, "embeddings").select(
        F.concat(F.lit("l"), F.col("label").cast("string")).alias("document_id"), F.lit("given").alias("namespace"),
        F.lpad(F.col("vec_id").cast("string"), 10, "0").alias("claim_id"), F.col("embedding").alias("vector"))


_JSON = """to_json({'claim_text': trim(claim_text), 'entity': entity_n, 'metric': metric_n, 'period': period_name,
  'qualifier': qualifier, 'scope': scope, 'unit': unit_canonical})"""


@add("emb_01_embedding_text", f"with {sql.SIDES} select claim_id, {_JSON}::varchar as embedding_text from sides")
def embedding_text(spark, sf):
    return similar.with_embedding_text(claims_n(spark, sf)).select("claim_id", "embedding_text")


@add("emb_02_text_hash", f"with {sql.SIDES} select claim_id, sha256({_JSON}::varchar) as embedding_text_hash from sides")
def text_hash(spark, sf):
    return similar.with_embedding_text(claims_n(spark, sf)).select("claim_id", "embedding_text_hash")


@add("emb_03_vector_audit", """select vec_id, case when len(v) <> 64 then 'wrong_dimension' when list_bool_or(list_transform(v, lambda x: isnan(x) or isinf(x))) then 'not_finite_float32'
  when not list_bool_or(list_transform(v, lambda x: abs(x) >= 1.175494351e-38)) then 'zero_vector' end as problem
from (select vec_id, case label when 1 then embedding[1:60] when 2 then list_transform(embedding, lambda x: x * 0)
  when 3 then list_transform(embedding, lambda x: case when x > 0.2 then 'nan'::float else x end) else embedding end as v from embeddings)""")
def vector_audit(spark, sf):
    """Vectors of three labels are damaged: cut short, zeroed, or with NaN where a coordinate exceeds 0.2."""
    v, label = F.col("embedding"), F.col("label")
    damaged = (F.when(label == 1, F.slice(v, 1, 60)).when(label == 2, F.transform(v, lambda x: x * F.lit(0).cast("float")))
               .when(label == 3, F.transform(v, lambda x: F.when(x > 0.2, F.lit(float("nan")).cast("float")).otherwise(x))).otherwise(v))
    return derived.table(spark, sf, "embeddings").select("vec_id", similar.vector_problem(damaged, 64).alias("problem"))


@add("emb_04_unit_vectors", """select vec_id, 96::bigint as dimensions, round(sqrt(list_sum(list_transform(u, lambda x: x * x))), 6) as norm, round(u[1], 6) as first_value,
  round(u[64], 6) as last_value, 0.0::double as padding
from (select vec_id, list_transform(embedding, lambda x: x::double / n) as u from (select vec_id, embedding,
  sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))) as n from embeddings))""")
def unit_vectors(spark, sf):
    u = similar.unit_vector(F.col("embedding"), 96)
    return derived.table(spark, sf, "embeddings").withColumn("u", u).select(
        "vec_id", F.size("u").alias("dimensions"), F.round(similar.norm(F.col("u")), 6).alias("norm"),
        F.round(F.get("u", 0), 6).alias("first_value"), F.round(F.get("u", 63), 6).alias("last_value"), F.get("u", 80).alias("padding"))


def hashed_vectors(spark: SparkSession, sf: str) -> DataFrame:
    texts = similar.with_embedding_text(claims_n(spark, sf)).select("document_id", "claim_id", "embedding_text", "embedding_text_hash")
    cache = spark.createDataFrame([], "namespace string, embedding_text_hash string, vector array<float>")
    vectors, _ = similar.embed_once(texts, cache, "hashed-256", similar.hashed_embedder())
    return vectors.withColumn("namespace", F.lit("hashed-256"))


@add("emb_05_hashed_embeddings")
def hashed_embeddings(spark, sf):
    """Built-in embedder over every claim text: dimension and norm of each vector."""
    v = F.col("vector")
    return hashed_vectors(spark, sf).select("document_id", "claim_id", F.size(v).alias("dimensions"), F.round(similar.norm(v), 5).alias("norm"))


@add("emb_06_embed_once", """select sha256(text) as embedding_text_hash, count(*) as documents,
  case when bool_or(source = 'src3') then 'cached' else 'created' end as origin from documents group by 1""")
def embed_once(spark, sf):
    """Document texts with copies: a text already known from one source is taken from the cache, the rest is embedded once."""
    texts = derived.table(spark, sf, "documents").select(
        "doc_id", "source", F.col("text").alias("embedding_text"), similar.text_hash(F.col("text")).alias("embedding_text_hash"))
    cache = texts.where("source = 'src3'").select(
        F.lit("n").alias("namespace"), "embedding_text_hash", F.array(F.lit(1.0).cast("float")).alias("vector")).distinct()

    def embed(missing):
        return missing.withColumn("vector", F.array(F.lit(2.0).cast("float")))

    vectors, _ = similar.embed_once(texts, cache, "n", embed)
    return vectors.groupBy("embedding_text_hash").agg(
        F.count(F.lit(1)).alias("documents"),
        F.when(F.max(F.get("vector", 0)) == 1.0, F.lit("cached")).otherwise(F.lit("created")).alias("origin"))


@add("emb_07_stale_claims", f"""with {sql.SIDES} select document_id, count(*) as stale from sides
where unit is null or scope = 'standalone' or qualifier = 'audited' group by 1""")
def stale_claims(spark, sf):
    """Stored state per claim: some without vector, some of another model, some with an older text."""
    claims = (similar.with_embedding_text(claims_n(spark, sf))
              .withColumn("embedding", F.when(F.col("unit").isNotNull(), F.array(F.lit(1.0))))
              .withColumn("embedding_model", F.when(F.col("scope").eqNullSafe(F.lit("standalone")), F.lit("old")).otherwise(F.lit("new")))
              .withColumn("stored_text_hash", F.when(F.col("qualifier").eqNullSafe(F.lit("audited")), F.lit("?")).otherwise(F.col("embedding_text_hash"))))
    return similar.stale_claims(claims, "new").groupBy("document_id").agg(F.count(F.lit(1)).alias("stale"))


_NEIGHBOURS = """pairs as (select a.label, a.vec_id as va, b.vec_id as vb, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) as s
  from embeddings a join embeddings b on a.label = b.label and a.vec_id <> b.vec_id),
top as (select * from (select *, row_number() over (partition by label, va order by round(s, 9) desc, vb) as n from pairs where round(s, 9) >= 0.30) where n <= 10)"""
_IDS = "'l' || cast(label as varchar) as document_id, lpad(cast(va as varchar), 10, '0') as claim_id, lpad(cast(vb as varchar), 10, '0') as neighbour_id"


@add("emb_08_top_neighbours", f"with {_NEIGHBOURS} select {_IDS}, round(s, 6) as similarity, n as rank from top")
def top_neighbours(spark, sf):
    found = similar.top_neighbours(vector_claims(spark, sf), threshold=THRESHOLD)
    return found.select("document_id", "claim_id", "neighbour_id", F.round("similarity", 6).alias("similarity"), "rank")


@add("emb_08_neighbours_tiled", f"with {_NEIGHBOURS} select {_IDS}, round(s, 6) as similarity from top")
def neighbours_tiled(spark, sf):
    """The same search with tiles of 16 claims, as a document with very many claims would run."""
    found = similar.top_neighbours(vector_claims(spark, sf), threshold=THRESHOLD, tile_rows=16)
    return found.select("document_id", "claim_id", "neighbour_id", F.round("similarity", 6).alias("similarity"))


@add("emb_09_fresh_neighbours", f"""with {_NEIGHBOURS} select {_IDS}, round(s, 6) as similarity from top
join (select vec_id, embedding from embeddings) e on e.vec_id = vb where e.embedding[1] > 0""")
def fresh_neighbours(spark, sf):
    """Claims whose first coordinate is not positive count as edited since they were embedded."""
    vectors = vector_claims(spark, sf)
    claims = vectors.select("document_id", "claim_id", F.lit("h").alias("embedding_text_hash"),
                            F.when(F.get("vector", 0) > 0, F.lit("h")).otherwise(F.lit("old")).alias("stored_text_hash"))
    found = similar.fresh_neighbours(similar.top_neighbours(vectors, threshold=THRESHOLD), claims)
    return found.select("document_id", "claim_id", "neighbour_id", F.round("similarity", 6).alias("similarity"))


@add("emb_10_approximate_neighbours")
def approximate_neighbours(spark, sf):
    found = vector_index.index_neighbours(vector_claims(spark, sf), threshold=THRESHOLD).neighbours
    return found.select("document_id", "claim_id", "neighbour_id", F.round("similarity", 6).alias("similarity"))


@add("emb_10_index_quality")
def index_quality(spark, sf):
    """Per document: recall of the index against the exact search, and the comparisons of both."""
    vectors = vector_claims(spark, sf)
    found = vector_index.index_neighbours(vectors, threshold=THRESHOLD)
    return vector_index.measured(vectors, found, similar.top_neighbours(vectors, threshold=THRESHOLD))


@add("snk_06_saved_embeddings", f"""with {sql.SIDES} select claim_id, case when vec_id is null then 'old' else 'given' end as embedding_model,
  case when vec_id is null then 'old' else 'v' || cast(vec_id as varchar) end as embedding_text_hash, round(coalesce(embedding[1]::double, 0.0::double), 5) as first_value
from sides left join embeddings on vec_id = cast(substr(claim_id, 2) as bigint)""")
def saved_embeddings(spark, sf):
    claims = claims_n(spark, sf).select("document_id", "claim_id", F.array(F.lit(0).cast("float")).alias("embedding"),
                                        F.lit("old").alias("embedding_model"), F.lit("old").alias("embedding_text_hash"))
    given = derived.table(spark, sf, "embeddings").select(
        F.concat(F.lit("c"), F.lpad(F.col("vec_id").cast("string"), 10, "0")).alias("claim_id"), "embedding",
        F.lit("given").alias("embedding_model"), F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("embedding_text_hash"))
    vectors = given.join(claims.select("document_id", "claim_id"), "claim_id")
    return similar.save_embeddings(claims, vectors).select(
        "claim_id", "embedding_model", "embedding_text_hash", F.round(F.get("embedding", 0).cast("double"), 5).alias("first_value"))
