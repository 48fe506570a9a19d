"""A corpus pipeline in four stages: language ID, exact dedup, near-duplicate join, packing.

Each stage reads all that its predecessor kept, from Parquet in the shared folder.  Part of the ``llm`` subpackage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm import exact_copies, jaccard_join, language, packing
from claimloom.llm.common import ROW, numbered, prepare, table, without_rows
from claimloom.llm.queries import ENGLISH, VOCABULARY, held_out
from claimloom.session import materialize

SHINGLE_WORDS, SIMILARITY_PERCENT = 5, 80


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; those without a letter go."""
    prepare(spark)
    prototypes = language.learn(docs.where(~held_out(F.col("doc_id"))))
    found = language.tagged(docs, prototypes).where(F.col("lang_pred") != language.UNKNOWN)
    return found.select(*[F.col(f"in_{i}").alias(name) for i, name in enumerate(docs.columns)])


def _identified(docs: DataFrame) -> DataFrame:
    """Rows told apart even where ids repeat or are null: by id, then by row."""
    return numbered(docs).withColumn("who", F.struct("doc_id", ROW))


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id."""
    prepare(spark)
    rows = _identified(docs)
    copies = exact_copies.exact_copies(rows, "who").where(~F.col("kept"))
    return without_rows(numbered(docs), materialize(copies.select(F.col(f"doc_id.{ROW}").alias(ROW)), "copies"))


def distinct_contents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest id."""
    prepare(spark)
    rows = _identified(docs)
    groups = jaccard_join.jaccard_components(rows, "who", n=SHINGLE_WORDS, percent=SIMILARITY_PERCENT)
    copies = groups.where(F.col(f"doc_id.{ROW}") != F.col(f"component_id.{ROW}"))
    return without_rows(numbered(docs), materialize(copies.select(F.col(f"doc_id.{ROW}").alias(ROW)), "near_copies"))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all documents in sequences of 2048 tokens."""
    prepare(spark)
    return packing.packed(docs, public_tokenizers.path(ENGLISH), public_tokenizers.PATTERN, vocabulary=public_tokenizers.path(VOCABULARY))


STAGES = [("language ID", known_language), ("exact dedup", distinct_texts), ("n-gram Jaccard join", distinct_contents), ("best-fit packing", packed_sequences)]
ORACLE_SQL = None  # neither the language vectors nor the packing can be said in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(prepare(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
