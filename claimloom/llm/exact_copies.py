"""Exact dedup by a tree merge of sorted digest runs.

Every input partition makes one run: its distinct digests in order, each with the identifier to keep and a count.  The
runs then meet in rounds.  In a round the runs whose numbers agree after removing three binary digits exchange
their rows (a binomial tree that joins eight runs at a time), and a multiway merge of the sorted runs leaves one row per
digest.  Rows are dealt out by (merge node, slice of the digest), so that no node of the tree holds more than its slice,
even in the last round.  The identifiers travel back by (run, digest): a text that makes up a third of the corpus is one row per run
in the tree, and its documents meet only the row of their own run.

Verified: two documents count as equal only when SHA-256, length and an independent 64-bit hash of the text all agree.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import chosen
from claimloom.session import materialize

FAN_IN_BITS = 3
_KEY = ["digest", "size", "check"]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, size, check, run): SHA-256 of the text with A-Z lower-cased, and the partition it was read in."""
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batches):
        run = TaskContext.get().partitionId()
        for batch in batches:
            texts = [(t or "").encode().lower() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()), pa.array([len(t) for t in texts], pa.int64()),
                 pa.array([xxhash.xxh3_64_intdigest(t) - (1 << 63) for t in texts], pa.int64()), pa.array([run] * len(texts), pa.int32())],
                names=["doc_id", *_KEY, "run"])

    return chosen(docs, doc_id=id_col, text=text_col).mapInArrow(work, f"doc_id {kind}, digest binary, size bigint, check bigint, run int")


def merged_runs(runs: DataFrame, last_run: int, keep: str = "max") -> DataFrame:
    """One row per distinct key of (digest, size, check, run, keep_id, group_size), after all rounds of the tree."""
    best = F.max if keep == "max" else F.min
    for round_ in range(max(1, -(-last_run.bit_length() // FAN_IN_BITS))):
        sorted_runs = (runs.withColumn("node", F.shiftright("run", FAN_IN_BITS * (round_ + 1))).withColumn("slice", F.substring("digest", 1, 2))
                       .repartition("node", "slice").sortWithinPartitions("node", "slice", *_KEY))
        runs = (sorted_runs.groupBy("node", "slice", *_KEY)
                .agg(best("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
                .withColumn("run", F.shiftleft("node", FAN_IN_BITS * (round_ + 1))).drop("node", "slice"))
    return runs.drop("run")


def exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row.

    Null texts are empty texts.  The largest (``keep="min"``: smallest) id of equal texts stays; a null id stays only where no
    copy has an id.  Rows that repeat the staying id all count as kept.  An empty table gives an empty result.
    """
    prints = materialize(fingerprints(docs, id_col, text_col), "digests")
    best = F.max if keep == "max" else F.min
    runs = prints.groupBy("run", *_KEY).agg(best("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    last = prints.agg(F.max("run")).first()[0] or 0
    final = merged_runs(runs, last, keep)
    told = runs.select("run", *_KEY).join(final, _KEY)
    return (prints.join(told, ["run", *_KEY]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256")))
