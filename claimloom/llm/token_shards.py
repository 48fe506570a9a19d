"""Token-id output in training order.

Every document has a number (its place in the scan).  A keyed Feistel network permutes the numbers; numbers that leave the range walk
the cycle until they are back in it, so the result is a permutation of 0..N-1 that needs no table.  It is the document's
global slot.  The documents are range-partitioned by slot, and every partition writes its ids in slot order as one shard of
fixed-stride binary records.  Reading shards and records in order gives the training order; a run resumes at any record by
seeking to ``record * stride``.

A record is ``RECORD_IDS`` little-endian unsigned 16-bit ids and one newline byte; an end id closes each document, documents run on
over records, and the last record of a shard is filled with ``FILL``.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimloom.llm.common import chosen, texts_of
from claimloom.llm.shingles import mixed
from claimloom.llm.tokens import byte_pairs

RECORD_IDS = 2048
STRIDE = 2 * RECORD_IDS + 1
END_ID, FILL = 50256, 65535
ROUNDS = 6
SHARD_BYTES = 16 << 20


def permuted(numbers: np.ndarray, size: int, key: int) -> np.ndarray:
    """The keyed permutation of 0..size-1: a balanced Feistel network with cycle-walking."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    keys = mixed(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key & ((1 << 64) - 1)))
    out = numbers.astype(np.uint64)
    walking = np.ones(len(out), bool)
    while walking.any():
        left, right = out[walking] >> np.uint64(half), out[walking] & low
        for k in keys:
            left, right = right, left ^ (mixed(right + k) & low)
        out[walking] = (left << np.uint64(half)) | right
        walking = out >= size
    return out.astype(np.int64)


def slotted(docs: DataFrame, key: int) -> tuple[DataFrame, int]:
    """``docs`` with a ``slot``, and how many there are.  Row numbers come from the scan: counts per input partition, then the row in it."""
    counts = docs.groupBy(F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()  # one row per input partition
    base, size = {}, 0
    for part, n in sorted(map(tuple, counts)):
        base[part], size = size, size + n
    known = docs.sparkSession.sparkContext.broadcast(base)

    @F.pandas_udf("bigint")
    def slot(row: pd.Series) -> pd.Series:
        rows = row.to_numpy()
        return pd.Series(permuted(np.array([known.value[p] for p in (rows >> 33).tolist()], np.int64) + (rows & ((1 << 33) - 1)), size, key))

    return docs.withColumn("slot", slot(F.monotonically_increasing_id())), size


def write_shards(docs: DataFrame, path: str, rank_file: str, pattern: str, key: int, text_col: str = "text") -> None:
    """Write the ids of all texts under ``path``, in the order of their slots."""
    order, _ = slotted(chosen(docs, text=text_col), key)
    size = docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`")))).first()[0] or 0
    shards = max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // SHARD_BYTES))

    def work(batches):
        pairs, ids = byte_pairs(rank_file, pattern), []
        for batch in batches:
            for text in texts_of(batch.column(0)):
                ids += pairs.encode(text)
                ids.append(END_ID)
            full = len(ids) // RECORD_IDS
            if full:
                whole = np.array(ids[:full * RECORD_IDS], "<u2").reshape(full, RECORD_IDS)
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in whole], pa.binary())], names=["record"])
                ids = ids[full * RECORD_IDS:]
        if ids:
            last = np.array(ids + [FILL] * (RECORD_IDS - len(ids)), "<u2")
            yield pa.RecordBatch.from_arrays([pa.array([last.tobytes()], pa.binary())], names=["record"])

    records = order.repartitionByRange(shards, "slot").sortWithinPartitions("slot").select("text").mapInArrow(work, "record binary")
    records.select(F.col("record").cast("string")).write.option("lineSep", "\n").option("compression", "none").text(path)


def read_records(spark: SparkSession, path: str, first: int = 0) -> DataFrame:
    """(shard, shard_record, record, ids binary) in training order from global record ``first`` on."""
    files = spark.read.format("binaryFile").load(path).where("path like '%part-%'").select("path", "length")
    number = F.regexp_extract("path", "part-([0-9]+)", 1).cast("bigint")  # names do not sort beyond 99,999 shards
    before = Window.orderBy(number).rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    index = files.withColumn("records", F.floor(F.col("length") / STRIDE)).withColumn("start", F.coalesce(F.sum("records").over(before), F.lit(0)))
    wanted = index.where(F.col("start") + F.col("records") > first).select("path", "start")
    rows = spark.read.format("binaryFile").load(path).select("path", "content").join(wanted, "path")

    def work(batches):
        for batch in batches:
            for shard, content, start in zip(*[c.to_pylist() for c in batch.columns]):
                skip = max(0, first - start)
                n = len(content) // STRIDE
                for low in range(skip, n, 1024):
                    at = range(low, min(n, low + 1024))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([shard] * len(at)), pa.array(list(at), pa.int64()), pa.array([start + i for i in at], pa.int64()),
                         pa.array([content[i * STRIDE:(i + 1) * STRIDE - 1] for i in at], pa.binary())], names=["shard", "shard_record", "record", "ids"])

    return rows.select("path", "content", "start").mapInArrow(work, "shard string, shard_record bigint, record bigint, ids binary")


def shard_documents(spark: SparkSession, path: str) -> DataFrame:
    """(slot, shard, start, length, ids_crc32) of every document, read from the shards: ``start`` counts ids within the shard."""
    def work(batches):
        for batch in batches:
            for shard, content in zip(*[c.to_pylist() for c in batch.columns]):
                ids = np.frombuffer(content, np.uint8).reshape(-1, STRIDE)[:, :-1].copy().view("<u2").ravel()
                ends = np.flatnonzero(ids == END_ID)
                starts = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
                sums = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(starts.tolist(), (ends + 1).tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard] * len(ends), pa.int64()), pa.array(np.arange(len(ends)), pa.int64()), pa.array(starts, pa.int64()),
                     pa.array(ends + 1 - starts, pa.int64()), pa.array(sums, pa.int64())], names=["shard", "number", "start", "length", "ids_crc32"])

    found = (spark.read.format("binaryFile").load(path).where("path like '%part-%'").select(F.regexp_extract("path", "part-([0-9]+)", 1).cast("bigint").alias("shard"), "content")
             .mapInArrow(work, "shard bigint, number bigint, start bigint, length bigint, ids_crc32 bigint"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    bases = found.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return found.join(bases, "shard").select((F.col("base") + F.col("number")).alias("slot"), "shard", "start", "length", "ids_crc32")


def training_order(docs: DataFrame, path: str, rank_file: str, pattern: str, key: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, slot, shard, start, length, ids_crc32) of every row, after writing the shards under ``path`` and reading them back.

    A null or empty text is its end id alone.  Repeated rows have a slot each; null ids are carried through; an empty table writes no
    record and gives an empty result; further columns are ignored.  The same input and key give the same order.
    """
    spark = docs.sparkSession
    write_shards(docs, path, rank_file, pattern, key, text_col)
    order, size = slotted(chosen(docs, doc_id=id_col), key)
    if not size:
        return order.select("doc_id", "slot", *[F.lit(0).cast("bigint").alias(c) for c in ("shard", "start", "length", "ids_crc32")])
    return order.join(shard_documents(spark, path), "slot").select("doc_id", "slot", "shard", "start", "length", "ids_crc32")
