"""Keyed tables as parquet snapshots: insert once, upsert, cascade delete.

Every write lands in a new version folder and becomes visible when the version marker
is written, so a repeated or interrupted job leaves either the old or the new snapshot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType


def with_content_hash(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("content_hash", F.sha2(F.col("text"), 256))


def last_of_batch(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Among rows with one key the last of the batch is kept (aggregated map-side)."""
    fields = rows.columns
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*fields), F.col(order)).alias("row")).select("row.*")


def insert_once(stored: DataFrame, batch: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of the batch that the table does not hold yet."""
    return last_of_batch(batch, keys, order).join(stored.select(*keys), keys, "left_anti")


def upsert(stored: DataFrame, batch: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """New snapshot: batch rows replace stored rows of the same key."""
    fields = [c for c in stored.columns]
    newest = batch if order is None else last_of_batch(batch, keys, order)

    def versioned(df, version):
        return df.select(*keys, F.struct(*fields).alias("row"), F.lit(version).alias("version"))

    return (versioned(stored, 0).unionByName(versioned(newest.select(*fields), 1))
            .groupBy(*keys).agg(F.max_by("row", "version").alias("row")).select("row.*"))


def without_documents(df: DataFrame, deleted: DataFrame) -> DataFrame:
    """Cascade of a document delete onto any table keyed by document_id."""
    return df.join(deleted.select("document_id"), "document_id", "left_anti")


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def ordered_read(df: DataFrame, order: list[str]) -> DataFrame:
    """Document by document in ``order``: a range-partitioned sort, so a large document spreads over tasks."""
    return df.orderBy("document_id", *order)


class Snapshot:
    """A versioned parquet table at ``path``; readers see the newest complete version."""

    def __init__(self, spark: SparkSession, path: str, schema, partition_by: tuple[str, ...] = ()):
        self.spark, self.path, self.schema, self.partition_by = spark, path.rstrip("/"), schema, partition_by

    def _fs(self):
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, root.getFileSystem(self.spark._jsc.hadoopConfiguration()), root

    def version(self, before: int | None = None) -> int:
        """Newest version (below ``before``) whose write finished; Spark leaves _SUCCESS last."""
        jvm, fs, root = self._fs()
        if not fs.exists(root):
            return -1
        found = [-1]
        for item in fs.listStatus(root):
            name = item.getPath().getName()
            if name.startswith("v") and name[1:].isdigit() and fs.exists(
                    jvm.org.apache.hadoop.fs.Path(item.getPath(), "_SUCCESS")):
                found.append(int(name[1:]))
        return max(v for v in found if before is None or v < before)

    def read(self, before: int | None = None) -> DataFrame:
        version = self.version(before)
        if version < 0:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v{version}")

    def replace(self, df: DataFrame, version: int | None = None) -> DataFrame:
        """Write the next version (or exactly ``version``, for replayed batches)."""
        version = self.version() + 1 if version is None else version
        writer = df.write.mode("overwrite")
        if self.partition_by:
            writer = writer.partitionBy(*self.partition_by)
        writer.parquet(f"{self.path}/v{version}")
        return self.read()


class AppendTable:
    """A parquet table that grows by one folder per batch id; a replayed batch overwrites its own folder."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str):
        self.spark, self.path = spark, path.rstrip("/")
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def write(self, df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/batch_id={batch_id}")

    def read_batch(self, batch_id: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/batch_id={batch_id}")

    def read(self, before: int | None = None) -> DataFrame:
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        if not root.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(root):
            return self.spark.createDataFrame([], self.schema)
        wanted = StructType([*self.schema.fields, StructField("batch_id", IntegerType())])
        rows = self.spark.read.option("basePath", self.path).schema(wanted).parquet(self.path)
        rows = rows if before is None else rows.where(F.col("batch_id") < before)
        return rows.drop("batch_id")

