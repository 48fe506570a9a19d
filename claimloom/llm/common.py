"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.session import prepare as prepare_session

# White space as the tokenizers' patterns see it (Unicode White_Space).
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings for whole texts: Arrow batches small enough that long documents fit a worker."""
    prepare_session(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chosen(df: DataFrame, **columns: str | Column) -> DataFrame:
    """Only the named columns, under the given names: other columns of the input cannot clash."""
    return df.select(*[(F.col(f"`{c}`") if isinstance(c, str) else c).alias(name) for name, c in columns.items()])


def arrow_map(df: DataFrame, work, schema: str) -> DataFrame:
    """``work(dict of column lists) -> dict of columns`` on every Arrow batch; columns follow ``schema``."""
    names = [f.split(":")[0].split()[0] for f in re.split(r",(?![^<(]*[>)])", schema.strip())]

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                out = work({n: batch.column(i) for i, n in enumerate(batch.schema.names)})
                yield pa.RecordBatch.from_arrays([out[n] if isinstance(out[n], pa.Array) else pa.array(out[n]) for n in names], names=names)

    return df.mapInArrow(run, schema)


def texts_of(column) -> list[str]:
    """Texts of an Arrow column, null as empty."""
    return [t or "" for t in column.to_pylist()]


ROW = "row__number"
BROADCAST_ROWS = 2_000_000  # 8 bytes each


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a number per row, the same in every reading of the same files."""
    return docs.withColumn(ROW, F.monotonically_increasing_id())


def without_rows(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``numbered`` docs but for the numbers of ``rows`` (a stored table).

    Up to BROADCAST_ROWS numbers are sent to every task, so that texts stay where they are; more are joined by shuffling.
    """
    rows = rows.select(ROW)
    return docs.join(F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows, ROW, "left_anti").drop(ROW)
