"""Session settings and the shared work folder."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_local_dirs: dict[str, str] = {}


def prepare(spark: SparkSession) -> SparkSession:
    """Runtime settings every plan relies on; cluster sizing is left to the caller."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    # rows that lie by page batch stay there in joins by page batch and a further key
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    # a task that holds one bucket writes it as it lies instead of sorting it by bucket
    spark.conf.set("spark.sql.maxConcurrentOutputFileWriters", "4")
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, for clusters on which it is not installed."""
    root = os.path.dirname(os.path.abspath(__file__))
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="spark-"), "claimloom"), "zip", os.path.dirname(root), os.path.basename(root))
    spark.sparkContext.addPyFile(archive)


def work_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir`` (the cluster's shared storage).

    Only on one machine, and only when the session names none (tests, laptops), a temporary folder stands in; on several machines
    a folder of one of them would lose rows, so that is an error.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        shared = _local_dirs.setdefault(app, tempfile.mkdtemp(prefix="spark-"))
    return f"{shared.rstrip('/')}/claimloom-{uuid.uuid4().hex}"


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """Add ``columns``, each computed once a row whatever reads it afterwards.

    Filters on plain columns are moved below them, with the expressions in place of the names: a filter on spans would trim the text
    anew for every block it looks at.  Nothing is moved below a generator, and one that makes one row of one row costs next to nothing.
    """
    return df.select(*[c for c in df.columns if c not in columns], F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def materialize(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` as a table on shared storage and read it back.

    The lineage ends at the files, so a lost executor re-reads instead of
    recomputing, and the reader knows the exact size of what it joins.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_by(df: DataFrame, name: str, keys: list[str], buckets: int) -> DataFrame:
    """Like ``materialize``, as a table bucketed by ``keys``: windows, groups and joins by them read it without a shuffle.

    Rows that already lie in ``buckets`` partitions by ``keys`` are written as they lie, one file per bucket.
    """
    spark = df.sparkSession
    table = f"claimloom_{name}_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(buckets, *keys).option("path", f"{work_dir(spark)}/{name}").saveAsTable(table)
    return spark.table(table)


_stages: dict[tuple[str, str, str], DataFrame] = {}


def stage(spark: SparkSession, name: str, source: str, build, keys: list[str] | None = None, buckets: int = 1) -> DataFrame:
    """A stored stage of the batch plan: written on first use, read by every later query.

    Stages are what the plan persists between its steps (normalized claims, comparison
    rows, chunks), kept per session and source folder; with ``keys`` bucketed by them.
    """
    key = (spark.sparkContext.applicationId, name, source)
    if key not in _stages:
        _stages[key] = materialize_by(build(), name, keys, buckets) if keys else materialize(build(), name)
    return _stages[key]


def spread(df: DataFrame) -> DataFrame:
    """Use every core when the input has fewer splits than cores (small single files).

    Large tables already have more splits than cores and are returned unchanged, so the
    shuffle exists only where the data is small.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
