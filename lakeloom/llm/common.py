"""Shared folder, hot-key joins and text conventions of the operators."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as characters and as a Java/Python/DuckDB regex class.
WS_CHARS = " \t\n\x0b\x0c\r"
WS_CLASS = r"\x20\x09-\x0D"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_local_root: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where a local session names none (tests, a laptop), a temporary folder that
    is removed when the process ends; on a cluster it must be named.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("on a cluster, spark.checkpoint.dir must name a folder that driver and executors share")
    if not _local_root:
        _local_root.append(tempfile.mkdtemp(prefix="lakeloom-"))
        atexit.register(shutil.rmtree, _local_root[0], ignore_errors=True)
    return _local_root[0]


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_root(spark)}/lakeloom-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder, partitioned by the column ``by``, and read it back.

    Cuts the lineage: a lost executor costs the tasks that it ran, not the
    stages before. The path is kept in ``_lakeloom_path`` of the result.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.mode("overwrite").parquet(path, partitionBy=by)
    out = spark.read.schema(df.schema).parquet(path)
    out._lakeloom_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of :func:`materialize` that nothing reads any more, and let Spark drop finished shuffles."""
    for table in tables:
        spark = table.sparkSession
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(table._lakeloom_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    if tables:
        release(tables[0].sparkSession)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete shuffle files of frames that are no longer referenced."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small_batches(spark: SparkSession, rows: int = 400) -> None:
    """Bound the Arrow batches that Python workers hold, as texts may be long, and show workers the package's folder."""
    home = str(Path(__file__).resolve().parents[2])
    environment = spark.sparkContext.environment
    if home not in environment.get("PYTHONPATH", "").split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [environment.get("PYTHONPATH"), home]))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def in_buckets(rows: DataFrame, buckets: int, by: str = "bucket"):
    """``rows`` grouped by ``by`` (integers from 0 to ``buckets`` - 1), each bucket in a task of its own.

    Dealt by hash, several buckets meet in one task, which then fetches and
    sorts all of them.
    """
    return rows.withColumn(by, F.col(by).cast("int")).repartitionById(buckets, by).groupBy(by)


def attach_groups(rows: DataFrame, groups: DataFrame, key: str, size_col: str, parts: int = 1024) -> DataFrame:
    """Join ``groups`` (one row per key, ``size_col`` rows of ``rows`` each) to ``rows`` by ``key``.

    A key that holds at least ``1/parts`` of all rows is hot. There are at most
    ``parts`` hot keys, whatever the input, so they are broadcast and their
    rows stay where they are; only the others are shuffled, and no one of them
    weighs enough to slow a task down.
    """
    total = groups.agg(F.coalesce(F.sum(size_col), F.lit(0)).alias("n")).head().n
    is_hot = F.col(size_col) * F.lit(parts) >= F.lit(total)
    hot = groups.filter(is_hot)
    cold = groups.filter(~is_hot)
    hot_rows = rows.join(F.broadcast(hot), key)
    cold_rows = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return hot_rows.unionByName(cold_rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
