"""Cutting lineage in iterative operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir.

    Where that is unset: a temporary folder if everything runs in one process, as in tests, and
    otherwise one in the warehouse, which all executors share.
    """
    found = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not found:
        single = spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster")
        found = tempfile.mkdtemp(prefix="oficina-") if single else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/oficina-checkpoints"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def own_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, removed when the driver's JVM ends."""
    path = f"{folder(spark)}/oficina/{name}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder(spark))
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written to a new folder in the shared one as Parquet and read back: smaller than a checkpoint where columns repeat."""
    path = own_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """Dealt out by keys to as many tasks as the session shuffles into: a narrow table is few files, however much work each of its rows makes."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *by)
