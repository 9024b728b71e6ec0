"""Intermediate results that several later steps read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only where the session names no such folder and the master is local a temporary one is made."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def materialize(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Writes ``df`` below ``spark.checkpoint.dir`` and reads it back, so that it is computed once and survives lost executors.

    With ``by``, a column of integers, each value's rows have a folder of their own: a filter on it reads no other.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    (df.write if by is None else df.write.partitionBy(by)).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def spread(df: DataFrame, *by: str) -> DataFrame:
    """``df`` dealt into as many parts as the session shuffles into, for work that is not in proportion to a table's bytes."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *by)


def discard(*tables: DataFrame) -> None:
    """Deletes the files of results of ``materialize`` that nothing reads any more."""
    for df in tables:
        delete_folder(df.sparkSession, df.written_to)


def delete_folder(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
