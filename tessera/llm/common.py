"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run without ASCII white space (space, tab to carriage return).
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none and the master is local (single-machine
    tests) a temporary folder is made and kept in the session under the same
    name; a cluster without the setting is refused.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to a table in the shared folder and reads it back.

    Cuts the lineage: what follows restarts from the written files when an
    executor is lost, and a costly column is computed once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return _noted(spark.read.schema(df.schema).parquet(path), path)


#: Folders of ``cut`` and ``bucketed`` that are still there, oldest first.
WRITTEN: list[str] = []
#: Names of those that are tables.
BUCKETED: set[str] = set()


def _noted(df: DataFrame, path: str) -> DataFrame:
    WRITTEN.append(path)
    df.written_to = path
    return df


def delete_written(spark: SparkSession, path: str) -> None:
    """Deletes a folder of ``cut`` or ``bucketed``."""
    if (name := path.rpartition("/")[2]) in BUCKETED:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        BUCKETED.discard(name)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    if path in WRITTEN:
        WRITTEN.remove(path)


def discard(*tables: DataFrame) -> None:
    """Deletes the files of results of ``cut`` or ``bucketed`` that nothing reads any more."""
    for df in tables:
        delete_written(df.sparkSession, df.written_to)


def bucketed(df: DataFrame, keys: list[str], name: str, *, deal: bool = False) -> DataFrame:
    """``cut`` to a table bucketed by ``keys``: joins on exactly these keys don't shuffle it again.

    ``deal`` deals the rows out first; without it they should stand by these keys already, for one file a bucket.
    """
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if deal:
        df = df.repartition(buckets, *keys)
    name = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark).rstrip('/')}/{name}"
    writer = df.write.format("parquet").option("path", path).option("compression", "zstd")
    writer.bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)
    BUCKETED.add(name)
    return _noted(spark.table(name), path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have yet, made from ``name``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def count_words(text: Column) -> Column:
    """Words in ``text``; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
