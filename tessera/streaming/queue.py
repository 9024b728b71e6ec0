"""A durable work queue on Structured Streaming.

Entries are JSON lines (path, retries, payload) in a folder. A streaming query
reads them in micro-batches, so each entry is claimed once and a restart goes on
from the checkpoint. Work that fails goes back as a new entry with one more retry,
or to the dead letters; nothing that arrives meanwhile is overwritten.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.usage import outcomes
from ..tables import discard, materialize

ENTRY = "path string, retries int, payload map<string,string>"
MAX_RETRIES = 5


def normalize(entries: DataFrame) -> DataFrame:
    """Entries with retries from 0; rows without a path are left out."""
    have = entries.columns
    retries = F.coalesce(F.col("retries"), F.lit(0)) if "retries" in have else F.lit(0)
    payload = F.col("payload") if "payload" in have else F.create_map().cast("map<string,string>")
    return entries.select("path", retries.cast("int").alias("retries"), payload.alias("payload")).filter("path is not null and path <> ''")


def enqueue(entries: DataFrame, folder: str) -> None:
    """Appends entries; each write is atomic and overwrites none."""
    normalize(entries).write.mode("append").json(folder)


def pending(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(ENTRY).option("recursiveFileLookup", True).json(folder)


def drain(batch: DataFrame, work: Callable[[DataFrame], DataFrame], max_retries: int = MAX_RETRIES) -> DataFrame:
    """``work`` adds ``ok`` and ``error``; the result says what becomes of each entry."""
    done = outcomes(work(batch), max_retries)
    failed = F.col("outcome") == "failed"
    return done.withColumns({"last_error": F.when(~F.col("ok"), F.col("error")), "failed_at": F.when(failed, F.current_timestamp())})


def consume(spark: SparkSession, folder: str, results: str, dead: str, checkpoint: str, work: Callable[[DataFrame], DataFrame], max_retries: int = MAX_RETRIES, files_per_batch: int = 100) -> StreamingQuery:
    """Starts a query that drains the folder until nothing is left; retries are entries of a later batch."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        # written once: the work runs once for all that is made of it
        done = materialize(drain(batch, work, max_retries), "queue-done")
        # a batch that is run again after a failure replaces its own output
        done.filter("outcome <> 'retried'").write.mode("overwrite").partitionBy("outcome").parquet(f"{results}/batch_id={batch_id}")
        done.filter("outcome = 'failed'").select("path", "retries", "payload", "last_error", "failed_at").write.mode("overwrite").json(f"{dead}/batch_id={batch_id}")
        back = done.filter("outcome = 'retried'").select("path", "retries", "payload")
        if not back.isEmpty():
            normalize(back).write.mode("overwrite").json(f"{folder}/retries-of-{batch_id}")
        discard(done)

    source = spark.readStream.schema(ENTRY).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", True).json(folder)
    return source.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
