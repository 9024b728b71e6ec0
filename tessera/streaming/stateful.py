"""A work queue whose entries live in the state of a streaming query.

Every entry (path, payload) has one row of state under its path: its retries, its
payload and whether it waits or is done. The handler runs once for an entry when it
arrives; while an entry is in flight, further arrivals of its path join it. Work that
fails waits in the state for a timer, longer after each failure, and goes to the dead
letters after ``max_retries`` failures. State, offsets and output are of one
micro-batch: after a crash a batch is run again from the state before it, so an entry
isn't lost, and no folder of retries grows.

Equal entries of one ``enqueue`` are stored once, with their number, so a worker's
Python meets each path once for each different entry. Tries leave it as rows: those whose
timers are due in one batch leave a task together.

``Queue.start`` returns the query that already drains a queue in this session instead
of starting a second one; Spark refuses a second one with the same checkpoint elsewhere.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from . import by_value

ENTRY = "path string, retries int, payload map<string,string>"
STORED = f"{ENTRY}, copies long"
OUTCOME = "path string, outcome string, retries int, payload map<string,string>, last_error string, due timestamp, joined int"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MAX_RETRIES, MESSAGE_CHARS = 5, 500
TRY = Row(*[c.split()[0] for c in OUTCOME.split(", ")])

#: Does the work of (path, payload, failures so far); raises if it fails.
Handler = Callable[[str, dict, int], None]


def backoff(retries: int, first: float, most: float) -> float:
    """Seconds to wait after the given number of failures: doubles, up to ``most``."""
    return min(most, first * 2 ** max(0, retries - 1))


class Worker(StatefulProcessor):
    """One path: its entry in flight, if any, and the timer of its next try."""

    def __init__(self, handler: Handler, max_retries: int, first_wait: float, most_wait: float):
        self.handler, self.max_retries, self.first_wait, self.most_wait = handler, max_retries, first_wait, most_wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "retries int, payload map<string,string>, joined int")

    def _try(self, path: str, retries: int, payload: dict, joined: int, now: int, held: bool) -> Row:
        error, due = None, None
        try:
            self.handler(path, payload, retries)
        except Exception as e:  # the work may fail in any way; that is what the queue is for
            error, retries = f"{type(e).__name__}: {e}"[:MESSAGE_CHARS], retries + 1
        if error is not None and retries < self.max_retries:
            wait = int(1000 * backoff(retries, self.first_wait, self.most_wait))
            due = now + max(1, wait)
            self.entry.update((retries, payload, joined))
            self.handle.registerTimer(due)
            outcome = "retried"
        else:
            if held:
                self.entry.clear()
            outcome = "succeeded" if error is None else "failed"
        return TRY(path, outcome, retries, list(payload.items()), error, None if due is None else datetime.fromtimestamp(due / 1000, timezone.utc), joined)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802
        first = next(rows)
        arrived = first["copies"] + sum(row["copies"] for row in rows)
        if (held := self.entry.get()) is not None:
            # in flight: its timer will try again, for all that ask for this path
            retries, payload, joined = held
            self.entry.update((retries, payload, joined + arrived))
            return
        yield self._try(key[0], first["retries"], dict(first["payload"] or {}), arrived - 1, timerValues.getCurrentProcessingTimeInMs(), False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802
        if (held := self.entry.get()) is None:
            return
        retries, payload, joined = held
        yield self._try(key[0], retries, dict(payload or {}), joined, timerValues.getCurrentProcessingTimeInMs(), True)

    def close(self) -> None:
        pass


def outcomes(entries: DataFrame, handler: Handler, *, max_retries: int = MAX_RETRIES, first_wait: float = 1.0, most_wait: float = 300.0) -> DataFrame:
    """A streaming table of what becomes of streaming ``entries``: path, outcome (succeeded, retried, failed), retries,
    payload, last_error, due (of the next try) and joined (arrivals of the same path while it was in flight).

    Rows without a path are left out; missing retries are 0, a missing payload is empty. A row with ``copies`` stands for so many.
    """
    entries.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    by_value(Worker, handler)
    have = entries.columns
    retries = F.coalesce(F.col("retries"), F.lit(0)).cast("int") if "retries" in have else F.lit(0)
    payload = F.col("payload").cast("map<string,string>") if "payload" in have else F.create_map().cast("map<string,string>")
    copies = F.coalesce(F.col("copies"), F.lit(1)).cast("int") if "copies" in have else F.lit(1)
    rows = entries.select("path", retries.alias("retries"), payload.alias("payload"), copies.alias("copies")).filter("path is not null and path <> ''")
    worker = Worker(handler, max_retries, first_wait, most_wait)
    return rows.groupBy("path").transformWithState(statefulProcessor=worker, outputStructType=OUTCOME, outputMode="Append", timeMode="ProcessingTime")


@dataclass
class Queue:
    """A folder of entries (JSON lines), and where its outcomes and its state go."""

    spark: SparkSession
    folder: str
    results: str
    checkpoint: str
    handler: Handler
    max_retries: int = MAX_RETRIES
    first_wait: float = 1.0
    most_wait: float = 300.0
    every: str = "1 second"

    @property
    def name(self) -> str:
        return f"queue {self.checkpoint}"

    def enqueue(self, entries: DataFrame) -> None:
        """Adds entries; a write overwrites none. Equal ones are written once, with their number."""
        same = [c for c in ("path", "retries", "payload") if c in entries.columns]
        entries.filter("path is not null and path <> ''").groupBy(*same).agg(F.count("*").alias("copies")).write.mode("append").json(self.folder)

    def start(self) -> StreamingQuery:
        """The query that drains this queue: the running one if there is one."""
        for query in self.spark.streams.active:
            if query.name == self.name:
                return query
        source = self.spark.readStream.schema(STORED).option("recursiveFileLookup", True).json(self.folder)
        done = outcomes(source, self.handler, max_retries=self.max_retries, first_wait=self.first_wait, most_wait=self.most_wait)
        writer = done.writeStream.queryName(self.name).option("checkpointLocation", self.checkpoint).outputMode("append")
        return writer.trigger(processingTime=self.every).format("parquet").option("path", self.results).start()

    def drain(self, seconds: float = 600.0) -> None:
        """Runs until all entries in the folder are read and none is in flight, then stops."""
        query, until, first = self.start(), time.monotonic() + seconds, None
        try:
            while True:
                if (error := query.exception()) is not None:
                    raise error
                last = query.lastProgress
                first = last.batchId if first is None and last is not None else first
                # the first batch of a run may be one that was broken off before; it looks for no new files
                # Spark counts the rows of state (below 0: it doesn't); only where that leaves it open is the state itself read
                if last is not None and last.batchId > first and last.numInputRows == 0 and all(o.numRowsTotal <= 0 for o in last.stateOperators) and self.waiting().isEmpty():
                    return
                if time.monotonic() > until:
                    raise TimeoutError(f"still at work after {seconds} seconds")
                time.sleep(0.2)
        finally:
            query.stop()

    def done(self) -> DataFrame:
        """Every outcome so far, one row for each try."""
        return self.spark.read.schema(OUTCOME).parquet(self.results)

    def dead_letters(self) -> DataFrame:
        return self.done().filter("outcome = 'failed'")

    def waiting(self) -> DataFrame:
        """(path, retries, payload, joined) of entries in flight, read from the state of the last batch."""
        state = self.spark.read.format("statestore").option("stateVarName", "entry").load(self.checkpoint)
        return state.select("key.path", "value.retries", "value.payload", "value.joined")
