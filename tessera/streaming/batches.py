"""Batches of model requests: submitted by tasks, followed by a streaming source, answered in request order.

The source's offset is the set of batches that have ended. ``latestOffset`` looks at the
open ones that are due: sooner when a batch is nearly done, later when much is open or
after an error, and gives a batch up after too many looks or errors. A batch that has
ended is read by as many tasks as it has slices of results, all in one micro-batch; so
what it lacks is known then, and each of its requests gets its row: the result, the
service's error, or the note that there is none. A restart looks again and reads only
batches that no earlier micro-batch has read.

A service is an object with ``create(requests, key) -> batch id``, ``look(batch id) ->
(ended, open, results)`` and ``results(batch id, first, last)``, which gives dicts of
``RESULT``'s fields but for batch_id; ``make_service`` makes one wherever it is needed.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from ..operators.flow import check_ids, poll_wait
from ..tables import discard, materialize
from . import by_value

RESULT = "batch_id string, request_id string, status string, error string, text string, stop_reason string, input_tokens long, output_tokens long, cached_read long, cached_created long"
FIELDS = [c.split()[0] for c in RESULT.split(", ")]
RESPONSE = "batch_id string, position long, request_id string, status string, error string, text string, stop_reason string, input_tokens long, output_tokens long, cached_read long, cached_created long"
BATCH_REQUESTS, SLICE = 10_000, 2_000
FIRST_WAIT, MOST_LOOKS, MOST_ERRORS = 5.0, 180, 10


@dataclass
class Watch:
    """How often a batch was looked at, and when the next look is due."""

    wait: float
    due: float
    looks: int = 0


@dataclass
class Slice(InputPartition):
    """Results ``first`` to ``last`` of a batch; its first slice also says that it has ended, or why it was given up."""

    batch_id: str
    first: int
    last: int
    error: str | None


@dataclass
class Watcher:
    """Looks at batches until all have ended; ``ended`` has (number of results, why it was given up) of those."""

    service: object
    open: dict[str, Watch]
    first_wait: float = FIRST_WAIT
    most_looks: int = MOST_LOOKS
    clock: Callable[[], float] = time.time
    ended: dict[str, tuple[int, str | None]] = field(default_factory=dict)

    def look(self) -> None:
        for batch_id in [b for b, w in self.open.items() if w.due <= self.clock()]:
            watch = self.open[batch_id]
            watch.looks += 1
            try:
                ended, pending, results = self.service.look(batch_id)
            except Exception as e:  # a service may fail in any way; the next look may succeed
                if watch.looks > MOST_ERRORS:
                    self._end(batch_id, 0, f"polling failed at look {watch.looks}: {e}"[:500])
                    continue
                watch.wait = poll_wait(watch.wait, 0, True)
            else:
                if ended:
                    self._end(batch_id, results, None)
                    continue
                watch.wait = poll_wait(watch.wait, pending, False) if self.first_wait >= 1 else self.first_wait
            if watch.looks >= self.most_looks:
                self._end(batch_id, 0, f"still open after {watch.looks} looks")
            watch.due = self.clock() + watch.wait

    def _end(self, batch_id: str, results: int, error: str | None) -> None:
        del self.open[batch_id]
        self.ended[batch_id] = (results, error)


class ResultReader(DataSourceStreamReader):
    def __init__(self, make_service: Callable, options: dict):
        self.make_service = make_service
        first_wait = float(options.get("firstwait", FIRST_WAIT))
        watched = {b: Watch(first_wait, 0.0) for b in json.loads(options["batches"])}
        self.watcher = Watcher(make_service(), watched, first_wait, int(options.get("mostlooks", MOST_LOOKS)))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"ended": {}}

    def latestOffset(self) -> dict:  # noqa: N802
        self.watcher.look()
        return {"ended": {b: list(x) for b, x in sorted(self.watcher.ended.items())}}

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        parts = []
        for batch_id, (n, error) in end["ended"].items():
            if batch_id not in start["ended"]:
                parts += [Slice(batch_id, i, min(n, i + SLICE), error) for i in range(0, max(n, 1), SLICE)]
        return parts

    def read(self, partition: Slice) -> Iterator[tuple]:
        p = partition
        if p.first == 0:
            yield (p.batch_id, None, "ended" if p.error is None else "given up", p.error, *[None] * 6)
        if p.last > p.first:
            for row in self.make_service().results(p.batch_id, p.first, p.last):
                yield (p.batch_id, *[row.get(f) for f in FIELDS[1:]])

    def commit(self, end: dict) -> None:
        pass


def result_source(make_service: Callable) -> type[DataSource]:
    """The data source ``batch_results`` of a service. Options: ``batches`` (a JSON array of ids), ``firstWait``, ``mostLooks``."""

    class BatchResults(DataSource):
        @classmethod
        def name(cls) -> str:
            return "batch_results"

        def schema(self) -> str:
            return RESULT

        def streamReader(self, schema) -> ResultReader:  # noqa: N802
            return ResultReader(make_service, {k.lower(): v for k, v in self.options.items()})

    return BatchResults


def respond(submitted: DataFrame, results: DataFrame) -> DataFrame:
    """A row of ``RESPONSE`` for every request of ``submitted(batch_id, position, request_id)`` whose batch ended in ``results``.

    Results that nobody asked for are left out; of several for a request the first by
    status and text counts. Requests without one, and those of a batch that was given
    up, are errored, with no tokens.
    """
    # ids of batches may be long: rows are sorted and dealt by a digest, and get the id back at the end
    batch = F.md5("batch_id").alias("_batch")
    marks = results.filter("request_id is null").select(batch, "batch_id", F.col("error").alias("_given_up")).dropDuplicates(["_batch"])
    values = F.struct("status", *[c for c in FIELDS[2:] if c != "status"])
    own = results.filter("request_id is not null").select(batch, "request_id", values.alias("r")).groupBy("_batch", "request_id").agg(F.min("r").alias("r"))
    rows = submitted.select(batch, "position", "request_id").join(own, ["_batch", "request_id"], "left").join(marks, "_batch")
    none = F.col("r").isNull()
    status = F.when(none | (F.col("r.status") != "succeeded"), "errored").otherwise("succeeded")
    error = F.when(none, F.coalesce("_given_up", F.lit("no result for this request"))).when(status == "errored", F.coalesce("r.error", F.concat(F.lit("the request "), "r.status")))
    tokens = [F.coalesce(F.col(f"r.{c}"), F.lit(0)).cast("long").alias(c) for c in FIELDS[6:]]
    return rows.select("batch_id", "position", "request_id", status.alias("status"), error.alias("error"), F.when(status == "succeeded", F.col("r.text")).alias("text"), "r.stop_reason", *tokens)


class Batches:
    """Requests of one run, in a folder: what was submitted, the source's checkpoint and the responses."""

    def __init__(self, spark: SparkSession, folder: str, make_service: Callable, *, first_wait: float = FIRST_WAIT, most_looks: int = MOST_LOOKS):
        self.spark, self.folder, self.make_service, self.first_wait, self.most_looks = spark, folder.rstrip("/"), make_service, first_wait, most_looks

    def submit(self, requests: DataFrame, *, size: int = BATCH_REQUESTS) -> DataFrame:
        """Sends ``requests(request_id, position, prompt)`` in batches of about ``size``; (batch_id, position, request_id).

        Every request needs an id of its own. A batch has a key made of its requests, so
        a task that runs again makes no second batch if the service knows keys.
        """
        check_ids(requests)
        batches = max(1, -(-requests.count() // size))
        make_service = self.make_service

        def send(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("position", kind="stable")
            key = f"{pdf['request_id'].iloc[0]}-{len(pdf)}-{pdf['request_id'].iloc[-1]}"
            batch_id = make_service().create(pdf[["request_id", "prompt"]].to_dict("records"), key)
            return pd.DataFrame({"batch_id": batch_id, "position": pdf["position"], "request_id": pdf["request_id"]})

        rows = requests.select(F.col("request_id").cast("string").alias("request_id"), F.col("position").cast("long").alias("position"), "prompt")
        sent = rows.groupBy(F.pmod(F.xxhash64("request_id"), F.lit(batches)).alias("_batch")).applyInPandas(lambda pdf: send(pdf), "batch_id string, position long, request_id string")
        sent.write.mode("append").parquet(f"{self.folder}/submitted")
        return self.submitted()

    def submitted(self) -> DataFrame:
        return self.spark.read.schema("batch_id string, position long, request_id string").parquet(f"{self.folder}/submitted")

    def start(self) -> StreamingQuery:
        """Follows all batches submitted so far. Their ids, one for thousands of requests, are collected for the source."""
        ids = sorted(r[0] for r in self.submitted().select("batch_id").distinct().collect())
        by_value(result_source, poll_wait, self.make_service)
        self.spark.dataSource.register(result_source(self.make_service))
        source = self.spark.readStream.format("batch_results").option("batches", json.dumps(ids)).option("firstWait", str(self.first_wait)).option("mostLooks", str(self.most_looks)).load()

        def handle(batch: DataFrame, number: int) -> None:
            results = materialize(batch, "batch-results")
            # a micro-batch that runs again replaces its own responses
            respond(self.submitted(), results).write.mode("overwrite").parquet(f"{self.folder}/responses/micro={number}")
            discard(results)

        return source.writeStream.foreachBatch(handle).option("checkpointLocation", f"{self.folder}/checkpoint").trigger(processingTime="0 seconds").start()

    def wait(self, seconds: float = 3600.0) -> DataFrame:
        """Follows the batches until every request has its response; these."""
        query, until, asked = self.start(), time.monotonic() + seconds, self.submitted().count()
        try:
            while asked and self.responses().count() < asked:
                if (error := query.exception()) is not None:
                    raise error
                if time.monotonic() > until:
                    raise TimeoutError(f"batches are still open after {seconds} seconds")
                time.sleep(0.2)
        finally:
            query.stop()
        return self.responses()

    def responses(self) -> DataFrame:
        """The responses so far, to be ordered by ``position``."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/responses")
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], RESPONSE)
        return self.spark.read.schema(RESPONSE).option("recursiveFileLookup", True).parquet(f"{self.folder}/responses")
