"""Events of a plan's stages, gathered while the stages run.

A traced stage is observed as it is written: Spark hands its row counts and score range
to the driver with the end of the job that writes it, so no stage is read again for its
trace. Stages take the place of ``materialize`` through their ``keep`` argument.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..tables import materialize

EVENT = "nth int, stage string, rows long, queries long, lowest double, highest double, missing long, seconds double"


def metrics_of(df: DataFrame) -> list[Column]:
    """What an event says of a table: its rows, the queries that have one, its scores' range, and hits without a text."""
    found = [F.count(F.lit(1)).alias("rows")]
    if "rank" in df.columns:
        found.append(F.count_if(F.col("rank") == 1).alias("queries"))
    if "score" in df.columns:
        found += [F.min("score").alias("lowest"), F.max("score").alias("highest")]
    if "section_text" in df.columns:
        found.append(F.count_if(F.col("section_text").isNull()).alias("missing"))
    return found


@dataclass
class Trace:
    """Collects the events of one run, a row for each stage; ``on_event`` is called with every event as it comes."""

    on_event: Callable[[dict], None] | None = None
    events: list[dict] = field(default_factory=list)

    def keep(self, df: DataFrame, stage: str) -> DataFrame:
        """``df``, written and read back, with an event."""
        seen, began = Observation(), time.monotonic()
        out = materialize(df.observe(seen, *metrics_of(df)), stage)
        found = seen.get
        event = {"nth": len(self.events), "stage": stage, **{k: found.get(k) for k in ("rows", "queries", "lowest", "highest", "missing")}, "seconds": round(time.monotonic() - began, 3)}
        self.events.append(event)
        if self.on_event:
            self.on_event(event)
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        """The events so far, one row for each stage of the plan."""
        names = [c.split()[0] for c in EVENT.split(", ")]
        return spark.createDataFrame([tuple(e[n] for n in names) for e in self.events], EVENT)

    def report(self) -> str:
        """A line for each event."""
        lines = []
        for e in self.events:
            scores = "" if e["lowest"] is None else f", {e['lowest']:.3f} to {e['highest']:.3f}"
            queries = "" if e["queries"] is None else f" for {e['queries']} queries"
            missing = f", {e['missing']} without text" if e["missing"] else ""
            lines.append(f"{e['stage']}: {e['rows']} rows{queries}{scores}{missing} ({e['seconds']:.2f} s)")
        return "\n".join(lines)
