"""Models on workers: loaded once in a process and kept for all later tasks there.

A model is named by a key and made by a function without arguments. ``model_udf`` makes
a column function of one; ``warm`` loads it in as many workers as the cluster runs tasks
at a time, all waiting for each other, so that no query pays for the loading.
"""

from __future__ import annotations

import os
import threading
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, StructType

#: Makes a model.
Load = Callable[[], Any]

_models: dict[str, Any] = {}
_lock = threading.Lock()


def model(key: str, load: Load) -> Any:
    """The model of this process under ``key``; the first call loads it, concurrent ones wait for that."""
    with _lock:
        if key not in _models:
            _models[key] = load()
        return _models[key]


def forget(key: str) -> None:
    """Drops a model of this process."""
    with _lock:
        _models.pop(key, None)


#: Rows that are Python objects at once; an Arrow batch has ten thousand, whatever their length.
ROWS_AT_ONCE = 128


def sliced(start: Callable[[], Callable[..., pa.Array]], returns: str) -> Callable[..., Column]:
    """A column function: ``start()`` gives a task's function on Arrow arrays of up to ``ROWS_AT_ONCE`` rows.

    Batches are cut before they become Python objects, and what is made of a slice leaves
    the worker before the next one, so its memory goes with the bytes of an input batch.
    """

    def over(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        run = None
        for columns in batches:
            run = start() if run is None else run
            columns = columns if isinstance(columns, tuple) else (columns,)  # a single column comes bare
            for at in range(0, max(1, len(columns[0])), ROWS_AT_ONCE):
                yield run(*(c.slice(at, ROWS_AT_ONCE) for c in columns))

    over.__annotations__ = {"batches": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
    made = F.arrow_udf(over, returns)
    return lambda *columns: made(*columns)


def each_row(function: Callable[..., Any], returns: str) -> Callable[..., Column]:
    """``function`` of every row's values, by slices."""
    kind = to_arrow_type(DataType.fromDDL(returns))
    return sliced(lambda: lambda *columns: pa.array([function(*values) for values in zip(*(c.to_pylist() for c in columns))], kind), returns)


def model_udf(key: str, load: Load, run: Callable[..., pd.Series | pd.DataFrame], returns: str) -> Callable[..., Column]:
    """A column function: ``run(model, *columns)`` on series of up to ``ROWS_AT_ONCE`` rows, with the worker's own model."""
    spark_type = DataType.fromDDL(returns)

    def start() -> Callable[..., pa.Array]:
        held = model(key, load)

        def one(*columns: pa.Array) -> pa.Array:
            got = run(held, *(c.to_pandas() for c in columns))
            if isinstance(spark_type, StructType):
                return pa.StructArray.from_arrays([pa.array(got[f.name], to_arrow_type(f.dataType), from_pandas=True) for f in spark_type], names=spark_type.names)
            return pa.array(got, to_arrow_type(spark_type), from_pandas=True)

        return one

    return sliced(start, returns)


def warm(spark: SparkSession, key: str, load: Load, workers: int | None = None) -> DataFrame:
    """Loads a model in ``workers`` processes at once (all slots without it): a row (pid, loaded) for each.

    It is a barrier stage, so it fails if the cluster can't run so many tasks together.
    """
    n = workers or spark.sparkContext.defaultParallelism

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _ in batches:
            pass
        there = key in _models
        model(key, load)
        BarrierTaskContext.get().barrier()
        yield pd.DataFrame({"pid": [os.getpid()], "loaded": [not there]})

    return spark.range(0, n, 1, n).mapInPandas(run, "pid long, loaded boolean", barrier=True)
