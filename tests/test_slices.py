"""Column functions that work on slices of an Arrow batch."""

import pandas as pd
from pyspark.sql import functions as F

from tessera.functions import registry
from tessera.functions.registry import ROWS_AT_ONCE


def test_a_model_gets_slices_of_a_batch(spark):
    sizes = registry.model_udf("sizes", lambda: len, lambda model, x: pd.Series([model(x)] * len(x)), "long")
    got = [r[0] for r in spark.range(0, 1000, 1, 1).select(sizes(F.col("id"))).collect()]
    assert len(got) == 1000 and max(got) == ROWS_AT_ONCE  # all 1000 before


def test_values_come_back_in_order_and_nulls_stay(spark):
    both = registry.each_row(lambda a, b: None if a is None else [{"x": a, "y": str(b)}] * (a % 3), "array<struct<x:long,y:string>>")
    t = spark.range(0, 1000, 1, 3).select("id", F.when(F.col("id") % 7 > 0, F.col("id")).alias("a")).withColumn("z", both("a", "id"))
    assert all(r["z"] == (None if r["a"] is None else [(r["a"], str(r["id"]))] * (r["a"] % 3)) for r in t.collect())
    assert t.limit(0).collect() == []
