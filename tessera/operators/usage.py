"""Usage, cost, content and latency aggregates."""

from __future__ import annotations

import functools
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import token_counts
from ..tables import materialize

# Default rates per million tokens.
RATES = {"input": 3.00, "cache_write": 3.75, "cache_read": 0.30, "output": 15.00, "batch_discount": 1.0}


#: What one token costs, in exact decimals.
PRICE = "decimal(18,12)"
ITEMS = ("uncached_input", "cache_read", "cache_write", "output", "total")


def cost(rates: dict[str, float] = RATES) -> Column:
    """Struct of ``ITEMS`` for a usage row, as exact decimals: sums don't depend on their order.

    Read tokens count on a cache hit, written ones on a miss; the discount holds
    only for batch rows (those with a number of successes).
    """
    per_token = lambda kind, part: F.lit(Decimal(str(rates[kind])) * part / 1_000_000).cast(PRICE)
    price = lambda kind: F.when(F.col("succeeded").isNotNull(), per_token(kind, Decimal(str(rates["batch_discount"])))).otherwise(per_token(kind, Decimal(1)))
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("decimal(18,0)")
    on = lambda flag, c: F.when(F.coalesce(F.col(flag), F.lit(False)), n(c)).otherwise(F.lit(0).cast("decimal(18,0)"))
    parts = [n("input_tokens") * price("input"), on("cache_hit", "cached_tokens_read") * price("cache_read"), on("cache_miss", "cached_tokens_created") * price("cache_write"), n("output_tokens") * price("output")]
    parts = [x.cast("decimal(36,12)") for x in parts]
    return F.struct(*[x.alias(c) for x, c in zip([*parts, sum(parts[1:], parts[0])], ITEMS)])


#: Columns of a usage row.
USAGE = {"duration": "double", "input_tokens": "long", "output_tokens": "long", "cache": "boolean", "cache_hit": "boolean", "cache_miss": "boolean", "cached_tokens_read": "long", "cached_tokens_created": "long", "succeeded": "int", "errored": "int"}


def normalize(*tables: DataFrame) -> DataFrame:
    """Usage rows of several sources as one table: columns of ``USAGE`` in their types (missing ones null; counts that every row has 0), others dropped."""
    def one(df: DataFrame) -> DataFrame:
        have = {c.lower(): c for c in df.columns}
        cols = [F.col(have[c]).cast(kind) if c in have else F.lit(None).cast(kind) for c, kind in USAGE.items()]
        zero = {"duration": 0.0, "input_tokens": 0, "output_tokens": 0, "cache": False}
        return df.select(*[(F.coalesce(x, F.lit(zero[c]).cast(kind)) if c in zero else x).alias(c) for (c, kind), x in zip(USAGE.items(), cols)])

    return functools.reduce(DataFrame.unionByName, map(one, tables))


def with_cost(usage: DataFrame, rates: dict[str, float] = RATES) -> DataFrame:
    return usage.withColumn("cost", cost(rates))


def collapse(usage: DataFrame, *by: str) -> DataFrame:
    """Sums, flags OR-ed; cache columns are null unless a row cached, batch columns unless a row was a batch."""
    cached, batch = F.bool_or("cache"), F.count("succeeded") > 0
    t = usage.groupBy(*by).agg(
        F.sum("duration").alias("duration"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), cached.alias("cache"),
        F.when(cached, F.bool_or("cache_hit")).alias("cache_hit"), F.when(cached, F.bool_or("cache_miss")).alias("cache_miss"),
        F.when(cached, F.sum("cached_tokens_read")).alias("cached_tokens_read"), F.when(cached, F.sum("cached_tokens_created")).alias("cached_tokens_created"),
        F.when(batch, F.sum("succeeded")).alias("succeeded"), F.when(batch, F.sum("errored")).alias("errored"),
        *([F.sum(f"cost.{c}").alias(f"{c}_cost") for c in ITEMS] if "cost" in usage.columns else []),
    )
    return t


def content_stats(items: DataFrame, text: str, *by: str) -> DataFrame:
    """Number of items, bytes, words and estimated tokens, and whether any item is to be cached if there is a column ``cache``."""
    t = items.withColumn("counts", token_counts(F.col(text)))
    cached = [F.coalesce(F.bool_or("cache"), F.lit(False)).alias("cache")] if "cache" in items.columns else []
    return t.groupBy(*by).agg(F.count("*").alias("items"), *cached, *[F.sum(f"counts.{c}").cast("long").alias(c) for c in ("num_bytes", "num_words", "num_special", "num_spaces", "tokens")])


def nearest_rank(rows: DataFrame, value: str, parts: dict[str, float], *by: str) -> DataFrame:
    """Percentiles as the value at position floor(n p), at most the last, of the sorted values.

    Equal values are counted first, then summed in two levels: inside ranges of
    values, and over the ranges, so no group's values meet in one task.
    """
    key = [F.col(c).alias(f"_by{i}") for i, c in enumerate(by)] or [F.lit(1).alias("_by0")]
    names = [f"_by{i}" for i in range(len(key))]
    counted = rows.filter(F.col(value).isNotNull()).groupBy(*key, F.col(value).alias("_value")).agg(F.count("*").alias("_n"))
    ranged = materialize(counted.repartitionByRange(*names, "_value").withColumn("_range", F.spark_partition_id()), "percentile-ranges")
    sums = ranged.groupBy(*names, "_range").agg(F.sum("_n").alias("_in_range"))
    whole = Window.partitionBy(*names)
    before = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*names, "_range", F.coalesce(F.sum("_in_range").over(before), F.lit(0)).alias("_before"), F.sum("_in_range").over(whole).alias("_all"))
    on = [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in [*names, "_range"]]
    joined = ranged.alias("r").join(sums.alias("s"), on).select(*[F.col(f"r.{c}") for c in [*names, "_range"]], "_value", "_n", "_before", "_all")
    end = F.sum("_n").over(Window.partitionBy(*names, "_range").orderBy("_value").rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.col("_before")
    placed = joined.withColumn("_end", end)
    at = lambda p: F.least(F.col("_all") - 1, F.floor(F.col("_all") * p))
    here = lambda p: (F.col("_end") > at(p)) & (F.col("_end") - F.col("_n") <= at(p))
    got = placed.groupBy(*names).agg(*[F.max(F.when(here(p), F.col("_value"))).alias(name) for name, p in parts.items()])
    return got.select(*[F.col(n).alias(c) for n, c in zip(names, by)], *parts)


def error_tally(errors: DataFrame, message: str, *by: str, chars: int = 140) -> DataFrame:
    return errors.groupBy(*by, F.substring(message, 1, chars).alias("message")).agg(F.count("*").alias("n"))


def largest(files: DataFrame, size: str, n: int = 10) -> DataFrame:
    return files.orderBy(F.desc(size)).limit(n)


def match_results(requests: DataFrame, results: DataFrame) -> DataFrame:
    """Batch results in request order; a request without a result gets an error row."""
    joined = requests.join(results.withColumn("_there", F.lit(True)), "request_id", "left")
    return joined.withColumn("status", F.when(F.col("_there").isNull(), "errored").otherwise(F.col("status"))).withColumn("error", F.when(F.col("_there").isNull(), "no result for this request").otherwise(F.col("error"))).drop("_there")


def outcomes(attempts: DataFrame, max_retries: int = 5) -> DataFrame:
    """Work items by what happens next: succeeded, retried or failed for good."""
    next_try = F.col("retries") + 1
    return attempts.withColumn("outcome", F.when(F.col("ok"), "succeeded").when(next_try >= max_retries, "failed").otherwise("retried")).withColumn("retries", F.when(F.col("ok"), F.col("retries")).otherwise(next_try))


def intents(labels: DataFrame, *by: str) -> DataFrame:
    """Distinct labels per group, GREETING first and the others sorted."""
    t = labels.groupBy(*by).agg(F.array_sort(F.collect_set("label")).alias("all"))
    rest = F.filter("all", lambda x: x != "GREETING")
    return t.select(*by, F.when(F.array_contains("all", "GREETING"), F.array_prepend(rest, F.lit("GREETING"))).otherwise(rest).alias("intents"))
