"""The vector store as a table: build, append, remove, describe."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

VECTORS = "document_id string, doc_ord int, section_idx int, range_start int, range_end int, vec_idx int, vec array<float>"
SPEC = "document_id string, vec_dim int, sections array<struct<start:int,end:int,vectors:array<array<float>>>>"


def create(spark: SparkSession) -> DataFrame:
    """An empty store."""
    return spark.createDataFrame([], VECTORS)


clear = create


def from_spec(specs: DataFrame) -> DataFrame:
    """Rows of ``SPEC`` (and ``doc_ord``) as vectors; every vector must have the document's dimension."""
    sections = specs.select("document_id", "doc_ord", "vec_dim", F.posexplode("sections").alias("section_idx", "s"))
    rows = sections.select("document_id", "doc_ord", "section_idx", F.col("s.start").alias("range_start"), F.col("s.end").alias("range_end"), "vec_dim", F.posexplode("s.vectors").alias("vec_idx", "vec"))
    fits = F.size("vec") == F.col("vec_dim")
    return rows.withColumn("vec", F.when(fits, F.col("vec")).otherwise(F.raise_error(F.lit("a vector has another dimension than its document")))).drop("vec_dim")


def from_texts(texts: DataFrame, encode: Callable[[pd.Series], pd.Series]) -> DataFrame:
    """One section per document from (document_id, doc_ord, texts); empty texts are left out. ``encode`` maps a Series of texts to vectors."""
    encoder = F.pandas_udf(encode, "array<float>")
    one = texts.select("document_id", "doc_ord", F.posexplode(F.filter("texts", lambda t: t.isNotNull() & (t != ""))).alias("vec_idx", "text"))
    return one.select("document_id", "doc_ord", F.lit(0).alias("section_idx"), F.lit(0).alias("range_start"), F.lit(0).alias("range_end"), "vec_idx", encoder("text").alias("vec"))


def append(store: DataFrame, *more: DataFrame) -> DataFrame:
    """Stores one after another; a document may be there twice, so doc_ord goes on behind the last."""
    for new in more:
        last = store.agg(F.coalesce(F.max("doc_ord") + 1, F.lit(0)).alias("shift"))
        store = store.unionByName(new.crossJoin(F.broadcast(last)).withColumn("doc_ord", F.col("doc_ord") + F.col("shift")).drop("shift"))  # one row
    return store


def remove(store: DataFrame, ids: DataFrame, key: str = "document_id") -> DataFrame:
    return store.join(ids.select(key).distinct(), key, "left_anti")


def missing(store: DataFrame, ids: DataFrame, key: str = "document_id") -> DataFrame:
    """Ids that the store doesn't have."""
    return ids.select(key).distinct().join(store, key, "left_anti")


def section(store: DataFrame, document_id: str, idx: int) -> DataFrame:
    return store.filter((F.col("document_id") == document_id) & (F.col("section_idx") == idx)).orderBy("vec_idx")


def vec_offsets(store: DataFrame) -> DataFrame:
    """Per section: its number of vectors and the vectors of its document before it."""
    per = store.groupBy("document_id", "doc_ord", "section_idx").agg(F.count("*").alias("vec_count"))
    before = Window.partitionBy("document_id", "doc_ord").orderBy("section_idx").rowsBetween(Window.unboundedPreceding, -1)
    return per.withColumn("vec_offset", F.coalesce(F.sum("vec_count").over(before), F.lit(0)))


def dimension(store: DataFrame) -> DataFrame:
    """One row: the dimension, and whether it is one for all vectors."""
    return store.agg(F.max(F.size("vec")).alias("vec_dim"), (F.min(F.size("vec")) == F.max(F.size("vec"))).alias("uniform"))


def collisions(new: DataFrame, known: DataFrame | None = None, key: str = "document_id") -> DataFrame:
    """Ids that are there more than once among ``new``, or in ``known`` too."""
    twice = new.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").select(key)
    if known is None:
        return twice
    return twice.union(new.select(key).join(known.select(key), key, "left_semi")).distinct()


def add_sources(sources: DataFrame, new: DataFrame) -> DataFrame:
    """``sources(document_id, path, content)`` with more rows; fails, adding nothing, if an id collides."""
    found = [r[0] for r in collisions(new, sources).limit(5).collect()]
    if found:
        raise ValueError(f"document ids collide: {', '.join(map(str, found))}")
    return sources.unionByName(new)


def hit_key(prefix: str = "") -> Column:
    return F.struct(*[F.col(f"{prefix}{c}") for c in ("document_id", "range_start", "range_end")])
