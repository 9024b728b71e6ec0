"""A training-corpus pipeline: five stages, each on what the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, written as
Parquet and read again as the next stage's ``docs``. All but the last return the
columns of ``documents``. Nulls, empty texts, repeats and extra columns are
handled as each operator's docstring says; the quality stage keeps rows without
an id, and line dedup drops only documents whose every line with words went.

A stage's intermediate tables are deleted when the next stage begins, since its
result is written by then; tables that the next stage's ``docs`` still read stay.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import byte_cnn, line_dedup, piece_dropout, simhash, source_mix
from tessera.llm import common
from tessera.llm.common import cut, discard, table


#: Folders that stages have written and that are still there.
_left: list[str] = []


def _sweep(docs: DataFrame) -> None:
    """Deletes what earlier stages have left, but for what ``docs`` reads."""
    read = docs.inputFiles() if _left else []
    for path in list(_left):
        name = path.rpartition("/")[2]
        if not any(name in file for file in read):
            _left.remove(path)
            common.delete_written(docs.sparkSession, path)


def _stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    @functools.wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _sweep(docs)
        before = set(common.WRITTEN)
        out = f(spark, docs, sf_dir)
        _left.extend(path for path in common.WRITTEN if path not in before)
        return out

    return run


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte-level network rejects go."""
    return byte_cnn.keep_good(docs, byte_cnn.train(docs, table(spark, sf_dir, "labels")))


@_stage
def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier line go; n_chars follows the text."""
    return with_n_chars(line_dedup.without_emptied(docs))


@_stage
def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return simhash.keep_one(docs)


@_stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return source_mix.emit_mix(docs)


@_stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, checked to decode to the text."""
    return piece_dropout.encode_documents(docs)


def with_n_chars(docs: DataFrame) -> DataFrame:
    from pyspark.sql import functions as F

    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


STAGES = [
    ("quality classifier", quality),
    ("line dedup", dedup_lines),
    ("SimHash near-dedup", dedup_documents),
    ("mixing sources to target weights", mix),
    ("SentencePiece encoding", encode),
]

#: A network, a similarity join and merge-dropout have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            discard(before)
        before = docs
    _sweep(docs)
    return docs
