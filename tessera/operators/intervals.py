"""Joins of half-open intervals (structs ``start``, ``end``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import intersects


def overlap_join(left: DataFrame, right: DataFrame, a: str, b: str, *, cell: int = 1024) -> DataFrame:
    """Rows of both sides whose intervals ``a`` and ``b`` overlap, each pair once.

    Both sides are laid on cells of ``cell`` units and meet by cell; a pair counts in
    the cell where its later start lies, so no duplicates have to be removed. Cells
    should be about as long as the intervals. Null intervals overlap none.
    """
    on_cells = lambda df, c: df.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(f"{c}.start") / cell), F.floor(F.col(f"{c}.end") / cell))))
    first = F.greatest(F.col(f"{a}.start"), F.col(f"{b}.start"))
    met = on_cells(left, a).join(on_cells(right, b), "_cell")
    return met.filter(intersects(F.col(a), F.col(b)) & (F.floor(first / cell) == F.col("_cell"))).drop("_cell")
