"""Per-group vector analytics: first principal component and representative spans.

Groups are documents, sections or labels. ``pca`` folds each group's blocks of
ordered vectors, so a group may be of any size. ``spans`` gives each group to one
task, which holds the group's vectors but not their pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import discard, materialize

#: Vectors that are folded at once.
BLOCK_ROWS = 20_000
#: Rows that meet all others of a group at once, where the dissimilarity is not linear.
PAIR_ROWS = 256


def first_component(vectors: np.ndarray, stop: float = 0.01, centering: bool = True) -> np.ndarray:
    """First principal direction by an order-dependent running update; stops when it hardly turns."""
    axis = fold_component(vectors, None, stop, centering)[1]
    return np.zeros(vectors.shape[1]) if axis is None else axis


def _unit(v: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(v)
    return v / size if size > 0 else v


def fold_component(vectors: np.ndarray, state: tuple | None, stop: float = 0.01, centering: bool = True) -> tuple:
    """(mean, axis, count, stopped, turned) after ``vectors``, going on from the state that the vectors before them gave.

    The first vector is the first axis. Each further one, less the mean of those
    before it, pulls the axis by its projection over the count. Two turns in a row
    (one less the cosine of old and new axis) under ``stop`` end it.
    """
    mean, axis, n, stopped, turned = state or (np.zeros(vectors.shape[1]), None, 0, False, 1.0)
    for v in vectors.astype(float) if not stopped else ():
        n += 1
        if axis is None:
            mean, axis = (v.copy() if centering else mean), _unit(v)
            continue
        x = v - mean if centering else v
        if centering:
            mean = mean + x / n
        new = _unit(axis + x * (x @ axis) / n)
        before, turned = turned, 1 - abs(new @ axis)
        axis = new
        if turned < stop and before < stop:
            stopped = True
            break
    return mean, axis, n, stopped, turned


def weighted_set(query: np.ndarray, vectors: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The query and the vectors of positive weight, each scaled by its weight's root."""
    keep = weights > 0
    return np.vstack((query[None], vectors[keep] * np.sqrt(weights[keep])[:, None]))


def reconstruct(v: np.ndarray, axis: np.ndarray) -> np.ndarray:
    return axis * (v @ axis)


def representative(
    vectors: np.ndarray, target: np.ndarray | None, beta: float | np.ndarray = 0.0, iterations: int = 300, tolerance: float = 1e-5, support: float = 1e-4, *,
    edge=None, keeping: float = 0.0, relevance: np.ndarray | None = None, adaptive: str | None = None, min_log_gap: float = math.log(3),
) -> list[tuple[int, float]]:
    """(row, weight) of the vectors that stand for a set: replicator dynamics on relevance plus mutual dissimilarity.

    Relevance is twice the dot product with ``target`` unless given; rows at or under
    ``keeping`` take no part. ``beta`` (one number, or one per row) lowers the diagonal.
    ``edge`` maps similarities of a block of rows to dissimilarities of at least 0; the
    default max(0, 1 - s) needs memory in proportion to the rows while no similarity
    exceeds 1, since it is linear there, and blocks of rows otherwise. Rows stay whose
    weight is over ``support``, half the even share and the ``adaptive`` threshold
    (``entropy`` or ``log-ratio``).
    """
    rel = 2 * vectors @ target if relevance is None else np.asarray(relevance, float)
    kept = np.flatnonzero(rel > keeping)
    if not len(kept):
        return []
    v, rel, n = vectors[kept].astype(float), rel[kept], len(kept)
    betas = np.full(n, float(beta)) if np.isscalar(beta) else np.asarray(beta, float)[kept]
    kappa, squares = betas.max(), np.einsum("ij,ij->i", v, v)
    linear = edge is None and squares.max() <= 1 + 1e-9
    edge = edge or (lambda s: np.maximum(1 - s, 0))
    alpha = np.full(n, 1 / n)

    def pull(alpha: np.ndarray) -> np.ndarray:
        if linear:
            return alpha.sum() * (1 + kappa) - v @ (alpha @ v) - alpha * (1 - squares + betas)
        out = np.empty(n)
        for at in range(0, n, PAIR_ROWS):
            m = edge(v[at : at + PAIR_ROWS] @ v.T) + kappa
            rows = np.arange(len(m))
            m[rows, at + rows] = kappa - betas[at : at + PAIR_ROWS]
            out[at : at + PAIR_ROWS] = m @ alpha
        return out

    for _ in range(iterations):
        gain = alpha * (pull(alpha) + rel)
        if not gain.sum() > 0:
            break
        new = gain / gain.sum()
        moved = np.abs(new - alpha).max()
        alpha = new
        if moved < tolerance:
            break
    least = max(support, 0.5 / len(vectors), {"entropy": entropy_cut, "log-ratio": lambda a: gap_cut(a, min_log_gap)}.get(adaptive, lambda a: 0.0)(alpha))
    return [(int(i), float(a)) for i, a in zip(kept, alpha) if a > least]


def entropy_cut(alpha: np.ndarray) -> float:
    """The smallest of the first ceil(exp(entropy)) weights; 0 if none is positive."""
    a = np.sort(alpha[alpha > 0])[::-1]
    if not len(a):
        return 0.0
    p = a / a.sum()
    return float(a[min(len(a), max(1, math.ceil(math.exp(-(p * np.log(p)).sum())))) - 1])


def gap_cut(alpha: np.ndarray, min_log_gap: float = math.log(3), eps: float = 1e-10) -> float:
    """The weight before the largest log-ratio of neighbours if it reaches ``min_log_gap``, else the smallest positive one."""
    a = np.sort(alpha[alpha > eps])[::-1]
    if len(a) < 2:
        return float(a[0]) if len(a) else 0.0
    gaps = np.log(a[:-1] / a[1:])
    return float(a[gaps.argmax()] if gaps.max() >= min_log_gap else a[-1])


def pca(vectors: DataFrame, by: str, order: str, vec: str = "vec", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(by, component, consumed): the first principal direction of each group's vectors in ``order``, and how many it took.

    Rows are dealt into sorted ranges of about ``block_rows``. In turn k each group's k-th range is folded into its mean, axis and
    count; groups go side by side, and those that have stopped or ended don't go on.
    """
    kind, order_kind = (vectors.schema[c].dataType.simpleString() for c in (by, order))
    rows = vectors.select(F.col(by).alias("g"), F.col(order).alias("o"), F.col(vec).cast("array<double>").alias("v"))
    n = max(1, -(-rows.count() // block_rows))
    ranges = materialize(rows.repartitionByRange(n, "g", "o").withColumn("part", F.spark_partition_id()), "pca-ranges")
    ends = ranges.groupBy(F.col("g").alias("h")).agg(F.min("part").alias("first"), F.max("part").alias("end"))
    turns = ranges.join(ends, ranges["g"].eqNullSafe(ends["h"])).select("g", "o", "v", (F.col("part") - F.col("first")).alias("turn"), (F.col("end") - F.col("first")).alias("last"))
    turns = materialize(turns, "pca-turns", by="turn")  # a turn reads its own rows only
    discard(ranges)
    shape = f"g {kind}, last int, n long, stopped boolean, turned double, mean array<double>, axis array<double>"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        before, new = pdf[pdf["n"].notna()], pdf[pdf["n"].isna()].sort_values("o")
        state = None
        if len(before):
            b = before.iloc[0]
            state = (np.array(b["mean"], float), None if b["axis"] is None else np.array(b["axis"], float), int(b["n"]), False, float(b["turned"]))
        if len(new):
            state = fold_component(np.stack(new["v"].to_numpy()).astype(float), state)
        mean, axis, count, stopped, turned = state
        return pd.DataFrame({"g": [pdf["g"].iloc[0]], "last": [pdf["last"].iloc[0]], "n": [count], "stopped": [stopped], "turned": [turned], "mean": [mean.tolist()], "axis": [None if axis is None else axis.tolist()]})

    none = [F.lit(None).cast(t).alias(c) for c, t in (("n", "long"), ("stopped", "boolean"), ("turned", "double"), ("mean", "array<double>"), ("axis", "array<double>"))]
    blank = [F.lit(None).cast(order_kind).alias("o"), F.lit(None).cast("array<double>").alias("v")]
    live, done, turn = None, None, 0
    while turn == 0 or not live.isEmpty():
        block = turns.filter(F.col("turn") == turn)
        if live is not None:
            going = live.select(F.col("g").alias("h")).distinct()
            block = block.join(going, block["g"].eqNullSafe(going["h"]), "left_semi")
        work = block.select("g", "last", "o", "v", *none)
        if live is not None:
            work = work.unionByName(live.select("g", "last", *blank, "n", "stopped", "turned", "mean", "axis"))
        state = materialize(work.groupBy("g").applyInPandas(run, shape), "pca-state")
        over = F.col("stopped") | (F.col("last") <= turn)
        ended, live = state.filter(over), state.filter(~over)
        done = ended if done is None else done.unionByName(ended)
        turn += 1
    discard(turns)
    return done.select(F.col("g").alias(by), F.coalesce("axis", F.transform("mean", lambda x: F.lit(0.0))).alias("component"), F.col("n").alias("consumed"))


def spans(vectors: DataFrame, by: str, order: str, vec: str = "vec", beta: float = 0.0, adaptive: str | None = None) -> DataFrame:
    """(by, order, weight): each group's representative vectors around its mean."""
    kinds = {c: vectors.schema[c].dataType.simpleString() for c in (by, order)}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        m = np.stack(pdf[vec].to_numpy()).astype(float)
        got = representative(m, m.mean(axis=0), beta, adaptive=adaptive)
        return pd.DataFrame({by: pdf[by].iloc[0], order: pdf[order].to_numpy()[[i for i, _ in got]], "weight": [w for _, w in got]})

    return vectors.select(by, order, vec).groupBy(by).applyInPandas(run, f"{by} {kinds[by]}, {order} {kinds[order]}, weight double")


def entropy_threshold(alpha: Column) -> Column:
    """The weight at the perplexity cut of an array of weights (sorted here); null if none is positive."""
    a = F.filter(F.reverse(F.array_sort(alpha)), lambda x: x > 0)
    s = F.aggregate(a, F.lit(0.0), lambda t, x: t + x)
    h = F.aggregate(a, F.lit(0.0), lambda t, x: t - x / s * F.log(x / s))
    k = F.least(F.greatest(F.ceil(F.exp(h)).cast("int"), F.lit(1)), F.size(a))
    return F.try_element_at(a, F.when(F.size(a) > 0, k))


def gap_threshold(alpha: Column, min_gap: float = 3.0, eps: float = 1e-10) -> Column:
    """The weight before the largest ratio of neighbours if it reaches ``min_gap``, else the smallest positive one."""
    a = F.filter(F.reverse(F.array_sort(alpha)), lambda x: x > eps)
    n = F.size(a)
    gaps = F.zip_with(F.slice(a, 1, F.greatest(n - 1, F.lit(0))), F.slice(a, 2, F.greatest(n - 1, F.lit(0))), lambda x, y: x / y)
    top = F.array_max(gaps)
    return F.when((n > 1) & (top >= min_gap), F.try_element_at(a, F.array_position(gaps, top).cast("int"))).otherwise(F.try_element_at(a, F.when(n > 0, n)))
