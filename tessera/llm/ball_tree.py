"""Exact top-k inner products by ball-tree branch and bound per shard.

Vectors (components floor(256 x)) are dealt by id to shards of about
``shard_rows`` rows. Each shard builds a ball tree; a node's bound for a query q
is q.c + |q| r (centre c, radius r), and children are visited in the order of
their bounds. Queries are a stated set; they travel in blocks of ``block_rows``,
and every block meets every shard as one row: no pair of vectors is ever emitted
but a shard's k best for a query. Scores are 64-bit integers: vectors
whose largest scaled component times the root of their length reaches 2^31 could
overflow them and are refused. Two rounds share the current kth score: in the
first, each query looks into its best leaf of every shard, and the kth best of
these scores prunes the second, full search in all shards. A node is left out
only if its bound is below that score, so ties survive.

Vectors that are null or hold a null or non-finite component take no part.
Vectors are compared with vectors of their own length only; the empty vector's
products are 0. Rows that repeat an id are candidates each; for an id that
repeats among the queries its smallest vector asks, and a query skips every row
of its own id. Null ids are no queries and no candidates. Empty tables give empty
results; other columns are ignored.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

LEAF = 256
SHARD_ROWS, BLOCK_ROWS = 8192, 1024


def _pack(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _unpack(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as f:
        return {k: f[k] for k in f.files}


def build(ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF) -> dict[str, np.ndarray]:
    """Arrays of a ball tree: rows in leaf order, and per node its bounds, row range and children (-1: leaf)."""
    order = np.argsort(ids, kind="stable")
    real = vectors.astype(np.float64)
    nodes: list[list] = []

    leaves: list[np.ndarray] = []
    # a stack, not recursion: degenerate data make deep trees
    open_nodes = [(order, 0, -1, 4)]
    while open_nodes:
        rows, at, parent, side_of = open_nodes.pop()
        me, points = len(nodes), real[rows]
        if parent >= 0:
            nodes[parent][side_of] = me
        centre = points.mean(axis=0)
        away = np.sqrt(((points - centre) ** 2).sum(axis=1))
        nodes.append([centre, away.max(initial=0.0), at, at + len(rows), -1, -1])
        if len(rows) > leaf and away.max() > 0:
            a = points[away.argmax()]
            b = points[((points - a) ** 2).sum(axis=1).argmax()]
            side = (points - (a + b) / 2) @ (b - a) > 0
            if side.any() and not side.all():
                left, right = rows[~side], rows[side]
                open_nodes += [(right, at + len(left), me, 5), (left, at, me, 4)]
                continue
        leaves.append(rows)
    order = np.concatenate(leaves)
    centre, radius, start, end, left, right = zip(*nodes)
    return {"ids": ids[order], "vectors": vectors[order], "centre": np.array(centre), "radius": np.array(radius), "start": np.array(start), "end": np.array(end), "left": np.array(left), "right": np.array(right)}


def search(tree: dict[str, np.ndarray], q_ids: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int, one_leaf: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vec id, score) of each query's k best rows of the tree that reach ``floor``; ``one_leaf``: in its best leaf only."""
    none = np.iinfo(np.int64).min
    scores, ids = np.full((len(q), k), none), np.full((len(q), k), np.iinfo(np.int64).max)
    real, norm = q.astype(np.float64), np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
    reach = np.abs(tree["centre"]).sum(axis=1) + 1
    rows_of, there = tree["vectors"], tree["ids"]
    # exact in floating point while every sum stays below 2**53
    most = float(np.abs(q).max(initial=0)) * float(np.abs(rows_of).max(initial=0)) * max(1, q.shape[1])
    left_hand, right_hand = (real, rows_of.astype(np.float64)) if most < 1 << 53 else (q, rows_of)

    def bound(node: int, rows: np.ndarray) -> np.ndarray:
        up = real[rows] @ tree["centre"][node] + norm[rows] * tree["radius"][node]
        return up + 1e-9 * (np.abs(up) + norm[rows] * reach[node]) + 1e-6

    def look(node: int, rows: np.ndarray) -> None:
        part = slice(tree["start"][node], tree["end"][node])
        found = left_hand[rows] @ right_hand[part].T
        good = found >= np.maximum(floor[rows], scores[rows, -1])[:, None]
        good &= there[part] != q_ids[rows, None]
        row, col = np.nonzero(good)
        if not len(row):
            return
        hit, row = np.unique(row, return_inverse=True)
        rows = rows[hit]
        # the old best and the new rows of each query, best score and then smallest id first
        own = np.concatenate((np.repeat(np.arange(len(rows)), k), row))
        score = np.concatenate((scores[rows].ravel(), found[hit[row], col].astype(np.int64)))
        vec = np.concatenate((ids[rows].ravel(), there[part][col]))
        order = np.lexsort((vec, ~score, own))  # ~x falls as x rises, without overflow
        own, score, vec = own[order], score[order], vec[order]
        nth = np.arange(len(own)) - np.searchsorted(own, np.arange(len(rows)))[own]
        top = nth < k
        scores[rows], ids[rows] = score[top].reshape(-1, k), vec[top].reshape(-1, k)

    everyone = np.arange(len(q))
    open_nodes = [(0, everyone, bound(0, everyone))]
    while open_nodes:
        node, rows, up = open_nodes.pop()
        if not one_leaf:  # the kth score may have risen since the bound was taken
            rows = rows[up >= np.maximum(floor[rows], scores[rows, -1]).astype(np.float64)]
        if not len(rows):
            continue
        left, right = tree["left"][node], tree["right"][node]
        if left < 0:
            look(node, rows)
            continue
        a, b = bound(left, rows), bound(right, rows)
        lefts = a >= b  # each query goes first where its bound is higher
        if not one_leaf:
            open_nodes += [(left, rows[~lefts], a[~lefts]), (right, rows[lefts], b[lefts])]
        open_nodes += [(right, rows[~lefts], b[~lefts]), (left, rows[lefts], a[lefts])]
    row, nth = np.nonzero(scores != none)
    return row, ids[row, nth], scores[row, nth]


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) per component as long; null unless every component is a finite number."""
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    too_large = F.exists(vector, lambda x: F.abs(x.cast("double") * scale) * F.sqrt(F.size(vector)) >= 1 << 31)
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return F.when(finite, F.when(too_large, F.raise_error(F.lit("a component is too large for 64-bit scores")).cast("array<bigint>")).otherwise(whole))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.int64).reshape(len(column), -1)


def _trees(pdf: pd.DataFrame) -> pd.DataFrame:
    tree = build(pdf["vec_id"].to_numpy(np.int64), _matrix(pdf["ints"]))
    return pd.DataFrame({"dim": [pdf["dim"].iloc[0]], "shard": [pdf["shard"].iloc[0]], "tree": [_pack(**tree)]})


def _blocks(pdf: pd.DataFrame) -> pd.DataFrame:
    data = _pack(ids=pdf["vec_id"].to_numpy(np.int64), vectors=_matrix(pdf["ints"]), floor=pdf["floor"].to_numpy(np.int64))
    return pd.DataFrame({"dim": [pdf["dim"].iloc[0]], "block": [pdf["block"].iloc[0]], "queries": [data]})


def _search_rows(k: int, one_leaf: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for tree, block in zip(pdf["tree"], pdf["queries"]):
                b = _unpack(block)
                row, vec_id, score = search(_unpack(tree), b["ids"], b["vectors"], b["floor"], k, one_leaf)
                yield pd.DataFrame({"query_id": b["ids"][row], "vec_id": vec_id, "score": score})

    return run


def top_k(vectors: DataFrame, queries: Column, *, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows that the condition ``queries`` on ``vectors`` holds for."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), quantised(F.col(vector_col), scale).alias("ints"), F.coalesce(queries, F.lit(False)).alias("asks"))
    rows = rows.filter("vec_id is not null and ints is not null").withColumn("dim", F.size("ints"))
    counted = rows.agg(F.count("*").alias("n"), F.count_if("asks").alias("asked")).first()
    n_shards, n_blocks = -(-counted["n"] // shard_rows) or 1, -(-counted["asked"] // block_rows) or 1
    deal = F.xxhash64("vec_id")
    tree_rows = rows.withColumn("shard", F.pmod(deal, F.lit(n_shards)).cast("int")).select("dim", "shard", "vec_id", "ints")
    trees = cut(tree_rows.groupBy("dim", "shard").applyInPandas(_trees, "dim int, shard int, tree binary"), "ball-trees")
    asked = rows.filter("asks").groupBy("vec_id").agg(F.min(F.struct("dim", "ints")).alias("one")).select("vec_id", "one.*")
    asked = asked.withColumn("block", F.pmod(F.shiftright(deal, 7), F.lit(n_blocks)).cast("int"))

    def each_shard(floors: Column, source: DataFrame, one_leaf: bool) -> DataFrame:
        blocks = source.withColumn("floor", floors).groupBy("dim", "block").applyInPandas(_blocks, "dim int, block int, queries binary")
        blocks = blocks.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))))
        # a task reads its shards' trees once; the blocks of queries come to them
        met = blocks.join(trees.hint("merge"), ["dim", "shard"]).select("tree", "queries")
        return met.mapInPandas(_search_rows(k, one_leaf), "query_id long, vec_id long, score long")

    lowest = F.lit(np.iinfo(np.int64).min + 1).cast("long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    seen = each_shard(lowest, asked, True).withColumn("nth", F.row_number().over(best)).filter(F.col("nth") == k)
    asked = asked.join(seen.select(F.col("query_id").alias("vec_id"), F.col("score").alias("kth")), "vec_id", "left")
    found = each_shard(F.coalesce("kth", lowest), asked, False)
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
