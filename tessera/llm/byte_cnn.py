"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded (8 numbers each), filters slide over windows of 6 bytes every
3 bytes, and responses (ReLU) are max-pooled over overlapping chunks of 128
windows that start every 96: the chunks cover the whole text. The mean and the
maximum of the chunks' pooled responses enter one logistic unit.

The network is fitted on the driver by Adam on a bounded sample of labelled rows:
``sample_rows`` documents at most, as many of either label as there are, each of
at most ``sample_bytes`` characters, chosen by a hash of their id among rows whose
crc32(id as text) mod 5 isn't 0. The intercept is then set for the labels' share
in all rows that may be learned from. Scoring reads nothing but the text.

Nulls: a null text scores like an empty one, and empty texts get a score from 0
to 1 like any other. Labels that are null or contradict each other for one id are
not learned from; without rows of both labels every score is the share of label 1
(0.5 without labels). Rows with a null id are scored; they count as not held out.
Repeated rows get equal scores. Very long texts are scored whole, in bounded
pieces. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

EMBED, WIDTH, STRIDE, FILTERS = 8, 6, 3, 24
BLOCK, CHUNK, HOP = 32, 4, 3
SAMPLE_ROWS, SAMPLE_BYTES, EPOCHS, LEAST_STEPS, BATCH, RATE = 2000, 30_000, 6, 600, 16, 0.004
#: Windows convolved at once: bounds memory for very long texts.
PIECE = 1 << 14
CUT = 0.3


@dataclass
class Net:
    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    mean_w: np.ndarray
    max_w: np.ndarray
    out: np.ndarray


def _new(seed: int) -> Net:
    r = np.random.default_rng(seed)
    f = lambda *shape: (r.standard_normal(shape) * 0.3).astype(np.float32)
    return Net(f(256, EMBED), f(WIDTH * EMBED, FILTERS) * 0.5, np.zeros(FILTERS, np.float32), np.zeros(FILTERS, np.float32), np.zeros(FILTERS, np.float32), np.zeros(1, np.float32))


def windows_of(text: str | None) -> np.ndarray:
    """Bytes of all windows (n, WIDTH); zeros fill the last one."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    n = max(1, -(-max(0, len(raw) - WIDTH) // STRIDE) + 1)
    raw = np.concatenate((raw, np.zeros(max(0, (n - 1) * STRIDE + WIDTH - len(raw)), np.uint8)))
    return np.lib.stride_tricks.sliding_window_view(raw, WIDTH)[::STRIDE]


def chunk_starts(blocks: int) -> np.ndarray:
    """First blocks of the overlapping chunks; the last chunk may be short."""
    return np.arange(0, max(1, blocks - (CHUNK - HOP)), HOP)


def _responses(net: Net, windows: np.ndarray) -> np.ndarray:
    return net.embed[windows].reshape(len(windows), -1) @ net.filters + net.bias


def block_maxima(net: Net, windows: np.ndarray) -> np.ndarray:
    parts = []
    for at in range(0, len(windows), PIECE):
        r = _responses(net, windows[at : at + PIECE])
        parts.append(np.maximum.reduceat(r, np.arange(0, len(r), BLOCK), axis=0))
    return np.maximum(np.concatenate(parts), 0)


def chunk_maxima(blocks: np.ndarray) -> np.ndarray:
    starts = chunk_starts(len(blocks))
    padded = np.concatenate((blocks, np.zeros((CHUNK, blocks.shape[1]), blocks.dtype)))
    return np.max([padded[starts + i] for i in range(CHUNK)], axis=0)


def logit(net: Net, text: str | None) -> float:
    chunks = chunk_maxima(block_maxima(net, windows_of(text)))
    return float(chunks.mean(axis=0) @ net.mean_w + chunks.max(axis=0) @ net.max_w + net.out[0])


def _gradient(net: Net, windows: np.ndarray, label: int, g: Net) -> None:
    """Adds one document's gradient of the log loss to ``g``."""
    r = _responses(net, windows)
    blocks = -(-len(r) // BLOCK)
    starts = chunk_starts(blocks)
    lows, highs = starts * BLOCK, np.minimum((starts + CHUNK) * BLOCK, len(r))
    at = np.array([lo + r[lo:hi].argmax(axis=0) for lo, hi in zip(lows, highs)])  # (chunks, filters)
    cols = np.arange(FILTERS)
    top = np.maximum(r[at, cols], 0)
    best = top.argmax(axis=0)
    p = 1 / (1 + np.exp(-np.clip(top.mean(axis=0) @ net.mean_w + top[best, cols] @ net.max_w + net.out[0], -30, 30)))
    d = np.float32(p - label)
    g.mean_w += d * top.mean(axis=0)
    g.max_w += d * top[best, cols]
    g.out += d
    back = np.repeat((d * net.mean_w / len(top))[None], len(top), axis=0)
    back[best, cols] += d * net.max_w
    back = np.where(top > 0, back, 0).astype(np.float32)
    rows, inverse = np.unique(at.ravel(), return_inverse=True)
    dr = np.zeros((len(rows), FILTERS), np.float32)
    np.add.at(dr, (inverse, np.tile(cols, len(top))), back.ravel())
    seen = windows[rows]
    x = net.embed[seen].reshape(len(rows), -1)
    g.filters += x.T @ dr
    g.bias += dr.sum(axis=0)
    np.add.at(g.embed, seen.ravel(), (dr @ net.filters.T).reshape(-1, EMBED))


def fit(texts: list[str], labels: list[int], seed: int = 0) -> Net:
    epochs = max(EPOCHS, -(-LEAST_STEPS * BATCH // len(texts)))
    net = _new(seed)
    names = list(vars(net))
    m = {k: np.zeros_like(getattr(net, k)) for k in names}
    v = {k: np.zeros_like(getattr(net, k)) for k in names}
    windows, random, step = [windows_of(t) for t in texts], np.random.default_rng(seed), 0
    for epoch in range(epochs):
        order = random.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            batch = order[at : at + BATCH]
            g = Net(**{k: np.zeros_like(getattr(net, k)) for k in names})
            for i in batch:
                _gradient(net, windows[i], labels[i], g)
            step += 1
            rate = RATE * (1 - epoch / epochs)
            for k in names:
                d = getattr(g, k) / len(batch) + 1e-4 * getattr(net, k)
                m[k] = 0.9 * m[k] + 0.1 * d
                v[k] = 0.99 * v[k] + 0.01 * d * d
                setattr(net, k, (getattr(net, k) - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32))
    return net


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES, seed: int = 0) -> Net:
    """Fits the network on a bounded sample of the rows that aren't held out."""
    usable = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).filter("id is not null and label in (0, 1)").filter(~held_out(F.col("id")))
    usable = usable.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("most")).filter("label = most").select("id", "label")
    share = usable.agg(F.count("*").alias("n"), F.sum("label").alias("ones")).first()
    net = _new(seed)
    if not share["n"]:
        return net
    if share["ones"] in (0, share["n"]):
        net.out[:] = 30.0 if share["ones"] else -30.0
        return net
    short = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter(F.length("text") <= sample_bytes)
    rows = []
    for label in (0, 1):
        chosen = usable.filter(F.col("label") == label).orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample_rows // 2)
        found = short.join(F.broadcast(chosen), "id")  # at most sample_rows / 2 ids
        rows += found.groupBy("id", "label").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: (r["id"], r["label"]))
    texts, marks = [r["text"] for r in rows], [r["label"] for r in rows]
    if len(set(marks)) < 2:
        p = share["ones"] / share["n"]
        net.out[:] = np.log(p / (1 - p))
        return net
    net = fit(texts, marks, seed)
    odds = np.log(share["ones"] / (share["n"] - share["ones"])) - np.log(sum(marks) / (len(marks) - sum(marks)))
    net.out += np.float32(odds)
    return net


def score_column(text: Column, net: Net) -> Column:
    """Probability of label 1 for the whole text."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([1 / (1 + np.exp(-np.clip(logit(net, t), -30.0, 30.0))) for t in texts], dtype=float)

    return score(text)


def score_documents(docs: DataFrame, net: Net, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    scored = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), score_column(F.col(text_col), net).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= CUT, 1).otherwise(0))


def keep_good(docs: DataFrame, net: Net, *, text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that the classifier rejects."""
    score = fresh(docs, "quality_score")
    return docs.withColumn(score, score_column(F.col(text_col), net)).filter(F.col(score) >= CUT).drop(score)
