"""Text encoders. The hashing encoder is deterministic and needs no model; others plug in as Series functions."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import plain_text

WORD = re.compile(r"[^\W_]+")


def hash_vector(text: str | None, dim: int = 64) -> list[float]:
    """Signed counts of hashed words and word pairs, scaled to unit length."""
    words = WORD.findall((text or "").lower())
    v = np.zeros(dim)
    for term in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))]:
        h = zlib.crc32(term.encode())
        v[h % dim] += 1 if h >> 16 & 1 else -1
    size = np.linalg.norm(v)
    return (v / size if size else v).astype(np.float32).tolist()


def hashing_encoder(text: Column, dim: int = 64) -> Column:
    @F.pandas_udf("array<float>")
    def encode(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: hash_vector(t, dim))

    return encode(text)


def model_encoder(text: Column, load: Callable[[], Callable[[list[str]], list[list[float]]]], *, normalize_text: bool | Callable[[Column], Column] = False) -> Column:
    """``load`` runs once per task; texts go to the model in batches, null ones as empty.

    ``normalize_text`` is a column function, or true for ``plain_text``.
    """
    if normalize_text:
        text = (plain_text if normalize_text is True else normalize_text)(F.coalesce(text, F.lit("")))

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            yield pd.Series(model(texts.fillna("").tolist()))

    return encode(text)


def model_texts(load: Callable[[], Callable[[list[str]], list[str]]]) -> Callable[[Column], Column]:
    """A text-to-text model (answers, summaries, synthesis) as a column function."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            yield pd.Series(model(texts.fillna("").tolist()))

    return run
