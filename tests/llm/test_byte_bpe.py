"""Merge replay against tiktoken."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tessera.llm import merge_replay, queries

DOCS = "doc_id long, text string"


@pytest.fixture(scope="module")
def ranks():
    return merge_replay.load_ranks()


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=ranks.pattern, mergeable_ranks=ranks.tokens, special_tokens={})


def texts():
    rng = random.Random(1)
    some = ["", " ", "a", "aaaa" * 999, "ab" * 5_000, "=" * 3_001, " \n" * 700, "the " * 2_000, "été l'œuvre 日本語 🙂🙂 it's WE'LL", "\x00\x1c x  y", "1234567890" * 300, "<|endoftext|> x", "internationalization" * 400]
    letters = "aaabcdeeinorst  theing'\n\t.,=-0159éßщ日🙂"
    some += ["".join(rng.choice(letters) for _ in range(rng.randrange(200))) for _ in range(400)]
    return some + ["".join(rng.choice("abcdehinotu") for _ in range(rng.randrange(1, 300))) for _ in range(400)]


def test_ids_equal_the_library(ranks, library):
    encoder = merge_replay.Encoder(ranks)
    got = [merge_replay.unpacked(x) for x in encoder.encode_all(texts())]
    assert got == [library.encode_ordinary(t) for t in texts()]
    assert encoder.encode_all(texts()[::-1])[::-1] == encoder.encode_all(texts())


def test_a_merge_that_makes_a_lower_rank(library):
    """Ranks in an order that no training gives: what a merge makes often goes before it."""
    rng = random.Random(2)
    for _ in range(60):
        tokens = {bytes([b]): b for b in range(256)}
        others = sorted({bytes(rng.choice(b"abc") for _ in range(rng.randrange(2, 6))) for _ in range(40)})
        rng.shuffle(others)
        tokens |= {t: 256 + i for i, t in enumerate(others)}
        own = merge_replay.ranks_of(tokens, r"\w+|\W")
        by_library = tiktoken.Encoding("own", pat_str=own.pattern, mergeable_ranks=tokens, special_tokens={})
        words = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 40))) for _ in range(30)] + ["abcab" * 500]
        assert [merge_replay.unpacked(x) for x in merge_replay.Encoder(own).encode_all(words)] == [by_library.encode_ordinary(w) for w in words]


def test_what_is_kept_is_bounded(ranks, library, monkeypatch):
    monkeypatch.setattr(merge_replay, "KEPT_CHARS", 100)
    encoder = merge_replay.Encoder(ranks)
    for t in texts()[:60]:
        assert merge_replay.unpacked(encoder.encode_all([t])[0]) == library.encode_ordinary(t)
        assert len(encoder.known) <= 4_000


def test_documents(spark, library, monkeypatch, tmp_path):
    monkeypatch.setattr(merge_replay, "RUN_CHARS", 500)
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "no id"), (7, None), (3, "aaaa" * 999)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("ids", F.lit(0)).withColumn("n_tokens", F.lit("x"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_byte_bpe(spark, str(tmp_path)).collect()
    sha = lambda x: hashlib.sha256(x).hexdigest()
    want = []
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha((t or "").encode())))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert merge_replay.encode_documents(docs.limit(0)).collect() == []
