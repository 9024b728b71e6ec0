"""Phrase collocations against counting every phrase."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import phrase_arrays

DOCS = "doc_id long, text string, lang string"
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def brute(rows, least=10, max_words=3, top=2000):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, max_words + 1):
                f.update((lang, tuple(words[i : i + m])) for i in range(len(words) - m + 1))
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = []
    for (lang, words), a in found.items():
        score, k = min((1_000_000 * a * a // (f[lang, words[:k]] * f[lang, words[k:]]), k) for k in range(1, len(words)))
        holds = lambda long: any(long[i : i + len(words)] == words for i in range(len(long) - len(words) + 1))
        if not any(g == lang and len(long) > len(words) and 100 * b >= 50 * a and holds(long) for (g, long), b in found.items()):
            out.append((lang, " ".join(words), a, f[lang, words[:k]], f[lang, words[k:]], n[lang], score))
    ranked = []
    for lang in {x[0] for x in out}:
        own = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[-1], -x[2], x[1].encode()))[:top]
        ranked += [(lang, i, *x[1:]) for i, x in enumerate(own, 1)]
    return sorted(ranked)


def check(spark, rows, **options):
    docs = spark.createDataFrame(rows, DOCS).withColumn("n", F.lit(1)).withColumn("phrase", F.lit("x")).withColumn("shard", F.lit(0)).repartition(3)
    got = sorted(map(tuple, phrase_arrays.mine(docs, **options).collect()))
    assert got == brute(rows, **options)
    return got


@pytest.fixture
def small_shards(monkeypatch):
    monkeypatch.setattr(phrase_arrays, "SHARD_TOKENS", 300)


def test_random_texts_over_many_shards(spark, small_shards):
    rng = random.Random(3)
    words = ["de", "La", "ÉTÉ", "été", "x", " ", "a b", "z\x1cz", "the", "\x00"]
    text = lambda: "".join(rng.choice(words) + rng.choice([" ", "  ", "\t", " ", ", ", "\n", "\x0b", "; ", "."]) for _ in range(rng.randrange(60)))
    rows = [(i, text(), rng.choice(["en", "fr", None, "und", ""])) for i in range(300)]
    assert len(check(spark, rows)) > 50


def test_overlaps_ties_and_covered_phrases(spark, small_shards):
    rows = [(i, "a a a a a. New York City! new york city; b c", "en") for i in range(9)] + [(None, "q r", "de")] * 20 + [(1, None, None), (2, "", "en"), (3, " \t. ,", "xx"), (4, "lone " * 9 + "x", "en")]
    rows += [(5, "word and other " * 4_000, "en")]
    got = {r[2]: r for r in check(spark, rows)}
    assert "new york city" in got and "new york" not in got and got["q r"][3:] == (20, 20, 20, 40, 1_000_000)


def test_other_lengths_and_limits(spark, small_shards):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("abcd") for _ in range(rng.randrange(30))), "en") for i in range(60)]
    check(spark, rows, max_words=5, least=4, top=17)
    check(spark, rows, max_words=2, least=30)


def test_empty_table(spark):
    assert phrase_arrays.mine(spark.createDataFrame([], DOCS)).collect() == []
    assert phrase_arrays.mine(spark.createDataFrame([(1, None, "en")], DOCS)).collect() == []


def test_suffix_array_orders_by_words():
    ids = np.array([1, 2, 1, 2, 1, 0, 2, 1, 2, 0, 3, 0], np.int32)
    starts, common = phrase_arrays.suffix_array(ids, 3)
    cut = lambda i: [*ids.tolist(), 0, 0, 0][i : i + 3]
    assert [cut(i) for i in starts] == sorted(cut(i) for i in np.flatnonzero(ids))
    counts = {(m, tuple(ids[s : s + m])): n for m, found, ns in phrase_arrays.phrases(ids, 3) for s, n in zip(found, ns)}
    assert counts[1, (1,)] == 4 and counts[2, (1, 2)] == 3 and counts[3, (2, 1, 2)] == 2
