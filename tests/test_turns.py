"""Turns of mixed sources and their runs, against loops."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import turns


def test_mixed_sources(spark):
    rows = [
        (1, 0, 0, "text", None, "Summarize"), (1, 0, 1, "document", None, "doc a"), (1, 0, 2, "document", "x", "doc b"), (1, 1, 0, "response", None, "Sure"), (1, 2, 0, "turn", "user", "More"), (1, 2, 1, "turn", "assistant", "Yes"),
        (2, 0, 0, "turn", "system", "Be brief"), (2, 0, 1, "turn", None, "no role"), (2, 0, 2, "odd", "user", "unknown"), (2, 1, 0, "text", None, ""), (2, 2, 0, "document", None, "only a document"), (2, 3, 0, "response", None, None),
        (None, 0, 0, "text", None, "no conversation"), (3, None, None, "response", "ignored", "early"), (3, 0, 0, "text", None, "later"), (3, 1, 0, "turn", "user", "a"), (3, 1, 0, "turn", "user", "a"),
    ]
    got = turns.numbered(turns.normalize(spark.createDataFrame(rows, turns.SOURCE).withColumn("documents", F.lit(1)))).collect()
    by = {}
    for r in sorted(got, key=lambda r: r["turn"]):
        by.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["content"], r["documents"]))
    assert by == {
        1: [(0, "user", "Summarize", ["doc a", "doc b"]), (1, "assistant", "Sure", []), (2, "user", "More", []), (3, "assistant", "Yes", [])],
        2: [(0, "system", "Be brief", []), (1, "user", "only a document", [])],
        None: [(0, "user", "no conversation", [])],
        3: [(0, "assistant", "early", []), (1, "user", "later", []), (2, "user", "a", []), (3, "user", "a", [])],
    }
    assert turns.normalize(spark.createDataFrame([], turns.SOURCE)).count() == 0


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_runs_match_a_loop(spark, monkeypatch, block):
    monkeypatch.setattr(turns, "BLOCK", block)
    r = random.Random(block)
    rows = [(c, t, r.choice(["user", "user", "assistant", None]), "x" * r.randrange(5)) for c in (1, 2, None) for t in range(r.randrange(1, 60)) if r.random() < 0.9]
    want = []
    for c, own in itertools.groupby(rows, key=lambda x: x[0]):
        for n, (role, held) in enumerate(itertools.groupby(own, key=lambda x: x[2] or "")):
            held = list(held)
            want.append((c, n, held[0][2], held[0][1], held[-1][1], len(held), sum(len(x[3]) for x in held)))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, content string").repartition(4)
    assert sorted(map(tuple, turns.runs(df).collect()), key=str) == sorted(want, key=str)
    assert turns.runs(df.limit(0)).count() == 0
