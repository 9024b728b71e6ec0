"""Models on workers, zero-shot labels, extractive answers and summaries, with made-up models."""

import math
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import registry
from tessera.operators import readers, search


class Entails:
    """Logits from letters: deterministic, and no two labels alike."""

    def __call__(self, premises, hypotheses):
        return [(len(p) % 5, sum(p.count(c) for c in set(h.split()[-1])) / (1 + len(p))) for p, h in zip(premises, hypotheses)]


def test_zero_shot_labels(spark):
    texts = ["the river rises", "", None, "aaaa bbbb", "weather and water " * 2_000]
    df = spark.createDataFrame(list(enumerate(texts)), "text_id long, text string").withColumn("n", F.lit(1))
    labels = ["river", "bbb", "water", "river again"]
    for multi in (False, True):
        got = {r["text_id"]: r for r in readers.zero_shot(df, labels, Entails, multi_label=multi).collect()}
        for i, text in enumerate(texts):
            logits = Entails()([text or ""] * 4, [readers.TEMPLATE.replace("{}", x) for x in labels])
            if multi:
                want = [math.exp(b) / (math.exp(a) + math.exp(b)) for a, b in logits]
            else:
                want = [math.exp(b) / sum(math.exp(x) for _, x in logits) for _, b in logits]
            order = sorted(range(4), key=lambda j: (-want[j], j))
            assert [x["label"] for x in got[i]["scores"]] == [labels[j] for j in order]
            assert [x["score"] for x in got[i]["scores"]] == pytest.approx([want[j] for j in order])
            assert got[i]["label"] == labels[order[0]] and got[i]["n"] == 1
    assert readers.zero_shot(df, [], Entails).filter("label is null and size(scores) = 0").count() == 5
    assert readers.zero_shot(df.limit(0), labels, Entails).count() == 0


def test_zero_shot_as_second_tier(spark):
    anchors = spark.createDataFrame([("A", [1.0, 0.0]), ("B", [0.0, 1.0])], "label string, vec array<float>")
    rows = spark.createDataFrame([(1, [1.0, 0.0], "clear"), (2, [0.7, 0.7], "bbbb bbbb"), (3, [0.7, 0.71], "river river")], "query_id long, vec array<float>, text string")
    got = {r["query_id"]: r for r in search.classify(rows, anchors, second=readers.zero_shot_tier({"WATER": "river", "LETTERS": "bbbb"}, Entails)).collect()}
    assert (got[2]["label"], got[3]["label"]) == ("LETTERS", "WATER") and got[2]["used_second"] and not got[1]["used_second"] and got[2]["confidence"] > 0.5


class Spans:
    """Logits of words that depend on the question, the word and its place in the window."""

    def __call__(self, questions, windows):
        a = [[(hash_of(q, w) % 97) / 10 + i % 3 for i, w in enumerate(words)] for q, words in zip(questions, windows)]
        b = [[(hash_of(w, q) % 89) / 10 - i % 4 for i, w in enumerate(words)] for q, words in zip(questions, windows)]
        return a, b


def hash_of(a, b):
    return sum((i + 1) * ord(c) for i, c in enumerate(a + "|" + b))


def spans_of(question, context, size, stride, most, top):
    found, best = [(m[0], m.start(), m.end()) for m in re.finditer(r"\S+", context)], {}
    for first in range(0, max(1, len(found) - size + stride), stride) if found else ():
        window = found[first : first + size]
        s, e = Spans()([question], [[w for w, _, _ in window]])
        per_start = {}
        for i in range(len(window)):
            j = max(range(i, min(len(window), i + most)), key=lambda j: (e[0][j], -j))
            per_start[window[i][1], window[j][2]] = s[0][i] + e[0][j]
        for k, v in per_start.items():
            best[k] = max(best.get(k, -math.inf), v)
    ranked = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:top]
    return [(n, context[a:b], a, b, round(v, 9)) for n, ((a, b), v) in enumerate(ranked, 1)]


@pytest.mark.parametrize("size, stride, most, top", [(6, 4, 3, 2), (5, 5, 9, 1), (384, 256, 15, 3)])
def test_answers_match_all_spans(spark, size, stride, most, top):
    r = random.Random(size)
    contexts = [" ".join("".join(r.choice("abcdé日🙂") for _ in range(r.randrange(1, 6))) for _ in range(n)) for n in (1, 4, 5, 6, 9, 31, 700)]
    pairs = [(i, f"what is {i}?", f"\n {c}  ") for i, c in enumerate(contexts)] + [(90, "q", ""), (91, "q", None), (92, None, "some words")]
    df = spark.createDataFrame(pairs, "pair_id long, question string, context string")
    got = readers.extract_answers(df, Spans, top=top, size=size, stride=stride, most_words=most).collect()
    want = [(i, *row) for i, q, c in pairs for row in spans_of((q or "").strip(), (c or "").strip(), size, stride, most, top)]
    assert sorted((x["pair_id"], x["rank"], x["answer"], x["start"], x["end"], round(x["score"], 9)) for x in got) == sorted(want)


def test_windows_that_leave_gaps_are_refused(spark):
    with pytest.raises(ValueError):
        readers.extract_answers(spark.createDataFrame([], "pair_id long, question string, context string"), Spans, size=4, stride=5)


class Shortens:
    """The first three words of a chunk; notes what it read."""

    def __init__(self, folder):
        self.folder = folder

    def __call__(self, chunks):
        for c in chunks:
            with open(f"{self.folder}/{os.getpid()}-{random.getrandbits(60)}", "w") as f:
                f.write(c)
        return [" ".join(c.split()[:3]) + "." for c in chunks]


def loop(text, budget):
    rounds, read = 0, []
    while text.split():
        rounds += 1
        chunks = readers.chunks_of(text, budget)
        read += chunks
        text = " ".join(" ".join(c.split()[:3]) + "." for c in chunks)
        if len(chunks) == 1:
            return text, rounds, read
    return "", rounds, read


def test_every_sentence_is_read_once_a_level(spark, tmp_path):
    folder = str(tmp_path)
    texts = [" ".join(f"w{i} says {'x ' * (i % 7)}so." for i in range(n)) for n in (1, 3, 40, 400)] + ["", None, "no end " * 60, "?! " * 30]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["summary"], r["rounds"]) for r in readers.summarize(df, lambda: Shortens(folder), key=folder, budget=20).collect()}
    want = {i: loop(t or "", 20) for i, t in enumerate(texts)}
    assert got == {i: w[:2] for i, w in want.items()} and max(w[1] for w in want.values()) >= 4
    assert sorted(open(f"{folder}/{f}").read() for f in os.listdir(folder)) == sorted(c for w in want.values() for c in w[2])


def test_summaries_that_do_not_end(spark):
    df = spark.createDataFrame([(1, "a b c. " * 30)], "doc_id long, text string")
    with pytest.raises(Exception, match="did not shorten"):
        readers.summarize(df, lambda: list, key="same", budget=10).collect()
    with pytest.raises(ValueError, match="after 1 rounds"):
        readers.summarize(df, lambda: lambda chunks: ["short." for _ in chunks], key="short", budget=10, most_rounds=1)


@pytest.mark.parametrize("budget", [1, 3, 50])
def test_chunks_hold_all_words_in_order(budget):
    r = random.Random(budget)
    text = " ".join(r.choice(["a", "b.", "c!\"", "d...", "(e?)", "é…"]) for _ in range(200))
    chunks = readers.chunks_of(text, budget)
    assert " ".join(chunks) == text and all(len(c.split()) <= budget for c in chunks)
    assert readers.chunks_of(" \n", budget) == [] and readers.chunks_of("." * 200_000, budget) == ["." * 200_000]


def test_one_load_for_each_worker(spark, tmp_path):
    folder = str(tmp_path)

    def load():
        with open(f"{folder}/{os.getpid()}-{random.getrandbits(60)}", "w"):
            return lambda x: x * 2

    warmed = registry.warm(spark, folder, load, workers=3).collect()
    assert len({r["pid"] for r in warmed}) == 3 and all(r["loaded"] for r in warmed)
    double = registry.model_udf(folder, load, lambda model, x: model(x), "long")
    for _ in range(3):
        assert spark.range(0, 1000, 1, 12).select(double("id").alias("d")).agg(F.sum("d")).first()[0] == 999_000
    pids = [f.split("-")[0] for f in os.listdir(folder)]
    assert len(pids) == len(set(pids)) >= 3
    assert not any(r["loaded"] for r in registry.warm(spark, folder, load, workers=1).collect()) or len(set(os.listdir(folder))) > 3


def test_a_model_of_this_process():
    calls = []
    assert registry.model("k", lambda: calls.append(1) or 7) == 7 and registry.model("k", lambda: calls.append(1) or 8) == 7 and calls == [1]
    registry.forget("k")
    assert registry.model("k", lambda: np.float64(9)) == 9
    registry.forget("k")
