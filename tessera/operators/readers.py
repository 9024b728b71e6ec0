"""Labels, answers and summaries by models of text, as plans around one model call each.

The models are parameters (``load`` makes one on a worker, kept under ``key``); what
surrounds the calls, templates, windows, normalising, the choice of spans and the rounds
of a summary, is here.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.registry import Load, each_row, model_udf
from ..tables import discard, materialize

TEMPLATE = "This text is about {}"
#: Words of a window, words between the starts of two windows, and words of an answer at most.
WINDOW, STRIDE, ANSWER_WORDS = 384, 256, 15
#: Words that a summary's model reads at once.
BUDGET, MOST_ROUNDS = 512, 12


def softmax(values: Column) -> Column:
    """Exponentials of an array's values, as parts of their sum."""
    shifted = F.transform(F.array(F.array_max(values)), lambda top: F.transform(values, lambda x: F.exp(x - top)))[0]
    return F.transform(F.array(shifted), lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y)))[0]


def zero_shot(texts: DataFrame, labels: list[str], load: Load, *, key: str = "zero-shot", text_col: str = "text", template: str = TEMPLATE, multi_label: bool = False) -> DataFrame:
    """``texts`` with ``scores``, an array of (label, score), best first, and ``label`` and ``confidence`` of the first.

    The model maps lists of premises and hypotheses to rows of two logits (against, for).
    Every text meets every label's hypothesis in one call for a batch. Scores are parts
    of the labels' sum or, with ``multi_label``, each label's own part of its two logits.
    Null texts are empty; ties go to the earlier label; no labels give an empty array.
    """
    hypotheses = [template.replace("{}", label) for label in labels]

    def run(model, premises: pd.Series) -> pd.Series:
        flat = [p or "" for p in premises for _ in hypotheses]
        logits = np.asarray(model(flat, hypotheses * len(premises)), np.float64).reshape(len(premises), len(hypotheses), 2)
        return pd.Series([list(map(list, rows)) for rows in logits.tolist()])

    if not labels:
        none = F.array().cast("array<struct<label:string,score:double>>")
        return texts.withColumns({"scores": none, "label": F.lit(None).cast("string"), "confidence": F.lit(None).cast("double")})
    scored = texts.withColumn("_logits", model_udf(key, load, run, "array<array<double>>")(F.col(text_col).cast("string")))
    parts = F.transform("_logits", lambda x: softmax(x)[1]) if multi_label else softmax(F.transform("_logits", lambda x: x[1]))
    named = F.transform(parts, lambda s, i: F.struct(s.alias("score"), (-i).alias("nth")))
    names = F.array(*[F.lit(x) for x in labels])
    best = F.transform(F.sort_array(named, asc=False), lambda x: F.struct(F.get(names, -x["nth"]).alias("label"), x["score"].alias("score")))
    out = scored.withColumn("scores", best).drop("_logits")
    return out.withColumns({"label": F.col("scores")[0]["label"], "confidence": F.col("scores")[0]["score"]})


def zero_shot_tier(labels: dict[str, str], load: Load, *, key: str = "zero-shot", text_col: str = "text", template: str = TEMPLATE) -> Callable[[DataFrame], DataFrame]:
    """The second tier of ``search.classify``: ``labels`` gives each label's wording; the rows need their text beside the vector."""
    wordings = list(labels.values())
    back = F.create_map(*[F.lit(x) for name, wording in labels.items() for x in (wording, name)])

    def second(rows: DataFrame) -> DataFrame:
        got = zero_shot(rows.select("query_id", F.col(text_col).alias("_text")), wordings, load, key=key, text_col="_text", template=template)
        return got.select("query_id", F.element_at(back, F.col("label")).alias("label"), "confidence")

    return second


WORD = re.compile(r"\S+")


def _tidy(text: str | None) -> str:
    return unicodedata.normalize("NFC", text or "").strip()


def _windows(size: int, stride: int) -> Callable[..., Column]:
    def cut(context: str | None) -> list[dict]:
        found = [(m[0], m.start(), m.end()) for m in WORD.finditer(_tidy(context))]
        firsts = range(0, max(1, len(found) - size + stride), stride) if found else ()
        return [dict(zip(("words", "starts", "ends"), map(list, zip(*found[i : i + size])))) for i in firsts]

    return each_row(cut, "array<struct<words:array<string>,starts:array<int>,ends:array<int>>>")


def extract_answers(pairs: DataFrame, load: Load, *, key: str = "answers", top: int = 1, size: int = WINDOW, stride: int = STRIDE, most_words: int = ANSWER_WORDS) -> DataFrame:
    """The ``top`` spans of every pair (pair_id, question, context) that answer it best: pair_id, rank, answer, start, end, score.

    A context is cut into windows of ``size`` words that begin ``stride`` words apart, so
    a span of up to ``size - stride`` words stands whole in one. The model maps lists of
    questions and of windows (lists of words) to lists of start logits and of end logits,
    one for each word. A span of up to ``most_words`` words scores the start logit of its
    first and the end logit of its last word; for each start the best end counts, and of
    a span in two windows the better score. Ties go to the earlier start, then the shorter
    span. Offsets are code points in the context, NFC and trimmed, which is what answers are
    cut from. Pairs with an empty or null context have no row.
    """
    if not 0 < stride <= size:
        raise ValueError("windows must begin 1 to size words apart")

    def run(model, questions: pd.Series, windows: pd.Series) -> pd.DataFrame:
        starts, ends = model([_tidy(q) for q in questions], [list(w) for w in windows])
        return pd.DataFrame({"s": [list(map(float, x)) for x in starts], "e": [list(map(float, x)) for x in ends]})

    held = pairs.select("pair_id", "question", F.col("context").cast("string").alias("context"))
    windows = held.select("pair_id", "question", F.explode(_windows(size, stride)("context")).alias("w"))
    scored = windows.withColumn("x", model_udf(key, load, run, "struct<s:array<double>,e:array<double>>")("question", F.col("w.words")))
    # the best end of each start: the maximum of the end logits in its reach, and the earliest place of it
    reach = lambda i: F.slice("x.e", i + 1, most_words)
    span = lambda s, i: F.transform(F.array(reach(i)), lambda r: F.struct(
        (s + F.array_max(r)).alias("score"), F.get("w.starts", i).alias("start"), F.get("w.ends", i + F.array_position(r, F.array_max(r)).cast("int") - 1).alias("end")
    ))[0]
    spans = F.transform("x.s", span)
    best = F.slice(F.array_sort(spans, lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).otherwise(a["start"] - b["start"])), 1, top)
    rows = scored.select("pair_id", F.explode(best).alias("b")).groupBy("pair_id", "b.start", "b.end").agg(F.max("b.score").alias("score"))
    order = Window.partitionBy("pair_id").orderBy(F.desc("score"), "start", "end")
    first = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)

    tidy = each_row(_tidy, "string")
    joined = first.join(held.select("pair_id", "context"), "pair_id")
    return joined.select("pair_id", "rank", F.substring(tidy("context"), F.col("start") + 1, F.col("end") - F.col("start")).alias("answer"), "start", "end", "score")


def chunks_of(text: str | None, budget: int) -> list[str]:
    """A text's sentences in groups of up to ``budget`` words, in order; a longer sentence is cut at words."""
    out: list[str] = []
    held: list[str] = []
    sentence: list[str] = []
    words = (text or "").split()
    for i, word in enumerate(words, 1):
        sentence.append(word)
        if word.rstrip("\"'”’)]").endswith((".", "!", "?", "…")) or len(sentence) == budget or i == len(words):
            if len(held) + len(sentence) > budget:
                out.append(" ".join(held))
                held = []
            held += sentence
            sentence = []
    return [*out, " ".join(held)] if held else out


def summarize(texts: DataFrame, load: Load, *, key: str = "summary", id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET, most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """(id, summary, rounds): texts summarised in rounds until one model call reads what is left of each.

    A round cuts every text that is over ``budget`` words into chunks of sentences, gives
    each chunk to the model once, and joins the summaries in order; a text that fits gets
    its last call and is done, so its level of summaries covers every sentence. Ids must
    be unique; null and empty texts have an empty summary and no round. A text that a
    round doesn't shorten, or that isn't done after ``most_rounds``, fails the job.
    """

    cut = each_row(lambda text: chunks_of(text, budget), "array<string>")

    def run(model, chunks: pd.Series) -> pd.Series:
        return pd.Series(list(model(chunks.tolist())), dtype=object)

    summary = model_udf(key, load, run, "string")
    words = lambda c: F.regexp_count(c, F.lit(r"\S+"))
    rows = texts.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    empty = rows.filter(words(F.col("text")) == 0).select("id", F.lit("").alias("summary"), F.lit(0).alias("rounds"))
    done, open_ = [empty], materialize(rows.filter(words(F.col("text")) > 0), "texts-to-summarise")
    for n in range(1, most_rounds + 1):
        pieces = open_.select("id", words(F.col("text")).alias("before"), F.posexplode(cut("text")).alias("nth", "chunk"))
        made = pieces.withColumn("made", summary("chunk")).groupBy("id").agg(F.max("before").alias("before"), F.count("*").alias("chunks"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "made"))), lambda x: x["made"]), " ").alias("text"))
        shorter = (F.col("chunks") == 1) | (words(F.col("text")) < F.col("before"))
        made = made.withColumn("text", F.when(shorter, F.col("text")).otherwise(F.raise_error(F.concat(F.lit("a round did not shorten the text "), F.col("id").cast("string"))).cast("string")))
        level = materialize(made, "summaries")
        discard(open_)
        done.append(level.filter("chunks = 1").select("id", F.col("text").alias("summary"), F.lit(n).alias("rounds")))
        open_ = level.filter("chunks > 1").select("id", "text")
        if open_.isEmpty():
            break
        open_ = materialize(open_, "texts-to-summarise")
    else:
        raise ValueError(f"texts are not summarised after {most_rounds} rounds")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.withColumnRenamed("id", id_col)
