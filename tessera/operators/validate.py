"""Validation and repair of model responses, on variant columns."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


DECODER = json.JSONDecoder()
FENCE, INNER_FENCE = re.compile(r"^\s*```(?:json)?\s*", re.I), re.compile(r"```(?:json)?[ \t]*\n", re.I)


def _is(value: Column, *kinds: str) -> Column:
    return F.coalesce(F.schema_of_variant(value).rlike("^(" + "|".join(kinds) + ")"), F.lit(False))


def response_errors(raw: Column) -> Column:
    """All faults of ``{answer: [{text, source?}], followUpQuestions: [text]}``; an empty array if it is sound."""
    v = F.try_parse_json(raw)
    get = lambda path, kind: F.try_variant_get(v, path, kind)
    answer, follow = get("$.answer", "array<variant>"), get("$.followUpQuestions", "array<variant>")
    text_of = lambda c: F.trim(F.coalesce(F.try_variant_get(c, "$.text", "string"), F.lit("")))
    source = lambda c: F.try_variant_get(c, "$.source", "variant")
    bad_source = lambda c: F.try_variant_get(c, "$.source.documentId", "string").isNull() | (F.size(F.coalesce(F.try_variant_get(c, "$.source.range", "array<int>"), F.array().cast("array<int>"))) != 2)
    chunk = lambda c, i: F.array_compact(F.array(
        F.when(text_of(c) == "", F.concat(F.lit("answer["), i.cast("string"), F.lit("].text must be a non-empty string"))),
        F.when(source(c).isNotNull() & bad_source(c), F.concat(F.lit("answer["), i.cast("string"), F.lit("].source needs documentId and range"))),
    ))
    question = lambda q, i: F.when(F.trim(F.coalesce(F.try_variant_get(q, "$", "string"), F.lit(""))) == "", F.concat(F.lit("followUpQuestions["), i.cast("string"), F.lit("] must be a non-empty string")))
    own = F.array_compact(F.array(F.when(answer.isNull() | (F.size(answer) == 0), "answer must be a non-empty array"), F.when(follow.isNull(), "followUpQuestions must be an array")))
    none = F.array().cast("array<string>")
    parts = F.concat(own, F.coalesce(F.flatten(F.transform(answer, chunk)), none), F.coalesce(F.array_compact(F.transform(follow, question)), none))
    return F.when(v.isNull() | ~_is(v, "OBJECT"), F.array(F.lit("response must be an object"))).otherwise(parts)


def theme_errors(raw: Column, themes: list[str]) -> Column:
    v = F.try_parse_json(raw)
    get = lambda path, kind: F.try_variant_get(v, path, kind)
    sure = get("$.confidence", "double")
    return F.array_compact(F.array(
        F.when(~F.coalesce(get("$.theme", "string").isin(themes), F.lit(False)), "unknown theme"),
        F.when(~F.coalesce((sure >= 0) & (sure <= 1), F.lit(False)), "confidence must be from 0 to 1"),
        F.when(F.trim(F.coalesce(get("$.rationale", "string"), F.lit(""))) == "", "rationale must not be empty"),
    ))


def row_texts(raw: Column) -> Column:
    """Question, anchors and variants of every row of a JSON array that has a question; null if it isn't one."""
    unfenced = F.trim(F.regexp_replace(raw, r"(?s)^\s*```[A-Za-z]*\s*(.*?)\s*```\s*$", "$1"))
    rows = F.from_json(unfenced, "array<struct<question:string,anchors:array<string>,variants:array<string>>>")
    none = F.array().cast("array<string>")
    one = lambda r: F.concat(F.array(r["question"]), F.coalesce(r["anchors"], none), F.coalesce(r["variants"], none))
    asked = F.filter(rows, lambda r: F.coalesce(F.trim(r["question"]), F.lit("")) != "")
    return F.when(F.try_parse_json(unfenced).isNotNull(), F.filter(F.flatten(F.transform(asked, one)), lambda t: F.coalesce(F.trim(t), F.lit("")) != ""))


def _opening_value(text: str) -> str | None:
    """The value that opens ``text``, whatever stands behind it; null if it is no list or object, or not JSON."""
    if text[:1] not in ("[", "{"):
        return None
    try:
        return json.dumps(DECODER.raw_decode(text)[0], ensure_ascii=False)
    except (ValueError, RecursionError):  # deeper than the parser goes: no reply that anything here can use
        return None


def first_json(text: str | None) -> str | None:
    """The JSON value of a reply; null if it has none.

    Only a value that opens the reply counts, or one that opens a fenced block: a
    citation such as ``[1]`` in running text doesn't. Talk behind the value is left out.
    A response envelope (``{"output": {"text": ...}}``) is unwrapped. Reads each
    character once, whatever the reply holds.
    """
    stripped = FENCE.sub("", text or "", count=1).strip()
    value = _opening_value(stripped.removesuffix("```").rstrip())
    if value is None and (fenced := INNER_FENCE.search(text or "")):
        value = _opening_value(text[fenced.end() :].lstrip())
    if value is not None and value.startswith('{"output"'):
        inner = json.loads(value)["output"]
        if isinstance(inner, dict) and isinstance(inner.get("text"), str):
            return first_json(inner["text"])
    return value


@F.pandas_udf(StringType())
def extract_json(texts: pd.Series) -> pd.Series:
    return texts.map(first_json)


def join_errors(errors: Column) -> Column:
    return F.array_join(errors, "; ")


def with_errors(responses: DataFrame, raw: str = "response") -> DataFrame:
    return responses.withColumn("errors", response_errors(F.col(raw))).withColumn("valid", F.size("errors") == 0)
