"""From raw questions to sourced answers, and from sources to a vector store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.encoders import hashing_encoder
from ..operators import flow, search, segments, usage, validate
from ..operators.trace import Trace
from ..tables import materialize


def analyze(queries: DataFrame, corrections: dict[str, str] | None = None) -> DataFrame:
    """``queries(query_id, text)`` with tone (of the raw text), the corrected text, greeting, segments and whether a model must split them."""
    q = queries.withColumn("raw", F.trim(F.coalesce("text", F.lit(""))))
    q = q.withColumn("tone", T.frustration(F.col("raw"))).withColumn("corrected", T.collapse_punctuation(T.correct_words(F.col("raw"), corrections or {})))
    q = q.withColumn("peeled", T.peel_greeting(F.col("corrected")))
    q = q.withColumns({"greeting": F.col("peeled.greeting"), "cleaned": F.col("peeled.query"), "multi_part": T.is_multi_part(F.col("peeled.query"))})
    none = F.array().cast("array<string>")
    parts = F.when(F.col("cleaned") == "", none).when(F.col("multi_part"), T.greedy_split(F.col("cleaned"))).otherwise(F.array("cleaned"))
    q = q.withColumn("segments", parts).withColumn("needs_split", F.col("multi_part") & (F.size("segments") == 1))
    return q.withColumn("level", T.frustration_level(F.col("tone.score"))).drop("raw", "peeled")


def segment_vectors(analyzed: DataFrame, encoder: Callable[[Column], Column] = hashing_encoder) -> DataFrame:
    """(query_id, segment_idx, text, vec); each distinct text is encoded once."""
    parts = analyzed.select("query_id", F.posexplode("segments").alias("segment_idx", "text"))
    return parts.join(parts.select("text").distinct().withColumn("vec", encoder(F.col("text"))), "text")


def find(analyzed: DataFrame, vectors: DataFrame, sources: DataFrame, anchors: DataFrame | None = None, options: search.Options = search.Options(), encoder: Callable[[Column], Column] = hashing_encoder, traced: Trace | None = None) -> DataFrame:
    """Hits of all segments of a question, united, resolved to their text and bounded.

    ``traced`` gets an event for each stage: the segments, those that are searched, the
    stages of the search, the union and what resolves.
    """
    keep = traced.keep if traced else materialize
    parts = segment_vectors(analyzed, encoder).withColumn("part", F.struct("query_id", "segment_idx"))
    if traced:
        parts = traced.keep(parts, "segments")
    if anchors is not None:
        labels = search.classify(parts.select(F.col("part").alias("query_id"), "vec"), anchors).select(F.col("query_id").alias("part"), "label", F.col("best_other").alias("label_score"))
        parts = search.searchable(parts.join(labels, "part"))
        parts = traced.keep(parts, "searched") if traced else parts
    hits = search.search(vectors, parts.select(F.col("part").alias("query_id"), "vec"), options, keep)
    hits = hits.withColumn("segment_idx", F.col("query_id.segment_idx")).withColumn("query_id", F.col("query_id.query_id"))
    united = search.union_hits(hits)
    united = traced.keep(united, "united") if traced else united
    resolved = search.resolve(united, sources, keep_missing=True)
    resolved = traced.keep(resolved, "resolved") if traced else resolved
    return resolved.filter(F.col("section_text").isNotNull() & (F.col("rank") <= options.max_rows))


def contexts(analyzed: DataFrame, hits: DataFrame, intents: DataFrame | None = None) -> DataFrame:
    q = analyzed.select("query_id", F.col("corrected").alias("text"), F.col("tone.score").alias("frustration"), "level")
    none = F.array().cast("array<string>")
    q = q.withColumn("intents", none) if intents is None else q.join(intents, "query_id", "left").withColumn("intents", F.coalesce("intents", none))
    return search.serialize(hits, q)


def answer(queries: DataFrame, vectors: DataFrame, sources: DataFrame, make_call: Callable[[], Callable[[str], str]], *, fallback: str | None = None, corrections: dict[str, str] | None = None, options: search.Options = search.Options(), concurrency: int = 8, max_retries: int = 2) -> DataFrame:
    """(query_id, answer, valid, attempts, errors): greetings alone get a template, other questions the model's validated reply."""
    analyzed = analyze(queries, corrections)
    plain = analyzed.filter((F.size("segments") == 0) & F.col("greeting")).select("query_id", T.greeting_answer(F.col("corrected")).alias("answer"), F.lit(True).alias("valid"), F.lit(0).alias("attempts"), F.array().cast("array<string>").alias("errors"))
    asked = analyzed.filter(F.size("segments") > 0)
    prompts = contexts(asked, find(asked, vectors, sources, options=options)).withColumnRenamed("context", "prompt")
    replies = flow.call_service(prompts, make_call, key="query_id", concurrency=concurrency, max_retries=max_retries, fallback=fallback)
    replies = replies.withColumn("answer", validate.extract_json(F.col("text"))).withColumn("faults", validate.response_errors(F.col("answer")))
    replies = replies.select("query_id", F.coalesce("answer", "text").alias("answer"), (F.col("valid") & (F.size("faults") == 0)).alias("valid"), "attempts", F.concat("errors", "faults").alias("errors"))
    return plain.unionByName(replies)


def knowledge_base(sources: DataFrame, encoder: Callable[[Column], Column] = hashing_encoder) -> DataFrame:
    """The vectors table of ``sources(document_id, content)``: sections, chunks, encoding."""
    return segments.encode_sections(segments.sections(sources), encoder(F.col("text")))


def augment(sections: DataFrame, make_call: Callable[[], Callable[[str], str]], **options) -> DataFrame:
    """Sections with model-written questions appended to their chunks; sections whose calls fail stay as they are."""
    prompts = sections.withColumn("request_id", F.concat_ws("#", "document_id", F.col("section_idx").cast("string"))).withColumn("prompt", F.concat(F.replace("breadcrumbs", F.lit(", "), F.lit(" > ")), F.lit("\n\n"), "content"))
    replies = flow.call_service(prompts, make_call, **options).select("request_id", F.coalesce(validate.row_texts(F.col("text")), F.array().cast("array<string>")).alias("more"))
    return prompts.join(replies, "request_id", "left").withColumn("chunks", F.concat("chunks", "more")).drop("more", "prompt", "request_id")


def write_markdown(texts: DataFrame, make_call: Callable[[], Callable[[str], str]], **options) -> DataFrame:
    """(request_id, markdown, file_name, valid): model-written markdown that has a title, without fences, named after it."""
    sound = lambda t: [] if t.lstrip().startswith("#") or "\n# " in t else ["no title"]
    done = flow.call_service(texts, make_call, validate=sound, **options).withColumn("markdown", T.strip_fences(F.col("text")))
    return done.select("request_id", "markdown", T.file_name_of(F.col("markdown")).alias("file_name"), T.has_title(F.col("markdown")).alias("valid"), "attempts", "errors")


def total_usage(rows: DataFrame) -> DataFrame:
    return usage.collapse(usage.with_cost(rows))
