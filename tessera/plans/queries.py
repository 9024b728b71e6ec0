"""The registered queries over the driver's tables, and their SQL."""

from __future__ import annotations

import base64
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import blocked, flow, intervals, readers, search, segments, spans, spelling, store, turns, usage, validate
from ..operators.search import Options
from ..operators.trace import Trace
from ..sources import vect
from ..sources.files import html_to_markdown
from ..streaming import batches, stateful
from ..tables import delete_folder, materialize, new_folder, spread
from . import answer


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store: a document per label, a section per five vector ids."""
    e, s = table(spark, sf_dir, "embeddings"), F.floor(F.col("vec_id") / 5).cast("int")
    return e.select(F.concat(F.lit("label|"), F.col("label").cast("string")).alias("document_id"), F.col("label").alias("doc_ord"), s.alias("section_idx"), (s * 5).alias("range_start"), (s * 5 + 5).alias("range_end"), (F.col("vec_id") % 5).cast("int").alias("vec_idx"), F.col("embedding").alias("vec"))


def queries_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query set: every row whose id is divisible by 20."""
    return table(spark, sf_dir, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))


def r6(c) -> F.Column:
    return F.round(c, 6)


def r6_f32(c: str) -> F.Column:
    """``r6`` of a double that a 32-bit float holds too, without a decimal number for each row.

    A million times such a value is exact in a double, and so is a half more, where it matters;
    the quotient is the double nearest to the decimal, and zeros have no sign, as in ``round``.
    """
    size = F.abs(c)
    return F.when(size < 1e9, F.signum(c) * (F.floor(size * 1e6 + 0.5) / F.lit(1e6)) + 0.0).otherwise(r6(c))


KEY = ["query_id", "document_id", "range_start", "range_end"]


def _hits(spark, d, floor=0.3):
    return search.ranked(search.best_scores(vectors_of(spark, d), queries_of(spark, d), floor))


def _first_hits(spark, d):
    """The hits that a cut looks at, with their vectors."""
    return blocked.top_sections(vectors_of(spark, d), queries_of(spark, d), 30)


def _out(hits: DataFrame) -> DataFrame:
    return hits.select(*KEY, "rank", r6("score").alias("score"))


def vector_functions(spark, d):
    e = table(spark, d, "embeddings")
    first = e.filter("vec_id = 0").select(F.col("embedding").alias("q"))
    t = e.crossJoin(F.broadcast(first))  # one row
    a, q = F.col("embedding"), F.col("q")
    return t.select("vec_id", r6(V.dot(a, q)).alias("dot"), r6(V.cosine(a, q)).alias("cosine"), r6(V.l2(a)).alias("l2"), r6(V.l2_squared(a)).alias("l2_squared"), r6(V.similarity(a, q, True)).alias("similarity"), r6(V.hinge(V.cosine(a, q))).alias("hinge"), r6(F.element_at(V.normalized(F.transform(a, lambda x: x * 3)), 1)).alias("normalized_1"))


def section_score_max(spark, d):
    return search.best_scores(vectors_of(spark, d), queries_of(spark, d), None).select(*KEY, r6_f32("score").alias("score"))


def section_argmax_vector(spark, d):
    hits = search.score_sections(vectors_of(spark, d), queries_of(spark, d))
    return hits.select(*KEY, r6(F.element_at("best_vec", 1).cast("double")).alias("best_first"))


def search_ranked(spark, d):
    return _out(_hits(spark, d))


def search_top(spark, d):
    """The first 52 sections of every query, by blocks."""
    return _out(blocked.top_sections(vectors_of(spark, d), queries_of(spark, d), 52))


def entropy_effective_count(spark, d):
    return search.entropy_count(_first_hits(spark, d))


def ratio_effective_count(spark, d):
    return search.ratio_count(_hits(spark, d), 1.2)


def adaptive_prune(spark, d):
    return _out(search.prune(_first_hits(spark, d)))


def search_no_rerank(spark, d):
    return _out(search.search(vectors_of(spark, d), queries_of(spark, d), Options(rerank=False)))


def search_full(spark, d):
    return _out(search.search(vectors_of(spark, d), queries_of(spark, d)))


def search_pivot(spark, d):
    return _out(search.search(vectors_of(spark, d), queries_of(spark, d), Options(pivot=True, pivot_min_results=50, pivot_min_anchor=0.4)))


def search_pivot_no_rerank(spark, d):
    return _out(search.search(vectors_of(spark, d), queries_of(spark, d), Options(pivot=True, rerank=False, pivot_min_results=50, pivot_min_anchor=0.4)))


def search_trace(spark, d):
    v, q, o = vectors_of(spark, d), queries_of(spark, d), Options(rerank=False)
    t = search.trace(q, search.stages(v, q, o), o)
    return t.select("query_id", "hits", r6("lowest").alias("lowest"), r6("highest").alias("highest"), "pruned_to", r6("cut_score").alias("cut_score"), r6("next_score").alias("next_score"), "pivot_added", "final")


def search_report(spark, d):
    v, q = vectors_of(spark, d), queries_of(spark, d)
    return search.report(search.trace(q, search.stages(v, q)))


def search_events(spark, d):
    """The events of a whole search and of the union of its hits by three segments, gathered while they ran."""
    traced = Trace()
    hits = search.search(vectors_of(spark, d), queries_of(spark, d), keep=traced.keep)
    parts = hits.withColumn("segment_idx", (F.col("query_id") % 3).cast("int")).withColumn("query_id", F.floor(F.col("query_id") / 60))
    traced.keep(search.union_hits(parts), "united")
    return traced.table(spark).select("nth", "stage", "rows", "queries", r6("lowest").alias("lowest"), r6("highest").alias("highest"))


def rerank_centroid(spark, d):
    c = search.centroids(search.prune(_first_hits(spark, d)))
    return c.select("query_id", r6(F.element_at("centroid", 1)).alias("c1"), r6(V.l2(F.col("centroid"))).alias("length"))


def rerank_weights(spark, d):
    w = search.rerank_weights(search.prune(_first_hits(spark, d)), queries_of(spark, d))
    return w.select("query_id", "weak", "skip", r6(F.aggregate("weights", F.lit(0.0), lambda a, x: a + x)).alias("total"))


def union_hits(spark, d):
    hits = _hits(spark, d).withColumn("segment_idx", (F.col("query_id") % 3).cast("int")).withColumn("query_id", F.floor(F.col("query_id") / 60))
    return search.union_hits(hits).select(*KEY, r6("score").alias("score"), "segment_idx", "rank")


def distribution_stats(spark, d):
    t = search.distribution(_hits(spark, d))
    return t.select("query_id", "n", "label", *[r6(c).alias(c) for c in ("lowest", "highest", "mean", "stddev", "entropy", "max_entropy")])


def threshold_suggestions(spark, d):
    return search.thresholds(_hits(spark, d))


def rerank_effect(spark, d):
    v, q = vectors_of(spark, d), queries_of(spark, d)
    return search.rerank_effect(search.search(v, q, Options(rerank=False)), search.search(v, q))


def rank_changes(spark, d):
    v, q = vectors_of(spark, d), queries_of(spark, d)
    return search.rank_changes(search.search(v, q, Options(rerank=False)), search.search(v, q))


def classifier_label(spark, d):
    anchors = table(spark, d, "embeddings").select(F.col("vec_id").alias("anchor_id"), F.col("label").cast("string").alias("label"), F.col("embedding").alias("vec"))
    got = search.classify(queries_of(spark, d), anchors)
    return got.select("query_id", "label", r6("confidence").alias("confidence"), r6("open_score").alias("open_score"), "low_confidence")


class _Letters:
    """A stand-in for an entailment model: the part of a premise's letters that the hypothesis' last word has."""

    def __call__(self, premises: list[str], hypotheses: list[str]) -> list[tuple[float, float]]:
        return [(0.5, 10 * sum(p.count(c) for c in set(h.split()[-1])) / (1 + len(p))) for p, h in zip(premises, hypotheses)]


def zero_shot_labels(spark, d):
    """The best of four labels for every document, and its score."""
    got = readers.zero_shot(table(spark, d, "documents").select("doc_id", "text"), ["tin", "reason", "que", "schub"], _Letters, key="letters")
    return got.select("doc_id", "label", r6("confidence").alias("confidence"))


class _Lengths:
    """A stand-in for a question-answering model: long words begin an answer, words with many e end it."""

    def __call__(self, questions: list[str], windows: list[list[str]]) -> tuple[list, list]:
        return [[float(len(w)) for w in ws] for ws in windows], [[float(w.count("e")) for w in ws] for ws in windows]


def extract_answers(spark, d):
    """The best span of up to 15 words in every document, looked for in overlapping windows."""
    pairs = table(spark, d, "documents").select(F.col("doc_id").alias("pair_id"), F.lit("which?").alias("question"), F.col("text").alias("context"))
    return readers.extract_answers(pairs, _Lengths, key="lengths").select("pair_id", "rank", "start", "end", "score", F.md5(F.col("answer").cast("binary")).alias("digest"))


class _Firsts:
    """A stand-in for a summary model: the first five words of a chunk."""

    def __call__(self, chunks: list[str]) -> list[str]:
        return [" ".join(c.split()[:5]) for c in chunks]


def summaries(spark, d):
    """Every document summarised in rounds, by a model that reads 200 words at a time."""
    return readers.summarize(table(spark, d, "documents").select("doc_id", "text"), _Firsts, key="firsts", budget=200)


def store_remove(spark, d):
    v = vectors_of(spark, d)
    ids = v.filter("section_idx % 2 = 0 and doc_ord < 3").select("document_id")
    return store.remove(v, ids).groupBy("document_id").agg(F.count("*").alias("n"))


def store_append(spark, d):
    v = vectors_of(spark, d)
    return store.append(v, v).groupBy("document_id", "doc_ord").agg(F.count("*").alias("n"))


def store_collisions(spark, d):
    docs = table(spark, d, "documents").select(F.col("source").alias("document_id"))
    return store.collisions(docs, vectors_of(spark, d).select("document_id"))


def vector_files(spark, d):
    """The store written as vector files, a version without one document, and that version read by the data source."""
    folder = new_folder(spark, "vector-files")
    versioned = vect.Versioned(spark, folder)
    versioned.reload(vectors_of(spark, d))
    versioned.remove("label|0")
    read = versioned.snapshot().groupBy("document_id", "doc_ord", "section_idx", "range_start", "range_end").agg(F.count("*").alias("n"), F.max("vec_idx").alias("last"), r6(F.sum(F.element_at("vec", 1).cast("double"))).alias("first_sum"), r6(F.sum(F.element_at("vec", -1).cast("double"))).alias("last_sum"))
    out = materialize(read, "vector-files-read")
    delete_folder(spark, folder)
    return out


def vec_offsets(spark, d):
    return store.vec_offsets(vectors_of(spark, d))


def store_dimension(spark, d):
    return store.dimension(vectors_of(spark, d))


def from_spec(spark, d):
    v = vectors_of(spark, d)
    s = v.groupBy("document_id", "doc_ord", "section_idx").agg(F.min("range_start").alias("start"), F.max("range_end").alias("end"), F.transform(F.array_sort(F.collect_list(F.struct("vec_idx", "vec"))), lambda x: x["vec"]).alias("vectors"))
    specs = s.groupBy("document_id", "doc_ord").agg(F.lit(64).alias("vec_dim"), F.transform(F.array_sort(F.collect_list(F.struct("section_idx", "start", "end", "vectors"))), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["vectors"].alias("vectors"))).alias("sections"))
    return store.from_spec(specs).groupBy("document_id", "section_idx").agg(F.count("*").alias("n"), r6(F.sum(F.element_at("vec", 1).cast("double"))).alias("s"))


def interval_ops(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.struct(F.col("l_linenumber").alias("start"), (F.col("l_linenumber") + F.col("l_quantity").cast("int")).alias("end")).alias("a"), F.struct((F.col("l_partkey") % 40).cast("int").alias("start"), (F.col("l_partkey") % 40 + 10).cast("int").alias("end")).alias("b"))
    a, b = F.col("a"), F.col("b")
    common = V.intersect(a, b)
    return li.select("l_orderkey", "l_linenumber", common["start"].alias("start"), common["end"].alias("end"), V.intersects(a, b).alias("meets"), V.contains(a, b).alias("holds"), V.span(a).alias("span"))


def interval_overlap_join(spark, d):
    """Documents whose ranges overlap."""
    v = table(spark, d, "documents").select("doc_id", F.struct((F.col("doc_id") * 7).alias("start"), (F.col("doc_id") * 7 + F.col("n_chars") % 23).alias("end")).alias("i"))
    met = intervals.overlap_join(v.select(F.col("doc_id").alias("a_id"), F.col("i").alias("a")), v.select(F.col("doc_id").alias("b_id"), F.col("i").alias("b")), "a", "b", cell=32)
    return met.filter("a_id < b_id").select("a_id", "b_id")


def _text(spark, d, more=""):
    return table(spark, d, "documents").select("doc_id", F.concat(F.col("text"), F.lit(more)).alias("t"))


def word_bucket(spark, d):
    n = T.word_count(F.col("t"))
    return _text(spark, d).select("doc_id", n.alias("words"), T.bucket(n).alias("bucket"))


def token_estimate(spark, d):
    return _text(spark, d).select("doc_id", T.token_counts(F.col("t")).alias("c")).select("doc_id", "c.*")


def content_stats(spark, d):
    return usage.content_stats(table(spark, d, "conversations"), "text", "role")


def text_normalize(spark, d):
    return _text(spark, d, " -- a_b!").select("doc_id", T.plain_text(F.col("t")).alias("plain"))


def collapse_punctuation(spark, d):
    return _text(spark, d, " no!!? what??? a,,b ;; c....").select("doc_id", T.collapse_punctuation(F.col("t")).alias("t"))


def normalize_punctuation(spark, d):
    return _text(spark, d, " no!! a,,b c.. d.... e--f g_h~i").select("doc_id", T.normalize_punctuation(F.col("t")).alias("t"))


def document_id(spark, d):
    pages = table(spark, d, "pages").select("page_id", F.concat(F.regexp_extract("url", r"://([^?#]*)", 1), F.lit(".md")).alias("p"))
    made = T.document_id(F.regexp_replace("p", "/+\\.md$", ".md"), ascii_only=True)
    return pages.select("page_id", made.alias("document_id"), T.is_document_id(made).alias("sound"))


def media_type(spark, d):
    names = F.concat(F.lit("f"), F.col("page_id").cast("string"), F.element_at(F.array(*map(F.lit, (".MD", ".html", ".pdf", ".zzz", ".jpeg"))), (F.col("page_id") % 5 + 1).cast("int")))
    return table(spark, d, "pages").select("page_id", T.media_type(names).alias("media_type"))


TONES = ("", " HELP ME NOW!!!", " please help, this is broken??", " damn it, asap!?", " wtf is not working right now", " EVERYTHING IS STUCK")


def _toned(spark, d):
    tail = F.element_at(F.array(*map(F.lit, TONES)), (F.pmod(F.col("conv_id") * 7 + F.col("turn"), F.lit(len(TONES))) + 1).cast("int"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.concat(F.col("text"), tail).alias("t"))


def frustration_score(spark, d):
    f = _toned(spark, d).withColumn("f", T.frustration(F.col("t")))
    return f.select("conv_id", "turn", r6("f.caps_ratio").alias("caps_ratio"), r6("f.shouting").alias("shouting"), r6("f.excess").alias("excess"), "f.profanity", F.size("f.urgent").alias("urgent"), r6("f.score").alias("score"), T.frustration_level(F.round("f.score", 9)).alias("level"))


GREETED = ("", "Hello! ", "thanks, ", "hi there ", "Good morning. ")


def _greeted(spark, d):
    head = F.element_at(F.array(*map(F.lit, GREETED)), (F.pmod(F.col("conv_id") * 3 + F.col("turn"), F.lit(len(GREETED))) + 1).cast("int"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.concat(head, F.coalesce("text", F.lit("")), F.lit(" What is it? Also explain why and show how.")).alias("t"))


def multi_part(spark, d):
    return _greeted(spark, d).select("conv_id", "turn", T.is_multi_part(F.col("t")).alias("multi_part"))


def greedy_split(spark, d):
    return _greeted(spark, d).select("conv_id", "turn", F.posexplode(T.greedy_split(F.col("t"))).alias("segment_idx", "segment"))


def peel_greeting(spark, d):
    return _greeted(spark, d).select("conv_id", "turn", T.peel_greeting(F.col("t")).alias("p")).select("conv_id", "turn", "p.*")


def greeting_template(spark, d):
    return _greeted(spark, d).select("conv_id", "turn", T.greeting_key(F.col("t")).alias("template"))


def query_prefix(spark, d):
    return table(spark, d, "benchmark").select("item_id", T.query_prefix(F.concat(F.lit("query: query: "), "text"), "query: ").alias("t"))


def spell_map(spark, d):
    return table(spark, d, "documents").select("doc_id", T.correct_words(F.col("text"), {"the": "THE", "of": "oF"}).alias("t"))


def resolve_range(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.col("text").alias("content"))
    hits = table(spark, d, "documents").select(F.col("doc_id").alias("query_id"), (F.col("doc_id") + F.when(F.col("doc_id") % 10 == 0, 10_000_000).otherwise(0)).cast("string").alias("document_id"), (F.col("n_chars") % 50 - 3).cast("int").alias("range_start"), (F.col("n_chars") % 70 + 5).cast("int").alias("range_end"))
    return search.resolve(hits, docs, keep_missing=True).select("query_id", "document_id", "section_text")


def serialize_context(spark, d):
    hits = search.search(vectors_of(spark, d), queries_of(spark, d), Options(rerank=False)).withColumn("section_text", F.concat(F.lit("a  b\n"), "document_id"))
    q = queries_of(spark, d).select("query_id", F.lit("q").alias("text"), F.lit(0.5).alias("frustration"), F.lit("frustrated").alias("level"), F.array(F.lit("GREETING"), F.lit("A")).alias("intents"))
    return search.serialize(hits, q)


def _usage(spark, d):
    li = table(spark, d, "lineitem")
    n = lambda c: F.col(c).cast("long")
    cache, batch = F.col("l_linenumber") % 2 == 0, F.col("l_returnflag") == "R"
    return li.select("l_suppkey", F.col("l_quantity").alias("duration"), n("l_extendedprice").alias("input_tokens"), n("l_quantity").alias("output_tokens"), cache.alias("cache"), F.when(cache, F.col("l_linenumber") % 4 == 0).alias("cache_hit"), F.when(cache, F.col("l_linenumber") % 4 == 2).alias("cache_miss"), F.when(cache, n("l_partkey")).alias("cached_tokens_read"), F.when(cache, n("l_suppkey")).alias("cached_tokens_created"), F.when(batch, 1).alias("succeeded"), F.when(batch, 0).alias("errored"))


def usage_collapse(spark, d):
    return usage.collapse(_usage(spark, d), "l_suppkey")


def usage_cost(spark, d):
    t = usage.collapse(usage.with_cost(_usage(spark, d), usage.RATES | {"batch_discount": 0.5}), "l_suppkey")
    return t.select("l_suppkey", *[F.round(f"{c}_cost", 6).cast("double").alias(f"{c}_cost") for c in usage.ITEMS])


def usage_normalize(spark, d):
    other = table(spark, d, "events").select(F.col("value").alias("DURATION"), F.col("user_id").alias("input_tokens"))
    t = usage.normalize(_usage(spark, d), other)
    return t.groupBy("cache", "succeeded").agg(F.count("*").alias("n"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.count("cached_tokens_read").alias("read"))


def turn_faults(spark, d):
    return flow.turn_faults(table(spark, d, "conversations"))


def conversation_runs(spark, d):
    """The conversations as mixed sources (prompts, responses and turns with a role), normalised, numbered and put together in runs."""
    t = table(spark, d, "conversations")
    kind = F.when(F.col("role") == "user", "text").when(F.col("role") == "assistant", "response").otherwise("turn")
    sources = t.select("conv_id", F.col("turn").alias("call"), F.lit(0).alias("nth"), kind.alias("kind"), "role", F.col("text").alias("content"))
    return turns.runs(turns.numbered(turns.normalize(sources)))


def intent_set(spark, d):
    t = table(spark, d, "conversations").select("conv_id", F.when(F.col("turn") == 0, "GREETING").otherwise(F.upper("role")).alias("label"))
    return usage.intents(t, "conv_id").select("conv_id", F.array_join("intents", ",").alias("intents"))


def reply_json(spark, d):
    """The JSON of replies made of every event's properties: plain, fenced, with talk behind it, enveloped, behind talk, nested too deep, cut off, and fenced behind talk."""
    e = spread(table(spark, d, "events").select("event_id", F.coalesce("props", F.lit("{}")).alias("p")))
    body = F.concat(F.lit('{"event": '), F.col("event_id").cast("string"), F.lit(', "props": '), F.col("p"), F.lit("}"))
    escaped = F.replace(F.replace(body, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    kinds = [
        body, F.concat(F.lit("```json\n"), body, F.lit("\n```\n")), F.concat(F.lit("\n["), body, F.lit("] **Reasoning:** see [3] and {x}")), F.concat(F.lit('{"output": {"text": "'), escaped, F.lit('"}}')),
        F.concat(F.lit("As noted in [1], "), body), F.repeat(F.lit("["), 20_000), F.concat(F.lit('{"open": ['), body), F.concat(F.lit("Here it is:\n```json\n"), body, F.lit("\n```\nIs that fine?")),
    ]
    reply = kinds[-1]
    for i, kind in reversed(list(enumerate(kinds[:-1]))):
        reply = F.when(F.col("event_id") % len(kinds) == i, kind).otherwise(reply)
    return e.select("event_id", validate.extract_json(reply).alias("json"))


def parse_json_rows(spark, d):
    rows = F.concat(F.lit('```json\n[{"question":"q'), F.col("event_id").cast("string"), F.lit('","anchors":["a","b"],"variants":["v"]},{"anchors":["x"]}]\n```'))
    texts = validate.row_texts(F.when(F.col("event_id") % 7 == 0, F.lit("oops")).otherwise(rows))
    return table(spark, d, "events").select("event_id", F.explode(texts).alias("text"))


def response_errors(spark, d):
    good = F.lit('{"answer":[{"text":"a","source":{"documentId":"x","range":[0,3]}}],"followUpQuestions":["q"]}')
    raw = F.when(F.col("event_id") % 4 == 0, good).when(F.col("event_id") % 4 == 1, F.lit('{"answer":[{"text":""}],"followUpQuestions":[""]}')).when(F.col("event_id") % 4 == 2, F.lit("[]")).otherwise(F.lit('{"answer":[]}'))
    t = table(spark, d, "events").select("event_id", validate.response_errors(raw).alias("e"))
    return t.select("event_id", F.size("e").alias("faults"))


class _Replies:
    """A stand-in for a batch service: a batch's id holds its requests' ids, and a request's id says what comes of it."""

    def create(self, requests: list[dict], key: str) -> str:
        return base64.b64encode(zlib.compress(" ".join(r["request_id"] for r in requests).encode())).decode()

    def _answers(self, batch_id: str) -> list[dict]:
        ids = zlib.decompress(base64.b64decode(batch_id)).decode().split()
        kinds = {0: {"status": "succeeded", "text": "yes"}, 1: {"status": "errored", "error": "overloaded"}, 3: {"status": "expired"}}
        sent = [(i, sum(map(int, i.split(":"))) % 4) for i in ids]
        return [{"request_id": i, "input_tokens": 10 * k, "output_tokens": 1} | kinds[k] for i, k in sent if k != 2]

    def look(self, batch_id: str) -> tuple[bool, int, int]:
        return True, 0, len(self._answers(batch_id))

    def results(self, batch_id: str, first: int, last: int) -> list[dict]:
        return self._answers(batch_id)[first:last]


def batch_responses(spark, d):
    """A request for every turn of the conversations, sent in batches, followed by the streaming source and answered in order."""
    t = table(spark, d, "conversations").filter("conv_id is not null and turn is not null")
    requests = t.select(F.concat_ws(":", "conv_id", "turn").alias("request_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("position"), F.coalesce("text", F.lit("")).alias("prompt"))
    root = new_folder(spark, "batch-run")
    run = batches.Batches(spark, root, _Replies, first_wait=0.05)
    run.submit(requests, size=500)
    got = run.wait()
    out = materialize(got.drop("batch_id", "stop_reason"), "batch-responses")
    delete_folder(spark, root)
    return out


def _fails_by_user(path: str, payload: dict, retries: int) -> None:
    if retries < int(payload["failures"]):
        raise ValueError(f"not yet: {retries}")


def queue_outcomes(spark, d):
    """Every user of the events as an entry of the stateful queue, whose work fails as often as the user's id modulo 6; four failures end it."""
    e = table(spark, d, "events").filter("user_id is not null").select(F.concat(F.lit("user|"), F.col("user_id").cast("string")).alias("path"), F.create_map(F.lit("failures"), (F.col("user_id") % 6).cast("string")).alias("payload"))
    root = new_folder(spark, "event-queue")
    q = stateful.Queue(spark, f"{root}/in", f"{root}/out", f"{root}/state", _fails_by_user, max_retries=4, first_wait=0.05, most_wait=0.2, every="0 seconds")
    q.enqueue(e)
    q.drain()
    last = q.done().filter("outcome <> 'retried'").groupBy("path").agg(F.count("*").alias("ends"), F.max("outcome").alias("outcome"), F.max("retries").alias("retries"), F.max("last_error").alias("last_error"))
    tries = q.done().groupBy("path").agg(F.count("*").alias("tries"))
    out = materialize(last.join(tries, "path"), "queue-outcomes")
    delete_folder(spark, root)
    return out


def retry_outcomes(spark, d):
    e = table(spark, d, "events").select("event_type", (F.col("event_id") % 6).cast("int").alias("retries"), (F.col("event_id") % 3 == 0).alias("ok"))
    return usage.outcomes(e).groupBy("event_type", "outcome").agg(F.count("*").alias("n"), F.max("retries").alias("retries"))


def error_tally(spark, d):
    return usage.error_tally(table(spark, d, "events"), "props", "event_type")


def latency_percentiles(spark, d):
    t = usage.nearest_rank(table(spark, d, "events"), "value", {"median": 0.5, "p95": 0.95}, "event_type")
    return t.select("event_type", r6("median").alias("median"), r6("p95").alias("p95"))


def match_results(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("request_id"))
    r = o.filter("request_id % 3 <> 0").select("request_id", F.lit("succeeded").alias("status"), F.lit(None).cast("string").alias("error"))
    return usage.match_results(o, r).select("request_id", "status", "error")


def text_sections(spark, d):
    pages = table(spark, d, "pages").select(F.col("page_id").cast("string").alias("document_id"), html_to_markdown(F.col("html")).alias("content"))
    return segments.sections(pages).select("document_id", "section_idx", "range_start", "range_end", "breadcrumbs", "word_count", "bucket", F.size("chunks").alias("n_chunks"))


def section_tree(spark, d):
    pages = table(spark, d, "pages").select(F.col("page_id").cast("string").alias("document_id"), html_to_markdown(F.col("html")).alias("content"))
    return segments.section_tree(pages)


def partition_report(spark, d):
    return segments.partition_report(section_tree(spark, d))


def spell_suggest(spark, d):
    """Every word of the documents, in small letters, that stands fewer than ten times, against those that stand ten times or more."""
    known = materialize(spelling.vocabulary(table(spark, d, "documents")), "vocabulary")
    return spelling.suggest(known.select(spelling.small("word").alias("word")), spelling.frequent_words(known, 10))


def spell_correct(spark, d):
    """Every document with its words corrected: a map that parts words of over twelve letters, then the documents' own frequent words."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    known = materialize(spelling.vocabulary(docs), "vocabulary")
    long = known.filter(F.length("word") > 12).select(spelling.small("word").alias("word")).distinct()
    slips = long.withColumn("fix", F.concat(F.substring("word", 1, 12), F.lit("-"), F.substring(F.col("word"), F.lit(13), F.length("word"))))
    got = spelling.correct(docs, spelling.frequent_words(known, 10), slips, known=known)
    return got.select("doc_id", F.length("corrected").alias("n_chars"), F.md5(F.col("corrected").cast("binary")).alias("digest"))


def text_segments(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.col("text").alias("content"))
    return segments.segments(docs).select("document_id", "idx", "start", "end")


def text_subsegments(spark, d):
    return segments.subsegments(table(spark, d, "documents"), "doc_id", "text")


def pca_first_component(spark, d):
    v = table(spark, d, "embeddings")
    return spans.pca(v, "label", "vec_id", "embedding").select("label", F.transform("component", lambda x: F.round(x, 6)).alias("component"), "consumed")


def representative_spans(spark, d):
    return spans.spans(table(spark, d, "embeddings"), "label", "vec_id", "embedding").select("label", "vec_id", r6("weight").alias("weight"))


def knowledge_base(spark, d):
    pages = table(spark, d, "pages").select(F.concat(F.lit("page|"), F.col("page_id").cast("string")).alias("document_id"), html_to_markdown(F.col("html")).alias("content"))
    return answer.knowledge_base(pages).groupBy("document_id").agg(F.count("*").alias("vectors"), F.countDistinct("section_idx").alias("sections"))


def analyze_queries(spark, d):
    q = table(spark, d, "conversations").select(F.struct("conv_id", "turn").alias("query_id"), "text")
    return answer.analyze(q).select("query_id.*", "corrected", "greeting", "multi_part", "needs_split", F.size("segments").alias("n_segments"), "level")


QUERIES = {f.__name__: f for f in (
    search_full, vector_functions, section_score_max, section_argmax_vector, search_ranked, search_top, entropy_effective_count, ratio_effective_count, adaptive_prune, search_no_rerank, search_pivot, search_pivot_no_rerank, search_trace, search_report, search_events,
    rerank_centroid, rerank_weights, union_hits, distribution_stats, threshold_suggestions, rerank_effect, rank_changes, classifier_label, zero_shot_labels, extract_answers, summaries, store_remove, store_append, store_collisions, vector_files, vec_offsets, store_dimension,
    from_spec, interval_ops, interval_overlap_join, word_bucket, token_estimate, content_stats, text_normalize, collapse_punctuation, normalize_punctuation, document_id, media_type, frustration_score, multi_part,
    greedy_split, peel_greeting, greeting_template, query_prefix, spell_map, resolve_range, serialize_context, usage_collapse, usage_cost, usage_normalize, turn_faults, conversation_runs, intent_set, reply_json, parse_json_rows, response_errors, retry_outcomes, error_tally,
    latency_percentiles, match_results, batch_responses, queue_outcomes, text_sections, section_tree, partition_report, spell_suggest, spell_correct, text_segments, text_subsegments, pca_first_component, representative_spans, knowledge_base, analyze_queries,
)}
