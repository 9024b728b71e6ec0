"""Vector search as one plan for any number of queries.

Tables: ``vectors(document_id, doc_ord, section_idx, range_start, range_end,
vec_idx, vec)`` and ``queries(query_id, vec)``. Sections are scored by their best
vector, cut where the score distribution breaks, optionally widened through an
anchor, reranked against the candidates' centroid, and bounded.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import weighted_score
from ..tables import discard, materialize
from .blocked import SECTION, best_cosines, best_sections, in_order, top_sections

#: Queries that are broadcast to the vectors at once, and vectors that a worker multiplies with them at once.
BROADCAST_QUERIES, BLOCK_VECTORS = 4096, 4096


@dataclass(frozen=True)
class Options:
    floor: float = 0.3
    min_rows: int = 3
    max_rows: int = 12
    user_rows: int | None = None
    max_cut: int = 30
    min_gap: float = 1.5
    eps: float = 1e-10
    rerank: bool = True
    rerank_threshold: float = 0.5
    extension_ratio: float = 0.7
    extension_max: int = 12
    pivot: bool = False
    pivot_min_results: int = 5
    pivot_min_anchor: float = 0.7
    pivot_max: int = 10


def score_sections(vectors: DataFrame, queries: DataFrame, floor: float | None = 0.3) -> DataFrame:
    """Best vector of each section for each query: score, best_vec; sections under ``floor`` go (None keeps all).

    A vector of another length than the query's is an error. ``vec_idx`` names one vector
    of a section; ids of queries are unique.
    """
    return best_sections(vectors, queries, floor, True, BROADCAST_QUERIES, BLOCK_VECTORS).drop("vec_idx")


def best_scores(vectors: DataFrame, queries: DataFrame, floor: float | None = 0.3) -> DataFrame:
    """``score_sections`` without the vectors: query_id, section, score and the ``vec_idx`` of the best vector."""
    return best_sections(vectors, queries, floor, False, BROADCAST_QUERIES, BLOCK_VECTORS)


def ranked(hits: DataFrame, score: str = "score", name: str = "rank") -> DataFrame:
    return hits.withColumn(name, F.row_number().over(Window.partitionBy("query_id").orderBy(*in_order(score))))


def entropy_count(hits: DataFrame, max_cut: int = 30) -> DataFrame:
    """(query_id, k): effective number of scores by perplexity among the first ``max_cut``."""
    s = F.when((F.col("rank") <= max_cut) & (F.col("score") > 0), F.col("score"))
    sums = hits.groupBy("query_id").agg(F.sum(s).alias("s"), F.sum(s * F.log(s)).alias("e"), F.count(s).alias("n"))
    k = F.ceil(F.round(F.exp(F.log("s") - F.col("e") / F.col("s")), 9))
    return sums.select("query_id", F.when(F.col("n") == 0, 0).otherwise(F.least(F.greatest(k, F.lit(1)), F.col("n"))).cast("int").alias("k"))


def ratio_count(hits: DataFrame, min_gap: float = 3.0, eps: float = 1e-10, upto: Column | None = None) -> DataFrame:
    """(query_id, k): rows before the earliest largest ratio of neighbours, if it reaches ``min_gap``; else all rows looked at.

    Rows are looked at up to the first one at the noise floor ``eps``, itself included;
    a score of 0 there makes an endless ratio, a negative one none.
    """
    looked = hits if upto is None else hits.filter(F.col("rank") <= upto)
    before = F.lag("score").over(Window.partitionBy("query_id").orderBy("rank"))
    looked = looked.withColumn("before", before).filter(F.col("before").isNull() | (F.col("before") > eps))
    gap = F.when(F.col("score") == 0, F.lit(float("inf"))).when(F.col("score") > 0, F.col("before") / F.col("score"))
    gaps = looked.withColumn("gap", F.when(F.col("before").isNotNull(), gap))
    top = gaps.groupBy("query_id").agg(F.count("*").alias("n"), F.max(F.struct("gap", (-F.col("rank")).alias("nth"))).alias("top"))
    return top.select("query_id", F.when(F.col("top.gap") >= min_gap, -F.col("top.nth") - 1).otherwise(F.col("n")).cast("int").alias("k"))


def prune(hits: DataFrame, max_cut: int = 30, min_gap: float = 1.5, eps: float = 1e-10) -> DataFrame:
    """Rows up to the smaller of the entropy and the ratio cut (``entropy_count``, ``ratio_count``); needs ``rank``.

    Only the first ``max_cut`` rows of a query can stay, so both cuts are windows over
    these few rows, dealt by query once.
    """
    columns = hits.columns
    whole = Window.partitionBy("query_id")
    s = F.when(F.col("score") > 0, F.col("score"))
    first = hits.filter(F.col("rank") <= (max_cut if max_cut > 0 else 30))
    first = first.withColumns({"_s": F.sum(s).over(whole), "_e": F.sum(s * F.log(s)).over(whole), "_n": F.count(s).over(whole)})
    k = F.ceil(F.round(F.exp(F.log("_s") - F.col("_e") / F.col("_s")), 9))
    first = first.filter(F.col("rank") <= F.when(F.col("_n") == 0, 0).otherwise(F.least(F.greatest(k, F.lit(1)), F.col("_n"))))
    before = F.lag("score").over(whole.orderBy("rank"))
    first = first.withColumn("_before", before)
    looked = F.col("_before").isNull() | (F.col("_before") > eps)
    gap = F.when(looked & F.col("_before").isNotNull(), F.when(F.col("score") == 0, F.lit(float("inf"))).when(F.col("score") > 0, F.col("_before") / F.col("score")))
    first = first.withColumns({"_top": F.max(F.struct(gap.alias("gap"), (-F.col("rank")).alias("nth"))).over(whole), "_looked": F.count_if(looked).over(whole)})
    keep = F.when(F.col("_top.gap") >= min_gap, -F.col("_top.nth") - 1).otherwise(F.col("_looked"))
    return first.filter(F.col("rank") <= keep).select(*columns)


def pivot_rows(candidates: DataFrame, vectors: DataFrame, o: Options) -> DataFrame:
    """Candidates and the sections near a query's best hit, for queries with few candidates and a strong anchor."""
    few = candidates.groupBy("query_id").agg(F.count("*").alias("n"))
    anchors = candidates.filter((F.col("rank") == 1) & (F.col("score") >= o.pivot_min_anchor)).join(few.filter(F.col("n") <= o.pivot_min_results), "query_id")
    anchors = anchors.select("query_id", F.col("best_vec").alias("vec"), F.col("score").alias("anchor_score"))
    near = top_sections(vectors, anchors.select("query_id", "vec"), o.pivot_max, o.floor).drop("rank")
    new = near.join(candidates.select("query_id", *SECTION), ["query_id", *SECTION], "left_anti")
    new = new.join(anchors.select("query_id", "anchor_score"), "query_id").withColumn("score", F.col("score") * F.col("anchor_score")).drop("anchor_score")
    return ranked(candidates.drop("rank").unionByName(new))


def centroids(candidates: DataFrame) -> DataFrame:
    """(query_id, centroid): mean of the candidates' best vectors, per component. Candidates of a query are few: the cut bounds them."""
    held = candidates.groupBy("query_id").agg(F.collect_list(F.struct("rank", "best_vec")).alias("all")).withColumn("all", F.transform(F.array_sort("all"), lambda c: c["best_vec"]))
    mean = lambda i: F.aggregate("all", F.lit(0.0), lambda a, v: a + v[i].cast("double")) / F.size("all")
    return held.select("query_id", F.transform(F.sequence(F.lit(0), F.size(F.col("all")[0]) - 1), mean).alias("centroid"))


def rerank_weights(candidates: DataFrame, queries: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(query_id, query_vec, weights, weak, skip): components where query and centroid agree; too many weak ones skip the rerank."""
    q = queries.select("query_id", F.col("vec").alias("query_vec"))
    w = centroids(candidates).join(q, "query_id").withColumn("weights", F.zip_with("query_vec", "centroid", lambda a, b: F.greatest(a.cast("double") * b, F.lit(0.0))))
    w = w.withColumn("weak", F.size(F.filter("weights", lambda x: x == 0)))
    return w.select("query_id", "query_vec", "weights", "weak", (F.col("weak") >= F.floor(F.size("weights") * threshold)).alias("skip"))


def rerank(candidates: DataFrame, hits: DataFrame, queries: DataFrame, o: Options) -> DataFrame:
    """Candidates and close further hits with ``rerank_score``; queries that skip keep null."""
    weights = rerank_weights(candidates, queries, o.rerank_threshold)
    last = candidates.groupBy("query_id").agg(F.min("score").alias("last"))
    rest = hits.join(candidates.select("query_id", *SECTION), ["query_id", *SECTION], "left_anti").join(last, "query_id").filter(F.col("score") >= o.extension_ratio * F.col("last"))
    more = rest.withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).filter(F.col("nth") <= o.extension_max).drop("nth", "last")
    pool = candidates.withColumn("extra", F.lit(False)).unionByName(more.withColumn("extra", F.lit(True))).join(weights, "query_id")
    pool = pool.filter(~F.col("skip") | ~F.col("extra"))
    return pool.withColumn("rerank_score", F.when(~F.col("skip"), weighted_score(F.col("best_vec"), F.col("query_vec"), F.col("weights")))).drop("query_vec", "weights", "weak")


def stages(vectors: DataFrame, queries: DataFrame, o: Options = Options(), keep: Callable[[DataFrame, str], DataFrame] = materialize) -> dict[str, DataFrame]:
    """The tables that a search goes through: hits, candidates, pivoted, pool, reranked (with ``rerank``) and found.

    ``hits`` are as many of the best sections as later stages can look at: the cut, what
    a pivot may add, and the extension behind them. ``counts`` (not computed unless it is
    read) has the number and the range of all. ``keep`` writes a stage and reads it back.
    """
    looked_at = max(o.max_cut if o.max_cut > 0 else 30, o.min_rows) + o.extension_max + (o.pivot_max if o.pivot else 0)
    hits = keep(top_sections(vectors, queries, looked_at, o.floor), "hits")
    scores = best_scores(vectors, queries, o.floor)
    counts = scores.groupBy("query_id").agg(F.count("*").alias("hits"), F.min("score").alias("lowest"), F.max("score").alias("highest"))
    out = {"hits": hits, "counts": counts, "candidates": keep(prune(hits, o.max_cut, o.min_gap, o.eps), "candidates")}
    candidates = out["pivoted"] = keep(pivot_rows(out["candidates"], vectors, o), "pivoted") if o.pivot else out["candidates"]
    if o.rerank:
        pool = out["pool"] = keep(rerank(candidates, hits, queries, o), "pool")
        kept = pool.filter("skip").drop("rerank_score", "skip", "extra")
        again = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), F.asc("extra"), F.asc("rank"))
        new = pool.filter("not skip").withColumn("score", F.col("rerank_score")).withColumn("rank", F.row_number().over(again)).drop("rerank_score", "skip", "extra")
        new = out["reranked"] = keep(prune(new, 30, o.min_gap, o.eps), "reranked")
        few = new.groupBy("query_id").agg(F.count("*").alias("n")).filter(F.col("n") < o.min_rows).select("query_id")
        again_scores = pool.filter("not skip").select("query_id", *SECTION, "rerank_score")
        saved = hits.filter(F.col("rank") <= o.min_rows).join(few, "query_id", "left_semi").join(again_scores, ["query_id", *SECTION], "left")
        saved = saved.withColumn("score", F.coalesce("rerank_score", "score")).drop("rerank_score")
        out["found"] = kept.unionByName(new.join(few, "query_id", "left_anti")).unionByName(saved)
    else:
        out["found"] = candidates
    if o.floor is None or o.floor <= 0:
        # without a positive floor the cut may leave nothing of a query: its first hits then
        cut_away = hits.join(out["candidates"].select("query_id").distinct(), "query_id", "left_anti").filter(F.col("rank") <= o.min_rows)
        out["found"] = out["found"].unionByName(cut_away)
    return out


def _bounded(found: DataFrame, o: Options) -> DataFrame:
    most = o.max_rows if o.user_rows is None else min(o.max_rows, o.user_rows)
    return found.filter(F.col("rank") <= most).select("query_id", "rank", "document_id", "doc_ord", "section_idx", "range_start", "range_end", "score")


def search(vectors: DataFrame, queries: DataFrame, o: Options = Options(), keep: Callable[[DataFrame, str], DataFrame] = materialize) -> DataFrame:
    """Hits per query: rank, document_id, range, score. The stages' tables go when the result is written."""
    tables = stages(vectors, queries, o, keep)
    found = keep(_bounded(tables["found"], o), "found")
    discard(*{t.written_to: t for t in tables.values() if hasattr(t, "written_to")}.values())
    return found


def trace(queries: DataFrame, tables: dict[str, DataFrame], o: Options = Options()) -> DataFrame:
    """What each stage did, one row per query: sizes, score range, the cut and the score behind it, pivot and rerank, the final number."""
    size = lambda df, name: df.groupBy("query_id").agg(F.count("*").alias(name))
    hits = tables["counts"]
    cut = tables["candidates"].groupBy("query_id").agg(F.count("*").alias("pruned_to"), F.max("rank").alias("last_rank"), F.min("score").alias("cut_score"))
    out = queries.select("query_id").distinct().join(hits, "query_id", "left").join(cut, "query_id", "left")
    behind = tables["hits"].select("query_id", F.col("rank").alias("r"), F.col("score").alias("next_score"))
    out = out.join(behind.withColumn("last_rank", F.col("r") - 1).drop("r"), ["query_id", "last_rank"], "left").drop("last_rank")
    out = out.join(size(tables["pivoted"], "pivoted_to"), "query_id", "left")
    if "pool" in tables:
        out = out.join(tables["pool"].groupBy("query_id").agg(F.bool_or("skip").alias("rerank_skipped")), "query_id", "left").join(size(tables["reranked"], "reranked_to"), "query_id", "left")
    out = out.join(size(_bounded(tables["found"], o), "final"), "query_id", "left")
    return out.fillna(0, subset=["hits", "pruned_to", "pivoted_to", "final"]).withColumn("pivot_added", F.col("pivoted_to") - F.col("pruned_to"))


def report(traced: DataFrame) -> DataFrame:
    """(query_id, report): the rows of ``trace`` as text, a line for each stage."""
    number = lambda c: F.format_string("%.3f", F.col(c))
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    n = F.col
    lines = [
        F.when(n("hits") == 0, "scored: 0 hits").otherwise(text("scored: ", n("hits"), " hits, ", number("lowest"), " to ", number("highest"))),
        F.when(n("hits") > 0, text("pruned: ", n("hits"), " to ", n("pruned_to"), F.when(n("next_score").isNotNull(), text(" (cut at ", number("cut_score"), ", next ", number("next_score"), ")")).otherwise(F.lit("")))),
        F.when(n("pivot_added") > 0, text("pivot: ", n("pivot_added"), " added")),
    ]
    if "rerank_skipped" in traced.columns:
        lines.append(F.when(n("rerank_skipped"), "rerank: skipped").when(n("reranked_to").isNotNull(), text("rerank: ", n("reranked_to"), " left")))
    return traced.select("query_id", F.concat_ws("\n", *lines, text("final: ", n("final"))).alias("report"))


def union_hits(hits: DataFrame) -> DataFrame:
    """One row per (query, document, range) over a query's segments: the best score, then the earliest segment; ranked."""
    key = ["query_id", "document_id", "range_start", "range_end"]
    best = hits.groupBy(*key).agg(F.max(F.struct("score", (-F.col("segment_idx")).alias("nth"))).alias("best")).select(*key, "best.score", (-F.col("best.nth")).alias("segment_idx"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "segment_idx", "document_id", "range_start", "range_end")
    return best.withColumn("rank", F.row_number().over(order))


def resolve(hits: DataFrame, sources: DataFrame, keep_missing: bool = False) -> DataFrame:
    """Hits with their ``section_text``; unknown documents and impossible ranges give null, dropped unless asked for."""
    s, e = F.col("range_start"), F.col("range_end")
    joined = hits.join(sources.select("document_id", F.col("content")), "document_id", "left")
    valid = (s >= 0) & (e >= s) & (e <= F.length("content"))
    out = joined.withColumn("section_text", F.when(valid, F.substring(F.col("content"), s + 1, e - s))).drop("content")
    return out if keep_missing else out.filter(F.col("section_text").isNotNull())


def distribution(hits: DataFrame) -> DataFrame:
    """Per query: n, lowest, highest, mean, stddev, entropy (bits), its maximum, and a label."""
    total = F.sum("score").over(Window.partitionBy("query_id"))
    p = F.col("score") / total
    t = hits.withColumn("p", p).groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("lowest"), F.max("score").alias("highest"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("stddev"), F.sum(F.when(F.col("p") > 0, -F.col("p") * F.log2("p")).otherwise(0.0)).alias("entropy"))
    t = t.withColumn("max_entropy", F.log2("n"))
    part = F.when(F.col("n") == 1, 0.0).otherwise(F.col("entropy") / F.col("max_entropy"))
    return t.withColumn("label", F.when(part < 0.5, "peaky").when(part < 0.85, "moderate").otherwise("flat"))


def thresholds(hits: DataFrame) -> DataFrame:
    """Per query: knee (rank before the largest drop of at least a tenth of the top), first gap's label, rows above mean + 1 sd and above the mean."""
    w = Window.partitionBy("query_id").orderBy("rank")
    whole = Window.partitionBy("query_id")
    t = hits.withColumns({"drop": F.lag("score").over(w) - F.col("score"), "top": F.max("score").over(whole), "mean": F.avg("score").over(whole), "sd": F.stddev_pop("score").over(whole), "second": F.when(F.col("rank") == 2, F.col("score"))})
    a = t.groupBy("query_id").agg(F.max("top").alias("top"), F.max(F.struct("drop", (-F.col("rank")).alias("nth"))).alias("d"), F.max("second").alias("second"), F.count_if(F.col("score") >= F.col("mean") + F.col("sd")).alias("above_z"), F.count_if(F.col("score") >= F.col("mean")).alias("above_mean"))
    ratio = F.col("top") / F.col("second")
    gap = F.when(F.col("second").isNull(), None).when(ratio >= 1.5, "strong").when(ratio >= 1.2, "moderate").otherwise("weak")
    return a.select("query_id", F.when(F.col("d.drop") >= 0.1 * F.col("top"), -F.col("d.nth") - 1).cast("int").alias("knee"), gap.alias("gap"), "above_z", "above_mean")


def rank_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Old and new rank of every section in either result (full outer)."""
    key = ["query_id", "document_id", "range_start", "range_end"]
    return before.select(*key, F.col("rank").alias("old_rank")).join(after.select(*key, F.col("rank").alias("new_rank")), key, "full").withColumn("moved", F.col("old_rank") - F.col("new_rank"))


def rerank_effect(before: DataFrame, after: DataFrame, top: int = 5) -> DataFrame:
    """Per query: how many of the first five stay, and what that makes of the rerank."""
    key = lambda t, name: t.filter(F.col("rank") <= top).groupBy("query_id").agg(F.collect_set(F.struct("document_id", "range_start", "range_end")).alias(name))
    both = key(before, "a").join(key(after, "b"), "query_id").withColumn("kept", F.size(F.array_intersect("a", "b")))
    return both.select("query_id", "kept", F.when(F.col("kept") >= 4, "cosmetic").when(F.col("kept") >= 2, "partial").otherwise("substantive").alias("effect"))


def serialize(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, context): the query, its tone and intents, and its results as one block of text."""
    row = F.concat(F.format_string("- %.3f,", F.round("score", 6)), "document_id", F.lit(",["), F.col("range_start").cast("string"), F.lit(","), F.col("range_end").cast("string"), F.lit("],"), F.trim(F.regexp_replace("section_text", r"\s+", " ")))
    rows = hits.select("query_id", F.struct("rank", row.alias("line")).alias("r")).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["line"]).alias("lines"))
    q = queries.join(rows, "query_id", "left").withColumn("lines", F.coalesce("lines", F.array().cast("array<string>")))
    tone = F.when(F.col("level").isNotNull(), F.concat(F.lit("Frustration: "), F.format_string("%.2f", "frustration"), F.lit(" ("), F.col("level"), F.lit(")")))
    head = F.concat(F.lit("Results:["), F.size("lines").cast("string"), F.lit("]{score,documentId,range:[start,end],sectionText}:"))
    return q.select("query_id", F.concat_ws("\n", F.concat(F.lit("User query: "), "text"), tone, F.concat(F.lit("User intent: "), F.array_join("intents", ", ")), head, F.array_join("lines", "\n")).alias("context"))


def classify(vectors: DataFrame, anchors: DataFrame, open_label: str = "TECHNICAL", base: float = 0.5, preference: float = 0.10, margin: float = 0.1, least: float = 0.4, second: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Anchor classifier: ``vectors(query_id, vec)`` against ``anchors(label, vec)``; an anchor's ``anchor_id``, if given, is not its own query.

    Class score: best cosine. The open label, when it has no anchors, scores
    ``base`` less the best other. Confidence is the lead over the runner-up. Another
    label that leads the open one by less than ``preference`` gives way to it, with a
    confidence of 0 at most. Thin leads or weak best scores are low confidence; for
    these rows ``second`` (query_id, label, confidence), if given, decides.
    """
    per = best_cosines(anchors, vectors, BROADCAST_QUERIES, BLOCK_VECTORS)
    # one entry per label, ties to the open label and then to the later label
    entry = lambda score, label: F.struct(score.alias("score"), (label == open_label).alias("open"), label.alias("label"))
    t = per.groupBy("query_id").agg(F.collect_list(entry(F.col("score"), F.col("label"))).alias("scores"), F.max("score").alias("raw"), F.max(F.when(F.col("label") != open_label, F.col("score"))).alias("best_other"), F.max(F.when(F.col("label") == open_label, F.col("score"))).alias("own"))
    t = t.withColumn("open", F.coalesce("own", base - F.col("best_other")))
    added = F.when(F.col("own").isNull(), F.concat("scores", F.array(entry(F.col("open"), F.lit(open_label))))).otherwise(F.col("scores"))
    t = t.withColumn("ranked", F.sort_array(added, asc=False))
    top, runner_up = F.col("ranked")[0], F.try_element_at("ranked", F.lit(2))
    gives_way = (top["label"] != open_label) & (top["score"] - F.col("open") < preference)
    t = t.withColumn("label", F.when(gives_way, open_label).otherwise(top["label"]))
    t = t.withColumn("confidence", F.when(gives_way, F.col("open") - top["score"]).otherwise(top["score"] - F.coalesce(runner_up["score"], F.lit(0.0))))
    out = t.select("query_id", "label", "confidence", "best_other", F.col("open").alias("open_score"), ((F.col("confidence") < margin) | (F.col("raw") < least)).alias("low_confidence"))
    if second is None:
        return out
    again = second(vectors.join(out.filter("low_confidence").select("query_id"), "query_id", "left_semi")).select("query_id", F.col("label").alias("label2"), F.col("confidence").alias("confidence2"))
    out = out.join(again, "query_id", "left")
    took = F.col("label2").isNotNull()
    return out.select("query_id", F.coalesce("label2", "label").alias("label"), F.when(took, F.col("confidence2")).otherwise(F.col("confidence")).alias("confidence"), "best_other", "open_score", (F.col("low_confidence") & ~took).alias("low_confidence"), took.alias("used_second"))


def searchable(segments: DataFrame, label: str = "CONVERSATIONAL", least: float = 0.7) -> DataFrame:
    """Segments to search: all but those that are surely small talk."""
    return segments.filter(F.col("label").isNull() | (F.col("label") != label) | F.col("label_score").isNull() | (F.col("label_score") < least))
