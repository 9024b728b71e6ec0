"""Segmentation by columns against the loops."""

import random

from tests.brute import segmentation as loops

from tessera.operators import segments
from tessera.plans.queries import table
from tessera.sources.files import html_to_markdown

DOCS = "document_id string, content string"


def texts():
    r = random.Random(7)
    parts = ["# One", "## Two deep", "### 1.2 Three", "1. First", "1.2 Second thing", "A) Third", "IV. Fourth", "(§ 3.1) Fifth", "#", "plain words", "Dr. Who et al. said so", "see www.a.b/c.d. Then", "at 3.14 or 1,000.5 it", "e.g. this", "---", "===", "***", "été; été", "Is it? Yes!", "a: b", "日本 語。", " wide", "word " * 30]
    gaps = ["\n", "\n\n", "\n\n\n", " ", ". ", ".\n", "\r\n", "\n \n", "\n\n---\n\n", "\v", "; "]
    out = ["", "\n\n", "...", "---", "# Only\n\nx", "# A\n\n# B", "intro\n\n# A\n\none", None, "  1. x", "# A\n\n### B\n\n## C\n\nx\n\n# D", "  a.", "x\n---\ny\n\nz", "\U0001f642 a. \U0001f642\U0001f642 b"]
    return out + ["".join(r.choice(parts) + r.choice(gaps) for _ in range(r.randrange(1, 25))) for _ in range(300)]


def frame(spark):
    rows = [(f"d{i % 200}", t) for i, t in enumerate(texts())]
    return rows, spark.createDataFrame(rows, DOCS).repartition(3)


def test_segments_match_the_loops(spark):
    rows, docs = frame(spark)
    order = ("start", "end", "level", "title_offset", "blank_before", "rule_before", "newline")
    for headers in (False, True):
        want = [(d, i, *(s[c] for c in order)) for d, t in rows for i, s in enumerate(loops.segment(t, headers))]
        got = segments.segments(docs, headers=headers).select("document_id", "idx", *order).collect()
        assert sorted(map(tuple, got)) == sorted(want)


def test_sections_match_the_loops(spark):
    rows, docs = frame(spark)
    want = [(d, i, s["range_start"], s["range_end"], s["paragraph"], ", ".join(s["titles"]), s["content"], s["sentences"]) for d, t in rows for i, s in enumerate(loops.sections_of(t))]
    got = segments.sections(docs).select("document_id", "section_idx", "range_start", "range_end", "paragraph", "breadcrumbs", "content", "sentences").collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 300


def test_trees_match_the_loops(spark):
    rows, docs = frame(spark)
    want = [(d, *n) for d, t in rows for n in loops.tree_of(t)]
    assert sorted(map(tuple, segments.section_tree(docs).collect()), key=str) == sorted(want, key=str)


def test_subsegments_match_the_loops(spark):
    rows, docs = frame(spark)
    want = [(d, i, *x) for d, t in rows for i, s in enumerate(loops.segment(t)) for x in loops.subsegment(t, s["start"], s["end"])]
    assert sorted(map(tuple, segments.subsegments(docs).collect())) == sorted(want)


def test_all_documents_and_pages(spark):
    d = "/root/testdata/sf0.001"
    docs = table(spark, d, "documents").select("doc_id", "text")
    held = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = segments.segments(docs, "doc_id", "text", headers=True).select("doc_id", "idx", "start", "end", "level").collect()
    assert sorted(map(tuple, got)) == sorted((k, i, s["start"], s["end"], s["level"]) for k, t in held.items() for i, s in enumerate(loops.segment(t, True)))
    pages = table(spark, d, "pages").select("page_id", html_to_markdown("html").alias("content"))
    held = {r["page_id"]: r["content"] for r in pages.collect()}
    got = segments.sections(pages, "page_id").select("page_id", "section_idx", "range_start", "range_end", "content").collect()
    assert sorted(map(tuple, got)) == sorted((k, i, s["range_start"], s["range_end"], s["content"]) for k, t in held.items() for i, s in enumerate(loops.sections_of(t)))


def test_nothing(spark):
    empty = spark.createDataFrame([], DOCS)
    assert segments.segments(empty).count() == segments.sections(empty).count() == segments.section_tree(empty).count() == segments.subsegments(empty).count() == 0
