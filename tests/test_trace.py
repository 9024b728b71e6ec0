"""Events of stages, against aggregates over the stages."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import search, store
from tessera.operators.trace import Trace
from tessera.plans import answer

VECTORS = [(f"d{i % 3}", i % 3, i // 3, 10 * i, 10 * i + 5, 0, [1.0 - i / 20, i / 20]) for i in range(12)]


def test_events_equal_aggregates_over_the_stages(spark):
    v = spark.createDataFrame(VECTORS, store.VECTORS)
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0])], "query_id long, vec array<float>")
    seen = []
    traced = Trace(seen.append)
    tables = search.stages(v, q, search.Options(pivot=True, pivot_min_anchor=0.1, pivot_min_results=50), traced.keep)
    assert seen == traced.events and [e["stage"] for e in seen] == ["hits", "candidates", "pivoted", "pool", "reranked"]
    for e in seen:
        t = tables[e["stage"]].agg(F.count("*"), F.count_if(F.col("rank") == 1), F.min("score"), F.max("score")).first()
        assert (e["rows"], e["queries"], e["lowest"], e["highest"]) == tuple(t) and e["missing"] is None
    table = traced.table(spark)
    assert table.count() == 5 and [r[0] for r in table.orderBy("nth").select("stage").collect()] == [e["stage"] for e in seen]
    assert traced.report().startswith(f"hits: {seen[0]['rows']} rows for 2 queries, ")


def test_nothing_found(spark):
    traced = Trace()
    v = spark.createDataFrame(VECTORS, store.VECTORS)
    q = spark.createDataFrame([(1, [0.0, 0.0])], "query_id long, vec array<float>")
    assert search.search(v, q, keep=traced.keep).count() == 0
    assert [e["rows"] for e in traced.events] == [0] * 5 and traced.events[0]["lowest"] is None
    assert traced.table(spark).count() == 5


def test_segments_union_and_resolution(spark):
    texts = ["how do I reset the boiler", "what does the valve do"]
    sources = spark.createDataFrame([("a|b", "x" * 40), ("c|d", "y" * 5)], "document_id string, content string")
    encoder = lambda text: F.when(text.contains("boiler"), F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0))).cast("array<float>")
    v = spark.createDataFrame([("a|b", 0, 0, 0, 30, 0, [1.0, 0.0]), ("c|d", 1, 0, 0, 30, 0, [0.9, 0.1])], store.VECTORS)
    analyzed = answer.analyze(spark.createDataFrame(list(enumerate(texts)), "query_id long, text string"))
    traced = Trace()
    found = answer.find(analyzed, v, sources, options=search.Options(rerank=False), encoder=encoder, traced=traced)
    by_stage = {e["stage"]: e for e in traced.events}
    assert list(by_stage) == ["segments", "hits", "candidates", "found", "united", "resolved"]
    assert by_stage["segments"]["rows"] == 2 and by_stage["resolved"]["missing"] == 1
    assert [r["document_id"] for r in found.collect()] == ["a|b"]
    plain = answer.find(analyzed, v, sources, options=search.Options(rerank=False), encoder=encoder)
    assert sorted(map(tuple, plain.select("query_id", "document_id", "rank").collect())) == sorted(map(tuple, found.select("query_id", "document_id", "rank").collect()))


@pytest.mark.parametrize("column, key", [("rank", "queries"), ("score", "lowest"), ("section_text", "missing")])
def test_metrics_follow_the_columns(spark, column, key):
    traced = Trace()
    traced.keep(spark.createDataFrame([(1,), (None,)], "other long").withColumn(column, F.col("other").cast("string" if column == "section_text" else "double")), "s")
    assert traced.events[0]["rows"] == 2 and traced.events[0][key] is not None
