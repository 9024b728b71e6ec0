"""Rules at the edges of search, content statistics and encoders."""

import pandas as pd
from pyspark.sql import functions as F

from tessera.functions import encoders
from tessera.operators import search, store, usage


def test_a_search_whose_cut_leaves_nothing_gives_the_first_hits(spark):
    v = spark.createDataFrame([(f"d{i}", i, 0, 0, 9, 0, [-0.1 * i, 1.0]) for i in range(1, 6)], store.VECTORS)
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "query_id long, vec array<float>")
    for rerank in (True, False):
        got = search.search(v, q, search.Options(floor=None, rerank=rerank)).orderBy("query_id", "rank").collect()
        assert [(r["document_id"], r["rank"]) for r in got if r["query_id"] == 1] == [("d1", 1), ("d2", 2), ("d3", 3)]
        assert [r for r in got if r["query_id"] == 2]
        assert search.search(v, q, search.Options(floor=None, rerank=rerank, user_rows=2)).filter("query_id = 1").count() == 2
    assert search.search(v, q).filter("query_id = 1").count() == 0


def test_content_stats_say_whether_anything_is_cached(spark):
    items = spark.createDataFrame([("a", "one two", False), ("a", "x", True), ("b", "y", None), ("b", "", False)], "k string, text string, cache boolean")
    assert {r["k"]: r["cache"] for r in usage.content_stats(items, "text", "k").collect()} == {"a": True, "b": False}
    assert "cache" not in usage.content_stats(items.drop("cache"), "text", "k").columns


def test_encoders_normalise_texts_as_told(spark):
    seen = spark.createDataFrame([(1, "  A_b!! c "), (2, None)], "i long, text string")
    load = lambda: lambda texts: [[float(len(t))] for t in texts]
    size = lambda how: [r[0][0] for r in seen.select("i", encoders.model_encoder(F.col("text"), load, normalize_text=how).alias("v")).orderBy("i").select("v").collect()]
    assert size(False) == [10.0, 0.0] and size(True) == [5.0, 0.0]
    assert size(lambda c: F.concat(c, F.lit("xx"))) == [12.0, 2.0]
    assert pd.Series(size(True)).notna().all()
