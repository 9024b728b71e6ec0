"""Every section over a floor, and the best cosine of every label, against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.operators import blocked, search, store
from tessera.plans.queries import QUERIES, queries_of, r6_f32, vectors_of

QUERY = "query_id long, vec array<float>"


def key(row):
    return tuple(str(x) for x in row)


@pytest.mark.parametrize("floor", [None, 0.0, 0.4])
@pytest.mark.parametrize("chunk, block", [(4096, 4096), (3, 7)])
def test_best_sections_match_a_join_of_all_pairs(spark, floor, chunk, block):
    r = np.random.default_rng(6)
    rows = [(f"d{i // 40}", i // 40, (i * 7) % 40 // 4, 0, 99, i, np.round(r.normal(size=4), 1).tolist()) for i in range(300)]
    rows += [("d0", 0, 0, 0, 99, 1000 + i, [0.5, 0.5, 0.5, i % 5 / 10]) for i in range(60)]  # one section in many blocks, with ties
    rows += [("d9", 9, 77, 0, 99, i, [0.5, None, 0.5, x]) for i, x in enumerate((0.1, 0.2))]  # a section without a score
    rows += [("d8", 8, 1, 0, 99, i, [x, 0.1, 0.1, 0.1]) for i, x in enumerate((float("inf"), float("nan"), 1.0, float("-inf")))]
    rows += [("d8", 8, 2, 0, 99, i, [x, 0.1, 0.1, 0.1]) for i, x in enumerate((None, float("-inf")))]
    v = spark.createDataFrame(rows, store.VECTORS).repartition(5)
    q = spark.createDataFrame([(i, np.round(r.normal(size=4), 1).tolist()) for i in range(9)] + [(9, [1.0, None, 0.0, 0.0])], QUERY)
    pairs = v.crossJoin(q.withColumnRenamed("vec", "query_vec")).withColumn("score", V.score_f32(F.col("vec"), F.col("query_vec")))
    pairs = pairs if floor is None else pairs.filter(F.col("score") >= floor)
    best = pairs.groupBy("query_id", *blocked.SECTION).agg(F.max(F.struct("score", (-F.col("vec_idx")).alias("nth"), "vec")).alias("b"))
    want = best.select("query_id", *blocked.SECTION, "b.score", (-F.col("b.nth")).alias("vec_idx"), F.col("b.vec").alias("best_vec")).collect()
    got = blocked.best_sections(v, q, floor, True, chunk, block).collect()
    assert sorted(map(key, got)) == sorted(map(key, want)) and len(got) > 100


@pytest.mark.parametrize("chunk, block", [(4096, 4096), (4, 7)])
def test_best_cosines_match_a_join_of_all_pairs(spark, chunk, block):
    r = np.random.default_rng(7)
    rows = [(i, None if i % 11 == 0 else f"l{i % 4}", np.round(r.normal(size=3), 1).tolist()) for i in range(60)]
    rows += [(100 + i, "same", rows[i][2]) for i in range(20)] + [(200, "own", [1.0, 2.0, 3.0]), (201, "short", [1.0]), (202, "zero", [0.0]), (203, "gap", [None, 1.0, 1.0]), (204, "none", None), (None, "nobody", [1.0, 1.0, 1.0])]
    anchors = spark.createDataFrame(rows, "anchor_id long, label string, vec array<float>").repartition(3)
    q = spark.createDataFrame([(i, v) for i, _, v in rows if i is not None and i % 5 == 0], QUERY)
    pairs = anchors.withColumnRenamed("vec", "a").crossJoin(q).filter("anchor_id <> query_id").withColumn("norm", V.l2(F.col("a")) * V.l2(F.col("vec")))
    score = F.when(F.col("norm") == 0, 0.0).otherwise(V.dot(F.col("a"), F.col("vec")) / F.col("norm"))
    want = pairs.groupBy("query_id", "label").agg(F.max(score).alias("score")).collect()
    got = blocked.best_cosines(anchors, q, chunk, block).collect()
    assert sorted(map(key, got)) == sorted(map(key, want)) and len(got) > 50


@pytest.mark.parametrize("name", ["classifier_label", "search_report", "section_score_max", "distribution_stats", "entropy_effective_count", "adaptive_prune", "rerank_centroid", "rerank_weights", "ratio_effective_count", "search_ranked", "search_trace", "section_argmax_vector", "threshold_suggestions", "union_hits"])
def test_no_plan_makes_a_row_for_each_pair(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Join Cross" not in plan and "Join Inner\n" not in plan


def test_the_first_hits_are_all_that_a_cut_reads(spark):
    d = "/root/testdata/sf0.01"
    hits = search.ranked(search.score_sections(vectors_of(spark, d), queries_of(spark, d)))
    whole = search.prune(hits).select("query_id", "document_id", "range_start", "range_end", "rank", F.round("score", 6))
    assert sorted(map(tuple, QUERIES["adaptive_prune"](spark, d).collect())) == sorted(map(tuple, whole.collect()))
    assert sorted(map(tuple, QUERIES["entropy_effective_count"](spark, d).collect())) == sorted(map(tuple, search.entropy_count(hits).collect()))


def test_scores_are_rounded_as_decimals_are(spark):
    """Without a decimal number for each of the all-pairs rows: halves go away from zero, and zeros have no sign."""
    r = np.random.default_rng(6)
    halves = np.arange(-300, 300) / 128
    # floats beside a half of the seventh digit, and of every size
    beside = (np.arange(-2000, 2000) * 977 * 2 + 1) * 5e-7
    drawn = [r.normal(size=20_000) * 10.0**k for k in (-9, -6, -1, 0, 3, 8, 12)]
    odd = [0.0, -0.0, 1e-9, -1e-9, 5e-7, -5e-7, 4.9999997e-7, 1e9, -1e9, 999999999.0, 3e38, -3e38, 1e-45, np.inf, -np.inf, np.nan]
    values = np.concatenate([halves, np.nextafter(halves.astype(np.float32), np.float32(9)), np.nextafter(halves.astype(np.float32), np.float32(-9)), beside, *drawn, odd]).astype(np.float32).astype(np.float64)
    rows = spark.createDataFrame([(float(x),) for x in values] + [(None,)], "score double")
    bits = lambda c: F.hex(F.encode(c.cast("string"), "utf-8"))
    assert rows.filter(~bits(r6_f32("score")).eqNullSafe(bits(F.round("score", 6)))).count() == 0
    plan = QUERIES["section_score_max"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "FLOOR(" in plan
