"""Search, text, segments, sources, usage, flow and queue of the library."""

import json
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import vectors as V
from tessera.functions.encoders import hash_vector
from tessera.operators import flow, search, segments, spans, spelling, store, usage, validate
from tessera.plans import answer
from tessera.plans.queries import QUERIES
from tessera.plans.sql import ORACLE_SQL
from tessera.sources import files
from tessera.streaming import queue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHECKED = ["vector_functions", "search_ranked", "adaptive_prune", "search_full", "union_hits", "threshold_suggestions", "classifier_label", "store_remove", "interval_ops", "token_estimate", "collapse_punctuation", "document_id", "frustration_score", "multi_part", "resolve_range", "usage_collapse", "usage_cost", "parse_json_rows", "response_errors", "latency_percentiles", "retry_outcomes", "search_trace", "usage_normalize", "turn_faults", "media_type", "serialize_context", "search_pivot", "interval_overlap_join"]


def plain(rows):
    def one(x):
        if x is None or isinstance(x, bool | str):
            return str(x)
        return f"{float(x):.5f}" if isinstance(x, int | float) or hasattr(x, "__float__") else str(x)

    return sorted(tuple(map(one, r)) for r in rows)


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_sql(spark, name):
    got = QUERIES[name](spark, SF)
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert plain(got.select(*columns).collect()) == plain(want.select(", ".join(f'"{c}"' for c in columns)).fetchall())


def hits(spark, scores):
    return spark.createDataFrame([(1, i + 1, float(s)) for i, s in enumerate(scores)], "query_id int, rank int, score double")


@pytest.mark.parametrize("scores,entropy,kept", [((0.85, 0.82, 0.80, 0.20, 0.15), 5, 3), ((0.9, 0.01, 0.01, 0.01), 2, 1), ((0.85, 0.80, 0.75, 0.70), 4, 4), ((0.866, 0.540, 0.537, 0.517, 0.512), 5, 1), ((0.5,), 1, 1)])
def test_adaptive_cut(spark, scores, entropy, kept):
    h = hits(spark, scores)
    assert search.entropy_count(h).first()["k"] == entropy
    assert search.prune(h).count() == kept


def test_search_bounds(spark):
    r = np.random.default_rng(0)
    rows = [(f"d|{i}", i, 0, 0, 5, j, (r.normal(size=6) / 2).tolist()) for i in range(40) for j in range(2)]
    vectors = spark.createDataFrame(rows, store.VECTORS)
    q = spark.createDataFrame([(1, [0.6, 0.8, 0.0, 0.0, 0.0, 0.0]), (2, [0.0] * 6)], "query_id int, vec array<float>")
    for o in (search.Options(), search.Options(pivot=True, pivot_min_results=50, pivot_min_anchor=0.1), search.Options(user_rows=2)):
        got = search.search(vectors, q, o).collect()
        assert all(x["query_id"] == 1 for x in got) and len(got) <= (o.user_rows or 12)
        assert len({(x["document_id"], x["range_start"]) for x in got}) == len(got)
    assert search.search(store.create(spark), q).count() == 0


def test_vector_edge_cases(spark):
    row = spark.range(1).select(V.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))), V.normalized(F.array(F.lit(0.0))), V.intersect(V.interval(F.lit(5), F.lit(1)), V.interval(F.lit(4), F.lit(9)))["end"], V.offsets(F.array(*map(F.lit, (2, 3, 4))))).first()
    assert list(row) == [0.0, [0.0], 5, [0, 2, 5]]


@pytest.mark.parametrize("text,greeting,query", [("Hello! What is it?", True, "What is it?"), ("thanks for it", False, "thanks for it"), ("hello", True, ""), ("It works. Thank you!", True, "It works."), ("a. hi there! b", True, "a. b")])
def test_peel_greeting(spark, text, greeting, query):
    assert tuple(spark.range(1).select(T.peel_greeting(F.lit(text))).first()[0]) == (greeting, query)


def test_greedy_split(spark):
    split = lambda t: spark.range(1).select(T.greedy_split(F.lit(t))).first()[0]
    assert split("Hello, what is it? Why so and how long") == ["Hello", "what is it?", "Why so", "how long"]
    assert split("Dr. Smith wrote this. Also see that") == ["Dr. Smith wrote this.", "Also see that"]
    assert split("") == [""]


def test_text_odds_and_ends(spark):
    t = lambda c: spark.range(1).select(c).first()[0]
    assert t(T.document_id(F.lit("a/b c/Éx_Y.v1.md"))) == "b_c|ex_y_v1"
    assert t(T.document_id(F.lit("x.md"))) == "root|x" and t(T.document_id(F.lit("a|b"))) == "a|b"
    assert t(T.file_name_of(F.lit("text\n# My **Best** Title\n"))) == "my_best_title.md"
    assert t(T.frustration(F.lit("please help me now"))["urgent"]) == ["please help", "now"]
    assert t(T.frustration(F.lit("wtf"))["score"]) == 0.5
    assert t(T.strip_fences(F.lit("```json\n{}\n```"))) == "{}"
    assert t(T.is_delimiter(F.lit("----"))) and not t(T.is_delimiter(F.lit("-*-")))
    assert t(F.array_join(T.split_words(F.lit("a, b")), "|")) == "a|, |b"


MARKDOWN = "# One\n\nHello there. See e.g. this, 3.14.\n\n## Two\n\nWords of the second part; more.\n\n1.2 Three\n\nEnd"


def test_segments_and_sections(spark):
    def found(text, headers=False):
        return segments.segments(spark.createDataFrame([("d", text)], "document_id string, content string"), headers=headers).orderBy("idx").collect()

    got = found(MARKDOWN, True)
    assert [MARKDOWN[s["start"] : s["end"]] for s in got] == ["# One", "Hello there", "See e.g. this, 3.14", "## Two", "Words of the second part", "more", "1.2 Three", "End"]
    assert [s["level"] for s in got] == [1, 0, 0, 2, 0, 0, 2, 0]
    assert found("# Foo\nbar", True)[0]["level"] == 0 and found("---") == [] and found(None) == []
    assert [MARKDOWN2["text"][s["start"] : s["end"]] for s in found(MARKDOWN2["text"])] == MARKDOWN2["want"]
    df = spark.createDataFrame([("d|a", MARKDOWN), ("d|b", None)], "document_id string, content string")
    rows = segments.sections(df).orderBy("section_idx").collect()
    assert [r["breadcrumbs"] for r in rows] == ["One", "One, Two", "One, Three"] and rows[0]["bucket"] == "short"
    vectors = answer.knowledge_base(df)
    assert vectors.count() == 6 and len(vectors.first()["vec"]) == 64


MARKDOWN2 = {"text": "Hello world.\nStill same", "want": ["Hello world", "Still same"]}


def test_chunks_of_medium_texts(spark):
    sentences = [f"{'word ' * 30}s{i}".strip() for i in range(6)]
    got = spark.range(1).select(segments.chunks(F.lit("all"), F.array(*map(F.lit, sentences)), F.lit("medium"))).first()[0]
    assert [c.count(". ") for c in got] == [1, 1, 1] and got[0] == ". ".join(sentences[:2])


def test_vector_files_round_trip(spark, tmp_path):
    v = spark.createDataFrame([("t|a", 0, s, s * 5, s * 5 + 5, i, [s + 0.5, float(i)]) for s in range(2) for i in range(3)] + [("t|é", 1, 0, 0, 1, 0, [1.0, 2.0])], store.VECTORS)
    assert files.write_vector_files(v, str(tmp_path)) == 2
    back = files.read_vector_files(spark, str(tmp_path))
    assert sorted(map(str, back.drop("doc_ord").collect())) == sorted(map(str, v.drop("doc_ord").collect()))
    with pytest.raises(ValueError):
        files.parse_vectors(b"\0" * 60)


def test_sources(spark, tmp_path):
    (tmp_path / "th").mkdir()
    (tmp_path / "th" / "One.md").write_text("# One\n\nText")
    (tmp_path / "x.txt").write_text("x")
    got = files.read_sources(spark, str(tmp_path)).collect()
    assert [(r["document_id"], r["content"]) for r in got] == [("th|one", "# One\n\nText")]
    assert files.list_files(spark, str(tmp_path)).count() == 2 and files.list_files(spark, str(tmp_path), blacklist=("th",)).count() == 1
    (tmp_path / "th" / "one!.md").write_text("again")
    with pytest.raises(ValueError):
        files.read_sources(spark, str(tmp_path))
    assert files.to_markdown("<head><title>t</title></head><h2>A</h2><p>b <i>c</i></p><ul><li>d</li></ul>") == "## A\n\nb c\n\n- d"


def test_json_repair_and_themes(spark):
    assert json.loads(validate.first_json('Sure: ```json\n{"a": "x}\\"", "b": [1]}\n``` bye')) == {"a": 'x}"', "b": [1]}
    assert validate.first_json("none") is None
    cases = {
        "[]": "[]", "": None, 'As noted in [1], {"answer": 1}': None, '```json\n{"a": "}"}\n``` ': '{"a": "}"}', "[1, 2] **Reasoning:** [3]": "[1, 2]", '{"a": [1, 2': None, '{"a": "x': None, '  \n{"a":1}x': '{"a": 1}', "{]}": None, '"x"': None,
        '{"output": {"text": "```json\\n{\\"a\\": 1}\\n```"}, "usage": 1}': '{"a": 1}', '{"output": 3}': '{"output": 3}', '{"output": {"text": "plain"}}': None, '{"a\\\\": "]"} [': '{"a\\\\": "]"}',
    }
    assert {k: validate.first_json(k) for k in cases} == cases
    for hostile in ("[" * 20_000, "[" * 500_000, '{"a":' * 20_000 + "1" + "}" * 20_000, '{"' + "\\" * 300_000, " " * 300_000 + "x" + " " * 300_000 + "y", '{"output": {"text": ' * 3_000):
        assert validate.first_json(hostile) is None
    replies = spark.createDataFrame([("[" * 20_000,), ('{"a": 1} bye',), (None,)], "t string")
    assert [r[0] for r in replies.select(validate.extract_json("t")).collect()] == [None, '{"a": 1}', None]
    t = spark.range(1).select(validate.theme_errors(F.lit('{"theme":"z","confidence":2,"rationale":""}'), ["a"]), validate.theme_errors(F.lit('{"theme":"a","confidence":1,"rationale":"r"}'), ["a"])).first()
    assert len(t[0]) == 3 and t[1] == []


def test_spans_and_thresholds(spark):
    m = np.array([[1.0, 0.0], [2.0, 0.0], [3.0, 0.0]])
    assert abs(abs(spans.first_component(m)[0]) - 1) < 1e-6 and np.allclose(spans.reconstruct(np.array([2.0, 5.0]), np.array([1.0, 0.0])), [2, 0])
    assert math.isclose(sum(w for _, w in spans.representative(np.eye(3), np.ones(3))), 1, abs_tol=1e-6)
    t = spark.range(1).select(spans.gap_threshold(F.array(*map(F.lit, (0.6, 0.3, 0.05)))), spans.entropy_threshold(F.array(*map(F.lit, (0.5, 0.5, 0.0))))).first()
    assert list(t) == [0.3, 0.5]


def test_flow():
    now = [0.0]
    bucket = flow.Bucket(2, 2, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s))
    for _ in range(6):
        bucket.acquire()
    assert abs(now[0] - 2.0) < 1e-9
    seen = []
    assert flow.attempt(lambda p: seen.append(p) or "bad", "x", lambda t: ["no"], 2, "f") == ("f", True, 3, ["no"] * 3, True)
    assert flow.merge_config({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}
    assert flow.without_secrets({"api_key": "k", "x": 1}) == {"api_key": "***", "x": 1} and flow.poll_wait(10, 5, False) == 8


def test_answers(spark):
    sources = spark.createDataFrame([("d|a", "# Cats\n\nCats sleep all day long."), ("d|b", "# Dogs\n\nDogs run in the park.")], "document_id string, content string")
    vectors = answer.knowledge_base(sources)
    q = spark.createDataFrame([(1, "hello"), (2, "Cats sleep all day long"), (3, None)], "query_id int, text string")

    def make():
        return lambda prompt: '{"answer":[{"text":"ok"}],"followUpQuestions":["q"]}'

    got = {r["query_id"]: r for r in answer.answer(q, vectors, sources, make, concurrency=2).collect()}
    assert got[1]["answer"].startswith("Hello") and got[2]["valid"] and got[2]["attempts"] == 1
    prompt = answer.contexts(answer.analyze(q), answer.find(answer.analyze(q), vectors, sources)).filter("query_id = 2").first()[1]
    assert prompt.startswith("User query: Cats sleep") and "d|a" in prompt
    assert hash_vector("") == [0.0] * 64


def test_queue(spark, tmp_path):
    at = {k: str(tmp_path / k) for k in ("in", "out", "dead", "cp")}
    queue.enqueue(spark.createDataFrame([("a", 0), ("b", 0), ("c", 4), (None, 0)], "path string, retries int"), at["in"])
    work = lambda b: b.withColumn("ok", (F.col("path") == "a") | (F.col("retries") > 0) & (F.col("path") == "b")).withColumn("error", F.lit("boom"))
    for _ in range(2):
        queue.consume(spark, at["in"], at["out"], at["dead"], at["cp"], work).awaitTermination()
    done = spark.read.parquet(at["out"]).select("path", "retries", "outcome").collect()
    assert sorted(map(tuple, done)) == [("a", 0, "succeeded"), ("b", 1, "succeeded"), ("c", 5, "failed")]
    assert [r["last_error"] for r in spark.read.json(at["dead"]).collect()] == ["boom"]


def test_entry_without_training_operators():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_pca_folds_a_large_group_in_blocks(spark, monkeypatch):
    r = np.random.default_rng(6)
    rows = [(g, i, [float(x) for x in r.normal(size=4) * [3, 1, 1, 1]]) for g, n in (("hot", 300), ("small", 5), (None, 7)) for i in range(n)] + [("same", i, [1.0] * 4) for i in range(3)]
    df = spark.createDataFrame(rows, "label string, id long, v array<float>")
    most, fold = spark.sparkContext.accumulator(0), spans.fold_component
    folds = spark.sparkContext.accumulator(0)

    def counted(vectors, state, stop=1e-9, centering=True):
        folds.add(1)
        most.add(int(len(vectors) > 100))
        return fold(vectors, state, stop, centering)

    monkeypatch.setattr(spans, "fold_component", counted)
    got = {x["label"]: x["component"] for x in spans.pca(df.repartition(3), "label", "id", "v", block_rows=30).collect()}
    monkeypatch.undo()
    assert set(got) == {"hot", "small", "same", None} and folds.value > 6 and most.value == 0
    for g in got:
        m = np.array([v for label, _, v in rows if label == g], np.float32).astype(float)
        assert np.allclose(got[g], spans.first_component(m, stop=1e-9))


def test_error_tally_keeps_long_messages_apart(spark, tmp_path):
    rows = [("a", '{"k": 76, "reason": "slow"}'), ("a", '{"k": 76, "reason": "lost"}'), ("a", '{"k": 76, "reason": "lost"}'), ("b", None)]
    spark.createDataFrame(rows, "event_type string, props string").write.parquet(str(tmp_path / "events.parquet"))
    got = sorted(tuple(r) for r in QUERIES["error_tally"](spark, str(tmp_path)).collect() if r["message"])
    assert got == [("a", rows[1][1], 2), ("a", rows[0][1], 1)]
    got, con = QUERIES["error_tally"](spark, SF), duckdb.connect()
    con.sql(f"create view events as select * from '{SF}/events.parquet'")
    assert plain(got.collect()) == plain(con.sql(ORACLE_SQL["error_tally"]).fetchall())


def test_text_queries_read_whole_documents(spark, tmp_path):
    rows = [(1, "One of the words. Then more; and the end."), (2, None), (3, ""), (4, "the sentence of it. " * 3000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spelled = {r["doc_id"]: r["t"] for r in QUERIES["spell_map"](spark, str(tmp_path)).collect()}
    assert set(spelled) == {1, 2, 3, 4} and spelled[2] is None and spelled[4].count("THE sentence oF it.") == 3000
    parts = QUERIES["text_subsegments"](spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in parts} == {1, 4} and max(r["end"] for r in parts if r["doc_id"] == 4) >= 20 * 2999


def unit(*x):
    return np.array(x, float) / np.linalg.norm(x)


def test_representative_spans_on_known_geometry():
    x, y, z = np.eye(4)[:3]
    rows = lambda v, t, **o: dict(spans.representative(np.array(v), t, **o))
    assert rows([x], x) == {0: 1.0} and rows([-x], x) == {} and rows([x], 0 * x) == {}
    assert set(rows([x, -x, unit(0.5, 0.87, 0, 0)], x, support=0)) <= {0, 2}
    for v in ([x, y, z], [x, x, x]):
        assert np.allclose(list(rows(v, unit(1, 1, 1, 0) if v[1] is y else x).values()), 1 / 3, atol=1e-3)
    r = np.random.default_rng(3)
    v = np.array([unit(*q) for q in r.normal(size=(30, 5)) + 0.5])
    beta = r.random(30)
    linear = spans.representative(v, v.mean(0), beta)
    assert dict(linear) == pytest.approx(dict(spans.representative(v, v.mean(0), beta, edge=lambda s: np.maximum(1 - s, 0))))
    # the matrix form, written out
    rel = 2 * v @ v.mean(0)
    keep = np.flatnonzero(rel > 0)
    m = np.maximum(1 - v[keep] @ v[keep].T, 0) + beta[keep].max()
    np.fill_diagonal(m, beta[keep].max() - beta[keep])
    a = np.full(len(keep), 1 / len(keep))
    for _ in range(300):
        new = a * (m @ a + rel[keep])
        new /= new.sum()
        done, a = np.abs(new - a).max() < 1e-5, new
        if done:
            break
    assert dict(linear) == pytest.approx({int(i): w for i, w in zip(keep, a) if w > 0.5 / 30})
    few = spans.representative(v, v.mean(0), beta, adaptive="entropy")
    assert {i for i, _ in few} <= {i for i, _ in linear} and dict(spans.representative(v, None, relevance=rel, beta=beta)) == pytest.approx(dict(linear))


def test_first_component_follows_the_running_update():
    r = np.random.default_rng(4)
    v = r.normal(size=(40, 3)) * [3, 1, 1]
    mean, axis, before, used = v[0].copy(), v[0] / np.linalg.norm(v[0]), 1.0, 1
    for k, x in enumerate(v[1:], 2):
        c, used = x - mean, k
        mean += c / k
        new = axis + c * (c @ axis) / k
        new /= np.linalg.norm(new)
        turned = 1 - abs(new @ axis)
        axis = new
        if turned < 0.01 and before < 0.01:
            break
        before = turned
    got = spans.fold_component(v, None)
    assert np.allclose(got[1], axis) and np.allclose(got[0], mean) and got[2] == used < 40
    assert np.allclose(spans.fold_component(v[7:], spans.fold_component(v[:7], None, 1e-9), 1e-9)[1], spans.first_component(v, 1e-9))


def test_classifier_margin_is_over_the_runner_up(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0])], "query_id long, vec array<double>")
    at = lambda c: [c, math.sqrt(1 - c * c), 0.0]
    anchors = spark.createDataFrame([("SUPPORT", at(0.8)), ("CONVERSATIONAL", at(0.75)), ("TECHNICAL", at(0.1))], "label string, vec array<double>")
    got = {r["query_id"]: r for r in search.classify(q, anchors).collect()}
    assert got[1]["label"] == "SUPPORT" and got[1]["confidence"] == pytest.approx(0.05) and got[1]["low_confidence"]
    assert got[2]["label"] == "TECHNICAL" and not got[2]["low_confidence"] or got[2]["confidence"] < 0.4
    near = spark.createDataFrame([("SUPPORT", at(0.6)), ("TECHNICAL", at(0.55))], "label string, vec array<double>")
    flipped = search.classify(q.limit(1), near).first()
    assert flipped["label"] == "TECHNICAL" and flipped["confidence"] == pytest.approx(-0.05)
    second = lambda rows: rows.select("query_id", F.lit("SUPPORT").alias("label"), F.lit(0.9).alias("confidence"))
    again = search.classify(q.limit(1), near, second=second).first()
    assert again["label"] == "SUPPORT" and again["used_second"] and not again["low_confidence"]


def test_cost_is_itemised(spark):
    row = "input_tokens long, output_tokens long, cache boolean, cache_hit boolean, cache_miss boolean, cached_tokens_read long, cached_tokens_created long, succeeded int, errored int, duration double"
    df = spark.createDataFrame([(1_000_000, 100_000, False, True, None, 500_000, 7, None, None, 1.0), (1_000_000, 0, True, False, True, 9, 200_000, 3, 0, 1.0), (None, None, None, None, None, None, None, None, None, None)], row)
    got = [r["cost"] for r in usage.with_cost(df, usage.RATES | {"batch_discount": 0.5}).collect()]
    assert [float(got[0][c]) for c in usage.ITEMS] == [3.0, 0.15, 0.0, 1.5, 4.65]
    assert [float(got[1][c]) for c in usage.ITEMS] == [1.5, 0.0, 0.375, 0.0, 1.875] and float(got[2]["total"]) == 0


def test_fixed_values_and_ids(spark):
    paths = ["a.yaml", "b.CSV", "c.html", "notes.toon", "md", "x-json", "d.docx"]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in paths], "p string").select(T.media_type(F.col("p"))).collect()]
    assert got == ["application/yaml", "application/csv", "text/plain", "text/toon", "text/markdown", "text/plain", "application/vnd.openxmlformats-officedocument.wordprocessingml.document"]
    levels = [r[0] for r in spark.createDataFrame([(x,) for x in (0.9, 0.5, 0.2, 0.1)], "s double").select(T.frustration_level(F.col("s"))).collect()]
    assert levels == ["very_frustrated", "frustrated", "mildly_frustrated", None]
    df = spark.createDataFrame([("up/My Theme/A b|md_2026-04-22T02-28-30-099Z.md", "other"), ("up/My Theme/A bmd_2026-04-22T02-28-30-099Z.md", "my theme"), ("plain.md", "other")], "p string, t string")
    got = df.select(T.document_id(F.col("p")), T.theme_conflict(F.col("p"), F.col("t")), T.document_id(F.col("p"), F.col("t"))).collect()
    assert [tuple(r) for r in got] == [("my_theme|a_b", True, "other|a_b"), ("my_theme|a_bmd_2026_04_22t02_28_30_099z", False, "my_theme|a_bmd_2026_04_22t02_28_30_099z"), ("root|plain", False, "other|plain")]
    with pytest.raises(Exception, match="conflict"):
        df.select(T.document_id(F.col("p"), F.col("t"), on_conflict="throw")).collect()
    assert "between" in segments.STOP_WORDS and "your" not in segments.STOP_WORDS


def test_ratio_cut_stops_at_the_noise_floor(spark):
    for scores, k in (((0.9, 0.8, 0.0, 0.0), 2), ((0.9, 0.8, -0.5), 3), ((0.0, 0.0), 1), ((0.9, 0.2, 1e-12, 1e-13), 2)):
        assert search.ratio_count(hits(spark, scores)).first()["k"] == k, scores


def test_search_refuses_other_dimensions_and_reports(spark):
    v = spark.createDataFrame([("a|b", 0, 0, 0, 5, 0, [1.0, 0.0]), ("a|c", 1, 0, 0, 5, 0, [0.9, 0.1])], "document_id string, doc_ord int, section_idx int, range_start int, range_end int, vec_idx int, vec array<float>")
    with pytest.raises(Exception, match="differ in length"):
        search.score_sections(v, spark.createDataFrame([(1, [1.0])], "query_id long, vec array<float>")).collect()
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [-1.0, 0.0])], "query_id long, vec array<float>")
    got = {r["query_id"]: r["report"] for r in search.report(search.trace(q, search.stages(v, q))).collect()}
    assert got[1].startswith("scored: 2 hits, 0.900 to 1.000\npruned: 2 to 2") and got[2] == "scored: 0 hits\nfinal: 0"


def test_load_and_add_paths(spark, tmp_path):
    for name, data in (("good/x", files.format_vectors("good|x", [(0, 4, np.eye(2))], 2)), ("more/y", files.format_vectors("more|y", [(0, 4, np.ones((1, 2)))], 2)), ("bad/z", b"junk")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / (name + ".bin")).write_bytes(data)
    at = lambda n: str(tmp_path / n)
    one = files.load_store(store.create(spark), at("good"))
    both, failures = files.add_paths(one, at("bad"), at("more"), at("nowhere"))
    assert [r["path"] for r in failures.collect()] == [at("bad"), at("nowhere")]
    assert {(r["document_id"], r["doc_ord"]) for r in both.collect()} == {("good|x", 0), ("more|y", 1)}
    assert files.load_store(both, at("more")).count() == 1 and files.load_store(both, at("more"), clear=False).count() == 4
    with pytest.raises(Exception, match="vector file|too short"):
        files.load_store(both, str(tmp_path))
    data = files.format_vectors("a|b", [(0, 4, np.eye(2))], 2)
    assert files.open_store(spark, data).count() == 2 and files.open_store(spark, at("good")).count() == 2 and files.open_store(spark, one).count() == 2
    with pytest.raises(ValueError, match="shorter"):
        files.parse_vectors(data[:-4])
    with pytest.raises(TypeError):
        files.open_store(spark, 3)


def test_section_tree_and_report(spark):
    text = "intro\n\n# A\n\none\n\ntwo\n\n## B\n\nthree\n\n# C\n\nfour"
    df = spark.createDataFrame([("d", text), ("e", "# Only\n\nx"), ("n", None), ("z", "")], "document_id string, content string")
    tree = segments.section_tree(df)
    rows = {k: [tuple(r)[1:] for r in tree.filter(F.col("document_id") == k).orderBy("node").collect()] for k in "denz"}
    assert [(r[0], r[1], r[2], r[4], r[7]) for r in rows["d"]] == [(0, None, 0, None, 1), (1, 0, 1, "A", 2), (2, 1, 2, "B", 1), (3, 0, 1, "C", 1)]
    assert rows["d"][2][5:7] == (text.index("## B"), text.index("# C")) and [(r[0], r[1], r[2], r[4]) for r in rows["e"]] == [(1, None, 0, "Only")]
    got = {r["document_id"]: r["report"] for r in segments.partition_report(tree).collect()}
    assert got["d"].split("\n")[2].startswith("    B [")


def test_polling_and_turns(spark):
    replies, waits = [(False, 200), RuntimeError("busy"), (False, 5), (True, 0)], []

    def look():
        r = replies.pop(0)
        if isinstance(r, Exception):
            raise r
        return r

    assert flow.poll(look, wait=10.0, sleep=waits.append) == 4 and waits == [10.0, 12.0, 18.0, pytest.approx(14.4)]
    with pytest.raises(TimeoutError):
        flow.poll(lambda: (False, 50), most=3, sleep=lambda _: None)
    with pytest.raises(RuntimeError, match="look 11"):
        flow.poll(lambda: 1 / 0, sleep=lambda _: None)
    t = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", " "), (3, 0, "assistant", "x"), (3, 1, "user", "y"), (4, 0, None, None)], "conv_id int, turn int, role string, text string")
    got = {r[0]: r[1] for r in flow.turn_faults(t).collect()}
    assert got[3] is None and "empty" in got[2] and "user" in got[1] and "user" in got[4]


def test_spelling_suggestions_match_brute_force(spark):
    known = [("boiler", 3), ("boilers", 1), ("water", 9), ("wader", 9), ("a", 1), (None, 2)]
    asked = ["boilr", "watr", "wter", "boilerss", "zzz", "water", "b", None, "watr"]
    got = {r["word"]: (r["suggestion"], r["distance"]) for r in spelling.suggest(spark.createDataFrame([(w,) for w in asked], "word string"), spark.createDataFrame(known, "word string, n long")).collect()}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    want = {}
    for w in {w for w in asked if w} - {k for k, _ in known}:
        near = sorted((distance(w, k), -n, k) for k, n in known if k and distance(w, k) <= 1)
        if near:
            want[w] = (near[0][2], near[0][0])
    assert got == want


def test_queue_runs_the_work_once(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def work(batch):
        def run(parts):
            for pdf in parts:
                calls.add(len(pdf))
                yield pdf.assign(ok=pdf["retries"] > 0, error="later")

        return batch.mapInPandas(run, f"{queue.ENTRY}, ok boolean, error string")

    folder = str(tmp_path / "queue")
    queue.enqueue(spark.createDataFrame([("a",), ("b",), ("c",)], "path string"), folder)
    for _ in range(2):
        queue.consume(spark, folder, str(tmp_path / "results"), str(tmp_path / "dead"), str(tmp_path / "checkpoint"), work).awaitTermination()
    assert calls.value == 6  # three that fail once and succeed then
    assert spark.read.parquet(str(tmp_path / "results")).filter("outcome = 'succeeded'").count() == 3


def test_many_queries_meet_in_blocks(spark, monkeypatch):
    r = np.random.default_rng(5)
    v = spark.createDataFrame([(f"d|{i % 5}", i % 5, i, 0, 5, 0, r.normal(size=4).tolist()) for i in range(40)], "document_id string, doc_ord int, section_idx int, range_start int, range_end int, vec_idx int, vec array<float>")
    q = spark.createDataFrame([(i, r.normal(size=4).tolist()) for i in range(11)], "query_id long, vec array<float>")
    want = sorted(map(tuple, search.search(v, q).collect()))
    monkeypatch.setattr(search, "BROADCAST_QUERIES", 3)
    monkeypatch.setattr(search, "BLOCK_VECTORS", 9)
    assert sorted(map(tuple, search.search(v, q).collect())) == want


def test_urgent_words_match_one_after_another(spark):
    import random
    import re

    r = random.Random(12)
    words = [w for phrase in T.URGENT for w in phrase.split(" ")] + ["x", "nowhere", "unbroken", "PLEASE", "Not", "away"]
    texts = ["".join(r.choice(words) + r.choice([" ", " ", " ", ", ", "! ", "-", "  "]) for _ in range(r.randrange(1, 14))).strip() for _ in range(1500)] + [""]

    def brute(text):
        rest, out = text.lower(), []
        for w in T.URGENT:
            pattern = rf"(?:(?<=\s)|^){w}(?=\s|$|[.,!?])" if " " in w else rf"(?<![A-Za-z0-9_]){w}(?![A-Za-z0-9_])"
            out += [w] * len(re.findall(pattern, rest))
            rest = re.sub(pattern, "\x01" * len(w), rest)
        return out

    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.urgent_hits(F.col("t")).alias("u")).collect()
    assert all(x["u"] == brute(x["t"]) for x in got), next((x["t"], x["u"], brute(x["t"])) for x in got if x["u"] != brute(x["t"]))
