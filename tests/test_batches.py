"""Batches of requests against a service in a folder."""

import json
import os
import uuid

import pytest

from tessera.streaming import batches


class FolderService:
    """Keeps batches as files; one ends at its n-th look. Requests are answered by what their prompts say."""

    def __init__(self, folder, looks=2):
        self.folder, self.looks = folder, looks

    def create(self, requests, key):
        for name in os.listdir(self.folder):
            if name.endswith(".json") and json.load(open(f"{self.folder}/{name}"))["key"] == key:
                return name[:-5]
        batch_id = uuid.uuid4().hex
        json.dump({"key": key, "requests": requests}, open(f"{self.folder}/{batch_id}.json", "w"))
        return batch_id

    def _answers(self, batch_id):
        out = []
        for r in json.load(open(f"{self.folder}/{batch_id}.json"))["requests"]:
            kind, found = r["prompt"], {"request_id": r["request_id"], "status": "succeeded", "text": "re: " + r["request_id"], "stop_reason": "end_turn", "input_tokens": 3, "output_tokens": 5}
            if kind == "error":
                found |= {"status": "errored", "error": "overloaded", "text": None}
            elif kind == "expired":
                found |= {"status": "expired", "text": None}
            if kind != "missing":
                out.append(found)
        return [*out, {"request_id": "stranger", "status": "succeeded", "text": "x"}]

    def look(self, batch_id):
        with open(f"{self.folder}/{batch_id}.looks", "a") as f:
            f.write("x")
        n = os.path.getsize(f"{self.folder}/{batch_id}.looks")
        requests = json.load(open(f"{self.folder}/{batch_id}.json"))["requests"]
        if any(r["prompt"] == "unreachable" for r in requests):
            raise OSError("no route")
        ended = n >= self.looks and not any(r["prompt"] == "endless" for r in requests)
        return ended, 0 if ended else len(requests), len(self._answers(batch_id)) if ended else 0

    def results(self, batch_id, first, last):
        return self._answers(batch_id)[first:last]


def requests_of(spark, kinds):
    return spark.createDataFrame([(f"r{i}", i, k) for i, k in enumerate(kinds)], "request_id string, position long, prompt string")


def test_late_missing_and_failed_results_in_order(spark, tmp_path):
    service = tmp_path / "service"
    service.mkdir()
    where = str(service)
    run = batches.Batches(spark, str(tmp_path / "run"), lambda: FolderService(where), first_wait=0.05, most_looks=40)
    kinds = ["fine", "error", "missing", "expired"] * 10
    sent = run.submit(requests_of(spark, kinds), size=8)
    assert sent.count() == 40 and 2 <= sent.select("batch_id").distinct().count() <= 5
    got = run.wait(120).orderBy("position").collect()
    assert [r["request_id"] for r in got] == [f"r{i}" for i in range(40)]
    by_kind = {kinds[r["position"]]: (r["status"], r["error"], r["input_tokens"], r["output_tokens"]) for r in got}
    assert by_kind == {"fine": ("succeeded", None, 3, 5), "error": ("errored", "overloaded", 3, 5), "missing": ("errored", "no result for this request", 0, 0), "expired": ("errored", "the request expired", 3, 5)}
    assert got[0]["text"] == "re: r0" and got[1]["text"] is None
    # a later run over the same folder reads only what is new
    looks = sum(os.path.getsize(f"{where}/{f}") for f in os.listdir(where) if f.endswith(".looks"))
    run.submit(spark.createDataFrame([("late", 40, "fine"), ("bad", 41, "endless")], "request_id string, position long, prompt string"), size=1000)
    again = run.wait(120).orderBy("position").collect()
    assert len(again) == 42 and [(r["status"], r["error"]) for r in again[40:]] == [("errored", "still open after 40 looks")] * 2
    assert looks >= 2


def test_a_batch_that_cannot_be_reached(spark):
    now = [0.0]

    class Down:
        def look(self, batch_id):
            if batch_id == "a":
                raise OSError("no route")
            return False, 500, 0

    w = batches.Watcher(Down(), {b: batches.Watch(5.0, 0.0) for b in "ab"}, clock=lambda: now[0])
    waits = []
    while w.open:
        w.look()
        waits.append(w.open["b"].wait if "b" in w.open else None)
        now[0] += 31.0
    assert w.ended["a"] == (0, "polling failed at look 11: no route") and w.ended["b"] == (0, "still open after 180 looks")
    assert waits[:3] == pytest.approx([6.0, 7.2, 8.64]) and waits[50] == 30.0


def test_slices_and_strangers(spark, monkeypatch):
    monkeypatch.setattr(batches, "SLICE", 3)
    r = batches.ResultReader(lambda: FolderService("/nowhere"), {"batches": "[]"})
    parts = r.partitions({"ended": {"a": [7, None]}}, {"ended": {"a": [7, None], "b": [7, None], "c": [0, "gone"], "d": [0, None]}})
    assert [(p.batch_id, p.first, p.last, p.error) for p in parts] == [("b", 0, 3, None), ("b", 3, 6, None), ("b", 6, 7, None), ("c", 0, 0, "gone"), ("d", 0, 0, None)]
    rows = [("b", None, "ended"), ("b", "x", "succeeded"), ("b", "x", "errored"), ("b", "y", "succeeded"), ("d", None, "ended")]
    results = spark.createDataFrame([(*r, None, "t", None, 1, 2, None, None) for r in rows], batches.RESULT)
    asked = spark.createDataFrame([("b", 1, "x"), ("b", 0, "z"), ("d", 2, "y"), ("e", 3, "y")], "batch_id string, position long, request_id string")
    got = [(r["request_id"], r["status"], r["error"]) for r in batches.respond(asked, results).orderBy("position").collect()]
    assert got == [("z", "errored", "no result for this request"), ("x", "errored", "the request errored"), ("y", "errored", "no result for this request")]


def test_long_batch_ids_are_not_dealt_with_every_row(spark):
    from tessera.streaming.batches import RESULT, respond

    submitted = spark.createDataFrame([("b" * 5000, i, str(i)) for i in range(3)] + [("open", 9, "9")], "batch_id string, position long, request_id string")
    results = spark.createDataFrame([("b" * 5000, None, "ended", None, *[None] * 6)] + [("b" * 5000, str(i), "succeeded", None, "t", None, 1, 1, 0, 0) for i in range(2)], RESULT)
    got = respond(submitted, results)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Aggregate [batch_id" in line or "Join" in line and "(batch_id" in line], plan
    rows = sorted((r["position"], r["batch_id"] == "b" * 5000, r["status"]) for r in got.collect())
    assert rows == [(0, True, "succeeded"), (1, True, "succeeded"), (2, True, "errored")]
