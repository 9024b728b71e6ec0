"""The stateful queue: one try at a time, retries by timer, restarts."""

import os
import time

from tessera.streaming import stateful


class Work:
    """Notes every call in a folder; fails as often as the payload says."""

    def __init__(self, folder):
        self.folder = folder

    def __call__(self, path, payload, retries):
        with open(f"{self.folder}/{path}-{retries}-{time.time_ns()}", "w"):
            pass
        if retries < int(payload.get("failures", 0)):
            raise OSError("x" * 2_000 if path == "long" else f"{path} is not there")


def make(spark, tmp_path, **options):
    calls = tmp_path / "calls"
    calls.mkdir(exist_ok=True)
    at = {k: str(tmp_path / k) for k in ("in", "out", "state")}
    return stateful.Queue(spark, at["in"], at["out"], at["state"], Work(str(calls)), **({"first_wait": 0.05, "most_wait": 0.1, "every": "0 seconds", "max_retries": 3} | options)), calls


def entries(spark, *rows):
    return spark.createDataFrame([(p, r, None if n is None else {"failures": str(n)}) for p, r, n in rows], stateful.ENTRY)


def ends(queue):
    return sorted((r["path"], r["outcome"], r["retries"]) for r in queue.done().filter("outcome <> 'retried'").collect())


def test_retries_dead_letters_and_copies(spark, tmp_path):
    queue, calls = make(spark, tmp_path)
    queue.enqueue(entries(spark, ("a", None, None), ("b", 0, 1), ("c", 0, 9), ("d", 2, 9), ("", 0, 0), (None, 0, 0), ("long", 0, 9), *[("twin", 0, 1)] * 50))
    queue.drain(120)
    assert ends(queue) == [("a", "succeeded", 0), ("b", "succeeded", 1), ("c", "failed", 3), ("d", "failed", 3), ("long", "failed", 3), ("twin", "succeeded", 1)]
    assert len(os.listdir(calls)) == 1 + 2 + 3 + 1 + 3 + 2  # copies join the entry that is in flight
    dead = {r["path"]: r["last_error"] for r in queue.dead_letters().collect()}
    assert dead["c"] == "OSError: c is not there" and len(dead["long"]) == stateful.MESSAGE_CHARS
    assert queue.done().filter("path = 'twin' and joined = 49").count() == 2
    # a path that is done may come again; what was done before isn't done again
    queue.enqueue(entries(spark, ("a", 0, 0), ("e", 0, 0)))
    queue.drain(120)
    assert ends(queue).count(("a", "succeeded", 0)) == 2 and ("e", "succeeded", 0) in ends(queue)
    assert len(os.listdir(calls)) == 14


def test_two_consumers_share_a_drain_and_a_stop_keeps_what_waits(spark, tmp_path):
    queue, calls = make(spark, tmp_path, first_wait=3600.0, most_wait=3600.0)
    queue.enqueue(entries(spark, ("slow", 0, 1), ("ok", 0, 0)))
    first = queue.start()
    again = stateful.Queue(spark, queue.folder, queue.results, queue.checkpoint, queue.handler).start()
    assert again.id == first.id and len([q for q in spark.streams.active if q.name == queue.name]) == 1
    until = time.time() + 60
    while time.time() < until and len(os.listdir(calls)) < 2:
        time.sleep(0.2)
    while time.time() < until and (first.lastProgress is None or first.lastProgress.batchId < 1):
        time.sleep(0.2)
    first.stop()
    assert ends(queue) == [("ok", "succeeded", 0)]
    waiting = queue.waiting().collect()
    assert [(r["path"], r["retries"], r["payload"]) for r in waiting] == [("slow", 1, {"failures": "1"})]
    # another arrival of its path joins it, in a later run too
    queue.enqueue(entries(spark, ("slow", 0, 0), ("new", 0, 0)))
    second = queue.start()
    while time.time() < until + 60 and len(os.listdir(calls)) < 3:
        time.sleep(0.2)
    while time.time() < until + 60 and not any(r["joined"] for r in queue.waiting().collect()):
        time.sleep(0.5)
    second.stop()
    assert sorted(f.split("-")[0] for f in os.listdir(calls)) == ["new", "ok", "slow"]
    assert [(r["path"], r["joined"]) for r in queue.waiting().collect()] == [("slow", 1)]


def test_equal_entries_are_stored_once(spark, tmp_path, monkeypatch):
    queue, calls = make(spark, tmp_path)
    queue.enqueue(entries(spark, *[("twin", 0, 1)] * 50, *[("twin", None, 1)] * 3, ("odd", 0, 2), (None, 0, 0)).repartition(7))
    assert sorted(r["copies"] for r in spark.read.schema(stateful.STORED).json(queue.folder).collect()) == [1, 3, 50]
    # entries without a number, as other writers leave them, count once
    spark.createDataFrame([("odd", 0, {"failures": "2"})], stateful.ENTRY).write.mode("append").json(queue.folder)
    reads = []
    monkeypatch.setattr(queue, "waiting", lambda of=queue.waiting: reads.append(1) or of())
    queue.drain(120)
    assert ends(queue) == [("odd", "succeeded", 2), ("twin", "succeeded", 1)] and len(os.listdir(calls)) == 3 + 2
    done = queue.done().collect()
    assert {(r["path"], r["joined"]) for r in done} == {("twin", 52), ("odd", 1)}
    assert all((r["due"] is None) == (r["outcome"] != "retried") for r in done) and {r["path"]: r["payload"] for r in done} == {"twin": {"failures": "1"}, "odd": {"failures": "2"}}
    assert len(reads) == 1  # the state is read when nothing is left in it


def test_waits_grow():
    assert [stateful.backoff(n, 1.0, 5.0) for n in range(5)] == [1.0, 1.0, 2.0, 4.0, 5.0]
