"""The data source of vector files: reading in parts, pushdown, commits and versions."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import store
from tessera.sources import files, vect

STORE = files.STORE


def write(folder, name, sections, dim=2):
    path = os.path.join(folder, *name.split("|")) + ".bin"
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(vect.format_vectors(name, sections, dim))
    return path


def some(r, n, dim=2):
    return [(10 * i, 10 * i + 5, r.random((i % 4, dim))) for i in range(n)]


def rows_of(documents):
    out = []
    for ordinal, (name, sections) in enumerate(sorted(documents.items())):
        for s, (start, end, v) in enumerate(sections):
            out += [(name, ordinal, s, start, end, i, np.asarray(x, np.float32).tolist()) for i, x in enumerate(v)]
    return out


@pytest.fixture
def folder(tmp_path):
    r = np.random.default_rng(1)
    documents = {f"t{i % 2}|d{i:02d}": some(r, 1 + i * 3) for i in range(9)}
    for name, sections in documents.items():
        write(tmp_path, name, sections)
    return str(tmp_path), documents


@pytest.mark.parametrize("split", [64, 700, 1 << 20])
def test_files_are_packed_and_cut_by_sections(spark, folder, split):
    path, documents = folder
    got = vect.read(spark, path, split_bytes=split).select(*STORE)
    assert sorted(map(tuple, got.collect())) == sorted(rows_of(documents))
    if split == 64:
        assert got.rdd.getNumPartitions() > 20


def test_pushed_conditions(spark, folder):
    path, documents = folder
    reader = vect.VectorReader({"path": path})
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    left = list(reader.pushFilters([EqualTo(("document_id",), "t1|d03"), In(("section_idx",), (2, 3)), GreaterThan(("vec_idx",), 0)]))
    assert left == [GreaterThan(("vec_idx",), 0)] and reader.ids == {"t1|d03"} and reader.sections == {2, 3}
    read = vect.read(spark, path).filter("document_id = 't1|d03' and section_idx in (2, 3) and vec_idx > 0").select(*STORE)
    want = [x for x in rows_of(documents) if x[0] == "t1|d03" and x[2] in (2, 3) and x[5] > 0]
    assert sorted(map(tuple, read.collect())) == sorted(want) and want
    assert vect.read(spark, path).filter("document_id = 'none'").count() == 0
    # broken files of other documents are still found by a permissive read
    open(os.path.join(path, "bad.bin"), "wb").write(b"x" * 50)
    assert vect.read(spark, path, mode="permissive").filter("document_id = 't1|d03' or error is not null").filter("error is not null").count() == 1


def test_broken_files(spark, folder):
    path, documents = folder
    good = open(os.path.join(path, "t0", "d08.bin"), "rb").read()
    cases = {"empty": b"", "short": good[:39], "cut": good[:-3], "magic": b"\1" + good[1:], "version": good[:4] + b"\3" + good[5:], "id": good[:40] + b"\xff\xfe" + good[42:]}
    for name, data in cases.items():
        open(os.path.join(path, name + ".bin"), "wb").write(data)
    with pytest.raises(Exception, match=".bin: "):
        vect.read(spark, path).collect()
    read = vect.read(spark, path, mode="permissive")
    errors = {os.path.basename(r["path"])[:-4]: r["error"] for r in read.filter("error is not null").collect()}
    assert set(errors) == set(cases) and errors["cut"] == "the file is shorter than it says"
    assert read.filter("error is null").count() == len(rows_of(documents))
    for data in cases.values():
        with pytest.raises(ValueError):
            files.parse_vectors(data)


def test_all_or_nothing_and_one_path_at_a_time(spark, folder, tmp_path):
    path, documents = folder
    write(tmp_path / "x", "o|k", [(0, 1, np.ones((2, 2)))])
    open(tmp_path / "x" / "bad.bin", "wb").write(b"junk")
    parts = [os.path.join(path, "t0"), os.path.join(path, "x"), os.path.join(path, "t1"), os.path.join(path, "gone")]
    got, failures = files.add_paths(store.create(spark), *parts)
    assert {r["path"]: r["error"] for r in failures.collect()}.keys() == {parts[1], parts[3]}
    assert got.select("document_id").distinct().count() == len([d for d in documents.values() if sum(len(v) for _, _, v in d)])
    with pytest.raises(Exception, match="junk|short"):
        files.load_store(got, parts[1])
    with pytest.raises(Exception, match="no such folder"):
        files.load_store(got, parts[3])


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    target = str(tmp_path / "out")
    rows = spark.createDataFrame([(f"a|{i}", bytes([i])) for i in range(40)], "document_id string, content binary").repartition(4)
    vect.register(spark)
    rows.filter("document_id < 'a|2'").write.format("vect").mode("append").save(target)
    before = sorted(os.listdir(target + "/a"))
    broken = rows.withColumn("content", F.when(F.col("document_id") == "a|17", F.raise_error(F.lit("lost")).cast("binary")).otherwise(F.col("content")))
    with pytest.raises(Exception, match="lost"):
        broken.write.format("vect").mode("overwrite").save(target)
    assert sorted(os.listdir(target + "/a")) == before and os.listdir(target) == ["a"]
    with pytest.raises(Exception, match="one file name"):
        rows.withColumn("document_id", F.lit("a|b")).write.format("vect").mode("append").save(target)
    assert sorted(os.listdir(target + "/a")) == before and os.listdir(target) == ["a"]
    rows.filter("document_id = 'a|5'").write.format("vect").mode("overwrite").save(target)
    assert os.listdir(target + "/a") == ["5.bin"]


def test_versions_are_whole(spark, tmp_path):
    folder = str(tmp_path / "store")
    make = lambda names, x: spark.createDataFrame([(n, i, 0, 0, 9, j, [x, float(j)]) for i, n in enumerate(names) for j in range(3)], store.VECTORS)
    versioned = vect.Versioned(spark, folder)
    assert versioned.newest() is None and versioned.snapshot().count() == 0
    assert versioned.reload(make("abc", 1.0)) == 1
    running = versioned.snapshot()
    assert versioned.reload(make("abcd", 2.0)) == 2
    # a search that began before goes on with what it had; a later one has only the new version
    assert {r[0] for r in running.select(F.element_at("vec", 1)).collect()} == {1.0} and running.count() == 9
    assert {r[0] for r in versioned.snapshot().select(F.element_at("vec", 1)).collect()} == {2.0} and versioned.snapshot().count() == 12
    assert versioned.append(make("e", 3.0)) == 3 and versioned.snapshot().count() == 15
    with pytest.raises(Exception, match="collide"):
        versioned.append(make("ae", 4.0))
    assert versioned.newest() == 3 and versioned.snapshot().count() == 15
    assert versioned.remove("a", "e", "zz") == 4
    assert [r[0] for r in versioned.snapshot().select("document_id").distinct().orderBy("document_id").collect()] == ["b", "c", "d"]
    assert {r[0] for r in versioned.snapshot().filter("document_id in ('b', 'c') and section_idx = 0").select("document_id").collect()} == {"b", "c"}
    with pytest.raises(ValueError, match="committed meanwhile"):
        vect.write_manifest(folder, 4, [])
    assert versioned.snapshot(1).count() == 9
    assert versioned.vacuum(keep=1) == 5 and vect.versions(folder) == [4]
    assert versioned.snapshot().count() == 9
    assert json.loads(open(f"{folder}/_manifest-0000000004.json").read())["version"] == 4
    jobs = [f for _, _, names in os.walk(folder) for f in names if f.endswith(".bin")]
    assert len(jobs) == 3
