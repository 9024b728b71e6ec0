"""The Merkle manifest against a written-out tree."""

import hashlib
import zlib

from pyspark.sql import functions as F

from tessera.llm import merkle_manifest

DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def digest(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def leaf(row):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def path(levels, i):
    for nodes in levels[:-1]:
        start = i - i % 3
        yield "".join(nodes[start:i]), "".join(nodes[i + 1 : start + 3])
        i //= 3


def brute(rows):
    groups, out = {}, []
    for row in rows:
        groups.setdefault(row[1], []).append((leaf(row), row))
    keys = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    for k in keys:
        groups[k].sort(key=lambda x: (x[1][0] is not None, x[1][0] or 0, x[0]))
    trees = {k: tree([x[0] for x in groups[k]]) for k in keys}
    top = tree([trees[k][-1][0] for k in keys])
    for place, k in enumerate(keys):
        for i, (own, row) in enumerate(groups[k]):
            steps = [*path(trees[k], i), *path(top, place)]
            folded = own
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0:
                folded = leaf((*row[:4], None if row[4] is None else row[4].replace("\n", "")))
            for left, right in steps:
                folded = digest(left, folded, right)
            out.append((row[0], own, trees[k][-1][0], top[-1][0], digest(*[a + b for a, b in steps]), folded, folded == top[-1][0]))
    return out


def check(spark, rows, **extra):
    docs = spark.createDataFrame(rows, DOCS).withColumns(extra)
    got = sorted(map(tuple, merkle_manifest.verify_tampered(docs).collect()), key=str)
    assert got == sorted(brute(rows), key=str)
    return got


def test_nulls_ties_repeats_and_clashing_names(spark):
    rows = [
        (1, "b", "en", 3, "a\nb"), (2, "b", None, None, None), (3, None, "en", 0, ""), (None, "b", "de", 4, "x\ny\n"), (None, "b", "de", 4, "w"), (-7, "", "en", 1, "é\n"), (4, "é", "en", 1, "z"),
        (1, "b", "en", 3, "a\nb"), (1, "b", "en", 3, "other"), (5, "=b", None, 2**40, "long \n" * 200_000),
    ]
    clash = {name: F.lit(9) for name in ("group", "digest", "at", "size", "part", "row", "path", "top", "tampered", "id")}
    got = check(spark, rows, **clash)
    assert {r[-1] for r in got} == {True, False}


def test_sizes_of_a_source(spark):
    sizes = [1, 2, 3, 4, 9, 10, 728, 729, 730, 1500]
    check(spark, [(i * 7919 % 10_007, f"s{n}", "en", i, f"t{i}\n") for n in sizes for i in range(n)])


def test_many_sources_and_an_empty_table(spark):
    got = check(spark, [(i, f"s{i % 800}" if i % 3 else None, "en", i, f"t{i}") for i in range(2_400)])
    assert all(r[-1] for r in got)
    assert merkle_manifest.verify_tampered(spark.createDataFrame([], DOCS)).collect() == []


def test_a_proof_of_chosen_fields(spark):
    docs = spark.createDataFrame([(i, "s", f"v{i}") for i in range(50)], "key long, part string, value string")
    got = merkle_manifest.manifest(docs, fields=("key", "value"), group="part", order="key")
    assert got.columns == ["key", "leaf", "subroot", "root", "path"]
    ok = got.withColumn("ok", merkle_manifest.fold(F.col("leaf"), F.col("path")) == F.col("root"))
    assert ok.filter("ok").count() == 50
