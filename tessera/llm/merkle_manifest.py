"""A Merkle manifest of a dataset, built of ordered blocks with higher-order functions.

Every row is a leaf: the SHA-256 of its fields, each written as ``-`` if null and
as byte count, colon and value otherwise. The leaves of a group (a source) stand in
order; every ``FANOUT`` consecutive nodes become the digest of their concatenated
hex digests until one is left, the group's subroot. Subroots, ordered by group
(null first, UTF-8 bytewise), become the root in the same way.

A leaf's place comes from one exchange by ranges of (group, order, leaf): rows are
numbered where they stand, and counts of the ranges, one row for each range and
group in it, give what stands before. ``BLOCK`` consecutive nodes, a power of the
fan-out, make an array that is collapsed level by level with ``sequence``,
``slice``, ``transform`` and ``aggregate``; the roots of blocks are the nodes of the
next round. No step holds more than a block, however large a group is. A proof is the
path from leaf to root: what stands left and right of the node at every level.

Texts are read once, where they are hashed. Nulls in any column are fields of the
leaf; rows with a null id stand first in their group. Empty and very long texts are
hashed whole. Rows with the same id stand in the order of their leaves, so repeated
rows have neighbouring places. An empty table has no leaves and gives an empty
manifest. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, discard

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 3
#: Levels that a block collapses, and the nodes in it.
HEIGHT = 6
BLOCK = FANOUT**HEIGHT
PATH = "array<struct<left:string,right:string>>"


def digest(*texts: Column) -> Column:
    """Lower-case hex SHA-256 of the concatenated texts."""
    return F.sha2(F.concat(*texts).cast("binary"), 256)


def leaf(*fields: Column) -> Column:
    """The digest of a row's fields."""
    values = [f.cast("string") for f in fields]
    return digest(*[F.when(v.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v)) for v in values])


def _parents(nodes: Column) -> Column:
    """Digests of every ``FANOUT`` consecutive nodes."""
    n = F.ceil(F.size(nodes) / F.lit(FANOUT)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: digest(F.array_join(F.slice(nodes, i * FANOUT + 1, FANOUT), "")))


def _levels(nodes: Column, height: Column) -> Column:
    """The nodes, their parents and so on, ``height`` times."""
    steps = F.slice(F.sequence(F.lit(1), F.lit(HEIGHT)), F.lit(1), height)
    return F.aggregate(steps, F.array(nodes), lambda acc, _: F.concat(acc, F.array(_parents(F.element_at(acc, -1)))))


def _path(levels: Column, i: Column) -> Column:
    """What stands left and right of node ``i`` of the lowest level and of its ancestors, but for the top level."""

    def beside(nodes: Column, level: Column) -> Column:
        at = F.floor(i / F.pow(F.lit(FANOUT), level)).cast("int")
        start = at - at % FANOUT
        side = lambda first, n: F.array_join(F.slice(nodes, first + 1, n), "")
        return F.struct(side(start, at % FANOUT).alias("left"), side(at + 1, FANOUT - 1 - at % FANOUT).alias("right"))

    return F.transform(F.slice(levels, F.lit(1), F.size(levels) - 1), beside)


def _height(size: Column) -> Column:
    """Levels above the nodes of a block in a group of ``size`` nodes."""
    return sum(((F.lit(FANOUT**j) < size).cast("int") for j in range(HEIGHT)), F.lit(0))


def _placed(nodes: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """``nodes`` with ``at``, the place in the row's ``group`` by ``order``, and ``size``, the group's nodes; the table that this reads."""
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = nodes.repartitionByRange(parts, "group", *order).sortWithinPartitions("group", *order)
    rows = cut(dealt.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row")), "merkle-rows")
    ranges = rows.groupBy("group", "part").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    whole = Window.partitionBy("group")
    earlier = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("group", "part", (F.col("first") - F.coalesce(F.sum("n").over(earlier), F.lit(0))).alias("zero"), F.sum("n").over(whole).alias("size"))
    return rows.join(ranges, ["group", "part"]).withColumn("at", F.col("row") - F.col("zero")).drop("part", "row", "zero"), rows


def _folded(nodes: DataFrame, payload: list[str]) -> DataFrame:
    """Blocks of ``nodes`` (group, at, size, digest and ``payload``): group, block, items, ``up``, the path
    from a block of ``BLOCK`` nodes to the uppermost node of its group, and ``top``, that node."""
    items = F.array_sort(F.collect_list(F.struct("at", "digest", *payload)))
    blocks = nodes.groupBy("group", F.floor(F.col("at") / BLOCK).alias("block"), "size").agg(items.alias("items"))
    node = F.element_at(F.element_at(_levels(F.col("items.digest"), _height(F.col("size"))), -1), 1)
    blocks = cut(blocks.withColumn("node", node), "merkle-blocks")
    large = blocks.filter(F.col("size") > BLOCK)
    if large.isEmpty():
        return blocks.select("group", "block", "size", "items", F.array().cast(PATH).alias("up"), F.col("node").alias("top"))
    above = _paths(_folded(large.select("group", F.col("block").alias("at"), F.ceil(F.col("size") / BLOCK).alias("size"), F.col("node").alias("digest")), []))
    above = above.select("group", F.col("at").alias("block"), F.col("path").alias("up"), "top")
    found = blocks.join(above, ["group", "block"], "left")
    return found.select("group", "block", "size", "items", F.coalesce("up", F.array().cast(PATH)).alias("up"), F.coalesce("top", "node").alias("top"))


def _paths(blocks: DataFrame, *above: str) -> DataFrame:
    """A row for each item of ``blocks``: its columns, group, ``path`` (in the block, ``up`` and the paths in ``above``), and ``top``."""
    # an array of one element names the levels, so that they are computed once a block
    levels = F.array(_levels(F.col("items.digest"), _height(F.col("size"))))
    paths = F.flatten(F.transform(levels, lambda ls: F.transform(F.element_at(ls, 1), lambda _, i: F.concat(_path(ls, i), F.col("up"), *above))))
    rows = blocks.select("group", "top", *[c for c in blocks.columns if c not in ("group", "top", "items", "block", "size", "up", *above)], F.explode(F.arrays_zip("items", paths.alias("path"))).alias("x"))
    return rows.select("group", "top", *rows.columns[2:-1], "x.items.*", "x.path")


def manifest(docs: DataFrame, *payload: Column, fields: tuple[str, ...] = FIELDS, group: str = "source", order: str = "doc_id") -> DataFrame:
    """Per row: ``order``, ``payload``, leaf, subroot, root and ``path``, an array of (left, right) from leaf to root.

    ``payload`` are named columns over ``docs`` that are computed where the text is read.
    """
    # the group as text that orders null before all others
    key = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    names = [f"p{i}" for i in range(len(payload))]
    rows = docs.select(key.alias("group"), F.col(order).alias("id"), leaf(*map(F.col, fields)).alias("digest"), *[p.alias(n) for p, n in zip(payload, names)])
    leaves = cut(rows, "merkle-leaves")
    placed, dealt = _placed(leaves, ["id", "digest"])
    blocks = _folded(placed, ["id", *names])
    discard(leaves, dealt)
    tops = blocks.filter("block = 0").select(F.lit("").alias("group"), F.col("group").alias("source"), F.col("top").alias("digest"))
    placed, dealt = _placed(tops, ["source"])
    roots = _paths(_folded(placed, ["source"])).select(F.col("source").alias("group"), F.col("path").alias("beyond"), F.col("top").alias("root"))
    discard(dealt)
    found = _paths(blocks.join(roots, "group"), "beyond")
    labels = docs.select(*payload).columns if payload else []
    return found.select(F.col("id").alias(order), *[F.col(n).alias(label) for n, label in zip(names, labels)], F.col("digest").alias("leaf"), F.col("top").alias("subroot"), "root", "path")


def fold(start: Column, path: Column) -> Column:
    """The root that ``start`` and what stands beside its path give."""
    return F.aggregate(path, start, lambda acc, s: digest(s["left"], acc, s["right"]))


def proof(path: Column) -> Column:
    """The digest of all that stands beside a path, from leaf to root and left to right."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""))


def tampered(docs: DataFrame) -> Column:
    """The leaf with the line feeds of the text deleted, of rows whose id has an even CRC-32; null for others."""
    other = [F.replace(F.col(f).cast("string"), F.lit("\n"), F.lit("")) if f == "text" else F.col(f) for f in FIELDS]
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, leaf(*other))


def verify_tampered(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, proof_sha256, folded_root (of the tampered leaf, else the leaf) and verified."""
    found = manifest(docs, tampered(docs).alias("tampered"))
    out = found.withColumn("proof_sha256", proof(F.col("path"))).withColumn("folded_root", fold(F.coalesce("tampered", "leaf"), F.col("path")))
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
