"""Mixing sources to target weights by systematic sampling.

Every source gets a target number of words: the sources, in code-point order
(null last), share ``share`` times all words by repeating ``weights``; a target
stops at ``max_copies`` times its source's words and the excess is dealt again by
weight until no target is above its bound. A document's expected copies are its
source's target over its source's words. Documents of a source stand in one
order (by size class, block, size, id); expected copies are summed along it, one
offset per source is added, and a document is emitted once for every integer
that its stretch of the running sum crosses.

The running sum has two levels, so a source that holds a third of all rows never
meets in one task: rows are ordered inside blocks of about ``block_rows`` rows,
and only the blocks' row counts are summed along a source. Sums are integers
(units of 2**-24 copies), so reruns agree whatever the partitioning.

Nulls: a null text has size 0, a null source is a source of its own (the last),
a null id (or one that is no number) is mixed like any other and dealt to a
block by its text. Empty texts have size 0 and may be emitted;
they take no words. Repeated rows are mixed one by one. An empty table gives an
empty result. Columns besides the three named are ignored by ``mix_sources`` and
kept by ``emit_mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import count_words, cut, fresh

UNIT = 1 << 24
BLOCK_ROWS = 4096
WEIGHTS = (5, 2, 1)


def source_targets(sizes: DataFrame, *, weights=WEIGHTS, share: float = 1.5, max_copies: int = 2) -> DataFrame:
    """Adds ``target`` to a table of sources (``no_source``, ``key``, ``source_size``).

    One row per source; the windows below order sources, never documents.
    """
    in_order = Window.orderBy("no_source", "key")
    w = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(in_order) - 1) % len(weights) + 1).cast("int")))
    w = w.withColumn("bound", (F.col("source_size") * max_copies).cast("double"))
    filling = Window.orderBy(F.col("bound") / F.col("weight"), "no_source", "key")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    level = (F.sum("source_size").over(whole) * share - F.coalesce(F.sum("bound").over(before), F.lit(0.0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    w = w.withColumn("level", level).withColumn("place", F.row_number().over(filling))
    w = w.withColumn("full", F.col("level") >= F.col("bound") / F.col("weight"))
    top = F.min(F.when(~F.col("full"), F.struct("place", "level"))).over(whole)["level"]
    w = w.withColumn("top", top)
    full = F.col("full") & (F.col("top").isNull() | (F.col("bound") / F.col("weight") <= F.col("top")))
    target = F.when(full | F.col("top").isNull(), F.col("bound")).otherwise(F.least("bound", F.col("top") * F.col("weight")))
    return w.select("no_source", "key", "source_size", target.alias("target"))


def _mixed(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights, share: float, max_copies: int, block_rows: int, seed: int) -> DataFrame:
    source, text = F.col(source_col).cast("string"), F.col(text_col)
    # ids that are no numbers are dealt by their text, so that they don't meet in one block
    deal = F.coalesce(F.col(id_col).try_cast("long"), F.conv(F.substring(F.md5(F.coalesce(text, F.lit(""))), 1, 8), 16, 10).cast("long"))
    sized = docs.select(F.col(id_col).alias("doc_id"), deal.alias("deal"), source.isNull().alias("no_source"), F.coalesce(source, F.lit("")).alias("key"), count_words(text).alias("size"), F.xxhash64(text).alias("text_hash"))
    sized = cut(sized.withColumn("size_class", F.length(F.bin("size"))), "mix-sizes")

    of_source, of_class = ["no_source", "key"], ["no_source", "key", "size_class"]
    classes = cut(sized.groupBy(*of_class).agg(F.count("*").alias("class_rows"), F.sum("size").alias("class_size")), "mix-classes")
    targets = source_targets(classes.groupBy(*of_source).agg(F.sum("class_size").alias("source_size")), weights=weights, share=share, max_copies=max_copies)
    per_row = F.when(F.col("source_size") > 0, F.least(F.lit(max_copies * UNIT).cast("long"), F.floor(F.col("target") / F.col("source_size") * UNIT))).otherwise(F.lit(0)).cast("long")
    start = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.when(F.col("no_source"), "null").otherwise(F.concat(F.lit("="), "key")))), 1, 6), 16, 10).cast("long")
    targets = targets.withColumns({"expected": per_row, "start": start})
    n_blocks = F.ceil(F.col("class_rows") / F.lit(block_rows)).cast("long")
    plan = cut(classes.join(targets, of_source).select(*of_class, n_blocks.alias("n_blocks"), "source_size", "target", "expected", "start"), "mix-plan")

    of_block = [*of_class, "block"]
    dealt = sized.join(plan, of_class).withColumn("block", F.pmod("deal", F.col("n_blocks")))
    blocks = dealt.groupBy(*of_block).agg(F.count("*").alias("rows"))
    ahead = Window.partitionBy(*of_source).orderBy("size_class", "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*of_block, F.coalesce(F.sum("rows").over(ahead), F.lit(0)).alias("ahead"))
    place = F.row_number().over(Window.partitionBy(*of_block).orderBy("size", "doc_id", "text_hash")) - 1
    placed = dealt.withColumn("place", place).join(blocks, of_block)
    left = (F.col("ahead") + F.col("place")) * F.col("expected") + F.col("start")
    crossed = F.shiftright(left + F.col("expected"), 24) - F.shiftright(left, 24)
    return placed.withColumn("copies", crossed.cast("int"))


def mix_sources(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = 1.5, max_copies: int = 2, block_rows: int = BLOCK_ROWS, seed: int = 0) -> DataFrame:
    """Per row of ``docs``: doc_id, size, source_size, target, taken (words) and copies."""
    mixed = _mixed(docs, id_col, text_col, source_col, weights, share, max_copies, block_rows, seed)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies")


def emit_mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = 1.5, max_copies: int = 2, block_rows: int = BLOCK_ROWS, seed: int = 0) -> DataFrame:
    """The mixture itself: every row of ``docs`` as often as the mix takes it.

    Rows of one id, source and text are interchangeable: their copies are summed
    and dealt to them in equal parts.
    """
    mixed = _mixed(docs, id_col, text_col, source_col, weights, share, max_copies, block_rows, seed)
    takes = mixed.groupBy("doc_id", "no_source", "key", "text_hash").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"))
    takes = takes.select(_row_key(F.col("doc_id"), F.col("no_source"), F.col("key"), F.col("text_hash")).alias("row_key"), "copies", "rows")
    mark = {c: fresh(docs, f"mix_{c}") for c in ("key", "nth", "copy", "copies", "rows")}
    source = F.col(source_col).cast("string")
    rows = docs.withColumn(mark["key"], _row_key(F.col(id_col), source.isNull(), F.coalesce(source, F.lit("")), F.xxhash64(text_col)))
    # one exchange of the rows serves the join and the numbering
    joined = rows.join(takes.select(F.col("row_key").alias(mark["key"]), F.col("copies").alias(mark["copies"]), F.col("rows").alias(mark["rows"])), mark["key"])
    joined = joined.withColumn(mark["nth"], F.row_number().over(Window.partitionBy(mark["key"]).orderBy(mark["key"])))
    copies, alike = F.col(mark["copies"]), F.col(mark["rows"])
    share_of = F.floor(copies / alike) + F.when(F.col(mark["nth"]) <= copies % alike, 1).otherwise(0)
    taken = joined.select(*docs.columns, share_of.cast("int").alias(mark["copy"])).filter(F.col(mark["copy"]) > 0)
    return taken.withColumn(mark["copy"], F.explode(F.sequence(F.lit(1), F.col(mark["copy"])))).drop(mark["copy"])


def _row_key(doc_id: Column, no_source: Column, source: Column, text_hash: Column) -> Column:
    """128 bits that name rows of one id, source and text; nulls have marks of their own."""
    parts = [doc_id.isNull(), F.coalesce(doc_id.cast("string"), F.lit("")), no_source, source, text_hash]
    return F.concat_ws(":", F.hex(F.xxhash64(F.lit(0), *parts)), F.hex(F.xxhash64(F.lit(1), *parts)))
