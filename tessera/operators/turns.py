"""Conversations from mixed sources, and runs of turns of one role.

A source row is (conv_id, call, nth, kind, role, content): the ``nth`` thing that was
given in the ``call``-th call of a conversation. Kinds are ``turn`` (a role and its
content), ``response`` (a reply's text), ``text`` (a prompt) and ``document``.

Runs are found by two windows, so that a conversation may be of any length: rows change
role within blocks of ``BLOCK`` turns, and one row for each block carries role and number
of changes on to the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SOURCE = "conv_id long, call long, nth int, kind string, role string, content string"
BLOCK = 4096


def normalize(sources: DataFrame) -> DataFrame:
    """(conv_id, call, nth, role, content, documents): the turns of source rows.

    A call that begins with a prompt or a document is one turn of the user: the first
    row is its content, the others that are texts or documents are its documents, in
    order. In other calls every row stands for itself: a turn with a role and content as
    it is, a response as the assistant's turn; what is neither is left out, and so are
    empty prompts and null contents. Nulls in ``call`` and ``nth`` stand first.
    """
    place = Window.partitionBy("conv_id", "call").orderBy("nth", "kind", "content")
    asks = F.col("kind").isin("text", "document")
    seen = sources.filter("content is not null").withColumn("_first", F.first("kind").over(place))
    prompted = F.coalesce(F.col("_first").isin("text", "document"), F.lit(False))
    given = F.array_sort(F.collect_list(F.struct("nth", "kind", "content")))
    texts = lambda c: F.transform(c, lambda x: x["content"])
    none = F.array().cast("array<string>")
    # prompts have few documents each, those that were given in one call
    one = seen.filter(prompted & asks).groupBy("conv_id", "call").agg(given.alias("g")).filter(F.col("g")[0]["content"] != "")
    prompts = one.select("conv_id", "call", F.col("g")[0]["nth"].alias("nth"), F.lit("user").alias("role"), F.col("g")[0]["content"].alias("content"), texts(F.slice("g", F.lit(2), F.greatest(F.size("g") - 1, F.lit(0)))).alias("documents"))
    role = F.when(F.col("kind") == "response", F.lit("assistant")).when((F.col("kind") == "turn") & F.col("role").isNotNull(), F.col("role"))
    others = seen.filter(~prompted).withColumn("role", role).filter("role is not null").select("conv_id", "call", "nth", "role", "content", none.alias("documents"))
    return prompts.unionByName(others)


def numbered(turns: DataFrame) -> DataFrame:
    """``turns`` with ``turn``, from 0 in the order of (call, nth); a conversation of any length is numbered by blocks of calls."""
    block = F.floor(F.coalesce(F.col("call"), F.lit(-1)) / BLOCK)
    held = turns.withColumn("_block", block)
    sizes = held.groupBy("conv_id", "_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("conv_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_zero", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy("conv_id", "_block").orderBy("call", "nth", "role", "content")
    same = lambda c: F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    placed = held.withColumn("_at", F.row_number().over(inside) - 1)
    met = placed.alias("a").join(sizes.alias("b"), same("conv_id") & same("_block")).select("a.*", F.col("b._zero"))
    return met.withColumn("turn", (F.col("_at") + F.col("_zero")).cast("long")).drop("_block", "_zero", "_at")


def with_runs(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role") -> DataFrame:
    """``turns`` with ``run``: the number, from 0, of the turn's run of one role in its conversation. Null roles are one role."""
    held = turns.withColumn("_block", F.floor(F.col(turn) / BLOCK)).withColumn("_role", F.coalesce(F.col(role), F.lit("")))
    inside = Window.partitionBy(conversation, "_block").orderBy(turn, "_role")
    changed = held.withColumn("_change", F.coalesce((F.lag("_role").over(inside) != F.col("_role")).cast("int"), F.lit(0)))
    changed = changed.withColumn("_changes", F.sum("_change").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    order = lambda f: f(F.struct(F.col(turn).alias("t"), F.col("_role").alias("r")))["r"]
    blocks = changed.groupBy(conversation, "_block").agg(order(F.min).alias("_first"), order(F.max).alias("_last"), F.sum("_change").alias("_n"))
    across = Window.partitionBy(conversation).orderBy("_block")
    entered = F.coalesce((F.lag("_last").over(across) != F.col("_first")).cast("int"), F.lit(0))
    blocks = blocks.withColumn("_entered", entered).withColumn("_base", F.sum(F.col("_entered") + F.col("_n")).over(across) - F.col("_n"))
    same = lambda c: F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    met = changed.alias("a").join(blocks.alias("b"), same(conversation) & same("_block")).select("a.*", F.col("b._base"))
    return met.withColumn("run", (F.col("_base") + F.col("_changes")).cast("long")).drop("_block", "_role", "_change", "_changes", "_base")


def runs(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", content: Column | str = "content") -> DataFrame:
    """(conversation, run, role, first_turn, last_turn, turns, chars) of every run; a long run is summed, not gathered."""
    text = F.col(content) if isinstance(content, str) else content
    return with_runs(turns, conversation, turn, role).groupBy(conversation, "run").agg(F.max(role).alias("role"), F.min(turn).alias("first_turn"), F.max(turn).alias("last_turn"), F.count("*").alias("turns"), F.sum(F.coalesce(F.length(text), F.lit(0))).alias("chars"))
