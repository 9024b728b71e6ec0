"""Vector arithmetic on array columns, in double precision on the JVM.

Arrays of unequal length or with null components give null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def l2_squared(v: Column) -> Column:
    return _sum(F.transform(v, lambda x: x.cast("double") * x.cast("double")))


def l2(v: Column) -> Column:
    return F.sqrt(l2_squared(v))


def _held(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector is zero."""
    return _held(l2(a) * l2(b), lambda norm: F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm))


def similarity(a: Column, b: Column, normalize: bool = False) -> Column:
    return cosine(a, b) if normalize else dot(a, b)


def normalized(v: Column) -> Column:
    """Unit length; a zero vector stays zero."""
    return _held(l2(v), lambda norm: F.transform(v, lambda x: F.when(norm == 0, 0.0).otherwise(x.cast("double") / norm)))


def hinge(c: Column) -> Column:
    """Anti-similarity: max(0, 1 - c)."""
    return F.greatest(F.lit(0.0), 1 - c)


def weighted_score(v: Column, query: Column, weights: Column) -> Column:
    """sum(v q w) / sqrt(sum((v w)^2)); 0 if the denominator is 0."""
    vw = F.zip_with(v, weights, lambda x, w: x.cast("double") * w)
    return _held(vw, lambda x: _held(l2(x), lambda size: F.when(size == 0, 0.0).otherwise(dot(x, query) / size)))


def score_f32(a: Column, b: Column) -> Column:
    """Inner product as stored scores have it: rounded to 32 bits, then widened."""
    return dot(a, b).cast("float").cast("double")


def offsets(counts: Column) -> Column:
    """Exclusive prefix sums of an array of counts."""
    run = F.aggregate(counts, F.array(F.lit(0).cast("long")), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x.cast("long"))))
    return F.slice(run, 1, F.size(counts))


# Intervals: half-open [start, end), as two columns or a struct.


def interval(start: Column, end: Column) -> Column:
    return F.struct(F.least(start, end).alias("start"), F.greatest(start, end).alias("end"))


def intersect(a: Column, b: Column) -> Column:
    """The common part, null if empty."""
    start, end = F.greatest(a["start"], b["start"]), F.least(a["end"], b["end"])
    return F.when(start < end, F.struct(start.alias("start"), end.alias("end")))


def intersects(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def contains(big: Column, small: Column) -> Column:
    return (big["start"] <= small["start"]) & (small["end"] <= big["end"])


def span(i: Column) -> Column:
    return i["end"] - i["start"]


def extract(text: Column, i: Column) -> Column:
    return F.substring(text, i["start"] + 1, span(i))
