"""SimHash near-duplicates by anchor-point covering.

Fingerprint (64 bits): A-Z are lower-cased, words are runs without ASCII white
space, shingles are ``shingle_words`` consecutive words joined by one space
(fewer words: the whole sequence; none: fingerprint 0). A bit is 1 if it is set
in over half of the shingles' XXH64 hashes (seed 42), repeats included.

Search. Two fingerprints that differ in at most 4 bits agree, by counting, to
within (1, 1, 0) bits on one of the three parts (22, 22, 20 bits). On each part
a covering code gives the anchors: for the 22-bit parts the codewords of a
Hamming(15, 11) code with 7 free bits (covering radius 1), for the 20-bit part
every word (radius 0). A fingerprint is replicated to every anchor within the
covering radius plus the part's threshold (2, 2, 0 bits: about 16, 16 and 1
anchors); two fingerprints within the threshold on a part meet at the anchor
nearest to either. Rows of an anchor are compared exactly, by XOR and bit count.

Only distinct fingerprints are replicated, so copies never meet as pairs. Every
anchor emits a spanning forest of its links (at most a row less than it read),
which keeps every connection. Components grow from these links by alternating
large-star and small-star steps, all joins and aggregates in Spark.

Nulls: a null text counts as empty. Empty texts have fingerprint 0 and link like
any other. A null id takes part in links; a component's id is the smallest id
that isn't null (null if there is none). Repeated rows give repeated result
rows. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, discard, fresh

MAX_BITS = 4
PART_BITS = (22, 22, 20)
#: Bits of a 22-bit part under the Hamming code (positions 1 to 15); the rest is free.
CODED = 15
#: Hashes whose bits are counted at once: bounds memory for very long texts.
SLICE = 1 << 15
#: From so many rows on, an anchor's rows are compared one against all others.
LARGE = 64


def fingerprint(text: str | None, shingle_words: int = 4) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle_words, len(words))
    hash_of = xxhash.xxh64_intdigest
    total, ones = len(words) - k + 1, np.zeros(64, np.int64)
    for at in range(0, total, SLICE):
        upto = min(total, at + SLICE)
        hashes = np.array([hash_of(joined[a:b], 42) for a, b in zip(starts[at:upto].tolist(), ends[at + k - 1 : upto + k - 1].tolist())], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def fingerprint_column(text: Column, shingle_words: int = 4) -> Column:
    """The fingerprint as a signed 64-bit integer."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle_words) for t in texts], np.uint64).view(np.int64))

    return of(text)


def _patterns() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Error patterns of up to 2 bits on 22 bits by syndrome: patterns (padded), how many, weight."""
    by: list[list[int]] = [[] for _ in range(16)]
    bit = range(PART_BITS[0])
    syndrome = lambda e: np.bitwise_xor.reduce([i + 1 for i in range(CODED) if e >> i & 1] or [0])
    for e in [0, *(1 << i for i in bit), *(1 << i | 1 << j for i in bit for j in bit if i < j)]:
        by[int(syndrome(e))].append(e)
    most = max(map(len, by))
    return np.array([[*x, *[0] * (most - len(x))] for x in by], np.uint64), np.array([len(x) for x in by]), np.uint64(0)


def _syndromes(part: np.ndarray) -> np.ndarray:
    out = np.zeros(len(part), np.uint64)
    for i in range(CODED):
        out ^= (part >> np.uint64(i) & np.uint64(1)) * np.uint64(i + 1)
    return out.astype(np.int64)


def anchors(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every anchor that each fingerprint is replicated to; a key holds part and anchor."""
    patterns, counts, _ = _patterns()
    rows, keys, shift = [], [], 0
    for part_no, bits in enumerate(PART_BITS):
        part = prints >> np.uint64(shift) & np.uint64((1 << bits) - 1)
        shift += bits
        if part_no == 2:
            at, words = np.arange(len(prints)), part
        else:
            s = _syndromes(part)
            at = np.repeat(np.arange(len(prints)), counts[s])
            nth = np.arange(len(at)) - np.repeat(np.cumsum(counts[s]) - counts[s], counts[s])
            words = part[at] ^ patterns[s[at], nth]
        rows.append(at)
        keys.append(words | np.uint64(part_no << 32))
    return np.concatenate(rows), np.concatenate(keys)


def _replicate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for at in range(0, len(pdf), 4096):
            prints = pdf["print"].to_numpy(np.int64)[at : at + 4096]
            row, key = anchors(prints.view(np.uint64))
            yield pd.DataFrame({"anchor": key.view(np.int64), "print": prints[row]})


def forest_of(prints: np.ndarray, max_bits: int = MAX_BITS) -> list[tuple[int, int]]:
    """A spanning forest of the links among one anchor's rows: each row visited once, against those not yet reached."""
    left, edges = np.unique(prints), []
    while len(left):
        reached, left = [left[0]], left[1:]
        while reached and len(left):
            one = reached.pop()
            near = np.bitwise_count((left ^ one).view(np.uint64)) <= max_bits
            if near.any():
                edges += [(int(one), int(x)) for x in left[near]]
                reached += list(left[near])
                left = left[~near]
    return edges


def _forest(anchor: np.ndarray, prints: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of whole anchors (rows sorted by anchor), a spanning forest for each."""
    first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    sizes = np.diff(np.append(first, len(anchor)))
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for at in np.flatnonzero(sizes > LARGE):
        if edges := forest_of(prints[first[at] : first[at] + sizes[at]], max_bits):
            x, y = np.array(edges, np.int64).T
            a.append(x)
            b.append(y)
    small = np.repeat(sizes <= LARGE, sizes) & np.repeat(sizes > 1, sizes)
    anchor, prints = anchor[small], prints[small]
    i_all, j_all = [], []
    for shift in range(1, LARGE):
        same = np.flatnonzero(anchor[shift:] == anchor[:-shift])
        if not len(same):
            break
        d = np.bitwise_count((prints[same] ^ prints[same + shift]).view(np.uint64))
        hit = same[d <= max_bits]
        i_all.append(hit)
        j_all.append(hit + shift)
    if i_all and (n := sum(map(len, i_all))):
        i, j = np.concatenate(i_all), np.concatenate(j_all)
        label = np.arange(len(prints))
        while n:  # the smallest row that each reaches inside its anchor
            low = np.minimum(label[i], label[j])
            new = label.copy()
            np.minimum.at(new, i, low)
            np.minimum.at(new, j, low)
            new = new[new]
            n = int((new != label).sum())
            label = new
        moved = np.flatnonzero(label != np.arange(len(prints)))
        a.append(prints[label[moved]])
        b.append(prints[moved])
    return np.concatenate(a), np.concatenate(b)


def _links_in(max_bits: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        anchor, prints = np.empty(0, np.int64), np.empty(0, np.int64)
        for pdf in batches:
            anchor = np.concatenate((anchor, pdf["anchor"].to_numpy(np.int64)))
            prints = np.concatenate((prints, pdf["print"].to_numpy(np.int64)))
            if not len(anchor):
                continue
            whole = int(np.searchsorted(anchor, anchor[-1]))  # the last anchor may go on in the next batch
            if whole:
                a, b = _forest(anchor[:whole], prints[:whole], max_bits)
                anchor, prints = anchor[whole:], prints[whole:]
                yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})
        if len(anchor):
            a, b = _forest(anchor, prints, max_bits)
            yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return run


def links(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links (a, b), a < b, that span every component of distinct fingerprints (column ``print``).

    The anchors find all pairs of up to ``MAX_BITS`` differing bits; more are refused, since pairs would be lost.
    """
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError(f"max_bits must be 0 to {MAX_BITS}, not {max_bits}")
    dealt = prints.mapInPandas(_replicate, "anchor long, print long").repartition("anchor").sortWithinPartitions("anchor", "print")
    return dealt.mapInPandas(_links_in(max_bits), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node that it reaches."""
    state = cut(edges.select("a", "b"), "links")
    before = None
    while True:
        both = state.union(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.filter("b > a").join(low, "a").select(F.col("low").alias("a"), "b").distinct()
        large = cut(large.filter("a < b"), "links")
        discard(state)
        low = large.groupBy("b").agg(F.min("a").alias("low"))
        down = large.join(low, "b")
        small = down.select(F.col("low").alias("x"), F.explode(F.array("a", "b")).alias("y"))
        state = cut(small.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).filter("a < b").distinct(), "links")
        discard(large)
        now = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    found = cut(state.select(F.col("b").alias("node"), F.col("a").alias("root")), "roots")
    discard(state)
    return found


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 4, max_bits: int = MAX_BITS) -> DataFrame:
    """Per row of ``docs``: doc_id, print (signed), component_id."""
    rows = cut(docs.select(F.col(id_col).alias("doc_id"), fingerprint_column(F.col(text_col), shingle_words).alias("print")), "prints")
    prints = rows.groupBy("print").agg(F.min("doc_id").alias("first_id"))
    found = components(links(prints.select("print"), max_bits))
    of_print = prints.join(found, prints["print"] == found["node"], "left").select("print", "first_id", F.coalesce("root", "print").alias("root"))
    of_print = cut(of_print, "print-roots")
    discard(found)
    smallest = of_print.groupBy("root").agg(F.min("first_id").alias("component_id"))
    label = of_print.join(smallest, "root").select("print", "component_id")
    return rows.join(label, "print").select("doc_id", "print", "component_id")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 4, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one document (the smallest id) of each component; rows without an id stay."""
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, shingle_words=shingle_words, max_bits=max_bits)
    kept = found.filter("doc_id = component_id").select(F.col("doc_id").alias("kept_id")).distinct()
    nth = fresh(docs, "nth_of_id")
    rows = docs.join(kept, docs[id_col] == kept["kept_id"], "left_semi")
    rows = rows.withColumn(nth, F.row_number().over(Window.partitionBy(id_col).orderBy(F.xxhash64(text_col)))).filter(F.col(nth) == 1).drop(nth)
    return rows.unionByName(docs.filter(F.col(id_col).isNull()))
