"""Phrase collocations from suffix arrays over word ids.

Documents are gathered into shards of about ``SHARD_TOKENS`` tokens, stored once as
word ids with the shard's own vocabulary; id 0 ends a piece. A word belongs to its
language, so a shard holds many languages and no phrase crosses two. Prefix doubling
sorts a shard's suffixes by their first words; the longest common prefixes of
neighbours give intervals, and an interval of depth m is a phrase of m words with its
count.

Counts are merged globally by key, in two steps. First every shard sends 64-bit
fingerprints of its phrases with their counts, packed by bucket of the fingerprint,
and a bucket returns to every shard a bit for each, whether it reaches ``least``
occurrences in all: what is rarer can be neither a candidate nor part of one. Then the
shards write out the words of those that do, and rows of (lang, phrase) are summed exactly; a
collision of fingerprints only writes out a rare phrase, which the exact count drops.
A bucket holds about as many phrases as a shard, however large the corpus is. The
score's products are decimals of 38 digits.

Nulls: a null text is empty; a null language is ``und``. Ids are not read. Empty
texts have no words; very long ones go to a shard of their own, whole. Repeated rows
count as often as they stand. An empty table gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from functools import partial
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, discard

LEAST, MAX_WORDS, TOP = 10, 3, 2000
#: A candidate inside a longer one goes if the longer one makes up this share of it, in per cent.
COVERED = 50
SHARD_TOKENS = 1 << 20
#: ``.`` ends pieces; what ends a piece or parts words is no letter of UTF-8's longer sequences.
SIGNS = bytes.maketrans(b"\t,;:!?\n\x0b\x0c\r", b" .........")
#: Bytes of a fingerprint that are sent; the rest of its eight names the bucket.
PRINT_BYTES = 5
MIX = np.uint64(0x9E3779B97F4A7C15)  # 2^64 over the golden ratio
SHARDS = "shard long, langs array<string>, n_words long, n_tokens long, n_letters long, words binary, lang_of binary, ids binary"


class _Shard:
    """Word ids of documents and their vocabulary."""

    def __init__(self):
        number = count(1).__next__
        self.vocabulary: dict[str, dict[bytes, int]] = defaultdict(lambda: defaultdict(number, {b".": 0}))
        self.ids: list[np.ndarray] = []
        self.n = 0

    def add(self, text: bytes, lang: str) -> None:
        tokens = (text.lower().translate(SIGNS).replace(b".", b" . ") + b" .").split()
        of = self.vocabulary[lang]
        self.ids.append(np.fromiter(map(of.__getitem__, tokens), np.int32, len(tokens)))
        self.n += len(tokens)

    def row(self, shard: int) -> dict:
        langs = list(self.vocabulary)
        n = sum(len(v) - 1 for v in self.vocabulary.values())
        words, lang_of = [b"."] * (n + 1), np.zeros(n + 1, np.int32)
        for i, lang in enumerate(langs):
            for word, at in self.vocabulary[lang].items():
                words[at] = word
                lang_of[at] = i
        packed = [pa.compress(x, "zstd", asbytes=True) for x in (b" ".join(words), lang_of.tobytes(), np.concatenate(self.ids).tobytes())]
        return {"shard": shard, "langs": langs, "n_words": n, "n_tokens": self.n, "n_letters": sum(map(len, words)) + n, **dict(zip(("words", "lang_of", "ids"), packed))}


def _shards(batches: Iterator[pa.RecordBatch], schema: pa.Schema, tokens: int) -> Iterator[pa.RecordBatch]:
    number = count(TaskContext.get().partitionId() << 32)
    held = _Shard()
    for batch in batches:
        for text, lang in zip(batch.column(0), batch.column(1)):
            held.add(text.as_py() or b"", lang.as_py())
            if held.n >= tokens:
                yield pa.RecordBatch.from_pylist([held.row(next(number))], schema)
                held = _Shard()
    if held.n:
        yield pa.RecordBatch.from_pylist([held.row(next(number))], schema)


def suffix_array(ids: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, common): the suffixes of ``ids`` that start with a word, in the order of at least their first ``depth``
    ids, and how many of these a suffix shares with the one before it. Ids are positive, 0 for the end of a piece."""
    n, width = len(ids), 1
    rank = np.zeros(n + 2 * depth, np.int64)
    rank[:n] = ids
    starts = np.flatnonzero(ids).astype(np.int32)
    while width < depth:
        # suffixes that start with an end keep rank 0 and are told apart no further
        key = rank[starts] << np.int64(32) | rank[starts + width]
        order = key.argsort(kind="stable")
        starts, key = starts[order], key[order]
        rank[starts] = np.cumsum(np.concatenate(([1], key[1:] != key[:-1]))) if len(starts) else 0
        width *= 2
    if depth == 1:
        starts = starts[ids[starts].argsort(kind="stable")]
    padded = np.zeros(n + depth, np.int32)
    padded[:n] = ids
    common, same = np.zeros(len(starts), np.int8), np.ones(max(len(starts) - 1, 0), bool)
    for j in range(depth):
        word = padded[starts + j]
        same &= (word[1:] == word[:-1]) & (word[1:] != 0)
        common[1:] += same
    return starts, common


def phrases(ids: np.ndarray, depth: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For every number of words m up to ``depth``: (m, a start of each distinct phrase, its count), from intervals of the suffix array."""
    starts, common = suffix_array(ids, depth)
    padded = np.concatenate((ids, np.zeros(depth, ids.dtype)))
    whole = np.ones(len(starts), bool)
    for m in range(1, depth + 1):
        whole &= padded[starts + m - 1] != 0
        first = np.flatnonzero((common < m) & whole)  # where an interval of depth m begins
        ends = np.append(np.flatnonzero(common < m), len(starts))
        yield m, starts[first], ends[np.searchsorted(ends, first, side="right")] - first


class _Read:
    """A stored shard."""

    def __init__(self, row: dict):
        unpacked = lambda name, size: pa.decompress(row[name], size, "zstd", asbytes=True)
        self.langs, self.words = row["langs"], unpacked("words", row["n_letters"]).split(b" ")
        self.lang_of = np.frombuffer(unpacked("lang_of", 4 * (row["n_words"] + 1)), np.int32)
        self.ids = np.frombuffer(unpacked("ids", 4 * row["n_tokens"]), np.int32)
        seeds = [xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass")) for lang in self.langs]
        hashed = [xxhash.xxh64_intdigest(w, seeds[i]) for w, i in zip(self.words, self.lang_of.tolist())]
        self.hashes = np.array(hashed, np.uint64)

    def prints(self, m: int, starts: np.ndarray) -> np.ndarray:
        """Fingerprints of the phrases of ``m`` words at ``starts``."""
        out = np.full(len(starts), m, np.uint64)
        for j in range(m):
            out = (out ^ (out >> np.uint64(29))) * MIX + self.hashes[self.ids[starts + j]]
        return out ^ (out >> np.uint64(32))

    def dealt(self, depth: int, buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, list[int]]]:
        """(m, starts, counts, prints, edges) of the phrases of each length, by bucket and in it those that stand once first;
        a bucket's phrases stand between two edges. A shard gives the same order whenever it is read."""
        for m, starts, counts in phrases(self.ids, depth):
            prints = self.prints(m, starts)
            bucket = (prints >> np.uint64(8 * PRINT_BYTES)) * np.uint64(buckets) >> np.uint64(64 - 8 * PRINT_BYTES)
            order = (bucket.astype(np.int32) * 2 + (counts > 1)).argsort(kind="stable")
            yield m, starts[order], counts[order], prints[order], np.searchsorted(bucket[order], np.arange(buckets + 1)).tolist()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The rows of batches, one at a time: a shard is large."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _send(batches: Iterator[pa.RecordBatch], schema: pa.Schema, depth: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Fingerprints and counts of a shard's phrases, packed by bucket: those that stand once, then others with their counts."""
    for row in _rows(batches):
        for m, _, counts, prints, edges in _Read(row).dealt(depth, buckets):
            low = prints.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :PRINT_BYTES]
            once = np.cumsum(np.append(0, counts == 1), dtype=np.int32)
            rows = []
            for b in np.flatnonzero(np.diff(edges)).tolist():
                i, j = edges[b], edges[b + 1]
                more = i + int(once[j] - once[i])
                rows.append({"bucket": b, "shard": row["shard"], "m": m, "prints": low[i:j].tobytes(), "counts": counts[more:j].astype(np.uint32).tobytes()})
            yield pa.RecordBatch.from_pylist(rows, schema)


def _common(rows: pd.DataFrame, least: int) -> pd.DataFrame:
    """For each row of a bucket a bit for each of its phrases: whether that reaches ``least`` occurrences in all shards."""
    sizes, counts = np.array([len(p) // PRINT_BYTES for p in rows["prints"]]), []
    prints = np.zeros((sizes.sum(), 8), np.uint8)
    prints[:, :PRINT_BYTES] = np.frombuffer(b"".join(rows["prints"]), np.uint8).reshape(-1, PRINT_BYTES)
    for n, c in zip(sizes.tolist(), rows["counts"]):
        counts += [np.ones(n - len(c) // 4, np.uint32), np.frombuffer(c, np.uint32)]
    # phrases of other lengths have fingerprints of their own
    prints, counts = prints.view("<u8")[:, 0], np.concatenate(counts)
    order = prints.argsort(kind="stable")
    prints = prints[order]
    begin = np.flatnonzero(np.append(True, prints[1:] != prints[:-1]))
    enough = np.empty(len(prints), bool)
    enough[order] = np.repeat(np.add.reduceat(counts[order], begin, dtype=np.int64) >= least, np.diff(np.append(begin, len(prints))))
    bits = [np.packbits(x).tobytes() for x in np.split(enough, sizes.cumsum()[:-1])]
    return pd.DataFrame({"shard": rows["shard"], "m": rows["m"], "bucket": rows["bucket"], "bits": bits})


def _spell(batches: Iterator[pa.RecordBatch], schema: pa.Schema, depth: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows (lang, n_words, phrase, n) of the phrases that came back to a shard, and its words by language with no phrase."""
    for row in _rows(batches):
        read = _Read(row)
        found = {(x["m"], x["bucket"]): x["bits"] for x in row["found"] or []}
        lang_of, words, ids = read.lang_of, read.words, read.ids
        totals = np.bincount(lang_of[ids[ids != 0]], minlength=len(read.langs))
        columns = [[lang for lang in read.langs], [0] * len(read.langs), [b""] * len(read.langs), totals.tolist()]
        for m, starts, counts, _, edges in read.dealt(depth, buckets) if found else ():
            hit = np.zeros(len(starts), bool)
            for b in np.flatnonzero(np.diff(edges)).tolist():
                hit[edges[b] : edges[b + 1]] = np.unpackbits(np.frombuffer(found[m, b], np.uint8), count=edges[b + 1] - edges[b])
            starts, counts = starts[hit], counts[hit]
            spelled = [words[i] for i in ids[starts].tolist()]
            for j in range(1, m):
                spelled = [a + b" " + words[i] for a, i in zip(spelled, ids[starts + j].tolist())]
            columns[0] += [read.langs[i] for i in lang_of[ids[starts]].tolist()]
            columns[1] += [m] * len(starts)
            columns[2] += spelled
            columns[3] += counts.tolist()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<string>": pa.list_(pa.string())}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split(" ") for f in ddl.split(", "))])


def count_phrases(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", max_words: int = MAX_WORDS, least: int = LEAST) -> DataFrame:
    """Per (lang, phrase) of up to ``max_words`` words with at least ``least`` occurrences: lang, n_words, phrase, n.

    The row with 0 words holds the number of all word occurrences of a language.
    """
    rows = docs.select(F.col(text_col).cast("string").cast("binary").alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))
    shards = cut(rows.mapInArrow(partial(_shards, schema=_arrow(SHARDS), tokens=SHARD_TOKENS), SHARDS), "phrase-shards")
    tokens = shards.agg(F.sum("n_tokens")).first()[0] or 0
    buckets = 1 + tokens // SHARD_TOKENS
    sent = "bucket int, shard long, m int, prints binary, counts binary"
    packed = shards.mapInArrow(partial(_send, schema=_arrow(sent), depth=max_words, buckets=buckets), sent)

    def common(rows: pd.DataFrame) -> pd.DataFrame:
        return _common(rows, least)

    back = packed.groupBy("bucket").applyInPandas(common, "shard long, m int, bucket int, bits binary")
    back = back.groupBy("shard").agg(F.collect_list(F.struct("m", "bucket", "bits")).alias("found"))
    spelled = "lang string, n_words int, phrase binary, n long"
    rows = shards.join(back, "shard", "left").mapInArrow(partial(_spell, schema=_arrow(spelled), depth=max_words, buckets=buckets), spelled)
    counted = rows.groupBy("lang", "n_words", F.col("phrase").cast("string").alias("phrase")).agg(F.sum("n").alias("n"))
    out = cut(counted.filter((F.col("n") >= least) | (F.col("n_words") == 0)), "phrase-counts")
    discard(shards)
    return out


def _words(phrase: Column, first: Column, n: Column) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), first, n), " ")


def collocations(counts: DataFrame, *, top: int = TOP, covered: int = COVERED) -> DataFrame:
    """The best ``top`` phrases of each language of ``count_phrases``: lang, rank, phrase, a, l, r, n, score."""
    wide = lambda x: F.col(x).cast("decimal(16,0)")
    known = counts.filter("n_words > 0").select("lang", "phrase", "n")
    candidates = counts.filter("n_words > 1").select("lang", "phrase", "n_words", F.col("n").alias("a"))
    cuts = candidates.select("*", F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)).alias("k"))
    cuts = cuts.withColumn("left", _words(F.col("phrase"), F.lit(1), F.col("k"))).withColumn("right", _words(F.col("phrase"), F.col("k") + 1, F.col("n_words") - F.col("k")))
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"])
    score = F.expr("cast(1000000bd * cast(a as decimal(16,0)) * cast(a as decimal(16,0)) as decimal(38,0)) div cast(cast(l as decimal(18,0)) * cast(r as decimal(18,0)) as decimal(38,0))")
    best = cuts.groupBy("lang", "phrase", "n_words", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best"))
    # phrases inside longer candidates, by where they start and how many words they have
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("n_words") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("n_words") - m + 1), lambda i: _words(F.col("phrase"), i, m))))
    inside = candidates.filter("n_words > 2").select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("longer"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = best.join(inside, ["lang", "phrase"], "left").filter(F.coalesce(100 * F.col("longer") < covered * F.col("a"), F.lit(True)))
    order = [F.col("best.score").desc(), F.col("a").desc(), F.asc("phrase")]
    # first by parts of a language, so that no task gets the best of all partitions at once
    parts = 1 + math.isqrt(int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    part = F.pmod(F.xxhash64("phrase"), F.lit(parts))
    best_of = lambda df, *keys: df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= top)
    ranked = best_of(best_of(kept.withColumn("part", part), "lang", "part").drop("rank", "part"), "lang")
    totals = counts.filter("n_words = 0").select("lang", F.col("n").alias("total"))
    out = ranked.join(totals, "lang").withColumnRenamed("total", "n")
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "best.l", "best.r", "n", "best.score")


def mine(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", max_words: int = MAX_WORDS, least: int = LEAST, top: int = TOP) -> DataFrame:
    """The collocations of ``docs``."""
    return collocations(count_phrases(docs, text_col=text_col, lang_col=lang_col, max_words=max_words, least=least), top=top)
