"""Removal of near-duplicate lines by an exact set-similarity join.

A line's tokens are its distinct words (runs without ASCII white space,
lower-cased). A line goes if the Jaccard similarity of its tokens with those of
an earlier line, in the order (id, text hash, line number), is at least
``threshold``; lines without a word stay. All arithmetic is on native columns.

1. The documents are written once, bucketed by id and text hash. Every later step
   that needs texts joins small rows to these buckets, so texts are shuffled once.
2. Equal lines collapse to the earliest (partial aggregates), so thousands of
   copies of a line cost one row. The lines that are left are numbered in order.
3. Token rarity comes from counts over all documents, in ``BUCKETS`` hash buckets;
   a token's key is (log2 of its bucket's count, hash), so sorted keys stand rarest
   first. Any one order keeps the filters exact; rarity makes the lists short.
4. Prefix filter: similar lines share one of the first n - ceil(t n) + 1 keys.
   Entries (key, line) carry length, position and a parity map of 64 or 128 bits of the set for the
   length, positional and bitmap filters; none loses a pair. Entries meet by 40
   bits of a key; more lines may meet by that, never fewer.
5. Entries are dealt by key once. Each is held against the first line of its key and
   the line just before it. Where one of them passes the filters, the entry meets
   only these two for now; else it meets every earlier line of its key that passes.
   So a group of near copies gives few pairs a line. Pairs are verified on the words'
   64-bit hashes, the closest of each line first.
6. Entries that were held back, of lines that no pair settled, then meet every
   earlier line of their key that passes, and these pairs are verified. The lists of
   the keys concerned were written along with the pairs. Nothing is capped.

Arrays are exploded by the outer forms: none is empty here, and for the others the
optimizer adds a filter that computes the array a second time.

Nulls: a null text stays null with 0 lines; a null id sorts last. Empty texts
stay empty. Rows that repeat id and text are one document and keep the same
lines. Very long texts and lines are processed whole. Other columns pass through
``drop_repeated_lines``, clashing names included. An empty table stays empty.
"""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bucketed, cut, discard, fresh

THRESHOLD = 0.8
#: Hash buckets that count tokens, and the bits of a key by which entries meet.
BUCKETS, KEY_BITS = 1 << 18, 40
BITS = ["bits0", "bits1"]
#: Up to so many words, 64 bits of parity tell lines apart.
SMALL = 96
LAST_ID = (1 << 63) - 1
HAS_WORD = r"[^\x20\x09-\x0D]"
WHITE = "\t\x0b\f\r"


def odd_space(text: Column) -> Column:
    """Whether a text holds white space besides spaces and line ends."""
    return functools.reduce(Column.__or__, [F.contains(text, F.lit(c)) for c in WHITE])


def split_words(line: Column, odd: Column) -> Column:
    """Lower-cased words; empty strings where white space repeats. ``odd``: whether its text has odd white space."""
    lower = F.lower(line)
    return F.split(F.when(odd, F.translate(lower, WHITE, " " * len(WHITE))).otherwise(lower), " ")


def hashes_of(line: Column, odd: Column) -> Column:
    """64-bit hashes of ``split_words``."""
    return F.transform(split_words(line, odd), lambda w: F.xxhash64(w))


def distinct_words(hashes: Column) -> Column:
    """Each of ``hashes_of`` once, without the empty string's."""
    return F.array_except(hashes, F.array(F.xxhash64(F.lit(""))))


def words_of(line: Column, odd: Column) -> Column:
    """64-bit hashes of the distinct lower-cased words."""
    return distinct_words(hashes_of(line, odd))


def similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct words."""
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def first_lines(texts: DataFrame) -> DataFrame:
    """(id, text_hash, line_no, line): the first of all equal lines with a word; ``line`` numbers them in order and buckets the table."""
    lines = texts.select("id", "text_hash", F.posexplode_outer(F.split("text", "\n")).alias("line_no", "words")).filter(F.col("words").rlike(HAS_WORD))
    first = lines.groupBy(F.xxhash64("words").alias("h0"), F.xxhash64(F.lit(1), "words").alias("h1")).agg(F.min(F.struct("id", "text_hash", "line_no")).alias("first"))
    first = cut(first.select("first.*"), "first-lines")
    order = ["id", "text_hash", "line_no"]
    numbered = first.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("line", F.monotonically_increasing_id())
    numbered = bucketed(numbered, ["line"], "line_numbers", deal=True)
    discard(first)
    return numbered


def with_words(lines: DataFrame, texts: DataFrame) -> DataFrame:
    """(line, words, odd): the text of each of ``lines`` (id, text_hash, line_no, line), from the bucketed documents."""
    asked = lines.groupBy("id", "text_hash").agg(F.collect_list(F.struct("line_no", "line")).alias("asked"))
    # explode_outer holds the split text as a column, so that it isn't split anew for each line
    split = asked.hint("shuffle_hash").join(texts, ["id", "text_hash"]).select("asked", "odd", F.explode_outer(F.array(F.split("text", "\n"))).alias("all"))
    found = F.transform("asked", lambda x: F.struct(x["line"].alias("line"), F.get("all", x["line_no"]).alias("words")))
    return split.select("odd", F.explode_outer(found).alias("x")).select("x.*", "odd")


def rarity_levels(texts: DataFrame) -> list[int]:
    """Per hash bucket, log2 of its tokens in all documents: ``BUCKETS`` small numbers, whatever the corpus."""
    lines = texts.select("odd", F.explode_outer(F.split("text", "\n")).alias("line"))
    tokens = lines.select(F.explode_outer(split_words(F.col("line"), F.col("odd"))).alias("token"))
    counted = tokens.groupBy(F.xxhash64("token").bitwiseAND(BUCKETS - 1).alias("bucket")).agg(F.count("*").alias("n"))
    levels = [0] * BUCKETS
    for row in counted.select(F.col("bucket").cast("int").alias("bucket"), F.least(F.floor(F.log2("n")), F.lit(31)).cast("int").alias("level")).collect():
        levels[row["bucket"]] = row["level"]
    return levels


def _bitmaps(hashes: Column, n: Column) -> list[Column]:
    """64 bits of parity (whether the number of hashes that name a bit is odd); of more than ``SMALL`` words, of the negative hashes and of the others."""
    none = F.lit(0).cast("long")
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(63).cast("int"))
    whole = F.aggregate(hashes, none, lambda a, h: a.bitwiseXOR(bit(h)))
    low = F.aggregate(hashes, none, lambda a, h: F.when(h < 0, a.bitwiseXOR(bit(h))).otherwise(a))
    high = F.aggregate(hashes, none, lambda a, h: F.when(h < 0, a).otherwise(a.bitwiseXOR(bit(h))))
    return [F.when(n <= SMALL, whole).otherwise(low), F.when(n <= SMALL, none).otherwise(high)]


def _sorted_keys(hashes: Column, levels: list[int]) -> Column:
    """The keys of hashes, rarest first. None is null by type, so that they are sorted as plain numbers, not as objects."""
    # a session variable: typed out as a literal, the table would stand in every description of the plan that the driver keeps
    spark = SparkSession.active()
    spark.sql("DECLARE OR REPLACE VARIABLE line_dedup_levels ARRAY<TINYINT>")
    spark.sql("SET VARIABLE line_dedup_levels = (SELECT levels FROM {table})", table=spark.createDataFrame(pa.table({"levels": pa.array([levels], pa.list_(pa.int8()))})))
    table = F.expr("line_dedup_levels")
    level = lambda h: F.coalesce(F.get(table, h.bitwiseAND(BUCKETS - 1).cast("int")), F.lit(0).cast("byte")).cast("long")
    return F.sort_array(F.transform(hashes, lambda h: F.shiftleft(level(h), 58).bitwiseOR(F.shiftrightunsigned(h, 6))))


def _entries(lines: DataFrame, levels: list[int], threshold: float) -> DataFrame:
    """(key, line, size, bitmap) for the keys of the prefix of each of ``lines`` (line, words, odd); ``size`` holds the number of words over the place."""
    # explode_outer holds the hashes as a column, so that they aren't made anew for each use; apart, array_except is compiled
    hashed = lines.select("line", F.explode_outer(F.array(hashes_of(F.col("words"), F.col("odd")))).alias("all"))
    hashed = hashed.select("line", F.explode_outer(F.array(distinct_words(F.col("all")))).alias("hashes"))
    n = F.size("hashes")
    prefix = F.slice(_sorted_keys(F.col("hashes"), levels), 1, (n - F.ceil(n * threshold - 1e-9) + 1).cast("int"))
    keyed = hashed.select("line", n.alias("n"), *[x.alias(c) for x, c in zip(_bitmaps(F.col("hashes"), n), BITS)], prefix.alias("prefix"))
    entries = keyed.select("line", "n", *BITS, F.posexplode_outer("prefix").alias("place", "key"))
    size = F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.col("place").cast("long"))
    return entries.select(F.col("key").bitwiseAND((1 << KEY_BITS) - 1).alias("key"), "line", size.alias("size"), *BITS)


def _n(a) -> Column:
    """The number of words, from an entry's ``size``."""
    return F.shiftright(a("size"), 32)


def _after(a) -> Column:
    """The words from an entry's place on."""
    return _n(a) - a("size").bitwiseAND((1 << 32) - 1)


def _apart(a, b) -> Column:
    """Bits that differ: at most the number of words that two lines don't share. The halves' parities add up to that of all."""
    differ = [a(c).bitwiseXOR(b(c)) for c in BITS]
    halves = F.bit_count(differ[0]) + F.bit_count(differ[1])
    return F.when((_n(a) > SMALL) & (_n(b) > SMALL), halves).otherwise(F.bit_count(differ[0].bitwiseXOR(differ[1])))


def _may_match(a, b, threshold: float) -> Column:
    """Length, positional and bitmap filters for two entries of one key (field -> column).

    The positional filter takes the key for the first that the lines share: at that key no similar pair fails."""
    total = _n(a) + _n(b)
    need = total * (threshold / (1 + threshold)) - 1e-9
    shared = F.least(_after(a), _after(b))
    length = F.least(_n(a), _n(b)) >= F.greatest(_n(a), _n(b)) * threshold - 1e-9
    return length & (shared >= need) & (_apart(a, b) <= total - 2 * need)


FIELDS = ["line", "size", *BITS]


def _as(prefix: str):
    return lambda c: F.col(f"{prefix}_{c}")


def _meetings(entries: DataFrame, threshold: float) -> DataFrame:
    """Pairs (line, y_line, apart, back) of entries that may match, and lists for later.

    ``back`` marks pairs of entries that met only the first line of their key and
    the one before. Where a key has such entries, its whole list is there too, as
    rows with y_line equal to line and the entry's fields.
    """
    # without nulls the optimizer adds no filter to one side only: both sides of the join read one exchange
    dealt = entries.select(*[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ["key", *FIELDS]]).repartition("key")
    of_key = Window.partitionBy("key").orderBy("line")
    so_far = of_key.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = dealt.withColumns({f"first_{c}": F.first(c).over(so_far) for c in FIELDS} | {f"last_{c}": F.lag(c).over(of_key) for c in FIELDS})
    may = [(_as(p)("line") < F.col("line")) & _may_match(F.col, _as(p), threshold) for p in ("first", "last")]
    ranked = ranked.withColumn("back", F.coalesce(may[0] | may[1], F.lit(False)))
    ranked = ranked.withColumn("listed", F.max("back").over(Window.partitionBy("key")))
    asks = ranked.filter((F.col("first_line") < F.col("line")) | F.col("listed")).select("key", *FIELDS, "back", "listed", "first_line", "last_line")
    others = dealt.select("key", *[F.col(c).alias(f"y_{c}") for c in FIELDS])
    y = _as("y")
    itself = F.col("listed") & (y("line") == F.col("line")) & (y("size") == F.col("size"))
    # the line order first: it is cheap and halves the list
    open_to = ~F.col("back") | (y("line") == F.col("first_line")) | (y("line") == F.col("last_line"))
    meets = (y("line") < F.col("line")) & open_to & _may_match(F.col, y, threshold)
    met = asks.join(others, (asks["key"] == others["key"]) & (y("line") <= F.col("line")) & (itself | meets))
    return met.select(asks["key"], *FIELDS, "back", "y_line", _apart(F.col, y).alias("apart"))


def _words_of_pairs(pairs: DataFrame, lines: DataFrame, texts: DataFrame) -> DataFrame:
    """(line, words) of the lines that stand in pairs, and only of those; words as hashes."""
    named = pairs.select("line").union(pairs.select("y_line")).distinct()
    return cut(with_words(lines.join(named, "line"), texts).select("line", words_of(F.col("words"), F.col("odd")).alias("words")), "pair-words")


def _verified(pairs: DataFrame, words: DataFrame, threshold: float) -> DataFrame:
    """The lines of pairs (line, y_line) that are similar."""
    met = pairs.join(words.withColumnRenamed("words", "x"), "line").join(words.select(F.col("line").alias("y_line"), F.col("words").alias("y")), "y_line")
    return met.filter(similarity(F.col("x"), F.col("y")) >= threshold).select("line").distinct()


def _gone(pairs: DataFrame, lines: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The lines of pairs (line, y_line, apart) that are similar; the closest pair of each line first."""
    words = _words_of_pairs(pairs, lines, texts)
    best = pairs.groupBy("line").agg(F.min(F.struct("apart", "y_line")).alias("y")).select("line", "y.y_line")
    gone = cut(_verified(best, words, threshold), "lines-gone")
    others = pairs.select("line", "y_line").join(best, ["line", "y_line"], "left_anti").join(gone, "line", "left_anti")
    both = cut(gone.union(_verified(others, words, threshold)), "lines-gone")
    discard(words, gone)
    return both


def kept_lines(texts: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """(id, text_hash, line_no) of the lines with words that stay, of ``texts`` (id, text_hash, text, odd)."""
    lines = first_lines(texts)
    met = cut(_meetings(_entries(with_words(lines, texts), rarity_levels(texts), threshold), threshold), "line-meetings")
    pairs = cut(met.filter("y_line < line").select("line", "y_line", "apart").distinct(), "line-pairs")
    gone = _gone(pairs, lines, texts, threshold)

    listed = met.filter("y_line = line").select("key", *FIELDS, "back")
    held = listed.filter("back").join(gone, "line", "left_anti")
    others = listed.select("key", *[F.col(c).alias(f"y_{c}") for c in FIELDS])
    again = held.join(others, (held["key"] == others["key"]) & (F.col("y_line") < F.col("line")) & _may_match(F.col, _as("y"), threshold))
    again = again.select("line", others["y_line"], _apart(F.col, _as("y")).alias("apart")).distinct()
    rest = cut(again.join(pairs, ["line", "y_line"], "left_anti"), "line-rest")
    discard(met, pairs)
    more = _gone(rest, lines, texts, threshold)
    kept = cut(lines.join(gone.union(more), "line", "left_anti").select("id", "text_hash", "line_no"), "lines-kept")
    discard(lines, gone, rest, more)
    return kept


def drop_repeated_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, lines_col: str | None = None, kept_col: str | None = None) -> DataFrame:
    """``docs`` with the lines that stay; optional columns count a text's lines and those kept."""
    columns = docs.columns
    key, text_hash, copy, all_lines, staying = (fresh(docs, c) for c in ("line_doc", "line_text_hash", "line_copy", "all_lines", "staying_lines"))
    odd = fresh(docs, "line_odd")
    keyed = docs.withColumns({key: F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)), text_hash: F.xxhash64(text_col)})
    keyed = keyed.withColumn(copy, F.row_number().over(Window.partitionBy(key, text_hash).orderBy(key))).withColumn(odd, odd_space(F.col(text_col)))
    docs = bucketed(keyed, [key, text_hash], "documents_by_text")
    texts = docs.filter((F.col(copy) == 1) & F.col(text_col).isNotNull()).select(F.col(key).alias("id"), F.col(text_hash).alias("text_hash"), F.col(text_col).alias("text"), F.col(odd).alias("odd"))

    kept = kept_lines(texts, threshold=threshold).groupBy("id", "text_hash").agg(F.collect_set("line_no").alias("nos"))
    kept = kept.select(F.col("id").alias("kept_id"), F.col("text_hash").alias("kept_hash"), "nos")
    joined = docs.join(kept.hint("shuffle_hash"), (docs[key] == kept["kept_id"]) & (docs[text_hash] == kept["kept_hash"]), "left")
    text, nos = docs[text_col], F.coalesce(kept["nos"], F.array().cast("array<int>"))
    # explode_outer holds the split text as a column, so that it isn't split anew for each line
    split, stay = F.col(all_lines), F.col(staying)
    joined = joined.select(*docs.columns, nos.alias(staying), F.explode_outer(F.array(F.split(text, "\n"))).alias(all_lines))
    # the places of the lines that stay: kept ones, and those without a word
    wordless = F.filter(F.transform(split, lambda line, i: F.when(~line.rlike(HAS_WORD), i)), lambda i: i.isNotNull())
    whole = F.size(stay) == F.size(split)
    joined = joined.withColumn(staying, F.explode_outer(F.array(F.when(whole, stay).otherwise(F.sort_array(F.array_union(stay, wordless))))))
    fewer = F.array_join(F.transform(stay, lambda i: F.get(split, i)), "\n")
    out = [F.col(c) if c != text_col else F.when(F.col(c).isNull() | whole, F.col(c)).otherwise(fewer).alias(c) for c in columns]
    if lines_col:
        out.append(F.when(F.col(text_col).isNull(), 0).otherwise(F.size(split)).alias(lines_col))
    if kept_col:
        out.append(F.when(F.col(text_col).isNull(), 0).otherwise(F.size(stay)).alias(kept_col))
    return joined.select(*out)


def without_emptied(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``drop_repeated_lines`` for a pipeline: a document whose every line with words went goes too."""
    had = fresh(docs, "had_words")
    marked = docs.withColumn(had, F.coalesce(F.col(text_col).rlike(HAS_WORD), F.lit(False)))
    left = drop_repeated_lines(marked, id_col=id_col, text_col=text_col, threshold=threshold)
    return left.filter(~F.col(had) | F.col(text_col).rlike(HAS_WORD)).drop(had)
