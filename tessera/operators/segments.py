"""Segments, headers and sections of texts as table functions.

One row per text goes in, rows of spans come out: ``segments`` (start, end,
header level, flags), ``sections`` (spans with their heading trail), ``section_tree``
and ``subsegments`` (clauses, phrases, words and word pairs). Offsets are code points.

A small function cuts a text into pieces, because a dot in a number, a name or an
address ends nothing. All else is columns: a piece goes with the one before it or
begins a segment by what stands between them; a heading stands alone between blanks;
paragraphs and headings are numbered by windows over a text's rows, which are written
once, and the headings' trails are an aggregate of each text's headings, joined to what
stands under them.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.registry import each_row
from ..functions.text import HONORIFICS, bucket, word_count
from ..tables import materialize

# What a dot does not end.
PROTECTED = [
    r"(?i)\b(?:https?|ftp)://\S+|\bwww\.\S+",
    r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    r"\b(?:[A-Za-z]\.){2,}",
    r"\b(?:[A-Za-z]+|\d+)(?:\.(?:[A-Za-z]+|\d+)){2,}\b",
    r"\b\d{1,3}(?:,\d{3})+\.\d+\b|\b\d+\.\d+\b|(?<!\w)\.\d+\b",
    r"\b[\w-]+(?:\.[A-Za-z0-9]{1,8}){1,2}\b",
    r"(?m)^[ \t]*(?:\d+|[A-Za-z]|[ivxlcdmIVXLCDM]+)\.(?=\s)",
    r"\b(?:" + "|".join(h.replace(".", r"\.").replace(" ", r"\s") for h in HONORIFICS) + r")\.",
]
# Words that aren't worth a span of their own.
STOP_WORDS = set(
    "and or but nor yet so although if then else which that because however therefore thus "
    "this these those they them their theirs it its itself when where while after before "
    "some such more most many other another of in on to for by as at is are was were be been being a an the "
    "between among across through within against during despite under over into onto upon from with without "
    "use uses used using have has had having make makes made making take takes took taking give gives gave giving".split()
)
# What stands between pieces, a rule, and the numbers of a heading such as ``1.2 Title`` or ``A) Title``.
EDGE, SPACE, ENDS = " \t\n\v\f\r!,.:;?", " \t\n\v\f\r", "\n\v\f\r!.;?"
RULE = re.compile(r"([*+\-=_~])\1{2,}\Z")
TOKEN = r"(?:\d+|[IVXLCDM]{2,7}|[ivxlcdm]{2,7}|[A-Za-z])"
NUMBERED = rf"(?U)^\s*[(§]?\s*((?:{TOKEN}[.)\-/:](?!\s*[.)\-/:])\s*)+(?:{TOKEN})?)\s*[.):]?\s+"
COUNTED = rf"(?U){TOKEN}(?=[.)\-/:\s]|\z)"

KEEP = [re.compile(p, re.ASCII) for p in PROTECTED]
CUT = re.compile(f"[{ENDS}]")


def cut_pieces(text: str | None) -> list[dict]:
    """The pieces of a text between line ends and ! . ; ?, trimmed, but for rules; each with the ``gap`` since the one before and whether a rule stands there."""
    text = text or ""
    kept = bytearray(len(text))
    for pattern in KEEP:
        for m in pattern.finditer(text):
            if not any(kept[m.start() : m.end()]):
                kept[m.start() : m.end()] = b"\1" * (m.end() - m.start())
    first, last = 0, len(text)
    while first < last and text[first] in EDGE and not kept[first]:
        first += 1
    while last > first and text[last - 1] in EDGE and not kept[last - 1]:
        last -= 1
    marks = [m.start() for m in CUT.finditer(text, first, last) if not kept[m.start()]]
    out, before, ruled = [], first, False
    for a, b in zip([first, *[i + 1 for i in marks]], [*marks, last]):
        piece = text[a:b].strip(SPACE)
        if RULE.match(piece):
            ruled = True
        elif piece:
            a += len(text[a:b]) - len(text[a:b].lstrip(SPACE))
            out.append({"start": a, "end": a + len(piece), "text": piece, "gap": text[before:a], "ruled": ruled})
            before, ruled = a + len(piece), False
    return out


def _pieces(text: Column) -> Column:
    return each_row(cut_pieces, "array<struct<start:int,end:int,text:string,gap:string,ruled:boolean>>")(text)


def _segmented(pieces: Column, headers: bool) -> Column:
    """Segments, structs of start, end, text, level, title_offset and flags, of an array of pieces."""
    held = lambda value, use: F.transform(F.array(value), use)[0]

    def flags(kept: Column) -> Column:
        """Pieces with whether blank lines stand before, and whether they begin a segment."""
        lines = lambda y: F.length(y["gap"]) - F.length(F.replace(y["gap"], F.lit("\n"), F.lit("")))
        return F.transform(kept, lambda y, i: F.struct(
            y.alias("x"), ((i > 0) & ~y["ruled"] & (lines(y) > 1)).alias("blank"),
            ((i == 0) | y["ruled"] | (lines(y) > 1) | (F.btrim(y["gap"], F.lit(SPACE)) != "")).alias("begins"),
        ))

    def joined(kept: Column) -> Column:
        """One struct for each run of pieces that begins with one that ``begins``."""
        places = F.filter(F.transform(kept, lambda y, i: F.when(y["begins"], i)), lambda i: i.isNotNull())

        def one(at: Column) -> Column:
            def row(i: Column, k: Column) -> Column:
                n = F.coalesce(F.get(at, k + 1), F.size(kept)) - i
                first, last = F.get(kept, i), F.get(kept, i + n - 1)
                text = F.array_join(F.transform(F.slice(kept, i + 1, n), lambda y, j: F.when(j == 0, y["x"]["text"]).otherwise(F.concat(y["x"]["gap"], y["x"]["text"]))), "")
                return F.struct(first["x"]["start"].alias("start"), last["x"]["end"].alias("end"), text.alias("text"), first["x"]["gap"].alias("gap"), first["blank"].alias("blank_before"), first["x"]["ruled"].alias("rule_before"), (n > 1).alias("newline"))

            return F.transform(at, row)

        return held(places, one)

    def headed(rows: Column) -> Column:
        def row(x: Column, i: Column) -> Column:
            apart = lambda y: y["blank_before"] | y["rule_before"]
            alone = ((i == 0) | apart(x)) & ((i + 1 == F.size(rows)) | F.coalesce(apart(F.get(rows, i + 1)), F.lit(False))) & ~x["newline"]
            marks = F.length(x["text"]) - F.length(F.ltrim(x["text"], F.lit("#")))
            body = F.regexp_replace(F.ltrim(x["text"], F.lit("#")), r"(?U)^\s+", "")
            own = F.when(marks > 0, body).otherwise(x["text"])
            numbers = F.regexp_count(F.btrim(F.regexp_extract(own, NUMBERED, 1), F.lit(" .):")), F.lit(COUNTED))
            offset = F.when(numbers > 0, F.length(F.regexp_extract(own, NUMBERED, 0))).otherwise(0)
            level = F.when(~F.lit(headers) | ~alone, 0).when(marks > 0, marks).otherwise(numbers)
            shift = F.when(marks > 0, F.length(x["text"]) - F.length(body)).otherwise(0)
            return F.struct(*[x[c].alias(c) for c in ("start", "end", "text", "gap", "blank_before", "rule_before", "newline")], level.cast("int").alias("level"), F.when(level > 0, shift + offset).otherwise(0).cast("int").alias("title_offset"))

        return F.transform(rows, row)

    return held(held(held(pieces, flags), joined), headed)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row for each segment of each text, with ``row`` (the text's own number), idx, segment ``s`` and ``heading``, the number of headings up to it.

    A text without segments has a row with a null ``s``. The rows are written once: every
    text has its number, whatever its id.
    """
    numbered = docs.select(F.col(id_col).alias("id"), F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("length"), F.monotonically_increasing_id().alias("row"), _segmented(_pieces(F.col(text_col)), True).alias("all"))
    held = materialize(numbered, "segmented").select("row", "id", "length", F.posexplode_outer("all").alias("idx", "s"))
    upto = Window.partitionBy("row").orderBy("idx")
    return held.withColumn("heading", F.coalesce(F.sum((F.col("s.level") > 0).cast("int")).over(upto), F.lit(0)))


def _trails(rows: DataFrame) -> DataFrame:
    """(row, heading, trail): for each heading the headings around it and itself, as (heading, level, title, start)."""
    title = F.regexp_replace(F.substring(F.col("s.text"), F.col("s.title_offset") + 1, F.length("s.text")), r"(?U)^\s+|\s+$", "")
    one = F.struct("heading", F.col("s.level").alias("level"), title.alias("title"), F.col("s.start").alias("start"))
    own = rows.filter("s.level > 0").groupBy("row").agg(F.array_sort(F.collect_list(one)).alias("hs"))
    none = F.array().cast("array<struct<heading:bigint,level:int,title:string,start:int>>")
    # a heading closes those of its level or deeper; the trails so far are carried along
    step = lambda acc, h: F.struct(*[F.array_append(F.filter(acc["open"], lambda o: o["level"] < h["level"]), h).alias("open")])
    grown = lambda acc, h: F.transform(F.array(step(acc, h)["open"]), lambda o: F.struct(o.alias("open"), F.array_append(acc["all"], o).alias("all")))[0]
    begin = F.struct(none.alias("open"), F.array().cast("array<array<struct<heading:bigint,level:int,title:string,start:int>>>").alias("all"))
    trails = F.aggregate("hs", begin, grown, lambda acc: acc["all"])
    return own.select("row", F.posexplode(trails).alias("nth", "trail")).select("row", (F.col("nth") + 1).cast("long").alias("heading"), "trail")


def section_tree(docs: DataFrame, id_col: str = "document_id", text_col: str = "content") -> DataFrame:
    """One row per heading: node, parent, depth, level, title, start, end and its own paragraphs.

    Node 0 is the text itself; it is left out if one heading holds all. A heading ends
    where the next one of its level or above begins, or with the text.
    """
    rows = _rows(docs, id_col, text_col)
    trails = _trails(rows)
    texts = rows.groupBy("row", "id").agg(F.max("length").alias("length"))
    paragraphs = rows.filter("s.level = 0").groupBy("row", "heading").agg(F.count("*").cast("int").alias("paragraphs"))
    # the last heading whose trail holds a heading is the last one inside it
    last = trails.select("row", F.col("heading").alias("inside"), F.explode("trail.heading").alias("heading")).groupBy("row", "heading").agg(F.max("inside").alias("inside"))
    starts = trails.select("row", (F.col("heading") - 1).alias("inside"), F.element_at("trail", -1)["start"].alias("next"))
    own, up = F.element_at("trail", -1), F.try_element_at("trail", F.lit(-2))
    nodes = trails.join(last, ["row", "heading"]).join(starts, ["row", "inside"], "left").join(texts, "row")
    nodes = nodes.select("row", "id", F.col("heading").alias("node"), F.coalesce(up["heading"], F.lit(0)).alias("parent"), F.size("trail").alias("depth"), own["level"].alias("level"), own["title"].alias("title"), own["start"].alias("start"), F.coalesce("next", "length").alias("end"))
    root = texts.select("row", "id", F.lit(0).cast("long").alias("node"), F.lit(None).cast("long").alias("parent"), F.lit(0).alias("depth"), F.lit(0).alias("level"), F.lit(None).cast("string").alias("title"), F.lit(0).alias("start"), F.col("length").alias("end"))
    every = root.unionByName(nodes).join(paragraphs.withColumnRenamed("heading", "node"), ["row", "node"], "left").withColumn("paragraphs", F.coalesce("paragraphs", F.lit(0)))
    whole = every.groupBy("row").agg(F.count_if(F.col("parent") == 0).alias("tops"), F.max(F.when(F.col("node") == 0, F.col("paragraphs"))).alias("loose"))
    single = (F.col("tops") == 1) & (F.col("loose") == 0)
    out = every.join(whole, "row").filter(~single | (F.col("node") > 0))
    return out.select(F.col("id").alias(id_col), F.col("node").cast("int").alias("node"), F.when(~single | (F.col("parent") > 0), F.col("parent")).cast("int").alias("parent"), F.when(single, F.col("depth") - 1).otherwise(F.col("depth")).alias("depth"), "level", "title", "start", "end", "paragraphs")


def partition_report(tree: DataFrame, id_col: str = "document_id") -> DataFrame:
    """(id, report): each text's headings as indented lines."""
    line = F.concat(F.repeat(F.lit("  "), F.col("depth")), F.coalesce("title", F.lit("(text)")), F.lit(" ["), F.col("start").cast("string"), F.lit(","), F.col("end").cast("string"), F.lit("]"))
    lines = tree.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("node", line.alias("line")))).alias("lines"))
    return lines.select(id_col, F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("report"))


def subsegment(text: str, at: int) -> list[tuple[int, int, int]]:
    """(tier, start, end) in a sentence that stands at ``at``: clauses (: ;), phrases (quotes, brackets, commas), long words, pairs and triplets of them."""
    out = []
    for tier, cut in ((0, ":;"), (1, "\"(),:;[]")):
        parts = []
        for m in re.finditer(f"[^{re.escape(cut)}]+", text):
            inner = m[0].strip(SPACE)
            if inner:
                a = m.start() + len(m[0]) - len(m[0].lstrip(SPACE))
                parts.append((tier, at + a, at + a + len(inner)))
        out += parts if len(parts) > 1 else []
    words = [(m.start() + at, m.end() + at) for m in re.finditer(r"\w[\w'’-]*", text) if len(m[0]) > 4 and m[0].lower() not in STOP_WORDS]
    for tier, n in ((2, 1), (3, 2), (4, 3)):
        out += [(tier, words[i][0], words[i + n - 1][1]) for i in range(len(words) - n + 1)]
    return out


def segments(docs: DataFrame, id_col: str = "document_id", text_col: str = "content", headers: bool = False) -> DataFrame:
    """One row per sentence: idx, start, end, level and title_offset (with ``headers``), and what stands before it."""
    found = docs.select(F.col(id_col), F.posexplode(_segmented(_pieces(F.col(text_col)), headers)).alias("idx", "s"))
    return found.select(id_col, "idx", "s.start", "s.end", "s.level", "s.title_offset", "s.blank_before", "s.rule_before", "s.newline")


def subsegments(docs: DataFrame, id_col: str = "document_id", text_col: str = "content") -> DataFrame:
    """One row per clause, phrase, long word, pair and triplet of them in each sentence: idx, tier, start, end."""
    found = docs.select(F.col(id_col), F.posexplode(_segmented(_pieces(F.col(text_col)), False)).alias("idx", "s"))

    inside = each_row(lambda text, at: [dict(zip(("tier", "start", "end"), x)) for x in subsegment(text, at)], "array<struct<tier:int,start:int,end:int>>")
    return found.select(id_col, "idx", F.explode(inside("s.text", "s.start")).alias("x")).select(id_col, "idx", "x.*")


def sections(docs: DataFrame, id_col: str = "document_id", text_col: str = "content") -> DataFrame:
    """One row per paragraph, in order: its span, place under its heading, breadcrumbs, content, sentences, word count, bucket and chunks.

    A paragraph begins after a heading, after blank lines and at the beginning; the first
    one under a heading has the heading in its span.
    """
    rows = _rows(docs, id_col, text_col).filter("s is not null")
    upto, under = Window.partitionBy("row").orderBy("idx"), Window.partitionBy("row", "heading").orderBy("idx")
    begins = (F.col("s.level") == 0) & (F.coalesce(F.lag("s.level").over(upto) > 0, F.lit(True)) | F.col("s.blank_before"))
    rows = rows.withColumn("begins", begins.cast("int"))
    rows = rows.withColumns({"section_idx": (F.sum("begins").over(upto) - 1).cast("int"), "paragraph": (F.sum("begins").over(under) - 1).cast("int")})
    part = F.struct("idx", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.text").alias("text"), F.col("s.gap").alias("gap"))
    made = rows.filter("s.level = 0").groupBy("row", "id", "heading", "section_idx", "paragraph").agg(F.array_sort(F.collect_list(part)).alias("p"))
    made = made.join(_trails(rows), ["row", "heading"], "left")
    content = F.array_join(F.transform("p", lambda x, i: F.when(i == 0, x["text"]).otherwise(F.concat(x["gap"], x["text"]))), "")
    start = F.when((F.col("paragraph") == 0) & F.col("trail").isNotNull(), F.element_at("trail", -1)["start"]).otherwise(F.col("p")[0]["start"])
    titles = F.coalesce(F.transform("trail", lambda t: t["title"]), F.array().cast("array<string>"))
    t = made.select(F.col("id").alias(id_col), "section_idx", start.alias("range_start"), F.element_at("p", -1)["end"].alias("range_end"), "paragraph", content.alias("content"), F.transform("p", lambda x: x["text"]).alias("sentences"), F.array_join(titles, ", ").alias("breadcrumbs"))
    t = t.withColumn("word_count", word_count(F.col("content"))).withColumn("bucket", bucket(F.col("word_count")))
    return t.withColumn("chunks", chunks(F.col("content"), F.col("sentences"), F.col("bucket")))


def chunks(content: Column, sentences: Column, size: Column, words: int = 80) -> Column:
    """Short texts are one chunk; medium ones join sentences with ". " up to about ``words`` words; long ones give a chunk per sentence."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))
    closed = lambda a: F.when(a["open"] == "", a["done"]).otherwise(F.array_append(a["done"], a["open"]))
    both = lambda a, s: F.when(a["open"] == "", s).otherwise(F.concat(a["open"], F.lit(". "), s))
    full = lambda a, s: (a["open"] != "") & (word_count(both(a, s)) > words)
    step = lambda a, s: F.struct(F.when(full(a, s), closed(a)).otherwise(a["done"]).alias("done"), F.when(full(a, s), s).otherwise(both(a, s)).alias("open"))
    medium = F.aggregate(sentences, start, step, closed)
    return F.when(size == "short", F.array(content)).when(size == "long", sentences).otherwise(medium)


def encode_sections(sections_df: DataFrame, encoder: Column, id_col: str = "document_id") -> DataFrame:
    """Vectors table from sections: the breadcrumbs, if any, and every chunk. ``encoder`` reads the column ``text``; sections without vectors go."""
    texts = F.concat(F.when(F.col("breadcrumbs") != "", F.array("breadcrumbs")).otherwise(F.array().cast("array<string>")), "chunks")
    rows = sections_df.withColumn("doc_ord", F.lit(0)).select(F.col(id_col).alias("document_id"), "doc_ord", "section_idx", "range_start", "range_end", F.posexplode(texts).alias("vec_idx", "text"))
    return rows.withColumn("vec", encoder).drop("text").filter(F.col("vec").isNotNull())
