"""Files as tables: texts, markdown sources, binary vector files, pages."""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.registry import each_row
from ..functions.text import document_id
from ..operators.store import VECTORS, append, collisions, from_spec
from ..tables import materialize
from . import vect
from .vect import format_vectors  # noqa: F401

STORE = [c.split()[0] for c in VECTORS.split(", ")]

def parse_vectors(data: bytes) -> list[tuple]:
    """Rows (document_id, section_idx, start, end, vec_idx, vec) of one file's bytes; ValueError for another format or version."""
    file = pa.BufferReader(data)
    head = vect.read_head(file)
    batches = vect.section_rows(file, head, 0, len(head.index))
    return [(name, s, start, end, i, vec) for b in batches for name, _, s, start, end, i, vec in zip(*(c.to_pylist() for c in b.columns))]


def read_vector_files(spark: SparkSession, path: str) -> DataFrame:
    """The store in all ``*.bin`` files below ``path`` (or in one file); documents are ordered by path. A broken file fails the read."""
    return vect.read(spark, path).select(*STORE)


def open_store(spark: SparkSession, source: str | bytes | DataFrame) -> DataFrame:
    """A store from what is given: a path, one vector file's bytes, or rows of specs (or of vectors, which pass through)."""
    if isinstance(source, str):
        return read_vector_files(spark, source)
    if isinstance(source, bytes | bytearray):
        rows = [(r[0], 0, *r[1:]) for r in parse_vectors(bytes(source))]
        return spark.createDataFrame(rows, VECTORS)
    if isinstance(source, DataFrame):
        return source if "vec" in source.columns else from_spec(source)
    raise TypeError(f"neither a path, bytes nor rows: {type(source).__name__}")


def load_store(store: DataFrame, path: str, *, clear: bool = True) -> DataFrame:
    """The store in ``path``, instead of ``store`` or (``clear`` false) behind it: all of it or, if a file is broken, a failure."""
    read = materialize(read_vector_files(store.sparkSession, path), "loaded-store")
    return read if clear else append(store, read)


def add_paths(store: DataFrame, *paths: str) -> tuple[DataFrame, DataFrame]:
    """(store with every path that could be read as a whole, failures (path, error)): a broken file keeps out its own path only.

    All paths are read side by side by one scan; the failures are a row for each path at most.
    """
    spark = store.sparkSession
    rows = materialize(vect.read(spark, *paths, mode="permissive"), "added-store")
    first = rows.filter("error is not null").groupBy("root").agg(F.min(F.struct("path", "error")).alias("first"))
    whole = F.when(F.col("first.path") == F.col("root"), F.col("first.error")).otherwise(F.concat("first.path", F.lit(": "), "first.error"))
    failures = first.select(F.col("root").alias("path"), whole.alias("error"))
    fine = rows.join(failures.select(F.col("path").alias("root")), "root", "left_anti")
    # numbers go on from one path that was read to the next; this table has a row for each path
    earlier = Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    spans = fine.groupBy("root").agg(F.min("doc_ord").alias("first"), (F.max("doc_ord") - F.min("doc_ord") + 1).alias("n"))
    shift = spans.select("root", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).cast("int").alias("shift"))
    placed = fine.join(shift, "root").withColumn("doc_ord", F.col("doc_ord") + F.col("shift"))
    return append(store, placed.select(*STORE)), failures


def write_vector_files(store: DataFrame, folder: str) -> int:
    """Writes ``theme/stem.bin`` per document below a folder that all executors reach: all files, or none. The number of files."""
    vect.write(store, folder)
    return store.select("document_id").distinct().count()


def list_files(spark: SparkSession, path: str, extensions: tuple[str, ...] = ("txt", "md", "docx"), blacklist: tuple[str, ...] = (), newer_than: str | None = None, recursive: bool = True) -> DataFrame:
    """(path, modificationTime, length) of files by extension; a blacklist entry hides a path it equals, starts or names as a sub-path."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    files = (reader.option("modifiedAfter", newer_than) if newer_than else reader).load(path).select("path", "modificationTime", "length")
    files = files.filter(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*extensions))
    for entry in blacklist:
        files = files.filter(~is_blacklisted(F.col("path"), entry))
    return files


def is_blacklisted(path: Column, entry: str) -> Column:
    plain, entry = F.regexp_replace(path, "^[a-z]+:/+", "/"), entry.strip("/")
    return (plain == "/" + entry) | plain.startswith(f"/{entry}/") | plain.contains(f"/{entry}/") | plain.endswith("/" + entry)


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """(document_id, path, content) of all markdown files below ``path``; fails if two files have one id."""
    texts = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(path, wholetext=True)
    rows = texts.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    out = rows.select(document_id(F.col("path")).alias("document_id"), "path", "content")
    twice = [r[0] for r in collisions(out).limit(5).collect()]
    if twice:
        raise ValueError(f"document ids collide: {', '.join(twice)}")
    return out


def output_path(document: Column, folder: str) -> Column:
    return F.concat(F.lit(folder.rstrip("/") + "/"), F.replace(document, F.lit("|"), F.lit("/")), F.lit(".bin"))


class _Markdown(HTMLParser):
    """Headings, paragraphs, lists and links of a page as markdown."""

    SKIP = {"script", "style", "head", "noscript", "template"}
    BREAKS = {"p", "div", "article", "section", "ul", "ol", "table", "tr", "blockquote", "header", "footer", "nav", "main", "aside"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.skipped = [], 0

    def handle_starttag(self, tag, attrs):
        if tag in self.SKIP:
            self.skipped += 1
        elif len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag == "li":
            self.out.append("\n- ")
        elif tag == "br":
            self.out.append("\n")
        elif tag in self.BREAKS:
            self.out.append("\n\n")

    def handle_endtag(self, tag):
        if tag in self.SKIP:
            self.skipped = max(0, self.skipped - 1)
        elif tag in self.BREAKS or len(tag) == 2 and tag[0] == "h":
            self.out.append("\n\n")

    def handle_data(self, data):
        if not self.skipped:
            text = " ".join(data.split())
            self.out.append(" " * data[:1].isspace() + text + " " * (data[-1:].isspace() and text != ""))


def to_markdown(html: str | None) -> str:
    import re

    parser = _Markdown()
    parser.feed(html or "")
    parser.close()
    joined = re.sub(r" {2,}", " ", "".join(parser.out))
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]*\n[ \t]*", "\n", joined)).strip()


def html_to_markdown(html: Column | str) -> Column:
    return each_row(to_markdown, "string")(html)
