"""Vector files as a Spark data source, ``format("vect")``, and versioned folders of them.

Reading: files are listed once, when the scan is planned; they are numbered by path
and packed into partitions of about ``splitBytes``, and a larger file is cut by its
sections, so that a task reads the header, the index and its own range of floats.
Conditions on ``document_id`` and ``section_idx`` reach the scan: a file of another
document costs its header only.

Writing takes (document_id, content) rows, one vector file each. Tasks write below
``_job-<id>``; the driver moves what the successful attempts have written, so a failed
task or job leaves nothing.

A versioned folder never changes a file. A commit adds files and then a manifest that
names all files of the new version; a reader takes the newest manifest, or the one it
is told, and goes on with it whatever is committed meanwhile.

Files are reached through Arrow's file systems (mounted folders, HDFS, object stores)
by every executor; the folder must be shared.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from ..operators.store import VECTORS

# The binary vector file. Ten little-endian 32-bit words: magic,
# version, dimension, sections, vectors, id bytes, and the byte offsets of id, index
# and vectors, and the file's size; then the id padded to 4 bytes, the index
# (start, end, vectors per section) and 32-bit floats.
MAGIC, VERSION, HEADER = 0x56454354, 2, struct.Struct("<10I")

SCHEMA = VECTORS + ", path string, root string, error string"
ARROW = pa.schema([("document_id", pa.string()), ("doc_ord", pa.int32()), ("section_idx", pa.int32()), ("range_start", pa.int32()), ("range_end", pa.int32()), ("vec_idx", pa.int32()), ("vec", pa.list_(pa.float32())), ("path", pa.string()), ("root", pa.string()), ("error", pa.string())])
SPLIT_BYTES = 32 << 20
MANIFEST = "_manifest-"


class Broken(ValueError):
    """A file that isn't a vector file of this version, or not a whole one."""


@dataclass(frozen=True)
class Head:
    """What stands before a file's vectors."""

    document_id: str
    dim: int
    index: np.ndarray  # start, end, vectors of every section
    vec_at: int


def read_head(file) -> Head:
    """Header, id and index of a random-access file, checked against its size."""
    size = file.size()
    if size < HEADER.size:
        raise Broken("too short")
    magic, version, dim, sections, vectors, id_bytes, id_at, index_at, vec_at, whole = HEADER.unpack(file.read_at(HEADER.size, 0))
    if magic != MAGIC or version != VERSION:
        raise Broken("not a vector file of this version")
    if whole > size or max(id_at + id_bytes, index_at + 12 * sections, vec_at + 4 * dim * vectors) > whole:
        raise Broken("the file is shorter than it says")
    try:
        name = file.read_at(id_bytes, id_at).decode()
    except UnicodeDecodeError as e:
        raise Broken("the id is not UTF-8") from e
    index = np.frombuffer(file.read_at(12 * sections, index_at), "<u4").reshape(-1, 3).astype(np.int64)
    if index[:, 2].sum() != vectors:
        raise Broken("the index counts other vectors than the header")
    return Head(name, dim, index, vec_at)


def format_vectors(name: str, sections: list[tuple[int, int, np.ndarray]], dim: int) -> bytes:
    """A vector file from (start, end, vectors) sections."""
    raw = name.encode()
    padded = raw + bytes(-len(raw) % 4)
    index = np.array([(s, e, len(v)) for s, e, v in sections], "<u4").reshape(-1, 3).tobytes()
    values = b"".join(np.asarray(v, "<f4").tobytes() for _, _, v in sections)
    index_at = HEADER.size + len(padded)
    vec_at = index_at + len(index)
    head = HEADER.pack(MAGIC, VERSION, dim, len(sections), sum(len(v) for _, _, v in sections), len(raw), HEADER.size, index_at, vec_at, vec_at + len(values))
    return head + padded + index + values


def section_rows(file, head: Head, first: int, last: int, sections: set[int] | None = None) -> Iterator[pa.RecordBatch]:
    """The vectors of sections ``first`` to ``last`` (exclusive) of an open file, without doc_ord, path and root."""
    before = np.concatenate(([0], head.index[:, 2].cumsum()))
    for s in range(first, last):
        start, end, n = head.index[s].tolist()
        if n == 0 or sections is not None and s not in sections:
            continue
        raw = file.read_at(4 * head.dim * n, head.vec_at + 4 * head.dim * int(before[s]))
        vec = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * head.dim, pa.int32()), pa.array(np.frombuffer(raw, "<f4")))
        same = lambda x: pa.array(np.full(n, x, np.int32))
        yield pa.RecordBatch.from_arrays([pa.array([head.document_id] * n), same(0), same(s), same(start), same(end), pa.array(np.arange(n, dtype=np.int32)), vec], names=ARROW.names[:7])


def locate(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system and the path in it."""
    return arrow_fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (arrow_fs.LocalFileSystem(), path)


def list_vector_files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of ``path`` if it is a file, else of all ``*.bin`` below it but for folders of unfinished jobs; by path."""
    files, at = locate(path)
    found = files.get_file_info(at)
    if found.type == arrow_fs.FileType.File:
        return [(at, found.size)]
    if found.type == arrow_fs.FileType.NotFound:
        raise FileNotFoundError(f"no such folder: {path}")
    inside = files.get_file_info(arrow_fs.FileSelector(at, recursive=True))
    hidden = lambda p: any(part.startswith("_") for part in p[len(at) :].split("/"))
    return sorted((f.path, f.size) for f in inside if f.type == arrow_fs.FileType.File and f.path.endswith(".bin") and not hidden(f.path))


def versions(path: str) -> list[int]:
    """The versions of a versioned folder, oldest first; empty if it has none."""
    files, at = locate(path)
    if files.get_file_info(at).type != arrow_fs.FileType.Directory:
        return []
    names = [f.base_name for f in files.get_file_info(arrow_fs.FileSelector(at))]
    return sorted(int(n[len(MANIFEST) : -5]) for n in names if n.startswith(MANIFEST) and n.endswith(".json"))


def read_manifest(path: str, version: int) -> list[dict]:
    """The files of a version: document_id, path below the folder, bytes; by document id."""
    files, at = locate(path)
    with files.open_input_stream(f"{at}/{MANIFEST}{version:010d}.json") as f:
        return json.loads(f.read())["files"]


def write_manifest(path: str, version: int, entries: list[dict]) -> None:
    """Puts a version in place by one rename; fails if somebody has written that version."""
    files, at = locate(path)
    to = f"{at}/{MANIFEST}{version:010d}.json"
    if files.get_file_info(to).type != arrow_fs.FileType.NotFound:
        raise ValueError(f"version {version} of {path} was committed meanwhile")
    draft = f"{at}/_draft-{uuid.uuid4().hex}"
    with files.open_output_stream(draft) as f:
        f.write(json.dumps({"version": version, "files": sorted(entries, key=lambda e: (e["document_id"], e["path"]))}).encode())
    files.move(draft, to)


@dataclass
class Part(InputPartition):
    """(root, path, doc_ord, share, shares): a share of the sections of each file; ``failed`` are roots that can't be listed."""

    files: list[tuple[str, str, int, int, int]]
    failed: list[tuple[str, str]]


class VectorReader(DataSourceReader):
    def __init__(self, options: dict):
        self.roots = json.loads(options["paths"]) if "paths" in options else [options["path"]]
        self.version = options.get("version")
        self.permissive = options.get("mode", "failfast").lower() == "permissive"
        self.split = int(options.get("splitbytes") or options.get("splitBytes") or SPLIT_BYTES)
        self.ids: set[str] | None = None
        self.sections: set[int] | None = None

    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        for f in filters:
            wanted = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if wanted is not None and f.attribute == ("document_id",) and not self.permissive:
                self.ids = wanted if self.ids is None else self.ids & wanted
            elif wanted is not None and f.attribute == ("section_idx",) and not self.permissive:
                self.sections = wanted if self.sections is None else self.sections & wanted
            else:
                yield f

    def _files(self, root: str) -> list[tuple[str, int]]:
        if self.version is None:
            return list_vector_files(root)
        entries = read_manifest(root, int(self.version))
        at = locate(root)[1]
        return [(f"{at}/{e['path']}", e["bytes"]) for e in entries if self.ids is None or e["document_id"] in self.ids]

    def partitions(self) -> list[Part]:
        pieces, failed, number = [], [], 0
        for root in self.roots:
            try:
                for path, size in self._files(root):
                    shares = max(1, -(-size // self.split))
                    pieces += [((root, path, number, i, shares), size // shares) for i in range(shares)]
                    number += 1
            except OSError as e:
                if not self.permissive:
                    raise
                failed.append((root, str(e)))
        parts, held, taken = [], [], 0
        for piece, size in pieces:
            if held and taken + size > self.split:
                parts.append(Part(held, []))
                held, taken = [], 0
            held.append(piece)
            taken += size
        return [*parts, Part(held, failed)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        fault = lambda root, path, e: pa.RecordBatch.from_pylist([{"path": path, "root": root, "error": str(e)}], ARROW)
        for root, error in partition.failed:
            yield fault(root, root, error)
        for root, path, number, share, shares in partition.files:
            try:
                with locate(root)[0].open_input_file(path) as file:
                    head = read_head(file)
                    if self.ids is not None and head.document_id not in self.ids:
                        continue
                    n = len(head.index)
                    for batch in section_rows(file, head, n * share // shares, n * (share + 1) // shares, self.sections):
                        rows = batch.num_rows
                        columns = [batch.column(0), pa.array(np.full(rows, number, np.int32)), *batch.columns[2:], pa.array([path] * rows), pa.array([root] * rows), pa.nulls(rows, pa.string())]
                        yield pa.RecordBatch.from_arrays(columns, schema=ARROW)
            except (Broken, OSError) as e:
                if not self.permissive:
                    raise Broken(f"{path}: {e}") from e
                if share == 0:
                    yield fault(root, path, e)


@dataclass
class Written(WriterCommitMessage):
    """What an attempt has written: (document_id, path below the attempt's folder, bytes)."""

    attempt: str
    files: list[tuple[str, str, int]]


class VectorWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.versioned = options.get("versioned", "false").lower() == "true"
        self.job = f"_job-{uuid.uuid4().hex}"

    def write(self, iterator) -> Written:
        files, at = locate(self.path)
        attempt, made = f"{self.job}/{uuid.uuid4().hex}", []
        for row in iterator:
            name, content = row["document_id"], bytes(row["content"])
            to = "/".join(p for p in name.split("|") if p not in ("", ".", "..")) + ".bin"
            full = f"{at}/{attempt}/{to}"
            files.create_dir(full.rpartition("/")[0], recursive=True)
            with files.open_output_stream(full) as f:
                f.write(content)
            made.append((name, to, len(content)))
        return Written(attempt, made)

    def commit(self, messages: list[Written | None]) -> None:
        files, at = locate(self.path)
        files.create_dir(at, recursive=True)
        done = [m for m in messages if m is not None]
        names = [to for m in done for _, to, _ in m.files]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("two documents have one file name")
        if self.versioned:
            self._commit_version(files, at, done)
            return
        old = [path for path, _ in list_vector_files(self.path)] if self.overwrite else []
        for m in done:
            for _, to, _ in m.files:
                files.create_dir(f"{at}/{to}".rpartition("/")[0], recursive=True)
                files.move(f"{at}/{m.attempt}/{to}", f"{at}/{to}")
        for path in set(old) - {f"{at}/{to}" for to in names}:
            files.delete_file(path)
        self._clean(files, at)

    def _commit_version(self, files: arrow_fs.FileSystem, at: str, done: list[Written]) -> None:
        known = versions(self.path)
        entries = [{"document_id": name, "path": f"{m.attempt}/{to}", "bytes": n} for m in done for name, to, n in m.files]
        before = read_manifest(self.path, known[-1]) if known and not self.overwrite else []
        twice = {e["document_id"] for e in before} & {e["document_id"] for e in entries}
        if twice:
            self.abort([])
            raise ValueError(f"document ids collide: {', '.join(sorted(twice)[:5])}")
        used = {m.attempt for m in done if m.files}
        for f in files.get_file_info(arrow_fs.FileSelector(f"{at}/{self.job}", allow_not_found=True)):
            if f"{self.job}/{f.base_name}" not in used:  # of an attempt that did not count
                files.delete_dir(f.path)
        write_manifest(self.path, known[-1] + 1 if known else 1, before + entries)

    def abort(self, messages) -> None:
        self._clean(*locate(self.path))

    def _clean(self, files: arrow_fs.FileSystem, at: str) -> None:
        if files.get_file_info(f"{at}/{self.job}").type == arrow_fs.FileType.Directory:
            files.delete_dir(f"{at}/{self.job}")


class VectorFiles(DataSource):
    """``spark.read.format("vect").load(folder)``. Options: ``paths`` (a JSON array, for several folders), ``version``,
    ``mode`` (``failfast``: a broken file fails the read; ``permissive``: it gives a row with ``error``), ``splitBytes``."""

    @classmethod
    def name(cls) -> str:
        return "vect"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> VectorReader:
        return VectorReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> VectorWriter:
        return VectorWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(VectorFiles)


def read(spark: SparkSession, *paths: str, mode: str = "failfast", version: int | None = None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Vectors of all files below ``paths``, with path, root (the path given) and error; documents are numbered in the order of roots and paths."""
    register(spark)
    reader = spark.read.format("vect").option("paths", json.dumps(list(paths))).option("mode", mode).option("splitBytes", str(split_bytes))
    return (reader if version is None else reader.option("version", str(version))).load()


def pack_documents(store: DataFrame) -> DataFrame:
    """(document_id, content): each document of a store as a vector file."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["section_idx", "vec_idx"])
        parts = [(int(g["range_start"].iloc[0]), int(g["range_end"].iloc[0]), np.stack(g["vec"].to_numpy())) for _, g in pdf.groupby("section_idx")]
        name = pdf["document_id"].iloc[0]
        return pd.DataFrame({"document_id": [name], "content": [format_vectors(name, parts, parts[0][2].shape[1])]})

    return store.groupBy("document_id").applyInPandas(run, "document_id string, content binary")


def write(store: DataFrame, folder: str, *, overwrite: bool = False, versioned: bool = False) -> None:
    """Writes ``theme/stem.bin`` for the document ``theme|stem``: all files, or none if a task fails for good."""
    register(store.sparkSession)
    pack_documents(store).write.format("vect").mode("overwrite" if overwrite else "append").option("versioned", str(versioned).lower()).save(folder)


class Versioned:
    """A folder of vector files whose versions don't change.

    ``snapshot`` is a store that stays as it is while others commit; searches that
    begin later see the later version.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def newest(self) -> int | None:
        found = versions(self.folder)
        return found[-1] if found else None

    def snapshot(self, version: int | None = None) -> DataFrame:
        """The store of a version, of the newest without one."""
        version = self.newest() if version is None else version
        if version is None:
            return self.spark.createDataFrame([], VECTORS)
        return read(self.spark, self.folder, version=version).select(*[c.split()[0] for c in VECTORS.split(", ")])

    def reload(self, store: DataFrame) -> int:
        """``store`` instead of what is there; the new version."""
        write(store, self.folder, overwrite=True, versioned=True)
        return self.newest()

    def append(self, store: DataFrame) -> int:
        """``store`` beside what is there; fails, and changes nothing, if a document is there already."""
        write(store, self.folder, versioned=True)
        return self.newest()

    def remove(self, *document_ids: str) -> int:
        """A version without some documents; no file is read or written but the manifest."""
        last = self.newest()
        kept = [e for e in read_manifest(self.folder, last) if e["document_id"] not in set(document_ids)]
        write_manifest(self.folder, last + 1, kept)
        return last + 1

    def vacuum(self, keep: int = 2) -> int:
        """Deletes all but the last ``keep`` versions and the files that only those had; the number of files deleted.

        A search that still reads a deleted version fails, so keep as many as may be read.
        """
        files, at = locate(self.folder)
        found = versions(self.folder)
        used = {e["path"] for v in found[-keep:] for e in read_manifest(self.folder, v)}
        old = {e["path"] for v in found[:-keep] for e in read_manifest(self.folder, v)} - used
        for v in found[:-keep]:
            files.delete_file(f"{at}/{MANIFEST}{v:010d}.json")
        for path in old:
            files.delete_file(f"{at}/{path}")
        return len(old)
