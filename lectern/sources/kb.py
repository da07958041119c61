"""Knowledge files as a data source: ``spark.read.format("kb")`` and ``spark.readStream.format("kb")``.

    kb.register(spark, {".html": kb.Parser("html", read_html)})
    spark.read.format("kb").option("splitBytes", 8 << 20).load("s3://bucket/files")

A task gets paths and parts of files, never contents: small files are packed up to ``splitBytes``, a large one whose parser can split
is read by several tasks, each its range of pages or lines. Nothing is opened to plan a read. Parsers are known by suffix and travel with the source.

Options: ``splitBytes`` (8 MB); ``settle``, for streams, seconds that a file must be unchanged before it is read (1).

Defined results: one row a segment, with the columns of ``SCHEMA``; a file whose suffix no parser has, or that its parser fails on, is one row with ``error`` and
no content, and the other files are read all the same (a file that cannot be opened fails its task, which Spark tries again); pages and lines without text give no row; names that begin with
``.`` or ``_`` are left out; an empty folder gives an empty table. A stream reads the files in the order of their times of change, each once, across restarts; a file that comes with an older time than one already read is not seen.
"""

from __future__ import annotations

import hashlib
import io
import json
import time
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "document_id string, index long, content string, page_number int, source string, total_pages int, file_type string, path string, error string"
ARROW = pa.schema([
    ("document_id", pa.string()), ("index", pa.int64()), ("content", pa.string()), ("page_number", pa.int32()), ("source", pa.string()),
    ("total_pages", pa.int32()), ("file_type", pa.string()), ("path", pa.string()), ("error", pa.string()),
])
#: Bytes of text that leave a task at a time.
SLICE = 4 << 20

#: What a parser gives of a segment: its place in the file, page number, text, and the pages of the file.
Segment = tuple[int, int | None, str, int | None]


@dataclass(frozen=True)
class Parser:
    """``read(file, part, parts)`` gives the segments of that part of a binary file; all parts give each segment once. Without ``splits`` there is one part."""

    kind: str
    read: Callable[[io.RawIOBase, int, int], Iterator[Segment]]
    splits: bool = False


def read_whole(file, part: int, parts: int) -> Iterator[Segment]:
    """The file's text as one segment."""
    yield 0, None, file.read().decode("utf-8-sig", errors="replace"), None


def read_pages(file, part: int, parts: int) -> Iterator[Segment]:
    """A range of a PDF file's pages; needs the optional ``pypdf``, which reads the pages that are asked for."""
    from pypdf import PdfReader

    pages = PdfReader(file).pages
    n = len(pages)
    for i in range(n * part // parts, n * (part + 1) // parts):
        yield i, i + 1, pages[i].extract_text() or "", n


def json_lines(field: str) -> Parser:
    """One segment a line, its ``field``; a segment's place is that of its line's first byte. A line belongs to the part that it begins in."""

    def read(file, part: int, parts: int) -> Iterator[Segment]:
        size = file.seek(0, io.SEEK_END)
        begin, end = size * part // parts, size * (part + 1) // parts
        file.seek(max(0, begin - 1))
        lines = io.BufferedReader(file, 1 << 20)
        at = begin - 1 + len(lines.readline()) if begin else 0  # past the line that holds the byte before, which is the last part's
        while at < end and (line := lines.readline()):
            if line.strip():
                text = json.loads(line).get(field)
                yield at, None, "" if text is None else str(text), None
            at += len(line)

    return Parser("json", read, True)


PARSERS: dict[str, Parser] = {".txt": Parser("txt", read_whole), ".md": Parser("md", read_whole), ".pdf": Parser("pdf", read_pages, True)}


@dataclass
class Files(InputPartition):
    """(path, part, parts) of what a task reads."""

    items: tuple[tuple[str, int, int], ...]


def suffix_of(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return "." + name.rsplit(".", 1)[-1].lower() if "." in name else ""


def located(uri: str) -> tuple[pafs.FileSystem, str, str]:
    """(file system, path, what stands before paths to name them as Spark does)."""
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    system, path = pafs.FileSystem.from_uri(uri)
    return system, path, "file:" if isinstance(system, pafs.LocalFileSystem) else uri[: -len(path)]


def listed(uri: str) -> list[tuple[str, int, int]]:
    """(URI, bytes, time of change in nanoseconds) of a file, or of all files below a folder, in the order of their names."""
    system, path, before = located(uri.rstrip("/"))
    info = system.get_file_info(path)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(uri)
    found = [info] if info.type == pafs.FileType.File else system.get_file_info(pafs.FileSelector(path, recursive=True))
    hidden = lambda p: any(name[:1] in "._" for name in p[len(path) :].split("/") if name)
    return sorted((before + i.path, i.size, i.mtime_ns or 0) for i in found if i.type == pafs.FileType.File and not hidden(i.path))


def planned(files: list[tuple[str, int, int]], parsers: Mapping[str, Parser], split: int) -> list[Files]:
    """Tasks of about ``split`` bytes each."""
    tasks, items, size = [], [], 0
    for path, n_bytes, _ in files:
        parser = parsers.get(suffix_of(path))
        if parser and parser.splits and n_bytes > split:
            parts = -(-n_bytes // split)
            tasks += [Files(((path, part, parts),)) for part in range(parts)]
            continue
        if items and size + n_bytes > split:
            tasks.append(Files(tuple(items)))
            items, size = [], 0
        items.append((path, 0, 1))
        size += n_bytes
    return tasks + [Files(tuple(items))] * bool(items)


def segments_of(task: Files, parsers: Mapping[str, Parser]) -> Iterator[tuple]:
    """Rows of ``SCHEMA``."""
    for path, part, parts in task.items:
        parser, name = parsers.get(suffix_of(path)), path.rsplit("/", 1)[-1]
        key, kind = hashlib.md5(path.encode()).hexdigest(), parser.kind if parser else None
        if parser is None:
            yield key, 0, None, None, name, None, kind, path, f"unsupported file type: {suffix_of(path)}"
            continue
        system, inside, _ = located(path)
        with system.open_input_file(inside) as file:
            try:
                for index, page, text, pages in parser.read(file, part, parts):
                    if text.strip() or not parser.splits:
                        yield key, index, text, page, name, pages, kind, path, None
            except Exception as error:  # the file's fault: say so in its row
                if isinstance(error, OSError):
                    raise
                yield key, 0, None, None, name, None, kind, path, f"{type(error).__name__}: {error}"


def batches_of(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[2] or "") + 200
        if size >= SLICE:
            yield pa.RecordBatch.from_pydict(dict(zip(ARROW.names, zip(*held))), schema=ARROW)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pydict(dict(zip(ARROW.names, zip(*held))), schema=ARROW)


class Reader(DataSourceReader):
    def __init__(self, uri: str, parsers: Mapping[str, Parser], split: int):
        self.uri, self.parsers, self.split = uri, parsers, split

    def partitions(self) -> list[Files]:
        return planned(listed(self.uri), self.parsers, self.split) or [Files(())]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return batches_of(segments_of(partition, self.parsers))


class StreamReader(DataSourceStreamReader):
    """An offset is a time of change: a batch has the files that changed after the last one and up to its own."""

    def __init__(self, uri: str, parsers: Mapping[str, Parser], split: int, settle: float):
        self.uri, self.parsers, self.split, self.settle, self.last = uri, parsers, split, settle, 0

    def initialOffset(self) -> dict:
        return {"at": 0}

    def latestOffset(self) -> dict:
        until = time.time_ns() - int(self.settle * 1e9)  # later files may share a time with the newest
        self.last = max([self.last, *(at for _, _, at in listed(self.uri) if at <= until)])
        return {"at": self.last}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        self.last = max(self.last, end["at"])
        return planned([f for f in listed(self.uri) if start["at"] < f[2] <= end["at"]], self.parsers, self.split) or [Files(())]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return batches_of(segments_of(partition, self.parsers))


def register(spark: SparkSession, parsers: Mapping[str, Parser] | None = None, name: str = "kb") -> None:
    """Make the source known under ``name``, with ``parsers`` by suffix besides, or in place of, ``PARSERS``."""
    known = {**PARSERS, **{k.lower(): p for k, p in (parsers or {}).items()}}
    called = name

    class KnowledgeFiles(DataSource):
        @classmethod
        def name(cls) -> str:
            return called

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> Reader:
            return Reader(self.options["path"], known, int(self.options.get("splitBytes", 8 << 20)))

        def streamReader(self, schema) -> StreamReader:
            return StreamReader(self.options["path"], known, int(self.options.get("splitBytes", 8 << 20)), float(self.options.get("settle", 1)))

    spark.dataSource.register(KnowledgeFiles)
