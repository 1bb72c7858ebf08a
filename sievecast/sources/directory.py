"""A data source of the source files below a folder: paths are listed and cut first, contents are read by tasks for the chosen ones alone."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

#: Files that one task reads at most, and bytes after which a batch of contents is handed on.
FILES_A_TASK, BATCH_BYTES = 64, 1 << 24
_SCHEMA = pa.schema([("file_path", pa.string()), ("content", pa.string())])


def open_folder(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return pa.fs.FileSystem.from_uri(path) if re.match(r"[a-z0-9+.-]+://", path) else (pa.fs.LocalFileSystem(), path)


def walk(fs: pa.fs.FileSystem, folder: str, skipped: frozenset[str]) -> Iterator[tuple[str, int]]:
    """(path, length) of the files below a folder, by path, folder by folder: who stops early has not listed the rest. Folders that can't be listed are left out."""
    waiting = [(folder, None)]
    while waiting:
        path, length = heapq.heappop(waiting)
        if length is not None:
            yield path, length
            continue
        try:
            found = fs.get_file_info(pa.fs.FileSelector(path.rstrip("/") or "/"))
        except OSError:
            continue
        for f in found:
            if f.type == pa.fs.FileType.Directory:
                if f.base_name not in skipped:
                    heapq.heappush(waiting, (f.path + "/", None))
            elif f.type == pa.fs.FileType.File:
                heapq.heappush(waiting, (f.path, f.size))


class Chosen(InputPartition):
    """Files that one task reads."""

    def __init__(self, paths: list[str]):
        self.paths = paths


class SourceFilesReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.most = int(options["most"]) if options.get("most") else None
        self.longest = int(options.get("longest", 0)) or None
        self.each = int(options.get("filesPerTask", FILES_A_TASK))
        self.wanted = re.compile(options.get("pattern", ""))
        self.unwanted = re.compile(options["without"]) if options.get("without") else None
        self.skipped = frozenset(filter(None, options.get("skippedFolders", "").split(",")))
        self.only: frozenset[str] | None = None
        self.prefix = ""

    def partitions(self) -> list[InputPartition]:
        fs, folder = open_folder(self.path)
        chosen = []
        for path, length in walk(fs, folder.rstrip("/") + "/", self.skipped):
            if self.most is not None and len(chosen) >= self.most:
                break
            if not self.wanted.search(path) or (self.unwanted and self.unwanted.search(path)) or (self.longest and length > self.longest):
                continue
            if (self.only is None or path in self.only) and path.startswith(self.prefix):
                chosen.append(path)
        return [Chosen(chosen[k : k + self.each]) for k in range(0, len(chosen), self.each)] or [Chosen([])]

    def read(self, partition: Chosen) -> Iterator[pa.RecordBatch]:
        fs, _ = open_folder(self.path)
        paths, contents, size = [], [], 0
        for path in partition.paths:
            try:
                with fs.open_input_stream(path) as f:
                    text = f.read().decode("utf-8", "replace")
            except OSError:
                text = None
            paths.append(path)
            contents.append(text)
            size += len(text or "")
            if size >= BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.string())], schema=_SCHEMA)
                paths, contents, size = [], [], 0
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.string())], schema=_SCHEMA)


class PushingReader(SourceFilesReader):
    """A reader that takes filters, which Spark allows only where ``spark.sql.python.filterPushdown.enabled`` is set."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality, lists and prefixes of paths choose what is listed, and so what is read."""
        for f in filters:
            values = {EqualTo: lambda: frozenset([f.value]), In: lambda: frozenset(f.value)}.get(type(f)) if getattr(f, "attribute", None) == ("file_path",) else None  # noqa: B023
            if values is not None:
                self.only = values() if self.only is None else self.only & values()
            elif isinstance(f, StringStartsWith) and f.attribute == ("file_path",) and (f.value.startswith(self.prefix) or not self.prefix):
                self.prefix = f.value
            else:
                yield f


class SourceFiles(DataSource):
    """``spark.read.format("source_files").option("path", ...)``: ``file_path, content``; content is null for a file that can't be read.

    Options: ``pattern`` and ``without`` (regular expressions on paths), ``skippedFolders`` (names, by comma),
    ``longest`` (bytes), ``most`` (files, the first by path: the listing stops there), ``filesPerTask``.
    With ``pushdown`` (which needs ``spark.sql.python.filterPushdown.enabled``), filters on file_path reach the listing.
    """

    @classmethod
    def name(cls) -> str:
        return "source_files"

    def schema(self) -> str:
        return "file_path string, content string"

    def reader(self, schema) -> SourceFilesReader:
        return PushingReader(self.options) if str(self.options.get("pushdown", "")).lower() == "true" else SourceFilesReader(self.options)
