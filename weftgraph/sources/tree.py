"""A Spark data source for trees of source files: ``spark.read.format("source_tree").load(path)``.

The plan lists the tree once, applies ignore files and the size limit, and packs files in path order into partitions of
about a byte budget, so a task holds no more than the budget (or one file). Files are read by the executors, from any
store that the path's scheme names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urlparse

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from weftgraph.sources.files import CHUNK_BYTES, IGNORED_FOLDERS, MAX_FILE_BYTES

#: Names of files that say what a folder leaves out.
IGNORE_FILES = (".gitignore", ".ignore")


def _expression(pattern: str) -> str:
    """A regular expression of an ignore pattern's path part."""
    out, at = "", 0
    while at < len(pattern):
        if pattern.startswith("**/", at):
            out, at = out + "(?:.*/)?", at + 3
        elif pattern.startswith("**", at):
            out, at = out + ".*", at + 2
        elif pattern[at] == "*":
            out, at = out + "[^/]*", at + 1
        elif pattern[at] == "?":
            out, at = out + "[^/]", at + 1
        elif pattern[at] == "[" and (end := pattern.find("]", at + 2)) > 0:
            inner = pattern[at + 1 : end].replace("\\", "\\\\")
            out, at = out + f"[{'^' + inner[1:] if inner[0] in '!^' else inner}]", end + 1
        else:
            at += pattern[at] == "\\" and at + 1 < len(pattern)
            out, at = out + re.escape(pattern[at]), at + 1
    return out


class Ignore:
    """Rules of ignore files: the last one that fits a path decides; a rule holds below the folder of its file."""

    def __init__(self) -> None:
        self.rules: list[tuple[re.Pattern, bool, bool]] = []

    def add(self, folder: str, lines: list[str]) -> None:
        for line in lines:
            line = line.rstrip("\n\r")
            line = line if line.endswith("\\ ") else line.rstrip(" ")
            if not line or line.startswith("#"):
                continue
            keep, line = line.startswith("!"), line.removeprefix("!")
            only_folders, line = line.endswith("/"), line.rstrip("/")
            anywhere = "/" not in line
            start = re.escape(f"{folder}/") if folder else ""
            self.rules.append((re.compile(start + ("(?:.*/)?" if anywhere else "") + _expression(line.lstrip("/"))), keep, only_folders))

    def hides(self, path: str, folder: bool) -> bool:
        hidden = False
        for rule, keep, only_folders in self.rules:
            if (folder or not only_folders) and rule.fullmatch(path):
                hidden = not keep
        return hidden


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if urlparse(uri).scheme else (pafs.LocalFileSystem(), uri)


def listed(uri: str, max_bytes: int) -> list[tuple[str, int]]:
    """(path below ``uri``, size) of the files that count, in path order. A folder that is left out is not entered."""
    store, root = _store(uri)
    root, ignore, found = root.rstrip("/"), Ignore(), []

    def enter(folder: str) -> None:
        entries = sorted(store.get_file_info(pafs.FileSelector(f"{root}/{folder}" if folder else root)), key=lambda e: e.base_name)
        for e in entries:
            if e.base_name in IGNORE_FILES and e.is_file:
                with store.open_input_stream(e.path) as f:
                    ignore.add(folder, f.read().decode("utf-8", "replace").split("\n"))
        for e in entries:
            path = f"{folder}/{e.base_name}" if folder else e.base_name
            if e.type == pafs.FileType.Directory:
                if e.base_name not in IGNORED_FOLDERS and not ignore.hides(path, True):
                    enter(path)
            elif e.is_file and e.size <= max_bytes and not ignore.hides(path, False):
                found.append((path, e.size))

    enter("")
    return found


class Batch(InputPartition):
    """Files of one task: paths below the root."""

    def __init__(self, paths: list[str]) -> None:
        super().__init__(len(paths))
        self.paths = paths


def packed(files: list[tuple[str, int]], budget: int) -> list[list[str]]:
    """Files in order, cut so that no batch holds more than ``budget`` bytes, except for a single larger file."""
    out, now, size = [], [], 0
    for path, n in files:
        if now and size + n > budget:
            out.append(now)
            now, size = [], 0
        now.append(path)
        size += n
    return [*out, now] if now else out


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root = options["path"]
        self.max_bytes, self.budget = int(options.get("maxbytes", MAX_FILE_BYTES)), int(options.get("budget", CHUNK_BYTES))

    def partitions(self) -> list[InputPartition]:
        return [Batch(paths) for paths in packed(listed(self.root, self.max_bytes), self.budget)] or [Batch([])]

    def read(self, partition: Batch) -> Iterator[pa.RecordBatch]:
        """A record batch for each file; one that cannot be read any more makes no row, bytes that are not UTF-8 become U+FFFD."""
        store, root = _store(self.root)
        for path in partition.paths:
            try:
                with store.open_input_stream(f"{root.rstrip('/')}/{path}") as f:
                    data = f.read()
            except OSError:
                continue
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(data)], pa.int64()), pa.array([data.decode("utf-8", "replace")])], names=["filePath", "size", "content"])


class SourceTree(DataSource):
    """Options: path; maxBytes (larger files are left out); budget (bytes of a partition)."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return "filePath string, size long, content string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SourceTree)
