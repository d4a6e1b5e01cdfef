"""A folder of documents as a data source: spark.read.format("document_files").load(folder).

The driver lists the files once, leaves out other suffixes and names, and deals what is left into tasks of about equal size, so a thousand small files take
all cores and not a thousand tasks. A task reads its files one by one: a text file is one row without a page number, a PDF a row a page, by the caller's extractor.
Folders are reached by pyarrow's file systems (local, HDFS, S3, ...); sources.files reads by Spark's own binary files instead.
"""

from __future__ import annotations

import fnmatch
import importlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators import structure
from .files import PAGES, SUFFIXES

#: Bytes that a file counts for besides its own: opening it costs as much.
OPEN_COST = 64 << 10


class Files(InputPartition):
    """The files of one task: (path, name)."""

    def __init__(self, files: list[tuple[str, str]]):
        super().__init__(None)
        self.files = files


class DocumentReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options.get("path", "")
        self.glob, self.pdf = options.get("glob", "*"), options.get("pdf")
        self.tasks, self.deep = int(options.get("tasks", "8")), options.get("recursive", "false").lower() == "true"
        self.suffixes = tuple(options["suffixes"].lower().split(",")) if "suffixes" in options else SUFFIXES

    def _opened(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path) if ":" in self.path.split("/")[0] else (fs.LocalFileSystem(), self.path)

    def partitions(self) -> list[Files]:
        system, root = self._opened()
        found = system.get_file_info(fs.FileSelector(root, recursive=self.deep))
        kept = [f for f in found if f.type == fs.FileType.File and f.base_name.lower().endswith(self.suffixes) and fnmatch.fnmatchcase(f.base_name, self.glob)]
        if not kept:
            raise FileNotFoundError(f"no supported file in {self.path}")
        # the largest first, each to the task that has least so far
        tasks: list[tuple[int, list]] = [(0, []) for _ in range(min(self.tasks, len(kept)))]
        for f in sorted(kept, key=lambda f: (-f.size, f.path)):
            i = min(range(len(tasks)), key=lambda i: (tasks[i][0], i))
            size, files = tasks[i]
            files.append((f.path, f.base_name))
            tasks[i] = size + f.size + OPEN_COST, files
        return [Files(files) for _, files in tasks]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = self._opened()
        module, _, name = (self.pdf or "").partition(":")
        extract = getattr(importlib.import_module(module), name) if module else None
        for path, base in partition.files:
            with system.open_input_stream(path) as f:
                content = f.read()
            if not base.lower().endswith(".pdf"):
                rows = [(None, content.decode("utf-8", errors="replace"))]
            elif extract is None:
                raise RuntimeError(f"{base}: no PDF extractor was given (option pdf, module:function)")
            else:
                rows = list(extract(content))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([base] * len(rows)), pa.array([n for n, _ in rows], pa.int32()), pa.array([t for _, t in rows], pa.string())], names=["source_file", "page", "text"])


class DocumentFiles(DataSource):
    """Options: path; glob (names); suffixes (comma-separated); recursive; tasks (most partitions); pdf (module:function from bytes to (page, text))."""

    @classmethod
    def name(cls) -> str:
        return "document_files"

    def schema(self) -> str:
        return PAGES

    def reader(self, schema) -> DocumentReader:
        return DocumentReader(dict(self.options))


def read_documents(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    """(source_file, page, text) of the files under a folder, text files as one row with a null page; as many tasks as the session has cores unless `tasks` says otherwise."""
    spark.dataSource.register(DocumentFiles)
    return spark.read.format("document_files").options(**({"tasks": str(spark.sparkContext.defaultParallelism)} | options)).load(folder)


def load_pages(spark: SparkSession, folder: str, least: int = structure.MIN_PAGE_CHARS, **options: str) -> DataFrame:
    """Pages (source_file, page, text) of a folder, as sources.files.load_pages gives them: text files cut at their page marks, short pages left out, numbers kept."""
    rows = read_documents(spark, folder, **options)
    plain = structure.split_pages(rows.where("page is null").select("source_file", "text"))
    return structure.drop_short_pages(plain.unionByName(rows.where("page is not null")), least)
