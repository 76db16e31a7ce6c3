"""Opening, listing and writing files on any filesystem the workers share; filters a reader can use."""
from __future__ import annotations

import operator
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, LessThan, LessThanOrEqual,
                                    StringContains, StringEndsWith, StringStartsWith)

TESTS: dict[type, Callable] = {
    EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt,
    LessThanOrEqual: operator.le, In: lambda v, some: v in some, StringStartsWith: str.startswith,
    StringEndsWith: str.endswith, StringContains: operator.contains}


# folders from which on tasks list them, and tasks of a read, however many small files there are
FOLDERS, TASKS = 64, 1024


class Pushed:
    """What the pushed filters allow a column's value to be.

    A reader uses it to leave files and blocks unopened; Spark still evaluates
    every filter, so a reader may return more than it allows.
    """

    def __init__(self, *columns: str):
        self.columns, self.tests = set(columns), []

    def take(self, filters: Iterable[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f) in TESTS and f.attribute[0] in self.columns and len(f.attribute) == 1:
                self.tests.append((f.attribute[0], type(f), f.value))
            yield f

    def allows(self, column: str, value) -> bool:
        return all(TESTS[kind](value, wanted) for name, kind, wanted in self.tests if name == column)


def register(spark: SparkSession, *sources: type) -> None:
    """Make data sources known to the session and let Spark hand them its filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in sources:
        spark.dataSource.register(source)


def write_files(files: DataFrame, root: str) -> DataFrame:
    """(path, length) after writing each (path, content) row below ``root``; a task that runs again writes the same."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = set()
        for batch in batches:
            paths = [f"{root.rstrip('/')}/{p}" for p in batch.column(0).to_pylist()]
            contents = batch.column(1).to_pylist()
            for path, content in zip(paths, contents):
                system, inner = locate(path)
                if (folder := inner.rsplit("/", 1)[0]) not in made:
                    system.create_dir(folder)
                    made.add(folder)
                with system.open_output_stream(inner) as out:
                    out.write(content)
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(map(len, contents), pa.int64())], ["path", "length"])

    return files.select("path", "content").mapInArrow(run, "path string, length bigint")


def locate(path: str):
    """(filesystem, path in it) for a local path or a URI."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def list_files(path: str, suffixes: tuple[str, ...]) -> list[tuple[str, int]]:
    """(path, size) of a file, or of the matching files below a folder."""
    system, inner = locate(path)
    info = system.get_file_info(inner)
    prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    if info.is_file:
        return [(path, info.size)]
    below = system.get_file_info(fs.FileSelector(inner, recursive=True))
    return sorted((prefix + f.path, f.size) for f in below if f.is_file and f.path.lower().endswith(suffixes))


def list_units(path: str, suffixes: tuple[str, ...]) -> tuple[list[tuple[str, int]], list[str]]:
    """(path, size) of matching files, and folders left to list where they are read.

    Folders are opened level by level until there are ``FOLDERS`` of them; the
    files of a deep and wide tree are then never listed in one place.
    """
    system, inner = locate(path)
    prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    info = system.get_file_info(inner)
    if info.is_file:
        return [(path, info.size)], []
    files, folders = [], [inner]
    while folders and len(folders) < FOLDERS:
        found = [f for at in folders for f in system.get_file_info(fs.FileSelector(at))]
        files += [(prefix + f.path, f.size) for f in found if f.is_file and f.path.lower().endswith(suffixes)]
        folders = [f.path for f in found if f.type == fs.FileType.Directory]
    return sorted(files), sorted(prefix + f for f in folders)


def in_groups(items: list, least: int) -> list[list]:
    """Runs of ``least`` items, longer where that would make more than ``TASKS``."""
    size = max(least, -(-len(items) // TASKS))
    return [items[i:i + size] for i in range(0, len(items), size)]


def open_file(path: str):
    system, inner = locate(path)
    return system.open_input_file(inner)
