"""A source tree as a Spark data source.

    tree.register(spark)
    spark.read.format("source_tree").option("partitions", 64).load("/data/project")

gives (path, size_bytes, raw). Partitions are sub-trees: the planner lists folders from
the top until there are enough of them; a task then walks its own sub-tree and streams
its files in Arrow batches. Folders that were listed leave their own files in runs of
``FILES_A_RUN``. Conditions on size_bytes and on the start of path are pushed down: a
file outside is not opened, a sub-tree outside isn't walked.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringStartsWith,
)

from . import detect, scan

NAME = "source_tree"
SCHEMA = "path string, size_bytes long, raw binary"
FILES_A_RUN = 2_000
#: A batch that leaves a task.
BATCH_FILES, BATCH_BYTES = 64, 16 << 20


@dataclass
class SubTree(InputPartition):
    """A folder to walk, or files of a folder that was listed."""

    folder: str | None
    files: tuple[str, ...] = ()


class TreeReader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"].removeprefix("file://")
        if not os.path.isdir(self.root):
            raise NotADirectoryError(self.root)
        flag = lambda name: str(options.get(name, "true")).lower() == "true"
        self.use_gitignore = flag("gitignore")
        self.globs = [*detect.IGNORED, *(detect.SENSITIVE if flag("sensitive") else ()), *json.loads(options.get("extra", "[]"))]
        self.wanted = int(options.get("partitions", 64))
        self.least, self.most = 0, int(options.get("maxBytes", scan.MAX_BYTES))
        self.start = ""

    def pushFilters(self, filters: list[Filter]):
        """Takes bounds of size_bytes and starts of path; gives back the others."""
        for f in filters:
            if isinstance(f, IsNotNull):  # no column is null
                continue
            at = getattr(f, "attribute", None)
            if at == ("size_bytes",) and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
                if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                    self.least = max(self.least, f.value + isinstance(f, GreaterThan))
                if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                    self.most = min(self.most, f.value - isinstance(f, LessThan))
            elif at == ("path",) and isinstance(f, StringStartsWith) and f.value.startswith(self.start):
                self.start = f.value
            else:
                if at == ("path",) and isinstance(f, EqualTo) and f.value.startswith(self.start):
                    self.start = f.value
                yield f

    def listed(self, folder: str, held: dict) -> Iterator[tuple[str, bool]]:
        """What a folder holds, without what can't begin with ``start``."""
        for path, is_dir in scan.listed(self.root, folder, self.skip, self.use_gitignore, self.most, held):
            if path.startswith(self.start) or is_dir and self.start.startswith(path + "/"):
                yield path, is_dir

    @property
    def skip(self):
        return detect.ignored_pattern(self.globs)

    def partitions(self) -> list[SubTree]:
        if self.least > self.most:
            return [SubTree(None)]
        level, done, held = [""], [], {}
        while level and len(level) + len(done) < self.wanted:
            below = []
            for folder in level:
                files = []
                for path, is_dir in self.listed(folder, held):
                    (below if is_dir else files).append(path)
                done += [SubTree(None, tuple(files[i : i + FILES_A_RUN])) for i in range(0, len(files), FILES_A_RUN)]
            level = below
        return [*done, *map(SubTree, level)] or [SubTree(None)]

    def walked(self, part: SubTree) -> Iterator[str]:
        yield from part.files
        left, held = [part.folder] if part.folder is not None else [], {}
        while left:
            for path, is_dir in self.listed(left.pop(), held):
                if is_dir:
                    left.append(path)
                else:
                    yield path

    def contents(self, part: SubTree) -> Iterator[tuple[str, bytes]]:
        """Files within the bounds of size; those that can't be read are passed over."""
        for path in self.walked(part):
            full = os.path.join(self.root, path)
            try:
                if not self.least <= os.path.getsize(full) <= self.most:
                    continue
                with open(full, "rb") as f:
                    raw = f.read(self.most + 1)
            except OSError:
                continue
            if self.least <= len(raw) <= self.most:  # it may have changed since it was measured
                yield path, raw

    def read(self, partition: SubTree) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for path, raw in self.contents(partition):
            rows.append((path, raw))
            size += len(raw)
            if len(rows) >= BATCH_FILES or size >= BATCH_BYTES:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple[str, bytes]]) -> pa.RecordBatch:
    paths, raws = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(map(len, raws), pa.int64()), pa.array(raws, pa.binary())], ["path", "size_bytes", "raw"])


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session and lets it take conditions."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TreeSource)


def tree_files(
    spark: SparkSession, root: str, sensitive: bool = True, use_gitignore: bool = True, max_bytes: int = scan.MAX_BYTES, extra: tuple[str, ...] = (), partitions: int | None = None, only=None,
) -> DataFrame:
    """The rows of ``scan.project_files`` by way of the data source; ``only`` is a condition
    on path and size_bytes. For trees without a folder that outweighs all others: such a
    folder below the listed ones is one task here, and many in ``project_files``."""
    register(spark)
    raw = spark.read.format(NAME).options(
        sensitive=str(sensitive).lower(), gitignore=str(use_gitignore).lower(), maxBytes=str(max_bytes), extra=json.dumps(extra), partitions=str(partitions or 4 * spark.sparkContext.defaultParallelism)
    ).load(root)
    return scan.described_files(raw if only is None else raw.where(only))
