"""Analyses kept between runs, by content hash, language and version of the analyser.

A store is a folder of Parquet folders and of numbered pointers. The newest pointer
names the folders that count. A run reads what is kept of its contents, parses the rest,
writes that as a folder of its own and then makes the next pointer, which only one
session can do; who comes second reads again and adds to what it finds. So readers see
whole folders only, and a failed run leaves nothing that counts.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import files as shared
from ..functions.tables import written
from . import symbols

KEY = ["content_hash", "language"]
#: With more folders than these, the next run puts all into one.
MOST_FOLDERS = 16
POINTERS_KEPT = 3


@dataclass
class Store:
    """``path`` is a folder that all executors see; ``parsed`` counts the contents that
    the last call had to parse."""

    spark: SparkSession
    path: str
    version: int = symbols.VERSION
    parsed: int = 0

    def pointer(self) -> tuple[int, list[str]]:
        """Number of the newest pointer, and its folders; folders of another version
        don't count."""
        for name in reversed(shared.listed(f"{self.path}/pointers")):
            if name.endswith(".json") and (told := shared.read(f"{self.path}/pointers/{name}")) is not None:
                return int(name.removesuffix(".json")), told["folders"] if told["version"] == self.version else []
        return 0, []

    def kept(self) -> DataFrame | None:
        _, folders = self.pointer()
        return self._read(folders) if folders else None

    def _read(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(symbols.ANALYSIS).parquet(*(f"{self.path}/{f}" for f in folders))

    def add(self, found: DataFrame) -> None:
        """Keeps analyses; whole, and also if other sessions add at the same time."""
        name = f"part-{uuid.uuid4().hex}"
        found.write.parquet(f"{self.path}/{name}")
        while True:
            at, folders = self.pointer()
            if shared.create(self.spark, f"{self.path}/pointers/{at + 1:010}.json", {"version": self.version, "folders": [*folders, name]}):
                break
        for old in shared.listed(f"{self.path}/pointers")[:-POINTERS_KEPT]:
            shared.removed(f"{self.path}/pointers/{old}")

    def compact(self) -> None:
        """Puts all folders into one; gives way if another session was faster. The old
        folders stay for those who read them."""
        at, folders = self.pointer()
        if len(folders) <= 1:
            return
        name = f"part-{uuid.uuid4().hex}"
        self._read(folders).dropDuplicates(KEY).write.parquet(f"{self.path}/{name}")
        shared.create(self.spark, f"{self.path}/pointers/{at + 1:010}.json", {"version": self.version, "folders": [name]})

    def analysed(self, files: DataFrame) -> DataFrame:
        """``symbols.analysed`` of ``files``, parsing only contents that no earlier run has."""
        if len(self.pointer()[1]) > MOST_FOLDERS:
            self.compact()
        kept, wanted = self.kept(), symbols.sources(files).select(*KEY).distinct()
        if kept is not None:
            # two sessions may have parsed the same content
            kept = kept.join(wanted, KEY, "left_semi").dropDuplicates(KEY)
            missing = written(wanted.join(kept.select(*KEY), KEY, "left_anti"))
        else:
            missing = written(wanted)
        self.parsed = missing.count()
        if self.parsed:
            contents = symbols.sources(files).join(missing, KEY, "left_semi").dropDuplicates(KEY)
            new = written(symbols.parsed(contents))
            self.add(new)
            kept = new if kept is None else kept.union(new)
        return symbols.of_files(files, kept) if kept is not None else symbols.analysed(files.where(F.lit(False)))
