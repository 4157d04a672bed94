"""JSON lines and their manifest as a Spark data sink: all of it appears, or nothing.

    commit.register(spark)
    lines.write.format("line_files").mode("overwrite").option("about", "{...}").save("/out")

``lines`` has a column line and, if there are several, folder. Tasks write to a folder
beside the target under names of their own and tell in their commit message what they
wrote: name, rows, bytes, sha256. The driver then names the files by partition, writes the
manifest next to them and moves the whole folder to the target, in one step where the
file system has one. A failing task leaves the target as it was; what attempts that
did not count have written is deleted, but for what tasks still write when a job is given up: that stays in
a folder of its own, which nothing reads. Equal partitions give equal bytes.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..functions.files import store

NAME, MANIFEST = "line_files", "manifest.json"


def exists(files: fs.FileSystem, path: str) -> bool:
    return files.get_file_info(path).type != fs.FileType.NotFound


@dataclass
class Part:
    """A file that an attempt wrote, and the name that it gets."""

    written: str
    name: str
    rows: int
    bytes: int
    sha256: str


@dataclass
class Written(WriterCommitMessage):
    parts: list[Part]


class LinesWriter(DataSourceArrowWriter):
    def __init__(self, options, columns: list[str], overwrite: bool):
        if "line" not in columns or set(columns) - {"line", "folder"}:
            raise ValueError(f"columns are line and folder, not {columns}")
        self.path, self.overwrite, self.has_folder = options["path"], overwrite, "folder" in columns
        self.about, self.extras = json.loads(options.get("about", "{}")), json.loads(options.get("extras", "{}"))
        self.with_manifest = options.get("manifest", "true") == "true"
        files, base = store(self.path)
        if not overwrite and exists(files, base):
            raise FileExistsError(self.path)
        self.stage = f"{base}._stage-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        task, (files, _) = TaskContext.get(), store(self.path)
        parts: list[Part] = []
        out, folder, digest = None, None, None

        def close() -> None:
            if out is not None:
                out.close()
                parts[-1].sha256 = digest.hexdigest()

        for batch in iterator:
            lines = batch.column(batch.schema.get_field_index("line")).to_pylist()
            folders = batch.column(batch.schema.get_field_index("folder")).to_pylist() if self.has_folder else [""] * len(lines)
            for to, line in zip(folders, lines, strict=True):
                if out is None or to != folder:
                    close()
                    folder, digest = to, hashlib.sha256()
                    if any(p.name.rpartition("/")[0] == (to or "") for p in parts):
                        raise ValueError(f"lines of {to!r} are not together")
                    name = f"part-{task.partitionId():05d}"
                    at = f"{self.stage}/{to}" if to else self.stage
                    files.create_dir(at, recursive=True)
                    parts.append(Part(f"{at}/_{name}-{task.taskAttemptId()}-{uuid.uuid4().hex}", f"{to}/{name}.jsonl" if to else f"{name}.jsonl", 0, 0, ""))
                    out = files.open_output_stream(parts[-1].written)
                json.loads(line)  # a line that is no JSON ends the job
                data = line.encode() + b"\n"
                out.write(data)
                digest.update(data)
                parts[-1].rows += 1
                parts[-1].bytes += len(data)
        close()
        return Written(parts)

    def commit(self, messages: list[Written | None]) -> None:
        files, base = store(self.path)
        files.create_dir(self.stage, recursive=True)
        parts = sorted((p for m in messages if m for p in m.parts), key=lambda p: p.name)
        for p in parts:
            files.move(p.written, f"{self.stage}/{p.name}")
        good = {f"{self.stage}/{p.name}" for p in parts}
        for info in files.get_file_info(fs.FileSelector(self.stage, recursive=True)):
            if info.type == fs.FileType.File and info.path not in good:  # of an attempt that did not count
                files.delete_file(info.path)
        told = self.about | {
            "files": [{"name": p.name, "rows": p.rows, "bytes": p.bytes, "sha256": p.sha256} for p in parts], "total_rows": sum(p.rows for p in parts), "total_bytes": sum(p.bytes for p in parts)
        }
        manifest = {MANIFEST: json.dumps(told, indent=2, sort_keys=True)} if self.with_manifest else {}
        for name, text in (self.extras | manifest).items():
            with files.open_output_stream(f"{self.stage}/{name}") as out:
                out.write(text.encode())
        old = f"{base}._old-{uuid.uuid4().hex}"
        if exists(files, base):
            if not self.overwrite:
                raise FileExistsError(self.path)
            files.move(base, old)
        files.move(self.stage, base)
        if exists(files, old):
            files.delete_dir(old)

    def abort(self, messages: list[Written | None]) -> None:
        files, _ = store(self.path)
        if exists(files, self.stage):
            files.delete_dir(self.stage)


class LinesSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema, overwrite: bool) -> LinesWriter:
        return LinesWriter(self.options, schema.names, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LinesSink)


def save(lines: DataFrame, path: str, about: dict | None = None, extras: dict[str, str] | None = None, overwrite: bool = True, manifest: bool = True) -> dict | None:
    """Writes ``lines`` as its partitions are, with a manifest of ``about`` and the files'
    rows, bytes and hashes, and the texts of ``extras`` by name; returns the manifest."""
    register(lines.sparkSession)
    told = {"about": json.dumps(about or {}), "extras": json.dumps(extras or {}), "manifest": str(manifest).lower()}
    lines.write.format(NAME).mode("overwrite" if overwrite else "append").options(**told).save(path)
    return read_manifest(path) if manifest else None


def read_manifest(path: str) -> dict:
    files, base = store(path)
    with files.open_input_stream(f"{base}/{MANIFEST}") as f:
        return json.loads(f.read())


def verified(path: str) -> list[str]:
    """Names of files that are missing or differ from what the manifest says of them."""
    files, base = store(path)
    wrong = []
    for f in read_manifest(path)["files"]:
        digest = hashlib.sha256()
        if exists(files, f"{base}/{f['name']}"):
            with files.open_input_stream(f"{base}/{f['name']}") as data:
                while part := data.read(1 << 20):
                    digest.update(part)
        if digest.hexdigest() != f["sha256"]:
            wrong.append(f["name"])
    return wrong
