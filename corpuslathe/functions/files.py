"""Small files that sessions share: made whole, replaced whole, made by one only."""

from __future__ import annotations

import json
import os
import uuid

from pyarrow import fs
from pyspark.sql import SparkSession


def store(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path below it; a path without a scheme is of the machine's tree,
    which all executors have to share."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.rstrip("/")


def exists(path: str) -> bool:
    files, at = store(path)
    return files.get_file_info(at).type != fs.FileType.NotFound


def read(path: str) -> dict | None:
    """What ``put`` or ``create`` wrote, None if there is nothing."""
    files, at = store(path)
    try:
        with files.open_input_stream(at) as f:
            return json.loads(f.read())
    except (FileNotFoundError, ValueError):
        return None


def put(path: str, value: dict) -> None:
    """Makes or replaces a file, whole at any time."""
    files, at = store(path)
    files.create_dir(at.rpartition("/")[0], recursive=True)
    new = f"{at}.{uuid.uuid4().hex}"
    with files.open_output_stream(new) as f:
        f.write(json.dumps(value, sort_keys=True).encode())
    files.move(new, at)


def create(spark: SparkSession, path: str, value: dict) -> bool:
    """Makes a file unless there is one; of several that try, one is told True."""
    files, at = store(path)
    files.create_dir(at.rpartition("/")[0], recursive=True)
    text = json.dumps(value, sort_keys=True).encode()
    if isinstance(files, fs.LocalFileSystem):
        new = f"{at}.{uuid.uuid4().hex}"
        with open(new, "wb") as f:
            f.write(text)
        try:
            os.link(new, at)
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(new)
    name = spark._jvm.org.apache.hadoop.fs.Path(path)  # pyarrow has no exclusive create
    hadoop = name.getFileSystem(spark._jsc.hadoopConfiguration())
    if hadoop.exists(name):
        return False
    try:
        out = hadoop.create(name, False)
    except Exception:  # noqa: BLE001  another one was first; the file tells
        if hadoop.exists(name):
            return False
        raise
    out.write(bytearray(text))
    out.close()
    return True


def listed(path: str) -> list[str]:
    """Names in a folder, in order; none if there is no folder."""
    files, at = store(path)
    found = files.get_file_info(fs.FileSelector(at, allow_not_found=True))
    return sorted(f.base_name for f in found)


def moved(path: str, to: str) -> bool:
    """Renames a file; False if it is gone."""
    (files, at), (_, new) = store(path), store(to)
    try:
        files.move(at, new)
        return True
    except (FileNotFoundError, OSError):
        return False


def removed(path: str) -> None:
    files, at = store(path)
    try:
        files.delete_file(at)
    except FileNotFoundError:
        pass
