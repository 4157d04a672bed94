"""Projects and their files.

Folders are listed level by level: each level is a table of folders, dealt to all
tasks, so no sub-tree waits for one of them. Ignored folders aren't entered. The
paths found are dealt to tasks again, by chance as all files are small, and each file
is read once. Spark's own recursive file source is not used, as it leaves out names
that begin with an underscore.
"""

from __future__ import annotations

import os
import re
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.tables import numbered, spread, written
from ..functions.tokens import content_hash
from . import detect, markdown

MAX_BYTES = 1_000_000
#: Files that a task reads, 64 at a time.
FILES_PER_TASK = 2_000
README_NAMES = ("README.md", "readme.md", "README", "Readme.md", "README.txt", "README.rst", "readme.txt", "README.markdown")


def _git_ignore(file: str) -> list[tuple[re.Pattern, bool, bool]]:
    """Rules (pattern on the path below the folder, negated, folders only)."""
    try:
        with open(file, encoding="utf-8", errors="replace") as f:
            rows = [x.rstrip("\n").rstrip() for x in f]
    except OSError:
        return []
    rules = []
    for row in rows:
        if not row or row.startswith("#"):
            continue
        negated, row = row.startswith("!"), row.lstrip("!")
        only, row = row.endswith("/"), row.rstrip("/")
        anchored, row = "/" in row, row.lstrip("/")
        body = re.escape(row).replace(r"\*\*/", "(?:.*/)?").replace(r"/\*\*", "(?:/.*)?").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
        rules.append((re.compile(("" if anchored else "(?:.*/)?") + body + r"\Z"), negated, only))
    return rules


def listed(root: str, folder: str, skip: re.Pattern, use_gitignore: bool = True, max_bytes: int = MAX_BYTES, held: dict | None = None):
    """(path, is_dir) of what a folder below root holds; hidden names, links, large
    files and what the rules name are left out. Rules are those of ``.gitignore`` files
    from the root down and the repository's exclude file; a user's own aren't read, as
    they differ between machines. Entries that can't be read are passed over. ``held``
    keeps rules between calls."""
    held = {} if held is None else held
    parts = [p for p in folder.split("/") if p]
    above = ["/".join(parts[:n]) for n in range(len(parts) + 1)] if use_gitignore else []
    for base in above:
        if base not in held:
            held[base] = _git_ignore(os.path.join(root, base, ".gitignore"))
            if not base:
                held[base] = _git_ignore(os.path.join(root, ".git/info/exclude")) + held[base]

    def left_out(path: str, is_dir: bool) -> bool:
        gone = False
        for base in above:
            below = path[len(base) + 1 :] if base else path
            for pattern, negated, only in held[base]:
                if (is_dir or not only) and pattern.match(below):
                    gone = not negated
        return gone

    try:
        entries = os.scandir(os.path.join(root, folder))
    except OSError:
        return
    with entries:
        for e in entries:
            path = f"{folder}/{e.name}" if folder else e.name
            try:
                is_dir = e.is_dir()
                if e.name.startswith(".") or skip.match(e.name) or e.is_symlink() or left_out(path, is_dir):
                    continue
                if is_dir or (e.is_file() and e.stat().st_size <= max_bytes):
                    yield path, is_dir
            except OSError:
                continue


def _frames(rows, columns: list[str], at_once: int):
    """Data frames of at most ``at_once`` rows."""
    while part := list(islice(rows, at_once)):
        yield pd.DataFrame(part, columns=columns)


def project_paths(spark: SparkSession, root: str, skip: re.Pattern, use_gitignore: bool = True, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(path) of a project's files: a job for each level of its folders."""

    def level(batches):
        held: dict = {}
        for pdf in batches:
            rows = (r for folder in pdf.path for r in listed(root, folder, skip, use_gitignore, max_bytes, held))
            yield from _frames(rows, ["path", "is_dir"], 10_000)
            held.clear()

    folders, found = spark.createDataFrame([("",)], "path string"), None
    while True:
        own = written(spread(folders).mapInPandas(level, "path string, is_dir boolean"))
        files, folders = own.where("not is_dir").select("path"), own.where("is_dir").select("path")
        found = files if found is None else found.union(files)
        if folders.isEmpty():
            return found


def project_files(spark: SparkSession, root: str, sensitive: bool = True, use_gitignore: bool = True, max_bytes: int = MAX_BYTES, extra: tuple[str, ...] = ()) -> DataFrame:
    """(path, file_pos, language, size_bytes, line_count, is_binary, content_hash,
    content) of a project's files; content is null where it is no UTF-8 text.

    ``root`` has to be visible to all executors. file_pos counts paths in byte order.
    ``extra`` are globs of names to leave out. An empty folder has no rows.
    """
    if not os.path.isdir(root):
        raise NotADirectoryError(root)
    skip = detect.ignored_pattern([*detect.IGNORED, *(detect.SENSITIVE if sensitive else ()), *extra])

    def contents(paths):
        for path in paths:
            try:
                with open(os.path.join(root, path), "rb") as f:
                    raw = f.read(max_bytes + 1)
            except OSError:
                continue
            if len(raw) <= max_bytes:  # it may have grown since it was listed
                yield path, raw

    def read(batches):
        for pdf in batches:
            yield from _frames(contents(pdf.path), ["path", "raw"], 64)

    paths = project_paths(spark, root, skip, use_gitignore, max_bytes)
    tasks = max(spark.sparkContext.defaultParallelism, -(-paths.count() // FILES_PER_TASK))
    raw = paths.repartition(tasks).mapInPandas(read, "path string, raw binary")
    return described_files(raw)


def described_files(raw: DataFrame) -> DataFrame:
    """The columns of ``project_files`` from (path, raw)."""
    text = F.when(F.is_valid_utf8(F.col("raw").cast("string")), F.col("raw").cast("string"))
    files = raw.select(
        "path", F.length("raw").cast("long").alias("size_bytes"), detect.is_binary(F.col("raw")).alias("is_binary"), content_hash(F.col("raw")).alias("content_hash"), text.alias("content")
    ).where("not is_binary")
    files = written(files.withColumns({"language": detect.language(F.col("path"), F.col("content")), "line_count": T.line_count(F.coalesce("content", F.lit("")))}))
    return files.join(numbered(files.select("path"), "path", "file_pos"), "path").select("path", "file_pos", "language", "size_bytes", "line_count", "is_binary", "content_hash", "content")


def discover(spark: SparkSession, root: str) -> DataFrame:
    """(path, name, project_type, has_readme): the root if it is a project, else the
    projects right below it, by name."""
    def one(path: str) -> tuple:
        try:
            names = sorted(os.listdir(path))
        except OSError:
            names = []
        return path, os.path.basename(path.rstrip("/")), names

    rows = [one(root)]
    if not any(m in rows[0][2] for m, _ in detect.MARKERS):
        rows = [one(e.path) for e in os.scandir(root) if e.is_dir() and not e.name.startswith(".") and e.name not in ("node_modules", "target")]
    found = spark.createDataFrame(rows, "path string, name string, names array<string>").withColumn("project_type", detect.project_type(F.col("names")))
    readme = F.arrays_overlap("names", F.array(*map(F.lit, README_NAMES[:3])))
    return found.where("project_type is not null").select("path", "name", "project_type", readme.alias("has_readme")).orderBy("name")


def description(paragraphs_of: DataFrame, text_col: str = "content") -> DataFrame:
    """``paragraphs_of`` with column description: the first sentences of a Markdown
    text's paragraphs.

    Fenced and indented code, headings, tables, rules, raw HTML and images are left
    out, as are badges; links and emphasis keep their words, soft line ends become
    blanks; list and quote markers are dropped.
    """
    blocks = F.transform(markdown.paragraphs(F.col(text_col)), _inline)
    kept = F.filter(blocks, lambda b: (b != "") & ~T.is_badge(b))
    return paragraphs_of.withColumn("description", T.truncated_sentences(F.array_join(kept, " ")))


def _inline(block):
    for pattern, to in (
        (r"\[!\[[^\]]*\]\([^)]*\)\]\([^)]*\)", ""), (r"!\[[^\]]*\](?:\([^)]*\)|\[[^\]]*\])", ""), (r"\[([^\]]*)\](?:\([^)]*\)|\[[^\]]*\])", "$1"),
        (r"(\*\*|__)(.+?)\1", "$2"), (r"(?<![\w*])[*_](?=\S)(.+?)(?<=\S)[*_](?![\w*])", "$1"), (r"[ \t]*\n[ \t]*", " "),
    ):
        block = F.regexp_replace(block, pattern, to)
    return F.trim(block)
