"""JSON lines, manifest and dataset card, written together."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import numbered
from ..operators import statistics
from . import commit
from .formats import BLURBS, FEATURES, TOOL_SUPPORT, formatted

# Licences that a card may name.
LICENCES = ("mit", "apache-2.0", "gpl-3.0", "bsd-3-clause", "cc-by-4.0", "cc-by-sa-4.0", "cc0-1.0", "other")


#: Lines of a file.
LINES_A_FILE = 100_000


def lines_of(samples: DataFrame, styles: tuple[str, ...], lines_a_file: int = LINES_A_FILE) -> DataFrame:
    """(folder, line) of all styles, a partition for each file: so many samples in the
    order of ``ord``. Files depend on the samples alone, not on their partitioning."""
    if not styles:
        return samples.sparkSession.createDataFrame([], "folder string, line string")
    order = numbered(samples.select("ord"), "ord", "pos")
    files = max(1, -(-order.count() // lines_a_file))
    every = None
    for i, style in enumerate(styles):
        own = formatted(samples, style).select("ord", "line").join(order, "ord")
        file = F.floor(F.col("pos") / lines_a_file).cast("int") + i * files
        own = own.select(F.lit(f"data/{style.lower()}").alias("folder"), "line", "pos", file.alias("file"))
        every = own if every is None else every.union(own)
    return every.repartitionById(len(styles) * files, F.col("file")).sortWithinPartitions("pos").select("folder", "line")


def export(
    samples: DataFrame, path: str, styles: tuple[str, ...], project: str, now: datetime, extras: dict[str, str] | None = None, lines_a_file: int = LINES_A_FILE, manifest: bool = True
) -> dict | None:
    """Writes JSON lines of each style below ``path``, the manifest and ``extras``, all at
    once; returns the manifest. Samples without a style's columns have no line there."""
    folders = [f"data/{s.lower()}" for s in styles]
    about = {"project": project, "generated_at": now.isoformat(), "total_samples": samples.count(), "formats": list(styles), "output_files": folders}
    return commit.save(lines_of(samples, styles, lines_a_file), path, about, extras, manifest=manifest)


def validated(spark: SparkSession, outputs: list[str]) -> list[str]:
    """``outputs``, if each is a folder that holds JSON lines and nothing else."""
    for folder in outputs:
        lines = spark.read.text(folder)  # raises if there is no such folder
        if not lines.where(F.get_json_object("value", "$").isNull()).isEmpty():
            raise ValueError(f"{folder} holds lines that are no JSON")
    return outputs


def size_bucket(n: int) -> str:
    for bound, name in ((1_000, "n<1K"), (10_000, "1K<n<10K"), (100_000, "10K<n<100K"), (1_000_000, "100K<n<1M")):
        if n < bound:
            return name
    return "1M<n<10M"


def yaml_escaped(text: str) -> str:
    return text.replace('"', '\\"').replace("\n", " ").replace("\r", "").replace(":", " -")


def features(style: str) -> list[str]:
    """A format's columns as YAML lines."""
    out = []
    for name, fields in FEATURES[style].items():
        out += [f"  - name: {name}", "    list:" if fields else "    dtype: string"]
        for x in fields:
            out += [f"    - name: {x}", "      dtype: string"]
    return out


def card(project: str, description: str, licence: str, styles: tuple[str, ...], counts: list[Row], tokens: Row, now: datetime) -> str:
    """Dataset card from (dimension, key, n) rows and the token statistics."""
    if licence not in LICENCES:
        raise ValueError(f"unknown licence {licence}")
    by = lambda d: sorted(((r.key, r.n) for r in counts if r.dimension == d), key=lambda x: (-x[1], x[0]))
    table = lambda head, rows: "\n".join([f"| {head} | Samples |", "|---|---|", *(f"| {k} | {n} |" for k, n in rows)])
    total = sum(n for _, n in by("type"))
    front = [
        "---", f"license: {licence}", "language:", "- en", f'pretty_name: "{yaml_escaped(project)} Training Data"', "size_categories:", f"- {size_bucket(total)}", "tags:", "- code", "- synthetic", "- fine-tuning",
        "task_categories:", "- text-generation", "configs:",
    ]
    for style in styles:
        front += [f"- config_name: {style.lower()}", "  data_files:", "  - split: train", f"    path: data/{style.lower()}/*"]
    # the columns are those of the first format
    front += ["dataset_info:", "  features:", *features((styles or ("OpenAI",))[0]), "  splits:", "  - name: train", f"    num_examples: {total}"]
    body = [
        "---", "", f"# {project}", "", description, "", f"Generated {now:%Y-%m-%d}. {total} samples.", "", "## Formats", "",
        *(x for s in styles for x in (BLURBS[s] + ("" if TOOL_SUPPORT[s] else " Without tools."), "")), "## Samples", "", table("Type", by("type")), "", table("Language", by("language")), "",
        f"Tokens: {tokens['sum']} in all, {tokens['min']} to {tokens['max']}, mean {tokens['mean']}, median {tokens['median']}, p90 {tokens['p90']}, p99 {tokens['p99']}.", "",
    ]
    return "\n".join([*front, *body])


def staged(spark: SparkSession, samples: DataFrame, path: str, project: str, description: str, licence: str, styles: tuple[str, ...], now: datetime) -> None:
    """Everything that a hub needs, as files below ``path``."""
    if not re.fullmatch(r"[A-Za-z0-9_][A-Za-z0-9._-]{0,95}", project):
        raise ValueError(f"{project!r} is no name for a repository")
    counts = statistics.counts(samples).collect()  # one row for each type, language and tier
    tokens = statistics.order_statistics(samples.select(F.col("metadata.estimated_tokens").alias("n")), "n").first()
    export(samples, path, styles, project, now, {"card": card(project, description, licence, styles, counts, tokens, now)})
