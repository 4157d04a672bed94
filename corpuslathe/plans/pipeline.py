"""From a source tree to training samples."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tokens import sample_text
from ..operators import dedup, quality
from ..operators.analyses import Store
from ..sources import scan
from .config import Config
from .generators import Tables, generated
from .runlog import RunLog


@dataclass
class Result:
    samples: DataFrame
    judged: DataFrame
    kept: DataFrame
    counters: dict[str, int]


def project_tables(
    spark: SparkSession, root: str, project: str, work: str, description: str = "", config: Config | None = None, store: Store | None = None, log: RunLog | None = None
) -> Tables:
    """A project's files and analyses, each written once below ``work``. Files that
    the quality settings leave out are listed but not analysed. ``store`` keeps analyses
    between runs; without one, they are kept below ``work``."""
    config, store = config or Config(), store or Store(spark, f"{work}/store")
    log = log or RunLog(f"{work}/log", uuid.uuid4().hex)
    own = config.ignore
    with log.phase("scanning"):
        found = scan.project_files(spark, root, own.skip_sensitive, own.use_gitignore, own.max_file_bytes, own.user_patterns)
        files = log.write(found, f"{work}/files", "files", n=F.count(F.lit(1)), size_bytes=F.sum("size_bytes"))
        log.tell("progress", "scanning", log.counts["files"]["n"], log.counts["files"]["n"])
    with log.phase("analyzing"):
        analyses = log.write(store.analysed(quality.sources_passed(files, config.quality)), f"{work}/analyses", "analyses", n=F.count(F.lit(1)))
        log.tell("progress", "analyzing", log.counts["analyses"]["n"], log.counts["files"]["n"])
    return Tables(project, description, files, analyses)


def run(ctx: Tables, work: str, config: Config | None = None, log: RunLog | None = None) -> Result:
    """Samples, the samples with reasons of rejection, those that stay, and how many
    each has; every table is written once and counted as it is."""
    config = config or Config()
    log = log or RunLog(f"{work}/log", uuid.uuid4().hex)
    one = F.count(F.lit(1))
    with log.phase("generating"):
        samples = log.write(generated(ctx, config.enabled_types, config.added_generators), f"{work}/samples", "samples", n=one)
        log.tell("progress", "generating", log.counts["samples"]["n"], log.counts["samples"]["n"])
    with log.phase("qualityFiltering"):
        rejected = F.count_if(F.col("reject_reason").isNotNull())
        judged = log.write(quality.with_reasons(samples, config.quality), f"{work}/judged", "judged", n=one, filtered=rejected)
        total = log.counts["judged"]["n"]
        log.tell("progress", "qualityFiltering", log.counts["judged"]["filtered"], total)
        fine = judged.where("reject_reason is null").drop("reject_reason")
        kept = log.write(dedup.deduplicated(fine, sample_text(F.col("conversation")), threshold=config.quality.dedup_threshold), f"{work}/kept", "kept", n=one)
        log.tell("progress", "qualityFiltering", total, total)
    seen = log.counts["judged"]
    fine_n, passed = seen["n"] - seen["filtered"], log.counts["kept"]["n"]
    counters = {"total_input": seen["n"], "filtered": seen["filtered"], "pre_dedup_count": fine_n, "passed": passed, "duplicates_removed": fine_n - passed}
    return Result(samples, judged, kept, counters)


def preview(samples: DataFrame, offset: int = 0, limit: int = 20) -> DataFrame:
    """A page of samples in their order."""
    return samples.orderBy("ord").offset(offset).limit(limit)
