"""One user's session: projects by id, settings, runs that other sessions see and may cancel."""

from __future__ import annotations

import hashlib
import re
import time
import uuid
from dataclasses import dataclass, field, replace
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions import files as shared
from ..operators import statistics
from ..operators.analyses import Store
from ..sinks import export, formats
from ..sources import detect, scan
from . import lease, pipeline
from .config import Config
from .generators import Tables
from .runlog import RunLog, events


@dataclass
class Project:
    id: str
    root: str
    name: str
    description: str
    project_type: str
    tables: Tables
    totals: Row


@dataclass
class Session:
    """``work`` is a folder that all executors see; sessions with the same one know of
    each other's runs."""

    spark: SparkSession
    work: str
    config: Config = field(default_factory=Config)
    projects: dict[str, Project] = field(default_factory=dict)
    lease_lives_s: float = lease.LIVES_S

    @property
    def status(self) -> dict:
        """What the run under way, of whatever session, or else the last one came to."""
        if held := lease.holder(self.work):
            return {"state": "running", "project": held["project"], "run": held["run"]}
        return shared.read(f"{self.work}/status.json") or {"state": "idle"}

    def discover(self, root: str) -> DataFrame:
        return scan.discover(self.spark, root)

    def scan(self, root: str) -> Project:
        """Scans a project by the present settings, reads its description and remembers
        it. The id follows from the path. Tables are this scan's own, as other sessions
        may still read older ones."""
        key = hashlib.sha256(root.encode()).hexdigest()[:16]
        name = root.rstrip("/").rpartition("/")[2]
        tables = pipeline.project_tables(self.spark, root, name, f"{self.work}/{key}/scan-{uuid.uuid4().hex}", config=self.config, store=Store(self.spark, f"{self.work}/store"), log=RunLog(f"{self.work}/log", uuid.uuid4().hex))
        found = scan.discover(self.spark, root).where(F.col("path") == root).first()
        tables.description = self.readme_description(tables.files)
        totals = statistics.language_totals(tables.files).where("is_total").first()
        self.projects[key] = Project(key, root, name, tables.description, found.project_type if found else "unknown", tables, totals)
        return self.projects[key]

    def readme_description(self, files: DataFrame) -> str:
        """The first sentences of the project's own README, or ''."""
        order = F.array_position(F.array(*map(F.lit, scan.README_NAMES)), F.col("path"))
        own = files.where(F.col("path").isin(*scan.README_NAMES)).orderBy(order).limit(1)
        row = scan.description(own).select("description").first()
        return (row.description or "") if row else ""

    def get(self, key: str) -> Project:
        return self.projects[key]

    def describe(self, key: str, description: str) -> Project:
        self.projects[key].description = self.projects[key].tables.description = description
        return self.projects[key]

    def languages(self, key: str) -> DataFrame:
        """Languages of a project, the most files first."""
        return statistics.language_totals(self.get(key).tables.files).where("not is_total").orderBy(F.desc("file_count"), "language")

    def ignored(self) -> list[str]:
        return list(detect.IGNORED)

    def sensitive(self) -> list[str]:
        return list(detect.SENSITIVE)

    def update_config(self, **changes) -> Config:
        """Checks and keeps the settings; nothing changes if they are wrong."""
        self.config = replace(self.config, **changes)
        return self.config

    def formats(self) -> DataFrame:
        return formats.catalogue(self.spark)

    def run(self, key: str) -> pipeline.Result:
        """Generates, filters, deduplicates and writes a project's samples. One run at a
        time in all sessions of the folder: raises ``lease.Busy`` beside another one, and
        ``lease.Cancelled`` if any session cancels it. Its events are in ``log``."""
        project, began = self.get(key), time.monotonic()
        with lease.Lease(self.spark, self.work, key, self.lease_lives_s) as held:
            log = RunLog(f"{self.work}/log", held.run, check=held.check)
            try:
                result = pipeline.run(project.tables, f"{self.work}/{key}/{held.tag}", self.config, log)
                with log.phase("exporting"):
                    export.export(result.kept, f"{self.work}/{key}/out", self.config.formats, project.name, datetime.now(UTC), manifest=self.config.include_manifest)
                log.tell("complete", ms=round(1000 * (time.monotonic() - began)))
                shared.put(f"{self.work}/status.json", {"state": "complete", "project": key, "run": held.run, "counters": result.counters})
                return result
            except Exception as e:
                state = "cancelled" if held.cancelled else "error"
                log.check = None
                log.tell(state, message=str(e)[:1000])
                shared.put(f"{self.work}/status.json", {"state": state, "project": key, "run": held.run, "message": str(e)[:1000]})
                if held.cancelled and not isinstance(e, lease.Cancelled):
                    raise lease.Cancelled(f"the run of {project.name} was cancelled") from e
                raise

    def cancel(self) -> bool:
        """Ends the run under way, of whatever session; False if there is none."""
        return lease.cancel(self.work)

    def log(self) -> DataFrame:
        """Events of all scans and runs."""
        return events(self.spark, f"{self.work}/log")

    def preview(self, samples: DataFrame, offset: int = 0, limit: int = 20) -> DataFrame:
        return pipeline.preview(samples, offset, limit)

    def statistics(self, samples: DataFrame) -> tuple[DataFrame, Row]:
        """Counts in long form, and the token statistics."""
        tokens = statistics.order_statistics(samples.select(F.col("metadata.estimated_tokens").alias("n")), "n")
        return statistics.counts(samples), tokens.first()

    def rejected(self, result: pipeline.Result) -> DataFrame:
        """Rejected samples by reason."""
        return result.judged.where("reject_reason is not null").groupBy("reject_reason").agg(F.count("*").alias("n"))

    def publish(self, key: str, samples: DataFrame, licence: str, name: str | None = None) -> str:
        """Stages everything that a hub needs; returns the folder."""
        project = self.get(key)
        path = f"{self.work}/{key}/publish"
        export.staged(self.spark, samples, path, name or suggested_name(project.name), project.description, licence, self.config.formats, datetime.now(UTC))
        return path


def suggested_name(project: str) -> str:
    """A repository name out of a project's name."""
    name = re.sub(r"[^a-z0-9._-]", "-", f"{project}-training-data".lower())
    name = re.sub(r"\.{2,}", ".", re.sub(r"-{2,}", "-", name))
    return name.strip(".-")[:96] or "training-data"


def shown_bytes(n: int) -> str:
    if n < 1024:
        return f"{n} B"
    return f"{n / 1024:.1f} KB" if n < 1024**2 else f"{n / 1024**2:.1f} MB"


# Names of the phases.
PHASES = {"scanning": "Scanning Files", "analyzing": "Analyzing ASTs", "generating": "Generating Samples", "qualityFiltering": "Quality Filtering", "formatting": "Formatting Output", "exporting": "Exporting JSONL"}
