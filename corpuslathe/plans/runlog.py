"""What a run does, told while it does it, and numbers taken where rows pass anyway.

Events are small JSON files in a folder, one an event, so that any session can read them
as a table or a stream (``streaming.phases`` follows them). Counts come from
``DataFrame.observe`` on the plan that is written, so nothing is read again for them.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession

from ..functions import files as shared

EVENT = "run string, seq long, event string, phase string, current long, total long, ms long, message string, at double"


@dataclass
class RunLog:
    """Events of one run below ``path``; ``check`` is called at each and may end the run."""

    path: str
    run: str
    seq: int = 0
    check: object = None
    counts: dict[str, dict] = field(default_factory=dict)

    def tell(self, event: str, phase: str | None = None, current: int | None = None, total: int | None = None, ms: int | None = None, message: str | None = None) -> None:
        told = {"run": self.run, "seq": self.seq, "event": event, "phase": phase, "current": current, "total": total, "ms": ms, "message": message, "at": time.time()}
        shared.put(f"{self.path}/{self.run}-{self.seq:06}.json", told)
        self.seq += 1
        if self.check:
            self.check()

    @contextmanager
    def phase(self, name: str) -> Iterator[None]:
        """Started before, completed with its milliseconds after."""
        self.tell("started", name)
        began = time.monotonic()
        yield
        self.tell("completed", name, ms=round(1000 * (time.monotonic() - began)))

    def write(self, df: DataFrame, path: str, name: str, **counted: Column) -> DataFrame:
        """Writes ``df`` and reads it again; ``counted`` are aggregates of the rows that
        pass, kept under ``name``."""
        seen = Observation(f"{self.run}-{name}")
        df.observe(seen, *(c.alias(k) for k, c in counted.items())).write.mode("overwrite").parquet(path)
        self.counts[name] = seen.get
        return df.sparkSession.read.parquet(path)


def events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVENT).json(path)


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(EVENT).json(path)
