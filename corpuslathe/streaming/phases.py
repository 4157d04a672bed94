"""Phases of runs as a stream with state.

A run's state is what each of its phases has done, and how many events it had. Events
may come late and in any order: what counts is their ``seq``. A timer for each run tells
when nothing has come for a while. The last row for each run and phase is what
``progress.completed_phases`` finds in the whole log.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

RESULT = "run string, phase string, started boolean, completed boolean, percent int, place int, current string, stalled boolean, version long"
_PHASE = "started_seq long, completed_seq long, step_seq long, percent int"
_RUN = "version long, timer long"
#: The session needs this store for states with several variables and timers.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
NEVER = -1


def percent(current, total) -> int:
    """Whole percent, halves upwards; 0 where the total is 0 or unknown."""
    return int(100 * current / total + 0.5) if pd.notna(current) and pd.notna(total) and total > 0 else 0


class Phases(StatefulProcessor):
    def __init__(self, stall_ms: int | None):
        self.stall_ms = stall_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.phases = handle.getMapState("phases", "phase string", _PHASE)
        self.run = handle.getValueState("run", _RUN)

    def told(self, key, version: int, stalled: bool) -> pd.DataFrame:
        """Rows of all phases, of which a run has a handful: an event may move the others' places."""
        every = {k[0]: v for k, v in self.phases.iterator()}
        done = sorted((v[1], p) for p, v in every.items() if v[1] != NEVER)
        places = {p: i for i, (_, p) in enumerate(done, 1)}
        begun = [(v[0], p) for p, v in every.items() if v[0] != NEVER and v[1] == NEVER]
        current = max(begun)[1] if begun else None
        rows = [(key[0], p, v[0] != NEVER, v[1] != NEVER, v[3], places.get(p), current, stalled, version) for p, v in sorted(every.items())]
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in RESULT.split(", ")])
        return out.astype({"place": "Int32", "percent": "int32"})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        version, timer = self.run.get() if self.run.exists() else (0, NEVER)
        for pdf in rows:
            for seq, event, phase, current, total in zip(pdf.seq, pdf.event, pdf.phase, pdf.current, pdf.total, strict=True):
                version += 1
                if phase is None:
                    continue
                started, completed, step, share = self.phases.getValue((phase,)) if self.phases.containsKey((phase,)) else (NEVER, NEVER, NEVER, 0)
                if event == "started":
                    started = max(started, seq)
                elif event == "completed":
                    completed = max(completed, seq)
                elif event == "progress" and seq > step:
                    step, share = seq, percent(current, total)
                self.phases.updateValue((phase,), (int(started), int(completed), int(step), int(share)))
        if self.stall_ms:
            if timer != NEVER:
                self.handle.deleteTimer(timer)
            timer = timerValues.getCurrentProcessingTimeInMs() + self.stall_ms
            self.handle.registerTimer(timer)
        self.run.update((version, timer))
        yield self.told(key, version, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        version, timer = self.run.get()
        if timer == expiredTimerInfo.getExpiryTimeInMs():
            self.run.update((version + 1, NEVER))
            yield self.told(key, version + 1, True)


def tracked(log: DataFrame, stall_ms: int | None = None) -> DataFrame:
    """Rows for all phases of a run whenever one changes, from a stream of events (run, seq, event,
    phase, current, total): whether it is started and completed, its percent, its place
    among the completed ones, the run's current phase, and whether no event came for
    ``stall_ms``. seq is 0 or more and different within a run; rows without a phase count
    as signs of life only. Among a run's rows of a phase the one of the greatest version
    holds. The session must use ``STORE``."""
    events = log.select(F.col("run").cast("string").alias("run"), F.col("seq").cast("long").alias("seq"), "event", "phase", F.col("current").cast("double").alias("current"), F.col("total").cast("double").alias("total"))
    return events.groupBy("run").transformWithStateInPandas(Phases(stall_ms), RESULT, "Update", "ProcessingTime" if stall_ms else "None")


def settled(rows: DataFrame) -> DataFrame:
    """The last row for each run and phase of what ``tracked`` gave."""
    last = F.row_number().over(Window.partitionBy("run", "phase").orderBy(F.desc("version")))
    return rows.withColumn("n", last).where("n = 1").drop("n", "version")
