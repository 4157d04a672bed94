"""One run at a time, seen and cancelled by any session.

The lease is a file that one session can make. Its owner renews it while it runs; a
lease that was not renewed for its time to live is dead and is taken over. Who wants a
run to end leaves a file that names it; the owner finds it when it renews and cancels
the Spark jobs that bear the run's tag.
"""

from __future__ import annotations

import threading
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from ..functions import files as shared

LIVES_S = 30.0


class Busy(RuntimeError):
    """Another run is under way."""


class Cancelled(RuntimeError):
    """The run was cancelled."""


@dataclass
class Lease:
    spark: SparkSession
    folder: str
    project: str
    lives_s: float = LIVES_S
    run: str = field(default_factory=lambda: uuid.uuid4().hex)
    cancelled: bool = False

    @property
    def path(self) -> str:
        return f"{self.folder}/run.lease"

    @property
    def tag(self) -> str:
        return f"run-{self.run}"

    def _told(self) -> dict:
        return {"run": self.run, "project": self.project, "renewed": time.time(), "lives_s": self.lives_s}

    def take(self) -> None:
        """Takes the lease, a dead one too; raises Busy if another run has it."""
        while not shared.create(self.spark, self.path, self._told()):
            held = shared.read(self.path)
            if held is None:
                continue
            if alive(held):
                raise Busy(f"a run of {held['project']} is under way")
            aside = f"{self.folder}/dead-{self.run}.json"
            if shared.moved(self.path, aside) and (found := shared.read(aside)) and found["run"] != held["run"]:
                # another session took it over in between: put its lease back
                shared.create(self.spark, self.path, found)
            shared.removed(aside)

    def __enter__(self) -> Lease:
        self.take()
        self.stop = threading.Event()
        self.spark.sparkContext.addJobTag(self.tag)
        self.thread = threading.Thread(target=self._renews, daemon=True)
        self.thread.start()
        return self

    def _renews(self) -> None:
        last = time.time()
        while not self.stop.wait(min(1.0, self.lives_s / 5)):
            if shared.exists(f"{self.folder}/cancel-{self.run}.json"):
                self.cancelled = True
            if self.cancelled:
                self.spark.sparkContext.cancelJobsWithTag(self.tag)
            if time.time() - last >= self.lives_s / 3:
                held = shared.read(self.path)
                if held is None or held["run"] != self.run:  # it was taken for dead
                    self.cancelled = True
                    continue
                shared.put(self.path, self._told())
                last = time.time()

    def check(self) -> None:
        """Raises Cancelled if the run is to end; called between jobs."""
        if not self.cancelled and shared.exists(f"{self.folder}/cancel-{self.run}.json"):
            self.cancelled = True
        if self.cancelled:
            raise Cancelled(f"the run of {self.project} was cancelled")

    def __exit__(self, *_) -> None:
        self.stop.set()
        self.thread.join()
        self.spark.sparkContext.removeJobTag(self.tag)
        held = shared.read(self.path)
        if held and held["run"] == self.run:
            shared.removed(self.path)
        shared.removed(f"{self.folder}/cancel-{self.run}.json")


def alive(held: dict | None) -> bool:
    return held is not None and time.time() - held["renewed"] < held["lives_s"]


def holder(folder: str) -> dict | None:
    """The run that has the lease, if it lives."""
    held = shared.read(f"{folder}/run.lease")
    return held if alive(held) else None


def cancel(folder: str) -> bool:
    """Asks the run that has the lease to end; False if there is none."""
    held = holder(folder)
    if held:
        shared.put(f"{folder}/cancel-{held['run']}.json", {"at": time.time()})
    return held is not None
