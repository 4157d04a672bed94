"""Progress logs: what each run did last, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(log: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """The last event of each key: n and the value with the largest order."""
    return log.groupBy(*key).agg(F.count("*").alias("n"), F.max(F.struct(*order, value)).alias("m")).select(*key, "n", *(F.col(f"m.{c}").alias(c) for c in [*order, value]))


def windowed_counts(log: DataFrame, time: str, kind: str, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """Events by window and kind; with ``late``, a watermark bounds a stream's state."""
    log = log.withWatermark(time, late) if late else log
    return log.groupBy(F.window(time, width).alias("w"), kind).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), kind, "n", "total")


def completed_phases(log: DataFrame) -> DataFrame:
    """(run, phase, started, completed, percent) from events (run, seq, event, phase,
    current, total); percent 0 where the total is 0."""
    is_ = lambda e: F.count_if(F.col("event") == e) > 0
    step = F.max_by(F.when(F.col("total") > 0, F.floor(100 * F.col("current") / F.col("total") + 0.5)).otherwise(0), F.when(F.col("event") == "progress", F.col("seq")))
    return log.groupBy("run", "phase").agg(is_("started").alias("started"), is_("completed").alias("completed"), F.coalesce(step, F.lit(0)).cast("int").alias("percent"))
