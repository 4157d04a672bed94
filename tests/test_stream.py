"""Streams with state against the batch form."""

import random
import time

import pytest

from corpuslathe.streaming import phases, progress

LOG = "run string, seq long, event string, phase string, current int, total int"


def events(runs):
    r, out = random.Random(runs), []
    for run in range(runs):
        seq = 0
        for phase in ("scan", "analyse", "generate", "filter", "export")[: r.randrange(1, 6)]:
            steps = [("started", None, None)] + [("progress", k, r.choice([0, 4, 7])) for k in range(r.randrange(5))]
            steps += [("completed", None, None)] if r.random() < 0.8 else []
            for event, current, total in steps:
                out.append((f"r{run}", seq, event, phase, current, total))
                seq += 1
        out.append((f"r{run}", seq, "beat", None, None, None))
    r.shuffle(out)
    return out


@pytest.fixture()
def stored(spark):
    before = {k: spark.conf.get(k) for k in (phases.STORE[0], "spark.sql.shuffle.partitions")}
    spark.conf.set(*phases.STORE)
    spark.conf.set("spark.sql.shuffle.partitions", 2)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def streamed(spark, batches, tmp_path, stall_ms=None, wait=lambda: False):
    """All rows that the stream gives for batches of files, one at a time."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = phases.tracked(stream, stall_ms).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c")).foreachBatch(lambda df, i: df.write.mode("append").parquet(str(tmp_path / "out"))).start()
    try:
        end = time.time() + 90  # a query with timers runs on without data
        while (sum(p.numInputRows for p in q.recentProgress) < sum(map(len, batches)) or wait()) and time.time() < end and q.isActive:
            time.sleep(0.5)
        assert q.exception() is None
    finally:
        q.stop()
    return spark.read.parquet(str(tmp_path / "out"))


def test_phases_of_a_shuffled_log(stored, tmp_path):
    spark, log = stored, events(12)
    got = phases.settled(streamed(spark, [log[: len(log) // 2], log[len(log) // 2 :]], tmp_path))
    want = progress.completed_phases(spark.createDataFrame(log, LOG).where("phase is not null")).collect()
    rows = {(r.run, r.phase): r for r in got.collect()}
    assert {k: (r.started, r.completed, r.percent) for k, r in rows.items()} == {(r.run, r.phase): (r.started, r.completed, r.percent) for r in want}
    assert any(r.percent for r in want) and not any(r.stalled for r in rows.values())
    for run in {r.run for r in want}:  # the order of completion, and what is under way, as the last event of the run tells
        mine = [r for r in log if r[0] == run]
        done = [p for _, p in sorted((r[1], r[3]) for r in mine if r[2] == "completed")]
        begun = [(r[1], r[3]) for r in mine if r[2] == "started" and r[3] not in done]
        own = {p: r for (x, p), r in rows.items() if x == run}
        assert {p: r.place for p, r in own.items()} == {p: done.index(p) + 1 if p in done else None for p in own}
        assert {r.current for r in own.values()} == {max(begun)[1] if begun else None}


def test_stalled_run(stored, tmp_path):
    log = [("a", 0, "started", "scan", None, None), ("a", 1, "progress", "scan", 1, 2)]
    out = tmp_path / "out"
    seen = lambda: not (out.exists() and stored.read.parquet(str(out)).where("stalled").count())
    rows = streamed(stored, [log], tmp_path, stall_ms=1500, wait=seen)
    (stalled,) = rows.where("stalled").collect()
    assert (stalled.run, stalled.phase, stalled.percent, stalled.current, stalled.version) == ("a", "scan", 50, "scan", 3)
