"""What base dedup moves, and pairs that only their sketches take for linked."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslathe import queries
from corpuslathe.operators import dedup

SIGNATURE = dedup.PERMUTATIONS * 8


def shuffled(spark) -> int:
    """Bytes that the session has shuffled so far."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    return sum(e.totalShuffleWrite() for e in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(sc.statusStore().executorList(False)))


@pytest.mark.parametrize("name", ["deduplicated_documents", "minhash_links"])
def test_signatures_are_shuffled_once_at_most(spark, sf, name, tmp_path):
    """With band hashes and sketches less than three times the bytes of all signatures, without
    broadcasts, which large tables do not have. Texts lie in many files, so they are not dealt."""
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    docs.repartition(32).write.parquet(f"{tmp_path}/documents.parquet")
    n, limit = docs.count(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled(spark)
        queries.QUERIES[name](spark, str(tmp_path)).write.format("noop").mode("overwrite").save()
        assert 0 < shuffled(spark) - before < 3 * n * SIGNATURE
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_only_rows_that_share_a_bucket_keep_signatures(spark, sf, monkeypatch):
    """Of the tables written on the way, the first has all signatures, and at most one more has any."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("ord"), "text")
    made, real = [], dedup.written
    monkeypatch.setattr(dedup, "written", lambda df: made.append(real(df)) or made[-1])
    dedup.deduplicated(docs, F.col("text")).count()
    bands = made[0].groupBy("bands").agg(F.min("ord").alias("i")).select("i", F.posexplode("bands").alias("band", "h"))
    met = bands.join(bands.groupBy("band", "h").count().where("count > 1"), ["band", "h"]).select("i").distinct().count()
    wide = [df.count() for df in made if "signature" in df.columns]
    assert wide == [docs.count(), met] and met < docs.count() / 2


@pytest.mark.parametrize("rounds", [0, 1, 3])
def test_sketches_alone_link_nothing(spark, rounds):
    """Values that differ in all but their lowest byte: sketches agree, signatures do not.
    109 of 128 equal values link, 108 do not."""
    r = np.random.default_rng(1)
    one = r.integers(0, 2**62, dedup.PERMUTATIONS)
    rows = [(0, one)]
    for i, equal in enumerate((109, 108, 8, 128 - 8), 1):
        rows.append((i, np.concatenate([one[:equal], one[equal:] + 256 * i])))
    bands = lambda x: [hash(tuple(x[k : k + 8].tolist())) for k in range(0, dedup.PERMUTATIONS, 8)]
    first = spark.createDataFrame([(i, bands(x), x.tolist()) for i, x in rows], "i long, bands array<long>, signature array<long>")
    gone: set = set()
    for j, y in rows:
        if any((x == y).mean() >= dedup.THRESHOLD for i, x in rows if i < j and i not in gone):
            gone.add(j)
    assert gone == {1, 4}
    assert {x.ord for x in dedup.removed_by_rounds(first, rounds=rounds).collect()} == gone
    pairs = {(i, j) for i, x in rows for j, y in rows if i < j and (x == y).mean() >= dedup.THRESHOLD}
    assert {(x.i, x.j) for x in dedup.links(first).collect()} == pairs
