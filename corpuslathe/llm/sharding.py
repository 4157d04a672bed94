"""Sharding by longest-processing-time scheduling.

Groups of equal texts stay together. Groups larger than a small share of the
total are few by that bound, whatever the input; all smaller ones are first
merged by hash into ``BUCKETS`` units. So the scheduler, one heap on the driver,
gets at most BUCKETS + HEAVY * shards units, largest first, and gives each to the
least-loaded shard. What a shard may be over the mean is then about the least
unit, unless one group alone is more than a shard.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SHARDS = 16
BUCKETS = 1 << 15
#: A group is a unit of its own from 1 / (HEAVY * shards) of the total on.
HEAVY = 512
#: Rows of a shard are numbered in so many parts.
PARTS = 1024


def schedule(sizes: list[tuple[int, int]], shards: int) -> dict[int, int]:
    """Shard of each (unit, size): largest first, each to the least-loaded shard;
    ties go to the smaller unit and the smaller shard."""
    load = [(0, s) for s in range(shards)]
    out = {}
    for unit, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
        at, s = heapq.heappop(load)
        out[unit] = s
        heapq.heappush(load, (at + size, s))
    return out


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, shard, slot.

    size is the UTF-8 length of the text and one. A null text counts as empty and
    is in the empty texts' group. Rows with equal texts share a shard, repeated
    rows too; each has its own slot. slot is gapless from 0 within a shard. A null
    id stays null. An empty table gives no rows. Other columns are not read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = written(
        docs.select(
            F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("group"),
        )
    )
    spark = docs.sparkSession
    groups = rows.groupBy("group").agg(F.sum("size").alias("size"))
    total = groups.agg(F.sum("size")).first()[0] or 0
    least = max(1, total // (HEAVY * shards))
    # at most HEAVY * shards groups reach that size
    heavy = {r.group: r.size_ for r in groups.where(F.col("size") >= least).withColumnRenamed("size", "size_").collect()}
    heavy_df = F.broadcast(spark.createDataFrame([(g,) for g in heavy], "heavy long"))
    light = rows.join(heavy_df, F.col("group") == F.col("heavy"), "left").withColumn("bucket", F.pmod("group", F.lit(BUCKETS)))
    buckets = light.where("heavy is null").groupBy("bucket").agg(F.sum("size").alias("n")).collect()  # at most BUCKETS rows
    units = [(2 * i, r.n) for i, r in enumerate(buckets)] + [(2 * i + 1, n) for i, n in enumerate(heavy.values())]
    to = schedule(units, shards)
    by_bucket = [(r.bucket, to[2 * i]) for i, r in enumerate(buckets)]
    by_group = [(g, to[2 * i + 1]) for i, g in enumerate(heavy)]
    placed = (
        rows.withColumn("bucket", F.pmod("group", F.lit(BUCKETS)))
        .join(F.broadcast(spark.createDataFrame(by_group, "group long, s1 int")), "group", "left")
        .join(F.broadcast(spark.createDataFrame(by_bucket, "bucket long, s2 int")), "bucket", "left")
        .select("doc_id", "size", "text_crc32", F.coalesce("s1", "s2").alias("shard"), F.pmod(F.xxhash64("row"), F.lit(PARTS)).alias("part"), "row")
    )
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))  # at most shards * PARTS rows
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("shard", "part").orderBy("row"))
    return placed.withColumn("own", own).join(F.broadcast(counts), ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("own") - 1).cast("long").alias("slot")
    )
