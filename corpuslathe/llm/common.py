"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir``. Only a local session without
    that setting (tests, notebooks) gets a temporary folder of its own.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    found = sc.getCheckpointDir()
    if found is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: cuts the
    lineage, survives lost executors and lets several consumers share the work."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many partitions as there are cores, if it has fewer; larger inputs
    stay as they are, so nothing is shuffled where it matters."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every node of ``edges``; component is the smallest id
    that the node reaches.

    Alternates large-star and small-star until the edges are stars around the
    components' smallest ids. Each step is a grouped minimum joined back to the
    edges; nothing is collected but whether an edge is left that is none. The
    minima are written before they are joined, so that Spark broadcasts them if
    they are small and else deals the edges of one large star to several tasks.
    """
    now = written(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where("u <> v")
        .distinct()
    )

    def settled(df: DataFrame) -> bool:
        """Whether every node has one smaller neighbour at most, and then no larger one."""
        ends = df.select(F.col("u").alias("n"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(df.select("v", F.lit(0), F.lit(1)))
        return ends.groupBy("n").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 or down = 1 and up = 1").isEmpty()

    while not settled(now):
        both = now.union(now.select("v", "u")).toDF("u", "v")
        low = written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        large = (
            both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        ).where("u <> v").distinct()
        large = written(large)
        low = written(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").select(
            F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")
        )
        now = written(small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct())
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
