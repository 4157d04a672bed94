"""Tables written on the way, and inputs dealt to all cores."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def written(df: DataFrame, *parts: str) -> DataFrame:
    """``df`` as a table in the folder that executors share, with a folder for each value
    of the columns ``parts``."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
        base = spark.sparkContext.getCheckpointDir()
    path = f"{base.rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.partitionBy(*parts).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many partitions as there are cores, if it has fewer; larger inputs
    stay as they are, so nothing is shuffled where it matters."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def numbered(rows: DataFrame, by: str, name: str) -> DataFrame:
    """``rows`` with their place in the order of ``by``, from 0. Ranges are numbered
    apart; only their counts, a row for each range, meet in one place."""
    ranges = written(rows.repartitionByRange(by).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    first = ranges.groupBy("_part").agg(F.count("*").alias("n")).select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_first"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(by)) - 1
    return ranges.withColumn(name, place).join(F.broadcast(first), "_part").select(*rows.columns, (F.col("_first") + F.col(name)).cast("long").alias(name))
