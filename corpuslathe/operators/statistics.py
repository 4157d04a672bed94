"""Exact statistics of files and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import written


def language_totals(files: DataFrame) -> DataFrame:
    """Files, lines and bytes by language and in total (language null and is_total)
    in one pass; rows without a language count in the total only."""
    out = files.rollup("language").agg(
        F.count("*").alias("file_count"), F.sum("line_count").alias("total_lines"), F.sum("size_bytes").alias("total_bytes"), F.grouping("language").cast("boolean").alias("is_total")
    )
    return out.where("is_total or language is not null")


def counts(samples: DataFrame) -> DataFrame:
    """Long form (dimension, key, n) by type, language and complexity."""
    pairs = F.explode(
        F.array(
            F.struct(F.lit("type").alias("dimension"), F.col("sample_type").alias("key")),
            F.struct(F.lit("language").alias("dimension"), F.coalesce("metadata.language", F.lit("Unknown")).alias("key")),
            F.struct(F.lit("complexity").alias("dimension"), F.coalesce("metadata.complexity_tier", F.lit("Unknown")).alias("key")),
        )
    )
    return samples.select(pairs.alias("p")).groupBy("p.dimension", "p.key").agg(F.count("*").alias("n"))


def order_statistics(numbers: DataFrame, column: str) -> DataFrame:
    """One row: n, total, min, max, mean (rounded down), median, p90, p99, each the
    element at its index of the sorted list; zeros for an empty table.

    Equal numbers are grouped first. Their distinct values are counted in ranges; of
    the ranges alone, a row each, the running total is made in one place. Then only the
    range that holds an index is ordered within.
    """
    each = numbers.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    ranges = written(each.repartitionByRange("v").withColumn("_part", F.spark_partition_id()))
    parts = ranges.groupBy("_part").agg(F.sum("n").alias("part_n"))  # a row for each range
    before = F.coalesce(F.sum("part_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("_part", before.alias("before"), F.sum("part_n").over(Window.partitionBy()).alias("total"))
    inner = F.sum("n").over(Window.partitionBy("_part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    rows = ranges.withColumn("inner", inner).join(F.broadcast(parts), "_part").withColumn("upto", F.col("before") + F.col("inner"))
    at = {"median": F.floor(F.col("total") / 2), "p90": F.floor((F.col("total") - 1) * 0.9), "p99": F.floor((F.col("total") - 1) * 0.99)}
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return rows.agg(
        zero(F.sum("n")).alias("n"), zero(F.sum(F.col("v") * F.col("n"))).alias("sum"), zero(F.min("v")).alias("min"), zero(F.max("v")).alias("max"),
        zero(F.floor(F.sum(F.col("v") * F.col("n")) / F.sum("n"))).alias("mean"), *(zero(F.min(F.when(F.col("upto") > i, F.col("v")))).alias(k) for k, i in at.items()),
    )


def quality_counters(judged: DataFrame, kept: DataFrame) -> DataFrame:
    """One row: total_input, filtered, pre_dedup_count, passed, duplicates_removed."""
    one = judged.agg(F.count("*").alias("total_input"), F.count_if(F.col("reject_reason").isNotNull()).alias("filtered"), F.count_if(F.col("reject_reason").isNull()).alias("pre_dedup_count"))
    n = kept.count()
    return one.withColumn("passed", F.lit(n).cast("long")).withColumn("duplicates_removed", F.col("pre_dedup_count") - n)
