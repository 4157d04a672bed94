"""A corpus pipeline over ``documents``: each stage applies one operator of
``corpuslathe.llm`` to all rows that the stage before it kept.

Stages take and return the columns of ``documents``; the last returns the packed
pieces. A stage's result is written as Parquet and read again as the next input.
SQL cannot express the trees of the first stage, so ``ORACLE_SQL`` is None; the
tests compare the stages with brute force.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslathe.llm import minhash, mixing, packing, secrets, toxicity
from corpuslathe.llm.common import shared_dir, written

MOST_REPEATS = 1.5


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from ``labels``. Null and
    empty texts are scored like others, repeated rows alike; an empty table stays
    empty."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels.where(~toxicity.held_out()))
    # text travels once, as an input of the score that is also carried
    scored = toxicity.score(docs, model, carry=docs.columns)
    return scored.where("predicted = 0").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays: that of its smallest id.
    Rows are told apart by id and text, so unrelated texts that share an id all
    stay, and rows without id are judged like others."""
    found = written(minhash.survivors(docs).where("not stays or n > 1"))
    gone = found.where("not stays").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    again = found.where("stays").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    rows = docs.withColumn("_text_hash", minhash.text_hash())
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_hash"))
    left = rows.join(gone, same, "left_anti")
    if again.isEmpty():
        return left.select(*docs.columns)
    several = left.join(again, same, "left_semi").dropDuplicates(["doc_id", "_text_hash"])
    return left.join(again, same, "left_anti").select(*docs.columns).unionByName(several.select(*docs.columns))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live credentials are masked; every document stays. A source is an owner, its
    languages are its repositories. Null texts, ids and sources are judged like others,
    repeated rows alike; an empty table stays empty."""
    return secrets.redact(docs, repo_col=F.concat_ws("/", "source", "lang"), owner_col="source")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are read towards flatter weights, each at least once and none more
    than MOST_REPEATS times; rows repeat accordingly. Each block of the mixture is a
    partition, thus a file of the written table, with its rows in order. Null sources
    are a source, null texts are read once, repeated rows each for itself; an empty
    table stays empty."""
    size, blocks = mixing.block_plan(docs, most_repeats=MOST_REPEATS)
    out = mixing.mix(docs, keep_all=True, most_repeats=MOST_REPEATS, carry=docs.columns, block_tokens=size)
    return out.repartitionById(blocks, F.col("block").cast("int")).sortWithinPartitions("position").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens; a row for each piece. A table of files is packed
    file by file, and sequence_id follows the files: so it follows the mixture. Null
    texts are empty documents, repeated rows each for itself; an empty table has no
    sequences."""
    if not docs.inputFiles():
        return packing.pack_documents(docs)
    return packing.pack_parts(docs, F.col("_metadata.file_name"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic),
    ("near_duplicates", near_duplicates),
    ("secrets", without_secrets),
    ("mixing", mixed),
    ("packing", packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
