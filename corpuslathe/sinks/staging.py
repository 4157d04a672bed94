"""What a hub's commit would carry, from a staged folder.

One pass over the files gives path, size and the hash that names their contents. Small
files travel inside the commit, in lines of their own; large ones are named by their
hash and uploaded apart, each content once however many files have it. Nothing is sent
from here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Files of at most so many bytes travel inside the commit.
INLINE_BYTES = 10 << 20
# Keys of the payload's lines.
HEADER, FILE, LARGE = "header", "file", "lfsFile"


def objects(spark: SparkSession, folder: str, inline_bytes: int = INLINE_BYTES) -> DataFrame:
    """(path, size_bytes, sha256, large, content) of all files below ``folder``, content
    only of those that travel inside the commit. Hidden files and what begins with an
    underscore, as Spark's own marks do, and empty files are no part of it."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    root = f"{folder.rstrip('/').partition('://')[2] or folder.rstrip('/').removeprefix('file:')}/"
    # from the first place of the folder's own path on
    path = F.substring_index(F.col("path"), root, -1)
    large = F.col("length") > inline_bytes
    encoded = F.replace(F.base64("content"), F.lit("\r\n"), F.lit(""))  # without the line ends of mail
    return raw.select(path.alias("path"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"), large.alias("large"), F.when(~large, encoded).alias("content"))


def uploads(objects_: DataFrame) -> DataFrame:
    """(sha256, size_bytes, path) of each different large content: what has to be sent apart,
    and one path to read it from."""
    return objects_.where("large").groupBy("sha256").agg(F.first("size_bytes").alias("size_bytes"), F.min("path").alias("path"))


def payload(objects_: DataFrame, summary: str, description: str = "") -> DataFrame:
    """(ord, line): the commit as JSON lines, the header first, then the files by path."""
    head = objects_.sparkSession.createDataFrame([(summary, description)], "summary string, description string")
    line = lambda key, *fields: F.to_json(F.struct(F.lit(key).alias("key"), F.struct(*fields).alias("value")))
    first = head.select(F.lit("").alias("ord"), line(HEADER, "description", "summary").alias("line"))
    inline = line(FILE, "content", F.lit("base64").alias("encoding"), "path")
    large = line(LARGE, F.lit("sha256").alias("algo"), F.col("sha256").alias("oid"), "path", F.col("size_bytes").alias("size"))
    return first.union(objects_.select(F.concat(F.lit("/"), "path").alias("ord"), F.when(F.col("large"), large).otherwise(inline).alias("line")))
