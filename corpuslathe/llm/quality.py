"""Quality by hierarchical empirical Bayes.

1. Evidence: boosted trees on surface features of the whole text give each
   document's chance of being good; fitted on at most ``FIT_ROWS`` labelled rows.
2. Host level: the mean chance of a host's documents, shrunk towards the global
   mean by as many pseudo-documents as the spread between hosts calls for (method
   of moments). Path level: the same towards the host's posterior.
3. A document's posterior odds are its evidence (odds over the global odds) times
   the odds of its path, from which its own part is taken out first.

All levels are grouped sums that pre-aggregate; a host with a third of all rows is
one row of the statistics.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spread, written
from .toxicity import Trees

FIT_ROWS = 10_000
THRESHOLD = 0.5
LEAST_STRENGTH, MOST_STRENGTH = 2.0, 1000.0
FEATURES = ("log_words", "distinct", "top_share", "again", "mean_length", "longest", "letters", "upper", "digits", "stops", "symbols", "pipes", "bangs", "line_words", "repeated_lines", "high")

_SYMBOLS = [ord(c) for c in "#$%&*^~@{}<>\\="]
_STOPS = [ord(c) for c in ".,;:?"]


def features(text: str | None) -> list[float]:
    """The values of FEATURES; all zero for a null or blank text."""
    words = (text or "").split()
    if not words:
        return [0.0] * len(FEATURES)
    data = text.encode("utf-8", "surrogatepass")
    c = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n, size = len(words), len(data)
    found = Counter(words)
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    high = c[128:].sum()
    letters = c[65:91].sum() + c[97:123].sum() + high
    return [
        float(np.log1p(n)), len(found) / n, max(found.values()) / n, sum(map(str.__eq__, words, words[1:])) / n, len(text) / n, float(np.log1p(max(map(len, found)))),
        letters / size, c[65:91].sum() / max(letters, 1), c[48:58].sum() / size, c[_STOPS].sum() / n, c[_SYMBOLS].sum() / n, c[124] / n, c[33] / n,
        n / max(len(lines), 1), 1 - len(set(lines)) / max(len(lines), 1), high / size,
    ]


def _featured(rows: DataFrame, keep: list[str], model=None) -> DataFrame:
    """``keep`` with the features x of column text, or with the model's chance p."""
    shared = rows.sparkSession.sparkContext.broadcast(model) if model is not None else None

    def run(batches):
        for batch in batches:
            x = np.array([features(t) for t in batch.column(0).to_pylist()], float).reshape(batch.num_rows, len(FEATURES))
            if shared is None:
                out = pa.array(list(x), pa.list_(pa.float64()))
            else:
                trees, prior = shared.value
                out = pa.array(1 / (1 + np.exp(-trees.raw(x))) if trees else np.full(len(x), prior))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(1, batch.num_columns)), out], [*keep, "x" if shared is None else "p"])

    rows = spread(rows.select("text", *keep))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(run, f"{schema}, " + ("x array<double>" if shared is None else "p double"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = FIT_ROWS):
    """(trees or None, share of good rows) from at most ``rows`` labelled rows; null
    labels are left out, the larger of contradicting ones counts. With one class
    only, or none, there are no trees and the share (0.5 if none) is everyone's."""
    own = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("y"))
    chosen = F.broadcast(own.orderBy(F.xxhash64("_id"), "_id").limit(rows))  # at most FIT_ROWS rows of an id and a label
    sample = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text")).join(chosen, "_id")
    found = _featured(sample, ["_id", "y"]).toPandas().sort_values("_id", ignore_index=True)
    y = found.y.to_numpy(float)
    if not 0 < y.sum() < len(y):
        return None, float(y.mean()) if len(y) else 0.5
    return Trees(np.array(found.x.tolist()).reshape(len(y), len(FEATURES)), y), float(y.mean())


def _odds(p: Column) -> Column:
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, within: str, mean: Column) -> float:
    """Pseudo-documents k of a level, from the spread of its groups (n, s)
    around their parents' mean, by the method of moments."""
    p = F.col("s") / F.col("n")
    g = groups.where("n > 1").agg(
        F.sum(F.col("n") * F.pow(p - mean, 2)).alias("between"), F.sum("n").alias("rows"), F.count("*").alias("groups"), F.sum(within).alias("within"),
    )
    variance = F.col("within") / F.greatest(F.col("rows") - F.col("groups"), F.lit(1))
    spread = (F.col("between") - F.col("groups") * variance) / F.greatest(F.col("rows"), F.lit(1))
    k = F.when(spread > 0, variance / spread).otherwise(MOST_STRENGTH)
    return g.select(F.coalesce(F.least(F.greatest(k, F.lit(LEAST_STRENGTH)), F.lit(MOST_STRENGTH)), F.lit(MOST_STRENGTH))).first()[0]


def score(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text", host: Column | str = "source", path: Column | str = "lang", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, evidence, host_rate, path_rate, score, keep for every row.

    Null and blank texts are scored by all-zero features. Rows with a null host
    share one group, and null paths of a host share one. Repeated rows count each.
    An empty table gives no rows. Other columns are not read.
    """
    col = lambda c: (F.col(c) if isinstance(c, str) else c).cast("string")
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(F.concat(F.lit("="), col(host)), F.lit("")).alias("host"), F.coalesce(F.concat(F.lit("="), col(path)), F.lit("")).alias("path")
    )
    found = written(_featured(rows, ["doc_id", "host", "path"], model))
    paths = found.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q"))
    inside = F.greatest(F.col("q") - F.col("s") * F.col("s") / F.col("n"), F.lit(0.0))
    paths = written(paths.withColumn("inside", inside))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).withColumn("inside", inside)
    mean = F.lit(hosts.agg(F.sum("s") / F.sum("n")).first()[0] or 0.5)
    k = _strength(hosts, "inside", mean)
    hosts = written(hosts.select("host", ((F.col("s") + k * mean) / (F.col("n") + k)).alias("host_rate")))
    paths = written(paths.join(hosts, "host"))
    k = _strength(paths, "inside", F.col("host_rate"))
    rate = (F.col("s") - F.col("p") + k * F.col("host_rate")) / (F.col("n") - 1 + k)
    out = found.join(paths, ["host", "path"]).withColumn("path_rate", rate).withColumn("evidence", _odds(F.col("p")) - _odds(mean))
    return out.withColumn("score", 1 / (1 + F.exp(-(F.col("evidence") + _odds(F.col("path_rate")))))).select(
        "doc_id", "evidence", "host_rate", "path_rate", "score", (F.col("score") >= threshold).alias("keep")
    )
