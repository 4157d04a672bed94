"""Maximum inner product search by score-aware (anisotropic) quantisation.

Vectors are quantised with 16 codewords (four bits) for every two dimensions. The
loss weighs the part of the residual that is parallel to the vector ETA times as
much as the rest, since that part moves the largest inner products. Codewords are
fitted on at most ``FIT_ROWS`` vectors; every vector is coded and searched.

A search scans four-bit tables: for a block of queries, the inner products of all
codewords, joined in pairs to tables of 256 entries, are summed by the codes of a
block of vectors. All vectors whose approximate score comes within ``MARGIN``
errors of the k-th best are reranked exactly, however many they are.

Equal vectors are one entry with the first of their rows. Queries and vectors meet in
blocks of bounded size; a task keeps the tables of ``HELD`` blocks of queries, with k
results a query, and hands over the rest.
"""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

FIT_ROWS = 8192
THRESHOLD = 0.2
ROUNDS = 4
BLOCK_ROWS = 4096
BLOCK_QUERIES = 256
#: Reranks reach down so many standard errors of the approximate scores.
MARGIN = 3.0
SALTS = 64
HELD = 8
LAST = 2**63 - 1


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) with v as doubles; without vectors that are null, empty, zero or hold
    null or non-finite components."""
    v = F.col(vector_col).cast("array<double>").alias("v")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vectors.select(F.col(id_col).alias("vec_id"), v).where(F.forall("v", fine) & F.exists("v", lambda x: x != 0))


class Quantiser:
    """Codewords of every pair of dimensions, fitted to the anisotropic loss."""

    def __init__(self, x: np.ndarray, threshold: float = THRESHOLD, rounds: int = ROUNDS, seed: int = 1):
        self.dim = x.shape[1]
        x = self.padded(x)
        self.parts = x.shape[1] // 2
        self.eta = max(1.0, (self.dim - 1) * threshold**2 / (1 - threshold**2))
        rng = np.random.default_rng(seed)
        pairs = x.reshape(len(x), self.parts, 2)
        start = rng.choice(len(x), 16, replace=len(x) < 16)
        self.words = pairs[start].transpose(1, 0, 2) + 1e-9 * rng.standard_normal((self.parts, 16, 2))
        for _ in range(8):  # plain k-means to start from
            codes = ((pairs[:, :, None] - self.words) ** 2).sum(3).argmin(2)
            for m in range(self.parts):
                n = np.bincount(codes[:, m], minlength=16)
                for k in (0, 1):
                    s = np.bincount(codes[:, m], pairs[:, m, k], 16)
                    self.words[m, :, k] = np.where(n > 0, s / np.maximum(n, 1), self.words[m, :, k])
        for _ in range(rounds):
            self.refit(x, self.codes(x))
        # error of scores of queries like the vectors themselves
        other = x[rng.permutation(len(x))]
        self.error = float(np.sqrt(((other * (x - self.decoded(self.codes(x)))).sum(1) ** 2).mean())) if len(x) > 1 else 0.0

    def padded(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, x.shape[1] % 2)))

    def codes(self, x: np.ndarray, sweeps: int = 3) -> np.ndarray:
        """Codes by coordinate descent on the anisotropic loss."""
        x = self.padded(x) if x.shape[1] == self.dim else x
        pairs = x.reshape(len(x), self.parts, 2)
        unit = pairs / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None, None]
        plain = ((pairs[:, :, None] - self.words) ** 2).sum(3)
        along = np.einsum("nmk,nmck->nmc", unit, pairs[:, :, None] - self.words)
        codes = plain.argmin(2)
        rows = np.arange(len(x))
        parallel = np.take_along_axis(along, codes[:, :, None], 2)[:, :, 0].sum(1)
        for _ in range(sweeps):
            for m in range(self.parts):
                rest = parallel - along[rows, m, codes[:, m]]
                codes[:, m] = (plain[:, m] + (self.eta - 1) * (rest[:, None] + along[:, m]) ** 2).argmin(1)
                parallel = rest + along[rows, m, codes[:, m]]
        return codes

    def refit(self, x: np.ndarray, codes: np.ndarray) -> None:
        """Codewords that minimise the loss for fixed codes (least squares)."""
        n, size = len(x), self.parts * 32
        unit = x / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None]
        place = ((np.arange(self.parts) * 16 + codes)[:, :, None] * 2 + np.arange(2)).reshape(n, -1)
        z = np.zeros((n, size))
        np.put_along_axis(z, place, unit, 1)
        a = (self.eta - 1) * (z.T @ z)
        a[np.diag_indices(size)] += np.bincount(place.ravel(), minlength=size) + 1e-6
        b = np.bincount(place.ravel(), x.ravel(), size) + (self.eta - 1) * (z.T @ (unit * x).sum(1)) + 1e-6 * self.words.ravel()
        self.words = np.linalg.solve(a, b).reshape(self.parts, 16, 2)

    def decoded(self, codes: np.ndarray) -> np.ndarray:
        return self.words[np.arange(self.parts), codes].reshape(len(codes), -1)

    def packed(self, codes: np.ndarray) -> np.ndarray:
        """Two four-bit codes in each byte."""
        codes = np.pad(codes, ((0, 0), (0, codes.shape[1] % 2))).astype(np.uint8)
        return codes[:, ::2] * 16 + codes[:, 1::2]

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Score tables (byte, query, 256) of a block of queries."""
        pairs = self.padded(queries).reshape(len(queries), self.parts, 2)
        one = np.einsum("qmk,mck->mqc", pairs, self.words).astype(np.float32)
        if self.parts % 2:
            one = np.concatenate([one, np.zeros_like(one[:1])])
        return (one[::2, :, :, None] + one[1::2, :, None, :]).reshape(len(one) // 2, len(queries), 256)


def scan(tables: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """Approximate scores (query, vector)."""
    out = np.take(tables[0], packed[:, 0], 1)
    for b in range(1, len(tables)):
        out += np.take(tables[b], packed[:, b], 1)
    return out


class _Best:
    """The k best exact results of each query of a block, over the blocks seen; ties go
    to the smaller first id, then to the smaller number."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, quantiser: Quantiser, k: int):
        self.ids, self.queries, self.k = ids, queries, k
        self.tables = quantiser.tables(queries)
        self.slack = MARGIN * quantiser.error * np.linalg.norm(queries, axis=1) / quantiser.scale
        self.rows = np.empty((0, 3), np.int64)
        self.scores = np.empty(0)
        self.least = np.full(len(ids), -np.inf)

    def meet(self, ids: np.ndarray, firsts: np.ndarray, packed: np.ndarray, vectors: np.ndarray) -> None:
        near = scan(self.tables, packed)
        k = min(self.k, len(ids))
        low = np.maximum(np.partition(near, len(ids) - k, 1)[:, len(ids) - k], self.least) - self.slack
        q, r = np.nonzero(near >= low[:, None])
        scores = np.concatenate([np.einsum("ij,ij->i", self.queries[q[i : i + 65536]], vectors[r[i : i + 65536]]) for i in range(0, max(len(q), 1), 65536)])
        rows = np.concatenate([self.rows, np.stack([q, ids[r], firsts[r]], 1)])
        scores = np.concatenate([self.scores, scores])
        order = np.lexsort((rows[:, 1], rows[:, 2], -scores, rows[:, 0]))
        rows, scores = rows[order], scores[order]
        place = np.arange(len(rows)) - np.searchsorted(rows[:, 0], rows[:, 0])
        keep = place < self.k
        self.rows, self.scores = rows[keep], scores[keep]
        full = place[keep] == self.k - 1
        self.least[self.rows[full, 0]] = self.scores[full]


def _blocks(rows: DataFrame, size: int, quantiser) -> DataFrame:
    """Blocks of rows (rep, first, v) as bytes: numbers, first ids, vectors and, with a
    quantiser, codes."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                ids, firsts = (part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (0, 1))
                x = np.stack(part.column(2).to_numpy(zero_copy_only=False)).astype(np.float64)
                codes = quantiser.value.packed(quantiser.value.codes(x)).tobytes() if quantiser else b""
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.binary()) for b in (ids.tobytes(), firsts.tobytes(), x.tobytes(), codes)], ["ids", "firsts", "vectors", "codes"])

    return rows.select("rep", "first", "v").mapInArrow(run, "ids binary, firsts binary, vectors binary, codes binary")


def search(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", fit_rows: int = FIT_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row whose id is
    divisible by ``every`` against all other rows, by largest inner product of the
    original vectors in double precision; ties go to the smaller id.

    Vectors that are null, zero or hold null or non-finite components take no part.
    Every other row is a candidate of its own: rows that repeat an id too, as queries
    as well, and rows without id, which come last among ties. Vectors meet those of
    their own length, a search for each length. Fewer than k candidates are all
    returned; an empty table gives no rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = written(usable(vectors, id_col, vector_col).withColumn("row", F.monotonically_increasing_id()))
    found = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for r in rows.select(F.size("v").alias("dim")).distinct().collect():  # a row for each length
        found = found.union(_searched(rows.where(F.size("v") == r.dim), r.dim, k, every, fit_rows))
    return found


def _searched(rows: DataFrame, dim: int, k: int, every: int, fit_rows: int) -> DataFrame:
    """``search`` over rows (vec_id, v, row) of one length."""
    spark = rows.sparkSession
    sample = rows.orderBy(F.xxhash64("vec_id"), "row").limit(fit_rows).select("v").collect()  # at most fit_rows
    x = np.array([r.v for r in sample])
    fitted = Quantiser(np.unique(x, axis=0))
    fitted.scale = float(np.sqrt((x**2).sum(1).mean()))
    quantiser = spark.sparkContext.broadcast(fitted)

    each, in_order = rows, [F.col("vec_id").asc_nulls_last(), "row"]
    for by in (["v", F.pmod(F.xxhash64("row"), F.lit(SALTS))], ["v"]):  # the first k + 1 of equal vectors, a common vector in parts first
        rows = rows.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy(*in_order))).where(F.col("n") <= k + 1).drop("n")
    first = F.coalesce(F.col("vec_id").cast("long"), F.lit(LAST))
    entries = written(rows.groupBy("v").agg(F.collect_list(F.struct("vec_id", "row")).alias("ids"), F.min("row").alias("rep"), F.min(first).alias("first")))
    asked = each.where(F.col("vec_id") % every == 0)
    asked = written(asked.join(entries.select("v", "rep"), "v").select("vec_id", "row", "rep"))
    queries = entries.join(asked.select("rep").distinct(), "rep", "left_semi")

    # full blocks: as many partitions as there are blocks
    parts = lambda df, size: df.repartition(max(1, -(-df.count() // size)))
    left = written(_blocks(parts(queries, BLOCK_QUERIES), BLOCK_QUERIES, None))
    right = written(_blocks(parts(entries, BLOCK_ROWS), BLOCK_ROWS, quantiser))
    # the stated queries against all rows: blocks meet blocks, not rows rows
    met = left.select(F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"), F.xxhash64("ids").alias("q")).crossJoin(right)

    def run(batches):
        best: OrderedDict[int, _Best] = OrderedDict()

        def out(b: _Best) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(b.ids[b.rows[:, 0]]), pa.array(b.rows[:, 1]), pa.array(b.rows[:, 2]), pa.array(b.scores)], ["q", "rep", "first", "score"])

        for batch in batches:
            for q_ids, q_v, q, ids, firsts, v, codes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if q not in best:
                    own = np.frombuffer(q_ids, np.int64)
                    best[q] = _Best(own, np.frombuffer(q_v).reshape(len(own), dim), quantiser.value, k + 1)
                    if len(best) > HELD:
                        yield out(best.popitem(last=False)[1])
                best.move_to_end(q)
                ids, firsts = np.frombuffer(ids, np.int64), np.frombuffer(firsts, np.int64)
                best[q].meet(ids, firsts, np.frombuffer(codes, np.uint8).reshape(len(ids), -1), np.frombuffer(v).reshape(len(ids), dim))
        for b in best.values():
            yield out(b)

    found = met.select("q_ids", "q_vectors", "q", "ids", "firsts", "vectors", "codes").mapInArrow(run, "q long, rep long, first long, score double")
    top = lambda of: Window.partitionBy(of).orderBy(F.desc("score"), *in_order)
    found = found.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "first", "rep"))).where(F.col("n") <= k + 1).drop("n", "first")
    near = found.join(entries.select("rep", "ids"), "rep").select("q", F.inline("ids"), "score")
    near = near.withColumn("n", F.row_number().over(top("q"))).where(F.col("n") <= k + 1)
    asked = asked.select(F.col("vec_id").cast("long").alias("query_id"), F.col("row").alias("query_row"), F.col("rep").alias("q"))
    answers = asked.join(near, "q").where("query_row <> row")
    return answers.withColumn("rank", F.row_number().over(top("query_row"))).where(F.col("rank") <= k).select("query_id", "rank", F.col("vec_id").cast("long").alias("vec_id"), "score")


def recall(found: DataFrame, vectors: DataFrame, queries: int = 50, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> float | None:
    """Share of the k truly nearest that ``found`` has, for at most so many queries,
    by brute force over all rows; None if nothing is near. Ids are taken to be different."""
    ids = [r[0] for r in found.select("query_id").distinct().orderBy(F.xxhash64("query_id")).limit(queries).collect()]
    rows = usable(vectors, id_col, vector_col).where("vec_id is not null").distinct()
    asked = F.broadcast(rows.where(F.col("vec_id").isin(ids)).select(F.col("vec_id").alias("query_id"), F.col("v").alias("w")))
    dot = F.aggregate(F.zip_with("v", "w", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    pairs = rows.join(asked, (F.col("vec_id") != F.col("query_id")) & (F.size("v") == F.size("w"))).select("query_id", "vec_id", dot.alias("score"))
    true = pairs.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("n") <= k)
    hits = true.join(found.select("query_id", "vec_id"), ["query_id", "vec_id"], "left_semi")
    n = true.count()
    return hits.count() / n if n else None
