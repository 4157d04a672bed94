"""Hard negatives by rotated one-bit codes with certain intervals.

Vectors become whole numbers. In a random rotation, a row's code is the signs of its
components; with it goes how well code and vector align. What the code does not say
is a residual, coded again, ``LEVELS`` times in all, and the length of the last one
is stored. A query is cut to ``PLANES`` bits a component, so that its product with a
code is a sum of popcounts. Estimate, cut and residual together give an interval
that holds the true product for certain (Cauchy-Schwarz), whatever the data are. Rows
whose interval cannot matter are left; the others are scored in whole numbers.

Two passes over blocks: the best rows of the anchor's label, then the best of other
labels within the limits that each positive sets. Anchors, a stated query set, meet
all rows block by block; a task keeps the results of ``HELD`` blocks of anchors and
hands over the rest, so its memory is bounded. No candidate is left out by number:
ties and copies are all scored, and ordered by id.
"""

from __future__ import annotations

from collections import OrderedDict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90
LEVELS, PLANES = 3, 6
BLOCK_ROWS, BLOCK_ANCHORS, AT_ONCE = 4096, 256, 32
HELD = 8
NONE = np.int64(-(2**63))
#: Products under it are exact in double precision; lengths over the second have no codes.
EXACT, LONGEST = 2.0**53, 1e140


@lru_cache(maxsize=4)
def rotation(dim: int) -> np.ndarray:
    q, _ = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))
    return q


def words_of(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    raw = np.packbits(bits, axis=-1, bitorder="little")
    raw = np.pad(raw, [(0, 0)] * (raw.ndim - 1) + [(0, -raw.shape[-1] % 8)])
    return np.ascontiguousarray(raw).view(np.uint64)


def coded(x: np.ndarray, levels: int = LEVELS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, align, rest): signs (level, row, word), the residual's part along its code
    (level, row), and the length of the last residual."""
    n, dim = x.shape
    with np.errstate(over="ignore"):
        length = np.sqrt((x**2).sum(1))
    wild = ~(length < LONGEST)
    left = np.where(wild[:, None], 0.0, x) @ rotation(dim) if dim else x
    codes, align = np.zeros((levels, n, -(-dim // 64)), np.uint64), np.zeros((levels, n))
    for k in range(levels if dim else 0):
        sign = left >= 0
        codes[k] = words_of(sign)
        align[k] = np.abs(left).mean(1)  # <left, code> / |code|^2
        left = left - np.where(sign, align[k][:, None], -align[k][:, None])
    return codes, align, np.where(wild, np.inf, np.sqrt((left**2).sum(1)) + 1e-9 * length)


class Planes:
    """Queries as bit planes: q = low + step * u + error, u of PLANES bits."""

    def __init__(self, q: np.ndarray, planes: int = PLANES):
        n, self.dim = q.shape
        with np.errstate(over="ignore"):
            self.length = np.sqrt((q**2).sum(1))
        wild = ~(self.length < LONGEST)
        self.length[wild] = np.inf
        turned = np.where(wild[:, None], 0.0, q) @ rotation(self.dim) if self.dim else q
        self.low = turned.min(1) if self.dim else np.zeros(n)
        step = (turned.max(1) - self.low if self.dim else np.zeros(n)) / (2**planes - 1)
        self.step = np.where(step > 0, step, 1.0)
        u = np.clip(np.rint((turned - self.low[:, None]) / self.step[:, None]), 0, 2**planes - 1).astype(np.int64)
        self.error = np.abs(turned - self.low[:, None] - self.step[:, None] * u).sum(1) + 1e-9 * self.length
        self.sums = u.sum(1)
        self.bits = np.stack([words_of(u >> b & 1 == 1) for b in range(planes)]) if self.dim else np.zeros((planes, n, 0), np.uint64)

    def interval(self, of: slice, codes: np.ndarray, align: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds (query, row) of the products of some queries with coded rows."""
        n = len(self.low[of])
        estimate = np.zeros((n, len(rest)))
        for k in range(len(codes)):
            weighted, ones = np.zeros((n, len(rest)), np.int32), np.zeros(len(rest), np.int64)
            for w in range(codes.shape[2]):
                ones += np.bitwise_count(codes[k, :, w])
                for b in range(len(self.bits)):
                    both = np.bitwise_count(self.bits[b, of, w, None] & codes[k, None, :, w])
                    weighted += both.astype(np.int32) << b
            # <q, signs> = low * (2 ones - dim) + step * (2 weighted - sum)
            product = self.low[of, None] * (2 * ones - self.dim) + self.step[of, None] * (2 * weighted - self.sums[of, None])
            estimate += product * align[k]
        with np.errstate(invalid="ignore"):
            width = self.length[of, None] * rest + self.error[of, None] * align.sum(0)
        width = np.where(np.isnan(width), np.inf, width) + 1e-6
        return estimate - width, estimate + width


def whole_products(a: np.ndarray, x: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Whole-number products (query, row) where wanted, NONE elsewhere; products beyond
    64 bits count as the greatest or least number."""
    out = np.full(wanted.shape, NONE)
    q, r = np.nonzero(wanted)
    if not len(q):
        return out
    with np.errstate(over="ignore"):
        most = np.sqrt((a**2).sum(1).max()) * np.sqrt((x[np.unique(r)] ** 2).sum(1).max())
    if not most < EXACT:
        big = 2**63 - 1
        exact = [[int(v) for v in row] for row in a], {int(k): [int(v) for v in x[k]] for k in np.unique(r)}
        out[q, r] = [max(-big, min(big, sum(s * t for s, t in zip(exact[0][i], exact[1][j], strict=True)))) for i, j in zip(q.tolist(), r.tolist(), strict=True)]
    elif len(q) * 16 > wanted.size:
        out = np.where(wanted, (a @ x.T).astype(np.int64), NONE)
    else:
        for i in range(0, len(q), 65_536):
            p, s = q[i : i + 65_536], r[i : i + 65_536]
            out[p, s] = np.einsum("ij,ij->i", a[p], x[s]).astype(np.int64)
    return out


class Block:
    """Rows of one dimension, out of the bytes that travel."""

    NAMES = ("rows", "ids", "known", "labels", "vectors", "codes", "align", "rest")

    def __init__(self, dim: int, parts: dict[str, bytes]):
        read = lambda name, kind: np.frombuffer(parts[name], kind)
        self.dim, self.rows, self.ids, self.labels = dim, read("rows", np.int64), read("ids", np.int64), read("labels", np.int64)
        self.known = read("known", bool)
        n = len(self.rows)
        self.vectors = read("vectors", np.float64).reshape(n, dim)
        if parts["rest"]:
            self.rest, self.align = read("rest", np.float64), read("align", np.float64).reshape(-1, n)
            self.codes = read("codes", np.uint64).reshape(len(self.align), n, -1)


class Anchors:
    """A block of anchors and the ``k`` best rows of each of its ``slots``: the anchor's
    own label (no limits), or other labels within the limits of each slot."""

    def __init__(self, block: Block, limits: np.ndarray | None, k: int):
        self.block, self.limits, self.k = block, limits, k
        self.slots = 1 if limits is None else limits.shape[1]
        self.planes = Planes(block.vectors)
        self.least = np.full((len(block.rows), self.slots), NONE)
        self.best = np.empty((0, 5), np.int64)  # slot, score, id (or 0), whether there is none, row

    def meet(self, other: Block) -> None:
        b, taken = self.block, []
        for at in range(0, len(b.rows), AT_ONCE):
            of = slice(at, min(at + AT_ONCE, len(b.rows)))
            low, high = self.planes.interval(of, other.codes, other.align, other.rest)
            same = b.labels[of, None] == other.labels
            may = same & (b.rows[of, None] != other.rows) if self.limits is None else ~same
            fits = []
            for s in range(self.slots):
                need = self.least[of, s].astype(np.float64)
                if self.limits is None:
                    if len(other.rows) >= self.k:  # the k-th largest of the lower bounds
                        sure = np.partition(np.where(may, low, -np.inf), -self.k, 1)[:, -self.k]
                        need = np.maximum(need, sure)
                    fits.append(may & ~(high < need[:, None]))
                else:
                    need = np.maximum(need, self.limits[of, s, 0].astype(np.float64))
                    most = self.limits[of, s, 1].astype(np.float64)
                    fits.append(may & ~(high < need[:, None]) & ~(low > most[:, None]))
            if not any(f.any() for f in fits):
                continue
            scores = whole_products(b.vectors[of], other.vectors, np.logical_or.reduce(fits))
            for s, fit in enumerate(fits):
                own = np.where(fit, scores, NONE)
                if self.limits is not None:
                    own[(own < self.limits[of, s, 0, None]) | (own > self.limits[of, s, 1, None])] = NONE
                need = self.least[of, s]
                if len(other.rows) > self.k:
                    need = np.maximum(need, np.partition(own, -self.k, 1)[:, -self.k])
                q, r = np.nonzero((own >= need[:, None]) & (own != NONE))
                taken.append(np.stack([(q + at) * self.slots + s, own[q, r], other.ids[r], ~other.known[r], other.rows[r]], 1))
        if taken:
            rows = np.concatenate([self.best, *taken])
            # ~score: the larger first, without overflow
            rows = rows[np.lexsort((rows[:, 4], rows[:, 2], rows[:, 3], ~rows[:, 1], rows[:, 0]))]
            place = np.arange(len(rows)) - np.searchsorted(rows[:, 0], rows[:, 0])
            self.best = rows[place < self.k]
            full = rows[place == self.k - 1]
            self.least[full[:, 0] // self.slots, full[:, 0] % self.slots] = full[:, 1]

    def found(self) -> pa.RecordBatch:
        """(anchor, slot, row, id, score)"""
        slot, score, ids, unknown, rows = self.best.T
        return pa.RecordBatch.from_arrays(
            [pa.array(self.block.rows[slot // self.slots]), pa.array(slot % self.slots), pa.array(rows), pa.array(ids, mask=unknown.astype(bool)), pa.array(score)], ["anchor", "slot", "row", "id", "score"]
        )


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, label: Column, anchor: Column) -> DataFrame:
    """(row, id, label, anchor, v): what takes part, with a number for each row and
    components floor(SCALE * x)."""
    v = F.transform(F.col(vector_col).cast("array<double>"), lambda x: F.lit(float(SCALE)) * x)
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), v.alias("v"))
    return rows.where(F.col("label").isNotNull() & F.forall("v", fine)).withColumn("row", F.monotonically_increasing_id())


def _blocks(rows: DataFrame, size: int, code: bool, limits: bool = False) -> DataFrame:
    """Blocks (dim, parts of Block, limits) of at most ``size`` rows."""

    def run(batches):
        for batch in batches:
            part = dict(zip(batch.schema.names, batch.columns, strict=True))
            v = part["v"].to_numpy(zero_copy_only=False)
            sizes = np.array([len(x) for x in v], np.int64)
            numbers = {c: part[c].fill_null(0).to_numpy() for c in ("row", "id", "label")}
            known = part["id"].is_valid().to_numpy(zero_copy_only=False)
            bounds = np.array(part["limits"].to_pylist(), np.int64) if limits else None
            for dim in np.unique(sizes).tolist():
                every = np.flatnonzero(sizes == dim)
                for at in range(0, len(every), size):
                    own = every[at : at + size]
                    x = np.floor(np.stack(v[own])).astype(np.float64).reshape(len(own), dim)
                    codes = coded(x) if code else (np.empty(0), np.empty(0), np.empty(0))
                    parts = [*(numbers[c][own] for c in ("row", "id")), known[own], numbers["label"][own], x, *codes, bounds[own] if limits else np.empty(0, np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int64()), *(pa.array([p.tobytes()], pa.binary()) for p in parts)], ["dim", *Block.NAMES, "limits"])

    full = rows.repartition(max(1, -(-rows.count() // size)))  # as many partitions as blocks
    return written(full.mapInArrow(run, ", ".join(["dim long", *(f"{n} binary" for n in (*Block.NAMES, "limits"))])))


def _searched(anchors: DataFrame, blocks: DataFrame, k: int, slots: int) -> DataFrame:
    """(anchor, slot, row, id, score): the best of each task; slots 0: own labels."""
    left = anchors.select(F.struct("dim", *Block.NAMES, "limits").alias("a"), F.xxhash64("rows").alias("key"))
    met = left.crossJoin(blocks.select(F.struct("dim", *Block.NAMES).alias("b")))

    def run(batches):
        held: OrderedDict[int, Anchors] = OrderedDict()
        for batch in batches:
            for a, key, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if a["dim"] != b["dim"]:
                    continue
                if key not in held:
                    own = Block(a["dim"], a)
                    limits = np.frombuffer(a["limits"], np.int64).reshape(len(own.rows), slots, 2) if slots else None
                    held[key] = Anchors(own, limits, k)
                    if len(held) > HELD:
                        yield held.popitem(last=False)[1].found()
                held.move_to_end(key)
                held[key].meet(Block(b["dim"], b))
        for rest in held.values():
            yield rest.found()

    best = met.mapInArrow(run, "anchor long, slot long, row long, id long, score long")
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "row")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(
    vectors: DataFrame, anchor: Column, label: Column, id_col: str = "vec_id", vector_col: str = "embedding",
    positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for
    each row for which ``anchor`` holds and each of its best ``positives`` other rows of
    the same label, the best ``negatives`` rows of other labels whose score is from
    ``low`` to ``high`` percent of the positive's.

    Scores are products of components floor(SCALE * x); larger ones come first, then
    smaller ids, null ids last. Rows with a null label, a null vector, or a null or
    non-finite component (after scaling) take no part; zero and empty vectors do.
    Vectors meet only those of their own length. Rows that repeat an id are rows of
    their own, as anchors too. An empty table gives no rows; other columns are read
    only by ``anchor`` and ``label``.
    """
    rows = written(whole_vectors(vectors, id_col, vector_col, label, anchor))
    asked = rows.where("anchor").drop("anchor")
    blocks = _blocks(rows, BLOCK_ROWS, True)
    own = _searched(_blocks(asked, BLOCK_ANCHORS, False), blocks, positives, 0)
    own = written(own.select("anchor", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))

    # whole limits: ceil(low * s / 100), floor(high * s / 100); s / 100 apart, so that nothing overflows
    rest = F.pmod("positive_score", F.lit(100))
    hundreds = ((F.col("positive_score") - rest).cast("decimal(20,0)") / 100).cast("long")
    least = hundreds * low + F.ceil(rest * low / F.lit(100.0)).cast("long")
    most = hundreds * high + F.floor(rest * high / F.lit(100.0)).cast("long")
    given = own.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct(F.col("slot").cast("int"), F.array(least, most)))).alias("of"))
    nothing = F.array(F.lit(1).cast("long"), F.lit(0).cast("long"))
    limits = F.flatten(F.array(*(F.coalesce(F.try_element_at("of", F.lit(s)), nothing) for s in range(positives))))
    second = asked.join(given, asked.row == given.anchor).select(*asked.columns, limits.alias("limits"))
    found = _searched(_blocks(second, BLOCK_ANCHORS, False, True), blocks, negatives, positives)
    named = found.select("anchor", F.col("slot").cast("int").alias("slot"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(own, ["anchor", "slot"])
    ids = asked.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    return named.join(ids, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
