"""Near-duplicate removal that keeps the first of linked samples.

Signatures are 128 minima over XXH3 hashes of 5-character shingles, in 16 bands of
8; two samples link when their signatures agree in at least the threshold's share.
A sample goes if an earlier, kept one links with it. This is not the same as one
per component: of a chain a-b-c without a-c, both a and c stay.

Candidates are rows of one band's bucket. Copies leave in a few rounds in which the
earliest rows remove what links with them; what is open then, the rows of a bucket that
do not link as a rule, is compared in pairs of chunks, so that no bucket is one task. The
chunks hold sketches, the lowest byte of each minimum: rows that link agree in so many of
them for certain, so only few pairs fetch their signatures.

A signature has a kilobyte and is written once. Rows alone in all of their buckets, most of
them, are told from band hashes; only the others' signatures are shuffled, and a candidate
pair meets them only if its sketches agree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import spread, written

PERMUTATIONS, BANDS, SHINGLE = 128, 16, 5
THRESHOLD = 0.85
#: Runs of characters whose hashes a task keeps, and how many are signed at once.
RUNS_HELD, RUNS_AT_ONCE = 1_000_000, 200_000
#: Rounds in which the earliest rows remove others, and rows of a chunk after that.
ROUNDS, CHUNK = 3, 1024


def seeds() -> tuple[np.ndarray, np.ndarray]:
    import xxhash

    hashed = lambda first: np.array([xxhash.xxh3_64_intdigest((first + i).to_bytes(8, "little")) for i in range(PERMUTATIONS)], np.uint64)
    return hashed(0), hashed(1000)


class _Runs(dict):
    """Hashes of runs; forgets all when it is full."""

    def __missing__(self, run: str) -> int:
        import xxhash

        if len(self) >= RUNS_HELD:
            self.clear()
        self[run] = h = xxhash.xxh3_64_intdigest(run.encode())
        return h


def shingle_hashes(text: str, held: dict | None = None) -> np.ndarray:
    """Distinct hashes of all runs of 5 characters; a shorter text is one run."""
    if not text:
        return np.empty(0, np.uint64)
    held = _Runs() if held is None else held
    runs = set(map("".join, zip(*(text[i:] for i in range(SHINGLE))))) if len(text) > SHINGLE else {text}  # noqa: B905
    return np.fromiter(map(held.__getitem__, runs), np.uint64, len(runs))


def signed(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A signature for each set; of an empty one all values are the greatest."""
    out = np.full((len(sets), PERMUTATIONS), np.iinfo(np.uint64).max, np.uint64)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        flat = np.concatenate([sets[i] for i in full])
        starts = np.cumsum([0, *(len(sets[i]) for i in full[:-1])])
        for k in range(PERMUTATIONS):
            out[full, k] = np.minimum.reduceat(flat * a[k] + b[k], starts)
    return out


def signature(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return signed([hashes], a, b)[0]


def signatures(texts: DataFrame, ord_col: str = "ord", text_col: str = "text") -> DataFrame:
    """(ord, signature, bands) for each row; the last two as signed longs."""

    def run(batches):
        import xxhash

        (a, b), held = seeds(), _Runs()
        for batch in batches:
            s, sets, size = [], [], 0
            for t in batch.column(1).to_pylist():
                sets.append(shingle_hashes(t or "", held))
                size += len(sets[-1])
                if size >= RUNS_AT_ONCE:
                    s, sets, size = [*s, *signed(sets, a, b)], [], 0
            s = [*s, *signed(sets, a, b)]
            bands = [[xxhash.xxh3_64_intdigest(x[i : i + 8].astype("<u8").tobytes()) for i in range(0, PERMUTATIONS, PERMUTATIONS // BANDS)] for x in s]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x.view(np.int64) for x in s], pa.list_(pa.int64())), pa.array([np.array(x, np.uint64).view(np.int64) for x in bands], pa.list_(pa.int64()))],
                ["ord", "signature", "bands"],
            )

    return spread(texts.select(F.col(ord_col).cast("long").alias("ord"), F.col(text_col).alias("text"))).mapInArrow(run, "ord long, signature array<long>, bands array<long>")


def heads(signed: DataFrame) -> DataFrame:
    """(i, bands): of rows with equal signatures the first. The others are always removed:
    by the first if it is kept, else by what removed the first. The 16 band hashes, 1024
    bits, stand for the signature."""
    return signed.groupBy("bands").agg(F.min("ord").alias("i")).select("i", "bands")


def firsts(signed: DataFrame) -> DataFrame:
    """(i, bands, signature) of ``heads``."""
    return heads(signed).join(signed.select(F.col("ord").alias("i"), "signature"), "i")


def _sketches(batches):
    """Rows (i, signature) with their sketch."""
    for batch in batches:
        low = _values(batch.column(1)).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x.tobytes() for x in low], pa.binary())], ["i", "signature", "sketch"])


def _shared(first: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (i, band, h, low) of buckets with several of ``first``, low being the earliest
    of the bucket, and (i, signature, sketch) of these rows, out of ``stored``."""
    rows = first.select("i", F.posexplode("bands").alias("band", "h"))
    rows = written(rows.join(_several(rows), ["band", "h"]))
    own = stored.select("i", "signature").join(rows.select("i").distinct(), "i", "left_semi")
    return rows, written(own.mapInArrow(_sketches, "i long, signature array<long>, sketch binary"))


def _several(rows: DataFrame) -> DataFrame:
    return rows.groupBy("band", "h").agg(F.min("i").alias("low"), F.count("*").alias("n")).where("n > 1").drop("n")


def _values(column: pa.Array) -> np.ndarray:
    """A row of numbers for each sketch or signature."""
    if pa.types.is_binary(column.type):
        return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, PERMUTATIONS)
    return column.flatten().to_numpy().reshape(-1, PERMUTATIONS)


def _agreeing(least: int):
    """Pairs (i, j) of rows (i, j, x, y) whose sketches x and y agree in ``least`` places."""

    def run(batches):
        for batch in batches:
            alike = (_values(batch.column("x")) == _values(batch.column("y"))).sum(1) >= least
            yield batch.select(["i", "j"]).filter(pa.array(alike))

    return run


def _least(threshold: float) -> int:
    return int(np.ceil(threshold * PERMUTATIONS - 1e-9))


def _near(pairs: DataFrame, stored: DataFrame, threshold: float) -> DataFrame:
    """(i, j, similarity) of the pairs (i, j) that reach the threshold. The pairs are written:
    if they are few, Spark sends them to the signatures, which then stay where they are."""
    ends = written(pairs).select("i", "j", F.explode(F.array("i", "j")).alias("end"))
    met = stored.select(F.col("i").alias("end"), "signature").join(ends, "end")
    sides = [F.collect_list(F.when(F.col("end") == F.col(c), F.col("signature"))).alias(c + "s") for c in "ij"]
    met = met.groupBy("i", "j").agg(*sides).select("i", "j", F.explode("is").alias("s"), "js").select("i", "j", "s", F.explode("js").alias("t"))
    same = F.aggregate(F.zip_with("s", "t", lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda n, v: n + v)
    near = met.select("i", "j", (same / F.lit(float(PERMUTATIONS))).alias("similarity"))
    return near.where(F.col("similarity") >= threshold)


def _compared(least: int):
    """(i, j, n) of pairs whose sketches or signatures agree in n places, ``least`` or more,
    out of rows (band, h, lo, hi, i, chunk, values), sorted by the first four, of which
    each group meets in one place: between its two chunks, or in its only one."""

    def met(group: list[tuple]) -> list[tuple[int, int, int]]:
        lo, hi = group[0][2:4]
        left = [r for r in group if r[5] == lo]
        right = left if lo == hi else [r for r in group if r[5] != lo]
        if not left or not right or len(group) < 2:
            return []
        x, y = (np.stack([r[6] for r in side]) for side in (left, right))
        u, v = x.astype(np.uint8), y.astype(np.uint8)
        out = []
        for at in range(0, len(x), 16):
            a, b = np.nonzero((u[at : at + 16, None] == v[None]).sum(2, dtype=np.int32) >= least)
            n = (x[at + a] == y[b]).sum(1)
            out += [(left[at + p][4], right[q][4], k) for p, q, k in zip(a.tolist(), b.tolist(), n.tolist(), strict=True) if k >= least]
        return [(min(p[:2]), max(p[:2]), p[2]) for p in out if p[0] != p[1] and (left is not right or p[0] < p[1])]

    def run(batches):
        group: list[tuple] = []
        for batch in batches:
            found = []
            for row in zip(*(c.to_pylist() for c in batch.columns[:6]), _values(batch.column(6)), strict=True):
                if group and row[:4] != group[0][:4]:
                    found += met(group)
                    group = []
                group.append(row)
            yield table(found)
        yield table(met(group) if group else [])

    def table(found: list[tuple[int, int, int]]) -> pa.RecordBatch:
        columns = zip(*found, strict=True) if found else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["i", "j", "n"])

    return run


def _meeting(rows: DataFrame, stored: DataFrame, values: str, threshold: float) -> DataFrame:
    """(i, j, n) of pairs among rows (i, band, h) that share a bucket and agree in n of their
    ``values``, a column of ``stored``, if n reaches the threshold."""
    sizes = rows.groupBy("band", "h").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"), F.count("*").alias("n")).where("n > 1").drop("n")
    own = rows.join(sizes, ["band", "h"]).withColumn("chunk", F.pmod(F.xxhash64("i"), F.col("chunks")).cast("int")).join(stored.select("i", values), "i")
    placed = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    group = ["band", "h", "lo", "hi"]
    placed = placed.select("band", "h", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"), "i", "chunk", values)
    return placed.repartition(*group).sortWithinPartitions(*group).mapInArrow(_compared(_least(threshold)), "i long, j long, n long").distinct()


def links(first: DataFrame, threshold: float = THRESHOLD, stored: DataFrame | None = None) -> DataFrame:
    """(i, j, similarity) of pairs i < j that share a band and reach the threshold.
    ``first`` has (i, bands), ``stored`` (i, signature) of these rows at least; without it,
    ``first`` has all. Signatures go to the buckets, as there may be far more pairs than rows."""
    rows, stored = _shared(first, first if stored is None else stored)
    near = _meeting(rows.select("i", "band", "h"), stored, "signature", threshold)
    return near.select("i", "j", (F.col("n") / F.lit(float(PERMUTATIONS))).alias("similarity")).where(F.col("similarity") >= threshold)


def removed(edges: DataFrame) -> DataFrame:
    """Ends j that the keep-first rule removes, from links (i, j) with i < j.

    Rounds: a node all of whose earlier neighbours are removed, or that has none, is
    kept; a node with a kept earlier neighbour is removed. Every round settles at
    least the first open node of each component, most settle at once.
    """
    edges = written(edges.select("i", "j").distinct())
    nodes = edges.select(F.col("i").alias("n")).union(edges.select("j")).distinct()
    state = written(nodes.withColumn("kept", F.lit(None).cast("boolean")))
    while True:
        to = edges.join(state.select(F.col("n").alias("i"), "kept"), "i").groupBy("j").agg(F.bool_or(F.coalesce("kept", F.lit(False))).alias("hit"), F.bool_or(F.col("kept").isNull()).alias("open"))
        verdict = F.when(F.col("hit"), False).when(~F.coalesce("open", F.lit(False)), True)
        state = written(state.join(to.withColumnRenamed("j", "n"), "n", "left").select("n", F.coalesce("kept", verdict).alias("kept")))
        if state.where("kept is null").isEmpty():
            return state.where("not kept").select(F.col("n").alias("ord"))


def removed_by_rounds(first: DataFrame, threshold: float = THRESHOLD, rounds: int = ROUNDS, stored: DataFrame | None = None) -> DataFrame:
    """(ord) that the keep-first rule removes, without all pairs of copies. ``first`` and
    ``stored`` are those of ``links``.

    In each of a few rounds, a row that is the earliest open one in all of its buckets is
    kept, as whatever could remove it is settled. It is compared with the open rows of
    its buckets and removes those that link; both leave. So m near copies of a row cost m
    comparisons, not m squared. What is still open links with no settled row; there the
    links are found in pairs of chunks, and the rule follows them (``removed``), whose
    rounds grow with chains of links, not with buckets.
    """
    open_, stored = _shared(first, first if stored is None else stored)
    gone = None
    for at in range(rounds):
        if at:
            rows = open_.select("i", "band", "h")
            open_ = written(rows.join(_several(rows), ["band", "h"]))
        if open_.isEmpty():
            break
        kept = open_.groupBy("i").agg(F.bool_and(F.col("i") == F.col("low")).alias("kept")).where("kept").select("i")
        lead = open_.join(kept, "i").select("i", "band", "h")
        pairs = lead.join(open_.select(F.col("i").alias("j"), "band", "h"), ["band", "h"]).where("i < j").select("i", "j").distinct()
        sketched = pairs.join(stored.select("i", F.col("sketch").alias("x")), "i").join(stored.select(F.col("i").alias("j"), F.col("sketch").alias("y")), "j")
        alike = sketched.select("i", "j", "x", "y").mapInArrow(_agreeing(_least(threshold)), "i long, j long")
        now = written(_near(alike, stored, threshold).select(F.col("j").alias("ord")).distinct())
        gone = now if gone is None else gone.union(now)
        open_ = open_.join(kept.union(now), "i", "left_anti")
    else:
        alike = _meeting(open_.select("i", "band", "h"), stored, "sketch", threshold).select("i", "j")
        edges = written(_near(alike, stored, threshold))
        if not edges.isEmpty():
            late = removed(edges)
            gone = late if gone is None else gone.union(late)
    return gone if gone is not None else first.select(F.col("i").alias("ord")).limit(0)


def deduplicated(samples: DataFrame, text, ord_col: str = "ord", threshold: float = THRESHOLD) -> DataFrame:
    """``samples`` without those that the rule removes; ``text`` is a column."""
    signed = written(signatures(samples.select(F.col(ord_col).alias("ord"), text.alias("text"))))
    first = written(heads(signed))
    stored = signed.select(F.col("ord").alias("i"), "signature")
    gone = removed_by_rounds(first, threshold, stored=stored).union(signed.join(first, signed.ord == first.i, "left_anti").select("ord"))
    return samples.join(gone.withColumnRenamed("ord", ord_col), ord_col, "left_anti")
