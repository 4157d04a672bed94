"""MinHash near-dedup by min-max hashing.

Every permutation gives two signature values, the minimum and the maximum of the
permuted shingle hashes, so a signature of 2K values costs K hash evaluations
per shingle. Both agree between two sets with probability J and are nearly
uncorrelated, so the share of agreeing values is an unbiased estimate of J.

Plan
1. One pass over the texts: shingle set, its size and 64-bit fingerprint, the
   band hashes and a 128-bit sketch of the signature. Written as a table.
2. Equal sets meet by fingerprint; only one of each set goes on.
3. In buckets of up to ``SMALL_BUCKET`` members every pair that the sketch and the
   sizes allow is verified on full sets, each pair once; links give components.
4. In larger buckets a leader out of the largest component so far is verified
   against the members outside it, in a few rounds: a group of m near copies costs
   m pairs a round, not m squared. Then the members still outside meet every member
   of their bucket in another component than their own, in a join whose condition
   is the similarity itself, so that only links come out and no bucket is cut short.
5. Components over all verified links.

Buckets are never capped. A set pair with similarity 0.75 is missed by all bands
with probability (1 - 0.75^5)^32 = 0.0002, one with 0.85 with 2e-8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, spread, written

SHINGLE_WORDS = 5
SIMILARITY_PERCENT = 75
PERMUTATIONS = 80
BAND_ROWS = 5
SKETCH_BITS = 128
#: Agreement of 1-bit values at J = 0.75 differs in 16 of 128 bits with standard deviation 3.7.
SKETCH_SLACK = 36
#: Buckets up to this size are compared in full; leader rounds in the larger ones.
SMALL_BUCKET, ROUNDS = 32, 2
WORDS_HELD = 400_000
WORDS_AT_ONCE = 120_000

_K = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    """64-bit hashes of words; forgets all when it is full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_HELD:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: str | None, held: dict, k: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's k-word shingles.

    Words are runs of anything but ASCII white space, A-Z lower-cased. Fewer than
    k words make one shingle of the whole sequence; no words, or null, make none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(held.__getitem__, words), np.uint64, len(words))
    n = max(1, len(w) - k + 1)
    h = np.full(n, len(w) if len(w) < k else k, np.uint64)
    for i in range(min(k, len(w))):
        h = h * _K + w[i : i + n]
    return np.unique(_mixed(h))


def permutations(n: int = PERMUTATIONS, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**64, n, np.uint64) | np.uint64(1), rng.integers(0, 2**64, n, np.uint64)


def min_max_signatures(sets: list[np.ndarray], n: int = PERMUTATIONS) -> np.ndarray:
    """One row of 2n values for each (non-empty) set: n minima, n maxima."""
    a, b = permutations(n)
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), 2 * n), np.uint64)
    for p in range(n):
        v = flat * a[p] + b[p]
        out[:, p] = np.minimum.reduceat(v, starts)
        out[:, n + p] = np.maximum.reduceat(v, starts)
    return out


def estimate(x: np.ndarray, y: np.ndarray) -> float:
    """Unbiased estimate of the Jaccard similarity from two signatures."""
    return float((x == y).mean())


def band_hashes(signatures: np.ndarray, rows: int = BAND_ROWS) -> np.ndarray:
    values = _mixed(signatures)
    bands = values.shape[1] // rows
    h = np.arange(1, bands + 1, dtype=np.uint64)[None, :] * _K + np.zeros((len(values), 1), np.uint64)
    for i in range(rows):
        # neighbouring values come from other permutations, minima and maxima apart
        h = _mixed(h * _K + values[:, i * bands : (i + 1) * bands])
    return h


def _sketches(signatures: np.ndarray) -> np.ndarray:
    """Two int64 with one bit of each of the first 128 mixed signature values."""
    bits = (_mixed(signatures[:, :SKETCH_BITS]) & np.uint64(1)).astype(np.uint8)
    return np.packbits(bits, axis=1).view(np.int64)


def _in_parts(texts: list) -> Iterator[list]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t or "") // 6
        if size >= WORDS_AT_ONCE:
            yield part
            part, size = [], 0
    if part:
        yield part


def text_hash(text_col: str = "text"):
    """64-bit hash of a row's whole text."""
    return F.xxhash64(F.col(text_col).cast("string"))


def sketch_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_hash, n_shingles, fp, bands, s1, s2) for each row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        held = _WordHashes()
        for batch in batches:
            ids, whole, at = batch.column(0), batch.column(2), 0
            for part in _in_parts(batch.column(1).to_pylist()):
                sets = [shingle_set(t, held) for t in part]
                full = [i for i, s in enumerate(sets) if len(s)]
                bands: list = [None] * len(part)
                s1, s2, fp = ([None] * len(part) for _ in range(3))
                if full:
                    signatures = min_max_signatures([sets[i] for i in full])
                    hashes, sketches = band_hashes(signatures).view(np.int64), _sketches(signatures)
                    for j, i in enumerate(full):
                        bands[i] = hashes[j]
                        s1[i], s2[i] = map(int, sketches[j])
                        fp[i] = xxhash.xxh3_64_intdigest(sets[i].tobytes()) - 2**63
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, len(part)), whole.slice(at, len(part)), pa.array(map(len, sets), pa.int64()), pa.array(fp, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(s1, pa.int64()), pa.array(s2, pa.int64())],
                    ["doc_id", "text_hash", "n_shingles", "fp", "bands", "s1", "s2"],
                )
                at += len(part)

    return spread(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), text_hash(text_col).alias("text_hash"))).mapInArrow(
        run, f"doc_id {kind}, text_hash long, n_shingles long, fp long, bands array<long>, s1 long, s2 long"
    )


def _set_table(docs: DataFrame) -> DataFrame:
    """(fp, shingles) for rows (doc_id, text)."""

    def run(batches):
        held = _WordHashes()
        for batch in batches:
            for part in _in_parts(batch.column(0).to_pylist()):
                sets = [s for t in part if len(s := shingle_set(t, held))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([xxhash.xxh3_64_intdigest(s.tobytes()) - 2**63 for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))],
                    ["fp", "shingles"],
                )

    return spread(docs.select("text")).mapInArrow(run, "fp long, shingles array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets reach the similarity."""
    left = sets.select(F.col("fp").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("fp").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return (
        pairs.join(left, "a")
        .join(right, "b")
        .select("a", "b", both.alias("n_both"), (F.size("sa") + F.size("sb") - both).alias("n_any"))
        .where(100 * F.col("n_both") >= percent * F.col("n_any"))
        .select("a", "b")
    )


def _near(x: str, y: str, percent: int):
    """What pairs over the similarity fulfil but for a chance of 1e-7."""
    differ = F.bit_count(F.col(f"{x}.s1").bitwiseXOR(F.col(f"{y}.s1"))) + F.bit_count(F.col(f"{x}.s2").bitwiseXOR(F.col(f"{y}.s2")))
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    return (differ <= SKETCH_SLACK) & (100 * F.least(n, m) >= percent * F.greatest(n, m))


def _joined(found: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components of those found so far and further links."""
    links = written(links)
    if found is None:
        return connected_components(links)
    return found if links.isEmpty() else connected_components(found.where("id <> component").toDF("a", "b").union(links))


def _placed(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Bucket rows with their component so far, c."""
    to = found.select(F.col("id").alias("_id"), "component")
    return rows.join(to, F.col("r.fp") == F.col("_id"), "left").select("band", "r", F.coalesce("component", "r.fp").alias("c"))


def _tops(placed: DataFrame, turn: int) -> DataFrame:
    """(band, tc, l): the largest component of each bucket that holds several, and
    one member of it, another each turn."""
    parts = placed.groupBy("band", "c").agg(F.count("*").alias("n"), F.min_by("r", F.xxhash64("r.fp", F.lit(turn))).alias("l"))
    tops = parts.groupBy("band").agg(F.max(F.struct("n", "c", "l")).alias("t"), F.count("*").alias("parts")).where("parts > 1")
    return tops.select("band", F.col("t.c").alias("tc"), F.col("t.l").alias("l"))


def _nodes(docs: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """(doc_id, text_hash, n_shingles, c) for each row; c is its component, null without shingles."""
    table = written(sketch_table(docs, id_col, text_col))
    reps = table.where("fp is not null").groupBy("fp").agg(
        F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("s1").alias("s1"), F.first("s2").alias("s2"), F.first("bands").alias("bands")
    )
    rows = reps.select("fp", F.struct("fp", "n", "s1", "s2").alias("r"), F.explode("bands").alias("band"))
    full = rows.groupBy("band").agg(F.count("*").alias("members")).where("members > 1")
    shared = written(rows.join(full, "band").select("band", "r", "members"))
    ids = shared.select(F.col("r.fp").alias("fp")).distinct()
    wanted = table.where("fp is not null").groupBy("fp").agg(F.min("doc_id").alias("doc_id")).join(ids, "fp", "left_semi").select("doc_id").distinct()
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sets = written(_set_table(source.join(wanted, source.doc_id.eqNullSafe(wanted.doc_id), "left_semi")).dropDuplicates(["fp"]))

    x, y = shared.where(F.col("members") <= SMALL_BUCKET).alias("x"), shared.where(F.col("members") <= SMALL_BUCKET).alias("y")
    pairs = x.join(y, (F.col("x.band") == F.col("y.band")) & (F.col("x.r.fp") < F.col("y.r.fp")) & _near("x.r", "y.r", percent))
    found = _joined(None, _verified(pairs.select(F.col("x.r.fp").alias("a"), F.col("y.r.fp").alias("b")).distinct(), sets, percent))

    large = written(shared.where(F.col("members") > SMALL_BUCKET).select("band", "r"))
    if not large.isEmpty():
        for turn in range(ROUNDS):
            placed = written(_placed(large, found))
            outside = placed.join(written(_tops(placed, turn)), "band").where("c <> tc").where(_near("r", "l", percent))
            pairs = outside.select(F.least("l.fp", "r.fp").alias("a"), F.greatest("l.fp", "r.fp").alias("b")).distinct()
            found = _joined(found, _verified(pairs, sets, percent))
        placed = written(_placed(large, found))
        placed = placed.join(written(_tops(placed, ROUNDS).select("band", "tc")), "band")
        placed = written(placed.join(sets.select(F.col("fp").alias("_fp"), "shingles"), F.col("r.fp") == F.col("_fp")).select("band", "r", "c", "tc", "shingles"))
        both = F.size(F.array_intersect("o.shingles", "m.shingles"))
        rest = placed.where("c <> tc").alias("o").join(
            placed.alias("m"),
            (F.col("o.band") == F.col("m.band")) & (F.col("o.c") != F.col("m.c")) & ((F.col("m.c") == F.col("m.tc")) | (F.col("o.r.fp") < F.col("m.r.fp")))
            & _near("o.r", "m.r", percent) & ((100 + percent) * both >= percent * (F.col("o.r.n") + F.col("m.r.n"))),
        )
        found = _joined(found, rest.select(F.col("o.r.fp").alias("a"), F.col("m.r.fp").alias("b")).distinct())
    # an fp that many rows share is split by Spark, as the other side is a written table
    to = written(found.select(F.col("id").alias("fp"), "component"))
    rows = written(table.select("doc_id", "text_hash", "n_shingles", "fp").join(to, "fp", "left"))
    return rows.select("doc_id", "text_hash", "n_shingles", F.coalesce("component", "fp").alias("c"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = SIMILARITY_PERCENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Documents link when 100 * |A & B| >= percent * |A | B| on their shingle sets.
    component_id is the smallest id reachable by links. Null or empty texts have
    no shingles and link with nothing. Rows that repeat an id are nodes of their
    own; they share a component if their sets are equal or link. A row without id
    may link others, and takes part in no minimum; where a component has no id at
    all, component_id is null and kept is true. Other columns are not read.
    """
    nodes = _nodes(docs, id_col, text_col, percent)
    # written before the join: see connected_components
    first_id = nodes.where("c is not null").groupBy("c").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("m"))
    first_id = written(first_id.where("m > 1").select("c", "first_id"))
    return nodes.join(first_id.withColumn("several", F.lit(True)), "c", "left").select(
        "doc_id", "n_shingles", F.when(F.col("several"), F.col("first_id")).otherwise(F.col("doc_id")).alias("component_id")
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = SIMILARITY_PERCENT) -> DataFrame:
    """(doc_id, text_hash, n, stays): for each distinct id and text of ``docs`` its
    number of rows and whether it is the one that stands for its component.

    That is the smallest id's, and of texts that share that id the one of the least
    hash; a text without id stands for components only that have no id at all.
    Texts without shingles stand for themselves.
    """
    keys = written(_nodes(docs, id_col, text_col, percent).groupBy("doc_id", "text_hash").agg(F.first("c").alias("c"), F.count("*").alias("n")))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    best = written(keys.where("c is not null").groupBy("c").agg(F.min(order).alias("best"), F.count("*").alias("m")).where("m > 1").select("c", "best"))
    stays = F.col("best").isNull() | (F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_hash") == F.col("best.text_hash")))
    return keys.join(best, "c", "left").select("doc_id", "text_hash", "n", stays.alias("stays"))
