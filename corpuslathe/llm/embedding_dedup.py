"""Embedding near-dedup on a robust-pruned flat graph.

1. Equal vectors of a label are one node with a count and a sketch: on which side of
   ``BITS`` random planes it lies. Until step 3 only sketches travel, not vectors.
2. Nodes of a label whose sketches agree in some of their bits are compared by all of
   them, as often as it takes to miss a pair at the link distance with chance ``MISS`` at
   most. What is near makes groups; a node without a group links with nothing. Groups of
   a label are put together to shards, whole; each shard is a task that builds a graph
   (3) of its vectors and searches it (4).
   A group that is too large for a task is dealt to clusters that overlap: a node goes to every
   centre whose bisector with its nearest centre is within half the link distance.
   Two vectors within the link distance then share a shard for certain (the
   nearest centre of their midpoint has both). Centres are fitted on at most
   ``FIT_ROWS`` nodes; all nodes are dealt. Shards that are still too large for a
   task are dealt again in the same way, by centres fitted on ``FIT_SHARD`` of their
   own nodes. What no centre divides (one dense cluster) is cut into chunks, and
   each pair of chunks is a task, so that a task is bounded and no pair lost.
3. A task's graph: its nodes are dealt to overlapping sub-clusters, which
   propose near candidates; robust pruning picks neighbours of these, and of random
   ones for long edges, with reverse edges. The adjacency lists of all sub-clusters
   (and of all tasks of a group that is too large for one) are united by node.
4. Each task searches the graph for every node of its own: greedy search
   from the medoids of the node's nearest sub-clusters, then expansion along all nodes within
   the link similarity less ``SLACK``. Links are verified in double precision on the
   original vectors.
5. A link counts in one task only, that of the first shard (and chunks) which both
   nodes share, so a task gives each node's number of links and its component
   within the task: as many rows as it has nodes, however many links there are.
6. ``audit`` measures recall against brute force.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ann import usable
from .common import connected_components, written

COSINE = 0.98
FIT_ROWS = 16_384
FIT_SHARD = 4096
#: Rows that a task holds. A label that fits is one shard; others are split into shards of about SHARD_ROWS, which leaves room for the overlap.
CHUNK = 8192
SHARD_ROWS = 4096
MOST_CENTRES = 256
#: Nodes of a sub-cluster inside a task, and how many sub-clusters a node is in.
SUB_ROWS, SUBS = 256, 3
NEAR, FAR, DEGREE, LONG = 64, 24, 24, 8
ALPHA = 1.2
BEAM, STARTS = 12, 3
SLACK = 0.03
#: Pairs of nodes looked at in one step of a search.
AT_ONCE = 1 << 20
#: Bits of a sketch, the chance that a pair at the link distance is missed by them, and that its sketches differ in more bits than allowed.
BITS, MISS, APART = 256, 1e-6, 1e-8
WORDS = [f"b{k}" for k in range(BITS // 64)]
#: Sketches that a task holds; a larger label is dealt by some bits, several times. Each deal is searched by so many tables.
SKETCHES = 1 << 18
DEAL_TABLES, TABLE_BITS, DEAL_BITS = 16, 16, 12
#: Sketches that agree in all bits of a table and are so many are one group without comparison.
LONG_RUN = 4096
#: Nodes with groups that are broadcast.
FEW = 200_000
FOUND = "node long, root long, others long"
#: Links of a lower cosine are not sought by sketches, which would take too many tables.
LEAST_SKETCHED = 0.9


def centres(x: np.ndarray, k: int, seed: int = 1, turns: int = 8) -> np.ndarray:
    """k-means centres of unit vectors."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(turns):
        near = (x @ c.T - 0.5 * (c**2).sum(1)).argmax(1)
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def overlapping(x: np.ndarray, c: np.ndarray, cosine: float = COSINE) -> np.ndarray:
    """Which unit vectors (rows) go to which centres (columns)."""
    half = np.sqrt(2 - 2 * cosine) / 2 + 1e-6
    d = (c**2).sum(1) - 2 * x @ c.T
    first = d.argmin(1)
    apart = np.sqrt(np.maximum(((c[:, None] - c[None]) ** 2).sum(2), 0))
    return d - d[np.arange(len(x)), first][:, None] <= 2 * half * apart[first] + 1e-9


def sub_clusters(x: np.ndarray, seed: int = 1) -> tuple[list[np.ndarray], np.ndarray]:
    """Overlapping groups of rows of unit vectors x, and each row's nearest groups."""
    n = len(x)
    k = max(1, n // SUB_ROWS)
    if k == 1:
        return [np.arange(n)], np.zeros((n, 1), np.int64)
    rng = np.random.default_rng(seed)
    c = centres(x[rng.choice(n, min(n, 16 * k), replace=False)], k, seed, 4)
    near = np.argsort(-(x @ c.T - 0.5 * (c**2).sum(1)), 1, kind="stable")[:, : min(SUBS, k)]
    rows, order = np.repeat(np.arange(n), near.shape[1]), np.argsort(near.ravel(), kind="stable")
    return np.split(rows[order], np.searchsorted(near.ravel()[order], np.arange(1, k))), near


def robust_graph(x: np.ndarray, seed: int = 1) -> list[np.ndarray]:
    """Neighbours of each unit vector: robust-pruned near candidates out of its
    sub-clusters, far ones at random, and reverse edges."""
    n = len(x)
    if n < 2:
        return [np.empty(0, np.int64)] * n
    rng = np.random.default_rng(seed)
    x = x.astype(np.float32)

    def pruned(rows: np.ndarray, cand: np.ndarray, degree: int) -> np.ndarray:
        own = np.einsum("nd,nkd->nk", x[rows], x[cand])
        order = np.argsort(-own, 1, kind="stable")
        cand, own = np.take_along_axis(cand, order, 1), np.take_along_axis(own, order, 1)
        far = np.sqrt(np.maximum(2 - 2 * own, 0))
        alive = cand != rows[:, None]
        out = np.full((len(rows), degree), -1)
        at = np.arange(len(rows))
        for e in range(degree):
            pick = alive.argmax(1)
            some = alive[at, pick]
            if not some.any():
                break
            star = cand[at, pick]
            out[some, e] = star[some]
            between = np.sqrt(np.maximum(2 - 2 * np.einsum("nd,nkd->nk", x[star], x[cand]), 0))
            alive &= (ALPHA * between > far) & (cand != star[:, None])
        return out

    def found(rows: np.ndarray, picked: np.ndarray) -> np.ndarray:
        a, b = np.repeat(rows, picked.shape[1]), picked.ravel()
        return a[b >= 0] * n + b[b >= 0]

    keys = []
    for group in sub_clusters(x, seed)[0]:  # the lists of all sub-clusters are united
        near = min(NEAR, len(group) - 1)
        for at in range(0, len(group) if near > 0 else 0, 256):
            rows = group[at : at + 256]
            s = x[rows] @ x[group].T
            s[np.arange(len(rows)), np.arange(at, at + len(rows))] = -2
            keys.append(found(rows, pruned(rows, group[np.argpartition(-s, near - 1, 1)[:, :near]], DEGREE)))
    for at in range(0, n, 256):
        rows = np.arange(at, min(n, at + 256))
        keys.append(found(rows, pruned(rows, rng.integers(0, n, (len(rows), min(FAR, n))), LONG)))
    keys = np.unique(np.concatenate(keys))
    both = np.unique(np.concatenate([keys, keys % n * n + keys // n]))
    return np.split(both % n, np.searchsorted(both // n, np.arange(1, n)))


def range_search(x: np.ndarray, norms: np.ndarray, edges: list[np.ndarray], cosine: float = COSINE):
    """Yields arrays of pairs (i, j), i < j, of rows of x that the graph finds to
    reach the cosine, each pair once."""
    n = len(x)
    unit = (x / norms[:, None]).astype(np.float32)
    size = np.array([len(e) for e in edges])
    flat = np.concatenate([*edges, np.empty(0, np.int64)]).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(size)])
    most = int(min(max(size.max(initial=0), 1), 48))
    pad = np.full((n, most), -1)
    for i, e in enumerate(edges):  # the nearest first
        near = e if len(e) <= most else e[np.argsort(-(unit[e] @ unit[i]), kind="stable")[:most]]
        pad[i, : len(near)] = near
    groups, nearest = sub_clusters(unit)
    medoids = np.array([g[(unit[g] @ unit[g].sum(0)).argmax()] if len(g) else 0 for g in groups])

    def cosines(a: np.ndarray, b: np.ndarray, of: np.ndarray) -> np.ndarray:
        return np.concatenate([np.einsum("ij,ij->i", of[a[i : i + 65536]], of[b[i : i + 65536]]) for i in range(0, max(len(a), 1), 65536)])

    at = 0
    while at < n:
        q = np.arange(at, min(n, at + max(1, min(512, (1 << 23) // n))))
        at += len(q)
        m = len(q)
        rows = np.arange(m)
        first = medoids[nearest[q, :STARTS]]
        seen = np.zeros((m, n), bool)
        seen[rows[:, None], first] = True
        ids = np.full((m, BEAM), -1)
        sims = np.full((m, BEAM), -np.inf, np.float32)
        done = np.ones((m, BEAM), bool)
        k = first.shape[1]
        ids[:, :k], sims[:, :k], done[:, :k] = first, np.einsum("nd,nkd->nk", unit[q], unit[first]), False
        while not done.all():
            open_ = np.where(done, -np.inf, sims)
            best = open_.argmax(1)
            live = ~done[rows, best]
            done[rows, best] = True
            cand = np.where(live[:, None], pad[ids[rows, best]], -1)
            new = (cand >= 0) & ~seen[rows[:, None], cand]
            seen[rows[:, None], np.where(new, cand, first[:, :1])] = True
            own = np.where(new, np.einsum("nd,nkd->nk", unit[q], unit[cand]), -np.inf)
            ids, sims = np.concatenate([ids, cand], 1), np.concatenate([sims, own], 1)
            done = np.concatenate([done, ~new], 1)
            top = np.argpartition(-sims, BEAM - 1, 1)[:, :BEAM]
            ids, sims, done = (np.take_along_axis(v, top, 1) for v in (ids, sims, done))
        within = np.zeros((m, n), bool)
        within[rows, q] = True
        r, c = np.nonzero(sims >= cosine - SLACK)
        within[r, ids[r, c]] = True
        seen = within.copy()
        r, c = np.nonzero(within)
        while len(r):  # neighbours of all that is near enough
            part = max(1, AT_ONCE // max(int(size[c].mean()), 1))
            r, rest_r, c, rest_c = r[:part], r[part:], c[:part], c[part:]
            reps = size[c]
            new_r = np.repeat(r, reps)
            new_c = flat[np.repeat(starts[c] - np.concatenate([[0], np.cumsum(reps)[:-1]]), reps) + np.arange(reps.sum())]
            fresh = ~seen[new_r, new_c]
            key = np.unique(new_r[fresh] * n + new_c[fresh])
            r, c = key // n, key % n
            seen[r, c] = True
            near = cosines(q[r], c, unit) >= cosine - SLACK
            r, c = r[near], c[near]
            within[r, c] = True
            r, c = np.concatenate([r, rest_r]), np.concatenate([c, rest_c])
        r, c = np.nonzero(within & (np.arange(n) > q[:, None]))
        for i in range(0, len(r), AT_ONCE):
            a, b = q[r[i : i + AT_ONCE]], c[i : i + AT_ONCE]
            fine = cosines(a, b, x) / (norms[a] * norms[b]) >= cosine
            yield a[fine], b[fine]


def _deal(nodes: DataFrame, fitted, cosine: float, level: str) -> DataFrame:
    """``nodes`` once for each centre of their ``key`` that they go to, numbered in
    column ``level``, with all of a node's numbers in ``level``s. Nodes of other
    length, or of a key without centres, go to a place of their length."""
    shared = nodes.sparkSession.sparkContext.broadcast(fitted)
    names = [c for c in nodes.columns if c not in ("key", "v")]

    def run(batches):
        for batch in batches:
            keys = np.array(batch.column(0).to_pylist(), object)
            vectors = batch.column(1).to_numpy(zero_copy_only=False)
            row, place, places = [], [], []
            for key in dict.fromkeys(keys):
                own, c = np.flatnonzero(keys == key), shared.value.get(key)
                fits = np.array([c is not None and len(vectors[i]) == c.shape[1] for i in own])
                for i in own[~fits].tolist():
                    row.append(i), place.append(-len(vectors[i])), places.append([-len(vectors[i])])
                if fits.any():
                    own = own[fits]
                    x = np.stack([vectors[i] for i in own]).astype(np.float64)
                    goes = overlapping(x / np.linalg.norm(x, axis=1)[:, None], c, cosine)
                    for i, to in zip(own.tolist(), goes, strict=True):
                        to = np.flatnonzero(to).tolist()
                        row += [i] * len(to)
                        place += to
                        places += [to] * len(to)
            at = pa.array(row, pa.int64())
            columns = [batch.column(k).take(at) for k in range(1, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(place, pa.int32()), pa.array(places, pa.list_(pa.int32()))], ["v", *names, level, f"{level}s"])

    into = nodes.select("key", "v", *names)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in into.schema.fields[1:])
    return into.mapInArrow(run, f"{schema}, {level} int, {level}s array<int>")


def _fit(x: list, rows: float) -> np.ndarray | None:
    """Centres for about so many rows, from some of them; None if they fit one task."""
    sizes = [len(a) for a in x]
    dim = max(sorted(set(sizes)), key=sizes.count)
    x = np.array([a for a in x if len(a) == dim], np.float64)
    k = min(MOST_CENTRES, len(x) // 8, round(rows / SHARD_ROWS))
    return centres(x / np.linalg.norm(x, axis=1)[:, None], k) if rows > CHUNK and k > 1 else None


def _tasks(nodes: DataFrame, cosine: float) -> DataFrame:
    """(shard, i, j, c, s, t, ss, ts, node, v): the nodes of each task, with their
    place at both levels, all their places, and their chunk."""
    n = nodes.count()
    sample = nodes.select("label", "v").orderBy(F.col("node")).limit(FIT_ROWS).collect()  # at most FIT_ROWS
    by_label: dict = {}
    for r in sample:
        by_label.setdefault(r.label, []).append(r.v)
    fitted = {k: c for k, v in by_label.items() if (c := _fit(v, len(v) / len(sample) * n)) is not None}
    shard = F.xxhash64("label", "s").alias("key")
    dealt = written(_deal(nodes.select(F.col("label").alias("key"), "label", "node", "v"), fitted, cosine, "s").select(shard, "node", "v", "s", "ss"))
    large = written(dealt.groupBy("key").agg(F.count("*").alias("rows")).where(F.col("rows") > CHUNK))
    # the second level: as many shards as nodes / CHUNK; each fits its centres in a task
    picked = F.pmod(F.xxhash64("node", F.lit(11)), F.col("rows")) < FIT_SHARD
    some = dealt.join(F.broadcast(large) if large.count() < 100_000 else large, "key").where(picked)

    def centre(block: pd.DataFrame) -> pd.DataFrame:
        c = _fit(list(block.v), float(block["rows"].iloc[0]))
        return pd.DataFrame({"key": [] if c is None else [block.key.iloc[0]], "c": [] if c is None else [c.tobytes()], "k": [] if c is None else [len(c)]})

    second = written(some.groupBy("key").applyInPandas(centre, "key long, c binary, k int"))
    kept = second.count()
    if 0 < kept * MOST_CENTRES <= 1 << 18:  # centres that a task can hold
        held = {r.key: np.frombuffer(r.c).reshape(r.k, -1) for r in second.collect()}
        again = dealt.join(F.broadcast(second.select("key")), "key", "left_semi").withColumn("shard", F.col("key"))
        rest = dealt.join(F.broadcast(second.select("key")), "key", "left_anti").select(F.col("key").alias("shard"), "node", "v", "s", "ss", F.lit(0).alias("t"), F.array(F.lit(0)).alias("ts"))
        dealt = _deal(again, held, cosine, "t").select("shard", "node", "v", "s", "ss", "t", "ts").unionByName(rest)
        dealt = written(dealt.withColumn("shard", F.xxhash64("shard", "t")))
    else:
        dealt = dealt.select(F.col("key").alias("shard"), "node", "v", "s", "ss", F.lit(0).alias("t"), F.array(F.lit(0)).alias("ts"))
    sizes = written(dealt.groupBy("shard").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks")))
    own = F.pmod(F.xxhash64("node", F.lit(7)), F.col("chunks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda o: F.struct(F.least("c", o).alias("i"), F.greatest("c", o).alias("j")))
    return dealt.join(sizes, "shard").withColumn("c", own).select("shard", "node", "v", "s", "ss", "t", "ts", "c", F.explode(pairs).alias("p")).select(
        "shard", "p.i", "p.j", "c", "s", "t", "ss", "ts", "node", "v"
    )


class _First:
    """Which pairs of a task's rows count there: those with no earlier shard in common."""

    def __init__(self, block: pd.DataFrame):
        self.c, self.i, self.j = block.c.to_numpy(), block.i.iloc[0], block.j.iloc[0]
        # places before the task's own, as sets of bits
        self.before = [self.bits(block[f"{k}s"], block[k].iloc[0]) for k in "st"]

    @staticmethod
    def bits(places, own: int) -> np.ndarray:
        out = np.zeros((len(places), MOST_CENTRES // 64), np.uint64)
        for r, some in enumerate(places):
            for p in some:
                if 0 <= p < own:
                    out[r, p // 64] |= np.uint64(1 << p % 64)
        return out

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        fine = (np.minimum(self.c[a], self.c[b]) == self.i) & (np.maximum(self.c[a], self.c[b]) == self.j)
        for bits in self.before:
            fine &= ~(bits[a] & bits[b]).any(1)
        return fine


@functools.cache
def _differing(cosine: float, bits: int = BITS) -> np.ndarray:
    """Chances that so many bits of a pair of this cosine differ in 0, 1, ... places."""
    q, h = math.acos(min(cosine, 1 - 1e-12)) / math.pi, np.arange(bits + 1)
    ways = np.array([math.lgamma(bits + 1) - math.lgamma(k + 1) - math.lgamma(bits - k + 1) for k in h])
    return np.exp(ways + h * math.log(q) + (bits - h) * math.log(1 - q))


@functools.cache
def _agree(bits: int) -> np.ndarray:
    """Chances that so many picked bits have none of 0, 1, ... differing ones."""
    ways = lambda n: math.lgamma(n + 1) - math.lgamma(n - bits + 1)
    return np.array([math.exp(ways(BITS - h) - ways(BITS)) if BITS - h >= bits else 0.0 for h in range(BITS + 1)])


@functools.cache
def allowed(cosine: float, bits: int = BITS) -> int:
    """In how many places so many bits of a link may differ."""
    return int(np.flatnonzero(_differing(cosine, bits)[::-1].cumsum()[::-1] > APART)[-1])


@functools.cache
def tables(cosine: float, bits: int) -> int:
    """How many tables of so many bits miss a link with chance ``MISS`` at most."""
    n = 1
    while _differing(cosine) @ (1 - _agree(bits)) ** n > MISS:
        n += 1
    return n


@functools.cache
def deals(cosine: float, bits: int) -> int:
    """How many deals by so many bits, each searched by ``DEAL_TABLES`` tables, miss a
    link with chance ``MISS`` at most."""
    n, found = 1, _agree(bits) * (1 - (1 - _agree(TABLE_BITS)) ** DEAL_TABLES)
    while _differing(cosine) @ (1 - found) ** n > MISS:
        n += 1
    return n


def sketches(x: np.ndarray) -> np.ndarray:
    """On which sides of random planes the rows of x lie, as words of 64 bits."""
    planes = np.random.default_rng(x.shape[1]).standard_normal((x.shape[1], BITS), np.float32)
    sides = (x / np.abs(x).max(1, keepdims=True)).astype(np.float32) @ planes > 0
    return np.packbits(sides, axis=1).view(np.int64)


def picked(words: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Some bits of sketches as one number."""
    code = np.zeros(len(words), np.int64)
    for bit in bits.tolist():
        code = code << 1 | words[:, bit // 64] >> bit % 64 & 1
    return code


def forest(spaces: np.ndarray, words: np.ndarray, n_tables: int, cosine: float = COSINE, seed: int = 1) -> np.ndarray:
    """For each sketch the first one of its group: sketches of a space that agree in all
    bits of a table and differ in ``allowed`` places at most are of one group. So many
    tables, or as many as ``MISS`` takes if 0."""
    n, most, most_of_word = len(spaces), allowed(cosine), allowed(cosine, 64)
    root, place = np.arange(n), np.unique(spaces, return_inverse=True)[1].astype(np.int64)
    bits = int(np.clip(math.log2(max(np.bincount(place).max(), 1)) - 2, 2, TABLE_BITS))
    rng, room = np.random.default_rng(seed), n.bit_length()
    sides = words.view(np.uint64)  # bits of signed words would be counted without sign
    word = sides[:, 0].copy()
    for _ in range(n_tables or tables(cosine, bits)):
        code = np.sort((place << bits | picked(words, rng.choice(BITS, bits, replace=False))) << room | np.arange(n))
        order, code = code & (1 << room) - 1, code >> room
        starts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        length = np.diff(np.append(starts, n))
        run, end = np.repeat(np.arange(len(starts)), length), np.repeat(starts + length, length)
        for at in np.flatnonzero(length > LONG_RUN).tolist():
            own = order[starts[at] : starts[at] + length[at]]
            root = _united(root, own[1:], own[:-1])
        w, step, look = word[order], 1, 2
        live = np.flatnonzero((np.arange(n) + 1 < end) & (length[run] <= LONG_RUN))
        while len(live):  # each with the one that stands so many steps behind it
            pair = live[np.bitwise_count(w[live] ^ w[live + step]) <= most_of_word]  # few that are not near
            a, b = order[pair], order[pair + step]
            apart = root[a] != root[b]
            a, b = a[apart], b[apart]
            near = np.bitwise_count(sides[a] ^ sides[b]).sum(1, dtype=np.int64) <= most
            if near.any():
                root = _united(root, a[near], b[near])
            step += 1
            live = live[live + step < end[live]]
            if step == look and len(live):  # what is one group already is done
                look *= 2
                at = root[order]
                one = np.minimum.reduceat(at, starts) == np.maximum.reduceat(at, starts)
                live = live[~one[run[live]]]
    return root


def _sketched(rows: DataFrame) -> DataFrame:
    """``rows`` with sketches instead of vectors."""
    names = [c for c in rows.columns if c != "v"]

    def run(batches):
        for batch in batches:
            v, words = batch.column(0), np.zeros((batch.num_rows, len(WORDS)), np.int64)
            size, flat = pc.list_value_length(v).to_numpy(), v.flatten().to_numpy()
            starts = np.cumsum(size) - size
            for dim in np.unique(size).tolist():
                own = np.flatnonzero(size == dim)
                part = max(1, (1 << 21) // dim)
                for some in (own[i : i + part] for i in range(0, len(own), part)):
                    words[some] = sketches(flat[starts[some][:, None] + np.arange(dim)].astype(np.float64))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *(pa.array(w) for w in words.T.copy())], [*names, *WORDS])

    into = rows.select("v", *names)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in into.schema.fields[1:])
    return into.mapInArrow(run, f"{schema}, " + ", ".join(f"{w} long" for w in WORDS))


def _near(nodes: DataFrame, cosine: float) -> DataFrame:
    """(node, root) of a forest of the groups of ``nodes`` (node, space, sketch)."""
    spark = nodes.sparkSession
    sizes = written(nodes.groupBy("space").count())
    total = sizes.agg(F.sum("count")).first()[0] or 0
    alone = {r.space: r["count"] for r in sizes.where(F.col("count") > min(CHUNK, SKETCHES)).collect()}  # few, as each has many nodes
    shared = max(1, round(total / SKETCHES * 2), min(64, total // 1024))  # tasks of the other spaces
    bits = {k: math.ceil(math.log2(n / SKETCHES)) for k, n in alone.items() if n > SKETCHES}

    def dealt(chunks: dict, only: bool = False):
        """A function that deals sketches to tasks; only: those of spaces in ``bits``, by themselves."""
        held = spark.sparkContext.broadcast((dict(bits), alone, chunks))

        def run(batches):
            bits, alone, chunks = held.value
            for batch in batches:
                space, node = (batch.column(k).to_numpy() for k in (0, 1))
                words = np.stack([batch.column(2 + k).to_numpy() for k in range(len(WORDS))], 1)
                kept = []  # row, bucket, chunks i and j, tables
                for key in np.unique(space).tolist() if bits else ():
                    if key not in bits:
                        continue
                    own = np.flatnonzero(space == key)
                    rng = np.random.default_rng(abs(key))
                    for deal in range(deals(cosine, bits[key])):
                        code = picked(words[own], rng.choice(BITS, bits[key], replace=False))
                        bucket = (key & ~0xFFFFFF) + (deal << DEAL_BITS) + code
                        parts = np.array([chunks.get(b, 1) for b in bucket.tolist()]) if chunks else np.ones(len(own), np.int64)
                        c = (node[own].astype(np.uint64) % parts.astype(np.uint64)).astype(np.int64)
                        row = np.repeat(np.arange(len(own)), parts)
                        other = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
                        kept.append((own[row], bucket[row], np.minimum(c[row], other), np.maximum(c[row], other), np.full(len(row), DEAL_TABLES)))
                if not only:
                    own = np.flatnonzero(~np.isin(space, np.array([*bits], np.int64)))
                    by_itself = np.isin(space[own], np.array([*alone], np.int64))
                    kept.append((own, np.where(by_itself, space[own], space[own] % shared), *np.zeros((3, len(own)), np.int64)))
                if kept:
                    row, *places = (np.concatenate(x) for x in zip(*kept, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int64)) for p in (*places, space[row], node[row], *words[row].T)], ["bucket", "i", "j", "tables", "space", "node", *WORDS])

        return nodes.select("space", "node", *WORDS).mapInArrow(run, "bucket long, i long, j long, tables long, space long, node long, " + ", ".join(f"{w} long" for w in WORDS))

    chunks: dict = {}
    while bits:  # more bits where some leave too many together
        large = dealt({}, only=True).groupBy("space", "bucket").count().where(F.col("count") > 2 * SKETCHES).collect()  # few, as each has many sketches
        most_of = {}
        for r in large:
            most_of[r.space] = max(r["count"], most_of.get(r.space, 0))
        more = {k: min(DEAL_BITS, bits[k] + math.ceil(math.log2(n / SKETCHES))) for k, n in most_of.items() if bits[k] < DEAL_BITS}
        if not more:
            chunks = {r.bucket: -(-r["count"] // SKETCHES) for r in large}
            break
        bits |= more

    def find(block: pd.DataFrame) -> pd.DataFrame:
        node = block.node.to_numpy()
        root = forest(block.space.to_numpy(), np.ascontiguousarray(block[WORDS].to_numpy()), int(block.tables.iloc[0]), cosine, abs(int(block.bucket.iloc[0])))
        some = root != np.arange(len(root))
        return pd.DataFrame({"node": node[some], "root": node[root[some]]})

    return dealt(chunks).groupBy("bucket", "i", "j", "tables").applyInPandas(find, "node long, root long")


def _united(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Components after further links: for each row the least row of its own."""
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            return root
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]


def _links(x: np.ndarray, n: np.ndarray, edges: list[np.ndarray], cosine: float, first=None) -> tuple[np.ndarray, np.ndarray]:
    """For each node its component and the rows (sums of n) that it links with."""
    others, root = np.zeros(len(x), np.int64), np.arange(len(x))
    for a, b in range_search(x, np.linalg.norm(x, axis=1), edges, cosine):
        if first:
            counts = first(a, b)
            a, b = a[counts], b[counts]
        others += np.bincount(a, n[b], len(x)).astype(np.int64) + np.bincount(b, n[a], len(x)).astype(np.int64)
        root = _united(root, a, b)
    return root, others


def _linked_large(nodes: DataFrame, cosine: float) -> DataFrame:
    """``linked`` for groups that no task holds."""
    tasks = written(_tasks(nodes, cosine))

    def build(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("node", ignore_index=True)
        x = np.stack(block.v.to_numpy()).astype(np.float64)
        ids = block.node.to_numpy()
        edges = robust_graph(x / np.linalg.norm(x, axis=1)[:, None])
        return pd.DataFrame({"node": ids, "near": [ids[e] for e in edges]})

    graph = tasks.select("shard", "i", "j", "node", "v").groupBy("shard", "i", "j").applyInPandas(build, "node long, near array<long>")
    graph = graph.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    graph = written(graph.join(nodes.select("node", "n"), "node"))

    def find(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("node", ignore_index=True)
        x, ids, n = np.stack(block.v.to_numpy()).astype(np.float64), block.node.to_numpy(), block.n.to_numpy()
        edges = []
        for near in block.near:
            near = np.asarray(near)
            at = np.minimum(np.searchsorted(ids, near), len(ids) - 1)
            edges.append(at[ids[at] == near])
        root, others = _links(x, n, edges, cosine, _First(block))
        some = others > 0
        return pd.DataFrame({"node": ids[some], "root": ids[root[some]], "others": others[some]})

    return tasks.join(graph, "node").groupBy("shard", "i", "j").applyInPandas(find, FOUND)


def _linked(rows: DataFrame, nodes: DataFrame, cosine: float) -> DataFrame:
    """``linked`` for ``nodes`` (node, space, n, sketch); ``rows`` (node, v) has their
    vectors, each once or more."""
    if cosine < LEAST_SKETCHED:
        groups = nodes.select("node", F.col("space").alias("component"))
    else:
        groups = connected_components(written(_near(nodes, cosine)), "node", "root").withColumnRenamed("id", "node")
    groups = written(groups)
    few = groups.count() < FEW
    groups = written(nodes.select("node", "space", "n").join(F.broadcast(groups) if few else groups, "node"))
    # a group of over SHARD_ROWS nodes is a shard or, beyond CHUNK, several; the others of a space share shards
    own = written(groups.groupBy("component").agg(F.count("*").alias("size")).where(F.col("size") > min(SHARD_ROWS, CHUNK)))
    groups = groups.join(F.broadcast(own), "component", "left")
    shards = written(groups.where("size is null").groupBy("space").agg(F.ceil(F.count("*") / SHARD_ROWS).alias("shards")).where("shards > 1"))
    shard = F.when(F.col("size").isNotNull(), F.xxhash64("space", "component")).otherwise(F.xxhash64("space", F.pmod(F.xxhash64("component"), F.coalesce("shards", F.lit(1)))))
    placed = groups.join(F.broadcast(shards), "space", "left").select("node", "space", "n", shard.alias("shard"), F.coalesce(F.col("size") > CHUNK, F.lit(False)).alias("large"))
    once = lambda df, *more: df.groupBy("node", *more).agg(F.first("v").alias("v"))
    if few:
        vectors = once(rows.join(F.broadcast(placed), "node").select("node", "space", "n", "shard", "large", "v"), "space", "n", "shard", "large")
    else:
        vectors = once(rows.select("node", "v")).join(placed, "node")

    def find(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("node", ignore_index=True)
        x, ids, n = np.stack(block.v.to_numpy()).astype(np.float64), block.node.to_numpy(), block.n.to_numpy()
        root, others = _links(x, n, robust_graph(x / np.linalg.norm(x, axis=1)[:, None]), cosine)
        some = others > 0
        return pd.DataFrame({"node": ids[some], "root": ids[root[some]], "others": others[some]})

    large = own.where(F.col("size") > CHUNK).count() > 0
    if large:
        vectors = written(vectors)
    found = vectors.where(~F.col("large")).groupBy("shard").applyInPandas(find, FOUND)
    if large:
        found = found.unionByName(_linked_large(vectors.where("large").select("node", F.col("space").alias("label"), "v", "n"), cosine))
    return found


def linked(nodes: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(node, root, others) for the rows (node, label, v, n) of each task in which a
    node has links: root is a node of the same component, others the rows (sums of
    n) that it links with and that count in this task."""
    return _linked(nodes.select("node", "v"), written(_sketched(nodes.select("node", _space(), "n", "v"))), cosine)


def _space():
    """Vectors of different spaces never link."""
    return F.xxhash64("label", F.size("v")).alias("space")


def graph_nodes(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, node, label, v) of the rows that can link; v keeps single precision."""
    kind = "array<float>" if dict(vectors.dtypes).get(vector_col) == "array<float>" else "array<double>"
    fine = usable(vectors.where(F.col(label_col).isNotNull()).select(F.struct(id_col, F.col(label_col).alias("label")).alias("_r"), F.col(vector_col)), "_r", vector_col)
    return fine.select(F.col(f"vec_id.{id_col}").alias("vec_id"), F.col("vec_id.label").alias("label"), "v", F.xxhash64("vec_id.label", "v").alias("node")).withColumn("v", F.col("v").cast(kind))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    Rows link when their labels are equal and not null and their cosine in double
    precision is at least ``cosine``. Vectors that are null, zero, of other length
    or hold null or non-finite components link with nothing. n_links counts other
    rows, equal vectors included; repeated rows count as rows of their own.
    component_id is the smallest id reachable. A row with a null id may link, has a
    component_id if another has an id, and is kept only if none has. An empty table
    gives no rows. Other columns are not read.
    """
    rows = graph_nodes(vectors, id_col, vector_col, label_col)  # read where they are needed, as written vectors take much more room than sketches
    firsts = [F.first(c).alias(c) for c in ("space", *WORDS)]
    nodes = written(_sketched(rows.select("node", "vec_id", _space(), "v")).groupBy("node").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("n"), *firsts))
    found = written(_linked(rows.select("node", "v"), nodes, cosine))
    others = found.groupBy("node").agg(F.sum("others").alias("others"))
    parts = written(connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "node"))
    placed = written(nodes.select("node", "first_id", "n").join(others, "node", "left").join(parts, "node", "left").where("n > 1 or others is not null"))
    # written before the join, so that one large component is no single task
    first = written(placed.where("component is not null").groupBy("component").agg(F.min("first_id").alias("component_id")))
    placed = placed.join(first, "component", "left").select(
        "node", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.when(F.col("component").isNull(), F.col("first_id")).otherwise(F.col("component_id")).alias("component_id"), F.lit(True).alias("some")
    )
    # a row that is not placed is the only one of its vector and without links
    out = rows.select("vec_id", "node").join(written(placed), "node", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(F.col("some"), F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"))
    ids = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = F.col("label").isNotNull() & F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    apart = ids.where(~fine).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(apart).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()))


def audit(nodes: DataFrame, found: DataFrame, queries: int = 200, cosine: float = COSINE) -> float | None:
    """Share of the true links of at most so many nodes (node, label, v, n) that
    ``found``, the result of ``linked``, counts; by brute force over the nodes of
    their labels. None if they have no link."""
    nodes = nodes.withColumn("v", F.col("v").cast("array<double>"))
    asked = F.broadcast(nodes.orderBy(F.xxhash64("node")).limit(queries).select(F.col("node").alias("q"), "label", F.col("v").alias("w")))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda s, t: s * t), F.lit(0.0), lambda s, t: s + t)
    near = dot("v", "w") / F.sqrt(dot("v", "v") * dot("w", "w"))
    true = nodes.join(asked, "label").where((F.col("node") != F.col("q")) & (near >= cosine)).groupBy("q").agg(F.sum("n").alias("true"))
    got = found.groupBy("node").agg(F.sum("others").alias("got"))
    r = true.join(got, F.col("q") == F.col("node"), "left").agg(F.sum("true"), F.sum(F.least("true", F.coalesce("got", F.lit(0))))).first()
    return r[1] / r[0] if r[0] else None
