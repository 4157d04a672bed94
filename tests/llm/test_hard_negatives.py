"""Hard negatives against a loop; the intervals; odd rows; limits of memory."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslathe.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<double>, label int, row string, score string"


def brute(rows, positives=5, negatives=10):
    fine = [(i, [int(np.floor(256 * x)) for x in v], l) for i, v, l in rows if l is not None and v is not None and all(x is not None and np.isfinite(x) and np.isfinite(256 * x) for x in v)]
    out = Counter()
    last = lambda i: (i is None, i or 0)
    for k, (a, u, l) in enumerate(fine):
        if a is None or a % 10:
            continue
        scored = [(-sum(s * t for s, t in zip(u, v, strict=True)), last(i), i, m) for j, (i, v, m) in enumerate(fine) if j != k and len(u) == len(v)]
        for p, _, pos, m in sorted((s for s in scored if s[3] == l), key=lambda s: s[:2])[:positives]:
            inside = [s for s in scored if s[3] != l and 30 * -p <= 100 * -s[0] <= 90 * -p]
            for rank, s in enumerate(sorted(inside, key=lambda s: s[:2])[:negatives], 1):
                out[a, pos, rank, s[2], -p, -s[0]] += 1
    return out


def mined(spark, rows):
    df = spark.createDataFrame([(i, v, l, "x", "y") for i, v, l in rows], SCHEMA)
    got = H.mine(df, F.col("vec_id") % 10 == 0, F.col("label")).collect()
    return Counter((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in got)


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), (rng.standard_normal(12) + (i % 3)).tolist(), int(i % 4)) for i in range(60)]
    rows += [(10, rows[10][1], 2), (10, rows[11][1], 2), (None, rows[12][1], 1), (None, rows[12][1], 0), (61, None, 1), (62, [1.0] * 12, None), (63, [float("nan")] * 12, 1), (64, [1.0, None] * 6, 1), (65, [float("inf")] * 12, 1)]
    rows += [(70, [0.0] * 12, 1), (71, [0.0] * 12, 2), (80, [1.0, 2.0], 1), (81, [1.5, 1.0], 1), (82, [0.5, 0.2], 2), (90, [], 1), (91, [], 1), (92, [], 2), (93, [1e308] * 12, 1)]
    rows += [(100 + i, rows[20][1], i % 2) for i in range(40)]  # copies: ties by id
    assert mined(spark, rows) == brute(rows)
    assert mined(spark, []) == Counter() and mined(spark, [(1, [1.0], 1)]) == Counter()


def test_beyond_double_precision(spark):
    rows = [(i * 5, [float(2**21 + i), float(-(2**20) + 3 * i), 2.0**20], i % 2) for i in range(12)]
    assert mined(spark, rows) == brute(rows)


def test_memory_of_a_task(spark, monkeypatch):
    """Many small blocks and few anchors held give the same rows."""
    rng = np.random.default_rng(5)
    rows = [(i, (rng.standard_normal(8) + 0.5).tolist(), i % 3) for i in range(150)]
    for name, value in (("BLOCK_ROWS", 16), ("BLOCK_ANCHORS", 2), ("HELD", 1), ("AT_ONCE", 1)):
        monkeypatch.setattr(H, name, value)
    assert mined(spark, rows) == brute(rows)


@pytest.mark.parametrize("dim", [1, 2, 63, 64, 65, 130])
def test_intervals_hold(dim):
    rng = np.random.default_rng(dim)
    for x in (rng.standard_normal((300, dim)), rng.standard_normal((300, dim)) * 1e-9, np.floor(256 * rng.standard_cauchy((300, dim))), np.zeros((2, dim)), np.full((2, dim), 1e200)):
        q = np.concatenate([x[:20], rng.standard_normal((20, dim))])
        for levels in (1, 3):
            codes = H.coded(x, levels)
            low, high = H.Planes(q).interval(slice(0, len(q)), *codes)
            with np.errstate(over="ignore", invalid="ignore"):
                true = q @ x.T
            fine = np.isfinite(true)
            assert (low <= true)[fine].all() and (true <= high)[fine].all() and (low[~fine] == -np.inf).all() and (high[~fine] == np.inf).all()


def test_intervals_prune():
    """Clustered rows: codes leave a small share to be scored; more levels, less."""
    rng = np.random.default_rng(2)
    x = np.floor(256 * (rng.standard_normal((40, 96))[rng.integers(0, 40, 4000)] + 0.1 * rng.standard_normal((4000, 96))))
    left = []
    for levels in (1, 2, 3):
        low, high = H.Planes(x[:50]).interval(slice(0, 50), *H.coded(x, levels))
        need = np.sort(low, 1)[:, -6]
        left.append((high >= need[:, None]).mean())
    assert left[2] < 0.2 and left == sorted(left, reverse=True)
