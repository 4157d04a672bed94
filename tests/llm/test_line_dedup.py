"""Line dedup against a loop: ranges that cut a hot line, odd rows, bitmaps."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpuslathe.llm import line_dedup

DOCS = "doc_id long, text string, lang string, h1 long, line string, keep string"


def brute(rows, least_chars=20, least_docs=3):
    """(doc_id, n_lines, n_dropped, kept) of each row."""
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            holders[key(x)].add(i)
    order = lambda i: (i is not None, i or 0)
    gone = lambda i, x: len(key(x)) >= least_chars and len(holders[key(x)]) >= least_docs and i != max(holders[key(x)], key=order)
    out = Counter()
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not gone(i, x)]
        out[i, len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    return out


def judged(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", 0, "x", "x") for i, t in rows], DOCS)
    got = line_dedup.kept_texts(docs, line_dedup.keep_bitmaps(docs)).collect()
    return Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in got)


LINES = ["a line of twenty chars", "A LINE of twenty chars\t", "  another line that is long enough ", "short", "", " ", "ééééééééééééééééééé", "éééééééééééééééééééé", "İİİİİİİİİİİİİİİİİİİİİİ", "it ends with a return...\r"]


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "\n"), (4, "\n".join(LINES * 2)), (5, "\n".join(LINES[::-1])), (5, "\n".join(LINES[:3])), (5, "\n".join(LINES[:3])), (None, "\n".join(LINES)), (6, LINES[0]), (7, LINES[7] + "\n" + LINES[8]), (None, LINES[6]), (8, LINES[7]), (9, "\n".join(LINES[:3])), (10, "x" * 300_000 + "\n" + LINES[9]), (11, LINES[9] + "\n"), (12, LINES[9])]
    assert judged(spark, rows) == brute(rows)
    assert judged(spark, []) == Counter()
    assert judged(spark, [(None, LINES[0]), (None, LINES[0] + "\n"), (1, LINES[0])]) == brute([(None, LINES[0]), (None, LINES[0] + "\n"), (1, LINES[0])])


def test_hot_line_over_many_ranges(spark):
    """One line in most documents, twice in some: more ranges than other lines fill."""
    rng = np.random.default_rng(1)
    rows = []
    for i in range(400):
        own = [f"line {rng.integers(300)} with enough characters" for _ in range(rng.integers(0, 4))]
        rows.append((i, "\n".join([*own, *["the line that nearly all documents hold"] * (1 + i % 2)] if i % 5 else own)))
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for parts in (1, 7, 60):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            assert judged(spark, rows) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 5)), max_size=30), st.lists(st.integers(1, 29), max_size=4))
def test_stream_in_ranges(rows, cuts):
    """However sorted rows are cut, streams and their edges judge as the whole does."""
    rows = sorted(((h, d, i) for i, (h, d) in enumerate(rows)), key=lambda r: (r[0], -r[1], r[2]))
    docs = defaultdict(set)
    for h, d, _ in rows:
        docs[h].add(d)
    want = {(d, i) for h, d, i in rows if len(docs[h]) >= 3 and d != max(docs[h])}
    got, seen, open_ = set(), defaultdict(set), []
    bounds = [0, *sorted(c for c in set(cuts) if c < len(rows)), len(rows)]
    for a, b in zip(bounds, bounds[1:], strict=False):
        s = line_dedup._Stream(3)
        for h, d, i in rows[a:b]:
            s.take((h, h), d, 0, i)
        s.close(True)
        assert len({r[0] for r in s.out if r[0] is not None}) <= 2
        for h, _, d, _, i in s.drained():
            if h is None:
                got.add((d, i))
            elif i is None:
                seen[h].add(d)
            else:
                open_.append((h, d, i))
    got |= {(d, i) for h, d, i in open_ if len(seen[h]) >= 3 and d != max(seen[h])}
    assert got == want


@pytest.mark.parametrize("n", [1, 7, 8, 9, 5000])
def test_bitmaps(n):
    rng = np.random.default_rng(n)
    for gone in ([], [0], [n - 1], rng.choice(n, n // 2, replace=False).tolist(), list(range(n))):
        told = line_dedup.packed(gone, n)
        assert set(np.flatnonzero(~line_dedup.unpacked(told, n)).tolist()) == set(gone) and len(told) <= 1 + -(-n // 8)
    assert len(line_dedup.packed(list(range(0, n, 1)), n)) < 40
