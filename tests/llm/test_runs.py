"""Runs of words against loops: all small texts, planted tails, odd rows."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpuslathe.llm import runs

DOCS = "doc_id long, text string, lang string, period string, n_runs string"


def brute(words, times=4, least=6):
    """(start, length, period) of all runs by the definition."""
    out = {}
    for p in range(1, len(words) // times + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(least, times * p):
                out.setdefault((i, j + p - i), p)
            i = max(j, i + 1)
    return sorted((s, n, p) for (s, n), p in out.items())


def tailed(words, doc_id):
    h = zlib.crc32(str(doc_id).encode())
    n = len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def row(doc_id, text, tails=True):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    words = tailed(words, doc_id) if tails else words
    found = brute(words)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    told = "".join(f"{s},{n},{p}\n" for s, n, p in sorted(found, key=lambda r: (r[0], r[2])))
    return doc_id, len(found), *best, None if best[0] is None else 1000 * best[1] // best[2], hashlib.sha256(told.encode()).hexdigest(), " ".join(w for i, w in enumerate(words) if i not in gone)


def judged(spark, rows):
    df = spark.createDataFrame([(i, t, "en", "x", "y") for i, t in rows], DOCS)
    got = runs.periodic_runs(df, tails=True).collect()
    assert all([tuple(x) for x in r.runs] == sorted((tuple(x) for x in r.runs), key=lambda x: (x[0], x[2])) and len(r.runs) == r.n_runs for r in got)
    return Counter((r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed) for r in got)


def test_all_short_texts():
    """Every text of two words up to length 13, many at a time."""
    every = [list(w) for n in range(14) for w in itertools.product((0, 1), repeat=n)]
    for at in range(0, len(every), 3000):
        texts, words = every[at : at + 3000], []
        for k, t in enumerate(texts):
            words += [*t, 2 + k]
        got, start, want = runs.runs_of(np.array(words), 13), 0, []
        for t in texts:
            want += [[s + start, s + n + start, p] for s, n, p in brute(t)]
            start += len(t) + 1
        assert got.tolist() == sorted(want, key=lambda r: (r[0], r[2]))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=200), st.integers(2, 5), st.integers(1, 9))
def test_other_limits(words, times, least):
    got = runs.runs_of(np.array([*words, 9]), len(words), times, least)
    assert [(s, e - s, p) for s, e, p in got.tolist()] == sorted(brute(words, times, least), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("period, cover", [(1, (0,)), (3, (0, 1)), (7, (1, 2, 4)), (runs.PERIOD, runs.COVER)])
def test_extensions(period, cover):
    rng = np.random.default_rng(period)
    for words in (rng.integers(0, 2, 300), np.tile(rng.integers(0, 5, 40), 12), rng.integers(0, 2**40, 50), np.zeros(200, int)):
        words = np.append(words, words.max() + 1)
        e = runs.Extensions(words, period, cover)
        suffixes = [words[i:].tolist() for i in e.at if i < len(words)]
        assert [words[i:].tolist() for i in e.at[e.order] if i < len(words)] == sorted(suffixes)
        i, j = rng.integers(0, len(words), (2, 2000))
        i, j = i[i != j], j[i != j]
        same = lambda a, b: next(k for k in range(len(words)) if a + k >= len(words) or b + k >= len(words) or words[a + k] != words[b + k])
        assert e(i, j).tolist() == [same(a, b) for a, b in zip(i.tolist(), j.tolist(), strict=True)]


def test_cover():
    assert {(a - b) % runs.PERIOD for a in runs.COVER for b in runs.COVER} == set(range(runs.PERIOD))


def test_odd_rows(spark):
    r = random.Random(4)
    texts = [None, "", " \n\t", "one", "a " * 5, "a " * 6, "A a " * 6, "a\x0bb\x0ca\rb a b a b", "é x " * 8, "x " * 3000, "w" * 100_000, " ".join(f"w{i % 700}" for i in range(2900))]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "a b " * 9), (None, None), (3, "a b c " * 5), (3, "a b c " * 5)]
    rows += [(100 + i, " ".join(r.choice("abc") for _ in range(r.randrange(80))) + " q r s" * r.randrange(7)) for i in range(300)]
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 and row(i, t)[1] for i, t in rows if i is not None)
    assert judged(spark, rows) == Counter(row(i, t) for i, t in rows)
    assert judged(spark, []) == Counter()


def test_groups_of_texts(spark, monkeypatch):
    """How texts are put together changes nothing."""
    rows = [(i, "a b c d " * (i % 9) + "e f " * (i % 7)) for i in range(120)]
    want = Counter(row(i, t) for i, t in rows)
    for at_once in (1, 50, 10**6):
        monkeypatch.setattr(runs, "WORDS_AT_ONCE", at_once)
        assert judged(spark, rows) == want


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    from corpuslathe.llm.queries import QUERIES

    want = {r.doc_id: row(r.doc_id, r.text) for r in docs.collect()}
    got = QUERIES["op13_periodic_runs"](spark, sf).collect()
    assert len(got) == len(want) and any(r.n_runs for r in got)
    for r in got:
        w = want[r.doc_id]
        assert (r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) == (*w[:7], hashlib.sha256(w[7].encode()).hexdigest())
