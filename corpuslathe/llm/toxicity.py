"""Toxicity: gradient-boosted trees over dense features, isotonic calibration.

Fitting uses at most ``FIT_ROWS`` labelled rows (the first by hash of their id);
distinct texts only. From these rows:

* a lexicon: whole words and word beginnings that occur in more toxic documents
  than chance allows (G test), with shrunken log odds as weights;
* dense features of each document: lexicon densities, second-person proximity,
  capitals, punctuation and obfuscation rates. For a fitting row, its own part in
  the lexicon's counts is taken out first, so that the trees don't trust terms
  that only this row has;
* gradient-boosted trees on logistic loss, and isotonic regression of the label
  on cross-validated scores.

Every document is then scored on its whole text; only the lexicon (at most
``TERMS`` terms), the trees and the steps of the isotonic function are sent out.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread, written

FIT_ROWS = 20_000
TERMS = 20_000
LEAST_DOCS = 3
BEGINNINGS = (3, 4, 5, 6, 7)
THRESHOLD = 0.3
TOKENS_HELD = 400_000
TREES, DEPTH, RATE, BINS, FOLDS = 60, 4, 0.15, 32, 3

# A small general lexicon, and second-person words of four languages.
INSULTS = frozenset(
    "asshole bastard bitch clown coward cretin creep degenerate disgusting dumb dumbass dumbo fool freak garbage hate hateful idiot idiotic imbecile jerk kill liar loser lunatic maggot moron moronic parasite pathetic pig psycho rat scum scumbag shit shut slut stupid subhuman trash ugly useless vermin vile whore worthless wretch".split()
)
SECOND_PERSON = frozenset("you your yours yourself youre u ur du dich dir dein deine deinen euch ihr tu te toi ton tes vous votre vos tú ti usted ustedes vosotros tus".split())
SIGNS = [ord(c) for c in "!?#$%&*@^~|"]
_TRIPLE = re.compile(r"(.)\1\1").search
_LETTER = re.compile(r"[^\W\d_]").search
LEET = str.maketrans("013457@$!|€", "oieastasile")
HIT, FIXED, SECOND, CAPS, PUNCT, ODD, DIGITS, KNOWN = (1 << b for b in range(16, 24))
_EDGES = ".,;:!?\"'()[]{}<>|*#$%&-_/~"
_FLAGS = {w: FIXED * (w in INSULTS) | SECOND * (w in SECOND_PERSON) for w in INSULTS | SECOND_PERSON}
FEATURES = (
    "log_words", "weight_rate", "hit_rate", "log_hits", "best", "second_best", "log_distinct", "window", "fixed_rate", "log_fixed", "second_rate",
    "near_second", "caps_rate", "upper_share", "bang_rate", "punct_rate", "punct_share", "odd_rate", "digit_rate", "hit_caps",
)


def core(token: str) -> str:
    """The token in lower case without what stands around its first and last letter or digit."""
    token = token.lower()
    if token.isalpha():
        return token
    i, j = 0, len(token)
    while i < j and not token[i].isalnum():
        i += 1
    while j > i and not token[j - 1].isalnum():
        j -= 1
    return token[i:j]


def terms_of(word: str) -> list[str]:
    """The word (marked by a blank) and its beginnings, if they are shorter."""
    return [word + " ", *(word[:k] for k in BEGINNINGS if len(word) >= k)] if len(word) > 2 else []


def plain(word: str) -> str:
    """The word with look-alike signs read as letters and repeated letters joined."""
    letters = [c for c in word.translate(LEET) if c.isalpha()]
    return "".join(c for i, c in enumerate(letters) if i < 2 or not c == letters[i - 1] == letters[i - 2])


def weight(a: np.ndarray, b: np.ndarray, toxic: float, clean: float) -> np.ndarray:
    """Shrunken log odds of terms in a of so many toxic and b of so many clean
    documents; 0 where a G test does not tell them from chance."""
    n, share = a + b, toxic / max(toxic + clean, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        g = 2 * (np.where(a > 0, a * np.log(a / (n * share)), 0) + np.where(b > 0, b * np.log(b / (n * (1 - share))), 0))
    odds = np.log((a + 0.5) / (toxic + 1)) - np.log((b + 0.5) / (clean + 1))
    return np.where((g >= 13) & (odds > 0.7) & (a >= LEAST_DOCS), np.minimum(odds, 9.0) * a / (a + 2), 0.0)


class Tokens(dict):
    """Tokens as integers: weight in hundredths, and flags above bit 16."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights
        self.heads = {t[:3] for t in weights}

    def __missing__(self, token: str) -> int:
        if len(self) >= TOKENS_HELD:
            self.clear()
        self[token] = value = self.value(token, self.weights.get)
        return value

    def value(self, token: str, get) -> int:
        word = token.lower().strip(_EDGES)
        if not word.isalpha() or _TRIPLE(word):
            return self.odd_value(token, get)
        value = _FLAGS.get(word, 0)
        if word[:3] in self.heads:
            found = [w for t in terms_of(word) if (w := get(t)) is not None]
            if found:
                best = max(found)
                value |= round(100 * best) | KNOWN | HIT * (best > 0)
        return value | CAPS * (len(word) > 1 and token.isupper()) | PUNCT * (len(token) - len(word) > 1)

    def odd_value(self, token: str, get) -> int:
        word = core(token)
        alpha, odd = word.isalpha(), 0
        other = word if alpha and not _TRIPLE(word) else plain(word)
        found = [w for t in terms_of(word) if (w := get(t)) is not None]
        if other != word and len(other) > 2:
            found += [w for t in terms_of(other) if (w := get(t)) is not None]
            odd = ODD if not alpha and (_LETTER(word) or not word.isalnum()) else 0
        best = max(found, default=0.0)
        value = round(100 * best) | odd | KNOWN * bool(found) | HIT * (best > 0) | _FLAGS.get(word, 0) | _FLAGS.get(other, 0) & FIXED
        value |= CAPS * (len(word) > 1 and token.isupper()) | DIGITS * (not alpha and not word.isdigit() and any(c.isdigit() for c in word))
        return value | PUNCT * (len(token) - len(word) > 1)


class Adjusted(dict):
    """``Tokens`` for one document, with other weights of some terms."""

    def __init__(self, tokens: Tokens, changed: dict[str, float]):
        self.tokens = tokens
        self.get_weight = lambda t: changed.get(t, tokens.weights.get(t))

    def __missing__(self, token: str) -> int:
        value = self.tokens[token]
        if value & KNOWN:
            value = self.tokens.value(token, self.get_weight)
        self[token] = value
        return value


def features(text: str | None, tokens: dict) -> np.ndarray:
    """The values of FEATURES; all zero for a null or blank text."""
    out = np.zeros(len(FEATURES))
    words = (text or "").split()
    if not words:
        return out
    v = np.fromiter(map(tokens.__getitem__, words), np.int64, len(words))
    n, w = len(v), (v & 0xFFFF) / 100
    hits, fixed, second = (np.flatnonzero(v & m) for m in (HIT, FIXED, SECOND))
    rate = lambda m: np.count_nonzero(v & m) / n
    top = np.sort(w[hits])[-2:] if len(hits) else np.zeros(0)
    sums = np.concatenate([[0.0], np.cumsum(w)])
    marked = np.union1d(hits, fixed)
    near = 0
    if len(marked) and len(second):
        at = np.searchsorted(second, marked)
        apart = np.minimum(np.abs(second[np.minimum(at, len(second) - 1)] - marked), np.abs(second[np.maximum(at - 1, 0)] - marked))
        near = np.count_nonzero(apart <= 5)
    chars = np.bincount(np.frombuffer(text.encode("ascii", "ignore"), np.uint8), minlength=128)
    size, letters, signs = len(text), chars[65:91].sum(), chars[SIGNS].sum()
    out[:] = (
        math.log1p(n), w.sum() / n, len(hits) / n, math.log1p(len(hits)), top[-1] if len(top) else 0, top[0] if len(top) > 1 else 0,
        math.log1p(len({words[i] for i in hits})), (sums[min(20, n) :] - sums[: n + 1 - min(20, n)]).max(), len(fixed) / n, math.log1p(len(fixed)), len(second) / n,
        near / n, rate(CAPS), letters / size, chars[33] / n, rate(PUNCT), signs / size, rate(ODD), rate(DIGITS), np.count_nonzero((v & HIT > 0) & (v & CAPS > 0)) / n,
    )
    return out


class Trees:
    """Gradient-boosted regression trees on logistic loss, over binned features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE):
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1], method="higher")) for c in x.T]
        self.depth, self.trees = depth, []
        binned = self.bins(x)
        n, f = x.shape
        self.start = math.log((y.sum() + 0.5) / (n - y.sum() + 0.5))
        raw = np.full(n, self.start)
        at_feature = np.arange(f) * (BINS + 1)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-raw))
            g, h = p - y, np.maximum(p * (1 - p), 1e-6)
            node, feature, cut = np.zeros(n, np.int64), [], []
            for level in range(depth):
                nodes = 1 << level
                where = (node[:, None] * (f * (BINS + 1)) + at_feature + binned).ravel()
                sums = [np.bincount(where, np.repeat(s, f), nodes * f * (BINS + 1)).reshape(nodes, f, BINS + 1).cumsum(2) for s in (g, h)]
                (gl, hl), (gt, ht) = sums, (s[:, :, -1:] for s in sums)
                gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                gain = np.where((hl < 1e-3) | (ht - hl < 1e-3), 0, gain).reshape(nodes, -1)
                best = gain.argmax(1)
                idle = gain[np.arange(nodes), best] <= 1e-9
                fs, cs = best // (BINS + 1), np.where(idle, BINS + 1, best % (BINS + 1))
                feature.append(fs)
                cut.append(cs)
                node = 2 * node + (binned[np.arange(n), fs[node]] > cs[node])
            leaf = -rate * np.bincount(node, g, 1 << depth) / (np.bincount(node, h, 1 << depth) + 1)
            raw += leaf[node]
            self.trees.append((feature, cut, leaf))

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, i], "left") for i, c in enumerate(self.cuts)], 1) if len(x) else np.zeros((0, len(self.cuts)), np.int64)

    def raw(self, x: np.ndarray) -> np.ndarray:
        binned, rows = self.bins(x), np.arange(len(x))
        out = np.full(len(x), self.start)
        for feature, cut, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for fs, cs in zip(feature, cut, strict=True):
                node = 2 * node + (binned[rows, fs[node]] > cs[node])
            out += leaf[node]
        return out


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps (raw, share of label 1) of the isotonic regression, by pooling
    adjacent violators; each pool is smoothed by half a row of either label."""
    order = np.argsort(raw, kind="stable")
    pools: list[list[float]] = []  # sum, count, last raw
    for r, t in zip(raw[order], y[order], strict=True):
        pools.append([float(t), 1.0, float(r)])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            s, n, at = pools.pop()
            pools[-1] = [pools[-1][0] + s, pools[-1][1] + n, at]
    values = np.maximum.accumulate([(s + 0.5 * y.mean()) / (n + 0.5) for s, n, _ in pools])
    return np.array([p[2] for p in pools]), np.asarray(values)


class Model:
    """Lexicon, trees and calibration; small enough to travel with the tasks."""

    def __init__(self, weights: dict[str, float], x: np.ndarray, y: np.ndarray):
        self.weights, self.prior = weights, float(y.mean()) if len(y) else 0.0
        self.trees = None
        if 0 < y.sum() < len(y):
            self.trees = Trees(x, y)
            fold = np.arange(len(y)) % FOLDS
            raw = np.empty(len(y))
            for k in range(FOLDS):
                rest = fold != k
                raw[~rest] = Trees(x[rest], y[rest]).raw(x[~rest]) if 0 < y[rest].sum() < rest.sum() else self.trees.start
            self.at, self.share = isotonic(raw, y)

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.prior)
        raw = self.trees.raw(x)
        step = np.minimum(np.searchsorted(self.at, raw, "left"), len(self.at) - 1)
        # a trace of the raw score keeps the order within a step
        return np.clip(0.999 * self.share[step] + 0.001 / (1 + np.exp(-raw)), 0, 1)


def _feature_table(x: np.ndarray) -> pa.Array:
    return pa.array(list(x), pa.list_(pa.float64()))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = FIT_ROWS) -> Model:
    """A model from ``docs`` and those rows of ``labels`` (ids and 0/1 labels; null
    labels are left out, the larger of contradicting ones counts, as it does for
    equal texts, which are one row of their smallest id). Rows without an id or a text
    teach nothing; without any row every score is 0. Other columns are not read."""
    own = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("y"))
    chosen = own.orderBy(F.xxhash64("_id"), "_id").limit(rows)
    text = F.col(text_col).cast("string").alias("text")
    sample = docs.select(F.col(id_col).alias("_id"), text).join(F.broadcast(chosen), "_id")  # at most FIT_ROWS rows of an id and a label
    sample = spread(written(sample.where("text is not null").groupBy("text").agg(F.min("_id").alias("_id"), F.max("y").alias("y")).select("_id", "text", "y")))
    toxic, clean = (float(x or 0) for x in sample.agg(F.sum("y"), F.sum(1 - F.col("y"))).first())

    def count(batches):
        for batch in batches:
            found: Counter = Counter()
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = {core(w) for w in t.split()}
                for term in {term for w in words for term in terms_of(w)}:
                    found[term, y] += 1
            keys = list(found)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([found[k] for k in keys], pa.int64())], ["term", "y", "n"])

    counts = sample.select("text", "y").mapInArrow(count, "term string, y int, n long").groupBy("term").agg(
        F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("b")
    )
    share = toxic / max(toxic + clean, 1)
    rise = F.col("a") / (F.col("a") + F.col("b"))
    counts = counts.where((F.col("a") >= LEAST_DOCS) & (rise > 1.5 * share)).orderBy(F.desc(F.col("a") * F.log(rise / max(share, 1e-9))), "term").limit(TERMS)
    found = counts.toPandas()
    lexicon = {t: (float(a), float(b)) for t, a, b in zip(found.term, found.a, found.b, strict=True)}

    def train(batches):
        terms = list(lexicon)
        place = {t: i for i, t in enumerate(terms)}
        a, b = (np.array([lexicon[t][k] for t in terms]) for k in (0, 1))
        tokens = Tokens(dict(zip(terms, weight(a, b, toxic, clean).tolist(), strict=True)))
        for batch in batches:
            out = []
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.array(sorted({place[x] for w in {core(w) for w in t.split()} for x in terms_of(w) if x in place}), np.int64)
                less = weight(a[own] - (y == 1), b[own] - (y == 0), toxic - (y == 1), clean - (y == 0))
                out.append(features(t, Adjusted(tokens, {terms[i]: w for i, w in zip(own.tolist(), less.tolist(), strict=True)})))
            yield pa.RecordBatch.from_arrays([_feature_table(np.array(out)) if out else pa.array([], pa.list_(pa.float64())), batch.column(1), batch.column(2)], ["x", "y", "_id"])

    kind = sample.schema["_id"].dataType.simpleString()
    rows_ = sample.select("text", "y", "_id").mapInArrow(train, f"x array<double>, y int, _id {kind}").toPandas().sort_values("_id", ignore_index=True)
    x = np.array(rows_.x.tolist()).reshape(len(rows_), len(FEATURES))
    names = list(lexicon)
    w = weight(np.array([lexicon[t][0] for t in names]), np.array([lexicon[t][1] for t in names]), toxic, clean) if names else []
    return Model({t: v for t, v in zip(names, map(float, w), strict=True) if v > 0}, x, rows_.y.to_numpy(float))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, carry: list[str] | None = None) -> DataFrame:
    """doc_id, score, predicted for every row of ``docs``, or the columns named in
    ``carry`` with score and predicted. Null and blank texts get the score of
    all-zero features; repeated rows and ids are scored each; an empty table gives
    no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by TERMS and TREES

    def run(batches):
        model = shared.value
        tokens = Tokens(model.weights)
        for batch in batches:
            texts = batch.column(0)
            x = np.array([features(t, tokens) for t in texts.to_pylist()]).reshape(len(texts), len(FEATURES))
            s = model.scores(x)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(1, batch.num_columns)), pa.array(s), pa.array((s >= threshold).astype(np.int32))], [*names, "score", "predicted"]
            )

    names = carry or ["doc_id"]
    columns = [F.col(c) for c in carry] if carry else [F.col(id_col).alias("doc_id")]
    into = spread(docs.select(F.col(text_col).cast("string").alias("_text"), *columns))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in into.schema.fields[1:])
    return into.mapInArrow(run, f"{schema}, score double, predicted int")


def held_out(id_col: str = "doc_id"):
    """Rows never used for fitting: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
