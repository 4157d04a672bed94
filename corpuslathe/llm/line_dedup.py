"""Line deduplication over ranges of sorted hashes, answered by keep bitmaps.

1. Every line of ``LEAST_CHARS`` or more becomes (hash, document, position); the hash
   has 128 bits (two different keys of n share one with chance n^2 / 2^129). Texts go
   no further.
2. These rows are dealt to ranges of (hash, document descending, position) and sorted
   within them. Since the document belongs to the range, a line that a third of all
   documents hold fills as many ranges as it needs.
3. A task streams its range. The first document of a hash, the largest, keeps its
   lines; those of the second wait until a third one shows that the line is common.
   So a task holds the lines of one document at most.
4. Only a range's first and last hash may go on in other ranges. Their rows leave
   the task unjudged, with the first ``LEAST_DOCS`` documents seen; a table of at most
   two hashes for each range, all that is broadcast, then judges them.
5. The lines to drop meet by document and become one compressed bitmap of the lines
   that stay. Texts are cut by bitmaps only where a caller asks for texts.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread, written

LEAST_CHARS = 20
LEAST_DOCS = 3
BLANK = b" \t\n\x0b\x0c\r"


def line_key(line: bytes) -> bytes:
    """A line without white space at its ends and with A-Z lower-cased."""
    return line.strip(BLANK).lower()


def packed(dropped: list[int] | None, n: int) -> bytes:
    """Keep bitmap of ``n`` lines: empty if all stay, else a byte that tells whether
    zlib made it shorter, and the bits."""
    if not dropped:
        return b""
    keep = np.ones(n, bool)
    keep[dropped] = False
    raw = np.packbits(keep, bitorder="little").tobytes()
    small = zlib.compress(raw, 6)
    return b"\1" + small if len(small) < len(raw) else b"\0" + raw


def unpacked(bitmap: bytes | None, n: int) -> np.ndarray:
    if not bitmap:
        return np.ones(n, bool)
    raw = zlib.decompress(bitmap[1:]) if bitmap[0] else bitmap[1:]
    return np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")[:n].astype(bool)


def _text_hash(text_col: str):
    """Tells rows of one id apart."""
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def _hashed(docs: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """(doc_id, text_hash, line, h1, h2) of every long line, and a row for each
    document with its number of lines in ``line`` and no hash."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            at, lines, hashes = [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                every = (text or b"").split(b"\n")
                at.append(i)
                lines.append(len(every))
                hashes.append(None)
                for k, line in enumerate(every):
                    if len(line) >= least:
                        key = line_key(line)
                        if len(key) >= least and (len(key) >= 4 * least or len(key.decode("utf-8", "replace")) >= least):
                            at.append(i)
                            lines.append(k)
                            hashes.append(xxhash.xxh3_128_digest(key))
            both = np.frombuffer(b"".join(h or bytes(16) for h in hashes), ">i8").reshape(-1, 2).astype(np.int64)
            gone = np.array([h is None for h in hashes], bool)
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(lines, pa.int64()), *(pa.array(both[:, c], mask=gone) for c in (0, 1))], ["doc_id", "text_hash", "line", "h1", "h2"]
            )

    own = docs.select(F.col(id_col).alias("doc_id"), _text_hash(text_col).alias("text_hash"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return spread(own).mapInArrow(run, f"doc_id {kind}, text_hash long, line long, h1 long, h2 long")


class _Stream:
    """Judges one sorted range. Rows out: (hash, document, text hash, line); with a line
    and no hash they are dropped, with both not judged yet, without a line a document
    that holds a hash of the range's edge."""

    def __init__(self, least_docs: int):
        self.least_docs, self.out = least_docs, []
        self.key, self.first = None, True

    def open(self, key) -> None:
        self.key, self.docs, self.waiting = key, [], []

    def edge(self) -> None:
        """The documents of an edge's hash that its judgement needs."""
        self.out += [(*self.key, d, None, None) for d in self.docs]

    def close(self, last: bool) -> None:
        """Ends a hash; what waits is dropped only if enough documents came."""
        if self.key is None:
            return
        if self.first or last:
            self.edge()
            self.out += [(*self.key, *row) for row in self.waiting]
        self.first = False

    def take(self, key, doc, text_hash, line) -> None:
        if key != self.key:
            self.close(False)
            self.open(key)
        if len(self.docs) < self.least_docs and (not self.docs or doc != self.docs[-1]):
            self.docs.append(doc)
        if self.first:  # the hash may have begun in the range before
            self.out.append((*key, doc, text_hash, line))
        elif len(self.docs) >= self.least_docs:
            self.out += [(None, None, *row) for row in (*self.waiting, (doc, text_hash, line)) if row[0] != self.docs[0]]
            self.waiting = []
        elif len(self.docs) > 1:
            self.waiting.append((doc, text_hash, line))

    def drained(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


def dropped_lines(hashed: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(doc_id, text_hash, line) of the rows (doc_id, text_hash, line, h1, h2) whose
    hash is in ``least_docs`` documents and whose document isn't the largest of them.
    A null id is a document of its own, smaller than all others."""
    kind = hashed.schema["doc_id"].dataType
    types = [pa.int64(), pa.int64(), None, pa.int64(), pa.int64()]

    def run(batches):
        stream, types[2] = _Stream(least_docs), None
        for batch in batches:
            types[2] = types[2] or batch.column(2).type
            for h1, h2, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                stream.take((h1, h2), *row)
                if len(stream.out) >= 50_000:
                    yield table(stream.drained())
            yield table(stream.drained())
        if types[2] is not None:
            stream.close(True)
            yield table(stream.drained())

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["h1", "h2", "doc_id", "text_hash", "line"])

    order = ["h1", "h2", F.desc_nulls_last("doc_id"), "line", "text_hash"]
    rows = hashed.where("h1 is not null").select("h1", "h2", "doc_id", "text_hash", "line")
    judged = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, f"h1 long, h2 long, doc_id {kind.simpleString()}, text_hash long, line long"))
    # a null id counts, and is no maximum beside others
    seen = judged.where("h1 is not null and line is null").groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("n"))
    common = seen.groupBy("h1", "h2").agg(F.count("*").alias("docs"), F.max("doc_id").alias("largest")).where(F.col("docs") >= least_docs)
    open_ = judged.where("h1 is not null and line is not null").join(F.broadcast(common), ["h1", "h2"])  # two hashes a range at most
    late = open_.where(~F.col("doc_id").eqNullSafe(F.col("largest")))
    return judged.where("h1 is null").select("doc_id", "text_hash", "line").union(late.select("doc_id", "text_hash", "line"))


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(doc_id, text_hash, n_lines, n_dropped, keep) of every different (id, text):
    the lines, how many go, and the compressed bitmap of those that stay.

    Null and empty texts are one empty line, which stays. Rows that repeat id and text
    are one row here; rows with one id and several texts are one document with several
    rows. Null ids are one document, the smallest. A line that repeats in the largest
    document keeps all its copies. An empty table gives no rows; other columns are not
    read.
    """
    hashed = written(_hashed(docs, id_col, text_col, least_chars))
    heads = hashed.where("h1 is null").select("doc_id", "text_hash", F.col("line").alias("n_lines"), F.lit(None).cast("long").alias("line"))
    gone = dropped_lines(hashed, least_docs).select("doc_id", "text_hash", F.lit(None).cast("long").alias("n_lines"), "line")
    rows = heads.union(gone).groupBy("doc_id", "text_hash").agg(F.max("n_lines").alias("n_lines"), F.collect_set("line").alias("gone"))

    def run(batches):
        for batch in batches:
            n, gone = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            maps = [packed(g, k) for g, k in zip(gone, n, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(map(len, gone), pa.int64()), pa.array(maps, pa.binary())], ["doc_id", "text_hash", "n_lines", "n_dropped", "keep"])

    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, text_hash long, n_lines long, n_dropped long, keep binary")


def kept_texts(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept) for every row of ``docs``: its text without
    the lines that its bitmap drops. Repeated rows give repeated results."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), _text_hash(text_col).alias("_hash"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("_text"))
    same = F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_hash") == F.col("text_hash"))
    met = rows.join(bitmaps.hint("shuffle_hash"), same, "left").select("_id", "n_lines", "n_dropped", "_text", "keep")

    def run(batches):
        for batch in batches:
            out = []
            for n, text, keep in zip(*(batch.column(c).to_pylist() for c in (1, 3, 4)), strict=True):
                if keep:
                    text = b"\n".join(x for x, stays in zip(text.split(b"\n"), unpacked(keep, n).tolist(), strict=True) if stays)
                out.append(text)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.binary())], ["doc_id", "n_lines", "n_dropped", "kept"])

    return met.mapInArrow(run, f"doc_id {kind}, n_lines long, n_dropped long, kept binary").withColumn("kept", F.col("kept").cast("string"))
