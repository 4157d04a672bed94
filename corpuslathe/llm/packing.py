"""Best-fit packing of tokenised documents by bin completion.

A document longer than a sequence is cut into full pieces, the first piece
taking the remainder, so that every document leaves at most one piece to place.
Pieces are dealt by hash into blocks of about ``BLOCK_ROWS``; a block is packed
on its own, in one task, and loses less than one sequence against packing all at
once. In a block:

* best-fit decreasing gives the first incumbent;
* bin completion takes the largest piece left and enumerates the undominated
  fillings of what remains of its sequence, least waste first;
* a branch ends when its waste exceeds what the incumbent leaves: (its sequences
  - 1) * capacity - total length; reaching the lower bound ends the search. The
  bound counts, beside ceil(total / capacity), pieces over half a sequence, of
  which no two fit together, and what the smaller ones need beyond the room there.
  ``width`` fillings are tried for a piece, out of those that ``steps`` steps find; a
  search that ends without reaching the bound is repeated with four times as many,
  until nothing was left out. After ``nodes`` fillings (one of more than ``steps``
  steps counts as several) the incumbent stands; without that limit (None) the
  search is exact. This bounds time; it drops no piece.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import spread

CAPACITY = 2048
END_ID = 0
BLOCK_ROWS = 4096
NODES = 6000
#: Fillings kept for each largest piece, and steps to look for them, at first.
WIDTH, STEPS = 3, 160
CHUNKS_HELD = 600_000

# A blank between two characters that are no white space always starts a new
# pre-token of the byte-level pattern, so texts may be cut there.
_CUT = re.compile(r"(?<=\S) (?=\S)")
_DOUBLE = re.compile(r"\s\s")
# Unicode versions of the libraries might differ beyond the Latin letters, and long runs take tiktoken long.
_OTHER = re.compile("[^\x00-\u024f]")
LONGEST_WORD, MOST_BLANKS = 400, 4000


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of whole texts as little-endian uint32 bytes: those of ``tokenizers``.

    Latin texts without very long words are encoded by ``tiktoken`` with the ranks of
    the same vocabulary, which gives the same ids faster. In other texts, ``tokenizers``
    encodes each distinct chunk once while it is held; the chunks are cut where the
    pre-tokenizer cuts anyway. Texts with a special token's string go whole to
    ``tokenizers``.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.whole = Tokenizer.from_file(path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.bpe = self.whole.model.tokenize
        self.fast = self._ranked()
        self.parts = regex.compile(public_tokenizers.PATTERN).findall
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.shown = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(0x250)}
        held: dict = {}
        encode = self._chunk

        class Held(dict):
            def __missing__(self, chunk: str) -> bytes:
                if len(self) >= CHUNKS_HELD:
                    self.clear()
                self[chunk] = out = encode(" " + chunk)
                return out

        self.held, self.words = Held(), held

    def _ranked(self):
        """The vocabulary as ranks for tiktoken: a token's rank is its id."""
        import public_tokenizers
        import tiktoken

        level = {v: k for k, v in self._bytes().items()}
        special = set(self.special)
        ranks = {bytes(level[c] for c in t): i for t, i in self.whole.get_vocab(with_added_tokens=True).items() if t not in special}
        return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    @staticmethod
    def _bytes() -> dict[int, str]:
        """How the byte-level pre-tokenizer shows each byte: printable Latin-1 as
        itself, the others in order from U+0100 on."""
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(shown)]
        return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}

    def _chunk(self, chunk: str) -> bytes:
        if chunk and max(chunk) >= "ɐ":  # Unicode versions might differ there
            return np.array(self.whole.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()
        out = b""
        for part in self.parts(chunk):
            if (ids := self.words.get(part)) is None:
                if len(self.words) >= CHUNKS_HELD:
                    self.words.clear()
                self.words[part] = ids = b"".join([t.id.to_bytes(4, "little") for t in self.bpe(part.translate(self.shown))])
            out += ids
        return out

    def __call__(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        sizes = list(map(len, text.split()))
        if max(sizes, default=0) <= LONGEST_WORD and len(text) - sum(sizes) - len(sizes) <= MOST_BLANKS and (text.isascii() or not _OTHER.search(text)):
            return np.array(self.fast(text), "<u4").tobytes()
        chunks = _CUT.split(text) if _DOUBLE.search(text) else text.split(" ")
        first, rest = chunks[0], chunks[1:]
        return self._chunk(first) + b"".join(map(self.held.__getitem__, rest))


def pieces_of(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids."""
    rest = n % capacity
    cuts = ([0] if rest else []) + list(range(rest, n, capacity))
    return [(a, b - a) for a, b in zip(cuts, [*cuts[1:], n], strict=True)]


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, path: str | None = None, with_ids: bool = False, part: Column | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, salt[, ids][, part]); null text is empty.

    A document is its ids and then ``END_ID``; so an empty one is one piece of
    length 1. ``part`` is a string of the row that goes along.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    path, with_part = path or tokenizer_path(), part is not None
    end = int(END_ID).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(path)
        for batch in batches:
            row, piece, start, length, crc, ids = ([] for _ in range(6))
            for i, text in enumerate(batch.column(1).to_pylist()):
                data = encode(text or "") + end
                for k, (a, n) in enumerate(pieces_of(len(data) // 4, capacity)):
                    part = data[4 * a : 4 * (a + n)]
                    for to, x in ((row, i), (piece, k), (start, a), (length, n), (crc, zlib.crc32(part))):
                        to.append(x)
                    if with_ids:
                        ids.append(np.frombuffer(part, "<i4"))
            rows = pa.array(row, pa.int64())
            columns = [batch.column(0).take(rows), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc)), pa.array(np.array(row, np.int32) & 1023)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "salt"]
            if with_ids:
                columns, names = [*columns, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
            if with_part:
                columns, names = [*columns, batch.column(2).take(rows)], [*names, "part"]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, salt int" + ", ids array<int>" * with_ids + ", part string" * with_part
    own = [F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")]
    return spread(docs.select(*own, *([part.alias("part")] if with_part else []))).mapInArrow(run, schema)


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing over sizes in descending order; bins of sizes."""
    open_: dict[int, list[list[int]]] = {}
    mask, bins = 0, []
    for s in sizes:
        fits = mask >> s
        if fits:
            room = s + (fits & -fits).bit_length() - 1  # the least room that holds it
            bin_ = open_[room].pop()
            if not open_[room]:
                mask ^= 1 << room
        else:
            room, bin_ = capacity, []
            bins.append(bin_)
        bin_.append(s)
        if room > s:
            open_.setdefault(room - s, []).append(bin_)
            mask |= 1 << (room - s)
    return bins


class _Left:
    """How many pieces of each size are left, with a bit mask of the sizes."""

    def __init__(self, sizes: list[int], capacity: int):
        self.n = [0] * (capacity + 1)
        self.mask = 0
        self.upto = [(2 << k) - 1 for k in range(capacity + 1)]
        self.bit = [1 << k for k in range(capacity + 1)]
        for s in sizes:
            self.add(s)

    def add(self, s: int) -> None:
        self.n[s] += 1
        self.mask |= 1 << s

    def take(self, s: int) -> None:
        self.n[s] -= 1
        if not self.n[s]:
            self.mask ^= 1 << s

    def largest(self, most: int) -> int:
        """The largest size up to ``most`` that is left, or 0."""
        return ((self.mask & self.upto[most]).bit_length() or 1) - 1 if most > 0 else 0


def fillings(left: _Left, room: int, width: int = WIDTH, steps: int = STEPS) -> tuple[list[tuple[int, list[int]]], int, bool]:
    """Up to ``width`` undominated fillings of ``room`` as (waste, sizes), least
    waste first, with the steps used and whether some may be left out. A filling is
    dominated if one of its pieces could give way to a larger one that is left, or
    if another piece still fits."""
    found: list[tuple[int, list[int]]] = []
    picked: list[int] = []
    used = full = 0
    most, cut, n, upto, bit = room, False, left.n, left.upto, left.bit
    while True:
        while m := left.mask & upto[room if room < most else most]:
            if used == steps:
                cut = True
                break
            used += 1
            s = m.bit_length() - 1
            n[s] -= 1
            if not n[s]:
                left.mask ^= bit[s]
            picked.append(s)
            room, most = room - s, s
        if not cut and not left.largest(room) and not any(left.largest(f + room) > f for f in set(picked)):
            found.append((room, list(picked)))
            full += room == 0
            cut = full == width  # nothing better can be found
        while picked and not cut:
            s = picked.pop()
            n[s] += 1
            left.mask |= bit[s]
            filled, room, most = room == 0, room + s, s - 1
            if not filled and left.largest(min(room, most)):
                break  # if s fills the room, all that could stand for it fits into s
        else:
            break
    for s in picked:
        left.add(s)
        room += s
    if not found:  # the steps ended in the middle: complete greedily
        sizes, rest = [], room
        while s := left.largest(rest):
            left.take(s)
            sizes.append(s)
            rest -= s
        for s in sizes:
            left.add(s)
        found.append((rest, sizes))
    found.sort(key=lambda x: x[0])
    return found[:width], used, cut or len(found) > width


def lower_bound(sizes: list[int], capacity: int) -> int:
    """Bins that any packing needs (Martello and Toth's L2). For each small size a:
    pieces over half a bin take a bin each; those up to capacity - a leave room for
    pieces from a on; what these need beyond that room takes further bins."""
    w = np.sort(np.asarray(sizes, np.int64))
    sums = np.concatenate([[0], np.cumsum(w)])
    if not len(w):
        return 0
    half = int(np.searchsorted(w, capacity // 2, "right"))  # from here on over half a bin
    a = np.unique(np.concatenate([[0], w[:half]]))
    first = np.searchsorted(w, a)
    alone = np.maximum(np.searchsorted(w, capacity - a, "right"), half)
    need = sums[half] - sums[first] - ((alone - half) * capacity - (sums[alone] - sums[half]))
    return int((len(w) - half + np.maximum(0, -(-need // capacity))).max())


def bin_completion(sizes: list[int], capacity: int = CAPACITY, nodes: int | None = NODES, width: int = WIDTH, steps: int = STEPS) -> list[list[int]]:
    """Bins of sizes, in as few bins as the search finds; in the fewest if ``nodes`` is None."""
    sizes = sorted(sizes, reverse=True)
    best = best_fit(sizes, capacity)
    total = sum(sizes)
    bound = lower_bound(sizes, capacity)
    if len(best) <= bound:
        return best
    left, waste, spare = _Left(sizes, capacity), 0, (len(best) - 1) * capacity - total
    path: list[tuple[list[int], int, list]] = []  # a bin, its waste, and its other fillings
    nodes, unit, cut = float("inf") if nodes is None else nodes, steps, False

    def close(largest: int, options: list) -> None:
        nonlocal waste
        w, filling = options.pop(0)
        for s in filling:
            left.take(s)
        waste += w
        path.append(([largest, *filling], w, options))

    while nodes > 0:
        if waste <= spare and (largest := left.largest(capacity)):
            left.take(largest)
            options, used, some = fillings(left, capacity - largest, width, steps)
            nodes -= max(1, -(-used // unit))
            cut = cut or some
            close(largest, options)
            continue
        nodes -= 1
        if waste <= spare:
            best = [b for b, _, _ in path]
            if len(best) <= bound:
                break
            spare = (len(best) - 1) * capacity - total
        while path:  # back to the last bin that can be filled another way
            (largest, *filling), w, options = path.pop()
            for s in filling:
                left.add(s)
            waste -= w
            if options:
                close(largest, options)
                break
            left.add(largest)
        if not path:
            if not cut:
                break
            width, steps, cut = 4 * width, 4 * steps, False
    return best


def place(lengths: np.ndarray, capacity: int = CAPACITY, **limits) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) for each length; full ones take a bin each."""
    by_size: dict[int, list[int]] = {}
    for i, n in enumerate(lengths.tolist()):
        by_size.setdefault(n, []).append(i)
    bins = [[n] for n, rows in by_size.items() if n == capacity for _ in rows]
    bins += bin_completion([n for n in lengths.tolist() if n < capacity], capacity, **limits)
    bin_, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for b, filled in enumerate(bins):
        at = 0
        for n in filled:
            i = by_size[n].pop()
            bin_[i], offset[i] = b, at
            at += n
    return bin_, offset


def pack(pieces: DataFrame, blocks: int, capacity: int = CAPACITY, **limits) -> DataFrame:
    """``pieces`` with sequence_id and offset, packed in so many blocks; ``limits`` go
    to ``bin_completion``."""
    return _packed(pieces, F.pmod(F.xxhash64("doc_id", "piece", "salt"), F.lit(blocks)), 32, capacity, **limits)


def _packed(pieces: DataFrame, block: Column, bits: int, capacity: int, **limits) -> DataFrame:
    """``pieces`` packed block by block; a sequence's number is block * 2^bits + bin."""
    inner = ("salt", "part", "part_no", "chunks")
    names = [f.name for f in pieces.schema if f.name not in inner]
    key = block.alias("block")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema if f.name in names) + ", sequence_id long, offset long"

    def run(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["doc_id", "piece", "ids_crc32"], kind="stable", ignore_index=True)
        bin_, offset = place(block["length"].to_numpy(), capacity, **limits)
        return block[names].assign(sequence_id=(int(key[0]) << bits) + bin_, offset=offset)

    return pieces.select("*", key).groupBy("block").applyInPandas(run, schema)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, path: str | None = None, with_ids: bool = False, **limits) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32[, ids],
    sequence_id, offset.

    Null texts are empty; repeated rows and ids are packed row by row; a null id
    stays null; an empty table gives no rows. Other columns are not read. The
    input should be a written table, so that a retried task sees the same rows in
    the same order. ``limits`` of the search: nodes, width and steps.
    """
    blocks = max(1, -(-docs.count() // BLOCK_ROWS))
    return pack(token_pieces(docs, id_col, text_col, capacity, path, with_ids), blocks, capacity, **limits)


def pack_parts(docs: DataFrame, part: Column, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, path: str | None = None, with_ids: bool = False, **limits) -> DataFrame:
    """``pack_documents`` for each ``part`` (a string; null is a part of its own) apart:
    no sequence holds pieces of two parts, and sequence_id follows the parts in their
    order. A part of more than ``BLOCK_ROWS`` rows is dealt to blocks by hash. A part
    takes less than one sequence a block more than it needs."""
    sizes = docs.select(part.alias("part")).groupBy("part").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("chunks"))
    sizes = sizes.withColumn("part_no", F.row_number().over(Window.orderBy("part")) - 1)  # a row for each part
    pieces = token_pieces(docs, id_col, text_col, capacity, path, with_ids, part).join(sizes.withColumnRenamed("part", "_part"), F.col("part").eqNullSafe(F.col("_part"))).drop("_part")
    chunk = F.pmod(F.xxhash64("doc_id", "piece", "salt"), F.col("chunks"))
    return _packed(pieces, F.col("part_no").cast("long") * (1 << 16) + chunk, 24, capacity, **limits)
