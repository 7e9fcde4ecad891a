"""Best-fit-decreasing packing of tokenized documents into training sequences.

A task reads its documents once and packs them in groups of GROUP_TOKENS, so nothing is shuffled, no document
or source is a hot key, and memory is bounded by a group and the longest text. Of each document, full windows
are cut first; what remains goes, longest first, into the tightest open window that holds it, found in a
segment tree over remaining capacities. Windows that are still open when a group ends are filled from the
emptiest ones, whose pieces may be cut for it; the one that is left goes on to the next group. What a task
has at its end is cut along its binary digits, as a sequence whose length is a power of two needs no padding.
So no sequence is padded at all.

Sequences are rows of a Parquet table: ids packed in the vocabulary's bits, and the pieces they came from.
"""

from __future__ import annotations

import os
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexarena.llm.bitpack import pack, unpack, width
from lexarena.llm.common import text_slices

WINDOW = 2048
GROUP_TOKENS = 1 << 22
SLICE_BYTES = 1 << 22
Piece = tuple[int | None, int, np.ndarray, int]  # doc_id, ids of its document before it, ids, ids of its document


class Capacities:
    """A segment tree over remaining capacities 0 to `most`, which counts the open windows of each."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.tree = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(most + 1)]

    def _change(self, capacity: int, by: int) -> None:
        i = capacity + self.size
        while i:
            self.tree[i] += by
            i >>= 1

    def add(self, window: int, capacity: int) -> None:
        self.open[capacity].append(window)
        self._change(capacity, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(window, capacity) of the open window with the least capacity that is at least `need`, which is taken out."""
        tree, i = self.tree, need + self.size
        if not tree[i]:
            while i > 1 and (i & 1 or not tree[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i *= 2
                if not tree[i]:
                    i += 1
        capacity = i - self.size
        self._change(capacity, -1)
        return self.open[capacity].pop(), capacity


def best_fit_decreasing(pieces: list[Piece], window: int) -> list[list[Piece]]:
    """Pieces of at most `window` ids, longest first, each in the tightest window that holds it."""
    found: list[list[Piece]] = []
    tree = Capacities(window)
    for piece in sorted(pieces, key=lambda p: -len(p[2])):
        n = len(piece[2])
        at, left = tree.take(n) or (len(found), window)
        if at == len(found):
            found.append([])
        found[at].append(piece)
        if left > n:
            tree.add(at, left - n)
    return found


def _head(piece: Piece, n: int) -> tuple[Piece, Piece]:
    doc, start, ids, total = piece
    return (doc, start, ids[:n], total), (doc, start + n, ids[n:], total)


def fill(windows: list[list[Piece]], window: int) -> tuple[list[list[Piece]], list[Piece]]:
    """Full windows, and the pieces of at most one that isn't: the fullest are filled from the emptiest."""
    used = lambda w: sum(len(p[2]) for p in w)
    full = [w for w in windows if used(w) == window]
    short = sorted((w for w in windows if used(w) < window), key=used, reverse=True)
    low, high = 0, len(short) - 1
    while low < high:
        gap = window - used(short[low])
        while gap and low < high:
            piece = short[high].pop()
            if len(piece[2]) > gap:
                piece, rest = _head(piece, gap)
                short[high].append(rest)
            short[low].append(piece)
            gap -= len(piece[2])
            high -= not short[high]
        if not gap:
            full.append(short[low])
            low += 1
    left = short[low] if low == high else []
    if used(left) == window:
        full.append(left)
        left = []
    return full, left


def powers(pieces: list[Piece]) -> list[list[Piece]]:
    """The pieces cut into sequences whose lengths are the powers of two that their total is made of."""
    total, out = sum(len(p[2]) for p in pieces), []
    rest = pieces[::-1]
    for bit in range(total.bit_length() - 1, -1, -1):
        need, some = total & (1 << bit), []
        while need:
            piece = rest.pop()
            if len(piece[2]) > need:
                piece, more = _head(piece, need)
                rest.append(more)
            some.append(piece)
            need -= len(piece[2])
        if some:
            out.append(some)
    return out


class Words:
    """The tokenizers library behind a cache of what lies between spaces and line ends.

    For a tokenizer that drops white space and whose pattern looks at nothing but what it matches, ids don't
    depend on what stands beyond a space.
    """

    PIECES, CHARS = 1 << 20, 1 << 26

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one thread
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = defaultdict(count().__next__)  # a new piece gets the next number
        self.lengths, self.starts, self.flat = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.uint32)
        self.known = self.used = self.chars = 0

    def _learn(self) -> None:
        k, end = self.known, len(self.index)
        pieces = list(islice(reversed(self.index), end - k))[::-1]
        found = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        size = np.fromiter(map(len, found), np.int64, end - k)
        ids = np.fromiter(chain.from_iterable(found), np.uint32, int(size.sum()))
        while end > len(self.lengths):
            self.lengths, self.starts = (np.concatenate((a, np.zeros(len(a), a.dtype))) for a in (self.lengths, self.starts))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros(len(self.flat), np.uint32)))
        self.lengths[k:end], self.starts[k:end] = size, self.used + np.cumsum(size) - size
        self.flat[self.used : self.used + len(ids)] = ids
        self.known, self.used, self.chars = end, self.used + len(ids), self.chars + sum(map(len, pieces))

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text (no nulls); pieces are looked up once for each slice of SLICE_BYTES."""
        for first, last, _, _ in text_slices(texts, SLICE_BYTES):
            if self.known > self.PIECES or self.chars > self.CHARS:
                self.clear()
            some = texts.slice(first, last - first).cast(pa.large_string())
            split = pc.split_pattern(pc.replace_substring(some, "\n", " "), " ")
            coded = pc.list_flatten(split).dictionary_encode()
            pieces = coded.dictionary
            # what is ASCII may be lower-cased here, so that fewer pieces are new; special tokens are written in lower case
            plain = pc.and_(pc.string_is_ascii(pieces), pc.invert(pc.match_substring(pieces, "<|")))
            pieces = pc.if_else(plain, pc.ascii_lower(pieces), pieces).to_pylist()
            number = np.fromiter(map(self.index.__getitem__, pieces), np.int64, len(pieces))
            if len(self.index) > self.known:
                self._learn()
            n, starts = self.lengths[number], self.starts[number]
            at, bounds = coded.indices.to_numpy(), split.offsets.to_numpy()
            for low, high in zip(bounds[:-1] - bounds[0], bounds[1:] - bounds[0], strict=True):
                k = at[low:high]
                size = n[k]
                ends = np.cumsum(size)
                yield self.flat[np.arange(ends[-1]) + np.repeat(starts[k] - (ends - size), size)]


_words: dict[str, Words] = {}


def words(path: str) -> Words:
    """One encoder for each Python worker, kept between its tasks."""
    if path not in _words:
        _words[path] = Words(path)
    return _words[path]


COLUMNS = {"part": "long", "seq": "long", "n_tokens": "long", "doc_ids": "array<long>", "starts": "array<long>", "lengths": "array<long>", "doc_tokens": "array<long>", "bits": "int", "data": "binary"}
SCHEMA = ", ".join(f"{c} {k}" for c, k in COLUMNS.items())
_ARROW = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}


def pack_sequences(docs: DataFrame, path: str, tokenizer: str, end_id: int, window: int = WINDOW, group_tokens: int = GROUP_TOKENS) -> None:
    """Tokenize docs (doc_id, text) and write them as sequences of at most `window` ids to path.

    Every document ends with end_id. A null text is empty and holds the end id alone; a null doc_id stays
    null; rows that repeat a doc_id are documents of their own. A text of any length is cut into windows; an
    empty table gives no sequence. Extra columns aren't read.
    """
    from tokenizers import Tokenizer

    bits = width(max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1))

    def run(batches: Iterator[pa.RecordBatch]):
        part, numbers, out = TaskContext.get().partitionId(), count(), []

        def write(sequence: list[Piece]) -> None:
            doc, start, ids, total = zip(*sequence, strict=True)
            every = np.concatenate(ids)
            out.append((part, next(numbers), len(every), list(doc), list(start), list(map(len, ids)), list(total), bits, pack(every, bits)))

        def batch():
            cells = [pa.array(c, _ARROW[k]) for c, k in zip(zip(*out, strict=True), COLUMNS.values(), strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(cells, names=list(COLUMNS))

        enc, held, size = words(tokenizer), [], 0
        for rows in batches:
            for doc, ids in zip(rows.column(0).to_pylist(), enc.encode(rows.column(1)), strict=True):
                ids = np.append(ids, np.uint32(end_id))
                n, whole = len(ids), len(ids) // window * window
                for start in range(0, whole, window):
                    write([(doc, start, ids[start : start + window], n)])
                if n > whole:
                    held.append((doc, whole, ids[whole:].copy(), n))
                    size += n - whole
                if size >= group_tokens:
                    full, held = fill(best_fit_decreasing(held, window), window)
                    size = sum(len(p[2]) for p in held)
                    for w in full:
                        write(w)
                if len(out) >= 1024:
                    yield batch()
        full, left = fill(best_fit_decreasing(held, window), window)
        for w in [*full, *powers(left)]:
            write(w)
        if out:
            yield batch()

    docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(run, SCHEMA).write.parquet(path)


def sequences(spark: SparkSession, path: str) -> DataFrame:
    """The sequences at path with a sequence_id: their place when tasks and their sequences are counted in order."""
    held = spark.read.schema(SCHEMA).parquet(path)
    # one row a task that wrote: what earlier tasks have written
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = held.groupBy("part").agg(F.count("*").alias("n")).select("part", before.alias("base"))
    return held.join(F.broadcast(bases), "part").withColumn("sequence_id", F.col("base") + F.col("seq")).drop("base")


def read_pieces(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece, from the ids in the sequences at path."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            doc, start, length, total, crc, name, offset = ([] for _ in range(7))
            for sequence, n, docs, starts, lengths, totals, bits, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, at = unpack(data, bits, n).astype("<u4"), 0
                for size in lengths:
                    crc.append(zlib.crc32(ids[at : at + size]))
                    offset.append(at)
                    at += size
                doc += docs
                start += starts
                length += lengths
                total += totals
                name += [sequence] * len(docs)
            cells = [pa.array(c, pa.int64()) for c in (doc, start, length, crc, total, name, offset)]
            yield pa.RecordBatch.from_arrays(cells, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    held = sequences(spark, path).select("sequence_id", "n_tokens", "doc_ids", "starts", "lengths", "doc_tokens", "bits", "data")
    return held.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long")
