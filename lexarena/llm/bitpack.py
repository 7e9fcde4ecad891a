"""Token ids in fixed-width bit-packed shards.

A shard is one binary value: header, document ids, document bounds, block offsets, blocks. Each block
packs up to `block` ids in the least number of bits that the vocabulary needs, first id in the highest
bits, and starts on a byte; the block offsets give random access, and numpy unpacks a block at once.
Shards are written by Spark as rows of a Parquet table (part, seq, doc ids, counts, data), so the
writer's commit protocol holds in every store and a lost executor leaves no half-written shard.
"""

from __future__ import annotations

import os
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, compress, count, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexarena.llm.common import few_texts

MAGIC = b"LXTS0001"
BLOCK = 1 << 14
SHARD_TOKENS = 1 << 22


def width(vocabulary: int) -> int:
    """Bits that hold every id of a vocabulary."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids in `bits` bits each, first id highest, padded to a byte; an id that needs more bits is refused."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"id {int(ids.max())} needs more than {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype(f">u{bits // 8}").tobytes()
    wide = np.unpackbits(ids.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)
    return np.packbits(wide[:, 32 - bits :]).tobytes()


def unpack(data: bytes | memoryview, bits: int, n: int) -> np.ndarray:
    """The n ids that pack() stored."""
    raw = np.frombuffer(data, np.uint8)
    if bits in (8, 16, 32):
        return raw[: n * bits // 8].view(f">u{bits // 8}").astype(np.uint32)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, 32 - bits :] = np.unpackbits(raw, count=n * bits).reshape(n, bits)
    return np.packbits(wide, axis=1).view(">u4").ravel().astype(np.uint32)


def write_shard(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, bits: int, block: int = BLOCK) -> bytes:
    """One shard of whole documents; a null doc_id is stored as the least 64-bit integer."""
    bounds = np.concatenate(([0], np.cumsum(lengths))).astype("<i8")
    least = np.iinfo(np.int64).min
    blocks = [pack(ids[i : i + block], bits) for i in range(0, len(ids), block)]
    offsets = np.concatenate(([0], np.cumsum([len(b) for b in blocks]))).astype("<i8")
    head = np.array([bits, block, len(doc_ids), len(ids)], "<i8")
    named = np.array([least if d is None else d for d in doc_ids], "<i8")
    return b"".join((MAGIC, head.tobytes(), named.tobytes(), bounds.tobytes(), offsets.tobytes(), *blocks))


class Shard:
    """Random access to the documents and tokens of one shard."""

    def __init__(self, data: bytes | memoryview):
        self.data = memoryview(data)
        if bytes(self.data[:8]) != MAGIC:
            raise ValueError("not a token shard")
        self.bits, self.block, self.n_docs, self.n_tokens = (int(x) for x in np.frombuffer(self.data[8:40], "<i8"))
        at = 40
        self.doc_ids = np.frombuffer(self.data, "<i8", self.n_docs, at)
        self.bounds = np.frombuffer(self.data, "<i8", self.n_docs + 1, at := at + 8 * self.n_docs)
        n_blocks = -(-self.n_tokens // self.block)
        self.offsets = np.frombuffer(self.data, "<i8", n_blocks + 1, at := at + 8 * (self.n_docs + 1))
        self.start = at + 8 * (n_blocks + 1)

    def tokens(self, first: int, last: int) -> np.ndarray:
        """Ids first to last (exclusive); only their blocks are unpacked."""
        if last <= first:
            return np.empty(0, np.uint32)
        low, high = first // self.block, (last - 1) // self.block
        parts = [
            unpack(self.data[self.start + self.offsets[b] : self.start + self.offsets[b + 1]], self.bits, min(self.block, self.n_tokens - b * self.block))
            for b in range(low, high + 1)
        ]
        return np.concatenate(parts)[first - low * self.block : last - low * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.tokens(int(self.bounds[i]), int(self.bounds[i + 1]))


_encoders: dict[str, Encoder] = {}


class Encoder:
    """The tokenizers library behind a cache of space-separated pieces.

    The byte-level pattern never lets a token reach over a single space into what precedes it, and a
    single line end between two words is a token. So where only single spaces and line ends separate
    words, a text may be cut before each space and around each line end, and a piece's ids don't depend
    on its neighbours. Pieces that are new are encoded together, one to a line. Texts with any other
    white space are encoded whole.
    """

    CACHE = 1 << 19

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one thread
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.line_end = self._plain("\n")
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = defaultdict(count().__next__)  # a new piece gets the next number
        self.lengths, self.starts, self.flat = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.uint32)
        self.known = self.used = 0
        self.alone = np.ones(1 << 16, bool)  # may be cut off from what stands around it
        self.index["\n"]
        self._add(["\n"], np.array([len(self.line_end)]), self.line_end)
        self.alone[self.index["\n"]] = len(self.line_end) == 1

    def _plain(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _learn(self) -> None:
        """Encode the pieces that the index has numbered since the last call."""
        k, end = self.known, len(self.index)
        pieces = list(islice(reversed(self.index), end - k))[::-1]
        alone = np.fromiter((len(w := p.split()) == 1 and len(w[0]) == len(p) - (p[:1] == " ") for p in pieces), bool, end - k)
        whole = list(compress(pieces, alone))
        ids = self._plain("\n".join(whole))
        breaks = np.append(np.flatnonzero(ids == self.line_end[0]), len(ids))
        if len(breaks) != len(whole):  # a token that takes the line end in
            found = [e.ids for e in self.tokenizer.encode_batch_fast(whole, add_special_tokens=False)]
            size, ids = np.array([len(f) for f in found], np.int64), np.array(list(chain.from_iterable(found)), np.uint32)
        else:
            size = np.diff(breaks, prepend=-1) - 1
            ids = np.delete(ids, breaks[:-1])
        every = np.zeros(end - k, np.int64)
        every[alone] = size
        self._add(pieces, every, ids)
        self.alone[k:end] = alone

    def _add(self, pieces: list[str], size: np.ndarray, ids: np.ndarray) -> None:
        """Store the ids of the next pieces."""
        k, end = self.known, self.known + len(pieces)
        while end > len(self.lengths):
            self.lengths, self.starts, self.alone = (np.concatenate((a, np.zeros(len(a), a.dtype))) for a in (self.lengths, self.starts, self.alone))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros(len(self.flat), np.uint32)))
        self.lengths[k:end] = size
        self.starts[k:end] = self.used + np.cumsum(size) - size
        self.flat[self.used : self.used + len(ids)] = ids
        self.known, self.used = end, self.used + len(ids)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if self.known > self.CACHE:
            self.clear()
        cut: list[np.ndarray | None] = []
        for text in texts:
            if "\0" in text:
                cut.append(None)
                continue
            pieces = text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
            cut.append(np.fromiter(map(self.index.__getitem__, pieces), np.int64, len(pieces)))
        if len(self.index) > self.known:
            self._learn()
        out: list[np.ndarray] = []
        for text, k in zip(texts, cut, strict=True):
            if k is None or not self.alone[k].all():
                out.append(self._plain(text))
                continue
            n = self.lengths[k]
            ends = np.cumsum(n)
            out.append(self.flat[np.arange(ends[-1]) + np.repeat(self.starts[k] - (ends - n), n)])
        return out


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker, kept between its tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int, vocabulary: int | None = None) -> None:
    """Tokenize docs (doc_id, text) and write their shards to path, in ascending doc_id order.

    Ids take the least bits that the vocabulary (None: the tokenizer's) and the end id need. A null text is
    empty and holds the end id alone; a null doc_id comes first; rows that repeat a doc_id are documents of
    their own, ordered by their texts' hash and text. A text of any length is one document of one shard; an
    empty table gives no shard. Extra columns aren't read.
    """
    if vocabulary is None:
        from tokenizers import Tokenizer

        vocabulary = Tokenizer.from_file(tokenizer).get_vocab_size()
    bits = width(max(vocabulary, end_id + 1))

    def run(batches: Iterator[pa.RecordBatch]):
        part, seq = TaskContext.get().partitionId(), 0
        enc = encoder(tokenizer)
        names, lengths, held = [], [], []

        def shard():
            nonlocal seq, names, lengths, held
            ids = np.concatenate(held)
            row = [[part], [seq], [names[0]], [names[-1]], [len(names)], [len(ids)], [write_shard(names, lengths, ids, bits)]]
            seq, names, lengths, held = seq + 1, [], [], []
            kinds = [pa.int64()] * 6 + [pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], names=COLUMNS)

        for batch in batches:
            for first in range(0, batch.num_rows, 64):
                some = batch.slice(first, 64)
                for name, ids in zip(some.column(0).to_pylist(), enc.encode(some.column(1).to_pylist()), strict=True):
                    names.append(name)
                    held.append(np.append(ids, np.uint32(end_id)))
                    lengths.append(len(held[-1]))
                if sum(lengths) >= SHARD_TOKENS:
                    yield shard()
        if names:
            yield shard()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")
    with few_texts(docs.sparkSession):
        rows.select("doc_id", "text").mapInArrow(run, SCHEMA).write.parquet(path)


COLUMNS = ["part", "seq", "first_doc", "last_doc", "n_docs", "n_tokens", "data"]
SCHEMA = ", ".join(f"{c} {'binary' if c == 'data' else 'long'}" for c in COLUMNS)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the shards at path."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part, seq, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                s = Shard(data.as_buffer())
                n = s.n_docs
                ids = s.tokens(0, s.n_tokens).astype("<u4")
                sums = [zlib.crc32(ids[a:b]) for a, b in zip(s.bounds[:-1], s.bounds[1:], strict=True)]
                named = pa.array(s.doc_ids, mask=s.doc_ids == np.iinfo(np.int64).min)
                cells = [np.full(n, part), np.full(n, seq), named, s.bounds[:-1], np.diff(s.bounds), np.array(sums, np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cells], names=["part", "seq", "doc_id", "at", "n_tokens", "ids_crc32"])

    shards = spark.read.schema(SCHEMA).parquet(path)
    docs = shards.select("part", "seq", "data").mapInArrow(run, "part long, seq long, doc_id long, at long, n_tokens long, ids_crc32 long")
    # the tokens before a shard: those of earlier parts (one row a part), and of earlier shards of its part
    before = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens")).select("part", before(Window.orderBy("part")).alias("base"))
    starts = shards.select("part", "seq", before(Window.partitionBy("part").orderBy("seq")).alias("within")).join(parts, "part")
    starts = starts.select("part", "seq", (F.col("base") + F.col("within")).alias("base"))
    return docs.join(starts, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
