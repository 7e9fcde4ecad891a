"""What the operators share: tables, the shared folder, and byte-level word and shingle hashes."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

WORD = r"[^\x20\x09-\x0D]+"
SLICE_BYTES = 1 << 21


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, set here only for a local session without one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("on a cluster, set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.gettempdir()}/checkpoints/lexarena-{os.getuid()}"
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found


@contextmanager
def _setting(spark: SparkSession, name: str, value: str):
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def freeing(spark: SparkSession):
    """Queries that end in here delete their own shuffle files: what they wrote is what is read from then on."""
    return _setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def few_texts(spark: SparkSession):
    """Queries that end in here hand Python a thousand rows at once: ten thousand whole texts would stand in memory twice."""
    return _setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def save(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: the lineage ends in files every executor can reach."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with freeing(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that save() wrote and that nothing reads any more."""
    jvm = df.sparkSession.sparkContext._jvm
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


# ---- hashes of words and shingles, over the UTF-8 bytes of many texts at once

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = {"p": np.ones(1, np.uint64), "inv": np.ones(1, np.uint64)}


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        out = np.full(max(n, SLICE_BYTES), _P if kind == "p" else _P_INV, np.uint64)
        out[0] = 1
        _powers[kind] = np.multiply.accumulate(out)
    return _powers[kind][:n]


def text_slices(column: pa.Array, limit: int = SLICE_BYTES, rows: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets) of runs of at most `rows` rows with about limit bytes; a null text is empty, a text stays whole."""
    column = column.fill_null("").cast(pa.large_string())
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    first = 0
    while first < len(column):
        last = min(first + rows, max(first + 1, int(np.searchsorted(offs, offs[first] + limit, "right")) - 1))
        yield first, last, raw[offs[first] : offs[last]], offs[first : last + 1] - offs[first]
        first = last


def word_hashes(raw: np.ndarray, offs: np.ndarray, fold: bool = True, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of its text) of every word, in order; fold lower-cases A-Z. With most, only a word's first bytes, so many at most, are hashed."""
    n = len(raw)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    space = _SPACE[raw]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    before, after = edge[:n].copy(), edge[1:].copy()
    before[1:] |= space[:-1]
    after[:-1] |= space[1:]
    start, end = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    if most is not None:
        end = np.minimum(end, start + most)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(((_LOWER[raw] if fold else raw).astype(np.uint64) + np.uint64(1)) * _power("p", n), out=total[1:])
    h = mix((total[end] - total[start]) * _power("inv", n)[start])
    return h, np.searchsorted(offs, start, "right") - 1


def chain(parts: list[np.ndarray]) -> np.ndarray:
    """One hash of several hashes in order."""
    h = mix(parts[0] + np.uint64(len(parts)))
    for p in parts[1:]:
        h = mix(h * _P + p)
    return h


def shingle_sets(raw: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct k-word shingle hashes, bounds) of each text; fewer words make one shingle, no word makes none."""
    words, doc = word_hashes(raw, offs)
    texts = len(offs) - 1
    count = np.bincount(doc, minlength=texts)
    at = np.arange(len(words))
    parts, owner = [], []
    full = at[: max(0, len(words) - k + 1)]
    full = full[doc[full] == doc[full + k - 1]] if len(full) else full
    parts.append(chain([words[full + j] for j in range(k)]) if len(full) else np.empty(0, np.uint64))
    owner.append(doc[full])
    starts = np.cumsum(count) - count
    for size in range(1, k):
        short = np.flatnonzero(count == size)
        if len(short):
            parts.append(chain([words[starts[short] + j] for j in range(size)]))
            owner.append(short)
    h, doc = np.concatenate(parts), np.concatenate(owner)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=texts)))).astype(np.int64)
