"""MinHash near-duplicates: banded candidates, odd sketches to weed them, full sets to confirm them.

A document's set holds the distinct hashes (64 bits) of its k-word shingles. Texts with one set are
one class and are handled once. MinHash samples make `bands` band keys of `rows` samples; a pair at
the least similarity meets in no band with probability (1 - 0.8**5)**40, about 1e-7. The same samples
fold into an odd sketch (Mitzenmacher, Pagh and Pham, 2014): a bitmap in which sample (i, value)
flips one bit, so the population count of two sketches' XOR estimates their similarity. A pair in a
band is verified on the full sets unless its estimate lies 6 standard deviations under the limit.

A second odd sketch folds the whole set instead of samples. Its XOR never counts more ones than the sets
differ in, and counts nearly all of them while they are few, so it tells 0.78 from 0.8.

No bucket is enumerated: each member meets one random member (the hub) of each of its buckets and tries
three of those that pass. Only members that stay in different components then meet each other, by pairs of blocks of a
bucket, in tasks that compare the whole-set sketches of many members at once and the first bucket that two share:
they put out little more than links, each once. Copies are one row per class.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexarena.llm.common import chain, mix, save, shingle_sets, text_slices
from lexarena.llm.graph import components

SKETCH_LONGS = 16
WHOLE_LONGS = 32
BLOCK = 1_000  # members of a bucket that a task compares with as many others
PAIRS = 1 << 15  # pairs of members that a task compares at once: their sketches take 24 MB
SLICE_ROWS = 1 << 10  # texts sketched at once: counting their bits takes 16 KB a text


def odd(row: np.ndarray, value: np.ndarray, rows: int, longs: int) -> np.ndarray:
    """Odd sketches of `rows` sets: each value of a row flips one of 64 * longs bits."""
    bits = 64 * longs
    flat = row * bits + (value % np.uint64(bits)).astype(np.int64)
    parity = (np.bincount(flat, minlength=rows * bits) & 1).astype(np.uint8).reshape(rows, bits)
    return np.packbits(parity, axis=1).view(np.uint64)


def signatures(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, s1, s2 (128 bits that name the set), bands, sketch, whole; one row per document."""
    samples = bands * rows
    rng = np.random.default_rng(6)
    mul = rng.integers(0, 1 << 32, samples, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
    add = rng.integers(0, 1 << 32, samples, dtype=np.uint64).astype(np.uint32)
    schema = "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>, sketch array<long>, whole array<long>"

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for first, last, raw, offs in text_slices(batch.column(1), rows=SLICE_ROWS):
                h, bounds = shingle_sets(raw, offs, k)
                size = np.diff(bounds)
                n, full = last - first, np.flatnonzero(size)
                s1, s2 = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
                keys, sketch = np.zeros((n, bands), np.uint64), np.zeros((n, SKETCH_LONGS), np.uint64)
                whole = odd(np.repeat(np.arange(n), size), mix(h ^ np.uint64(0x2545F4914F6CDD1D)), n, WHOLE_LONGS)
                if len(full):
                    at = bounds[:-1][full]
                    s1[full], s2[full] = np.add.reduceat(h, at), np.add.reduceat(mix(h ^ np.uint64(0x5851F42D4C957F2D)), at)
                    low = (h >> np.uint64(32)).astype(np.uint32)
                    least = np.empty((len(full), samples), np.uint32)
                    for j in range(samples):
                        least[:, j] = np.minimum.reduceat((low ^ add[j]) * mul[j], at)
                    wide = least.astype(np.uint64)
                    for b in range(bands):
                        keys[full, b] = chain([np.full(len(full), b, np.uint64), *(wide[:, b * rows + r] for r in range(rows))])
                    drawn = mix(wide + (np.arange(samples, dtype=np.uint64) << np.uint64(32)))
                    sketch[full] = odd(np.repeat(np.arange(len(full)), samples), drawn.ravel(), len(full), SKETCH_LONGS)
                lists = lambda a, w: pa.ListArray.from_arrays(pa.array(np.arange(0, n * w + 1, w, dtype=np.int32)), pa.array(a.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, n), pa.array(size), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), lists(keys, bands), lists(sketch, SKETCH_LONGS), lists(whole, WHOLE_LONGS)],
                    names=["doc_id", "n_shingles", "s1", "s2", "bands", "sketch", "whole"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def full_sets(docs: DataFrame, k: int) -> DataFrame:
    """doc_id and its whole shingle set, as sorted 64-bit hashes in a binary; only texts whose set is the one that s1 names."""

    def run(batches):
        for batch in batches:
            for first, last, raw, offs in text_slices(batch.column(1)):
                n = last - first
                h, bounds = shingle_sets(raw, offs, k)
                total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h, dtype=np.uint64)))
                named = (total[bounds[1:]] - total[bounds[:-1]]).view(np.int64) == batch.column(2).slice(first, n).to_numpy()
                cells = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(bounds * 8), pa.py_buffer(h)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), cells.cast(pa.binary())], names=["doc_id", "cells"]).filter(pa.array(named))

    return docs.select("doc_id", "text", "s1").mapInArrow(run, "doc_id long, cells binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets reach the similarity."""

    def run(batches):
        for batch in batches:
            hit = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                both = np.concatenate((x, y))
                both.sort(kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                hit.append(100 * shared >= percent * (len(both) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(hit, pa.bool_()))

    both = pairs.join(sets.select(F.col("doc_id").alias("u"), F.col("cells").alias("a")), "u")
    both = both.join(sets.select(F.col("doc_id").alias("v"), F.col("cells").alias("b")), "v")
    return both.select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def _alike(samples: int, percent: int, x: str, y: str) -> str:
    """SQL for: the sizes allow the similarity, and the sketches' XOR doesn't rule it out.

    With d differing samples of s, 2d bits flip; the expected count of ones is m/2 (1 - exp(-4d/m)).
    """
    m, least = 64 * SKETCH_LONGS, percent / 100
    low = least - 6 * (least * (1 - least) / samples) ** 0.5
    most = m / 2 * (1 - np.exp(-4 * samples * (1 - low) / m))
    ones = " + ".join(f"bit_count({x}.sketch[{i}] ^ {y}.sketch[{i}])" for i in range(SKETCH_LONGS))
    return f"100 * least({x}.n_shingles, {y}.n_shingles) >= {percent} * greatest({x}.n_shingles, {y}.n_shingles) AND {ones} <= {most:.1f}"


def _close(percent: int, x: str, y: str) -> str:
    """SQL for: the whole-set sketches allow the similarity.

    Linked sets of s hashes together differ in at most d = s (1 - t) / (1 + t) of them. The XOR's ones
    are at most d, and in large sets, where flips meet, at most their mean m q plus 6 deviations.
    """
    m = 64 * WHOLE_LONGS
    ones = " + ".join(f"bit_count({x}.whole[{i}] ^ {y}.whole[{i}])" for i in range(WHOLE_LONGS))
    d = f"(({x}.n_shingles + {y}.n_shingles) * {100 - percent} / {100.0 + percent})"
    q = f"((1 - exp(-2 * {d} / {m})) / 2)"
    sizes = f"100 * least({x}.n_shingles, {y}.n_shingles) >= {percent} * greatest({x}.n_shingles, {y}.n_shingles)"
    return f"{sizes} AND {ones} <= least({d} + 1e-6, {m} * {q} + 6 * sqrt({m} * {q} * (1 - {q})))"


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = 40, rows: int = 5, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each document; links join sets at percent similarity or more.

    A component is named by its smallest doc_id; kept marks that document. Null or empty texts, or
    texts without words, have no set and link with nothing. A null doc_id links with nothing either:
    its component is null and it is kept. Rows that repeat a doc_id are one document of that id: they
    share its component, and each row is returned. Extra columns of docs are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sig = save(signatures(docs, k, bands, rows), "signatures")
    some = sig.where("n_shingles > 0 AND doc_id IS NOT NULL")
    reps = some.groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("rep"), *(F.first(c).alias(c) for c in ("bands", "sketch", "whole")))
    reps = save(reps, "classes")
    member = reps.select("rep", "s1", F.explode("bands").alias("key"))
    hubs = member.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("rep", "key"), "rep"))["rep"].alias("hub")).where("n > 1")
    shared = save(member.join(hubs.select("key", "hub"), "key"), "buckets")
    slim = reps.select("rep", "n_shingles", "sketch", "whole")
    met = shared.where("rep <> hub").select(F.greatest("rep", "hub").alias("u"), F.least("rep", "hub").alias("v")).distinct()
    alike, close = F.expr(_alike(bands * rows, percent, "x", "y")), F.expr(_close(percent, "x", "y"))
    met = met.join(slim.select(F.col("rep").alias("u"), F.struct("n_shingles", "sketch", "whole").alias("x")), "u")
    met = met.join(slim.select(F.col("rep").alias("v"), F.struct("n_shingles", "sketch", "whole").alias("y")), "v")
    nodes = shared.select(F.col("rep").alias("doc_id"), "s1").distinct()
    sets = save(full_sets(docs.join(nodes, "doc_id"), k), "sets")

    # each class first tries up to three of the hubs it met: the least, the greatest and a random one
    some_of = F.array_distinct(F.array(F.min("v"), F.max("v"), F.max(F.struct(F.xxhash64("u", "v"), "v"))["v"]))
    tried = save(met.where(alike & close).groupBy("u").agg(some_of.alias("v")).select("u", F.explode("v").alias("v")), "tried")
    links = save(_confirmed(tried, sets, percent), "links")
    parts = components(links)

    # then members of one bucket meet across components
    rows_of = _labelled(shared.select("key", F.col("rep").alias("node")), parts)
    rest = _across(rows_of, reps.select(F.col("rep").alias("node"), "n_shingles", "whole", "bands"), percent, block)
    rest = save(rest.join(tried, ["u", "v"], "left_anti"), "rest")
    if not rest.isEmpty():
        stars = parts.where("node <> component").select(F.col("node").alias("u"), F.col("component").alias("v"))
        parts = components(stars.unionAll(_confirmed(rest, sets, percent)))

    class_of = _labelled(reps.select("s1", "s2", "n_shingles", F.col("rep").alias("node")), parts).withColumnRenamed("component", "component_id")
    # a doc_id with several rows joins the classes of all its rows
    twice = some.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    if not twice.isEmpty():
        class_of = _with_repeats(some, class_of, twice)
    out = sig.select("doc_id", "n_shingles", "s1", "s2").join(class_of.select("s1", "s2", "n_shingles", "component_id"), ["s1", "s2", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _across(rows: DataFrame, classes: DataFrame, percent: int, block: int) -> DataFrame:
    """(u, v) of members of one bucket (key, node, component) in different components whose sketches are close.

    Of two such members one at least is light: outside the bucket's largest component. So a bucket's members
    meet its light ones only, and both are dealt in blocks of about `block`: a pair of blocks, not a
    bucket, is what a task gets together, and a bucket of one component but for a few costs little.
    """
    parts = rows.groupBy("key", "component").agg(F.count("*").alias("n"))
    sizes = parts.groupBy("key").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.max_by("component", F.struct("n", "component")).alias("main")).where("n > most")
    cut = lambda n: F.ceil(F.col(n) / block).cast("int")
    sizes = sizes.select("key", "main", cut("n").alias("blocks"), F.ceil((F.col("n") - F.col("most")) / block).cast("int").alias("light_blocks"))
    members = rows.join(sizes, "key").join(classes, "node").withColumn("light", F.col("component") != F.col("main"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n, salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(n)).cast("int")
    kept = ("light", "node", "component", "n_shingles", "whole", "bands")
    x = members.select("key", own("blocks", 1).alias("i"), every("light_blocks").alias("j"), F.lit(True).alias("left"), *kept)
    y = members.where("light").select("key", every("blocks").alias("i"), own("light_blocks", 2).alias("j"), F.lit(False).alias("left"), *kept)
    met = x.unionAll(y).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def run(batches):
        held = None
        for batch in batches:
            now = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch]).combine_chunks()
            where = [now.column(c).to_numpy() for c in ("key", "i", "j")]
            new = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in where])) + 1
            starts = [0, *new.tolist()]
            yield from met_in(now, starts)  # the last pair of blocks may go on in the next batch
            held = now.slice(starts[-1])
        if held is not None and len(held):
            yield from met_in(held.combine_chunks(), [0, len(held)])

    def met_in(rows: pa.Table, bounds: list[int]):
        if len(bounds) < 2:  # no pair of blocks is whole yet
            return
        flat = lambda c: rows.column(c).chunk(0).flatten().to_numpy().reshape(len(rows), -1)
        whole, band = flat("whole").view(np.uint64), flat("bands")
        key, node, component, size = (rows.column(c).to_numpy() for c in ("key", "node", "component", "n_shingles"))
        left, light = (rows.column(c).to_numpy() for c in ("left", "light"))
        us, vs = [], []
        for first, last in zip(bounds, bounds[1:], strict=False):
            side = left[first:last]
            a, b = first + np.flatnonzero(side), first + np.flatnonzero(~side)
            step = max(1, PAIRS // max(1, len(b)))
            for at in range(0, len(a), step):
                p, q = a[at : at + step, None], b[None, :]
                # of two light members the smaller one meets the larger; a pair meets once, in the first bucket that it shares
                i, j = np.nonzero((component[p] != component[q]) & (~light[p] | (node[p] < node[q])) & (100 * np.minimum(size[p], size[q]) >= percent * np.maximum(size[p], size[q])))
                if not len(i):
                    continue
                p, q = p[i, 0], q[0, j]
                near = np.bitwise_count(whole[p] ^ whole[q]).sum(axis=1, dtype=np.int64) <= _most_ones(size[p] + size[q], percent)
                p, q = p[near], q[near]
                same = band[p] == band[q]
                met = same.any(axis=1) & (band[p, same.argmax(axis=1)] == key[p]) if len(p) else near[:0]
                us.append(np.maximum(node[p], node[q])[met])
                vs.append(np.minimum(node[p], node[q])[met])
        if us:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], names=["u", "v"])

    return met.mapInArrow(run, "u long, v long").distinct()


def _most_ones(sizes: np.ndarray, percent: int) -> np.ndarray:
    """The most ones of the XOR of whole-set sketches of linked sets with so many hashes together; as in _close."""
    m, d = 64 * WHOLE_LONGS, sizes * (100 - percent) / (100.0 + percent)
    q = (1 - np.exp(-2 * d / m)) / 2
    return np.minimum(d + 1e-6, m * q + 6 * np.sqrt(m * q * (1 - q)))


def _labelled(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """rows with the component of their node; a node without a link is its own."""
    return rows.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _with_repeats(some: DataFrame, class_of: DataFrame, twice: DataFrame) -> DataFrame:
    """Join the components that rows of one repeated doc_id fall into."""
    named = some.join(twice, "doc_id", "left_semi").join(class_of, ["s1", "s2", "n_shingles"])
    links = named.select(F.col("doc_id").alias("u"), F.col("component_id").alias("v"))
    merged = components(links).select(F.col("node").alias("component_id"), F.col("component").alias("merged"))
    return class_of.join(merged, "component_id", "left").withColumn("component_id", F.coalesce("merged", "component_id")).drop("merged")
