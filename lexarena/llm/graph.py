"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexarena.llm.common import discard, save

HELD = 500_000


def _contract(edges: DataFrame) -> DataFrame:
    """The edges with each partition's own components as stars around their smallest nodes; nothing moves.

    A task holds at most HELD nodes: beyond that it puts out the stars that it has and starts afresh.
    """

    def run(batches):
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (p := parent.setdefault(x, x)) != x:
                parent[x] = x = parent.setdefault(p, p)
            return x

        def stars():
            found = [(x, r) for x in list(parent) if (r := root(x)) != x]
            parent.clear()
            for i in range(0, len(found), 10_000):
                u, v = zip(*found[i : i + 10_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

        for batch in batches:
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = root(u), root(v)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            if len(parent) > HELD:
                yield from stars()
        yield from stars()

    return edges.mapInArrow(run, "u long, v long")


def _with_least(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs (u, v) with m, the least of u and its v's; the table of m).

    The table of m is written, so that both sides of the join are plain shuffles: Spark then splits a
    node that holds a large part of all pairs, or broadcasts m where it is small.
    """
    least = save(pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    return pairs.join(least, "u").select("u", "v", "m"), least


def _star(edges: DataFrame) -> DataFrame:
    """One large-star step then one small-star step over edges (u, v) with u > v, written as a table."""
    both, least = _with_least(edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))))
    large = save(both.where("v > u AND v > m").select(F.col("v").alias("u"), F.col("m").alias("v")), "large")
    small, low = _with_least(large)
    small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v")))
    out = save(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for t in (edges, least, large, low):
        discard(t)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node on an edge (u, v); the component is its smallest node.

    Each step is a table in the shared folder, so a lost executor costs one step; a step's table goes once the
    next is written. The loop ends once a step changes nothing: every node then points at the smallest
    node of its component.
    """
    edges = save(_contract(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))), "edges")
    sign = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    seen = sign(edges)
    while seen[0]:
        edges = _star(edges)
        found = sign(edges)
        if found == seen:
            break
        seen = found
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots.select("node", F.col("node").alias("component")))
