"""The ordered rating fold with many tasks inside one court: blocks of time, and in each the components of players.

A match reads the ratings that its players' earlier matches left, so over the whole history the players of a
court soon hang together, and the fold of a court is one task. Over a short stretch of time they don't: few
matches link few players. The order is therefore cut into blocks; the players of a block that its matches
link are a unit, and the units of a block are folded side by side. Each block hands the ratings of its
players to the block in which they play next.
"""

from __future__ import annotations

import math
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexarena.operators.rating import Model, lists, rate_history
from lexarena.sources.tables import Folder, shared_folder, written

LAST = -1  # the "next block" of players who play no more
PART = 200_000  # matches of a block that a task links
HELD = 500_000  # players that a task's links are held of at once


def linked(cut: DataFrame) -> DataFrame:
    """(block, u, v), u > v: players of one block that its matches (block, _nodes) link, as stars around each task's smallest players.

    A task puts out a row a player instead of one for each player of each match. It holds the links of
    one block at a time, and of about HELD players at most: then it puts out the stars that it has and starts afresh.
    """

    def run(batches):
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (p := parent.setdefault(x, x)) != x:
                parent[x] = x = parent.setdefault(p, p)
            return x

        def stars(block: int):
            found = [(x, r) for x in list(parent) if (r := root(x)) != x]
            parent.clear()
            for i in range(0, len(found), 10_000):
                u, v = zip(*found[i : i + 10_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(u), pa.int32()), pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["block", "u", "v"])

        now = None
        for batch in batches:
            for block, nodes in zip(batch.column(0).to_pylist(), lists(batch.column(1)), strict=True):
                if block != now or len(parent) > HELD:
                    yield from stars(now)
                    now = block
                if not nodes:
                    continue
                a = root(nodes[0])
                for x in nodes[1:]:
                    b = root(x)
                    if a != b:
                        a, b = min(a, b), max(a, b)
                        parent[b] = a
        yield from stars(now)

    return cut.select("block", "_nodes").mapInArrow(run, "block int, u long, v long")


def _stars(edges: DataFrame) -> DataFrame:
    """(block, u, v) of every node u but the smallest, v, of each component of edges (block, u, v) with u > v.

    Large and small stars in turn, until no edge changes: each node's larger neighbours, then its smaller
    ones, are hung onto its smallest neighbour. Minima are aggregated before the shuffle and written, so that Spark
    splits the join of a node with very many neighbours, which are never gathered in one place.
    """
    now, before = written(edges, "links"), None
    while True:
        both = now.unionAll(now.select("block", F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("block", "u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = written(both.where("v > u").join(least, ["block", "u"]).select("block", F.col("v").alias("u"), F.col("m").alias("v")), "large")
        down = written(large.groupBy("block", "u").agg(F.min("v").alias("m")), "least")
        small = large.join(down, ["block", "u"]).where("v <> m").select("block", F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(small.distinct().unionAll(down.select("block", "u", F.col("m").alias("v"))), "links")
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("block", "u", "v") % 1_000_003), F.bit_xor(F.xxhash64("block", "u", "v"))).first())
        if state == before:
            return now
        before = state


def components(edges: DataFrame) -> DataFrame:
    """(block, node, label) of every node in edges (block, u, v): label is the smallest node that it is linked with in its block.

    Edges of a node with itself are allowed. An empty table has no components.
    """
    nodes = edges.select("block", F.explode(F.array("u", "v")).alias("node")).distinct()
    found = _stars(edges.where("u <> v").select("block", F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    return nodes.join(found.select("block", F.col("u").alias("node"), F.col("v").alias("label")), ["block", "node"], "left").select("block", "node", F.coalesce("label", "node").alias("label"))


def units_of(matches: DataFrame, group: str, order: list[str], blocks: int | None = None) -> DataFrame:
    """matches with block (0 .. blocks - 1, ascending in order) and unit: what must be folded one after the other within the block.

    Without `blocks` there are as many as keep a block's links below half its players, from where on
    a random graph hangs together. Matches that are equal in order stay in one block. Null order columns come last.
    """
    sides = F.concat("team_a", "team_b")
    if blocks is None:
        links = matches.agg(F.coalesce(F.sum(F.greatest(F.size(sides) - 1, F.lit(0))), F.lit(0)).alias("n")).first()["n"]
        players = matches.select(group, F.explode(sides).alias("p")).distinct().count()
        blocks = max(1, math.ceil(2 * links / max(players, 1)))
    # a node stands for a player of a group; equal hashes of two players would only join their units
    nodes = F.array_sort(F.array_distinct(F.transform(sides, lambda p: F.xxhash64(F.col(group), p))))
    keys = [F.asc_nulls_last(c) for c in order]
    # several ranges a block, so that a block of any size is cut and linked by tasks of bounded rows
    parts = max(1, math.ceil(matches.count() / (blocks * PART)))
    cut = matches.repartitionByRange(blocks * parts, *keys).withColumn("block", F.floor(F.spark_partition_id() / parts).cast("int"))
    cut = written(cut.withColumn("_nodes", nodes), "blocks")
    first = F.get("_nodes", F.lit(0))
    labels = _stars(linked(cut)).select("block", F.col("u").alias("node"), F.col("v").alias("label"))
    # the group is part of the unit's name: players of two groups never share one
    name = F.concat_ws("/", F.coalesce("label", "node", F.lit(0)).cast("string"), F.coalesce(F.col(group).cast("string"), F.lit("")))
    joined = cut.withColumn("node", first).join(labels, ["block", "node"], "left")
    return joined.select("block", name.alias("unit"), *matches.columns)


def rate_history_in_blocks(matches: DataFrame, group: str, order: list[str], stored: DataFrame | None = None, model: Model = Model(), blocks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(history, final): the rows of rate_history and those of rate_sequence, folded by blocks and units.

    Results don't depend on `blocks`. A block is two jobs, which write its rows and its players' ratings to the
    shared folder; a rating is written once for each block in which its player plays, under the number of the
    block that reads it, so no block reads what other players have. A unit is one task's sorted stream, which holds the
    unit's players; one player in a third of all matches makes a unit of them, since each of the matches
    reads the rating that the one before it has left. Empty tables give empty ones (final has the stored players).
    """
    return _in_blocks(matches, group, order, stored, model, blocks, True)


def rate_sequence_in_blocks(matches: DataFrame, group: str, order: list[str], stored: DataFrame | None = None, model: Model = Model(), blocks: int | None = None) -> DataFrame:
    """final of rate_history_in_blocks for itself: a block's fold puts out its players at its end, a job a block, and no history."""
    return _in_blocks(matches, group, order, stored, model, blocks, False)[1]


def _in_blocks(matches: DataFrame, group: str, order: list[str], stored: DataFrame | None, model: Model, blocks: int | None, keep: bool) -> tuple[DataFrame | None, DataFrame]:
    spark, path = matches.sparkSession, f"{shared_folder(matches.sparkSession)}/ratings-{uuid.uuid4().hex}"
    order = [c for c in order if c != group]
    types = dict(matches.dtypes)
    kind, player = types[group], types["team_a"].removeprefix("array<").removesuffix(">")
    # the matches are counted, sampled and cut: they are made once for that
    dealt = units_of(written(matches, "matches"), group, order, blocks)
    dealt.write.partitionBy("block").parquet(f"{path}/matches")
    dealt = spark.read.schema(dealt.schema).parquet(f"{path}/matches")
    numbers = sorted(r["block"] for r in dealt.select("block").distinct().collect())  # as many as there are jobs
    plays = dealt.select("block", "unit", group, F.explode(F.concat("team_a", "team_b")).alias("player")).distinct()
    # all that a player's own rows say: a row for each block, never more than there are blocks
    then = lambda c: f"lead({c}) OVER (PARTITION BY {group}, player ORDER BY block)"
    plays = plays.select("*", F.expr(f"coalesce({then('block')}, {LAST})").alias("next"), F.expr(then("unit")).alias("next_unit"))
    plays.write.partitionBy("block").parquet(f"{path}/plays")
    plays = spark.read.schema(plays.schema).parquet(f"{path}/plays")
    columns = ["next", "next_unit", group, "player", "mu", "sigma", "matches"]
    ratings = f"next int, next_unit string, `{group}` {kind}, player {player}, mu double, sigma double, matches long"
    met = F.col(group).eqNullSafe(F.col("_g")) & F.col("player").eqNullSafe(F.col("_p"))

    def hand_on(found: DataFrame) -> None:
        found.select(*columns).write.mode("append").partitionBy("next").parquet(f"{path}/ratings")

    spark.createDataFrame([], ratings).write.parquet(f"{path}/ratings/next={LAST}/none")
    if stored is not None:
        start = plays.groupBy(group, "player").agg(F.min_by(F.struct("block", "unit"), "block").alias("s"))
        given = stored.select(F.col(group).cast(kind).alias(group), F.col("player").cast(player).alias("player"), "mu", "sigma", F.col("matches").cast("long").alias("matches"))
        given = given.join(start.withColumnsRenamed({group: "_g", "player": "_p"}), met, "left")
        hand_on(given.select(F.coalesce("s.block", F.lit(LAST)).alias("next"), F.col("s.unit").alias("next_unit"), group, "player", "mu", "sigma", "matches"))
    out = []
    for number in numbers:
        folder = f"{path}/ratings/next={number}"
        known = None
        if Folder(spark, folder).names():
            known = spark.read.schema(ratings.replace("next int, ", "")).parquet(folder).select(F.col("next_unit").alias("unit"), "player", "mu", "sigma", "matches")
        now = dealt.where(F.col("block") == number).drop("block")
        after = plays.where(F.col("block") == number)
        if keep:
            rows = rate_history(now, "unit", [group, *order], known, model, packed=False).drop("unit")
            rows.write.parquet(f"{path}/history/block={number}")
            rows = spark.read.schema(rows.schema).parquet(f"{path}/history/block={number}")
            out.append(f"{path}/history/block={number}")
            ends = rows.groupBy(group, "player").agg(F.max_by(F.struct("mu", "sigma", "matches"), "matches").alias("r")).select(group, "player", "r.*")
            after = after.select("next", "next_unit", F.col(group).alias("_g"), F.col("player").alias("_p"))
            hand_on(ends.join(after, met))
        else:  # a unit is one of a group, so the unit and the player tell the group
            ends = rate_history(now, "unit", order, known, model, final=True, packed=False)
            after = after.select("next", "next_unit", group, F.col("unit").alias("_u"), F.col("player").alias("_p"))
            hand_on(ends.join(after, (F.col("unit") == F.col("_u")) & F.col("player").eqNullSafe(F.col("_p"))))
    history = rate_history(matches.where("false"), group, order, None, model, packed=False) if keep else None
    if out:
        history = spark.read.schema(history.schema).parquet(*out)
    final = spark.read.schema(ratings.replace("next int, ", "")).option("recursiveFileLookup", "true").parquet(f"{path}/ratings/next={LAST}")
    return history, final.select(group, "player", "mu", "sigma", "matches")
