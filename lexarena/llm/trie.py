"""The trie of conversation prefixes, with subtree sums.

Turns are hashed where they are read, and only hashes travel. A prefix's digest chains the digest of the
prefix before it with the hash of its last turn: within blocks of BLOCK turns in parallel, then over the
blocks, so that a conversation of any length is dealt to many tasks. Prefixes with one depth and digest are
one node, named by its smallest member.

The nodes that a conversation names are the lower end of its own path: going down, members only go, so the
smallest only grows. A node's ancestors are therefore the prefixes of the conversation that names it, and
the nodes of one conversation are summed before they are exploded to them: a prefix above all of these nodes
gets their total, one among them the sum from there on. That makes one row a prefix, whatever the depth.

Running sums (turns before a turn, sums from a node on) are taken over sorted ranges of rows. At most one
conversation reaches over each border between two ranges, so what earlier ranges hold of it is a table of two
rows a range, which is broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexarena.llm.common import discard, save

BLOCK = 256
PIECE = 512
ROOT = hashlib.sha256(b"").digest()


def turn_hash(role: Column, text: Column) -> Column:
    """The SHA-256 of a turn; the role's length keeps (role, text) apart from other splits of one string."""
    return F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))


def running(df: DataFrame, group: str, order: list[Column], value: str, name: str) -> DataFrame:
    """df with `name`: the sum of `value` over the rows of a row's group (a long) up to itself, in order; written in between."""

    def run(batches: Iterator[pa.RecordBatch]):
        part = TaskContext.get().partitionId()
        last, carry = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            g, v = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in (group, value))
            total = np.cumsum(v)
            first = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
            base = total[first] - v[first]
            if g[0] == last:
                base[0] -= carry
            within = total - np.repeat(base, np.diff(np.append(first, len(g))))
            last, carry = g[-1], within[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(g), part, np.int64)), pa.array(within.astype(np.int64))], names=[*batch.schema.names, "_part", name])

    ranged = df.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    held = save(ranged.mapInArrow(run, f"{fields}, _part long, `{name}` long"), f"running-{name}")
    ends = held.groupBy("_part").agg(F.min(group).alias("_low"), F.max(group).alias("_high"))
    edges = ends.select("_part", F.explode(F.array_distinct(F.array("_low", "_high"))).alias(group))
    sums = held.join(F.broadcast(edges), ["_part", group]).groupBy("_part", group).agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("_part", group, F.sum("_sum").over(earlier).alias("_before")).where("_before IS NOT NULL")
    out = held.join(F.broadcast(before), ["_part", group], "left")
    return out.select(*df.columns, (F.col(name) + F.coalesce("_before", F.lit(0))).alias(name))


def rebuild(conversations: DataFrame, group_size: int = 100, shared_turns: int = 6) -> tuple[DataFrame, DataFrame]:
    """(rows, conversations) of conversations that share their first turns with the first of their group.

    Conversation c takes the first h turns of conversation c - c % group_size, then its own after its first
    h; h is crc32(c) % shared_turns. The rows are (conv_id, depth, turn, chars), from depth 1; the other
    table is (conv_id, length).
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("at"), turn_hash(role, text).alias("turn"), F.length(text).cast("long").alias("chars"), F.lit(1).cast("long").alias("one")
    )
    turns = running(turns, "conv_id", [F.col("at").asc_nulls_first(), F.col("turn")], "one", "pos")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % shared_turns
    base = F.col("conv_id") - F.col("conv_id") % group_size
    first = F.sort_array(F.collect_list(F.struct("pos", "turn", "chars")))  # fewer than shared_turns rows a group
    heads = turns.where(f"conv_id % {group_size} = 0 AND pos < {shared_turns}").groupBy(F.col("conv_id").alias("base")).agg(first.alias("head"))
    convs = turns.groupBy("conv_id").agg(F.max("pos").alias("n")).select("conv_id", "n", h.alias("h"), base.alias("base"))
    convs = convs.join(heads, "base", "left").withColumn("head", F.slice("head", 1, F.col("h").cast("int")))
    convs = save(convs.select("conv_id", "n", "h", F.coalesce(F.size("head"), F.lit(0)).alias("k"), "head").withColumn("k", F.greatest("k", F.lit(0))), "trie-conversations")
    lead = convs.select("conv_id", F.inline("head")).select("conv_id", F.col("pos").alias("depth"), "turn", "chars")
    own = turns.where(F.col("pos") > h).join(convs.select("conv_id", "h", "k"), "conv_id")
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("k")).alias("depth"), "turn", "chars")
    return lead.unionByName(own), convs.select("conv_id", (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))


def _link(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(conv_id, block, depth, chars, chained hash, the one before it in the block, whether the block ends here)."""
    held, state, before = None, b"", None
    for conv, block, depth, turn, chars in rows:
        if held is not None:
            ends = held[:2] != (conv, block)
            yield (*held, ends)
            if ends:
                state, before = b"", None
        before = state or None
        state = hashlib.sha256(state + turn).digest()
        held = (conv, block, depth, chars, state, before)
    if held is not None:
        yield (*held, True)


def _bases(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(conv_id, block, digest of all turns before the block) after each full block."""
    last, state = None, ROOT
    for conv, block, link in rows:
        state = hashlib.sha256((state if conv == last else ROOT) + link).digest()
        last = conv
        yield conv, block + 1, state


def _streamed(df: DataFrame, fn, kinds: dict[str, str]) -> DataFrame:
    """fn over the rows of each partition, in order, some thousands of rows in memory at a time."""
    arrow = {"long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "string": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]):
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        out: list[tuple] = []

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, arrow[k]) for c, k in zip(zip(*out, strict=True), kinds.values(), strict=True)], names=list(kinds))

        for row in fn(rows):
            out.append(row)
            if len(out) == 8192:
                yield batch()
                out.clear()
        if out:
            yield batch()

    return df.mapInArrow(run, ", ".join(f"{c} {k}" for c, k in kinds.items()))


def prefixes(rows: DataFrame) -> DataFrame:
    """(conv_id, depth, digest, parent, chars, ends) of every prefix of the conversations of rebuild()'s rows, from depth 1."""
    block = ((F.col("depth") - 1) / BLOCK).cast("long")
    dealt = rows.select("conv_id", block.alias("block"), "depth", "turn", "chars").repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "depth")
    links = save(_streamed(dealt, _link, {"conv_id": "long", "block": "long", "depth": "long", "chars": "long", "link": "binary", "before": "binary", "last": "boolean"}), "trie-links")
    full = links.where(f"last AND depth % {BLOCK} = 0")
    whole = full.select("conv_id", "block", "link").repartition("conv_id").sortWithinPartitions("conv_id", "block")
    bases = _streamed(whole, _bases, {"conv_id": "long", "block": "long", "base": "binary"})
    goes_on = links.where(f"block > 0 AND depth % {BLOCK} = 1").select("conv_id", (F.col("block") - 1).alias("block"), F.lit(True).alias("more"))
    stops = full.select("conv_id", "block", "depth").join(goes_on, ["conv_id", "block"], "left").where("more IS NULL").select("conv_id", "block", "depth", F.lit(True).alias("stops"))
    later = links.where("block > 0").join(bases, ["conv_id", "block"])
    all_ = links.where("block = 0").withColumn("base", F.lit(ROOT)).unionByName(later)
    chained = lambda c: F.unhex(F.sha2(F.concat("base", c), 256))
    out = all_.select("conv_id", "block", "depth", chained("link").alias("digest"), F.when(F.col("before").isNull(), F.col("base")).otherwise(chained("before")).alias("parent"), "chars", "last")
    cut = out.where(f"last AND depth % {BLOCK} = 0").join(stops, ["conv_id", "block", "depth"], "left").select("conv_id", "depth", "digest", "parent", "chars", F.coalesce("stops", F.lit(False)).alias("ends"))
    rest = out.where(f"NOT (last AND depth % {BLOCK} = 0)").select("conv_id", "depth", "digest", "parent", "chars", F.col("last").alias("ends"))
    kept = save(rest.unionByName(cut), "trie-prefixes")
    discard(links)
    return kept


def _pieces(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(digest, first id, ids joined) of at most PIECE ids of one node."""
    node, ids = None, []
    for digest, conv in rows:
        if ids and (digest != node or len(ids) == PIECE):
            yield node, ids[0], ",".join(map(str, ids))
            ids = []
        node = digest
        ids.append(conv)
    if ids:
        yield node, ids[0], ",".join(map(str, ids))


def _hashed(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(digest, SHA-256 of its pieces, comma-joined)."""
    node, state = None, None
    for digest, _, ids in rows:
        if digest != node:
            if state is not None:
                yield node, state.hexdigest()
            node, state = digest, hashlib.sha256(ids.encode())
        else:
            state.update(b"," + ids.encode())
    if state is not None:
        yield node, state.hexdigest()


def hash_members(ends: DataFrame) -> DataFrame:
    """(digest, ends_sha256) of (digest, conv_id): ids are joined piece by piece in sorted ranges, and a node's pieces pass one running hash."""
    ranged = ends.select("digest", "conv_id").repartitionByRange("digest", "conv_id").sortWithinPartitions("digest", "conv_id")
    pieces = _streamed(ranged, _pieces, {"digest": "binary", "first": "long", "ids": "string"})
    return _streamed(pieces.repartition("digest").sortWithinPartitions("digest", "first"), _hashed, {"digest": "binary", "ends_sha256": "string"})


def prefix_trie(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    rows are (conv_id, depth, turn, chars) with depths from 1 on without a gap, conversations (conv_id,
    length). Every conversation, even one without a turn, is a member of the root; without conversations
    there is no node. Equal prefixes are one node however often they come.
    """
    paths = prefixes(rows)
    keys = ["depth", "digest", "parent", "chars"]  # the last two follow from the digest
    found = paths.groupBy(*keys).agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"))
    root = conversations.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0")
    root = root.select(F.lit(0).cast("long").alias("depth"), F.lit(ROOT).alias("digest"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("chars"), "n_convs", "conv_id")
    found = save(found.unionByName(root), "trie-found")
    children = found.where("depth > 0").groupBy(F.col("parent").alias("digest")).agg(F.count("*").alias("n_children"))
    nodes = found.join(children, "digest", "left").withColumns({"n_children": F.coalesce("n_children", F.lit(0).cast("long")), "own": (F.col("n_convs") - 1) * F.col("chars")})
    nodes = save(nodes, "trie-nodes")

    # parents: at most a thousand nodes have a thousandth of all nodes as children, and these are broadcast
    total = nodes.count()
    named = lambda df, c: df.select(F.col("digest").alias("parent"), F.col("conv_id").alias(c))
    many = named(nodes.where(F.col("n_children") * 1000 >= total), "wide")
    few = named(nodes.where((F.col("n_children") * 1000 < total) & (F.col("n_children") > 0)), "narrow")
    below = nodes.join(F.broadcast(many), "parent", "left")
    near = below.where("wide IS NOT NULL OR parent IS NULL").withColumn("narrow", F.lit(None).cast("long"))
    far = below.where("wide IS NULL AND parent IS NOT NULL").join(few, "parent", "left")
    nodes_ = near.unionByName(far).withColumn("parent_conv_id", F.coalesce("wide", "narrow"))

    # subtree sums: what a conversation's nodes hold, exploded to all its prefixes
    held = nodes.groupBy("conv_id").agg(F.sum("own").alias("saved"), F.sum((F.col("n_children") == 0).cast("long")).alias("leaves"), F.min("depth").alias("top"))
    held = save(held.where("saved > 0 OR leaves > 0"), "trie-held")
    up = paths.select("conv_id", "depth", "digest").join(held, "conv_id")
    up = up.select("digest", F.when(F.col("depth") < F.col("top"), F.col("saved")).otherwise(F.lit(0)).alias("saved"), "leaves")
    at_root = held.groupBy(F.lit(ROOT).alias("digest")).agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    shared = running(nodes.where("n_convs > 1 AND depth > 0").select("conv_id", "depth", "digest", "own"), "conv_id", [F.col("depth").desc()], "own", "saved")
    sums = up.unionByName(shared.select("digest", "saved", F.lit(0).cast("long").alias("leaves"))).groupBy("digest").agg(F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves"))
    sums = sums.unionByName(at_root.select("digest", F.col("saved").alias("saved_tokens"), F.col("leaves").alias("n_leaves")))

    ends = paths.where("ends").select("digest", "conv_id").unionByName(conversations.where("length = 0").select(F.lit(ROOT).alias("digest"), "conv_id"))
    out = nodes_.join(sums, "digest").join(hash_members(ends), "digest", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def trie_of(conversations: DataFrame) -> DataFrame:
    """The prefix trie of the rebuilt conversations of (conv_id, turn, role, text).

    Turns are ordered by turn, null first, then by their hash; repeated rows are turns each. A null role or
    text is empty, of any length; a row without a conv_id belongs to no conversation. An empty table gives no
    node. Other columns, whatever their names, aren't read.
    """
    return prefix_trie(*rebuild(conversations))
