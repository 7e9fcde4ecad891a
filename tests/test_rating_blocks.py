"""The rating fold by blocks and units against the plain fold."""

import random
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexarena.operators import rating
from lexarena.operators.rating_blocks import components, linked, rate_history_in_blocks, rate_sequence_in_blocks, units_of

SCHEMA = "court string, day int, n int, team_a array<string>, team_b array<string>, outcome string, weight double"


def _matches(spark, size=150, players=120, seed=5):
    rng, rows = random.Random(seed), []
    for n in range(size):
        some = [f"p{i}" for i in rng.sample(range(players), rng.choice([2, 2, 3]))]
        rows.append((rng.choice(["g", "h", None]), rng.choice([None, *range(40)]), n, some[:1], some[1:], rng.choice(sorted(rating.OUTCOMES)), rng.choice([None, 0.5, 2.0])))
    return spark.createDataFrame(rows, SCHEMA)


def _plain(rows):
    return sorted((tuple(str(x) if isinstance(x, str | None) else round(x, 9) for x in r) for r in rows), key=str)


def test_blocks_equal_the_plain_fold(spark):
    matches = _matches(spark)
    stored = spark.createDataFrame([("g", "p1", 30.0, 7.0, 4), ("g", "nobody", 1.0, 2.0, 3), (None, "p2", 28.0, 5.0, 2)], "court string, player string, mu double, sigma double, matches long")
    history, final = rate_history_in_blocks(matches, "court", ["day", "n"], stored, blocks=3)
    want = rating.rate_history(matches, "court", ["day", "n"], stored)
    assert history.columns == want.columns
    assert _plain(history.collect()) == _plain(want.collect())
    assert _plain(final.collect()) == _plain(rating.rate_sequence(matches, "court", ["day", "n"], stored=stored).collect())


def test_units_are_many_and_keep_the_order(spark):
    rows = units_of(_matches(spark), "court", ["day", "n"]).collect()
    last = {}
    for r in sorted(rows, key=lambda r: (r.day is None, r.day or 0, r.n)):
        assert r.block >= last.get("block", 0)
        last["block"] = r.block
    assert len(rows) == 150 and len({(r.block, r.unit) for r in rows}) > 10 * 3
    owner = {}
    for r in rows:  # a player of a court is in one unit of a block, a unit in one court
        for p in r.team_a + r.team_b:
            assert owner.setdefault((r.block, r.court, p), r.unit) == r.unit
        assert owner.setdefault((r.block, r.unit), r.court) == r.court


def test_one_player_in_every_match_and_empty_tables(spark):
    rows = [("g", 1, n, ["hot"], [f"p{n}"], "win_a", None) for n in range(12)]
    matches = spark.createDataFrame(rows, SCHEMA)
    history, final = rate_history_in_blocks(matches, "court", ["n"], blocks=2)
    assert history.count() == 24 and final.where("player = 'hot'").first().matches == 12
    history, final = rate_history_in_blocks(matches.where("n > 99"), "court", ["n"])
    assert history.count() == 0 and final.count() == 0


def test_components(spark):
    rng = random.Random(3)
    edges = [(b, rng.randrange(60), rng.randrange(60)) for b in (0, 1) for _ in range(35)] + [(2, i, i + 1) for i in range(40)] + [(3, 7, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for b, u, v in edges:
        low, high = sorted([find((b, u)), find((b, v))])
        parent[high] = low
    got = {(r.block, r.node): r.label for r in components(spark.createDataFrame(edges, "block int, u long, v long")).collect()}
    assert got == {x: find(x)[1] for x in list(parent)}


def test_weights(spark):
    side = "array<struct<mu:double,sigma:double>>"
    row = spark.createDataFrame([([(25.0, 8.0)], [(20.0, 5.0)], 2.0)], f"a {side}, b {side}, w double")
    one, two, none = row.select(*(rating.rate_teams(F.col("a"), F.col("b"), F.lit("win_b"), weight=w) for w in (None, F.col("w"), F.lit(0)))).first()
    assert two.a[0].mu - 25 == pytest.approx(2 * (one.a[0].mu - 25)) and two.b[0].sigma < one.b[0].sigma
    assert none.a[0].mu == 25 and none.a[0].sigma == pytest.approx((64 + rating.Model().tau ** 2) ** 0.5)


def test_final_ratings_alone_write_no_history(spark):
    matches = _matches(spark).withColumnRenamed("n", "number")
    stored = spark.createDataFrame([("g", "p1", 30.0, 7.0, 4), ("g", "nobody", 1.0, 2.0, 3), (None, "p2", 28.0, 5.0, 2)], "court string, player string, mu double, sigma double, matches long")
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(shared.glob("ratings-*"))
    final = rate_sequence_in_blocks(matches, "court", ["day", "number"], stored, blocks=3).collect()
    (folder,) = set(shared.glob("ratings-*")) - before
    assert _plain(final) == _plain(rating.rate_sequence(matches, "court", ["day", "number"], stored=stored).collect())
    assert (folder / "ratings").exists() and not (folder / "history").exists()


def test_a_task_links_its_players_before_spark_does(spark):
    """As many rows as players, not as many as players of matches; blocks stay apart."""
    rows = [(b, [10 * b + i % 4, 10 * b + (i + 1) % 4]) for b in (0, 1) for i in range(50)] + [(1, []), (1, [99])]
    found = linked(spark.createDataFrame(rows, "block int, _nodes array<long>").coalesce(1)).collect()
    assert sorted(tuple(r) for r in found) == [(0, 1, 0), (0, 2, 0), (0, 3, 0), (1, 11, 10), (1, 12, 10), (1, 13, 10)]


def test_lists_of_a_sliced_column():
    column = pa.array([[1, 2], [], [3], [4, 5]])
    assert rating.lists(column.slice(1, 2)) == [[], [3]] and rating.lists(pa.array([["x"], None])) == [["x"], None]
    assert rating.lists(pa.array([[1, None]])) == [[1, None]] and rating.values(pa.array([1.5, None])) == [1.5, None]
