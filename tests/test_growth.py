"""Work that must not grow faster than the tables: how often rows are walked, and over how many tasks."""

from pyspark.sql import Row
from pyspark.sql import functions as F

from lexarena.operators import rating
from lexarena.plans import catalogue
from lexarena.session import spread
from lexarena.sources import ingest
from lexarena.sources.tables import TableStore
from lexarena.streaming import items

DATA = "/root/testdata/sf0.001"


def test_migrated_rows_are_dealt_over_tasks(spark, tmp_path):
    """One file of one row group is read by one task, but not migrated by it."""
    spark.read.parquet(f"{DATA}/customer.parquet").crossJoin(spark.range(300)).withColumn("c_custkey", F.col("c_custkey") + 1000 * F.col("id")).drop("id").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    found = catalogue.QUERIES["migrated_decisions"](spark, str(tmp_path))
    assert found.rdd.getNumPartitions() >= 2 and found.count() == 45_000


def test_spread_keeps_its_rows(spark):
    rows = spark.range(1000).coalesce(1)
    dealt = spread(rows, "id", 100)
    assert dealt.rdd.getNumPartitions() == 10 and sorted(r.id for r in dealt.collect()) == list(range(1000))
    assert spread(rows.where("false"), "id", 100).count() == 0


def test_envelopes_are_walked_once(spark):
    plan = catalogue.QUERIES["typed_envelopes"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan


def test_records_are_asked_once_and_an_empty_run_commits_nothing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"n": 1}\n{"n": 2}\nnot json\n')
    asked = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def says(text):
        asked.add(1)
        return "two" if text == '{"n":2}' else None

    store = TableStore(spark, f"file://{tmp_path}/store")
    run = lambda: ingest.ingest(store, f"file://{tmp_path}/in", lambda r: says(F.to_json(r)))
    assert run() == {"pending": 1, "completed": 1, "failed": 0} and asked.value == 3
    assert run() == {"pending": 0, "completed": 0, "failed": 0} and store.version() == 1 and asked.value == 3
    assert [(r.records, r.valid) for r in store.read("files").collect()] == [(2, 1)] and [r.record for r in store.read("records").collect()] == ['{"n":1}']


def test_last_matches_are_those_of_the_history(spark):
    rows = [(f"c{n % 2}", n, [n % 7, 100 + n % 3], [10 + n % 5], ("win_a", "win_b", "draw")[n % 3]) for n in range(60)]
    matches = spark.createDataFrame(rows, "court string, n long, team_a array<long>, team_b array<long>, outcome string")
    stored = spark.createDataFrame([("c0", 1, 30.0, 5.0, 4), ("c0", 999, 30.0, 5.0, 4)], "court string, player long, mu double, sigma double, matches long")
    columns = ["court", "player", "mu_before", "sigma_before", "mu", "sigma", "matches"]
    want = {}
    for r in sorted(rating.rate_history(matches, "court", ["n"], stored, packed=False).collect(), key=lambda r: r.n):
        want[r.court, r.player] = tuple(r[c] for c in columns)
    assert sorted(tuple(r) for r in rating.last_matches(matches, "court", ["n"], stored).select(*columns).collect()) == sorted(want.values())


def test_an_item_of_a_batch_costs_three_calls_at_most_without_timers():
    calls, timers = [], []

    class Value:
        held = None

        def get(self):
            calls.append("get")
            return self.held

        def update(self, value):
            calls.append("update")
            self.held = value

    class Handle:
        def getValueState(self, *_):
            return Value()

        def listTimers(self):
            calls.append("list")
            return iter(timers)

        def deleteTimer(self, at):
            timers.remove(at)

        def registerTimer(self, at):
            timers.append(at)

    states = items.ItemStates(event_time=True)
    states.init(Handle())
    event = lambda status, second: Row(status=status, micros=second * 1_000_000, tie=0)
    send = lambda *events: [(r.status, r.attempts, r.updated.second) for r in states.handleInputRows(("a",), iter(events), None)]
    assert send(event("pending", 2), event("failed", 1)) == [("pending", 1, 2)] and calls == ["get", "update"]
    assert send(event("failed", 3)) == [("failed", 2, 3)] and calls[2:] == ["get", "update"] and timers == [7000]
    assert send(event("failed", 4)) == [("failed", 3, 4)] and calls[4:] == ["get", "update", "list"] and timers == [10_000]
    assert send(event("failed", 5)) == [("failed", 4, 5)] and timers == []
    assert send(event("done", 6)) == [("done", 4, 6)] and calls[-2:] == ["get", "update"]


def test_parts_of_a_replay_arrive_in_files_of_bounded_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(items, "FILE_ROWS", 10)
    events = spark.range(100).select((F.col("id") % 7).alias("item"), F.timestamp_seconds(F.col("id") + 1).alias("ts"), F.col("id").alias("tie"), F.lit("failed").alias("status"))
    found = items.replay_in_parts(events, f"file://{tmp_path}", key="item", time="ts", tie="tie", status="status")
    assert {(r.item, r.attempts) for r in found.collect()} == {(str(k), 15 if k < 2 else 14) for k in range(7)}
    files = list((tmp_path / "landing").glob("*.parquet"))
    assert len(files) == 12 and len(list((tmp_path / "checkpoint/offsets").glob("[0-9]"))) >= 4
