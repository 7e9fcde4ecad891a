"""Versioned tables, the item stream, file intake, typed validation and the listing source."""

import datetime
import json
import threading

import pytest
from pyspark.sql import functions as F

from lexarena.operators import typed
from lexarena.sources import ingest, listing_source, readers
from lexarena.sources.tables import Conflict, TableStore, once
from lexarena.streaming import items, metrics


@pytest.fixture
def store(spark, tmp_path):
    return TableStore(spark, f"file://{tmp_path}/store")


def numbers(df):
    return sorted(r[0] for r in df.collect())


def test_versions_conflicts_and_time_travel(spark, store):
    assert store.version() == 0 and store.tables() == []
    with pytest.raises(KeyError):
        store.read("a")
    assert store.commit({"a": ("replace", spark.range(3))}) == 1
    assert store.commit({"a": ("append", spark.range(3, 5)), "b": ("append", spark.range(1))}) == 2
    with pytest.raises(Conflict):
        store.commit({"a": ("replace", spark.range(9))}, expected=1)
    assert numbers(store.read("a")) == [0, 1, 2, 3, 4] and numbers(store.read("a", 1)) == [0, 1, 2]
    with pytest.raises(ValueError, match="schema"):
        store.commit({"a": ("append", spark.range(1).selectExpr("cast(id as string) AS id"))})
    with pytest.raises(ValueError, match="mode"):
        store.commit({"a": ("merge", spark.range(1))})
    assert store.commit({"a": ("append", spark.range(0))}) == 3  # no rows, still a version
    assert store.restore(1) == 4 and numbers(store.read("a")) == [0, 1, 2]
    assert store.compact("a", 1) == 5 and numbers(store.read("a")) == [0, 1, 2]
    got = {(r.version, r.table): (r.rows, r.written) for r in store.history().collect()}
    assert got == {(1, "a"): (3, 3), (2, "a"): (5, 2), (2, "b"): (1, 1), (3, "a"): (5, 0), (3, "b"): (1, 0), (4, "a"): (3, 0), (5, "a"): (3, 3)}


def test_a_writer_that_dies_is_never_seen(spark, store, tmp_path):
    store.commit({"a": ("replace", spark.range(3))})
    (tmp_path / "store/versions/.draft-dead").write_text('{"version": 2, "tab')  # died while it wrote a version
    spark.range(7).write.parquet(f"file://{tmp_path}/store/data/a/dead")  # died before it wrote one
    assert store.version() == 1 and numbers(store.read("a")) == [0, 1, 2]
    assert store.unnamed() == ["a/dead"]
    assert store.commit({"a": ("append", spark.range(3, 4))}) == 2


def test_of_two_writers_at_a_time_both_count_once(spark, store):
    store.commit({"a": ("replace", spark.range(1))})
    gate, errors = threading.Barrier(2), []

    def add(n):
        try:
            gate.wait()
            store.retry(lambda _: {"a": ("append", spark.range(n, n + 1))}, batch=(f"w{n}", 0))
        except Exception as error:  # noqa: BLE001
            errors.append(error)

    workers = [threading.Thread(target=add, args=(n,)) for n in (10, 20)]
    [w.start() for w in workers]
    [w.join() for w in workers]
    assert not errors and numbers(store.read("a")) == [0, 10, 20] and store.version() == 3


def test_a_replayed_batch_changes_nothing(spark, store):
    sink = once(store, "w", lambda rows, number: {"a": ("append", rows.withColumn("n", F.lit(number)))})
    sink(spark.range(2), 0)
    sink(spark.range(2), 0)
    sink(spark.range(2), 1)
    sink(spark.range(2), 0)
    assert store.version() == 2 and store.read("a").count() == 4


EVENT = "item string, ts timestamp, tie long, status string"


def events_of(rows):
    at = datetime.datetime(2024, 1, 1)
    return [(i, at + datetime.timedelta(seconds=s), t, x) for i, s, t, x in rows]


def put(spark, folder, rows):
    spark.createDataFrame(events_of(rows), EVENT).coalesce(1).write.mode("append").parquet(folder)


def test_item_stream_restarts_after_a_crash_and_equals_the_batch(spark, store, tmp_path):
    folder, rows = f"{tmp_path}/in", []
    for part in range(3):
        some = [(f"i{i % 5}", 10 * ((7 * i + part) % 9), i + 10 * part, ["pending", "failed", "completed"][(i + part) % 3]) for i in range(10)]
        some += [(None, 1, 1, "failed"), ("null", 5, 5, None)]
        rows += some
        put(spark, folder, some)
    like = spark.createDataFrame([], EVENT)
    stream = lambda: items.item_stream(metrics.read_stream(spark, folder, like), "item", "ts", "tie", "status", late=items.NEVER_LATE)
    tries = []

    def crash(stream, sink, checkpoint, mode):
        def dies(df, number):
            sink(df, number)
            tries.append(number)
            if number == 1:
                raise RuntimeError("died after the commit, before the checkpoint")

        return metrics.run_available(stream, dies, checkpoint, mode)

    with pytest.raises(Exception, match="died"):
        items.follow_items(store, "states", stream(), f"{tmp_path}/cp", run=crash)
    before = store.version()
    items.follow_items(store, "states", stream(), f"{tmp_path}/cp")
    assert tries == [0, 1] and store.version() > before
    batch = spark.createDataFrame(events_of([(i or "", s, t, x or "") for i, s, t, x in rows]), EVENT)
    want = {(r.item, r.status, r.attempts) for r in metrics.item_states(batch, "item", ["ts", "tie"], "status").collect()}
    assert {(r.item, r.status, r.attempts) for r in items.last_states(store, "states").collect()} == want


def test_retry_timers_fire_when_the_wait_is_over(spark, store, tmp_path):
    folder, like = f"{tmp_path}/in", spark.createDataFrame([], EVENT)
    run = lambda: items.follow_items(store, "s", items.item_stream(metrics.read_stream(spark, folder, like), "item", "ts", "tie", "status", late="0 seconds"), f"{tmp_path}/cp")
    put(spark, folder, [("a", 0, 1, "failed"), ("b", 0, 1, "failed"), ("c", 0, 1, "failed"), ("d", 0, 1, "failed"), ("d", 0, 2, "failed"), ("d", 0, 3, "failed"), ("d", 0, 4, "failed")])
    run()
    put(spark, folder, [("b", 1, 2, "completed"), ("clock", 1, 1, "pending")])
    run()
    assert store.read("s").where("kind = 'retry'").count() == 0
    put(spark, folder, [("clock", 60, 2, "pending")])
    run()
    retries = store.read("s").where("kind = 'retry'").collect()
    assert {(r.item, r.attempts, r.delay) for r in retries} == {("a", 1, 2.0), ("c", 1, 2.0)}  # b went on, d failed too often


def test_files_are_taken_in_once(spark, store, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text('{"n": 1}\n{"n": null}\nnot json\n')
    (folder / "b.json").write_text("not json\n")
    (folder / "c.json").write_text("")
    reason = lambda r: F.when(F.try_variant_get(r, "$.n", "int").isNull(), "no n")
    run = lambda **o: ingest.ingest(store, f"file://{folder}", reason, **o)
    assert run(dry_run=True) == {"pending": 2, "completed": 1, "failed": 1} and store.version() == 0  # c.json has no byte
    assert run() == {"pending": 2, "completed": 1, "failed": 1}
    assert [json.loads(r.record) for r in store.read("records").collect()] == [{"n": 1}]
    assert {(r.path[-6:], r.records, r.valid, r.status) for r in store.read("files").collect()} == {("a.json", 2, 1, "completed"), ("b.json", 0, 0, "failed")}
    (folder / "b.json").write_text('{"n": 2}\n')
    (folder / "c.json").write_text('{"m": 2}\n')
    (folder / "d.json").write_text('{"n": 3}\n{"n": 3}\n')
    assert run() == {"pending": 3, "completed": 2, "failed": 1}
    assert sorted(json.loads(r.record)["n"] for r in store.read("records").collect()) == [1, 2, 3, 3]
    assert run() == {"pending": 1, "completed": 0, "failed": 1}
    assert store.read("records").count() == 4 and store.read("files").count() == 4


def test_of_two_intakes_at_a_time_one_is_told(spark, store, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"n": 1}\n')

    def late(spark, folder):
        if not store.version():
            ingest.ingest(store, folder, lambda r: F.lit(None).cast("string"))
        return ingest.json_lines(spark, folder)

    with pytest.raises(Conflict):
        ingest.ingest(store, f"file://{tmp_path}/in", lambda r: F.lit(None).cast("string"), read=late)
    assert store.read("records").count() == 1


DECISION = {"numero_processo": "1", "resultado": "x", "data_decisao": "2024-02-29"}
WHOLE = {"file_name_source": "a", "extraction_timestamp": "2024-01-01T00:00:00", "decisions": [DECISION], "chunks_processed": 1, "total_decisions_found": 1}


@pytest.mark.parametrize(
    ("change", "fault"),
    [
        ({}, None), ({"more": [1]}, None), ({"decisions": []}, None), ({"chunks_processed": "12"}, None), ({"chunks_processed": 2.0}, None), ({"extraction_timestamp": 1700000000}, None),
        ({"chunks_processed": True}, "$.chunks_processed: not a int"), ({"chunks_processed": "x"}, "$.chunks_processed: not a int"), ({"file_name_source": 5}, "$.file_name_source: not a string"),
        ({"decisions": {}}, "$.decisions: not a list"), ({"decisions": None}, "$.decisions: null"), ({"decisions": [DECISION, "x"]}, "$.decisions[1]: not an object"),
        ({"decisions": [DECISION | {"tipo_decisao": None, "resumo": "r"}]}, None), ({"decisions": [DECISION | {"tipo_decisao": 1}]}, "$.decisions[0].tipo_decisao: not a string"),
        ({"decisions": [DECISION | {"polo_ativo": None}]}, "$.decisions[0].polo_ativo: null"), ({"decisions": [DECISION | {"polo_ativo": ["a", 1]}]}, "$.decisions[0].polo_ativo[1]: not a string"),
        ({"decisions": [DECISION | {"data_decisao": "2023-02-29"}]}, "$.decisions[0].data_decisao: not a date"), ({"decisions": [DECISION | {"data_decisao": "2024-01-01T00:00:00"}]}, None),
        ({"decisions": [{k: v for k, v in DECISION.items() if k != "resultado"}, {}]}, "$.decisions[0].resultado: missing"),
    ],
)
def test_first_fault(spark, change, fault):
    got = spark.createDataFrame([(json.dumps(WHOLE | change),)], "d string").select(typed.first_fault(F.parse_json("d"), typed.ENVELOPE).alias("f")).first().f
    assert got == fault


def test_documents_that_are_not_json_are_rejected(spark):
    docs = spark.createDataFrame([(1, json.dumps(WHOLE)), (2, "{"), (3, None), (4, "null"), (5, "")], "k int, d string")
    good, bad = typed.split_typed(docs, "d")
    assert [r.k for r in good.collect()] == [1]
    assert {r.k: r.fault for r in bad.collect()} == {2: "$: not JSON", 3: "$: not JSON", 4: "$: null", 5: "$: not JSON"}


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    folder = f"file://{tmp_path_factory.mktemp('archive')}/l"
    day = lambda i: datetime.date(2020 + i % 4, 1 + i % 12, 1 + i % 28) if i % 10 else None
    rows = [(f"i{i:03}", f"t\n{i}", day(i), ["a", "b", None][i % 3], ["x", "y"][i % 2]) for i in range(200)]
    df = spark.createDataFrame(rows, "identifier string, title string, date date, creator string, collection string")
    listing_source.write_archive(df, folder)
    return df, folder


def test_listing_source_equals_the_batch_search(spark, archive):
    df, folder = archive
    start, end = datetime.date(2021, 3, 1), datetime.date(2022, 6, 30)

    def same(search, **bounds):
        return [tuple(r) for r in search(listing_source.read_archive(spark, folder, **bounds)).collect()] == [tuple(r) for r in search(df).collect()]

    assert same(lambda x: x.orderBy("identifier"))
    assert same(lambda x: readers.search_items(x, "a", start=start, end=end), creator="a", start=start, end=end)
    assert same(lambda x: readers.search_items(x, "b", year_from=2021, year_to=2022, rows=7), creator="b", start=datetime.date(2021, 1, 1), end=datetime.date(2022, 12, 31))
    assert same(lambda x: readers.collection_items(x, "x", rows=20), collection="x")
    assert same(lambda x: readers.search_items(x, "zz"), creator="zz")
    items_ = listing_source.read_archive(spark, folder)  # one frame, many queries
    for where in ("creator = 'a'", "date IS NULL OR creator = 'b'", f"date > '{start}'", "creator IS NULL AND title LIKE 't%'", "true"):
        assert items_.where(where).count() == df.where(where).count()


def test_listing_reader_takes_a_partition_a_year(archive):
    _, folder = archive
    years = lambda **o: [p.year for p in listing_source.ListingReader({"path": folder} | o).partitions()]
    assert years() == [0, 2020, 2021, 2022, 2023] and years(creator="a") == years()
    assert years(start="2021-12-31", end="2022-01-01") == [2021, 2022] and years(end="2020-06-01") == [0, 2020]
    assert years(start="2030-01-01") == [0]  # one empty partition


def test_listing_lines_that_are_no_items_are_left_out(spark, tmp_path):
    (tmp_path / "year=2020").mkdir()
    (tmp_path / "year=2020/a.json").write_text('{"identifier": "a", "date": "2020-01-02T03:04:05", "title": {"x": 1}}\nnope\n[1]\n\n{"identifier": 5, "date": "soon"}')
    (tmp_path / "year=2020/note.txt").write_text('{"identifier": "no"}')
    got = listing_source.read_archive(spark, f"file://{tmp_path}").collect()
    assert sorted((r.identifier, r.title, r.date) for r in got) == [("5", None, None), ("a", '{"x": 1}', datetime.date(2020, 1, 2))]


def test_json_lines_keep_their_path(spark, tmp_path):
    (tmp_path / "a b.json").write_text('{"n": 1}\n')
    path = f"file://{tmp_path}"
    assert {r.path for r in ingest.json_lines(spark, path).collect()} == {r.path for r in ingest.files_of(spark, path).collect()}
