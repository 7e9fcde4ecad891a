import datetime
import json

import pytest
from pyspark.sql import functions as F

from lexarena.sources import readers, writers
from lexarena.streaming import metrics


def test_envelopes_isolate_bad_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"file_name_source": "a.pdf", "decisions": [{"n": 1}, {"n": "x"}]}))
    (tmp_path / "b.json").write_text("not json")
    (tmp_path / "c.json").write_text(json.dumps({"file_name_source": "c.pdf"}))
    good, bad = readers.read_envelopes(spark, str(tmp_path))
    assert sorted((r.file_name_source, len(r.decisions)) for r in good.collect()) == [("a.pdf", 2), ("c.pdf", 0)]
    assert bad.count() == 1


def test_missing_csv_is_empty(spark, tmp_path):
    assert readers.read_ratings_csv(spark, str(tmp_path / "none.csv")).count() == 0


def test_config(tmp_path):
    (tmp_path / "c.toml").write_text("[rating]\ntau = 0.1\n")
    assert readers.load_config(tmp_path / "c.toml")["rating"]["tau"] == 0.1
    assert readers.load_config()["rating"]["tau"] == pytest.approx(25 / 15)


def test_links_and_search(spark):
    html = '<a href="/x/20240724.pdf">a</a><a href=\'/x/20240725.pdf\'>b</a>'
    row = spark.range(1).select(readers.first_pdf_link(F.lit(html)).alias("a"), readers.first_pdf_link(F.lit(html), "20240725").alias("b"), readers.first_pdf_link(F.lit("")).alias("c")).first()
    assert tuple(row) == ("/x/20240724.pdf", "/x/20240725.pdf", None)
    items = readers.expected_items(spark, datetime.date(2024, 2, 27), datetime.date(2024, 3, 1)).withColumns({"title": F.lit("t"), "creator": F.lit("tjro")})
    assert [r.identifier for r in readers.search_items(items, "tjro", rows=2).collect()] == ["tjro-diario-2024-03-01", "tjro-diario-2024-02-29"]
    assert readers.existing_items(items, items.limit(1)).count() == 1
    courts = readers.Courts()
    courts.register("TJRO", object())
    assert "tjro" in courts
    with pytest.raises(ValueError, match="supported: tjro"):
        courts.get("x")


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, {"a": "b"})], "id int, m map<string,string>")
    assert writers.export_csv({"t": df}, str(tmp_path / "csv")) == {"t": "ok"}
    assert writers.export_parquet({"t": df, "e": df.limit(0)}, str(tmp_path / "pq")) == ["t"]
    target = writers.snapshot({"t": df}, str(tmp_path / "snap"), "v1", df.select(F.count("*").alias("n")))
    assert spark.read.parquet(f"{target}/t").count() == 1
    assert writers.bundle(target, str(tmp_path / "x.tar.gz")).endswith("x.tar.gz")
    archives = spark.createDataFrame([("weekly", 1)], "archive_type string, version int")
    assert writers.next_version(archives).first().next_version == 2


def test_streaming_metrics_equal_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    seen = []
    stream = metrics.event_metrics(metrics.read_stream(spark, str(tmp_path / "in"), events, files=10))
    metrics.run_available(stream, lambda df, _: seen.extend(df.collect()), str(tmp_path / "cp"), mode="complete")
    want = {(r.metric_start, r.event_type): r.n for r in metrics.event_metrics(events).collect()}
    assert {(r.metric_start, r.event_type): r.n for r in seen} == want


def test_new_files_are_processed_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"n": 1}')
    seen = []
    run = lambda: metrics.process_new_files(spark, str(tmp_path / "in"), "n int", lambda df, _: seen.extend(r.n for r in df.collect()), str(tmp_path / "cp"))
    run()
    (tmp_path / "in/b.json").write_text('{"n": 2}')
    run()
    assert seen == [1, 2]


def test_item_states(spark):
    df = spark.createDataFrame([("a", 1, "pending"), ("a", 2, "failed"), ("a", 3, "completed")], "k string, t int, s string")
    r = metrics.item_states(df, "k", ["t"], "s").first()
    assert (r.status, r.attempts, r.updated) == ("completed", 1, 3)
