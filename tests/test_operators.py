import datetime
import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lexarena.functions.text import normalize_lawyer_name
from lexarena.operators import anonymize, listings, queues, rating, standardize, validate

V = 25.0 / 15
CASES = [
    (0.0, "win_a", (27.635231, 8.065506), (22.364769, 8.065506)),
    (V, "win_a", (27.697815, 8.221999), (22.302185, 8.221999)),
    (V, "win_b", (22.302185, 8.221999), (27.697815, 8.221999)),
    (V, "draw", (25.0, 8.221999), (25.0, 8.221999)),
    (V, "partial_a", (27.646367, 8.093336), (22.353633, 8.093336)),
    (25.0 / 300, "win_a", (27.635389, 8.065901), (22.364611, 8.065901)),
]


def rate(spark, a, b, outcome, tau):
    row = spark.createDataFrame([(a, b, outcome)], "a array<struct<mu:double,sigma:double>>, b array<struct<mu:double,sigma:double>>, o string")
    return row.select(rating.rate_teams(F.col("a"), F.col("b"), F.col("o"), rating.Model(tau=tau)).alias("r")).first().r


@pytest.mark.parametrize("tau,outcome,a,b", CASES)
def test_one_on_one(spark, tau, outcome, a, b):
    prior = [(25.0, 25.0 / 3)]
    r = rate(spark, prior, prior, outcome, tau)
    assert tuple(r.a[0]) == pytest.approx(a, abs=1e-6) and tuple(r.b[0]) == pytest.approx(b, abs=1e-6)


def test_two_on_two(spark):
    r = rate(spark, [(25.0, 8.0), (30.0, 7.0)], [(20.0, 9.0), (22.0, 8.0)], "win_a", V)
    assert [tuple(x) for x in r.a] == [pytest.approx((26.232576, 8.048424), abs=1e-6), pytest.approx((30.955708, 7.111609), abs=1e-6)]
    assert [tuple(x) for x in r.b] == [pytest.approx((18.45364, 8.957077), abs=1e-6), pytest.approx((20.767424, 8.032636), abs=1e-6)]


def test_unknown_outcome_raises(spark):
    with pytest.raises(PySparkException):
        rate(spark, [(25.0, 8.0)], [(25.0, 8.0)], "lost", V)


def test_sequence_is_an_ordered_fold(spark):
    rows = [("g", 2, [1], [2], "win_b"), ("g", 1, [1], [2], "win_a"), ("h", 1, [9], [8], "draw")]
    df = spark.createDataFrame(rows, "court string, n int, team_a array<long>, team_b array<long>, outcome string")
    got = {(r.court, r.player): r for r in rating.rate_sequence(df, "court", ["n"]).collect()}
    first = rate(spark, [(25.0, 25.0 / 3)], [(25.0, 25.0 / 3)], "win_a", V)
    then = rate(spark, [tuple(first.a[0])], [tuple(first.b[0])], "win_b", V)
    assert (got["g", 1].mu, got["g", 1].sigma) == pytest.approx(tuple(then.a[0]))
    assert got["g", 2].matches == 2 and got["h", 9].mu == pytest.approx(25.0) and len(got) == 4
    assert rating.rate_sequence(df.where("n > 5"), "court", ["n"]).count() == 0


def test_history_starts_from_stored_ratings(spark):
    rows = [("g", 2, [1], [2], "win_b"), ("g", 1, [1], [2], "win_a")]
    df = spark.createDataFrame(rows, "court string, n int, team_a array<long>, team_b array<long>, outcome string")
    stored = spark.createDataFrame([("g", 1, 30.0, 7.0, 4), ("g", 9, 1.0, 2.0, 3)], "court string, player long, mu double, sigma double, matches long")
    got = rating.rate_history(df, "court", ["n"], stored).orderBy("n", "side").collect()
    assert [(r.n, r.player, r.side, r.matches) for r in got] == [(1, 1, "a", 5), (1, 2, "b", 1), (2, 1, "a", 6), (2, 2, "b", 2)]
    assert (got[0].mu_before, got[0].sigma_before) == (30.0, 7.0) and (got[2].mu_before, got[2].sigma_before) == (got[0].mu, got[0].sigma)
    first = rate(spark, [(30.0, 7.0)], [(25.0, 25.0 / 3)], "win_a", V)
    assert (got[0].mu, got[1].sigma) == pytest.approx((first.a[0].mu, first.b[0].sigma))
    final = {r.player: r for r in rating.rate_sequence(df, "court", ["n"], stored=stored).collect()}
    assert final[9].matches == 3 and (final[1].mu, final[1].matches) == (got[2].mu, 6)


def test_ids_are_dense_and_ordered(spark):
    held, rows = spark.createDataFrame([(7,)], "id long"), spark.range(100).select((F.col("id") * 37 % 100).alias("k"))
    got = {r.k: r.id for r in queues.with_new_ids(held, rows, ["k"]).collect()}
    assert got == {k: k + 8 for k in range(100)}


def test_matches_from_decisions(spark):
    row = lambda n, r, a, b: (n, datetime.date(2024, 1, 1), r, "s", 0, "c", a, b)
    df = spark.createDataFrame(
        [row("1", "Procedente", ["a"], ["b"]), row("1", "Procedente", ["a"], ["b"]), row("2", "procedente", [], ["b"]), row("3", "procedente", ["a"], ["a"]), row("4", "??", ["a"], ["b"]), row("5", "parcialmente procedente", ["a", "a"], ["b"])],
        "numero_processo string, data_decisao date, resultado string, source string, position int, tribunal string, advogados_polo_ativo_ids array<string>, advogados_polo_passivo_ids array<string>",
    )
    got = sorted((r.match_id.numero_processo, r.outcome, r.team_a) for r in rating.prepare_matches(df).collect())
    assert got == [("1", "win_a", ["a"]), ("5", "partial_a", ["a"])]


def test_probability_and_decay(spark):
    one = spark.range(1).select(rating.win_probability(F.lit(25.0), F.lit(69.0), F.lit(25.0), F.lit(69.0)).alias("p"), rating.decayed_sigma(F.lit(3.0), F.lit(0)).alias("s")).first()
    assert one.p == pytest.approx(0.5) and one.s == pytest.approx(3.0)
    assert math.isclose(rating.Model().rating(1.0)[0], 25.0)


def test_quarantine(spark):
    df = spark.createDataFrame([('{"numero_processo":"0001234-56.2023.8.22.0001","polo_ativo":"A","polo_passivo":" ","resultado":"x"}',), ("[]",), ("null",)], "j string")
    good, bad = validate.split_valid(df.select(F.parse_json("j").alias("record")))
    assert good.count() == 1 and sorted(r.reject_reason for r in bad.collect()) == ["not_a_record", "not_a_record"]


def test_identifiers(spark):
    df = spark.createDataFrame([("A",), (None,), ("  ",)], "v string").select(anonymize.replace_value("P", F.col("v")).alias("u"))
    first, second, third = (r.u for r in df.collect())
    assert len(first) == 36 and second is None and third == "  "
    lists = spark.range(1).select(anonymize.replace_list("P", F.array(F.lit("A"), F.lit("B"), F.lit(None), F.lit("  "))).alias("l")).first().l
    assert len(lists) == 3 and lists[0] == first and lists[-1] == "  "
    maps = spark.range(1).select(anonymize.replace_keys("P", F.create_map(F.lit("A"), F.lit(1))).alias("m")).first().m
    assert maps == {first: 1}
    js = spark.createDataFrame([('{"n":"A","l":["A","B"],"k":"x\\"y","z":3}',), ("bad",)], "j string").select(anonymize.replace_json(F.col("j"), {"n": "P", "l": "P"}).alias("o"))
    rows = [r.o for r in js.collect()]
    import json

    out = json.loads(rows[0])
    assert out["n"] == first and out["l"][0] == first and out["k"] == 'x"y' and out["z"] == 3 and rows[1] == "bad"


def test_map_keeps_the_first_original(spark):
    values = spark.createDataFrame([("P", "Ana", "ANA", 2), ("P", "ana", "ANA", 1), ("P", "", "X", 3), ("P", "B", " ", 4), ("P", "C", None, 5)], "pii_type string, original_value string, value_for_uuid_ref string, seq long")
    empty = spark.createDataFrame([], "pii_uuid string, original_value string, value_for_uuid_ref string, pii_type string")
    known, bad = anonymize.extend_map(empty, values)
    assert sorted(r.original_value for r in known.collect()) == ["C", "ana"] and bad.count() == 2
    again, _ = anonymize.extend_map(known, values)
    assert again.count() == 2
    with pytest.raises(PermissionError):
        anonymize.decode(known, known, False, "me", F.current_timestamp())
    rows, audit = anonymize.decode(known.select("pii_uuid").unionAll(spark.sql("SELECT 'nobody'")), known, True, "me", F.current_timestamp())
    assert rows.where("original_value IS NULL").count() == 1 and audit.count() == 3


def test_migrations(spark):
    df = spark.createDataFrame([("1", ["Ana"], ["Bo"], ["Dr. C"], [])], "numero_processo string, polo_ativo array<string>, polo_passivo array<string>, advogados_polo_ativo array<string>, advogados_polo_passivo array<string>")
    r = anonymize.migrate_decisions(df, normalize_lawyer_name).first()
    assert len(r.numero_processo) == 36 and len(r.advogados_polo_ativo_ids[0]) == 36 and r.advogados_polo_ativo_ids != r.advogados_polo_ativo
    m = spark.range(1).select(anonymize.anonymize_metadata(F.create_map(F.lit("creator"), F.lit("a"), F.lit("subject"), F.lit("s"))).alias("m")).first().m
    assert m["subject"] == "s" and len(m["creator"]) == 36


def test_rating_store(spark):
    store = spark.createDataFrame([], "advogado_id string, mu double, sigma double, total_partidas int")
    for mu, sigma, step, want in ((25.0, 8.333, False, 0), (26.0, 8.0, True, 1), (27.0, 7.5, False, 1)):
        store = queues.upsert_ratings(store, spark.createDataFrame([("x", mu, sigma, step)], "advogado_id string, mu double, sigma double, increment boolean"))
        row = store.first()
        assert (row.mu, row.sigma, row.total_partidas) == (mu, sigma, want)


def test_queue_upsert(spark):
    schema = "url string, status string, metadata map<string,string>, created_at timestamp, updated_at timestamp"
    t = [datetime.datetime(2024, 1, d) for d in (1, 2)]
    old = spark.createDataFrame([("u", "pending", {}, t[0], t[0])], schema)
    new = spark.createDataFrame([("u", "downloaded", {"k": "v"}, t[1], t[1]), ("w", "pending", {}, t[1], t[1])], schema)
    got = {r.url: r for r in queues.upsert_latest(old, new).collect()}
    assert len(got) == 2 and got["u"].status == "downloaded" and got["u"].created_at == t[0] and got["u"].metadata == {"k": "v"}
    one = queues.update_by_key(old, spark.createDataFrame([("u", "failed", 1)], "url string, state string, other int"), "url", {"state": "status"}).first()
    assert one.status == "failed"


def test_coverage_golden(spark):
    day = lambda *d: spark.createDataFrame([(datetime.date(2025, 1, x),) for x in d], "date date")
    r = listings.coverage_report(listings.coverage(day(1, 2, 3), day(1, 2, 4))).first()
    assert r.coverage_percent == pytest.approx(66.66666666666666) and (r.missing, r.extra, r.total_archived, r.total_expected) == (1, 1, 3, 3)
    assert r.missing_dates == [datetime.date(2025, 1, 3)] and r.extra_dates == [datetime.date(2025, 1, 4)]


def test_chunks(spark):
    pages = spark.range(30).select(F.lit("d").alias("doc_id"), F.col("id").cast("int").alias("page"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("text"))
    first, second = (r.text.split("\n") for r in listings.chunk_texts(pages).orderBy("chunk").collect())
    assert first == [f"p{i}" for i in range(25)]
    assert second[0].startswith("[CONTINUED") and second[1:] == [f"p{i}" for i in range(24, 30)]
    assert listings.chunk_texts(pages.where("page < 25")).count() == 1


def test_listing(spark):
    raw = spark.createDataFrame([("2024", "7", "25", "100", "a.pdf", "/n/", None), ("2024", "13", "1", "1", "b.pdf", "/n/", None), ("2024", "7", "26", "101S", "c.pdf", "/n/", "S")], "year string, month string, day string, number string, url string, relativePath string, sufix string")
    got = listings.listing_entries(raw, "https://x").collect()
    assert [(r.standard_filename, r.ia_identifier) for r in got] == [("dj_20240726_S.pdf", "tjro-diario-2024-07-26-s"), ("dj_20240725.pdf", "tjro-diario-2024-07-25")]


def test_chunk_merge(spark):
    df = spark.createDataFrame([("d", 1, '{"decisions":[{"n":"222"}]}'), ("d", 0, '{"decisions":[{"n":"111"}]}'), ("e", 0, "no"), ("f", 0, "{}")], "doc_id string, chunk int, reply string")
    got = {r.doc_id: r for r in standardize.merge_chunks(df).collect()}
    assert got["d"].decisions == ['{"n":"111"}', '{"n":"222"}'] and got["d"].chunks_processed == 2 and got["d"].total == 2
    assert got["e"].decisions is None and got["f"].decisions == []
