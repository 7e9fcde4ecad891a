"""Records, queues, listings, migrations and small functions on the driver's tables."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexarena.functions import text
from lexarena.operators import analytics, anonymize, listings, queues, rating, records, standardize, typed, validate
from lexarena.plans.domain import _uuid_sql
from lexarena.plans.registry import register
from lexarena.session import spread, table
from lexarena.sources import ingest, listing_source, readers
from lexarena.sources.tables import TableStore, shared_folder
from lexarena.streaming import items, metrics

AS_OF = datetime.date(2001, 8, 1)


@register(f"SELECT c_custkey, {_uuid_sql("'LAWYER_ID_NORMALIZED:' || c_name")} AS key, c_mktsegment AS value FROM customer")
def map_keys_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = table(spark, sf_dir, "customer").withColumn("m", F.create_map("c_name", "c_mktsegment"))
    return people.select("c_custkey", F.explode(anonymize.replace_keys("LAWYER_ID_NORMALIZED", F.col("m"))).alias("key", "value"))


@register(f"""
    WITH u AS (SELECT c_custkey, {_uuid_sql("'PARTY_NAME:' || c_name")} AS name, {_uuid_sql("'CITY:' || c_mktsegment")} AS item, {_uuid_sql("'CITY:' || c_name")} AS other FROM customer)
    SELECT c_custkey, name, item AS first_item, CAST(c_custkey AS VARCHAR) AS k,
      '{{"a\\"b":"true","code":"' || c_custkey || '","d":[true,null,"null"],"k":' || c_custkey || ',"l":["' || item || '","\\t",7,"' || other || '"],"m":null,"n":"' || name || '","x":"null"}}' AS j FROM u""")
def json_fields_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON object of each customer with one string and one list replaced; strings that look like other values, numbers, nulls and a quote in a key stay."""
    key = F.col("c_custkey").cast("string")
    people = F.concat(F.lit('{"n":"'), F.col("c_name"), F.lit('","code":"'), key, F.lit('","a\\"b":"true","x":"null","m":null,"d":[true,null,"null"],"k":'), key, F.lit(',"l":["'), F.col("c_mktsegment"), F.lit('",null,"\\t",7,"'), F.col("c_name"), F.lit('"]}'))
    out = table(spark, sf_dir, "customer").select("c_custkey", anonymize.replace_json(people, {"n": "PARTY_NAME", "l": "CITY", "k": "NUMBER"}).alias("j"))
    get = lambda path: F.get_json_object("j", path)
    return out.select("c_custkey", get("$.n").alias("name"), get("$.l[0]").alias("first_item"), get("$.k").alias("k"), "j")


@register("""
    WITH q AS (SELECT o_orderkey AS url, o_orderstatus AS status, o_orderdate AS created_at FROM orders),
    u AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey ELSE -o_orderkey - 1 END AS url, 'archived' AS status, TIMESTAMP '2002-01-01' AS created_at FROM orders WHERE o_orderkey % 3 = 0)
    SELECT coalesce(q.url, u.url) AS url, coalesce(u.status, q.status) AS status, CAST(coalesce(q.created_at, u.created_at) AS DATE) AS created FROM q FULL JOIN u ON q.url = u.url""")
def queue_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third order updated: the even ones are there and keep their creation date, the odd ones are new."""
    orders = table(spark, sf_dir, "orders")
    held = orders.select(F.col("o_orderkey").alias("url"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("updated_at"))
    late = F.lit(datetime.datetime(2002, 1, 1)).cast("timestamp_ntz")
    new = orders.where("o_orderkey % 3 = 0").select(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey")).otherwise(-1 - F.col("o_orderkey")).alias("url"), F.lit("archived").alias("status"), late.alias("created_at"), late.alias("updated_at"))
    return queues.upsert_latest(held, new).select("url", "status", F.col("created_at").cast("date").alias("created"))


@register("""
    SELECT o_orderkey AS url, CASE WHEN o_orderkey % 5 = 0 THEN 'failed' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 5 = 0 THEN '/new' ELSE o_orderpriority END AS arquivo_path FROM orders""")
def queue_update_by_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("url"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("arquivo_path"))
    updates = held.where("url % 5 = 0").select("url", F.lit("failed").alias("status"), F.lit("/new").alias("pdf_path"), F.lit(1).alias("unheard_of"))
    return queues.update_by_key(held, updates, "url", {"pdf_path": "arquivo_path"})


@register("""
    SELECT o_orderkey, 'dj_' || strftime(o_orderdate, '%Y%m%d') || CASE o_orderstatus WHEN 'P' THEN '_P' ELSE '' END || '.pdf' AS standard_filename, CAST(o_orderdate AS DATE) AS date,
      o_orderkey AS number, 'https://x/n/' || o_orderkey || '.pdf' AS full_url, 'Diário TJRO - ' || strftime(o_orderdate, '%Y-%m-%d') AS title
    FROM orders WHERE o_orderkey % 10 <> 3 AND o_orderkey % 10 <> 7""")
def listing_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as raw listing rows; those that end in 3 have no such month, those that end in 7 no number."""
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    part = lambda f: f(day).cast("string")
    raw = table(spark, sf_dir, "orders").select(
        part(F.year).alias("year"), F.when(k % 10 == 3, "13").otherwise(part(F.month)).alias("month"), part(F.dayofmonth).alias("day"),
        F.when(k % 10 == 7, "x").otherwise(F.concat(k.cast("string"), F.lit("S"))).alias("number"), F.concat(k.cast("string"), F.lit(".pdf")).alias("url"),
        F.lit("/n/").alias("relativePath"), F.when(F.col("o_orderstatus") == "P", "P").alias("sufix"))
    out = listings.listing_entries(raw, "https://x")
    return out.select(F.col("number").alias("o_orderkey"), "standard_filename", "date", "number", "full_url", "metadata.title")


@register(r"""
    SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS name, 'item-' || page_id AS identifier, regexp_extract(lower(url), '^[a-z]+://([^/?#]*)', 1) LIKE '%.jus.br' AS court,
      CASE WHEN page_id % 2 = 0 THEN 'https://b' || '/p/' || page_id ELSE 'http://c/' || page_id END AS absolute, '2024-05-06' AS day FROM pages""")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.col("page_id").cast("string")
    return table(spark, sf_dir, "pages").select(
        "page_id", text.basename(F.col("url")).alias("name"), text.identifier_from_archive_url(F.concat(F.lit("https://a/details/item-"), page, F.lit("/x.pdf"))).alias("identifier"),
        text.is_court_url(F.col("url")).alias("court"), text.absolute_url("https://b", F.concat(F.when(F.col("page_id") % 2 == 0, "/p/").otherwise("http://c/"), page)).alias("absolute"),
        text.iso_date_part(F.lit("2024-05-06T10:00:00")).alias("day"),
    )


@register("SELECT item_id, md5(trim(text)) AS body FROM benchmark")
def json_fence_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    fenced = F.concat(F.lit("\n```json\n"), F.trim("text"), F.lit("\n``` \n"))
    return table(spark, sf_dir, "benchmark").select("item_id", F.md5(text.strip_json_fence(fenced)).alias("body"))


@register("""
    SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 0 WHEN p_size % 3 = 1 THEN 1 ELSE 2 END AS n, round_even(p_retailprice * 1000 / 1048576, 2) AS megabytes, round(p_retailprice / 1099511627776 * 6, 9) AS cost FROM part""")
def list_lengths_and_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = F.when(F.col("p_size") % 3 == 1, F.array("p_brand")).when(F.col("p_size") % 3 == 2, F.array("p_brand", "p_type"))
    size = F.col("p_retailprice") * 1000
    return table(spark, sf_dir, "part").select("p_partkey", text.list_length(items).alias("n"), text.megabytes(size).alias("megabytes"), F.round(analytics.storage_cost(F.col("p_retailprice"), 6.0), 9).alias("cost"))


def _gazettes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as gazette records: some without a URL or a date."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("tribunal"), F.when(k % 11 != 0, F.col("o_orderdate").cast("date")).alias("data"), F.when(k % 7 != 0, F.concat(F.lit("https://x/"), k.cast("string"), F.lit(".pdf"))).alias("url"),
        F.concat(k.cast("string"), F.lit(".pdf")).alias("filename"), F.lit(None).cast("string").alias("hash"), F.when(k % 2 == 0, F.concat(F.lit("/f/"), k.cast("string"))).alias("pdf_path"),
        F.lit(None).cast("string").alias("ia_identifier"), F.when(k % 3 != 0, "queued").alias("status"), F.create_map(F.lit("k"), k.cast("string")).alias("metadata"))


@register("SELECT o_orderpriority AS tribunal, count(*) AS n FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey % 7 <> 0 GROUP BY 1")
def queueable_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.queueable(_gazettes(spark, sf_dir)).groupBy("tribunal").agg(F.count("*").alias("n"))


@register("""
    SELECT o_orderkey || '.pdf' AS filename, CASE WHEN o_orderkey % 3 <> 0 THEN 'queued' ELSE 'pending' END AS status, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderkey AS VARCHAR) END AS k,
      CASE WHEN o_orderkey % 2 = 0 THEN '/f/' || o_orderkey END AS pdf_path, CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderdate AS DATE) END AS data FROM orders""")
def record_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records through the queue's form and through JSON; every fifth has bad metadata on the way."""
    rows = records.to_queue_item(_gazettes(spark, sf_dir))
    rows = rows.withColumn("metadata", F.when(F.try_to_number(F.regexp_extract("filename", r"\d+", 0), F.lit("9999999999")) % 5 == 0, "{bad").otherwise(F.col("metadata")))
    back = records.from_queue_item(rows)
    out = back.select(records.from_json_text(records.to_json_text(back)).alias("r"))
    return out.select("r.filename", "r.status", F.get(F.array(F.try_element_at("r.metadata", F.lit("k"))), F.lit(0)).alias("k"), "r.pdf_path", "r.data")


@register("SELECT page_id, page_id % 2 = 0 AND strlen(html) + 4 > 1000 AS valid FROM pages")
def valid_pdf_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.encode(F.concat(F.when(F.col("page_id") % 2 == 0, "%PDF").otherwise("<html"), F.col("html")), "UTF-8")
    return table(spark, sf_dir, "pages").select("page_id", validate.valid_pdf(content).alias("valid"))


@register("SELECT event_id, 'done' AS event_type, 'x' AS k, CAST(user_id AS VARCHAR) AS who, 'keep' AS old FROM events")
def metadata_updated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.create_map(F.lit("old"), F.lit("keep"), F.lit("k"), F.lit("before")).alias("metadata"))
    out = queues.set_metadata(rows, ["event_type"], event_type=F.lit("done"), k=F.lit("x"), who=F.col("user_id"))
    return out.select("event_id", "event_type", *(F.col("metadata")[c].alias(c) for c in ("k", "who", "old")))


@register(f"SELECT {_uuid_sql("'LAWYER_ID_NORMALIZED:' || c_name")} AS advogado_id, c_acctbal AS mu FROM customer")
def migrated_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anonymize.migrate_ratings(table(spark, sf_dir, "customer").select(F.col("c_name").alias("advogado_id"), F.col("c_acctbal").alias("mu")))


def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as decisions: a case number, a party on each side and a titled lawyer."""
    name = F.col("c_name")
    raw = F.to_json(F.struct(F.col("c_custkey").cast("string").alias("numero_processo"), F.array(name).alias("polo_ativo"), F.lit("kept").alias("resumo"), F.lit("true").alias("tribunal"), F.lit(1.5).alias("score")))
    people = spread(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), "c_custkey", 20_000)
    return people.select(
        "c_custkey", F.col("c_custkey").cast("string").alias("numero_processo"), F.array(name, F.lit(" \t")).alias("polo_ativo"), F.array("c_mktsegment").alias("polo_passivo"),
        F.array(F.concat(F.lit("Dr. "), name)).alias("advogados_polo_ativo"), F.array().cast("array<string>").alias("advogados_polo_passivo"), raw.alias("raw_json_data"))


@register(f"""
    SELECT c_custkey, {_uuid_sql("'CASE_NUMBER:' || c_custkey")} AS case_number, {_uuid_sql("'PARTY_NAME:' || c_name")} AS active, ' ' || chr(9) AS blank, {_uuid_sql("'PARTY_NAME:' || c_mktsegment")} AS passive,
      {_uuid_sql("'LAWYER_FULL_STRING:Dr. ' || c_name")} AS lawyer, {_uuid_sql("'LAWYER_ID_NORMALIZED:' || upper(c_name)")} AS lawyer_id,
      {_uuid_sql("'CASE_NUMBER:' || c_custkey")} AS raw_number, {_uuid_sql("'PARTY_NAME:' || c_name")} AS raw_active, 'kept' AS raw_rest, true AS raw_string FROM customer""")
def migrated_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = anonymize.migrate_decisions(_people(spark, sf_dir), text.normalize_lawyer_name, "raw_json_data")
    get = lambda path: F.get_json_object("raw_json_data", path)
    return out.select(
        "c_custkey", F.col("numero_processo").alias("case_number"), F.col("polo_ativo")[0].alias("active"), F.col("polo_ativo")[1].alias("blank"), F.col("polo_passivo")[0].alias("passive"),
        F.col("advogados_polo_ativo")[0].alias("lawyer"), F.col("advogados_polo_ativo_ids")[0].alias("lawyer_id"), get("$.numero_processo").alias("raw_number"), get("$.polo_ativo[0]").alias("raw_active"), get("$.resumo").alias("raw_rest"), F.contains("raw_json_data", F.lit('"score":1.5,"tribunal":"true"')).alias("raw_string"),
    )


@register("""
    SELECT pii_type, count(*) AS n, min(original_value) AS first_value FROM (
      SELECT 'CASE_NUMBER' AS pii_type, CAST(c_custkey AS VARCHAR) AS original_value FROM customer UNION SELECT 'PARTY_NAME', c_name FROM customer UNION
      SELECT 'PARTY_NAME', c_mktsegment FROM customer UNION SELECT 'LAWYER_FULL_STRING', 'Dr. ' || c_name FROM customer UNION SELECT 'LAWYER_ID_NORMALIZED', 'Dr. ' || c_name FROM customer) GROUP BY 1""")
def decode_map_of_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decode map that the migration of decisions builds, by kind, from a map that holds the segments already."""
    people = _people(spark, sf_dir)
    empty = spark.createDataFrame([], "pii_uuid string, original_value string, value_for_uuid_ref string, pii_type string")
    segments = people.select(F.lit("PARTY_NAME").alias("pii_type"), F.col("polo_passivo")[0].alias("original_value"), F.lit(None).cast("string").alias("value_for_uuid_ref"), F.col("c_custkey").alias("seq"))
    known, _ = anonymize.extend_map(empty, segments)
    known, _ = anonymize.extend_map(known, anonymize.decision_values(people, text.normalize_lawyer_name, "c_custkey"))
    return known.groupBy("pii_type").agg(F.count("*").alias("n"), F.min("original_value").alias("first_value"))


@register(f"""
    SELECT o_orderkey, {_uuid_sql("'CASE_NUMBER:' || o_orderkey")} AS case_number, {_uuid_sql("'LAWYER_ID_NORMALIZED:' || o_custkey")} AS player, {_uuid_sql("'LAWYER_ID_NORMALIZED:' || o_custkey")} AS map_key, o_totalprice AS mu FROM orders""")
def migrated_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    who = F.col("o_custkey").cast("string")
    held = F.create_map(who, F.struct(F.col("o_totalprice").alias("mu"), F.lit(8.0).alias("sigma")))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("numero_processo"), F.array(who).alias("equipe_a_ids"), F.array(who).alias("equipe_b_ids"), *(held.alias(f"ratings_equipe_{s}_{w}") for s in "ab" for w in ("antes", "depois")))
    out = anonymize.migrate_matches(rows)
    return out.select("o_orderkey", F.col("numero_processo").alias("case_number"), F.col("equipe_b_ids")[0].alias("player"), F.explode("ratings_equipe_a_depois").alias("map_key", "v")).select("o_orderkey", "case_number", "player", "map_key", "v.mu")


@register(f"SELECT s_suppkey, {_uuid_sql("'METADATA_CREATOR:' || s_name")} AS creator, {_uuid_sql("'METADATA_TITLE:t' || s_suppkey")} AS title, 'law' AS subject FROM supplier")
def anonymized_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.create_map(F.lit("creator"), F.col("s_name"), F.lit("title"), F.concat(F.lit("t"), F.col("s_suppkey").cast("string")), F.lit("subject"), F.lit("law"))
    out = table(spark, sf_dir, "supplier").select("s_suppkey", anonymize.anonymize_metadata(m).alias("m"))
    return out.select("s_suppkey", *(F.col("m")[c].alias(c) for c in ("creator", "title", "subject")))


@register("""
    SELECT conv_id AS doc_id, count(*) AS chunks_processed, CASE WHEN bool_and(turn < 5) THEN count(*) END AS total, CASE WHEN bool_and(turn < 5) THEN string_agg('{"n":' || turn || '}', '' ORDER BY turn) END AS decisions
    FROM conversations GROUP BY 1""")
def merged_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as chunk replies of one decision each; a sixth turn is no JSON, which spoils its whole document."""
    reply = F.when(F.col("turn") < 5, F.concat(F.lit('{"decisions":[{"n":'), F.col("turn").cast("string"), F.lit("}]}"))).otherwise("sorry")
    out = standardize.merge_chunks(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("chunk"), reply.alias("reply")))
    return out.select("doc_id", "chunks_processed", F.col("total").cast("long").alias("total"), F.array_join("decisions", "").alias("decisions"))


@register("""
    SELECT outcome, count(*) AS n FROM (SELECT CASE o_orderstatus WHEN 'F' THEN 'win_a' WHEN 'O' THEN 'win_b' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'partial_a' END END AS outcome FROM orders) GROUP BY 1""")
def result_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("o_orderstatus")
    result = F.when(s == "F", "Procedente ").when(s == "O", "improcedente").when(F.col("o_orderkey") % 2 == 0, "Parcialmente procedente").otherwise("unknown")
    return table(spark, sf_dir, "orders").select(rating.outcome_of(result).alias("outcome")).groupBy("outcome").agg(F.count("*").alias("n"))


@register("""
    WITH t AS (SELECT c_custkey, c_acctbal / 400 AS mu, sqrt(64.0 + 49.0 + 2 * (25.0 / 6) ^ 2) AS c FROM customer)
    SELECT c_custkey, round(1 / (1 + exp((25.0 - mu) / c)), 6) AS win, round(1 / (1 + exp((mu - 25.0 - 1) / c)) - 1 / (1 + exp((mu - 25.0 + 1) / c)), 6) AS draw,
      round(least(sqrt(9.0 + (c_custkey % 500) * 0.0001), 25.0 / 3), 6) AS sigma FROM t""")
def match_chances(spark: SparkSession, sf_dir: str) -> DataFrame:
    mu, a, b = F.col("c_acctbal") / 400, F.lit(64.0), F.lit(49.0)
    return table(spark, sf_dir, "customer").select(
        "c_custkey", F.round(rating.win_probability(mu, a, F.lit(25.0), b), 6).alias("win"), F.round(rating.draw_probability(mu, a, F.lit(25.0), b), 6).alias("draw"),
        F.round(rating.decayed_sigma(F.lit(3.0), F.col("c_custkey") % 500), 6).alias("sigma"),
    )


@register("""
    SELECT user_id, max_by(event_type, (ts, event_id)) AS status, count(*) FILTER (event_type = 'error') AS attempts, least(count(*) FILTER (event_type = 'error') * 2.0, 10.0) AS delay FROM events GROUP BY 1""")
def retry_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.when(F.col("event_type") == "error", "failed").otherwise(F.col("event_type"))
    states = metrics.item_states(table(spark, sf_dir, "events").withColumn("s", kinds), "user_id", ["ts", "event_id"], "s")
    return states.select("user_id", F.when(F.col("status") == "failed", "error").otherwise(F.col("status")).alias("status"), "attempts", metrics.retry_delay(F.col("attempts")).alias("delay"))


@register("""
    SELECT CAST(user_id AS VARCHAR) AS item, max_by(CASE event_type WHEN 'error' THEN 'failed' ELSE event_type END, (ts, event_id)) AS status,
      count(*) FILTER (event_type = 'error') AS attempts, least(count(*) FILTER (event_type = 'error') * 2.0, 10.0) AS delay FROM events GROUP BY 1""")
def retry_states_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """retry_delays as a keyed stream over files of events, stopped half way and started again from its checkpoint."""
    kinds = F.when(F.col("event_type") == "error", "failed").otherwise(F.col("event_type"))
    events = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), kinds.alias("status"))
    folder = f"{shared_folder(spark)}/item-stream-{uuid.uuid4().hex}"
    return items.replay_in_parts(events, folder, key="user_id", time="ts", tie="event_id", status="status").drop("updated")


@register("""
    SELECT year(o_orderdate) AS year, CASE WHEN year(o_orderdate) = 1996 THEN 0 ELSE count(*) FILTER (o_orderstatus = 'P') END AS items FROM orders GROUP BY 1""")
def yearly_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing API's reply for each year; one year's is an error, not a list."""
    per_year = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.collect_list(F.when(F.col("o_orderstatus") == "P", F.col("o_orderkey"))).alias("keys"))
    return readers.yearly_counts(per_year.select("year", F.when(F.col("year") == 1996, '{"error":1}').otherwise(F.to_json("keys")).alias("reply")))


@register("SELECT count(*) AS n FROM orders a JOIN (SELECT o_orderkey, 2 * o_custkey AS value FROM orders) b USING (o_orderkey) WHERE value % 4 = 0")
def range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two projections of orders joined by key, filtered and counted."""
    a = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return a.select("o_orderkey").join(a.select("o_orderkey", (F.col("o_custkey") * 2).alias("value")), "o_orderkey").where("value % 4 = 0").agg(F.count("*").alias("n"))


@register("SELECT count(*) AS files, CAST(sum(strlen(html)) AS BIGINT) AS bytes, round_even(sum(strlen(html)) / 1048576.0, 2) AS megabytes FROM pages")
def storage_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.storage_size(table(spark, sf_dir, "pages"), F.octet_length("html"))


@register("SELECT c_custkey, c_name, (SELECT count(*) - 20 FROM customer) AS more FROM customer ORDER BY c_custkey LIMIT 20")
def display_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.display_page(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), ["c_custkey"])


@register("SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '5-LOW'")
def registry_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of the urgent registry that the low one doesn't have."""
    orders = table(spark, sf_dir, "orders")
    of = lambda priority: orders.where(F.col("o_orderpriority") == priority).select("o_custkey")
    return of("1-URGENT").subtract(of("5-LOW"))


@register("""
    SELECT DISTINCT 'court-database-' || strftime(o_orderdate, '%Y-%m-%d') || '-weekly' AS item, 'matches: ' || count(*) || ', files: ' || count(DISTINCT o_custkey) AS description, CAST(count(*) AS VARCHAR) AS stats_matches
    FROM orders GROUP BY CAST(o_orderdate AS DATE), o_orderdate""")
def snapshot_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").alias("d")).agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("f"))
    meta = records.snapshot_metadata(F.lit("t"), {"matches": F.col("n"), "files": F.col("f")})
    out = days.select(records.snapshot_item("court", F.col("d"), F.lit("WEEKLY")).alias("item"), meta.alias("m"))
    return out.select("item", F.col("m")["description"].alias("description"), F.col("m")["stats_matches"].alias("stats_matches"))


@register("""
    SELECT least(11, greatest(0, CAST(floor((c_acctbal + 1000) / 1100) AS BIGINT) + 1)) AS level, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS wins,
      round(count(*) FILTER (o_orderstatus = 'F') * 100.0 / count(*), 6) AS win_percent FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1""")
def results_by_opponent_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal")
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus").join(people, "o_custkey")
    level = F.width_bucket(F.col("c_acctbal"), F.lit(-1000.0), F.lit(10000.0), F.lit(10))
    return analytics.results_by_level(rows, level, F.col("o_orderstatus") == "F")


@register("SELECT event_type AS keyword, count(*) AS n, round(count(*) FILTER (value > 50) * 100.0 / count(*), 6) AS success_percent FROM events GROUP BY 1")
def topic_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.array("event_type", "event_type").alias("k"), "value")
    return analytics.topic_success(rows, "k", F.col("value") > 50)


@register("""
    WITH d AS (SELECT o_orderpriority AS tribunal, o_orderstatus AS r, CASE WHEN l_partkey % 5 = 0 THEN '' ELSE CAST(l_partkey AS VARCHAR) END AS number FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
    h AS (SELECT tribunal, r, count(*) AS n FROM d GROUP BY 1, 2)
    SELECT tribunal, count(*) AS decisions, count(DISTINCT nullif(number, '')) AS cases, CAST(count(*) * 3 AS BIGINT) AS parties,
      (SELECT string_agg(r || ':' || n, ',' ORDER BY r) FROM h WHERE h.tribunal = d.tribunal) AS outcomes FROM d GROUP BY 1""")
def gazette_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.when(F.col("l_partkey") % 5 == 0, "").otherwise(F.col("l_partkey").cast("string")).alias("numero_processo"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("tribunal"), F.col("o_orderstatus").alias("resultado")).join(lines, "o_orderkey")
    rows = rows.withColumns({"polo_ativo": F.array("tribunal", "resultado"), "polo_passivo": F.array("tribunal")})
    out = standardize.gazette_decision_stats(rows, "tribunal")
    named = F.array_join(F.transform(F.map_entries("outcomes"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",")
    return out.select("tribunal", "decisions", "cases", F.col("parties").cast("long").alias("parties"), named.alias("outcomes"))


@register("SELECT year(o_orderdate) AS year, count(*) AS n, count(*) FILTER (o_orderstatus = 'P') AS supplements FROM orders GROUP BY 1")
def listing_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderdate", F.when(F.col("o_orderstatus") == "P", "S").alias("sufix"))
    return listings.listing_years(rows, "o_orderdate", "sufix")


@register("SELECT 'customer' AS name, count(*) > 0 AS ok FROM customer UNION ALL SELECT 'orders', count(*) > 0 FROM orders UNION ALL SELECT 'events', count(*) > 0 FROM events")
def health_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether tables can be read and have rows."""
    probe = lambda name: table(spark, sf_dir, name).agg((F.count("*") > 0).alias("ok")).select(F.lit(name).alias("name"), "ok")
    return probe("customer").unionByName(probe("orders")).unionByName(probe("events"))


@register("""
    WITH d AS (SELECT CAST(unnest(generate_series(DATE '1996-01-01', DATE '1996-03-31', INTERVAL 1 DAY)) AS DATE) AS date)
    SELECT 'tjro' AS tribunal, date AS data, min('https://x/n/' || o_orderkey || '.pdf') AS url, min(o_orderkey || '.pdf') AS filename, 'pending' AS status
    FROM d JOIN orders ON CAST(o_orderdate AS DATE) = date WHERE o_orderstatus = 'P' GROUP BY date""")
def records_for_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = spark.range(1).select(listings.day_series(F.lit(datetime.date(1996, 1, 1)), F.lit(datetime.date(1996, 3, 31))).alias("date"))
    listing = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderdate").cast("date").alias("date"), F.concat(F.lit("https://x/n/"), F.col("o_orderkey").cast("string"), F.lit(".pdf")).alias("url"))
    return records.for_days(days, listing, "tjro")


@register("""
    SELECT o_orderkey, CASE WHEN l.n IS NULL THEN o_orderstatus ELSE 'analyzed' END AS status, coalesce(l.n, 0) AS decision_count
    FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) l ON l_orderkey = o_orderkey""")
def attached_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    decisions = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return records.attach_analysis(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status")), decisions, "o_orderkey")


@register("SELECT o_orderkey || '.pdf' AS filename, o_orderpriority AS tribunal FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 3)")
def archivable_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "lineitem").where("l_linenumber = 3").select(F.concat(F.col("l_orderkey").cast("string"), F.lit(".pdf")).alias("filename"))
    return records.archivable(_gazettes(spark, sf_dir).select("filename", "tribunal"), files)


@register("""
    SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderdate AS DATE) ELSE DATE '2001-07-31' END AS day, 'dummy_data' AS status, coalesce(try_cast(try_strptime('2024' || lpad(CAST(o_orderkey % 14 AS VARCHAR), 2, '0') || '05', '%Y%m%d') AS DATE), DATE '2001-08-01') AS file_day FROM orders""")
def defaults_of_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day before the as-of day where none is given, the date in a file's name or else the as-of day, and the placeholder's status."""
    k = F.col("o_orderkey")
    name = F.concat(F.lit("dj_2024"), F.lpad((k % 14).cast("string"), 2, "0"), F.lit("05.pdf"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", records.default_date(F.when(k % 2 == 0, F.col("o_orderdate").cast("date")), F.lit(AS_OF)).alias("day"), text.date_from_filename(name, F.lit(AS_OF)).alias("file_day"), k.cast("string").alias("filename"))
    return rows.join(records.placeholder(rows).select(F.col("file_name_source").alias("filename"), "status"), "filename").drop("filename")


@register("""
    WITH d AS (SELECT row_number() OVER (ORDER BY date) - 1 AS i, date FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders WHERE o_orderstatus = 'P'))
    SELECT date, CAST(i + 1 AS VARCHAR) AS number, '' AS sufix FROM d UNION ALL SELECT date, (i + 1) || 'S', 'S' FROM d WHERE i % 3 = 0""")
def generated_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderdate").cast("date").alias("date")).distinct()
    numbered = queues.with_new_ids(spark.range(0), days, ["date"]).select("date", (F.col("id") - 1).alias("i"))
    return records.generated_listing(numbered)


#: What is wrong with a raw decision, by the order's key.
_CASES = [
    (None, '{"numero_processo":"%s","partes":{"requerente":["A"],"requerido":"B"},"resultado":"procedente"}'),
    ("numero_pattern", '{"numero_processo":"%s-TOO-LONG-BY-FAR","partes":{"requerente":["A"],"requerido":"B"},"resultado":"x"}'),
    ("ativo_missing", '{"numero_processo":"%s","partes":"A x B","resultado":"x"}'),
    ("ativo_empty_items", '{"numero_processo":"%s","partes":{"requerente":[""],"requerido":"B"},"resultado":"x"}'),
    ("passivo_missing", '{"numero_processo":"%s","partes":{"requerente":["A"]},"resultado":"x"}'),
    ("resultado_type", '{"numero_processo":"%s","polo_ativo":"A","polo_passivo":"B","resultado":5}'),
    ("not_a_record", '["%s"]'),
]


@register(f"SELECT o_orderkey, CASE o_orderkey % {len(_CASES)} {' '.join(f"WHEN {i} THEN '{r}'" for i, (r, _) in enumerate(_CASES) if r)} END AS reject_reason FROM orders")
def validated_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raw decision of each order, with one of the faults or none, and why it is rejected."""
    k = F.col("o_orderkey")
    shape = F.get(F.array(*(F.lit(j) for _, j in _CASES)), (k % len(_CASES)).cast("int"))
    raw = F.replace(shape, F.lit("%s"), F.concat(F.lpad(k.cast("string"), 15, "0"), F.lit("-1.2")))
    return table(spark, sf_dir, "orders").select("o_orderkey", validate.reject_reason(F.parse_json(raw)).alias("reject_reason"))


@register("""
    SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS numero_processo, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE 'old' END AS resultado,
      CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS DATE) ELSE DATE '2001-08-01' END AS data_decisao, CASE WHEN o_orderkey % 5 = 0 THEN 'L1|L2' ELSE 'A' END AS ativo FROM orders""")
def standardized_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw decisions of orders under several aliases as canonical ones."""
    k = F.col("o_orderkey")
    empty = F.lit(None).cast("string")
    raw = F.struct(
        k.cast("string").alias("process_number"), F.lit("A").alias("active_party"), F.when(k % 5 == 0, F.array(F.lit("L1"), F.lit("L2"))).alias("advogados_ativo"), F.lit("old").alias("resultado"),
        F.when(k % 2 == 0, F.col("o_orderstatus")).otherwise(empty).alias("outcome"), F.when(k % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(empty).alias("decision_date"))
    d = standardize.standardize(F.parse_json(F.to_json(raw)), F.lit(AS_OF))
    out = table(spark, sf_dir, "orders").select("o_orderkey", d.alias("d"))
    return out.select("o_orderkey", "d.numero_processo", "d.resultado", "d.data_decisao", F.array_join("d.polo_ativo", "|").alias("ativo"))


@register("SELECT page_id, coalesce(nullif(regexp_replace(url, '[^\\w.\\-]', '', 'g'), ''), 'default_filename') AS name FROM pages")
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.sanitize_filename(F.col("url")).alias("name"))


@register("""
    SELECT c_custkey, c_acctbal AS first_balance, CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END AS second_balance, c_acctbal AS restored_balance,
      CAST(CASE WHEN c_nationkey < 5 THEN 2 ELSE 1 END AS BIGINT) AS rows_third FROM customer""")
def versioned_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers through four versions of a table: as they are, without debts, with some appended again, and the first restored."""
    people = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    store = TableStore(spark, f"{shared_folder(spark)}/customers-{uuid.uuid4().hex}")
    store.commit({"customer": ("replace", people)})
    store.commit({"customer": ("replace", store.read("customer").withColumn("c_acctbal", F.greatest("c_acctbal", F.lit(0.0))))}, expected=1)
    store.commit({"customer": ("append", store.read("customer", 1).where("c_nationkey < 5"))}, expected=2)
    store.restore(1)
    balance = lambda version, name: store.read("customer", version).select("c_custkey", F.col("c_acctbal").alias(name))
    counts = store.read("customer", 3).groupBy("c_custkey").agg(F.count("*").alias("rows_third"))
    return balance(1, "first_balance").join(balance(2, "second_balance"), "c_custkey").join(balance(None, "restored_balance"), "c_custkey").join(counts, "c_custkey")


@register(f"""
    SELECT o_orderkey, o_orderkey % 3 <> 0 AS first_half, CAST(1 AS BIGINT) AS times, (SELECT count(*) FROM orders WHERE o_orderkey % {len(_CASES)} = 0) AS valid_in_ledger
    FROM orders WHERE o_orderkey % {len(_CASES)} = 0""")
def ingested_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw decisions of orders in files that arrive in two parts, taken in by four runs, of which two find nothing to do or are dry."""
    folder = f"{shared_folder(spark)}/ingest-{uuid.uuid4().hex}"
    orders, store = spread(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 200_000), TableStore(spark, f"{folder}/store")
    k = F.col("o_orderkey")
    shape = F.get(F.array(*(F.lit(j) for _, j in _CASES)), (k % len(_CASES)).cast("int"))
    lines = orders.select("o_orderkey", F.replace(shape, F.lit("%s"), F.concat(F.lpad(k.cast("string"), 15, "0"), F.lit("-1.2"))).alias("value"))
    run = lambda **o: ingest.ingest(store, f"{folder}/in", validate.reject_reason, **o)
    lines.where(k % 3 != 0).select("value").write.mode("append").text(f"{folder}/in")
    run(dry_run=True)
    run()
    lines.where(k % 3 == 0).select("value").write.mode("append").text(f"{folder}/in")
    run()
    run()
    valid = store.read("files").agg(F.sum("valid").alias("valid_in_ledger"))
    key = F.split_part(F.get_json_object("record", "$.numero_processo"), F.lit("-"), F.lit(1)).cast("long")
    early = store.read("records", 1).select(key.alias("o_orderkey"), F.lit(True).alias("first_half")).distinct()
    found = store.read("records").groupBy(key.alias("o_orderkey")).agg(F.count("*").alias("times")).join(early, "o_orderkey", "left")
    return found.withColumn("first_half", F.coalesce("first_half", F.lit(False))).crossJoin(F.broadcast(valid))  # one row


#: Faults of an envelope by the order's key: the value put in and what is said of it.
_ENVELOPE = '{"file_name_source":"a.pdf","extraction_timestamp":"2024-05-01T10:00:00Z","chunks_processed":1,"total_decisions_found":2,"decisions":[%s,{"numero_processo":"%d","resultado":"x","data_decisao":"2024-05-01"}]}'
_DECISION = '{"numero_processo":"%d","resultado":"x","data_decisao":"2024-05-01","polo_ativo":["A"],"resumo":null}'
_TYPED = [
    (None, _ENVELOPE.replace("%s", _DECISION)),
    (None, _ENVELOPE.replace("%s", _DECISION).replace('"chunks_processed":1', '"chunks_processed":"1"')),
    ("$: not JSON", "{" + _ENVELOPE),
    ("$: not an object", "[%d]"),
    ("$.decisions: not a list", _ENVELOPE.replace("[%s,", '"x","y":[').replace("%s", _DECISION)),
    ("$.extraction_timestamp: not a timestamp", _ENVELOPE.replace("%s", _DECISION).replace("2024-05-01T10:00:00Z", "May")),
    ("$.chunks_processed: not a int", _ENVELOPE.replace("%s", _DECISION).replace('"chunks_processed":1', '"chunks_processed":1.5')),
    ("$.total_decisions_found: missing", _ENVELOPE.replace("%s", _DECISION).replace("total_decisions_found", "found")),
    ("$.decisions[0].numero_processo: not a string", _ENVELOPE.replace("%s", _DECISION.replace('"%d"', "%d"))),
    ("$.decisions[0].polo_ativo[1]: null", _ENVELOPE.replace("%s", _DECISION.replace('["A"]', '["A",null]'))),
    ("$.decisions[1].data_decisao: not a date", _ENVELOPE.replace("%s", _DECISION).replace('2024-05-01"}]}', '2024-02-30"}]}')),
    ("$.decisions[0].resultado: null", _ENVELOPE.replace("%s", _DECISION.replace('"resultado":"x"', '"resultado":null'))),
    ("$.file_name_source: missing", "{}"),
]


@register(f"SELECT o_orderkey, CASE o_orderkey % {len(_TYPED)} {' '.join(f"WHEN {i} THEN '{r}'" for i, (r, _) in enumerate(_TYPED) if r)} END AS fault FROM orders")
def typed_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extraction envelope of each order, with one fault of a kind or none, and where validation stops."""
    k = F.col("o_orderkey")
    shape = F.get(F.array(*(F.lit(j) for _, j in _TYPED)), (k % len(_TYPED)).cast("int"))
    orders = spread(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 100_000)
    documents = orders.select("o_orderkey", F.replace(shape, F.lit("%d"), k.cast("string")).alias("document"))
    return typed.with_fault(documents, "document").select("o_orderkey", "fault")


def _archive(spark: SparkSession, sf_dir: str) -> str:
    """The folder of yearly listings of orders as archive items, which the data source reads."""
    k = F.col("o_orderkey").cast("string")
    rows = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("item-"), k).alias("identifier"), F.concat(F.lit("Diário "), k).alias("title"), F.col("o_orderdate").cast("date").alias("date"), F.col("o_orderpriority").alias("creator"), F.col("o_orderstatus").alias("collection"))
    folder = f"{shared_folder(spark)}/archive-{uuid.uuid4().hex}"
    listing_source.write_archive(rows, folder)
    return folder


@register("""
    SELECT 'item-' || o_orderkey AS identifier, 'Diário ' || o_orderkey AS title, CAST(o_orderdate AS DATE) AS date, o_orderpriority AS creator FROM orders
    WHERE o_orderpriority = '2-HIGH' AND CAST(o_orderdate AS DATE) BETWEEN DATE '1996-03-01' AND DATE '1998-02-28' ORDER BY date DESC, identifier LIMIT 10000""")
def archive_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search API's feature: a creator's items between two dates, the newest 10,000."""
    bounds = {"creator": "2-HIGH", "start": datetime.date(1996, 3, 1), "end": datetime.date(1998, 2, 28)}
    found = readers.search_items(listing_source.read_archive(spark, _archive(spark, sf_dir), **bounds), **bounds)
    return found.select("identifier", "title", "date", "creator")


@register("""
    SELECT 'item-' || o_orderkey AS identifier, CAST(o_orderdate AS DATE) AS date FROM orders WHERE o_orderstatus = 'P' ORDER BY date DESC, identifier LIMIT 10000""")
def archive_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 10,000 items of a collection."""
    return readers.collection_items(listing_source.read_archive(spark, _archive(spark, sf_dir), collection="P"), "P").select("identifier", "date")


@register("SELECT year(o_orderdate) AS year, o_orderpriority AS creator, count(*) AS items FROM orders GROUP BY 1, 2")
def archive_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items by year and creator over every listing of the archive."""
    return listing_source.read_archive(spark, _archive(spark, sf_dir)).groupBy(F.year("date").alias("year"), "creator").agg(F.count("*").alias("items"))
