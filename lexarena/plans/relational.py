"""Filters, joins, aggregates, windows and set operations on the driver's tables.

Stand-ins: ratings are customers (mu c_acctbal, sigma c_nationkey), the queue is orders (status
o_orderstatus, court o_orderpriority, created_at o_orderdate), activity is events.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexarena.functions.text import tolerant_map
from lexarena.operators import analytics, listings, queues
from lexarena.plans.registry import register
from lexarena.session import table

AS_OF = datetime.date(2001, 8, 1)
STATUSES = ["F", "O", "P"]


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("advogado_id"), F.col("c_acctbal").alias("mu"), F.col("c_nationkey").cast("double").alias("sigma"))


def queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("url"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("tribunal"),
        F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").cast("date").alias("date"),
    )


_RATINGS = "SELECT c_custkey AS advogado_id, c_acctbal AS mu, CAST(c_nationkey AS DOUBLE) AS sigma FROM customer"
_QUEUE = "SELECT o_orderkey AS url, o_orderstatus AS status, o_orderpriority AS tribunal, o_orderdate AS created_at, CAST(o_orderdate AS DATE) AS date FROM orders"


@register(f"SELECT *, mu - 3 * sigma AS conservative_skill FROM ({_RATINGS}) ORDER BY conservative_skill DESC, advogado_id LIMIT 20")
def ranking_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.ranking(ratings(spark, sf_dir))


@register(f"SELECT *, mu - 3 * sigma AS conservative_skill FROM ({_RATINGS})")
def ratings_by_mu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ratings(spark, sf_dir).withColumn("conservative_skill", F.col("mu") - 3 * F.col("sigma")).orderBy(F.desc_nulls_last("mu"), "advogado_id")


@register(f"SELECT * FROM ({_RATINGS}) WHERE advogado_id = 42")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ratings(spark, sf_dir).where("advogado_id = 42")


@register(f"SELECT * FROM ({_QUEUE}) WHERE status = 'P'")
def queue_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queues.by_status(queue(spark, sf_dir), "P")


@register(f"SELECT * FROM ({_QUEUE}) WHERE tribunal = '1-URGENT'")
def queue_by_court(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queues.by_court(queue(spark, sf_dir), "1-URGENT")


@register("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def count_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))


@register("SELECT o_orderpriority AS tribunal, count(*) AS n FROM orders GROUP BY 1")
def count_by_court(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue(spark, sf_dir).groupBy("tribunal").agg(F.count("*").alias("n"))


@register("""
    SELECT (SELECT count(*) FROM customer) AS total_lawyers, (SELECT round(avg(c_acctbal), 6) FROM customer) AS mean_mu,
      (SELECT round(avg(c_nationkey), 6) FROM customer) AS mean_sigma, (SELECT max(c_acctbal) FROM customer) AS max_mu,
      (SELECT count(*) FROM customer WHERE c_acctbal > 0) AS active_lawyers, (SELECT count(*) FROM orders) AS total_matches,
      (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS completed_matches, (SELECT count(*) FROM lineitem) AS total_decisions,
      (SELECT count(*) FROM lineitem WHERE l_returnflag = 'R') AS returned_decisions, (SELECT count(*) FROM part) AS total_files,
      (SELECT min(o_orderdate) FROM orders) AS first_date, (SELECT max(o_orderdate) FROM orders) AS last_date""")
def general_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve metrics from one aggregate a table, joined as one-row tables."""
    people = table(spark, sf_dir, "customer").agg(
        F.count("*").alias("total_lawyers"), F.round(F.avg("c_acctbal"), 6).alias("mean_mu"), F.round(F.avg("c_nationkey"), 6).alias("mean_sigma"),
        F.max("c_acctbal").alias("max_mu"), F.count_if(F.col("c_acctbal") > 0).alias("active_lawyers"))
    matches = table(spark, sf_dir, "orders").agg(
        F.count("*").alias("total_matches"), F.count_if(F.col("o_orderstatus") == "F").alias("completed_matches"),
        F.min("o_orderdate").alias("first_date"), F.max("o_orderdate").alias("last_date"))
    decisions = table(spark, sf_dir, "lineitem").agg(F.count("*").alias("total_decisions"), F.count_if(F.col("l_returnflag") == "R").alias("returned_decisions"))
    files = table(spark, sf_dir, "part").agg(F.count("*").alias("total_files"))
    return people.crossJoin(F.broadcast(matches)).crossJoin(F.broadcast(decisions)).crossJoin(F.broadcast(files))


@register(f"SELECT count(*) AS n FROM orders WHERE o_orderdate >= DATE '{AS_OF}' - INTERVAL 7 DAY")
def recent_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    recent = queue(spark, sf_dir).where(F.col("created_at") >= F.lit(AS_OF) - F.expr("INTERVAL '7' DAY"))
    return recent.agg(F.count("*").alias("n"))


@register(f"SELECT * FROM ({_QUEUE}) WHERE date BETWEEN DATE '1996-01-01' AND DATE '1996-03-31' ORDER BY date DESC, url LIMIT 100")
def date_range_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listings.date_filter(queue(spark, sf_dir), "date", datetime.date(1996, 1, 1), datetime.date(1996, 3, 31))
    return rows.orderBy(F.desc("date"), "url").limit(100)


@register(f"SELECT year(date) AS year, count(*) AS n FROM ({_QUEUE}) WHERE year(date) IN (1996, 1998) GROUP BY 1")
def years_in_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings.in_years(queue(spark, sf_dir), "date", [1996, 1998]).groupBy(F.year("date").alias("year")).agg(F.count("*").alias("n"))


@register("SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F' OR o_totalprice > 200000")
def disjunctive_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where((F.col("o_orderstatus") == "F") | (F.col("o_totalprice") > 200000)).agg(F.count("*").alias("n"))


@register("SELECT year(o_orderdate) AS year, count(*) AS n FROM orders GROUP BY 1 ORDER BY year DESC LIMIT 10")
def count_by_year_last10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue(spark, sf_dir).groupBy(F.year("date").alias("year")).agg(F.count("*").alias("n")).orderBy(F.desc("year")).limit(10)


@register("""
    SELECT o_orderpriority AS tribunal, count(*) FILTER (o_orderstatus = 'F') AS n_f, count(*) FILTER (o_orderstatus = 'O') AS n_o,
      count(*) FILTER (o_orderstatus = 'P') AS n_p, count(*) FILTER (o_orderstatus = 'X') AS n_x FROM orders GROUP BY 1""")
def status_pivot_zero_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.status_pivot(queue(spark, sf_dir), ["tribunal"], "status", [*STATUSES, "X"])


@register("""
    SELECT count(*) AS total, min(CAST(o_orderdate AS DATE)) AS first_date, max(CAST(o_orderdate AS DATE)) AS last_date,
      array_to_string(list_sort(list(DISTINCT year(o_orderdate))), ',') AS years, count(*) * 5 AS estimated_mb FROM orders""")
def listing_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = listings.listing_statistics(queue(spark, sf_dir), "date")
    return stats.withColumn("years", F.array_join(F.transform("years", lambda y: y.cast("string")), ","))


@register("""
    SELECT count(*) AS total, count(*) FILTER (s = 'pending') AS pending, count(*) FILTER (s = 'downloading') AS downloading, count(*) FILTER (s = 'downloaded') AS downloaded,
      count(*) FILTER (s = 'uploading') AS uploading, count(*) FILTER (s = 'completed') AS completed, count(*) FILTER (s = 'failed') AS failed, round(count(*) FILTER (s = 'completed') * 100.0 / count(*), 6) AS completion_rate
    FROM (SELECT CASE WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderkey % 4 = 0 THEN 'downloading' WHEN o_orderkey % 4 = 1 THEN 'downloaded' WHEN o_orderkey % 4 = 2 THEN 'uploading' WHEN o_orderstatus = 'O' THEN 'pending' ELSE 'failed' END AS s FROM orders)""")
def pipeline_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    under_way = F.when(F.col("status") == "F", "completed").when(F.col("url") % 4 == 0, "downloading").when(F.col("url") % 4 == 1, "downloaded").when(F.col("url") % 4 == 2, "uploading")
    named = queue(spark, sf_dir).withColumn("status", under_way.when(F.col("status") == "O", "pending").otherwise("failed"))
    return queues.completion(named, ["pending", "downloading", "downloaded", "uploading", "completed", "failed"]).withColumn("completion_rate", F.round("completion_rate", 6))


_TABLES = ("customer", "lineitem", "orders", "part", "supplier", "events")


@register(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in _TABLES))
def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [table(spark, sf_dir, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("table_name"), "n") for t in _TABLES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


@register("SELECT coalesce(CAST(year(o_orderdate) AS VARCHAR), 'all') AS year, count(*) AS n, count(*) FILTER (o_orderstatus = 'O') AS n_new FROM orders GROUP BY ROLLUP (year(o_orderdate))")
def discovery_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = queue(spark, sf_dir).withColumn("y", F.year("date")).rollup("y").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "O").alias("n_new"))
    return rows.select(F.coalesce(F.col("y").cast("string"), F.lit("all")).alias("year"), "n", "n_new")


@register("""
    SELECT o_orderpriority AS tribunal, count(*) AS decisions, count(DISTINCT nullif(l_partkey, 1)) AS cases, count(DISTINCT l_suppkey) AS parties
    FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def distinct_cases_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    both = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("tribunal")).join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return both.groupBy("tribunal").agg(F.count("*").alias("decisions"), F.count_distinct(F.nullif("l_partkey", F.lit(1))).alias("cases"), F.count_distinct("l_suppkey").alias("parties"))


@register(r"SELECT keyword, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS keyword FROM benchmark) GROUP BY 1")
def keyword_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "benchmark").select(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)).alias("keywords"))
    return analytics.keyword_counts(words, "keywords")


@register("SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS period, o_orderpriority AS tribunal, o_orderstatus AS status, count(*) AS n FROM orders GROUP BY ALL")
def outcome_trend_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.outcome_trend(queue(spark, sf_dir), "created_at", ["tribunal", "status"])


@register("SELECT count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linenumber % 2 = 0")
def join_filter_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where("l_linenumber % 2 = 0").select("l_orderkey")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey")).join(lines, "l_orderkey").agg(F.count("*").alias("n"))


_DAYS = """e AS (SELECT CAST(unnest(generate_series(DATE '1995-01-01', DATE '1996-12-31', INTERVAL 1 DAY)) AS DATE) AS date),
    a AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' AND o_orderdate < DATE '1997-03-01')"""


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    start, end = F.lit(datetime.date(1995, 1, 1)), F.lit(datetime.date(1996, 12, 31))
    expected = spark.range(1).select(listings.day_series(start, end).alias("date"))
    archived = queue(spark, sf_dir).where((F.col("status") == "P") & (F.col("tribunal") == "1-URGENT") & (F.col("date") < datetime.date(1997, 3, 1)))
    return listings.coverage(expected, archived)


@register(f"""WITH {_DAYS}
    SELECT (SELECT count(*) FROM e) AS total_expected, (SELECT count(*) FROM a) AS total_archived,
      (SELECT count(*) FROM e WHERE date NOT IN (FROM a)) AS missing, (SELECT count(*) FROM a WHERE date NOT IN (FROM e)) AS extra,
      round((SELECT count(*) FROM e WHERE date IN (FROM a)) * 100.0 / (SELECT count(*) FROM e), 6) AS coverage_percent,
      (SELECT string_agg(CAST(date AS VARCHAR), ',' ORDER BY date) FROM a WHERE date NOT IN (FROM e)) AS extra_dates""")
def coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = listings.coverage_report(_days(spark, sf_dir))
    extra = F.nullif(F.array_join(F.transform("extra_dates", lambda d: d.cast("string")), ","), F.lit(""))
    return report.select("total_expected", "total_archived", "missing", "extra", F.round("coverage_percent", 6).alias("coverage_percent"), extra.alias("extra_dates"))


@register(f"WITH {_DAYS} SELECT date FROM e WHERE date NOT IN (FROM a)")
def missing_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _days(spark, sf_dir).where("in_expected AND NOT in_archive").select("date")


@register("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT')")
def anti_join_new_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "orders").where("o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return queues.insert_ignore(known, table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey")


@register("""
    WITH k AS (SELECT o_orderkey AS url, CAST(o_orderdate AS DATE) AS date, o_custkey AS number FROM orders WHERE o_orderstatus = 'F'),
    i AS (SELECT o_orderkey + 1 AS url, CAST(o_orderdate AS DATE) AS date, o_custkey AS number FROM orders WHERE o_orderstatus <> 'F')
    SELECT url, date, number FROM i WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.url = i.url OR (k.date = i.date AND k.number = i.number))""")
def disjunctive_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("url"), F.col("o_orderdate").cast("date").alias("date"), F.col("o_custkey").alias("number"), "o_orderstatus")
    known, items = rows.where("o_orderstatus = 'F'"), rows.where("o_orderstatus <> 'F'").withColumn("url", F.col("url") + 1)
    return queues.missing_from(items, known).select("url", "date", "number")


@register("""
    WITH u AS (SELECT o_custkey AS id, max(o_totalprice) AS mu, max_by(o_orderkey, o_orderdate) IS NOT NULL AS seen FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
    SELECT c_custkey AS advogado_id, coalesce(u.mu, c_acctbal) AS mu, coalesce(CASE WHEN u.id IS NOT NULL THEN 8.0 END, CAST(c_nationkey AS DOUBLE)) AS sigma,
      CAST(3 + CASE WHEN u.id IS NOT NULL THEN 1 ELSE 0 END AS INT) AS total_partidas FROM customer LEFT JOIN u ON u.id = c_custkey
    UNION ALL SELECT -s_suppkey - 1, s_acctbal, 8.0, 0 FROM supplier""")
def upsert_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = ratings(spark, sf_dir).withColumn("total_partidas", F.lit(3))
    updates = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").groupBy(F.col("o_custkey").alias("advogado_id")).agg(F.max("o_totalprice").alias("mu"))
    updates = updates.withColumns({"sigma": F.lit(8.0), "increment": F.lit(True)})
    fresh = table(spark, sf_dir, "supplier").select((-1 - F.col("s_suppkey")).alias("advogado_id"), F.col("s_acctbal").alias("mu"), F.lit(8.0).alias("sigma"), F.lit(False).alias("increment"))
    return queues.upsert_ratings(held, updates.unionByName(fresh))


@register("SELECT user_id, event_id, ts, event_type AS status FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def queue_latest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.col("event_type").alias("status"))
    return queues.current_state(rows, "user_id", ["ts", "event_id"])


@register("""
    SELECT o_custkey AS player, o_orderkey, o_totalprice AS rating, lag(o_totalprice) OVER w AS previous, round(o_totalprice - lag(o_totalprice) OVER w, 6) AS delta
    FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def rating_history_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("player"), "o_orderkey", "o_orderdate", F.col("o_totalprice").alias("rating"))
    return analytics.rating_history(rows, "player", ["o_orderdate", "o_orderkey"], "rating").drop("o_orderdate").withColumn("delta", F.round("delta", 6))


@register("""
    WITH r AS (SELECT user_id, event_type, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)
        - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS island FROM events)
    SELECT user_id, event_type, count(*) AS length, min(ts) AS first_ts, max(ts) AS last_ts FROM r GROUP BY user_id, event_type, island""")
def streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = analytics.streaks(table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id"), "user_id", ["ts", "event_id"], "event_type")
    return runs.select("user_id", "event_type", "length", F.col("first.ts").alias("first_ts"), F.col("last.ts").alias("last_ts"))


@register("""
    WITH m AS (SELECT DISTINCT o_orderkey, o_custkey AS a, l_suppkey AS b FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
    SELECT a, b, count(*) AS meetings FROM m GROUP BY 1, 2""")
def opponent_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    teams = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("team_b"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.array("o_custkey").alias("team_a"))
    return analytics.opponent_pairs(orders.join(teams, "l_orderkey"))


@register("SELECT CAST(ts AS DATE) AS metric_date, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def daily_event_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexarena.streaming.metrics import event_metrics

    rows = event_metrics(table(spark, sf_dir, "events"))
    return rows.select(F.col("metric_start").cast("date").alias("metric_date"), "event_type", "n", F.round("total", 4).alias("total"))


@register("SELECT count(*) AS n, sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS total FROM events")
def json_field_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.try_element_at(tolerant_map(F.col("props")), F.lit("k")).cast("long")
    return table(spark, sf_dir, "events").agg(F.count("*").alias("n"), F.sum(k).alias("total"))


@register("""
    SELECT least(11, greatest(0, CAST(floor((c_acctbal + 1000) / 1100) AS BIGINT) + 1)) AS bucket, count(*) AS n FROM customer GROUP BY 1""")
def rating_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.histogram(ratings(spark, sf_dir), F.col("mu"), -1000.0, 10000.0, 10)


@register(f"""
    WITH n AS (SELECT o_custkey AS id, count(*) AS total_partidas FROM orders WHERE o_orderdate >= DATE '2000-01-01' GROUP BY 1)
    SELECT r.*, total_partidas, mu - 3 * sigma AS conservative_skill FROM ({_RATINGS}) r JOIN n ON n.id = advogado_id WHERE total_partidas >= 3
    ORDER BY conservative_skill DESC, advogado_id LIMIT 20""")
def active_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    recent = table(spark, sf_dir, "orders").where(F.col("o_orderdate") >= F.lit(datetime.date(2000, 1, 1))).groupBy(F.col("o_custkey").alias("advogado_id"))
    return analytics.ranking(ratings(spark, sf_dir).join(recent.agg(F.count("*").alias("total_partidas")), "advogado_id"), 20, least_matches=3)


@register("""
    SELECT a.event_type AS a, b.event_type AS b, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) a
    JOIN (SELECT DISTINCT user_id, event_type FROM events) b ON a.user_id = b.user_id AND a.event_type < b.event_type GROUP BY 1, 2""")
def keyword_co_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("keywords"))
    return analytics.keyword_pairs(sets, "keywords")


@register("""
    SELECT event_type, count(*) AS n FROM events WHERE date_diff('day', CAST(ts AS DATE), DATE '2024-01-31')
      < CASE event_type WHEN 'click' THEN 7 WHEN 'view' THEN 14 ELSE 100000 END GROUP BY 1""")
def retention_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = analytics.retained(table(spark, sf_dir, "events"), "ts", {"click": 7, "view": 14}, "event_type", F.lit(datetime.date(2024, 1, 31)))
    return kept.groupBy("event_type").agg(F.count("*").alias("n"))


@register("""
    SELECT 'not_null' AS test, 'o_orderkey' AS "column", count(*) FILTER (o_orderkey IS NULL) AS failures FROM orders UNION ALL
    SELECT 'unique', 'o_orderkey', count(o_orderkey) - count(DISTINCT o_orderkey) FROM orders UNION ALL
    SELECT 'unique', 'o_custkey', count(o_custkey) - count(DISTINCT o_custkey) FROM orders UNION ALL
    SELECT 'accepted_values', 'o_orderstatus', count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) FROM orders""")
def column_quality_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexarena.operators.validate import quality_report

    return quality_report(table(spark, sf_dir, "orders"), ["o_orderkey"], ["o_orderkey", "o_custkey"], {"o_orderstatus": ["F", "O"]})


@register("SELECT s_suppkey, s_acctbal, s_name FROM supplier ORDER BY s_acctbal DESC, s_name LIMIT 5")
def slowest_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("seconds"), F.col("s_name").alias("node"))
    return analytics.slowest(rows).select("s_suppkey", F.col("seconds").alias("s_acctbal"), F.col("node").alias("s_name"))


@register("""
    SELECT row_number() OVER (ORDER BY c_custkey) + (SELECT max(o_orderkey) FROM orders) AS id, c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'""")
def insert_with_new_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    rows = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    return queues.with_new_ids(held, rows, ["c_custkey"]).select(F.col("id").cast("long").alias("id"), "c_custkey")
