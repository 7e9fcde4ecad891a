"""Text, identifiers, personal data, validation, ratings and chunks on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexarena.functions import hashing, text
from lexarena.operators import anonymize, dedupe, listings, rating, rating_blocks, standardize, validate
from lexarena.plans.registry import register
from lexarena.session import table

_NS = hashing.DEFAULT_NAMESPACE.hex


def _uuid_sql(name: str) -> str:
    """DuckDB SQL for the version-5 UUID of an expression (ASCII names: the namespace's bytes come first as a blob)."""
    h = f"sha1(unhex('{_NS}') || encode({name}))"
    return (
        f"(SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') "
        f"|| substr(h, 18, 3) || '-' || substr(h, 21, 12) FROM (SELECT {h} AS h))"
    )


@register(f"SELECT c_custkey, {_uuid_sql("'PARTY_NAME:' || c_name")} AS pii_uuid FROM customer")
def pii_uuid5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", hashing.pii_uuid("PARTY_NAME", F.col("c_name")).alias("pii_uuid"))


@register(f"""
    SELECT {_uuid_sql("'SEGMENT:' || ref")} AS pii_uuid, CASE WHEN ref = 'BUILDING' THEN 'known before' ELSE original_value END AS original_value, ref AS value_for_uuid_ref, 'SEGMENT' AS pii_type
    FROM (SELECT c_mktsegment AS ref, min_by(c_name, c_custkey) AS original_value FROM customer GROUP BY 1)""")
def get_or_create_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = table(spark, sf_dir, "customer").select(F.lit("SEGMENT").alias("pii_type"), F.col("c_name").alias("original_value"), F.col("c_mktsegment").alias("value_for_uuid_ref"), F.col("c_custkey").alias("seq"))
    known = spark.createDataFrame([("known before", "BUILDING", "SEGMENT")], "original_value string, value_for_uuid_ref string, pii_type string")
    known = known.withColumn("pii_uuid", hashing.pii_uuid(F.col("pii_type"), F.col("value_for_uuid_ref")))
    return anonymize.extend_map(known, values)[0]


@register(f"""
    SELECT c_custkey, {_uuid_sql("'PARTY_NAME:' || c_name")} AS pii_uuid, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN c_name END AS original_value,
      CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'PARTY_NAME' END AS pii_type FROM customer""")
def pii_decode_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = table(spark, sf_dir, "customer").withColumn("pii_uuid", hashing.pii_uuid("PARTY_NAME", F.col("c_name")))
    known = people.where("c_mktsegment IN ('BUILDING', 'MACHINERY')").select("pii_uuid", F.col("c_name").alias("original_value"), F.lit("PARTY_NAME").alias("pii_type"))
    out, _ = anonymize.decode(people.select("pii_uuid", "c_custkey"), known, True, "query", F.lit(None).cast("timestamp"))
    return out


@register(f"""
    WITH t AS (SELECT DISTINCT o_orderkey, l_suppkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
    SELECT o_orderkey, {_uuid_sql("'LAWYER:' || CAST(l_suppkey AS VARCHAR)")} AS lawyer FROM t""")
def pii_array_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    teams = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set(F.col("l_suppkey").cast("string")).alias("team"))
    named = table(spark, sf_dir, "orders").select("o_orderkey").join(teams, "o_orderkey")
    return named.select("o_orderkey", F.explode(anonymize.replace_list("LAWYER", F.col("team"))).alias("lawyer"))


_FOLD = f"translate(regexp_replace(replace(upper(text), 'ẞ', 'SS'), '^[\\s\\p{{Z}}\\x0B\\x1C-\\x1F\\x85]*((DOUTORA|DOUTOR|DRA\\.|DR\\.|DRA|DR)[\\s\\p{{Z}}\\x0B\\x1C-\\x1F\\x85]*)*', ''), '{text.ACCENTED}', '{text.PLAIN}')"


@register(rf"SELECT doc_id, md5(trim(regexp_replace({_FOLD}, '[\s\p{{Z}}\x0B\x85]+', ' ', 'g'))) AS name_md5 FROM documents")
def normalize_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.normalize_lawyer_name(F.col("text"))).alias("name_md5"))


@register(r"""
    SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS host,
      coalesce(try_cast(try_strptime(regexp_extract(u, '(?i)diario(?:jus)?(?:tj)?(\d{8})', 1), '%Y%m%d') AS DATE),
        try_cast(try_strptime(regexp_extract(u, '(?i)(?:data=|date=|dt=)(\d{8})', 1), '%Y%m%d') AS DATE),
        try_cast(try_strptime(regexp_replace(regexp_extract(u, '\d{4}[/_-]?\d{2}[/_-]?\d{2}'), '[/_-]', '', 'g'), '%Y%m%d') AS DATE),
        try_cast(try_strptime(regexp_replace(regexp_extract(u, '\d{2}[/_-]?\d{2}[/_-]?\d{4}'), '[/_-]', '', 'g'), '%d%m%Y') AS DATE)) AS date,
      nullif(regexp_extract(u, '/novodiario/(\d{4})/', 1), '') AS year, nullif(regexp_extract(u, '(?i)-NR(\d+)', 1), '') AS edition
    FROM (SELECT *, url || '/novodiario/2024/' || CAST(20240101 + page_id % 40 AS VARCHAR) || '614-NR' || CAST(page_id AS VARCHAR) || '.pdf' AS u FROM pages)""")
def url_host_and_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.concat("url", F.lit("/novodiario/2024/"), (F.lit(20240101) + F.col("page_id") % 40).cast("string"), F.lit("614-NR"), F.col("page_id").cast("string"), F.lit(".pdf"))
    rows = table(spark, sf_dir, "pages").select("page_id", "url", u.alias("u"))
    meta = text.url_metadata(F.col("u"))
    return rows.select("page_id", text.url_host(F.col("url")).alias("host"), text.date_from_url(F.col("u")).alias("date"), meta["year"].alias("year"), meta["edition"].alias("edition"))


@register("""
    SELECT o_orderkey, 'tjro-diario-' || strftime(o_orderdate, '%Y-%m-%d') || '-' || lower(o_orderstatus) AS ia_identifier,
      'dj_' || strftime(o_orderdate, '%Y%m%d') || '_' || o_orderstatus || '.pdf' AS file_name, 'TJRO - ' || strftime(o_orderdate, '%Y-%m-%d') AS display_name FROM orders""")
def archive_identifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    date = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", text.archive_identifier(F.lit("tjro"), date, F.col("o_orderstatus")).alias("ia_identifier"),
        text.gazette_file_name(date, F.col("o_orderstatus")).alias("file_name"), text.display_name(F.lit("tjro"), date).alias("display_name"),
    )


#: Raw decisions by case, for validation.
_NUMBER = '"numero_processo":"0001234-56.2023.8.22.0001"'
_SIDES = '"partes":{"requerente":["A"],"requerido":"B"}'
CASES = [
    ("valid", f'{{{_NUMBER},{_SIDES},"resultado":"procedente"}}', None),
    ("no_number", f'{{{_SIDES},"resultado":"procedente"}}', "numero_missing"),
    ("empty_number", f'{{"numero_processo":"",{_SIDES},"resultado":"x"}}', "numero_missing"),
    ("short_number", f'{{"numero_processo":"123.456",{_SIDES},"resultado":"x"}}', "numero_pattern"),
    ("number_type", f'{{"numero_processo":12345,{_SIDES},"resultado":"x"}}', "numero_type"),
    ("extra_number", f'{{"numero_processo":"1234-56.2023.8.22.0001-EXTRA",{_SIDES},"resultado":"x"}}', "numero_pattern"),
    ("no_parties", f'{{{_NUMBER},"resultado":"x"}}', "ativo_missing"),
    ("text_parties", f'{{{_NUMBER},"partes":"A x B","resultado":"x"}}', "ativo_missing"),
    ("empty_side", f'{{{_NUMBER},"partes":{{"requerente":[],"requerido":"B"}},"resultado":"x"}}', "ativo_missing"),
    ("blank_items", f'{{{_NUMBER},"partes":{{"requerente":[""],"requerido":"B"}},"resultado":"x"}}', "ativo_empty_items"),
    ("side_type", f'{{{_NUMBER},"partes":{{"requerente":123,"requerido":"B"}},"resultado":"x"}}', "ativo_type"),
    ("no_passive", f'{{{_NUMBER},"partes":{{"requerente":["A"]}},"resultado":"x"}}', "passivo_missing"),
    ("no_result", f"{{{_NUMBER},{_SIDES}}}", "resultado_missing"),
    ("list_result", f'{{{_NUMBER},{_SIDES},"resultado":[]}}', "resultado_missing"),
    ("result_type", f'{{{_NUMBER},{_SIDES},"resultado":5}}', "resultado_type"),
    ("new_layout", f'{{{_NUMBER},"polo_ativo":"A","polo_passivo":"B","resultado":"x"}}', None),
]


def _case(values: list) -> str:
    """DuckDB SQL for the value of a customer's case, by its key."""
    whens = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values) if v is not None)
    return f"CASE c_custkey % {len(values)} {whens} END"


def _dealt(spark: SparkSession, sf_dir: str, texts: list[str]) -> DataFrame:
    """(c_custkey, json): each customer with one of the texts, by its key."""
    return table(spark, sf_dir, "customer").select("c_custkey", F.get(F.array(*(F.lit(t) for t in texts)), (F.col("c_custkey") % len(texts)).cast("int")).alias("json"))


@register(f"SELECT c_custkey, {_case([n for n, _, _ in CASES])} AS name, {_case([r for _, _, r in CASES])} AS reject_reason FROM customer")
def validate_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raw decision of each customer, one of the cases, and why it is rejected."""
    names = F.get(F.array(*(F.lit(n) for n, _, _ in CASES)), (F.col("c_custkey") % len(CASES)).cast("int"))
    return _dealt(spark, sf_dir, [j for _, j, _ in CASES]).select("c_custkey", names.alias("name"), validate.reject_reason(F.parse_json("json")).alias("reject_reason"))


@register("""
    SELECT c_custkey, t.* EXCLUDE (id) FROM customer JOIN (VALUES (0, '1', 'x', DATE '2024-05-06', 'A', ''), (1, '2', 'decided', DATE '2024-01-01', 'L1|L2', 'M'), (2, '', '', DATE '2024-01-01', '', ''))
      t(id, numero_processo, resultado, data_decisao, ativo, passivo) ON t.id = c_custkey % 3""")
def standardize_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raw decision of each customer under one of three layouts as a canonical one."""
    raw = [
        '{"process_number":"1","outcome":"x","decision":"y","decision_date":"2024-05-06","active_party":"A"}',
        '{"numero_processo":"2","outcome":"","decision":"decided","active_party":["P"],"advogados_ativo":["L1","L2"],"passive_party":"M"}',
        "{}",
    ]
    rows = _dealt(spark, sf_dir, raw).withColumn("d", standardize.standardize(F.parse_json("json"), F.lit("2024-01-01").cast("date")))
    return rows.select("c_custkey", "d.numero_processo", "d.resultado", "d.data_decisao", F.array_join("d.polo_ativo", "|").alias("ativo"), F.array_join("d.polo_passivo", "|").alias("passivo"))


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as matches: the customer against the order's suppliers."""
    teams = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_suppkey")).alias("team_b"))
    outcome = F.when(F.col("o_orderstatus") == "F", "win_a").when(F.col("o_orderstatus") == "O", "win_b").otherwise("draw")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("court"), F.col("o_orderdate").alias("date"), "o_custkey", outcome.alias("outcome"))
    return orders.join(teams, "l_orderkey")


@register("""
    WITH t AS (SELECT o_orderkey, any_value(o_orderstatus) AS s, any_value(c_acctbal) / 400 AS mu, count(DISTINCT l_suppkey) AS n
        FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY 1),
    v AS (SELECT *, (25.0 / 3) ^ 2 + (25.0 / 15) ^ 2 AS v, CASE s WHEN 'F' THEN 1.0 WHEN 'O' THEN 0.0 ELSE 0.5 END AS w FROM t),
    c AS (SELECT *, v AS s2a, n * v AS s2b, sqrt(v + n * v + 2 * (25.0 / 6) ^ 2) AS c FROM v),
    p AS (SELECT *, 1 / (1 + exp((n * 25.0 - mu) / c)) AS p FROM c)
    SELECT o_orderkey, round(mu + s2a / c * (w - p), 6) AS mu_a,
      round(sqrt(v * greatest(1 - sqrt(s2a) / c * (s2a / (c * c)) * p * (1 - p), 0.0001)), 6) AS sigma_a,
      round(25.0 - v / s2b * (s2b / c) * (w - p), 6) AS mu_b, round(sqrt(v * greatest(1 - v / s2b * (sqrt(s2b) / c * (s2b / (c * c)) * p * (1 - p)), 0.0001)), 6) AS sigma_b FROM p""")
def rate_independent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every match rated from priors: team A's player by account balance, team B's at the default."""
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_acctbal") / 400).alias("mu"))
    rows = _matches(spark, sf_dir).join(people, "o_custkey")
    prior = rating.Model()
    a = F.array(F.struct("mu", F.lit(prior.sigma).alias("sigma")))
    b = F.transform("team_b", lambda _: F.struct(F.lit(prior.mu).alias("mu"), F.lit(prior.sigma).alias("sigma")))
    out = rows.select(F.col("l_orderkey").alias("o_orderkey"), rating.rate_teams(a, b, F.col("outcome")).alias("r"))
    six = lambda c, n: F.round(c, 6).alias(n)
    return out.select("o_orderkey", six(F.col("r.a")[0]["mu"], "mu_a"), six(F.col("r.a")[0]["sigma"], "sigma_a"), six(F.col("r.b")[0]["mu"], "mu_b"), six(F.col("r.b")[0]["sigma"], "sigma_b"))


def _fold_sql(stored: bool, columns: str, weight: str = "1.0") -> str:
    """DuckDB SQL for the ordered fold: one recursion a match of each court, ratings kept by player."""
    mu, sigma, n = ("coalesce(20.0 + s_nationkey, 25.0)", "CASE WHEN s_nationkey IS NULL THEN 25.0 / 3 ELSE 7.0 END", "CASE WHEN s_nationkey IS NULL THEN 0 ELSE 10 END") if stored else ("25.0", "25.0 / 3", "0")
    return f"""
    WITH RECURSIVE lines AS (SELECT l_orderkey, list(DISTINCT l_suppkey) AS b FROM lineitem GROUP BY 1),
    m AS MATERIALIZED (SELECT o_orderpriority AS court, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS i,
        CASE o_orderstatus WHEN 'F' THEN 1.0 WHEN 'O' THEN 0.0 ELSE 0.5 END AS won, CAST({weight} AS DOUBLE) AS weight, list_concat([-1 - o_custkey], b) AS players FROM orders JOIN lines ON l_orderkey = o_orderkey),
    p AS MATERIALIZED (SELECT court, i, won, weight, unnest(players) AS player, generate_subscripts(players, 1) = 1 AS is_a FROM m),
    r(court, player, i, mu, sigma, n, mu_before, sigma_before) USING KEY (court, player) AS (
      SELECT DISTINCT court, player, CAST(0 AS BIGINT), CAST({mu} AS DOUBLE), CAST({sigma} AS DOUBLE), CAST({n} AS BIGINT), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE)
        FROM p LEFT JOIN supplier ON s_suppkey = player
      UNION
      SELECT q.court, q.player, q.step, q.mu + q.v / q.c * (CASE WHEN is_a THEN 1 ELSE -1 END) * (won - pa) * weight,
        sqrt(q.v * greatest(1 - q.v / q.s2 * (sqrt(q.s2) / q.c * q.s2 / (q.c * q.c) * pa * (1 - pa) * weight), 0.0001)), n + 1, q.mu, q.sigma
      FROM (SELECT *, 1 / (1 + exp((mu_b - mu_a) / c)) AS pa, CASE WHEN is_a THEN s2a ELSE s2b END AS s2
        FROM (SELECT *, sqrt(s2a + s2b + 2 * (25.0 / 6) ^ 2) AS c
          FROM (SELECT x.*, sum(v) FILTER (is_a) OVER w AS s2a, sum(v) FILTER (NOT is_a) OVER w AS s2b, sum(mu) FILTER (is_a) OVER w AS mu_a, sum(mu) FILTER (NOT is_a) OVER w AS mu_b
            FROM (SELECT p.court, p.player, p.i AS step, p.won, p.weight, p.is_a, s.mu, s.sigma, s.n, s.sigma ^ 2 + (25.0 / 15) ^ 2 AS v
              FROM p JOIN (SELECT max(i) + 1 AS step FROM r) t ON p.i = t.step JOIN recurring.r s ON s.court = p.court AND s.player = p.player) x
            WINDOW w AS (PARTITION BY court, step)))) q)
    SELECT court, player, {columns} FROM r WHERE i > 0"""


@register(_fold_sql(False, "round(mu, 6) AS mu, round(sigma, 6) AS sigma, n AS matches"))
def rate_sequential(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings after all matches of each court, in order of date and key."""
    matches = _matches(spark, sf_dir).withColumns({"team_a": F.array(-1 - F.col("o_custkey"))})
    out = rating.rate_sequence(matches, "court", ["date", "l_orderkey"])
    return out.select("court", "player", F.round("mu", 6).alias("mu"), F.round("sigma", 6).alias("sigma"), "matches")


@register(_fold_sql(False, "round(mu, 6) AS mu, round(sigma, 6) AS sigma, n AS matches", "CASE WHEN o_totalprice >= 150000 THEN 1.5 ELSE 0.5 END"))
def rate_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As rate_sequential, with three times as much weight on matches about large sums."""
    sums = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.when(F.col("o_totalprice") >= 150000, 1.5).otherwise(0.5).alias("weight"))
    matches = _matches(spark, sf_dir).withColumns({"team_a": F.array(-1 - F.col("o_custkey"))}).join(sums, "l_orderkey")
    out = rating.rate_sequence(matches, "court", ["date", "l_orderkey"])
    return out.select("court", "player", F.round("mu", 6).alias("mu"), F.round("sigma", 6).alias("sigma"), "matches")


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored rating of ten matches for each supplier in each court."""
    people = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("player"), (20.0 + F.col("s_nationkey")).alias("mu"), F.lit(7.0).alias("sigma"), F.lit(10).alias("matches"))
    courts = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("court")).distinct()
    return people.withColumn("court", F.explode(F.array(*(F.lit(c) for c in sorted(r["court"] for r in courts.collect())))))  # a handful of courts


@register(_fold_sql(True, "round(mu_before, 6) AS mu_before, round(sigma_before, 6) AS sigma_before, round(mu, 6) AS mu, round(sigma, 6) AS sigma, n AS matches"))
def rate_history_from_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each player's last match in each court: ratings before and after it, from suppliers' stored ratings of ten matches."""
    matches = _matches(spark, sf_dir).withColumns({"team_a": F.array(-1 - F.col("o_custkey"))})
    last = rating.last_matches(matches, "court", ["date", "l_orderkey"], _stored(spark, sf_dir))
    return last.select("court", "player", *(F.round(c, 6).alias(c) for c in ("mu_before", "sigma_before", "mu", "sigma")), "matches")


@register(_fold_sql(True, "round(mu, 6) AS mu, round(sigma, 6) AS sigma, n AS matches"))
def rate_in_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings after all matches of each court, from the stored ones, folded by blocks of time and by the players they link."""
    matches = _matches(spark, sf_dir).withColumns({"team_a": F.array(-1 - F.col("o_custkey"))})
    stored = _stored(spark, sf_dir)
    final = rating_blocks.rate_sequence_in_blocks(matches, "court", ["date", "l_orderkey"], stored, blocks=6)
    played = final.join(stored.select("court", "player", F.lit(True).alias("was_stored")), ["court", "player"], "left").where("was_stored IS NULL OR matches > 10")
    return played.select("court", "player", F.round("mu", 6).alias("mu"), F.round("sigma", 6).alias("sigma"), "matches")


@register("""
    WITH p AS (SELECT conv_id, turn, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations),
    c AS (SELECT conv_id, turn, turn // 2 AS chunk, false AS overlap FROM p UNION ALL SELECT conv_id, turn, turn // 2 + 1, true FROM p WHERE (turn + 1) % 2 = 0 AND turn < last)
    SELECT conv_id, chunk, count(*) AS pages, count(*) FILTER (overlap) AS overlaps, min(turn) AS first_page, max(turn) AS last_page FROM c GROUP BY 1, 2""")
def chunk_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listings.chunk_assignments(table(spark, sf_dir, "conversations").select("conv_id", "turn"), "conv_id", "turn", size=2)
    return rows.groupBy("conv_id", "chunk").agg(F.count("*").alias("pages"), F.count_if("overlap").alias("overlaps"), F.min("turn").alias("first_page"), F.max("turn").alias("last_page"))


@register("""
    WITH RECURSIVE it AS MATERIALIZED (SELECT o_orderkey AS seq, o_custkey || '/' || o_orderstatus AS url, CAST(o_orderdate AS DATE) AS date, o_orderpriority AS number FROM orders),
    r(seq, state) USING KEY (seq) AS (
      SELECT seq, 0 FROM it
      UNION
      SELECT seq, CASE WHEN seq = u AND seq = d THEN 1 ELSE 2 END FROM (
        SELECT *, bool_or(seq = u AND seq = d) OVER (PARTITION BY url) AS url_taken, bool_or(seq = u AND seq = d) OVER (PARTITION BY date, number) AS day_taken FROM (
          SELECT it.*, min(seq) OVER (PARTITION BY url) AS u, min(seq) OVER (PARTITION BY date, number) AS d
          FROM it WHERE seq IN (SELECT seq FROM recurring.r WHERE state = 0) AND (SELECT count(*) FROM r) > 0))
      WHERE url_taken OR day_taken)
    SELECT seq, url, date, number FROM it WHERE seq IN (SELECT seq FROM r WHERE state = 1)""")
def greedy_batch_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders accepted in key order: refused if an accepted one has the same customer and status group, or date and priority."""
    items = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("seq"), F.concat_ws("/", "o_custkey", "o_orderstatus").alias("url"), F.col("o_orderdate").cast("date").alias("date"), F.col("o_orderpriority").alias("number"))
    return dedupe.accept_in_order(items)


@register(r"""
    SELECT count(*) AS n, sum(len(name)) AS chars FROM (SELECT coalesce(nullif(regexp_replace(url, '[^\w.\-]', '', 'g'), ''), 'default_filename') AS name FROM pages)""")
def sanitized_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "pages").select(text.sanitize_filename(F.col("url")).alias("name"))
    return names.agg(F.count("*").alias("n"), F.sum(F.length("name")).cast("long").alias("chars"))


@register("SELECT page_id, sha256(html) AS sha256_hash, substr(sha256(html), 1, 12) AS item_id, substr(sha1(html), 1, 8) AS version FROM pages")
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.encode("html", "UTF-8")
    return table(spark, sf_dir, "pages").select("page_id", hashing.content_sha256(html).alias("sha256_hash"), hashing.item_id(html).alias("item_id"), hashing.prompt_version(html).alias("version"))
