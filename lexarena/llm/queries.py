"""The registered queries of the operators: each reads its whole table and applies one operator."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexarena.llm import bitpack, cascade, decontam, lm, mixing, neardup, packing, pii, repair, revisit, rollup, toxicity, trie
from lexarena.llm.common import save, shared_dir, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def vocabulary_file(name: str) -> str:
    """Where the installed package of public tokenizers keeps a file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_mixing_to_target_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's topic, tokens, raked cell weight, probability and whether it is sampled."""
    out = mixing.mix_to_targets(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "topic", "n_tokens", F.round("weight", 6).alias("weight"), F.round("probability", 6).alias("probability"), "sampled")


ORACLES["op1_mixing_to_target_weights"] = mixing.oracle()


@query
def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and benchmark item that it leaks."""
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base measures of each document and whether the cascade keeps it."""
    out = cascade.cascade(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLES["op4_quality_rules"] = r"""
    WITH w AS (
      SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
      FROM documents),
    grams AS (
      SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3),
    named AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM grams),
    dup AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM named),
    covered AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM dup, range(3) t(j) WHERE n > 1 GROUP BY doc_id),
    m AS (
      SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words,
        CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines,
        length(regexp_replace(text, '[^!]', '', 'g')) AS n_exclaims, len(regexp_extract_all(text, '\p{Lu}{2,}')) AS n_shouts
      FROM w LEFT JOIN covered USING (doc_id)),
    f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
      NOT (base_failed OR 100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 30 * n_lines OR word_chars < 2 * n_words
        OR word_chars > 15 * n_words OR 100 * n_exclaims > 30 * n_words OR 100 * n_shouts > 30 * n_words) AS kept
    FROM f"""


@query
def op5_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document's ids lie in the packed files, read back from them."""
    path = f"{shared_dir(spark)}/token-shards-{uuid.uuid4().hex}"
    bitpack.encode_shards(table(spark, sf_dir, "documents"), path, vocabulary_file("byte_bpe_50k.json"), end_id=2)
    return bitpack.read_documents(spark, path)


@query
def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept over 4-word shingles at a similarity of 0.8."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), k=4)


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stupid-backoff score of every document, bigrams over the counts of all others."""
    return lm.stupid_backoff(table(spark, sf_dir, "documents"))


ORACLES["op7_lm_scoring"] = r"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    t AS (SELECT r, doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
    g AS (SELECT r, doc_id, i, w[i] AS w1, CASE WHEN i > 1 THEN w[i - 1] END AS w0 FROM t),
    uni AS (SELECT w1, count(*) AS c FROM g GROUP BY w1), uni_d AS (SELECT r, w1, count(*) AS c FROM g GROUP BY r, w1),
    bi AS (SELECT w0, w1, count(*) AS c FROM g WHERE i > 1 GROUP BY w0, w1), bi_d AS (SELECT r, w0, w1, count(*) AS c FROM g WHERE i > 1 GROUP BY r, w0, w1),
    s AS (SELECT g.r, g.doc_id, g.i, u.c - ud.c AS c1, coalesce(v.c - vd.c, 0) AS c0, coalesce(b.c - bd.c, 0) AS c01,
        (SELECT count(*) FROM g) - len(d.w) AS n
      FROM g JOIN d ON d.r = g.r JOIN uni u ON u.w1 = g.w1 JOIN uni_d ud ON ud.r = g.r AND ud.w1 = g.w1
      LEFT JOIN uni v ON v.w1 = g.w0 LEFT JOIN uni_d vd ON vd.r = g.r AND vd.w1 = g.w0
      LEFT JOIN bi b ON b.w0 = g.w0 AND b.w1 = g.w1 LEFT JOIN bi_d bd ON bd.r = g.r AND bd.w0 = g.w0 AND bd.w1 = g.w1),
    m AS (SELECT r, CAST(round_even(1000000 * CASE WHEN i = 1 THEN ln((c1 + 1) / (n + 1)) WHEN c01 > 0 AND c0 > 0 THEN ln(c01 / c0)
        ELSE ln(0.4) + ln((c1 + 1) / (n + 1)) END, 0) AS BIGINT) AS micro FROM s)
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(sum(micro), 0) AS BIGINT) AS score_micro
    FROM d LEFT JOIN m ON m.r = d.r GROUP BY d.r, d.doc_id, len(w)"""


@query
def op3_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every revisit of a crawl over pages, with the response it stands for and its merged headers."""
    out = revisit.resolve(revisit.crawl_of(table(spark, sf_dir, "pages")))
    headers = F.array_join(F.transform("headers", lambda e: F.concat(e["name"], F.lit("="), e["value"])), ";")
    return out.select("record_id", "url", "response_id", "state", "digest", "length", headers.alias("headers"))


ORACLES["op3_warc_revisits"] = r"""
    WITH p AS (
      SELECT page_id, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^https?://', '', 'i') AS rest, md5(coalesce(html, '')) AS digest,
        CAST(strlen(coalesce(html, '')) AS BIGINT) AS length, page_id * 60 AS ts FROM pages),
    q AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^[^/?]*')), ':(80|443)$', ''), '^(www|m)\.', '') AS host,
        regexp_replace(regexp_extract(rest, '^[^/?]*(.*)$', 1), '([?&])(ref|utm_[a-z]*)=[^&]*', '\1', 'g') AS tail FROM p),
    c AS (SELECT *, host || regexp_replace(regexp_replace(replace(regexp_replace(tail, '&+', '&', 'g'), '?&', '?'), '[?&]$', ''), '/$', '') AS url FROM q),
    full_ AS (SELECT url, ts, page_id * 4 AS response_id, digest, length FROM c),
    v AS (
      SELECT page_id * 4 + 1 AS record_id, url, ts, ts - 86400 AS at, substr(digest, 1, 16) AS etag, 'W/' AS weak, 'max-age=1' AS age FROM c UNION ALL
      SELECT page_id * 4 + 2, url, ts, ts + 604800, substr(digest, 1, 16), 'W/', 'max-age=60' FROM c UNION ALL
      SELECT page_id * 4 + 3, url, ts, ts + 1209600, reverse(substr(digest, 1, 16)), '', 'max-age=90' FROM c),
    last AS (SELECT v.record_id, max(struct_pack(ts := f.ts, id := f.response_id)) AS r FROM v JOIN full_ f ON f.url = v.url AND f.ts < v.at GROUP BY v.record_id),
    j AS (SELECT v.*, f.response_id, f.digest, f.length, f.response_id IS NOT NULL AND substr(f.digest, 1, 16) = v.etag AS same
      FROM v LEFT JOIN last USING (record_id) LEFT JOIN full_ f ON f.response_id = last.r.id)
    SELECT record_id, url, response_id, CASE WHEN response_id IS NULL THEN 'no_response' WHEN same THEN 'resolved' ELSE 'mismatch' END AS state,
      CASE WHEN same THEN digest END AS digest, CASE WHEN same THEN length END AS length,
      CASE WHEN same THEN 'cache-control=' || age || ';content-length=' || length || ';content-type=text/html;date=' || ts || ';etag=' || weak || etag END AS headers
    FROM j"""


@query
def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base spans of each document, counted and hashed, and all spans."""
    return pii.find(table(spark, sf_dir, "documents")).drop("base", "found")


@query
def op10_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after five batches over documents, one of them applied twice.

    Inserts of word counts, deletes of documents under 50 words, revisions of documents with tables to
    counts without their bars, inserts of piece counts; then the deletes once more, which change nothing.
    """
    text = F.col("text")
    counts = {"n": cascade.n_words(text), "pieces": rollup.n_pieces(text), "bars": cascade.n_chars_of(text, "|"), "has_table": F.coalesce(F.contains(text, F.lit(" | ")), F.lit(False))}
    docs = save(table(spark, sf_dir, "documents").select("source", "lang", *(c.alias(k) for k, c in counts.items())), "token-counts")  # each text is read once
    held = rollup.TokenTotals(spark, f"{shared_dir(spark)}/token-totals-{uuid.uuid4().hex}")
    change = lambda df, kind, tokenizer, n="n", old=None: df.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(kind).alias("change"), F.col(n).alias("n_tokens"), (F.col(old) if old else F.lit(None).cast("long")).alias("old_tokens"))
    deletes = change(docs.where("n < 50"), "delete", "words-1")
    revised = docs.where("n >= 50 AND has_table").withColumn("new", F.col("n") - F.col("bars"))
    held.apply("insert-words", change(docs, "insert", "words-1"))
    held.apply("delete-short", deletes)
    held.apply("revise-tables", change(revised, "revise", "words-1", "new", "n"))
    held.apply("insert-pieces", change(docs, "insert", "pieces-2", "pieces"))
    held.apply("delete-short", deletes)
    return held.totals()


ORACLES["op10_token_rollups"] = r"""
    WITH d AS (
      SELECT coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(text, '') AS text,
        len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n,
        len(regexp_extract_all(coalesce(text, ''), '\p{L}+|\p{Nd}+|[^\p{L}\p{Nd}\x20\x09-\x0D]')) AS pieces FROM documents),
    t AS (
      SELECT source, lang, 'words-1' AS tokenizer, 1 AS docs, CASE WHEN contains(text, ' | ') THEN n - length(regexp_replace(text, '[^|]', '', 'g')) ELSE n END AS tokens
      FROM d WHERE n >= 50 UNION ALL SELECT source, lang, 'pieces-2', 1, pieces FROM d)
    SELECT source, lang, tokenizer, CAST(sum(docs) AS BIGINT) AS docs, CAST(sum(tokens) AS BIGINT) AS tokens FROM t GROUP BY ALL"""


#: One row: the table of the CRC-32 of each byte value.
SQL_CRC_TABLE = """crc AS (SELECT list(list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: xor(c >> 1, (c & 1) * 3988292384)) ORDER BY i) AS t FROM range(256) r(i))"""


def sql_crc32(e: str) -> str:
    """DuckDB SQL for the CRC-32 of an ASCII string, beside the table crc."""
    codes = f"list_transform(range(1, length({e}) + 1), lambda i: CAST(ascii({e}[i]) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1])), 4294967295)"


@query
def op11_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of the rebuilt conversations, with its subtree sums."""
    return trie.trie_of(table(spark, sf_dir, "conversations"))


ORACLES["op11_conversation_prefix_trie"] = f"""
    WITH {SQL_CRC_TABLE},
    src AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
    t AS (SELECT conv_id, sha256(length(role) || ':' || role || text) AS turn, CAST(length(text) AS BIGINT) AS chars,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) AS pos FROM src),
    c AS (SELECT conv_id, CAST(conv_id AS VARCHAR) AS name FROM t GROUP BY conv_id),
    ch AS (SELECT conv_id, {sql_crc32("name")} % 6 AS h FROM c, crc),
    r AS (
      SELECT ch.conv_id, 0 AS side, t.pos, t.turn, t.chars FROM ch JOIN t ON t.conv_id = ch.conv_id - ch.conv_id % 100 AND t.pos <= h UNION ALL
      SELECT ch.conv_id, 1, t.pos, t.turn, t.chars FROM ch JOIN t ON t.conv_id = ch.conv_id AND t.pos > h),
    l AS (SELECT conv_id, list(turn ORDER BY side, pos) AS turns, list(chars ORDER BY side, pos) AS chars FROM r GROUP BY conv_id),
    d AS (SELECT ch.conv_id, coalesce(turns, []) AS turns, coalesce(chars, []) AS chars, unnest(range(0, coalesce(len(turns), 0) + 1)) AS d FROM ch LEFT JOIN l USING (conv_id)),
    p AS (
      SELECT conv_id, CAST(d AS BIGINT) AS depth, sha256(array_to_string(turns[1:d], '')) AS k, CASE WHEN d > 0 THEN sha256(array_to_string(turns[1:d - 1], '')) END AS up,
        CASE WHEN d > 0 THEN chars[d] ELSE 0 END AS chars, d = len(turns) AS ends FROM d),
    n AS (
      SELECT depth, k, up, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(chars) AS own,
        sha256(coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM p GROUP BY depth, k, up),
    kids AS (SELECT up AS k, depth - 1 AS depth, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
    s AS (
      SELECT p.depth, p.k, sum(n.own) AS saved_tokens, count(*) FILTER (WHERE kids.k IS NULL) AS n_leaves
      FROM n LEFT JOIN kids USING (depth, k) JOIN p ON p.conv_id = n.conv_id AND p.depth <= n.depth GROUP BY p.depth, p.k)
    SELECT n.conv_id, n.depth, q.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
    FROM n JOIN s USING (depth, k) LEFT JOIN kids USING (depth, k) LEFT JOIN n q ON q.k = n.up AND q.depth = n.depth - 1"""


@query
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The faults, cost, audit and repaired digest of every conversation, after planted damage."""
    conversations = table(spark, sf_dir, "conversations")
    return repair.report(repair.damage(conversations), conversations)


def _cheapest(*options: str) -> str:
    return f"list_min([{', '.join(options)}])"


def _edited(state: int) -> str:
    """DuckDB SQL for the cheapest (cost, audit, output) from a state before a turn, without insertions."""
    to = 3 if state == 2 else 2
    keep = {0: "CASE r WHEN 's' THEN 1 WHEN 'u' THEN 2 END", 1: "CASE r WHEN 'u' THEN 2 END", 2: "CASE r WHEN 'a' THEN 3 END", 3: "CASE r WHEN 'u' THEN 2 END"}[state]
    role = "assistant" if to == 3 else "user"
    k = f"CASE {keep} WHEN 1 THEN s1 WHEN 2 THEN s2 WHEN 3 THEN s3 END"
    extra = "CASE fault WHEN 'truncated' THEN 1 WHEN 'ok' THEN 0 ELSE 1000000 END"
    return _cheapest(
        f"{{'c': s{state}.c + 3, 'a': 'D' || s{state}.a, 'o': s{state}.o}}",
        f"{{'c': coalesce(({k}).c, 1000000) + {extra}, 'a': 'K' || coalesce(({k}).a, ''), 'o': role || ':' || text || chr(10) || coalesce(({k}).o, '')}}",
        f"{{'c': s{to}.c + 2 + {extra}, 'a': 'R' || s{to}.a, 'o': '{role}:' || text || chr(10) || s{to}.o}}",
    )


def _inserted(state: str, to: str, role: str) -> str:
    return _cheapest(state, f"{{'c': {to}.c + 2, 'a': 'I' || {to}.a, 'o': '{role}:' || chr(10) || {to}.o}}")


ORACLES["op12_conversation_repair"] = f"""
    WITH RECURSIVE {SQL_CRC_TABLE},
    named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
    kinds AS (SELECT named.*, {sql_crc32("name")} % 20 AS kind FROM named, crc),
    damaged AS (
      SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
      FROM kinds, range(2) c(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
    n AS (
      SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS seen FROM (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) AS i FROM damaged)),
    f AS (
      SELECT *, left(role, 1) AS r, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN seen THEN 'duplicate'
          WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE 'ok' END AS fault,
        lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM n),
    stats AS (
      SELECT conv_id, count(*) AS rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
        count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
        count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
    v AS (
      SELECT conv_id, rows AS i, {{'c': 0, 'a': '', 'o': ''}} AS s0, {{'c': 4, 'a': 'II', 'o': 'user:' || chr(10) || 'assistant:' || chr(10)}} AS s1,
        {{'c': 2, 'a': 'I', 'o': 'assistant:' || chr(10)}} AS s2, {{'c': 0, 'a': '', 'o': ''}} AS s3 FROM stats UNION ALL
      SELECT conv_id, i, {_inserted("w0", "x2", "user")}, {_inserted("w1", "x2", "user")}, x2, x3 FROM (
        SELECT *, {_inserted("w2", "w3", "assistant")} AS x2, {_inserted("w3", "w2", "user")} AS x3 FROM (
          SELECT v.conv_id, v.i - 1 AS i, {", ".join(f"{_edited(q)} AS w{q}" for q in range(4))}
          FROM v JOIN f ON f.conv_id IS NOT DISTINCT FROM v.conv_id AND f.i = v.i)))
    SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
      coalesce(illegal, 0) AS illegal, CAST(coalesce(s0.c, 0) AS BIGINT) AS cost, coalesce(s0.a, '') AS audit,
      sha256(coalesce(left(s0.o, length(s0.o) - 1), '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN stats s ON s.conv_id IS NOT DISTINCT FROM c.conv_id
      LEFT JOIN v ON v.conv_id IS NOT DISTINCT FROM c.conv_id AND v.i = 0 AND s.rows IS NOT NULL"""


@query
def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document's ids lie in the packed sequences, read back from them."""
    path = f"{shared_dir(spark)}/packed-sequences-{uuid.uuid4().hex}"
    packing.pack_sequences(table(spark, sf_dir, "documents"), path, vocabulary_file("word_bpe_49k.json"), end_id=1)
    return packing.read_pieces(spark, path)
