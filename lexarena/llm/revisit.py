"""Not-modified revisits: each takes the latest earlier full response of its canonical URL.

The as-of join is a running maximum of (time, record) over full responses. The timeline is cut into
buckets of about as many captures each, so the rows of one URL are many window groups, wherever they lie; what came before a bucket is a running
maximum over its URL's buckets, a few rows a URL. Payloads don't move: responses carry their digest and
length, and with_payload() joins bodies by record id where they are wanted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 64
# Fixed: header fields that a 304 response may update in a stored response.
PERMITTED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")


def canonical(url: Column) -> Column:
    """Host and path without scheme, fragment, www. or m., tracking parameters (ref, utm_*), default port and final slash; null stays null."""
    rest = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), r"(?i)^https?://", "")
    host, tail = F.lower(F.regexp_extract(rest, r"^[^/?]*", 0)), F.regexp_extract(rest, r"^[^/?]*(.*)$", 1)
    host = F.regexp_replace(F.regexp_replace(host, r":(80|443)$", ""), r"^(www|m)\.", "")
    tail = F.regexp_replace(tail, r"([?&])(ref|utm_[a-z]*)=[^&]*", "$1")
    tail = F.regexp_replace(F.regexp_replace(F.regexp_replace(tail, "&+", "&"), r"\?&", "?"), r"[?&]$", "")
    return F.concat(host, F.regexp_replace(tail, "/$", ""))


def _entries(headers: Column) -> Column:
    """A header map as (name in lower case, value) entries in order; the last of equal names counts."""
    low = F.transform(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))), lambda e: F.struct(F.lower(e["key"]).alias("name"), e["value"].alias("value")))
    return F.array_sort(low)


def _value(entries: Column, name: str) -> Column:
    return F.get(F.transform(F.filter(entries, lambda e: e["name"] == name), lambda e: e["value"]), F.lit(0))


def resolve(captures: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Each revisit with the response it stands for.

    captures: record_id (long), type ('response' or 'revisit'), url, ts (long), status (int), headers
    (map), digest, length. A full response has type response, status 200 and a digest. A revisit takes the
    one of its canonical URL with the latest ts before its own (record_id decides between equal ts).

    Returns record_id, url (canonical), response_id, state, digest, length, headers (entries in order of
    name). state: 'resolved' if the validators agree: ETags (weak comparison) if both have one, else
    Last-Modified if both have it, else digests; 'mismatch' if they differ; 'unvalidated' if no validator is
    on both sides; 'no_response' without an earlier response, or without a URL or time. Only a resolved
    revisit has digest, length and headers: the response's, updated by the revisit's permitted ones.
    Null headers are empty; repeated rows are resolved each; an empty table gives an empty one; a URL of any
    length is one key; extra columns are not read.
    """
    full = (F.col("type") == "response") & (F.col("status") == 200) & F.col("digest").isNotNull()
    rows = captures.select("record_id", "type", "status", "digest", "length", F.col("ts").cast("long").alias("ts"), canonical(F.col("url")).alias("url"), _entries(F.col("headers")).alias("headers"))
    rows = rows.where(full | (F.col("type") == "revisit"))
    cuts = rows.agg(F.percentile_approx("ts", [i / buckets for i in range(1, buckets)], 10_000)).first()[0] if buckets > 1 else None
    cuts = F.array(*(F.lit(c) for c in sorted(set(cuts or [])))).cast("array<long>")
    stored = F.when(full, F.struct("ts", "record_id", "digest", "length", "headers"))
    rows = rows.withColumns({"bucket": F.when(F.col("ts").isNull(), -1).otherwise(F.size(F.filter(cuts, lambda c: c <= F.col("ts")))), "stored": stored})
    inside = Window.partitionBy("url", "bucket").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("within", F.max("stored").over(inside))
    before = Window.partitionBy("url").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = rows.where(full).groupBy("url", "bucket").agg(F.max("stored").alias("last"))
    here = rows.where("type = 'revisit'").groupBy("url", "bucket").agg(F.lit(None).cast(carry.schema["last"].dataType).alias("last"))
    carry = carry.unionAll(here).groupBy("url", "bucket").agg(F.max("last").alias("last")).select("url", "bucket", F.max("last").over(before).alias("carry"))
    found = rows.where("type = 'revisit'").join(carry, ["url", "bucket"], "left").withColumn("r", F.coalesce("within", "carry"))
    usable = F.col("url").isNotNull() & F.col("ts").isNotNull()
    found = found.withColumn("r", F.when(usable, F.col("r")))
    tag = lambda e: F.regexp_replace(_value(e, "etag"), "^W/", "")
    mine, theirs = F.col("headers"), F.col("r.headers")
    agree = F.coalesce(tag(mine) == tag(theirs), _value(mine, "last-modified") == _value(theirs, "last-modified"), F.col("digest") == F.col("r.digest"))
    state = F.when(F.col("r").isNull(), "no_response").when(agree, "resolved").when(~agree, "mismatch").otherwise("unvalidated")
    new = F.filter(mine, lambda e: e["name"].isin(*PERMITTED))
    kept = F.filter(theirs, lambda e: ~F.exists(new, lambda n: n["name"] == e["name"]))
    out = found.withColumn("state", state)
    resolved = F.col("state") == "resolved"
    return out.select(
        "record_id", "url", F.col("r.record_id").alias("response_id"), "state",
        F.when(resolved, F.col("r.digest")).alias("digest"), F.when(resolved, F.col("r.length")).alias("length"),
        F.when(resolved, F.array_sort(F.concat(new, kept))).alias("headers"),
    )


def with_payload(resolved: DataFrame, bodies: DataFrame) -> DataFrame:
    """resolved with the body of its response, from bodies (record_id, body); null where there is none."""
    return resolved.join(bodies.select(F.col("record_id").alias("response_id"), "body"), "response_id", "left")


def crawl_of(pages: DataFrame) -> DataFrame:
    """A crawl over the table of pages: one response each, and three revisits.

    A page is fetched at minute page_id. A revisit a day before it, one a week after it with the page's
    ETag, and one two weeks after it with another ETag follow; record ids are 4 * page_id to + 3.
    """
    digest, length = F.md5(F.coalesce("html", F.lit(""))), F.octet_length(F.coalesce("html", F.lit("")))
    base = pages.select("page_id", "url", digest.alias("digest"), length.cast("long").alias("length"), (F.col("page_id") * 60).alias("at"))
    tag = F.substring("digest", 1, 16)
    stored = F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("ETag"), tag, F.lit("Cache-Control"), F.lit("max-age=600"), F.lit("Content-Length"), F.col("length").cast("string"))
    again = lambda t, age: F.create_map(F.lit("etag"), t, F.lit("cache-control"), F.lit(age), F.lit("content-length"), F.lit("0"), F.lit("date"), F.col("at").cast("string"))
    day = 86_400
    record = lambda k, kind, shift, status, headers, d: F.struct(
        (F.col("page_id") * 4 + k).alias("record_id"), F.lit(kind).alias("type"), (F.col("at") + shift).alias("ts"), F.lit(status).alias("status"),
        headers.alias("headers"), d.alias("digest"), F.col("length"))
    none = F.lit(None).cast("string")
    records = F.array(
        record(0, "response", 0, 200, stored, F.col("digest")),
        record(1, "revisit", -day, 304, again(F.concat(F.lit("W/"), tag), "max-age=1"), none),
        record(2, "revisit", 7 * day, 304, again(F.concat(F.lit("W/"), tag), "max-age=60"), none),
        record(3, "revisit", 14 * day, 304, again(F.reverse(tag), "max-age=90"), none),
    )
    return base.select("url", F.explode(records).alias("r")).select("url", "r.*")
