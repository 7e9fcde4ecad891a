"""Gazette records: conversions, days and their records, attached analyses, generated listings and identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexarena.functions.text import basename, tolerant_map

FIELDS = ("tribunal", "data", "url", "filename", "hash", "pdf_path", "ia_identifier", "status")
# Fixed: the placeholder of a record that was not analyzed.
PLACEHOLDER = {"status": "dummy_data", "reason": "extraction not configured", "decisions_found": "0"}


def to_queue_item(records: DataFrame) -> DataFrame:
    """Records as rows of the job queue: renamed fields, the metadata map as JSON text."""
    return records.select("url", F.col("data").alias("date"), "tribunal", "filename", F.to_json("metadata").alias("metadata"), "ia_identifier", "status", F.col("pdf_path").alias("arquivo_path"))


def from_queue_item(rows: DataFrame) -> DataFrame:
    """Rows of the job queue as records; bad metadata is an empty map, a missing status is pending."""
    return rows.select(
        "tribunal", F.col("date").alias("data"), "url", "filename", F.lit(None).cast("string").alias("hash"), F.col("arquivo_path").alias("pdf_path"), "ia_identifier",
        F.coalesce("status", F.lit("pending")).alias("status"), tolerant_map(F.col("metadata")).alias("metadata"),
    )


def to_json_text(records: DataFrame) -> Column:
    """A record as one JSON object."""
    return F.to_json(F.struct(*FIELDS, "metadata"))


def from_json_text(text: Column) -> Column:
    """struct(FIELDS, metadata) of a JSON object; missing optional fields are null, a missing status is pending, missing metadata is empty."""
    read = F.from_json(text, ", ".join(f"{c} {'date' if c == 'data' else 'string'}" for c in FIELDS) + ", metadata map<string,string>")
    empty = F.create_map().cast("map<string,string>")
    return F.struct(*(read[c].alias(c) for c in FIELDS[:-1]), F.coalesce(read["status"], F.lit("pending")).alias("status"), F.coalesce(read["metadata"], empty).alias("metadata"))


def for_days(days: DataFrame, listing: DataFrame, court: str) -> DataFrame:
    """A record for each day (date) that the listing (date, url) has a URL for: the least one, the file named after it."""
    found = listing.where("url IS NOT NULL").groupBy("date").agg(F.min("url").alias("url"))
    return days.select("date").distinct().join(found, "date").select(F.lit(court).alias("tribunal"), F.col("date").alias("data"), "url", basename(F.col("url")).alias("filename"), F.lit("pending").alias("status"))


def attach_analysis(records: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """records with decision_count and status 'analyzed' where decisions (key) has any; others stay as they are, with 0."""
    counts = decisions.groupBy(key).agg(F.count("*").alias("decision_count"))
    out = records.join(counts, key, "left")
    status = F.when(F.col("decision_count").isNotNull(), "analyzed").otherwise(F.col("status"))
    return out.withColumns({"status": status, "decision_count": F.coalesce("decision_count", F.lit(0))})


def archivable(records: DataFrame, files: DataFrame) -> DataFrame:
    """Records whose file (filename) was downloaded."""
    return records.join(files.select("filename").where("filename IS NOT NULL").distinct(), "filename", "left_semi")


def default_date(given: Column, as_of: Column) -> Column:
    """The given date, else the day before as_of."""
    return F.coalesce(given, F.date_sub(as_of, 1))


def generated_listing(days: DataFrame, first_number: int = 1) -> DataFrame:
    """Raw listing rows (date, number, sufix) for days (i, date): a main edition each, and a supplement for every third."""
    number = (F.col("i") + first_number).cast("string")
    editions = F.array(F.struct(number.alias("number"), F.lit("").alias("sufix")), F.struct(F.concat(number, F.lit("S")).alias("number"), F.lit("S").alias("sufix")))
    some = F.when(F.col("i") % 3 == 0, editions).otherwise(F.slice(editions, 1, 1))
    return days.select("date", F.explode(some).alias("e")).select("date", "e.number", "e.sufix")


def placeholder(records: DataFrame) -> DataFrame:
    """An extraction for each record that none was made for: no decisions, so nothing is read from it."""
    return records.select(F.col("filename").alias("file_name_source"), *(F.lit(v).alias(k) for k, v in PLACEHOLDER.items()))


def snapshot_item(prefix: str, date: Column, kind: Column) -> Column:
    """The identifier of a database snapshot: prefix-database-YYYY-MM-DD-kind."""
    return F.lower(F.concat_ws("-", F.lit(prefix), F.lit("database"), F.date_format(date, "yyyy-MM-dd"), kind))


def snapshot_metadata(title: Column, stats: dict[str, Column]) -> Column:
    """A snapshot's metadata: its title, a description with the statistics, and each as stats_*."""
    described = F.concat_ws(", ", *(F.concat(F.lit(f"{k}: "), v.cast("string")) for k, v in stats.items()))
    return F.map_concat(F.create_map(F.lit("title"), title, F.lit("description"), described), F.create_map(*(x for k, v in stats.items() for x in (F.lit(f"stats_{k}"), v.cast("string")))))
