"""Gazette listings: entries, statistics, coverage and page chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexarena.functions.text import archive_identifier, gazette_file_name


def listing_entries(raw: DataFrame, base_url: str, court: str = "tjro") -> DataFrame:
    """Raw listing rows (strings) as entries, newest first; rows with a bad date or number are left out."""
    date = F.try_to_date(F.concat_ws("-", "year", F.lpad("month", 2, "0"), F.lpad("day", 2, "0")))
    number = F.try_to_number(F.regexp_extract("number", r"^\d+", 0), F.lit("9999999999")).cast("long")
    rows = raw.withColumns({"date": date, "n": number, "sufix": F.coalesce("sufix", F.lit(""))}).where("date IS NOT NULL AND n IS NOT NULL")
    title = F.concat(F.lit(f"Diário {court.upper()} - "), F.date_format("date", "yyyy-MM-dd"))
    meta = F.struct(title.alias("title"), F.concat(title, F.lit(" nº "), F.col("n").cast("string")).alias("description"), F.lit(court).alias("creator"), F.date_format("date", "yyyy-MM-dd").alias("date"))
    return rows.select(
        F.col("url").alias("original_filename"), gazette_file_name(F.col("date"), F.col("sufix")).alias("standard_filename"),
        F.concat(F.lit(base_url), F.col("relativePath"), F.col("url")).alias("full_url"), "date", F.year("date").alias("year"), F.month("date").alias("month"),
        F.dayofmonth("date").alias("day"), F.col("n").alias("number"), "sufix", archive_identifier(F.lit(court), F.col("date"), F.col("sufix")).alias("ia_identifier"), meta.alias("metadata"),
    ).orderBy(F.desc("date"), "original_filename")


def date_filter(rows: DataFrame, column: str, start=None, end=None) -> DataFrame:
    """Rows from start to end, both included and each optional."""
    if start is not None:
        rows = rows.where(F.col(column) >= F.lit(start))
    if end is not None:
        rows = rows.where(F.col(column) <= F.lit(end))
    return rows


def in_years(rows: DataFrame, column: str, years: list[int]) -> DataFrame:
    """Rows of the years; an empty list keeps all."""
    return rows.where(F.year(column).isin(*years)) if years else rows


def day_series(start: Column, end: Column) -> Column:
    """Every day from start to end."""
    return F.explode(F.sequence(start, end, F.expr("INTERVAL 1 DAY")))


def listing_statistics(rows: DataFrame, date: str, megabytes_each: int = 5) -> DataFrame:
    """One row: total, first and last date, years, estimated megabytes; years are few, so their list is small."""
    return rows.agg(
        F.count("*").alias("total"), F.min(date).alias("first_date"), F.max(date).alias("last_date"),
        F.array_sort(F.collect_set(F.year(date))).alias("years"), (F.count("*") * megabytes_each).alias("estimated_mb"),
    )


def listing_years(rows: DataFrame, date: str, sufix: str) -> DataFrame:
    """(year, n, supplements) of a listing."""
    return rows.groupBy(F.year(date).alias("year")).agg(F.count("*").alias("n"), F.count_if(F.coalesce(sufix, F.lit("")) != "").alias("supplements"))


def coverage(expected: DataFrame, archived: DataFrame) -> DataFrame:
    """(date, in_expected, in_archive) of every date on either side, by one full outer join."""
    e = expected.select("date").distinct().withColumn("in_expected", F.lit(True))
    a = archived.select("date").distinct().withColumn("in_archive", F.lit(True))
    both = e.join(a, "date", "full_outer")
    return both.select("date", F.coalesce("in_expected", F.lit(False)).alias("in_expected"), F.coalesce("in_archive", F.lit(False)).alias("in_archive"))


def coverage_report(days: DataFrame) -> DataFrame:
    """One row: totals, covered, missing and extra counts, percent covered, and the sorted lists of missing and extra days."""
    return days.agg(
        F.count_if("in_expected").alias("total_expected"), F.count_if("in_archive").alias("total_archived"),
        F.count_if(F.col("in_expected") & ~F.col("in_archive")).alias("missing"), F.count_if(~F.col("in_expected") & F.col("in_archive")).alias("extra"),
        F.coalesce(F.try_divide(F.count_if(F.col("in_expected") & F.col("in_archive")) * 100.0, F.count_if("in_expected")), F.lit(0.0)).alias("coverage_percent"),
        F.array_sort(F.collect_list(F.when(F.col("in_expected") & ~F.col("in_archive"), F.col("date")))).alias("missing_dates"),
        F.array_sort(F.collect_list(F.when(~F.col("in_expected") & F.col("in_archive"), F.col("date")))).alias("extra_dates"),
    )


def chunk_assignments(pages: DataFrame, doc: str, page: str, size: int = 25) -> DataFrame:
    """One row for each page of each chunk: pages of a document (0-based) in chunks of `size`, the last page of a chunk also first in the next.

    Adds chunk and overlap. A chunk that would hold the overlap alone is not made.
    """
    last = F.max(page).over(Window.partitionBy(doc))
    own = F.floor(F.col(page) / size)
    repeated = ((F.col(page) + 1) % size == 0) & (F.col(page) < F.col("_last"))
    rows = pages.withColumn("_last", last)
    parts = F.when(repeated, F.array(F.struct(own.alias("chunk"), F.lit(False).alias("overlap")), F.struct((own + 1).alias("chunk"), F.lit(True).alias("overlap"))))
    parts = parts.otherwise(F.array(F.struct(own.alias("chunk"), F.lit(False).alias("overlap"))))
    return rows.withColumn("_part", F.explode(parts)).select(*pages.columns, "_part.chunk", "_part.overlap")


def chunk_texts(pages: DataFrame, size: int = 25, marker: str = "[CONTINUED FROM THE PREVIOUS CHUNK]") -> DataFrame:
    """(doc_id, chunk, text) of page rows (doc_id, page, text); later chunks start with a marker and the overlap page."""
    rows = chunk_assignments(pages, "doc_id", "page", size)
    ordered = F.array_sort(F.collect_list(F.struct("page", "text")))
    out = rows.groupBy("doc_id", "chunk").agg(ordered.alias("p"))
    body = F.array_join(F.transform("p", lambda x: F.coalesce(x["text"], F.lit(""))), "\n")
    return out.select("doc_id", "chunk", F.when(F.col("chunk") > 0, F.concat(F.lit(marker + "\n"), body)).otherwise(body).alias("text"))
