"""Readers with declared schemas: Parquet, listings, envelopes, ratings, pages, search results, day series."""

from __future__ import annotations

import tomllib
from copy import deepcopy
from datetime import date
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexarena import schemas

DEFAULT_CONFIG = {
    "rating": {"mu": 25.0, "sigma": 25.0 / 3, "beta": 25.0 / 6, "tau": 25.0 / 15},
    "security": {"allow_pii_decoding": False},
}


def load_config(path: str | Path | None = None) -> dict:
    """A TOML file merged over the defaults, table by table; the defaults are never changed."""
    config = deepcopy(DEFAULT_CONFIG)
    if path and Path(path).exists():
        for name, value in tomllib.loads(Path(path).read_text()).items():
            config[name] = config.get(name, {}) | value if isinstance(value, dict) else value
    return config


def read_parquet_glob(spark: SparkSession, pattern: str) -> DataFrame:
    return spark.read.parquet(pattern)


def read_listing(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of raw listing rows."""
    return spark.read.schema(schemas.LISTING).option("multiLine", True).json(path)


def read_envelopes(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(extraction envelopes, files that aren't JSON objects) of a folder; one bad file doesn't stop the others."""
    files = spark.read.option("wholetext", True).text(folder).select(F.col("_metadata.file_path").alias("path"), F.try_parse_json("value").alias("v"))
    get = lambda name, kind: F.try_variant_get("v", f"$.{name}", kind)
    fields = [get(n, k).alias(n) for n, k in (f.split(" ") for f in schemas.ENVELOPE.split(", ")) if n not in ("decisions", "file_name_source")]
    name = F.coalesce(get("file_name_source", "string"), F.element_at(F.split("path", "/"), -1)).alias("file_name_source")
    decisions = F.coalesce(get("decisions", "array<variant>"), F.array().cast("array<variant>")).alias("decisions")
    return files.where("v IS NOT NULL").select("path", name, *fields, decisions), files.where("v IS NULL").select("path")


def yearly_counts(replies: DataFrame) -> DataFrame:
    """(year, items) of a listing API's replies (year, reply): the length of a JSON list, 0 for anything else."""
    items = F.try_variant_get(F.try_parse_json("reply"), "$", "array<variant>")
    return replies.select("year", F.coalesce(F.size(items), F.lit(0)).alias("items"))


def read_state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON state file; a missing file or one that isn't JSON is an empty table."""
    try:
        found = spark.read.option("wholetext", True).text(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    return found.select(F.from_json("value", schema).alias("s")).where("s IS NOT NULL AND to_json(s) <> '{}'").select("s.*")


def read_ratings_csv(spark: SparkSession, path: str) -> DataFrame:
    """Ratings by advogado_id; a missing file is an empty table."""
    schema = "advogado_id string, mu double, sigma double, total_partidas int"
    try:
        return spark.read.schema(schema).option("header", True).csv(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of url and, if given, date."""
    return spark.read.schema("url string, date string").csv(path).where("url <> 'url'").withColumn("date", F.try_to_date("date"))


def read_pdf_files(spark: SparkSession, path: str) -> DataFrame:
    """PDF files with their size, SHA-256 and whether they look whole."""
    from lexarena.functions.hashing import content_sha256
    from lexarena.operators.validate import valid_pdf

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path)
    return files.withColumns({"sha256": content_sha256(F.col("content")), "valid": valid_pdf(F.col("content"))})


def first_pdf_link(html: Column, day: str | None = None) -> Column:
    """The first PDF link of a page, or the first that holds a day as YYYYMMDD; null if there is none."""
    links = F.regexp_extract_all(html, F.lit(r"""(?i)href\s*=\s*["']([^"']+\.pdf[^"']*)["']"""), F.lit(1))
    return F.get(F.filter(links, lambda x: F.contains(x, F.lit(day))) if day else links, F.lit(0))


def search_items(items: DataFrame, creator: str | None = None, year_from: int | None = None, year_to: int | None = None, start=None, end=None, rows: int = 10_000) -> DataFrame:
    """Archive items (identifier, title, date, creator), newest first: a year range, or a date range if both ends are given."""
    found = items if creator is None else items.where(F.col("creator") == creator)
    if start is not None and end is not None:
        found = found.where(F.col("date").between(F.lit(start), F.lit(end)))
    else:
        found = found if year_from is None else found.where(F.col("date") >= F.lit(date(year_from, 1, 1)))
        found = found if year_to is None else found.where(F.col("date") <= F.lit(date(year_to, 12, 31)))
    return found.orderBy(F.desc_nulls_last("date"), "identifier").limit(rows)


def collection_items(items: DataFrame, collection: str, rows: int = 10_000) -> DataFrame:
    """The items of a collection, newest first."""
    return items.where(F.col("collection") == collection).orderBy(F.desc_nulls_last("date"), "identifier").limit(rows)


def existing_items(wanted: DataFrame, inventory: DataFrame) -> DataFrame:
    """Wanted rows whose identifier the inventory holds."""
    return wanted.join(inventory.select("identifier"), "identifier", "left_semi")


def expected_items(spark: SparkSession, start, end, court: str = "tjro") -> DataFrame:
    """(date, identifier) of every day from start to end."""
    from lexarena.functions.text import archive_identifier

    days = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr("INTERVAL 1 DAY"))).alias("date"))
    return days.withColumn("identifier", archive_identifier(F.lit(court), F.col("date"), F.lit(None).cast("string")))


def synthetic_decisions(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """Generated decisions: case_id, date, court, outcome, keywords."""
    pick = lambda values, salt: F.get(F.array(*(F.lit(v) for v in values)), F.pmod(F.xxhash64("id", F.lit(seed + salt)), F.lit(len(values))).cast("int"))
    rows = spark.range(n)
    return rows.select(
        F.format_string("CASE-%05d", "id").alias("case_id"), F.date_add(F.lit("2022-01-01").cast("date"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1400)).cast("int")).alias("date"),
        pick(["court-1", "court-2", "court-3", "court-4", "court-5"], 1).alias("court"), pick(["granted", "denied", "partial", "settled", "dismissed"], 2).alias("outcome"),
        F.array(pick(["tax", "labour", "civil", "family"], 3), pick(["appeal", "contract", "damages"], 4)).alias("keywords"),
    )


class Courts:
    """Registered courts: code to implementation."""

    def __init__(self) -> None:
        self._known: dict[str, object] = {}

    def register(self, code: str, implementation: object) -> None:
        self._known[code.lower()] = implementation

    def get(self, code: str) -> object:
        if code.lower() not in self._known:
            raise ValueError(f"unknown court {code!r}; supported: {', '.join(self.supported())}")
        return self._known[code.lower()]

    def supported(self) -> list[str]:
        return sorted(self._known)

    def __contains__(self, code: str) -> bool:
        return code.lower() in self._known
