"""Files taken in once: records and the ledger of the files they came from become visible in one commit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexarena.sources.tables import TableStore, written

LEDGER = "path string, length long, records long, valid long, status string"


def files_of(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, length) of a folder's files, from their listing; no file is read, and files without a byte aren't listed."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder).select(F.col("_metadata.file_path").alias("path"), "length")


def ledger_of(store: TableStore, name: str, version: int | None = None) -> DataFrame:
    version = store.version() if version is None else version
    return store.read(name, version) if name in store.tables(version) else store.spark.createDataFrame([], LEDGER)


def pending(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files that the ledger doesn't have as completed; failed ones are tried again."""
    return files.join(ledger.where("status = 'completed'").select("path"), "path", "left_anti")


def json_lines(spark: SparkSession, folder: str, files: DataFrame | None = None) -> DataFrame:
    """(path, record) of the JSON lines of a folder, or of those of its files that `files` (path) has; a line that isn't JSON is a null record."""
    lines = spark.read.option("recursiveFileLookup", True).text(folder).select(F.col("_metadata.file_path").alias("path"), "value")
    if files is not None:
        lines = lines.join(files.select("path"), "path")  # other files' lines aren't parsed
    return lines.select("path", F.try_parse_json("value").alias("record"))


def ingest(store: TableStore, folder: str, reason: Callable, read: Callable[[SparkSession, str], DataFrame] | None = None, name: str = "records", ledger: str = "files", dry_run: bool = False) -> dict[str, int]:
    """Take in the pending files of a folder; returns the files that are pending, completed and failed.

    read gives (path, record) of all files, of which those of pending files are kept by a join; without it,
    files are JSON lines, and those of pending files alone are parsed. reason gives why a record (VARIANT) is
    invalid, or null; each record is asked once, as what it says is written to the shared folder first. Valid records are appended to the table `name` with
    their path. A file is completed if it has a valid record, else failed. Rows and ledger are one commit:
    after a crash before it nothing has happened, and a second run finds nothing to do. Of two runs at a
    time one gets a Conflict. dry_run commits nothing.
    """
    spark, base = store.spark, store.version()
    known = ledger_of(store, ledger, base)
    todo = pending(files_of(spark, folder), known)
    if {name, ledger} <= set(store.tables(base)) and todo.isEmpty():
        return _counts(todo.withColumn("status", F.lit(None).cast("string")))
    records = json_lines(spark, folder, todo) if read is None else read(spark, folder).join(todo.select("path"), "path")
    valid = F.col("record").isNotNull() & reason(F.col("record")).isNull()
    if dry_run:
        records = records.select("path", F.col("record").isNotNull().alias("is_json"), valid.alias("is_valid"))
    else:
        marked = records.select("path", F.col("record").isNotNull().alias("is_json"), F.when(valid, F.to_json("record")).alias("record"))
        records = written(marked, "ingest").withColumn("is_valid", F.col("record").isNotNull())
    counted = records.groupBy("path").agg(F.count_if("is_json").alias("records"), F.count_if("is_valid").alias("valid"))
    rows = todo.join(counted, "path", "left").select("path", "length", F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("valid", F.lit(0)).alias("valid"))
    rows = rows.withColumn("status", F.when(F.col("valid") > 0, "completed").otherwise("failed"))
    if dry_run:
        return _counts(rows)
    again = known.join(rows.select("path"), "path", "left_anti").unionByName(rows)
    version = store.commit({name: ("append", records.where("is_valid").select("path", "record")), ledger: ("replace", again)}, expected=base, note=f"ingest {folder}")
    return _counts(store.read(ledger, version).join(todo.select("path"), "path", "left_semi"))


def _counts(rows: DataFrame) -> dict[str, int]:
    found = rows.agg(F.count("*").alias("pending"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed")).first()
    return found.asDict()
