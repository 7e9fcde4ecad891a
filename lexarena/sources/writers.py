"""Exports and snapshots: each writes a new folder and never one that it reads."""

from __future__ import annotations

import tarfile
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def export_csv(tables: dict[str, DataFrame], folder: str) -> dict[str, str]:
    """Every table as CSV with a header; returns name -> 'ok' or the error, and one failure doesn't stop the others."""
    state = {}
    for name, df in tables.items():
        try:
            flat = df.select(*(F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes))
            flat.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")
            state[name] = "ok"
        except Exception as error:  # noqa: BLE001 - reported, not raised
            state[name] = str(error).splitlines()[0]
    return state


def export_parquet(tables: dict[str, DataFrame], folder: str) -> list[str]:
    """Every table that has rows, as Parquet with Snappy; returns the names written."""
    done = []
    for name, df in tables.items():
        if not df.isEmpty():
            df.write.mode("overwrite").option("compression", "snappy").parquet(f"{folder}/{name}")
            done.append(name)
    return done


def snapshot(tables: dict[str, DataFrame], folder: str, version: str, statistics: DataFrame | None = None) -> str:
    """All tables under a version, with a one-row JSON of statistics."""
    target = f"{folder}/{version}"
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{target}/{name}")
    if statistics is not None:
        statistics.withColumn("version", F.lit(version)).coalesce(1).write.mode("errorifexists").json(f"{target}/_statistics")
    return target


def next_version(archives: DataFrame) -> DataFrame:
    """(archive_type, next_version)."""
    return archives.groupBy("archive_type").agg((F.coalesce(F.max("version"), F.lit(0)) + 1).alias("next_version"))


def bundle(folder: str, target: str) -> str:
    """A tar.gz of a local snapshot folder."""
    with tarfile.open(target, "w:gz") as tar:
        for path in sorted(Path(folder).iterdir()):
            tar.add(path, arcname=path.name)
    return target


def export_listing(entries: DataFrame, folder: str, kind: str) -> None:
    """A listing as 'json', 'urls_only' or 'csv' (metadata fields as metadata_* columns)."""
    if kind == "json":
        entries.write.mode("overwrite").json(folder)
    elif kind == "urls_only":
        entries.select(F.col("full_url").alias("value")).write.mode("overwrite").text(folder)
    elif kind == "csv":
        names = entries.schema["metadata"].dataType.names
        flat = entries.select(*(c for c in entries.columns if c != "metadata"), *(F.col(f"metadata.{n}").alias(f"metadata_{n}") for n in names))
        flat.write.mode("overwrite").option("header", True).csv(folder)
    else:
        raise ValueError(f"unknown kind {kind!r}")


def export_queue(queue: DataFrame, folder: str) -> None:
    queue.orderBy(F.desc("year"), F.desc("date"), "number").write.mode("overwrite").option("header", True).csv(folder)


def inventory_envelope(items: DataFrame, details: int = 10) -> DataFrame:
    """One JSON value for each item, details for the first ones by identifier, with the count."""
    total = items.agg(F.count("*").alias("total"))
    top = items.orderBy("identifier").limit(details).agg(F.array_sort(F.collect_list(F.struct("identifier", "title", "date"))).alias("items"))
    return total.crossJoin(top).select(F.to_json(F.struct("total", "items")).alias("value"))


def archive_record(files: DataFrame, archive_type: str, statistics: DataFrame) -> DataFrame:
    """Rows for archived files: hash, size and three statistics."""
    rows = files.select("path", F.sha2("content", 256).alias("sha256_hash"), F.length("content").alias("file_size_bytes"), F.lit(archive_type).alias("archive_type"))
    return rows.crossJoin(F.broadcast(statistics.select("total_lawyers", "total_matches", "total_decisions").limit(1)))


def merge_summary(summary: DataFrame, key: str, value: str) -> DataFrame:
    """A summary map with one key set; the new value counts."""
    return summary.withColumn("summary", F.map_concat(F.map_filter("summary", lambda k, _: k != key), F.create_map(F.lit(key), F.lit(value))))


def compact(df: DataFrame, folder: str, files: int) -> None:
    """A table rewritten as a few files in a new folder."""
    df.repartition(files).write.mode("errorifexists").parquet(folder)


def write_state(state: DataFrame, folder: str) -> None:
    """A one-row state as JSON, to a new folder or over an old state."""
    state.coalesce(1).write.mode("overwrite").json(folder)


def replace_rows(rows: DataFrame, folder: str, version: str) -> str:
    """All rows of a table as a new version beside the old ones; readers move on to it by its path."""
    target = f"{folder}/version={version}"
    rows.write.mode("errorifexists").parquet(target)
    return target
