"""A Spark data source over an archive's yearly listings: a partition a year, bounds applied in the reader.

The archive's search API answers with JSON items by year; offline, its replies lie in a folder as
year=YYYY/*.json, one item a line. Like the API, the source takes a creator, a collection and a range of
dates, as options: the years of the range are its partitions, and what is outside never becomes a row. Files
are opened where the task runs, in any store that pyarrow knows (local, HDFS, S3).

Filters are options because Spark 4.1 keeps what one query has pushed into a Python source for later queries
of the same frame, which then lack rows.
"""

from __future__ import annotations

import datetime
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

FORMAT = "archive_listing"
COLUMNS = ("identifier", "title", "date", "creator", "collection")
_ARROW = pa.schema([(c, pa.date32() if c == "date" else pa.string()) for c in COLUMNS])


class YearPartition(InputPartition):
    def __init__(self, year: int, files: list[str]):
        self.year, self.files = year, files


class ListingReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder = options["path"]
        self.equal = {c: options[c] for c in ("creator", "collection") if c in options}
        self.start, self.end = (datetime.date.fromisoformat(options[k]) if k in options else None for k in ("start", "end"))

    def partitions(self) -> list[InputPartition]:
        """A partition for each year with files that the date bounds meet."""
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(self.folder)
        found: dict[int, list[str]] = {}
        for entry in files.get_file_info(fs.FileSelector(root, recursive=True)):
            year = next((p[5:] for p in entry.path.split("/") if p.startswith("year=")), "")
            if entry.is_file and entry.path.endswith(".json") and year.isdigit():
                found.setdefault(int(year), []).append(entry.path)
        kept = sorted(y for y in found if (self.start is None or y >= self.start.year) and (self.end is None or y <= self.end.year))
        return [YearPartition(y, sorted(found[y])) for y in kept] or [YearPartition(0, [])]

    def _kept(self, item: dict, day: datetime.date | None) -> bool:
        if self.start is not None and (day is None or day < self.start) or self.end is not None and (day is None or day > self.end):
            return False
        return all(item.get(c) == v for c, v in self.equal.items())

    def read(self, partition: YearPartition) -> Iterator[pa.RecordBatch]:
        """Items of a year in batches; a line that isn't a JSON object is left out, a date that isn't one is null."""
        from pyarrow import fs

        files, _ = fs.FileSystem.from_uri(self.folder)
        rows: list[tuple] = []
        for path in partition.files:
            with files.open_input_stream(path) as stream:
                for line in _lines(stream):
                    item = _parsed(line)
                    if item is None:
                        continue
                    day = _day(item.get("date"))
                    if self._kept(item, day):
                        rows.append(tuple(day if c == "date" else _text(item.get(c)) for c in COLUMNS))
                    if len(rows) == 4096:
                        yield _batch(rows)
                        rows = []
        if rows:
            yield _batch(rows)

def _lines(stream, size: int = 1 << 20) -> Iterator[bytes]:
    rest = b""
    while chunk := stream.read(size):
        *whole, rest = (rest + chunk).split(b"\n")
        yield from whole
    if rest:
        yield rest


def _parsed(line: bytes) -> dict | None:
    try:
        item = json.loads(line)
    except ValueError:
        return None
    return item if isinstance(item, dict) else None


def _day(value) -> datetime.date | None:
    try:
        return datetime.date.fromisoformat(value[:10])
    except (TypeError, ValueError):
        return None


def _text(value) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


class ListingSource(DataSource):
    """spark.read.format('archive_listing').load(folder)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return ", ".join(f"{c} {'date' if c == 'date' else 'string'}" for c in COLUMNS)

    def reader(self, schema: StructType) -> ListingReader:
        return ListingReader(dict(self.options))


def read_archive(spark: SparkSession, folder: str, creator: str | None = None, collection: str | None = None, start: datetime.date | None = None, end: datetime.date | None = None) -> DataFrame:
    """The items (identifier, title, date, creator, collection) of the listings in a folder, within the given bounds; both dates are included."""
    spark.dataSource.register(ListingSource)
    bounds = {"creator": creator, "collection": collection, "start": start and start.isoformat(), "end": end and end.isoformat()}
    return spark.read.format(FORMAT).options(**{k: v for k, v in bounds.items() if v is not None}).load(folder)


def write_archive(items: DataFrame, folder: str) -> None:
    """Items as the yearly replies that read_archive() reads; items without a date are filed under year 0."""
    out = items.select(*(F.col(c) if c in items.columns else F.lit(None).cast("string").alias(c) for c in COLUMNS))
    out.withColumn("year", F.coalesce(F.year("date"), F.lit(0))).repartition("year").write.partitionBy("year").json(folder)
