"""Job queues and rating stores without MERGE: each change makes a new version of the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexarena.sources.tables import written


def by_status(queue: DataFrame, status: str) -> DataFrame:
    return queue.where(F.col("status") == status).orderBy(F.asc_nulls_last("created_at"), "url")


def by_court(queue: DataFrame, court: str) -> DataFrame:
    return queue.where(F.col("tribunal") == court).orderBy(F.desc_nulls_last("date"), F.desc_nulls_last("created_at"), "url")


def upsert_latest(queue: DataFrame, updates: DataFrame, key: str = "url", order: str = "updated_at") -> DataFrame:
    """The queue with updates put in by key: the latest row wins and keeps the earliest created_at."""
    every = queue.unionByName(updates.withColumn("_new", F.lit(1)), allowMissingColumns=True).withColumn("_new", F.coalesce("_new", F.lit(0)))
    last = Window.partitionBy(key).orderBy(F.desc("_new"), F.desc_nulls_last(order))
    out = every.withColumns({"created_at": F.min("created_at").over(Window.partitionBy(key)), "_rank": F.row_number().over(last)})
    return out.where("_rank = 1").drop("_rank", "_new")


def upsert_ratings(ratings: DataFrame, updates: DataFrame) -> DataFrame:
    """ratings with updates (advogado_id, mu, sigma, increment): new mu and sigma, total_partidas one more where increment."""
    joined = ratings.join(updates.select("advogado_id", F.col("mu").alias("n_mu"), F.col("sigma").alias("n_sigma"), F.col("increment").cast("int").alias("step")), "advogado_id", "full_outer")
    return joined.select(
        "advogado_id", F.coalesce("n_mu", "mu").alias("mu"), F.coalesce("n_sigma", "sigma").alias("sigma"),
        (F.coalesce("total_partidas", F.lit(0)) + F.coalesce("step", F.lit(0))).alias("total_partidas"),
    )


def update_by_key(table: DataFrame, updates: DataFrame, key: str, aliases: dict[str, str] | None = None) -> DataFrame:
    """table with non-null values of updates put in by key; aliased columns are renamed and unknown ones ignored."""
    renamed = updates.select(*(F.col(c).alias((aliases or {}).get(c, c)) for c in updates.columns))
    known = [c for c in renamed.columns if c in table.columns and c != key]
    renamed = renamed.select(key, *(F.col(c).alias(f"_{c}") for c in known))
    out = table.join(renamed, key, "left")
    return out.select(*(F.coalesce(f"_{c}", c).alias(c) if c in known else F.col(c) for c in table.columns))


def insert_ignore(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in the table, one for each key."""
    return rows.dropDuplicates([key]).join(table.select(key), key, "left_anti")


def with_new_ids(table: DataFrame, rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows with ids that follow the table's largest, dense and in order.

    Rows are dealt by ranges of the order and numbered inside each; a range starts where the ranges before
    it end. Only the ranges' sizes, one row each, come together.
    """
    top = table.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    dealt = written(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a partition
    starts = sizes.select("_part", before.alias("start")).crossJoin(F.broadcast(top))
    here = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt.join(F.broadcast(starts), "_part").withColumn("id", here + F.col("start") + F.col("top")).drop("_part", "start", "top")


def missing_from(items: DataFrame, known: DataFrame) -> DataFrame:
    """Items that match no known row by url, nor by (date, number)."""
    by_url = items.join(known.select("url").where("url IS NOT NULL").distinct(), "url", "left_anti")
    return by_url.join(known.select("date", "number").distinct(), ["date", "number"], "left_anti")


def current_state(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last event of each key."""
    value = F.struct(*order, *(c for c in events.columns if c not in (key, *order)))
    return events.groupBy(key).agg(F.max(value).alias("v")).select(key, "v.*")


def completion(queue: DataFrame, statuses: list[str]) -> DataFrame:
    """One row: total, a count for each status, completion_rate in percent (0 for an empty queue)."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in statuses]
    rate = F.coalesce(F.try_divide(F.count_if(F.col("status") == "completed") * 100.0, F.count("*")), F.lit(0.0))
    return queue.agg(F.count("*").alias("total"), *counts, rate.alias("completion_rate"))


def set_metadata(record: DataFrame, known: list[str], **values: Column) -> DataFrame:
    """Known fields updated; others put into the metadata map."""
    out = record.withColumns({k: v for k, v in values.items() if k in known})
    extra = {k: v for k, v in values.items() if k not in known}
    if extra:
        add = F.create_map(*(x for k, v in extra.items() for x in (F.lit(k), v.cast("string"))))
        out = out.withColumn("metadata", F.map_concat(F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin(*extra)), add))
    return out
