"""Rankings, trends, streaks, opponents and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranking(ratings: DataFrame, limit: int = 20, least_matches: int = 0) -> DataFrame:
    """The best by conservative skill, ties by id; players under least_matches are left out first."""
    rows = ratings.where(F.col("total_partidas") >= least_matches) if least_matches else ratings
    return rows.withColumn("conservative_skill", F.col("mu") - 3 * F.col("sigma")).orderBy(F.desc_nulls_last("conservative_skill"), "advogado_id").limit(limit)


def outcome_trend(rows: DataFrame, date: str, keys: list[str], unit: str = "month") -> DataFrame:
    return rows.groupBy(F.date_trunc(unit, date).cast("date").alias("period"), *keys).agg(F.count("*").alias("n"))


def rating_history(events: DataFrame, player: str, order: list[str], value: str) -> DataFrame:
    """Events with previous value and delta for each player in order."""
    w = Window.partitionBy(player).orderBy(*order)
    return events.withColumn("previous", F.lag(value).over(w)).withColumn("delta", F.col(value) - F.col("previous"))


def streaks(events: DataFrame, player: str, order: list[str], value: str) -> DataFrame:
    """(player, value, length, first, last) of each run of equal values, by the difference of two row numbers."""
    w = Window.partitionBy(player).orderBy(*order)
    island = F.row_number().over(w) - F.row_number().over(Window.partitionBy(player, value).orderBy(*order))
    at = F.struct(*order)
    runs = events.withColumn("_island", island).groupBy(player, value, "_island")
    return runs.agg(F.count("*").alias("length"), F.min(at).alias("first"), F.max(at).alias("last")).drop("_island")


def opponent_pairs(matches: DataFrame) -> DataFrame:
    """(a, b, meetings) of players of team_a against players of team_b, within each match."""
    pairs = matches.select(F.explode("team_a").alias("a"), "team_b").select("a", F.explode("team_b").alias("b"))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("meetings"))


def keyword_counts(rows: DataFrame, keywords: str) -> DataFrame:
    return rows.select(F.explode(keywords).alias("keyword")).groupBy("keyword").agg(F.count("*").alias("n"))


def keyword_pairs(rows: DataFrame, keywords: str) -> DataFrame:
    """(a, b, n) of keywords that occur in one record, a before b."""
    once = rows.select(F.array_sort(F.array_distinct(keywords)).alias("k"))
    pairs = once.select(F.posexplode("k").alias("i", "a"), "k").select("a", F.explode(F.slice("k", F.col("i") + 2, F.size("k"))).alias("b"))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n"))


def histogram(rows: DataFrame, value: Column, low: float, high: float, buckets: int) -> DataFrame:
    """(bucket, n) of equal widths; 0 and buckets + 1 take what lies outside."""
    return rows.groupBy(F.width_bucket(value, F.lit(low), F.lit(high), F.lit(buckets)).alias("bucket")).agg(F.count("*").alias("n"))


def status_pivot(rows: DataFrame, keys: list[str], status: str, values: list[str]) -> DataFrame:
    """Counts of a fixed list of statuses by key, 0 where there are none."""
    return rows.groupBy(*keys).agg(*(F.count_if(F.col(status) == v).alias(f"n_{v.lower()}") for v in values))


def retained(rows: DataFrame, created: str, days: dict[str, int], kind: str, as_of: Column) -> DataFrame:
    """Rows younger than their kind's days at as_of; kinds without a rule are kept."""
    rules = F.create_map(*(F.lit(x) for kv in days.items() for x in kv))
    limit = rules[F.col(kind)]
    return rows.where(limit.isNull() | (F.datediff(as_of, F.col(created).cast("date")) < limit))


def storage_cost(size: Column, price_per_tb: float) -> Column:
    return size / F.lit(float(1 << 40)) * price_per_tb


def run_summary(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(counts by node type and status, failed nodes with their messages) of a build's results."""
    counts = results.groupBy("node_type", "status").agg(F.count("*").alias("n"))
    return counts, results.where(F.col("status").isin("error", "fail")).select("node", "status", "message")


def slowest(results: DataFrame, n: int = 5) -> DataFrame:
    return results.orderBy(F.desc_nulls_last("seconds"), "node").limit(n)


def results_by_level(matches: DataFrame, level: Column, won: Column) -> DataFrame:
    """(level, n, wins, win_percent) of matches by the opponent's rating level."""
    out = matches.groupBy(level.alias("level")).agg(F.count("*").alias("n"), F.count_if(won).alias("wins"))
    return out.withColumn("win_percent", F.round(F.col("wins") * 100.0 / F.col("n"), 6))


def topic_success(rows: DataFrame, keywords: str, won: Column) -> DataFrame:
    """(keyword, n, success_percent) of records by keyword."""
    each = rows.select(F.explode(F.array_distinct(keywords)).alias("keyword"), won.alias("won"))
    return each.groupBy("keyword").agg(F.count("*").alias("n"), F.round(F.count_if("won") * 100.0 / F.count("*"), 6).alias("success_percent"))


def display_page(rows: DataFrame, order: list[str], size: int = 20) -> DataFrame:
    """The first rows in order, each with how many more there are."""
    total = rows.agg(F.greatest(F.count("*") - size, F.lit(0)).alias("more"))  # one row
    return rows.orderBy(*order).limit(size).crossJoin(F.broadcast(total))


def storage_size(files: DataFrame, size: Column) -> DataFrame:
    """One row: files, bytes and megabytes."""
    total = F.coalesce(F.sum(size), F.lit(0)).cast("long")
    return files.agg(F.count("*").alias("files"), total.alias("bytes")).withColumn("megabytes", F.bround(F.col("bytes") / F.lit(float(1 << 20)), 2))
