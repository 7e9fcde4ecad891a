"""Sequential greedy deduplication of one batch: an item is dropped only if it meets an earlier accepted one."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexarena.sources.tables import written


def accept_in_order(items: DataFrame) -> DataFrame:
    """Items (seq, url, date, number) that a pass in seq order accepts.

    An item is refused if an accepted earlier one has its url, or its date and number. Undecided items
    are settled in waves: one that is first among the undecided in both of its groups is accepted, and
    what it meets is refused. Each wave settles the first undecided item at least, so the loop ends; a
    chain of collisions takes a wave for each link. A wave's tables are written to the shared folder, so
    its plan starts from files. Null urls, dates and numbers meet nothing.
    """
    todo, done = items.select("seq", "url", "date", "number"), None
    while True:
        first = todo.where("url IS NOT NULL").groupBy("url").agg(F.min("seq").alias("u"))
        also = todo.where("date IS NOT NULL AND number IS NOT NULL").groupBy("date", "number").agg(F.min("seq").alias("d"))
        marked = todo.join(first, "url", "left").join(also, ["date", "number"], "left")
        won = written(marked.where("seq = coalesce(u, seq) AND seq = coalesce(d, seq)").select("seq", "url", "date", "number"), "accepted")
        done = won if done is None else done.unionAll(won)
        todo = todo.join(won.select("seq"), "seq", "left_anti").join(won.select("url"), "url", "left_anti").join(won.select("date", "number"), ["date", "number"], "left_anti")
        todo = written(todo.select("seq", "url", "date", "number"), "undecided")
        if todo.isEmpty():
            return items.join(done.select("seq"), "seq", "left_semi")


def accept_reference(items: pd.DataFrame) -> list[int]:
    """The same by a plain loop, for tests."""
    urls, days, kept = set(), set(), []
    for row in items.sort_values("seq").itertuples():
        if row.url not in urls and (row.date, row.number) not in days:
            kept.append(row.seq)
            urls.add(row.url)
            days.add((row.date, row.number))
    return kept
