"""Runs of pages, segments and lanes, and what is made of the replies for a run of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def page_runs(items: DataFrame, key: str, page: str, most: int) -> DataFrame:
    """`items` with `run` and `at`: consecutive pages of one key, `most` of them at the most, and the place in it.

    A run breaks where the key changes, a page does not follow the one before, or the run is full. An item
    without a key or a page is a run of its own. Pages of one key are ordered within that key, so no key waits
    for another.
    """
    inside = Window.partitionBy(key).orderBy(page)
    runs = items.filter(F.col(key).isNotNull() & F.col(page).isNotNull())
    runs = runs.withColumn("island", F.col(page) - F.row_number().over(inside))
    place = F.row_number().over(Window.partitionBy(key, "island").orderBy(page)) - 1
    runs = runs.withColumn("rn", place)
    first = F.min(page).over(Window.partitionBy(key, "island", F.floor(F.col("rn") / most)))
    runs = runs.withColumn("run", F.concat_ws(":", F.col(key).cast("string"), first.cast("string"))).withColumn("at", (F.col("rn") % most).cast("int")).drop("island", "rn")
    alone = items.filter(F.col(key).isNull() | F.col(page).isNull()).withColumn("run", F.lit(None).cast("string")).withColumn("at", F.lit(0))
    return runs.unionByName(alone)


def segments(items: DataFrame, group: str, order: str, kind: str) -> DataFrame:
    """(group, kind, first, last, n): stretches of equal kind in order, for each group."""
    inside = Window.partitionBy(group).orderBy(order)
    changed = F.when(F.lag(kind).over(inside).eqNullSafe(F.col(kind)) & (F.row_number().over(inside) > 1), 0).otherwise(1)
    marked = items.withColumn("changed", changed).withColumn("segment", F.sum("changed").over(inside))
    return marked.groupBy(group, "segment").agg(F.first(kind).alias(kind), F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).drop("segment")


def lanes(position: Column, n: int) -> tuple[Column, Column]:
    """(lane, round) of the item at a position (from 0): the n-th of each round goes to lane n."""
    return (position % n).cast("int"), (F.floor(position / n) + 1).cast("int")


def merge_replies(replies: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """One row per key: of each column the last non-empty value by `order`."""
    filled = [F.max_by(F.nullif(F.col(c).cast("string"), F.lit("")), F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.col(order))).alias(c) for c in columns]
    return replies.groupBy(key).agg(*filled)


def accepted_batches(pages: DataFrame, run: str, empty: Column) -> DataFrame:
    """(run, pages, empty, accepted): a batch is refused when all its pages, or more than half of them, are empty."""
    out = pages.groupBy(run).agg(F.count("*").alias("pages"), F.count_if(empty).alias("empty"))
    return out.withColumn("accepted", F.col("empty") * 2 <= F.col("pages")).withColumn("accepted", F.col("accepted") & (F.col("empty") < F.col("pages")))
