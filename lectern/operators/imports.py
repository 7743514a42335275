"""Import of ready rows into the live table, with the outcome of each row and batch, in one version of the store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators import writes
from lectern.session import materialise
from lectern.sources.store import Store


def import_batches(store: Store, assets: DataFrame, staged: str = "staged", live: str = "questions", sources: str = "sources", columns: tuple[str, ...] = ("source_id", "question_text", "grade")) -> DataFrame:
    """(batch_id, imported, failed, status) of every batch with ready rows; the rows are in the live table when it returns.

    A row's picture comes first: `assets` (id) are the rows whose pictures are stored, and a row without one, or
    without a live source, fails alone with its reason in `fault`. Imported rows are approved in the live table and
    imported in the staged one, and both tables are published as one version. A second run imports nothing more.
    """
    txn = store.begin()
    ready = txn.read(staged).filter("status = 'ready'").join(assets.select("id").distinct().withColumn("has_asset", F.lit(True)), "id", "left")
    known = txn.read(sources).select(F.col("id").alias("source_id"), F.lit(True).alias("has_source"))
    fault = F.when(F.col("has_source").isNull(), "no source").when(F.col("has_asset").isNull(), "no picture")
    judged = materialise(ready.join(known, "source_id", "left").withColumn("fault", fault).drop("has_source", "has_asset"), "judged")
    wanted = txn.read(live).columns
    grown = writes.project_ready(judged.filter("fault is null")).select("id", *[c for c in columns if c in wanted], "review_status")
    txn.merge(live, grown, writes.upsert_questions)
    outcome = judged.select("id", F.when(F.col("fault").isNull(), "imported").otherwise("failed").alias("status"), "fault")
    txn.merge(staged, outcome, lambda rows, new: writes.merge(rows, new, "id", {}))
    txn.publish()
    counts = judged.groupBy("batch_id").agg(F.count_if(F.col("fault").isNull()).alias("imported"), F.count_if(F.col("fault").isNotNull()).alias("failed"))
    return counts.withColumn("status", F.when(F.col("failed") > 0, "failed").otherwise("imported"))
