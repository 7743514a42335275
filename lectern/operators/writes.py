"""Writes as functions of (table, delta): each returns the table after the write, to be stored under a new version.

A delta has one row per key (`latest` makes it so). Both sides meet in one full join on the key; which side a
column comes from is a rule on the two values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import boxes

Rule = Callable[[Column, Column, Column, Column], Column]

# The states that a write may set, and those that some writes leave alone.
REVIEW_STATES = ["pending", "approved", "rejected"]
SETTLED = ["approved", "rejected"]
PROTECTED = ["edited", "ready", "imported", "skipped"]
RECORD_STATES = ["empty", "staged", "edited", "ready", "imported", "skipped"]


def latest(delta: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key by `order`; partial maxima, so a hot key needs no sort."""
    return delta.groupBy(key).agg(F.max_by(F.struct(*delta.columns), order).alias("row")).select("row.*")


def replaced(old: Column, new: Column, is_old: Column, is_new: Column) -> Column:
    """The delta's value, null included, where the delta has the row."""
    return F.when(is_new, new).otherwise(old)


def kept(old: Column, new: Column, is_old: Column, is_new: Column) -> Column:
    """The table's value where the table has the row."""
    return F.when(is_old, old).otherwise(new)


def filled(old: Column, new: Column, is_old: Column, is_new: Column) -> Column:
    """The delta's value unless it is null."""
    return F.coalesce(new, old)


def frozen(states: list[str]) -> Rule:
    """As `replaced`, but a value among `states` stays."""
    return lambda old, new, is_old, is_new: F.when(is_old & old.isin(states), old).otherwise(replaced(old, new, is_old, is_new))


def merge(base: DataFrame, delta: DataFrame, key: str, rules: dict[str, Rule], default: Rule = replaced) -> DataFrame:
    """`base` after an upsert of `delta`; columns that only `base` has stay, and are null in new rows."""
    b, d = base.withColumn("is_old", F.lit(True)).alias("b"), delta.withColumn("is_new", F.lit(True)).alias("d")
    is_old, is_new = F.col("b.is_old").isNotNull(), F.col("d.is_new").isNotNull()
    out = []
    for c in base.columns:
        if c == key:
            out.append(F.coalesce(f"b.{c}", f"d.{c}").alias(c))
        elif c in delta.columns:
            out.append(rules.get(c, default)(F.col(f"b.{c}"), F.col(f"d.{c}"), is_old, is_new).alias(c))
        else:
            out.append(F.col(f"b.{c}").alias(c))
    return b.join(d, F.col(f"b.{key}") == F.col(f"d.{key}"), "full").select(*out)


def upsert_sources(base: DataFrame, delta: DataFrame) -> DataFrame:
    """Every column is replaced but created_at; folder_id is never null."""
    return merge(base, delta, "id", {"created_at": kept, "folder_id": lambda *x: F.coalesce(replaced(*x), F.lit(""))})


def upsert_questions(base: DataFrame, delta: DataFrame) -> DataFrame:
    """The delta's columns are replaced; created_at and a settled review_status stay."""
    return merge(base, delta, "id", {"created_at": kept, "review_status": frozen(SETTLED)})


def upsert_answers(base: DataFrame, delta: DataFrame) -> DataFrame:
    """As questions, and a link is never lost."""
    return merge(base, delta, "id", {"created_at": kept, "review_status": frozen(SETTLED), "question_id": filled})


def upsert_staged_sources(base: DataFrame, delta: DataFrame) -> DataFrame:
    """Nulls of the delta change nothing, but in file_fault and meta_json; a protected status stays."""
    return merge(base, delta, "id", {"status": frozen(PROTECTED), "file_fault": replaced, "meta_json": replaced}, filled)


def upsert_staged_records(base: DataFrame, delta: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(table, refused ids): a record in a protected state refuses the write whole."""
    refused = delta.join(base.filter(F.col("status").isin(PROTECTED)), "id", "left_semi").select("id")
    return merge(base, delta.join(refused, "id", "left_anti"), "id", {"created_at": kept}), refused


def edit_records(base: DataFrame, edits: DataFrame, allowed: list[str]) -> DataFrame:
    """Human edits of the columns `allowed` alone; imported rows are frozen, ready stays ready, any other becomes edited."""
    given = edits.select("id", *[F.col(c).alias(f"new_{c}") for c in allowed if c in edits.columns], F.lit(True).alias("is_edit"))
    may = F.coalesce(F.col("is_edit"), F.lit(False)) & (F.coalesce("status", F.lit("")) != "imported")
    out = [F.when(may, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if f"new_{c}" in given.columns else F.col(c) for c in base.columns if c != "status"]
    status = F.when(may & (F.coalesce("status", F.lit("")) != "ready"), "edited").otherwise(F.col("status")).alias("status")
    return base.join(given, "id", "left").select(*[status if c == "status" else out[[x for x in base.columns if x != "status"].index(c)] for c in base.columns])


def set_status(base: DataFrame, ids: DataFrame, status: str, allowed: list[str], column: str = "status") -> DataFrame:
    """`base` with the status of the rows of `ids` set; a status that is not allowed is an error."""
    if status not in allowed:
        raise ValueError(f"no such status: {status}")
    hit = ids.select("id").distinct().withColumn("is_hit", F.lit(True))
    new = F.when(F.col("is_hit"), F.lit(status)).otherwise(F.col(column)).alias(column)
    return base.join(hit, "id", "left").select(*[new if c == column else F.col(c) for c in base.columns])


def set_review_status(questions: DataFrame, answers: DataFrame, ids: DataFrame, status: str) -> tuple[DataFrame, DataFrame]:
    """Both tables with the review status set for (entity, id) rows."""
    pick = lambda entity: ids.filter(F.col("entity") == entity)
    return tuple(set_status(t, pick(e), status, REVIEW_STATES, "review_status") for t, e in ((questions, "question"), (answers, "answer")))


def apply_revision(base: DataFrame, delta: DataFrame, status_columns: list[str]) -> DataFrame:
    """Content is replaced in every row; the status columns are frozen where the table's row is approved."""
    approved = F.coalesce(F.col("b.revision_status") == "approved", F.lit(False))
    rule = lambda *x: F.when(approved, x[0]).otherwise(replaced(*x))
    known = delta.join(base, "id", "left_semi")
    return merge(base, known, "id", {c: rule for c in status_columns})


def resolve(base: DataFrame, ids: DataFrame, approve: bool) -> DataFrame:
    """Approve or reopen rows; either way nothing is left to review."""
    out = set_status(base, ids, "approved" if approve else "pending", ["approved", "pending"], "revision_status")
    hit = ids.select("id").distinct().withColumn("is_hit", F.lit(True))
    review = F.when(F.col("is_hit"), F.lit(False)).otherwise(F.col("needs_review")).alias("needs_review")
    return out.join(hit, "id", "left").select(*[review if c == "needs_review" else F.col(c) for c in base.columns])


def set_media_box(base: DataFrame, edits: DataFrame) -> DataFrame:
    """media with element `index` (from 0) boxed by `box`, for the edits (id, index, box); out of range changes nothing."""
    joined = base.join(edits.select("id", "index", "box"), "id", "left")
    media = F.when(F.col("index").isNull(), F.col("media")).otherwise(boxes.set_box(F.col("media"), F.col("index"), F.col("box"))).alias("media")
    return joined.select(*[media if c == "media" else F.col(c) for c in base.columns])


def clear_zero_boxes(base: DataFrame, newest: int, order: str = "created_at") -> DataFrame:
    """Zero boxes become null in the `newest` rows that hold one; a second run finds others or none."""
    chosen = base.filter(boxes.holds_zero_box(F.col("media"))).orderBy(F.desc_nulls_last(order), F.desc("id")).limit(newest).select("id", F.lit(True).alias("is_hit"))
    media = F.when(F.col("is_hit"), boxes.clear_zero_boxes(F.col("media"))).otherwise(F.col("media")).alias("media")
    return base.join(chosen, "id", "left").select(*[media if c == "media" else F.col(c) for c in base.columns])


def set_cell(base: DataFrame, key: str, ident, column: str, value) -> DataFrame:
    """One cell changed; the key is not editable, an unknown column is an error, an equal value changes nothing."""
    if column == key or column not in base.columns:
        raise ValueError(f"not editable: {column}")
    new = F.when(F.col(key) == F.lit(ident), F.lit(value).cast(base.schema[column].dataType)).otherwise(F.col(column))
    return base.withColumn(column, new)


def insert_row(base: DataFrame, values: dict, dropped: tuple[str, ...] = ("created_at", "raw_ocr_text")) -> DataFrame:
    """One row more; empty strings and the columns `dropped` are left to their defaults (null)."""
    used = {k: v for k, v in values.items() if v != "" and k not in dropped}
    if unknown := set(used) - set(base.columns):
        raise ValueError(f"unknown columns: {sorted(unknown)}")
    one = base.sparkSession.range(1).select(*[F.lit(used.get(f.name)).cast(f.dataType).alias(f.name) for f in base.schema])
    return base.union(one)


def delete_rows(base: DataFrame, ids: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(table, deleted rows): the deleted rows are returned to be stored before the table is."""
    return base.join(ids.select(key), key, "left_anti"), base.join(ids.select(key).distinct(), key, "left_semi")


def create_batches(base: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the delta that meet none of the table's in any of `keys`; of the delta's own the least id stays."""
    out = delta
    for k in keys:
        out = out.join(base.select(k), k, "left_anti")
    for k in keys:
        first = out.groupBy(k).agg(F.min("id").alias("least"))
        out = out.join(first, k).filter("id = least").drop("least")
    return base.unionByName(out.select(*base.columns))


def project_ready(staged: DataFrame) -> DataFrame:
    """Staged rows as live ones: ready becomes approved, the grade a number or null, link_id the question_id."""
    grade = F.when(F.col("grade").cast("string").rlike(r"^[0-9]+$"), F.col("grade").cast("int"))
    return staged.withColumn("grade", grade).withColumn("review_status", F.when(F.col("status") == "ready", "approved").otherwise("pending"))


def import_ready(batch: DataFrame, live_sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(row outcomes, batch outcomes) of the ready rows of batches.

    A row without a live source, or whose assets failed (asset_ok false), fails alone; a batch with a failed row
    is failed, with both counts.
    """
    known = live_sources.select(F.col("id").alias("source_id"), F.lit(True).alias("has_source"))
    rows = batch.filter("status = 'ready'").join(known, "source_id", "left")
    fault = F.when(F.col("has_source").isNull(), "no source").when(~F.coalesce("asset_ok", F.lit(True)), "asset failed")
    rows = rows.select("batch_id", "id", "kind", F.when(fault.isNull(), "imported").otherwise("failed").alias("outcome"), fault.alias("fault"))
    counts = rows.groupBy("batch_id").agg(F.count_if(F.col("outcome") == "imported").alias("imported"), F.count_if(F.col("outcome") == "failed").alias("failed"))
    return rows, counts.withColumn("status", F.when(F.col("failed") > 0, "failed").otherwise("imported"))


def ready_all(base: DataFrame, source_id, states: list[str] = ["staged"]) -> DataFrame:
    """Every row of a source in one of `states` becomes ready."""
    hit = (F.col("source_id") == F.lit(source_id)) & F.col("status").isin(states)
    return base.withColumn("status", F.when(hit, "ready").otherwise(F.col("status")))


def reparse(base: DataFrame, parsed: DataFrame, apply: bool) -> DataFrame:
    """(id, before, after, written) for rows not imported whose new list (id, options) is longer; or, applied, the table."""
    new = parsed.select("id", F.col("options").alias("new_options"))
    joined = base.join(new, "id", "left")
    longer = (F.coalesce("status", F.lit("")) != "imported") & (F.coalesce(F.size("new_options"), F.lit(0)) > F.coalesce(F.size("options"), F.lit(0)))
    if not apply:
        return joined.filter(longer).select("id", F.size("options").alias("before"), F.size("new_options").alias("after"), F.lit(False).alias("written"))
    return joined.select(*[F.when(longer, F.col("new_options")).otherwise(F.col("options")).alias("options") if c == "options" else F.col(c) for c in base.columns])


def replay(parked: DataFrame, failing: DataFrame, most: int) -> DataFrame:
    """(seq, op, attempts, outcome) of parked writes, oldest first.

    An operation of `failing` (op) fails again and keeps its place with one attempt more, until `most` are used up.
    """
    known = failing.select("op").distinct().withColumn("fails", F.lit(True))
    out = parked.join(known, "op", "left").withColumn("attempts", F.col("attempts") + 1)
    outcome = F.when(F.col("fails").isNull(), "written").when(F.col("attempts") >= most, "given up").otherwise("parked")
    return out.select("seq", "op", "attempts", outcome.alias("outcome"))


def with_columns_of(base: DataFrame, columns: dict[str, str]) -> DataFrame:
    """`base` with the columns that it lacks, null, and its rows as they are."""
    return base.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in base.columns}) if columns else base


def accept_alias(vocabulary: DataFrame, variant: str, tag: str, folded: Callable[[Column], Column]) -> DataFrame:
    """The vocabulary (tag, variants) with `variant` appended to the tag, found exactly or by its folded form."""
    hit = (F.col("tag") == tag) | (folded(F.col("tag")) == folded(F.lit(tag)))
    if vocabulary.filter(hit).isEmpty():
        raise ValueError(f"unknown tag: {tag}")
    more = F.array_distinct(F.concat("variants", F.array(F.lit(variant))))
    return vocabulary.withColumn("variants", F.when(hit, more).otherwise(F.col("variants")))


def consolidate(base: DataFrame, legacy: DataFrame, columns: list[str], complete_backup: bool, apply: bool) -> tuple[DataFrame, DataFrame]:
    """(table, parity checks): nulls of `columns` filled from a legacy table; without `apply` the table stays.

    A run is refused without a complete backup. The checks compare the row counts and that no value is lost.
    """
    if apply and not complete_backup:
        raise ValueError("no complete backup")
    after = merge(base, legacy.join(base, "id", "left_semi").select("id", *columns), "id", {c: lambda old, new, *_: F.coalesce(old, new) for c in columns})
    both = base.select("id", *columns).alias("x").join(after.select("id", *columns).alias("y"), "id", "full")
    lost = [F.count_if(F.col(f"x.{c}").isNotNull() & ~F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}"))).alias(c) for c in columns]
    counts = both.agg(F.count("*").alias("rows"), *lost).select(F.expr("stack(" + str(len(columns)) + ", " + ", ".join(f"'kept_{c}', {c} = 0" for c in columns) + ") as (check, ok)"))
    return (after if apply else base), counts
