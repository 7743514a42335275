"""Counts, cross-tabs and checks over the bank: single passes of conditional aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators.review import answered_ids, between_days

# The states that a review total counts.
STATES = ["pending", "approved", "rejected"]


def period_counts(questions: DataFrame, answers: DataFrame, sources: DataFrame, first: str | None = None, last: str | None = None) -> DataFrame:
    """One row: questions, answers, errors (rejected), files by kind, and succeeded, over a range of days."""
    q = between_days(questions, "created_at", first, last).agg(F.count("*").alias("questions"), F.count_if(F.col("review_status") == "rejected").alias("errors"))
    a = between_days(answers, "created_at", first, last).agg(F.count("*").alias("answers"))
    s = between_days(sources, "created_at", first, last).agg(
        F.count("*").alias("files"), F.count_if(F.col("type") == "question").alias("question_files"), F.count_if(F.col("type") == "answer").alias("answer_files")
    )
    return q.join(F.broadcast(a)).join(F.broadcast(s)).withColumn("succeeded", F.col("questions") + F.col("answers"))


def status_counts(rows: DataFrame, column: str = "review_status") -> DataFrame:
    """(status, n, total): rows per state; total counts the three known states alone and comes once per row."""
    counts = rows.groupBy(F.col(column).alias("status")).agg(F.count("*").alias("n"))
    total = rows.agg(F.count_if(F.col(column).isin(STATES)).alias("total"))
    return counts.join(F.broadcast(total))


def subject_status(questions: DataFrame) -> DataFrame:
    """Per subject the rows of each known state and the total of all states, largest first; null subjects are left out."""
    counts = [F.count_if(F.col("review_status") == s).alias(s) for s in STATES]
    return questions.filter("subject is not null").groupBy("subject").agg(*counts, F.count("*").alias("total")).orderBy(F.desc("total"), "subject")


def answer_picture_matrix(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """One row: questions with and without an answer, crossed with pictures, and the margins."""
    found = answered_ids(questions, answers).withColumn("answered", F.lit(True))
    flagged = questions.select("id", (F.col("n_media") > 0).alias("pictured")).join(found, "id", "left").withColumn("answered", F.coalesce("answered", F.lit(False)))
    a, p = F.col("answered"), F.col("pictured")
    cells = {"answer_picture": a & p, "answer_only": a & ~p, "picture_only": ~a & p, "neither": ~a & ~p, "answered": a, "pictured": p}
    return flagged.agg(*[F.count_if(c).alias(name) for name, c in cells.items()])


def facet_values(questions: DataFrame) -> DataFrame:
    """(facet, value): the distinct values of each facet as text; nulls are left out, blanks too where noted."""
    blank_out = ("corp", "difficulty")
    value = lambda c: F.nullif(F.col(c).cast("string"), F.lit("")) if c in blank_out else F.col(c).cast("string")
    facets = [F.struct(F.lit(c).alias("facet"), value(c).alias("value")) for c in ("subject", "topic", "grade", "corp", "difficulty")]
    return questions.select(F.explode(F.array(*facets)).alias("x")).select("x.*").filter("value is not null").distinct()


def overview(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, rows, latest): size and newest time of each table."""
    parts = [df.agg(F.lit(name).alias("name"), F.count("*").alias("rows"), F.max("created_at").alias("latest")) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def revision_summary(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """(entity, status, n, flagged): rows per revision state, null counting as pending."""
    state = F.coalesce("revision_status", F.lit("pending")).alias("status")
    one = lambda df, name: df.groupBy(F.lit(name).alias("entity"), state).agg(F.count("*").alias("n"), F.count_if("needs_review").alias("flagged"))
    return one(questions, "question").union(one(answers, "answer"))


def staged_counts(tables: dict[str, DataFrame], column: str = "status") -> DataFrame:
    """(name, status, n) of several staging tables."""
    parts = [df.groupBy(F.lit(name).alias("name"), F.col(column).alias("status")).agg(F.count("*").alias("n")) for name, df in tables.items()]
    return reduce(DataFrame.union, parts)


def subject_roll(questions: DataFrame, sources: DataFrame) -> DataFrame:
    """Per subject of a source: its sources, their questions, how many need review and their share in per cent."""
    per_source = questions.groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("n"), F.count_if("needs_review").alias("flagged"))
    joined = sources.select("id", "subject").join(per_source, "id", "left")
    out = joined.groupBy("subject").agg(F.count("*").alias("sources"), F.sum(F.coalesce("n", F.lit(0))).alias("questions"), F.sum(F.coalesce("flagged", F.lit(0))).alias("flagged"))
    share = F.when(F.col("questions") > 0, F.round(100 * F.col("flagged") / F.col("questions"))).otherwise(0).cast("int")
    return out.withColumn("percent", share)


def checks(named: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """(check, failures, ok): for each name how many rows of its table meet the condition that none should."""
    tables = {id(df): df for df, _ in named.values()}
    parts = []
    for key, df in tables.items():  # all conditions on one table in one scan
        counts = [F.struct(F.lit(name).alias("check"), F.count_if(bad).alias("failures")) for name, (t, bad) in named.items() if id(t) == key]
        parts.append(df.agg(F.array(*counts).alias("x")).select(F.explode("x").alias("x")).select("x.*"))
    return reduce(DataFrame.union, parts).withColumn("ok", F.col("failures") == 0)


def parity_checks(questions: DataFrame, answers: DataFrame, sources: DataFrame) -> DataFrame:
    """The invariants of a consolidated bank: links that lead nowhere, blank keys, answers that differ from their question."""
    source_ids = sources.select(F.col("id").alias("source_id"))
    question_keys = questions.select(F.col("id").alias("question_id"), F.col("grade").alias("q_grade"), F.col("subject").alias("q_subject"))
    orphan_q = questions.filter("source_id is not null").join(source_ids, "source_id", "left_anti")
    orphan_a = answers.filter("question_id is not null").join(question_keys, "question_id", "left_anti")
    linked = answers.join(question_keys, "question_id")
    differs = lambda x, y: F.col(x).isNotNull() & F.col(y).isNotNull() & (F.col(x) != F.col(y))
    return checks({
        "question_without_source": (orphan_q, F.lit(True)),
        "answer_without_question": (orphan_a, F.lit(True)),
        "question_without_text": (questions, F.coalesce(F.trim("question_text") == "", F.lit(True))),
        "question_without_subject": (questions, F.coalesce(F.trim("subject") == "", F.lit(True))),
        "question_without_number": (questions, F.col("question_number").isNull()),
        "question_without_grade": (questions, F.col("grade").isNull()),
        "question_state_unknown": (questions, ~F.coalesce(F.col("review_status").isin("pending", "approved", "rejected", "unlinked"), F.lit(False))),
        "answer_without_number": (answers, F.col("question_number").isNull()),
        "answer_state_unknown": (answers, ~F.coalesce(F.col("review_status").isin("pending", "approved", "rejected", "unlinked"), F.lit(False))),
        "answer_unlinked_but_approved": (answers, F.col("question_id").isNull() & (F.col("review_status") == "approved")),
        "source_without_file": (sources, F.coalesce(F.trim("file_name") == "", F.lit(True))),
        "source_without_subject": (sources, F.col("subject").isNull()),
        "linked_grade_differs": (linked, differs("grade", "q_grade")),
        "linked_subject_differs": (linked, differs("subject", "q_subject")),
    })


def snapshot_totals(df: DataFrame, kind: str, size: str) -> DataFrame:
    """(kind, rows, bytes): rows and bytes of each kind, and of all under the kind 'all'."""
    grouped = df.groupBy(kind).agg(F.count("*").alias("rows"), F.sum(size).cast("long").alias("bytes"))
    return grouped.union(grouped.agg(F.lit("all"), F.sum("rows"), F.sum("bytes")))


def uploads_with_counts(sources: DataFrame, questions: DataFrame, most: int = 20) -> DataFrame:
    """(id, file_name, subject, created_at, questions) of the newest `most` sources: the cut comes before the count."""
    newest = sources.orderBy(F.desc_nulls_last("created_at"), F.desc("id")).limit(most).select("id", "file_name", "subject", "created_at")
    counts = questions.join(F.broadcast(newest.select(F.col("id").alias("source_id"))), "source_id", "left_semi").groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("questions"))  # `most` rows
    return newest.join(counts, "id", "left").withColumn("questions", F.coalesce("questions", F.lit(0)))


def subject_totals(questions: DataFrame) -> DataFrame:
    """(subject, total, approved, needs_review) of each subject."""
    return questions.groupBy("subject").agg(
        F.count("*").alias("total"), F.count_if(F.col("review_status") == "approved").alias("approved"), F.count_if("needs_review").alias("needs_review"),
    )
