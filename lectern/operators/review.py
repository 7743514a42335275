"""The review listing: faceted questions with the answers that belong to them.

An answer belongs to a question by its id, or, where it has no link, by the identity (number, subject, topic,
grade). The two cases exclude each other, so an OR join becomes the union of two equi-joins, with no nested loop
and nothing to deduplicate.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IDENTITY = ["question_number", "subject", "topic", "grade"]
#: Rows up to which the listed questions are broadcast to the answers.
BROADCAST_ROWS = 10_000
#: Tasks for each core, at least, over which the pairs of one identity are dealt out.
SPREAD = 8
#: Questions of one identity that one task pairs, about: those of a larger one are dealt over several.
TOGETHER = 10_000
# The revision listings.
VIEWS = {
    "flagged": lambda: F.col("needs_review"),
    "revised": lambda: F.col("revision_status") == "revised",
    "approved": lambda: F.col("revision_status") == "approved",
    "all": lambda: F.lit(True),
}


def chosen(value: str | Iterable | None) -> list[str]:
    """The values of a facet: a scalar, a comma-separated text or a list; blanks and 'all' choose nothing."""
    if value is None:
        return []
    parts = value.split(",") if isinstance(value, str) else value if isinstance(value, (list, tuple, set)) else [value]
    return [x for x in (str(v).strip() for v in parts if v is not None) if x not in ("", "all")]


def facets(df: DataFrame, **values: str | Iterable | None) -> DataFrame:
    """Rows whose columns are among the chosen values; a column without choices does not filter, null never matches.

    Values are cast to the column's type, so the filter reaches the scan.
    """
    types = {f.name: f.dataType for f in df.schema}
    tests = [F.col(c).isin([F.lit(v).try_cast(types[c]) for v in found]) for c, v in values.items() if (found := chosen(v))]
    return df.filter(reduce(Column.__and__, tests)) if tests else df


def between_days(df: DataFrame, column: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """Rows whose time lies on the days first..last, both included, as a range that the scan can use."""
    kind = df.schema[column].dataType
    if first:
        df = df.filter(F.col(column) >= F.lit(first).cast(kind))
    if last:
        df = df.filter(F.col(column) < F.date_add(F.lit(last).cast("date"), 1).cast(kind))
    return df


def with_answers(questions: DataFrame, answers: DataFrame, columns: list[str], inner: bool = False, small_questions: bool = False) -> DataFrame:
    """(columns, answer_id, answer_review_status): every question with each answer that belongs to its id; unless `inner`, once with nulls without any.

    The questions' columns go through the joins, so questions and answers are shuffled and the pairs never are: their
    number grows with the square of an identity's size. Questions of one id share their answers, as a join of the
    pairs by id gives them. The questions of a large identity are dealt over tasks that each get its loose answers.
    """
    loose = answers.filter("question_id is null")
    if not small_questions:
        # A row for `TOGETHER` questions at most.
        deal = questions.groupBy(*IDENTITY).agg(F.ceil(F.count("*") / TOGETHER).alias("deals")).filter("deals > 1")
        loose = loose.join(F.broadcast(deal), IDENTITY, "left").withColumn("deal", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("deals") - 1, F.lit(0)))))
    names = [F.col("id").alias("answer_id"), F.col("review_status").alias("answer_review_status"), F.col("question_id").alias("a_question_id"), *[F.col(c).alias(f"a_{c}") for c in IDENTITY]]
    named = answers.select(*names)
    keys = questions.select(F.col("id").alias("q_id"), *[F.col(c).alias(f"q_{c}") for c in IDENTITY])
    shown = questions.select(*columns)
    twins = shown.join(F.broadcast(keys) if small_questions else keys, F.col("id") == F.col("q_id"))
    twins = F.broadcast(twins) if small_questions else twins
    listed = [*columns, "answer_id", "answer_review_status"]
    by_id = twins.join(named.filter("a_question_id is not null"), F.col("id") == F.col("a_question_id")).select(*listed)
    same = [F.col(f"q_{c}") == F.col(f"a_{c}") for c in IDENTITY]
    if small_questions:
        loose = loose.select(*names)
    else:
        # The adaptive plan joins partitions by the bytes that come in, and a few megabytes make millions of pairs.
        spark = questions.sparkSession
        n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), SPREAD * spark.sparkContext.defaultParallelism)
        twins = twins.join(F.broadcast(deal.withColumnsRenamed({c: f"d_{c}" for c in IDENTITY})), [F.col(f"q_{c}") == F.col(f"d_{c}") for c in IDENTITY], "left")
        twins = twins.withColumn("q_deal", F.pmod(F.xxhash64("q_id"), F.coalesce("deals", F.lit(1))))
        loose = loose.select(*names, F.col("deal").alias("a_deal"))
        twins, loose = (df.repartition(n, *[f"{k}_{c}" for c in [*IDENTITY, "deal"]]) for df, k in ((twins, "q"), (loose, "a")))
        same.append(F.col("q_deal") == F.col("a_deal"))
    out = by_id.union(twins.join(loose, same).select(*listed))
    if inner:
        return out
    alone = shown.join(answered_ids(questions, answers, small_questions), "id", "left_anti")
    return out.union(alone.select(*columns, F.lit(None).cast(named.schema["answer_id"].dataType), F.lit(None).cast(named.schema["answer_review_status"].dataType)))


def answered_ids(questions: DataFrame, answers: DataFrame, small_questions: bool = False) -> DataFrame:
    """(id): each answered question once, by semi joins that never multiply rows; of few questions, the answers are cut to those that may be theirs."""
    linked = answers.filter("question_id is not null").select(F.col("question_id").alias("id"))
    loose = answers.filter("question_id is null").select(*IDENTITY)
    if small_questions:
        linked = linked.join(F.broadcast(questions.select("id")), "id", "left_semi")
        loose = loose.join(F.broadcast(questions.select(*IDENTITY)), IDENTITY, "left_semi")
    by_id = questions.join(linked.distinct() if small_questions else linked, "id", "left_semi").select("id")
    by_identity = questions.join(loose.distinct(), IDENTITY, "left_semi").select("id")
    return by_id.union(by_identity).distinct()


def only_answered(questions: DataFrame, answers: DataFrame, wanted: str | None) -> DataFrame:
    """'1': answered questions, '0': the others, anything else: all."""
    if wanted == "1":
        return questions.join(answered_ids(questions, answers), "id", "left_semi")
    if wanted == "0":
        left = questions.join(answers.select(F.col("question_id").alias("id")), "id", "left_anti")
        return left.join(answers.filter("question_id is null").select(*IDENTITY), IDENTITY, "left_anti").select(*questions.columns)
    return questions


def review_rows(
    questions: DataFrame, answers: DataFrame, mode: str = "both", limit: int | None = 120, date_from: str | None = None, date_to: str | None = None,
    has_answer: str | None = None, has_picture: str | None = None, **values: str | Iterable | None,
) -> DataFrame:
    """The newest `limit` (question, answer) rows of the faceted questions, by falling question id, then answer id.

    Questions without an answer come once with nulls, unless mode is 'answers'. Each question, or each answered one,
    gives a row at least, so a listing needs only the newest `limit` of them: they are cut before the join and, up to
    `BROADCAST_ROWS`, broadcast, so the answers are scanned without a shuffle. Limit None lists all.
    """
    found = between_days(facets(questions, **values), "created_at", date_from, date_to)
    if has_picture in ("0", "1"):
        found = found.filter((F.col("n_media") > 0) == F.lit(has_picture == "1"))
    found = only_answered(found, answers, has_answer)
    inner = mode == "answers"
    if limit is not None:
        cut = answered_ids(found, answers) if inner else found.select("id")
        newest = cut.orderBy(F.desc("id")).limit(limit).select(F.col("id").alias("newest_id")).distinct()
        found = found.join(F.broadcast(newest), F.col("id").eqNullSafe(F.col("newest_id")), "left_semi")
    # Formatted before the join, once a question.
    found = found.withColumns({"grade_text": F.col("grade").cast("string"), "created": F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss")})
    columns = ["id", "source_id", "question_number", "question_text", "subject", "topic", "grade_text", "corp", "year", "difficulty", "review_status", "created"]
    rows = with_answers(found, answers, columns, inner, small_questions=limit is not None and limit <= BROADCAST_ROWS)
    rows = rows.withColumnsRenamed({"grade_text": "grade", "created": "created_at"})
    return rows if limit is None else rows.orderBy(F.desc("id"), F.asc_nulls_last("answer_id")).limit(limit)


def latest_answers(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Each question with its linked answer of the least id, nulls where it has none; one aggregate with partial minima."""
    first = answers.filter("question_id is not null").groupBy(F.col("question_id").alias("id")).agg(F.min(F.struct("id", "review_status", "grade")).alias("first"))
    out = questions.select("id", "subject", "revision_status").join(first, "id", "left")
    return out.select("id", "subject", "revision_status", F.col("first.id").alias("answer_id"), F.col("first.review_status").alias("answer_review_status"))


def with_source(questions: DataFrame, sources: DataFrame) -> DataFrame:
    """Questions with their source's file name and, where they have none, its subject."""
    named = sources.select(F.col("id").alias("source_id"), "file_name", F.col("subject").alias("source_subject"))
    return questions.join(named, "source_id", "left").select("id", "source_id", "file_name", F.coalesce(F.nullif("corp", F.lit("")), "source_subject").alias("corp_or_subject"), F.col("grade").cast("string").alias("grade"))


def with_question(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """Answers with the question they link to."""
    named = questions.select(F.col("id").alias("question_id"), F.col("question_text").alias("text"), F.col("review_status").alias("question_status"))
    return answers.select("id", "question_id", "review_status").join(named, "question_id", "left")


def source_detail(sources: DataFrame, questions: DataFrame, answers: DataFrame, most: int | None = None) -> DataFrame:
    """Each source with its questions as an array in the order of their numbers, and the number of their linked answers.

    Counts are joined in after partial aggregation, so no child row is multiplied.
    """
    per_question = answers.filter("question_id is not null").groupBy(F.col("question_id").alias("id")).agg(F.count("*").alias("n"))
    children = questions.select("id", "source_id", "question_number").join(per_question, "id", "left")
    entry = F.struct("question_number", "id", F.coalesce("n", F.lit(0)).alias("n_answers"))
    nested = children.groupBy("source_id").agg(F.array_sort(F.collect_list(entry)).alias("questions"), F.sum(F.coalesce("n", F.lit(0))).alias("n_answers"))
    nested = nested.withColumnRenamed("source_id", "id")
    listed = F.coalesce("questions", F.expr("cast(array() as array<struct<question_number:int,id:bigint,n_answers:bigint>>)"))
    return sources.select("id", "file_name").join(nested, "id", "left").select("id", "file_name", listed.alias("questions"), F.coalesce("n_answers", F.lit(0)).alias("n_answers"))


def source_counts(sources: DataFrame, questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Each source with how many questions it has and how many of them are linked; zero, not null, for none."""
    linked = answers.filter("question_id is not null").select(F.col("question_id").alias("id")).distinct().withColumn("linked", F.lit(1))
    counts = questions.select("id", "source_id").join(linked, "id", "left").groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("n_questions"), F.count("linked").alias("n_linked"))
    return sources.select("id", "status").join(counts, "id", "left").select("id", "status", F.coalesce("n_questions", F.lit(0)).alias("n_questions"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"))


def pending(questions: DataFrame) -> DataFrame:
    """Questions that no revision has settled."""
    return questions.filter(F.coalesce("revision_status", F.lit("pending")) == "pending")


def pending_answers(answers: DataFrame) -> DataFrame:
    """Answers that no revision has settled, and all without a link."""
    return answers.filter((F.coalesce("revision_status", F.lit("pending")) == "pending") | F.col("question_id").isNull())


def revision_items(rows: DataFrame, view: str = "flagged", limit: int = 200) -> DataFrame:
    """A revision listing, newest first, nulls last; an unknown view is 'flagged'."""
    return rows.filter(VIEWS.get(view, VIEWS["flagged"])()).orderBy(F.desc_nulls_last("created_at"), "id").limit(limit)


def for_linking(answers: DataFrame, numbers: DataFrame, ids: DataFrame) -> DataFrame:
    """Unlinked answers with one of `numbers` (question_number), and those linked to one of `ids` (id)."""
    loose = answers.filter("question_id is null").join(numbers.select("question_number").distinct(), "question_number", "left_semi")
    linked = answers.join(ids.select(F.col("id").alias("question_id")).distinct(), "question_id", "left_semi")
    return loose.select(*answers.columns).union(linked.select(*answers.columns))


def context_questions(questions: DataFrame, subject: str | None, topic: str | None, grade: int | None) -> DataFrame:
    """Questions equal in all three; a None matches nothing."""
    return questions.filter((F.col("subject") == F.lit(subject)) & (F.col("topic") == F.lit(topic)) & (F.col("grade") == F.lit(grade)))


def by_ids(rows: DataFrame, ids: DataFrame | list) -> DataFrame:
    """The rows with these ids: a literal list as a pushed filter, a table as a semi-join."""
    return rows.filter(F.col("id").isin(ids)) if isinstance(ids, list) else rows.join(ids.select("id").distinct(), "id", "left_semi")


def outside(rows: DataFrame, touched: DataFrame) -> DataFrame:
    """Rows whose id is not among those touched."""
    return rows.join(touched.select("id").distinct(), "id", "left_anti")


def matches_text(df: DataFrame, text: str, skip: Iterable[str] = ("raw_ocr_text",)) -> DataFrame:
    """Rows in which some column's text holds `text`, case-blind; % and _ stay wild; null columns never match."""
    tests = [F.coalesce(F.col(f"`{c}`").cast("string").ilike(f"%{text}%"), F.lit(False)) for c in df.columns if c not in set(skip)]
    return df.filter(reduce(Column.__or__, tests))


def page_of_rows(df: DataFrame, sort: str, limit: int = 100, offset: int = 0, falling: bool = True, text: str = "", most: int = 500) -> DataFrame:
    """One page of a table, sorted by a column of it (nulls last, ties by id), with the total of the filtered rows.

    The total is a separate count, joined as one row: no window gathers all rows in one task.
    """
    if sort not in df.columns:
        raise ValueError(f"no column {sort}")
    found = matches_text(df, text) if text else df
    order = F.desc_nulls_last(sort) if falling else F.asc_nulls_last(sort)
    total = found.agg(F.count("*").alias("total"))
    return found.orderBy(order, "id").offset(offset).limit(min(limit, most)).join(F.broadcast(total))


def newest(df: DataFrame, most: int, order: str = "created_at") -> DataFrame:
    """The newest `most` rows, undated ones last, the higher id first among equals."""
    return df.orderBy(F.desc_nulls_last(order), F.desc("id")).limit(most)


def by_numbers(questions: DataFrame, wanted: DataFrame, exclude: DataFrame, scope: str = "subject") -> DataFrame:
    """Questions whose number, as text, is asked for in their scope (wanted: scope, number), without those of `exclude` (id)."""
    asked = wanted.select(F.col(scope), F.col("number").cast("string").alias("wanted_number")).distinct()
    met = questions.withColumn("wanted_number", F.col("question_number").cast("string")).join(asked, [scope, "wanted_number"], "left_semi")
    return met.join(exclude.select("id").distinct(), "id", "left_anti").select(*questions.columns)


def context(questions: DataFrame, ids: DataFrame, wanted: DataFrame, scope: str = "subject") -> DataFrame:
    """Context for a reader, with origin: the questions asked for by id, then those asked for by number that are not among them."""
    first = questions.join(ids.select("id").distinct(), "id", "left_semi").select(*questions.columns)
    return first.withColumn("origin", F.lit("id")).union(by_numbers(questions, wanted, ids, scope).withColumn("origin", F.lit("number")))


def _named_views() -> dict[str, Column]:
    state = F.col("revision_status")
    return {"flagged": F.col("needs_review"), "revised": state == "revised", "approved": state == "approved", "all": state.isNotNull()}


def views(df: DataFrame) -> DataFrame:
    """(id, view): each row under every named view of the revision that it belongs to."""
    return df.select("id", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in _named_views().items()]))).alias("view"))


def view(df: DataFrame, name: str) -> DataFrame:
    """The rows of one named view; an unknown name is an error."""
    named = _named_views()
    if name not in named:
        raise ValueError(f"no such view: {name}")
    return df.filter(named[name])


def unfinished(rows: DataFrame, batch: str, done: tuple[str, ...] = ("imported",)) -> DataFrame:
    """The rows of every batch that are still to be done, with seq, their place in the batch by id; a batch may lie over many tasks."""
    from lectern.operators.chunks import ranked

    return ranked(rows.filter(~F.col("status").isin(*done)), batch, "id", rank="place").withColumn("seq", F.col("place") + 1).drop("place")
