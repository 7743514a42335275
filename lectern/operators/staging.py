"""Replies of a reader as staged rows, and a revision of what is staged, as one set-oriented job each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import boxes, maths, options, rows, text
from lectern.operators import audit, linking

QUESTION_REPLY = "array<struct<question_number:string,question_text:string,options:string,corp:string,year:string,difficulty:string,diagram_bbox:string,type:string,page:string,caption:string,table_text:string,table_format:string>>"
ANSWER_REPLY = "array<struct<question_number:string,answer_explanation:string,correct_option_label:string,correct_option_text:string,corp:string,year:string,page:string,diagram_bbox:string>>"


def _entries(replies: DataFrame, key: str, schema: str) -> DataFrame:
    """(source_id, subject, topic, grade, position, entry...): the objects of each reply's list, numbered from 1."""
    listed = F.from_json(F.get_json_object(audit_free(F.col("reply")), f"$.{key}"), schema)
    spread = replies.select("source_id", "subject", "topic", "grade", F.posexplode(listed).alias("at", "e")).filter("e is not null")
    return spread.select("source_id", "subject", "topic", "grade", (F.col("at") + 1).alias("position"), "e.*")


def audit_free(reply: Column) -> Column:
    """The object in a reply, whatever stands around it."""
    return options.first_object(reply)


def stage_questions(replies: DataFrame) -> DataFrame:
    """Staged questions of the replies (source_id, subject, topic, grade, reply).

    Texts are repaired, choices printed in a text become its options, boxes are cleaned, the position stands in
    for a missing number, and the folder's subject, topic and grade stand whatever the reply says.
    """
    e = _entries(replies, "questions", QUESTION_REPLY)
    e = e.withColumn("clean", maths.clean_stored(F.coalesce("question_text", F.lit("")))).withColumn("parted", options.clean_options(F.col("options"), F.col("clean")))
    number = text.position_number(text.latin_digits(F.col("question_number")), F.col("position"))
    box = boxes.clean_box(boxes.box_from_json(F.col("diagram_bbox")))
    table = F.nullif(F.trim("table_text"), F.lit(""))
    empty = (F.trim(F.coalesce("parted.stem", F.lit(""))) == "") & (F.size("parted.options") == 0)
    return e.select(
        text.record_id(F.col("source_id"), "q", number, F.col("position")).alias("id"), "source_id", number.alias("question_number"), F.col("parted.stem").alias("question_text"),
        F.col("parted.options").alias("options"), "subject", "topic", "grade", "corp", text.canonical_year(F.col("year")).alias("year"), "difficulty",
        rows.question_type(F.col("type"), F.col("parted.options")).alias("type"), box.alias("bbox"),
        F.coalesce(text.page_number(F.col("page")), F.lit(1)).alias("page"), F.to_json(F.struct("subject", "topic")).alias("tags"), F.when(empty, "empty").otherwise("staged").alias("status"),
        F.when(box.isNotNull(), boxes.crop_key(F.col("source_id"), "q", number, F.lit(0))).alias("crop_key"), F.lit("pending").alias("crop_state"), F.nullif(F.trim("caption"), F.lit("")).alias("caption"),
        table.alias("table_text"), F.coalesce(F.nullif("table_format", F.lit("")), F.when(table.isNotNull(), "markdown_table")).alias("table_format"),
    )


def candidate_pool(questions: DataFrame, most: int = 25, clip: int = 160) -> DataFrame:
    """(subject, number_key, candidates): for each number of a subject the first `most` questions by id, their texts cut.

    Partitions keep no more than these of a number before the shuffle, so a number that many share stays small.
    """
    said = F.coalesce("question_text", F.lit("")) if "question_text" in questions.columns else F.lit("")
    keyed = questions.select("subject", text.match_number(F.col("question_number")).alias("number_key"), "id", F.substring(said, 1, clip).alias("text")).filter("number_key is not null")
    first = keyed.withColumn("place", F.row_number().over(Window.partitionBy("subject", "number_key").orderBy("id"))).filter(F.col("place") <= most)
    listed = F.array_sort(F.collect_list(F.struct("place", "id", "text")))
    return first.groupBy("subject", "number_key").agg(F.transform(listed, lambda c: F.struct(c["id"].alias("id"), c["text"].alias("text"))).alias("candidates"))


LEGACY_REPLY = "array<struct<question_number:string,question_text:string,options:string,corp:string,year:string,difficulty:string,raw_ocr_text:string,diagram_bbox:string>>"


def legacy_questions(replies: DataFrame) -> DataFrame:
    """Question rows in their first form, from replies (source_id, subject, topic, grade, reply, url).

    The folder's subject, topic and grade stand whatever the reply says; the position stands in for a missing number;
    a picture is kept only with a box that is one.
    """
    e = _entries(replies, "questions", LEGACY_REPLY).join(replies.select("source_id", "url"), "source_id")
    number = F.coalesce(F.nullif(F.nullif("question_number", F.lit("")), F.lit("0")), F.col("position").cast("string"))
    box = boxes.clean_box(boxes.box_from_json(F.col("diagram_bbox")))
    return e.select(
        F.concat("source_id", F.lit("-q"), number).alias("id"), "source_id", text.parse_number(number).alias("question_number"), "question_text",
        F.to_json(options.normalize_options(F.col("options"))).alias("options"), "subject", "topic", "grade", "corp", "year", "difficulty", F.lit("pending").alias("review_status"), "raw_ocr_text",
        F.to_json(box).alias("diagram_bbox"), F.when(box.isNotNull(), F.col("url")).alias("diagram_url"), F.to_json(rows.tags("subject", "topic")).alias("tags"),
    )


def stage_answers(replies: DataFrame, questions: DataFrame) -> DataFrame:
    """Staged answers of the replies, each with the question that the ladder finds for it, how sure that is, and the candidates of its number."""
    e = _entries(replies, "answers", ANSWER_REPLY)
    box = boxes.clean_box(boxes.box_from_json(F.col("diagram_bbox")))
    number = text.position_number(text.latin_digits(F.col("question_number")), F.col("position"))
    staged = e.select(
        text.record_id(F.col("source_id"), "a", number, F.col("position")).alias("id"), "source_id", number.alias("question_number"), "subject", "topic", "grade", "corp",
        text.canonical_year(F.col("year")).alias("year"), maths.clean_stored(F.coalesce("answer_explanation", F.lit(""))).alias("answer_explanation"),
        options.clean_label(F.col("correct_option_label")).alias("correct_option_label"),
        F.when(F.trim(F.coalesce("answer_explanation", F.lit(""))) == "", "empty").otherwise("staged").alias("status"), box.alias("bbox"),
        F.when(box.isNotNull(), boxes.crop_key(F.col("source_id"), "a", number, F.lit(0))).alias("crop_key"), F.coalesce(text.page_number(F.col("page")), F.lit(1)).alias("page"),
    )
    found = linking.verdicts(staged, questions, scope=["subject"])
    linked = staged.join(found.select("id", "match_state", "match_method", "link_id"), "id", "left").withColumn("number_key", text.match_number(F.col("question_number")))
    return linked.join(candidate_pool(questions), ["subject", "number_key"], "left").withColumn("candidates", F.coalesce("candidates", F.array().cast(_candidates(questions)))).drop("number_key")


def _candidates(questions: DataFrame) -> str:
    return f"array<struct<id:{questions.schema['id'].dataType.simpleString()},text:string>>"


def with_option_text(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """Answers with the option that they name: by their label, else the one option quoted in the explanation; and a hash."""
    listed = questions.select(F.col("id").alias("question_id"), F.col("options").alias("question_options"))
    joined = answers.join(listed, "question_id", "left")
    quoted = options.named_in(F.col("question_options"), F.col("answer_explanation"))
    chosen = F.coalesce(options.option_text(F.col("question_options"), F.col("correct_option_label")), quoted["text"])
    label = F.coalesce(F.nullif("correct_option_label", F.lit("")), quoted["label"])
    out = joined.withColumns({"correct_option_text": chosen, "correct_option_label": label, "content_hash": text.content_hash(F.col("answer_explanation"))})
    return out.drop("question_options")


def stage_file(replies: DataFrame, questions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sources, questions, answers): what one job stages; a source without any record has status empty."""
    q, a = stage_questions(replies), stage_answers(replies, questions)
    counts = q.select("source_id").union(a.select("source_id")).groupBy("source_id").agg(F.count("*").alias("n"))
    status = F.when(F.coalesce("n", F.lit(0)) > 0, "staged").otherwise("empty")
    return replies.select("source_id", "subject", "topic", "grade").distinct().join(counts, "source_id", "left").withColumn("status", status).drop("n"), q, a


def slim_pairs(pairs: DataFrame, question_most: int = 3000, answer_most: int = 1500) -> DataFrame:
    """(question_id, pair): what a reader is sent of each pair, as JSON with raw texts cut."""
    cut = F.struct(
        "question_id", "answer_id", "question_text", "answer_explanation",
        F.substring("question_raw", 1, question_most).alias("question_raw"), F.substring("answer_raw", 1, answer_most).alias("answer_raw"),
    )
    return pairs.select("question_id", F.to_json(cut).alias("pair"))


def decoded(df: DataFrame, columns: dict[str, str], dropped: list[str]) -> DataFrame:
    """JSON columns (name -> type) read into values, null where broken, and some columns dropped."""
    return df.withColumns({c: F.from_json(F.col(c), t) for c, t in columns.items()}).drop(*dropped)


def usage_of(reply: Column) -> Column:
    """struct<tokens_in, tokens_out, finish>: counts from either of two reply shapes, 0 where missing."""
    at = lambda *paths: F.coalesce(*[F.get_json_object(reply, p) for p in paths])
    count = lambda *paths: F.coalesce(at(*paths).try_cast("bigint"), F.lit(0))
    return F.struct(
        count("$.usageMetadata.promptTokenCount", "$.usage.prompt_tokens").alias("tokens_in"), count("$.usageMetadata.candidatesTokenCount", "$.usage.completion_tokens").alias("tokens_out"),
        at("$.candidates[0].finishReason", "$.choices[0].finish_reason").alias("finish"),
    )


def revise(questions: DataFrame, answers: DataFrame, run_id: str) -> dict[str, DataFrame]:
    """One revision of all pending rows: pairs, derived labels, reports with ids, statuses and counters.

    Polish comes first, then pairing with conflicts and fills, then labels from explanations, then missing
    columns; a row with an error or a conflict goes to a person.
    """
    from lectern.session import materialise

    # Each step below reads the polished rows again, so they are written once.
    q = materialise(audit.polish(questions, ["question_text"]), "polished-questions")
    a = materialise(audit.polish(answers, ["answer_explanation"]), "polished-answers")
    pairs = linking.pair(q, a)
    filled = materialise(linking.backfill(pairs, q, a), "filled-pairs")
    labels = audit.derived_labels(a.join(q.select(F.col("id").alias("question_id"), F.col("options").alias("q_options")), "question_id", "left").drop("options").withColumnRenamed("q_options", "options"))
    same = ["entity", "entity_id", "field", "issue", "severity", "source"]
    named = lambda df, entity: audit.reports(df, entity).select(same)
    conflict = filled.select(F.lit("question").alias("entity"), F.col("question_id").alias("entity_id"), F.explode("conflicts").alias("field"), F.lit("qa_field_conflict").alias("issue"), F.lit("error").alias("severity"), F.lit("code").alias("source"))
    mismatch = labels.filter("status = 'mismatch'").select(F.lit("answer").alias("entity"), F.col("id").alias("entity_id"), F.lit("correct_option_label").alias("field"), F.lit(audit.CONFLICT_ISSUES[1]).alias("issue"), F.lit("error").alias("severity"), F.lit("code").alias("source"))
    unmatched = pairs.filter("reason is not null").select(F.when(F.col("question_id").isNotNull(), "question").otherwise("answer").alias("entity"), F.coalesce("question_id", "answer_id").alias("entity_id"), F.lit("question_id").alias("field"), F.col("reason").alias("issue"), F.lit("info").alias("severity"), F.lit("code").alias("source"))
    found = named(q, "question").union(named(a, "answer")).union(conflict.select(same)).union(mismatch.select(same)).union(unmatched.select(same))
    found = found.union(audit.null_reports(q, "question").select(same)).union(audit.null_reports(a, "answer").select(same))
    found = materialise(found, "reports")
    return {
        "pairs": filled, "labels": labels, "reports": audit.stamped(found, run_id, ["issue", "field"]), "counters": audit.counters(found),
        "question_status": audit.finalise(q, found, "question"), "answer_status": audit.finalise(a, found, "answer"),
    }
