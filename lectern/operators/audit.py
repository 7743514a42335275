"""The revision audit: completeness, polish, derived labels, verdicts and the status they lead to."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import maths, options, rows, text

# The texts of the two reports that count as conflicts, and of the link report.
CONFLICT_ISSUES = ["qa_field_conflict", "qa_label_mismatch: explanation reviews the stored option"]
LINKED = "linked to matched question"


def null_reports(df: DataFrame, entity: str) -> DataFrame:
    """(entity, entity_id, field, issue, severity, source): one error for each required column that a row lacks."""
    missing = df.select(F.lit(entity).alias("entity"), F.col("id").alias("entity_id"), F.explode(rows.missing_columns(entity, df.columns)).alias("field"))
    return missing.select("*", F.lit("null_required_column").alias("issue"), F.lit("error").alias("severity"), F.lit("code").alias("source"))


def polish_numbers(df: DataFrame) -> DataFrame:
    """question_number and grade as numbers where they spell one; the year in 0-9."""
    number = lambda c: F.coalesce(text.parse_number(F.col(c)).cast("string"), F.col(c).cast("string"))
    return df.withColumns({"question_number": number("question_number"), "grade": number("grade"), "year": text.latin_digits(F.col("year"))})


def healed(c: Column) -> Column:
    """Single blanks, TeX in delimiters, digits by kind of text; null and empty stay."""
    return F.when(c.isNull() | (c == ""), c).otherwise(maths.digit_policy(maths.sanitize_math(text.norm_text(c))))


def polish(df: DataFrame, texts: list[str], tags: list[str] = ["subject", "topic", "difficulty", "corp"]) -> DataFrame:
    """`df` with texts healed and tags rebuilt, and repairs: array<struct<field, before, after>> of what changed.

    Columns of `texts` and 'options' (JSON, if present) are healed; 'correct_option_label' gets digits 0-9 and is
    filled from 'correct_option_text' by the options, or the text from the label.
    """
    before = {c: F.col(f"old.{c}") for c in df.columns}
    out = df.withColumn("old", F.struct(*df.columns)).withColumns({c: healed(F.col(c)) for c in texts if c in df.columns})
    if "year" in df.columns:
        out = out.withColumn("year", text.latin_digits(F.col("year").cast("string")))
    if "options" in df.columns:
        out = out.withColumn("options_read", options.polished_options(F.col("options")))
        out = out.withColumn("options_healed", maths.polished_list(F.transform("options_read", lambda o: text.norm_text(o["text"]))))
        out = out.withColumn("options_read", F.transform("options_read", lambda o, i: F.struct(o["label"].alias("label"), F.get("options_healed", i).alias("text")))).drop("options_healed")
        out = out.withColumn("options", F.to_json("options_read"))
        if {"correct_option_label", "correct_option_text"} <= set(df.columns):
            label, answer = F.nullif(F.trim(text.latin_digits(F.col("correct_option_label"))), F.lit("")), F.nullif(F.col("correct_option_text"), F.lit(""))
            out = out.withColumns({
                "correct_option_text": F.coalesce(answer, F.when(label.isNotNull(), options.text_of_label(F.col("options_read"), label))),
                "correct_option_label": F.coalesce(label, F.when(answer.isNotNull(), options.label_of_text(F.col("options_read"), answer))),
            })
        out = out.drop("options_read")
    present = [c for c in tags if c in df.columns]
    out = out.withColumn("tags", F.to_json(rows.tags(*present)))
    watched = [c for c in out.columns if c in df.columns and c != "id"]
    return out.withColumn("repairs", rows.changed({c: (before[c], F.col(c)) for c in watched})).drop("old")


def reports(polished: DataFrame, entity: str) -> DataFrame:
    """One info report for each repair."""
    out = polished.select(F.lit(entity).alias("entity"), F.col("id").alias("entity_id"), F.explode("repairs").alias("r"))
    return out.select("entity", "entity_id", F.col("r.field").alias("field"), F.lit("repaired").alias("issue"), F.lit("info").alias("severity"), F.lit("code").alias("source"), F.col("r.before").alias("before_value"), F.col("r.after").alias("after_value"))


def needs_model(text_col: str, others: list[str], verify: Column) -> Column:
    """Why a row still needs a reader: typos for any text, digits for unbalanced delimiters, label to verify."""
    unbalanced = reduce(Column.__or__, [~maths.delimiters_balanced(F.col(c)) for c in [text_col, *others]])
    return F.array_compact(F.array(F.when(F.col(text_col) != "", F.lit("typos")), F.when(unbalanced, F.lit("digits")), F.when(verify, F.lit("label"))))


def finalise(df: DataFrame, all_reports: DataFrame, entity: str, forced: Column | None = None) -> DataFrame:
    """(id, revision_status, needs_review): needs_human with an error report, a conflict or by force, else revised."""
    bad = all_reports.filter((F.col("entity") == entity) & ((F.col("severity") == "error") | F.col("issue").isin(CONFLICT_ISSUES)))
    ids = bad.select(F.col("entity_id").alias("id")).distinct().withColumn("bad", F.lit(True))
    flagged = F.coalesce(F.col("bad"), F.lit(False)) | (F.coalesce(forced, F.lit(False)) if forced is not None else F.lit(False))
    return df.join(ids, "id", "left").select("id", F.when(flagged, "needs_human").otherwise("revised").alias("revision_status"), flagged.alias("needs_review"))


def stamped(all_reports: DataFrame, run_id: str, order: list[str]) -> DataFrame:
    """Reports with an id <run>:<entity>:<row>:r<n>, n counting a row's reports from 0 in the given order."""
    n = F.row_number().over(Window.partitionBy("entity", "entity_id").orderBy(*order)) - 1
    return all_reports.withColumn("report_id", F.concat(F.lit(f"{run_id}:"), "entity", F.lit(":"), F.col("entity_id").cast("string"), F.lit(":r"), n.cast("string")))


def counters(all_reports: DataFrame) -> DataFrame:
    """(counter, n): each report under the first class that fits it."""
    kind = (
        F.when(F.col("issue") == "null_required_column", "null_reports").when(F.col("source") == "ai", "ai_flags")
        .when((F.col("field") == "question_id") & (F.col("issue") == LINKED), "links")
        .when((F.col("source") == "code") & (F.col("severity") == "info") & (F.col("field") != "question_id"), "backfills")
        .when(F.col("issue").isin(CONFLICT_ISSUES), "conflicts").otherwise("other")
    )
    return all_reports.groupBy(kind.alias("counter")).agg(F.count("*").alias("n"))


def merge_verdicts(df: DataFrame, verdicts: DataFrame, columns: list[str]) -> DataFrame:
    """`df` with the columns that a reader's verdict (id, columns, flag) sets; rows without one stay pending.

    answered says whether a verdict came; a flag makes the row needs_human.
    """
    given = verdicts.select("id", *[F.col(c).alias(f"new_{c}") for c in columns], F.col("flag").alias("verdict_flag"), F.lit(True).alias("answered"))
    joined = df.join(given, "id", "left")
    status = F.when(F.col("answered").isNull(), "pending").when(F.col("verdict_flag"), "needs_human").otherwise("revised")
    values = [F.coalesce(F.nullif(F.col(f"new_{c}").cast("string"), F.lit("")), F.col(c).cast("string")).alias(c) if c in columns else F.col(c) for c in df.columns]
    return joined.select(*values, F.coalesce("answered", F.lit(False)).alias("answered"), status.alias("verdict_status"))


def derived_labels(df: DataFrame) -> DataFrame:
    """(id, status, derived, current) from answer_explanation, correct_option_label and options (JSON)."""
    found = options.derive_label(F.col("answer_explanation"), F.col("correct_option_label"), options.normalize_options(F.col("options"), digits=True))
    return df.select("id", found.alias("f")).select("id", "f.*")


REVISIONS = "array<struct<id:string,set:struct<correct_option_label:string>,flags:array<struct<field:string,issue:string,severity:string,suggestion:string>>,needs_review:boolean,confidence:string>>"
#: What a report on a row has, but for its id.
_REPORT = "array<struct<entity:string,entity_id:bigint,field:string,issue:string,severity:string,source:string,before_value:string,after_value:string>>"


def verdicts_of(replies: DataFrame) -> DataFrame:
    """(id, label, flags, needs_review, confidence) of the revisions in a reader's replies (seq, reply); of several on one row the last."""
    listed = F.from_json(F.get_json_object(options.first_object(F.col("reply")), "$.revisions"), REVISIONS)
    each = replies.select("seq", F.posexplode(listed).alias("place", "r")).filter("r.id is not null and r.id <> ''")
    last = each.groupBy(F.col("r.id").alias("id")).agg(F.max_by("r", F.struct("seq", "place")).alias("r"))
    return last.select("id", F.col("r.set.correct_option_label").alias("label"), "r.flags", F.coalesce("r.needs_review", F.lit(False)).alias("needs_review"), "r.confidence")


def merge_audit(pairs: DataFrame, verdicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(updates, reports) of pairs (question_id, answer_id, question_label, answer_label, options, needs_ai, verify) after verdicts.

    The label is the one field that a verdict may set, where `verify` asks for it and only to the label of one of the
    question's options; any other is reported. A row that needed a verdict and got none has no update and stays
    pending. An error flag, or a verdict that asks for it, sends both rows to a person. Updates are (entity, id,
    correct_option_label, correct_option_text, revision_status, needs_review, revision_notes), the text null where it
    stays; a pair without an answer updates its question alone.
    """
    given = verdicts.select(F.col("id").alias("verdict_id"), "label", "flags", F.col("needs_review").alias("asks"), "confidence")
    met = pairs.join(given, F.col("question_id").cast("string") == F.col("verdict_id"), "left")
    plain = lambda c: F.trim(text.latin_digits(F.coalesce(F.col(c), F.lit(""))))
    met = met.withColumns({
        "listed": options.normalize_options(F.col("options"), digits=True), "wanted": F.when(F.col("verify"), F.nullif(plain("label"), F.lit(""))), "silent": F.col("needs_ai") & F.col("verdict_id").isNull(),
        "flags": F.filter(F.coalesce("flags", F.expr("cast(array() as array<struct<field:string,issue:string,severity:string,suggestion:string>>)")), lambda f: f.isNotNull()),
    })
    met = met.withColumn("known", F.coalesce(F.exists("listed", lambda o: o["label"] == F.col("wanted")), F.lit(False))).withColumn("wanted_text", options.text_of_label(F.col("listed"), F.col("wanted")))
    met = met.withColumn("changed", F.col("known") & (F.col("wanted") != plain("question_label")))
    human = F.exists("flags", lambda f: F.coalesce(f["severity"] == "error", F.lit(False))) | F.coalesce("asks", F.lit(False))
    notes = F.to_json(F.struct(F.col("flags").alias("ai_flags"), F.col("confidence").alias("ai_confidence")))
    told = met.filter("not silent").withColumns({"human": human, "notes": notes})
    new_text, answer_label = F.when(F.col("changed"), F.col("wanted_text")), F.when(F.col("known"), F.coalesce(F.nullif("answer_label", F.lit("")), F.col("wanted"))).otherwise(F.col("answer_label"))
    state = [F.when(F.col("human"), "needs_human").otherwise("revised").alias("revision_status"), F.col("human").alias("needs_review"), F.col("notes").alias("revision_notes")]
    side = lambda entity, key, label: told.filter(F.col(key).isNotNull()).select(F.lit(entity).alias("entity"), F.col(key).alias("id"), F.when(F.col("changed"), F.col("wanted")).otherwise(label).alias("correct_option_label"), new_text.alias("correct_option_text"), *state)
    updates = side("question", "question_id", F.col("question_label")).union(side("answer", "answer_id", answer_label))

    def report(entity: str, field: Column, issue: Column, severity: Column, before: Column, after: Column) -> Column:
        key = F.col(f"{entity}_id").cast("bigint")
        return F.struct(F.lit(entity).alias("entity"), key.alias("entity_id"), field.alias("field"), issue.alias("issue"), severity.alias("severity"), F.lit("ai").alias("source"), before.alias("before_value"), after.alias("after_value"))

    none, label, warn, info = F.lit(None).cast("string"), F.lit("correct_option_label"), F.lit("warn"), F.lit("info")
    with_answer = F.col("answer_id").isNotNull()
    one = [
        (F.col("silent"), report("question", none, F.lit("ai_no_verdict"), warn, none, none)),
        (~F.col("silent") & F.col("wanted").isNotNull() & ~F.col("known"), report("question", label, F.concat(F.lit("ai suggested unknown label '"), "wanted", F.lit("'")), warn, none, none)),
    ]
    for entity, when in (("question", F.lit(True)), ("answer", with_answer)):
        old = F.substring(F.coalesce(F.col(f"{entity}_label"), F.lit("")), 1, 150)
        one.append((~F.col("silent") & F.col("changed") & when, report(entity, label, F.lit("ai corrected option label from explanation"), info, old, F.col("wanted"))))
        one.append((~F.col("silent") & F.col("changed") & when, report(entity, F.lit("correct_option_text"), F.lit("filled from options by label"), info, none, F.substring("wanted_text", 1, 150))))
    single = F.array_compact(F.array(*[F.when(c, r) for c, r in one])).cast(_REPORT)
    of_flag = lambda entity: lambda f: report(entity, f["field"], F.coalesce(F.nullif(f["issue"], F.lit("")), F.lit("unspecified")), F.when(f["severity"] == "error", "error").otherwise("warn"), none, F.substring(f["suggestion"], 1, 280))
    of_answer = F.filter("flags", lambda f: F.coalesce(f["field"].isin("answer_explanation", "correct_option_label"), F.lit(False)) & with_answer)
    flagged = F.when(~F.col("silent"), F.concat(F.transform("flags", of_flag("question")).cast(_REPORT), F.transform(of_answer, of_flag("answer")).cast(_REPORT))).otherwise(F.array().cast(_REPORT))
    return updates, met.select(F.explode(F.concat(single, flagged)).alias("r")).select("r.*")
