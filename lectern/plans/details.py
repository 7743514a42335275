"""Registered queries of smaller operators, with inputs made of the tables' own values."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import boxes, faults, options, rows
from lectern.operators import audit, imports, reports, staging, stats, writes
from lectern.plans.registry import query
from lectern.session import scratch_path
from lectern.sources import tables
from lectern.sources.store import Store


@query("select id, file_name, subject, created_at, (select count(*) from q where q.source_id = x.id) as questions from (select * from s order by created_at desc nulls last, id desc limit 20) x")
def uploads_with_counts(spark, sf_dir):
    """The newest uploads with their question counts."""
    return stats.uploads_with_counts(tables.sources(spark, sf_dir), tables.questions(spark, sf_dir))


@query("select subject, count(*) as total, count(*) filter (review_status = 'approved') as approved, count(*) filter (needs_review) as needs_review from q group by subject")
def subject_totals(spark, sf_dir):
    """Questions by subject and status."""
    return stats.subject_totals(tables.questions(spark, sf_dir))


_FLAGS = """with r as (
  select 'question' as entity, id as entity_id, case id % 6 when 0 then 'corp' when 1 then 'question_id' when 2 then 'year' when 3 then 'year' when 4 then 'options' else 'question_id' end as field,
    case id % 6 when 0 then 'null_required_column' when 1 then 'linked to matched question' when 2 then 'repaired' when 3 then 'qa_field_conflict' when 4 then 'looks odd' else 'qa_unmatched_answer' end as issue,
    case id % 6 when 0 then 'error' when 3 then 'warn' when 5 then 'warn' else 'info' end as severity, case when id % 6 = 4 then 'ai' else 'code' end as source
  from q)
"""


def _flags(spark, sf_dir):
    pick = lambda *values: F.element_at(F.array(*map(F.lit, values)), (F.col("id") % 6 + 1).cast("int"))
    return tables.questions(spark, sf_dir).select(
        F.lit("question").alias("entity"), F.col("id").alias("entity_id"), pick("corp", "question_id", "year", "year", "options", "question_id").alias("field"),
        pick("null_required_column", audit.LINKED, "repaired", audit.CONFLICT_ISSUES[0], "looks odd", "qa_unmatched_answer").alias("issue"),
        pick("error", "info", "info", "warn", "info", "warn").alias("severity"), pick("code", "code", "code", "code", "ai", "code").alias("source"),
    )


@query(_FLAGS + """select case when issue = 'null_required_column' then 'null_reports' when source = 'ai' then 'ai_flags' when field = 'question_id' and issue = 'linked to matched question' then 'links'
  when source = 'code' and severity = 'info' and field <> 'question_id' then 'backfills' when issue = 'qa_field_conflict' then 'conflicts' else 'other' end as counter, count(*) as n from r group by 1""")
def revision_classes(spark, sf_dir):
    """Reports under each of the six classes."""
    return audit.counters(_flags(spark, sf_dir))


@query(_FLAGS + "select 'run:question:' || entity_id || ':r0' as report_id, entity_id, case when entity_id % 2 = 0 then 'seen' else issue end as issue from r where entity_id % 3 = 0")
def stored_reports(spark, sf_dir):
    """Reports stored, some written again, and fetched for a third of the rows."""
    store = Store(spark, scratch_path(spark, "store"), 20_000)
    found = audit.stamped(_flags(spark, sf_dir), "run", ["field"])
    reports.insert(store, found)
    reports.insert(store, found.filter("entity_id % 2 = 0").withColumn("issue", F.lit("seen")))
    ids = tables.questions(spark, sf_dir).filter("id % 3 = 0").select("id")
    return reports.fetch(store, "question", ids).select("report_id", "entity_id", "issue")


_STAGED = """with b as (
  select q.id, q.source_id % 50 as batch_id, q.source_id, q.question_text, q.grade, q.id % 7 <> 0 as has_asset, s.id is not null as has_source
  from q left join (select id from s where id % 4 <> 0) s on s.id = q.source_id where q.review_status = 'pending')
"""


def _imported(spark, sf_dir):
    q, s = tables.questions(spark, sf_dir), tables.sources(spark, sf_dir)
    store = Store(spark, scratch_path(spark, "store"), 20_000)
    txn = store.begin()
    txn.put("sources", s.filter("id % 4 <> 0").select("id", "file_name"), "id")
    txn.put("questions", q.filter("review_status <> 'pending'").select("id", "source_id", "question_text", "grade", "review_status", "created_at"), "id")
    staged = q.filter("review_status = 'pending'").select("id", (F.col("source_id") % 50).alias("batch_id"), "source_id", "question_text", F.col("grade").cast("string").alias("grade"), F.lit("ready").alias("status"), F.lit(None).cast("string").alias("fault"))
    txn.put("staged", staged, "id")
    txn.publish()
    return store, imports.import_batches(store, q.filter("id % 7 <> 0").select("id"))


@query(_STAGED + """select id, source_id, question_text, grade, review_status from q where review_status <> 'pending' union all
  select id, source_id, question_text, grade, 'approved' from b where has_asset and has_source""")
def imported_questions(spark, sf_dir):
    """The live table after an import of all ready rows."""
    store, _ = _imported(spark, sf_dir)
    return store.read("questions").select("id", "source_id", "question_text", F.col("grade").cast("int").alias("grade"), "review_status")


@query(_STAGED + "select id, case when has_asset and has_source then 'imported' else 'failed' end as status, case when not has_source then 'no source' when not has_asset then 'no picture' end as fault from b")
def imported_outcomes(spark, sf_dir):
    """What the import left of each staged row."""
    store, _ = _imported(spark, sf_dir)
    return store.read("staged").select("id", "status", "fault")


@query("""with z as (select id, created_at, row_number() over (order by created_at desc nulls last, id desc) as place from s where id % 3 = 0)
select s.id, case when z.place <= 40 then null when s.id % 3 = 0 then 0.0 else s.id % 3 end::double as y0 from s left join z using (id)""")
def newest_boxes_cleared(spark, sf_dir):
    """Zero boxes cleared in the newest rows alone."""
    s = tables.sources(spark, sf_dir).select("id", "created_at").withColumn("media", F.expr("array(named_struct('object', 'page', 'bbox', array(cast(id % 3 as double), 0d, 0d, 0d), 'page', 1))"))
    return writes.clear_zero_boxes(s, 40).select("id", F.expr("media[0].bbox[0]").alias("y0"))


@query("select id, case when status <> 'imported' and id % 5 > id % 3 then id % 5 else id % 3 end as n, case when status <> 'imported' and id % 5 > id % 3 then file_name end as first from s")
def reparsed_applied(spark, sf_dir):
    """A second parse applied where it finds more."""
    s = tables.sources(spark, sf_dir).select("id", "status", "file_name", F.expr("array_repeat(cast(null as string), cast(id % 3 as int))").alias("options"))
    found = writes.reparse(s, s.select("id", F.expr("array_repeat(file_name, cast(id % 5 as int))").alias("options")), apply=True)
    return found.select("id", F.size("options").cast("long").alias("n"), F.get("options", F.lit(0)).alias("first"))


@query("""select id, case when least(b0, b1, b2, b3) < 0 or greatest(b0, b1, b2, b3) > 1000 then 'range' when b2 <= b0 or b3 <= b1 then 'order' end as fault
  from (select id, file_size % 1200 as b0, grade * 40 as b1, (id * 7) % 1003 as b2, (id * 13) % 1001 as b3 from s) x""")
def strict_boxes(spark, sf_dir):
    """Boxes made of a source's numbers, judged without repair."""
    s, key = tables.sources(spark, sf_dir), F.col("id")
    box = F.array(*[x.cast("double") for x in (F.col("file_size") % 1200, F.col("grade") * 40, (key * 7) % 1003, (key * 13) % 1001)])
    return s.select("id", boxes.strict_box_fault(box).alias("fault"))


@query("""select id, step from (select id, power(10.0, floor(log10(raw))) as p, raw from (select id, (abs(file_size) + 1) / 5.0 as raw from s) x) y,
  lateral (select p * case when raw / p <= 1 then 1.0 when raw / p <= 2 then 2.0 when raw / p <= 2.5 then 2.5 when raw / p <= 5 then 5.0 else 10.0 end as step)""")
def axis_steps(spark, sf_dir):
    """Round steps for an axis up to each source's size."""
    return tables.sources(spark, sf_dir).select("id", rows.axis_step((F.abs("file_size") + 1).cast("double")).alias("step"))


@query("""select id, case when code = 429 then 'rate_limit' when storage then case when code in (401, 403, 404, 500, 503) then 'storage_fail' else 'storage_fail' end
  when code in (401, 403) then 'bad_key' when code = 404 then 'model_unavailable' when code in (500, 503) then 'overload' else 'unknown' end as kind
  from (select event_id as id, [401, 403, 404, 418, 429, 500, 503][(user_id % 7 + 1)::int] as code, event_type in ('click', 'purchase') as storage from events) x""", views=False)
def fault_kinds_of_events(spark, sf_dir):
    """Kinds of failures whose messages are put together from an event's user and type."""
    from lectern.session import table

    e = table(spark, sf_dir, "events")
    code = F.element_at(F.array(*[F.lit(x) for x in (401, 403, 404, 418, 429, 500, 503)]), (F.col("user_id") % 7 + 1).cast("int"))
    vendor = F.when(F.col("event_type").isin("click", "purchase"), "supabase storage").otherwise("gemini")
    return e.select(F.col("event_id").alias("id"), faults.classify(F.concat(vendor, F.lit(" HTTP "), code.cast("string"), F.lit(": "), F.col("event_type"))).alias("kind"))


@query("""select id, case when id % 5 < 4 then [subject, topic, question_text, coalesce(corp, 'none')][(id % 5 + 1)::int] end as by_label, list_position([subject, topic, question_text, coalesce(corp, 'none')], subject)::varchar as own_label
  from q""")
def options_of_rows(spark, sf_dir):
    """Options printed from a question's own values, read back and looked up by label in several scripts."""
    q, key = tables.questions(spark, sf_dir), F.col("id")
    printed = F.to_json(F.array(F.concat(F.lit("1) "), "subject"), F.concat(F.lit("۲. "), "topic"), F.concat(F.lit("3: "), "question_text"), F.concat(F.lit("د) "), F.coalesce("corp", F.lit("none")))))
    listed = options.normalize_options(printed)
    label = F.element_at(F.array(*[F.lit(x) for x in ("(1)", "۲", "ج", "4", "zz")]), (key % 5 + 1).cast("int"))
    return q.select("id", options.option_text(listed, label).alias("by_label"), options.label_of_text(listed, F.col("subject")).alias("own_label"))


@query("""select q.source_id || '-q' || (q.id + 1) as id, q.source_id::varchar as source_id, (q.id + 1)::double as question_number, q.question_text, q.corp, 'folder ' || (q.source_id % 3) as subject,
  case when q.n_media > 1 then 'u' || q.source_id end as diagram_url, case when q.n_media > 1 then 2 else 0 end as n_options from q""")
def legacy_questions(spark, sf_dir):
    """Question rows in their first form, from replies made of the questions of each source."""
    q = tables.questions(spark, sf_dir)
    box = F.when(F.col("n_media") > 1, "[10, 20, 300, 400]").otherwise("[0, 0, 0, 0]")
    listed = F.when(F.col("n_media") > 1, '["1) a", "2) b"]')
    entry = F.struct((F.col("id") + 1).cast("string").alias("question_number"), "question_text", F.lit("said").alias("subject"), "corp", box.alias("diagram_bbox"), listed.alias("options"))
    replies = q.groupBy(F.col("source_id").cast("string").alias("source_id")).agg(F.to_json(F.struct(F.collect_list(entry).alias("questions"))).alias("reply"))
    place = F.col("source_id").cast("long")
    replies = replies.select("source_id", F.concat(F.lit("folder "), (place % 3).cast("string")).alias("subject"), F.lit("t").alias("topic"), F.lit(10).alias("grade"), "reply", F.concat(F.lit("u"), "source_id").alias("url"))
    found = staging.legacy_questions(replies)
    return found.select("id", "source_id", "question_number", "question_text", "corp", "subject", "diagram_url", F.size(F.from_json("options", "array<struct<label:string,text:string>>")).alias("n_options"))
