"""The registered queries of the keyed writes: each returns the table after one write to the bank."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions.text import fold
from lectern.operators import writes
from lectern.plans.registry import query
from lectern.sources import tables


def _changed(q):
    """A delta for the bank's questions: every third row changed, and each with an id over 0 again as a new row below 0."""
    some = q.filter("id % 3 = 0").select("id", "source_id", F.concat("question_text", F.lit(" v2")).alias("question_text"), F.when(F.col("id") % 2 == 0, F.col("corp")).alias("corp"), F.lit("pending").alias("review_status"), F.col("created_at"))
    return some.union(some.withColumn("id", -F.col("id")).filter("id % 6 = 0"))


_DELTA = """with d0 as (select id, source_id, question_text || ' v2' as question_text, case when id % 2 = 0 then corp end as corp, 'pending' as review_status, created_at from q where id % 3 = 0),
d as (select * from d0 union all select -id, source_id, question_text, corp, review_status, created_at from d0 where id % 6 = 0)
"""


@query("""select id, file_name || case when id % 2 = 0 then ' v2' else '' end as file_name, case when id % 2 = 0 then '' else rel_path end as folder_id, created_at from s""")
def upsert_sources(spark, sf_dir):
    """Half of the sources written again, without folders (M1)."""
    s = tables.sources(spark, sf_dir).select("id", "file_name", F.col("rel_path").alias("folder_id"), "created_at")
    delta = s.filter("id % 2 = 0").select("id", F.concat("file_name", F.lit(" v2")).alias("file_name"), F.lit(None).cast("string").alias("folder_id"), F.lit("2000-01-01").cast("timestamp_ntz").alias("created_at"))
    return writes.upsert_sources(s, delta)


@query(_DELTA + """select coalesce(q.id, d.id) as id, coalesce(d.question_text, q.question_text) as question_text, case when d.id is null then q.corp else d.corp end as corp,
  case when q.review_status in ('approved', 'rejected') or d.id is null then q.review_status else d.review_status end as review_status, q.difficulty, coalesce(q.created_at, d.created_at) as created_at
  from q full join d on q.id = d.id""")
def upsert_questions(spark, sf_dir):
    """Questions written again: settled states and unlisted columns stay (M2, F16)."""
    q = tables.questions(spark, sf_dir)
    out = writes.upsert_questions(q, _changed(q))
    return out.select("id", "question_text", "corp", "review_status", "difficulty", "created_at")


@query("""select id, case when id % 4 = 0 then coalesce(case when id % 8 = 0 then id + 1 end, question_id) else question_id end as question_id,
  case when id % 4 = 0 and review_status <> 'approved' then 'unlinked' else review_status end as review_status from a""")
def upsert_answers(spark, sf_dir):
    """Answers written again: a link is never lost (M3)."""
    a = tables.answers(spark, sf_dir)
    delta = a.filter("id % 4 = 0").select("id", F.when(F.col("id") % 8 == 0, F.col("id") + 1).alias("question_id"), F.lit("unlinked").alias("review_status"))
    return writes.upsert_answers(a, delta).select("id", "question_id", "review_status")


@query("""select id, coalesce(case when id % 3 = 0 then 'again' end, file_name) as file_name, case when id % 2 = 0 and status not in ('edited', 'ready', 'imported', 'skipped') then 'empty' else status end as status,
  case when id % 2 = 0 then null else subject end as file_fault from s""")
def upsert_staged_sources(spark, sf_dir):
    """Staged sources written again with nulls (M4)."""
    s = tables.sources(spark, sf_dir).select("id", "file_name", "status", F.col("subject").alias("file_fault"))
    delta = s.filter("id % 2 = 0 or id % 3 = 0").select("id", F.when(F.col("id") % 3 == 0, "again").alias("file_name"), F.when(F.col("id") % 2 == 0, "empty").otherwise(F.col("status")).alias("status"), F.when(F.col("id") % 2 != 0, F.col("file_fault")).alias("file_fault"))
    return writes.upsert_staged_sources(s, delta)


@query("""select id, case when id % 2 = 0 and status not in ('edited', 'ready', 'imported', 'skipped') then 'new' else file_name end as file_name, status,
  id % 2 = 0 and status in ('edited', 'ready', 'imported', 'skipped') as refused from s""")
def upsert_staged_records(spark, sf_dir):
    """Staged records written again: protected ones refuse (M5, T4)."""
    s = tables.sources(spark, sf_dir).select("id", "file_name", "status")
    out, refused = writes.upsert_staged_records(s, s.filter("id % 2 = 0").withColumn("file_name", F.lit("new")))
    return out.join(refused.withColumn("refused", F.lit(True)), "id", "left").select("id", "file_name", "status", F.coalesce("refused", F.lit(False)).alias("refused"))


@query("""select id, case when id % 3 = 0 and status <> 'imported' then 'checked' else file_name end as file_name, grade, case when id % 3 = 0 and status not in ('imported', 'ready') then 'edited' else status end as status from s""")
def edited_records(spark, sf_dir):
    """Human edits of a listed column; grade is not in the list (M6)."""
    s = tables.sources(spark, sf_dir).select("id", "file_name", "grade", "status")
    return writes.edit_records(s, s.filter("id % 3 = 0").select("id", F.lit("checked").alias("file_name"), F.lit(-1).alias("grade")), ["file_name"])


@query("select id, case when id % 5 = 2 then 'skipped' else status end as status from s")
def set_record_status(spark, sf_dir):
    """An allowed status set for some records (M7)."""
    s = tables.sources(spark, sf_dir).select("id", "status")
    return writes.set_status(s, s.filter("id % 5 = 2"), "skipped", writes.RECORD_STATES)


@query("""select 'question' as entity, id, case when id % 10 = 0 then 'rejected' else review_status end as review_status from q
  union all select 'answer', id, case when id % 10 = 5 then 'rejected' else review_status end from a""")
def set_review_status(spark, sf_dir):
    """A review status set in both tables (M8)."""
    q, a = tables.questions(spark, sf_dir), tables.answers(spark, sf_dir)
    ids = q.filter("id % 10 = 0").select(F.lit("question").alias("entity"), "id").union(a.filter("id % 10 = 5").select(F.lit("answer"), "id"))
    out = writes.set_review_status(q, a, ids, "rejected")
    return out[0].select(F.lit("question").alias("entity"), "id", "review_status").union(out[1].select(F.lit("answer"), "id", "review_status"))


@query("""select id, case when id % 2 = 0 then 'revised text' else question_text end as question_text, case when id % 2 = 0 and coalesce(revision_status, '') <> 'approved' then 'needs_human' else revision_status end as revision_status,
  case when id % 2 = 0 and coalesce(revision_status, '') <> 'approved' then true else needs_review end as needs_review from q""")
def revision_updates(spark, sf_dir):
    """Revised content with frozen status columns (M9)."""
    q = tables.questions(spark, sf_dir).select("id", "question_text", "revision_status", "needs_review")
    delta = q.filter("id % 2 = 0").select("id", F.lit("revised text").alias("question_text"), F.lit("needs_human").alias("revision_status"), F.lit(True).alias("needs_review"))
    return writes.apply_revision(q, delta.union(delta.filter("id > 0").withColumn("id", -F.col("id"))), ["revision_status", "needs_review"])


@query("select id, case when id % 9 = 0 then 'approved' else revision_status end as revision_status, case when id % 9 = 0 then false else needs_review end as needs_review from q")
def resolved(spark, sf_dir):
    """Rows approved."""
    q = tables.questions(spark, sf_dir).select("id", "revision_status", "needs_review")
    return writes.resolve(q, q.filter("id % 9 = 0"), approve=True)


@query("select id, case when id % 2 = 0 then 7.0 when id % 3 <> 0 then id % 3 end::double as y0, 1 as n from s")
def media_boxes(spark, sf_dir):
    """One box set for every second source, then all zero boxes cleared."""
    s = tables.sources(spark, sf_dir).select("id", "created_at").withColumn("media", F.expr("array(named_struct('object', 'page', 'bbox', array(cast(id % 3 as double), 0d, 0d, 0d), 'page', 1))"))
    edits = s.filter("id % 2 = 0").select("id", F.lit(0).alias("index"), F.expr("array(7d, 0d, 0d, 0d)").alias("box"))
    out = writes.clear_zero_boxes(writes.set_media_box(s, edits), 1 << 30)
    return out.select("id", F.expr("media[0].bbox[0]").alias("y0"), F.size("media").alias("n"))


@query("""select id, case when id = 7 then 'renamed' else file_name end as file_name, grade from s where id <> 8 union all select 0, 'new', null""")
def console_writes(spark, sf_dir):
    """One cell set, one row inserted, one deleted."""
    s = tables.sources(spark, sf_dir).select("id", "file_name", "grade")
    out = writes.insert_row(writes.set_cell(s, "id", 7, "file_name", "renamed"), {"id": 0, "file_name": "new", "grade": "", "created_at": "x"})
    return writes.delete_rows(out, out.filter("id = 8"))[0]


@query("""with b as (select c_mktsegment as name, min(id) as id from (select c_custkey as id, c_mktsegment from customer) x group by 1) select id, name from b union all select 0, 'fresh'""", views=True)
def created_batches(spark, sf_dir):
    """Batches created twice."""
    s = tables.sources(spark, sf_dir)
    named = s.select("id", F.split("rel_path", "/")[0].alias("name"))
    base = named.groupBy("name").agg(F.min("id").alias("id")).select("id", "name")
    return writes.create_batches(base, named.union(spark.sql("select 0L, 'fresh' union all select 0L, 'fresh'").distinct()), ["name"])


_BATCH = """with b as (select q.id, q.source_id % 50 as batch_id, q.id % 7 <> 0 as asset_ok, s.id as live from q left join (select id from s where id % 4 <> 0) s on s.id = q.source_id where q.review_status = 'pending')
"""


def _batch(spark, sf_dir):
    q = tables.questions(spark, sf_dir).filter("review_status = 'pending'")
    batch = q.select((F.col("source_id") % 50).alias("batch_id"), "id", F.lit("question").alias("kind"), "source_id", F.lit("ready").alias("status"), (F.col("id") % 7 != 0).alias("asset_ok"))
    return writes.import_ready(batch, tables.sources(spark, sf_dir).filter("id % 4 <> 0"))


@query(_BATCH + "select batch_id, id, 'question' as kind, case when live is null or not asset_ok then 'failed' else 'imported' end as outcome, case when live is null then 'no source' when not asset_ok then 'asset failed' end as fault from b")
def imported_rows(spark, sf_dir):
    """The outcome of each ready row."""
    return _batch(spark, sf_dir)[0]


@query(_BATCH + """select batch_id, count(*) filter (live is not null and asset_ok) as imported, count(*) filter (live is null or not asset_ok) as failed,
  case when count(*) filter (live is null or not asset_ok) > 0 then 'failed' else 'imported' end as status from b group by batch_id""")
def imported_batches(spark, sf_dir):
    """The outcome of each batch."""
    return _batch(spark, sf_dir)[1]


@query("select id, grade, case when status = 'ready' then 'approved' else 'pending' end as review_status from s")
def live_projection(spark, sf_dir):
    """Staged rows as live rows."""
    return writes.project_ready(tables.sources(spark, sf_dir).withColumn("grade", F.col("grade").cast("string"))).select("id", "grade", "review_status")


@query("select id, case when grade = 3 and status = 'staged' then 'ready' else status end as status from s")
def ready_all(spark, sf_dir):
    """All staged rows of one source made ready."""
    return writes.ready_all(tables.sources(spark, sf_dir).withColumn("source_id", F.col("grade")), 3).select("id", "status")


@query("select id, id % 3 as before, id % 5 as after, false as written from s where status <> 'imported' and id % 5 > id % 3")
def reparsed_options(spark, sf_dir):
    """The dry run of a second parse."""
    s = tables.sources(spark, sf_dir).select("id", "status", F.expr("array_repeat('x', cast(id % 3 as int))").alias("options"))
    return writes.reparse(s, s.select("id", F.expr("array_repeat('y', cast(id % 5 as int))").alias("options")), apply=False)


@query("select id as seq, (id % 4) + 1 as attempts, case when id % 6 <> 0 then 'written' when id % 4 + 1 >= 3 then 'given up' else 'parked' end as outcome from a")
def replayed_writes(spark, sf_dir):
    """Parked writes tried again."""
    a = tables.answers(spark, sf_dir).select(F.col("id").alias("seq"), F.concat(F.lit("op"), F.col("id") % 6).alias("op"), (F.col("id") % 4).alias("attempts"))
    return writes.replay(a, a.filter("seq % 6 = 0"), 3).select("seq", "attempts", "outcome")


@query("select id, coalesce(corp, 'L') as corp, coalesce(year, '1') as year, null::varchar as extra from q")
def consolidated(spark, sf_dir):
    """Nulls filled from a legacy table, and a column added."""
    q = tables.questions(spark, sf_dir).select("id", "corp", "year")
    return writes.with_columns_of(writes.consolidate(q, q.select("id", F.lit("L").alias("corp"), F.lit("1").alias("year")), ["corp", "year"], complete_backup=True, apply=True)[0], {"extra": "string", "corp": "string"})


@query("select p_brand as tag, case when p_brand = 'Brand#11' then ['Brand#11', 'B 11'] else [p_brand] end as variants from (select distinct p_brand from part) x")
def accepted_alias(spark, sf_dir):
    """A variant appended to its tag."""
    from lectern.session import table

    vocabulary = table(spark, sf_dir, "part").select(F.col("p_brand").alias("tag")).distinct().withColumn("variants", F.array("tag"))
    return writes.accept_alias(vocabulary, "B 11", "Brand#11", fold)
