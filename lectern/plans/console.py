"""The registered queries of the console and its listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import console, review, stats
from lectern.plans.registry import query
from lectern.sources import tables


@query("select id, file_name, count(*) over () >= 1000 as truncated from (select id, file_name from s order by id limit 1000) x")
def console_capped(spark, sf_dir):
    """At most 1,000 rows, and whether that cut the result."""
    return console.capped(tables.sources(spark, sf_dir).select("id", "file_name"), "id")


@query("select subject, count(*) as n from q where corp is not null group by subject")
def console_select(spark, sf_dir):
    """A guarded statement."""
    bank = {"questions": tables.questions(spark, sf_dir), "answers": tables.answers(spark, sf_dir)}
    _, statement = console.guard(spark, "SELECT subject, count(*) AS n FROM questions WHERE corp IS NOT NULL GROUP BY subject;", set(bank))
    bank["questions"].createOrReplaceTempView("questions")
    return spark.sql(statement)


@query("""select 's' as "table", 'id' as "column", 1 as position, 'bigint' as type, count(id) as filled, count(*) as rows from s union all select 's', 'grade', 2, 'int', count(grade), count(*) from s
  union all select 's', 'subject', 3, 'string', count(subject), count(*) from s union all select 'q', 'id', 1, 'bigint', count(id), count(*) from q union all select 'q', 'corp', 2, 'string', count(corp), count(*) from q""")
def console_schema(spark, sf_dir):
    """Columns and types of two tables, and how many rows fill each column."""
    s = tables.sources(spark, sf_dir).select("id", F.col("grade").cast("int").alias("grade"), "subject")
    q = tables.questions(spark, sf_dir).select("id", "corp")
    return console.profile(spark, {"s": s, "q": q}, {"s": "id", "q": "id"}).select("table", "column", "position", "type", "filled", "rows")


@query("select id, file_name, status from s where id = 42")
def console_row(spark, sf_dir):
    """One row by its key."""
    return console.row_by_id(tables.sources(spark, sf_dir).select("id", "file_name", "status"), "id", 42)


@query("select id, status, file_size > 0 as has_box from s where status = 'staged' and file_size > 0")
def staged_list(spark, sf_dir):
    """Staged records with a box."""
    s = tables.sources(spark, sf_dir).select("id", F.lit(1).alias("source_id"), "status", (F.col("file_size") > 0).alias("has_box"))
    return console.staged_list(s, source=1, status="staged", has_box=True).select("id", "status", "has_box")


@query("select row_number() over (partition by grade order by id) as seq, id, grade, status from s where status not in ('imported')")
def pending_batch_rows(spark, sf_dir):
    """The rows of every batch that are still to be imported, in order."""
    return review.unfinished(tables.sources(spark, sf_dir).select("id", "grade", "status"), "grade")


@query("select id, file_name, created_at from s order by created_at desc nulls last, id desc limit 50")
def newest_sources(spark, sf_dir):
    """The newest 50 sources (L4)."""
    return review.newest(tables.sources(spark, sf_dir).select("id", "file_name", "created_at"), 50)


@query("select type, count(*) as rows, cast(sum(file_size) as bigint) as bytes from s group by type union all select 'all', count(*), cast(sum(file_size) as bigint) from s")
def snapshot_totals(spark, sf_dir):
    """Rows and bytes by kind and in all."""
    return stats.snapshot_totals(tables.sources(spark, sf_dir), "type", "file_size")


_WANTED = "select distinct subject, question_number from a where subject is not null and id % 10 = 3"


def _wanted(spark, sf_dir):
    return tables.answers(spark, sf_dir).filter("subject is not null and id % 10 = 3").select("subject", F.col("question_number").alias("number"))


@query(f"select q.id, q.question_number from q join ({_WANTED}) w on w.subject = q.subject and w.question_number::varchar = q.question_number::varchar where q.id not in (select question_id from a where question_id is not null)")
def questions_by_number(spark, sf_dir):
    """The questions that answers ask for by number as text, without those that are linked."""
    linked = tables.answers(spark, sf_dir).filter("question_id is not null").select(F.col("question_id").alias("id"))
    return review.by_numbers(tables.questions(spark, sf_dir), _wanted(spark, sf_dir), linked).select("id", "question_number")


@query(f"""select id, 'id' as origin from q where id in (select question_id from a) union all
  select q.id, 'number' from q join ({_WANTED}) w on w.subject = q.subject and w.question_number::varchar = q.question_number::varchar where q.id not in (select question_id from a where question_id is not null)""")
def context_union(spark, sf_dir):
    """Context by id, then by number without those (U4)."""
    linked = tables.answers(spark, sf_dir).filter("question_id is not null").select(F.col("question_id").alias("id"))
    return review.context(tables.questions(spark, sf_dir), linked, _wanted(spark, sf_dir)).select("id", "origin")


@query("select id, 'flagged' as view from q where needs_review union all select id, 'revised' from q where revision_status = 'revised' union all select id, 'approved' from q where revision_status = 'approved' union all select id, 'all' from q where revision_status is not null")
def revision_views(spark, sf_dir):
    """All named views of the revision (F8)."""
    return review.views(tables.questions(spark, sf_dir))
