"""The registered queries of the store: writes by key range, parked writes, console writes, search, consolidation, chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import chunks, consolidation, console, replay, writes
from lectern.plans.registry import query
from lectern.session import scratch_path
from lectern.sources import grams, tables
from lectern.sources.store import Store

#: Rows of one file in these queries, so that small tables have several files too.
_ROWS = 20_000


def _store(spark, **held) -> Store:
    store = Store(spark, scratch_path(spark, "store"), _ROWS)
    txn = store.begin()
    for name, df in held.items():
        txn.put(name, df, "id")
    txn.publish()
    return store


@query("""select coalesce(q.id, d.id) as id, coalesce(d.question_text, q.question_text) as question_text,
  case when q.review_status in ('approved', 'rejected') or d.id is null then q.review_status else d.review_status end as review_status, coalesce(q.created_at, d.created_at) as created_at
  from q full join (
    select id, question_text || ' v2' as question_text, 'pending' as review_status, created_at from q where id % 97 = 0
    union all select -id, question_text, 'pending', created_at from q where id % 970 = 0 and id > 0) d on q.id = d.id""")
def ranged_upsert(spark, sf_dir):
    """Few questions written again and a few new ones: only files whose key ranges they are in are rewritten."""
    q = tables.questions(spark, sf_dir).select("id", "question_text", "review_status", "created_at")
    delta = q.filter("id % 97 = 0").select("id", F.concat("question_text", F.lit(" v2")).alias("question_text"), F.lit("pending").alias("review_status"), "created_at")
    new = q.filter("id % 970 = 0 and id > 0").select((-F.col("id")).alias("id"), "question_text", F.lit("pending").alias("review_status"), "created_at")
    store = _store(spark, questions=q)
    txn = store.begin()
    txn.merge("questions", delta.union(new), writes.upsert_questions)
    txn.publish()
    return store.read("questions")


@query("""select id, file_name || case when id % 4 = 0 then ' 2' when id % 2 = 0 then ' 1' else '' end as file_name, (case when id % 2 = 0 then 1 else 0 end + case when id % 4 = 0 then 1 else 0 end)::int as times from s""")
def replayed_batches(spark, sf_dir):
    """Two parked batches of a stream written in order, each step once, though the first attempt dies between them."""
    s = tables.sources(spark, sf_dir).select("id", "file_name", F.lit(0).alias("times"))
    store, parked = _store(spark, sources=s), replay.Parked(spark, scratch_path(spark, "parked"))
    for k in (1, 2):
        parked.park("sources", [("write", s.filter(F.col("id") % (2 * k) == 0).select("id", F.concat("file_name", F.lit(f" {k}")).alias("file_name"), F.lit(1).alias("times")))])
    counted = {"times": lambda old, new, *_: F.coalesce(old, F.lit(0)) + F.coalesce(new, F.lit(0))}
    tries = []

    def write(txn, rows):
        tries.append(1)
        if len(tries) == 2:
            raise OSError("down")
        return txn.merge("sources", rows, lambda old, new: writes.merge(old, new, "id", counted))

    replay.replay(store, parked, {"write": write}, attempts=1)
    replay.replay(store, parked, {"write": write}, attempts=1)
    return store.read("sources")


@query("""select id, case when subject is null and id % 3 = 0 then 'unnamed ' || grade else file_name end as file_name, case when subject is null and id % 3 = 0 then grade + 1 else grade end as grade, subject
  from s where not (grade = 7 and id % 2 = 0)""")
def console_updates(spark, sf_dir):
    """An UPDATE and a DELETE of the console, written to the store."""
    s = tables.sources(spark, sf_dir).select("id", "file_name", "grade", "subject")
    store = _store(spark, sources=s)
    for statement in ("DELETE FROM sources WHERE grade = 7 AND id % 2 = 0", "UPDATE sources SET file_name = 'unnamed ' || grade, grade = grade + 1 WHERE subject IS NULL AND id % 3 = 0"):
        if error := console.run_sql(spark, statement, store=store)["error"]:
            raise RuntimeError(error)
    return store.read("sources")


@query("select id, rel_path from s where file_name ilike '%build%er#%17%' or rel_path ilike '%build%er#%17%' or status ilike '%build%er#%17%'")
def console_search(spark, sf_dir):
    """Rows that hold a text in any column, found by postings of three-letter strings."""
    s = tables.sources(spark, sf_dir).select("id", "file_name", "rel_path", "status")
    store = _store(spark, sources=s)
    grams.update_index(store, "sources", skip=("id",))
    return grams.search(store, "sources", "build%er#%17", skip=("id",)).rows.select("id", "rel_path")


_LEGACY = """with l as (
  select id, case when id % 2 = 0 then 'L' end as corp, '1' as year from q where id % 5 <> 0 union all select -id, 'L', '1' from q where id % 50 = 0 and id > 0),
"""


def _legacy(q):
    some = q.filter("id % 5 <> 0").select("id", F.when(F.col("id") % 2 == 0, "L").alias("corp"), F.lit("1").alias("year"))
    return some.union(q.filter("id % 50 = 0 and id > 0").select((-F.col("id")).alias("id"), F.lit("L"), F.lit("1")))


@query(_LEGACY + """b as (select q.id, q.corp, q.year, l.id is not null as had, l.corp as lc, l.year as ly from q left join l on q.id = l.id)
select 'rows_lost' as check, 0::bigint as n union all select 'rows_added', 0 union all select 'legacy_rows_without_a_row', (select count(*) from l where id not in (select id from q))
union all select 'lost_corp', (select count(*) from b where corp is not null and id % 3 = 0 and corp <> 'L') union all select 'left_corp', (select count(*) from b where corp is null and lc is not null and id % 3 = 1)
union all select 'lost_year', 0 union all select 'left_year', (select count(*) from b where year is null and ly is not null and id % 3 = 1)""")
def consolidation_parity(spark, sf_dir):
    """Parity checks find what a bad consolidation lost and left behind."""
    q = tables.questions(spark, sf_dir).select("id", "corp", "year")
    legacy = _legacy(q)
    full = writes.merge(q, legacy.join(q, "id", "left_semi"), "id", {c: lambda old, new, *_: F.coalesce(old, new) for c in ("corp", "year")})
    # A run that overwrites corp in a third of the rows and skips another third.
    third = F.col("id") % 3
    bad = full.alias("f").join(q.alias("q"), "id").select("id", F.when(third == 0, F.lit("L")).when(third == 1, F.col("q.corp")).otherwise(F.col("f.corp")).alias("corp"), F.when(third == 1, F.col("q.year")).otherwise(F.col("f.year")).alias("year"))
    return consolidation.parity(q, bad, legacy, "id", ["corp", "year"])


@query("""with l as (select id, case when id % 2 = 0 then 'L' end as corp, '1' as year from q where id % 5 <> 0)
select q.id, coalesce(q.corp, l.corp) as corp, coalesce(q.year, l.year) as year from q left join l on q.id = l.id""")
def consolidated_store(spark, sf_dir):
    """Two tables become one in a single version: nulls filled, every check held, a column and the legacy table dropped."""
    q = tables.questions(spark, sf_dir).select("id", "corp", "year", F.lit("old").alias("legacy_note"))
    store = _store(spark, questions=q, legacy=_legacy(q).join(q, "id", "left_semi"))
    out = consolidation.consolidate(store, "questions", "legacy", ["corp", "year"], ["legacy_note"], complete_backup=True, apply=True)
    if not out.holds:
        raise RuntimeError(f"checks fail: {out.checks}")
    return store.read("questions")


@query("""with recursive r as (
  select id, subject, length(question_text) + id % 83 as size, row_number() over (partition by subject order by id) as i from q),
w as (
  select subject, id, i, 0::bigint as chunk, 1 as rows, size from r where i = 1
  union all
  select r.subject, r.id, r.i, case when w.rows >= 8 or w.size + r.size > 320 then w.chunk + 1 else w.chunk end, case when w.rows >= 8 or w.size + r.size > 320 then 1 else w.rows + 1 end,
    case when w.rows >= 8 or w.size + r.size > 320 then r.size else w.size + r.size end
  from w join r on r.subject = w.subject and r.i = w.i + 1)
select id, chunk from w""")
def audit_chunks(spark, sf_dir):
    """The questions of each subject in order, in chunks of at most eight under a budget of characters."""
    q = tables.questions(spark, sf_dir).select("id", "subject", (F.length("question_text") + F.col("id") % 83).alias("size"))
    return chunks.chunked(q, "subject", "id", size="size", most_rows=8, most_size=320).select("id", "chunk")
