"""All queries of the engine and their SQL counterparts, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import rows, text
from lectern.operators import audit, linking, review, stats, usage
from lectern.plans import console, details, scalars, store, windows, writes  # noqa: F401  (each registers its queries)
from lectern.plans.registry import ORACLE, QUERIES, query  # noqa: F401
from lectern.sources import tables
from lectern.session import table

#: The time of reference of the usage report.
NOW = "2024-01-31 00:00:00"


def _bank(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tables.questions(spark, sf_dir), tables.answers(spark, sf_dir), tables.sources(spark, sf_dir)


# Review listing -------------------------------------------------------------------------------------------------

_PAIRS = """with pairs as (
  select q.id as q_id, a.id as answer_id, a.review_status as answer_review_status from q join a on a.question_id = q.id
  union all select q.id, a.id, a.review_status from q join a on a.question_id is null and a.question_number = q.question_number and a.subject = q.subject and a.topic = q.topic and a.grade = q.grade)
"""
_LISTED = """q.id, source_id, question_number, question_text, subject, topic, grade::varchar as grade, corp, year, difficulty, review_status,
  strftime(created_at, '%Y-%m-%dT%H:%M:%S') as created_at, answer_id, answer_review_status"""


@query(f"{_PAIRS} select {_LISTED} from q left join pairs on q.id = q_id order by q.id desc, answer_id nulls last limit 120")
def review_rows(spark, sf_dir):
    """The newest 120 rows of the listing."""
    q, a, _ = _bank(spark, sf_dir)
    return review.review_rows(q, a)


@query(f"{_PAIRS} select {_LISTED} from q left join pairs on q.id = q_id")
def review_all(spark, sf_dir):
    """The whole listing."""
    q, a, _ = _bank(spark, sf_dir)
    return review.review_rows(q, a, limit=None)


@query(f"""{_PAIRS} select {_LISTED} from q left join pairs on q.id = q_id where subject in ('1-URGENT', '2-HIGH') and review_status = 'pending'
  and n_media > 0 and created_at >= timestamp '1996-01-01' and created_at < timestamp '1998-01-01'""")
def review_faceted(spark, sf_dir):
    """Facets, days and pictures."""
    q, a, _ = _bank(spark, sf_dir)
    return review.review_rows(q, a, limit=None, date_from="1996-01-01", date_to="1997-12-31", has_picture="1", subject="1-URGENT, 2-HIGH", review_status=["pending"], topic="all")


@query(f"{_PAIRS} select {_LISTED} from q join pairs on q.id = q_id order by q.id desc, answer_id limit 500")
def review_answers_mode(spark, sf_dir):
    """Answered rows alone, newest 500."""
    q, a, _ = _bank(spark, sf_dir)
    return review.review_rows(q, a, mode="answers", limit=500)


@query(f"{_PAIRS} select id, subject from q where id in (select q_id from pairs)")
def answered(spark, sf_dir):
    """Answered questions."""
    q, a, _ = _bank(spark, sf_dir)
    return review.only_answered(q, a, "1").select("id", "subject")


@query(f"{_PAIRS} select id, subject from q where id not in (select q_id from pairs)")
def unanswered(spark, sf_dir):
    """Questions without an answer."""
    q, a, _ = _bank(spark, sf_dir)
    return review.only_answered(q, a, "0").select("id", "subject")


@query("""select q.id, q.subject, q.revision_status, f.id as answer_id, f.review_status as answer_review_status from q left join
  (select * from a where question_id is not null qualify row_number() over (partition by question_id order by id) = 1) f on f.question_id = q.id""")
def latest_answers(spark, sf_dir):
    """Each question's linked answer of the least id."""
    q, a, _ = _bank(spark, sf_dir)
    return review.latest_answers(q, a)


@query("select q.id, q.source_id, s.file_name, coalesce(nullif(q.corp, ''), s.subject) as corp_or_subject, q.grade::varchar as grade from q left join s on s.id = q.source_id")
def with_source(spark, sf_dir):
    """Questions with their source."""
    q, _, s = _bank(spark, sf_dir)
    return review.with_source(q, s)


@query("select a.question_id, a.id, a.review_status, q.question_text as text, q.review_status as question_status from a left join q on q.id = a.question_id")
def with_question(spark, sf_dir):
    """Answers with the question they link to."""
    q, a, _ = _bank(spark, sf_dir)
    return review.with_question(a, q)


@query("""with n as (select question_id, count(*) as n from a where question_id is not null group by 1),
  c as (select source_id, to_json(list({'question_number': question_number, 'id': id, 'n_answers': coalesce(n, 0)} order by question_number, id))::varchar as questions, sum(coalesce(n, 0))::bigint as n_answers
    from q left join n on n.question_id = q.id group by 1)
  select s.id, file_name, coalesce(questions, '[]') as questions, coalesce(n_answers, 0) as n_answers from s left join c on c.source_id = s.id""")
def source_detail(spark, sf_dir):
    """Each source with its questions nested, as JSON."""
    q, a, s = _bank(spark, sf_dir)
    return review.source_detail(s, q, a).withColumn("questions", F.to_json("questions"))


@query("""select s.id, s.status, count(q.id) as n_questions, count(l.question_id) as n_linked from s left join q on q.source_id = s.id
  left join (select distinct question_id from a where question_id is not null) l on l.question_id = q.id group by all""")
def source_counts(spark, sf_dir):
    """Each source with its counts, zero for none."""
    q, a, s = _bank(spark, sf_dir)
    return review.source_counts(s, q, a)


@query("select id, 'question' as entity from q where coalesce(revision_status, 'pending') = 'pending' union all select id, 'answer' from a where coalesce(revision_status, 'pending') = 'pending' or question_id is null")
def pending_rows(spark, sf_dir):
    """What a revision has not settled."""
    q, a, _ = _bank(spark, sf_dir)
    return review.pending(q).select("id", F.lit("question").alias("entity")).union(review.pending_answers(a).select("id", F.lit("answer")))


@query("select id, created_at, revision_status from q where needs_review order by created_at desc nulls last, id limit 200")
def revision_flagged(spark, sf_dir):
    """The flagged listing (F8, L3)."""
    return review.revision_items(tables.questions(spark, sf_dir)).select("id", "created_at", "revision_status")


@query("select id, question_id from a where (question_id is null and question_number in (select question_number from q where subject = '1-URGENT')) or question_id in (select id from q where subject = '1-URGENT')")
def answers_for_linking(spark, sf_dir):
    """Unlinked answers by number and linked ones by id."""
    q, a, _ = _bank(spark, sf_dir)
    urgent = q.filter("subject = '1-URGENT'")
    return review.for_linking(a, urgent, urgent).select("id", "question_id")


@query("select id from q where subject = '2-HIGH' and topic = 'F' and grade = 11")
def context_questions(spark, sf_dir):
    """Questions equal in subject, topic and grade."""
    return review.context_questions(tables.questions(spark, sf_dir), "2-HIGH", "F", 11).select("id")


@query("select id from a where (coalesce(revision_status, 'pending') = 'pending' or question_id is null) and id not in (select id from q where review_status = 'approved')")
def untouched_answers(spark, sf_dir):
    """Pending answers without those touched."""
    q, a, _ = _bank(spark, sf_dir)
    return review.outside(review.pending_answers(a), q.filter("review_status = 'approved'")).select("id")


@query("select *, count(*) over () as total from (select id, file_name, subject, status from s) where id::varchar ilike '%17%' or file_name ilike '%17%' or subject ilike '%17%' or status ilike '%17%' order by file_name desc nulls last, id limit 100 offset 10")
def console_page(spark, sf_dir):
    """A searched page of a table with its total."""
    return review.page_of_rows(tables.sources(spark, sf_dir).select("id", "file_name", "subject", "status"), "file_name", offset=10, text="17")


# Aggregates -----------------------------------------------------------------------------------------------------


@query("""select (select count(*) from q where {d}) as questions, (select count(*) from q where {d} and review_status = 'rejected') as errors, (select count(*) from a where {d}) as answers,
  (select count(*) from s where {d}) as files, (select count(*) from s where {d} and type = 'question') as question_files, (select count(*) from s where {d} and type = 'answer') as answer_files,
  (select count(*) from q where {d}) + (select count(*) from a where {d}) as succeeded""".replace("{d}", "created_at >= timestamp '1996-03-01' and created_at < timestamp '2024-01-16'"))
def period_counts(spark, sf_dir):
    """Counts of a period (A1)."""
    return stats.period_counts(*_bank(spark, sf_dir), "1996-03-01", "2024-01-15")


@query("select review_status as status, count(*) as n, (select count(*) from q where review_status in ('pending', 'approved', 'rejected')) as total from q group by 1")
def status_counts(spark, sf_dir):
    """Rows per state with the total of the known ones (A2)."""
    return stats.status_counts(tables.questions(spark, sf_dir))


@query("""select subject, count(*) filter (review_status = 'pending') as pending, count(*) filter (review_status = 'approved') as approved, count(*) filter (review_status = 'rejected') as rejected, count(*) as total
  from q where subject is not null group by 1""")
def subject_status(spark, sf_dir):
    """Subject by state (A3)."""
    return stats.subject_status(tables.questions(spark, sf_dir))


@query(f"""{_PAIRS}, f as (select id in (select q_id from pairs) as x, n_media > 0 as p from q)
  select count(*) filter (x and p) as answer_picture, count(*) filter (x and not p) as answer_only, count(*) filter (not x and p) as picture_only, count(*) filter (not x and not p) as neither,
  count(*) filter (x) as answered, count(*) filter (p) as pictured from f""")
def answer_picture_matrix(spark, sf_dir):
    """Answers crossed with pictures (A4)."""
    q, a, _ = _bank(spark, sf_dir)
    return stats.answer_picture_matrix(q, a)


@query("""select distinct 'subject' as facet, subject as value from q where subject is not null union all select distinct 'topic', topic from q where topic is not null
  union all select distinct 'grade', grade::varchar from q where grade is not null union all select distinct 'corp', corp from q where corp <> '' union all select distinct 'difficulty', difficulty from q where difficulty <> ''""")
def facet_values(spark, sf_dir):
    """The distinct values of each facet."""
    return stats.facet_values(tables.questions(spark, sf_dir))


@query("select 'questions' as name, count(*) as rows, max(created_at) as latest from q union all select 'answers', count(*), max(created_at) from a union all select 'sources', count(*), max(created_at) from s")
def overview(spark, sf_dir):
    """Size and newest time of each table."""
    return stats.overview(dict(zip(("questions", "answers", "sources"), _bank(spark, sf_dir))))


@query("""select 'question' as entity, coalesce(revision_status, 'pending') as status, count(*) as n, count(*) filter (needs_review) as flagged from q group by 2
  union all select 'answer', coalesce(revision_status, 'pending'), count(*), count(*) filter (needs_review) from a group by 2""")
def revision_summary(spark, sf_dir):
    """Rows per revision state."""
    q, a, _ = _bank(spark, sf_dir)
    return stats.revision_summary(q, a)


@query("select 'sources' as name, status, count(*) as n from s group by 2 union all select 'questions', review_status, count(*) from q group by 2")
def staged_counts(spark, sf_dir):
    """States of several tables."""
    q, _, s = _bank(spark, sf_dir)
    return stats.staged_counts({"sources": s, "questions": q.withColumn("status", F.col("review_status"))})


@query("""with p as (select source_id, count(*) as n, count(*) filter (needs_review) as flagged from q group by 1),
  r as (select subject, count(*) as sources, sum(coalesce(n, 0))::bigint as questions, sum(coalesce(flagged, 0))::bigint as flagged from s left join p on p.source_id = s.id group by 1)
  select *, case when questions > 0 then round(100 * flagged / questions)::int else 0 end as percent from r""")
def subject_roll(spark, sf_dir):
    """Sources, questions and flags per subject."""
    q, _, s = _bank(spark, sf_dir)
    return stats.subject_roll(q, s)


@query("""with l as (select a.grade, a.subject, q.grade as q_grade, q.subject as q_subject from a join q on q.id = a.question_id), c as (
  select 'question_without_source' as "check", count(*) as failures from q where source_id is not null and source_id not in (select id from s)
  union all select 'answer_without_question', count(*) from a where question_id is not null and question_id not in (select id from q)
  union all select 'question_without_text', count(*) from q where coalesce(trim(question_text), '') = ''
  union all select 'question_without_subject', count(*) from q where coalesce(trim(subject), '') = ''
  union all select 'question_without_number', count(*) from q where question_number is null
  union all select 'question_without_grade', count(*) from q where grade is null
  union all select 'question_state_unknown', count(*) from q where coalesce(review_status, '') not in ('pending', 'approved', 'rejected', 'unlinked')
  union all select 'answer_without_number', count(*) from a where question_number is null
  union all select 'answer_state_unknown', count(*) from a where coalesce(review_status, '') not in ('pending', 'approved', 'rejected', 'unlinked')
  union all select 'answer_unlinked_but_approved', count(*) from a where question_id is null and review_status = 'approved'
  union all select 'source_without_file', count(*) from s where coalesce(trim(file_name), '') = ''
  union all select 'source_without_subject', count(*) from s where subject is null
  union all select 'linked_grade_differs', count(*) from l where grade <> q_grade
  union all select 'linked_subject_differs', count(*) from l where subject <> q_subject)
  select *, failures = 0 as ok from c""")
def parity_checks(spark, sf_dir):
    """The invariants of a consolidated bank."""
    return stats.parity_checks(*_bank(spark, sf_dir))


# Usage ----------------------------------------------------------------------------------------------------------

_SEEN = """with seen as (select *, coalesce(nullif(source, ''), 'pipeline') as origin, cast((ts at time zone 'UTC') at time zone 'America/Los_Angeles' as date) as day,
  coalesce(tokens_in, 0) + coalesce(tokens_out, 0) as tokens from u where ts >= timestamp '2024-01-01 00:00:00' and not (coalesce(key_name, '') = '9router' and coalesce(nullif(source, ''), 'pipeline') = 'pipeline'))
"""


def _seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.without_lane_noise(usage.in_period(tables.usage(spark, sf_dir), "30d", NOW))


@query(f"""{_SEEN} select count(*) as calls, count(*) filter (not coalesce(ok, false)) as errors, coalesce(sum(tokens_in), 0)::bigint as tokens_in, coalesce(sum(tokens_out), 0)::bigint as tokens_out, coalesce(sum(ms), 0)::bigint as ms from seen""")
def usage_totals(spark, sf_dir):
    """Totals of a period."""
    return usage.totals(_seen(spark, sf_dir))


@query(f"{_SEEN} select origin as source, count(*) as calls, sum(tokens)::bigint as tokens from seen group by 1")
def usage_by_source(spark, sf_dir):
    """Calls and tokens per source."""
    return usage.by_source(_seen(spark, sf_dir))


def _chart_sql(label: str, value: str) -> str:
    return f"""{_SEEN}, c as (select day, {label} as series, {value} as value from seen group by 1, 2),
  p as (select series, row_number() over (order by sum(value) desc, series)::int as place from c group by 1)
  select d.day, place, p.series, coalesce(value, 0)::double as value from (select distinct day from c) d cross join p left join c on c.day = d.day and c.series = p.series"""


@query(_chart_sql("model", "count(*)"))
def usage_chart_models(spark, sf_dir):
    """Calls per Pacific day and model, dense."""
    return usage.chart(_seen(spark, sf_dir))


@query(_chart_sql("coalesce(nullif(key_name, ''), nullif(key_masked, ''), 'unknown')", "sum(tokens)"))
def usage_chart_keys(spark, sf_dir):
    """Tokens per Pacific day and key, dense."""
    return usage.chart(_seen(spark, sf_dir), "key", "tokens")


@query("""select cast((ts at time zone 'UTC') at time zone 'America/Los_Angeles' as date) as day, key_masked as key, model, count(*) as used,
  (case model when 'gemini-3.5-flash-lite' then 500 when 'view' then 60 else 20 end)::bigint as cap, count(*) >= (case model when 'view' then 60 else 20 end) as spent from u group by 1, 2, 3""")
def usage_gauge(spark, sf_dir):
    """Calls against the daily caps."""
    return usage.daily_gauge(tables.usage(spark, sf_dir), "view:60,bad,worse:x")


@query("""with o as (select model, ms, row_number() over (partition by model order by ts, id) as i, count(*) over (partition by model) as n from u where ms > 0)
  select model, round(sum(ms * pow(0.7, n - i) * case when i = 1 then 1 else 0.3 end), 3) as latency from o group by 1""")
def usage_latency(spark, sf_dir):
    """The running latency of each model."""
    return usage.running_latency(tables.usage(spark, sf_dir)).withColumn("latency", F.round("latency", 3))


@query("select id, ts, model from u order by ts desc, id desc limit 200")
def usage_last_calls(spark, sf_dir):
    """The newest 200 calls."""
    return usage.last_calls(tables.usage(spark, sf_dir)).select("id", "ts", "model")


@query("select 'questions' as name, count(*) as n from q union all select 'answers', count(*) from a union all select 'sources', count(*) from s")
def union_of_counts(spark, sf_dir):
    """The size of each table."""
    return usage.union_of_counts(dict(zip(("questions", "answers", "sources"), _bank(spark, sf_dir))))


# Linking --------------------------------------------------------------------------------------------------------

_LADDER = """n as (select number{k}, count(*) as n, min(corp) as corp, min(year) as year, min(id) as id from q group by all),
j as (select a.id, a.subject, coalesce(n.n, 0) as n_candidates, n.id as only_id,
    coalesce(n.n = 1 and (a.corp is null or n.corp is null or a.corp = n.corp) and (a.year is null or n.year is null or a.year = n.year), false) as linked,
    coalesce(a.corp = n.corp and a.year = n.year, false) as strong
  from a left join n on n.number = a.number{on} where question_id is null{w})"""
_LADDER_ALL = "with " + _LADDER.format(k="", on="", w="")
_STATE = "case when not linked then 'needs_manual' when strong then 'auto_ok' else 'unlinked_ok' end as match_state"


def _numbered(df: DataFrame) -> DataFrame:
    """The rows with their own number as the question number, so that some numbers are unique."""
    return df.withColumn("question_number", F.col("number"))


def _ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, a, _ = _bank(spark, sf_dir)
    return linking.verdicts(_numbered(a.filter("question_id is null")), _numbered(q))


@query(f"{_LADDER_ALL} select id, n_candidates, {_STATE}, case when linked and strong then 'number+corp+year' when linked then 'number' end as match_method, case when linked then only_id end as link_id from j")
def link_ladder(spark, sf_dir):
    """The verdict on every unlinked answer."""
    return _ladder(spark, sf_dir).select("id", "n_candidates", "match_state", "match_method", "link_id")


@query(f"{_LADDER_ALL} select match_state, count(*) as n from (select {_STATE} from j) x group by 1")
def link_histogram(spark, sf_dir):
    """Verdicts per state."""
    return linking.histogram(_ladder(spark, sf_dir))


@query(f"{_LADDER_ALL} select id, match_state from (select id, {_STATE} from j) x where match_state <> 'auto_ok' order by id limit 20")
def link_sample(spark, sf_dir):
    """The first 20 answers to look at."""
    return linking.sample_for_review(_ladder(spark, sf_dir)).select("id", "match_state")


@query("with " + _LADDER.format(k=", subject", on=" and n.subject = a.subject", w=" and a.subject is not null") + f""",
  m as (select number, count(*) as n, min(corp) as corp, min(year) as year from q group by 1)
  select id, j.subject, {_STATE}, coalesce(pool, 0) as pool from j left join (select subject, count(*) as pool from q group by 1) z on z.subject = j.subject
  union all select a.id, null, case when not coalesce(m.n = 1 and (a.corp is null or m.corp is null or a.corp = m.corp) and (a.year is null or m.year is null or a.year = m.year), false) then 'needs_manual'
    when a.corp = m.corp and a.year = m.year then 'auto_ok' else 'unlinked_ok' end, (select count(*) from q) from a left join m on m.number = a.number where question_id is null and a.subject is null""")
def match_report(spark, sf_dir):
    """Unlinked answers within their subject's questions."""
    q, a, _ = _bank(spark, sf_dir)
    return linking.match_report(_numbered(a), _numbered(q))


@query("""with k as (select question_number as n, coalesce(corp, '') as corp, coalesce(year, '') as year, min(id) as id from q where question_number is not null group by 1, 2, 3),
  f as (select a.id, min(k.id) filter ((k.corp = '' or coalesce(a.corp, '') = '' or k.corp = a.corp) and (k.year = '' or coalesce(a.year, '') = '' or k.year = a.year)) as strict, min(k.id) as any_one
    from a left join k on k.n = a.question_number group by a.id)
  select id, coalesce(strict, any_one) as question_id, case when any_one is null then 'unlinked' else 'pending' end as review_status from f""")
def first_match(spark, sf_dir):
    """Strict, then tolerant first match."""
    q, a, _ = _bank(spark, sf_dir)
    return linking.first_match(a, q)


@query("""with d as (select question_id, count(*) as n, min(id) as one from a where question_id in (select id from q) group by 1),
  t as (select id, case when number is null or subject is null or topic is null or grade is null then null else concat_ws('~', number, lower(subject), topic, grade) end as key from q where id not in (select question_id from d)),
  g as (select concat_ws('~', number, lower(subject), topic, grade) as key, count(*) as n, min(id) as one from a where question_id is null and number is not null and subject is not null and topic is not null and grade is not null group by 1),
  f as (select key, min(id) as first from t group by 1),
  p as (select question_id, case when n = 1 then one end as answer_id, 'id' as how, case when n > 1 then 'qa_ambiguous_pair' end as reason from d
    union all select t.id, case when n = 1 and t.id = first then one end, 'key', case when n > 1 then 'qa_ambiguous_pair' when n = 1 and t.id = first then null else 'qa_unmatched_answer' end
    from t left join g on g.key = t.key left join f on f.key = t.key)
  select * from p union all
  select null, a.id, 'none', case when exists (select 1 from d where d.question_id = a.question_id and d.n > 1)
    or (a.question_id is null and exists (select 1 from g join t on t.key = g.key where g.n > 1 and g.key = concat_ws('~', a.number, lower(a.subject), a.topic, a.grade) and a.subject is not null)) then 'qa_ambiguous_pair' else 'qa_unmatched_question' end
  from a where id not in (select answer_id from p where answer_id is not null)""")
def pairing(spark, sf_dir):
    """Pairs by id, then by identity, and what stays over with its reason."""
    q, a, _ = _bank(spark, sf_dir)
    return linking.pair(_numbered(q), _numbered(a))


_SIDES = linking.IDENTITY + linking.CONFIRMING
_FILLS = ", ".join([f"case when {t}.{c} is null or {t}.{c}::varchar = '' then case when coalesce({o}.{c}::varchar, '') <> '' then '{name}.{c}' end end" for t, o, name in (("a", "q", "answer"), ("q", "a", "question")) for c in _SIDES])
_CLASH = ", ".join(f"case when q.{c} <> a.{c} and q.{c}::varchar <> '' and a.{c}::varchar <> '' then '{c}' end" for c in _SIDES)


@query(f"""select q.id as question_id, a.id as answer_id, concat_ws(',', {_CLASH}) as conflicts, concat_ws(',', {_FILLS}) as fills from a join q on q.id = a.question_id""")
def pair_backfill(spark, sf_dir):
    """What the two sides of a linked pair contradict in, and lend each other."""
    q, a, _ = _bank(spark, sf_dir)
    linked = a.filter("question_id is not null").select("question_id", F.col("id").alias("answer_id"), F.lit("id").alias("how"))
    found = linking.backfill(linked, q, a)
    return found.select("question_id", "answer_id", F.array_join("conflicts", ",").alias("conflicts"), F.array_join("fills", ",").alias("fills"))


@query("select a.id, coalesce(a.subject, q.subject) as subject, coalesce(a.corp, q.corp) as corp, coalesce(a.year, q.year) as year from a left join q on q.id = a.question_id")
def identity_backfill(spark, sf_dir):
    """Answers filled from their question."""
    q, a, _ = _bank(spark, sf_dir)
    return linking.fill_identity(a, q, ["subject", "corp", "year"]).select("id", "subject", "corp", "year")


@query("select a.id, coalesce(o.id, q.id) as question_id from a left join (select number, min(id) as id from q group by 1) o on o.number = a.number left join q on q.id = a.number")
def link_resolve(spark, sf_dir):
    """A stored link by old number or id."""
    q, a, _ = _bank(spark, sf_dir)
    return linking.resolve_links(a, q)


@query("""select question_number, corp, year, id, origin from (
  select coalesce(question_number::varchar, '') as question_number, coalesce(corp, '') as corp, coalesce(year, '') as year, id, case when n_media = 0 then 'staged' else 'live' end as origin from q) x
  qualify row_number() over (partition by question_number, corp, year order by origin = 'live', id) = 1""")
def candidate_bank(spark, sf_dir):
    """Staged candidates before live ones, without duplicates."""
    q = tables.questions(spark, sf_dir)
    return linking.candidate_bank(q.filter("n_media = 0"), q.filter("n_media <> 0"))


@query("select id from q where (subject is null or subject in ('', '1-URGENT')) and (topic is null or topic in ('', 'F')) and (grade is null or grade = 12)")
def narrowed_candidates(spark, sf_dir):
    """Candidates of a scope, nulls tolerated."""
    return linking.narrowed(tables.questions(spark, sf_dir), "1-URGENT", "F", 12).select("id")


@query("""with r as (select id, subject, question_text, row_number() over (partition by subject, question_number order by id) as place, sum(length(question_text)) over (partition by subject, question_number order by id rows unbounded preceding)::bigint as used from q)
  select id, place::int as place, used from r where place <= 60 and (place = 1 or used <= 100)""")
def candidate_budget(spark, sf_dir):
    """The first candidates of each bank within a budget of characters."""
    q = tables.questions(spark, sf_dir).withColumn("bank", F.struct("subject", "question_number"))
    return linking.budgeted(q, "bank", "id", "question_text", budget=100).select("id", "place", "used")


# Audit ----------------------------------------------------------------------------------------------------------


def _missing_sql(view: str, entity: str, present: set[str]) -> str:
    lacks = lambda c: f"coalesce(trim({c}::varchar) in ('', '[]', '{{}}', 'null'), true)" if c in present else "true"
    return " union all ".join(f"select '{entity}' as entity, id as entity_id, '{c}' as field from {view} where {lacks(c)}" for c in rows.REQUIRED[entity])


_Q_COLUMNS = {"id", "source_id", "question_number", "question_text", "subject", "topic", "difficulty", "grade", "corp", "year"}
_A_COLUMNS = {"id", "question_number", "corp", "year", "difficulty", "subject", "topic", "grade"}
_NULLS = f"with r as ({_missing_sql('q', 'question', _Q_COLUMNS)} union all {_missing_sql('a', 'answer', _A_COLUMNS)})"


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, a, _ = _bank(spark, sf_dir)
    return audit.null_reports(q, "question").union(audit.null_reports(a, "answer"))


@query(f"{_NULLS} select *, 'null_required_column' as issue, 'error' as severity, 'code' as source from r")
def null_reports(spark, sf_dir):
    """One report for each required value that is missing."""
    return _reports(spark, sf_dir)


@query(f"{_NULLS} select entity, entity_id, field, 'run:' || entity || ':' || entity_id || ':r' || (row_number() over (partition by entity, entity_id order by field) - 1) as report_id from r")
def stamped_reports(spark, sf_dir):
    """Reports with their ids."""
    return audit.stamped(_reports(spark, sf_dir), "run", ["field"]).select("entity", "entity_id", "field", "report_id")


@query(f"{_NULLS} select 'null_reports' as counter, count(*) as n from r")
def revision_counters(spark, sf_dir):
    """Reports per class."""
    return audit.counters(_reports(spark, sf_dir))


@query(f"""{_NULLS}, b as (select distinct entity_id from r where entity = 'question')
  select id, case when b.entity_id is not null then 'needs_human' else 'revised' end as revision_status, b.entity_id is not null as needs_review from q left join b on b.entity_id = q.id""")
def finalised(spark, sf_dir):
    """The revision status that reports lead to."""
    return audit.finalise(tables.questions(spark, sf_dir), _reports(spark, sf_dir), "question")


@query("""select q.id, coalesce(nullif(case when q.id % 10 = 0 then 'checked' else '' end, ''), q.difficulty) as difficulty, q.id % 2 = 0 as answered,
  case when q.id % 2 <> 0 then 'pending' when q.id % 14 = 0 then 'needs_human' else 'revised' end as verdict_status from q""")
def merged_verdicts(spark, sf_dir):
    """Rows with what a reader's verdicts set."""
    q = tables.questions(spark, sf_dir)
    given = q.filter("id % 2 = 0").select("id", F.when(F.col("id") % 10 == 0, "checked").otherwise("").alias("difficulty"), (F.col("id") % 7 == 0).alias("flag"))
    return audit.merge_verdicts(q, given, ["difficulty"]).select("id", "difficulty", "answered", "verdict_status")


# Scalar functions -----------------------------------------------------------------------------------------------


@query(
    r"""select doc_id, sha1(n) as content_hash, length(n)::int as n_norm, case when length(n) > 160 then n[1:160] || '…' else n end as clipped, translate(n, '0123456789', '۰۱۲۳۴۵۶۷۸۹') as persian,
  substr(sha256(n), 1, 16) as key_hash from (select doc_id, trim(regexp_replace(coalesce(text, ''), '[\s\x0B\x1c-\x1f\x{85}\x{A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g')) as n from documents) x""",
    views=False,
)
def text_functions(spark, sf_dir):
    """Normal form, hash, cut and digits of every document."""
    norm = text.norm_text(F.col("text"))
    out = table(spark, sf_dir, "documents").select("doc_id", "text", norm.alias("n"))
    return out.select("doc_id", text.content_hash(F.col("text")).alias("content_hash"), F.length("n").alias("n_norm"), text.clip(F.col("n"), 160).alias("clipped"), text.persian_digits(F.col("n")).alias("persian"), text.key_hash(F.col("n")).alias("key_hash"))


@query("select id, sha1(rel_path) as source_key, regexp_replace(rel_path, '/[^/]*$', '') as folder, case when length(file_name) > 8 then file_name[1:4] || '…' || file_name[-4:] else file_name[1:1] || '…' end as masked from s")
def source_keys(spark, sf_dir):
    """Identity, folder and mask of every source."""
    return tables.sources(spark, sf_dir).select("id", text.source_id(F.col("rel_path")).alias("source_key"), text.folder_of(F.col("rel_path")).alias("folder"), text.mask(F.col("file_name")).alias("masked"))
