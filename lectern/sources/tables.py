"""The bank's relations, bound to the star-schema and event tables.

Each function reads whole tables and derives the columns that a question, answer, source or usage row has. The
same derivations as SQL are in `SQL`, for oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.session import table


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions from orders."""
    key, day = F.col("o_orderkey"), F.col("o_orderdate")
    year = F.year(day)
    return table(spark, sf_dir, "orders").select(
        key.alias("id"), F.col("o_custkey").alias("source_id"), F.when(key % 7 == 0, key + 1).otherwise(key).alias("number"), (key % 97).cast("int").alias("question_number"),
        F.concat(F.col("o_orderpriority"), F.lit(" no. "), key.cast("string")).alias("question_text"),
        F.col("o_orderpriority").alias("subject"), F.col("o_orderstatus").alias("topic"), (year - 1985).cast("int").alias("grade"),
        F.when(key % 11 != 0, F.col("o_orderpriority")).alias("corp"), F.when(key % 13 != 0, year.cast("string")).alias("year"),
        F.when(key % 3 == 0, "easy").when(key % 3 == 1, "hard").otherwise("").alias("difficulty"),
        F.when(key % 5 == 0, "approved").when(key % 5 == 1, "rejected").when(key % 5 == 2, "unlinked").otherwise("pending").alias("review_status"),
        F.when(key % 6 == 1, "pending").when(key % 6 == 2, "revised").when(key % 6 == 3, "needs_human").when(key % 6 == 4, "approved").when(key % 6 == 5, "pending").alias("revision_status"),
        (key % 9 == 0).alias("needs_review"), (key % 4).cast("int").alias("n_media"), day.alias("created_at"),
    )


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers from events: a third linked by id, the rest by identity; some without a subject."""
    key, kind = F.col("event_id"), F.col("event_type")
    priority = F.when(kind == "click", "1-URGENT").when(kind == "view", "2-HIGH")
    return table(spark, sf_dir, "events").select(
        key.alias("id"), F.when(key % 3 == 0, key).alias("question_id"), (key * 2).alias("number"), (F.col("user_id") % 97).cast("int").alias("question_number"),
        priority.when(kind == "signup", "3-MEDIUM").when(kind == "purchase", "5-LOW").alias("subject"), F.when(key % 2 == 0, "F").otherwise("O").alias("topic"),
        (10 + key % 7).cast("int").alias("grade"), priority.alias("corp"), F.when(key % 2 == 0, (1995 + key % 7).cast("string")).alias("year"),
        F.when(key % 4 == 0, "easy").when(key % 4 == 1, "hard").alias("difficulty"),
        F.when(key % 5 == 0, "approved").when(key % 5 == 1, "unlinked").otherwise("pending").alias("review_status"),
        F.when(key % 6 == 1, "pending").when(key % 6 == 2, "revised").when(key % 6 == 3, "needs_human").alias("revision_status"),
        (key % 8 == 0).alias("needs_review"), F.col("ts").alias("created_at"),
    )


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source files from customers; every seventh has no subject of its own."""
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.alias("id"), F.col("c_name").alias("file_name"), F.concat(F.col("c_mktsegment"), F.lit("/"), F.col("c_nationkey").cast("string"), F.lit("/"), F.col("c_name")).alias("rel_path"),
        F.when(key % 7 != 0, F.col("c_mktsegment")).alias("subject"), F.col("c_nationkey").alias("grade"), F.when(key % 2 == 0, "question").otherwise("answer").alias("type"),
        F.floor(F.col("c_acctbal")).cast("long").alias("file_size"),
        F.when(key % 5 == 0, "ready").when(key % 5 == 1, "edited").when(key % 5 == 2, "imported").otherwise("staged").alias("status"),
        F.expr("timestamp_ntz'1995-01-01' + make_interval(0, 0, 0, cast(c_custkey % 1000 as int))").alias("created_at"),
    )


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage rows from events; ok is null for some, source and key_name are null, blank or set."""
    key, user = F.col("event_id"), F.col("user_id")
    return table(spark, sf_dir, "events").select(
        key.alias("id"), F.col("ts"), F.col("event_type").alias("model"),
        F.when(user % 7 == 0, "9router").when(user % 5 == 0, "").when(user % 5 != 1, F.concat(F.lit("key-"), (user % 10).cast("string"))).alias("key_name"),
        F.concat(F.lit("k"), (user % 3).cast("string"), F.lit("…")).alias("key_masked"),
        F.when(key % 4 == 0, "").when(key % 4 == 1, "pipeline").when(key % 4 == 2, "ocr").alias("source"),
        F.when(key % 10 != 0, F.floor("value").cast("long")).alias("tokens_in"), (key % 50).alias("tokens_out"), F.floor(F.col("value") * 100).cast("long").alias("ms"),
        F.when(F.col("event_type") == "error", False).when(key % 6 != 0, True).alias("ok"),
    )


#: The same relations as SQL common table expressions q, a, s and u.
SQL = """
q as (
  select o_orderkey as id, o_custkey as source_id, case when o_orderkey % 7 = 0 then o_orderkey + 1 else o_orderkey end as number, cast(o_orderkey % 97 as int) as question_number,
    o_orderpriority || ' no. ' || o_orderkey as question_text, o_orderpriority as subject, o_orderstatus as topic, cast(year(o_orderdate) - 1985 as int) as grade,
    case when o_orderkey % 11 <> 0 then o_orderpriority end as corp, case when o_orderkey % 13 <> 0 then cast(year(o_orderdate) as varchar) end as year,
    case o_orderkey % 3 when 0 then 'easy' when 1 then 'hard' else '' end as difficulty,
    case o_orderkey % 5 when 0 then 'approved' when 1 then 'rejected' when 2 then 'unlinked' else 'pending' end as review_status,
    case o_orderkey % 6 when 1 then 'pending' when 2 then 'revised' when 3 then 'needs_human' when 4 then 'approved' when 5 then 'pending' end as revision_status,
    o_orderkey % 9 = 0 as needs_review, cast(o_orderkey % 4 as int) as n_media, o_orderdate as created_at
  from orders),
a as (
  select event_id as id, case when event_id % 3 = 0 then event_id end as question_id, event_id * 2 as number, cast(user_id % 97 as int) as question_number,
    case event_type when 'click' then '1-URGENT' when 'view' then '2-HIGH' when 'signup' then '3-MEDIUM' when 'purchase' then '5-LOW' end as subject,
    case when event_id % 2 = 0 then 'F' else 'O' end as topic, cast(10 + event_id % 7 as int) as grade,
    case event_type when 'click' then '1-URGENT' when 'view' then '2-HIGH' end as corp, case when event_id % 2 = 0 then cast(1995 + event_id % 7 as varchar) end as year,
    case event_id % 4 when 0 then 'easy' when 1 then 'hard' end as difficulty,
    case event_id % 5 when 0 then 'approved' when 1 then 'unlinked' else 'pending' end as review_status,
    case event_id % 6 when 1 then 'pending' when 2 then 'revised' when 3 then 'needs_human' end as revision_status,
    event_id % 8 = 0 as needs_review, ts as created_at
  from events),
s as (
  select c_custkey as id, c_name as file_name, c_mktsegment || '/' || c_nationkey || '/' || c_name as rel_path, case when c_custkey % 7 <> 0 then c_mktsegment end as subject,
    c_nationkey as grade, case when c_custkey % 2 = 0 then 'question' else 'answer' end as type, cast(floor(c_acctbal) as bigint) as file_size,
    case c_custkey % 5 when 0 then 'ready' when 1 then 'edited' when 2 then 'imported' else 'staged' end as status,
    timestamp '1995-01-01' + to_days(cast(c_custkey % 1000 as int)) as created_at
  from customer),
u as (
  select event_id as id, ts, event_type as model,
    case when user_id % 7 = 0 then '9router' when user_id % 5 = 0 then '' when user_id % 5 <> 1 then 'key-' || (user_id % 10) end as key_name,
    'k' || (user_id % 3) || '…' as key_masked, case event_id % 4 when 0 then '' when 1 then 'pipeline' when 2 then 'ocr' end as source,
    case when event_id % 10 <> 0 then cast(floor(value) as bigint) end as tokens_in, event_id % 50 as tokens_out, cast(floor(value * 100) as bigint) as ms,
    case when event_type = 'error' then false when event_id % 6 <> 0 then true end as ok
  from events)"""


def with_views(sql: str) -> str:
    """An oracle over q, a, s and u."""
    body = sql.strip()
    word = next((w for w in ("with recursive ", "with ") if body.startswith(w)), "")
    return f"{word or 'with '}{SQL.strip()}{',' if word else ''}\n{body.removeprefix(word)}"
