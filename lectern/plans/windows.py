"""The registered queries of runs, segments, lanes and replies."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import pages
from lectern.plans.registry import query
from lectern.session import table

_PAGES = """with p as (select distinct user_id as paper, event_id % 40 as page from events),
i as (select *, page - row_number() over (partition by paper order by page) as island from p),
r as (select *, row_number() over (partition by paper, island order by page) - 1 as rn from i)
"""


@query(_PAGES + "select paper, page, paper || ':' || min(page) over (partition by paper, island, rn // 3) as run, (rn % 3)::int as at from r", views=False)
def page_runs(spark, sf_dir):
    """Consecutive pages of every paper in runs of three."""
    papers = table(spark, sf_dir, "events").select(F.col("user_id").alias("paper"), (F.col("event_id") % 40).alias("page")).distinct()
    return pages.page_runs(papers, "paper", "page", 3)


@query("""with c as (select conv_id, turn, role, case when lag(role) over w is not distinct from role and row_number() over w > 1 then 0 else 1 end as changed from conversations window w as (partition by conv_id order by turn)),
s as (select *, sum(changed) over (partition by conv_id order by turn) as segment from c)
select conv_id, min(role) as role, min(turn) as first, max(turn) as last, count(*) as n from s group by conv_id, segment""", views=False)
def role_segments(spark, sf_dir):
    """Stretches of turns of one role."""
    return pages.segments(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn", "role")


@query("select p_partkey, (p_partkey % 4)::int as lane, (p_partkey // 4 + 1)::int as round from part", views=False)
def lanes(spark, sf_dir):
    """Parts dealt to four lanes in turn."""
    lane, number = pages.lanes(F.col("p_partkey"), 4)
    return table(spark, sf_dir, "part").select("p_partkey", lane.alias("lane"), number.alias("round"))


@query("""select user_id, arg_max(event_type, event_id) filter (event_type <> 'error') as kind, arg_max(cast(cast(floor(value) as bigint) as varchar), event_id) filter (value is not null and event_id % 3 <> 0) as amount from events group by user_id""", views=False)
def merged_replies(spark, sf_dir):
    """The last non-empty value of each field of a paper's replies."""
    replies = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type")).alias("kind"), F.when(F.col("event_id") % 3 != 0, F.floor("value").cast("long")).alias("amount"))
    return pages.merge_replies(replies, "user_id", "event_id", ["kind", "amount"])


@query("""select user_id, count(*) as pages, count(*) filter (event_type = 'error') as empty, count(*) filter (event_type = 'error') * 2 <= count(*) and count(*) filter (event_type = 'error') < count(*) as accepted from events group by user_id""", views=False)
def accepted_batches(spark, sf_dir):
    """Batches with at most half of their pages empty."""
    return pages.accepted_batches(table(spark, sf_dir, "events"), "user_id", F.col("event_type") == "error")
