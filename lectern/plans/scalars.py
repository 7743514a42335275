"""The registered queries of the column functions and the vocabulary."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import boxes, faults, maths, options, rows, text
from lectern.operators import usage, vocabulary
from lectern.plans.registry import query
from lectern.sources import tables
from lectern.session import table


@query("""select id, case when id % 15 between 1 and 12 then (id % 15)::int end as grade, (id % 30)::int as page, (case when id % 3 = 0 then id else id % 3 end)::int as place, (id % 50)::bigint as number,
  case when id % 4 = 0 then 'own' when id % 3 > 0 then 'mcq_single' else 'short_answer' end as kind, list_filter([corp, year, difficulty], lambda x: x is not null and x <> '') as tags from q""")
def row_functions(spark, sf_dir):
    """Grades, pages, positions, numbers, types and tags of every question."""
    q, key = tables.questions(spark, sf_dir), F.col("id")
    return q.select(
        "id", text.parse_grade((key % 15).cast("string")).alias("grade"), text.page_number(F.concat(F.lit("page "), (key % 30).cast("string"))).alias("page"),
        text.position_number((key % 3).cast("string"), key).alias("place"), text.match_number(F.concat((key % 50).cast("string"), F.lit(".7"))).alias("number"),
        rows.question_type(F.when(key % 4 == 0, "own").otherwise(" "), F.expr("array_repeat('x', cast(id % 3 as int))")).alias("kind"), rows.tags("corp", "year", "difficulty").alias("tags"),
    )


@query("""select event_id, cast(ts as date) - 6 as from_day, date_sub('second', ts, timestamp '2024-06-01') / 86400.0 as age_days, least(120.0, 5.0 * power(2.0, greatest(event_id % 8, 1) - 1)) as wait from events""", views=False)
def time_functions(spark, sf_dir):
    """Starts of a week's period, ages in days and waits before retries."""
    seconds = F.timestamp_diff("SECOND", F.col("ts").cast("timestamp"), F.lit("2024-06-01").cast("timestamp"))
    return table(spark, sf_dir, "events").select("event_id", usage.period_start(F.col("ts"), 7).alias("from_day"), (seconds / 86400.0).alias("age_days"), rows.backoff((F.col("event_id") % 8).cast("int")).alias("wait"))


@query("""select event_id, (timezone('UTC', timezone('America/Los_Angeles', (cast(timezone('America/Los_Angeles', timezone('UTC', ts)) as date) + 1)::timestamp)))::timestamp as reset_at from events""", views=False)
def reset_times(spark, sf_dir):
    """The Pacific midnight after every event."""
    return table(spark, sf_dir, "events").select("event_id", usage.next_midnight(F.col("ts")).cast("timestamp_ntz").alias("reset_at"))


@query(r"""select doc_id, case when len(regexp_replace(t, '\P{L}', '', 'g')) > 0 then len(regexp_replace(t, '\P{L}', '', 'g')) when regexp_matches(t, '\p{Nd}') then 1 else 0 end::int as letters,
  (len(t) - len(replace(t, '$', ''))) % 2 = 0 and len(t) - len(replace(t, '\[', '')) = len(t) - len(replace(t, '\]', '')) and len(t) - len(replace(t, '\(', '')) = len(t) - len(replace(t, '\)', '')) as balanced
  from (select doc_id, coalesce(text, '') as t from documents) x""", views=False)
def text_measures(spark, sf_dir):
    """Letters and balance of delimiters of every document."""
    return table(spark, sf_dir, "documents").select("doc_id", text.letters(F.col("text")).alias("letters"), maths.delimiters_balanced(F.col("text")).alias("balanced"))


@query("""select id, 100.0 as y0, least(900.0, 400.0 + id % 400) as y1, [50.0, 100.0, 500.0, 600.0] as merged, id % 10 between 1 and 3 as figure, 'crops/' || id || '/q' || (id % 7) || '-2.jpg' as crop from s""")
def box_functions(spark, sf_dir):
    """Cleaned and merged boxes, the figure rule and crop names."""
    s, key = tables.sources(spark, sf_dir), F.col("id")
    flipped = F.array((F.lit(400.0) + key % 400), F.lit(900.0), F.lit(100.0), F.lit(10.0))
    merged = boxes.union_box(F.array(F.expr("array(100d, 100d, 500d, 300d)"), F.expr("array(50d, 200d, 90d, 600d)")))
    share = F.array((key % 10) / 20.0 + 0.15 * F.when(key % 10 == 0, -1.0).when(key % 10 >= 4, 1.0).otherwise(0.0))
    clean = boxes.clean_box(flipped)
    return s.select("id", clean[0].cast("double").alias("y0"), clean[2].cast("double").alias("y1"), F.transform(merged, lambda x: x.cast("double")).alias("merged"), boxes.has_figure(share).alias("figure"), boxes.crop_key(key.cast("string"), "q", key % 7, F.lit(2)).alias("crop"))


@query("""select id, case (id % 5)::int when 0 then 'one' when 1 then 'two' when 2 then 'three' when 3 then 'four' end as by_label, case when id % 4 = 3 then null else ['one', 'two', 'three'][(id % 4 + 1)::int] end as text,
  case when id % 4 < 3 then (id % 4 + 1)::varchar end as label from q""")
def option_lookups(spark, sf_dir):
    """Options by label, by place and by text."""
    q, key = tables.questions(spark, sf_dir), F.col("id")
    listed = options.normalize_options(F.lit('["1) one", "2) two", "3) three", "4) four"]'))
    label = F.element_at(F.array(*[F.lit(x) for x in ("(1)", "۲", "ج", "د", "zz")]), (key % 5 + 1).cast("int"))
    three = options.normalize_options(F.lit('[{"label": "1", "text": "one"}, {"key": "2", "value": "two"}, "3. three"]'))
    place = (key % 4 + 1).cast("string")
    text_at = options.text_of_label(three, place)
    return q.select("id", options.option_text(listed, label).alias("by_label"), text_at.alias("text"), options.label_of_text(three, text_at).alias("label"))


@query("""select id, case id % 6 when 0 then 'rate_limit' when 1 then 'recv_dropped' when 2 then 'model_empty' when 3 then 'unknown' when 4 then 'overload' else 'quota' end as kind from s""")
def fault_kinds(spark, sf_dir):
    """Kinds of failure messages."""
    said = F.element_at(F.array(*[F.lit(x) for x in ("gemini HTTP 429 rate limit", "gemini ReadTimeout", "gemini: no text content", "something", "gemini HTTP 503", "gemini HTTP 429 quota exceeded")]), (F.col("id") % 6 + 1).cast("int"))
    return tables.sources(spark, sf_dir).select("id", faults.classify(said).alias("kind"))


@query("select id, row_number() over (order by id) as place from s")
def natural_order(spark, sf_dir):
    """Sources in the natural order of their file names."""
    from pyspark.sql import Window

    # A listing of one folder, which is one window by its nature.
    names = tables.sources(spark, sf_dir).select("id", F.concat(F.lit("scan-"), "id", F.lit(".jpg")).alias("name"))
    return names.select("id", F.row_number().over(Window.orderBy(text.natural_key(F.col("name")))).alias("place"))


def _vocabulary(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    brands = part.select(F.lit("corps").alias("kind"), F.lit(None).cast("string").alias("subject"), F.col("p_brand").alias("tag")).distinct()
    brands = brands.withColumn("variants", F.array(F.regexp_replace("tag", "#", " # "), F.lit(""), F.regexp_replace("tag", "#", " # ")))
    topics = part.select(F.lit("topics").alias("kind"), F.col("p_brand").alias("subject"), F.col("p_type").alias("tag")).distinct().withColumn("variants", F.expr("cast(array() as array<string>)"))
    return brands.union(topics)


@query("select p_partkey, case when p_partkey % 3 <> 2 then p_brand end as corp from part", views=False)
def vocabulary_tags(spark, sf_dir):
    """Tags of raw spellings by fold."""
    spelled = vocabulary.spellings(vocabulary.normalised(_vocabulary(spark, sf_dir)), "corps")
    raw = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).when(F.col("p_partkey") % 3 == 1, F.regexp_replace("p_brand", "#", "  # ")).otherwise("none").alias("raw"))
    return vocabulary.matched(raw, "raw", spelled, "corp").select("p_partkey", "corp")


@query("select distinct 'topics' as kind, p_type as tag, 'unknown subject' as fault from part", views=False)
def vocabulary_faults(spark, sf_dir):
    """Topics whose subject the vocabulary lacks."""
    return vocabulary.faults(_vocabulary(spark, sf_dir)).distinct()


@query("select distinct p_type as tag from part where p_brand = 'Brand#11'", views=False)
def vocabulary_topics(spark, sf_dir):
    """The topics of one subject."""
    return vocabulary.topics_of(_vocabulary(spark, sf_dir), F.lit("Brand#11"))


@query("""select id, len(list_distinct(kept))::int as found, kept[1] as first
  from (select id, list_filter([corp, subject, corp, topic, difficulty], lambda x: x is not null and trim(x) <> '') as kept from q) x""")
def distinct_values(spark, sf_dir):
    """Distinct strings of a row in order (U5): how many, and the first."""
    kept = rows.distinct_values("corp", "subject", "corp", "topic", "difficulty")
    return tables.questions(spark, sf_dir).select("id", F.size(kept).alias("found"), F.get(kept, F.lit(0)).alias("first"))
