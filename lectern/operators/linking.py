"""Linking answers to questions: the evidence ladder, the first match, pairing with backfill, candidate banks.

Whether a number is unique decides more than any single candidate, so the ladder joins an aggregate of the
questions (how many have the number, and the one that does), never all candidates of an answer.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.rows import is_missing
from lectern.functions.text import canonical_year, fold, match_number, parse_number, with_norms
from lectern.session import materialise

# What identifies a pair and what confirms it.
IDENTITY = ["question_number", "subject", "topic", "grade"]
CONFIRMING = ["corp", "year", "difficulty"]


def comparison(df: DataFrame, tags: DataFrame | None = None) -> DataFrame:
    """`df` with number_key, corp_key and year_key; with `tags` (fold_key, tag) a known spelling counts as its tag."""
    keyed = df.withColumn("number_key", match_number(F.col("question_number"))).withColumn("corp_key", fold(F.col("corp"))).withColumn("year_key", canonical_year(F.col("year")))
    if tags is None:
        return keyed
    named = keyed.join(tags.select(F.col("fold_key").alias("corp_key"), fold(F.col("tag")).alias("tag_key")), "corp_key", "left")
    return named.withColumn("corp_key", F.coalesce("tag_key", "corp_key")).drop("tag_key")


def verdicts(answers: DataFrame, questions: DataFrame, scope: list[str] | None = None, tags: DataFrame | None = None) -> DataFrame:
    """Each answer with n_candidates, match_state, match_method and link_id.

    Candidates are the questions with its number, within equal `scope` columns if given. One candidate that
    contradicts in neither institute nor year links: 'auto_ok' if both are present and equal, else 'unlinked_ok'.
    Everything else is 'needs_manual'. Candidates without id are left out; a null number never matches.
    """
    keys = ["number_key", *(scope or [])]
    left, right = comparison(answers, tags), comparison(questions.filter("id is not null"), tags)
    per_number = right.groupBy(*keys).agg(F.count("*").alias("n"), F.min(F.struct("id", "corp_key", "year_key")).alias("only"))
    joined = left.join(per_number, keys, "left")
    agrees = lambda c: (F.col(c) == "") | (F.col(f"only.{c}") == "") | (F.col(c) == F.col(f"only.{c}"))
    equal = lambda c: (F.col(c) != "") & (F.col(c) == F.col(f"only.{c}"))
    linked = F.coalesce((F.col("n") == 1) & agrees("corp_key") & agrees("year_key"), F.lit(False))
    strong = equal("corp_key") & equal("year_key")
    out = joined.withColumn("n_candidates", F.coalesce("n", F.lit(0)))
    out = out.withColumn("match_state", F.when(~linked, "needs_manual").when(strong, "auto_ok").otherwise("unlinked_ok"))
    out = out.withColumn("match_method", F.when(linked & strong, "number+corp+year").when(linked, "number"))
    return out.withColumn("link_id", F.when(linked, F.col("only.id"))).select(*answers.columns, "n_candidates", "match_state", "match_method", "link_id")


def match_report(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """(id, subject, match_state, pool): the verdict on every unlinked answer within its subject's questions.

    An answer without a subject is judged against all questions. pool is how many questions it was judged against.
    """
    loose = answers.filter("question_id is null").withColumn("subject", F.nullif("subject", F.lit("")))
    sizes = questions.groupBy("subject").agg(F.count("*").alias("pool"))
    everything = questions.agg(F.count("*").alias("pool"))
    with_subject = verdicts(loose.filter("subject is not null"), questions, ["subject"]).join(sizes, "subject", "left")
    without = verdicts(loose.filter("subject is null"), questions).join(F.broadcast(everything))
    columns = ["id", "subject", "match_state", F.coalesce("pool", F.lit(0)).alias("pool")]
    return with_subject.select(*columns).union(without.select(*columns))


def histogram(found: DataFrame) -> DataFrame:
    """(match_state, n) over verdicts."""
    return found.groupBy("match_state").agg(F.count("*").alias("n"))


def sample_for_review(found: DataFrame, n: int = 20) -> DataFrame:
    """The first `n` answers that did not link by full evidence, by id."""
    return found.filter("match_state <> 'auto_ok'").orderBy("id").limit(n)


def first_match(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """(id, question_id, review_status): each answer's first question, by id, with its number.

    One whose institute and year do not contradict wins over one with the number alone; an answer without any is
    'unlinked'. Candidates are first reduced to the first question per (number, institute, year), so what meets an
    answer are kinds of evidence, not questions.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    kinds = questions.withColumn("number_key", parse_number(F.col("question_number"))).filter("number_key is not null")
    kinds = kinds.groupBy("number_key", blank("corp").alias("corp"), blank("year").alias("year")).agg(F.min("id").alias("question"))
    listed = kinds.groupBy("number_key").agg(F.collect_list(F.struct("question", "corp", "year")).alias("kinds"))
    joined = answers.withColumn("number_key", parse_number(F.col("question_number"))).join(listed, "number_key", "left")
    agrees = lambda k, c: (k[c] == "") | (blank(c) == "") | (k[c] == blank(c))
    strict = F.array_min(F.transform(F.filter("kinds", lambda k: agrees(k, "corp") & agrees(k, "year")), lambda k: k["question"]))
    any_one = F.array_min(F.transform("kinds", lambda k: k["question"]))
    found = F.coalesce(strict, any_one)
    return joined.select("id", found.alias("question_id"), F.when(found.isNull(), "unlinked").otherwise("pending").alias("review_status"))


def with_identity(df: DataFrame, name: str = "key", columns: list[str] = IDENTITY) -> DataFrame:
    """`df` with the normalised identity as one value; null if a part is missing."""
    parts = {f"{name}_{c}": c for c in columns}
    whole = reduce(Column.__and__, [F.col(p).isNotNull() for p in parts])
    return with_norms(df, parts).withColumn(name, F.when(whole, F.concat_ws("\x1f", *parts))).drop(*parts)


def pair(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """(question_id, answer_id, how, reason): what pairs, and every row that does not, with its reason.

    Answers linked by id come first: one makes a pair, several are ambiguous and the question tries no key. Of the
    other questions the first of each identity (by id) takes an unlinked answer that is alone with it; several such
    answers are ambiguous for all, and what is left over is unmatched. Set form of a walk in id order.
    """
    q = materialise(with_identity(questions.select("id", *IDENTITY)).select(F.col("id").alias("question_id"), "key"), "question-keys")
    a = materialise(with_identity(answers.select("id", "question_id", *IDENTITY)).select(F.col("id").alias("answer_id"), F.col("question_id").alias("linked"), "key"), "answer-keys")
    direct = a.filter("linked is not null").join(q.select(F.col("question_id").alias("linked")), "linked", "left_semi")
    per_question = direct.groupBy(F.col("linked").alias("question_id")).agg(F.count("*").alias("n_direct"), F.min("answer_id").alias("direct"))
    marked = materialise(q.join(per_question, "question_id", "left"), "question-links")
    by_id = marked.filter("n_direct is not null").select("question_id", F.when(F.col("n_direct") == 1, F.col("direct")).alias("answer_id"), F.lit("id").alias("how"), F.when(F.col("n_direct") > 1, "qa_ambiguous_pair").alias("reason"))
    free = a.filter("linked is null and key is not null").groupBy("key").agg(F.count("*").alias("n"), F.min("answer_id").alias("only"))
    trying = marked.filter("n_direct is null")
    firsts = trying.filter("key is not null").groupBy("key").agg(F.min("question_id").alias("first"))
    keyed = trying.join(free, "key", "left").join(firsts, "key", "left")
    takes = (F.col("n") == 1) & (F.col("question_id") == F.col("first"))
    by_key = keyed.select(
        "question_id", F.when(takes, F.col("only")).alias("answer_id"), F.lit("key").alias("how"),
        F.when(F.col("n") > 1, "qa_ambiguous_pair").when(F.coalesce(takes, F.lit(False)), F.lit(None)).otherwise("qa_unmatched_answer").alias("reason"),
    )
    paired = materialise(by_id.union(by_key), "pairs")
    used = paired.filter("answer_id is not null").select("answer_id")
    tried = trying.filter("key is not null").select("key").distinct().withColumn("tried", F.lit(True))
    crowded_key = free.filter("n > 1").select("key").withColumn("crowded", F.lit(True)).join(tried, "key").select("key", "crowded")
    crowded_id = per_question.filter("n_direct > 1").select(F.col("question_id").alias("linked")).withColumn("crowded_id", F.lit(True))
    rest = a.join(used, "answer_id", "left_anti").join(crowded_id, "linked", "left")
    loose_key = F.when(F.col("linked").isNull(), F.col("key"))
    rest = rest.withColumn("key", loose_key).join(crowded_key, "key", "left")
    ambiguous = F.col("crowded_id").isNotNull() | F.col("crowded").isNotNull()
    alone = rest.select(F.lit(None).cast("long").alias("question_id"), "answer_id", F.lit("none").alias("how"), F.when(ambiguous, "qa_ambiguous_pair").otherwise("qa_unmatched_question").alias("reason"))
    return paired.union(alone)


def conflicts(columns: list[str], left: str = "q_", right: str = "a_") -> Column:
    """The columns that both sides define and that differ, given their comparable forms (`with_norms`)."""
    differ = lambda c: F.col(f"{left}{c}_norm") != F.col(f"{right}{c}_norm")
    return F.array_compact(F.array(*[F.when(differ(c), F.lit(c)) for c in columns]))


def backfill(pairs: DataFrame, questions: DataFrame, answers: DataFrame) -> DataFrame:
    """(question_id, answer_id, conflicts, fills): for each pair what contradicts and what one side lends the other.

    A pair linked by id is checked in identity and confirming columns, one found by identity in the confirming ones.
    fills has 'answer.<column>' or 'question.<column>' for each missing value that the other side has.
    """
    columns = IDENTITY + CONFIRMING
    side = lambda df, p, key: df.select(F.col("id").alias(key), *[F.col(c).alias(p + c) for c in columns])
    both = pairs.filter("question_id is not null and answer_id is not null").join(side(questions, "q_", "question_id"), "question_id").join(side(answers, "a_", "answer_id"), "answer_id")
    both = with_norms(both, {f"{p}{c}_norm": p + c for p in ("q_", "a_") for c in columns})
    lends = lambda to, frm, name: [F.when(is_missing(F.col(to + c)) & ~is_missing(F.col(frm + c)), F.lit(f"{name}.{c}")) for c in columns]
    found = F.when(F.col("how") == "id", conflicts(columns)).otherwise(conflicts(CONFIRMING))
    return both.select("question_id", "answer_id", found.alias("conflicts"), F.array_compact(F.array(*lends("a_", "q_", "answer"), *lends("q_", "a_", "question"))).alias("fills"))


def fill_identity(answers: DataFrame, questions: DataFrame, columns: list[str]) -> DataFrame:
    """Answers with their nulls filled from the question they link to; what is set stays."""
    lent = questions.select(F.col("id").alias("question_id"), *[F.col(c).alias(f"lent_{c}") for c in columns])
    joined = answers.join(lent, "question_id", "left")
    return joined.select(*[F.coalesce(c, f"lent_{c}").alias(c) if c in columns else F.col(c) for c in answers.columns])


def resolve_links(answers: DataFrame, questions: DataFrame, link: str = "number") -> DataFrame:
    """(id, question_id): the question that a stored link names, by its old number or else its id."""
    by_old = questions.groupBy(F.col("number").alias(link)).agg(F.min("id").alias("by_old"))
    by_id = questions.select(F.col("id").alias(link), F.col("id").alias("by_id")).distinct()
    return answers.select("id", link).join(by_old, link, "left").join(by_id, link, "left").select("id", F.coalesce("by_old", "by_id").alias("question_id"))


def candidate_bank(staged: DataFrame, live: DataFrame) -> DataFrame:
    """Staged candidates, then live ones, of each (number, institute, year) the first."""
    both = staged.withColumn("origin", F.lit("staged")).unionByName(live.withColumn("origin", F.lit("live")), allowMissingColumns=True)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    key = [text(c) for c in ("question_number", "corp", "year")]
    first = F.min(F.struct((F.col("origin") == "live").alias("later"), "id", "origin")).alias("first")
    kept = both.groupBy(key[0].alias("question_number"), key[1].alias("corp"), key[2].alias("year")).agg(first)
    return kept.select("question_number", "corp", "year", F.col("first.id").alias("id"), F.col("first.origin").alias("origin"))


def narrowed(questions: DataFrame, subject: str | None = None, topic: str | None = None, grade: int | None = None) -> DataFrame:
    """Candidates of a scope; one is left out only where its own value is set and differs."""
    out = questions
    for c, v in (("subject", subject), ("topic", topic)):
        if v:
            out = out.filter(F.col(c).isNull() | (F.col(c) == "") | (F.col(c) == v))
    return out.filter(F.col("grade").isNull() | (F.col("grade").cast("string") == str(grade))) if grade else out


def budgeted(entries: DataFrame, group: str, order: str, text: str, most: int = 60, budget: int = 6000) -> DataFrame:
    """Of each group the first `most` entries while their texts' lengths sum to `budget` at most; one at least."""
    inside = Window.partitionBy(group).orderBy(order)
    ranked = entries.withColumn("place", F.row_number().over(inside)).filter(F.col("place") <= most)
    upto = F.sum(F.length(text)).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return ranked.withColumn("used", upto).filter((F.col("place") == 1) | (F.col("used") <= budget))


def summary_of(pool: Column, most: int = 25, clip: int = 160) -> Column:
    """The first candidates of an array, their texts cut."""
    return F.transform(F.slice(pool, 1, most), lambda c: c.withField("text", F.substring(c["text"], 1, clip)))


def parsed_numbers(df: DataFrame) -> DataFrame:
    return df.withColumn("number", parse_number(F.col("question_number")))
