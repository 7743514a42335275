"""Column functions over whole rows: missing values, required columns, tags, changes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The columns that a complete row has.
REQUIRED = {
    "question": ["id", "source_id", "question_number", "question_text", "options", "subject", "topic", "difficulty", "raw_ocr_text", "grade", "corp", "year"],
    "answer": ["id", "source_id", "question_number", "answer_explanation", "correct_option_label", "corp", "year", "difficulty", "subject", "topic", "grade", "raw_ocr_text"],
}
# Texts that count as nothing.
NOTHING = ["", "[]", "{}", "null"]


def is_missing(value: Column) -> Column:
    """Null, blank, or an empty JSON container."""
    return F.coalesce(F.trim(value.cast("string")).isin(NOTHING), F.lit(True))


def missing_columns(entity: str, present: list[str] | None = None) -> Column:
    """The names of the required columns that a row lacks; one outside `present` is lacking everywhere."""
    names = [F.when(is_missing(F.col(c)) if present is None or c in present else F.lit(True), F.lit(c)) for c in REQUIRED[entity]]
    return F.array_compact(F.array(*names))


def tags(*columns: str) -> Column:
    """The values that are neither null nor empty, in order."""
    return F.filter(F.array(*[F.col(c).cast("string") for c in columns]), lambda x: x.isNotNull() & (x != ""))


def question_type(own: Column, options: Column) -> Column:
    """A row's own type, else by whether it has options."""
    return F.coalesce(F.nullif(F.trim(own), F.lit("")), F.when(F.size(options) > 0, "mcq_single").otherwise("short_answer"))


def changed(pairs: dict[str, tuple[Column, Column]]) -> Column:
    """array<struct<field, before, after>> of the pairs (before, after) that differ."""
    entry = lambda f, b, a: F.when(~b.eqNullSafe(a), F.struct(F.lit(f).alias("field"), b.cast("string").alias("before"), a.cast("string").alias("after")))
    return F.array_compact(F.array(*[entry(f, b, a) for f, (b, a) in pairs.items()]))


def share(n: Column, total: Column) -> Column:
    """n of total in whole per cent, half up; 0 of nothing."""
    return F.when(total > 0, F.round(100 * n / total)).otherwise(0).cast("int")


def backoff(attempt: Column, base: float = 5.0, most: float = 120.0) -> Column:
    """The wait before a retry: doubling from `base`, `most` at the longest; attempts count from 1."""
    return F.least(F.lit(most), F.lit(base) * F.pow(F.lit(2.0), F.greatest(attempt, F.lit(1)) - 1))


def axis_step(largest: Column, ticks: int = 5) -> Column:
    """A round step (1, 2, 2.5 or 5 times a power of ten) that covers `largest` in `ticks` steps."""
    raw = largest / ticks
    power = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    unit = raw / power
    return F.when(largest > 0, power * F.when(unit <= 1, 1.0).when(unit <= 2, 2.0).when(unit <= 2.5, 2.5).when(unit <= 5, 5.0).otherwise(10.0)).otherwise(1.0)


def distinct_values(*columns: str) -> Column:
    """The values of a row's columns, each once, in order, nulls and blank ones left out."""
    values = F.array(*[F.col(c).cast("string") for c in columns])
    return F.array_distinct(F.filter(values, lambda x: x.isNotNull() & (F.trim(x) != "")))
