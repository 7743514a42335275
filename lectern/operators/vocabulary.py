"""The vocabulary: three dimensions read from one JSON document, checked, and looked up by folded spelling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import fold

SCHEMA = "subjects array<struct<tag:string,variants:array<string>>>, corps array<struct<tag:string,variants:array<string>>>, topics array<struct<subject:string,tag:string,variants:array<string>>>"
#: Variants that one tag may have.
MOST_VARIANTS = 200


def read(spark: SparkSession, path: str) -> DataFrame:
    """(kind, subject, tag, variants) of the document at `path`; what it lacks, or a document that is none, gives no rows."""
    raw = spark.read.schema(SCHEMA).option("multiLine", True).json(path)
    none = F.lit(None).cast("string").alias("subject")
    part = lambda kind, subject: raw.select(F.explode(kind).alias("x")).select(F.lit(kind).alias("kind"), subject, F.col("x.tag").alias("tag"), F.coalesce("x.variants", F.expr("cast(array() as array<string>)")).alias("variants"))
    return part("subjects", none).union(part("corps", none)).union(part("topics", F.col("x.subject").alias("subject")))


def normalised(vocabulary: DataFrame) -> DataFrame:
    """Trimmed variants, each once, in order, without empty ones."""
    clean = F.array_distinct(F.filter(F.transform("variants", lambda v: F.trim(v)), lambda v: v.isNotNull() & (v != "")))
    return vocabulary.withColumn("variants", clean)


def faults(vocabulary: DataFrame) -> DataFrame:
    """(kind, tag, fault) of rows without a tag, with too many variants, or whose topic names no subject."""
    subjects = vocabulary.filter("kind = 'subjects'").select(F.col("tag").alias("subject"), F.lit(True).alias("known"))
    fault = F.when(F.coalesce("tag", F.lit("")) == "", "no tag").when(F.size("variants") > MOST_VARIANTS, "too many variants").when((F.col("kind") == "topics") & F.col("known").isNull(), "unknown subject")
    return vocabulary.join(subjects.distinct(), "subject", "left").select("kind", "tag", fault.alias("fault")).filter("fault is not null")


def spellings(vocabulary: DataFrame, kind: str) -> DataFrame:
    """(fold_key, tag): each folded spelling of a kind once; of tags that share one the greatest stays."""
    named = vocabulary.filter(F.col("kind") == kind).select("tag", F.explode(F.concat(F.array("tag"), "variants")).alias("spelling"))
    return named.groupBy(fold(F.col("spelling")).alias("fold_key")).agg(F.max("tag").alias("tag")).filter("fold_key != ''")


def matched(df: DataFrame, column: str, spelled: DataFrame, out: str) -> DataFrame:
    """`df` with the tag of a column's spelling, null where none fits; the size of the vocabulary decides the join."""
    keyed = df.withColumn("fold_key", fold(F.col(column)))
    return keyed.join(spelled.withColumnRenamed("tag", out), "fold_key", "left").drop("fold_key")


def topics_of(vocabulary: DataFrame, subject: Column) -> DataFrame:
    return vocabulary.filter((F.col("kind") == "topics") & (F.col("subject") == subject)).select("tag").distinct()
