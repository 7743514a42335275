"""License scans: exact phrases, and an exact containment join of text blocks with license templates.

Everything is DataFrame and SQL functions. Blocks are the lines of a text and its paragraphs (stretches between
blank lines, so a wrapped notice is one block); a block meets a template when it holds at least `threshold` of the
template's distinct words. The templates' words are ordered by how many texts of the whole corpus hold them, rarest
first, and a block's words that stand in any template are put into that order. A block of m such words meets a
template of n words and need = ceil(t n) only if m >= need (length), their first shared word is among the
template's first n - need + 1 and the block's first m - need + 1 (prefixes), and as many words as are needed are
left from its place on, on either side (position). What is left is verified exactly.

A template of fewer than `SHORT` words has to be met whole, and the words that name a license are needed in any case:
a notice about another license differs from a short template in just these.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# License notices by label, as templates of the containment join.
TEMPLATES = [
    ("gpl", "this work is licensed under the gnu general public license version"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("apache", "licensed under the apache license version"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("cc-by", "licensed under cc by"),
    ("cc-by", "this work is licensed under a creative commons attribution international license"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    # The paragraphs that license files and headers print whole.
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("proprietary", "all rights reserved no part of this publication may be reproduced without permission"),
]

#: Words under which a template has to be met whole.
SHORT = 10
#: Words that tell licenses apart; a block has to hold those that its template holds.
NAMES = {"gnu", "apache", "cc", "by", "creative", "commons", "attribution", "mit", "mozilla"}

#: Word characters of a raw text (A-Z are lower-cased after the match), and what parts words.
_IN, _OUT = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z alone; other letters stay as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(text), F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"), F.lit(1))


def _anywhere(phrases: list[str]) -> str:
    """A case-blind pattern for texts that hold one of the phrases as whole words."""
    inner = "|".join(f"{_OUT}+".join(p.split()) for p in phrases)
    return f"(?i)(?<!{_IN})(?:{inner})(?!{_IN})"


def _places(phrase: list[str], label: str) -> Column:
    """The (at, label) of each place in the word array `w` where the phrase's words stand in a row."""

    def mark(word: Column, i: Column) -> Column:
        fits = word == phrase[0]
        for k, other in enumerate(phrase[1:], 1):
            fits &= F.get(F.col("w"), i + k) == other
        return F.when(fits, i)

    marks = F.filter(F.transform("w", mark), lambda i: i.isNotNull())
    return F.coalesce(F.transform(marks, lambda i: F.struct(i.cast("long").alias("at"), F.lit(label).alias("label"))), F.expr("cast(array() as array<struct<at:bigint,label:string>>)"))


def scan_phrases(docs: DataFrame, phrases: dict[str, str] = PHRASES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, n_base, first_word, last_word, base (array of labels, distinct, sorted).

    A null text counts as empty. Words are only listed for texts that a case-blind pattern finds to hold a phrase.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    hits = F.when(text.rlike(_anywhere(list(phrases))), words_of(text))
    found = docs.select(F.col(f"`{id_col}`").alias("id"), F.regexp_count(text, F.lit(f"{_IN}+")).cast("long").alias("n_words"), hits.alias("w"))
    places = [_places(phrase.split(), label) for phrase, label in phrases.items()]
    found = found.withColumn("p", F.concat(*places))
    return found.select(
        "id", "n_words", F.size("p").cast("long").alias("n_base"), F.array_min("p.at").alias("first_word"), F.array_max("p.at").alias("last_word"),
        F.array_sort(F.array_distinct("p.label")).alias("base"),
    ).withColumnRenamed("id", id_col)


def blocks_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, block): every line and every paragraph of every text, equal ones of a text once."""
    text = F.col(f"`{text_col}`")
    blocks = F.array_distinct(F.concat(F.split(text, "\n"), F.split(text, r"\n[ \t\r\f\x0B]*\n")))
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.explode(blocks).alias("block"))


def template_rows(docs: DataFrame, templates: list[tuple[str, str]], threshold: float, text_col: str) -> tuple[list[dict], list[str]]:
    """(templates with their words in global frequency order, all their words in it): rarest first, ties by the word."""
    vocabulary = sorted({w for _, t in templates for w in t.split()})
    text = F.col(f"`{text_col}`")
    counted = docs.select(F.explode(F.array_intersect(F.array(*map(F.lit, vocabulary)), words_of(text))).alias("w")).groupBy("w").count()
    frequency = {r["w"]: r["count"] for r in counted.collect()}  # at most one row per word of the templates
    rows = []
    for k, (label, text) in enumerate(templates):
        words = sorted(set(text.split()), key=lambda w: (frequency.get(w, 0), w))
        need = len(words) if len(words) < SHORT else math.ceil(threshold * len(words) - 1e-9)
        rows.append({"template": k, "label": label, "words": words, "need": need, "prefix": words[: len(words) - need + 1], "names": [w for w in words if w in NAMES]})
    return rows, sorted(vocabulary, key=lambda w: (frequency.get(w, 0), w))


def join_templates(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All pairs of a block and a template that it meets: id, block, template, label, containment (0 to 1).

    A block meets a template with `threshold` of its words, all of them if it has fewer than `SHORT`, and with those
    of `NAMES` in it. A block that occurs in several rows gives rows for each; null and empty texts give none. The templates are a
    small parameter and travel as literals.
    """
    if not templates:
        raise ValueError("templates is empty")
    rows, order = template_rows(docs, templates, threshold, text_col)
    shortest = min(r["need"] for r in rows)
    prefixes = sorted({w for r in rows for w in r["prefix"]})
    candidates = docs.filter(F.col(f"`{text_col}`").rlike(_anywhere(prefixes)))
    blocks = blocks_of(candidates, id_col, text_col)
    # The block's words that stand in a template, in the global order.
    known = blocks.withColumn("words", F.array_intersect(F.array(*map(F.lit, order)), words_of(F.col("block")))).filter(F.size("words") >= shortest)
    index = docs.sparkSession.createDataFrame(
        [(w, i, r["template"], r["label"], r["words"], r["need"], r["names"]) for r in rows for i, w in enumerate(r["prefix"])],
        "w string, place int, template int, label string, template_words array<string>, need int, names array<string>",
    )
    first = F.slice("words", F.lit(1), F.size("words") - shortest + 1)
    probes = known.select("id", "block", "words", F.posexplode(first).alias("at", "w"))
    left = (F.size("words") - F.col("at") >= F.col("need")) & (F.size("template_words") - F.col("place") >= F.col("need"))
    pairs = probes.join(F.broadcast(index), "w").filter(left)
    # A pair is kept at its first shared word alone, so no pair comes twice and none needs a distinct.
    shared = F.array_intersect("template_words", "words")
    pairs = pairs.withColumn("shared", shared).filter((F.size("shared") >= F.col("need")) & (F.element_at("shared", 1) == F.col("w")) & (F.size(F.array_except("names", "words")) == 0))
    return pairs.select("id", "block", "template", "label", (F.size("shared") / F.size("template_words")).alias("containment")).withColumnRenamed("id", id_col)


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    labels holds the phrases' labels and those of the templates met; score is the greatest containment of a
    template met, 1 where a phrase stands, else 0. Labels belong to a text, which its hash stands for, so null
    and repeated ids get those of their own row. Null texts are empty, and an empty table gives no rows.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.xxhash64(F.col(f"`{text_col}`")).alias("digest"))
    base = scan_phrases(rows.withColumn("both", F.struct("id", "digest")), id_col="both").select("both.*", "n_words", "n_base", "first_word", "last_word", "base")
    met = join_templates(rows, templates, threshold, "digest").groupBy("digest").agg(F.collect_set("label").alias("met"), F.max("containment").alias("best"))
    out = base.join(met, "digest", "left")
    return out.select(
        F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("base", F.coalesce("met", F.expr("cast(array() as array<string>)"))))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
