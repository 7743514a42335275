"""Column functions for JSON lists, answer options and what an explanation says about them."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from lectern.functions.text import latin_digits, norm_text, page_number

OPTION = "struct<label:string,text:string>"
_SPLIT = StructType().add("stem", StringType()).add("options", ArrayType(StructType().add("label", StringType()).add("text", StringType())))
#: Field names of an option's object.
_FIELDS = ", ".join(f"{n} string" for n in ("label", "option_label", "key", "text", "option_text", "value", "content"))
#: Signs that part a label from its option text.
_PART = r"[).:ـ]"
# The printed labels of an option, by its place.
LABELS = [["1", "الف", "ا"], ["2", "ب"], ["3", "ج"], ["4", "د"], ["5", "ه"], ["6", "و"]]


def json_list(text: Column, element: str = "string") -> Column:
    """The elements of a JSON array; empty for anything else. Objects stay as JSON text where `element` is string."""
    return F.coalesce(F.from_json(text, f"array<{element}>"), F.expr(f"cast(array() as array<{element}>)"))


def first_object(reply: Column) -> Column:
    """The object of a model's reply: what a code fence holds, else from the first { to the last }; null if it is no JSON."""
    fenced = F.split(reply, "```(?:json)?", -1)
    inner = F.when(F.size(fenced) >= 3, F.get(fenced, F.lit(1))).otherwise(reply)
    start = F.instr(inner, "{")
    length = F.length(inner) - F.instr(F.reverse(inner), "}") + 2 - start
    body = F.when((start > 0) & (length > 1), F.substring(inner, start, length))
    return F.when(F.try_parse_json(body).isNotNull(), body)


def normalize_options(raw: Column, digits: bool = False) -> Column:
    """array<struct<label,text>> from a JSON list of strings, objects (several field names) and other values.

    'label) text' strings are parted, the label defaults to the 1-based place. With `digits` labels are in 0-9 and
    texts have single blanks.
    """

    # Each element is parsed once; the second lambda's variable holds what the first one made.
    def parse(x: Column, i: Column) -> Column:
        return F.struct(x.alias("raw"), F.when(x.startswith("{"), F.from_json(x, _FIELDS)).alias("fields"), F.split(x, _PART, 2).alias("halves"), (i + 1).cast("string").alias("place"))

    def read(e: Column) -> Column:
        field = lambda *names: F.coalesce(*[e["fields"][n] for n in names])
        name, is_object = F.trim(F.get(e["halves"], F.lit(0))), e["raw"].startswith("{")
        named = (F.size(e["halves"]) == 2) & F.length(name).between(1, 3)
        label = F.when(is_object, F.coalesce(field("label", "option_label", "key"), e["place"])).when(named, name).otherwise(e["place"])
        text = F.when(is_object, F.coalesce(field("text", "option_text", "value", "content"), F.lit(""))).when(named, F.trim(F.get(e["halves"], F.lit(1)))).otherwise(F.trim(e["raw"]))
        return F.struct((latin_digits(label) if digits else label).alias("label"), (norm_text(text) if digits else text).alias("text"))

    return F.transform(F.transform(json_list(raw), parse), read)


def polished_options(raw: Column) -> Column:
    """As `normalize_options` with digits, without options that have no text; the others keep their labels."""
    return F.filter(normalize_options(raw, digits=True), lambda o: o["text"] != "")


# --- options printed in the text ---------------------------------------------------------------------------

#: A choice's number where it stands alone: opened by a bracket, or closed by a sign.
_NUMBER = re.compile(r"(?<!\S)(?:[(\[]\s*(\d{1,2})\s*[)\]]?(?=\s)|(\d{1,2})\s*(?:[)\]]|[.:،ـ-](?=\s)))")


def printed_choices(text: str) -> tuple[str, list[str]]:
    """(stem, choices): the choices are what stands between the numbers 1, 2, 3, ... of a text, two at least."""
    marks = []
    for m in _NUMBER.finditer(text):
        if int(m[1] or m[2]) == len(marks) + 1:
            marks.append(m)
    if len(marks) < 2:
        return text, []
    ends = [m.start() for m in marks[1:]] + [len(text)]
    choices = [" ".join(text[m.end() : end].split()) for m, end in zip(marks, ends)]
    return (text[: marks[0].start()].strip(), choices) if all(choices) else (text, [])


@F.pandas_udf(_SPLIT)
def split_options(texts: pd.Series) -> pd.DataFrame:
    """struct<stem, options>: the choices printed in a text and what stands before them; null is the empty text.

    Fewer than two choices leave the text whole. Options are numbered from 1.
    """
    found = [printed_choices(x or "") for x in texts]
    options = [[{"label": str(k + 1), "text": c} for k, c in enumerate(choices)] for _, choices in found]
    return pd.DataFrame({"stem": [stem for stem, _ in found], "options": options})


def _says_only_its_label(option: Column) -> Column:
    """Whether an option's text holds no sign but the number that is its label, however often."""
    numbers = F.regexp_extract_all(latin_digits(option["text"]), F.lit("([0-9]+)"), F.lit(1))
    other = option["text"].rlike(r"[\p{L}\p{Sc}]|[^\p{Nd}\s\p{P}ـ]")
    return ~other & F.forall(numbers, lambda x: x == latin_digits(F.trim(option["label"])))


def clean_options(raw: Column, text: Column) -> Column:
    """struct<stem, options>: choices in the text win; a list of bare labels is no list; else the list stands."""
    printed, listed = split_options(text), normalize_options(raw)
    none = F.expr(f"cast(array() as array<{OPTION}>)")
    kept = F.struct(F.coalesce(text, F.lit("")).alias("stem"), F.when(F.forall(listed, _says_only_its_label), none).otherwise(listed).alias("options"))
    return F.when(F.size(printed["options"]) > 0, printed).otherwise(kept)


def clean_label(label: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(latin_digits(F.coalesce(label, F.lit("")))), r"^[()\[\]\-.]+|[()\[\]\-.]+$", ""))


def _place_of(label: Column) -> Column:
    """The 1-based place that a printed label stands for, else null."""
    places = F.create_map(*[F.lit(x) for i, names in enumerate(LABELS, 1) for n in names for x in (n, i)])
    return F.try_element_at(places, label)


def _spelling(label: Column) -> Column:
    """One form for all spellings of a label: its place if it stands for one, else the label."""
    return F.get(F.transform(F.array(clean_label(label)), lambda c: F.struct(c.alias("clean"), F.coalesce(_place_of(c).cast("string"), c).alias("form"), _place_of(c).alias("place"))), F.lit(0))


def option_text(options: Column, label: Column) -> Column:
    """The text of the option with this label, in any of its spellings; else of the option at its place."""

    def found(x: Column) -> Column:
        at = F.array_position(F.transform(x["options"], lambda o: _spelling(o["label"])["form"]), x["want"]["form"])
        hit = F.when(at > 0, F.get(x["options"], at.cast("int") - 1)["text"])
        return F.when(x["want"]["clean"] != "", F.coalesce(hit, F.get(x["options"], x["want"]["place"] - 1)["text"]))

    # An array of one element: what is wanted is cleaned once, not for every option.
    return F.get(F.transform(F.array(F.struct(options.alias("options"), _spelling(label).alias("want"))), found), F.lit(0))


def text_of_label(options: Column, label: Column) -> Column:
    return F.get(F.filter(options, lambda o: o["label"] == label), F.lit(0))["text"]


def label_of_text(options: Column, text: Column) -> Column:
    return F.get(F.filter(options, lambda o: o["text"] == text), F.lit(0))["label"]


def named_in(options: Column, explanation: Column, least: int = 10) -> Column:
    """The one option whose text, of more than `least` characters, stands in the explanation; null for none or several."""
    said = norm_text(explanation)
    hits = F.filter(options, lambda o: (F.length(norm_text(o["text"])) > least) & F.contains(said, norm_text(o["text"])))
    return F.when(F.size(hits) == 1, F.get(hits, F.lit(0)))


# --- the correct option by its explanation ------------------------------------------------------------------

# The review heading, a mention of an option, words that assert it and the one that denies.
HEADING = r"بررسی\s*سایر\s*گزینه[‌ه]?\s*ها?"
MENTION = r"گزینه[\s‌ٔ]*(?:[(\[{]\s*)?([۰-ۿ0-9]{1,3})(?:\s*[)\]}])?"
ASSERTS = ["صحیح", "صحيحة", "درست", "پاسخ"]
DENIES = "نادرست"


def derive_label(explanation: Column, stored: Column, options: Column) -> Column:
    """struct<status, derived, current>: the option that an explanation leaves as the correct one.

    Behind the review heading every option named is wrong unless a word of `ASSERTS` stands within 30 characters
    before it or 15 after; the one option left is the answer. Without a heading one assertion and no wrong
    option are needed. status is ok, fill, mismatch or inconclusive.
    """
    labels = F.array_distinct(F.transform(options, lambda o: F.trim(latin_digits(o["label"]))))
    text = norm_text(explanation)
    current = F.nullif(F.trim(latin_digits(F.coalesce(stored, F.lit("")))), F.lit(""))
    headed = text.rlike(HEADING)
    section = F.when(headed, F.get(F.split(text, HEADING, 2), F.lit(1))).otherwise(text)
    gaps, whole = F.split(section, MENTION, -1), F.regexp_extract_all(section, F.lit(MENTION), F.lit(0))
    named = F.regexp_extract_all(section, F.lit(MENTION), F.lit(1))
    total = lambda parts: F.aggregate(parts, F.lit(0), lambda n, x: n + F.length(x))

    def mention(label: Column, i: Column) -> Column:
        start = total(F.slice(gaps, F.lit(1), i + 1)) + total(F.slice(whole, F.lit(1), i))
        end = start + F.length(F.get(whole, i))
        before = F.substring(section, F.greatest(start - 30, F.lit(0)) + 1, F.least(start, F.lit(30)))
        around = [F.regexp_replace(x, DENIES, "") for x in (before, F.substring(section, end + 1, F.lit(15)))]
        asserted = F.lit(False)
        for word in ASSERTS:
            asserted = asserted | around[0].contains(word) | around[1].contains(word)
        return F.struct(latin_digits(label).alias("label"), asserted.alias("asserted"))

    found = F.filter(F.transform(named, mention), lambda m: F.array_contains(labels, m["label"]))
    wrong = F.array_distinct(F.filter(found, lambda m: ~m["asserted"])["label"])
    asserted = F.filter(found, lambda m: m["asserted"])["label"]
    left = F.array_except(labels, wrong)
    last = F.element_at(F.when(F.size(asserted) > 0, asserted), -1)
    by_review = F.when((F.size(left) == 1) & (last.isNull() | (last == F.get(left, F.lit(0)))), F.get(left, F.lit(0)))
    by_word = F.when((F.size(wrong) == 0) & (F.size(asserted) == 1), F.get(asserted, F.lit(0)))
    usable = (text != "") & (F.size(options) >= 2) & (F.size(found) > 0)
    derived = F.when(usable, F.when(headed, by_review).otherwise(by_word))
    status = F.when(derived.isNull(), "inconclusive").when(current.isNull(), "fill").when(current == derived, "ok").otherwise("mismatch")
    return F.struct(status.alias("status"), derived.alias("derived"), current.alias("current"))


# --- replies of several pages --------------------------------------------------------------------------------


def split_pages(reply: Column, pages: Column, key: str = "questions") -> Column:
    """array<struct<page, item>>: the items of a JSON reply with the page that each belongs to.

    Four shapes are read, the first with items wins: a list of page blocks, an object of page blocks, a flat list
    of items with pages, and page blocks at the top. An item without a wanted page goes to the page of a
    one-page request and else is dropped. Items that are no objects are dropped.
    """
    at = lambda x, path: F.get_json_object(x, path)
    objects = lambda x: F.filter(json_list(x), lambda y: y.startswith("{"))
    empty = F.expr("cast(array() as array<struct<page:int,item:string>>)")

    def block(body: Column, label: Column) -> Column:
        page = page_number(F.coalesce(at(body, "$.page"), label))
        items = F.transform(objects(at(body, f"$.{key}")), lambda i: F.struct(page.alias("page"), i.alias("item")))
        return F.when(F.array_contains(pages, page), items).otherwise(empty)

    def entries(text: Column) -> Column:
        return F.map_entries(F.coalesce(F.from_json(text, "map<string,string>"), F.expr("cast(map() as map<string,string>)")))

    held = at(reply, "$.pages")
    listed = F.flatten(F.transform(objects(held), lambda b: block(b, F.lit(None).cast("string"))))
    keyed = F.flatten(F.transform(F.when(held.startswith("{"), entries(held)).otherwise(entries(F.lit("{}"))), lambda e: block(e["value"], e["key"])))
    one = F.when(F.size(pages) == 1, F.get(pages, F.lit(0)))

    def placed(item: Column) -> Column:
        page = page_number(at(item, "$.page"))
        return F.struct(F.when(F.array_contains(pages, page), page).otherwise(one).cast("int").alias("page"), item.alias("item"))

    flat = F.filter(F.transform(objects(at(reply, f"$.{key}")), placed), lambda x: x["page"].isNotNull())
    top = F.flatten(F.transform(F.filter(entries(reply), lambda e: ~e["key"].isin(key, "pages") & e["value"].startswith("{")), lambda e: block(e["value"], e["key"])))
    chosen = top
    for shape in (flat, keyed, listed):
        chosen = F.when(F.size(shape) > 0, shape).otherwise(chosen)
    return F.coalesce(chosen, empty)
