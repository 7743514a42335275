"""Column functions for digits, numbers, spelling keys and identities.

Everything is a built-in expression, so it stays in code generation and is null-safe: a null in gives a null
out unless a docstring says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

# The digits of the three scripts, in order.
LATIN = "0123456789"
PERSIAN = "۰۱۲۳۴۵۶۷۸۹"
ARABIC = "٠١٢٣٤٥٦٧٨٩"
# Grade names and their numbers.
GRADE_WORDS = {"دهم": 10, "یازدهم": 11, "دوازدهم": 12}
# Letters that count as one another in a spelling key; the hamza is dropped.
FOLD_FROM = "يكىآأإٱةؤء"
FOLD_TO = "یکیااااهو"
# Zero-width and bidirectional marks that a spelling key ignores, besides white space.
UNSEEN = "\u200b-\u200f\u202a-\u202e"

#: Unicode white space as Python splits at it.
SPACE = r"(?U)[\s\x1c-\x1f]+"


def latin_digits(text: Column) -> Column:
    """Persian and Arabic-Indic digits as 0-9."""
    return F.translate(text, PERSIAN + ARABIC, LATIN + LATIN)


def persian_digits(text: Column) -> Column:
    """0-9 and Arabic-Indic digits as Persian ones."""
    return F.translate(text, LATIN + ARABIC, PERSIAN + PERSIAN)


def norm_text(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends; null becomes the empty text."""
    return F.trim(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACE, " "))


def blank_to_null(text: Column) -> Column:
    return F.when(F.trim(text) != "", text)


def parse_number(value: Column) -> Column:
    """The number a text spells in any of the digit sets, as a double; null if it spells none."""
    text = F.trim(latin_digits(value.cast("string")))
    plain = F.regexp_replace(text, "(?<=[0-9])_(?=[0-9])", "")
    return F.coalesce(plain.try_cast("bigint").cast("double"), plain.try_cast("double"))


def parse_grade(value: Column) -> Column:
    """1 to 12 from digits or a grade name, else null."""
    text = norm_text(latin_digits(value.cast("string")))
    digits = F.when(text.rlike("^[0-9]+$"), text.try_cast("int"))
    named = F.lit(None).cast("int")
    for word, number in GRADE_WORDS.items():
        named = F.when(text == word, number).otherwise(named)
    return F.when(digits.between(1, 12), digits).when(digits.isNull(), named)


def norm_scalar(value: Column) -> Column:
    """A comparable form: 12, 12.0 and their Persian spelling are all '12'; other text is folded; '' is null."""

    def read(digits: Column) -> Column:
        plain = F.regexp_replace(F.trim(digits), "(?<=[0-9])_(?=[0-9])", "")
        number = F.coalesce(plain.try_cast("bigint").cast("double"), plain.try_cast("double"))
        return F.struct(F.nullif(F.lower(norm_text(digits)), F.lit("")).alias("text"), number.alias("number"))

    def say(x: Column) -> Column:
        whole = (x["number"] == F.floor(x["number"])) & (F.abs(x["number"]) < 1e15)
        return F.when(whole, x["number"].cast("bigint").cast("string")).when(x["number"].isNotNull(), x["number"].cast("string")).otherwise(x["text"])

    # Arrays of one element: a lambda's variable is computed once, however often it is used.
    return F.get(F.transform(F.transform(F.array(latin_digits(value.cast("string"))), read), say), F.lit(0))


def with_norms(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """`df` with the comparable forms (`norm_scalar`) of columns, each under a new name: {new name: column}.

    The steps are columns one after another, so each is computed once, in generated code. Whole numbers need none.
    """
    kinds = {n: df.schema[c].dataType for n, c in names.items()}
    whole = {n: c for n, c in names.items() if isinstance(kinds[n], (ByteType, ShortType, IntegerType, LongType))}
    spelled = {n: c for n, c in names.items() if n not in whole}
    step = lambda n, k: f"{n}__{k}"
    as_number = lambda x: F.when(F.abs(x) < 1e15, x.cast("bigint").cast("string")).otherwise(x.cast("double").cast("string"))
    out = df.withColumns({n: as_number(F.col(c)) for n, c in whole.items()} | {step(n, 0): latin_digits(F.col(c).cast("string")) for n, c in spelled.items()})
    out = out.withColumns({step(n, 1): F.regexp_replace(F.trim(F.col(step(n, 0))), "(?<=[0-9])_(?=[0-9])", "") for n in spelled})
    out = out.withColumns({step(n, 2): F.coalesce(F.col(step(n, 1)).try_cast("bigint").cast("double"), F.col(step(n, 1)).try_cast("double")) for n in spelled})
    for n in spelled:
        x, folded = F.col(step(n, 2)), F.nullif(F.lower(norm_text(F.col(step(n, 0)))), F.lit(""))
        exact = (x == F.floor(x)) & (F.abs(x) < 1e15)
        out = out.withColumn(n, F.when(exact, x.cast("bigint").cast("string")).when(x.isNotNull(), x.cast("string")).otherwise(folded))
    return out.drop(*[step(n, k) for n in spelled for k in range(3)])


def match_number(value: Column) -> Column:
    """The whole part of the number a text spells; null for none, and for what is not finite."""
    number = F.trim(latin_digits(value.cast("string"))).try_cast("double")
    return F.when(F.abs(number) < 9e18, number.cast("bigint"))


def position_number(value: Column, position: Column) -> Column:
    """A printed number, or the 1-based position where it is missing or 0."""
    return F.coalesce(F.nullif(value.try_cast("int"), F.lit(0)), position.cast("int"))


def canonical_year(raw: Column) -> Column:
    """'1402-1403' from any spelling of one or two years: the distinct four-digit groups in order, two at most.

    Without such a group the remaining digits; without digits the empty text. Null gives the empty text.
    """
    text = F.trim(latin_digits(F.coalesce(raw.cast("string"), F.lit(""))))
    years = F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit("([0-9]{4})"), F.lit(1))))
    return F.when(F.size(years) > 0, F.concat_ws("-", F.slice(years, 1, 2))).otherwise(F.regexp_replace(text, "[^0-9]", ""))


def fold(value: Column) -> Column:
    """A spelling key: letter variants as one, no marks and no white space; null gives the empty text."""
    text = F.translate(F.coalesce(value.cast("string"), F.lit("")), FOLD_FROM, FOLD_TO)
    return F.regexp_replace(text, rf"(?U)[{UNSEEN}\s\x1c-\x1f]+", "")


def folder_of(rel_path: Column) -> Column:
    """The directory of a path, '/' or '\\' between its parts; null for a bare file name."""
    return F.nullif(F.regexp_replace(F.translate(rel_path, "\\", "/"), "/?[^/]*$", ""), F.lit(""))


def source_id(rel_path: Column) -> Column:
    """The identity of a source file: SHA-1 of its normalised path."""
    return F.sha1(F.ltrim(F.trim(F.translate(F.coalesce(rel_path, F.lit("")), "\\", "/")), F.lit("/")))


def record_id(source: Column, kind: str, number: Column, position: Column) -> Column:
    """<source>-q<number> or <source>-a<number>; the position stands in for a missing number."""
    return F.concat(source, F.lit(f"-{kind}"), F.coalesce(number.cast("string"), position.cast("string")))


def content_hash(text: Column) -> Column:
    return F.sha1(norm_text(text))


def key_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def object_name(url: Column, bucket: str = "[^/]+") -> Column:
    """The object path in a storage address, null for none or for the placeholder 'unknown'."""
    name = F.nullif(F.regexp_extract(url, rf"/storage/v1/object/(?:public/)?{bucket}/([^?]+)", 1), F.lit(""))
    return F.when(~name.rlike("(^|/)unknown$"), name)


def mask(secret: Column, keep: int = 4) -> Column:
    """The first and last characters of a secret alone; of a short one only the first."""
    long = F.concat(F.substring(secret, 1, keep), F.lit("…"), F.right(secret, F.lit(keep)))
    return F.when(F.length(secret) > 2 * keep, long).otherwise(F.concat(F.substring(secret, 1, 1), F.lit("…")))


def clip(text: Column, most: int) -> Column:
    """The first characters of a text, with an ellipsis where it was cut; null gives the empty text."""
    whole = F.coalesce(text, F.lit(""))
    return F.when(F.length(whole) > most, F.concat(F.substring(whole, 1, most), F.lit("…"))).otherwise(whole)


def iso_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def letters(text: Column) -> Column:
    """How many letters a text has; 1 for digits alone."""
    n = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\p{L}"))
    return F.when(n > 0, n).otherwise(F.coalesce(text, F.lit("")).rlike(r"\p{Nd}").cast("int"))


def page_number(label: Column) -> Column:
    """The page that a label names: its number, or else its first run of digits; true and false name none."""
    number = parse_number(label)
    found = F.regexp_extract(latin_digits(label), "([0-9]+)", 1).try_cast("int")
    return F.when(F.lower(label).isin("true", "false"), F.lit(None).cast("int")).otherwise(F.coalesce(number.try_cast("int"), found))


def natural_key(name: Column) -> Column:
    """A sort key by which runs of digits order as numbers and come before text."""
    parts = F.regexp_extract_all(F.lower(name), F.lit("([0-9]+|[^0-9]+)"), F.lit(1))

    def part(x: Column) -> Column:
        number = x.rlike("^[0-9]").cast("boolean")
        return F.struct((~number).alias("text_last"), F.when(number, x.try_cast("decimal(38,0)")).alias("number"), F.when(~number, x).alias("text"))

    return F.transform(parts, part)


# --- half-spaces -------------------------------------------------------------------------------------------

# Affixes that orthography parts from the stem, tried in this order.
PREFIXES = ["نمی", "می"]
SUFFIXES = ["هایی", "های", "ها", "ترین"]
# Words that begin with such a prefix as part of the stem.
WHOLE_MI = """
میان میانا میانجی میانجیگری میانگین میدان میدانی میدانگاه میانه
میر میرت میراث میرزا میرا میزان میز میزبان میزگرد میسل میگرن
میل میلاد میلی میلیارد میلیون میله میم میمند میهمان میوه
میگو میگویی میروم میرم میری میبینم میکنم میدهم میخورم
""".split()
# Words that end in such a suffix as part of the stem.
WHOLE_HA = "تنها رها بها گها نگاه شهادت گواهی همراه ماه راه گناه گیاه".split()

ZWNJ = "\u200c"
_FA = r"\u0621-\u064A\u066E-\u06D3\u06D5\u06FA-\u06FF\u200C\u200D"


def _part_affix(word: Column, affixes: list[str], whole: list[str], at_end: bool) -> Column:
    out = word
    for affix in reversed(affixes):
        n = len(affix)
        stem = F.left(word, F.length(word) - n) if at_end else F.substring(word, F.lit(n + 1), F.length(word))
        has = word.endswith(affix) if at_end else word.startswith(affix)
        parted = F.concat(stem, F.lit(ZWNJ + affix)) if at_end else F.concat(F.lit(affix + ZWNJ), stem)
        keep = (F.length(word) - n < 2) | stem.isin(whole)
        out = F.when(has, F.when(keep, word).otherwise(parted)).otherwise(out)
    return F.when(word.contains(ZWNJ) | word.isin(whole), word).otherwise(out)


def restore_zwnj(text: Column) -> Column:
    """Put the half-spaces back that the affixes above need; nothing else changes.

    A word of three letters or more is parted after its prefix, or else before its suffix.
    """
    tokens = F.regexp_extract_all(text, F.lit(f"([{_FA}]+|[^{_FA}]+)"), F.lit(1))

    def repair(token: Column) -> Column:
        parted = _part_affix(_part_affix(token, PREFIXES, WHOLE_MI, False), SUFFIXES, WHOLE_HA, True)
        return F.when((F.length(token) >= 3) & token.rlike(f"^[{_FA}]") & token.rlike(r"[\u0600-\u06FF]"), parted).otherwise(token)

    return F.array_join(F.transform(tokens, repair), "")


def missing_zwnj(text: Column) -> Column:
    return F.coalesce(restore_zwnj(text) != text, F.lit(False))
