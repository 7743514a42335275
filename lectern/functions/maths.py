"""Column functions that bring TeX in text to one notation.

One scanner cuts a text into pieces, prose or math with its delimiters, counting braces where a group has to
close; every rule then works on pieces. The scanner is Python over Arrow batches, a text at a time.
"""

from __future__ import annotations

import re
import string
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from lectern.functions.text import ARABIC, LATIN, PERSIAN, restore_zwnj

_CLOSES = {"$$": "$$", "$": "$", "\\[": "\\]", "\\(": "\\)"}
_TO_LATIN = str.maketrans(PERSIAN + ARABIC, LATIN * 2)
_TO_PERSIAN = str.maketrans(LATIN + ARABIC, PERSIAN * 2)


def pieces(text: str) -> Iterator[tuple[str, str]]:
    """(opening delimiter, body) of each stretch of a text; prose has the delimiter "".

    An opening without its end is prose; a single $ ends on its own line.
    """
    begin = at = 0
    while at < len(text):
        if text[at] not in "$\\":
            at += 1
            continue
        opening = next((o for o in _CLOSES if text.startswith(o, at)), None)
        if opening is None:
            at += 2 if text[at] == "\\" else 1  # an escaped sign opens nothing
            continue
        start = at + len(opening)
        end = text.find(_CLOSES[opening], start)
        if end <= start or opening == "$" and "\n" in text[start:end]:
            at = start
            continue
        if begin < at:
            yield "", text[begin:at]
        yield opening, text[start:end]
        begin = at = end + len(_CLOSES[opening])
    if begin < len(text):
        yield "", text[begin:]


def group_end(text: str, at: int) -> int:
    """The end of the group that opens at `at`, whatever it holds; `at` itself if it never closes."""
    depth = 0
    for k in range(at, len(text)):
        depth += (text[k] == "{") - (text[k] == "}")
        if not depth:
            return k + 1
    return at


def in_pieces(text: str, math: Callable[[str], str], prose: Callable[[str], str] = lambda x: x) -> str:
    return "".join(f"{o}{math(body)}{_CLOSES[o]}" if o else prose(body) for o, body in pieces(text))


def around_macros(body: str, names: tuple[str, ...], inner: Callable[[str], str], outer: Callable[[str], str]) -> str:
    """Apply `inner` to the macros of these names with their groups, `outer` to what stands between them."""
    out, begin, at = [], 0, body.find("\\")
    while at >= 0:
        name = next((n for n in names if body.startswith(f"\\{n}{{", at)), None)
        end = group_end(body, at + len(name) + 1) if name else at
        if name and end > at + len(name) + 1:
            out += [outer(body[begin:at]), inner(body[at:end])]
            begin = end
        at = body.find("\\", max(end, at + 1))
    return "".join(out) + outer(body[begin:])


def _column(rule: Callable[[str], str]) -> Callable[[Column], Column]:
    """A rule on one text as a column function; null stays null."""

    @F.pandas_udf(StringType())
    def apply(texts: pd.Series) -> pd.Series:
        return texts.map(rule, na_action="ignore")

    return apply


# --- canonical delimiters -----------------------------------------------------------------------------------


def _is_letter_of_prose(sign: str) -> bool:
    return "؀" <= sign <= "ۿ" or "ݐ" <= sign <= "ݿ"


#: Signs that may stand in TeX anywhere: ASCII punctuation but what delimits, quotes, or marks names and clauses.
_OPERATORS = frozenset(string.punctuation) - frozenset("\\{}$") - frozenset("\"`") - frozenset("#@") - frozenset(".,;:")


def _atoms(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of each stretch that could be TeX: commands, closed groups, Latin words and numbers, operators."""
    at = 0
    while at < len(text):
        sign, end = text[at], at
        if sign == "\\":
            end = at + 1
            while end < len(text) and text[end].isascii() and text[end].isalpha():
                end += 1
            end = end if end > at + 1 else min(at + 2, len(text))
        elif sign == "{":
            end = group_end(text, at)
        elif sign.isascii() and sign.isalnum():
            while end < len(text) and text[end].isascii() and text[end].isalnum():
                end += 1
        elif sign in _OPERATORS:
            end = at + 1
        elif sign in ".,;:":
            around = text[max(at - 1, 0) : at + 2]
            end = at if any(map(_is_letter_of_prose, around)) else at + 1
        if end > at:
            yield at, end
        at = max(end, at + 1)


def fence(text: str) -> str:
    """Put $ around each run of atoms that holds a command, or an index or power; words at its edges stay outside."""
    runs: list[list[tuple[int, int]]] = []
    for a, b in _atoms(text):
        if runs and not text[runs[-1][-1][1] : a].strip(" \t"):
            runs[-1].append((a, b))
        else:
            runs.append([(a, b)])
    out, done = [], 0
    for run in runs:
        words = [text[a:b] for a, b in run]
        lone = [len(w) > 1 and w.isalpha() or w in ".,;:!?" for w in words]
        while run and lone[0]:
            del run[0], words[0], lone[0]
        while run and lone[-1]:
            del run[-1], words[-1], lone[-1]
        scripts = any(w in "_^" and (x[0] == "{" or x[0] == "\\" or x[0].isalnum()) for w, x in zip(words, words[1:]))
        if scripts or any(w[0] == "\\" and len(w) > 1 and w[1].isalpha() for w in words):
            out += [text[done : run[0][0]], "$", text[run[0][0] : run[-1][1]], "$"]
            done = run[-1][1]
    return "".join(out) + text[done:]


def _environments(text: str) -> str:
    """Displays around environments that stand in prose."""
    out, at = [], 0
    while (start := text.find("\\begin{", at)) >= 0:
        name = text[start + 7 : text.find("}", start) if "}" in text[start:] else len(text)]
        last = text.find(f"\\end{{{name}}}", start)
        if last < 0:
            break
        end = last + len(name) + 6
        out += [text[at:start], "$$", text[start:end], "$$"]
        at = end
    return "".join(out) + text[at:]


def _without_floats(text: str) -> str:
    """Tables as arrays; the float around them, and its centring, go."""
    for name in ("table", "tabular"):
        kept, parts = "" if name == "table" else "\\begin{array}", text.split(f"\\begin{{{name}}}")
        # An option in brackets right behind the opening goes with it.
        text = parts[0] + "".join(kept + (p[p.find("]") + 1 :] if p.startswith("[") and "]" in p else p) for p in parts[1:])
        text = text.replace(f"\\end{{{name}}}", "" if name == "table" else "\\end{array}")
    head, *rest = text.split("\\centering")
    return head + "".join(r.lstrip() if not r[:1].isalnum() else "\\centering" + r for r in rest)


def canonical_text(text: str) -> str:
    """One form of delimiters: $ for inline and $$ for display math, also around TeX that lost its own.

    Floats unwrap, tables become arrays, bare environments become displays, a $ inside a display goes, the last of
    an odd number of $$ becomes $, and displays of blanks are dropped. A second application changes nothing.
    """
    text = _without_floats(text)
    if text.count("$$") % 2:
        head, _, tail = text.rpartition("$$")
        text = f"{head}${tail}"
    if "\\begin{" in text:
        text = "".join(f"{o}{body}{_CLOSES[o]}" if o else _environments(body) for o, body in pieces(text))
    out = []
    for opening, body in pieces(text):
        if opening in ("$$", "\\["):
            bare = "".join(x for k, x in enumerate(body) if x != "$" or body[k - 1 : k] == "\\")
            out.append(f"$${bare}$$" if bare.strip() else "")
        elif opening:
            out.append(f"${body}$")
        else:
            out.append(fence(body) if any(x in body for x in "\\_^") else body)
    return "".join(out)


canonical_math = _column(canonical_text)


def clean_stored(text: Column) -> Column:
    """What is stored: canonical math, then half-spaces."""
    return restore_zwnj(canonical_math(text))


# --- notation inside math -----------------------------------------------------------------------------------

_STATES = ("(g)", "(l)", "(s)", "(aq)")


def _element(text: str, at: int) -> int:
    """The end of the element's letters that begin at `at`; `at` if none does."""
    if text[at : at + 1] not in string.ascii_uppercase or at >= len(text):
        return at
    return at + 1 + (text[at + 1 : at + 2].isascii() and text[at + 1 : at + 2].islower())


def _count(text: str, at: int) -> tuple[int, str]:
    """(end, digits) of an index of digits, in braces or not; (at, "") if there is none."""
    begin = at + 1 + (text[at + 1 : at + 2] == "{")
    end = begin
    while end < len(text) and text[end].isascii() and text[end].isdigit():
        end += 1
    closed = begin == at + 1 or text[end : end + 1] == "}"
    if text[at : at + 1] != "_" or end == begin or not closed:
        return at, ""
    return end + (begin > at + 1), text[begin:end]


def _goes_on(text: str, at: int, signs: str) -> bool:
    """Whether a word, or one of `signs`, stands right before `at`."""
    return at > 0 and (text[at - 1] in signs or text[at - 1].isascii() and text[at - 1].isalpha())


def _compounds(text: str) -> Iterator[tuple[int, int, list[tuple[str, str]]]]:
    """(start, end, [letters, count]) of each row of elements: two elements, or one with a count."""
    at = 0
    while at < len(text):
        end, elements, parts, open_letters = at, 0, [], ""
        while not _goes_on(text, at, "\\{_^") and (upto := _element(text, end)) > end:
            elements, open_letters = elements + 1, open_letters + text[end:upto]
            end, digits = _count(text, upto)
            if digits:
                parts.append((open_letters, digits))
                open_letters = ""
        if open_letters:
            parts.append((open_letters, ""))
        if elements > 1 or elements and parts[0][1]:
            yield at, end, parts
        at = max(end, at + 1)


def _bonds(text: str) -> str:
    """Elements joined by signs for bonds, upright as a whole."""
    out, at = [], 0
    while at < len(text):
        ends, end = [], at if _goes_on(text, at, "\\{") else _element(text, at)
        while end > at:
            ends.append(end)
            sign = end + len(text[end:]) - len(text[end:].lstrip())
            after = sign + 1 + len(text[sign + 1 :]) - len(text[sign + 1 :].lstrip())
            if text[sign : sign + 1] not in tuple("-=≡"):
                break
            end = _element(text, after)
            if end == after:
                break
        # A last element that a word, number or index follows is none.
        if ends and (text[ends[-1] : ends[-1] + 1] == "_" or text[ends[-1] : ends[-1] + 1].isascii() and text[ends[-1] : ends[-1] + 1].isalnum()):
            ends.pop()
        end = ends[-1] if len(ends) > 1 else at + 1
        out.append(f"\\mathrm{{{text[at:end]}}}" if len(ends) > 1 else text[at:end])
        at = end
    return "".join(out)


def _scripts(text: str) -> str:
    """Braces around each index of one sign."""
    out = list(text)
    for k in range(len(text) - 1):
        if text[k] == "_" and text[k + 1].isascii() and text[k + 1].isalnum():
            out[k + 1] = f"{{{text[k + 1]}}}"
    return "".join(out)


brace_subscripts = _column(lambda text: around_macros(text, ("mathrm",), _scripts, lambda x: x))


def _upright(body: str) -> str:
    """Compounds in upright letters with braced counts, and their states upright behind them; bonds upright."""
    out, at = [], 0
    for start, end, parts in _compounds(body):
        state = next((s for s in _STATES if body.startswith(s, end)), "")
        out.append(body[at:start])
        out += [f"\\mathrm{{{letters}}}" + (f"_{{{count}}}" if count else "") for letters, count in parts]
        out.append(f"\\mathrm{{{state}}}" if state else "")
        at = end + len(state)
    body = "".join(out) + body[at:]
    return around_macros(body, ("mathrm",), lambda x: x, _bonds)


def _notation(body: str) -> str:
    body = re.sub(rf"(?<=[{PERSIAN}])\s*[/٫]\s*(?=[{PERSIAN}])", ".", body).translate(_TO_LATIN)
    return around_macros(body, ("mathrm", "text"), lambda x: x, _upright)


#: Inside math: 0-9, a point for the Persian decimal slash, upright compounds and bonds.
normalise_math = _column(lambda text: in_pieces(text, _notation))


# --- polish -------------------------------------------------------------------------------------------------


def _coefficients(text: str) -> str:
    """Without underscores before a digit that is no index, that is, behind nothing an index could belong to."""
    kept = []
    for k, sign in enumerate(text):
        before = text[k - 1 : k]
        idle = sign == "_" and text[k + 1 : k + 2].isdecimal() and not (before and (before in ")}" or before.isascii() and before.isalnum()))
        kept.append("" if idle else sign)
    return "".join(kept)


def _bare(text: str) -> str:
    return "".join(f"{o}{body}{_CLOSES[o]}" if o else fence(body) for o, body in pieces(_environments(text)))


fix_coefficients = _column(_coefficients)
#: Delimiters around environments, commands, and indices or powers in prose.
wrap_bare = _column(_bare)
sanitize_math = _column(lambda text: _sanitized(text))
#: 0-9 inside math, Persian digits in prose.
digit_policy = _column(lambda text: _digits_by_kind(text))


def _sanitized(text: str) -> str:
    return in_pieces(text, _coefficients, lambda x: _bare(_coefficients(x)))


def _digits_by_kind(text: str) -> str:
    return in_pieces(text, lambda x: x.translate(_TO_LATIN), lambda x: x.translate(_TO_PERSIAN))


@F.pandas_udf(ArrayType(StringType()))
def polished_list(lists: pd.Series) -> pd.Series:
    """`sanitize_math` and `digit_policy` of each text of a list; Spark allows no Python inside `transform`."""
    return lists.map(lambda texts: [x and _digits_by_kind(_sanitized(x)) for x in texts], na_action="ignore")


def delimiters_balanced(text: Column) -> Column:
    """Whether $ come in pairs and the bracket delimiters match in number; null is balanced."""
    s = F.coalesce(text, F.lit(""))
    n = lambda x: (F.length(s) - F.length(F.replace(s, F.lit(x), F.lit("")))) / len(x)
    return (n("$") % 2 == 0) & (n(r"\[") == n(r"\]")) & (n(r"\(") == n(r"\)"))
