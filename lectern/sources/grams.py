"""Search for a text anywhere in the rows of a store's table, with postings of three-letter strings for each file.

The postings are a table of the store too, in the order of their strings, so those of one string are a key range. A
search intersects the files of its pattern's strings, the rarest first, and reads only files that may hold a match;
there the pattern decides. Files that were written since the index was brought up to date are always read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators import writes
from lectern.sources.store import Store, Transaction

#: Letters of one string.
LETTERS = 3
#: Between a string and a file in a posting's key, and above all files there.
_SPLIT, _END = "\t", "￿"


@dataclass
class Found:
    rows: DataFrame
    read: int
    of: int


def _name(table: str) -> str:
    return f"grams-{table}"


def grams_of(text: Column) -> Column:
    """The strings of `LETTERS` letters in a text, lower-cased, as a set."""
    lower = F.lower(text)
    at = F.sequence(F.lit(1), F.length(lower) - (LETTERS - 1))
    return F.when(F.length(lower) >= LETTERS, F.array_distinct(F.transform(at, lambda i: F.substr(lower, i, F.lit(LETTERS))))).otherwise(F.array().cast("array<string>"))


def update_index(store: Store, table: str, skip: tuple[str, ...] = ()) -> int:
    """Add postings for the table's files that have none, publish them, and return how many files these were."""
    txn = store.begin()
    files = {f[0] for f in txn.table(table).files}
    new = files - _indexed(store, txn, table) if _name(table) in txn.lists else files
    rows = txn.store.frame(txn.table(table), [f for f in txn.table(table).files if f[0] in new])
    if new:
        columns = [c for c in rows.columns if c not in skip]
        path = F.concat(F.lit("data/"), F.substring_index("_metadata.file_path", "/data/", -1)).alias("file")
        texts = rows.select(path, F.explode(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])).alias("text"))
        grams = texts.select("file", F.explode(grams_of(F.col("text"))).alias("gram")).distinct()
        marks = store.spark.createDataFrame([(f, "") for f in sorted(new)], "file string, gram string")
        keys = grams.union(marks).select(F.concat("gram", F.lit(_SPLIT), "file").alias("posting"))
        if _name(table) in txn.lists:
            txn.merge(_name(table), keys, lambda old, more: writes.merge(old, more, "posting", {}))
        else:
            txn.put(_name(table), keys, "posting")
        txn.publish()
    return len(new)


def _files(store: Store, txn: Transaction, table: str, gram: str) -> DataFrame:
    """(file): where a string occurs."""
    postings = txn.table(_name(table))
    low, high = gram + _SPLIT, gram + _SPLIT + _END
    rows = store.frame(postings, [f for f in postings.files if f[2] >= low and f[1] <= high])
    return rows.filter(F.col("posting").between(low, high)).select(F.substring_index("posting", _SPLIT, -1).alias("file"))


def _indexed(store: Store, txn: Transaction, table: str) -> set[str]:
    return {r["file"] for r in _files(store, txn, table, "").collect()}


def stretches(pattern: str) -> list[str]:
    """The parts of a LIKE pattern between its wildcards."""
    out, at = [""], 0
    while at < len(pattern):
        if pattern[at] == "\\" and at + 1 < len(pattern):
            at += 1
            out[-1] += pattern[at]
        elif pattern[at] in "%_":
            out.append("")
        else:
            out[-1] += pattern[at]
        at += 1
    return [x for x in out if x]


def matches(columns: list[str], pattern: str) -> Column:
    """Whether any of the columns holds the pattern, whatever its case; % and _ are wildcards."""
    return reduce(Column.__or__, [F.coalesce(F.col(c).cast("string").ilike(f"%{pattern}%"), F.lit(False)) for c in columns])


def search(store: Store, table: str, pattern: str, skip: tuple[str, ...] = ()) -> Found:
    """The rows in which any column but those of `skip` holds the pattern; how many files were read, of how many.

    The driver holds names of files only. A pattern without a stretch of `LETTERS` letters reads all files. The index
    has to be made with the same `skip`, or a smaller one.
    """
    txn = store.begin()
    held = txn.table(table)
    files = {f[0] for f in held.files}
    wanted = {s[i : i + LETTERS] for part in stretches(pattern) for s in [part.lower()] for i in range(len(s) - LETTERS + 1)}
    if wanted and _name(table) in txn.lists:
        indexed = _indexed(store, txn, table)
        sizes = {g: _files(store, txn, table, g).count() for g in wanted}
        left = files & indexed
        for g in sorted(wanted, key=lambda g: (sizes[g], g)):
            if not left:
                break
            left &= {r["file"] for r in _files(store, txn, table, g).collect()}
        files = left | (files - indexed)
    rows = store.frame(held, [f for f in held.files if f[0] in files])
    columns = [c for c in rows.columns if c not in skip]
    return Found(rows.filter(matches(columns, pattern)), len(files), len(held.files))
