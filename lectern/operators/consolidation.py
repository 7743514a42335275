"""Consolidation of a legacy table into the one that stays: fill, prove, drop, all in one version or not at all."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators import writes
from lectern.sources.store import Report, Store


@dataclass
class Outcome:
    """The checks (name -> rows against it), whether all hold, the version that was published, and what the fill did to files."""

    checks: dict[str, int]
    version: int | None
    report: Report | None

    @property
    def holds(self) -> bool:
        return not any(self.checks.values())


def fills(base: DataFrame, legacy: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, columns): rows of `base` that lack a value which the legacy table has, with it."""
    old = legacy.select(F.col(key), *[F.col(c).alias(f"legacy_{c}") for c in columns])
    met = base.select(key, *columns).join(old, key)
    lacks = F.lit(False)
    for c in columns:
        lacks |= F.col(c).isNull() & F.col(f"legacy_{c}").isNotNull()
    return met.filter(lacks).select(key, *[F.coalesce(c, f"legacy_{c}").alias(c) for c in columns])


def parity(before: DataFrame, after: DataFrame, legacy: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(check, n): rows that went or came, legacy rows without a row, and for each column values lost and values left behind."""
    old = before.select(F.col(key).alias("k"), *[F.col(c).alias(f"old_{c}") for c in columns], F.lit(1).alias("was"))
    new = after.select(F.col(key).alias("k"), *[F.col(c).alias(f"new_{c}") for c in columns], F.lit(1).alias("now"))
    gone = legacy.select(F.col(key).alias("k"), *[F.col(c).alias(f"legacy_{c}") for c in columns], F.lit(1).alias("had"))
    both = old.join(new, "k", "full").join(gone, "k", "full")
    counts = [
        F.count_if(F.col("was").isNotNull() & F.col("now").isNull()).alias("rows_lost"), F.count_if(F.col("was").isNull() & F.col("now").isNotNull()).alias("rows_added"),
        F.count_if(F.col("had").isNotNull() & F.col("now").isNull()).alias("legacy_rows_without_a_row"),
    ]
    for c in columns:
        counts.append(F.count_if(F.col(f"old_{c}").isNotNull() & ~F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}"))).alias(f"lost_{c}"))
        counts.append(F.count_if(F.col("now").isNotNull() & F.col(f"new_{c}").isNull() & F.col(f"legacy_{c}").isNotNull()).alias(f"left_{c}"))
    names = [c for c in both.agg(*counts).columns]
    pairs = ", ".join(f"'{n}', `{n}`" for n in names)
    return both.agg(*counts).select(F.expr(f"stack({len(names)}, {pairs}) as (check, n)"))


def consolidate(
    store: Store, table: str, legacy: str, columns: list[str], dropped: list[str], complete_backup: bool, apply: bool = False, more: Callable[[DataFrame, DataFrame], dict[str, int]] | None = None
) -> Outcome:
    """Fill nulls of `columns` from the table `legacy`, and if every check holds, drop the columns `dropped` and that table.

    Without `apply` nothing is published, and the checks tell what a run would find. `more` adds checks of its own
    (name -> rows against it) on the table before and after. All of it is one version: after a check that fails, the
    store's files are those of before. A run is refused without a complete backup.
    """
    if apply and not complete_backup:
        raise ValueError("no complete backup")
    txn = store.begin()
    before, old = txn.read(table), txn.read(legacy)
    key = txn.table(table).key
    delta = fills(before, old, key, columns)
    report = txn.merge(table, delta, lambda rows, new: writes.merge(rows, new, key, {c: writes.filled for c in columns}))
    after = txn.read(table)
    checks = {r["check"]: r["n"] for r in parity(before, after, old, key, columns).collect()}
    checks |= more(before, after) if more else {}
    out = Outcome(checks, None, report)
    if apply and out.holds:
        txn.drop_columns(table, *dropped)
        txn.remove(legacy)
        out.version = txn.publish()
    return out
