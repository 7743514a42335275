"""The SQL console: a guard behind Spark's own parser, results with a cap, and writes to a store.

Nothing is planned before the guard lets it through.
"""

from __future__ import annotations

import re
import threading
import time
import uuid
from collections.abc import Iterator

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.guard import Refused, inspect
from lectern.session import materialise
from lectern.sources.store import Conflict, Store

# What a result may hold, and how long a statement may take.
MOST_ROWS, SECONDS = 1000, 20
VERBS = {"select": "read", "with": "read", "insert": "write", "update": "write", "delete": "write"}


def _parts(sql: str) -> Iterator[tuple[str, str]]:
    """(code, comment, text or name; the part) of a statement; an unterminated one is refused."""
    at = begin = 0
    while at < len(sql):
        if sql.startswith("--", at):
            end = sql.find("\n", at)
            kind, end = "comment", len(sql) if end < 0 else end
        elif sql.startswith("/*", at):
            end = sql.find("*/", at + 2) + 2
            if end < 2:
                raise Refused("unterminated comment")
            kind = "comment"
        elif sql[at] in "'\"`":
            quote, end = sql[at], at + 1
            while end < len(sql) and (sql[end] != quote or sql[end + 1 : end + 2] == quote):
                end += 2 if sql[end] == quote else 1
            if end >= len(sql):
                raise Refused("unterminated literal")
            kind, end = "text" if quote == "'" else "name", end + 1
        else:
            at += 1
            continue
        yield "code", sql[begin:at]
        yield kind, sql[at:end]
        at = begin = end
    yield "code", sql[begin:]


def scrub(sql: str) -> str:
    """The statement without comments, each literal as ''."""
    out = {"comment": lambda x: " " if x.startswith("/*") else "", "text": lambda x: "''"}
    return "".join(out.get(kind, str)(part) for kind, part in _parts(sql)).strip().rstrip(";").strip()


def _unqualified(sql: str) -> str:
    """The statement with the names of views for those of tables in a schema, literals left alone."""
    shorter = lambda x: re.sub(r"(?i)\bpublic\s*\.\s*", "", re.sub(r"(?i)\binformation_schema\s*\.\s*(?=(columns|tables)\b)", "information_schema_", x))
    return "".join(shorter(part) if kind == "code" else part for kind, part in _parts(sql))


def quoted(name: str) -> str:
    """An identifier in backticks; anything but a plain lower-case name is refused."""
    if not re.fullmatch("[a-z_][a-z0-9_]*", name):
        raise Refused(f"no identifier: {name}")
    return f"`{name}`"


def guard(spark: SparkSession, sql: str, allowed: set[str]) -> tuple[str, str]:
    """(read or write, the statement): one SELECT, WITH, INSERT, UPDATE or DELETE over the tables `allowed`.

    The statement's words are looked at for its form alone: one statement, and WHERE written out in an UPDATE or
    DELETE. What it may do is decided by the nodes of its parsed plan (`operators.guard`).
    """
    kind, statement, *_ = _inspected(spark, sql, allowed)
    return "read" if kind == "read" else "write", statement


def _inspected(spark: SparkSession, sql: str, allowed: set[str]) -> tuple:
    """(read, insert, update or delete; the statement; the table written to; the parsed plan)."""
    if not sql.strip():
        raise Refused("empty")
    if "$" in sql:
        raise Refused("no $ is allowed")
    bare = scrub(sql)
    if not bare:
        raise Refused("empty")
    if ";" in bare:
        raise Refused("one statement at a time")
    verb = re.match("[a-z]*", bare.lower())[0]
    if verb not in VERBS:
        raise Refused(f"not allowed: {verb}")
    if verb in ("update", "delete") and not re.search(r"\bwhere\b", bare, re.I):
        raise Refused(f"{verb} needs WHERE")
    statement = sql.strip().rstrip(";")
    kind, into, _, plan = inspect(spark, statement, allowed)
    return kind, statement, into, plan


def _in_session(session: SparkSession, df: DataFrame) -> DataFrame:
    """The same rows as a frame of another session."""
    return _frame(session, df._jdf.queryExecution().logical())


def _frame(session: SparkSession, plan) -> DataFrame:
    return DataFrame(session._jvm.org.apache.spark.sql.classic.Dataset.ofRows(session._jsparkSession, plan), session)


def _column(session: SparkSession, expression) -> Column:
    return Column(session._jvm.org.apache.spark.sql.classic.ExpressionUtils.column(expression))


def _condition(session: SparkSession, kind: str, plan) -> Column:
    """The WHERE of an UPDATE or DELETE; null is false."""
    return F.coalesce(_column(session, plan.condition().get() if kind == "update" else plan.condition()), F.lit(False))


def _write(store: Store, kind: str, name: str, plan) -> int:
    """Apply an INSERT, UPDATE or DELETE to a table of the store and publish it; the number of rows that it changed."""
    session, txn = store.spark, store.begin()
    table = txn.table(name)
    columns = txn.read(name).columns
    if kind == "insert":
        top, insert = plan, plan
        while insert.getClass().getSimpleName() != "InsertIntoStatement":
            insert = insert.child()
        query = insert.query() if top.equals(insert) else top.copy(insert.query(), top.cteRelations(), top.allowRecursion())
        rows = _frame(session, query)
        given = [insert.userSpecifiedCols().apply(k).lower() for k in range(insert.userSpecifiedCols().length())] or columns
        if len(given) != len(rows.columns) or set(given) - set(columns):
            raise ValueError(f"columns do not fit: {', '.join(given)}")
        types = dict(txn.read(name).dtypes)
        rows = rows.toDF(*given).select(*[F.col(c).cast(types[c]).alias(c) if c in given else F.lit(None).cast(types[c]).alias(c) for c in columns])
        rows = materialise(rows, "inserted")
        if not txn.read(name).join(rows, table.key, "left_semi").isEmpty() or not rows.groupBy(table.key).count().filter("count > 1").isEmpty():
            raise ValueError(f"a row with this {table.key} is there already")
        count = rows.count()
        txn.merge(name, rows, lambda old, new: old.unionByName(new))
    else:
        where = _condition(session, kind, plan)
        count = txn.read(name).filter(where).count()
        if kind == "delete":
            txn.update(name, where, lambda rows: rows.filter(~where))
        else:
            assigned = [plan.assignments().apply(k) for k in range(plan.assignments().length())]
            values = {a.key().nameParts().last().lower(): _column(session, a.value()) for a in assigned}
            if unknown := set(values) - set(columns):
                raise ValueError(f"unknown columns: {sorted(unknown)}")
            if table.key in values:
                raise ValueError(f"not editable: {table.key}")
            types = dict(txn.read(name).dtypes)
            change = lambda rows: rows.select(*[F.when(where, values[c].cast(types[c])).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in columns])
            txn.update(name, where, change)
    txn.publish()
    return count


def run_sql(spark: SparkSession, sql: str, tables: dict[str, DataFrame] | None = None, store: Store | None = None) -> dict:
    """A statement's result: kind, columns, rows, truncated, elapsed_ms, affected and error.

    It runs over `tables`, or over a store's tables, in a session of its own. A read gives up to `MOST_ROWS` rows;
    truncated is true from that number on. A write changes the store: only files with a row that it changes are
    written again, and the new version is there whole or not at all. Without a store an UPDATE or DELETE gives the
    number of rows that it would change, and an INSERT is an error. What Spark refuses, and a statement over `SECONDS`
    seconds, is an error in the result; what the guard refuses never reaches Spark.
    """
    names = set(store.state()["tables"]) if store else set(tables or {})
    kind, statement, into, plan = _inspected(spark, sql, names)
    begin, out = time.monotonic(), {"kind": "read" if kind == "read" else "write", "columns": [], "rows": [], "truncated": False, "affected": None, "error": None}
    group, session = uuid.uuid4().hex, spark.newSession()

    def work() -> None:
        # The thread has a job group of its own, so the caller's stays as it is.
        session.sparkContext.setJobGroup(group, "console", True)
        try:
            own = Store(session, store.root, store.file_rows) if store else None
            for name in names:
                (own.read(name) if own else _in_session(session, tables[name])).createOrReplaceTempView(name)
            if kind == "read":
                known = {n: session.table(n) for n in names}
                if "information_schema" in statement.lower():
                    schema_rows(session, known, {}).selectExpr("table as table_name", "column as column_name", "position as ordinal_position", "type as data_type").createOrReplaceTempView("information_schema_columns")
                    session.createDataFrame([(n,) for n in sorted(known)], "table_name string").createOrReplaceTempView("information_schema_tables")
                found = session.sql(_unqualified(statement))
                rows = [tuple(r) for r in found.limit(MOST_ROWS).collect()]
                out.update(columns=found.columns, rows=rows, truncated=len(rows) >= MOST_ROWS)
            elif own is None and kind == "insert":
                raise ValueError("there is no store to write to")
            elif own is None:
                out["affected"] = session.table(into).filter(_condition(session, kind, plan)).count()
            else:
                out["affected"] = _write(own, kind, into, plan)
        except (PySparkException, Py4JError, ValueError, Conflict) as e:
            out["error"] = str(e).splitlines()[0]

    thread = threading.Thread(target=work, daemon=True)
    thread.start()
    thread.join(SECONDS)
    while thread.is_alive():
        # Again and again: a job that planning delayed past the limit starts after the first time.
        spark.sparkContext.cancelJobGroup(group)
        thread.join(0.5)
    return out | {"elapsed_ms": round((time.monotonic() - begin) * 1000)}


def schema_rows(spark: SparkSession, tables: dict[str, DataFrame], keys: dict[str, str]) -> DataFrame:
    """(table, column, position, type, nullable, is_key): what the console knows of its tables."""
    rows = [(t, f.name, k + 1, f.dataType.simpleString(), f.nullable, keys.get(t) == f.name) for t, df in tables.items() for k, f in enumerate(df.schema)]
    return spark.createDataFrame(rows, "table string, column string, position int, type string, nullable boolean, is_key boolean")


def profile(spark: SparkSession, tables: dict[str, DataFrame], keys: dict[str, str]) -> DataFrame:
    """What the console knows of its tables, with filled, the rows that have a value, and rows: one scan of each table."""
    known = schema_rows(spark, tables, keys)
    out = None
    for name, df in tables.items():
        counts = df.agg(F.count("*").alias("all rows"), *[F.count(F.col(f"`{c}`")).alias(f"n{k}") for k, c in enumerate(df.columns)])
        pairs = ", ".join(f"{k + 1}, n{k}, `all rows`" for k in range(len(df.columns)))
        one = counts.select(F.lit(name).alias("table"), F.expr(f"stack({len(df.columns)}, {pairs}) as (position, filled, rows)"))
        out = one if out is None else out.union(one)
    return known.join(out, ["table", "position"])


def row_by_id(df: DataFrame, key: str, ident) -> DataFrame:
    return df.filter(F.col(key) == F.lit(ident))


def capped(df: DataFrame, *order: str, most: int = MOST_ROWS) -> DataFrame:
    """The first `most` rows by `order`, with truncated: whether there were that many."""
    first = df.orderBy(*order).limit(most)
    n = first.agg((F.count("*") >= most).alias("truncated"))
    return first.crossJoin(F.broadcast(n))  # one row


def staged_list(df: DataFrame, source=None, status: str | None = None, has_box: bool | None = None) -> DataFrame:
    """Staged records of a source, with a status, with or without a box; what is None asks for nothing."""
    for column, value in (("source_id", source), ("status", status)):
        if value is not None:
            df = df.filter(F.col(column) == F.lit(value))
    return df if has_box is None else df.filter(F.col("has_box") == F.lit(has_box))
