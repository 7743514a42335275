"""Files in and out: folder scans, snapshots, dumps, manifests, rotation, exports and parked writes.

Large outputs are written by Spark, one folder per table. The driver handles lists of files and manifests, whose
size does not grow with the rows.
"""

from __future__ import annotations

import datetime
import json
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DateType, DecimalType, NumericType, TimestampNTZType, TimestampType

from lectern.sources.hdfs import Files

# What a scan takes and what it leaves.
EXTENSIONS = ["jpg", "jpeg", "png", "webp", "pdf"]
KINDS = ["question", "answer"]
DONE = ["done", "failed"]
SET_NAME = r"[0-9]{8}-[0-9]{6}"
TABLE_NAME = r"[a-z_][a-z0-9_]*"


# Scans ----------------------------------------------------------------------------------------------------------


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, rel_path, modified, size) of every file below a folder; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = Files(spark).plain(root) + "/"
    rel = F.substr("path", F.instr("path", base) + F.lit(len(base)))
    return files.select("path", rel.alias("rel_path"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"))


def layout(rel_path: Column) -> Column:
    """struct<subject, grade, topic, type> of <subject>/<grade>/<topic>/<type>/<file>, the grade may lack; null else."""
    parts = F.split(rel_path, "/")
    n = F.size(parts)
    at = lambda i: F.get(parts, F.lit(i))
    kind = F.lower(F.element_at(parts, -2))
    with_grade = F.struct(at(0).alias("subject"), at(1).alias("grade"), at(2).alias("topic"), kind.alias("type"))
    without = F.struct(at(0).alias("subject"), F.lit(None).cast("string").alias("grade"), at(1).alias("topic"), kind.alias("type"))
    return F.when(~kind.isin(KINDS), None).when(n == 5, with_grade).when(n == 4, without)


def scan(spark: SparkSession, root: str, now: datetime.datetime, least_age: float) -> tuple[DataFrame, DataFrame]:
    """(items, refused): files ready to be read, questions first, and those of a wrong depth.

    Folders done and failed, other endings, other folders than question and answer and files younger than
    `least_age` seconds are left out. The type of a folder's meta.json wins over the folder's name.
    """
    found = listing(spark, root)
    metas = found.filter(F.col("rel_path").rlike(r"(^|/)meta\.json$")).select("path", F.regexp_replace("rel_path", "/?[^/]*$", "").alias("folder"))
    texts = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="meta.json").select(F.input_file_name().alias("file"), F.regexp_replace("value", "^﻿", "").alias("body"))
    name = lambda c: F.regexp_replace(F.regexp_replace(c, r"^[a-z]+:/+", "/"), "%20", " ")
    meta = metas.join(texts, name(F.col("path")) == name(F.col("file"))).select("folder", F.get_json_object("body", "$.type").alias("meta_type"))
    ending = F.lower(F.regexp_extract("rel_path", r"\.([^./]+)$", 1))
    parts = F.split("rel_path", "/")
    files = found.filter(ending.isin(EXTENSIONS) & ~F.exists(parts, lambda x: x.isin(DONE)) & (F.col("modified") <= F.lit(now) - F.expr(f"interval {least_age} seconds")))
    files = files.filter(F.lower(F.element_at(parts, -2)).isin(KINDS)).withColumn("at", layout(F.col("rel_path")))
    items = files.filter("at is not null").withColumn("folder", F.regexp_replace("rel_path", "/[^/]*$", "")).join(meta, "folder", "left")
    kind = F.when(F.col("meta_type").isin(KINDS), F.col("meta_type")).otherwise(F.col("at.type"))
    items = items.select("rel_path", "at.subject", "at.grade", "at.topic", kind.alias("type"), "size", "modified").orderBy(F.desc("type"), "rel_path")
    return items, files.filter("at is null").select("rel_path")


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The objects of a JSON array or of JSON lines; a missing, empty or broken file gives no rows."""
    if not Files(spark).exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)


# Snapshots ------------------------------------------------------------------------------------------------------


def _value(column: str, kind) -> Column:
    c = F.col(f"`{column}`")
    if isinstance(kind, (TimestampType, TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    if isinstance(kind, DecimalType):
        return c.cast("double")
    return F.lower(F.hex(c)) if isinstance(kind, BinaryType) else c


def _literal(column: str, kind) -> Column:
    c, quote = F.col(f"`{column}`"), lambda x: F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("''")), F.lit("'"))
    if isinstance(kind, NumericType):
        out = c.cast("string")
    elif kind.simpleString() == "boolean":
        out = F.upper(c.cast("string"))
    elif kind.simpleString().startswith(("array", "struct", "map")):
        out = quote(F.to_json(c))
    elif isinstance(kind, (TimestampType, TimestampNTZType, DateType)):
        out = quote(_value(column, kind).cast("string"))
    else:
        out = quote(_value(column, kind))
    return F.coalesce(out, F.lit("NULL"))


def insert_statements(df: DataFrame, name: str) -> DataFrame:
    """(value): one INSERT for each row, to be run in any SQL engine."""
    columns = ", ".join(f'"{c}"' for c in df.columns)
    values = F.concat_ws(", ", *[_literal(f.name, f.dataType) for f in df.schema])
    return df.select(F.concat(F.lit(f'INSERT INTO "{name}" ({columns}) VALUES ('), values, F.lit(");")).alias("value"))


def write_backup(tables: dict[str, DataFrame | None], root: str, now: datetime.datetime, trigger: str = "manual") -> dict:
    """Each table as JSON lines and as SQL under a new set, newest rows first, then the set's manifest.

    A table that is None is missing and noted. The manifest comes last and by a rename, so a set with one is whole.
    """
    name = now.strftime("%Y%m%d-%H%M%S")
    path, begin, entries, missing = f"{root}/{name}", datetime.datetime.now(), {}, []
    for t, df in tables.items():
        if df is None:
            missing.append(t)
            continue
        ordered = df.orderBy(F.desc_nulls_last("created_at")) if "created_at" in df.columns else df
        ordered.select(*[_value(f.name, f.dataType).alias(f.name) for f in df.schema]).write.option("ignoreNullFields", "false").json(f"{path}/{t}.json")
        insert_statements(ordered, t).write.text(f"{path}/{t}.sql")
        rows = df.sparkSession.read.text(f"{path}/{t}.json").count()
        entries[t] = {"rows": rows, "bytes": sum(_files().size(f"{path}/{t}.{x}") for x in ("json", "sql"))}
    manifest = {
        "set": name, "trigger": trigger, "tables": entries, "missing": missing, "rows": sum(e["rows"] for e in entries.values()), "bytes": sum(e["bytes"] for e in entries.values()),
        "seconds": round((datetime.datetime.now() - begin).total_seconds(), 3),
    }
    _files().write_new(f"{path}/manifest.json", json.dumps(manifest))
    return manifest


def _files() -> Files:
    """Shared storage as the running session sees it."""
    return Files(SparkSession.active())


def publish(df: DataFrame, root: str, name: str) -> str:
    """A new version of a table beside the old ones, made current by replacing one small pointer file."""
    version = f"{root}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(version)
    _files().replace(f"{root}/{name}.current", version)
    return version


def current(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(Files(spark).read(f"{root}/{name}.current"))


def sets(root: str) -> list[dict]:
    """The manifests below a folder, newest first; other names, and sets without a readable manifest, are left out."""
    files, out = _files(), []
    for name in reversed(files.names(root)):
        try:
            if re.fullmatch(SET_NAME, name):
                out.append(json.loads(files.read(f"{root}/{name}/manifest.json")))
        except (OSError, ValueError):
            continue
    return out


def complete_set(root: str, tables: list[str]) -> str | None:
    """The newest set that has every table as JSON and as SQL in storage."""
    files = _files()
    whole = lambda s, t, x: files.exists(f"{root}/{s}/{t}.{x}/_SUCCESS")
    return next((m["set"] for m in sets(root) if all(whole(m["set"], t, x) for t in tables for x in ("json", "sql"))), None)


def due(root: str, now: datetime.datetime, days: float = 1.0) -> bool:
    """Whether a new set is due: none yet, or the newest is that old."""
    found = sets(root)
    return not found or age_days(found[0]["set"], now) >= days


def age_days(name: str, now: datetime.datetime) -> float:
    return (now - datetime.datetime.strptime(name, "%Y%m%d-%H%M%S")).total_seconds() / 86400


def rotate(root: str, keep: int = 1) -> list[str]:
    """Delete all sets but the newest `keep`, one at least; their names."""
    old = [m["set"] for m in sets(root)][max(keep, 1) :]
    for name in old:
        _files().delete(f"{root}/{name}")
    return old


def backup_file(root: str, name: str, table: str, form: str) -> str:
    """The folder of one table of a set; names that are none, or that lead outside, are an error."""
    # Names of these forms have no separator and no "..", so a path made of them stays below the root.
    if not re.fullmatch(SET_NAME, name) or not re.fullmatch(TABLE_NAME, table) or form not in ("json", "sql"):
        raise ValueError("no such backup file")
    return f"{root}/{name}/{table}.{form}"


def tree_totals(spark: SparkSession, root: str) -> DataFrame:
    """(files, bytes) of a source tree."""
    return listing(spark, root).agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


# Other sinks ----------------------------------------------------------------------------------------------------


def stash(df: DataFrame, root: str, table: str, now: datetime.datetime) -> None:
    """Append rows, with the time, before they are deleted."""
    df.withColumn("deleted_at", F.lit(now.strftime("%Y-%m-%dT%H:%M:%S"))).write.mode("append").json(f"{root}/{table}.graveyard")


def append_log(spark: SparkSession, path: str, events: list[dict]) -> None:
    """Events of a run as JSON lines."""
    spark.createDataFrame([(json.dumps(e, ensure_ascii=False),) for e in events], "value string").write.mode("append").text(path)


def export_csv(df: DataFrame, path: str) -> None:
    """CSV with a byte order mark, every value in quotes, quotes doubled and null empty."""
    cell = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    head = "﻿" + ",".join('"' + c.replace('"', '""') + '"' for c in df.columns)
    lines = df.select(F.concat_ws(",", *[cell(c) for c in df.columns]).alias("value"))
    _files().replace(f"{path}/0-head.csv", head + "\n")
    lines.write.mode("append").text(path)


def park(spark: SparkSession, path: str, steps: list[dict]) -> None:
    """Append the operations of a write that failed, in order."""
    rows = [(k, json.dumps(s, ensure_ascii=False)) for k, s in enumerate(steps)]
    spark.createDataFrame(rows, "step int, op string").withColumn("parked_at", F.current_timestamp()).coalesce(1).write.mode("append").json(path)


def parked(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(operations, broken lines) that were parked, oldest first."""
    parsed = F.from_json("value", "step int, op string, parked_at timestamp, broken string", {"columnNameOfCorruptRecord": "broken"})
    raw = spark.read.text(path).select(parsed.alias("x")).select("x.*")
    return raw.filter("broken is null").drop("broken").orderBy("parked_at", "step"), raw.filter("broken is not null").select("broken")
