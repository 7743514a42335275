"""A sweep over a folder: files that are old enough are worked on by executors, and then lie under done or failed."""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.session import materialise
from lectern.sources.files import DONE
from lectern.sources.hdfs import Files
from lectern.sources.tree import escaped, files_of

OUTCOMES = "rel_path string, ok boolean, fault string"
#: Files of one sweep; the next one takes the others.
MOST = 1000


def outcomes(files: DataFrame, work: Callable[[str, bytes], None]) -> DataFrame:
    """(rel_path, ok, fault): `work` on the path and the content of each file; what it raises is that file's fault."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            faults = []
            for path, content in zip(batch["rel_path"], batch["content"], strict=True):
                try:
                    work(path, bytes(content))
                    faults.append(None)
                except Exception as e:  # whatever the work raises
                    faults.append(str(e) or type(e).__name__)
            yield pd.DataFrame({"rel_path": batch["rel_path"], "ok": [f is None for f in faults], "fault": faults})

    return files.select("rel_path", "content").mapInPandas(each, OUTCOMES)


def archive(files: Files, path: str, ok: bool) -> str:
    """Move a file to done or failed beside it, where no scan looks; one of that name there is replaced. Its new path."""
    folder, _, name = path.rpartition("/")
    target = f"{folder}/{DONE[0] if ok else DONE[1]}/{name}"
    files.move(path, target)
    return target


def sweep(spark: SparkSession, root: str, convert: Callable[[DataFrame], DataFrame], now: datetime.datetime, least_age: float, endings: tuple[str, ...] = ("pdf",), most: int = MOST) -> list[dict]:
    """One pass: {rel_path, ok, fault} of each file, in order of the paths.

    `convert` gets (rel_path, content) of files of these endings that have not changed for `least_age` seconds and do
    not lie under done or failed, and gives (rel_path, ok, fault). Files come under done or failed after that, one by
    one; a sweep that is killed before takes them again. A file without an outcome failed.
    """
    ending = F.lower(F.regexp_extract("rel_path", r"\.([^./]+)$", 1))
    old = F.col("modified") <= F.lit(now) - F.expr(f"interval {least_age} seconds")
    ready = files_of(spark, root).filter(ending.isin(*endings) & ~F.exists(F.split("rel_path", "/"), lambda x: x.isin(DONE)) & old).orderBy("rel_path").limit(most).select("path", "rel_path").collect()
    if not ready:
        return []
    names = spark.createDataFrame([(r["path"], r["rel_path"]) for r in ready], "path string, rel_path string")
    found = spark.read.format("binaryFile").load([escaped(r["path"]) for r in ready]).select("path", "content").join(F.broadcast(names), "path")  # `most` names
    told = {r["rel_path"]: r for r in materialise(convert(found.select("rel_path", "content")), "swept").collect()}
    files, out = Files(spark), []
    for r in ready:
        said = told.get(r["rel_path"])
        ok = bool(said and said["ok"])
        archive(files, r["path"], ok)
        out.append({"rel_path": r["rel_path"], "ok": ok, "fault": None if ok else said["fault"] if said else "no outcome"})
    return out
