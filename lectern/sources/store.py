"""A store of versioned tables whose files have key ranges, so that a write of few rows rewrites few files.

Below the root lie `data/` (Parquet files, never changed), `lists/` (for a state of a table, its files with their least
and greatest keys) and `versions/` (for each version, which list holds for each table, and the ledger). A version is
one small file that appears whole or not at all, so readers see all tables of a transaction or none; of two writers
that began at one version the second gets `Conflict`.

The driver holds one entry for each file of the tables that a transaction touches: with 256 MB files some 400,000 at
100 TB. Rows never pass it.
"""

from __future__ import annotations

import json
import uuid
from bisect import bisect_right
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lectern.sources.hdfs import Exists, Files

#: Rows of one file, about.
FILE_ROWS = 1 << 20


class Conflict(RuntimeError):
    """Another writer published a version first."""


@dataclass
class Table:
    """A state of a table: its key, its columns, and its files (path, least key, greatest key, rows) in the order of keys."""

    key: str
    schema: str
    files: list[tuple] = field(default_factory=list)

    @property
    def rows(self) -> int:
        return sum(f[3] for f in self.files)

    def to_json(self) -> str:
        return json.dumps({"key": self.key, "schema": self.schema, "files": self.files})


@dataclass
class Report:
    """What a write did to a table's files."""

    read: int
    written: int
    linked: int


class Store:
    def __init__(self, spark: SparkSession, root: str, file_rows: int = FILE_ROWS):
        self.spark, self.root, self.file_rows, self.files = spark, root.rstrip("/"), file_rows, Files(spark)

    def version(self) -> int:
        """The newest version; 0 before the first."""
        names = [n for n in self.files.names(f"{self.root}/versions") if n.endswith(".json")]
        return int(names[-1].split(".")[0]) if names else 0

    def state(self, version: int | None = None) -> dict:
        """{tables: {name: its list}, ledger: {...}} of a version."""
        version = self.version() if version is None else version
        return json.loads(self.files.read(self.at(version))) if version else {"tables": {}, "ledger": {}}

    def at(self, version: int) -> str:
        return f"{self.root}/versions/{version:012d}.json"

    def table(self, name: str, version: int | None = None) -> Table:
        found = json.loads(self.files.read(f"{self.root}/{self.state(version)['tables'][name]}"))
        return Table(found["key"], found["schema"], [tuple(f) for f in found["files"]])

    def read(self, name: str, version: int | None = None) -> DataFrame:
        return self.frame(self.table(name, version))

    def frame(self, table: Table, files: list[tuple] | None = None) -> DataFrame:
        """The rows of a table, or of some of its files."""
        schema = StructType.fromJson(json.loads(table.schema))
        paths = [f"{self.root}/{f[0]}" for f in (table.files if files is None else files)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def between(self, name: str, low, high, version: int | None = None) -> tuple[DataFrame, int]:
        """(rows with low <= key <= high, files that are read for them)."""
        table = self.table(name, version)
        files = [f for f in table.files if f[2] >= low and f[1] <= high]
        return self.frame(table, files).filter(F.col(table.key).between(low, high)), len(files)

    def begin(self) -> Transaction:
        return Transaction(self)

    def vacuum(self, keep: int = 2) -> int:
        """Delete the files that none of the newest `keep` versions names, and the older versions; how many data files went."""
        last = self.version()
        versions = [int(n.split(".")[0]) for n in self.files.names(f"{self.root}/versions")]
        kept = [v for v in versions if v > last - max(1, keep)]
        lists = {path for v in kept for path in self.state(v)["tables"].values()}
        used = {f[0] for path in lists for f in json.loads(self.files.read(f"{self.root}/{path}"))["files"]}
        for v in set(versions) - set(kept):
            self.files.delete(self.at(v))
        gone = 0
        for name in self.files.names(f"{self.root}/lists"):
            if f"lists/{name}" not in lists:
                self.files.delete(f"{self.root}/lists/{name}")
        folders = {u.rsplit("/", 1)[0] for u in used}
        for write in self.files.names(f"{self.root}/data"):
            for part in self.files.names(f"{self.root}/data/{write}"):
                inside = f"data/{write}/{part}"
                names = [inside] if part.endswith(".parquet") else [f"{inside}/{n}" for n in self.files.names(f"{self.root}/{inside}") if n.endswith(".parquet")]
                for path in names:
                    if path not in used:
                        self.files.delete(f"{self.root}/{path}")
                        gone += 1
            if not any(f == f"data/{write}" or f.startswith(f"data/{write}/") for f in folders):
                self.files.delete(f"{self.root}/data/{write}")
        return gone


class Transaction:
    """Writes to some tables, published together. Later writes see earlier ones; nobody else does before `publish`."""

    def __init__(self, store: Store):
        self.store, self.base = store, store.version()
        state = store.state(self.base)
        self.lists, self.ledger = dict(state["tables"]), dict(state["ledger"])
        self.changed: dict[str, Table] = {}

    def table(self, name: str) -> Table:
        return self.changed[name] if name in self.changed else self.store.table(name, self.base)

    def read(self, name: str) -> DataFrame:
        return self.store.frame(self.table(name))

    def put(self, name: str, df: DataFrame, key: str) -> Report:
        """A table as a whole. Keys are unique and not null."""
        count = df.count()
        parts = max(1, -(-count // self.store.file_rows))
        ordered = df.repartitionByRange(parts, key).sortWithinPartitions(key)
        table = Table(key, df.schema.json())
        table.files = self._written(name, ordered, key, None)
        if sum(f[3] for f in table.files) != count:
            raise ValueError(f"{name}: a key is null, or the input changed while it was written")
        self.changed[name] = table
        return Report(0, len(table.files), 0)

    def _written(self, name: str, df: DataFrame, key: str, by: str | None) -> list[tuple]:
        """Write rows and list the files with their ranges; the keys alone are read again."""
        folder = f"data/{name}-{uuid.uuid4().hex}"
        writer = df.write.option("maxRecordsPerFile", self.store.file_rows)
        (writer.partitionBy(by) if by else writer).parquet(f"{self.store.root}/{folder}")
        plain = StructType([f for f in df.schema.fields if f.name != by])
        source = self.store.spark.read.schema(plain).option("recursiveFileLookup", "true").parquet(f"{self.store.root}/{folder}")
        found = source.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.min(key).alias("least"), F.max(key).alias("most"), F.count(key).alias("rows")).collect()
        return sorted(((folder + r["path"].split(folder, 1)[1], r["least"], r["most"], r["rows"]) for r in found), key=lambda f: f[1])

    def _place(self, table: Table, key: Column) -> Column:
        """The number of the file whose range a key is in: the last one that begins at or before it."""
        starts = [f[1] for f in table.files][1:]

        @F.pandas_udf("int")
        def place(keys: pd.Series) -> pd.Series:
            return pd.Series([bisect_right(starts, k) for k in keys], dtype="int32")

        return place(key)

    def _rewrite(self, name: str, touched: set[int], after: Callable[[DataFrame], DataFrame]) -> Report:
        table = self.table(name)
        if not touched:
            return Report(0, 0, len(table.files))
        read = [table.files[k] for k in sorted(touched) if k < len(table.files)]
        rows = after(self.store.frame(table, read))
        part = "file_number"
        while part in rows.columns:
            part += "_"
        placed = rows.withColumn(part, self._place(table, F.col(table.key)) if table.files else F.lit(0))
        # Rows of one file stay together or follow one another; a file that has grown is cut, and its parts have ranges of their own.
        ordered = placed.repartitionByRange(max(1, len(read)), part, table.key).sortWithinPartitions(part, table.key)
        written = self._written(name, ordered, table.key, part)
        linked = [f for k, f in enumerate(table.files) if k not in touched]
        self.changed[name] = Table(table.key, table.schema, sorted(linked + written, key=lambda f: f[1]))
        return Report(len(read), len(written), len(linked))

    def merge(self, name: str, delta: DataFrame, rule: Callable[[DataFrame, DataFrame], DataFrame]) -> Report:
        """The table after `rule(rows, delta)`, a write by key: only files whose range a key of the delta is in are read and written.

        The rule has to leave rows with other keys as they are. Null keys are an error.
        """
        table = self.table(name)
        keys = delta.select(F.col(table.key).alias("key"))
        found = keys.select(self._place(table, F.col("key")).alias("file") if table.files else F.lit(0).alias("file"), F.col("key").isNull().alias("none")).distinct().collect()
        if any(r["none"] for r in found):
            raise ValueError(f"{name}: a key of the delta is null")
        schema = StructType.fromJson(json.loads(table.schema))
        return self._rewrite(name, {r["file"] for r in found}, lambda rows: rule(rows, delta).select(*schema.names))

    def update(self, name: str, where: Column, change: Callable[[DataFrame], DataFrame]) -> Report:
        """The table after `change` of the files that hold a row for which `where` is true. Keys stay as they are."""
        table = self.table(name)
        hit = self.read(name).filter(where).select(F.col("_metadata.file_path").alias("path")).distinct().collect() if table.files else []
        paths = {r["path"].rsplit("/data/", 1)[1] for r in hit}
        touched = {k for k, f in enumerate(table.files) if f[0].removeprefix("data/") in paths}
        return self._rewrite(name, touched, lambda rows: change(rows).select(*StructType.fromJson(json.loads(table.schema)).names))

    def reshape(self, name: str, change: Callable[[DataFrame], DataFrame]) -> Report:
        """The table with other columns: every file is written again."""
        table = self.table(name)
        return self.put(name, change(self.read(name)), table.key)

    def drop_columns(self, name: str, *columns: str) -> None:
        """The table without columns: its files stay as they are, and readers no longer ask for these."""
        table = self.table(name)
        fields = [f for f in StructType.fromJson(json.loads(table.schema)).fields if f.name not in columns]
        self.changed[name] = Table(table.key, StructType(fields).json(), table.files)

    def remove(self, name: str) -> None:
        """The bank without a table; older versions still have it."""
        self.lists.pop(name)
        self.changed.pop(name, None)

    def publish(self, **ledger) -> int:
        """Make all writes the next version, with `ledger` entries set; the version's number."""
        for name, table in self.changed.items():
            self.lists[name] = f"lists/{name}-{uuid.uuid4().hex}.json"
            self.store.files.write_new(f"{self.store.root}/{self.lists[name]}", table.to_json())
        state = json.dumps({"tables": self.lists, "ledger": self.ledger | ledger})
        try:
            self.store.files.write_new(self.store.at(self.base + 1), state)
        except Exists:
            raise Conflict(f"version {self.base + 1} is there already") from None
        return self.base + 1
