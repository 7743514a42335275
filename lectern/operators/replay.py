"""Writes that could not be made are parked with their rows, and made again in order, each step once.

A batch of a stream is a list of steps, such as a source and then its questions. The position of a stream, the last
(batch, step) that is in the store, is an entry of the store's ledger and is published with the tables of that step.
So a replay that is killed anywhere goes on behind the last step that was published, and repeats none.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lectern.sources.hdfs import Exists, Files
from lectern.sources.store import Conflict, Store, Transaction

#: A step: writes rows within a transaction.
Handler = Callable[[Transaction, DataFrame], object]
_ENTRY = "stream:"


class Parked:
    """Batches that wait below a folder: <stream>/<batch>/<step>, and a note of the steps that makes a batch whole."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark)

    def _at(self, stream: str, batch: int) -> str:
        return f"{self.root}/{stream}/{batch:012d}"

    def park(self, stream: str, steps: list[tuple[str, DataFrame]], batch: int | None = None) -> int:
        """Keep the steps (operation, rows) of a batch; its number, the next of its stream unless one is given. A batch that is kept already stays."""
        if "/" in stream or not stream:
            raise ValueError(f"no name of a stream: {stream}")
        names = [n for n in self.files.names(f"{self.root}/{stream}") if n.isdigit()]
        batch = (int(names[-1]) + 1 if names else 0) if batch is None else batch
        note = f"{self._at(stream, batch)}/steps.json"
        if not self.files.exists(note):
            for k, (_, rows) in enumerate(steps):
                rows.write.mode("overwrite").parquet(f"{self._at(stream, batch)}/{k}")
            try:
                self.files.write_new(note, json.dumps([op for op, _ in steps]))
            except Exists:
                pass  # another attempt kept the same batch
        return batch

    def waiting(self) -> tuple[list[tuple[str, int, list[str]]], list[str]]:
        """((stream, batch, operations) in order, folders whose note cannot be read). A batch without a note was never whole."""
        found, broken = [], []
        for stream in self.files.names(self.root):
            for name in self.files.names(f"{self.root}/{stream}"):
                note = f"{self.root}/{stream}/{name}/steps.json"
                if name.isdigit() and self.files.exists(note):
                    try:
                        ops = json.loads(self.files.read(note))
                        if not isinstance(ops, list):
                            raise ValueError("not a list")
                        found.append((stream, int(name), ops))
                    except (ValueError, OSError):
                        broken.append(f"{self.root}/{stream}/{name}")
        return found, broken

    def rows(self, stream: str, batch: int, step: int) -> DataFrame:
        return self.spark.read.parquet(f"{self._at(stream, batch)}/{step}")

    def drop(self, stream: str, batch: int) -> None:
        self.files.delete(self._at(stream, batch))


def position(store: Store, stream: str) -> tuple[int, int]:
    """The last (batch, step) of a stream that is in the store."""
    return tuple(store.state()["ledger"].get(_ENTRY + stream, (-1, -1)))


def apply_step(store: Store, stream: str, batch: int, step: int, handler: Handler, rows: DataFrame) -> bool:
    """One step, published with the stream's position; False if it was in the store already. Tried again when another writer came first."""
    while True:
        txn = store.begin()
        if tuple(txn.ledger.get(_ENTRY + stream, (-1, -1))) >= (batch, step):
            return False
        handler(txn, rows)
        try:
            txn.publish(**{_ENTRY + stream: [batch, step]})
            return True
        except Conflict:
            continue


def apply_batch(store: Store, stream: str, batch: int, steps: list[tuple[str, DataFrame]], handlers: dict[str, Handler]) -> None:
    """All steps of a batch that are not in the store yet, in order."""
    for k, (op, rows) in enumerate(steps):
        if op not in handlers:
            raise ValueError(f"unknown operation: {op}")
        apply_step(store, stream, batch, k, handlers[op], rows)


def replay(store: Store, parked: Parked, handlers: dict[str, Handler], attempts: int = 3, streams: set[str] | None = None) -> list[dict]:
    """Make the parked writes again, oldest first; what was done with each batch.

    A step that fails `attempts` times holds its stream: that step and all later ones stay parked, other streams go
    on. A batch whose steps are all in the store is dropped.
    """
    report, held = [], set()
    for stream, batch, ops in parked.waiting()[0]:
        if streams is not None and stream not in streams:
            continue
        row = {"stream": stream, "batch": batch, "outcome": "held", "tries": 0, "error": None}
        while stream not in held and row["outcome"] == "held":
            row["tries"] += 1
            try:
                apply_batch(store, stream, batch, [(op, parked.rows(stream, batch, k)) for k, op in enumerate(ops)], handlers)
                row |= {"outcome": "written", "error": None}
            except Exception as e:  # whatever a handler or the storage raises
                row["error"] = str(e).splitlines()[0] if str(e) else type(e).__name__
                if row["tries"] >= attempts:
                    held.add(stream)
        if row["outcome"] == "written":
            parked.drop(stream, batch)
        report.append(row)
    return report
