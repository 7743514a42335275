"""Rows of a key in order, cut into chunks of at most so many rows and so much size.

The walk that decides where chunks begin looks at all rows before: a row begins a chunk if the open one is full. No
task walks a key. Rows get gapless ranks from a range partitioning, every `BLOCK` ranks are a block, and a block finds
for each place where a chunk may begin in it where the first chunk of the next block begins, and how many chunks that
takes: as a chunk has a bounded number of rows, these are as few places. The maps of the blocks of a key, one row for
`BLOCK` rows, are followed from block to block, and then each block cuts its own rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.session import materialise

#: Ranks of one block.
BLOCK = 4096


def ranked(df: DataFrame, key: str, *order: str, rank: str = "rank") -> DataFrame:
    """`df` with the gapless position, from 0, of each row among those of its key; a key may lie over many tasks.

    Rows that are equal in `order` get positions in any order. Null keys are one key. The result is a written table.
    """
    keys = [F.col(key), *[F.col(c) for c in order], F.xxhash64(F.monotonically_increasing_id())]
    spread = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id())

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = object(), 0
        for batch in batches:
            if not len(batch):
                continue
            values = batch.column(key)
            code = np.asarray(values.dictionary_encode().indices.fill_null(-1))
            fresh = np.concatenate([[values[0].as_py() != last], code[1:] != code[:-1]])
            at = np.arange(len(code))
            begins = np.maximum.accumulate(np.where(fresh, at, 0))
            head = np.cumsum(fresh) == 0
            place = np.where(head, at + seen, at - begins)
            seen, last = int(place[-1]) + 1, values[-1].as_py()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place, pa.int64())], [*batch.schema.names, "_place"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spread.schema)
    numbered = materialise(spread.mapInArrow(number, f"{fields}, _place long"), "ranked")
    # Keys that lie over several parts: at most two for each part, so this can be broadcast.
    parts = numbered.groupBy(F.col(key).alias("_key"), "_part").agg((F.max("_place") + 1).alias("_n"))
    several = parts.groupBy("_key").agg(F.collect_list(F.struct("_part", "_n")).alias("_parts")).filter(F.size("_parts") > 1)
    before = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = several.select("_key", F.inline("_parts")).select("_key", F.col("_part").alias("_in"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    met = numbered.join(F.broadcast(bases), F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_in")), "left")
    return met.withColumn(rank, F.coalesce("_base", F.lit(0)) + F.col("_place")).drop("_part", "_place", "_key", "_in", "_base")


def _next(sizes: np.ndarray, most_rows: int, most_size: int) -> np.ndarray:
    """For each row the row at which the chunk that begins there ends; a row that is too large alone is a chunk alone."""
    upto = np.concatenate([[0], np.cumsum(sizes)])
    by_size = np.searchsorted(upto, upto[:-1] + most_size, "right") - 1
    at = np.arange(len(sizes))
    return np.maximum(at + 1, np.minimum(by_size, at + most_rows))


def chunked(df: DataFrame, key: str, *order: str, size: str, most_rows: int, most_size: int, block: int = BLOCK) -> DataFrame:
    """`df` with rank and chunk, both from 0 in each key.

    A chunk takes the next row while it has less than `most_rows` rows and the row's size fits into `most_size`; a row
    that is larger alone makes a chunk of its own. Null and negative sizes count as 0; null keys are one key; an empty
    table gives no rows.
    """
    if most_rows < 1 or block < most_rows:
        raise ValueError("a chunk has at least one row and no more than a block")
    rows = ranked(df, key, *order)
    weight = F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0))
    number = F.floor(F.col("rank") / block).cast("long")
    light = rows.select(F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("")).alias("k"), "rank", weight.alias("size"))
    # The first rows of a block are wanted by the block before it too, whose last chunk may reach over them.
    own = light.withColumn("block", number)
    reach = own.filter((F.col("block") > 0) & (F.pmod("rank", F.lit(block)) < most_rows)).withColumn("block", F.col("block") - 1)
    dealt = own.union(reach).repartition("k", "block").sortWithinPartitions("k", "block", "rank")

    def groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
        """(k, block, the named columns) of each block, whole."""
        held, last = [], None
        for batch in batches:
            k, b = batch.column("k").to_pylist(), batch.column("block").to_numpy()
            code = np.asarray(batch.column("k").dictionary_encode().indices)
            cuts = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (b[1:] != b[:-1])])) if len(b) else []
            for i, j in zip(cuts, [*cuts[1:], len(b)]):
                if (k[i], int(b[i])) != last:
                    if held:
                        yield *last, *[np.concatenate(x) for x in zip(*held)]
                    held, last = [], (k[i], int(b[i]))
                held.append([batch.column(n).to_numpy()[i:j] for n in names])
        if held:
            yield *last, *[np.concatenate(x) for x in zip(*held)]

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = ([], [], [], [])
        for k, b, rank, sizes in groups(batches, ["rank", "size"]):
            inside = int((rank < (b + 1) * block).sum())
            following = _next(sizes, most_rows, most_size)
            leave, count = np.arange(len(rank) + 1), np.zeros(len(rank) + 1, np.int64)
            for i in range(inside - 1, -1, -1):
                j = following[i]
                leave[i], count[i] = leave[j], count[j] + 1
            entries = min(most_rows, inside)
            for column, x in zip(out, (k, b, (leave[:entries] - inside).tolist(), count[:entries].tolist()), strict=True):
                column.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), *(pa.array(x, pa.list_(pa.int64())) for x in out[2:])], ["k", "block", "leave", "count"])

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, entry, base = None, 0, 0
        for batch in batches:
            out = ([], [])
            for k, leave, count in zip(batch.column("k").to_pylist(), batch.column("leave").to_pylist(), batch.column("count").to_pylist(), strict=True):
                if k != last:
                    last, entry, base = k, 0, 0
                out[0].append(entry)
                out[1].append(base)
                if entry < len(leave):
                    base += count[entry]
                    entry = leave[entry]
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("block"), *(pa.array(x, pa.int64()) for x in out)], ["k", "block", "entry", "base"])

    summary = materialise(dealt.mapInArrow(maps, "k string, block long, leave array<long>, count array<long>"), "chunk-maps")
    entries = summary.repartition("k").sortWithinPartitions("k", "block").mapInArrow(follow, "k string, block long, entry long, base long")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, b, rank, sizes, entry, base in groups(batches, ["rank", "size", "entry", "base"]):
            following, begins, at = _next(sizes, most_rows, most_size), np.zeros(len(rank), np.int64), int(entry[0])
            while at < len(rank):
                begins[at] = 1
                at = int(following[at])
            chunk = base[0] - 1 + np.cumsum(begins)
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(rank), pa.string()), pa.array(rank), pa.array(chunk)], ["k", "rank", "chunk"])

    inside = own.join(entries, ["k", "block"]).repartition("k", "block").sortWithinPartitions("k", "block", "rank")
    found = inside.mapInArrow(cut, "k string, rank long, chunk long").withColumnRenamed("rank", "_rank")
    met = rows.join(found, F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("")).eqNullSafe(F.col("k")) & (F.col("rank") == F.col("_rank")))
    return met.drop("k", "_rank")
