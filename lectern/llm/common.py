"""Small helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that one Arrow batch may carry to Python. Texts can be long, so the default of 10,000 is too many.
ARROW_ROWS = 1000
#: And the bytes of one such batch.
ARROW_BYTES = 8 << 20
#: Slots of a sieve. Its size is fixed; when it is full it lets all pass, which costs a shuffle and loses nothing.
SIEVE = 1 << 22
#: Slots of a sieve that grows with what it marks: for each of those, and at most.
SPARE, MOST_SLOTS = 16, 1 << 26


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that carry whole texts to Python workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def texts_of(df: DataFrame, *others: str, text: str = "text") -> DataFrame:
    """The named columns and the text alone, so clashing extra columns never reach an operator."""
    return df.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{text}`").alias("text"))


def utf8(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each value of a string column, empty for null."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    for value in column.cast(pa.large_binary()):
        yield value.as_py() or b""


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying each value; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pa.compute.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]] if len(column) else raw[:0], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about `limit` bytes of text, one row at least, for work on arrays many times as large."""
    for batch in batches:
        offsets, at = buffer_of(batch.column("text"))[1], 0
        while at < len(batch):
            upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield batch.slice(at, upto - at)
            at = upto


def slots_for(marked: int) -> int:
    """Slots of a sieve for so many marked keys."""
    return min(MOST_SLOTS, max(SIEVE, 1 << (SPARE * marked).bit_length()))


def split_by_sieve(df: DataFrame, needed: DataFrame, *key: str, slots: int = SIEVE) -> tuple[DataFrame, DataFrame]:
    """`df` in two: rows that may have a partner in `needed` by the columns `key`, and rows that have none.

    It keeps rows without a part in a join out of that join's shuffle; the join after it stays exact. One bit a
    slot, in `slots` / 64 rows at most, is what is broadcast.
    """
    word, bits = fresh(df, "sieve_word", "sieve_bits")
    slot = F.pmod(F.xxhash64(*key), F.lit(slots)).cast("int")
    words = needed.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias(word)).agg(F.bit_or(F.expr("shiftleft(1L, slot & 63)")).alias(bits))
    met = df.join(F.broadcast(words), F.shiftright(slot, 6) == F.col(word), "left")
    passes = F.coalesce(F.getbit(F.col(bits), slot.bitwiseAND(F.lit(63))) == 1, F.lit(False))
    return met.filter(passes).select(*df.columns), met.filter(~passes).select(*df.columns)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like `names` that `df` does not have."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def with_rank(df: DataFrame, *order: str) -> DataFrame:
    """`df` with `rank`, the gapless position of each row in the order of these columns; no row is moved to one task."""
    from pyspark.sql import Window

    from lectern.session import materialise

    spread = materialise(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    # One row per range partition, so this window is small whatever the input.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = spread.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_part").orderBy(*order)
    return spread.join(F.broadcast(bases), "_part").withColumn("rank", F.col("_base") + F.row_number().over(inside) - 1).drop("_part", "_base")
